"""What grows with the documents is no broadcast, which the driver would build, however small its files are."""

import random

from quillmill.llm import simhash_copies


def _broadcasts(spark, since):
    held = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [held.apply(k) for k in range(held.size())]
    return sum("BroadcastExchange" in e.physicalPlanDescription() for e in plans if e.executionId() > since)


def _last(spark):
    held = spark._jsparkSession.sharedState().statusStore().executionsList()
    return max((held.apply(k).executionId() for k in range(held.size())), default=-1)


def test_near_copies_are_found_without_broadcasts(spark, docs_of):
    r = random.Random(8)
    rows = [(k, " ".join(r.choice("abcdefghijkl") * 3 + str(r.randrange(60)) for _ in range(80))) for k in range(60)]
    rows += [(100 + k, t + " more") for k, t in rows[:30]]
    since = _last(spark)
    kept = simhash_copies.keep_one(docs_of(rows)).collect()
    assert {x.doc_id for x in kept} == set(range(60))
    assert _broadcasts(spark, since) == 0
