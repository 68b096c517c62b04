"""The similarity joins find every pair, and compare whole sets only where a pair of terms bounds their similarity."""

import itertools
import math
import random
import re

import pytest

from quillmill.operators import duplicates

WORDS = [f"w{k}" for k in range(40)]


def some_sets(seed):
    """Small and large sets, near copies of some, and terms from frequent to single ones."""
    r, out = random.Random(seed), set()
    for k in range(120):
        s = frozenset(r.choices(WORDS, [1 / (i + 1) for i in range(40)], k=r.randint(1, 20)))
        out |= {s, s | {f"own{k}"}, frozenset(list(s)[: r.randint(1, len(s))]), frozenset(r.sample(WORDS[:4], r.randint(1, 3)))}
    return sorted(map(sorted, out))


@pytest.mark.parametrize("threshold", [0.15, 0.34, 0.5, 0.85])
@pytest.mark.parametrize("strict", [False, True])
def test_every_similar_pair_comes_once(spark, threshold, strict):
    sets = some_sets(int(threshold * 100))
    found = duplicates.similar_classes(spark.createDataFrame(list(enumerate(sets)), "item long, terms array<string>"), threshold, strict).collect()
    jaccard = {(i, j): len(set(a) & set(b)) / len(set(a) | set(b)) for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2)}
    want = {p: s for p, s in jaccard.items() if (s > threshold if strict else s >= threshold)}
    assert len(found) == len(want) and {(r.a, r.b): r.similarity for r in found} == want


@pytest.mark.parametrize("threshold", [0.3, 0.7, 0.9])
def test_semantic_links_are_those_of_all_pairs(spark, docs_of, threshold):
    sets = some_sets(5)
    df = {t: sum(t in s for s in sets) for s in sets for t in s}
    w = {t: math.log((1 + len(sets)) / (1 + n)) + 1 for t, n in df.items()}
    norm = [math.sqrt(sum(w[t] ** 2 for t in s)) for s in sets]
    want = [0] * len(sets)
    for i, j in itertools.combinations(range(len(sets)), 2):
        if round(sum(w[t] ** 2 for t in set(sets[i]) & set(sets[j])) / norm[i] / norm[j], 9) >= threshold:
            want[i] += 1
            want[j] += 1
    docs = docs_of([(k, "") for k in range(len(sets))])
    held = spark.createDataFrame([(k, s, 1) for k, s in enumerate(sets)], "doc_id long, terms array<string>, length int")
    found = {r.doc_id: r.n_links for r in duplicates.semantic_duplicates(docs, threshold, held).collect()}
    assert found == dict(enumerate(want))


def test_sets_that_share_a_rare_term_do_not_all_meet(spark, docs_of, monkeypatch):
    plans, stored = {}, duplicates.stored

    def noted(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    monkeypatch.setattr(duplicates, "stored", noted)
    docs = docs_of([(k, f"common words {'alpha beta gamma delta'[: 6 + k]}") for k in range(12)])
    duplicates.near_duplicates(docs)
    duplicates.semantic_duplicates(docs)
    assert len(plans["pairs"]) == 2
    for plan in plans["pairs"]:
        compared = [x for x in plan.split("\n") if "Join" in x and "array_intersect" in x]
        assert compared and all(re.search(r"Join \[[ab]#", x) for x in compared), compared  # by id, not by term
