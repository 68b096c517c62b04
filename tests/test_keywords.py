"""Key terms of texts: counted within rows, over the rows of a repeated key together, and never shuffled."""

from collections import Counter

import pytest

from quillmill.functions import text as T

ROWS = [(1, "beta beta alpha gamma gamma 1234 the the the"), (2, None), (3, ""), (4, "zeta " * 3 + "eta iota"), (None, "kappa kappa lambda")]


def _want(rows):
    held = {}
    for key, t in rows:
        held.setdefault(key, []).extend((t or "").split())
    out = {}
    for key, words in held.items():
        top = Counter(words).most_common(4)
        out[key] = sorted((w, n, k + 1) for k, (w, n) in enumerate(top) if len(w) > 3 and not w.isdigit())
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize("more", [[], [(4, "zeta eta eta eta eta"), (None, "lambda lambda")]], ids=["once", "repeated"])
def test_key_terms(spark, more):
    df = spark.createDataFrame(ROWS + more, "doc_id long, text string").coalesce(2)
    got = {}
    for r in T.key_terms(df, "doc_id", "text", k=4).collect():
        got.setdefault(r.doc_id, []).append((r.word, r.freq, r.rank))
    assert {k: sorted(v) for k, v in got.items()} == _want(ROWS + more)
    sets = {r.doc_id: r.terms for r in T.key_term_sets(df, "doc_id", "text", k=4).collect()}
    assert sets == {k: [w for w, _, _ in v] for k, v in _want(ROWS + more).items()}


def test_words_are_not_shuffled(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    for found in (T.key_term_sets(df, "doc_id", "text"), T.chat_keywords(df, "doc_id", "text"), T.metadata_keywords(df, "doc_id", "text")):
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
