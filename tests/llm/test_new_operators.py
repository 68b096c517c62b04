"""Circulant MinHash, whitening and the filter audit against brute force, over awkward rows."""

import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import filter_audit, linking, minhash, whitening
from tests.llm.test_llm import ROWS, prose


def shingles(text, width):
    words = _words(text)
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def _words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w.decode() for w in low.encode().split()]


def brute_components(rows, width, per_cent):
    """doc_id -> (set size, smallest doc_id reachable), for distinct doc_ids."""
    sets = {d: shingles(t, width) for d, t in rows}
    left, out = {d for d in sets if sets[d]}, {d: d for d in sets}
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            at = todo.pop()
            seen.add(at)
            near = {d for d in left if 100 * len(sets[at] & sets[d]) >= per_cent * len(sets[at] | sets[d])}
            left -= near
            todo += near
        for d in seen:
            out[d] = min(seen)
    return {d: (len(sets[d]), out[d]) for d in sets}


def varied(seed, text, n):
    r = random.Random(str(seed))
    words = text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.random()}"
    return " ".join(words)


@pytest.fixture(scope="module")
def near_rows():
    rows = [(k, prose(("m", k), 12 + 9 * k)) for k in range(40)]
    rows += [(100 + k, varied(k, rows[k % 40][1], 1 + k % 7)) for k in range(200)]
    rows += [(400 + k, " ".join(f"s{j}" for j in range(k % 4, 9 + k % 5))) for k in range(20)]  # tiny sets
    group = prose("group", 300)
    rows += [(1000 + k, varied(("g", k), group, 9)) for k in range(150)]  # one group about the threshold
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one"), (2004, "ONE"), (2005, "one two"), (2006, "word " * 3000), (2007, " ".join(f"w{k}" for k in range(9000)))]
    return rows


@pytest.mark.parametrize("members", [1024, 16])
def test_minhash_is_brute_force(spark, docs_of, near_rows, monkeypatch, members):
    monkeypatch.setattr(linking, "_MEMBERS", members)  # small blocks: big clusters are split, and their blocks meet
    found = {r.doc_id: r for r in minhash.near_dedup(docs_of(near_rows)).collect()}
    want = brute_components(near_rows, 2, 80)
    assert {d: (r.n_shingles, r.component_id) for d, r in found.items()} == want
    assert all(r.kept == (d == r.component_id) for d, r in found.items())
    assert len({c for _, c in want.values()}) < len(want) - 100


def test_minhash_repeats_nulls_and_no_rows(spark, docs_of):
    found = minhash.near_dedup(docs_of(ROWS))
    rows = sorted(map(tuple, found.collect()), key=repr)
    assert len(rows) == len(ROWS) and found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    of = {}
    for d, n, c, k in rows:
        of.setdefault(d, []).append((n, c, k))
    assert of[6][0] == of[6][1] == (of[4][0][0], 4, False)  # copies; one of them with a null doc_id
    assert (of[4][0][0], 4, False) in of[None] and of[0] == [(0, 0, True)] and of[1] == [(0, 1, True)]
    assert [r for r in of[None] if r[2]] and minhash.near_dedup(docs_of(ROWS).where("false")).count() == 0


def test_signature_is_two_permutations():
    ranks = minhash._ranks()
    held = np.unique(np.random.default_rng(2).integers(1 << 63, size=50, dtype=np.uint64))
    second = np.concatenate([ranks[:, 0], ranks[:, 0]])
    bins = [int(h * minhash._SPREADER >> np.uint64(44)) for h in held]
    assert minhash.signature(held, ranks).tolist() == [min(int(second[b + k]) for b in bins) for k in range(minhash.COORDINATES)]
    assert sorted(ranks[:, 0].tolist()) == list(range(minhash._BINS))


def test_similar_pairs_of_any_frequency():
    r = random.Random(4)
    sets = [np.array(sorted({r.randrange(60) for _ in range(r.choice([1, 20, 70]))} | {100}), np.uint64) for _ in range(90)]
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if 100 * len(a := {*sets[i].tolist()} & {*sets[j].tolist()}) >= 60 * len({*sets[i].tolist()} | {*sets[j].tolist()}) and a}
    assert {tuple(p) for p in linking.similar_pairs(sets, 60).tolist()} == want


def test_cells_connect_all_pairs_within_the_radius():
    draw = np.random.default_rng(3)
    for n in (5, 32, 33, 300):
        sketch = draw.integers(1 << 12, size=(n, 2), dtype=np.int64)
        item, cell = np.arange(n) + 10, np.zeros(n, np.int64)
        got = {frozenset(c) for c in _parts(range(10, n + 10), linking.cell_forest(cell, item, sketch, 4).tolist())}
        pairs = [(10 + i, 10 + j) for i in range(n) for j in range(i) if int(linking._far(sketch[i], sketch[j])) <= 4]
        assert got == {frozenset(c) for c in _parts(range(10, n + 10), pairs)}


def _parts(nodes, edges):
    of = {n: {n} for n in nodes}
    for a, b in edges:
        if of[a] is not of[b]:
            of[a] |= of[b]
            for n in list(of[b]):
                of[n] = of[a]
    return of.values()


def vectors_of(spark, rows):
    return spark.createDataFrame([(k, v, 1.0, 2) for k, v in rows], "vec_id long, embedding array<float>, whitened double, n int")


@pytest.mark.parametrize("scale", [1.0, 3000.0])
def test_whitening_is_numpy(spark, scale):
    draw = np.random.default_rng(6)
    points = (draw.normal(size=(700, 12)) * (1 + np.arange(12)) * scale).astype(np.float32)
    rows = [(k, p.tolist()) for k, p in enumerate(points)] + [(5, points[5].tolist()), (None, points[6].tolist())]
    bad = [(900, None), (901, [1.0] * 11 + [None]), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (904, [1.0]), (905, []), (906, [1e30] * 12)]
    found = whitening.whiten(vectors_of(spark, rows + bad).repartition(5)).collect()
    x = np.floor(1024 * np.array([v for _, v in rows], np.float32).astype(float)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(found) == 8 * n and {r.vec_id for r in found} == {k for k, _ in rows}
    white = centred @ vectors[:, :8] / np.sqrt(values[:8])
    sign = {}
    for r in found:
        at = next(i for i, (k, _) in enumerate(rows) if k == r.vec_id)
        want = white[at, r.component - 1]
        s = sign.setdefault(r.component, np.sign(r.whitened * want))
        assert abs(r.whitened - s * want) < 1e-8 and abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9
        assert int(r.deviation) == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[at], total, strict=True)) and r.n == n and r.identity_error < 1e-9
    assert len({r.identity_error for r in found}) == 1


def test_whitening_of_few_equal_and_no_vectors(spark):
    few = whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0, 3.0]), (2, [2.0, 2.0, 3.0])])).collect()
    assert sorted((r.vec_id, r.component, r.whitened is None) for r in few) == [(v, c, c > 1) for v in (1, 2) for c in (1, 2, 3)]
    equal = whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0])] * 4)).collect()
    assert len(equal) == 8 and all(r.whitened is None and r.deviation == 0 and r.explained == 0 and r.identity_error == 0 for r in equal)
    for rows in ([], [(1, None)], [(1, [])], [(1, [float("nan")])]):
        assert whitening.whiten(vectors_of(spark, rows)).collect() == []


def test_merged_moments_are_those_of_the_whole():
    x = np.random.default_rng(8).integers(-(2**40), 2**40, size=(300, 4))
    held = whitening.nothing(4)
    for k in range(0, 300, 37):
        held = whitening.of_integers(x[k : k + 37]).merged(held)
    assert held.n == 300 and held.sums == [int(s) for s in x.astype(object).sum(axis=0)]
    np.testing.assert_allclose(held.scatter, np.cov(x.T, bias=True) * 300, rtol=1e-12)
    huge = np.array([[2**62, 5], [2**62, 6], [-(2**62), 7]])
    assert whitening.exact_sums(huge) == [2**62, 18] and whitening.squares(whitening.times_less(huge, 3, [2**62, 18]))[0] == (2**63) ** 2 + 9


AUDIT = [
    (1, "word " * 120, "en"), (2, " ".join(f"w{k}" for k in range(120)), "en"), (3, " ".join(f"w{k}" for k in range(120)), "de"), (4, " ".join(f"W{k}" for k in range(120)), None),
    (5, "", ""), (6, None, "en"), (7, "ABC # $", "en"), (8, "ABC # $", "en"), (8, "ABC # $", "en"), (None, "ABC # $", "en"), (None, "alone " * 100, "fr"), (9, " ".join(f"été{k}" for k in range(100)) + " x*", "fr"),
    (10, " ".join(f"v{k} " * 5 for k in range(2000)), "en"),
]


def brute_audit(rows, labels):
    def fails(d, t):
        words = [w for w in (t or "").encode().split()]
        smaller = [x for x, o in ((x, o or "") for x, o, _ in rows) if o == (t or "") and x is not None and (d is None or x < d)]
        return {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t or "") > 10 * len(t or ""), "D": any(c in "#$%&*|" for c in t or ""), "E": bool(smaller)}

    good, toxic = ({d for d, *y in labels if y[k] == 1 and d is not None} for k in (0, 1))
    out, marked = [], [(lang or "", d, fails(d, t)) for d, t, lang in rows]
    for part in {p for p, _, _ in marked}:
        mine = [(d, f) for p, d, f in marked if p == part]
        steps, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for k, x in enumerate(order):
                gone = [d for d, f in left if f[x]]
                left = [(d, f) for d, f in left if not f[x]]
                shapley[x] += len(gone)
                failing = sum(f[x] for _, f in mine)
                steps.append((part, "".join(order), k + 1, len(left), len(gone), failing - len(gone), sum(f[x] and sum(f.values()) == 1 for _, f in mine), sum(d in good for d in gone), sum(d in toxic for d in gone)))
        out += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def test_audit_is_brute_force(spark):
    labels = [(1, 1, 0), (1, 0, 1), (2, None, 1), (4, 1, None), (7, 1, 1), (8, 0, 1), (None, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in AUDIT], "doc_id long, text string, lang string, mask int, part string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(docs, table)
    assert sorted(map(tuple, found.collect())) == brute_audit(AUDIT, labels)
    assert filter_audit.audit(docs.where(F.lit(False)), table).collect() == []
    assert filter_audit.audit(docs, table.where(F.lit(False))).agg(F.sum("good_lost")).first()[0] == 0


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5])
def test_plain_changes_visit_every_order_once(k):
    order, seen = list(range(k)), {tuple(range(k))}
    for at in filter_audit.plain_changes(k):
        order[at], order[at + 1] = order[at + 1], order[at]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert seen == set(permutations(range(k)))
