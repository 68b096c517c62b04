"""Each registered query of this subpackage on the smallest tables: its rows are those of its SQL where it has one, and its
contract's columns hold what the input says."""

import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillmill.llm import queries
from tests.llm.test_llm import brute_counts
from tests.test_oracles import SF, TABLES, rows_of


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF / t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, str(SF))
    names = sorted(df.columns)
    columns = ", ".join(f'"{n}"' for n in names)
    assert rows_of(names, df.select(*names).collect()) == rows_of(names, duck.sql(f"SELECT {columns} FROM ({queries.ORACLES[name]})").fetchall())


@pytest.fixture(scope="module")
def texts(duck):
    return {d: t or "" for d, t in duck.sql("SELECT doc_id, text FROM documents").fetchall()}


def ids_of(texts, name, end):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    return {d: [*tok.encode(t, add_special_tokens=False).ids, *end] for d, t in texts.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, texts):
    ids, start, want = ids_of(texts, "word_bpe_49k.json", [2]), 0, []
    for d in sorted(ids):
        want.append((d, start, len(ids[d]), crc(ids[d])))
        start += len(ids[d])
    assert sorted(map(tuple, queries.op1_token_records(spark, str(SF)).collect())) == want


def test_op5(spark, texts):
    ids, held = ids_of(texts, "byte_bpe_50k.json", [0]), {}
    rows = queries.op5_best_fit_packing(spark, str(SF)).collect()
    for r in rows:
        assert crc(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    assert len(held) <= 1.02 * sum(map(len, ids.values())) / 2048 + 1


def test_op9(spark, texts):
    for r in queries.op9_quality_rules(spark, str(SF)).collect():
        counts = brute_counts(texts[r.doc_id])
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (*counts, failed)
        assert not (failed and r.kept)


def test_op10(spark, texts):
    tok, ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), ids_of(texts, "byte_bpe_50k.json", [])
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for r in queries.op10_bpe(spark, str(SF)).collect():
        held = ids[r.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(held), sha(np.array(held, "<u4").tobytes()), sha(tok.decode(held, skip_special_tokens=False).encode()))


@pytest.mark.parametrize("name", ["op3_toxicity", "op8_simhash"])
def test_one_row_for_each_document(spark, texts, name):
    assert sorted(r.doc_id for r in queries.QUERIES[name](spark, str(SF)).collect()) == sorted(texts)


def test_op12(spark, duck):
    held = duck.sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    x = np.floor(1024 * np.array([v for _, v in held], float)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    values = np.linalg.eigvalsh(centred.T @ centred / n)[::-1]
    want = {k: sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, total, strict=True)) for (k, _), row in zip(held, x, strict=True)}
    rows = queries.op12_whitening(spark, str(SF)).collect()
    assert sorted((r.vec_id, r.component) for r in rows) == [(k, c) for k in sorted(want) for c in range(1, 9)]
    for r in rows:
        assert (r.n, r.deviation) == (n, want[r.vec_id]) and abs(r.explained * values.sum() / values[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    white = np.array([[r.whitened for r in sorted(rows, key=lambda r: r.vec_id) if r.component == c] for c in range(1, 9)])
    np.testing.assert_allclose(np.cov(white, bias=True), np.eye(8), atol=1e-9)
