"""The pipeline's stages take effect, keep clean documents, and equal brute force where that can be said."""

import random

import pytest

import corpus_pipeline
from quillmill.llm import common, linking, simhash_copies
from quillmill.llm.common import written
from tests.llm.test_llm import _toxic_rows, prose


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rows = _toxic_rows(300, 5)
    docs = [(k, t) for k, t, _, _ in rows]
    r = random.Random(1)
    passage = prose("shared", 80)
    docs += [(1000 + k, docs[k][1].replace(" ", "  ", 1)) for k in range(20)]
    docs += [(2000 + k, " ".join(w if r.random() > 0.004 else "other" for w in prose(("near", k % 5), 600).split())) for k in range(15)]
    docs += [(3000 + k, prose(("own", k), 100) + " " + passage + " " + prose(("tail", k), 50)) for k in range(6)]
    docs += [(4000, None), (4001, "")]
    table = spark.createDataFrame([(d, t, "en", "src0", None if t is None else len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, q, t) for k, _, q, t in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return f"file://{folder}", rows


def test_stages(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, folder), name)
        assert docs.columns == columns
        kept[name] = {r.doc_id: r for r in docs.collect()}
    toxic = {k for k, _, _, t in rows if t}
    assert len(toxic & kept["toxicity"].keys()) <= 0.05 * len(toxic)
    assert len(kept["toxicity"]) >= 300 + 20 + 15 + 6 + 2 - 1.4 * len(toxic) - 5
    assert not {k for k in range(1000, 1020) if k - 1000 in kept["toxicity"]} & kept["exact_dedup"].keys()
    assert 4000 in kept["exact_dedup"] and 4001 not in kept["exact_dedup"]
    assert len({k for k in kept["simhash_dedup"] if 2000 <= k < 3000}) <= 10
    last = kept["substring_dedup"]
    assert prose("shared", 80) in last[3000].text and prose("shared", 80) not in last[3001].text
    assert last[3001].n_chars == len(last[3001].text)


def test_run_packs_what_stays(spark, corpus):
    folder, _ = corpus
    packed = corpus_pipeline.run(spark, folder).collect()
    assert packed and all(r.length <= 2048 for r in packed)
    assert {r.doc_id for r in packed} & {3000, 4000}


def _alike(a, b):
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_stage_finds_copies_at_080_to_095(spark, docs_of):
    rows, r = [], random.Random(3)
    for k in range(60):
        words = prose(("base", k), 150 + 10 * k).split()
        rows.append((k, " ".join(words)))
        aim = r.uniform(0.8, 0.95)
        while _alike(rows[k][1], " ".join(words)) > aim + 0.01:
            words[r.randrange(len(words))] = f"other{r.random()}"
        rows.append((1000 + k, " ".join(words)))
    near = {k for k in range(60) if _alike(rows[2 * k][1], rows[2 * k + 1][1]) >= 0.8}
    assert len(near) >= 50
    far = [(2000 + k, " ".join(prose(("far", k // 2), 300).split()[: 200] + prose(("tail", k), 100).split())) for k in range(20)]
    group = prose("group", 400).split()
    crowd = [(3000 + k, " ".join(w if (k * 7 + j) % 97 else f"own{k}x{j}" for j, w in enumerate(group))) for k in range(97)]
    kept = {x.doc_id for x in corpus_pipeline.simhash_stage(spark, docs_of(rows + far + crowd), "").collect()}
    wanted = {k for k in range(60)} | {1000 + k for k in range(60) if k not in near} | {d for d, _ in far}
    texts, left, parts = dict(crowd), set(dict(crowd)), set()
    while left:
        parts.add(min(left))
        todo = [min(left)]
        left.discard(todo[0])
        while todo:
            at = todo.pop()
            step = {d for d in left if _alike(texts[at], texts[d]) >= 0.8}
            left -= step
            todo += step
    assert kept == wanted | parts


def _components(texts):
    """Of doc_id -> text: doc_id -> the smallest of its component, by brute force."""
    sets = {d: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for d, t in texts.items() if (w := t.split())}
    left, out = set(sets), {}
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            at = todo.pop()
            seen.add(at)
            near = {d for d in left if 5 * len(sets[at] & sets[d]) >= 4 * len(sets[at] | sets[d])}
            left -= near
            todo += near
        out |= dict.fromkeys(seen, min(seen))
    return out


def _near(spark, docs_of, rows):
    return {r.doc_id: r.component_id for r in simhash_copies.near_dedup(docs_of(rows)).collect()}


def test_near_stage_finds_short_texts(spark, docs_of):
    """Texts of 5 to 40 words against themselves less a word or two: no link at 0.8 is lost."""
    rows = []
    for k in range(400):
        words = [f"t{k}x{j}" for j in range(5 + k % 36)]
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(words[:-1])), (3 * k + 2, " ".join(words[1:]))]
    assert _near(spark, docs_of, rows) == _components(dict(rows))


def _loose_group(n, changes=6):
    base = [f"b{j}" for j in range(400)]
    rows = []
    for k in range(n):
        r = random.Random(k)
        words = list(base)
        for at in r.sample(range(400), changes):
            words[at] = f"own{k}x{at}"
        rows.append((k, " ".join(words)))
    return rows


@pytest.mark.parametrize("members", [1024, 100])
def test_near_stage_keeps_every_link_of_a_loose_group(spark, docs_of, monkeypatch, members):
    """500 texts, each six changes from a common one, so that most pairs lie just below 0.8 and few above."""
    monkeypatch.setattr(linking, "_MEMBERS", members)
    rows = _loose_group(500)
    assert _near(spark, docs_of, rows) == _components(dict(rows))


def test_a_loose_group_makes_no_rows_of_its_pairs(spark, docs_of, monkeypatch):
    """Of groups of 300, 600 and 1,200 texts just below 0.8 the rows that leave a step grow with the group."""
    made = []
    for n in (300, 600, 1200):
        held = []

        def written(df, name, held=held):
            out = common.written(df, name)
            held.append(out.count())
            return out

        monkeypatch.setattr(linking, "written", written)
        monkeypatch.setattr(simhash_copies, "written", written)
        assert len(_near(spark, docs_of, _loose_group(n, 9))) == n
        made.append(max(held))
    assert made[2] <= 5 * made[0] and made[2] <= 3 * 1200


def test_stages_and_run_on_no_documents_and_awkward_ones(spark, docs_of, tmp_path):
    from tests.llm.test_llm import ROWS

    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(d, t, None, "", 0) for d, t in ROWS], "doc_id long, Text string, lang string, source string, n_chars long")
    for table in (docs, docs.where("false")):
        held = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            held = written(stage(spark, held, f"file://{tmp_path}"), name)
            assert [c.lower() for c in held.columns] == [c.lower() for c in docs.columns]
        assert corpus_pipeline.STAGES[-1][1](spark, held, "").count() >= held.count()
    docs.where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
