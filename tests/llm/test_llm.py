"""Each training-data operator against brute force or the library, over awkward rows: nulls, empty and long texts, ties,
repeated rows, clashing column names, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmill.llm import bpe, chat_format, components, exact_dedup, license_scan, packing, quality, record_files, simhash, substring_dedup, toxicity

WORDS_BPE, BYTES_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
BLANK = r"[\x20\x09-\x0D]+"


def prose(seed, n):
    r = random.Random(str(seed))
    return " ".join(r.choice(["lorem", "Ipsum", "dölor", "sit", "amet,", "vel", "nunc.", "x1", "QUI", "a"]) + r.choice(["", "", "um", "ibus"]) for _ in range(n))


PASSAGE = prose("passage", 70)
ROWS = [
    (0, None),
    (1, ""),
    (2, "  \n\t "),
    (3, "one"),
    (4, prose(4, 120)),
    (5, prose(4, 120).replace(" ", "\n", 3)),
    (6, prose(4, 120)),
    (6, prose(4, 120)),
    (7, prose(7, 60) + " " + PASSAGE + " " + prose(8, 30)),
    (8, PASSAGE + "\n" + prose(9, 10)),
    (9, prose(10, 40) + "\t" + PASSAGE),
    (10, "a b <|endoftext|>  c\n\n d 's 've 　x  \n ý \x01z <|startoftext|>  "),
    (11, "Released under the MIT License. Licensed under the Apache License, Version 2.0 and cc by-nc"),
    (12, "This work is licensed under the GNU General Public License, version 3."),
    (13, "word " * 4000),
    (14, " ".join(f"w{k}" for k in range(9000))),
    (15, "été 中文字符 emoji 😀😀 naïve\r\nline\x0bnext\x0cpage \\ \\n <| <\\| "),
    (None, "no id"),
    (None, prose(4, 120)),
]


@pytest.fixture(scope="module")
def docs(docs_of):
    return docs_of(ROWS)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_token_records_round_trip(spark, docs, none):
    tok = Tokenizer.from_file(WORDS_BPE)
    back = record_files.read_records(record_files.write_records(docs, WORDS_BPE, 2)).orderBy("part", "record").collect()
    ordered = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    for doc_id, text in ordered:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in back] == want
    assert record_files.read_records(record_files.write_records(none, WORDS_BPE, 2)).count() == 0


def test_records_are_read_in_any_order_and_damage_is_seen(spark, docs, tmp_path):
    path = record_files.write_records(docs, WORDS_BPE, 2, f"file://{tmp_path}").first().path
    held = record_files.RecordFile(path)
    in_order = [(d, i.tolist()) for d, i in held.in_order()]
    shuffled = [(d, i.tolist()) for d, i in held.shuffled(1)]
    assert sorted(map(repr, shuffled)) == sorted(map(repr, in_order)) and (len(in_order) < 3 or shuffled != in_order)
    file = path.removeprefix("file://") + ".rec"
    data = bytearray(open(file, "rb").read())
    data[20] ^= 1
    open(file, "wb").write(data)
    with pytest.raises(ValueError):
        list(record_files.RecordFile(path).in_order())


def test_license_scan(docs, none):
    found = license_scan.scan(docs).collect()
    assert len(found) == len(ROWS)
    by = {r.doc_id: r for r in found}
    assert [b.word for b in by[11].base] == [1, 8, 14]
    assert by[11].base_labels == ["apache-2", "cc-by-nc", "mit"] and by[12].base_labels == [] and by[12].labels == ["gpl-3"]
    for r in found:
        text = next(t or "" for d, t in ROWS if d == r.doc_id)
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        if r.doc_id is not None:
            assert r.n_words == len(words)
    assert license_scan.scan(none).count() == 0


def brute_licences(text):
    """Labels and score by comparing every block with every template, then setting aside what a better match explains."""
    words, matches = license_scan.words_of(text), []
    sets = [set(license_scan.words_of(t)) for _, t in license_scan.TEMPLATES]
    for k, (label, template) in enumerate(license_scan.TEMPLATES):
        stride = 4
        while stride < len(license_scan.words_of(template)):
            stride *= 2
        for at in range(0, len(words), stride):
            common = len(sets[k] & set(words[at : at + 2 * stride]))
            if common >= 0.8 * len(sets[k]):
                matches.append((k, label, at, at + 2 * stride, common))
    left = []
    for k, label, low, high, common in matches:
        size, beaten = len(sets[k]), False
        for k2, label2, low2, high2, common2 in matches:
            shared, share, share2 = len(sets[k] & sets[k2]), common / size, common2 / len(sets[k2])
            explains = label != label2 and shared >= 0.8 * size and low < high2 and low2 < high
            better = share2 > share + 1e-12 or (abs(share2 - share) < 1e-12 and common2 > common)
            beaten |= explains and better and not (common == size and shared < size)
        if not beaten:
            left.append((label, common / size))
    base = {x for _, x in license_scan.base_places(words)}
    return base | {x for x, _ in left}, 1.0 if base else max((s for _, s in left), default=0.0)


def test_license_blocks_equal_brute_force(docs_of):
    r = random.Random(3)
    texts = []
    for k in range(60):
        label, words = r.choice(license_scan.TEMPLATES)
        kept = [w for w in words.split() if r.random() < r.choice([0.7, 0.8, 0.9, 1.0])]
        more = " ".join(r.choice(license_scan.TEMPLATES)[1].split()[: r.randrange(40)]) if k % 3 == 0 else ""
        texts.append((k, prose(k, r.randrange(40)) + " " + " ".join(kept) + "\n" + more + prose(k + 1, r.randrange(40))))
    got = {x.doc_id: (set(x.labels), x.score) for x in license_scan.scan(docs_of(texts)).collect()}
    for k, text in texts:
        labels, score = brute_licences(text)
        assert got[k] == (labels, pytest.approx(score))


def test_each_template_gets_its_own_label_alone(docs_of):
    rows, want = [], {}
    for k, (label, text) in enumerate(license_scan.TEMPLATES):
        for j, (before, after) in enumerate([("", ""), (prose(k, 90) + " ", " " + prose(k + 1, 90)), ("x " * k, "")]):
            rows.append((10 * k + j, before + text + after))
            want[10 * k + j] = {label}
    got = {x.doc_id: set(x.labels) for x in license_scan.scan(docs_of(rows)).collect()}
    assert got == want


def _toxic_rows(n, seed):
    r = random.Random(str(seed))
    rows = []
    for k in range(n):
        toxic, low = r.random() < 0.2, r.random() < 0.2
        words = prose((seed, k), r.randrange(20, 120)).split()
        for _ in range(3 * toxic):
            words.insert(r.randrange(len(words)), r.choice(["scumword", "badword", "vileword"]))
        text = " ".join(words) + (" ##!! ##!!" if low else "")
        rows.append((k, text, int(not low), int(toxic)))
    return rows


def test_toxicity_on_held_out_documents(spark, docs_of):
    rows = _toxic_rows(500, 1)
    table = docs_of([r[:2] for r in rows] + ROWS[:3])
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows[:350]] + [(0, None, None), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.reject_toxic(docs_of([(r[0] + 10_000, r[1]) for r in rows[350:]]).unionByName(table), labels).collect()}
    held_out = rows[350:]
    assert np.mean([found[r[0] + 10_000].toxic == bool(r[3]) for r in held_out]) > 0.95
    assert np.mean([(found[r[0] + 10_000].p_low_quality >= 0.5) == (not r[2]) for r in held_out]) > 0.95
    kept = toxicity.drop_toxic(table, labels)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in found.items() if r.kept and k is not None and k < 10_000}


def test_toxicity_chain_uses_out_of_fold_probabilities():
    rows = _toxic_rows(300, 2)
    sets = [toxicity.features(r[1]) for r in rows]
    y = {"toxic": np.array([r[3] for r in rows], float), "same": np.array([r[3] for r in rows], float)}
    chain, held_out = toxicity.fit_chain(sets, y)
    assert [x.category for x in chain] == ["toxic", "same"] and chain[1].earlier[0] > 0 and held_out.shape == (300, 2)


def test_toxicity_probabilities_are_those_of_the_weights(spark, docs_of):
    rows = _toxic_rows(200, 7)
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows[:150]], "doc_id long, quality int, toxic int")
    docs = docs_of([r[:2] for r in rows])
    chain, threshold = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.reject_toxic(docs, labels).collect()}
    for k, text, _, _ in rows:
        low, toxic = chain
        found = toxicity.features(text)
        p = 1 / (1 + np.exp(-(low.intercept + sum(w for f, w in low.weights.items() if f in found))))
        q = 1 / (1 + np.exp(-(toxic.intercept + sum(w for f, w in toxic.weights.items() if f in found) + toxic.earlier[0] * p)))
        assert abs(got[k].p_low_quality - p) < 1e-9 and abs(got[k].p_toxic - q) < 1e-9 and got[k].toxic == (q >= threshold)


def test_a_fold_never_sees_its_own_labels():
    r = random.Random(9)
    # each document has a word of its own beside those that all share: whoever saw a label would know it by that word
    sets = [{b"own%d" % (k // 5), b"all"} for k in range(100)]
    y = np.array([r.random() < 0.5 for _ in range(100)], float)
    turned = y.copy()
    turned[::5] = 1 - turned[::5]  # the labels of fold 0
    held, other = (toxicity.fit_chain(sets, {"x": v})[1][:, 0] for v in (y, turned))
    assert (held[::5] == other[::5]).all() and (held[1::5] != other[1::5]).any()


def test_the_threshold_follows_the_false_alarms():
    y = np.array([1] * 50 + [0] * 1000)
    sure = np.concatenate([np.full(50, 0.9), np.full(1000, 0.01)])
    assert toxicity.best_threshold(sure, y) == 0.05
    noisy = sure.copy()
    noisy[60:70] = 0.25
    assert toxicity.best_threshold(noisy, y) == 0.3
    assert toxicity.best_threshold(np.full(1050, 0.99), y) == 0.5 and toxicity.best_threshold(np.array([]), np.array([])) == 0.5


def test_toxicity_without_labels(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = toxicity.reject_toxic(docs, labels).collect()
    assert len(found) == len(ROWS)
    assert toxicity.reject_toxic(none, labels).count() == 0


def test_chat_parts_become_placeholders(spark):
    parts = [("text", "look <|im_end|> \\", None, None), ("image", None, "a.png", 2.0), ("audio", None, "b.wav", 3.5), ("text", None, None, None), ("document", None, "c.pdf", None)]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok\n<|im_start|>", None, None)]), (1, 1, "assistant", [("text", "", None, None)]), (None, None, None, None), (2, 0, "we\\n\nird<|", [])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content {chat_format.PARTS}").withColumn("head", F.lit(1))
    made = chat_format.format_conversations(df)
    r = made.where("conv_id = 1").first()
    assert "<|image:1|><|audio:2|><|document:3|>" in r.formatted
    assert [(a.turn_index, a.ordinal, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, 1, "image", "a.png", 392), (0, 2, "audio", "b.wav", 88), (0, 3, "document", "c.pdf", 512)]
    assert r.expanded_tokens == 992 and r.n_turns == 3
    assert "".join(r.formatted[m.start : m.start + m.length] for m in r.loss_mask) == "ok\n<\\|im_start|>"
    back = {x.conv_id: x for x in chat_format.read_back(made).collect()}
    assert back[1].loss_text == "ok\n<|im_start|>"
    assert back[2].turns[0].role == "we\\n\nird<|" and back[None].turns[0].text == ""
    assert made.where("false").count() == 0


def test_packing_certifies_and_keeps_every_piece(spark, docs, none):
    tok = Tokenizer.from_file(BYTES_BPE)
    rows = packing.pack_documents(docs, BYTES_BPE, per_part=5).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 2048
    for doc_id, text in ROWS:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        lengths = packing.cut_lengths(len(ids), 2048)
        assert sum(lengths) == len(ids) and all(n == 2048 for n in lengths[1:])
        if doc_id not in (None, 6):
            assert [(r.start, r.length, r.ids_crc32) for r in sorted(pieces[doc_id], key=lambda r: r.piece)] == [(sum(lengths[:k]), n, zlib.crc32(np.array(ids[sum(lengths[:k]) : sum(lengths[: k + 1])], "<u4").tobytes())) for k, n in enumerate(lengths)]
    assert packing.pack_documents(none, BYTES_BPE).count() == 0


def test_lower_bound_never_exceeds_a_packing():
    r = random.Random(5)
    for _ in range(200):
        capacity = r.choice([10, 97, 2048])
        lengths = np.array([r.randint(1, capacity) for _ in range(r.randrange(1, 60))])
        bins, offsets, n = packing.best_fit_decreasing(lengths, capacity)
        filled = np.bincount(bins, lengths, n)
        assert filled.max() <= capacity and packing.lower_bound(lengths, capacity) <= n
    assert packing.lower_bound(np.array([51] * 7), 100) == 7  # more than volume says


def test_exact_dedup_equals_brute_force(docs, none):
    got = Counter(map(tuple, exact_dedup.exact_dedup(docs).collect()))
    norm = [(d, re.sub(BLANK, " ", t or "")) for d, t in ROWS]
    want = Counter()
    for d, t in norm:
        group = [x for x, u in norm if u == t]
        keep = min((x for x in group if x is not None), default=None)
        want[(d, keep, len(group), d == keep, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert got == want
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, k, _, kept, _ in want if kept}


def test_cuckoo_index_inserts_deletes_and_grows():
    index, held, r = exact_dedup.CuckooIndex(2), {}, random.Random(1)
    for k in range(4000):
        digest = hashlib.sha256(str(r.randrange(900)).encode()).digest()
        if digest in held:
            assert index.get(digest, 5) == held[digest] and index.get(digest, 6) is None
            if r.random() < 0.4:
                assert index.delete(digest, 5)
                del held[digest]
        else:
            assert index.get(digest, 5) is None and not index.delete(digest, 5)
            index.insert(digest, 5, k)
            held[digest] = k
    assert {d: p for d, _, p in index.items()} == held and index.live == len(held) and index.resized > 3


def test_index_follows_changes(spark, docs_of):
    rows = exact_dedup.digests(docs_of([(1, "a"), (2, "a"), (3, "b")]))
    index = exact_dedup.build_index(rows)
    changed = exact_dedup.update_index(index, exact_dedup.digests(docs_of([(4, "c"), (0, "a")])), exact_dedup.digests(docs_of([(3, "b"), (2, "a")])))
    assert sorted((r.keep_id, r.group_size) for r in changed.collect()) == [(0, 2), (4, 1)]


def test_substring_dedup_equals_brute_force(docs, none):
    got = Counter(map(tuple, substring_dedup.substring_digests(docs).collect()))
    big = 2**63 - 1
    cut = [(d, (t or ""), re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in ROWS]
    first = {}
    for d, _, w in cut:
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            first[key] = min(first.get(key, big), big if d is None else d)
    want = Counter()
    for d, _, w in cut:
        gone = set()
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < (big if d is None else d):
                gone |= set(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[(d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert got == want and any(n for _, _, n, _ in want)
    assert substring_dedup.substring_digests(none).count() == 0
    cleaned = substring_dedup.remove_repeats(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(ROWS)
    assert {r.text for r in cleaned.where("doc_id = 15").collect()} == {dict(ROWS)[15]}


@pytest.mark.parametrize("width, grain", [(5, 2), (8, 4)])
def test_super_kmers_in_small_alphabets(docs_of, width, grain):
    r = random.Random(width)
    rows = [(k, " ".join(r.choice("ab") for _ in range(r.randrange(40)))) for k in range(60)]
    got = {x.doc_id: x.n_removed for x in substring_dedup.substring_digests(docs_of(rows), width, grain).collect()}
    first = {}
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), d)
    for d, t in rows:
        w = t.split()
        gone = {j for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < d for j in range(i, i + width)}
        assert got[d] == len(gone)


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    r = random.Random(6)
    lines = sorted({" ".join(r.choice("abc") for _ in range(r.randrange(4, 12))).encode() for _ in range(30)})
    least, greatest = list(range(30))[: len(lines)], [k + k % 2 for k in range(len(lines))]
    want = substring_dedup.shared_windows(lines, least, greatest, 4)
    monkeypatch.setattr(substring_dedup.xxhash, "xxh64_intdigest", lambda x, *a: len(x) % 2)
    assert substring_dedup.shared_windows(lines, least, greatest, 4) == want


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, near):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash_equals_brute_force(docs_of, none):
    r = random.Random(9)
    rows = [(d, t) for d, t in dict(ROWS).items() if d is not None]
    for k in range(40):
        words = prose(k % 8, 200).split()
        for _ in range(r.randrange(4)):
            words[r.randrange(len(words))] = "changed"
        rows.append((100 + k, " ".join(words)))
    fps = {d: brute_fingerprint(t or "") for d, t in rows}
    want = brute_components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.near_dedup(docs_of(rows)).collect()}
    assert got == {d: (f"{fps[d]:016x}", want[d]) for d in fps}
    assert simhash.near_dedup(none).count() == 0
    kept = simhash.keep_one(docs_of(rows))
    assert {x.doc_id for x in kept.collect()} == {d for d in fps if want[d] == d}


def test_links_connect_what_all_pairs_would(spark):
    r = random.Random(2)
    fps = {r.getrandbits(64) for _ in range(50)}
    for f in list(fps)[:20]:  # chains of near fingerprints, and one big group
        for _ in range(r.choice([3, 10])):
            for _ in range(r.randrange(1, 6)):
                f ^= 1 << r.randrange(64)
            fps.add(f)
    centre = r.getrandbits(64)
    fps |= {centre ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = brute_components(sorted(signed), lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = simhash.links(df)
    for one_task in (0, 1 << 20):
        got = {x.node: x.component for x in components.components(links, one_task).collect()}
        assert {n: got.get(n, n) for n in signed} == want
    assert links.count() < 70 * len(signed)


def test_simhash_bound_is_below_the_distance():
    r = np.random.default_rng(1)
    a, b = (r.integers(-(2**63), 2**63 - 1, 500) for _ in range(2))
    assert (simhash.manhattan(simhash.embed(a), simhash.embed(b)) <= np.bitwise_count((a ^ b).view(np.uint64))).all()


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_estimates(docs, none, docs_of):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    r = random.Random(8)
    odd = [(100 + k, "".join(r.choice(["a", "b ", " ", "\n", "#", "é|", "\t", "x y z ", "<$>", "q\n"]) for _ in range(r.randrange(200)))) for k in range(60)]
    texts = dict(ROWS) | dict(odd)
    found = quality.judge(docs.unionByName(docs_of(odd))).collect()
    assert len(found) == len(ROWS) + len(odd)
    for x in found:
        if x.doc_id is not None:
            assert tuple(x[n] for n in names) == brute_counts(texts[x.doc_id] or "")
    assert quality.judge(none).count() == 0


def test_quality_discounts_a_rule_that_is_noise():
    r = np.random.default_rng(5)
    n = 20_000
    bad = r.random(n) < 0.2
    votes = np.where(r.random((n, 4)) < 0.02, -1, 1)
    votes[:, :3][bad & (r.random(n) < 0.9)] = -1
    votes[:, 3] = np.where(r.random(n) < 0.3, -1, 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    shares, rates = quality.estimate(patterns, counts.astype(float))
    good = dict(zip(map(tuple, patterns.tolist()), quality.kind_odds(patterns, shares, rates)[:, 0], strict=True))
    kept = np.array([good[tuple(v)] >= 0.5 for v in votes.tolist()])
    assert kept[~bad].mean() > 0.95 and rates[0, 3] == pytest.approx(0.3, abs=0.03)


def test_quality_estimates_find_the_bad_kinds():
    r = np.random.default_rng(4)
    bad = r.random(5000) < 0.2
    kind = r.integers(0, 3, 5000)
    votes = np.where(r.random((5000, 4)) < 0.1, 0, np.where(r.random((5000, 4)) < 0.01, -1, 1))
    for k in range(3):
        votes[bad & (kind == k) & (r.random(5000) < 0.95), k] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    good = dict(zip(map(tuple, patterns.tolist()), quality.kind_odds(patterns, *quality.estimate(patterns, counts.astype(float)))[:, 0], strict=True))
    said = np.array([good[tuple(v)] >= 0.5 for v in votes.tolist()])
    assert (said == ~bad).mean() > 0.95


def test_bpe_equals_the_library(docs, none):
    tok = Tokenizer.from_file(BYTES_BPE)
    got = Counter((r.doc_id, bytes(r.ids), r.decoded) for r in bpe.encode_documents(docs, BYTES_BPE).collect())
    want = Counter()
    for d, t in ROWS:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[(d, np.array(ids, "<u4").tobytes(), tok.decode(ids, skip_special_tokens=False))] += 1
    assert got == want
    assert bpe.encode_documents(none, BYTES_BPE).count() == 0


def test_every_letter_before_every_mark():
    import unicodedata

    import pyarrow as pa
    from quillmill.llm.tokens import TextEncoder

    letters = [chr(c) for c in range(0x80, 0x32400) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    marks = ".,;:!?"
    texts = ["".join(f"a {c}{m} b{c}{m}\n{c}{c.lower()}x{m} " for m in (marks[k % 6], marks[(k + 1) % 6]) for c in letters[k : k + 40]) for k in range(0, len(letters), 40)]
    for path, make in ((BYTES_BPE, TextEncoder), (WORDS_BPE, TextEncoder), (BYTES_BPE, bpe.PairIndexBPE)):
        tok = Tokenizer.from_file(path)
        want = tok.encode_batch(texts, add_special_tokens=False)
        for text, ids, x in zip(texts, make(path).encode_each(pa.array(texts)), want, strict=True):
            assert ids.tolist() == x.ids, text[:20]


def test_bpe_on_random_texts():
    import pyarrow as pa

    r = random.Random(11)
    pieces = [" ", "  ", "\n", "\n\n", "\t", " \n", " ", "a", "the", "The", "'s", "'ll", "12", ".", "!?", "é", "中", "😀", "<|endoftext|>", "ing", "\x01", " ", "\r\n", "\x85", "\x1c"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(30))) for _ in range(1500)]
    tok, own = Tokenizer.from_file(BYTES_BPE), bpe.PairIndexBPE(BYTES_BPE)
    for text, ids in zip(texts, own.encode_each(pa.array(texts)), strict=True):
        assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)
    from quillmill.llm.tokens import TextEncoder

    for path in (BYTES_BPE, WORDS_BPE):
        tok = Tokenizer.from_file(path)
        for text, ids in zip(texts, TextEncoder(path).encode_each(pa.array(texts)), strict=True):
            assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_wide_fingerprints_are_majorities():
    import numpy as np

    from quillmill.llm import simhash_copies
    from quillmill.llm.simhash import majority

    draw = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 4, 5, 8, 9, 16, 63, 64, 255, 256, 1000):
        held = np.unique(draw.integers(1 << 63, size=n, dtype=np.uint64))
        mixed = [(held ^ (held >> np.uint64(31))) * mix for mix in simhash_copies._MIXES]
        assert simhash_copies.wide_fingerprint(held) == [majority(x ^ (x >> np.uint64(32))) for x in mixed]
