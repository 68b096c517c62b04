"""Licence scan: base phrases, and an exact set-similarity join of text blocks with licence templates.

Words are runs of digits, lower-cased letters and characters beyond ASCII. A template of up to L words (L a power of
two) is looked for in blocks of 2L words that start at every L-th word, so any L words in a row lie whole in a block. A
block holds a template if it has at least `threshold` of the template's distinct words. The join finds every such
block: words are ordered by how many blocks have them, rarest first; a block and a template that share enough words
share one in their prefixes; pairs are then held against the length filter (a block with too few template words), the
positional filter (what can still match beyond the shared word) and at last the exact overlap. Words of no template
cannot match and are left out of blocks from the start.

Some templates are nearly part of others (a Creative Commons notice has almost the words of its sister notices), so one
notice matches several. Of matches in overlapping blocks, one is set aside if another label's template shares enough of
its words to explain it and fits better: a greater containment, or as great a one with more words. A match that is whole
and has words the other template lacks is never set aside. What is left gives the labels. Two notices of one family
within a block of each other can't be told from the larger one alone where all words of the smaller are in it.

Defined results: a null text has no words; repeated rows are scanned each; score is the best containment of a template
found, 1 with a base phrase, 0 with neither; an empty table gives an empty result; other columns are unread.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import doc_texts, written
from quillmill.llm.tokens import batch_rows, in_groups

#: The base phrases and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Passages of public licences, by label.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
]

_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes(b if b in _KEEP else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def base_places(words: list[bytes], phrases: dict[str, str] = BASE_PHRASES) -> list[tuple[int, str]]:
    """(index of the first word, label) of each place where a phrase's words stand in a row."""
    line, found = b" %b " % b" ".join(words), []
    for phrase, label in phrases.items():
        sought = b" %b " % phrase.encode()
        at, begun, word = line.find(sought), 0, 0
        while at >= 0:
            word, begun = word + line.count(b" ", begun, at), at
            found.append((word, label))
            at = line.find(sought, at + 1)
    return found


class Templates:
    """Templates as sets of numbered words, in classes by the power of two that holds their length."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8):
        cut = [(label, words_of(text)) for label, text in templates]
        self.words = sorted({w for _, ws in cut for w in ws})
        self.number = {w: k for k, w in enumerate(self.words)}
        self.labels = [label for label, _ in cut]
        self.sets = [sorted({self.number[w] for w in ws}) for _, ws in cut]
        self.stride = [1 << max(2, math.ceil(math.log2(max(1, len(ws))))) for _, ws in cut]
        self.need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.sets]
        self.classes = {c: min(n for n, s in zip(self.need, self.stride, strict=True) if s == c) for c in sorted(set(self.stride))}
        self.in_class = {c: np.isin(np.arange(len(self.words)), [t for ts, s in zip(self.sets, self.stride, strict=True) if s == c for t in ts]) for c in self.classes}

    def blocks(self, texts: list[np.ndarray]) -> list[list[dict]]:
        """For each text, given the numbers of its words (-1: in no template), the blocks that pass the length filter."""
        out: list[list[dict]] = [[] for _ in texts]
        doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        pos = np.concatenate([np.arange(len(t)) for t in texts]) if texts else np.zeros(0, int)
        tok = np.concatenate(texts) if texts else np.zeros(0, int)
        for stride, need in self.classes.items():
            hit = np.flatnonzero((tok >= 0) & self.in_class[stride][tok])
            block = pos[hit] // stride
            most = int(block.max(initial=0)) + 1
            again = block > 0  # a word also lies in the block that began before
            place = np.concatenate([doc[hit] * most + block, (doc[hit] * most + block - 1)[again]])
            keys = np.unique(place * len(self.words) + np.concatenate([tok[hit], tok[hit][again]]))
            places, begin, size = np.unique(keys // len(self.words), return_index=True, return_counts=True)
            for k in np.flatnonzero(size >= need):
                tokens = (keys[begin[k] : begin[k] + size[k]] % len(self.words)).tolist()
                out[places[k] // most].append({"stride": stride, "block": int(places[k] % most), "tokens": tokens})
        return out


_SCANNED = "uid long, doc_id long, n_words long, base array<struct<word:long,label:string>>, blocks array<struct<stride:int,block:long,tokens:array<int>>>"


def scan_texts(docs: DataFrame, templates: Templates, phrases: dict[str, str]) -> DataFrame:
    place = pa.struct([("word", pa.int64()), ("label", pa.string())])
    block = pa.struct([("stride", pa.int32()), ("block", pa.int64()), ("tokens", pa.list_(pa.int32()))])

    def run(batches):
        uid = TaskContext.get().partitionId() << 40
        get = templates.number.get
        for group in in_groups((r for b in batches for r in batch_rows(b)), 1):
            cut = [words_of(text) for _, text in group]
            base = [[{"word": w, "label": x} for w, x in base_places(ws, phrases)] for ws in cut]
            blocks = templates.blocks([np.array([get(w, -1) for w in ws], np.int64) for ws in cut])
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(uid, uid + len(group)), pa.int64()), pa.array([d for d, _ in group], pa.int64()), pa.array(map(len, cut), pa.int64()), pa.array(base, pa.list_(place)), pa.array(blocks, pa.list_(block))],
                ["uid", "doc_id", "n_words", "base", "blocks"],
            )
            uid += len(group)

    return doc_texts(docs).mapInArrow(run, _SCANNED)


def join_templates(scanned: DataFrame, templates: Templates) -> DataFrame:
    """uid, label, template, stride, block, common (words), containment of every block that holds a template."""
    spark = scanned.sparkSession
    blocks = scanned.select("uid", F.explode("blocks").alias("b")).select("uid", "b.stride", "b.block", "b.tokens")
    # as many rows as the templates have words
    counted = {r.token: r["count"] for r in blocks.select(F.explode("tokens").alias("token")).groupBy("token").count().collect()}
    order = sorted(range(len(templates.words)), key=lambda t: (counted.get(t, 0), t))
    rank = {t: k for k, t in enumerate(order)}
    prefixes, whole = [], []
    for k, tokens in enumerate(templates.sets):
        ranks, need = sorted(rank[t] for t in tokens), templates.need[k]
        prefixes += [(templates.stride[k], r, i, k, len(ranks), need) for i, r in enumerate(ranks[: len(ranks) - need + 1])]
        whole.append((k, templates.labels[k], ranks))
    prefix = spark.createDataFrame(prefixes, "stride int, rank int, t_at int, template int, t_size int, need int")
    whole_sets = spark.createDataFrame(whole, "template int, label string, t_ranks array<int>")
    ranks = F.array(*[F.lit(rank[t]) for t in range(len(templates.words))])
    least = F.create_map(*[F.lit(x) for c in templates.classes.items() for x in c])
    ordered = blocks.select("uid", "stride", "block", F.array_sort(F.transform("tokens", lambda t: F.get(ranks, t))).alias("ranks")).withColumn("size", F.size("ranks"))
    heads = ordered.select("*", F.posexplode(F.slice("ranks", F.lit(1), F.col("size") - F.element_at(least, F.col("stride")) + 1)).alias("b_at", "rank"))
    # both template tables have a row or less for each word of a template
    pairs = heads.join(F.broadcast(prefix), ["stride", "rank"]).where((F.col("size") >= F.col("need")) & (1 + F.least(F.col("t_size") - F.col("t_at"), F.col("size") - F.col("b_at")) - 1 >= F.col("need")))
    pairs = pairs.dropDuplicates(["uid", "stride", "block", "template"]).join(F.broadcast(whole_sets), "template")
    both = F.size(F.array_intersect("ranks", "t_ranks"))
    return pairs.where(both >= F.col("need")).select("uid", "label", "template", "stride", "block", both.alias("common"), (both / F.col("t_size")).alias("containment"))


def best_matches(found: DataFrame, templates: Templates) -> DataFrame:
    """The matches (of join_templates) that no better one explains."""
    sizes = [len(s) for s in templates.sets]
    shared = [(a, b, len(set(x) & set(y)), sizes[a], sizes[b]) for a, x in enumerate(templates.sets) for b, y in enumerate(templates.sets)]
    rivals = [r for r in shared if templates.labels[r[0]] != templates.labels[r[1]] and r[2] >= templates.need[r[0]]]
    if not rivals:
        return found
    # as many rows as templates have near relatives
    pairs = F.broadcast(found.sparkSession.createDataFrame(rivals, "template int, other int, shared int, size int, o_size int"))
    widest = 2 * max(templates.classes)
    placed = found.select("uid", "template", "common", (F.col("block") * F.col("stride")).alias("low"), ((F.col("block") + 2) * F.col("stride")).alias("high"), "stride", "block")
    cells = placed.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / widest), F.floor((F.col("high") - 1) / widest))))
    other = cells.select("uid", "cell", *[F.col(c).alias(f"o_{c}") for c in ("common", "low", "high")], F.col("template").alias("other"))
    met = cells.join(pairs, "template").join(other, ["uid", "cell", "other"]).where((F.col("low") < F.col("o_high")) & (F.col("o_low") < F.col("high")))
    share, o_share = F.col("common") * F.col("o_size"), F.col("o_common") * F.col("size")
    better = (o_share > share) | ((o_share == share) & (F.col("o_common") > F.col("common")))
    whole = (F.col("common") == F.col("size")) & (F.col("shared") < F.col("size"))
    aside = met.where(better & ~whole).select("uid", "template", "stride", "block").distinct()
    return found.join(aside, ["uid", "template", "stride", "block"], "left_anti")


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8, phrases: dict[str, str] = BASE_PHRASES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, base (places and labels), matches (label, template, first_word,
    block_words, containment) that no better one explains, base_labels, labels (distinct, sorted), score."""
    held = Templates(templates, threshold)
    scanned = written(scan_texts(docs, held, phrases), "blocks")
    match = F.struct("label", "template", (F.col("block") * F.col("stride")).alias("first_word"), (2 * F.col("stride")).alias("block_words"), "containment")
    found = best_matches(written(join_templates(scanned, held), "matches"), held).groupBy("uid").agg(F.array_sort(F.collect_list(match)).alias("matches"))
    joined = scanned.select("uid", "doc_id", "n_words", "base").join(found, "uid", "left")
    of = lambda c: F.coalesce(F.transform(c, lambda x: x["label"]), F.array().cast("array<string>"))
    best = F.array_max(F.transform("matches", lambda m: m["containment"]))
    return joined.select(
        "doc_id",
        "n_words",
        "base",
        "matches",
        F.array_sort(F.array_distinct(of("base"))).alias("base_labels"),
        F.array_sort(F.array_distinct(F.concat(of("base"), of("matches")))).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )
