"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models. Each model also sees the probabilities of the categories
before it; in training these are out-of-fold predictions (a document's own label has no part in them), so a later model
meets the same kind of input that it will get from unlabelled documents.

Features are the distinct lower-cased words of a text, and doubled punctuation. Words that tell a category's labels
apart (a two-proportion test) are chosen, so that a long text isn't judged by the noise of its many other words. Models
are fitted on a bounded sample of labelled documents (`per_class` of each label of the last category, those of least
doc_id hash; their distinct features, not their texts, come to the driver); every document is scored.

Defined results: a null text has no features and scores as such; null labels and documents without text are left out of
training; where a document's labels disagree the greater counts; of rows with equal doc_id the text of least hash is
trained on; a chain without both labels of a category gives that category's base rate; repeated rows are scored each; an
empty table gives an empty result; other columns are unread.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import doc_texts, give_back
from quillmill.llm.tokens import batch_rows, in_groups

_WORD = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes(b if b in _WORD else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_MARKS = [bytes([b, b]) for b in b"!#$%&*?@|~"] + [b" | "]


def features(text: str) -> set[bytes]:
    raw = text.encode()
    return {*raw.translate(_FOLD).split(), *(b"\0" + m for m in _MARKS if m in raw)}


@dataclass
class Link:
    """One category's model: weights of features, of the probabilities before it, and the intercept."""

    category: str
    weights: dict[bytes, float] = field(default_factory=dict)
    earlier: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def probability(self, found: set[bytes], before: list[float]) -> float:
        margin = self.intercept + sum(self.weights[f] for f in self.weights.keys() & found) + sum(w * p for w, p in zip(self.earlier, before, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, margin))))


def telling_features(sets: list[set[bytes]], y: np.ndarray, most: int, least_z: float = 4.0, least_count: int = 3) -> list[bytes]:
    """Features whose share differs between the labels by at least least_z standard errors, the clearest first."""
    yes, no = Counter(), Counter()
    for s, label in zip(sets, y.tolist(), strict=True):
        (yes if label else no).update(s)
    n_yes, n_no = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    scored = []
    for f in yes.keys() | no.keys():
        a, b = yes[f], no[f]
        if a + b >= least_count:
            pooled = (a + b) / (n_yes + n_no)
            z = abs(a / n_yes - b / n_no) / math.sqrt(max(pooled * (1 - pooled), 1e-9) * (1 / n_yes + 1 / n_no))
            if z >= least_z:
                scored.append((-z, f))
    return [f for _, f in sorted(scored)[:most]]


def fit_link(category: str, sets: list[set[bytes]], y: np.ndarray, before: np.ndarray, most: int, penalty: float = 0.1, rounds: int = 200) -> Link:
    """Logistic regression with an L2 penalty, by gradient steps scaled to each feature's curvature. before: a column
    of probabilities for each earlier category."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = math.log(rate / (1 - rate))
    if y.min(initial=1) == y.max(initial=0) or len(y) == 0:
        return Link(category, {}, [0.0] * before.shape[1], base)
    chosen = telling_features(sets, y, most)
    number = {f: k for k, f in enumerate(chosen)}
    pairs = [(i, number[f]) for i, s in enumerate(sets) for f in s & number.keys()]
    rows, cols = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
    w, v, c = np.zeros(len(chosen)), np.zeros(before.shape[1]), base
    scale_w = np.bincount(cols, minlength=len(chosen)) * 0.25 + penalty
    per_row = np.bincount(rows, minlength=len(y)) + before.shape[1] + 1
    step = 1 / max(1.0, float(np.percentile(per_row, 90)) / 2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(c + np.bincount(rows, w[cols], len(y)) + before @ v, -30, 30)))
        err = y - p
        w += step * 2 * (np.bincount(cols, err[rows], len(chosen)) - penalty * w) / scale_w
        v += step * (before.T @ err - penalty * v) / (0.25 * (before**2).sum(axis=0) + penalty)
        c += step * err.sum() / (0.25 * len(y))
    return Link(category, dict(zip(chosen, w.tolist(), strict=True)), v.tolist(), float(c))


def fit_chain(sets: list[set[bytes]], labels: dict[str, np.ndarray], folds: int = 5, most: int = 5_000) -> tuple[list[Link], np.ndarray]:
    """A chain over the categories of `labels`, in their order, and the out-of-fold probabilities (a column for each)."""
    n = len(sets)
    fold = np.arange(n) % folds
    before = np.zeros((n, 0))
    chain = []
    for category, y in labels.items():
        chain.append(fit_link(category, sets, y, before, most))
        held_out = np.zeros(n)
        for f in range(folds):
            inside = np.flatnonzero(fold != f)
            part = fit_link(category, [sets[i] for i in inside], y[inside], before[inside], most)
            for i in np.flatnonzero(fold == f).tolist():
                held_out[i] = part.probability(sets[i], before[i].tolist())
        before = np.column_stack([before, held_out])
    return chain, before


#: Thresholds to choose from, and the share of documents without the label that a threshold may reject out of fold.
THRESHOLDS, FALSE_ALARMS = (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5), 0.005


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The least threshold with few enough false alarms among these (out-of-fold) probabilities; the greatest if none has."""
    clean = p[y == 0]
    return next((t for t in THRESHOLDS if len(clean) and (clean >= t).mean() <= FALSE_ALARMS), THRESHOLDS[-1])


def training_sample(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], per_class: int) -> tuple[list[set[bytes]], dict[str, np.ndarray]]:
    """The features and labels of at most 2 * per_class labelled documents."""
    last = list(categories)[-1]
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.cast("int").alias(f"y_{k}") for k, c in categories.items()]).dropna()
    marked = marked.groupBy("doc_id").agg(*[F.max(f"y_{k}").alias(f"y_{k}") for k in categories])
    ordered = F.xxhash64("doc_id")
    few = [marked.where(F.col(f"y_{last}") == y).orderBy(ordered, "doc_id").limit(per_class) for y in (0, 1)]
    chosen = few[0].unionByName(few[1])  # at most 2 * per_class rows of a few numbers
    rows = doc_texts(docs).where("text <> ''").join(F.broadcast(chosen), "doc_id")
    # one text of each, found before the shuffle
    one = rows.groupBy("doc_id", *[f"y_{k}" for k in categories]).agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("t"))
    rows = one.select("doc_id", "t.text", *[f"y_{k}" for k in categories])

    names = list(categories)

    def run(batches):
        for group in in_groups((r for b in batches for r in batch_rows(b)), 1):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in group], pa.int64()), "found": pa.array([sorted(features(r[1])) for r in group], pa.list_(pa.binary()))} | {f"y_{k}": pa.array([r[2 + j] for r in group], pa.int32()) for j, k in enumerate(names)})

    sampled = rows.mapInArrow(run, ", ".join(["doc_id long", "found array<binary>", *(f"y_{k} int" for k in names)]))
    words: dict[bytes, bytes] = {}  # one object for each distinct word
    held = []
    for batch in sampled.toArrow().to_batches():
        for doc_id, found, *y in batch_rows(batch):
            held.append((doc_id * 2654435761 % (1 << 32), doc_id, {words.setdefault(f, f) for f in found}, y))
    held.sort(key=lambda r: r[:2])
    give_back()
    return [r[2] for r in held], {k: np.array([r[3][j] for r in held], float) for j, k in enumerate(names)}


def default_categories() -> dict[str, Column]:
    """The chain over the columns of `labels`: low quality first, then toxic."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column] | None = None, per_class: int = 4_000) -> tuple[list[Link], float]:
    """The chain, and the last category's threshold as its out-of-fold probabilities say. The last model's intercept is
    moved from the sample's share of positives to that of all labels, and those probabilities with it."""
    categories = categories or default_categories()
    sets, y = training_sample(docs, labels, categories, per_class)
    chain, held_out = fit_chain(sets, y)
    last = list(categories)[-1]
    shares = {r.y: r["count"] for r in labels.select(categories[last].cast("int").alias("y")).groupBy("y").count().where("y in (0, 1)").collect()}
    n_yes, moved = float(y[last].sum()), 0.0
    if min(n_yes, len(sets) - n_yes, shares.get(0, 0), shares.get(1, 0)) > 0:
        moved = math.log(shares[1] / shares[0]) - math.log(n_yes / (len(sets) - n_yes))
        chain[-1].intercept += moved
    p = np.clip(held_out[:, -1], 1e-12, 1 - 1e-12)
    return chain, best_threshold(1 / (1 + (1 - p) / p * math.exp(-moved)), y[last])


def score(docs: DataFrame, chain: list[Link]) -> DataFrame:
    """doc_id and p_<category> of every row. A model has at most as many weights as fit_chain allows."""
    names = [f"p_{x.category}" for x in chain]

    def run(batches):
        for group in in_groups((r for b in batches for r in batch_rows(b)), 1):
            columns: list[list[float]] = [[] for _ in chain]
            for _, text in group:
                found, before = features(text), []
                for link, column in zip(chain, columns, strict=True):
                    before.append(link.probability(found, before))
                    column.append(before[-1])
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in group], pa.int64()), *(pa.array(c, pa.float64()) for c in columns)], ["doc_id", *names])

    return doc_texts(docs).mapInArrow(run, ", ".join(["doc_id long", *(f"{x} double" for x in names)]))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float | None = None, per_class: int = 4_000) -> DataFrame:
    """doc_id, p_low_quality, p_toxic, toxic (p_toxic >= threshold; chosen out of fold if not given) and kept of every row
    of docs."""
    chain, chosen = train(docs, labels, per_class=per_class)
    return score(docs, chain).withColumn("toxic", F.col("p_toxic") >= (chosen if threshold is None else threshold)).withColumn("kept", ~F.col("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float | None = None, per_class: int = 4_000) -> DataFrame:
    """The rows of docs, with all their columns, that reject_toxic keeps; no shuffle."""
    chain, chosen = train(docs, labels, per_class=per_class)
    least = chosen if threshold is None else threshold
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches):
        for batch in batches:
            keep = []
            for text in batch.column(at):
                found, before = features(text.as_py() or ""), []
                for link in chain:
                    before.append(link.probability(found, before))
                keep.append(before[-1] < least)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
