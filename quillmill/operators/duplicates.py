"""Fingerprints, exact copies, and similarity joins over documents' key terms.

The similarity joins order terms by how many documents have them, rarest first. Similar sets that share two terms or more are
found by the first two that both have, as a pair: it lies among the first terms of each (for Jaccard at least t, among
n - ceil(t n) + 2), and what may follow it bounds the similarity. So items meet by pairs of rare terms, frequent words hardly
ever join, and only what passes the bound is compared as a whole. Sets that are similar by a single term meet by that
term. Documents with equal sets are one class and are joined as one."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators.storage import new_path, stored
from quillmill.operators.vector import best_rows


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, md5 of the text, of its lower-cased form with single spaces, of its sorted key terms, length, words."""
    text = T.text("text")
    collapsed = F.regexp_replace(F.regexp_replace(F.lower(text), "^\\s+|\\s+$", ""), "\\s+", " ")
    terms = term_sets(docs).select("doc_id", F.md5(F.array_join("terms", " ")).alias("semantic_hash"))
    first = docs.select("doc_id", F.md5(text).alias("content_hash"), F.md5(collapsed).alias("fuzzy_hash"), F.length(text).alias("length"), F.size(T.words(text)).alias("word_count"))
    return first.join(terms, "doc_id", "left").withColumn("semantic_hash", F.coalesce("semantic_hash", F.md5(F.lit(""))))


def term_sets(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, terms (sorted), and more columns of the same document, of documents that have key terms."""
    return T.key_term_sets(docs, "doc_id", "text", more=more)


def exact_matches(docs: DataFrame) -> DataFrame:
    """doc_id, first_id: the smallest doc_id of the same text, for documents that are not it. One row per digest is
    made before the join, however many copies there are."""
    hashed = docs.select("doc_id", F.md5(T.text("text")).alias("h"))
    first = hashed.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return hashed.join(first, "h").where("doc_id > first_id").select("doc_id", "first_id")


def similar_classes(sets: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    """sets (item, terms: distinct sets) -> a, b (a < b), similarity of every pair at or above (strict: above)."""
    freq = sets.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    each = sets.select("item", F.explode("terms").alias("term")).join(freq, "term")
    ordered = stored(each.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "term"))), lambda x: x["term"]).alias("terms")), "ordered_terms")
    n = F.size("terms")
    least = F.ceil(n * threshold - 1e-9).cast("int")  # so many terms a similar set has in common with it
    fact = lambda key, shared, rest: F.struct(key.alias("key"), n.alias("n"), F.lit(shared).alias("shared"), rest.cast("int").alias("rest"))
    two = _of_pairs("terms", n - F.greatest(least, F.lit(2)) + 2, lambda x, y, j: fact(F.xxhash64(x, y), 2, n - j - 1))
    one = F.transform(F.when(n * threshold <= 1 + 1e-9, F.col("terms")).otherwise(F.array().cast("array<string>")), lambda x: fact(F.xxhash64(x), 1, F.lit(0)))
    common = F.col("a.shared") + F.least("a.rest", "b.rest")
    met = _met(ordered.select("item", F.inline(F.concat(two, one))), common >= (F.col("a.n") + F.col("b.n")) * (threshold / (1 + threshold)) - 1e-9)
    scored = _both(met, ordered).select("a", "b", T.jaccard(F.col("a_terms"), F.col("b_terms")).alias("similarity"))
    return scored.where(F.col("similarity") > threshold if strict else F.col("similarity") >= threshold)


def _of_pairs(array: str, end: Column, make, keep=None) -> Column:
    """make(x, y, j) of the entries x before y at place j < end of an array, where keep(x, y, j)."""
    of = lambda x, i: F.transform(F.filter(F.transform(F.slice(array, i + 2, F.greatest(end - i - 1, F.lit(0))), lambda y, d: F.struct(y.alias("y"), (i + 1 + d).alias("j"))), lambda z: keep(x, z["y"], z["j"]) if keep else F.lit(True)), lambda z: make(x, z["y"], z["j"]))
    return F.flatten(F.transform(array, of))


def _met(rows: DataFrame, close: Column) -> DataFrame:
    """rows (item, key, facts) -> a, b (a < b), once each, of items of one key whose facts (a., b.) are `close`. The rows are narrow, so
    that what a key's many items cost is a comparison of numbers."""
    kept = stored(rows, "keys")
    pairs = kept.alias("a").join(kept.alias("b"), F.col("a.key") == F.col("b.key")).where((F.col("a.item") < F.col("b.item")) & close)
    return pairs.select(F.col("a.item").alias("a"), F.col("b.item").alias("b")).distinct()


def _both(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """pairs (a, b) with the columns of held (item, ...) of either, as a_ and b_."""
    for p in ("a", "b"):
        pairs = pairs.join(held.select(F.col("item").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in held.columns if c != "item"]), p)
    return pairs


def sized_term_sets(docs: DataFrame) -> DataFrame:
    """doc_id, terms, length of the text. Worth storing where several operators take it."""
    return term_sets(docs.select("doc_id", "text", F.length(T.text("text")).alias("length")), "length")


def near_duplicates(docs: DataFrame, threshold: float = 0.85, band: float = 0.3, longest: int | None = None, sets: DataFrame | None = None) -> DataFrame:
    """doc_id, class_id, n_links. A class is the documents of equal terms and length; its id is its smallest doc_id.
    Links: other documents of similarity >= threshold whose lengths differ by at most `band` of the longer one. With
    `longest`, documents of that many characters and more ask for no links; they are still found by shorter ones."""
    sets = stored(sized_term_sets(docs), "term_sets") if sets is None else sets
    classes = sets.groupBy("terms", "length").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("size"))
    classes = stored(classes, "classes")
    by_terms = stored(classes.groupBy("terms").agg(F.min("class_id").alias("item")), "by_terms")
    pairs = stored(similar_classes(by_terms, threshold).select("a", "b"), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(by_terms.select(F.col("item").alias("a"), F.col("item").alias("b")))
    held = stored(classes.join(by_terms, "terms").select("item", "class_id", "length", "size"), "members")
    left = held.select(F.col("item").alias("a"), F.col("class_id"), F.col("length").alias("l"))
    right = held.select(F.col("item").alias("b"), F.col("length").alias("r"), F.col("size"))
    # lengths within the band lie in the same step of its logarithm or in neighbouring ones, so classes of one term set meet
    # by it and by step, not each with all
    step = lambda c: F.floor(F.ln(F.greatest(F.col(c), F.lit(1))) / (-1.001 * math.log(1 - band))).cast("int")
    left = left.withColumn("step", F.explode(F.sequence(step("l") - 1, step("l") + 1)))
    near = both.join(left, "a").join(right.withColumn("step", step("r")), ["b", "step"]).where(F.abs(F.col("l") - F.col("r")) <= band * F.greatest("l", "r"))
    asks = near if longest is None else near.where(F.col("l") < longest)
    links = asks.groupBy("class_id").agg((F.sum("size") - 1).alias("n_links"))
    of = sets.join(classes.select("terms", "length", "class_id"), ["terms", "length"]).select("doc_id", "class_id")
    found = docs.select("doc_id").join(of, "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    return found.join(links, "class_id", "left").select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def search_sets(sets: DataFrame, queries: DataFrame, least: float, strict: bool, k: int, block: int = 32_768) -> DataFrame:
    """sets (item, terms, weight: 1 if not given) x queries (query_id, terms) -> query_id, item, similarity, n: of each task over
    the sets, a query's k most similar ones, and the weight of all its sets that pass the threshold (the same in each of
    these rows, so it adds up over tasks where k is 1).

    A stated query set against all sets: queries come in blocks of about `block`, whose inverted lists travel to the tasks of one
    scan over the sets. A set meets only the queries of a block that share a term with it, and these are counted in arrays; nothing
    is joined or shuffled but the results. Terms are compared by 64-bit hashes."""
    weighted = sets if "weight" in sets.columns else sets.withColumn("weight", F.lit(1))
    hashes = F.transform("terms", lambda t: F.xxhash64(t)).alias("hashes")
    held = weighted.select("item", hashes, F.col("weight").cast("long").alias("weight"))
    asked = stored(queries.select(F.col("query_id").cast("long").alias("query_id"), hashes), "asked")
    n_blocks = max(1, -(-asked.count() // block))
    if n_blocks > 1:  # a folder for each block, so that none is read once for each other one
        path = new_path(asked.sparkSession, "asked")
        asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int")).repartition("block").write.partitionBy("block").parquet(path)
        of_block = lambda b: asked.sparkSession.read.schema("query_id long, hashes array<long>, block int").parquet(path).where(F.col("block") == b).drop("block")
    else:
        of_block = lambda b: asked
    kind = "query_id long, item long, similarity double, n long"
    found = [held.mapInArrow(_sharing(of_block(b).toArrow(), least, strict, k), kind) for b in range(n_blocks)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _sharing(asked: pa.Table, least: float, strict: bool, k: int, most: int = 1 << 19):
    """The function of a scan over sets: rows (item, hashes, weight) against the inverted lists of these queries, of which about
    `most` entries are looked at at once."""
    asked = asked.combine_chunks()
    ids = asked.column(0).to_numpy()
    lists = asked.column(1).combine_chunks()
    q_size = np.diff(lists.offsets.to_numpy()) if len(ids) else np.zeros(0, np.int64)
    flat = lists.flatten().to_numpy() if len(ids) else np.zeros(0, np.int64)
    order = np.argsort(flat, kind="stable")
    terms, begin, df = np.unique(flat[order], return_index=True, return_counts=True)
    posted = np.repeat(np.arange(len(ids), dtype=np.uint32), q_size)[order]

    def shared(at: np.ndarray, row: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (of these places among the terms), queries, and how many terms they share, where these are enough."""
        n, low = df[at], row[0]
        place = np.arange(n.sum()) + np.repeat(begin[at] - np.cumsum(n) + n, n)
        kind = np.uint32 if (row[-1] - low + 1) * len(ids) < 1 << 32 else np.uint64
        pair = np.sort(np.repeat(((row - low) * len(ids)).astype(kind), n) + posted[place].astype(kind))
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        both = np.diff(np.append(first, len(pair)))
        kept = np.flatnonzero(both >= enough)
        pair, both = pair[first[kept]].astype(np.int64), both[kept]
        row = pair // len(ids)
        return row + low, pair - row * len(ids), both

    def parts(hashes: np.ndarray, size: np.ndarray):
        """Of the terms that queries have: their places and rows, in runs of whole rows."""
        at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
        hit = np.flatnonzero(terms[at] == hashes)
        at, row = at[hit], np.repeat(np.arange(len(size)), size)[hit]
        met, cut = np.cumsum(df[at]), 0
        while cut < len(at):
            end = int(np.searchsorted(met, (met[cut - 1] if cut else 0) + most, "right"))
            end = np.searchsorted(row, row[end], "left") if end < len(at) else end
            end = max(end, np.searchsorted(row, row[cut], "right"))  # a row at least
            yield at[cut:end], row[cut:end]
            cut = end

    def run(batches):
        total, best, held = np.zeros(len(ids), np.int64), [], 0
        reached = np.full(len(ids), -1.0)  # the k-th best similarity of a query so far
        for b in batches if len(terms) else ():
            b = b.take(pc.sort_indices(pc.list_value_length(b.column(1))))  # so that the rows of a run need as many common terms
            item, weight = b.column(0).to_numpy(), b.column(2).to_numpy()
            size = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
            for at, rows in parts(b.column(1).flatten().to_numpy(), size):
                row, q, both = shared(at, rows, math.ceil((least - 1e-6) * size[rows[0]]))  # as a union is as large as the set at least
                every = q_size[q] + size[row]
                near = np.flatnonzero(both * (1 + least) >= (least - 1e-6) * every - 1e-6)
                row, q, both, every = row[near], q[near], both[near], every[near]
                alike = np.round(both / (every - both), 6)
                kept = np.flatnonzero((alike > least if strict else alike >= least) & (item[row] != ids[q]))
                row, q, alike = row[kept], q[kept], alike[kept]
                np.add.at(total, q, weight[row])
                ahead = np.flatnonzero(alike >= reached[q])
                best.append((q[ahead], item[row[ahead]], alike[ahead]))
                held += len(ahead)
                if held > 2 * k * len(ids) + (1 << 18):
                    best = [best_rows(tuple(np.concatenate(x) for x in zip(*best, strict=True)), k)]
                    held = len(best[0][0])
                    q, n = np.unique(best[0][0], return_counts=True)
                    reached[q[n == k]] = best[0][2][(np.cumsum(n) - 1)[n == k]]
        if best:
            q, item, alike = best_rows(tuple(np.concatenate(x) for x in zip(*best, strict=True)), k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(item), pa.array(alike), pa.array(total[q])], ["query_id", "item", "similarity", "n"])

    return run


def related_topics(docs: DataFrame, queries: DataFrame, threshold: float = 0.3, k: int = 10, sets: DataFrame | None = None) -> DataFrame:
    """For each query document the k most similar classes of documents of equal key terms above the threshold; a class
    is named by its smallest doc_id and may hold the query itself, which then is left out."""
    sets = stored(term_sets(docs), "term_sets") if sets is None else sets.select("doc_id", "terms")
    classes = sets.groupBy("terms").agg(F.min("doc_id").alias("item"))
    asked = sets.join(queries.select("doc_id"), "doc_id", "left_semi").withColumnRenamed("doc_id", "query_id")
    found = search_sets(classes, asked, threshold, True, k)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("item").alias("related_id"), "similarity", "rank")


def semantic_duplicates(docs: DataFrame, threshold: float = 0.7, sets: DataFrame | None = None) -> DataFrame:
    """doc_id, class_id, n_links: cosine of idf-weighted key terms at or above the threshold.

    Terms are in rare-first order and weights have length 1. Where x and y are the first terms that two sets share, their cosine
    is at most the length of x's weight and those from y on, in either set; so only pairs of terms where that reaches the
    threshold are joined. A single shared term must reach it alone. Documents of equal sets are one class."""
    sets = stored(term_sets(docs), "term_sets") if sets is None else sets
    n = sets.agg(F.count("*").alias("n"))  # one row
    freq = sets.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))
    weight = F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1
    classes = stored(sets.groupBy("terms").agg(F.min("doc_id").alias("item"), F.count("*").alias("size")), "classes")
    each = classes.select("item", F.explode("terms").alias("term")).join(freq.select("term", "df", weight.alias("w")), "term")
    ordered = each.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("df", "term", "w"))).alias("t"))
    norm = F.sqrt(F.aggregate("t", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    unit = ordered.withColumn("norm", norm).select("item", F.transform("t", lambda x: F.struct(x["term"].alias("term"), (x["w"] / F.col("norm")).alias("w"))).alias("t"))
    unit = stored(unit, "unit_terms")
    slack = 1e-8  # cosines are rounded
    after = F.transform("t", lambda x, i: F.aggregate(F.slice("t", i + 1, F.size("t")), F.lit(0.0), lambda s, y: s + y["w"] * y["w"]))  # squared, its own included
    fact = lambda key, first, second, rest: F.struct(key.alias("key"), first.alias("first"), second.alias("second"), rest.alias("rest"))
    rest = lambda j: F.sqrt(F.coalesce(F.get("after", j + 1), F.lit(0.0)))
    two = _of_pairs("t", F.size("t"), lambda x, y, j: fact(F.xxhash64(x["term"], y["term"]), x["w"], y["w"], rest(j)), lambda x, y, j: x["w"] * x["w"] + F.get("after", j) >= threshold**2 - slack)
    zero = F.lit(0.0)
    one = F.transform(F.filter("t", lambda x: x["w"] >= threshold - slack), lambda x: fact(F.xxhash64(x["term"]), x["w"], zero, zero))
    bound = sum((F.col(f"a.{c}") * F.col(f"b.{c}") for c in ("second", "rest")), F.col("a.first") * F.col("b.first"))
    met = _met(unit.withColumn("after", after).select("item", F.inline(F.concat(two, one))), bound >= threshold - slack)
    vectors = unit.select("item", F.transform("t", lambda x: x["term"]).alias("terms"), F.map_from_entries("t").alias("w"))
    met = _both(met, vectors).select(*[F.col(p).alias(f"{p}_item") for p in ("a", "b")], "a_terms", "b_terms", "a_w", "b_w")
    cosine = F.aggregate(F.array_intersect("a_terms", "b_terms"), F.lit(0.0), lambda s, x: s + F.col("a_w")[x] * F.col("b_w")[x])
    pairs = stored(met.where(F.round(cosine, 9) >= threshold).select("a_item", "b_item"), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b_item").alias("a_item"), F.col("a_item").alias("b_item")))
    others = both.join(classes.select(F.col("item").alias("b_item"), "size"), "b_item").groupBy(F.col("a_item").alias("item")).agg(F.sum("size").alias("others"))
    links = classes.join(others, "item", "left").select("terms", F.col("item").alias("class_id"), (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    found = sets.join(links, "terms").select("doc_id", "class_id", "n_links")
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def title_mentions(docs: DataFrame, titles: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, title_id of titles (title_id, title) longer than `least` that stand in a text as whole words, in a
    document other than their own. Only texts that have a title's rarest word are looked at."""
    low = titles.select("title_id", F.lower("title").alias("title")).where(F.length("title") > least)
    own = low.select("title_id", "title", F.explode(F.array_distinct(T.tokens("title"))).alias("term"))
    words = docs.select("doc_id", F.explode(F.array_distinct(T.tokens("text"))).alias("term"))
    freq = words.join(own.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    rarest = own.join(freq, "term").groupBy("title_id", "title").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    near = words.join(rarest, "term").where("doc_id <> title_id").select("doc_id", "title_id", "title")
    padded = lambda c: F.concat(F.lit(" "), F.array_join(T.tokens(c), " "), F.lit(" "))
    return near.join(docs.select("doc_id", "text"), "doc_id").where(F.contains(padded("text"), padded("title"))).select("doc_id", "title_id")
