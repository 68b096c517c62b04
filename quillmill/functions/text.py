"""Text expressions: words, terms, keywords. All are Column expressions that stay in the JVM, but for the counts of a row's words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The stop words of each tokenizer, as results depend on them.
INDEX_STOPWORDS = (
    "a an and are as at be by for from has he in is it its of on that the to was will with would you your i we they them "
    "this these those what when where who why how all any both each few more most other some such no nor not only own same "
    "so than too very can just don should now"
).split()
CHAT_STOPWORDS = (
    "the and are was will been have had were said each which their time would there could other after first with this that "
    "they from you your yours his her him can about into"
).split()
KEY_TERM_STOPWORDS = (
    "the a an and or but in on at to for of with by is are was were be been have has had will would could should may might "
    "this that these those i you he she it we they"
).split()
QUERY_STOPWORDS = (
    "the a an and or but in on at to for of with by is are was were be been being have has had do does did will would should "
    "could can may might must what when where why how who which that this these those"
).split()
METADATA_STOPWORDS = "the a an and or but in on at to for of with by".split()

#: Anything that is no letter, digit or underscore, the same in Java's and RE2's patterns.
BREAK = "[^\\p{L}\\p{N}_]+"
_WORD = "[\\p{L}\\p{N}_]"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def words(c: Column | str) -> Column:
    """What white space separates."""
    return F.filter(F.split(text(c), "\\s+"), lambda x: x != "")


def tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(text(c)), BREAK), lambda x: x != "")


def all_terms(c: Column | str, least: int = 2) -> Column:
    """Tokens of `least` and more letters a-z and nothing else, stop words included (for phrases and distances)."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit(f"(?<!{_WORD})[a-z]{{{least},}}(?!{_WORD})"), F.lit(0))


def terms(c: Column | str) -> Column:
    """The terms that the lexical index holds."""
    return F.filter(all_terms(c), lambda x: ~x.isin(INDEX_STOPWORDS))


def top_words(df: DataFrame, key: str, array: Column, k: int, more: tuple[str, ...] = ()) -> DataFrame:
    """key, more columns of its row, top (word, freq, rank): a key's k most frequent words, equal ones by first occurrence.

    Words are counted within their row, so none is shuffled. Only where some key has several rows do those meet in a groupBy."""

    def run(batches):
        for b in batches:
            for begin in range(0, b.num_rows, 256):
                part = b.slice(begin, 256)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], _top(part.column(part.num_columns - 1), k)], [*part.schema.names[:-1], "top"])

    rows = df.select(key, *more, array.alias("_words"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, *more))
    each = lambda part: part.mapInArrow(run, f"{kinds}, top array<struct<word: string, freq: bigint, rank: int>>")
    again = df.groupBy(F.col(key).alias("_key")).count().where("count > 1").select("_key")
    if again.isEmpty():
        return each(rows)
    same = F.col(key).eqNullSafe(F.col("_key"))
    found = rows.join(again, same, "left_semi").select(key, *more, F.posexplode("_words").alias("at", "word"))
    found = found.groupBy(key, "word").agg(F.count("*").alias("freq"), F.min("at").alias("first_at"), *[F.first(c).alias(c) for c in more])
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("freq"), "first_at"))
    met = found.withColumn("rank", rank).where(F.col("rank") <= k).groupBy(key).agg(*[F.first(c).alias(c) for c in more], F.collect_list(F.struct("word", "freq", "rank")).alias("top"))
    return each(rows.join(again, same, "left_anti")).unionByName(met)


def _top(lists: pa.ListArray, k: int) -> pa.ListArray:
    """Of each list of words its k most frequent ones, as (word, freq, rank)."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    coded = lists.flatten().dictionary_encode()
    n = max(1, len(coded.dictionary))
    pair, first, freq = np.unique(np.repeat(np.arange(len(lists)), size) * n + coded.indices.to_numpy(), return_index=True, return_counts=True)
    order = np.lexsort((first, -freq, pair // n))
    row = pair[order] // n
    rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
    order, row, rank = order[rank <= k], row[rank <= k], rank[rank <= k]
    words = coded.dictionary.take(pa.array(pair[order] % n)).cast(pa.string())
    kept = pa.StructArray.from_arrays([words, pa.array(freq[order], pa.int64()), pa.array(rank, pa.int32())], ["word", "freq", "rank"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(lists) + 1)), pa.int32()), kept)


def chat_keywords(df: DataFrame, key: str, column: str, k: int = 10) -> DataFrame:
    """The k most frequent words of three letters and more, of which those that occur once then go."""
    kept = F.filter(all_terms(column, 3), lambda x: ~x.isin(CHAT_STOPWORDS))
    return top_words(df, key, kept, k).select(key, F.inline("top")).where(F.col("freq") > 1)


def _is_key_term(word: Column) -> Column:
    return (F.length(word) > 3) & ~word.isin(KEY_TERM_STOPWORDS) & ~word.rlike("^\\p{N}+$")


def key_terms(df: DataFrame, key: str, column: str, k: int = 20, more: tuple[str, ...] = ()) -> DataFrame:
    """Of the k most frequent words of any kind, those longer than three, no stop words and no digits."""
    return top_words(df, key, tokens(column), k, more).select(key, *more, F.inline("top")).where(_is_key_term(F.col("word")))


def key_term_sets(df: DataFrame, key: str, column: str, k: int = 20, more: tuple[str, ...] = ()) -> DataFrame:
    """key, terms (sorted) and more columns, of rows that have key terms."""
    words = F.transform(F.filter("top", lambda x: _is_key_term(x["word"])), lambda x: x["word"])
    return top_words(df, key, tokens(column), k, more).select(key, F.array_sort(words).alias("terms"), *more).where(F.size("terms") > 0)


def metadata_keywords(df: DataFrame, key: str, column: str, k: int = 20) -> DataFrame:
    kept = F.filter(words(F.lower(text(column))), lambda x: (F.length(x) > 3) & ~x.isin(METADATA_STOPWORDS))
    return top_words(df, key, kept, k).select(key, F.inline("top"))


def query_keywords(c: Column | str, k: int = 10) -> Column:
    """The first k distinct words longer than two that are no stop words."""
    return F.slice(F.array_distinct(F.filter(tokens(c), lambda x: (F.length(x) > 2) & ~x.isin(QUERY_STOPWORDS))), 1, k)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))
