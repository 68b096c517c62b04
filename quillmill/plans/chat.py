"""Queries of conversation analytics and chunking. Events stand in for messages: their type is the channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import chunks, conversation
from quillmill.plans.common import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("channel"), F.col("props").alias("message"), F.concat(F.lit("#"), F.col("event_type"), F.lit(" #all")).alias("hashtags"))


def _plain_times(df: DataFrame, *names: str) -> DataFrame:
    """Times without a zone, as the tables have them."""
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


SESSIONS = """m AS (SELECT event_id AS id, ts, user_id, event_type AS channel, props AS message FROM events),
f AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY channel ORDER BY ts, id) > 1800000000 THEN 1 ELSE 0 END AS b FROM m),
s AS (SELECT *, 1 + sum(b) OVER (PARTITION BY channel ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS session FROM f),
g AS (SELECT *, (row_number() OVER (PARTITION BY channel, session ORDER BY ts, id) - 1) // 25 AS part FROM s)"""


@query(f"WITH {SESSIONS} SELECT id, channel, session::BIGINT AS session, part::BIGINT AS part FROM g")
def sessionize_gap_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.sessions(_messages(spark, sf_dir)).select("id", "channel", "session", "part")


@query(f"WITH {SESSIONS} SELECT channel, session::BIGINT AS session, part::BIGINT AS part, count(*) AS n_messages, count(DISTINCT user_id) AS n_participants, min(ts) AS start_ts, max(ts) AS end_ts, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000, 6) AS hours FROM g GROUP BY ALL")
def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_times(conversation.session_stats(conversation.sessions(_messages(spark, sf_dir))), "start_ts", "end_ts")


NAMES = "CASE WHEN user_id % 3 = 0 THEN 'nick' || user_id WHEN user_id % 3 = 1 THEN 'First' || user_id || ' Last' ELSE 'user' || user_id END"


def _names(messages: DataFrame) -> DataFrame:
    number, kind = F.col("user_id").cast("string"), F.col("user_id") % 3
    users = messages.select("user_id").distinct().select("user_id", F.concat(F.lit("user"), number).alias("username"), F.when(kind == 0, F.concat(F.lit("nick"), number)).otherwise("").alias("nickname"), F.when(kind == 1, F.concat(F.lit("First"), number)).alias("first_name"), F.when(kind == 1, F.lit("Last")).alias("last_name"))
    return conversation.display_names(users)


@query(f"SELECT DISTINCT user_id, {NAMES} AS display_name FROM events")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(_messages(spark, sf_dir))


@query(f"""WITH {SESSIONS}, n AS (SELECT *, {NAMES} AS name FROM g) SELECT channel, session::BIGINT AS session, part::BIGINT AS part,
 '## Conversation in #' || channel || chr(10) || '**Participants:** ' || count(DISTINCT user_id) || ' users' || chr(10) || chr(10) ||
 string_agg('**' || name || '** (' || strftime(ts, '%H:%M') || '): ' || coalesce(message, ''), chr(10) ORDER BY ts, id) AS text FROM n GROUP BY channel, session, part""")
def conversation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _messages(spark, sf_dir)
    return conversation.session_texts(conversation.sessions(messages), _names(messages))


@query("""SELECT event_type AS channel, count(*) AS n_messages, count(DISTINCT user_id) AS n_participants, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000, 6) AS span_days,
 round(count(*) / greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000, 1), 6) AS per_day FROM events GROUP BY 1""")
def message_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.activity(_messages(spark, sf_dir))


@query("""WITH c AS (SELECT event_type AS channel, user_id, count(*) AS n_messages, sum(length(coalesce(props, '')))::BIGINT AS n_chars FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY n_messages DESC, user_id) AS rank FROM c) SELECT channel, user_id, n_messages, n_chars, rank::INT AS rank FROM r WHERE rank <= 10""")
def top_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.top_participants(_messages(spark, sf_dir))


@query("SELECT h AS hashtag, count(*) AS n FROM (SELECT unnest(['#' || event_type, '#all']) AS h FROM events) GROUP BY 1 ORDER BY n DESC, hashtag LIMIT 20")
def hashtag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.hashtags(_messages(spark, sf_dir))


THREADED = """m AS (SELECT conv_id::VARCHAR || '-' || turn AS id, role AS user_id, make_timestamp(1704067200000000 + turn * 60000000) AS ts, CASE WHEN turn > 0 THEN conv_id::VARCHAR || '-0' ELSE '' END AS root_id,
 text AS message, CASE WHEN role = 'system' THEN 'system_note' ELSE '' END AS type FROM conversations)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id").cast("string")
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", conv, F.col("turn").cast("string")).alias("id"), F.col("role").alias("user_id"), F.timestamp_micros(F.lit(1704067200000000) + F.col("turn").cast("long") * 60_000_000).alias("ts"),
        F.when(F.col("turn") > 0, F.concat(conv, F.lit("-0"))).otherwise("").alias("root_id"), F.col("text").alias("message"), F.when(F.col("role") == "system", "system_note").otherwise("").alias("type"),
    )


@query(f"WITH {THREADED} SELECT id, user_id FROM m WHERE (trim(coalesce(message, '')) <> '' AND NOT starts_with(type, 'system_')) OR type IN ('channel_header', 'channel_purpose', 'add_to_channel')")
def message_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).where(conversation.valid_message()).select("id", "user_id")


@query(f"""WITH {THREADED}, t AS (SELECT *, CASE WHEN root_id <> '' AND root_id <> id THEN root_id ELSE id END AS thread_id FROM m)
SELECT thread_id, count(*) AS n_messages, count(DISTINCT user_id) AS n_participants, max(ts) FILTER (id = thread_id) AS created_at, max(ts) AS last_activity FROM t GROUP BY 1 HAVING max(ts) FILTER (id = thread_id) IS NOT NULL""")
def thread_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_times(conversation.threads(_turns(spark, sf_dir)), "created_at", "last_activity")


@query("SELECT conv_id, turn, coalesce(string_agg(role || ': ' || coalesce(text, ''), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), '') AS context FROM conversations")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.context_window(table(spark, sf_dir, "conversations"))


def _fixed_sql(source: str, name: str, key: str, size: int, overlap: int) -> str:
    """Recursive: one step a window. reverse/strpos give the last space of a window."""
    w, b = size * 4, overlap * 4
    end = f"CASE WHEN s + {w} < length(t) AND strpos(reverse(substr(t, s + 1, {w})), ' ') > 0 AND {w} - strpos(reverse(substr(t, s + 1, {w})), ' ') > 0 THEN s + {w} - strpos(reverse(substr(t, s + 1, {w})), ' ') ELSE s + {w} END"
    return f"""{name}_steps AS (SELECT {key}, t, 0 AS s, {end.replace('s +', '0 +')} AS e FROM {source} WHERE length(t) > 0 UNION ALL
SELECT {key}, t, n AS s, {end.replace('s +', 'n +')} AS e FROM (SELECT {key}, t, CASE WHEN e - {b} <= s THEN e ELSE e - {b} END AS n FROM {name}_steps) WHERE n < length(t)),
{name} AS (SELECT {key}, s, row_number() OVER (PARTITION BY {key} ORDER BY s) - 1 AS i, c FROM (SELECT {key}, s, regexp_replace(substr(t, s + 1, e - s), '^\\s+|\\s+$', '', 'g') AS c FROM {name}_steps) WHERE c <> '')"""


@query(f"WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {_fixed_sql('d', 'f', 'doc_id', 512, 64)} SELECT doc_id, i::INT AS chunk_index, s::BIGINT AS start_index, c AS content FROM f")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunks.chunk(table(spark, sf_dir, "documents"), "fixed", size=512, overlap=64)
    return found.select("doc_id", F.col("parent_index").alias("chunk_index"), "start_index", "content")


def _packed_sql(split: str, joiner: str) -> str:
    return f"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '{split}'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents),
r AS (SELECT doc_id, l, 1 AS i, 0 AS k, l[1] AS held FROM p WHERE len(l) > 0 UNION ALL
 SELECT doc_id, l, i + 1, CASE WHEN length(held || {joiner} || l[i + 1]) // 4 > 512 THEN k + 1 ELSE k END, CASE WHEN length(held || {joiner} || l[i + 1]) // 4 > 512 THEN l[i + 1] ELSE held || {joiner} || l[i + 1] END FROM r WHERE i < len(l))
SELECT doc_id, k::INT AS chunk_index, arg_max(held, i) AS content FROM r GROUP BY doc_id, k"""


@query(_packed_sql("[.!?]+(?:\\s|$)", "' '"))
def chunk_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk(table(spark, sf_dir, "documents"), "sentences").select("doc_id", F.col("parent_index").alias("chunk_index"), "content")


@query(_packed_sql("\\n\\s*\\n", "chr(10) || chr(10)"))
def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.chunk(table(spark, sf_dir, "documents"), "paragraphs").select("doc_id", F.col("parent_index").alias("chunk_index"), "content")


def chunk_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents and children; a position is where the chunk is next found in the text."""
    return chunks.with_ids(chunks.chunk(table(spark, sf_dir, "documents"), "hierarchical"))


_ID = "substr(sha256(doc_id || '|{0}|' || {1} || '|' || {2}), 1, 16)"
#: fp: parents (doc_id, i, c), gc: children (doc_id, p: parent, i, c), whole: the parent's text.
TWO_LEVELS = f"""d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {_fixed_sql('d', 'fp', 'doc_id', 1024, 64)}, pk AS (SELECT doc_id || '|' || i AS pid, c AS t FROM fp), {_fixed_sql('pk', 'gk', 'pid', 512, 64)},
gc AS (SELECT fp.doc_id, fp.i AS p, gk.i AS i, gk.c AS c, fp.c AS whole FROM gk JOIN fp ON gk.pid = fp.doc_id || '|' || fp.i)"""

QUERIES["chunk_hierarchical"] = chunk_hierarchical
ORACLES["chunk_hierarchical"] = f"""WITH RECURSIVE {TWO_LEVELS}, b AS (SELECT d.doc_id, -1::BIGINT AS i, 0::BIGINT AS start, 0::BIGINT AS a FROM d UNION ALL
SELECT doc_id, i, start, start + length(c) - 256 FROM (SELECT fp.doc_id, fp.i, fp.c, CASE WHEN strpos(substr(d.t, greatest(0, a) + 1), fp.c) > 0 THEN greatest(0, a) + strpos(substr(d.t, greatest(0, a) + 1), fp.c) - 1 ELSE a END AS start
FROM b JOIN fp ON fp.doc_id = b.doc_id AND fp.i = b.i + 1 JOIN d ON d.doc_id = fp.doc_id)),
o AS (SELECT fp.doc_id, 0 AS level, fp.i AS parent_index, 0 AS child_index, start, c AS content, NULL::VARCHAR AS parent_id, NULL::VARCHAR AS position FROM fp JOIN b ON b.doc_id = fp.doc_id AND b.i = fp.i UNION ALL
SELECT gc.doc_id, 1, p, gc.i, start + strpos(whole, c) - 1, c, {_ID.format('0', 'p', '0').replace('doc_id', 'gc.doc_id')}, (gc.i + 1) || '/' || count(*) OVER (PARTITION BY gc.doc_id, p) FROM gc JOIN b ON b.doc_id = gc.doc_id AND b.i = p)
SELECT doc_id, level, parent_index::INT AS parent_index, child_index::INT AS child_index, start::BIGINT AS start_index, content, substr(sha256(doc_id || '|' || level || '|' || parent_index || '|' || child_index), 1, 16) AS chunk_id, parent_id,
(length(content) // 4)::BIGINT AS token_count, length(content)::INT AS char_count, position FROM o"""


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {_fixed_sql('d', 'f', 'doc_id', 1024, 64)}, pk AS (SELECT doc_id || '|' || i AS pid, c AS t FROM f),
{_fixed_sql('pk', 'g', 'pid', 512, 64)}
SELECT substr(sha256(split_part(g.pid, '|', 1) || '|1|' || split_part(g.pid, '|', 2) || '|' || g.i), 1, 16) AS chunk_id, substr(sha256(split_part(g.pid, '|', 1) || '|0|' || split_part(g.pid, '|', 2) || '|0'), 1, 16) AS parent_id,
 replace(pk.t, g.c, '>>>FOCUS>>> ' || g.c || ' <<<FOCUS<<<') AS context FROM g JOIN pk ON g.pid = pk.pid""")
def parent_context_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.expanded_context(chunk_hierarchical(spark, sf_dir))
