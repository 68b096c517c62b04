"""Queries of texts with tables inside and of references between texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import duplicates, points, references, sections, table_driver
from quillmill.operators.storage import stored
from quillmill.plans import assessing, chat, content
from quillmill.plans.chat import _fixed_sql
from quillmill.plans.common import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


_TRIM = "regexp_replace({0}, '^[ \\t\\r\\x0B\\f]+|[ \\t\\r\\x0B\\f]+$', '', 'g')"

#: Tables of texts (no two of them overlap in the given tables): t (doc_id, table_no, format, h: names, rows: cells by name).
TABLES = f"""l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (SELECT doc_id, i, line, 'pipes' AS format FROM l WHERE contains(line, '|') UNION ALL SELECT doc_id, i, line, 'aligned' FROM l WHERE contains(line, chr(9))),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, format ORDER BY i) AS island FROM k),
r AS (SELECT doc_id, format, min(i) AS low, max(i) AS high, list({_TRIM.format('line')} ORDER BY i) AS lines FROM g GROUP BY doc_id, format, island HAVING count(*) >= 2),
c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY low) - 1 AS table_no, format,
  CASE WHEN format = 'pipes' THEN list_transform(list_filter(lines, lambda x: x <> '' AND NOT regexp_full_match(x, '[|+:\\-\\s]+')), lambda x: list_transform(string_split(trim(x, '|'), '|'), lambda y: {_TRIM.format('y')}))
       ELSE list_transform(list_filter(lines, lambda x: x <> ''), lambda x: regexp_split_to_array(x, '\\t+|\\s{{2,}}')) END AS cut FROM r),
t AS (SELECT doc_id, doc_id || '_table_' || table_no AS table_id, format, list_filter(range(1, len(cut[1]) + 1), lambda j: list_position(cut[1], cut[1][j]) = j) AS own, cut[1] AS head,
  list_filter(cut[2:], lambda x: len(x) = len(cut[1])) AS body FROM c WHERE len(cut) > 0),
n AS (SELECT doc_id, table_id, format, list_transform(own, lambda j: head[j]) AS h, len(body) AS n_rows,
  list_transform(body, lambda x: list_transform(own, lambda j: x[len(head) - list_position(list_reverse(head), head[j]) + 1])) AS body FROM t),
b AS (SELECT doc_id, table_id, h, n_rows, unnest(body) AS cells, unnest(range(len(body))) AS i FROM n)"""

COLUMNS = """v AS (SELECT table_id, i, unnest(cells) AS value, unnest(range(len(cells))) AS col FROM b), u AS (SELECT table_id, col, value, count(*) AS n, min(i) AS lo FROM v GROUP BY ALL),
s AS (SELECT doc_id, table_id, n_rows, h, unnest(h) AS name, unnest(range(len(h))) AS col FROM n),
f AS (SELECT s.*, count(value) AS k, coalesce(sum(u.n), 0)::BIGINT AS filled, string_agg('  ' || value || ': ' || u.n || ' (' || printf('%.1f', round(100 * u.n / n_rows, 1)) || '%)', chr(10) ORDER BY u.n DESC, lo) AS spread
  FROM s LEFT JOIN u ON s.table_id = u.table_id AND s.col = u.col GROUP BY ALL),
p AS (SELECT table_id, col, string_agg('  Row ' || (i + 1) || ': ' || value, chr(10) ORDER BY i) AS samples FROM v WHERE i < 10 GROUP BY ALL)"""

CHUNKS = """x AS (
SELECT doc_id, n.table_id, n.table_id || '_table_summary' AS chunk_id, NULL::VARCHAR AS parent_id, 'table_summary' AS chunk_type,
  'Table Summary: ' || n_rows || ' rows × ' || len(h) || ' columns' || chr(10) || 'Format: ' || format || chr(10) || 'Source: ' || chr(10) || chr(10) || 'Columns: ' || array_to_string(h, ', ') || chr(10) || chr(10) || 'Column Information:' || chr(10) ||
  (SELECT string_agg('- ' || name || ': string (' || filled || ' non-null, ' || k || ' unique)', chr(10) ORDER BY col) FROM f WHERE f.table_id = n.table_id) || chr(10) || chr(10) || 'First 5 rows:' ||
  coalesce(chr(10) || (SELECT string_agg('Row ' || (i + 1) || ': ' || array_to_string(list_transform(range(1, len(h) + 1), lambda j: h[j] || '=' || cells[j]), ', '), chr(10) ORDER BY i) FROM b WHERE b.table_id = n.table_id AND i < 5), '') AS content FROM n
UNION ALL
SELECT doc_id, table_id, table_id || '_rows_' || 20 * q || '_' || 20 * (q + 1), table_id || '_table_summary', 'table_rows',
  regexp_replace('Table rows ' || (min(i) + 1) || ' to ' || (max(i) + 1) || ' of ' || any_value(n_rows) || chr(10) || 'Columns: ' || array_to_string(any_value(h), ', ') || chr(10) || chr(10) ||
  string_agg('Row ' || (i + 1) || ':' || chr(10) || array_to_string(list_transform(range(1, len(h) + 1), lambda j: '  ' || h[j] || ': ' || cells[j]), chr(10)), chr(10) || chr(10) ORDER BY i), '[ \\t\\r\\x0B\\f]+$', '')
FROM (SELECT *, unnest(CASE WHEN i % 20 >= 18 AND (i // 20 + 1) * 20 < n_rows THEN [i // 20, i // 20 + 1] ELSE [i // 20] END) AS q FROM b) GROUP BY doc_id, table_id, q
UNION ALL
SELECT doc_id, f.table_id, f.table_id || '_column_' || name, f.table_id || '_table_summary', 'table_column',
  'Column Analysis: ' || name || chr(10) || 'Table: ' || chr(10) || 'Position: Column ' || (f.col + 1) || ' of ' || len(h) || chr(10) || chr(10) || 'Statistics:' || chr(10) || '- Data type: string' || chr(10) ||
  '- Non-null values: ' || filled || '/' || n_rows || chr(10) || '- Unique values: ' || k || chr(10) || chr(10) || CASE WHEN k <= 20 THEN 'Value distribution:' || chr(10) || coalesce(spread || chr(10), '') || chr(10) ELSE '' END ||
  'Sample values (first ' || least(10, n_rows) || '):' || coalesce(chr(10) || samples, '') || CASE WHEN n_rows > 10 THEN chr(10) || '  ... and ' || (n_rows - 10) || ' more values' ELSE '' END
FROM f LEFT JOIN p ON f.table_id = p.table_id AND f.col = p.col)"""

REST = f"""d AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = l.doc_id AND i BETWEEN low AND high)), '') AS t FROM l GROUP BY doc_id),
{_fixed_sql('d', 'fx', 'doc_id', 1024, 64)}, pk AS (SELECT doc_id || '|' || i AS pid, c AS t FROM fx), {_fixed_sql('pk', 'gx', 'pid', 512, 64)}"""


@query(f"""WITH RECURSIVE {TABLES}, {COLUMNS}, {CHUNKS}, {REST},
o AS (SELECT doc_id, NULL::VARCHAR AS table_id, substr(sha256(doc_id || '|0|' || i || '|0'), 1, 16) AS chunk_id, NULL::VARCHAR AS parent_id, NULL::VARCHAR AS main_parent, 'parent' AS chunk_type, c AS content FROM fx UNION ALL
SELECT split_part(pid, '|', 1)::BIGINT, NULL, substr(sha256(split_part(pid, '|', 1) || '|1|' || split_part(pid, '|', 2) || '|' || i), 1, 16), substr(sha256(split_part(pid, '|', 1) || '|0|' || split_part(pid, '|', 2) || '|0'), 1, 16), NULL, 'child', c FROM gx UNION ALL
SELECT x.doc_id, table_id, chunk_id, parent_id, (SELECT substr(sha256(fx.doc_id || '|0|0|0'), 1, 16) FROM fx WHERE fx.doc_id = x.doc_id AND fx.i = 0), chunk_type, content FROM x)
SELECT doc_id, table_id, chunk_id, parent_id, main_parent, chunk_type, md5(content) AS content_md5 FROM o""")
def mixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts' own chunks, and those of the tables inside, linked."""
    return table_driver.mixed_chunks(table(spark, sf_dir, "documents")).withColumn("content_md5", F.md5("content")).drop("content")


_CITED = " UNION ".join(f"SELECT doc_id, lower(unnest(regexp_extract_all(coalesce(text, ''), '(?i){p}', 1))) AS citation FROM documents" for p in references.CITATIONS)


@query(f"""WITH d AS (SELECT doc_id, lower(text) AS t, lower(regexp_replace(split_part(split_part(text, chr(10), 1), '.', 1), '^\\s+|\\s+$', '', 'g')) AS title, lower(source) AS source FROM documents),
ct AS (SELECT title AS p, count(*) AS n, min(doc_id) AS class_id FROM d WHERE length(title) > 10 GROUP BY 1), cs AS (SELECT source AS p, count(*) AS n, min(doc_id) AS class_id FROM d WHERE length(source) > 0 GROUP BY 1),
w AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(title, '\\s+'), lambda x: x <> '')) AS p FROM d), cw AS (SELECT p, count(*) AS n, min(doc_id) AS class_id FROM w GROUP BY 1), c AS ({_CITED}),
m AS (SELECT d.doc_id, 'title_mention' AS reference_type, p AS reference, class_id, n - (title IS NOT DISTINCT FROM p)::INT AS n_documents, 0.9 AS confidence FROM d JOIN ct ON contains(t, p)
UNION ALL SELECT d.doc_id, 'source_mention', p, class_id, n - (source IS NOT DISTINCT FROM p)::INT, 0.7 FROM d JOIN cs ON contains(t, p)
UNION ALL SELECT DISTINCT c.doc_id, 'citation', cw.p, class_id, n - (w.p IS NOT NULL)::INT, 0.6 FROM c JOIN cw ON contains(citation, cw.p) LEFT JOIN w ON w.doc_id = c.doc_id AND w.p = cw.p)
SELECT doc_id, reference_type, reference, class_id, n_documents::BIGINT AS n_documents, confidence::DOUBLE AS confidence FROM m WHERE n_documents > 0""")
def document_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles (a text's first line up to its first full stop), sources and cited title words of all documents, in all documents."""
    first = F.substring_index(F.substring_index("text", "\n", 1), ".", 1)
    return references.references(table(spark, sf_dir, "documents"), F.regexp_replace(first, "^\\s+|\\s+$", ""), F.col("source"))


_EDGES = "SELECT doc_id, reference_type AS edge_type, class_id::VARCHAR AS target, n_documents::DOUBLE AS weight FROM ({0}) UNION ALL SELECT query_id, 'related_topic', related_id::VARCHAR, similarity FROM ({1}) UNION ALL SELECT doc_id, 'cluster', unnest(string_split(clusters, ',')), NULL FROM ({2}) WHERE clusters <> '' UNION ALL SELECT doc_id, 'authority', nearest_id::VARCHAR, n_connections FROM ({3}) WHERE n_connections > 0"


@query(_EDGES.format(ORACLES["document_references"], content.ORACLES["related_topics"], assessing.ORACLES["content_clusters"], assessing.ORACLES["authority_connections"]))
def relationship_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's relations as typed edges: references, related topics (of the documents that ask), clusters, authority."""
    edge = lambda df, key, kind, target, weight: df.select(F.col(key).alias("doc_id"), kind.alias("edge_type"), target.cast("string").alias("target"), weight.cast("double").alias("weight"))
    clusters = assessing.content_clusters(spark, sf_dir).where("clusters <> ''").withColumn("cluster", F.explode(F.split("clusters", ",")))
    sets = stored(duplicates.term_sets(assessing.with_authority(spark, sf_dir), "authority"), "term_sets")  # once for both that take them
    strong = assessing.authority_connections(spark, sf_dir, sets).where("n_connections > 0")
    edges = edge(document_references(spark, sf_dir), "doc_id", F.col("reference_type"), F.col("class_id"), F.col("n_documents"))
    edges = edges.unionByName(edge(content.related_topics(spark, sf_dir, sets), "query_id", F.lit("related_topic"), F.col("related_id"), F.col("similarity")))
    return edges.unionByName(edge(clusters, "doc_id", F.lit("cluster"), F.col("cluster"), F.lit(None))).unionByName(edge(strong, "doc_id", F.lit("authority"), F.col("nearest_id"), F.col("n_connections")))


def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of all documents. Cutting goes on from line to line, so there are tests instead of SQL."""
    return sections.explode_chunks(table(spark, sf_dir, "documents"), "markdown")


def chunk_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as blocks of code."""
    return sections.explode_chunks(table(spark, sf_dir, "documents"), "python")


def chunk_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as lines under a header."""
    return sections.explode_chunks(table(spark, sf_dir, "documents"), "csv")


QUERIES |= {"chunk_markdown": chunk_markdown, "chunk_code": chunk_code, "chunk_csv": chunk_csv}


_POINT = "substr(sha256(key || '|{0}|' || {1} || '|' || {2}), 1, 16)"


@query(f"""WITH RECURSIVE x AS ({chat.ORACLES['conversation_text']}), d AS (SELECT channel || '|' || session || '|' || part AS key, text AS t FROM x WHERE length(text) >= 100),
{_fixed_sql('d', 'fp', 'key', 1024, 64)}, pk AS (SELECT key || '#' || i AS pid, c AS t FROM fp), {_fixed_sql('pk', 'gk', 'pid', 512, 64)},
b AS (SELECT key, -1::BIGINT AS i, 0::BIGINT AS start, 0::BIGINT AS a FROM d UNION ALL
SELECT key, i, start, start + length(c) - 256 FROM (SELECT fp.key, fp.i, fp.c, CASE WHEN strpos(substr(d.t, greatest(0, a) + 1), fp.c) > 0 THEN greatest(0, a) + strpos(substr(d.t, greatest(0, a) + 1), fp.c) - 1 ELSE a END AS start
FROM b JOIN fp ON fp.key = b.key AND fp.i = b.i + 1 JOIN d ON d.key = fp.key)),
o AS (SELECT key, 0 AS level, fp.i AS p, 0 AS k, start, c, NULL::VARCHAR AS parent_id FROM fp JOIN b USING (key, i) UNION ALL
SELECT fp.key, 1, fp.i, gk.i, start + strpos(fp.c, gk.c) - 1, gk.c, {_POINT.format('0', 'fp.i', '0').replace('key', 'fp.key')} FROM gk JOIN fp ON gk.pid = fp.key || '#' || fp.i JOIN b ON b.key = fp.key AND b.i = fp.i)
SELECT {_POINT.format("' || level || '", 'p', 'k')} AS id, c AS content, 'chat://' || split_part(key, '|', 1) AS source, key AS document_id, CASE level WHEN 1 THEN 'child' ELSE 'parent' END AS chunk_type, parent_id, level AS hierarchy_level,
start::BIGINT AS start_index, (start + length(c))::BIGINT AS end_index, (length(c) // 4)::BIGINT AS token_count, length(c)::INT AS char_count, split_part(key, '|', 1) AS channel, split_part(key, '|', 2)::BIGINT AS session, split_part(key, '|', 3)::BIGINT AS part FROM o""")
def channel_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's chunks as flat points of a store."""
    return points.channel_points(chat.conversation_text(spark, sf_dir))
