"""The queries of the training-data operators, by the names that the driver calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import load
from . import grouped_splits, leakage, near_duplicates, packing, personal, shared_spans, splitting, truncation

Query = Callable[[SparkSession, str], DataFrame]
#: Each table with long texts, its key and its text.
TEXTS = (("paths", "path_id", "path"), ("documents", "doc_id", "text"))


def both(spark: SparkSession, d: str, f: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """f over paths and documents, with the table's name as tbl."""
    out = [f(load(spark, d, tbl), key, text).withColumn("tbl", F.lit(tbl)) for tbl, key, text in TEXTS]
    return out[0].unionByName(out[1])


def _truncated(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judged(load(spark, d, "scored"), load(spark, d, "parts"), load(spark, d, "colors"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of scored whose text is cut."""
    return _truncated(spark, d).where("cut").select("row_id").distinct()


def p1_sources(spark: SparkSession, d: str) -> DataFrame:
    """For each source the share of its rows that are cut."""
    return truncation.shares(_truncated(spark, d))


def p1_limits(spark: SparkSession, d: str) -> DataFrame:
    """The length limits of each source, with the fitted lengths and the censoring posterior."""
    return truncation.limits(truncation.features(load(spark, d, "scored"), load(spark, d, "parts"), load(spark, d, "colors")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Paths of more than 3,000 characters, which must be cut."""
    return splitting.oversized(load(spark, d, "paths"), "path_id", "path").withColumnRenamed("key", "path_id")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All paths in pieces of at most 3,000 characters."""
    return splitting.split_items(load(spark, d, "paths"), "path_id", "path").withColumnRenamed("key", "path_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records alike: five-word runs, at least 60 words each, similarity 0.7 or more."""
    return both(spark, d, near_duplicates.similar_pairs).select("tbl", "key_a", "key_b")


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each record that has a partner, with its group and its number of links."""
    return both(spark, d, near_duplicates.groups).select("tbl", "key", "class_id", "n_links")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different source strings that denote one model."""
    return grouped_splits.same_model(load(spark, d, "paths"), "path_id", "source", "complete_npz")


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    """The split of each path; all walks of a model in one."""
    return grouped_splits.splits(load(spark, d, "paths"), "path_id", "source", "complete_npz").withColumnRenamed("key", "path_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Records with 300 characters in a row that another record of the table has too."""
    return both(spark, d, shared_spans.sharing_records).select("tbl", "record_key")


def p5_shared(spark: SparkSession, d: str) -> DataFrame:
    """How much of each record is found elsewhere in its table."""
    return both(spark, d, shared_spans.shared_amounts).select("tbl", "record_key", "n_stretches", "n_shared", "share")


def p5_stretches(spark: SparkSession, d: str) -> DataFrame:
    """The shared stretches of each record."""
    return both(spark, d, shared_spans.shared_stretches).select("tbl", "record_key", "start", "end")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of more than 6,400 tokens."""
    return packing.oversized(load(spark, d, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """Each document, or piece of one, with its sequence and its place there."""
    return packing.packed(load(spark, d, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


def p7_program(spark: SparkSession, d: str) -> DataFrame:
    """How many sequences are used, and how few any packing could use."""
    return packing.report(load(spark, d, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Items and documents that share at least 13 words in a row."""
    return leakage.leaks(load(spark, d, "documents"), load(spark, d, "eval_items")).select("item_id", "doc_id")


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each document with a leaked passage: how many items, and the longest passage in words."""
    return leakage.by_document(leakage.leaks(load(spark, d, "documents"), load(spark, d, "eval_items")))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Each leaked item: in how many documents, and the longest passage in words."""
    return leakage.by_item(leakage.leaks(load(spark, d, "documents"), load(spark, d, "eval_items")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The personal information in documents, each value once a document."""
    return personal.found(load(spark, d, "documents"), "doc_id", "text", load(spark, d, "parts")).withColumnRenamed("key", "doc_id")


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The documents with placeholders."""
    return personal.redact(load(spark, d, "documents"), "doc_id", "text", load(spark, d, "parts")).withColumnRenamed("key", "doc_id")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_sources, p1_limits, p2_found, p2_pieces, p3_found, p3_groups, p4_found, p4_splits, p5_found, p5_shared, p5_stretches, p7_found, p7_packed, p7_program, p8_found, p8_documents, p8_items, p9_found, p9_redacted)}


# --- the same in SQL, where it can say it and ends in time on whole tables ---------------------------------------


def _both_sql(f: Callable[[str, str, str], str]) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({f(*t)})" for t in TEXTS)


def _similar_sql(tbl: str, key: str, text: str) -> str:
    return f"""
WITH w AS (SELECT {key} AS k, list_filter(regexp_split_to_array(lower({text}), '[ \\t\\r\\n]+'), lambda x: x <> '') AS w FROM {tbl} WHERE {text} IS NOT NULL AND {key} IS NOT NULL),
r AS (SELECT k, unnest(list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: hash(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4])))) AS h FROM w WHERE len(w) >= 60),
n AS (SELECT k, count(*) AS n FROM r GROUP BY k),
c AS (SELECT a.k AS key_a, b.k AS key_b, count(*) AS c FROM r a JOIN r b ON a.h = b.h AND a.k < b.k GROUP BY ALL)
SELECT '{tbl}' AS tbl, key_a, key_b FROM c JOIN n x ON x.k = key_a JOIN n y ON y.k = key_b WHERE c >= 0.7 * (x.n + y.n - c) - 1e-9"""


def _shared_starts(tbl: str, key: str, text: str) -> str:
    """CTEs: s has the starts of all windows that another record has."""
    return f"""
t AS (SELECT {key} AS k, {text} AS x FROM {tbl} WHERE {key} IS NOT NULL AND length({text}) >= 300),
v AS (SELECT k, unnest(generate_series(1, length(x) - 299)) AS pos, x FROM t),
g AS (SELECT k, pos - 1 AS pos, md5(substr(x, CAST(pos AS INT), 300)) AS h FROM v),
m AS (SELECT h FROM g GROUP BY h HAVING min(k) <> max(k)),
s AS (SELECT DISTINCT k, pos FROM g SEMI JOIN m USING (h)),
p AS (SELECT k, pos, lag(pos) OVER w AS before, lead(pos) OVER w AS next FROM s WINDOW w AS (PARTITION BY k ORDER BY pos))"""


def _shared_sql(tbl: str, key: str, text: str) -> str:
    return f"""
WITH {_shared_starts(tbl, key, text)},
c AS (SELECT k, count(*) FILTER (before IS NULL OR pos > before + 300) AS n, CAST(sum(least(300, coalesce(next - pos, 300))) AS BIGINT) AS total FROM p GROUP BY k)
SELECT '{tbl}' AS tbl, a.k AS record_key, coalesce(c.n, 0) AS n_stretches, coalesce(c.total, 0) AS n_shared, CASE WHEN a.n > 0 THEN coalesce(c.total, 0) / a.n ELSE 0.0 END AS share
FROM (SELECT {key} AS k, max(length({text})) AS n FROM {tbl} WHERE {key} IS NOT NULL GROUP BY 1) a LEFT JOIN c ON a.k = c.k"""


def _stretches_sql(tbl: str, key: str, text: str) -> str:
    return f"""
WITH {_shared_starts(tbl, key, text)},
q AS (SELECT k, pos, sum(CASE WHEN before IS NULL OR pos > before + 300 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY pos) AS no FROM p)
SELECT '{tbl}' AS tbl, k AS record_key, min(pos) AS start, max(pos) + 300 AS "end" FROM q GROUP BY k, no"""


_WIDE, _PLAIN = "".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")
_SAME_MODEL = rf"""
WITH d AS (SELECT DISTINCT source FROM paths WHERE source IS NOT NULL AND path_id IS NOT NULL),
a AS (SELECT source, regexp_replace(regexp_replace(lower(url_decode(replace(translate(source, '{_WIDE}', '{_PLAIN}'), '+', ' '))), '[\x{{00AD}}\x{{200B}}-\x{{200F}}\x{{2060}}\x{{FEFF}}]', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g') AS s FROM d),
b AS (SELECT source, s, regexp_replace(regexp_extract(s, '[^/\\\\]*$'), '( ?\.(npz|npy|xz|gz|zst|bz2|zip|jsonl?|ldr|mpd|txt|parquet) ?)+$', '') AS bare FROM a),
c AS (SELECT source, s, regexp_extract(bare, '(?:^|[^a-z0-9])([a-z]+)[^a-z0-9]+([a-z0-9]{{5}})[^a-z0-9]*$', ['t', 'c']) AS x, regexp_extract(bare, '^(?:.*[^a-z0-9])?([a-z]+)[^a-z0-9]+([a-z0-9]{{5}})(?:[^a-z0-9].*)?$', ['t', 'c']) AS y FROM b),
m AS (SELECT source, CASE WHEN x.c <> '' THEN x.t || '-' || x.c WHEN y.c <> '' THEN y.t || '-' || y.c ELSE trim(s) END AS model FROM c)
SELECT p.source AS source_a, q.source AS source_b FROM m p JOIN m q ON p.model = q.model AND p.source < q.source"""

_LEAKS = r"""
w AS (SELECT 'i' AS side, item_id AS k, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL UNION ALL SELECT 'd', doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
u AS (SELECT side, k, w, unnest(generate_series(1, len(w) - 12)) AS pos FROM w WHERE len(w) >= 13),
g AS (SELECT side, k, pos, array_to_string(list_slice(w, pos, pos + 12), ' ') AS run FROM u),
h AS (SELECT DISTINCT a.k AS item_id, b.k AS doc_id, b.pos, b.pos - a.pos AS way FROM g a JOIN g b ON a.run = b.run AND a.side = 'i' AND b.side = 'd'),
l AS (SELECT item_id, doc_id, way, pos - row_number() OVER (PARTITION BY item_id, doc_id, way ORDER BY pos) AS island FROM h),
n AS (SELECT item_id, doc_id, way, island, count(*) + 12 AS n FROM l GROUP BY ALL),
f AS (SELECT item_id, doc_id, CAST(max(n) AS INT) AS n_words FROM n GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": "SELECT DISTINCT path_id FROM paths WHERE length(path) > 3000 AND path_id IS NOT NULL",
        "p3_found": _both_sql(_similar_sql),
        "p4_found": _SAME_MODEL,
        "p5_found": _both_sql(lambda *t: f"WITH {_shared_starts(*t)} SELECT DISTINCT '{t[0]}' AS tbl, k AS record_key FROM s"),
        "p5_shared": _both_sql(_shared_sql),
        "p5_stretches": _both_sql(_stretches_sql),
        "p7_found": "SELECT DISTINCT doc_id FROM documents WHERE octet_length(encode(text)) + 1 > 6400 AND doc_id IS NOT NULL",
        "p8_found": f"WITH {_LEAKS} SELECT item_id, doc_id FROM f",
        "p8_documents": f"WITH {_LEAKS} SELECT doc_id, count(*) AS n_items, max(n_words) AS n_words FROM f GROUP BY doc_id",
        "p8_items": f"WITH {_LEAKS} SELECT item_id, count(*) AS n_docs, max(n_words) AS n_words FROM f GROUP BY item_id",
    }
