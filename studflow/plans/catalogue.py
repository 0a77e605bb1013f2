"""All queries of the core, on the project's tables, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import affine
from ..functions import scalar as S
from ..operators import assembly, catalog, collision, components, evaluation, grammar, offsets, pools, records, spatial, walks, whole_texts
from ..tables import checkpointed, load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _catalogue(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return load(spark, d, "parts"), load(spark, d, "colors"), load(spark, d, "connectors")


def _rounded(c: Column, n: int = 6) -> Column:
    """Rounded, without negative zeros."""
    return F.round(c, n) + F.lit(0.0)


# --- problem 6 -------------------------------------------------------------------------------------------------


def _records_sql() -> str:
    """CTE v: raw_id, the five fields, and the reason (null for good records)."""
    per = lambda f: "CASE delim WHEN 'semicolon' THEN " + f(";") + " WHEN 'tab' THEN " + f("\\t") + " ELSE " + f(",") + " END"
    field = lambda d: f'"(?:[^"]|"")*"|[^"{d}]*'
    whole = per(lambda d: f"regexp_full_match(rec, '(?:{field(d)})(?:{d}(?:{field(d)}))*')")
    parts = per(lambda d: f"regexp_extract_all('{d.replace('\\t', chr(9))}' || rec, '{d}({field(d)})', 1)")
    n = "'0|[1-9][0-9]*'"
    small = lambda c: f"(length({c}) < 19 OR length({c}) = 19 AND {c} <= '9223372036854775807')"
    return f"""
WITH r AS (SELECT raw_id, delim, CASE WHEN record LIKE '%' || chr(13) || chr(10) THEN left(record, -2) WHEN record LIKE '%' || chr(10) OR record LIKE '%' || chr(13) THEN left(record, -1) ELSE record END AS rec FROM raw_scored),
q AS (SELECT raw_id, rec, {whole} AS quoted, {parts} AS f FROM r),
u AS (SELECT raw_id, rec, quoted, list_transform(f, lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END) AS f FROM q),
e AS (SELECT raw_id, rec, quoted, len(f) AS n, f[1] AS id, f[2] AS sample, f[3] AS text, f[4] AS n_actions, f[5] AS invalid FROM u),
v AS (SELECT *, CASE WHEN rec IS NULL THEN 'columns' WHEN NOT quoted THEN 'quoting' WHEN n <> 5 THEN 'columns'
  WHEN regexp_full_match(id, '[\\s\\p{{Z}}]*') OR regexp_full_match(text, '[\\s\\p{{Z}}]*') OR NOT regexp_full_match(sample, {n}) OR NOT regexp_full_match(n_actions, {n}) OR n_actions = '0' OR NOT (invalid = '' OR regexp_full_match(invalid, {n}))
    OR NOT {small('sample')} OR NOT {small('n_actions')} OR invalid <> '' AND NOT {small('invalid')} OR TRY_CAST(nullif(invalid, '') AS BIGINT) > TRY_CAST(n_actions AS BIGINT) THEN 'value' END AS reason FROM e)"""


@query(_records_sql() + " SELECT raw_id, reason FROM v WHERE reason IS NOT NULL")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that can't be read, with the reason."""
    return records.bad_records(load(spark, d, "raw_scored"), "raw_id", "record", "delim").withColumnRenamed("key", "raw_id")


@query(_records_sql() + " SELECT raw_id, id, CAST(sample AS BIGINT) AS sample, text, CAST(n_actions AS BIGINT) AS n_actions, CAST(nullif(invalid, '') AS BIGINT) AS invalid FROM v WHERE reason IS NULL")
def p6_rows(spark: SparkSession, d: str) -> DataFrame:
    """The good records in typed columns."""
    return records.good_records(load(spark, d, "raw_scored"), "raw_id", "record", "delim").withColumnRenamed("key", "raw_id")


# --- path text -------------------------------------------------------------------------------------------------


def _letters(s: str) -> str:
    return f"(CASE WHEN regexp_full_match({s}, '[a-z]{{1,13}}') THEN CAST(list_sum(list_transform(generate_series(1, length({s})), lambda i: (ascii(substr({s}, CAST(i AS INT), 1)) - 96) * power(26, length({s}) - i))) - 1 AS BIGINT) END)"


def _checked_sql(table: str, key: str, text: str) -> str:
    """CTEs up to o: each pair's lines, with ok."""
    deg = lambda t: f"regexp_full_match({t}, '0|[1-9][0-9]?|[12][0-9][0-9]|3[0-5][0-9]')"
    mates = lambda pairs: "least(ps, cs) || '+' || greatest(ps, cs) IN (" + ", ".join(f"'{a}+{b}'" for a, b in pairs) + ")"
    return f"""
WITH t AS (SELECT {key}, CASE WHEN {text} LIKE '%' || chr(10) THEN {text} ELSE {text} || chr(10) END AS tx FROM {table} WHERE {text} IS NOT NULL AND {key} IS NOT NULL),
l AS (SELECT {key}, CAST((length(tx) - length(replace(tx, chr(10), '')) + 2) // 2 AS INT) AS n_actions, list_slice(string_split(tx, chr(10)), 1, len(string_split(tx, chr(10))) - 1) AS ls FROM t),
x AS (SELECT *, len(ls) AS n, unnest(generate_series(0, len(ls) - 1)) AS k FROM l),
f AS (SELECT {key}, n_actions, n, k, (k + 1) // 2 AS pair, k = 0 OR k % 2 = 1 AS is_node, ls[k + 1] AS line, ls, string_split(ls[k + 1], ' ') AS w FROM x WHERE k = 0 OR n % 2 = 1 OR k < n - 1),
g AS (SELECT *, strpos(line, ' | ') AS bar, split_part(line, ' | ', 1) AS lft, w[2] AS fam, {_letters('w[1]')} AS par,
  CASE WHEN w[2] IN ('stud', 'axle') THEN w[3] WHEN w[2] IN ('hinge', 'ball', 'fixed') THEN CAST({_letters('w[3]')} AS VARCHAR) END AS ps,
  CASE WHEN w[2] IN ('stud', 'axle') THEN w[5] WHEN w[2] IN ('hinge', 'ball', 'fixed') THEN CAST({_letters('w[3]')} AS VARCHAR) END AS cs,
  CASE WHEN w[2] IN ('hinge', 'ball', 'fixed') AND w[4] IN ('in', 'on') THEN w[4] END AS pp,
  CASE WHEN w[2] IN ('stud', 'axle') THEN {_letters('w[4]')} ELSE {_letters('w[5]')} END AS pc, {_letters('w[6]')} AS cc FROM f),
h AS (SELECT *, CASE WHEN strpos(lft, ' ') > 0 THEN substr(lft, strpos(lft, ' ') + 1) ELSE '' END AS nm,
  CASE WHEN par < pair THEN (CASE WHEN par = 0 THEN ls[1] ELSE ls[2 * par] END) END AS pline, CASE WHEN NOT is_node THEN ls[k] END AS cline FROM g),
c AS (SELECT name, sub, coalesce(pol, '') AS pol, count(*) AS cn FROM connectors JOIN parts USING (part_id) GROUP BY ALL),
nm2 AS (SELECT *, substr(split_part(pline, ' | ', 1), strpos(split_part(pline, ' | ', 1), ' ') + 1) AS pname, substr(split_part(cline, ' | ', 1), strpos(split_part(cline, ' | ', 1), ' ') + 1) AS cname FROM h),
j AS (SELECT h.*, p.name IS NOT NULL AS has_part, q.name IS NOT NULL AS has_color, a.cn AS pn, b.cn AS cn2 FROM nm2 h
  LEFT JOIN (SELECT DISTINCT name FROM parts) p ON h.nm = p.name LEFT JOIN (SELECT DISTINCT name FROM colors) q ON substr(h.line, h.bar + 3) = q.name
  LEFT JOIN c a ON h.pname = a.name AND h.ps = a.sub AND coalesce(h.pp, '') = a.pol
  LEFT JOIN c b ON h.cname = b.name AND h.cs = b.sub AND (CASE h.pp WHEN 'in' THEN 'on' WHEN 'on' THEN 'in' ELSE '' END) = b.pol),
o AS (SELECT {key}, n_actions, n, pair, is_node, line, nm, bar, coalesce(CASE WHEN is_node THEN bar > 0 AND regexp_full_match(split_part(lft, ' ', 1), '[a-z]+') AND strpos(lft, ' ') > 0 AND has_part AND has_color
  ELSE par < pair AND pc < pn AND cc < cn2 AND CASE fam
    WHEN 'stud' THEN len(w) = 7 AND {mates(S.STUD_MATES)} AND {deg('w[7]')}
    WHEN 'axle' THEN len(w) = 9 AND {mates(S.AXLE_MATES)} AND w[7] IN ('flip', 'regular') AND {deg('w[8]')} AND regexp_full_match(w[9], '0|-?[1-9][0-9]{{0,17}}')
    WHEN 'hinge' THEN len(w) = 8 AND pp IS NOT NULL AND w[7] IN ('flip', 'regular') AND {deg('w[8]')}
    WHEN 'ball' THEN len(w) = 9 AND pp IS NOT NULL AND {deg('w[7]')} AND {deg('w[8]')} AND {deg('w[9]')}
    WHEN 'fixed' THEN len(w) = 6 AND pp IS NOT NULL ELSE FALSE END END, FALSE) AS ok FROM j)"""


def _score_sql(table: str, key: str, text: str) -> str:
    return f"""{_checked_sql(table, key, text)}
SELECT {key}, any_value(n_actions) AS n_actions, CAST(least(min(CASE WHEN NOT ok THEN pair END), CASE WHEN any_value(n) % 2 = 0 THEN any_value(n) // 2 END) AS INT) AS invalid FROM o GROUP BY {key}"""


@query(_score_sql("scored", "row_id", "text"))
def score_texts(spark: SparkSession, d: str) -> DataFrame:
    """Actions and first wrong action of each generated text."""
    return grammar.scores(load(spark, d, "scored"), "row_id", "text", *_catalogue(spark, d)).withColumnRenamed("key", "row_id")


@query(_score_sql("paths", "path_id", "path"))
def path_scores(spark: SparkSession, d: str) -> DataFrame:
    """The same of each sampled path."""
    return grammar.scores(load(spark, d, "paths"), "path_id", "path", *_catalogue(spark, d)).withColumnRenamed("key", "path_id")


def _trees(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return grammar.trees(load(spark, d, "paths"), "path_id", "path", *_catalogue(spark, d))


def _rewritten_sql() -> str:
    c = lambda x: f"chr(CAST(97 + {x} AS INT))"
    letters = f"CASE WHEN pair < 26 THEN {c('pair')} WHEN pair < 702 THEN {c('(pair - 26) // 26')} || {c('(pair - 26) % 26')} ELSE {c('(pair - 702) // 676')} || {c('(pair - 702) // 26 % 26')} || {c('(pair - 702) % 26')} END"
    return f"""{_checked_sql("paths", "path_id", "path")},
b AS (SELECT path_id, min(CASE WHEN NOT ok THEN pair END) AS bad FROM o GROUP BY path_id),
k AS (SELECT o.* FROM o JOIN b USING (path_id) WHERE bad IS NULL OR pair < bad),
i AS (SELECT name, arg_max(code, ord) AS code FROM colors GROUP BY name), z AS (SELECT code, arg_max(name, ord) AS color FROM colors GROUP BY code)
SELECT path_id, string_agg(CASE WHEN is_node THEN {letters} || ' ' || nm || ' | ' || color ELSE line END, chr(10) ORDER BY pair, is_node DESC) || chr(10) AS text
FROM k LEFT JOIN i ON is_node AND substr(line, bar + 3) = i.name LEFT JOIN z USING (code) GROUP BY path_id"""


@query(_rewritten_sql())
def path_rewritten(spark: SparkSession, d: str) -> DataFrame:
    """Each path parsed and written again, with canonical labels and colour names."""
    return grammar.serialized(*_trees(spark, d), *_catalogue(spark, d)[:2]).withColumnRenamed("key", "path_id")


_FIRST_BAD = "list_min(list_concat([CASE WHEN invalid IS NULL THEN n_actions ELSE invalid END], collisions))"


@query(f"SELECT count(*) AS n, count(*) FILTER (invalid IS NULL) AS parsable, CASE WHEN bool_and(collisions IS NOT NULL) THEN count(*) FILTER (invalid IS NULL AND len(collisions) = 0) END AS clean, CASE WHEN bool_and(collisions IS NOT NULL) THEN round(avg({_FIRST_BAD}), 6) END AS mean_first_failure FROM scored")
def score_summary(spark: SparkSession, d: str) -> DataFrame:
    """Summary of stored scores; null where some row has no collisions."""
    return grammar.summary(load(spark, d, "scored")).withColumn("mean_first_failure", F.round("mean_first_failure", 6))


@query(f"SELECT count(*) AS n, count(*) FILTER (invalid IS NULL) AS parsable, count(*) FILTER (invalid IS NULL AND len(collisions) = 0) AS clean, round(avg({_FIRST_BAD}), 6) AS mean_first_failure FROM scored WHERE collisions IS NOT NULL")
def score_summary_checked(spark: SparkSession, d: str) -> DataFrame:
    """The same of the rows whose collisions were checked."""
    return grammar.summary(load(spark, d, "scored").where("collisions is not null")).withColumn("mean_first_failure", F.round("mean_first_failure", 6))


# --- scalar functions ------------------------------------------------------------------------------------------


@query("WITH n AS (SELECT p_partkey, p_partkey AS k FROM part) SELECT p_partkey, CASE WHEN k < 26 THEN chr(CAST(97 + k AS INT)) WHEN k < 702 THEN chr(CAST(97 + (k - 26) // 26 AS INT)) || chr(CAST(97 + (k - 26) % 26 AS INT)) WHEN k < 18278 THEN chr(CAST(97 + (k - 702) // 676 AS INT)) || chr(CAST(97 + (k - 702) // 26 % 26 AS INT)) || chr(CAST(97 + (k - 702) % 26 AS INT)) ELSE chr(CAST(97 + (k - 18278) // 17576 AS INT)) || chr(CAST(97 + (k - 18278) // 676 % 26 AS INT)) || chr(CAST(97 + (k - 18278) // 26 % 26 AS INT)) || chr(CAST(97 + (k - 18278) % 26 AS INT)) END AS letters, k AS number FROM n")
def letter_ids(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "part").select("p_partkey", S.i2id(F.col("p_partkey")).alias("letters"))
    return x.withColumn("number", S.id2i(F.col("letters")))


@query("WITH w AS (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS word FROM scored WHERE text IS NOT NULL) SELECT word, count(*) AS n, CASE WHEN regexp_full_match(word, '0|-?[1-9][0-9]{0,17}') THEN CAST(word AS BIGINT) END AS number, CASE WHEN regexp_full_match(word, '0|[1-9][0-9]?|[12][0-9][0-9]|3[0-5][0-9]') THEN CAST(word AS INT) END AS degrees FROM w GROUP BY word")
def whole_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The words of all texts, with what they are as canonical integers and as degrees."""
    w = load(spark, d, "scored").where("text is not null").select(F.explode(F.split(F.regexp_replace("text", "\n", " "), " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return w.select("word", "n", S.canonical_int(F.col("word")).alias("number"), S.degree(F.col("word")).alias("degrees"))


@query("SELECT vec_id, CAST(((CAST(round_even(degrees(CAST(embedding[1] AS DOUBLE) * 20), 0) AS BIGINT) % 360) + 360) % 360 AS INT) AS degrees, CAST(round_even(CAST(embedding[2] AS DOUBLE) * 100, 0) AS BIGINT) AS slide FROM embeddings")
def quantized(spark: SparkSession, d: str) -> DataFrame:
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return load(spark, d, "embeddings").select("vec_id", S.quantized_degrees(e(0) * 20).alias("degrees"), S.quantized_slide(e(1) * 100).alias("slide"))


@query("SELECT DISTINCT sub, CASE sub WHEN 'stud' THEN 0 WHEN 'open' THEN 1 WHEN 'hole' THEN 2 WHEN 'tube' THEN 3 WHEN 'post' THEN 4 WHEN 'bar' THEN 5 WHEN 'clip' THEN 6 WHEN 'axle' THEN 7 WHEN 'cross' THEN 8 WHEN 'pin' THEN 9 WHEN 'socket' THEN 10 ELSE 100 + TRY_CAST(sub AS INT) END AS code FROM connectors")
def subtype_codes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "connectors").select("sub").distinct().select("sub", S.sub_code(F.col("sub")).alias("code"))


@query("SELECT doc_id, CAST((length(text) - length(replace(text, chr(10), '')) + (CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END) + 2) // 2 AS INT) AS n_actions, CASE WHEN len(string_split(text, chr(10))) > 3 THEN array_to_string(list_slice(string_split(text, chr(10)), 1, 3), chr(10)) || chr(10) ELSE text END AS head, len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, 'a '))) AS root_lines FROM documents")
def text_lines(spark: SparkSession, d: str) -> DataFrame:
    """Actions, the first three lines, and the lines that begin like a root node."""
    t = F.col("text")
    return load(spark, d, "documents").select("doc_id", S.n_actions(t).alias("n_actions"), S.first_lines(t, 3).alias("head"), F.size(F.filter(F.split(t, "\n"), lambda x: F.startswith(x, F.lit("a ")))).cast("bigint").alias("root_lines"))


@query("SELECT vec_id, round(1 / (1 + exp(-CAST(embedding[1] AS DOUBLE))), 9) AS sigmoid, round(exp(CAST(embedding[label + 1] AS DOUBLE)) / list_sum(list_transform(embedding, lambda v: exp(CAST(v AS DOUBLE)))), 9) AS softmax FROM embeddings")
def score_functions(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select("vec_id", F.round(S.sigmoid(F.get("embedding", F.lit(0)).cast("double")), 9).alias("sigmoid"), F.round(S.softmax_pick(F.col("embedding"), F.col("label")), 9).alias("softmax"))


@query("WITH m AS (SELECT max(len(collisions)) AS m FROM scored) SELECT row_id, array_to_string(list_concat(list_resize(CAST([] AS INT[]), m - len(collisions), -1), collisions), ',') AS padded FROM scored, m WHERE collisions IS NOT NULL")
def padded_lists(spark: SparkSession, d: str) -> DataFrame:
    """Collision lists padded on the left to the longest."""
    x = load(spark, d, "scored").where("collisions is not null").select("row_id", "collisions")
    most = x.agg(F.max(F.size("collisions")).alias("most"))
    return x.join(F.broadcast(most)).select("row_id", F.array_join(S.left_padded(F.col("collisions"), F.col("most"), F.lit(-1)), ",").alias("padded"))


# --- catalogue -------------------------------------------------------------------------------------------------


@query("SELECT code, arg_max(name, ord) AS name FROM colors GROUP BY code")
def color_names(spark: SparkSession, d: str) -> DataFrame:
    return catalog.color_names(load(spark, d, "colors"))


@query("SELECT part_id, sub, pol, count(*) AS n FROM connectors GROUP BY ALL")
def connector_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.connector_counts(load(spark, d, "connectors"))


@query("SELECT part_id, kind, sub, pol, \"row\", CAST(row_number() OVER (PARTITION BY part_id ORDER BY kind, sub, pol NULLS FIRST, \"row\") - 1 AS INT) AS conn_idx, CAST(row_number() OVER (PARTITION BY part_id, sub, pol ORDER BY kind, \"row\") - 1 AS INT) AS subgroup_idx FROM (SELECT part_id, kind, sub, pol, conn_idx AS \"row\" FROM connectors)")
def connector_order(spark: SparkSession, d: str) -> DataFrame:
    """The canonical order worked out again from the rows."""
    return catalog.ordered(load(spark, d, "connectors").select("part_id", "kind", "sub", "pol", F.col("conn_idx").alias("row")))


@query("WITH s AS (SELECT src AS stem FROM aliases UNION SELECT stem FROM parts UNION SELECT 'x' || stem FROM parts) SELECT s.stem, coalesce(a.dst, s.stem) AS dst, p.part_id FROM s LEFT JOIN aliases a ON s.stem = a.src LEFT JOIN parts p ON coalesce(a.dst, s.stem) = p.stem")
def stem_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Stems by alias and vocabulary, unknown ones included."""
    parts, aliases = load(spark, d, "parts"), load(spark, d, "aliases")
    stems = aliases.select(F.col("src").alias("stem")).unionByName(parts.select("stem")).unionByName(parts.select(F.concat(F.lit("x"), "stem").alias("stem"))).distinct()
    return catalog.resolved_stems(stems, aliases, parts).select("stem", "dst", "part_id")


def _m(a: str, i: int, j: int) -> str:
    return f"{a}[{4 * i + j + 1}]"


def _product_sql(a: str, b: str, i: int, j: int) -> str:
    return " + ".join(f"{_m(a, i, k)} * {_m(b, k, j)}" for k in range(4))


@query("SELECT src, conn_idx, " + ", ".join(f"round({_product_sql('wrap', 'frame', i, 3)}, 6) + 0.0 AS {'xyz'[i]}, round({_product_sql('wrap', 'frame', i, 1)}, 6) + 0.0 AS u{'xyz'[i]}" for i in range(3)) + " FROM aliases JOIN parts ON dst = stem JOIN connectors USING (part_id)")
def alias_frames(spark: SparkSession, d: str) -> DataFrame:
    """The connectors of aliased parts in their alias' frame."""
    x = load(spark, d, "aliases").join(load(spark, d, "parts"), F.col("dst") == F.col("stem")).join(load(spark, d, "connectors"), "part_id")
    x = x.select("src", "conn_idx", affine.product(F.col("wrap"), F.col("frame")).alias("m"))
    return x.select("src", "conn_idx", *[_rounded(F.get("m", F.lit(4 * i + j))).alias(p + "xyz"[i]) for i in range(3) for j, p in ((3, ""), (1, "u"))])


@query("SELECT part_id, conn_idx, " + ", ".join(f"round(-({' + '.join(f'{_m('frame', k, i)} * {_m('frame', k, 3)}' for k in range(3))}), 6) + 0.0 AS {'xyz'[i]}, round(-{_m('frame', i, 1)} / sqrt({' + '.join(f'{_m('frame', k, 1)} * {_m('frame', k, 1)}' for k in range(3))}), 6) + 0.0 AS a{'xyz'[i]}" for i in range(3)) + " FROM connectors")
def connector_axes(spark: SparkSession, d: str) -> DataFrame:
    """Each connector's mating axis, and where the part's origin lies in its frame (frames are orthonormal)."""
    x = load(spark, d, "connectors").select("part_id", "conn_idx", affine.inverse(F.col("frame")).alias("inv"), affine.axis(F.col("frame")).alias("ax"))
    return x.select("part_id", "conn_idx", *[_rounded(F.get(c, F.lit(k))).alias(n) for i in range(3) for c, k, n in (("inv", 4 * i + 3, "xyz"[i]), ("ax", i, "a" + "xyz"[i]))])


# --- spatial joins and graphs ----------------------------------------------------------------------------------

_POINTS = "p AS (SELECT vec_id AS v, CAST(embedding[1] AS DOUBLE) * 40 AS x, CAST(embedding[2] AS DOUBLE) * 40 AS y, CAST(embedding[3] AS DOUBLE) * 40 AS z FROM embeddings)"
_NEAR = f"{_POINTS}, e AS (SELECT s.v AS a, t.v AS b, sqrt(pow(s.x - t.x, 2) + pow(s.y - t.y, 2) + pow(s.z - t.z, 2)) AS distance FROM p s JOIN p t ON s.v < t.v AND pow(s.x - t.x, 2) + pow(s.y - t.y, 2) + pow(s.z - t.z, 2) <= 9)"


def _points(spark: SparkSession, d: str) -> DataFrame:
    p = F.array(*[F.get("embedding", F.lit(k)).cast("double") * 40 for k in range(3)])
    return load(spark, d, "embeddings").select(F.lit(0).alias("graph_id"), "vec_id", p.alias("p"))


def _near(spark: SparkSession, d: str) -> DataFrame:
    return spatial.radius_pairs(_points(spark, d), ["graph_id"], "vec_id", 3.0)


@query(f"WITH {_NEAR} SELECT a, b, round(distance, 6) AS distance FROM e")
def radius_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).select("a", "b", F.round("distance", 6).alias("distance"))


@query(f"WITH {_POINTS} SELECT s.v AS a, t.v AS b FROM p s JOIN p t ON s.v < t.v AND abs(s.x - t.x) <= 4 AND abs(s.y - t.y) <= 4 AND abs(s.z - t.z) <= 4")
def box_pairs(spark: SparkSession, d: str) -> DataFrame:
    moved = lambda k: F.transform("p", lambda v: v + k)
    boxes = _points(spark, d).select("graph_id", "vec_id", moved(-2.0).alias("lo"), moved(2.0).alias("hi"))
    return spatial.overlapping_boxes(boxes, ["graph_id"], "vec_id", 8.0).select("a", "b")


@query(f"WITH RECURSIVE {_NEAR}, s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT v AS node, v AS low FROM p UNION SELECT s.b, r.low FROM r JOIN s ON s.a = r.node) SELECT node, min(low) AS component FROM r GROUP BY node")
def point_components(spark: SparkSession, d: str) -> DataFrame:
    """Connected components, points on their own included."""
    own = _points(spark, d).select(F.col("vec_id").alias("a"), F.col("vec_id").alias("b"))
    return components.connected_components(_near(spark, d).select("a", "b").unionByName(own), "a", "b")


@query(f"WITH {_NEAR}, s AS (SELECT a AS node, b AS neighbour, TRUE AS forward FROM e UNION ALL SELECT b, a, FALSE FROM e) SELECT node, neighbour, forward, CAST(row_number() OVER (PARTITION BY node ORDER BY neighbour) - 1 AS INT) AS at FROM s")
def point_adjacency(spark: SparkSession, d: str) -> DataFrame:
    e = _near(spark, d).select("graph_id", F.lit("stud").alias("family"), F.col("a").cast("int"), F.lit(0).alias("a_conn"), F.col("b").cast("int"), F.lit(0).alias("b_conn"))
    return assembly.adjacency(e).select(F.col("node").cast("bigint"), F.col("neighbour").cast("bigint"), "forward", "at")


@query(f"WITH RECURSIVE {_NEAR}, s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT v AS node, v AS low FROM p UNION SELECT s.b, r.low FROM r JOIN s ON s.a = r.node), c AS (SELECT node, min(low) AS low FROM r GROUP BY node), d AS (SELECT DISTINCT low AS node, low, 0 AS depth FROM c UNION SELECT s.b, d.low, d.depth + 1 FROM d JOIN s ON s.a = d.node WHERE d.depth < 60) SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM d GROUP BY node")
def point_depths(spark: SparkSession, d: str) -> DataFrame:
    """Steps from the lowest node of each component along the breadth-first walk."""
    e = _near(spark, d).select("graph_id", F.lit("stud").alias("family"), F.col("a").cast("int").alias("a"), F.lit(0).alias("a_conn"), F.col("b").cast("int").alias("b"), F.lit(0).alias("b_conn"), F.lit(0.0).alias("yaw"), F.lit(False).alias("flip"), F.array(*[F.lit(0.0)] * 3).alias("rot"))
    nodes = _points(spark, d).select("graph_id", F.col("vec_id").cast("int").alias("node"))
    c = assembly.graph_components(nodes, e)
    w = walks.walked(e, c, c.select("graph_id", "component_index").distinct().withColumn("seed", F.lit(None).cast("bigint")), "bfs")
    per = w.groupBy("graph_id", "component_index").agg(F.array_sort(F.collect_list(F.struct("pos", "node", "parent_pos"))).alias("v"))
    depth = F.aggregate("v", F.array().cast("array<bigint>"), lambda acc, x: F.array_append(acc, F.when(x["parent_pos"].isNull(), F.lit(0).cast("bigint")).otherwise(F.get(acc, x["parent_pos"].cast("int")) + 1)))
    return per.select(F.explode(F.arrays_zip(F.transform("v", lambda x: x["node"]).alias("node"), depth.alias("depth"))).alias("r")).select(F.col("r.node").cast("bigint").alias("node"), F.col("r.depth").alias("depth"))


@query("WITH c AS (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL) SELECT o_orderkey, n, CAST(sum(n) OVER (ORDER BY o_orderkey) - n AS BIGINT) AS lo, CAST(sum(n) OVER (ORDER BY o_orderkey) AS BIGINT) AS hi FROM c")
def packed_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where each order's lines lie when all lists are packed end to end."""
    c = load(spark, d, "orders").select("o_orderkey").join(load(spark, d, "lineitem").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("n"))
    return offsets.packed(c, "o_orderkey", "n").select("o_orderkey", "n", "lo", "hi")


@query("WITH c AS (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL), r AS (SELECT o_orderkey, CAST(sum(n) OVER (ORDER BY o_orderkey) - n AS BIGINT) AS lo, n FROM c) SELECT o_orderkey, CAST(g AS INT) AS at, lo + g AS entry FROM (SELECT *, unnest(generate_series(0, n - 1)) AS g FROM r WHERE n > 0)")
def unpacked_offsets(spark: SparkSession, d: str) -> DataFrame:
    return offsets.unpacked(packed_offsets(spark, d), "o_orderkey")


_MATES = lambda pairs: "least(a.sub, b.sub) || '+' || greatest(a.sub, b.sub) IN (" + ", ".join(f"'{x}+{y}'" for x, y in pairs) + ")"
_DOT = lambda i, j: " + ".join(f"a.frame[{4 * k + i + 1}] * b.frame[{4 * k + j + 1}]" for k in range(3))
_GRID = (10.0, 8.0, 10.0)  # places are rounded to it, so that parts stand where their connectors may meet
_JOINTS = f"""
n AS (SELECT vec_id AS node, CAST(vec_id % (SELECT count(*) FROM parts) AS INT) AS part_id, round(CAST(embedding[1] AS DOUBLE) * 9) * {_GRID[0]} AS x, round(CAST(embedding[2] AS DOUBLE) * 9) * {_GRID[1]} AS y, round(CAST(embedding[3] AS DOUBLE) * 9) * {_GRID[2]} AS z, CASE WHEN vec_id % 3 = 0 THEN -1.0 ELSE 1.0 END AS t FROM embeddings),
m AS (SELECT node, conn_idx, kind, sub, pol, greatest(coalesce(length, 0), 4) AS r, x, y, z, list_transform(frame, lambda v, i: CASE WHEN i > 4 THEN t * v ELSE v END) AS frame FROM n JOIN connectors USING (part_id)),
c AS (SELECT *, x + frame[4] AS px, y + frame[8] AS py, z + frame[12] AS pz FROM m),
j AS (SELECT a.node AS a, a.conn_idx AS a_conn, b.node AS b, b.conn_idx AS b_conn, a.kind, a.sub AS a_sub, pow(a.px - b.px, 2) + pow(a.py - b.py, 2) + pow(a.pz - b.pz, 2) AS d2, {_DOT(1, 1)} AS along, {_DOT(2, 0)} AS zx, {_DOT(0, 0)} AS xx, {_DOT(0, 0)} + {_DOT(1, 1)} + {_DOT(2, 2)} AS trace,
  -((b.px - a.px) * b.frame[2] + (b.py - a.py) * b.frame[6] + (b.pz - a.pz) * b.frame[10]) AS proj, -((b.px - a.px) * a.frame[2] + (b.py - a.py) * a.frame[6] + (b.pz - a.pz) * a.frame[10]) AS slide, a.r + b.r AS rr, CASE a.kind WHEN 'stud' THEN 'stud' ELSE a.kind END AS family
  FROM c a JOIN c b ON a.node <> b.node AND abs(a.px - b.px) <= 3 + a.r + b.r AND abs(a.py - b.py) <= 3 + a.r + b.r AND abs(a.pz - b.pz) <= 3 + a.r + b.r
  WHERE a.kind = 'stud' AND b.kind = 'hole' AND {_MATES(S.STUD_MATES)} OR a.kind = b.kind AND a.kind IN ('hinge', 'ball', 'fixed') AND a.sub = b.sub AND a.pol = 'in' AND b.pol = 'on' OR a.kind = 'axle' AND b.kind = 'axle' AND {_MATES(S.AXLE_MATES)} AND a.sub IN ('socket', 'cross', 'clip') AND b.sub NOT IN ('socket', 'cross', 'clip')),
e AS (SELECT * FROM j WHERE CASE family WHEN 'axle' THEN abs(along) >= 0.9 AND d2 - proj * proj <= 9 AND (rr - abs(proj) >= 4 OR sqrt(greatest(0, 9 - greatest(d2 - proj * proj, 0))) >= 4 - (rr - abs(proj)) - 1e-4)
  WHEN 'stud' THEN d2 <= 9 AND along >= 0.95 WHEN 'hinge' THEN d2 <= 9 AND abs(along) >= 0.95 WHEN 'ball' THEN d2 <= 9 ELSE d2 <= 9 AND (a_sub NOT IN ('0', '1', '2', '3') OR along >= 0.9999 AND trace >= 2.99) END)"""


def _placed_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of the catalogue, each placed at a point of a grid, every third upside down: the nodes of one graph."""
    parts = load(spark, d, "parts").agg(F.count("*").alias("n"))
    at = lambda k: F.round(F.get("embedding", F.lit(k)).cast("double") * 9) * _GRID[k]
    turn = F.when(F.col("vec_id") % 3 == 0, -1.0).otherwise(1.0)
    row = lambda k: [(turn if k else F.lit(1.0)) if i == k else F.lit(0.0) for i in range(3)] + [at(k)]
    xf = F.array(*row(0), *row(1), *row(2), *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])
    return load(spark, d, "embeddings").join(F.broadcast(parts)).select(F.lit(0).alias("graph_id"), F.col("vec_id").cast("int").alias("node"), (F.col("vec_id") % F.col("n")).cast("int").alias("part_id"), F.lit(0).alias("color"), xf.alias("xf"))


@query(f"WITH {_JOINTS} SELECT family, CAST(a AS INT) AS a, a_conn, CAST(b AS INT) AS b, b_conn, CASE WHEN family IN ('hinge', 'axle') THEN along < 0 ELSE FALSE END AS turned, CAST(CASE WHEN family = 'axle' THEN round(slide, 4) + 0.0 WHEN family IN ('stud', 'hinge') THEN round(cos(atan2(-(zx), xx)), 4) + 0.0 ELSE 0.0 END AS DOUBLE) AS measure FROM e")
def part_joints(spark: SparkSession, d: str) -> DataFrame:
    """All joints of parts placed on a grid, with their measures: the slide of axles, the cosine of the turn of studs and
    hinges (whose sign at a half turn is a matter of the last bit)."""
    e = assembly.graph_edges(_placed_parts(spark, d), load(spark, d, "connectors"))
    measure = F.when(F.col("family") == "axle", F.col("yaw")).when(F.col("family").isin("stud", "hinge"), F.cos("yaw")).otherwise(0.0)
    return e.select("family", "a", "a_conn", "b", "b_conn", F.col("flip").alias("turned"), _rounded(measure, 4).alias("measure"))


@query(f"WITH RECURSIVE {_JOINTS}, g AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT node, node AS low FROM n UNION SELECT g.b, w.low FROM w JOIN g ON g.a = w.node), l AS (SELECT node, min(low) AS low FROM w GROUP BY node), s AS (SELECT low, count(*) AS size FROM l GROUP BY low), o AS (SELECT low, size, row_number() OVER (ORDER BY size DESC, low) - 1 AS component_index FROM s) SELECT CAST(node AS INT) AS node, CAST(component_index AS INT) AS component_index, size FROM l JOIN o USING (low)")
def part_components(spark: SparkSession, d: str) -> DataFrame:
    """The components of the same graph, the largest first."""
    nodes = checkpointed(_placed_parts(spark, d))
    c = assembly.graph_components(nodes, checkpointed(assembly.graph_edges(nodes, load(spark, d, "connectors"))))
    return c.select("node", "component_index", F.col("size").cast("bigint").alias("size"))


@query()
def part_walks(spark: SparkSession, d: str) -> DataFrame:
    """Collision-free walks over the same graph, written as texts; boxes stand in for meshes."""
    parts, colors, connectors = _catalogue(spark, d)
    code = colors.agg(F.min("code").alias("c"))
    nodes = checkpointed(_placed_parts(spark, d).drop("color").join(F.broadcast(code)).select("graph_id", "node", "part_id", F.col("c").alias("color"), "xf"))
    edges = checkpointed(assembly.graph_edges(nodes, connectors))
    comps = checkpointed(assembly.graph_components(nodes, edges))
    seeds = comps.where("size >= 2").select("graph_id", "component_index").distinct().withColumn("seed", F.lit(0).cast("bigint"))
    walk = checkpointed(walks.sampled(edges, comps, nodes, connectors, box_meshes(connectors, 1.0), seeds))
    text = grammar.serialized(*walks.trees_of(walk, nodes, connectors), parts, colors)
    return text.select("key.component_index", "text")


# --- captions and evaluation -----------------------------------------------------------------------------------

_PROMPTS = "pr AS (SELECT CAST(row_number() OVER (ORDER BY line_no) - 1 AS BIGINT) AS prompt_index, id, caption FROM captions WHERE caption IS NOT NULL), pk AS (SELECT prompt_index, coalesce(id, 'prompt_' || lpad(CAST(prompt_index AS VARCHAR), CAST(greatest(4, length(CAST(prompt_index AS VARCHAR))) AS INT), '0')) AS prompt_key, regexp_replace(caption, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS caption FROM pr)"


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.prompts(load(spark, d, "captions"))


@query(f"WITH {_PROMPTS} SELECT * FROM pk")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    return _prompts(spark, d)


@query("SELECT line_no, 'Is this LEGO set ' || lower(regexp_replace(trim(regexp_replace(caption, '[\\s\\p{Z}]+', ' ', 'g')), '[.!?]+$', '')) || '?' AS question FROM captions")
def questions(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "captions").select("line_no", S.question(F.col("caption")).alias("question"))


@query(f"WITH {_PROMPTS} SELECT pk.*, CAST(s AS INT) AS sample FROM pk, generate_series(0, 2) g(s)")
def worklist(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.worklist(_prompts(spark, d), 3)


_VIEWS = f"{_PROMPTS}, m AS (SELECT DISTINCT source || '.tar' AS archive, id, sample, id || '/' || id || '_' || CAST(sample AS VARCHAR) || '.png' AS name FROM scored WHERE id IS NOT NULL AND source IS NOT NULL AND sample IS NOT NULL), k AS (SELECT prompt_key, max(prompt_index) AS prompt_index FROM pk GROUP BY 1), v AS (SELECT prompt_index, archive, array_to_string(list(name ORDER BY sample, name), ',') AS views FROM m JOIN k ON m.id = k.prompt_key GROUP BY 1, 2), w AS (SELECT prompt_index, max(archive) AS archive FROM v GROUP BY 1)"


def _views(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "scored").where("id is not null and source is not null and sample is not null").select(F.concat("source", F.lit(".tar")).alias("archive"), F.concat("id", F.lit("/"), "id", F.lit("_"), F.col("sample").cast("string"), F.lit(".png")).alias("name")).distinct()
    return evaluation.views(s, _prompts(spark, d))


@query(f"WITH {_VIEWS} SELECT w.prompt_index, w.archive, v.views FROM w JOIN v USING (prompt_index, archive)")
def render_views(spark: SparkSession, d: str) -> DataFrame:
    """Render views by prompt, the archives' members named after runs, models and samples."""
    return _views(spark, d).select("prompt_index", "archive", F.array_join("views", ",").alias("views"))


@query(f"WITH {_VIEWS} SELECT * FROM pk WHERE prompt_index NOT IN (SELECT prompt_index FROM w)")
def missing_views(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.missing(_prompts(spark, d), _views(spark, d))


_COSINES = "c AS (SELECT e.label, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q)"


def _cosines(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    first = e.agg(F.min_by("embedding", "vec_id").alias("q"))
    return evaluation.pooled(e.join(F.broadcast(first)).select("label", S.cosine(F.col("embedding"), F.col("q")).alias("s")), ["label"], "s")


@query(f"WITH {_COSINES} SELECT label, round(max(s), 9) AS max_score, round(avg(s), 9) AS mean_score FROM c GROUP BY label")
def pooled_scores(spark: SparkSession, d: str) -> DataFrame:
    """Best and mean similarity of each label's vectors to the first vector."""
    return _cosines(spark, d).select("label", F.round("max_score", 9).alias("max_score"), F.round("mean_score", 9).alias("mean_score"))


@query(f"WITH {_COSINES}, m AS (SELECT label, max(s) AS b FROM c GROUP BY label) SELECT count(*) AS n_prompts, round(avg(b), 9) AS score FROM m")
def pooled_metric(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.metric(_cosines(spark, d)).select("n_prompts", F.round("score", 9).alias("score"))


# --- whole tables ----------------------------------------------------------------------------------------------


@query("SELECT path, min(path_id) AS path_id, count(*) AS n FROM paths WHERE path IS NOT NULL GROUP BY path")
def distinct_paths(spark: SparkSession, d: str) -> DataFrame:
    return pools.without_repeats([load(spark, d, "paths")], "path_id", "path").select(F.col("text").alias("path"), F.col("key").alias("path_id"), "n")


@query("SELECT source, component_index, count(*) AS n_rows, count(*) FILTER (complete_component) AS n_complete, bool_and(nodes <= component_nodes) AS within FROM paths WHERE component_nodes >= 2 GROUP BY ALL")
def walked_components(spark: SparkSession, d: str) -> DataFrame:
    """Of components of at least two parts, how many walks are complete."""
    x = load(spark, d, "paths").where("component_nodes >= 2")
    return x.groupBy("source", "component_index").agg(F.count("*").alias("n_rows"), F.count_if("complete_component").alias("n_complete"), F.bool_and(F.col("nodes") <= F.col("component_nodes")).alias("within"))


def _captions_paths(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    paths = load(spark, d, "paths").where("source is not null").select(F.col("path_id").alias("key"), F.regexp_replace("source", r"\.npz\z", "").alias("id"), "path")
    return load(spark, d, "captions").select(F.col("line_no").alias("key"), "id", "caption"), paths


@query("SELECT c.id, count(DISTINCT c.line_no) AS n_captions, count(DISTINCT p.path_id) AS n_paths FROM captions c JOIN paths p ON c.id = regexp_replace(p.source, '\\.npz$', '') GROUP BY c.id")
def captioned_models(spark: SparkSession, d: str) -> DataFrame:
    """Captions and paths by model, as their names are written; each side is counted before the join."""
    return pools.counted_pairs(*_captions_paths(spark, d))


_BARE = "regexp_replace(source, '\\.npz$', '')"


@query(f"WITH c AS (SELECT line_no, id, caption, row_number() OVER (PARTITION BY id ORDER BY line_no) - 1 AS k FROM captions WHERE id IS NOT NULL AND caption IS NOT NULL), q AS (SELECT {_BARE} AS id, path_id, path, row_number() OVER (PARTITION BY {_BARE} ORDER BY path_id) - 1 AS r FROM paths WHERE source IS NOT NULL AND path IS NOT NULL), n AS (SELECT id, least(count(*), 5) AS n FROM q GROUP BY id) SELECT line_no AS caption_key, path_id AS path_key, c.id, caption || chr(10) || path AS text, CAST(octet_length(encode(caption)) + 1 AS INT) AS masked FROM c JOIN n ON c.id = n.id JOIN q ON q.id = c.id AND q.r = c.k % n")
def training_pairs(spark: SparkSession, d: str) -> DataFrame:
    """One path for each caption, to be trained on behind it."""
    return pools.paired(*_captions_paths(spark, d))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "events").select("event_type", F.from_json("props", "k bigint").alias("j"))
    return x.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("j.k").alias("total"))


@query("SELECT CAST(path_id % 8 AS INT) AS stripe, count(*) AS n, min(path_id) AS low, max(path_id // 8) AS last, count(*) AS restored FROM paths GROUP BY 1")
def stripes(spark: SparkSession, d: str) -> DataFrame:
    """Paths dealt out to eight stripes, and how many get their number back from stripe and place."""
    at, place = pools.stripe(F.col("path_id"), 8)
    x = load(spark, d, "paths").select("path_id", at.alias("stripe"), place.alias("place"))
    return x.groupBy("stripe").agg(F.count("*").alias("n"), F.min("path_id").alias("low"), F.max("place").alias("last"), F.count_if(pools.unstriped(F.col("stripe"), F.col("place"), 8) == F.col("path_id")).alias("restored"))


# --- geometry of paths -----------------------------------------------------------------------------------------


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return walks.poses(*_trees(spark, d), load(spark, d, "connectors"))


@query()
def path_poses(spark: SparkSession, d: str) -> DataFrame:
    """Where each part of each path lies."""
    return _placed(spark, d).select(F.col("key").alias("path_id"), "pos", "part_id", "color", *[_rounded(F.get("xf", F.lit(4 * i + 3)), 4).alias("xyz"[i]) for i in range(3)])


@query()
def path_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges of the graphs that paths are, with continuous parameters."""
    _, e = walks.graphs_of(*_trees(spark, d), load(spark, d, "connectors"))
    return e.select(F.col("graph_id").alias("path_id"), "family", "a", "a_conn", "b", "b_conn", _rounded(F.col("yaw"), 9).alias("yaw"), "flip", *[_rounded(F.get("rot", F.lit(k)), 9).alias(f"r{'xyz'[k]}") for k in range(3)])


@query()
def text_errors(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with each generated text, in words."""
    return grammar.errors(load(spark, d, "scored"), "row_id", "text", *_catalogue(spark, d)).withColumnRenamed("key", "row_id")


@query()
def path_joints(spark: SparkSession, d: str) -> DataFrame:
    """All joints between the placed parts of each path, found from their connectors, as whole-number parameters."""
    return whole_texts.text_joints(load(spark, d, "paths"), "path_id", "path", *_catalogue(spark, d)).withColumnRenamed("key", "path_id")


def box_meshes(connectors: DataFrame, margin: float = 4.0) -> DataFrame:
    """A box of triangles for each part, around its connectors: a stand-in where no meshes are at hand."""
    at = lambda k: F.get("frame", F.lit(4 * k + 3))
    x = connectors.groupBy("part_id").agg(*[f(at(k)).alias(f"{n}{k}") for k in range(3) for f, n in ((F.min, "l"), (F.max, "h"))])
    lo, hi = F.array(*[F.col(f"l{k}") - margin for k in range(3)]), F.array(*[F.col(f"h{k}") + margin for k in range(3)])
    corner = [F.array(*[F.get("local_hi" if c >> k & 1 else "local_lo", F.lit(k)) for k in range(3)]) for c in range(8)]
    faces = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]
    x = x.select("part_id", lo.alias("local_lo"), hi.alias("local_hi"))
    return x.select("part_id", F.array(*corner).alias("vertices"), F.array(*[F.array(*[F.lit(v) for v in f]) for f in faces]).alias("faces"), "local_lo", "local_hi")


@query()
def path_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Which placements of each path hit an earlier part, with boxes for meshes."""
    parts, colors, connectors = _catalogue(spark, d)
    x = whole_texts.text_collisions(load(spark, d, "paths"), "path_id", "path", parts, colors, connectors, box_meshes(connectors))
    return x.select(F.col("key").alias("path_id"), F.array_join(F.transform("collisions", lambda v: v.cast("string")), ",").alias("collisions"), "first")


def _walked(spark: SparkSession, d: str, method: str) -> DataFrame:
    seed = 0 if method == "random" else None
    return whole_texts.text_walks(load(spark, d, "paths"), "path_id", "path", *_catalogue(spark, d), method, seed).withColumnRenamed("key", "path_id")


@query()
def rewalked_breadth_first(spark: SparkSession, d: str) -> DataFrame:
    """Each path's model walked again from its joints, breadth first, and written."""
    return _walked(spark, d, "bfs")


@query()
def rewalked_at_random(spark: SparkSession, d: str) -> DataFrame:
    return _walked(spark, d, "random")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
