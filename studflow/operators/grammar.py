"""Path text as relations: parsed, checked, scored and written again without any per-row Python.

A text is a root node line, then pairs of a node line and the edge line that attaches it. Whether a pair is right
depends on nodes before it only, so all lines are checked at once and the text is cut at its first wrong pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import ARITY, AXLE_MATES, STUD_MATES, canonical_int, degree, flip, i2id, id2i, lookup, n_actions
from .catalog import color_names, connector_counts


def _node_name(line: Column) -> Column:
    """The part's name on a node line: behind the first blank, before the first bar."""
    return F.regexp_extract(F.substring_index(line, " | ", 1), r"^[^ ]* ([\s\S]*)\z", 1)


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_actions, n_lines, line_no, line, parent_name, child_name; a missing last line end is added.

    parent_name and child_name are the parts' names that an edge line joins, null for others; they are looked up while
    the lines of a text are together, so that no line carries the names of all. Null texts and keys give no rows. Rows
    of a repeated key with different texts would mix: keys must be unique.
    """
    t = F.when(F.endswith(F.col(text), F.lit("\n")), F.col(text)).otherwise(F.concat(F.col(text), F.lit("\n")))
    x = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), n_actions(F.col(text)).alias("n_actions"), F.split(t, "\n").alias("all"))
    x = x.select("key", "n_actions", F.expr("slice(all, 1, size(all) - 1)").alias("all"))
    parent = lambda line: id2i(F.substring_index(line, " ", 1)).cast("int")
    # the node line of part n is line 0 or 2n - 1
    node = lambda n: F.get("all", F.when(n > 0, 2 * n - 1).otherwise(n))
    entry = lambda line, i: F.struct(
        line.alias("line"),
        F.when((i > 0) & (i % 2 == 0), _node_name(node(parent(line)))).alias("parent_name"),
        F.when((i > 0) & (i % 2 == 0), _node_name(F.get("all", i - 1))).alias("child_name"),
    )
    x = x.select("key", "n_actions", F.size("all").alias("n_lines"), F.posexplode(F.transform("all", entry)).alias("line_no", "e"))
    return x.select("key", "n_actions", "n_lines", "line_no", "e.line", "e.parent_name", "e.child_name")


def parsed_lines(df: DataFrame, key: str, text: str, parts: DataFrame, colors: DataFrame, connectors: DataFrame) -> DataFrame:
    """Each line with its pair, its parsed fields, and whether it's right (ok). The catalogue tables are small (a row a
    part, colour or kind of connector), so they're joined by broadcast if their size allows."""
    x = lines(df, key, text)
    node = (F.col("line_no") == 0) | ((F.col("line_no") % 2 == 1) & ((F.col("n_lines") % 2 == 1) | (F.col("line_no") < F.col("n_lines") - 1)))
    edge = (F.col("line_no") > 0) & (F.col("line_no") % 2 == 0)
    # an even number of lines leaves the last node without its edge: it isn't read
    x = x.withColumn("is_node", node).where(node | edge).withColumn("pair", F.floor((F.col("line_no") + 1) / 2).cast("int"))
    tok = F.split("line", " ")
    x = x.withColumn("t", F.when(~F.col("is_node"), tok))
    t = lambda i: F.get("t", F.lit(i))
    fam = t(1)
    named, sided = fam.isin("stud", "axle"), fam.isin("hinge", "ball", "fixed")
    pol = F.when(sided & t(3).isin("in", "on"), t(3))
    sub = F.when(sided, id2i(t(2)).cast("string"))
    parent = id2i(t(0))
    x = x.select(
        "key", "n_actions", "n_lines", "pair", "is_node", "line",
        F.when(F.col("is_node"), F.substring_index("line", " ", 1)).alias("label"),
        F.when(F.col("is_node") & (F.instr("line", " | ") > 0), F.regexp_extract(F.substring_index("line", " | ", 1), r"^[^ ]* ([\s\S]*)\z", 1)).alias("name"),
        F.when(F.col("is_node") & (F.instr("line", " | ") > 0), F.expr("substring(line, instr(line, ' | ') + 3)")).alias("color"),
        fam.alias("family"), F.size("t").alias("n_tokens"), parent.alias("parent"),
        F.when(named, t(2)).otherwise(sub).alias("parent_sub"), F.when(named, t(4)).otherwise(sub).alias("child_sub"),
        pol.alias("parent_pol"), F.when(pol == "in", "on").when(pol == "on", "in").alias("child_pol"),
        F.when(named, id2i(t(3))).otherwise(id2i(t(4))).alias("parent_conn"), id2i(t(5)).alias("child_conn"),
        F.when(fam == "stud", degree(t(6))).when(fam == "axle", degree(t(7))).when(fam == "hinge", degree(t(7))).alias("yaw"),
        F.when(fam.isin("axle", "hinge"), flip(t(6))).alias("flip"), F.when(fam == "axle", canonical_int(t(8))).alias("slide"),
        F.when(fam == "ball", degree(t(6))).alias("rx"), F.when(fam == "ball", degree(t(7))).alias("ry"), F.when(fam == "ball", degree(t(8))).alias("rz"),
        "parent_name", "child_name", "t",
    )
    p = parts.groupBy(F.col("name").alias("p_name")).agg(F.max("part_id").alias("part_id"))
    c = colors.groupBy(F.col("name").alias("c_name")).agg(F.max_by("code", "ord").alias("code"))
    n = connector_counts(connectors).join(parts.select("part_id", "name"), "part_id").select("name", "sub", "pol", "n", "part_id")
    x = x.join(p, F.col("name") == F.col("p_name"), "left").join(c, F.col("color") == F.col("c_name"), "left")
    for side in ("parent", "child"):
        m = n.select(F.col("name").alias("m_name"), F.col("sub").alias("m_sub"), F.col("pol").alias("m_pol"), F.col("n").alias(f"{side}_n"), F.col("part_id").alias(f"{side}_part"))
        x = x.join(m, (F.col(f"{side}_name") == F.col("m_name")) & (F.col(f"{side}_sub") == F.col("m_sub")) & (F.coalesce(f"{side}_pol", F.lit("")) == F.coalesce("m_pol", F.lit(""))), "left").drop("m_name", "m_sub", "m_pol")
    mates = lambda pairs: F.concat_ws("+", F.least("parent_sub", "child_sub"), F.greatest("parent_sub", "child_sub")).isin(*["+".join(q) for q in pairs])
    right_node = F.col("label").rlike(r"^[a-z]+\z") & F.col("part_id").isNotNull() & F.col("code").isNotNull()
    values = (
        F.when(F.col("family") == "stud", mates(STUD_MATES) & F.col("yaw").isNotNull())
        .when(F.col("family") == "axle", mates(AXLE_MATES) & F.col("flip").isNotNull() & F.col("yaw").isNotNull() & F.col("slide").isNotNull())
        .when(F.col("family") == "hinge", F.col("parent_pol").isNotNull() & F.col("flip").isNotNull() & F.col("yaw").isNotNull())
        .when(F.col("family") == "ball", F.col("parent_pol").isNotNull() & F.col("rx").isNotNull() & F.col("ry").isNotNull() & F.col("rz").isNotNull())
        .when(F.col("family") == "fixed", F.col("parent_pol").isNotNull())
    )
    right_edge = (F.col("n_tokens") == lookup(ARITY, F.col("family"))) & (F.col("parent") < F.col("pair")) & (F.col("parent_conn") < F.col("parent_n")) & (F.col("child_conn") < F.col("child_n")) & values
    return x.withColumn("ok", F.coalesce(F.when(F.col("is_node"), right_node).otherwise(right_edge), F.lit(False)))


def scores(df: DataFrame, key: str, text: str, parts: DataFrame, colors: DataFrame, connectors: DataFrame) -> DataFrame:
    """key, n_actions, invalid: the number of actions, and of those before the first wrong one (null if none is).

    An empty text is one empty, wrong line: one action, invalid 0. Null texts give no row.
    """
    x = parsed_lines(df, key, text, parts, colors, connectors)
    bad = x.groupBy("key").agg(F.first("n_actions").alias("n_actions"), F.first("n_lines").alias("n_lines"), F.min(F.when(~F.col("ok"), F.col("pair"))).alias("bad"))
    dangling = F.when(F.col("n_lines") % 2 == 0, (F.col("n_lines") / 2).cast("int"))
    return bad.select("key", "n_actions", F.least("bad", dangling).cast("int").alias("invalid"))


def _said(text: Column) -> Column:
    """A piece of a text in quotes, as messages show it."""
    t = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    return F.when(F.contains(t, F.lit("'")) & ~F.contains(t, F.lit('"')), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(t, F.lit("'"), F.lit("\\'")), F.lit("'")))


def _node_reason() -> Column:
    return (
        F.when(F.instr("line", " | ") == 0, F.concat(F.lit("node line missing ' | ': "), _said(F.col("line"))))
        .when(F.col("name") == "", F.concat(F.lit("bad node: "), _said(F.col("line"))))
        .when(~F.col("label").rlike(r"^[a-z]+\z"), F.concat(F.lit("invalid letter ID: "), _said(F.col("label"))))
        .when(F.col("part_id").isNull(), F.concat(F.lit("unknown part: "), _said(F.col("name"))))
        .when(F.col("code").isNull(), F.concat(F.lit("unknown color: "), _said(F.col("color"))))
    )


#: What the words behind the connectors are, by family: degrees, a flip, an integer.
_TAILS = {"stud": "d", "axle": "fdi", "hinge": "fd", "ball": "ddd", "fixed": ""}


def _letters_reason(word: Column) -> Column:
    return F.when(~word.rlike(r"^[a-z]+\z"), F.concat(F.lit("invalid letter ID: "), _said(word)))


def _word_reason(kind: Column, word: Column) -> Column:
    label = F.when(kind == "d", "degree").otherwise("slide")
    number = F.when(~word.rlike(r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*\z"), F.concat(label, F.lit(" is not an integer: "), _said(word)))
    number = F.coalesce(number, F.when(~word.rlike(r"^(0|-?[1-9][0-9]*)\z"), F.concat(label, F.lit(" has non-canonical form: "), _said(word))))
    number = F.coalesce(number, F.when((kind == "d") & degree(word).isNull(), F.concat(F.lit("degree "), word, F.lit(" not in [0, 360)"))))
    return F.when(kind == "f", F.when(flip(word).isNull(), F.concat(F.lit("expected regular/flip, got "), _said(word)))).otherwise(number)


def _connector_reason(c: Column) -> Column:
    name = F.concat(c["sub"], F.lit("/"), F.coalesce(c["pol"], F.lit("None")))
    none = F.when(c["n"].isNull(), F.concat(F.lit("part "), c["part"].cast("string"), F.lit(" has no "), name, F.lit(" connectors")))
    far = F.concat(name, F.lit("["), c["at"].cast("string"), F.lit("] out of range for part "), c["part"].cast("string"), F.lit(" (has "), c["n"].cast("string"), F.lit(")"))
    return F.coalesce(none, _letters_reason(c["word"]), F.when(F.coalesce(c["at"] >= c["n"], F.lit(True)), far))


def _edge_reason() -> Column:
    """What is wrong first on an edge line, in the order in which its words are read. Words are gone through by
    transform, so that the expression stays small."""
    t = lambda i: F.get("t", F.lit(i))
    fam = F.col("family")
    named, want = fam.isin("stud", "axle"), lookup(ARITY, fam)
    first = lambda reasons: F.get(F.array_compact(reasons), F.lit(0))
    side = lambda s, word: F.struct(F.col(f"{s}_sub").alias("sub"), F.col(f"{s}_pol").alias("pol"), F.col(f"{s}_id").alias("part"), F.col(f"{s}_n").alias("n"), F.col(f"{s}_conn").alias("at"), word.alias("word"))
    joined = first(F.transform(F.array(side("parent", F.when(named, t(3)).otherwise(t(4))), side("child", t(5))), _connector_reason))
    pair = F.concat_ws("+", F.least(t(2), t(4)), F.greatest(t(2), t(4)))
    mates = pair.isin(*["+".join(q) for q in STUD_MATES]) & (fam == "stud") | pair.isin(*["+".join(q) for q in AXLE_MATES]) & (fam == "axle")
    tail = lookup(_TAILS, fam)
    words = F.when(F.length(tail) > 0, F.transform(F.sequence(F.lit(0), F.length(tail) - 1), lambda i: _word_reason(F.substring(tail, i + 1, F.lit(1)), F.get("t", i + 6))))
    return F.coalesce(
        F.when(F.size("t") < 2, F.concat(F.lit("bad edge: "), _said(F.col("line")))),
        F.when(want.isNull(), F.concat(F.lit("unknown edge family: "), _said(fam))),
        F.when(F.size("t") != want, F.concat(fam, F.lit(" edge expected "), want.cast("string"), F.lit(" tokens, got "), F.size("t").cast("string"))),
        first(F.transform(F.array(t(0)), _letters_reason)),
        F.when(F.coalesce(F.col("parent") >= F.col("pair"), F.lit(True)), F.concat(F.lit("bad parent ref: "), _said(t(0)))),
        F.when(~named, first(F.transform(F.array(t(2)), _letters_reason))),
        F.when(~named & ~t(3).isin("in", "on"), F.concat(F.lit("bad polarity: "), _said(t(3)))),
        joined,
        F.when(named & ~mates, F.concat(F.lit("cannot mate subtypes "), t(2), F.lit("+"), t(4))),
        first(words),
    )


def errors(df: DataFrame, key: str, text: str, parts: DataFrame, colors: DataFrame, connectors: DataFrame) -> DataFrame:
    """key, n_parsed, error: the actions before the first wrong one, and what is wrong with it; error is null for a right
    text.

    Words are read from the left, a pair's node before its edge. A text that is right but lacks its last line end has
    that error; an empty text has no line at all and is `empty`. Null texts give no row.
    """
    x = parsed_lines(df, key, text, parts, colors, connectors)
    p = parts.groupBy(F.col("name").alias("n")).agg(F.max("part_id").alias("id"))
    for side in ("parent", "child"):
        x = x.join(p.select(F.col("n").alias(f"{side}_name"), F.col("id").alias(f"{side}_id")), f"{side}_name", "left")
    reason = F.when(F.col("is_node"), _node_reason()).otherwise(_edge_reason())
    x = x.withColumn("bad", F.when(~F.col("ok"), F.struct("pair", (~F.col("is_node")).alias("edge"), F.coalesce(reason, F.lit("wrong line")).alias("reason"))))
    got = x.groupBy("key").agg(F.first("n_lines").alias("n_lines"), F.min("bad").alias("bad"))
    own = df.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    last = F.substring_index(F.regexp_replace(F.col(text), r"\n\z", ""), "\n", -1)
    own = own.select(F.col(key).alias("k"), last.alias("last"), F.endswith(F.col(text), F.lit("\n")).alias("ended"), (F.col(text) == "").alias("empty"))
    x = got.join(own, F.col("key") == F.col("k"))
    dangling = F.when(F.col("n_lines") % 2 == 0, F.floor(F.col("n_lines") / 2).cast("int"))
    first = F.least(F.col("bad.pair"), dangling)
    error = (
        F.when(F.col("empty"), "empty")
        .when(F.col("bad.pair").isNotNull() & (F.col("bad.pair") == first), F.col("bad.reason"))
        .when(dangling.isNotNull(), F.concat(F.lit("dangling node without edge: "), _said(F.col("last"))))
        .when(~F.col("ended"), "missing trailing newline")
    )
    n = F.when(F.col("empty"), 0).otherwise(F.coalesce(first, F.floor((F.col("n_lines") + 1) / 2).cast("int")))
    return x.select("key", n.cast("int").alias("n_parsed"), error.alias("error"))


def trees(df: DataFrame, key: str, text: str, parts: DataFrame, colors: DataFrame, connectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of each text up to its first wrong pair.

    nodes: key, pos, part_id, color (its code); edges: key, pos (of the child), parent, the parts of both, family, the
    subtypes, polarities and connectors of both sides, and the family's parameters (others null).
    """
    x = parsed_lines(df, key, text, parts, colors, connectors)
    kept = x.withColumn("bad", F.min(F.when(~F.col("ok"), F.col("pair"))).over(W.partitionBy("key"))).where(F.col("bad").isNull() | (F.col("pair") < F.col("bad")))
    nodes = kept.where("is_node").select("key", F.col("pair").alias("pos"), "part_id", F.col("code").alias("color"))
    edges = kept.where("not is_node").select("key", F.col("pair").alias("pos"), F.col("parent").cast("int").alias("parent"), "parent_part", "child_part", "family", "parent_sub", "child_sub", "parent_pol", "child_pol", F.col("parent_conn").cast("int").alias("parent_conn"), F.col("child_conn").cast("int").alias("child_conn"), "flip", "yaw", "slide", "rx", "ry", "rz")
    return nodes, edges


def serialized(nodes: DataFrame, edges: DataFrame, parts: DataFrame, colors: DataFrame) -> DataFrame:
    """key, text: the path text of each tree; a colour code has its last name in file order. A part or colour that the
    catalogue lacks makes its tree's text null."""
    p = parts.select("part_id", F.col("name").alias("part_name"))
    c = color_names(colors).select(F.col("code").alias("color"), F.col("name").alias("color_name"))
    n = nodes.join(p, "part_id", "left").join(c, "color", "left")
    first = F.concat(i2id(F.col("pos"), 4), F.lit(" "), F.col("part_name"), F.lit(" | "), F.col("color_name"))
    n = n.select("key", (F.col("pos") * 2).alias("at"), first.alias("line"))
    e = edges
    # written once for each edge, before the families' lines are put together; four letters are 475,254 parts
    e = e.select("*", i2id(e.parent_conn, 4).alias("pc"), i2id(e.child_conn, 4).alias("cc"), i2id(e.parent, 4).alias("up"), i2id(e.parent_sub.try_cast("bigint"), 2).alias("letter"))
    pc, cc, up, letter = e.pc, e.cc, e.up, e.letter
    turned = F.when(e.flip, "flip").otherwise("regular")
    sp = F.lit(" ")
    j = lambda *xs: F.concat(*[y for x in xs for y in (x.cast("string"), sp)][:-1])
    line = (
        F.when(e.family == "stud", j(up, e.family, e.parent_sub, pc, e.child_sub, cc, e.yaw))
        .when(e.family == "axle", j(up, e.family, e.parent_sub, pc, e.child_sub, cc, turned, e.yaw, e.slide))
        .when(e.family == "hinge", j(up, e.family, letter, e.parent_pol, pc, cc, turned, e.yaw))
        .when(e.family == "ball", j(up, e.family, letter, e.parent_pol, pc, cc, e.rx, e.ry, e.rz))
        .when(e.family == "fixed", j(up, e.family, letter, e.parent_pol, pc, cc))
    )
    both = n.unionByName(e.select("key", (F.col("pos") * 2 + 1).alias("at"), line.alias("line")))
    got = both.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("all"))
    whole = ~F.exists("all", lambda x: x["line"].isNull())
    return got.select("key", F.when(whole, F.concat(F.array_join(F.transform("all", lambda x: x["line"]), "\n"), F.lit("\n"))).alias("text"))


def summary(scored: DataFrame) -> DataFrame:
    """One row: n, parsable, and, only if every row has its collisions, clean and mean_first_failure.

    An empty table gives n 0 and nulls.
    """
    first = F.array_min(F.concat(F.array(F.when(F.col("invalid").isNull(), F.col("n_actions")).otherwise(F.col("invalid"))), F.col("collisions")))
    x = scored.agg(
        F.count("*").alias("n"), F.count_if(F.col("invalid").isNull()).alias("parsable"), F.bool_and(F.col("collisions").isNotNull()).alias("all_"),
        F.count_if(F.col("invalid").isNull() & (F.size("collisions") == 0)).alias("clean_"), F.avg(first).alias("mean_"),
    )
    return x.select("n", "parsable", F.when(F.col("all_"), F.col("clean_")).alias("clean"), F.when(F.col("all_"), F.col("mean_")).alias("mean_first_failure"))
