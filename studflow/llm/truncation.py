"""Problem 1: texts that were cut off by a field limit or in transfer.

Each source's lengths are taken as log-normal and right-censored at its limits: lengths that more texts without a line
end share than the fit can explain. All limits of a source are fitted together by maximum likelihood; the fit tells how
many whole texts a limit's length would have, and so the posterior that a text of that length was censored. These are
the prior odds of a row (elsewhere those of a stray cut, by source). They are multiplied by the evidence of the ending:
how often cut and whole texts end inside a word or line, in a mark for lost text, in a faulty line, in a whole line with
or without its line end, and whether a last number or colour is more often the beginning of a longer one. The rates are
estimated from the rows themselves.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import checkpointed, spread

#: The words of an edge line by family, in order, after the parent's letters (fixed values of the grammar).
CONN, SUB, NUM, FLIP, POL = r"[a-z]+", r"[a-z]+", r"-?[0-9]+", r"(?:regular|flip)", r"(?:in|on)"
EDGES = {
    "stud": (SUB, CONN, SUB, CONN, NUM),
    "axle": (SUB, CONN, SUB, CONN, FLIP, NUM, NUM),
    "hinge": (SUB, POL, CONN, CONN, FLIP, NUM),
    "ball": (SUB, POL, CONN, CONN, NUM, NUM, NUM),
    "fixed": (SUB, POL, CONN, CONN),
}
#: What is put in place of a lost rest: an ellipsis, the replacement character, or words in brackets.
MARK = re.compile(r"\s*(?:…|\.{2,}|�+|[\[<({][^\[\]<>(){}|]{2,40}[\]>)}]|--+ ?[a-z ]{2,30} ?--+)\s*$", re.I)
WHOLE_END, WHOLE_BARE, PARTIAL, PARTIAL_END, MARKED, FAULT, FAULT_BARE = range(7)
#: A length is a candidate limit if so many texts without a line end, by chance, would be rarer than this in any source.
CHANCE = 1e-3
#: What is added to counts of endings that no whole text has by the problem's statement, and to those of others.
NEVER, SEEN = 1e-4, 0.5


def _words(part: str) -> list[str]:
    return part.split(" ")


class Grammar:
    """Whether a last line is whole, the beginning of a whole line, or neither (faulty)."""

    def __init__(self, parts: set[str], colors: set[str]):
        self.parts, self.colors = parts, colors
        self.part_order, self.color_order = sorted(parts), sorted(colors)
        self.longer = {c: [x for x in colors if x != c and x.startswith(c)] for c in colors}
        self.edge = {f: re.compile("[a-z]+ " + " ".join((f, *w))) for f, w in EDGES.items()}

    @staticmethod
    def begins(prefix: str, order: list[str]) -> bool:
        """Whether some name in order begins with prefix and goes on."""
        at = bisect.bisect_right(order, prefix)
        return at < len(order) and order[at].startswith(prefix)

    def _edge_begins(self, words: list[str]) -> bool:
        """All words but the last are right, and the last is the beginning of a right one."""
        family, rest = words[1], words[2:]
        if family not in EDGES:
            return not rest and any(f.startswith(family) for f in EDGES)
        want = EDGES[family]
        if len(rest) > len(want):
            return False
        for k, (w, p) in enumerate(zip(rest, want)):
            if k < len(rest) - 1:
                if not re.fullmatch(p, w):
                    return False
            elif w and not re.fullmatch(p, w):
                choices = {FLIP: ("regular", "flip"), POL: ("in", "on")}.get(p)
                if not (any(c.startswith(w) for c in choices) if choices else p == NUM and w == "-"):
                    return False
        return True

    def line(self, line: str) -> str:
        """whole, begins or fault."""
        words = _words(line)
        if not line or not re.fullmatch("[a-z]+", words[0]):
            return "fault"
        if len(words) == 1:
            return "begins"
        rest = line[len(words[0]) + 1 :]
        if words[1] in EDGES or " | " not in rest and any(f.startswith(words[1]) for f in EDGES):
            if words[1] in EDGES and self.edge[words[1]].fullmatch(line):
                return "whole"
            return "begins" if self._edge_begins(words) else "fault"
        name, bar, color = rest.partition(" |")
        if not bar:
            return "begins" if self.begins(name, self.part_order) or name.rstrip(" ") in self.parts else "fault"
        if color in ("", " "):
            return "begins"
        color = color[1:]
        if color in self.colors:
            return "whole"
        return "begins" if self.begins(color, self.color_order) or color.rstrip(" ") in self.colors and color.endswith(" ") else "fault"

    def judge(self, text: str) -> tuple[int, int, str | None, int, int]:
        """Ending class, actions held, last number, and how often the text has the last colour and longer ones."""
        held = (text.count("\n") + (not text.endswith("\n")) + 2) // 2
        body = text.rstrip("\r\n")
        ended = body != text
        mark = MARK.search(body)
        if mark and (mark.start() >= body.rfind("\n") or mark[0].strip() == body[body.rfind("\n") + 1 :].strip()):
            return MARKED, held, None, 0, 0
        last = body[body.rfind("\n") + 1 :].rstrip("\r")
        kind = self.line(last)
        if kind == "begins":
            name = last.partition(" ")[2]
            # with its line end, a whole name without a colour is a fault of grammar
            return (PARTIAL if not ended else FAULT if name in self.parts else PARTIAL_END), held, None, 0, 0
        if kind == "fault":
            return (FAULT if ended else FAULT_BARE), held, None, 0, 0
        number, same, longer = None, 0, 0
        if not ended:
            color = last.partition(" | ")[2]
            if color:
                have = Counter(x.partition(" | ")[2] for x in body.split("\n")[:-1] if " | " in x)
                same, longer = have[color], sum(have[x] for x in self.longer.get(color, ()))
        if re.search(r" -?[0-9]+$", last):
            number = ("s" if " axle " in last else "y") + last.rpartition(" ")[2]  # a slide or an angle
        return (WHOLE_END if ended else WHOLE_BARE), held, number, same, longer


def features(scored: DataFrame, parts: DataFrame, colors: DataFrame) -> DataFrame:
    """row_id, source, n_actions, length, ending, held, number, same, longer of each row with a text."""
    # names of the catalogue: as many as there are parts and colours, not texts
    names = {r[0] for r in parts.select("name").distinct().toLocalIterator() if r[0]}, {r[0] for r in colors.select("name").distinct().toLocalIterator() if r[0]}
    vocabulary = scored.sparkSession.sparkContext.broadcast(names)
    rows = scored.where(F.col("text").isNotNull()).select("row_id", "source", F.col("n_actions").cast("bigint").alias("n_actions"), F.length("text").cast("bigint").alias("length"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(*vocabulary.value)
        for b in batches:
            got = list(zip(*map(g.judge, b.column(4).to_pylist()))) or [()] * 5
            kinds = (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(k) for k in range(4)] + [pa.array(x, k) for x, k in zip(got, kinds)], names=["row_id", "source", "n_actions", "length", "ending", "held", "number", "same", "longer"])

    return spread(rows).mapInArrow(run, f"row_id {rows.schema['row_id'].dataType.simpleString()}, source string, n_actions bigint, length bigint, ending int, held bigint, number string, same bigint, longer bigint")


def fit_censored(z: np.ndarray, n: np.ndarray, censored: np.ndarray) -> tuple[float, float]:
    """Mean and deviation of normal z (with counts n), the censored ones known only to be larger, by EM."""
    mu, sd = float(np.average(z, weights=n)), float(np.sqrt(np.average((z - np.average(z, weights=n)) ** 2, weights=n))) or 0.1
    for _ in range(200):
        a = (z - mu) / sd
        phi = np.exp(-0.5 * np.minimum(a * a, 700)) / math.sqrt(2 * math.pi)
        tail = np.maximum(0.5 * np.array([math.erfc(x / math.sqrt(2)) for x in a]), 1e-12)
        ratio = np.minimum(phi / tail, 50)
        e1 = np.where(censored, mu + sd * ratio, z)
        e2 = np.where(censored, mu * mu + sd * sd + sd * (z + mu) * ratio, z * z)
        new = float(np.average(e1, weights=n))
        new_sd = math.sqrt(max(float(np.average(e2, weights=n)) - new * new, 1e-6))
        done = abs(new - mu) + abs(new_sd - sd) < 1e-7
        mu, sd = new, new_sd
        if done:
            break
    return mu, sd


def chance(n: float, expected: float) -> float:
    """How likely a Poisson count of this mean is n or more, at most."""
    if n <= expected:
        return 1.0
    # Chernoff's bound
    return math.exp(min(0.0, n - expected - n * math.log(n / expected)))


def limits(rows: DataFrame) -> DataFrame:
    """source, cut_at, n_at, mu, sigma, posterior: the lengths at which a source's texts are censored.

    Worked out for each source from the counts of its lengths, of which there are at most as many as characters in its
    longest text. All limits of a source are fitted together.
    """
    is_ = lambda *kinds: F.sum(F.when(F.col("ending").isin(*kinds), 1).otherwise(0))
    counts = rows.where("length > 0").groupBy("source", "length").agg(F.count("*").alias("n"), is_(WHOLE_END).alias("ended"), is_(WHOLE_BARE).alias("bare"))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("length")
        x, n, ended, whole = (f[c].to_numpy().astype(float) for c in ("length", "n", "ended", "bare"))
        source = f["source"].iloc[0]
        z, open_ = np.log(x), n - ended  # texts with their line end aren't cut by a limit
        # the mean count of a length nearby (15 percent to either side), which the fit may be wrong about
        total = np.concatenate(([0.0], np.cumsum(open_)))
        lo, hi = np.searchsorted(x, 0.85 * x), np.searchsorted(x, 1.15 * x, side="right")
        near = (total[hi] - total[lo] - open_) / np.maximum(0.3 * x, 1)
        at, mu, sd, posterior = np.zeros(len(x), dtype=bool), 0.0, 1.0, np.zeros(len(x))
        seen = []
        while True:
            mu, sd = fit_censored(z, n, at)
            # the share of this source's whole texts that lack their line end
            lack = (whole[~at].sum() + SEEN) / ((whole + ended)[~at].sum() + 2 * SEEN)
            a = (z - mu) / sd
            # as many whole texts of this length without a line end as are to be expected
            expected = np.maximum(lack * n.sum() * np.exp(-0.5 * a * a) / (math.sqrt(2 * math.pi) * sd * x), 1e-9)
            posterior = 1 - np.minimum(1.0, expected / np.maximum(open_, 1e-9))
            by_chance = np.array([chance(k, max(e, m, 0.02)) for k, e, m in zip(open_, expected, near)])
            new = (by_chance < CHANCE / len(x)) & (posterior > 0.5)
            if any((new == s).all() for s in seen):
                break
            seen.append(new)
            at = new
        return pd.DataFrame([(source, int(x[c]), int(n[c]), mu, sd, float(posterior[c])) for c in np.flatnonzero(at)], columns=["source", "cut_at", "n_at", "mu", "sigma", "posterior"])

    return counts.groupBy("source").applyInPandas(one, "source string, cut_at bigint, n_at bigint, mu double, sigma double, posterior double")


def ending_odds(rows: DataFrame) -> dict[int, float]:
    """For each kind of ending how much likelier it is of a cut text than of a whole one.

    Texts at a limit count as cut by their posterior, others by the endings that only cut texts have.
    """
    never = F.col("ending").isin(PARTIAL, PARTIAL_END, MARKED)
    p = F.when(never, 1.0).otherwise(F.coalesce("posterior", F.lit(0.0)))
    got = {r["ending"]: r for r in rows.groupBy("ending").agg(F.sum(p).alias("cut"), F.sum(1 - p).alias("whole")).collect()}
    count = lambda e, c: (got[e][c] if e in got else 0.0) + (NEVER if c == "whole" and e in (PARTIAL, PARTIAL_END, MARKED) else SEEN)
    kinds = range(7)
    cut, whole = (sum(count(e, c) for e in kinds) for c in ("cut", "whole"))
    return {e: (count(e, "cut") / cut) / (count(e, "whole") / whole) for e in kinds}


def judged(scored: DataFrame, parts: DataFrame, colors: DataFrame) -> DataFrame:
    """row_id, source, length, ending, cut_at, probability, cut for each row with a text.

    A null text is no text that was cut; an empty one holds one action at most. A null source is a source of its own.
    Repeated rows are judged alike. The vocabulary tables are read whole; extra columns are ignored.
    """
    # a row's features are a few numbers; its text isn't kept
    rows = checkpointed(features(scored, parts, colors))
    at = limits(rows).select(F.col("source").alias("s"), "cut_at", "posterior")
    # a source has a few limits, so sources and limits are much fewer than rows
    rows = checkpointed(rows.join(at, rows["source"].eqNullSafe(at["s"]) & (rows["length"] == at["cut_at"]), "left").drop("s"))
    # how often last numbers are whole, and how often they begin longer ones: numbers of at most six characters
    number = rows.where((F.col("ending") == WHOLE_END) & F.col("number").isNotNull() & (F.length("number") <= 6)).groupBy("number").agg(F.count("*").alias("n"))
    begun = number.select(F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.length("number") - 1, F.lit(2))), lambda k: F.substring("number", F.lit(1), k))).alias("head"), "number", "n").where("head <> number").groupBy("head").agg(F.sum("n").alias("begins"))
    table = number.join(begun, number["number"] == begun["head"], "full").select(F.coalesce("number", "head").alias("number"), (F.coalesce("n", F.lit(0)) + 0.3).alias("whole"), F.coalesce("begins", F.lit(0)).cast("double").alias("begins"))
    # texts cut elsewhere than at a limit, by source: those that end in a way that only cut texts have
    free = F.col("cut_at").isNull()
    stray = rows.groupBy("source").agg(
        ((F.count_if(free & F.col("ending").isin(PARTIAL, PARTIAL_END, MARKED)) + SEEN) / (F.count_if(free) + 2 * SEEN)).alias("stray"),
        F.coalesce(F.avg(F.col("length") / F.greatest("held", F.lit(1))), F.lit(50.0)).alias("chars"),
    ).withColumnRenamed("source", "s")
    joined = rows.join(stray, rows["source"].eqNullSafe(stray["s"])).drop("s").join(table, "number", "left")
    prior = F.when(F.col("posterior").isNotNull(), F.least(F.col("posterior"), F.lit(1 - 1e-6))).otherwise(F.col("stray"))
    evidence = F.create_map(*[F.lit(v) for e, v in ending_odds(rows).items() for v in (e, v)])
    odds = prior / (1 - prior) * F.try_element_at(evidence, F.col("ending"))
    # a whole line: of a text cut at a limit (or at any of an action's characters) its last word may have been longer.
    # How often the word begins longer ones, to how often it is a whole one, is the evidence
    longer = F.when(F.col("number").isNotNull(), F.coalesce("begins", F.lit(0.0)) / F.coalesce("whole", F.lit(0.3))).otherwise(F.col("longer") / (F.col("same") + 0.3))
    word = F.when(F.col("posterior").isNotNull(), F.col("posterior")).otherwise(F.col("stray") / F.greatest("chars", F.lit(1.0))) * longer
    # with its line end nothing is missing but actions
    odds = F.when(F.col("ending") == WHOLE_BARE, word).when(F.col("ending") == WHOLE_END, 0.0).otherwise(odds)
    missing = F.coalesce(F.col("held") < F.col("n_actions"), F.lit(False))
    probability = F.when(missing, 1.0).otherwise(odds / (1 + odds))
    return joined.select("row_id", "source", "length", "ending", "cut_at", probability.alias("probability")).withColumn("cut", F.col("probability") > 0.5)


def shares(rows: DataFrame) -> DataFrame:
    """source, n_rows, n_cut, share."""
    return rows.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum(F.col("cut").cast("bigint")).alias("n_cut"), F.avg(F.col("cut").cast("double")).alias("share"))
