"""Column functions: letter ids, canonical integers, quantisation, text and score helpers. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letter ids longer than this can't be held in a bigint and are null.
LETTERS = 13
#: Named connector subtypes and their shared codes (fixed values); other subtypes are digits, coded 100 and up.
STUD_SUBS = {"stud": 0, "open": 1, "hole": 2, "tube": 3, "post": 4}
AXLE_SUBS = {"bar": 0, "clip": 1, "axle": 2, "cross": 3, "pin": 4, "socket": 5}
#: Pairs of subtypes that mate (fixed values), in alphabetical order within a pair.
STUD_MATES = (("hole", "open"), ("hole", "stud"), ("open", "post"), ("open", "tube"), ("stud", "tube"))
AXLE_MATES = (("axle", "cross"), ("axle", "socket"), ("bar", "clip"), ("bar", "cross"), ("pin", "socket"))
#: Preference among parallel edges, the family with most parameters first (fixed values).
FAMILY_RANK = {"axle": 0, "ball": 1, "hinge": 2, "stud": 3, "fixed": 4}
#: Tokens of an edge line by family (fixed values).
ARITY = {"stud": 7, "hinge": 8, "axle": 9, "ball": 9, "fixed": 6}


def lookup(values: dict, key: Column) -> Column:
    """The value of a small fixed table, null for other keys."""
    items = list(values.items())
    out = F.when(key == items[0][0], items[0][1])
    for k, v in items[1:]:
        out = out.when(key == k, v)
    return out


def i2id(n: Column, letters: int = 6) -> Column:
    """0 -> a, 25 -> z, 26 -> aa: counting with letters and no zero. Negative or null numbers give null, and so do
    those of more than so many letters (six reach beyond 300 million)."""
    out, first = None, 0
    for size in range(1, letters + 1):
        rest = n - F.lit(first)
        text = F.concat(*[F.chr(F.lit(97) + F.floor(rest / F.lit(26**k)).cast("bigint") % 26) if k else F.chr(F.lit(97) + rest % 26) for k in range(size - 1, -1, -1)])
        here = (n >= first) & (n < first + 26**size)
        out = F.when(here, text) if out is None else out.when(here, text)
        first += 26**size
    return out


def id2i(text: Column) -> Column:
    """The inverse of i2id; null for anything but lower-case letters a-z."""
    total = F.aggregate(F.split(text, ""), F.lit(0).cast("bigint"), lambda acc, c: F.when(c == "", acc).otherwise(acc * 26 + F.ascii(c) - 96))
    return F.when(text.rlike(rf"^[a-z]{{1,{LETTERS}}}\z"), total - 1)


def canonical_int(text: Column) -> Column:
    """The integer that is written this way and no other; null for leading zeros, signs, blanks or over 18 digits."""
    return F.when(text.rlike(r"^(0|-?[1-9][0-9]{0,17})\z"), text.try_cast("bigint"))


def degree(text: Column) -> Column:
    """A canonical integer from 0 to 359, else null."""
    v = canonical_int(text)
    return F.when((v >= 0) & (v < 360), v.cast("int"))


def flip(text: Column) -> Column:
    return F.when(text == "flip", True).when(text == "regular", False)


def sub_code(sub: Column) -> Column:
    """One code for all subtypes: stud family, then axle family, then 100 and the digits."""
    named = STUD_SUBS | {k: v + len(STUD_SUBS) for k, v in AXLE_SUBS.items()}
    return F.coalesce(lookup(named, sub), F.lit(100) + sub.try_cast("int"))


def quantized_degrees(radians: Column) -> Column:
    """Whole degrees from 0 to 359, halves to even."""
    return F.pmod(F.bround(F.degrees(radians)).cast("bigint"), F.lit(360)).cast("int")


def quantized_slide(units: Column) -> Column:
    return F.bround(units).cast("bigint")


def stem(file: Column) -> Column:
    """A part's file name in lower case without one .dat."""
    return F.regexp_replace(F.lower(file), r"\.dat\z", "")


def n_actions(text: Column) -> Column:
    """Actions of a path text: its lines, a missing last line end counted, two to an action after the first."""
    full = F.when(F.endswith(text, F.lit("\n")), text).otherwise(F.concat(text, F.lit("\n")))
    return F.floor((F.length(full) - F.length(F.replace(full, F.lit("\n"), F.lit(""))) + 2) / 2).cast("int")


def first_text(path: Column, text: Column) -> Column:
    """path, or text where path is null or empty."""
    return F.coalesce(F.nullif(path, F.lit("")), text)


def question(caption: Column, template: str = "Is this LEGO set {}?") -> Column:
    """A yes/no question for a caption: blanks collapsed, closing punctuation dropped, lower case."""
    base = F.trim(F.regexp_replace(caption, r"(?U)\s+", " "))
    head, tail = template.split("{}")
    return F.concat(F.lit(head), F.lower(F.regexp_replace(base, r"[.!?]+\z", "")), F.lit(tail))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of the normalised vectors; null if either is all zeros."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax_pick(logits: Column, index: Column) -> Column:
    """The softmax weight of one entry (0-based); null outside the array."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda s, v: s + F.exp(v.cast("double") - top.cast("double")))
    return F.exp(F.get(logits, index).cast("double") - top.cast("double")) / total


def first_lines(text: Column, n: int) -> Column:
    """The first n lines with their line ends; the whole text if it has fewer."""
    cut = F.substring_index(text, "\n", n)
    return F.when(F.length(cut) < F.length(text), F.concat(cut, F.lit("\n"))).otherwise(text)


def left_padded(tokens: Column, size: Column, pad: Column) -> Column:
    return F.concat(F.array_repeat(pad, F.greatest(size - F.size(tokens), F.lit(0))), tokens)
