"""Problem 2: splitting oversized items at natural boundaries, with an overlap, by pointer doubling.

All boundaries of all oversized items of a batch lie in one table. Each is joined to its farthest legal successor: the
piece that follows a cut begins 100 to 300 characters before it and may reach 3,000 characters. Squaring the successor
table doubles the steps it takes at once, so all greedy cuts of all items are known after about log2(pieces) rounds,
without a loop over pieces or items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import spread
from . import flat

LIMIT, LEAST, MOST = 3000, 100, 300


#: What ends a line besides line feed and carriage return: vertical tab, form feed, next line, line and paragraph
#: separator, and the semicolon, which paths written on one line use.
OTHER_ENDS = flat.table("\x0b\x0c\x85\u2028\u2029;")
#: Where an action ends in a path without any line end: behind an edge's last number.
BARE_END = re.compile(r"(?<=[0-9]) +(?=[a-z]+ [A-Z])")


def boundaries(cp: np.ndarray, starts: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(places, ranks) of all boundaries: rank 2 ends an action, 1 a line, 0 is set in where lines are too long.

    Places are indexes into cp behind the boundary's last character; each text's end is a boundary of rank 2. An
    action ends with an edge line (one without a bar), or with a node line that is followed by another node line.
    """
    feed, ret = cp == 10, cp == 13
    ends = feed | OTHER_ENDS[cp]
    ends[:-1] |= ret[:-1] & ~feed[1:]
    # line ends written out as a backslash and a letter
    slash = cp[:-1] == 92
    written = slash & (cp[1:] == 110)
    carriage = slash & (cp[1:] == 114)
    carriage[:-2] &= ~written[2:]
    ends[1:] |= written | carriage
    bare = np.flatnonzero(np.add.reduceat(ends, starts[:-1]) == 1)  # only the separator behind it
    for k in bare:
        ends[[starts[k] + m.end() - 1 for m in BARE_END.finditer(texts[k])]] = True
    line_end = np.flatnonzero(ends) + 1  # the separator behind each text is a line feed, too
    line_start = np.concatenate(([0], line_end[:-1]))
    node = np.add.reduceat((cp == 124).astype(np.int32), line_start) > 0
    follows = np.append(node[1:], True)
    rank = np.where(~node | follows, 2, 1)
    of = np.searchsorted(starts, line_end, side="left") - 1
    rank[np.isin(of, bare)] = 2
    place = line_end
    # a text's end: its separator doesn't count
    last = np.searchsorted(starts[1:], place, side="left")
    is_end = place == starts[1:][np.minimum(last, len(starts) - 2)]
    place = np.where(is_end, place - 1, place)
    rank = np.where(is_end, 2, rank)
    place, first = np.unique(place, return_index=True)
    # a final line end and the text's end are one place
    top = np.zeros(len(place), dtype=np.int64)
    np.maximum.at(top, np.searchsorted(place, np.where(is_end, line_end - 1, line_end)), rank)
    # where the next boundary is too far, cuts anywhere
    before = np.concatenate(([0], place[:-1]))
    before = np.maximum(before, starts[np.searchsorted(starts, place, side="right") - 1])
    gap = LIMIT - MOST
    extra = np.maximum((place - before - 1) // gap, 0)
    which = np.repeat(np.arange(len(place)), extra)
    step = np.arange(len(which)) - np.repeat(np.cumsum(extra) - extra, extra) + 1
    more = before[which] + gap * step
    place, rank = np.concatenate((place, more)), np.concatenate((top, np.zeros(len(more), dtype=np.int64)))
    order = np.argsort(place, kind="stable")
    return place[order], rank[order]


def _latest(places: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The last of places that is at most limit, or -1."""
    at = np.searchsorted(places, limit, side="right") - 1
    return np.where(at >= 0, places[np.maximum(at, 0)], -1)


def cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of all pieces, in order."""
    cp, starts = flat.codepoints(texts)
    place, rank = boundaries(cp, starts, texts)
    stop = starts[1:] - 1
    by_rank = [place[rank >= r] for r in (2, 1)]
    text = np.searchsorted(starts, place, side="right") - 1
    # where the next piece begins: the last natural boundary that gives a legal overlap
    begin = np.full(len(place), -1)
    for p in by_rank:
        b = _latest(p, place - LEAST)
        begin = np.where((begin < 0) & (b >= place - MOST), b, begin)
    begin = np.where(begin < 0, place - LEAST, begin)
    # a node for each boundary, then one for each text's beginning
    node_place = np.concatenate((place, starts[:-1]))
    node_begin = np.concatenate((begin, starts[:-1]))
    node_text = np.concatenate((text, np.arange(len(texts))))
    node_begin = np.maximum(node_begin, starts[node_text])
    reach = np.minimum(node_begin + LIMIT, stop[node_text])
    after = np.full(len(node_place), -1)
    for p in (*by_rank, place):
        s = _latest(p, reach)
        after = np.where((after < 0) & (s > node_place), s, after)
    ended = node_place >= stop[node_text]
    jump = np.where(ended, np.arange(len(node_place)), np.searchsorted(place, after))
    # doubling: after k rounds `seen` has the first 2^k cuts of each text and jump takes 2^k steps
    seen = np.zeros(len(node_place), dtype=bool)
    seen[len(place) :] = True
    succ = jump
    while True:
        new = np.unique(jump[seen])
        grown = seen.copy()
        grown[new] = True
        if (grown == seen).all():
            break
        seen, jump = grown, jump[jump]
    from_ = np.flatnonzero(seen & ~ended)
    ends = node_place[succ[from_]]
    order = np.lexsort((ends, node_text[from_]))
    from_, ends = from_[order], ends[order]
    t = node_text[from_]
    return t, node_begin[from_] - starts[t], ends - starts[t]


def pieces(df: DataFrame, key: str, text: str, with_text: bool = True) -> DataFrame:
    """key, piece, n_pieces, start, end, overlap, text: the items longer than LIMIT characters, in pieces.

    Pieces are of at most LIMIT characters and end at an action or line end wherever one is in reach; each but the
    first begins LEAST to MOST characters before the end of the one before, so that the text is the first piece
    followed by what the others have behind their overlap. Null keys or texts give no rows; each row of a repeated key
    is cut.
    """
    long = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull() & (F.length("text") > LIMIT))
    kind = long.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                texts = b.column(1).slice(lo, 500).to_pylist()
                no, start, end = cut(texts)
                count = np.bincount(no, minlength=len(texts))
                first = np.cumsum(count) - count
                overlap = np.zeros(len(no), dtype=np.int64)
                overlap[1:] = np.where(no[1:] == no[:-1], end[:-1] - start[1:], 0)
                out = {"key": b.column(0).slice(lo, 500).take(pa.array(no)), "piece": pa.array((np.arange(len(no)) - first[no]).astype(np.int32)), "n_pieces": pa.array(count[no].astype(np.int32)), "start": pa.array(start), "end": pa.array(end), "overlap": pa.array(overlap)}
                if with_text:
                    out["text"] = pa.array([texts[k][i:j] for k, i, j in zip(no, start, end)], pa.string())
                yield pa.RecordBatch.from_pydict(out)

    return spread(long).mapInArrow(run, f"key {kind}, piece int, n_pieces int, start bigint, end bigint, overlap bigint" + ", text string" * with_text)


def split_items(df: DataFrame, key: str, text: str) -> DataFrame:
    """As pieces(), with each item that is short enough as its only piece (an empty text is one empty piece)."""
    k, t = F.col(key), F.col(text)
    zero = F.lit(0).cast("bigint")
    short = df.where(k.isNotNull() & (F.length(t) <= LIMIT)).select(k.alias("key"), F.lit(0).alias("piece"), F.lit(1).alias("n_pieces"), zero.alias("start"), F.length(t).cast("bigint").alias("end"), zero.alias("overlap"), t.alias("text"))
    return short.unionByName(pieces(df, key, text))


def oversized(df: DataFrame, key: str, text: str) -> DataFrame:
    """The keys of the items that were cut into more than one piece."""
    return pieces(df, key, text, with_text=False).where("n_pieces > 1").select("key").distinct()
