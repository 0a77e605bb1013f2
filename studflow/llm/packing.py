"""Problem 7: filling sequences of fixed capacity with items, none split unless it's longer than a sequence.

The counts of item lengths, in classes of UNIT tokens, are all that reaches the driver: at most CAPACITY / UNIT
numbers, whatever the number of items. Over them the configuration linear program (as few sequences as possible, each
filled by a configuration of classes, all items covered) is solved by multiplicative weights: a knapsack dynamic program
prices configurations under the current weights of the classes, the best of them are used a little, and each class's
weight falls exponentially with the share of its items that is covered. The weights are dual values, so that each
pricing also proves a lower bound. The solution is rounded to whole sequences, what rounding leaves is priced again by
whole sequences, and the last items, which no longer fill sequences well, go in longest first; all of this by counts of
configurations, never item by item. Items then get their sequence by their rank in their class.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranks import ranked

CAPACITY, UNIT = 6400, 4
#: Of a class's items at most this share is covered in one round; the rounds at most; the exponents of the weights, one
#: for each pass: even wear where all sequences can be filled, then stronger ones.
SHARE, ROUNDS, RATES = 0.1, 60, (0.03, 1.0, 3.0)
#: Another pass, with the next rate, follows while the value is more than so many times the bound.
GAP = 1.005
#: Configurations worth less than the best by up to this share are used, too.
LOSS = 0.003
#: Bands of sizes that whole sequences are weighed by, and the exponent of their weight.
BANDS, BAND_RATE = 16, 5.0
#: Whole sequences filled less than this are left to be filled longest first.
FILL = 0.97

Pattern = list[tuple[int, int]]


def items(df: DataFrame, key: str, text: str, capacity: int = CAPACITY) -> DataFrame:
    """key, piece, n_pieces, n_tokens, token_from: each text as one item, or in pieces of capacity tokens.

    Tokens are the bytes of the UTF-8 text and one closing token, so an empty text has one. Null keys or texts give no
    item; each row is an item, repeated or not.
    """
    size = (F.octet_length(text) + 1).cast("bigint")
    x = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), size.alias("size"))
    n = F.ceil(F.col("size") / capacity).cast("int")
    x = x.select("key", "size", n.alias("n_pieces"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    start = F.col("piece").cast("bigint") * capacity
    return x.select("key", "piece", "n_pieces", F.least(F.lit(capacity).cast("bigint"), F.col("size") - start).alias("n_tokens"), start.alias("token_from"))


def _class():
    return F.ceil(F.col("n_tokens") / UNIT).cast("int")


def lengths(x: DataFrame) -> dict[int, int]:
    """How many items each class has: at most CAPACITY / UNIT numbers."""
    return {r["class"]: r["n"] for r in x.groupBy(_class().alias("class")).agg(F.count("*").alias("n")).toLocalIterator()}


def oversized(df: DataFrame, key: str, text: str, capacity: int = CAPACITY) -> DataFrame:
    """The keys of the texts that were packed in more than one piece."""
    return packed(df, key, text, capacity).where("n_pieces > 1").select("key").distinct()


def report(df: DataFrame, key: str, text: str, capacity: int = CAPACITY) -> DataFrame:
    """One row: n_items, n_tokens, n_sequences, program (the value of the linear program as solved), bound (no packing
    of these items, in units of UNIT tokens, needs fewer), fill (the share of the sequences that isn't empty)."""
    x = items(df, key, text, capacity)
    total = x.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
    plan, value, bound = configure(lengths(x), capacity // UNIT)
    n = sum(times for _, times in plan)
    return df.sparkSession.createDataFrame([(total["n"], total["tokens"], n, value, bound, total["tokens"] / (n * capacity) if n else 0.0)], "n_items bigint, n_tokens bigint, n_sequences bigint, program double, bound double, fill double")


Column = tuple[np.ndarray, np.ndarray]  # class numbers and how often each is used


def best_values(sizes: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """The greatest value that fits each room up to capacity, by dynamic programming; items may be used repeatedly."""
    best = np.zeros(capacity + 1)
    order = np.argsort(sizes, kind="stable")
    sizes, value = sizes[order], value[order]
    many = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for w in range(1, capacity + 1):
        n = many[w]
        best[w] = max(best[w - 1], (best[w - sizes[:n]] + value[:n]).max()) if n else 0.0
    return best


def columns(best: np.ndarray, sizes: np.ndarray, value: np.ndarray, room: np.ndarray, loss: float, rng: np.random.Generator, how_many: int = 256) -> list[Column]:
    """Configurations within a share `loss` of the best value, drawn along the dynamic program: of the items that may
    come next each by the room its class has left. None uses a class more often than its room allows, rounded up.
    """
    n = np.arange(how_many)
    at, slack = np.full(how_many, len(best) - 1), np.full(how_many, loss * best[-1])
    used = np.zeros((how_many, len(sizes)), dtype=np.int64)
    most = np.ceil(room - 1e-9).astype(np.int64)
    wish = np.log(np.maximum(room * sizes, 1e-300))
    active = n[best[at] > 0]
    while len(active):
        w = at[active]
        rest = w[:, None] - sizes
        lost = np.where((rest >= 0) & (used[active] < most), best[w][:, None] - best[np.maximum(rest, 0)] - value, np.inf)
        score = np.where(lost <= slack[active][:, None] + 1e-9, wish + rng.gumbel(size=lost.shape), -np.inf)
        k = score.argmax(axis=1)
        row = np.arange(len(active))
        fits = score[row, k] > -np.inf
        # half of what fits at once, where that loses no more than one
        each = np.maximum(np.minimum(w // sizes[k], most[k] - used[active, k]) // 2, 1)
        cost = best[w] - best[w - each * sizes[k] * fits] - each * value[k]
        each = np.where(cost <= lost[row, k] + 1e-9, each, 1)
        on = active[fits]
        used[on, k[fits]] += each[fits]
        slack[on] -= np.maximum(np.where(each == 1, lost[row, k], cost)[fits], 0.0)
        at[on] -= (each * sizes[k])[fits]
        # nothing may come here: a little room is lost, if that is allowed, or the configuration ends
        off = active[~fits]
        slack[off] -= best[at[off]] - best[at[off] - 1]
        at[off] -= 1
        active = active[(best[at[active]] > 0) & (slack[active] >= -1e-9)]
    found, seen = [], set()
    for row in used[used.any(axis=1)]:
        k = np.flatnonzero(row)
        case = k.tobytes() + row[k].tobytes()
        if case not in seen:
            seen.add(case)
            found.append((k, row[k]))
    return found


class Program(NamedTuple):
    """A fractional solution: configurations and how often each; its value and a lower bound of any solution's."""

    columns: list[Column]
    times: np.ndarray
    value: float
    bound: float


def covering(sizes: np.ndarray, demand: np.ndarray, capacity: int, base: np.ndarray, rate: float) -> Program:
    """Every class covered in full, by weights that begin at base."""
    rng, out, times = np.random.default_rng(0), [], []
    d, left = demand.astype(float), demand.astype(float)
    bound = 0.0
    for _ in range(ROUNDS):
        on = left > 1e-9 * d
        if not on.any():
            break
        # an item's price falls as more of its class is covered
        done = 1 - left / d
        price = np.where(on, base * np.exp(-rate * (done - (done * base * d).sum() / (base * d).sum())), 0.0)
        best = best_values(sizes[on], price[on], capacity)
        bound = max(bound, float((price * d).sum()) / best[-1])
        room = np.where(on, np.minimum(left, SHARE * d), 0.0)
        for k, a in columns(best, sizes, price, room, LOSS, rng):
            t = float((room[k] / a).min())
            if t > 1e-9:
                out.append((k, a))
                times.append(t)
                room[k] -= a * t
                left[k] = np.maximum(left[k] - a * t, 0.0)
    for k, a, t in longest_first(sizes, np.where(left > 1e-9 * d, left, 0.0), capacity):  # what the rounds didn't cover
        out.append((k, a))
        times.append(float(t))
    return Program(out, np.array(times), float(np.sum(times)), bound)


def shared_cost(sizes: np.ndarray, demand: np.ndarray, program: Program) -> np.ndarray:
    """A price for each class's items: each sequence costs one, shared by its items by their sizes, so that items that
    leave room unused are dear."""
    cost = np.zeros(len(sizes))
    for (k, a), t in zip(program.columns, program.times.tolist()):
        cost[k] += t * a * sizes[k] / float((a * sizes[k]).sum())
    return cost / demand


def plain_bound(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> float:
    """All tokens over the capacity, or, where more, sequences that items over half the capacity need one each of, and
    those for what is left of the items of a least size beside them (Martello and Toth 1990, their second bound)."""
    tokens = sizes * demand
    big = sizes * 2 > capacity
    out = float(tokens.sum()) / capacity
    for least in [0, *sizes[~big].tolist()]:
        alone = sizes > capacity - least
        beside, small = big & ~alone, ~big & (sizes >= least)
        over = float(tokens[small].sum()) - (float(demand[beside].sum()) * capacity - float(tokens[beside].sum()))
        out = max(out, float(demand[alone].sum() + demand[beside].sum()) + max(0.0, over / capacity))
    return out


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> Program:
    """The configuration linear program by multiplicative weights. The first weights are the sizes, which is right where
    sequences can be filled; if the value stays above the bound, the weights that this solution leads to come next."""
    base, bound, kept = sizes.astype(float), plain_bound(sizes, demand, capacity), None
    for rate in RATES:
        program = covering(sizes, demand, capacity, base, rate)
        base = shared_cost(sizes, demand, program)
        bound = max(bound, program.bound, float((base * demand).sum()) / best_values(sizes, base, capacity)[-1])
        if kept is None or program.value < kept.value:
            kept = program
        if kept.value <= GAP * bound:
            break
    return kept._replace(bound=bound * (1 - 1e-12))  # less what floats may be off


def whole(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Configurations used whole times for as long as they fill sequences well; takes them out of left.

    The weights go by bands of sizes here: where a class has an item or two, only a band's share that is left says
    whether its sizes are used up too fast.
    """
    rng, out = np.random.default_rng(1), []
    band = np.minimum(BANDS - 1, sizes * BANDS // (capacity + 1))
    tokens = lambda x: np.bincount(band, weights=x * sizes, minlength=BANDS)
    all_ = np.maximum(tokens(left), 1e-9)
    while (left > 0).any():
        total, on = float((left * sizes).sum()), left > 0
        price = sizes * np.exp(BAND_RATE * (tokens(left) / all_ - total / all_.sum()))[band] * on
        best, used = best_values(sizes[on], price[on], capacity), 0
        for k, a in columns(best, sizes, price, left.astype(float), LOSS, rng):
            if used >= max(SHARE * total, capacity):
                break
            n = min(int((left[k] // a).min()), max(1, int(SHARE * total / capacity / 8)))
            if n > 0 and (a * sizes[k]).sum() >= FILL * capacity:
                left[k] -= a * n
                used += n * capacity
                out.append((k, a, n))
        if not used:
            break
    return out


def longest_first(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Sequences filled with the longest items that still fit; each configuration is repeated until one of its classes
    is used up, so there are no more of them than classes (twice as many where counts are whole). Takes all of left."""
    out, one = [], left.dtype.kind == "f"
    while (left > 0).any():
        room, use = capacity, []
        for k in np.flatnonzero(left > 0)[::-1].tolist():
            a = min(int(np.ceil(left[k])), room // int(sizes[k]))
            if a:
                use.append((k, a))
                room -= a * int(sizes[k])
        k, a = (np.array(x) for x in zip(*use))
        n = (left[k] / a).min() if one else int((left[k] // a).min())
        left[k] -= a * n
        if one:
            left[left < 1e-9] = 0.0
        out.append((k, a, n))
    return out


def configure(counts: dict[int, int], capacity: int = CAPACITY // UNIT) -> tuple[list[tuple[Pattern, int]], float, float]:
    """For counts of item sizes: configurations (of sizes) and how many sequences each is used for, covering all items;
    the value of the linear program as it was solved, and a lower bound of any solution's number of sequences."""
    sizes = np.array(sorted(counts), dtype=np.int64)
    if not len(sizes):
        return [], 0.0, 0.0
    demand = np.array([counts[s] for s in sizes.tolist()], dtype=np.int64)
    program = solve(sizes, demand, capacity)
    left, plan = demand.copy(), []
    # rounded so that the first configurations together are used as often as the program has them, to less than one
    ends = np.floor(np.cumsum(program.times) + 1e-6)
    for (k, a), n in zip(program.columns, np.diff(ends, prepend=0.0).astype(np.int64).tolist()):
        n = min(n, int((left[k] // a).min()))
        if n > 0:
            plan.append((k, a, n))
            left[k] -= a * n
    plan += whole(sizes, left, capacity)
    plan += longest_first(sizes, left, capacity)
    merged: dict[tuple, int] = {}
    for k, a, n in plan:
        pattern = tuple(sorted(zip(sizes[k].tolist(), a.tolist()), reverse=True))
        merged[pattern] = merged.get(pattern, 0) + n
    return [(list(p), n) for p, n in merged.items()], program.value, program.bound


def packed(df: DataFrame, key: str, text: str, capacity: int = CAPACITY) -> DataFrame:
    """key, piece, n_pieces, sequence, position, offset, n_tokens, token_from.

    token_from is where the piece begins in its document, offset where it lies in its sequence. No sequence holds more
    than capacity tokens (a multiple of UNIT); a full piece of a longer document is a sequence of its own.
    """
    x = items(df, key, text, capacity).withColumn("class", _class())
    counts = lengths(x)
    rows, at, base = [], dict.fromkeys(counts, 0), 0
    for config, times in configure(counts, capacity // UNIT)[0]:
        slot = 0
        for size, a in config:
            rows.append((size, at[size], at[size] + a * times, base, a, slot))
            at[size] += a * times
            slot += a
        base += times
    # at most as many rows as configurations times their classes, whatever the number of documents
    plan = df.sparkSession.createDataFrame(rows, "size int, lo bigint, hi bigint, base bigint, each int, slot int")
    r = ranked(x, ["class"], F.struct("key", "piece"))
    placed = r.join(F.broadcast(plan), (r["class"] == plan["size"]) & (r["rank"] >= plan["lo"]) & (r["rank"] < plan["hi"]))
    k = F.col("rank") - F.col("lo")
    placed = placed.select("key", "piece", "n_pieces", (F.col("base") + F.floor(k / F.col("each"))).alias("sequence"), (F.col("slot") + k % F.col("each")).cast("int").alias("position"), "n_tokens", "token_from")
    w = W.partitionBy("sequence").orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    return placed.select("key", "piece", "n_pieces", "sequence", "position", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)).alias("offset"), "n_tokens", "token_from")
