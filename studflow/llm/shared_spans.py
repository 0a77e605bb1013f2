"""Problem 5: long exact spans shared between records, by automata of repeated phrases.

1. A window is SPAN characters in a row. Each window is anchored at the smallest of the hashes of its GRAM-character
   pieces, which depends on the window's own characters only, so equal windows of different records have equal anchors.
   One pass over the texts gives the anchors (one in about 100 characters); anchors of two or more records mark the
   phrases that may recur.
2. The phrases are compiled into sharded Aho-Corasick automata of at most about PHRASES each. A record is streamed
   through the automata of the shards that it has an anchor in, and no other, so that the work grows with the records
   and not with records times shards; the automaton confirms the phrases letter by letter and locates all of them.
3. At located phrases every window is hashed, and a window that two records have is shared. The records of a shard are
   in one task, unless they are many; then those windows that aren't settled there meet by their phrase. No two records
   are compared as a pair. Windows are told apart by two hashes of 96 bits in all, beside the phrase: among 10^12 windows two
   different ones agree with a chance of 1 in 10^5.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import checkpointed, spread
from . import flat
from .flat import U, pack, unpack

SPAN, GRAM = 300, 96
WIDTH = SPAN - GRAM + 1
#: Phrases of a shard's automaton, which stays small enough for fast memory; records that one task streams through it;
#: partitions that shards are put in, several to one if need be.
PHRASES, RECORDS, PARTS = 5_000, 40_000, 16_000
#: Code points worked on at once, unless one text is longer.
SLICE = 600_000
OTHER = U(0xA0761D6478BD642F)
_INVERSE = U(pow(int(flat.MULT), -1, 1 << 64))


class Sums:
    """Hashes of pieces of some texts, laid end to end, by running sums."""

    def __init__(self, texts: list[str]):
        cp, self.starts = flat.codepoints(texts)
        self.n = n = len(cp)
        power = np.full(n + 1, flat.MULT)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        self.inverse = np.full(n + 1, _INVERSE)
        self.inverse[0] = 1
        np.multiply.accumulate(self.inverse, out=self.inverse)
        self.sums = np.zeros(n + 1, dtype=U)
        np.cumsum((cp.astype(U) * flat.MIX_A + flat.MIX_B) * power[:n], out=self.sums[1:])
        self.cp, self.power = cp, power

    def hashes(self, start: np.ndarray, size: int) -> np.ndarray:
        return flat.mix((self.sums[start + size] - self.sums[start]) * self.inverse[start])

    def checks(self, start: np.ndarray) -> np.ndarray:
        """Another 32 bits of the windows that begin here."""
        more = np.zeros(self.n + 1, dtype=U)
        np.cumsum(flat.mix(self.cp.astype(U) + OTHER) * self.power[: self.n], out=more[1:])
        return (flat.mix((more[start + SPAN] - more[start]) * self.inverse[start]) >> U(32)).astype(np.uint32)


class Anchors(Sums):
    """The anchors of all windows: for each its text and its place."""

    def __init__(self, texts: list[str]):
        super().__init__(texts)
        windows = np.maximum(np.diff(self.starts) - SPAN, 0)  # a separator follows each text
        text = np.repeat(np.arange(len(texts)), windows)
        begin = np.concatenate(([0], np.cumsum(windows)))[:-1]
        at = np.arange(len(text)) + (self.starts[:-1] - begin)[text]
        if not len(at):
            self.text = self.pos = at
            return
        v = self.hashes(np.arange(self.n - GRAM + 1), GRAM)
        # 40 bits of the hash, then the position, later ones first
        v = (v & ~U(0xFFFFFF)) | (~np.arange(len(v), dtype=U) & U(0xFFFFFF))
        reach = 1
        while reach * 2 <= WIDTH:
            v = np.minimum(v[:-reach], v[reach:])
            reach *= 2
        if reach < WIDTH:
            v = np.minimum(v[: len(v) - (WIDTH - reach)], v[WIDTH - reach :])
        pos = at + ((((~v[at]) & U(0xFFFFFF)).astype(np.int64) - at) & 0xFFFFFF)
        new = np.ones(len(at), dtype=bool)
        new[1:] = (pos[1:] != pos[:-1]) | (text[1:] != text[:-1])
        self.text, self.pos = text[new], pos[new]


def sliced(keys: np.ndarray, texts: list[str], extra: list | None = None) -> Iterator[tuple[np.ndarray, list[str], list | None]]:
    lo, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= SLICE or k == len(texts) - 1:
            yield keys[lo : k + 1], texts[lo : k + 1], extra[lo : k + 1] if extra is not None else None
            lo, size = k + 1, 0


def recurring(h: np.ndarray, check: np.ndarray, key: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """For each entry, whether its hash (64 bits and 32 more) occurs with two keys, or is known to."""
    order = np.lexsort((check, h))
    hs, cs, ks = h[order], check[order], key[order]
    first = np.flatnonzero(np.concatenate(([True], (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1])))) if len(hs) else np.zeros(0, dtype=np.int64)
    if not len(first):
        return np.zeros(0, dtype=bool)
    many = np.minimum.reduceat(ks, first) != np.maximum.reduceat(ks, first)
    if known is not None:
        many |= np.maximum.reduceat(known[order], first) > 0
    out = np.empty(len(h), dtype=bool)
    out[order] = np.repeat(many, np.diff(np.append(first, len(hs))))
    return out


def one_of_each(h: np.ndarray, check: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One of the entries `at` for each hash."""
    order = at[np.lexsort((check[at], h[at]))]
    return order[np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (check[order][1:] != check[order][:-1])))] if len(order) else order


def _by_bucket(bucket: np.ndarray, buckets: int, **columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        o = order[cuts[b] : cuts[b + 1]]
        if len(o):
            yield b, pack(**{k: v[o] for k, v in columns.items()})


def _entries(keys: np.ndarray, texts: list[str], buckets: int) -> Iterator[tuple[int, bytes]]:
    """First pass: anchors; known 1: already seen with two keys in this batch.

    Of a hash known to recur in the batch, one entry goes to the hash's bucket, and all its occurrences, as settled
    ones (known 2), to buckets by their key, so that no hash gathers more than an entry or two a batch.
    """
    h, rec, pos = [], [], []
    base = 0
    for _, t, _ in sliced(keys, texts):
        a = Anchors(t)
        if len(a.pos):
            h.append(a.hashes(a.pos, GRAM))
            rec.append(base + a.text)
            pos.append(a.pos - a.starts[a.text])
        base += len(t)
    if not h:
        return
    h, rec, pos = (np.concatenate(x) for x in (h, rec, pos))
    key = keys[rec]
    check = np.zeros(len(h), dtype=np.uint32)
    here = recurring(h, check, key)
    own = np.flatnonzero(here)
    lead = one_of_each(h, check, own)
    rest = np.flatnonzero(~here)
    at = np.concatenate((rest, lead, own))
    known = np.repeat(np.array([0, 1, 2], dtype=np.uint8), [len(rest), len(lead), len(own)])
    bucket = np.where(known == 2, flat.mix(key[at].astype(U)) % U(buckets), h[at] % U(buckets)).astype(np.int64)
    yield from _by_bucket(bucket, buckets, h=h[at], key=key[at], pos=pos[at].astype(np.uint32), known=known)


def _occurrences(blobs: list[bytes]) -> dict[str, np.ndarray]:
    h, key, pos, known = (np.concatenate(x) for x in zip(*(unpack(b, "u8", "i8", "u4", "u1") for b in blobs)))
    settled = known == 2
    open_ = np.flatnonzero(~settled)
    many = recurring(h[open_], np.zeros(len(open_), dtype=np.uint32), key[open_], known[open_])
    # an entry known to recur stands for occurrences that come as settled ones
    take = np.concatenate((np.flatnonzero(settled), open_[many & (known[open_] == 0)]))
    return {"key": key[take], "pos": pos[take], "anchor": h[take].view(np.int64)}


def _grouped(parts: DataFrame, buckets: int, f, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[bytes]] = {}
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(k, []).append(blob)
        for k in list(by):
            out = f(by.pop(k))
            size = len(next(iter(out.values())))
            for lo in range(0, size, 100_000):
                yield pa.RecordBatch.from_pydict({n: pa.array(v[lo : lo + 100_000].astype(np.int64)) for n, v in out.items()})

    return parts.repartitionById(buckets, F.col("bucket")).mapInArrow(run, schema)


def _emit(rows: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    rows = list(rows)
    if rows:
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in rows], pa.int32()), "blob": pa.array([r[1] for r in rows], pa.large_binary())})


def _buckets(df: DataFrame, entries: float) -> int:
    cores = df.sparkSession.sparkContext.defaultParallelism
    return int(min(32_000, max(2 * cores, math.ceil(entries / 2e6))))


def occurrences(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, int]:
    """(records, places, buckets): the usable records, and key, pos and hash of the anchors that recur."""
    records = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).where((F.length("text") >= SPAN) & F.col("key").isNotNull())
    chars = records.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = _buckets(df, chars / 80)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _emit(_entries(b.column(0).to_numpy(), b.column(1).to_pylist(), buckets))

    parts = spread(records).mapInArrow(post, "bucket int, blob binary")
    return records, checkpointed(_grouped(parts, buckets, _occurrences, "key bigint, pos bigint, anchor bigint")), buckets


def automaton(phrases: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in phrases:
        out.add_word(p)
    out.make_automaton()
    return out


def located(machine: ahocorasick.Automaton, text: str) -> list[int]:
    """Where the phrases begin in a text, all of them."""
    return [end - size + 1 for end, size in machine.iter(text)]


class Windows(NamedTuple):
    """Windows of records: two hashes, the record's key, the first character, and the bucket of the phrase in it."""

    h: np.ndarray
    check: np.ndarray
    key: np.ndarray
    start: np.ndarray
    bucket: np.ndarray


def _windows(keys: np.ndarray, texts: list[str], places: list[list[int]], buckets: int) -> Iterator[Windows]:
    """Second pass: all windows that hold a phrase that begins at one of these places."""
    for k, t, p in sliced(keys, texts, places):
        a = Sums(t)
        count = np.array([len(x) for x in p], dtype=np.int64)
        who = np.repeat(np.arange(len(t)), count)
        at = np.concatenate([np.asarray(x, dtype=np.int64) for x in p]) if len(p) else np.zeros(0, dtype=np.int64)
        low, high = np.maximum(at - (SPAN - GRAM), 0), np.minimum(at, np.diff(a.starts)[who] - 1 - SPAN)
        fits = high >= low
        who, at, low, high = who[fits], at[fits], low[fits], high[fits]
        n = high - low + 1
        of = np.repeat(np.arange(len(n)), n)
        start = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + low[of]
        begin = start + a.starts[who[of]]
        bucket = (a.hashes(at + a.starts[who], GRAM) % U(buckets)).astype(np.int64)
        yield Windows(a.hashes(begin, SPAN), a.checks(begin), k[who[of]], start, bucket[of])


def _sent(w: Windows, buckets: int, whole: bool) -> Iterator[tuple[int, bytes]]:
    """What has to be told of some windows: the stretches of those that recur among them, which go by key (known 2);
    and unless these are all the records that have the phrases, the others, which may recur elsewhere, and one of each
    that does here (known 0 and 1), which go by their phrase."""
    here = recurring(w.h, w.check, w.key)
    own = np.flatnonzero(here)
    key, lo, hi = stretches(w.key[own], w.start[own])
    none = np.zeros(0, dtype=np.int64)
    lead, rest = (none, none) if whole else (one_of_each(w.h, w.check, own), np.flatnonzero(~here))
    at = np.concatenate((rest, lead))
    known = np.repeat(np.array([0, 1, 2], dtype=np.uint8), [len(rest), len(lead), len(key)])
    bucket = np.concatenate((w.bucket[at], (flat.mix(key.astype(U)) % U(buckets)).astype(np.int64)))
    yield from _by_bucket(bucket, buckets, h=np.concatenate((w.h[at], np.zeros(len(key), dtype=U))), check=np.concatenate((w.check[at], np.zeros(len(key), dtype=np.uint32))), key=np.concatenate((w.key[at], key)), lo=np.concatenate((w.start[at], lo)).astype(np.uint32), hi=np.concatenate((w.start[at], hi)).astype(np.uint32), known=known)


def stretches(key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive starts of one key: key, first start, last start."""
    order = np.lexsort((start, key))
    k, s = key[order], start[order]
    if not len(k):
        return k, s, s
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (s[1:] > s[:-1] + 1)))
    first = np.flatnonzero(new)
    return k[first], s[first], s[np.append(first[1:], len(k)) - 1]


def _covered(blobs: list[bytes]) -> dict[str, np.ndarray]:
    h, check, key, lo, hi, known = (np.concatenate(x) for x in zip(*(unpack(b, "u8", "u4", "i8", "u4", "u4", "u1") for b in blobs)))
    settled = known == 2
    open_ = np.flatnonzero(~settled)
    many = recurring(h[open_], check[open_], key[open_], known[open_])
    take = open_[many & (known[open_] == 0)]
    k, a, b = stretches(key[take], lo[take].astype(np.int64))
    return {"key": np.concatenate((k, key[settled])), "first": np.concatenate((a, lo[settled])), "last": np.concatenate((b, hi[settled]))}


def stretches_at(records: DataFrame, places: DataFrame, buckets: int) -> DataFrame:
    """key, first, last: stretches of starts of windows that another record has, at the phrases of these anchors."""
    shards = max(1, math.ceil(places.select("anchor").distinct().count() / PHRASES))
    at = places.select("key", "pos", "anchor", F.pmod("anchor", F.lit(shards)).alias("shard"))
    # a record goes to each shard it has an anchor in; a shard of many records is spread over several tasks
    route = at.select("key", "shard").distinct()
    salts = route.groupBy("shard").agg(F.ceil(F.count("*") / RECORDS).cast("int").alias("salts"))
    route = route.join(salts, "shard").select("key", "shard", "salts", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int").alias("salt"))
    texts = route.join(records, "key").select("shard", "salt", F.lit(1).alias("kind"), "salts", "key", "text")
    # one record of each phrase gives its letters
    one = at.groupBy("anchor", "shard").agg(F.min(F.struct("key", "pos")).alias("p")).select("shard", F.col("p.key").alias("key"), F.col("p.pos").alias("pos"))
    phrases = one.join(records, "key").select("shard", F.substring("text", F.col("pos").cast("int") + 1, F.lit(GRAM)).alias("text")).join(salts, "shard")
    phrases = phrases.select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "salts", F.lit(0).cast("bigint").alias("key"), "text")
    # partitions as full as there are shards for, at least one a core
    parts = min(PARTS, max(shards, records.sparkSession.sparkContext.defaultParallelism))
    rows = phrases.unionByName(texts).repartition(parts, "shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, letters, machine, held = None, [], None, []

        def told() -> Iterator[pa.RecordBatch]:
            if held:
                yield from _emit(_sent(Windows(*(np.concatenate(x) for x in zip(*held))), buckets, current[2] == 1))
                held.clear()

        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                keys, use, found = [], [], []

                def hashed() -> None:
                    if keys:
                        held.extend(_windows(np.array(keys, dtype=np.int64), use, found, buckets))
                    for x in (keys, use, found):
                        x.clear()

                for shard, salt, kind, salts_, k, t in zip(*(c.to_pylist() for c in batch.slice(lo, 2000).columns)):
                    if current is None or current[:2] != (shard, salt):
                        hashed()
                        yield from told()
                        current, letters, machine = (shard, salt, salts_), [], None
                    if kind == 0:
                        letters.append(t)
                        continue
                    if machine is None:
                        machine, letters = automaton(letters), []
                    got = located(machine, t)
                    if got:
                        keys.append(k)
                        use.append(t)
                        found.append(got)
                hashed()
        yield from told()

    return _grouped(rows.mapInArrow(stream, "bucket int, blob binary"), buckets, _covered, "key bigint, first bigint, last bigint")


def sharing_records(df: DataFrame, key: str, text: str) -> DataFrame:
    """record_key of each record that holds SPAN characters in a row that another record holds too.

    Records with a null key or text, or of fewer characters, hold none; rows with one key are one record. Characters
    are code points, compared as they are.
    """
    return stretches_at(*occurrences(df, key, text)).select(F.col("key").alias("record_key")).distinct()


def shared_stretches(df: DataFrame, key: str, text: str) -> DataFrame:
    """record_key, start, end: the maximal stretches (0-based, end excluded) whose windows all occur elsewhere."""
    found = stretches_at(*occurrences(df, key, text)).select("key", F.col("first").alias("lo"), (F.col("last") + SPAN).alias("hi"))
    w = W.partitionBy("key").orderBy("lo", "hi")
    seen = F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = found.withColumn("new", F.when(seen.isNull() | (seen < F.col("lo")), 1).otherwise(0)).withColumn("no", F.sum("new").over(w))
    return marked.groupBy("key", "no").agg(F.min("lo").alias("start"), F.max("hi").alias("end")).select(F.col("key").alias("record_key"), "start", "end")


def shared_amounts(df: DataFrame, key: str, text: str) -> DataFrame:
    """record_key, n_stretches, n_shared, share: how much of each record is found elsewhere (0 for the others)."""
    found = shared_stretches(df, key, text).groupBy("record_key").agg(F.count("*").alias("n_stretches"), F.sum(F.col("end") - F.col("start")).alias("n_shared"))
    all_ = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("record_key")).agg(F.max(F.length(text)).alias("n"))
    zero = F.lit(0).cast("bigint")
    n = F.coalesce("n_shared", zero)
    return all_.join(found, "record_key", "left").select("record_key", F.coalesce("n_stretches", zero).alias("n_stretches"), n.alias("n_shared"), F.when(F.col("n") > 0, n / F.col("n")).otherwise(0.0).alias("share"))
