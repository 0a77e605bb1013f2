"""Problem 3: near-duplicate records with small edits.

A set-similarity self-join over the distinct word runs of each record, by rare-first prefix filtering:

1. one pass counts the runs in a table that grows with the input, which gives the rare-first order (any fixed order
   is exact; collisions in the table only make it less sharp);
2. each record's runs are put in that order; its prefix is what two records of the wanted similarity must share at
   least one run of. The prefixes are shuffled by run, column-wise and packed, with a parity map of each record's
   set (one to two bits for each run in it);
3. records that meet on a prefix run pass the length filter, the positional filter and, as suffix filter, the lower
   bound that the parity maps give for the symmetric difference; none of these loses a pair;
4. each surviving pair is verified once, from the two texts.

Records whose run sets are equal are one class in step 3, so groups of copies never meet pair by pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import checkpointed, passing_shuffles, spread
from . import flat
from .flat import pack, unpack

#: The table of counts has a slot for every 64 runs or so, within these bounds (2^20 to 2^24 slots, a byte each).
SKETCH_BITS = (20, 24)
#: A count is kept as six times its binary logarithm in one byte: exact enough to order and to cut by, up to 4e12.
STEPS = 6
#: Runs are told apart by so many bits of their hash in the filters: 32, and more where there are more runs.
TOKEN_BITS = (32, 43)
#: Parity maps have 128 bits, or 2, 4, 8 ... times as many.
LEVELS = 12
#: A run whose count is above this is split into blocks of records that meet block by block.
HOT = 200_000
#: Pairs looked at in one go.
CHUNK = 2_000_000
#: Records taken together; their number has to fit 13 bits of a sort key.
SLICE = 5_000
#: Prefix entries of a bucket, which one task holds; and buckets of one round over the texts.
ENTRIES, ROUND = 2_000_000, 16_000
#: A record goes, with its map, to each bucket that one of its prefix runs is in, so with many buckets all postings would
#: take many times the input; they are dealt out in up to so many rounds, of at least so many buckets.
ROUNDS, FEWEST = 16, 24
#: Copies of one class meet in blocks of so many.
BLOCK = 500


def runs(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of n words of each text (lower case), their bounds, and each text's number of words."""
    cp, starts = flat.codepoints([t.lower() for t in texts])
    words, _, _, of_text = flat.word_hashes(cp, starts, flat.BLANKS)
    h, bounds = flat.runs_of(words, of_text, n)
    return h, bounds, np.diff(of_text)


def codes(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes: 0 for none, else 1 and STEPS times the binary logarithm."""
    return np.where(counts > 0, np.minimum(1 + np.round(STEPS * np.log2(np.maximum(counts, 1))), 255), 0).astype(np.uint8)


def counts_of(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, np.round(2.0 ** ((code.astype(float) - 1) / STEPS)), 0).astype(np.int64)


def sketch_bits(chars: float) -> int:
    """For texts of so many characters; a run begins with each word, of about six characters."""
    return int(np.clip(math.ceil(math.log2(max(chars / 6 / 64, 1))), *SKETCH_BITS))


def token_bits(chars: float) -> int:
    """So many that a run meets few others by chance: 16 for each run there is, where 43 bits are enough for that."""
    return int(np.clip(math.ceil(math.log2(max(chars / 6, 1))) + 4, *TOKEN_BITS))


def sketch(texts: DataFrame, n: int, bits: int = SKETCH_BITS[0]) -> np.ndarray:
    """How often runs occur, by the first bits of their hash: a table of 2^bits counts (as codes)."""
    chunk = 1 << 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                h, _, _ = runs(b.column(0).slice(lo, SLICE).to_pylist(), n)
                np.add.at(total, (h >> np.uint64(64 - bits)).astype(np.int64), 1)
        if total.any():
            parts = np.minimum(total, 0xFFFFFFFF).astype(np.uint32).reshape(-1, chunk)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(len(parts)), pa.int32()), "counts": pa.array([pack(c=p) for p in parts], pa.binary())})

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        # one row per task, added up one after the other
        total = np.zeros(chunk, dtype=np.int64)
        for blob in frame["counts"]:
            total += unpack(blob, "u4")[0]
        return pd.DataFrame({"chunk": [key[0]], "counts": [pack(c=codes(total))]})

    # each task sends a whole table, so there are no more of them than cores
    few = texts.coalesce(max(texts.sparkSession.sparkContext.defaultParallelism, 1)) if bits > SKETCH_BITS[0] else texts
    out = few.mapInArrow(count, "chunk int, counts binary").groupBy("chunk").applyInPandas(add, "chunk int, counts binary")
    total = np.zeros(1 << bits, dtype=np.uint8)
    for row in out.toLocalIterator():
        total[row["chunk"] * chunk : (row["chunk"] + 1) * chunk] = unpack(bytes(row["counts"]), "u1")[0]
    return total


def prefix_lengths(size: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the probing prefix and of the shorter indexed prefix (for the smaller record of a pair).

    One more than needed, as two runs of a record may have the same bits of their hash.
    """
    probe = size - np.ceil(t * size - 1e-9).astype(np.int64) + 2
    index = size - np.ceil(2 * t / (1 + t) * size - 1e-9).astype(np.int64) + 2
    return probe, index


def map_level(size: np.ndarray) -> np.ndarray:
    """A record's parity map has 128 << level bits: at least one for each of its runs."""
    return np.clip(np.ceil(np.log2(np.maximum(size, 1) / 128)), 0, LEVELS).astype(np.int64)


class Maps:
    """The parity maps of many records, folded to each level that a pair may be compared at."""

    def __init__(self, words: np.ndarray, size: np.ndarray):
        self.level = map_level(size)
        start = np.concatenate(([0], np.cumsum(2 << self.level)))[:-1]
        self.at, self.maps = [], []
        for k in range(int(self.level.max(initial=-1)) + 1):
            has = np.flatnonzero(self.level >= k)
            out = np.zeros((len(has), 2 << k), dtype=np.uint64)
            for own in np.unique(self.level[has]):
                rows = np.flatnonzero(self.level[has] == own)
                m = words[start[has[rows]][:, None] + np.arange(2 << own)]
                while m.shape[1] > 2 << k:  # halves laid over each other: the map of half as many bits
                    m = m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]
                out[rows] = m
            at = np.full(len(size), -1, dtype=np.int64)
            at[has] = np.arange(len(has))
            self.at.append(at)
            self.maps.append(out)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """At most the size of the symmetric difference of the sets of i and j."""
        out = np.zeros(len(i), dtype=np.int64)
        both = np.minimum(self.level[i], self.level[j])
        for k in np.unique(both):
            w = np.flatnonzero(both == k)
            m, at = self.maps[k], self.at[k]
            out[w] = np.bitwise_count(m[at[i[w]]] ^ m[at[j[w]]]).sum(axis=1, dtype=np.int64)
        return out


def _counts_at(counts: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    return counts[(h >> flat.U(bits - (int(len(counts)).bit_length() - 1))).astype(np.int64)]


def _prefixes(keys: np.ndarray, texts: list[str], n: int, t: float, min_words: int, counts: np.ndarray, bits: int = TOKEN_BITS[0]) -> bytes | None:
    """The records' prefixes, packed: all that their postings are made of, each record once."""
    h, bounds, words = runs(texts, n)
    enough = words >= min_words
    sizes = np.where(enough, np.diff(bounds), 0)
    keep = np.repeat(enough, np.diff(bounds))
    h = h[keep]
    keys, bounds = keys[enough], np.concatenate(([0], np.cumsum(sizes[enough])))
    # runs are told apart by these bits of their hash here, by 44 when a pair is verified
    h, bounds = flat.distinct_in_text(h, bounds, bits)
    size = np.diff(bounds)
    if not len(size):
        return None
    rec = np.repeat(np.arange(len(size)), size)
    # the class of a record is the hash of its set; copies within the batch are dropped here
    ids = flat.mix(np.add.reduceat(flat.mix(h ^ flat.MIX_A), bounds[:-1]) + size.astype(np.uint64))
    order = np.lexsort((keys, ids))
    lead = np.ones(len(ids), dtype=bool)
    lead[1:] = ids[order][1:] != ids[order][:-1]
    leader = order[lead][np.cumsum(lead) - 1]
    leads = np.zeros(len(ids), dtype=bool)
    leads[order[lead]] = True
    copies = {}
    for i, j in zip(order[~lead], leader[~lead]):
        copies.setdefault(int(j), []).append(int(keys[i]))
    # parity maps, laid end to end
    level = map_level(size)
    start = np.concatenate(([0], np.cumsum(128 << level)))
    bit = ((h * flat.MULT) & flat.U(0xFFFFFFFF)).astype(np.int64) & ((128 << level) - 1)[rec]
    parity = (np.bincount(start[rec] + bit, minlength=start[-1]) & 1).astype(np.uint8)
    maps = np.packbits(parity, bitorder="little").view(np.uint64)
    # rare first: by count, then by the run's hash
    low = flat.U((1 << bits) - 1)
    h = np.sort((rec.astype(np.uint64) << flat.U(bits + 8)) | (_counts_at(counts, h, bits).astype(np.uint64) << flat.U(bits)) | h) & low
    place = np.arange(len(h)) - np.repeat(bounds[:-1], size)
    probe, _ = prefix_lengths(size, t)
    sel = np.flatnonzero((place < probe[rec]) & leads[rec])
    sel = sel[counts_of(_counts_at(counts, h[sel], bits)) > 1]
    token, rec, place = h[sel], rec[sel], place[sel]
    # only records that have postings
    used, rec = np.unique(rec, return_inverse=True)
    if not len(used):
        return None
    own = [(k, c) for k, i in enumerate(used.tolist()) for c in copies.get(i, ())]
    steps = np.diff(place, prepend=0)
    return pack(
        ids=ids[used], keys=keys[used], size=size[used].astype(np.uint32), maps=np.concatenate([maps[start[k] // 64 : start[k + 1] // 64] for k in used]), many=np.bincount(rec).astype(np.uint32),
        low=(token & flat.U(0xFFFFFFFF)).astype(np.uint32), high=(token >> flat.U(32)).astype(np.uint16), steps=steps.astype(np.int32), copy_of=np.array([k for k, _ in own], dtype=np.uint16), copy=np.array([c for _, c in own], dtype=np.int64),
    )


def _dealt(prefixes: bytes, counts: np.ndarray, buckets: int, bits: int = TOKEN_BITS[0], wanted: tuple[int, int] | None = None) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed postings) of the records, for the buckets wanted[0] to wanted[1]."""
    ids, keys, size, maps, many, low, high, steps, copy_of, copy = unpack(prefixes, "u8", "i8", "u4", "u8", "u4", "u4", "u2", "i4", "u2", "i8")
    token = low.astype(np.uint64) | high.astype(np.uint64) << flat.U(32)
    rec, place = np.repeat(np.arange(len(size)), many), np.cumsum(steps.astype(np.int64))
    start = np.concatenate(([0], np.cumsum(128 << map_level(size.astype(np.int64)))))
    copies: dict[int, list[int]] = {}
    for i, c in zip(copy_of.tolist(), copy.tolist()):
        copies.setdefault(i, []).append(c)
    often = counts_of(np.arange(256))[_counts_at(counts, token, bits)]
    side = np.zeros(len(token), dtype=np.uint8)
    hot = np.flatnonzero(often > HOT)
    if len(hot):
        # a hot run meets in blocks: block r of its records goes to every pair of blocks that has r
        blocks = -(-often[hot] // HOT)
        row = (ids[rec[hot]] % blocks.astype(np.uint64)).astype(np.int64)
        times = np.repeat(np.arange(len(hot)), blocks)
        other = np.arange(len(times)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        lower, high = np.minimum(row[times], other), np.maximum(row[times], other)
        pair = flat.mix(token[hot][times] + flat.mix((lower << 32 | high).astype(np.uint64)))
        rest = often <= HOT
        src = hot[times]
        new_side = np.where(lower == high, 0, np.where(row[times] == lower, 1, 2)).astype(np.uint8)
        token = np.concatenate((token[rest], pair >> flat.U(64 - bits)))
        side = np.concatenate((side[rest], new_side))
        rec, place = np.concatenate((rec[rest], rec[src])), np.concatenate((place[rest], place[src]))
    bucket = (flat.mix(token) % flat.U(buckets)).astype(np.int64)
    home = np.full(len(size), -1, dtype=np.int64)
    home[rec[::-1]] = bucket[::-1]
    first, last = wanted or (0, buckets)
    order = np.flatnonzero((bucket >= first) & (bucket < last))
    order = order[np.lexsort((token[order], bucket[order]))]
    token, side, rec, place, bucket = token[order], side[order], rec[order], place[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(first, last + 1))
    wide = np.diff(start) // 64
    narrow = np.uint32 if bits <= 32 else np.uint64
    for b in range(first, last):
        lo, hi = cuts[b - first], cuts[b - first + 1]
        if lo == hi:
            continue
        used, local = np.unique(rec[lo:hi], return_inverse=True)
        at_home = home[used] == b
        own = [(k, c) for k in np.flatnonzero(at_home) for c in copies.get(int(used[k]), ())]
        words = wide[used]
        at = np.arange(words.sum()) + np.repeat(start[used] // 64 - (np.cumsum(words) - words), words)
        yield b, pack(
            ids=ids[used], keys=keys[used], size=size[used].astype(np.uint32), maps=maps[at], home=at_home.astype(np.uint8),
            token=np.diff(token[lo:hi].astype(np.int64), prepend=0).astype(narrow), rec=local.astype(np.uint16), place=place[lo:hi].astype(np.uint32), side=side[lo:hi],
            copy_of=np.array([k for k, _ in own], dtype=np.uint16), copy=np.array([c for _, c in own], dtype=np.int64),
        )


def _postings(keys: np.ndarray, texts: list[str], n: int, t: float, min_words: int, counts: np.ndarray, buckets: int, bits: int = TOKEN_BITS[0], wanted: tuple[int, int] | None = None) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed postings) of the records, for the buckets wanted[0] to wanted[1]."""
    prefixes = _prefixes(keys, texts, n, t, min_words, counts, bits)
    return iter(()) if prefixes is None else _dealt(prefixes, counts, buckets, bits, wanted)


def _meet(blobs: list[bytes], t: float, bits: int = TOKEN_BITS[0]) -> tuple[np.ndarray, np.ndarray]:
    """Of one bucket: the candidate pairs (of class representatives) and the (representative, copy) pairs."""
    parts = [unpack(b, "u8", "i8", "u4", "u8", "u1", "u4" if bits <= 32 else "u8", "u2", "u4", "u1", "u2", "i8") for b in blobs]
    counts = np.array([len(p[0]) for p in parts])
    shift = np.concatenate(([0], np.cumsum(counts)))[:-1]
    ids, keys, size, home = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 2, 4))
    maps = Maps(np.concatenate([p[3] for p in parts]), size.astype(np.int64))
    token = np.concatenate([np.cumsum(p[5].astype(np.uint64)).astype(np.uint64) for p in parts])
    rec = np.concatenate([p[6].astype(np.int64) + s for p, s in zip(parts, shift)])
    place = np.concatenate([p[7] for p in parts]).astype(np.int64)
    side = np.concatenate([p[8] for p in parts])
    copy_of = np.concatenate([p[9].astype(np.int64) + s for p, s in zip(parts, shift)])
    copy = np.concatenate([p[10] for p in parts])
    del parts
    # classes: equal ids; the smallest key stands for them
    order = np.lexsort((keys, ids))
    lead = np.ones(len(ids), dtype=bool)
    lead[1:] = ids[order][1:] != ids[order][:-1]
    leader = np.empty(len(ids), dtype=np.int64)
    leader[order] = order[lead][np.cumsum(lead) - 1]
    own = np.flatnonzero((home == 1) & (leader != np.arange(len(ids))))
    members = np.stack((np.concatenate((keys[leader[own]], keys[leader[copy_of]])), np.concatenate((keys[own], copy))), axis=1)
    rec = leader[rec]
    size = size.astype(np.int64)
    _, index = prefix_lengths(size, t)
    if bits > 32:  # numbered, to fit beside a size
        token = np.unique(token, return_inverse=True)[1].astype(np.uint64)
    merged = (token << np.uint64(32)) | size[rec].astype(np.uint64)
    order = np.lexsort((side, rec, merged))
    merged, rec, place, side = merged[order], rec[order], place[order], side[order]
    fresh = np.ones(len(rec), dtype=bool)
    fresh[1:] = (merged[1:] != merged[:-1]) | (rec[1:] != rec[:-1]) | (side[1:] != side[:-1])
    merged, rec, place, side = merged[fresh], rec[fresh], place[fresh], side[fresh]
    s = size[rec]
    most = (merged & ~np.uint64(0xFFFFFFFF)) | np.minimum(np.floor(s / t + 1e-9), 0xFFFFFFFF).astype(np.uint64)
    at = np.arange(len(rec))
    many = np.where(place < index[rec], np.searchsorted(merged, most, side="right") - at - 1, 0)
    total = np.concatenate(([0], np.cumsum(many)))
    found, begin = [], 0
    while begin < len(rec):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + CHUNK, side="right")) - 1)
        for lo in range(0, int(many[begin]), CHUNK) if end == begin + 1 else (0,):
            if end == begin + 1:  # a posting alone may have more partners than a chunk
                j = np.arange(begin + 1 + lo, begin + 1 + min(lo + CHUNK, int(many[begin])))
                i = np.full(len(j), begin)
            else:
                m = many[begin:end]
                i = np.repeat(at[begin:end], m)
                j = np.arange(len(i)) - np.repeat(total[begin:end] - total[begin], m) + i + 1
            si, sj = s[i], s[j]
            least = np.ceil(t / (1 + t) * (si + sj) - 1e-9) - 1
            ok = np.minimum(si - place[i], sj - place[j]) >= least
            ok &= (side[i] == 0) | (side[i] != side[j])
            i, j, least = rec[i[ok]], rec[j[ok]], least[ok]
            ok = (size[i] + size[j] - maps.apart(i, j)) >= 2 * least
            found.append(np.unique(np.stack((keys[i[ok]], keys[j[ok]]), axis=1), axis=0))
        begin = end
    pairs = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)
    pairs = np.unique(np.sort(pairs, axis=1), axis=0)
    return pairs, members


def candidates(df: DataFrame, key: str, text: str, *, threshold: float = 0.7, n: int = 5, min_words: int = 60, buckets: int | None = None) -> DataFrame:
    """kind 0: pairs a < b of class representatives that may be similar; kind 1: a is the representative, b a copy.

    A bucket is a share of the runs, about ENTRIES prefix entries whatever the input, and is held by one task. Where there
    are many, the prefixes are kept and dealt out in rounds, so that the disk holds one round's postings; each round's
    shuffle files go when its pairs are found.
    """
    base = spread(df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull() & (F.length("text") >= 2 * min_words - 1) & F.col("key").isNotNull()))
    chars = float(base.agg(F.sum(F.length("text"))).first()[0] or 0)
    bits = token_bits(chars)
    counts = sketch(base.select("text"), n, sketch_bits(chars))
    if buckets is None:
        # about a third of the runs are in prefixes; at least a bucket a core
        cores = df.sparkSession.sparkContext.defaultParallelism
        buckets = max(cores, math.ceil(0.31 * chars / 6 / ENTRIES))
    shared = df.sparkSession.sparkContext.broadcast(counts)

    as_rows = lambda rows, first: pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] - first for r in rows], pa.int32()), "blob": pa.array([r[1] for r in rows], pa.large_binary())})

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                b = batch.slice(lo, SLICE)
                rows = list(_postings(b.column(0).to_numpy(), b.column(1).to_pylist(), n, threshold, min_words, shared.value, buckets, bits))
                if rows:
                    yield as_rows(rows, 0)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                b = batch.slice(lo, SLICE)
                prefixes = _prefixes(b.column(0).to_numpy(), b.column(1).to_pylist(), n, threshold, min_words, shared.value, bits)
                if prefixes is not None:
                    yield pa.RecordBatch.from_pydict({"blob": pa.array([prefixes], pa.large_binary())})

    def deal(wanted: tuple[int, int]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in batch.column(0):
                    rows = list(_dealt(x.as_py(), shared.value, buckets, bits, wanted))
                    if rows:
                        yield as_rows(rows, wanted[0])

        return run

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[bytes]] = {}
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(k, []).append(blob)
        for k in list(by):
            pairs, members = _meet(by.pop(k), threshold, bits)
            for kind, x in ((0, pairs), (1, members)):
                for at in range(0, len(x), 100_000):
                    y = x[at : at + 100_000]
                    yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(y), kind), pa.int32()), "a": pa.array(y[:, 0], pa.int64()), "b": pa.array(y[:, 1], pa.int64())})

    # the buckets are the partitions
    met = lambda posted, many: posted.repartitionById(many, F.col("bucket")).mapInArrow(meet, "kind int, a bigint, b bigint")
    step = min(ROUND, max(FEWEST, -(-buckets // ROUNDS)))
    if buckets <= step:
        return met(base.mapInArrow(post, "bucket int, blob binary"), buckets)
    kept, out = checkpointed(base.mapInArrow(keep, "blob binary")), None
    for lo in range(0, buckets, step):
        wanted = lo, min(lo + step, buckets)
        with passing_shuffles(df.sparkSession):
            one = checkpointed(met(kept.mapInArrow(deal(wanted), "bucket int, blob binary"), wanted[1] - lo))
        out = one if out is None else out.unionByName(one)
    return out


def verified(pairs: DataFrame, df: DataFrame, key: str, text: str, *, threshold: float = 0.7, n: int = 5) -> DataFrame:
    """a, b, similarity of the pairs that reach the threshold, each worked out once from the two texts."""
    base = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    left = base.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    right = base.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(lo, SLICE) for x in batches for lo in range(0, x.num_rows, SLICE)):
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keys, first = np.unique(np.concatenate((a, b)), return_index=True)
            ta, tb = batch.column(2), batch.column(3)
            texts = [(ta[int(k)] if k < len(a) else tb[int(k) - len(a)]).as_py() for k in first]
            h, bounds, _ = runs(texts, n)
            h, bounds = flat.distinct_in_text(h, bounds)
            ia, ib = np.searchsorted(keys, a), np.searchsorted(keys, b)
            size = np.diff(bounds)
            common = np.empty(len(a), dtype=np.int64)
            for lo in range(0, len(a), 2000):
                x, y = ia[lo : lo + 2000], ib[lo : lo + 2000]
                no = np.concatenate((np.repeat(np.arange(len(x)), size[x]), np.repeat(np.arange(len(y)), size[y])))
                at = np.concatenate([np.arange(bounds[k], bounds[k + 1]) for k in x] + [np.arange(bounds[k], bounds[k + 1]) for k in y])
                v = h[at]
                order = np.lexsort((v, no))
                v, no = v[order], no[order]
                same = (v[1:] == v[:-1]) & (no[1:] == no[:-1])
                common[lo : lo + 2000] = np.bincount(no[1:][same], minlength=len(x))[: len(x)]
            union = size[ia] + size[ib] - common
            similar = np.where(union > 0, common / np.maximum(union, 1), 0.0)
            ok = common >= np.ceil(threshold * union - 1e-9)
            ok &= union > 0
            yield pa.RecordBatch.from_pydict({"a": pa.array(a[ok]), "b": pa.array(b[ok]), "similarity": pa.array(similar[ok])})

    return joined.mapInArrow(check, "a bigint, b bigint, similarity double")


def similar_classes(df: DataFrame, key: str, text: str, **options) -> tuple[DataFrame, DataFrame]:
    """(links, copies): links a < b between class representatives with their similarity; copies (a, b) of a class.

    Null keys or texts, and texts of fewer than min_words words, are in no class and no link. Repeated rows with one
    key count once. Words are what blanks, tabs, carriage returns and line feeds separate, in lower case.
    """
    met = checkpointed(candidates(df, key, text, **options))
    pairs = met.where("kind = 0").select("a", "b").distinct()
    wanted = {k: v for k, v in options.items() if k in ("threshold", "n")}
    links = verified(pairs, df, key, text, **wanted)
    return links, met.where("kind = 1 and a <> b").select("a", "b").distinct()


def similar_pairs(df: DataFrame, key: str, text: str, **options) -> DataFrame:
    """key_a < key_b: all pairs of similar records, those between copies of the linked classes included.

    A class is cut into blocks of about BLOCK members, and blocks meet, so that no task gets all pairs of a large one.
    """
    links, copies = similar_classes(df, key, text, **options)
    links = checkpointed(links)
    # members of each class that has copies; links between classes without copies need no join
    classes = checkpointed(copies.select(F.col("a").alias("rep"), F.col("b").alias("key")))
    # classes of more than one block: a table of n rows has at most n / BLOCK of them
    large = checkpointed(classes.groupBy("rep").agg(F.ceil((F.count("*") + 1) / BLOCK).cast("int").alias("n")).where("n > 1"))
    salts = 64
    salted = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    whole = classes.unionByName(classes.select("rep", F.col("rep").alias("key")).distinct()).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int"))
    # the members' blocks; the salt spreads the members of a large class over the join
    blocks = F.coalesce("n", F.lit(1))
    whole = checkpointed(whole.join(salted, ["rep", "salt"], "left").select("rep", "key", blocks.alias("n"), F.pmod(F.xxhash64("key", "rep"), blocks).cast("int").alias("block")))
    met = whole.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("rep", "key", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    x, y = met.where("block = lo").alias("x"), met.where("block = hi").alias("y")
    one = (F.col("x.lo") < F.col("x.hi")) | (F.col("x.key") < F.col("y.key"))
    within = x.join(y, (F.col("x.rep") == F.col("y.rep")) & (F.col("x.lo") == F.col("y.lo")) & (F.col("x.hi") == F.col("y.hi")) & one)
    within = within.select(F.least("x.key", "y.key").alias("key_a"), F.greatest("x.key", "y.key").alias("key_b"))
    both = links.select("a", "b")
    for s in "ab":
        n = large.select(F.col("rep").alias(s), "n")
        both = both.join(n, s, "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1))).drop("n")
        own = whole.select(F.col("rep").alias(s), "block", F.col("key").alias(f"k{s}"))
        both = both.join(own, [s, "block"], "left").withColumn(f"k{s}", F.coalesce(f"k{s}", s)).drop("block")
    across = both.select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))
    return across.unionByName(within)


def groups(df: DataFrame, key: str, text: str, **options) -> DataFrame:
    """key, class_id, n_links: the connected groups of similar records, named by their smallest key.

    One row for each record that has a partner; n_links counts the links of its class representative to other classes
    plus the copies in its class.
    """
    from ..operators.components import connected_components

    links, copies = similar_classes(df, key, text, **options)
    links, copies = checkpointed(links.select("a", "b")), checkpointed(copies)
    comp = connected_components(links.unionByName(copies), "a", "b")
    ends = links.select(F.col("a").alias("key")).unionByName(links.select(F.col("b").alias("key"))).groupBy("key").agg(F.count("*").alias("links"))
    size = copies.groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("copies"))
    rep = copies.select(F.col("b").alias("key"), F.col("a").alias("rep"))
    return (
        comp.select(F.col("node").alias("key"), F.col("component").alias("class_id"))
        .join(rep, "key", "left").withColumn("rep", F.coalesce("rep", "key"))
        .join(ends.withColumnRenamed("key", "rep"), "rep", "left").join(size, "rep", "left")
        .select("key", "class_id", (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(0))).alias("n_links"))
    )
