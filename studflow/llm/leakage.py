"""Problem 8: evaluation texts that leaked into training texts, by winnowing.

Of every window of WINDOW pieces of GRAM words the smallest hash is kept, so that two texts that share RUN words in a
row keep a common fingerprint. The documents' fingerprints are joined with the items' (held by each task where there
are few of them, shuffled otherwise), and each hit is extended to both sides.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import spread
from . import flat
from .flat import U

RUN, GRAM = 13, 7
WINDOW = RUN - GRAM + 1
#: Up to so many words of items are held by each task (8 bytes each, and as much for their fingerprints).
HELD_WORDS = 4_000_000
#: Parts that a fingerprint's documents are spread over where items are shuffled.
SALTS = 16


@functools.cache
def separators() -> np.ndarray:
    """True for all but letters and digits."""
    return np.fromiter((not chr(i).isalnum() for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (longest runs of letters and digits, in lower case), and each text's first (one more)."""
    cp, starts = flat.codepoints([t.replace("İ", "i").lower() for t in texts])
    h, _, _, of_text = flat.word_hashes(cp, starts, separators())
    return h, of_text


def fingerprints(h: np.ndarray, of_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, index of the first word) of the kept pieces; texts of fewer than RUN words keep none."""
    grams, bounds = flat.runs_of(h, of_text, GRAM)
    none = np.zeros(0, dtype=np.int64)
    if len(grams) < WINDOW:
        return none.astype(U), none, none
    low = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    # the last of equal ones
    at = np.arange(len(low)) + WINDOW - 1 - low[:, ::-1].argmin(axis=1)
    text = np.searchsorted(bounds, np.arange(len(low)), side="right") - 1
    inside = np.arange(len(low)) + WINDOW <= bounds[text + 1]
    keep = np.unique(at[inside])
    text = np.searchsorted(bounds, keep, side="right") - 1
    return grams[keep], text, of_text[text] + keep - bounds[text]


def extended(a: np.ndarray, i: int, b: np.ndarray, j: int) -> int:
    """Words in a row that a and b share around a[i] == b[j]."""
    n = min(len(a) - i, len(b) - j)
    off = np.flatnonzero(a[i : i + n] != b[j : j + n])
    right = int(off[0]) if len(off) else n
    n = min(i, j)
    off = np.flatnonzero(a[i - n : i][::-1] != b[j - n : j][::-1])
    return right + (int(off[0]) if len(off) else n)


class Items:
    """The items' words and fingerprints, by hash."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids, (self.h, self.of_text) = ids, words(texts)
        f, text, at = fingerprints(self.h, self.of_text)
        order = np.argsort(f, kind="stable")
        self.f, self.text, self.at = f[order], text[order], at[order]

    def leaks(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, item, words) of all that share RUN words; words is the longest run that a hit extends to."""
        h, of_text = words(texts)
        f, text, at = fingerprints(h, of_text)
        lo, hi = np.searchsorted(self.f, f, side="left"), np.searchsorted(self.f, f, side="right")
        best: dict[tuple[int, int], int] = {}
        for k in np.flatnonzero(hi > lo):
            t = int(text[k])
            a = h[of_text[t] : of_text[t + 1]]
            for m in range(lo[k], hi[k]):
                i = int(self.text[m])
                first = self.of_text[i]
                n = extended(a, int(at[k] - of_text[t]), self.h[first : self.of_text[i + 1]], int(self.at[m] - first))
                if n >= RUN and n > best.get((t, i), 0):
                    best[t, i] = n
        return [(t, i, n) for (t, i), n in best.items()]


def _held(docs: DataFrame, items: DataFrame, kinds: tuple[str, str]) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in items.toLocalIterator()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = Items([i for i, _ in held.value], [t for _, t in held.value])
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                got = all_.leaks(part.column(1).to_pylist())
                keys = part.column(0).take(pa.array([t for t, _, _ in got], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([all_.ids[i] for _, i, _ in got], b.schema.field(2).type), keys, pa.array([n for _, _, n in got], pa.int32())], names=["item_id", "doc_id", "n_words"])

    typed = docs.withColumn("i", F.lit(None).cast(kinds[0]))  # gives the item key's Arrow type
    return spread(typed).mapInArrow(run, f"item_id {kinds[0]}, doc_id {kinds[1]}, n_words int")


def _shuffled(docs: DataFrame, items: DataFrame, kinds: tuple[str, str]) -> DataFrame:
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, text, _ = fingerprints(*words(b.column(1).to_pylist()))
            both = np.unique(np.stack((f.view(np.int64), text), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(both[:, 1])), pa.array(both[:, 0])], names=["k", "f"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, most = [], []
            for k, (a, t) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                for _, _, n in Items([0], [a]).leaks([t]):
                    keep.append(k)
                    most.append(n)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(most, pa.int32())], names=["item_id", "doc_id", "n_words"])

    # a print of many documents (a boilerplate) is spread over salts, and the items' side, which is small, repeated for each
    left = spread(docs).mapInArrow(prints, f"k {kinds[1]}, f bigint").select(F.col("k").alias("doc_id"), "f", F.pmod(F.xxhash64("k"), F.lit(SALTS)).cast("int").alias("salt"))
    right = spread(items).mapInArrow(prints, f"k {kinds[0]}, f bigint").select(F.col("k").alias("item_id"), "f", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs = left.join(right, ["f", "salt"]).select("item_id", "doc_id").distinct()
    texts = pairs.join(items.select(F.col("item").alias("item_id"), F.col("text").alias("a")), "item_id").join(docs.select(F.col("doc").alias("doc_id"), F.col("text").alias("t")), "doc_id")
    return texts.select("item_id", "doc_id", "a", "t").mapInArrow(extend, f"item_id {kinds[0]}, doc_id {kinds[1]}, n_words int")


def leaks(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text, item, words) of all that share RUN words; words is the longest run that a hit extends to."""
        h, of_text = words(texts)
        f, text, at = fingerprints(h, of_text)
        lo, hi = np.searchsorted(self.f, f, side="left"), np.searchsorted(self.f, f, side="right")
        best: dict[tuple[int, int], int] = {}
        for k in np.flatnonzero(hi > lo):
            t = int(text[k])
            a = h[of_text[t] : of_text[t + 1]]
            for m in range(lo[k], hi[k]):
                i = int(self.text[m])
                first = self.of_text[i]
                n = extended(a, int(at[k] - of_text[t]), self.h[first : self.of_text[i + 1]], int(self.at[m] - first))
                if n >= RUN and n > best.get((t, i), 0):
                    best[t, i] = n
        return [(t, i, n) for (t, i), n in best.items()]


def _held(docs: DataFrame, items: DataFrame, kinds: tuple[str, str]) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in items.toLocalIterator()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = Items([i for i, _ in held.value], [t for _, t in held.value])
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                got = all_.leaks(part.column(1).to_pylist())
                keys = part.column(0).take(pa.array([t for t, _, _ in got], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([all_.ids[i] for _, i, _ in got], b.schema.field(2).type), keys, pa.array([n for _, _, n in got], pa.int32())], names=["item_id", "doc_id", "n_words"])

    typed = docs.withColumn("i", F.lit(None).cast(kinds[0]))  # gives the item key's Arrow type
    return spread(typed).mapInArrow(run, f"item_id {kinds[0]}, doc_id {kinds[1]}, n_words int")


def _shuffled(docs: DataFrame, items: DataFrame, kinds: tuple[str, str]) -> DataFrame:
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, text, _ = fingerprints(*words(b.column(1).to_pylist()))
            both = np.unique(np.stack((f.view(np.int64), text), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(both[:, 1])), pa.array(both[:, 0])], names=["k", "f"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, most = [], []
            for k, (a, t) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                for _, _, n in Items([0], [a]).leaks([t]):
                    keep.append(k)
                    most.append(n)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(most, pa.int32())], names=["item_id", "doc_id", "n_words"])

    left = spread(docs).mapInArrow(prints, f"k {kinds[1]}, f bigint").select(F.col("k").alias("doc_id"), "f")
    right = spread(items).mapInArrow(prints, f"k {kinds[0]}, f bigint").select(F.col("k").alias("item_id"), "f")
    pairs = left.join(right, "f").select("item_id", "doc_id").distinct()
    texts = pairs.join(items.select(F.col("item").alias("item_id"), F.col("text").alias("a")), "item_id").join(docs.select(F.col("doc").alias("doc_id"), F.col("text").alias("t")), "doc_id")
    return texts.select("item_id", "doc_id", "a", "t").mapInArrow(extend, f"item_id {kinds[0]}, doc_id {kinds[1]}, n_words int")


def leaks(documents: DataFrame, eval_items: DataFrame, *, doc: str = "doc_id", item: str = "item_id", text: str = "text", held_words: int = HELD_WORDS) -> DataFrame:
    """item_id, doc_id, n_words: each item and document that share at least RUN words in a row, and the most.

    Null keys or texts take no part; rows with one key count as one. Whichever way the items are brought to the
    documents, the result is the same.
    """
    docs = documents.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    items = eval_items.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).alias("item"), F.col(text).alias("text"))
    kinds = items.schema["item"].dataType.simpleString(), docs.schema["doc"].dataType.simpleString()
    # a word has at least one character and one separator
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    found = (_held if size / 2 <= held_words else _shuffled)(docs, items, kinds)
    return found.groupBy("item_id", "doc_id").agg(F.max("n_words").alias("n_words"))


def by_document(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.max("n_words").alias("n_words"))


def by_item(found: DataFrame) -> DataFrame:
    return found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("n_words").alias("n_words"))
