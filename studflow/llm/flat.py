"""Flat numpy views of many texts at once, the base of the text kernels.

All functions take the texts of one Arrow batch, lay their code points end to end and work on the whole
array, so that no Python code runs once a character or once a word.
"""

from __future__ import annotations

import sys

import numpy as np
import zstandard

U = np.uint64
#: Odd multipliers of the polynomial hashes (64-bit golden ratio and two more splitmix constants).
MULT = U(0x9E3779B97F4A7C15)
MIX_A, MIX_B = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: every bit of the result depends on every bit of h."""
    h = (h ^ (h >> U(30))) * MIX_A
    h = (h ^ (h >> U(27))) * MIX_B
    return h ^ (h >> U(31))


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one separator (line feed) after each, and where each text starts."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=starts[1:])
    joined = "\n".join(texts) + "\n" if texts else ""
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), starts


def table(chars: str) -> np.ndarray:
    """A lookup table by code point that is true for these characters."""
    t = np.zeros(sys.maxunicode + 1, dtype=bool)
    t[[ord(c) for c in chars]] = True
    return t


BLANKS = table(" \t\r\n")


def word_hashes(cp: np.ndarray, starts: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words are the longest runs of code points that aren't separators.

    Gives each word's hash, the index of its first code point, the index behind its last one, and for each text
    the number of its first word (one entry more than texts).
    """
    if not len(cp):
        none = np.zeros(0, dtype=np.int64)
        return none.astype(U), none, none, np.zeros(len(starts), dtype=np.int64)
    inside = ~separator[cp]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    first, behind = edge[0::2], edge[1::2]
    if not len(first):
        return np.zeros(0, dtype=U), first, behind, np.zeros(len(starts), dtype=np.int64)
    size = behind - first
    # position in the word, for the word's code points only
    at = np.flatnonzero(inside)
    offset = np.zeros(len(first), dtype=np.int64)
    np.cumsum(size[:-1], out=offset[1:])
    place = np.arange(len(at), dtype=np.int64) - np.repeat(offset, size)
    power = np.ones(int(size.max()) + 1, dtype=U)
    np.multiply.accumulate(np.concatenate((power[:1], np.full(len(power) - 1, MULT))), out=power)
    value = (cp[at].astype(U) + U(1)) * power[place]
    h = mix(np.add.reduceat(value, offset) + size.astype(U))
    return h, first, behind, np.searchsorted(first, starts)


def runs_of(words: np.ndarray, of_text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words in a row within a text, and for each text its first run (one entry more)."""
    counts = np.maximum(np.diff(of_text) - (n - 1), 0)
    bounds = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=bounds[1:])
    total = int(bounds[-1])
    if not total:
        return np.zeros(0, dtype=U), bounds
    start = np.arange(total, dtype=np.int64) + np.repeat(of_text[:-1] - bounds[:-1], counts)
    h = words[start].copy()
    for k in range(1, n):
        h *= MULT
        h += words[start + k]
    return mix(h), bounds


def distinct_in_text(h: np.ndarray, bounds: np.ndarray, bits: int = 44) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text (their first bits), ascending, and the new bounds; up to 2^(64-bits) texts."""
    text = np.repeat(np.arange(len(bounds) - 1, dtype=U), np.diff(bounds))
    both = np.sort((text << U(bits)) | (h >> U(64 - bits)))
    both = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both
    return both & U((1 << bits) - 1), np.searchsorted(both >> U(bits), np.arange(len(bounds), dtype=U))


def pack(**arrays: np.ndarray) -> bytes:
    out = []
    for a in arrays.values():
        b = zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())
        out.append(len(b).to_bytes(4, "little") + b)
    return b"".join(out)


def unpack(blob: bytes, *dtypes: str) -> list[np.ndarray]:
    out, at = [], 0
    for d in dtypes:
        n = int.from_bytes(blob[at : at + 4], "little")
        out.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[at + 4 : at + 4 + n]), dtype=d))
        at += 4 + n
    return out
