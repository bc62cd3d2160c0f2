"""Vectorised text kernels over Arrow batches: word spans and hashes without a Python loop per word.

A span hash is a polynomial over its symbols modulo 2**64, taken from one running sum for the whole batch
(prefix difference times the inverse power at its start) and then mixed. Two bases give 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Bytes that separate words: space and U+0009 to U+000D.
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of alphanumeric words: ASCII letters and digits and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Lower-cases A to Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base = _BASES[which]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, U64(b))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if size <= 1 << 23:
            _POWERS[which] = have
    return have


def running(symbols: np.ndarray, which: int) -> np.ndarray:
    """Prefix sums that :func:`spans_of` reads."""
    pw, _ = _powers(which, len(symbols) + 1)
    acc = np.zeros(len(symbols) + 1, U64)
    np.cumsum((symbols.astype(U64) + U64(1)) * pw[: len(symbols)], out=acc[1:])
    return acc


def spans_of(acc: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """Hash of each span [start, end) of the symbols behind ``acc``."""
    _, inverse = _powers(which, len(acc))
    return mix((acc[ends] - acc[starts]) * inverse[starts] + (ends - starts).astype(U64) * U64(0x2545F4914F6CDD1D))


#: Bytes of text whose arrays are held at a time; longer texts are cut between words.
CHUNK_BYTES = 1 << 22


def _chunks(buf: np.ndarray, is_word: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of about ``CHUNK_BYTES`` that end where no word goes on."""
    lo = 0
    while lo < len(buf):
        hi = min(len(buf), lo + CHUNK_BYTES)
        while hi < len(buf):
            blank = np.flatnonzero(~is_word[buf[hi - 1 : hi + CHUNK_BYTES]])
            if len(blank):
                hi += int(blank[0])
                break
            hi = min(len(buf), hi + CHUNK_BYTES)
        yield lo, hi
        lo = hi


def word_spans(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text number of every maximal run of word bytes; a run never crosses two texts."""
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in _chunks(buf, is_word):
        n = hi - lo
        w = is_word[buf[lo:hi]]
        first = np.zeros(n + 1, bool)
        first[offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, side="right")] - lo] = True
        opens = w.copy()
        opens[1:] &= ~w[:-1] | first[1:n]
        closes = w
        closes = closes.copy()
        closes[:-1] &= ~w[1:] | first[1:n]
        starts.append(np.flatnonzero(opens) + lo)
        ends.append(np.flatnonzero(closes) + (lo + 1))
    begin = np.concatenate(starts)
    return begin, np.concatenate(ends), np.searchsorted(offsets, begin, side="right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """Hash of each word; the arrays behind them cover ``CHUNK_BYTES`` at a time (or one longer word)."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK_BYTES, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        out[i:j] = spans_of(running(buf[lo:hi], which), starts[i:j] - lo, ends[i:j] - lo, which)
        i = j
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into pieces of about ``most`` bytes of text, whole rows each: piece, bytes, offsets."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        at = batch.schema.get_field_index(column)
        text = batch.column(at).cast(pa.large_binary())
        sizes = np.asarray(pc.fill_null(pc.binary_length(text), 0), dtype=np.int64)
        piece = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            part = text.slice(lo, hi - lo)
            offsets = np.concatenate([[0], np.cumsum(sizes[lo:hi])])
            if part.null_count:
                part = pc.fill_null(part, b"")
            raw = np.frombuffer(part.buffers()[2] or b"", np.uint8)
            begin = np.frombuffer(part.buffers()[1], np.int64)[part.offset] if len(part) else 0
            yield batch.slice(lo, hi - lo), raw[begin : begin + offsets[-1]], offsets
