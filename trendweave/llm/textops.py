"""Vectorised numpy helpers over the byte buffers of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE_BYTES = (9, 10, 11, 12, 13, 32)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE_BYTES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, in place where x is a fresh array."""
    x ^= x >> np.uint64(30)
    x *= MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(1, n), np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; nulls count as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose bytes come to about ``most``; a longer row is a run of its own."""
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and for each document the index of its first word (n+1 values)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


SHORT = 4096


def _hash_short(padded: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of spans of at most SHORT bytes, eight bytes at a time; padded has eight bytes more than the spans need."""
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    h = lengths.astype(np.uint64) * STEP
    live = np.arange(len(starts))
    at, left = starts, lengths
    while len(live):
        piece = eight[at]
        part = left < 8
        piece[part] &= (np.uint64(1) << (left[part].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        h[live] = mix64((h[live] ^ piece) * STEP)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


def _hash_long(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """Polynomial hash of long spans, in pieces of bounded size."""
    out = np.zeros(len(starts), np.uint64)
    base = int(STEP) | 1
    table = powers(base, min(piece, int(lengths.max())))
    for i, (s, n) in enumerate(zip(starts, lengths, strict=True)):
        h = np.uint64(int(n) * int(STEP) & 0xFFFFFFFFFFFFFFFF)
        for k in range(0, int(n), piece):
            part = BYTE_CODE[raw[s + k : s + min(k + piece, n)]]
            h = mix64(np.array([h ^ (part * table[: len(part)]).sum(dtype=np.uint64)], np.uint64))[0]
        out[i] = h
    return out


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span raw[start:end]."""
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    lengths = ends - starts
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    short = lengths <= SHORT
    if short.all():
        return _hash_short(padded, starts, lengths)
    out[short] = _hash_short(padded, starts[short], lengths[short])
    out[~short] = _hash_long(raw, starts[~short], lengths[~short])
    return out


def repeats(keys: np.ndarray) -> np.ndarray:
    """True at each key that occurs more than once."""
    bits = max(8, len(keys).bit_length() + 2)
    cell = (keys >> np.uint64(64 - bits)).astype(np.int64)
    maybe = np.flatnonzero(np.bincount(cell, minlength=1 << bits)[cell] > 1)
    order = maybe[np.argsort(keys[maybe])]
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def byte_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per document, how often each byte occurs (n x 256)."""
    out = np.zeros((len(offsets) - 1, 256), np.int64)
    for i in range(len(out)):
        if offsets[i + 1] > offsets[i]:
            out[i] = np.bincount(raw[offsets[i] : offsets[i + 1]], minlength=256)
    return out


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int, whole_short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word windows and the document of each; whole_short: a shorter, non-empty document is one window."""
    n_docs = len(first) - 1
    counts = np.diff(first)
    n = np.maximum(counts - width + 1, 0)
    weight = powers(0xD1342543DE82EF95, width) * np.uint64(0xA0761D6478BD642F) | np.uint64(1)
    doc = np.repeat(np.arange(n_docs), n)
    start = np.repeat(first[:-1], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    h = np.zeros(len(start), np.uint64)
    for k in range(width):
        h += words[start + k] * weight[k]
    h = mix64(h)
    if whole_short:
        short = np.flatnonzero((counts > 0) & (counts < width))
        extra = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            extra[has] += words[first[short[has]] + k] * weight[k]
        extra = mix64(extra ^ (counts[short].astype(np.uint64) * STEP))
        h, doc = np.concatenate([h, extra]), np.concatenate([doc, short])
    return h, doc


def code_points(raw: np.ndarray) -> np.ndarray:
    """True at each byte that begins a code point."""
    return (raw & 0xC0) != 0x80
