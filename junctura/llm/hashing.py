"""Words of many texts at once: where they stand, and 64-bit hashes of them.

A hash takes eight bytes of a word at a time through the rounds of XXH64 (its multipliers are fixed values), so words that
differ anywhere differ in their hash but for chance. Who must be sure compares bytes with equal().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: White space between words.
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], "u8")
#: Bytes of text that are looked at at once.
STEP = 1 << 19
#: Bytes from which on a word is hashed by the library, one by one.
LONG = 256


class Blocks:
    """Eight bytes from any place of a buffer, as little-endian numbers; zeros follow its end."""

    def __init__(self, buf: bytes | np.ndarray):
        """An array is taken as it is: eight bytes at least must follow what is asked for."""
        self.words = buf.view("<u8") if isinstance(buf, np.ndarray) else np.frombuffer(buf + bytes(16 - len(buf) % 8), "<u8")

    def at(self, places: np.ndarray) -> np.ndarray:
        k = places >> 3
        shift = ((places & 7) << 3).astype("u8")
        # two shifts, as one by 64 has no defined result
        return (self.words[k] >> shift) | (self.words[k + 1] << np.uint64(1) << (np.uint64(63) - shift))


def mix(x: np.ndarray, by: int) -> np.ndarray:
    """A second hash of hashes."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(by)
    return x ^ (x >> np.uint64(29))


def _rotated(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _round(h: np.ndarray, block: np.ndarray) -> np.ndarray:
    return _rotated(h ^ (_rotated(block * _P2, 31) * _P1), 27) * _P1 + _P4


def hashes(buf: bytes, blocks: Blocks, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the parts of a buffer."""
    size = ends - starts
    with np.errstate(over="ignore"):
        h = _round(size.astype("u8") + _P5, blocks.at(starts) & _MASKS[np.minimum(size, 8)])
        some, done = np.flatnonzero((size > 8) & (size < LONG)), 8
        while len(some):
            h[some] = _round(h[some], blocks.at(starts[some] + done) & _MASKS[np.minimum(size[some] - done, 8)])
            done += 8
            some = some[size[some] > done]
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
    for k in np.flatnonzero(size >= LONG).tolist():
        h[k] = xxhash.xxh64_intdigest(buf[starts[k] : ends[k]])
    return h ^ (h >> np.uint64(32))


def equal(a: Blocks, a_starts: np.ndarray, b: Blocks, b_starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether parts of two buffers, of equal sizes, are equal byte by byte."""
    same = (a.at(a_starts) ^ b.at(b_starts)) & _MASKS[np.minimum(size, 8)] == 0
    some, done = np.flatnonzero((size > 8) & same), 8
    while len(some):
        if done > LONG:  # the few long ones that are left, each at a stroke
            for k in some.tolist():
                n = int(size[k])
                same[k] = bool((a.words.view("u1")[a_starts[k] : a_starts[k] + n] == b.words.view("u1")[b_starts[k] : b_starts[k] + n]).all())
            break
        off = (a.at(a_starts[some] + done) ^ b.at(b_starts[some] + done)) & _MASKS[np.minimum(size[some] - done, 8)] != 0
        same[some[off]] = False
        done += 8
        some = some[~off & (size[some] > done)]
    return same


def spans(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of bytes."""
    edges = np.diff(np.concatenate([[True], BLANK[a], [True]]).view("i1"))
    return np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)


def pieces(texts: pa.Array, step: int | None = None) -> Iterator[tuple[bytes, int, np.ndarray, int]]:
    """Buffers of about ``step`` bytes that hold all texts (no nulls) of an array, a line feed between two texts.

    Gives the buffer, the row of its first text, the places where its texts begin, and the number of lines of that first text
    that earlier buffers held: a longer text is cut at line feeds, so only a single line is never divided.
    """
    step = step or STEP
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
    a = 0
    while a < len(texts):
        e = max(a + 1, int(np.searchsorted(offsets, offsets[a] + step, side="right")) - 1)
        if e > a + 1 or offsets[e] - offsets[a] <= step:
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, e - a], "i4"), texts[a:e].cast(pa.binary())), pa.scalar(b"\n", pa.binary()))
            yield joined[0].as_py(), a, offsets[a:e] - offsets[a] + np.arange(e - a), 0
        else:
            text, at, line = texts[a].as_py(), 0, 0
            while at < len(text):
                cut = text.rfind(b"\n", at, at + step)
                cut = cut if cut >= 0 else text.find(b"\n", at + step)
                part = text[at : cut if cut >= 0 else len(text)]
                yield part, a, np.zeros(1, "i8"), line
                at, line = at + len(part) + 1, line + part.count(b"\n") + 1
        a = e


def words(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a buffer, and where they start."""
    starts, ends = spans(np.frombuffer(buf, "u1"))
    return hashes(buf, Blocks(buf), starts, ends), starts
