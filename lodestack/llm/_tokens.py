"""Vectorised words of whole texts: 64-bit word hashes and document offsets, in numpy.

A word is a maximal run of alphanumeric characters or underscores of the lower-cased text. Its hash
is a polynomial in its code points modulo 2**64, mixed; hashes are the same on every machine. Texts are
worked on in pieces of bounded size, however long one of them is; pieces end between words.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np

#: Characters worked on at once. A single run (a word without an end) of more counts as runs of so many characters.
PIECE = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CP = "utf-32-le" if sys.byteorder == "little" else "utf-32-be"


@functools.lru_cache(1)
def _word_table() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() or c == 95 for c in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(_CP, "surrogatepass"), np.uint32)


@functools.lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for one piece: tables of one fixed size."""
    with np.errstate(over="ignore"):
        a, b = np.full(PIECE, _BASE), np.full(PIECE, _BASE_INV)
        a[0] = b[0] = 1
        return np.multiply.accumulate(a), np.multiply.accumulate(b)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def run_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run cp[start:end] of one piece."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers()
    sums = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * up[: len(cp)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def pieces(text: str, inside: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(start, code points) of consecutive pieces of at most PIECE characters.

    A piece ends behind the last character that is not `inside` (a table by code point) a run; where a run is
    longer than a piece, it is cut into pieces from its own start, so cuts do not depend on what stands before.
    """
    lo, n = 0, len(text)
    while lo < n:
        cp = code_points(text[lo : lo + PIECE])
        if lo + PIECE < n:
            for tail in (1 << 12, PIECE):
                out = np.flatnonzero(~inside[cp[-tail:]])
                if len(out):
                    cp = cp[: max(0, len(cp) - tail) + int(out[-1]) + 1]
                    break
        yield lo, cp
        lo += len(cp)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edge = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


def joined(texts: list[str]) -> tuple[str, np.ndarray]:
    """All texts, each with a line break behind it, and the end of each."""
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return "\n".join(texts) + "\n" if texts else "", ends


def words(texts: list[str], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and offsets: words of text i are hashes[offsets[i]:offsets[i + 1]].

    With prefixes, hashes has a row for whole words and one for the first n characters, for each n.
    """
    text, bounds = joined([t.lower() for t in texts])
    out, at = [], []
    for lo, cp in pieces(text, _word_table()):
        starts, ends = runs(_word_table()[cp])
        whole = run_hashes(cp, starts, ends)
        out.append(np.stack([whole, *(run_hashes(cp, starts, np.minimum(starts + n, ends)) for n in prefixes)]) if prefixes else whole)
        at.append(starts + lo)
    offsets = np.zeros(len(texts) + 1, np.int64)
    if out:
        offsets[1:] = np.searchsorted(np.concatenate(at), bounds)
    none = np.zeros((1 + len(prefixes), 0) if prefixes else 0, np.uint64)
    return (np.concatenate(out, axis=-1) if out else none), offsets


_SHINGLE = [np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def shingles(hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of the n-word shingles of one text; a shorter text that has words is one shingle."""
    k = len(hashes)
    if not k:
        return np.zeros(0, np.uint64)
    m = max(1, k - n + 1)
    out = np.full(m, np.uint64(min(n, k)))
    for lo in range(0, m, PIECE):
        h = out[lo : lo + PIECE]
        for j in range(min(n, k)):
            h = mix(h + hashes[lo + j : lo + j + len(h)] * _SHINGLE[j % 5])
        out[lo : lo + PIECE] = h
    return out


#: ASCII white space, and the bytes of a text that are split at a time.
SPACE, SPLIT = b" \t\n\x0b\x0c\r", 1 << 20


def interned(text: bytes, known: dict[bytes, int]) -> np.ndarray:
    """The ids of the words of a text, split at ASCII white space; new words are added to `known`."""
    out, lo = [], 0
    while lo < len(text):
        hi = min(len(text), lo + SPLIT)
        while hi < len(text) and text[hi] not in SPACE:  # a piece ends before white space
            hi += 1
        out.append(np.fromiter((known.setdefault(w, len(known)) for w in text[lo:hi].split()), np.int32))
        lo = hi
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def group_stream(batches, key):
    """Splits Arrow batches sorted by key into runs: yields lists of record batches with one key each.

    key(batch) gives a numpy array; a run may go on over many batches and is yielded whole.
    """
    held, held_key = [], None
    for b in batches:
        if not b.num_rows:
            continue
        k = key(b)
        cut = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for lo, hi in zip(cut, cut[1:]):
            if held and k[lo] != held_key:
                yield held
                held = []
            held_key = k[lo]
            held.append(b.slice(lo, hi - lo))
    if held:
        yield held
