"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is cut into pre-tokens by the tokenizer's pattern. Pre-tokens that are vocabulary entries are
resolved by a minimal perfect hash over the vocabulary (hash and displace: one displacement per
bucket of about four entries, every entry its own slot, the entry's bytes compared); the others are
merged with a heap of (rank, position) over linked bytes. Pre-tokens that come again are found in a memo
that is bounded by the bytes it holds; long ones are never kept in it. Ranks are read on the driver and
travel with the task.

Defined cases: null text is empty; an empty text has no tokens (both digests are those of nothing);
null ids and repeated rows are kept; other columns are ignored; very long texts are worked on in
slices of matches, digests being updated as they go (a single pre-token is merged whole, at some 60 bytes
of memory for each of its own).
"""

import base64
import functools
import hashlib
import heapq
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm._spark import WARM, arrow_map, prepare, table, tidy
from lodestack.llm._tokens import PIECE, mix, run_hashes

#: Bytes (estimated) of each of the memo's two generations, characters of a pre-token that may be kept in it, matches worked on at once.
MEMO_BYTES, KEPT, SLICE = 56 << 20, 48, 1 << 14
#: Characters of a text whose matches are listed at once.
LONG = 1 << 19
#: Digest of an empty text.
NOTHING = hashlib.sha256().hexdigest()
#: Bytes that a memo entry takes besides its characters and ids: two objects and a place in the table.
ENTRY = 140
_STEP = np.uint64(0x9E3779B97F4A7C15)


def byte_hashes(items: list[bytes]) -> np.ndarray:
    """64-bit hashes of byte strings, none of them longer than a piece."""
    lengths = np.fromiter(map(len, items), np.int64, len(items))
    ends = np.cumsum(lengths)
    out, lo = [np.zeros(0, np.uint64)], 0
    while lo < len(items):
        base = int(ends[lo] - lengths[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + PIECE, side="right")))
        own = ends[lo:hi] - base
        out.append(run_hashes(np.frombuffer(b"".join(items[lo:hi]), np.uint8), own - lengths[lo:hi], own))
        lo = hi
    return np.concatenate(out)


class PerfectHash:
    """Minimal perfect hash of n byte strings: n slots, one entry in each."""

    def __init__(self, items: list[bytes], load: int = 4):
        n = len(items)
        self.n, self.buckets = max(1, n), max(1, n // load)
        h = byte_hashes(items)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.displace = np.zeros(self.buckets, np.uint32)
        self.slot_item = np.full(self.n, -1, np.int32)
        for b in np.argsort(-np.diff(cuts), kind="stable"):
            own = order[cuts[b] : cuts[b + 1]]
            if not len(own):
                break
            first, width = np.uint64(0), 16
            while True:
                tries = np.arange(width, dtype=np.uint64)
                at = (mix(h[own][None, :] + (tries + first)[:, None] * _STEP) % np.uint64(self.n)).astype(np.int64)
                ok = (self.slot_item[at] < 0).all(1)
                if len(own) > 1:
                    ok &= (np.diff(np.sort(at, 1), axis=1) > 0).all(1)
                if ok.any():
                    d = int(np.argmax(ok))
                    self.displace[b] = int(tries[d] + first)
                    self.slot_item[at[d]] = own
                    break
                first += np.uint64(width)
                width = min(2 * width, 1 << 14)

    def slots(self, items: list[bytes]) -> np.ndarray:
        """Entry number that each item would have, were it an entry."""
        h = byte_hashes(items)
        d = self.displace[(h % np.uint64(self.buckets)).astype(np.int64)].astype(np.uint64)
        return self.slot_item[(mix(h + d * _STEP) % np.uint64(self.n)).astype(np.int64)]


class ByteBpe:
    """Encoder and decoder for ranks (bytes to id) and a pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.entries = list(ranks)
        self.ids = [ranks[e] for e in self.entries]
        self.hash = PerfectHash(self.entries)
        self.name = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()
        self._ready()

    def _ready(self) -> None:
        self.find = regex.compile(self.pattern)
        self.text_of = dict(zip(self.ids, self.entries))
        self.longest = max(map(len, self.entries), default=0)
        self.decimal = {i: str(i) for i in self.ids}
        self.memo: dict[str, bytes] = {}  # ids as unsigned numbers of 32 bits
        self.older: dict[str, bytes] = {}
        self.held = 0

    def __reduce__(self):
        state = {k: v for k, v in self.__dict__.items() if k not in ("find", "text_of", "longest", "decimal", "memo", "older", "held", "ranks")}
        return _revived, (self.name, state)

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a piece that is no entry: the lowest rank merges first, the leftmost of equals.

        A part is named by its start; end and before link the parts; rank_at is the rank of a part joined with
        the next one, -1 where that is no entry. A heap entry holds rank and start in one number and is stale
        when rank_at says otherwise.
        """
        n, rank = len(piece), self.ranks.get
        shift = 13 if n < 1 << 13 else 32
        mask = (1 << shift) - 1
        end, before, rank_at = list(range(1, n + 1)), list(range(-1, n - 1)), [rank(piece[i : i + 2], -1) for i in range(n - 1)]
        rank_at.append(-1)
        if n > 1 << 13:  # compact, for what may be very long
            end, before, rank_at = array("q", end), array("q", before), array("q", rank_at)
        heap = [r << shift | i for i, r in enumerate(rank_at) if r >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            x = pop(heap)
            i = x & mask
            if rank_at[i] != x >> shift:
                continue
            j = end[i]
            k = end[i] = end[j]
            rank_at[j] = -1
            if k < n:
                before[k] = i
                r = rank_at[i] = rank(piece[i : end[k]], -1)
                if r >= 0:
                    push(heap, r << shift | i)
            else:
                rank_at[i] = -1
            p = before[i]
            if p >= 0:
                r = rank_at[p] = rank(piece[p:k], -1)
                if r >= 0:
                    push(heap, r << shift | p)
        out, i, ranks = [], 0, self.ranks
        while i < n:
            k = end[i]
            out.append(ranks[piece[i:k]])
            i = k
        return out

    def resolve(self, tokens: Iterable[str]) -> dict[str, bytes]:
        """Puts pre-tokens into the memo; gives those that are too long for it."""
        new, apart, older, memo, held = [], {}, self.older, self.memo, 0
        for t in tokens:
            if (known := older.get(t)) is not None:
                memo[t] = known
                held += ENTRY + len(t) + len(known)
            else:
                new.append(t)
        if new:
            pieces = [t.encode("utf-8", "surrogatepass") for t in new]
            entries, ids, longest = self.entries, self.ids, self.longest
            short = [k for k, p in enumerate(pieces) if len(p) <= longest]
            at = np.full(len(new), -1)
            at[short] = self.hash.slots([pieces[k] for k in short])
            for t, p, k in zip(new, pieces, at.tolist()):
                known = array("I", (ids[k],) if k >= 0 and entries[k] == p else self.merged(p)).tobytes()
                if len(t) <= KEPT:
                    memo[t] = known
                    held += ENTRY + len(t) + len(known)
                else:
                    apart[t] = known
        self.held += held
        return apart

    def encode_slices(self, texts: Iterable[str]) -> Iterator[tuple[int, list[int]]]:
        """(number of the text, ids), in slices: one for each text, several for a long one, none where it has no tokens."""
        held: list[tuple[int, list[str]]] = []  # pre-tokens of some texts, resolved together
        n = 0
        for k, text in enumerate(texts):
            if len(text) <= LONG:
                tokens = self.find.findall(text)
                parts = iter([tokens] if len(tokens) <= SLICE else [tokens[i : i + SLICE] for i in range(0, len(tokens), SLICE)])
            else:
                it = (m.group() for m in self.find.finditer(text))
                parts = iter(lambda: list(islice(it, SLICE)), [])
            for tokens in parts:
                held.append((k, tokens))
                n += len(tokens)
                if n >= SLICE:
                    yield from self._resolved(held)
                    held, n = [], 0
        yield from self._resolved(held)

    def _resolved(self, held: list[tuple[int, list[str]]]) -> Iterator[tuple[int, list[int]]]:
        if self.held > MEMO_BYTES:  # what is still in use moves on to the new memo, the rest is forgotten
            self.memo, self.older, self.held = {}, self.memo, 0
        apart = self.resolve(set().union(*(tokens for _, tokens in held)).difference(self.memo))
        known = self.memo.__getitem__ if not apart else (lambda t, memo=self.memo: memo[t] if t in memo else apart[t])
        for k, tokens in held:
            if tokens:
                yield k, np.frombuffer(b"".join(map(known, tokens)), np.uint32).tolist()

    def encode(self, text: str) -> list[int]:
        return [i for _, part in self.encode_slices([text]) for i in part]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.text_of.__getitem__, ids))

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, sha256 of the ids in decimal joined by spaces, sha256 of the decoded bytes) of each text."""
        out, at = [(0, NOTHING, NOTHING)] * len(texts), -1
        for k, ids in self.encode_slices(texts):
            if k != at:
                at, n, a, b = k, 0, hashlib.sha256(), hashlib.sha256()
            a.update((" " * (n > 0) + " ".join(map(self.decimal.__getitem__, ids))).encode())
            b.update(self.decode(ids))
            n += len(ids)
            out[k] = n, a, b
        return [(n, a, b) if n == 0 else (n, a.hexdigest(), b.hexdigest()) for n, a, b in out]


#: Encoders of this process by name: a Python worker that is used again keeps what it has resolved, until another stage uses it.
_LIVE: dict = {}


def _forget() -> None:
    for bpe in _LIVE.values():
        bpe.memo, bpe.older, bpe.held = {}, {}, 0


WARM["byte_bpe"] = _forget


def _revived(name: str, state: dict) -> ByteBpe:
    if name not in _LIVE:
        bpe = ByteBpe.__new__(ByteBpe)
        bpe.__dict__ |= state
        bpe.ranks = dict(zip(bpe.entries, bpe.ids))
        bpe._ready()
        _LIVE.clear()
        _LIVE[name] = bpe
    return _LIVE[name]


@functools.lru_cache(4)
def load(path: str, pattern: str) -> ByteBpe:
    """From a file of base64 entries and ranks, one a line."""
    with open(path, "rb") as f:
        return ByteBpe({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)


def with_ids(docs: DataFrame, bpe: ByteBpe, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """docs with the array of ids of each text as ids_col (replaced if it is there)."""
    prepare(docs.sparkSession)

    def ids(texts: pd.Series) -> pd.Series:
        out = texts.map(lambda t: np.array(bpe.encode(t or ""), np.int32))
        tidy()
        return out

    return docs.withColumn(ids_col, F.pandas_udf(ids, "array<int>")(F.col(text_col)))


def encode_digests(docs: DataFrame, bpe: ByteBpe, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = bpe.digests(b.column("body").to_pylist())
            yield pa.record_batch([b.column("doc_id"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    return arrow_map(base, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", warm="byte_bpe")


def public_bpe() -> ByteBpe:
    import public_tokenizers

    return load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), public_bpe())
