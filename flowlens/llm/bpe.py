"""Byte-level BPE by corpus-level merge replay.

A task gathers the distinct pieces of its documents into one token array with neighbour links, indexes all adjacent
pairs by the rank of their merge, and replays the merges in rank order over all pieces at once: each merge looks up its
positions in the index and re-indexes only the neighbours that it touched. Pieces are independent, so this gives every
piece the tokens that merging it alone would. Where a merged token has a merge of lower rank with its neighbour, that one
comes before the piece's other merges; a piece in which many wait so is merged by itself, from a heap of its own pairs.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import prepare

#: Distinct pieces a worker remembers, and pieces of documents per replay.
KNOWN, PIECES = 3 << 18, 1 << 21
#: Documents per step.
ROWS = 2000
NONE = np.int64(1) << 40
#: A piece with more merges than this waiting for a lower one is merged by itself.
SOLO = 16


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Merges:
    """The vocabulary of a rank file: tokens by id, and the id that each pair of ids merges into."""

    def __init__(self, ranks: bytes):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.ids = table
        self.tokens = {i: t for t, i in table.items()}
        self.byte = np.array([table[bytes([i])] for i in range(256)], np.int64)
        keys, out = [], []
        for token, rank in table.items():
            for cut in range(1, len(token)):
                a, b = table.get(token[:cut]), table.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    out.append(rank)
        at = np.argsort(keys)
        self.keys, self.out = np.array(keys, np.int64)[at], np.array(out, np.int64)[at]
        # tokens that can at once merge further with a lower rank; where one does, the piece's other merges wait for that
        a, b = self.keys >> 32, self.keys & 0xFFFFFFFF
        self.early = set(a[self.out < a].tolist()) | set(b[self.out < b].tolist())

    @functools.cached_property
    def pairs(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.out.tolist(), strict=True))

    def alone(self, piece: bytes) -> list[int]:
        """Token ids of one piece, merge by merge from a heap of its pairs."""
        tok = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(tok)
        nxt, prv, pairs = list(range(1, n + 1)), list(range(-1, n - 1)), self.pairs
        heap = [(r, i) for i, key in enumerate(a << 32 | b for a, b in zip(tok, tok[1:], strict=False))
                if (r := pairs.get(key)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = nxt[i]
            if tok[i] < 0 or j >= n or pairs.get(tok[i] << 32 | tok[j]) != r:
                continue
            tok[i], tok[j], k = r, -1, nxt[j]
            nxt[i] = k
            if k < n:
                prv[k] = i
                if (x := pairs.get(r << 32 | tok[k])) is not None:
                    heapq.heappush(heap, (x, i))
            if (h := prv[i]) >= 0 and (x := pairs.get(tok[h] << 32 | r)) is not None:
                heapq.heappush(heap, (x, h))
        return [t for t in tok if t >= 0]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges into, NONE where it doesn't."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.out[at], NONE)

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces one after another, and how many each piece has."""
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        whole = np.fromiter((self.ids.get(p, -1) for p in pieces), np.int64, len(pieces))  # a piece that is a token
        n = len(flat)
        tok = self.byte[flat]
        piece = np.repeat(np.arange(len(pieces)), length)
        last = np.zeros(n, bool)
        last[np.cumsum(length)[length > 0] - 1] = True
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[last] = -1
        prv[np.flatnonzero(last)[:-1] + 1] = -1
        if n:
            prv[0] = -1
        alive = np.ones(n, bool)
        solo = np.zeros(len(pieces), bool)  # pieces that are merged by themselves
        todo = np.flatnonzero((nxt >= 0) & (whole[piece] < 0))
        index: dict[int, list[np.ndarray]] = defaultdict(list)  # rank -> positions of its left tokens
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            if not len(at):
                return
            rank = self.rank(tok[at], tok[nxt[at]])
            keep = rank < NONE
            at, rank = at[keep], rank[keep]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            begin = np.r_[0, cut]
            for r, x, y in zip(rank[begin].tolist(), begin.tolist(), [*cut.tolist(), len(at)], strict=True):
                if r not in index:
                    heapq.heappush(heap, r)
                index[r].append(at[x:y])

        add(todo)
        while heap:
            r = heapq.heappop(heap)
            at = index.pop(r)
            at = np.unique(np.concatenate(at)) if len(at) > 1 else np.sort(at[0])
            at = at[alive[at] & (nxt[at] >= 0) & ~solo[piece[at]]]
            at = at[self.rank(tok[at], tok[nxt[at]]) == r]
            if not len(at):
                continue
            every = at
            if len(at) > 1:  # of positions that overlap, every second, from the left
                chained = np.r_[False, nxt[at[:-1]] == at[1:]]
                if chained.any():
                    start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                    at = at[(np.arange(len(at)) - start) % 2 == 0]
            if r in self.early and len(at) > 1:
                before, beyond = prv[at], nxt[nxt[at]]
                side = np.where(before >= 0, tok[before], -1)
                side[1:][nxt[at[:-1]] == before[1:]] = r
                low = (self.rank(side, np.full(len(at), r)) < r) | (
                    (beyond >= 0) & (self.rank(np.full(len(at), r), np.where(beyond >= 0, tok[beyond], -1)) < r))
                if low.any():  # in such a piece, merges up to the first that goes on lower; the others later
                    stop = np.full(len(pieces), n)
                    np.minimum.at(stop, piece[at[low]], at[low])
                    many = np.bincount(piece[at[at > stop[piece[at]]]], minlength=len(pieces)) > SOLO
                    solo |= many
                    later = every[(every > stop[piece[every]]) & ~many[piece[every]]]
                    at = at[(at <= stop[piece[at]]) & ~many[piece[at]]]
                    if len(later):
                        index[r].append(later)
                        heapq.heappush(heap, r)
                    if not len(at):
                        continue
            gone = nxt[at]
            after = nxt[gone]
            tok[at] = r
            alive[gone] = False
            nxt[at] = after
            right = after >= 0
            prv[after[right]] = at[right]
            left = prv[at]
            touched = np.concatenate([at[right], left[left >= 0]])
            add(np.unique(touched) if len(touched) > 1 else touched)
        done = whole[piece] >= 0
        alive &= ~done
        first = np.cumsum(length) - length
        at = first[whole >= 0]
        alive[at] = True
        tok[at] = whole[whole >= 0]
        for k in np.flatnonzero(solo).tolist():
            ids = self.alone(pieces[k])
            alive[first[k]:first[k] + length[k]] = np.arange(length[k]) < len(ids)
            tok[first[k]:first[k] + len(ids)] = ids
        return tok[alive], np.bincount(piece[alive], minlength=len(pieces))


class Rows(dict):
    """Row numbers of words in the order of their first look-up; ``new`` has those that were not there before."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = i = len(self)
        self.new.append(word)
        return i


class Encoder:
    """Token ids of texts, block by block; remembers the pieces it has replayed, up to a bound."""

    def __init__(self, ranks: bytes, pattern: str):
        self.merges = Merges(ranks)
        self.split = regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.row = Rows()
        self.flat, self.end = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of every text."""
        out: list[np.ndarray] = []
        block: list[np.ndarray] = []
        held = 0
        for text in texts:
            pieces = self.split(text)
            block.append(np.fromiter(map(self.row.__getitem__, pieces), np.int64, len(pieces)))
            held += len(pieces)
            if held > PIECES or len(self.row) > KNOWN:
                out += self._resolve(block)
                block, held = [], 0
                if len(self.row) > KNOWN:
                    self._forget()
        return out + self._resolve(block)

    def _resolve(self, block: list[np.ndarray]) -> list[np.ndarray]:
        if self.row.new:
            ids, n = self.merges.replay([p.encode() for p in self.row.new])
            self.row.new = []
            self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])
            self.end = np.concatenate([self.end, self.end[-1] + np.cumsum(n)])
        out = []
        for rows in block:
            begin, size = self.end[rows], self.end[rows + 1] - self.end[rows]
            at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            out.append(self.flat[at])
        return out


_ENCODERS: dict[tuple, Encoder] = {}


def worker_encoder(ranks: bytes, pattern: str) -> Encoder:
    """The encoder of this Python worker: later tasks go on with the pieces that earlier ones replayed."""
    key = (hashlib.sha256(ranks).hexdigest(), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks, pattern)
    return _ENCODERS[key]


def decode(ids: np.ndarray, tokens: dict[int, bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids.tolist()))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, n_tokens, ids, ids_sha256, decoded_sha256; a row per document.

    ``ids_sha256`` is of the ids as little-endian unsigned 32-bit integers, ``decoded_sha256`` of the bytes that they
    decode to; both are taken where the tokens are. The driver reads the rank file and broadcasts it (a vocabulary of
    bounded size). Pieces are the matches of ``pattern``; text between matches is dropped, as by the reference library.
    A null text counts as empty and has no ids. Repeated rows and null ids are rows like others; the columns ``keep``
    are returned after those, and others are ignored; no rows give no rows.
    """
    spark = prepare(docs)
    keep = keep or []
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    names = ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(ranks.value, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                ids = encoder.encode(part.column(1).to_pylist())
                end = np.cumsum([0, *map(len, ids)])
                raw = [hashlib.sha256(decode(x, encoder.merges.tokens)).hexdigest() for x in ids]
                flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(np.diff(end).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(end.astype(np.int32)), pa.array(flat.astype(np.int32))),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array(raw, pa.string()), *part.columns[2:]], names=names)

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *keep)
    own = StructType.fromDDL("doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")
    return src.mapInArrow(run, StructType([*own.fields, *src.schema.fields[2:]]))
