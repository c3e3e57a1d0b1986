"""Byte-level BPE by replaying the merges over a whole block of text at once.

A block's texts are split by the pattern; each different piece is kept once. An inverted index leads
from the rank of a token pair to the positions where the pair stands now, in any piece. The ranks
are taken in ascending order from a heap; one step merges all positions of that rank, and only the
pairs with the left and right neighbours of a merged position are looked up anew. A piece costs the
same whether the block holds it once or a million times. Ids equal those of the rank-file library.

Cases: null and empty text give no ids; every other text, of any length, decodes to its own UTF-8
bytes. Repeated rows give repeated results, other columns play no part, an empty table gives none.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from faultlens.llm.blocks import text_slices

BLOCK_BYTES = 24_000_000  # text replayed together
_NONE = np.int32(2**31 - 1)
_SHIFT = 32


class Merges:
    """Ranks, and for each pair of tokens whose joined bytes are a token, that token's rank."""

    def __init__(self, raw: bytes):
        self.tokens = {base64.b64decode(t): int(r) for t, r in (x.split() for x in raw.splitlines() if x.strip())}
        self.single = np.array([self.tokens[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.tokens.items():
            for cut in range(1, len(token)):
                left, right = self.tokens.get(token[:cut]), self.tokens.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << _SHIFT | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.pairs = pairs
        table = [b""] * (max(self.tokens.values()) + 1)
        for token, rank in self.tokens.items():
            table[rank] = token
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.length = np.array([len(t) for t in table], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), _NONE, np.int32)
        wanted = left << _SHIFT | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.rank[at], _NONE)

    def one(self, piece: bytes) -> list[int]:
        """A single piece, pair by pair: the lowest rank first, the leftmost of equal ones."""
        ids = [int(self.single[b]) for b in piece]
        while len(ids) > 1:
            ranks = [self.pairs.get(a << _SHIFT | b, _NONE) for a, b in zip(ids, ids[1:])]
            least = min(ranks)
            if least == _NONE:
                break
            at = ranks.index(least)
            ids[at : at + 2] = [int(least)]
        return ids


@functools.lru_cache(maxsize=2)
def merges(raw: bytes) -> Merges:
    return Merges(raw)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each range, one after the other."""
    total = int(lengths.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def replay(pieces: list[bytes], m: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces one after the other, and each piece's number of ids."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    n = int(sizes.sum())
    if not n:
        return np.empty(0, np.int64), sizes
    symbol = np.full(n + 1, -1, np.int64)  # the last place stands for "nothing there"
    symbol[:n] = m.single[np.frombuffer(b"".join(pieces), np.uint8)]
    after = np.arange(1, n + 2)
    before = np.arange(-1, n)
    held = sizes > 0
    ends = np.cumsum(sizes)
    after[ends[held] - 1] = n
    before[(ends - sizes)[held]] = n
    rank = np.full(n + 1, _NONE, np.int32)  # of the pair that starts here
    alive = np.ones(n + 1, bool)
    odd: list[np.ndarray] = []
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def place(at: np.ndarray, than: int) -> None:
        """Look up the pairs that start at these positions and enter them in the index."""
        found = m.look(symbol[at], symbol[after[at]])
        found[after[at] == n] = _NONE
        rank[at] = found
        at, found = at[found != _NONE], found[found != _NONE]
        if not len(at):
            return
        if (low := found <= than).any():
            odd.append(at[low])
        order = np.argsort(found, kind="stable")
        at, found = at[order], found[order]
        cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
        for key, part in zip(found[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts) if len(cuts) else [at]):
            if key in index:
                index[key].append(part)
            else:
                index[key] = [part]
                heapq.heappush(heap, key)

    place(np.arange(n), -1)
    while heap:
        key = heapq.heappop(heap)
        parts = index.pop(key)
        at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        at = at[rank[at] == key]
        if not len(at):
            continue
        if len(at) > 1:
            # Pairs that overlap, as in a run of one letter: from the left, every other one.
            tied = np.zeros(len(at), bool)
            tied[1:] = after[at[:-1]] == at[1:]
            if tied.any():
                i = np.arange(len(at))
                at = at[(i - np.maximum.accumulate(np.where(tied, 0, i))) & 1 == 0]
        right = after[at]
        beyond = after[right]
        symbol[at] = key
        alive[right] = False
        rank[right] = _NONE
        after[at] = beyond
        before[beyond] = at
        left = before[at]
        left = left[left != n]
        place(np.unique(np.concatenate((at, left))), key)
    ids, counts = symbol[:n][alive[:n]], np.zeros(len(pieces), np.int64)
    counts[held] = np.add.reduceat(alive[:n].astype(np.int64), (ends - sizes)[held])
    again = set(np.searchsorted(ends, np.concatenate(odd), side="right").tolist()) if odd else set()
    # Pieces that are tokens stay whole; a pair that formed too late for its rank is redone alone.
    whole = {i: [r] for i, p in enumerate(pieces) if (r := m.tokens.get(p)) is not None and counts[i] != 1}
    redone = whole | {i: m.one(pieces[i]) for i in again if i not in whole and pieces[i] not in m.tokens}
    if redone:
        split = np.split(ids, np.cumsum(counts)[:-1])
        for i, own in redone.items():
            split[i], counts[i] = np.array(own, np.int64), len(own)
        ids = np.concatenate(split)
    return ids, counts


def decode(ids: np.ndarray, m: Merges) -> bytes:
    return m.bytes[_spread(m.start[ids], m.length[ids])].tobytes()


def encode_blocks(
    batches: Iterator[pa.RecordBatch], column: str, raw: bytes, pattern: str, block_bytes: int
) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Blocks of rows with the ids of each row."""
    m, find = merges(raw), regex.compile(pattern).findall
    rows: list[pa.RecordBatch] = []
    texts: list[np.ndarray] = []
    seen: dict[str, int] = defaultdict(count().__next__)
    size = 0

    def finish() -> tuple[list[pa.RecordBatch], list[np.ndarray]]:
        flat, counts = replay([p.encode() for p in seen], m)
        starts = np.cumsum(counts) - counts
        return rows, [flat[_spread(starts[t], counts[t])] for t in texts]

    for piece in text_slices(batches, column):
        rows.append(piece)
        for text in piece.column(column).to_pylist():
            found = find(text) if text else []
            texts.append(np.fromiter(map(seen.__getitem__, found), np.int32, len(found)))
            size += len(text or "")
        if size >= block_bytes or len(seen) >= block_bytes // 40:
            yield finish()
            rows, texts, size = [], [], 0
            seen = defaultdict(count().__next__)
    if rows:
        yield finish()


def encode(
    docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Ids and decoded bytes of every text: key, ids (array of int), decoded (binary)."""
    return _run(
        docs, path, pattern, key, text, block_bytes, "ids array<int>, decoded binary", [pa.list_(pa.int32()), pa.binary()],
        lambda ids, whole: (ids.astype(np.int32), whole),
    )


def digests(
    docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Number of ids and the SHA-256 of ids and of the decoded bytes, without moving the ids."""
    return _run(
        docs, path, pattern, key, text, block_bytes, "n_tokens long, ids_sha256 string, decoded_sha256 string",
        [pa.int64(), pa.string(), pa.string()],
        lambda ids, whole: (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(whole).hexdigest()),
    )


def _run(docs: DataFrame, path: str, pattern: str, key: str, text: str, block_bytes: int, schema: str, kinds: list, of: Callable) -> DataFrame:
    with open(path, "rb") as file:
        raw = file.read()  # the tokenizer's own file: its size doesn't depend on the data
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(raw)
        for rows, ids in encode_blocks(batches, "_text", raw, pattern, block_bytes):
            at = 0
            for piece in rows:
                own = [of(x, decode(x, m)) for x in ids[at : at + piece.num_rows]]
                at += piece.num_rows
                columns = [pa.array(c, k) for c, k in zip(zip(*own), kinds)]
                yield pa.RecordBatch.from_arrays([piece.column("_key"), *columns], [key, *names])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("_key"), docs[text].alias("_text")).mapInArrow(run, f"`{key}` {kind}, {schema}")
