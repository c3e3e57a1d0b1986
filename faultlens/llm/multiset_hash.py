"""Document fingerprints by a homomorphic multiset hash of paragraphs.

A text is the multiset of its paragraphs (the pieces between line feeds). Each paragraph is hashed to a wide
vector, and a text's fingerprint is the sum of its paragraphs' vectors, lane by lane, modulo powers of two.
So the order of paragraphs does not matter, and a paragraph is inserted or deleted by adding or subtracting its vector.

A vector has two parts. ``DIGEST`` lanes modulo 2^64 are the paragraph's BLAKE2b digest: they tell different
multisets apart. ``COUNTS`` lanes modulo 2^24 are a signed count of the paragraph's two-word shingles (a
paragraph of one word: the word): each adds or takes one in a lane. Sums and differences of fingerprints are fingerprints of sums and
differences, so the count lanes of two texts give |A - B|^2 against |A|^2 + |B|^2, and their likeness is
1 - |A - B|^2 / (|A|^2 + |B|^2), between 0 and 1, with a deviation of about 1 / sqrt(COUNTS).

The written form is base64 of all lanes, little-endian. Different multisets share a fingerprint with a chance of
about 2^-512 unless somebody builds them on purpose.

Cases: a null text is empty; the empty text is one empty paragraph. Texts without a word are alike in 1 if
their fingerprints are equal, else in 0. A row with a null id comes before all others; rows that repeat an id are ordered by their
texts' hashes. A table of one row has itself as the next. An empty table gives none; other columns are not looked at.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from faultlens.llm.blocks import hashes, mix, words

DIGEST = 8  # lanes modulo 2^64
COUNTS = 512  # lanes, kept modulo 2^32 and written modulo 2^24
BLOCK_BYTES = 32 << 20  # texts of a block of neighbours, about
MOST_BLOCKS = 50_000  # blocks, whose beginnings the driver holds; more text makes larger blocks, which are streamed
PIECE_BYTES, PIECE_TEXTS = 2_000_000, 512  # handled at once inside a task; a longer text is a piece of its own
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def fingerprints(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Digest lanes (texts x DIGEST, uint64) and count lanes (texts x COUNTS, uint32)."""
    digests = np.zeros((len(texts), DIGEST), np.uint64)
    if not texts:
        return digests, np.zeros((0, COUNTS), np.uint32)
    paragraphs = [t.split(b"\n") for t in texts]
    sizes = np.array([len(p) for p in paragraphs])
    each = b"".join(hashlib.blake2b(p, digest_size=8 * DIGEST).digest() for ps in paragraphs for p in ps)
    lanes = np.frombuffer(each, np.uint64).reshape(-1, DIGEST)
    digests[:] = np.add.reduceat(lanes, np.cumsum(sizes) - sizes, axis=0)

    flat = [p for ps in paragraphs for p in ps]
    data = np.frombuffer(b"".join(flat), np.uint8)
    ends = np.cumsum([len(p) for p in flat])
    starts, stops, counts = words(data, np.concatenate(([0], ends)))
    if not len(starts):
        return digests, np.zeros((len(texts), COUNTS), np.uint32)
    word = hashes(data, starts, stops)
    where = np.repeat(np.arange(len(flat)), counts)
    text_of = np.repeat(np.arange(len(texts)), sizes)
    pair = np.flatnonzero(where[1:] == where[:-1])
    alone = np.flatnonzero(np.repeat(counts, counts) == 1)
    shingle = np.concatenate((mix(word[pair] * _A + word[pair + 1] * _B), mix(word[alone] + _B)))
    text = text_of[np.concatenate((where[pair], where[alone]))]
    lane = (shingle % np.uint64(COUNTS)).astype(np.int64)
    sign = 1.0 - 2.0 * (shingle >> np.uint64(63))
    sums = np.bincount(text * COUNTS + lane, sign, len(texts) * COUNTS).astype(np.int64)
    return digests, sums.astype(np.uint32).reshape(-1, COUNTS)


def added(one: tuple, other: tuple, sign: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints after inserting (or with sign -1, deleting) the paragraphs of ``other``."""
    with np.errstate(over="ignore"):
        return (one[0] + other[0], one[1] + other[1]) if sign > 0 else (one[0] - other[0], one[1] - other[1])


def likeness(one: tuple, other: tuple) -> np.ndarray:
    """Between 0 and 1, for the fingerprints of each row; equal fingerprints have 1."""
    equal = (one[0] == other[0]).all(1) & (one[1] == other[1]).all(1)
    square = lambda x: (x.view(np.int32).astype(np.float64) ** 2).sum(1)
    apart, whole = square(one[1] - other[1]), square(one[1]) + square(other[1])
    return np.where(equal, 1.0, np.where(whole > 0, np.clip(1 - apart / np.maximum(whole, 1), 0, 1), 0.0))


def written(prints: tuple[np.ndarray, np.ndarray]) -> list[str]:
    digests, counts = prints
    low = np.ascontiguousarray(counts).view(np.uint8).reshape(len(counts), -1, 4)[:, :, :3]
    return [base64.b64encode(d.tobytes() + c.tobytes()).decode() for d, c in zip(digests, low)]


def parsed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(base64.b64decode(t) for t in texts), np.uint8).reshape(len(texts), -1)
    low = np.zeros((len(texts), COUNTS, 4), np.uint8)
    low[:, :, 1:] = raw[:, 8 * DIGEST :].reshape(len(texts), COUNTS, 3)
    counts = low.reshape(len(texts), -1).view(np.int32) >> 8  # with the sign
    return raw[:, : 8 * DIGEST].copy().view(np.uint64), counts.view(np.uint32)


def edit(text: str, following: str) -> tuple[str, str, str]:
    """(edited text, deleted paragraphs, inserted paragraphs): the last half of the text gives way to the start of
    the following one. The deleted and inserted paragraphs are all that changes."""
    half = len(text) // 2
    kept, new = text[: len(text) - half], following[:half]
    changed = kept.rfind("\n") + 1
    return kept + new, text[changed:], kept[changed:] + new


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text takes its second half from the next row in key order (after the last: the first). Rows are
    dealt into blocks of neighbours; the first row of each is also sent to the block before, so that
    every row meets its next one without a sort of the whole table in one place."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_h", F.xxhash64("_text"))
    total = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    places = F.struct(F.col("_id"), F.col("_h"))
    blocks = min(MOST_BLOCKS, max(1, -(-total // block_bytes)))
    ranged = rows.select("_id", "_h").repartitionByRange(blocks, "_id", "_h")
    # One row for each block comes to the driver: where it begins.
    firsts = [r["f"] for r in ranged.groupBy(F.spark_partition_id().alias("_p")).agg(F.min(places).alias("f")).collect()]
    order = lambda i, h: (i is not None, i if i is not None else 0, h)
    starts = sorted(order(f["_id"], f["_h"]) for f in firsts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, h, t in zip(*(batch.column(c).to_pylist() for c in ("_id", "_h", "_text"))):
                place, packed = order(i, h), packer.compress(t.encode())
                own = bisect.bisect_right(starts, place) - 1
                sent = [(own, False)] + ([((own - 1) % len(starts), True)] if place == starts[own] else [])
                for block, guest in sent:
                    for column, value in zip(out, (block, guest, i, h, packed)):
                        column.append(value)
            arrays = [pa.array(c, k) for c, k in zip(out, (pa.int32(), pa.bool_(), batch.schema.field("_id").type, pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(arrays, ["_block", "_guest", "_id", "_h", "_packed"])

    dealt = rows.mapInArrow(deal, f"_block int, _guest boolean, _id {kind}, _h long, _packed binary")
    sides = dealt.repartitionById(max(1, len(starts)), F.col("_block")).sortWithinPartitions("_block", "_guest", F.col("_id").asc_nulls_first(), "_h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        held: list[tuple] = []  # rows of one block whose next row has not been seen, or that are not answered yet
        size = 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("_block", "_guest", "_id")]
            for block, guest, i, packed in zip(*columns, batch.column("_packed")):
                if held and held[-1][1] and (guest and held[-1][0] == block):
                    continue  # a further row equal to the first of the next block
                body = unpacker.decompress(packed.as_py()).decode()
                if held and held[-1][0] != block:
                    yield answer(held)
                    held, size = [], 0
                elif size > PIECE_BYTES or len(held) > PIECE_TEXTS:
                    held.append((block, guest, i, body))
                    yield answer(held)
                    held, size = [], 0
                held.append((block, guest, i, body))
                size += len(body)
        if held:
            yield answer(held)

    def answer(held: list[tuple]) -> pa.RecordBatch:
        """All rows but the last, which is the next of the one before."""
        texts = [h[3] for h in held]
        changes = [edit(a, b) for a, b in zip(texts, texts[1:])]
        every = fingerprints([t.encode() for t in texts])
        own, following = tuple(x[:-1] for x in every), tuple(x[1:] for x in every)
        gone, come = (fingerprints([c[k].encode() for c in changes]) for k in (1, 2))
        new = added(added(own, gone, -1), come)
        arrays = [
            pa.array([h[2] for h in held[:-1]], kinds[0]),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(c[0].encode()).hexdigest() for c in changes], pa.string()),
            pa.array(written(own), pa.string()),
            pa.array(written(new), pa.string()),
            pa.array(likeness(own, new)),
            pa.array(likeness(own, following)),
        ]
        return pa.RecordBatch.from_arrays(arrays, names)

    kinds = [to_arrow_type(docs.schema[key].dataType)]
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return sides.select("_block", "_guest", "_id", "_packed").mapInArrow(run, schema)
