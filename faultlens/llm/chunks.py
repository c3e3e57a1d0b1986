"""Substring dedup by content-defined chunks.

A gear hash (each byte shifts the hash left and adds the byte's value; 16 bits, so it knows the last 16
bytes) rolls over the whole UTF-8 text; a chunk ends where it falls under a bound, so boundaries follow
the content: an insertion moves the chunks around it and leaves all others as they are. A
chunk whose digest stands in a document with a smaller id is repeated; a run of repeated chunks of
at least ``words`` words is a repeated passage, to be removed from the later document.

Blocks of texts keep their chunks; each different digest of a block goes to its key range with the
smallest id of the block that has it; the range answers with the smallest id of all.

Cases: null and empty texts have no chunks; rows with a null id take no part. Repetitions inside one
document (or rows that share an id) are not reported. Texts of any length are chunked whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.blocks import _SPACE, hashes, mix, text_slices, utf8
from faultlens.llm.exchange import bundle, cuts, ranges, unbundle
from faultlens.operators.sizing import settle

AVERAGE = 20  # bytes between two boundaries
LONGEST = 64  # bytes of a chunk at most
WORDS = 30  # words in a run of repeated chunks that is a repeated passage
WINDOW = 16
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)


def boundaries(data: np.ndarray, offsets: np.ndarray, average: int = AVERAGE) -> np.ndarray:
    """Ends of the chunks of all texts, ascending; every text's end is one."""
    if not len(data):
        return np.empty(0, np.int64)
    gear = _GEAR[data]
    width = 1
    while width < WINDOW:
        # The hash over twice the bytes: the nearer half, and the farther one shifted.
        longer = gear.copy()
        longer[width:] += gear[:-width] << np.uint16(width)
        gear, width = longer, 2 * width
    ends = np.flatnonzero(gear < 65536 // average) + 1
    starts = offsets[:-1]
    text = np.searchsorted(offsets, ends, side="left") - 1
    # The first bytes of a text have no whole window; the text's end is added below.
    ends = ends[(ends - offsets[text] >= WINDOW) & (ends < offsets[text + 1])]
    ends = np.union1d(ends, offsets[1:][offsets[1:] > starts])
    # A chunk that is too long ends where its hash is least, the last such place within reach: in
    # text that repeats itself, boundaries still follow the content.
    sizes = np.diff(ends, prepend=0)
    extra = []
    for end, start in zip(ends[sizes > LONGEST].tolist(), (ends - sizes)[sizes > LONGEST].tolist()):
        begin = int(offsets[np.searchsorted(offsets, start, side="right") - 1])
        while end - start > LONGEST:
            low = max(start + 1, begin + WINDOW)
            reach = gear[low - 1 : start + LONGEST]
            start = low + len(reach) - 1 - int(np.argmin(reach[::-1]))
            extra.append(start)
    return np.union1d(ends, np.array(extra, np.int64))


def chunk_texts(texts: pa.Array, average: int = AVERAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of chunks of each text; digest, length and number of word beginnings of each chunk."""
    data, offsets = utf8(texts)
    ends = boundaries(data, offsets, average)
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    number = np.diff(np.searchsorted(ends, offsets, side="right"))
    begin = ~_SPACE[data]
    begin[1:] &= _SPACE[data[:-1]]
    begin[offsets[:-1][offsets[:-1] < len(data)]] |= ~_SPACE[data[offsets[:-1][offsets[:-1] < len(data)]]]
    begun = np.concatenate(([0], np.cumsum(begin)))
    return number, hashes(data, starts, ends), (ends - starts).astype(np.uint16), (begun[ends] - begun[starts]).astype(np.uint8)


_BLOCK = "block long, ids binary, chunks binary"


def _blocks(docs: DataFrame, key: str, text: str, average: int) -> DataFrame:
    rows = docs.select(docs[key].cast("long").alias("_key"), docs[text].alias("_text")).filter(F.col("_key").isNotNull() & F.col("_text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for piece in text_slices(batches, "_text"):
            number, *chunks = chunk_texts(piece.column("_text"), average)
            ids = bundle(piece.column("_key").to_numpy(), number.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([ids]), pa.array([bundle(*chunks)])], ["block", "ids", "chunks"])
            block += 1

    return rows.mapInArrow(run, _BLOCK)


def _open(ids: bytes, chunks: bytes) -> tuple[np.ndarray, ...]:
    """Document of each chunk, digest, length, words; and the chunk's place in the block's texts."""
    key, number = unbundle(ids, np.int64, np.int64)
    digest, size, words = unbundle(chunks, np.uint64, np.uint16, np.uint8)
    return np.repeat(key, number), np.repeat(np.arange(len(key)), number), digest, size.astype(np.int64), words.astype(np.int64)


def repeated_passages(docs: DataFrame, words: int = WORDS, average: int = AVERAGE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, start, end (bytes of the UTF-8 text), n_words, source: the smallest id of a document in
    which the passage's longest chunk stands. One row for each repeated passage."""
    spark = docs.sparkSession
    parts = ranges(spark)
    blocks = settle(_blocks(docs, key, text, average))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, chunks in zip(*(c.to_pylist() for c in batch.columns)):
                doc, _, digest, _, _ = _open(ids, chunks)
                if not len(digest):
                    continue
                order = np.argsort(digest, kind="stable")
                digest, doc = digest[order], doc[order]
                first = np.flatnonzero(np.concatenate(([True], digest[1:] != digest[:-1])))
                least, most = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
                digest, at = digest[first], cuts(digest[first], parts)
                held = np.flatnonzero(np.diff(at))
                payload = [bundle(digest[at[p] : at[p + 1]], least[at[p] : at[p + 1]], (most > least)[at[p] : at[p + 1]].astype(np.uint8)) for p in held]
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(np.full(len(held), block)), pa.array(payload)], ["part", "block", "payload"])

    def answer(group: pa.Table) -> pa.Table:
        asked = [unbundle(p, np.uint64, np.int64, np.uint8) for p in group.column("payload").to_pylist()]
        every = np.concatenate([a[0] for a in asked])
        digest, inverse = np.unique(every, return_inverse=True)
        least = np.full(len(digest), np.iinfo(np.int64).max)
        np.minimum.at(least, inverse, np.concatenate([a[1] for a in asked]))
        out, at = [], 0
        for own, doc, several in asked:
            first = least[inverse[at : at + len(own)]]
            at += len(own)
            told = (first < doc) | (several > 0)
            out.append(bundle(own[told], first[told]) if told.any() else None)
        found = pa.table({"block": group.column("block"), "payload": pa.array(out, pa.binary())})
        return found.filter(pa.array([p is not None for p in out]))

    def merge(own: pa.Table, answers: pa.Table) -> pa.Table:
        empty = pa.table({c: pa.array([], pa.int64()) for c in (key, "start", "end", "n_words", "source")})
        if not own.num_rows or not answers.num_rows:
            return empty
        doc, row, digest, size, many = _open(own.column("ids")[0].as_py(), own.column("chunks")[0].as_py())
        told = [unbundle(p, np.uint64, np.int64) for p in answers.column("payload").to_pylist()]
        keys, first = np.concatenate([t[0] for t in told]), np.concatenate([t[1] for t in told])
        order = np.argsort(keys)
        keys, first = keys[order], first[order]
        at = np.minimum(np.searchsorted(keys, digest), len(keys) - 1)
        repeated = (keys[at] == digest) & (first[at] < doc)
        # Runs: neighbours in one text.
        ends = np.cumsum(size)
        begins = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        base = (ends - size)[begins][np.cumsum(np.concatenate(([True], row[1:] != row[:-1]))) - 1]
        opens = repeated & np.concatenate(([True], (row[1:] != row[:-1]) | ~repeated[:-1]))
        closes = repeated & np.concatenate(((row[1:] != row[:-1]) | ~repeated[1:], [True]))
        a, b = np.flatnonzero(opens), np.flatnonzero(closes)
        sums = np.concatenate(([0], np.cumsum(many)))
        total = sums[b + 1] - sums[a]
        a, b, total = a[total >= words], b[total >= words], total[total >= words]
        # The source is that of the run's longest chunk; short chunks stand in many documents.
        inside = np.repeat(np.arange(len(a)), b - a + 1)
        place = np.arange(len(inside)) + np.repeat(a - np.concatenate(([0], np.cumsum(b - a + 1)[:-1])), b - a + 1) if len(a) else a
        order = np.lexsort((place, -size[place], inside))
        longest = place[order][np.searchsorted(inside, np.arange(len(a)))]
        columns = (doc[a], (ends - size - base)[a], (ends - base)[b], total, first[at[longest]])
        return pa.table(dict(zip((key, "start", "end", "n_words", "source"), (pa.array(c, pa.int64()) for c in columns))))

    asked = blocks.mapInArrow(ask, "part int, block long, payload binary")
    answers = asked.groupBy("part").applyInArrow(answer, "block long, payload binary")
    schema = f"`{key}` long, start long, end long, n_words long, source long"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(merge, schema)


def remove_passages(docs: DataFrame, passages: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns; the passages of ``repeated_passages`` are cut out of the texts. A
    character that a passage's end would cut in two is left out with it."""
    spans = settle(passages.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_spans")))
    joined = docs.join(spans.hint("merge"), key, "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([_cut(t, a, b) for t, a, b in zip(texts, starts, ends)], dtype=object)

    kept = cut(F.col(text), F.col("_spans.start"), F.col("_spans.end"))
    return joined.withColumn(text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(kept)).select(docs.columns)


def _cut(text: str | None, starts: np.ndarray | None, ends: np.ndarray | None) -> str | None:
    if text is None or starts is None:
        return text
    raw, at, left = text.encode(), 0, []
    for start, end in zip(starts, ends):
        left.append(raw[at:start])
        at = end
    return b"".join([*left, raw[at:]]).decode(errors="ignore")
