"""Token ids of a corpus in ascending id order, as Simple-8b coded blocks in Parquet files.

Block format (little endian): ``S8B1``; unsigned 32-bit: documents, ids, dictionary entries, words,
escapes; then one unsigned 32-bit length for each document, the dictionary (ids, most frequent
first), 64-bit words, and the escaped ids. An id is coded as its place in the dictionary plus 1, or
as 0 if it is not there: the next escaped id stands for it. A word's upper four bits select how many
codes of how many bits its lower 60 bits hold, lowest first; so a block is decoded selector by
selector, whole arrays at a time, and every word's place in the output is a running sum.

Files: rows are range-partitioned and sorted by document id; each task cuts its rows into blocks and
writes rows (part, block, before: ids of the part in earlier blocks, ids, keys, payload). A
document is never split. A text is cut into units that no token spans (words and the marks around them),
and each unit is encoded once for as long as a bounded memory of the task holds it; a text's ids are its units' ids.

Cases: null and empty texts are the end id alone. Rows with a null key come first; equal keys are
ordered by a hash of the text, and each row is a document. Special tokens' strings are ordinary text.
An empty table writes no block and reads back no row.
"""

from __future__ import annotations

import functools
import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from faultlens.llm.blocks import text_slices, utf8

BLOCK = 1 << 18  # ids from which a block is closed
KNOWN = 400_000  # units whose ids a task holds at a time
DICTIONARY = 1 << 14  # entries of a block's dictionary at most; rarer ids are escaped
# (codes in a word, bits of a code) by selector: the coding's fixed values.
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
_SELECTOR = np.zeros(61, np.int8)
_SELECTOR[[many for many, _ in SELECTORS]] = np.arange(len(SELECTORS))
_POWERS = 1 << np.arange(61)
_WIDTHS = np.searchsorted(_POWERS, np.arange(1 << 16), side="right").astype(np.uint8)
_MAGIC = b"S8B1"
_HEAD = struct.Struct("<4s5I")


def pack(codes: np.ndarray) -> np.ndarray:
    """64-bit words of the codes (below 2^60). Each word takes the most codes that fit."""
    n = len(codes)
    if not n:
        return np.empty(0, np.uint64)
    widths = np.searchsorted(_POWERS, codes, side="right") if codes.max() >> 16 else _WIDTHS[codes]
    # The greatest width of the next codes, for longer and longer stretches: each is two of the one before
    # that overlap. Behind the end all widths are zero, as zeros fill the last word up.
    widest, held = np.append(widths.astype(np.uint8), np.zeros(60, np.uint8)), 1
    step = np.ones(n, np.uint8)
    for many, bits in reversed(SELECTORS):
        widest = np.maximum(widest[: len(widest) - (many - held)], widest[many - held :])
        held = many
        np.copyto(step, many, where=widest[:n] <= bits)
    jump = step.tobytes()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += jump[i]
    starts = np.array(starts)
    chosen = _SELECTOR[step[starts]]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.append(codes.astype(np.uint64), np.zeros(60, np.uint64))
    for s, (many, bits) in enumerate(SELECTORS):
        own = np.flatnonzero(chosen == s)
        if len(own):
            shifts = np.arange(many, dtype=np.uint64) * np.uint64(bits)
            words[own] |= np.bitwise_or.reduce(padded[starts[own][:, None] + np.arange(many)] << shifts, axis=1)
    return words


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The first n codes of the words."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    many = np.array([c for c, _ in SELECTORS])[chosen]
    starts = np.cumsum(many) - many
    out = np.zeros(int(many.sum()), np.uint64)
    for s, (number, bits) in enumerate(SELECTORS):
        own = np.flatnonzero(chosen == s)
        if len(own):
            shifts = np.arange(number, dtype=np.uint64) * np.uint64(bits)
            out[starts[own][:, None] + np.arange(number)] = (words[own][:, None] >> shifts) & np.uint64((1 << bits) - 1)
    return out[:n]


def write_block(lengths: np.ndarray, ids: np.ndarray, dictionary: int = DICTIONARY) -> bytes:
    number = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    held = np.flatnonzero(number)
    entries = held[np.argsort(-number[held], kind="stable")][:dictionary]
    code = np.zeros(len(number), np.int64)
    code[entries] = np.arange(1, len(entries) + 1)
    codes = code[ids]
    escapes = ids[codes == 0]
    words = pack(codes)
    head = _HEAD.pack(_MAGIC, len(lengths), len(ids), len(entries), len(words), len(escapes))
    parts = (lengths.astype("<u4"), entries.astype("<u4"), words.astype("<u8"), escapes.astype("<u4"))
    return head + b"".join(p.tobytes() for p in parts)


def read_block(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the documents, and all ids."""
    magic, docs, n, entries, words, escapes = _HEAD.unpack_from(payload)
    if magic != _MAGIC:
        raise ValueError("not a block of token ids")
    at, parts = _HEAD.size, []
    for kind, number in (("<u4", docs), ("<u4", entries), ("<u8", words), ("<u4", escapes)):
        parts.append(np.frombuffer(payload, kind, number, at))
        at += parts[-1].nbytes
    codes = unpack(parts[2].astype(np.uint64), n).astype(np.int64)
    ids = np.append(np.uint32(0), parts[1])[codes].astype(np.uint32)
    ids[codes == 0] = parts[3]
    return parts[0].astype(np.int64), ids


# Kinds of bytes: white space, letters, digits, marks, apostrophes, bytes of other characters.
_KIND = np.full(256, 5, np.uint8)
_KIND[:128] = [0 if chr(b) in " \t\n\v\f\r" else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 4 if chr(b) == "'" else 3 for b in range(128)]
# Whether a unit starts at a byte, by the kind of the byte before it (times 8) and its own.
_STARTS = np.zeros(48, bool)
_STARTS[1:6] = True
_STARTS[[8 * a + b for a, b in ((1, 2), (1, 3), (1, 4), (2, 1), (2, 2), (2, 3), (2, 4), (3, 1), (3, 2))]] = True


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The parts of all texts that have the same ids wherever they stand, and how many each text has.
    Texts are cut at ASCII white space, and where two of ASCII letters, digits and marks meet, or two
    digits: no piece of the pre-tokenizer holds such a place (behind an apostrophe one may, so none is
    cut there), and no accent joins characters over it. The normaliser lower-cases them; a letter
    with an ASCII character behind it, which no accent joins before that, is so here, and spellings meet."""
    data, offsets = utf8(texts)
    upper = (data >= 65) & (data <= 90)
    upper[:-1] &= data[1:] < 128
    data = data + (upper.view(np.uint8) << 5)
    kind = _KIND[data]
    first = kind > 0
    body = first.copy()
    at_start = np.zeros(len(data) + 1, bool)
    at_start[offsets] = True
    first[1:] &= _STARTS[(kind[:-1] << 3) + kind[1:]] | at_start[1:-1]
    counts = np.diff(np.searchsorted(np.flatnonzero(first), offsets))
    held = data[body]
    starts = np.append(np.flatnonzero(first[body]), len(held))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(held)]), counts


class WordIds:
    """Ids of units, each unit encoded once while it is held."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's threads would wait for others
        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        # The pre-tokenizer's pattern, to know how many pieces a unit has: a fixed value of the vocabulary.
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.clear()

    def clear(self) -> None:
        self.words, self.ids = pa.array([], pa.large_binary()), pa.array([], pa.large_list(pa.uint32()))
        self.uses = np.empty(0, np.int64)

    def keep_common(self, known: int) -> None:
        """Forget the units that came once; all of them if too many are left."""
        held = np.flatnonzero(self.uses > 1)
        if 2 * len(held) > known:
            self.clear()
            return
        self.words, self.ids, self.uses = self.words.take(pa.array(held)), self.ids.take(pa.array(held)), np.ones(len(held), np.int64)

    def _batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and their number for each text."""
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.empty(0, np.uint32), *ids]), np.fromiter(map(len, ids), np.int64, len(ids))

    def learn(self, fresh: pa.Array) -> None:
        """Encode units that are not held, and hold them."""
        words = fresh.cast(pa.large_string()).to_pylist()
        # Units of known pieces are encoded fifty at a time; every piece ends with an end token.
        plain = np.array([w.isascii() or (len(w.lower()) == len(w) and unicodedata.is_normalized("NFC", w)) for w in words], bool)
        together = np.flatnonzero(plain)
        known = [words[i] for i in together.tolist()]
        pieces = np.array([1 if w.isalpha() else len(self.pieces(w.lower())) for w in known], np.int64)
        flat, tokens = self._batch([" ".join(known[i : i + 50]) for i in range(0, len(known), 50)])
        group = np.arange(len(known)) // 50
        ends, stops = self.ends[flat], np.cumsum(tokens)
        found = np.diff(np.append(0, np.cumsum(ends))[np.append(0, stops)])
        right = (found == np.bincount(group, pieces, len(tokens))) & ((tokens == 0) | np.append(True, ends)[stops])
        flat, pieces = flat[np.repeat(right, tokens)], pieces[right[group]]
        plain[together[~right[group]]] = False
        cuts = np.append(0, np.flatnonzero(self.ends[flat]) + 1)[np.append(0, np.cumsum(pieces))]
        alone = np.flatnonzero(~plain)
        rest, sizes = self._batch([words[i] for i in alone.tolist()])
        order = np.argsort(np.append(np.flatnonzero(plain), alone))
        lists = pa.LargeListArray.from_arrays(np.append(cuts, len(flat) + np.cumsum(sizes)), np.append(flat, rest))
        self.words = pa.concat_arrays([self.words, fresh])
        self.ids = pa.concat_arrays([self.ids, lists.take(pa.array(order)) if len(alone) else lists])
        self.uses = np.append(self.uses, np.zeros(len(words), np.int64))

    def encode(self, texts: list[str | None] | pa.Array, end: int, known: int) -> tuple[np.ndarray, np.ndarray]:
        """Lengths (with the end id) and ids of all texts."""
        if len(self.words) > known:
            self.keep_common(known)
        found, each = units(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        coded = found.dictionary_encode()
        place = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.words), -1).to_numpy().astype(np.int64)
        fresh, index = place < 0, coded.indices.to_numpy()
        place[fresh] = len(self.words) + np.arange(np.count_nonzero(fresh))
        if fresh.any():
            self.learn(coded.dictionary.filter(pa.array(fresh)))
        self.uses[place] += np.bincount(index, minlength=len(place))
        lists = self.ids.take(pa.array(place[index]))
        stops = lists.offsets.to_numpy()[np.cumsum(each)] - lists.offsets[0].as_py()
        return np.diff(stops, prepend=0) + 1, np.insert(lists.flatten().to_numpy(), stops, np.uint32(end))


@functools.lru_cache(maxsize=2)
def word_ids(model: str) -> WordIds:
    return WordIds(model)


_FILES = "part int, block int, before long, ids long, keys array<{key}>, payload binary"


def write_ids(docs: DataFrame, folder: str, path: str, end: int, key: str = "doc_id", text: str = "text", block: int = BLOCK, known: int = KNOWN) -> None:
    """Encode all texts with the tokenizer file ``path`` and write the blocks to ``folder``."""
    with open(path, encoding="utf-8") as file:
        model = file.read()  # the tokenizer's own file: its size doesn't depend on the data
    rows = docs.select(docs[key].alias("_key"), docs[text].alias("_text"), F.xxhash64(docs[text]).alias("_hash"))
    rows = rows.repartitionByRange("_key", "_hash").sortWithinPartitions("_key", "_hash").select("_key", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = word_ids(model), TaskContext.get().partitionId()
        keys: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        number, before, held = 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal number, before, held, keys, lengths, ids
            own = pa.concat_arrays(keys)
            payload = write_block(np.concatenate(lengths), np.concatenate(ids))
            listed = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            counts = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64())]
            number, before, held = number + 1, before + held, 0
            keys, lengths, ids = [], [], []
            return pa.RecordBatch.from_arrays([*counts, listed, pa.array([payload])], ["part", "block", "before", "ids", "keys", "payload"])

        for piece in text_slices(batches, "_text"):
            sizes, found = encoder.encode(piece.column("_text"), end, known)
            # Blocks close at the document that reaches the size.
            ends, start = np.cumsum(sizes), 0
            while start < len(sizes):
                base = ends[start] - sizes[start]
                stop = min(len(sizes), int(np.searchsorted(ends, base + block - held)) + 1)
                keys.append(piece.column("_key").slice(start, stop - start))
                lengths.append(sizes[start:stop])
                ids.append(found[base : ends[stop - 1]])
                held += int(ends[stop - 1] - base)
                start = stop
                if held >= block:
                    yield close()
        if keys:
            yield close()

    rows.mapInArrow(run, _FILES.format(key=docs.schema[key].dataType.simpleString())).write.parquet(folder)


def read_ids(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """Blocks with ``base``, the number of ids of all documents before the block."""
    blocks = spark.read.parquet(folder)
    # One row for each range part: as many as the write had tasks, whatever the size of the texts.
    parts = blocks.groupBy("part").agg(F.max(F.col("before") + F.col("ids")).alias("all"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("ahead"))
    return blocks.join(F.broadcast(offsets), "part").withColumn("base", F.col("ahead") + F.col("before")).drop("ahead")


def decode_rows(blocks: DataFrame, of, schema: str, key: str = "doc_id") -> DataFrame:
    """One row for each document: key, start, and what ``of(ids)`` gives for its ids."""
    kind = blocks.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lengths, ids = read_block(batch.column("payload")[i].as_py())
                ends = np.cumsum(lengths)
                starts = ends - lengths
                values = [of(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                made = pa.table({str(k): list(c) for k, c in enumerate(zip(*values))}).combine_chunks()
                columns = [batch.column("keys")[i].values, pa.array(starts + batch.column("base")[i].as_py())]
                columns += [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in made.columns]
                yield pa.RecordBatch.from_arrays(columns, [key, "start", *[x.split()[0] for x in schema.split(", ")]])

    return blocks.select("keys", "payload", "base").mapInArrow(run, f"`{key}` {kind}, start long, {schema}")


def checksums(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """n_tokens and the CRC32 of the ids as little-endian 32-bit integers."""
    return decode_rows(blocks, lambda ids: (len(ids), zlib.crc32(ids.astype("<u4").tobytes())), "n_tokens long, ids_crc32 long", key)
