"""Spelling variants of a corpus' words by a dictionary of trie-node pairs.

Every prefix of a word is a node of the forward trie, every suffix one of the reversed trie. A node's number is
computed from its parent's number and its letter (64 bits), so all tasks give a node the same number and the
tries need not stand in one place. A word of L letters enters the dictionary under integer pairs (prefix node, suffix node):
the L pairs around a skipped letter, and the L + 1 pairs around a place where a letter may be inserted. Then

* two words that meet by skipped letters differ by exactly one replaced letter, and meet in one pair only;
* a word that skips a letter meets the word without that letter at its insertion pair. Of a run of equal letters only
  the first is used, so these meet in one pair only as well.

So a pair's entry holds one word by insertion at most, and no more words by skipping than there are letters; nothing is
compared with all others, long words cost as many integers as letters, and near words are exact (a false
meeting needs two 64-bit numbers to agree by chance).

Words are numbered in code-point order, so the best near word is a comparison of integers. Roots are found by pointer
doubling over the words that have a form.

Cases: a null text has no run; a null id counts as empty text. Words that are null are not looked at; rows that repeat a word are
added up (a null count is 0). Ties of n go to the smaller word. Empty tables give none; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.blocks import mix, text_slices
from faultlens.operators.sizing import settle, skew_join, with_position

RUNS = re.compile("[a-zÀ-ÿ]+")
HELD = 100_000  # different words a task counts before it passes them on
AT_ONCE = 4_096  # words whose tries are walked together
_STEP = np.uint64(0x9E3779B97F4A7C15)


def run_counts(docs: DataFrame, typo_every: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all letter runs, A-Z lower-cased, summed for each task's part of the corpus, not yet
    over all. Where ``typo_every`` divides the CRC-32 of ``<key>:<run>``, the run loses the letter at that
    CRC-32 modulo its length; a run of one letter then gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for piece in text_slices(batches, "_text"):
            for own, body in zip(piece.column("_key").to_pylist(), piece.column("_text").to_pylist()):
                start = zlib.crc32(f"{own}:".encode())
                # bytes.lower changes A-Z only
                for word, n in Counter(RUNS.findall(body.encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % typo_every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    counts[word] += n
            if len(counts) > HELD:
                yield batch_of(counts)
                counts = Counter()
        yield batch_of(counts)

    def batch_of(counts: Counter) -> pa.RecordBatch:
        counts.pop("", None)
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return rows.mapInArrow(run, "word string, n long")


def walk(letters: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node numbers of all prefixes and all suffixes of words, whose letters stand one word after the
    other. A word of L letters has L + 1 of each; suffix i is what follows the first i letters."""
    first = np.cumsum(sizes) - sizes
    nodes = first + np.arange(len(sizes))  # where a word's L + 1 numbers begin
    prefix = np.empty(len(letters) + len(sizes), np.uint64)
    suffix = np.empty_like(prefix)
    prefix[nodes], suffix[nodes + sizes] = 1, 2
    for depth in range(int(sizes.max(initial=0))):
        on = np.flatnonzero(sizes > depth)
        at, last = nodes[on] + depth, nodes[on] + sizes[on] - depth
        prefix[at + 1] = mix(prefix[at] * _STEP + letters[first[on] + depth])
        suffix[last - 1] = mix(suffix[last] * _STEP + letters[first[on] + sizes[on] - 1 - depth])
    return prefix, suffix


def pairs(words: DataFrame) -> DataFrame:
    """The dictionary: prefix node, suffix node, the word's number ``_w`` and ``n``, and ``_how``: 0 for an insertion
    pair, 1 for a skipped letter, 2 for a skipped letter that is the first of its run. From (word, n, _w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for piece in (whole.slice(i, AT_ONCE) for i in range(0, whole.num_rows, AT_ONCE)):
                texts = piece.column("word").to_pylist()
                sizes = np.array([len(t) for t in texts], np.int64)
                letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
                prefix, suffix = walk(letters, sizes)
                word = np.repeat(np.arange(len(sizes)), sizes)
                at = np.arange(len(letters)) + word  # place of a letter's prefix node
                fresh = np.ones(len(letters), bool)
                fresh[1:] = (letters[1:] != letters[:-1]) | (word[1:] != word[:-1])
                both = np.repeat(np.arange(len(sizes)), sizes + 1)
                rows = np.concatenate((word, both))
                columns = [np.concatenate((prefix[at], prefix)), np.concatenate((suffix[at + 1], suffix))]
                how = np.concatenate((1 + fresh, np.zeros(len(both)))).astype(np.int8)
                arrays = [pa.array(c.view(np.int64)) for c in columns]
                arrays += [piece.column("_w").take(pa.array(rows)), piece.column("n").take(pa.array(rows)), pa.array(how)]
                yield pa.RecordBatch.from_arrays(arrays, ["_p", "_s", "_w", "n", "_how"])

    return words.select("word", "n", "_w").mapInArrow(run, "_p long, _s long, _w long, n long, _how byte")


def meetings(dictionary: DataFrame) -> DataFrame:
    """(_w, n_near, best) for each dictionary entry in which a word meets others; ``best`` is the near
    word there of largest n, as struct (n, -number)."""
    one = F.struct(F.col("n").alias("n"), (-F.col("_w")).alias("m"), F.col("_how").alias("how"))
    # At most one word by insertion and one for each letter by skipping.
    met = dictionary.groupBy("_p", "_s").agg(F.sort_array(F.collect_list(one), asc=False).alias("_all")).filter(F.size("_all") > 1)
    near = lambda own, x: ((own["how"] > 0) & (x["how"] > 0)) | (own["how"] + x["how"] == 2) & ((own["how"] == 0) | (x["how"] == 0))
    rows = met.select("_all", F.explode("_all").alias("_own"))
    others = F.filter("_all", lambda x: (x["m"] != F.col("_own")["m"]) & near(F.col("_own"), x))
    found = rows.select((-F.col("_own.m")).alias("_w"), others.alias("_near")).filter(F.size("_near") > 0)
    return found.select("_w", F.size("_near").cast("long").alias("n_near"), F.get("_near", F.lit(0)).alias("_top")).select(
        "_w", "n_near", F.struct(F.col("_top.n").alias("n"), F.col("_top.m").alias("m")).alias("best")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(_w, _root) of the words with a form, from (_w, _form). Each round doubles the steps."""
    held = settle(forms.select("_w", F.col("_form").alias("_root")))
    while True:
        on = held.select(F.col("_w").alias("_root"), F.col("_root").alias("_next"))
        moved = settle(skew_join(held, on, "_root", "left"))
        held = moved.select("_w", F.coalesce("_next", "_root").alias("_root"))
        if moved.filter(F.col("_next").isNotNull()).isEmpty():
            return held


def group(words: DataFrame, least: int = 3, letters: int = 5, factor: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of at least ``letters`` code points whose ``n`` sums up
    to at least ``least``. Two words are near if one inserted, deleted or replaced code point makes them equal. A word's form is its near
    word of largest n, if that is at least ``factor`` times its own; its root is where forms lead to."""
    long = words.filter(F.length("word") >= letters)
    counted = long.groupBy("word").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n")).filter(F.col("n") >= least)
    known = settle(with_position(settle(counted), "word", "_w").select("_w", "word", "n"))
    parts = meetings(pairs(known)).groupBy("_w").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best"))
    near = settle(parts.select("_w", "n_near", F.col("best.n").alias("_n"), (-F.col("best.m")).alias("_form")))
    taken = settle(near.join(known.select("_w", "n"), "_w").filter(F.col("_n") >= factor * F.col("n")).select("_w", "_form", F.col("_n").alias("form_n")))
    ends = roots(taken)
    names = lambda c, to: known.select(F.col("_w").alias(c), F.col("word").alias(to))
    # A form or root may have very many words: those joins cut hot keys.
    led = skew_join(skew_join(taken.join(ends, "_w"), names("_form", "form"), "_form", "left"), names("_root", "root"), "_root", "left")
    out = known.join(near.select("_w", "n_near"), "_w", "left").join(led.select("_w", "form", "root", "form_n"), "_w", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
