"""Benchmark decontamination: a BM25 index of the test items, asked with every training passage.

Items are the indexed texts; a passage is a window of words of a training text. Items belong to length classes
of up to 8, 16, 32, ... words; a class has passages of twice its greatest length, moved by half of that, so that each item
that stands in a text lies whole in some passage of its class, whatever other items there are. Each class has an
index of its own, with word statistics of all items. An item's score for a passage is BM25 over the passage's different words,
divided by the score that the item gives itself: 1 if the passage holds all its words. All items at or
above the threshold are found by block-max WAND: posting lists by item with the greatest
contribution of each list and of each block of it; a passage whose words' list maxima do not add up to
the threshold is passed over (the maxima of long lists are taken item by item there), and so are
blocks whose maxima do not. Hits are then verified: the
share of the item's question n-grams and of its answer n-grams that stand in the passage.

The indexes go to the executors, so items are cut into shards of at most ``shard_bytes`` of
text, by length; each shard is one pass over the texts, which are hashed once for all classes of the shard. The
shard size changes no result.

Cases: null and empty texts are never hits; null, empty and wordless items are never found. Items
with equal texts are found each. Repeated rows give repeated results; no item, no hits.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.blocks import MARKS, distinct, mix, text_slices, word_hashes
from faultlens.operators.sizing import settle


SHORTEST = 8  # words of the shortest length class


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.5  # of the item's own score
    part: float = 0.5  # share of n-grams of the question, and of the answer, that must be found
    whole: float = 0.6  # or this share of all n-grams of the item
    n: int = 3  # words in an n-gram; a shorter part is one n-gram
    k1: float = 1.2
    b: float = 0.75
    block: int = 64  # postings with one maximum
    rare: int = 8  # a list of so few items is short
    shard_bytes: int = 8_000_000  # item text that goes to the executors at once


def question_and_answer(text: str | None) -> tuple[str, str]:
    """An item without fields of its own: its last sentence is the answer, what stands before is
    the question; a single sentence is both."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", (text or "").strip()) if re.search(r"\w", p)]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text or "", text or "")


def hashed(texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    array = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    return word_hashes(pc.utf8_lower(array), MARKS)


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    n = min(n, len(words))
    if not n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out + words[k : len(words) - n + 1 + k])
    return distinct(out)


@dataclass
class Index:
    """Posting lists of the items of one length class in a shard."""

    settings: Settings
    ids: list
    window: int
    terms: np.ndarray
    most: np.ndarray  # greatest contribution of each term
    lists: list[tuple[list[int], list[float], list[float]]]  # items, contributions, block maxima
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # n-grams

    def __post_init__(self) -> None:
        """Lists of few items, flat, and for each item what its words in longer lists can add."""
        lengths = np.array([len(x[0]) for x in self.lists])
        self.rare = lengths <= self.settings.rare
        self.sizes = np.where(self.rare, lengths, 0)
        self.starts = np.cumsum(self.sizes) - self.sizes
        rare = [x for x, few in zip(self.lists, self.rare) if few]
        self.flat_items = np.array([i for x in rare for i in x[0]], np.int64)
        self.flat_parts = np.array([w for x in rare for w in x[1]], float)
        self.others = np.zeros(len(self.ids))
        for x, few in zip(self.lists, self.rare):
            if not few:
                self.others[x[0]] += x[1]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.terms & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def spots(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the indexed words, and their numbers."""
        maybe = np.flatnonzero(self.seen[(words & np.uint64(0xFFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, words[maybe]), len(self.terms) - 1)
        found = self.terms[at] == words[maybe]
        return maybe[found], at[found]

    def may_hold(self, where: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Passages (of ``where``) in which some item can reach the threshold: the contributions of
        the words in short lists, and all that the item's other words could add."""
        few = self.rare[which]
        where, which = where[few], which[few]
        n = self.sizes[which]
        flat = np.arange(int(n.sum())) + np.repeat(self.starts[which] - (np.cumsum(n) - n), n)
        pair = np.repeat(where, n) * len(self.ids) + self.flat_items[flat]
        pairs, inverse = np.unique(pair, return_inverse=True)
        bound = np.bincount(inverse, self.flat_parts[flat], len(pairs)) + self.others[pairs % len(self.ids)]
        return distinct(pairs[bound >= self.settings.threshold - 1e-9] // len(self.ids))

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Every item whose score reaches the threshold, by block-max WAND."""
        need, step = self.settings.threshold - 1e-9, self.settings.block
        live = [[self.lists[t][0][0], 0, *self.lists[t], float(self.most[t])] for t in terms]
        found = []
        while live:
            live.sort(key=lambda x: x[0])
            total, pivot = 0.0, -1
            for i, x in enumerate(live):
                total += x[5]
                if total >= need:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = live[pivot][0]
            while pivot + 1 < len(live) and live[pivot + 1][0] == item:
                pivot += 1
            bound, beyond = 0.0, live[pivot + 1][0] if pivot + 1 < len(live) else 1 << 60
            for x in live[: pivot + 1]:
                at = bisect_left(x[2], item, x[1])
                if at < len(x[2]):
                    bound += x[4][at // step]
                    last = min(len(x[2]), (at // step + 1) * step) - 1
                    beyond = min(beyond, x[2][last] + 1)
            if bound < need:
                target = max(beyond, item + 1)  # no item of these blocks can reach the threshold
            elif live[0][0] == item:
                score = sum(x[3][x[1]] for x in live[: pivot + 1])
                if score >= need:
                    found.append((item, score))
                target = item + 1
            else:
                target = item
            for x in live[: pivot + 1]:
                if x[0] < target:
                    x[1] = bisect_left(x[2], target, x[1])
                    x[0] = x[2][x[1]] if x[1] < len(x[2]) else -1
            live = [x for x in live if x[0] >= 0]
        return found


def length_class(words: int) -> int:
    """Greatest number of words of an item's class: the next power of two, SHORTEST at least."""
    return max(SHORTEST, 1 << (words - 1).bit_length())


def build_indexes(items: list[tuple[object, str, str]], known: dict[int, int], n_items: int, average: float, s: Settings) -> list[Index]:
    """``items``: id, question, answer. ``known``: number of items with each word, of all shards."""
    classes: dict[int, list[tuple]] = {}
    for key, question, answer in items:
        q, a = hashed([question])[0], hashed([answer])[0]
        words = q if question == answer else np.concatenate((q, a))
        if len(words):
            classes.setdefault(length_class(len(words)), []).append((key, words, q, a))
    return [_build(rows, 2 * longest, known, n_items, average, s) for longest, rows in sorted(classes.items())]


def _build(rows: list[tuple], window: int, known: dict[int, int], n_items: int, average: float, s: Settings) -> Index:
    postings: dict[int, list[tuple[int, float]]] = {}
    for i, (_, words, _, _) in enumerate(rows):
        terms, tf = np.unique(words, return_counts=True)
        have = np.array([known[t] for t in terms.tolist()], float)
        idf = np.log1p((n_items - have + 0.5) / (have + 0.5))
        part = idf * tf * (s.k1 + 1) / (tf + s.k1 * (1 - s.b + s.b * len(words) / average))
        for t, w in zip(terms.tolist(), (part / part.sum()).tolist()):
            postings.setdefault(t, []).append((i, w))
    terms = np.array(sorted(postings), np.uint64)
    lists = []
    for t in terms.tolist():
        own, weight = map(list, zip(*postings[t]))
        lists.append((own, weight, [max(weight[k : k + s.block]) for k in range(0, len(weight), s.block)]))
    parts = [(ngrams(q, s.n), ngrams(a, s.n), ngrams(w, s.n)) for _, w, q, a in rows]
    most = np.array([max(x[1]) for x in lists])
    return Index(s, [r[0] for r in rows], window, terms, most, lists, parts)


def hits(texts: pa.Array, shard: list[Index]) -> list[tuple[int, object, float, float, float]]:
    """(row, item id, score, question overlap, answer overlap) of verified hits, the best
    passage of each row and item."""
    words, sizes = hashed(texts)
    if not len(words):
        return []
    return [h for index in shard for h in _hits(words, sizes, index)]


def _hits(words: np.ndarray, sizes: np.ndarray, index: Index) -> list[tuple[int, object, float, float, float]]:
    s, best = index.settings, {}
    spot, term = index.spots(words)
    # Passages begin every half window; a text that ends inside one has no further passage.
    half = index.window // 2
    ends = np.cumsum(sizes)
    begins = ends - sizes
    number = np.maximum(1, -(-sizes // half) - 1)
    first = np.cumsum(number) - number
    row = np.searchsorted(ends, spot, side="right")
    slot = (spot - begins[row]) // half
    passage = np.concatenate((first[row] + np.minimum(slot, number[row] - 1), first[row] + slot - 1))
    ok = np.concatenate((np.ones(len(spot), bool), (slot > 0) & (slot <= number[row] - 1)))
    pairs = distinct(passage[ok] * len(index.terms) + np.concatenate((term, term))[ok])
    where, which = pairs // len(index.terms), pairs % len(index.terms)
    total = np.bincount(where, index.most[which], int(number.sum()))
    able = total >= s.threshold - 1e-9
    # An item made of common words alone could be held by any passage; then all are asked.
    if index.others.max(initial=0.0) < s.threshold:
        kept = able[where]
        able = np.zeros(len(total), bool)
        able[index.may_hold(where[kept], which[kept])] = True
    for p in np.flatnonzero(able).tolist():
        lo, hi = np.searchsorted(where, [p, p + 1])
        found = index.search(which[lo:hi].tolist())
        if not found:
            continue
        r = int(np.searchsorted(first, p, side="right")) - 1
        start = int(begins[r]) + (p - int(first[r])) * half
        have = ngrams(words[start : min(start + index.window, int(ends[r]))], s.n)
        for item, score in found:
            q, a, whole = (_share(x, have, words[start : min(start + index.window, int(ends[r]))], s.n) for x in index.parts[item])
            if (q >= s.part and a >= s.part) or whole >= s.whole:
                best[r, item] = max(best.get((r, item), (0.0, 0.0, 0.0)), (score, q, a))
    return [(r, index.ids[i], *v) for (r, i), v in sorted(best.items())]


def _share(part: np.ndarray, have: np.ndarray, words: np.ndarray, n: int) -> float:
    """Share of a part's n-grams that stand in the passage. A part of fewer than n words is one
    shorter n-gram, which the passage's n-grams can't show; it is looked for among its own length."""
    if not len(part):
        return 0.0
    share = float(np.isin(part, have).mean())
    if share < 1 and len(part) == 1:
        share = max(share, *(float(np.isin(part, ngrams(words, k)).mean()) for k in range(1, n)))
    return share


def indexes(items: DataFrame, settings: Settings = Settings(), key: str = "item_id", text: str = "text", answer: str | None = None) -> Iterator[list[Index]]:
    """The shards' indexes, one after the other. With ``answer`` the text is the question."""
    s = settings
    rows = items.select(F.col(key).alias("id"), F.col(text).alias("q"), F.col(answer if answer else text).alias("a"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("q").isNotNull()).withColumn("a", F.coalesce("a", F.lit("")))
    split = answer is None

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = hashed([q])[0] if split else np.concatenate((hashed([q])[0], hashed([a])[0]))
                if len(words):
                    own = np.unique(words).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), len(words) / len(own)))], ["term", "words"])

    # Every word of an item carries an equal share of the item's length, so one sum gives the total.
    told = settle(rows.select("q", "a").mapInArrow(terms, "term long, words double").groupBy("term").agg(F.count("*").alias("n"), F.sum("words").alias("words")))
    sized = settle(rows.withColumn("size", F.octet_length("q") + F.when(F.lit(split), 0).otherwise(F.octet_length("a"))))
    facts = sized.agg(F.count("*"), F.sum("size"), F.max("size")).first()
    total_words = told.agg(F.sum("words")).first()[0]
    if not facts[0] or not total_words:
        return
    shards = max(1, -(-facts[1] // s.shard_bytes))
    # Shards by length, so that a shard has few classes. Cut values come from a sketch of the lengths.
    cuts = sized.approxQuantile("size", [i / shards for i in range(1, shards)], 0.001) if shards > 1 else []
    bounds = [-1.0, *sorted(set(cuts)), float("inf")]
    for low, high in zip(bounds, bounds[1:]):
        band = sized.filter((F.col("size") > low) & (F.col("size") <= high))
        pieces = max(1, -(-(band.agg(F.sum("size")).first()[0] or 0) // (2 * s.shard_bytes)))
        for i in range(pieces):
            own = band.filter(F.pmod(F.xxhash64("id", "q"), F.lit(pieces)) == i)
            held = [(r.id, *((question_and_answer(r.q)) if split else (r.q, r.a))) for r in own.orderBy("id", "q").collect()]
            wanted = own.select("q", "a").mapInArrow(terms, "term long, words double").select("term").distinct()
            known = {r.term % (1 << 64): r.n for r in told.join(wanted, "term").select("term", "n").collect()}
            shard = build_indexes(held, known, facts[0], total_words / facts[0], s)
            if shard:
                yield shard


def find_leaks(docs: DataFrame, items: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", answer: str | None = None) -> DataFrame:
    """One row for each text and item that it holds: key, item key, score, overlaps."""
    kinds = f"`{key}` {docs.schema[key].dataType.simpleString()}, `{item_key}` {items.schema[item_key].dataType.simpleString()}"
    schema = f"{kinds}, score double, question_overlap double, answer_overlap double"
    narrow = docs.select(docs[key].alias("_key"), docs[text].alias("_text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for shard in indexes(items, settings, item_key, item_text, answer):

        def run(batches: Iterator[pa.RecordBatch], shard: list[Index] = shard) -> Iterator[pa.RecordBatch]:
            for piece in text_slices(batches, "_text"):
                found = hits(piece.column("_text"), shard)
                if found:
                    rows, items_, score, q, a = zip(*found)
                    columns = [piece.column("_key").take(pa.array(rows)), pa.array(items_)]
                    columns += [pa.array(x, pa.float64()) for x in (score, q, a)]
                    yield pa.RecordBatch.from_arrays(columns, [key, item_key, "score", "question_overlap", "answer_overlap"])

        out = out.unionByName(narrow.mapInArrow(run, schema))
    return out


def remove_leaks(docs: DataFrame, items: DataFrame, settings: Settings = Settings(), text: str = "text", item_key: str = "item_id", item_text: str = "text", answer: str | None = None) -> DataFrame:
    """The rows, with all columns, of the texts that hold no item."""
    columns = [f"_c{i}" for i in range(len(docs.columns))]
    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(columns, docs.schema.fields))
    at = f"_c{docs.columns.index(text)}"
    out = docs.toDF(*columns)
    for shard in indexes(items, settings, item_key, item_text, answer):

        def run(batches: Iterator[pa.RecordBatch], shard: list[Index] = shard) -> Iterator[pa.RecordBatch]:
            for piece in text_slices(batches, at):
                keep = np.ones(piece.num_rows, bool)
                keep[[h[0] for h in hits(piece.column(at), shard)]] = False
                yield piece.filter(pa.array(keep))

        out = out.mapInArrow(run, schema)
    return out.toDF(*docs.columns)
