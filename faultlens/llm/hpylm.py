"""Hierarchical Pitman-Yor bigram model, seated by Gibbs sampling over the whole corpus.

Every word is a context with a restaurant of its own; the customers of restaurant u are the tokens that
follow u, its tables share dishes (words), and each table is a customer of the common parent restaurant, whose
base is uniform over the known words and one unknown. A text's first token follows the end token.
A restaurant with c customers and t tables for a word, C customers and T tables in all gives

    P(word | u) = (c - d t + (s + d T) P(word)) / (s + C),

and so does the parent with the base. Discounts d come from the counts of counts, strengths s are
parameters. The table numbers t of a restaurant's words have the joint law

    prod S_d(c, t) (d P)^t  Gamma(s / d + T),  T the sum of all t,

with generalised Stirling numbers S_d. A sweep draws g from Gamma(s / d + T) for each restaurant; given g the gamma
function falls apart, and every t is drawn from its own S_d(c, t) (d P g)^t, all words of a restaurant at
once and in any number of tasks. Both draws leave the joint law as it is (given the parent's
probabilities P). Then the parent's customers are seated in the same way. Predictive probabilities are averaged over
the sweeps after the first ones.

How it runs: texts become blocks of word hashes. Blocks ask key ranges of words and of word pairs, each
different key once for each block; pair ranges hold the restaurants' shared tables (a pair that stands
once always has one table, so only pairs that stand twice take part), word ranges the parent's. A sweep
sends sums between pair and word ranges; the driver sees two totals a sweep. At the end the
ranges answer the blocks, which score their texts. Any word or pair costs one entry for each block.

Cases: null text is empty and has the end token alone. Rows with a null key are scored and count as the
remainder of an empty text. Repeated rows count each. Without training rows every probability is the base's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.blocks import distinct, mix, text_slices, word_hashes
from faultlens.llm.exchange import bundle, ranges, unbundle
from faultlens.operators.sizing import settle

END = np.uint64(0x5EED0E4DC0FFEE11)  # the end token, in place of a word's hash
EXACT = 128  # customers up to which the numbers come from a table; beyond, the same numbers come from an integral
NODES, REACH = 64, 40.0  # places of the integral on one half of its path, and how far it goes: exp(-REACH) is left out
BLOCK_BYTES = 4_000_000
_48 = np.uint64(16)  # words are known to pairs by the upper 48 bits of their hash


@dataclass(frozen=True)
class Settings:
    strength: float = 1.0  # of the context restaurants
    root_strength: float = 1.0
    burn_in: int = 1  # sweeps before those that are averaged
    samples: int = 2
    add: float = 0.1  # of the base model
    seed: int = 11


# Sampling of table numbers


def log_stirling(most: int, d: float) -> np.ndarray:
    """log of the generalised Stirling numbers S_d(c, t), c and t up to ``most``."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0
    t = np.arange(most + 1)
    for c in range(1, most + 1):
        with np.errstate(divide="ignore"):
            stay = out[c - 1] + np.log(np.maximum(c - 1 - d * t, 0))
        out[c, 1:] = np.logaddexp(out[c - 1, :-1], stay[1:])
    return out


def draw_tables(customers: np.ndarray, x: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Table numbers of dishes with these customers; x is what a new table weighs."""
    tables = np.minimum(customers, 1)
    small = customers <= EXACT
    order = np.argsort(customers, kind="stable")
    order = order[(customers[order] > 1) & small[order]]
    if len(order):
        table = log_stirling(int(customers[order[-1]]), d)
        cuts = np.flatnonzero(np.diff(customers[order])) + 1
        for run in np.split(order, cuts):
            c = int(customers[run[0]])
            t = np.arange(1, c + 1)
            for part in np.array_split(run, max(1, len(run) * c // 2_000_000)):
                weight = table[c, 1 : c + 1] + np.log(x[part])[:, None] * t
                mass = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), axis=1)
                tables[part] = 1 + (rng.random(len(part))[:, None] * mass[:, -1:] > mass).sum(1).clip(max=c - 1)
    large = np.flatnonzero(~small)
    if len(large):
        tables[large] = _draw_large(customers[large].astype(float), x[large].astype(float), d, rng)
    return tables


def restaurant_weight(tables: np.ndarray | float, strength: float, d: float, rng: np.random.Generator) -> np.ndarray:
    """Draws of g for restaurants with so many tables; a new table of a dish of chance P then weighs d P g."""
    return rng.gamma(strength / d + tables)


def _center(c: np.ndarray, x: np.ndarray, d: float) -> np.ndarray:
    """About the mean of t under S_d(c, t) x^t: expected tables at the strength v with v^(1-d) (v+c)^d = x."""
    low, high = np.full(len(c), -700.0), np.log(np.maximum(x, 1e-300)) + 1
    for _ in range(60):
        mid = (low + high) / 2
        over = (1 - d) * mid + d * np.log(np.exp(mid) + c) > np.log(x)
        low, high = np.where(over, low, mid), np.where(over, mid, high)
    v = np.exp(low)
    return np.clip(1 + (x - v) / d, 1, c)


def _draw_large(c: np.ndarray, x: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Draws of t from S_d(c, t) x^t where a table of the numbers would be too long."""
    out, chance = np.empty(len(c), np.int64), rng.random(len(c))
    center = _center(c, x, d)
    # t is a sum of c independent 0/1 draws, so its variance is below its mean and below c less its mean.
    half = 9 * np.sqrt(np.minimum(center, c - center + 1)) + 20
    todo = np.argsort(half, kind="stable")
    while len(todo):
        again = []
        for run in np.array_split(todo, -(-len(todo) // 2048)):
            low = np.floor(np.maximum(1, center[run] - half[run]))
            width = int(np.max(np.minimum(c[run], np.ceil(center[run] + half[run])) - low)) + 1
            weight = log_weights(c[run], x[run], d, low, center[run], width)
            top = weight.max(1)
            # A window that cuts off mass is widened.
            cut = ((low > 1) & (weight[:, 0] > top - 25)) | ((low + width <= c[run]) & (weight[:, -1] > top - 25))
            mass = np.cumsum(np.exp(weight - top[:, None]), axis=1)
            found = (chance[run][:, None] * mass[:, -1:] > mass).sum(1)
            out[run] = np.minimum(low + found, c[run])
            again.append(run[cut])
        todo = np.concatenate(again)
        half[todo] *= 2
    return out


def log_weights(c: np.ndarray, x: np.ndarray, d: float, low: np.ndarray, center: np.ndarray, width: int) -> np.ndarray:
    """log of S_d(c, t) x^t for t = low, low + 1, ..., up to a constant of each row.

    S_d(c, t) = c! / (t! d^t) [z^c] (1 - (1 - z)^d)^t; the coefficient is an integral over z = exp(-s), taken
    along a parabola around the cut of (1 - z)^d, through the saddle point of the middle t (or at 1/c, if
    that is farther from the cut; there the integral of 1, which is 0, is taken off), or along the whole
    circle where the integrand is not narrow on it."""
    a, b = np.log(1e-300) * np.ones(len(c)), np.full(len(c), np.log(25.0))
    middle = np.minimum(center, c - 0.5)
    gap = lambda s: np.where(s.real > 0.7, np.log1p(-np.exp(-np.where(s.real > 0.7, s, 1))), np.log(-np.expm1(-np.where(s.real > 0.7, 1, s))))
    slope = lambda s: c - middle * d * np.exp(-s + (d - 1) * gap(s)) / -np.expm1(d * gap(s))
    for _ in range(60):
        mid = (a + b) / 2
        with np.errstate(all="ignore"):
            left = slope(np.exp(mid)) < 0
        a, b = np.where(left, mid, a), np.where(left, b, mid)
    saddle = np.exp(a)
    near = saddle * c < 1
    sigma = np.where(near, 1 / c, saddle)
    bend = (slope(sigma * 1.001) - slope(sigma * 0.999)) / (0.002 * sigma)
    reach = np.sqrt(np.where(near, 1 + REACH, REACH / np.maximum(sigma**2 * bend, 1e-300)))
    round_ = (2 * sigma * reach > 1)[:, None]
    y = (np.arange(NODES) + 0.5) / NODES * np.where(round_, np.pi / (2 * sigma[:, None]), reach[:, None])
    s = np.where(round_, sigma[:, None] * (1 + 2j * y), sigma[:, None] * (1 + 1j * y) ** 2)
    top = -np.expm1(d * gap(sigma))
    ratio = -np.expm1(d * gap(s)) / top[:, None]
    turn, along = np.where(round_, 1, 1 + 1j * y), c[:, None] * (s - sigma[:, None])
    value = turn * np.exp(along + low[:, None] * np.log(ratio))
    one = np.where(near, (turn * np.exp(along)).real.sum(1), 0)
    t = low[:, None] + np.arange(width)
    out = np.empty((len(c), width))
    for k in range(width):
        out[:, k] = value.real.sum(1) - one * np.exp(-(low + k) * np.log(top)) if near.any() else value.real.sum(1)
        value *= ratio
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.log(np.maximum(out, 0)) + t * (np.log(x / d) + np.log(top))[:, None] - _log_factorial(t)
    return np.where((t <= c[:, None]) & ~np.isnan(out), out, -np.inf)


def _log_factorial(t: np.ndarray) -> np.ndarray:
    exact = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 32)))))
    n = np.maximum(t, 31)
    series = (n + 0.5) * np.log(n) - n + 0.5 * np.log(2 * np.pi) + 1 / (12 * n) - 1 / (360 * n**3)
    return np.where(t < 32, exact[np.minimum(t, 31).astype(np.int64)], series)


# Blocks of texts

_BLOCK = "block long, keys array<{key}>, held binary, sizes binary, words binary, tokens binary"


def _blocks(docs: DataFrame, key: str, text: str, held_out: Column) -> DataFrame:
    rows = docs.select(docs[key].alias("_key"), docs[text].alias("_text"), F.coalesce(held_out, F.lit(False)).alias("_held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for piece in text_slices(batches, "_text", BLOCK_BYTES):
            hashed, counts = word_hashes(piece.column("_text"))
            ends = np.cumsum(counts + 1)
            tokens = np.full(len(hashed) + len(counts), END, np.uint64)
            body = np.ones(len(tokens), bool)
            body[ends - 1] = False
            tokens[body] = hashed
            words, index = np.unique(tokens, return_inverse=True)
            keys = piece.column("_key")
            listed = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            held = piece.column("_held").to_numpy(zero_copy_only=False).astype(np.uint8)
            parts = [bundle(held), bundle((counts + 1).astype(np.uint32)), bundle(_steps(words)), bundle(index.astype(np.uint32))]
            yield pa.RecordBatch.from_arrays([pa.array([block]), listed, *(pa.array([p]) for p in parts)], ["block", "keys", "held", "sizes", "words", "tokens"])
            block += 1

    return rows.mapInArrow(run, _BLOCK.format(key=docs.schema[key].dataType.simpleString()))


def _steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending.dtype.type(0))


@dataclass
class Block:
    """A block's words and pairs, in the order in which it asks for them."""

    held: np.ndarray
    sizes: np.ndarray
    words: np.ndarray
    tokens: np.ndarray
    parts: int
    word_parts: int

    @staticmethod
    def open(held: bytes, sizes: bytes, words: bytes, tokens: bytes, parts: int, word_parts: int) -> Block:
        one = lambda data, kind: unbundle(data, kind)[0]
        return Block(one(held, np.uint8) > 0, one(sizes, np.uint32).astype(np.int64), np.cumsum(one(words, np.uint64), dtype=np.uint64), one(tokens, np.uint32).astype(np.int64), parts, word_parts)

    def __post_init__(self) -> None:
        self.train = np.repeat(~self.held, self.sizes)
        self.word_counts = np.bincount(self.tokens[self.train], minlength=len(self.words)).astype(np.uint32)
        end = int(np.searchsorted(self.words, END))
        before = np.roll(self.tokens, 1)
        before[np.cumsum(self.sizes) - self.sizes] = end
        short = self.words >> _48
        self.word_part = part_of(short, self.word_parts)
        # Pairs by range, then context, then word. A context's pairs lie in up to 8 ranges.
        pair = before * len(self.words) + self.tokens
        unique, inverse = np.unique(pair, return_inverse=True)
        u, w = unique // len(self.words), unique % len(self.words)
        part = (mix(short[u] * np.uint64(8) + (short[w] & np.uint64(7))) % np.uint64(self.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")  # words ascend with their numbers, so u and w are in order
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.u, self.w, self.part, self.pair = u[order], w[order], part[order], place[inverse]
        self.pair_counts = np.bincount(self.pair[self.train], minlength=len(self.u)).astype(np.uint32)
        self.short = short


def part_of(short: np.ndarray, parts: int) -> np.ndarray:
    """Word range of 48-bit words: ranges ascend with the words."""
    return ((short >> np.uint64(32)) * np.uint64(parts) >> np.uint64(16)).astype(np.int64)


def _runs(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(range, its slice) of ascending range numbers."""
    if len(part):
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield int(part[a]), slice(a, b)


def _table(**columns) -> pa.Table:
    return pa.table(columns)


_STATE = "kind int, part int, block long, payload binary, n long, v long, n1 long, n2 long"


def _state(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
    columns = list(zip(*rows)) if rows else [[]] * 8
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _STATE.split(", ")])


def _count(kind: int, part: int, asked: list[tuple[int, bytes]]) -> pa.Table:
    """A range's keys with their counts (block -1), and for every block where its keys are among them."""
    if kind == 0:
        own = [unbundle(p, np.uint64, np.uint32) for _, p in asked]
        keys = [(np.cumsum(steps, dtype=np.uint64), count) for steps, count in own]
        every, many = np.concatenate([k for k, _ in keys]), np.concatenate([c for _, c in keys]).astype(np.int64)
        unique, inverse = np.unique(every, return_inverse=True)
        columns = (unique,)
    else:
        own = [unbundle(p, np.uint64, np.uint64, np.uint32) for _, p in asked]
        us, ws = np.concatenate([np.cumsum(u, dtype=np.uint64) for u, _, _ in own]), np.concatenate([w for _, w, _ in own])
        many = np.concatenate([c for _, _, c in own]).astype(np.int64)
        order = np.lexsort((ws, us))
        new = np.concatenate(([True], (np.diff(us[order]) != 0) | (np.diff(ws[order]) != 0)))
        inverse = np.empty(len(us), np.int64)
        inverse[order] = np.cumsum(new) - 1
        columns = (us[order][new], ws[order][new])
    count = np.bincount(inverse, many, len(columns[0])).astype(np.int64)
    # Words that stand twice, and pairs that do, have tables to share; others follow from their count.
    kept = count > 1
    number = np.cumsum(kept) - 1
    columns = tuple(c[kept] for c in columns)
    summary = (int(count.sum()), int((count > 0).sum()), int((count == 1).sum()), int((count == 2).sum()))
    if kind == 0:
        rows = [(kind, part, -1, bundle(*columns, count[kept]), *summary)]
    else:
        # Restaurants by number: the words once (block -2), then context, word and customers of each pair.
        named = distinct(np.concatenate(columns))
        numbers = [np.searchsorted(named, c).astype(np.uint32) for c in columns]
        rows = [(kind, part, -1, bundle(_steps(numbers[0]), numbers[1], count[kept].astype(np.uint32)), *summary)]
        rows.append((kind, part, -2, bundle(_steps(named)), 0, 0, 0, 0))
    at = 0
    for (block, _), columns_ in zip(asked, own):
        n = len(columns_[-1])
        found, own_count = inverse[at : at + n], many[at : at + n]
        at += n
        # The block hears of keys that stand twice, and of single ones that it hasn't itself.
        told = np.flatnonzero(kept[found] | ((count[found] == 1) & (own_count == 0)))
        where = np.where(kept[found[told]], number[found[told]] + 1, 0)  # 0: stands once
        rows.append((kind, part, block, bundle(np.diff(told, prepend=0).astype(np.uint32), where.astype(np.uint32)), 0, 0, 0, 0))
    return _state(rows)


def score_texts(docs: DataFrame, held_out: Column, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every text; learned
    from the texts that are not held out."""
    s, spark = settings, docs.sparkSession
    # Pair and word ranges write to each other in every sweep, so their product is kept small.
    parts, word_parts = ranges(spark), max(1, 2 * ranges(spark, 1) // 5)
    blocks = settle(_blocks(docs, key, text, held_out))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column("block")[i].as_py()
                b = Block.open(*(batch.column(c)[i].as_py() for c in ("held", "sizes", "words", "tokens")), parts, word_parts)
                rows = [(0, p, block, bundle(_steps(b.words[at]), b.word_counts[at])) for p, at in _runs(b.word_part)]
                us, ws = b.short[b.u], b.short[b.w]
                rows += [(1, p, block, bundle(_steps(us[at]), ws[at], b.pair_counts[at])) for p, at in _runs(b.part)]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["kind", "part", "block", "payload"])

    def count(names: tuple, group: pa.Table) -> pa.Table:
        return _count(names[0].as_py(), names[1].as_py(), sorted(zip(group.column("block").to_pylist(), group.column("payload").to_pylist())))

    asked = blocks.mapInArrow(ask, "kind int, part int, block long, payload binary")
    counted = settle(asked.groupBy("kind", "part").applyInArrow(count, _STATE))
    sums = {r.kind: r for r in counted.filter("block = -1").groupBy("kind").agg(*(F.sum(c).alias(c) for c in ("n", "v", "n1", "n2"))).collect()}
    if not sums:
        return spark.createDataFrame([], f"`{key}` {docs.schema[key].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    discount = lambda r: float(np.clip(r.n1 / max(1, r.n1 + 2 * r.n2), 0.1, 0.95))
    tokens, words, d, d0 = sums[0].n, sums[0].v, discount(sums[1]), discount(sums[0])

    word_state = counted.filter("kind = 0 and block = -1").select("part", "payload")
    pair_state = counted.filter("kind = 1 and block = -1").select("part", "payload")
    # What pair ranges say next: the words that they name, and the customers who share a table. Before the
    # first sweep every dish has one table.
    names_of = counted.filter("kind = 1 and block = -2").select("part", F.col("payload").alias("named"))
    seats, chain = None, []
    for sweep in range(s.burn_in + s.samples):
        keep = sweep >= s.burn_in

        def report(names: tuple, own: pa.Table, held: pa.Table) -> pa.Table:
            """Customers that share a table, by context and by word, to the word ranges."""
            named = np.cumsum(unbundle(held.column("named")[0].as_py(), np.uint64)[0], dtype=np.uint64)
            u, w, c, t, _ = _restaurants(own)
            by_u = np.bincount(u, c - t, len(named)).astype(np.uint32)
            by_w = np.bincount(w, c - t, len(named)).astype(np.uint32)
            rows = [(p, names[0].as_py(), bundle(_steps(named[at]), by_u[at], by_w[at])) for p, at in _runs(part_of(named, word_parts))]
            kinds = (pa.int32(), pa.int32(), pa.binary())
            return pa.table([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 3, kinds)], names=["part", "origin", "payload"])

        # One weight for the parent, drawn once; those of the contexts are drawn where their tables are summed up.
        root_tables = chain[-1][2] if chain else words
        root_weight = float(restaurant_weight(root_tables, s.root_strength, d0, np.random.default_rng([s.seed, sweep, 2])))

        def parent(names: tuple, told: pa.Table, own: pa.Table) -> pa.Table:
            """Seat the parent's customers of a word range; answer every pair range that reported
            with its contexts' weights."""
            keys, c = unbundle(own.column("payload")[0].as_py(), np.uint64, np.int64) if own.num_rows else (np.empty(0, np.uint64), np.empty(0, np.int64))
            part, short = names[0].as_py(), keys >> _48
            shared_u, shared_w, asks = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64), []
            for origin, payload in sorted(zip(told.column("origin").to_pylist(), told.column("payload").to_pylist())):
                steps, by_u, by_w = unbundle(payload, np.uint64, np.uint32, np.uint32)
                at = np.minimum(np.searchsorted(short, np.cumsum(steps, dtype=np.uint64)), len(c) - 1)
                np.add.at(shared_u, at, by_u.astype(np.int64))
                np.add.at(shared_w, at, by_w.astype(np.int64))
                asks.append((origin, at))
            tables, customers = (c - shared_u).astype(np.float32), np.maximum(c - shared_w, 1)
            rng = np.random.default_rng([s.seed, sweep, part, 0])
            weights = restaurant_weight(tables, s.strength, d, rng).astype(np.float32)
            shares = draw_tables(customers, np.full(len(c), d0 * root_weight / (words + 1)), d0, rng)
            number = (customers - d0 * shares).astype(np.float32)
            rows = [(origin, part, bundle(weights[at], number[at]), 0, 0) for origin, at in asks]
            counts = (shared_u.astype(np.uint32), shared_w.astype(np.uint32), shares.astype(np.uint32))
            rows.append((-1, part, bundle(*counts), int(shared_w.sum()), int((shares - 1).sum())))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
            return pa.table([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["part", "origin", "payload", "shared", "extra"])

        state = pair_state.withColumn("what", F.lit(0))
        if seats is not None:
            state = state.unionByName(seats)
        reports = state.groupBy("part").cogroup(names_of.groupBy("part")).applyInArrow(report, "part int, origin int, payload binary")
        heard = settle(reports.groupBy("part").cogroup(word_state.groupBy("part")).applyInArrow(parent, "part int, origin int, payload binary, shared long, extra long"))
        shared, extra = heard.filter("part = -1").agg(F.coalesce(F.sum("shared"), F.lit(0)), F.coalesce(F.sum("extra"), F.lit(0))).first()
        # Totals of the parent: customers, and tables (one for each word, and the drawn ones).
        chain.append((heard, tokens - shared, words + extra))

        totals = chain[-1][1:]

        def seat(names: tuple, own: pa.Table, told: pa.Table) -> pa.Table:
            """Draw the table numbers of a pair range's restaurants."""
            u, w, c, t, total = _restaurants(own)
            answers = dict(zip(told.column("origin").to_pylist(), told.column("payload").to_pylist()))
            if not len(c):
                return _seats([])
            # Word ranges ascend, and each answered in the order of the report.
            found = [unbundle(answers[p], np.float32, np.float32) for p in sorted(answers)]
            weights, number = (np.concatenate(x).astype(float) for x in zip(*found))
            chance = (number[w] + (s.root_strength + d0 * totals[1]) / (words + 1)) / (s.root_strength + totals[0])
            x = d * weights[u] * chance
            t = draw_tables(c, np.maximum(x, 1e-300), d, np.random.default_rng([s.seed, sweep, names[0].as_py(), 1]))
            return _seats([(names[0].as_py(), bundle(t.astype(np.uint32), (total + (t if keep else 0)).astype(np.uint32)), 1)])

        seats = settle(state.groupBy("part").cogroup(heard.filter("part >= 0").groupBy("part")).applyInArrow(seat, "part int, payload binary, what int"))

    # Answers to the blocks: words with tables and customers of every sample, pairs with mean tables.
    samples = chain[s.burn_in :]
    spoken = None
    for k, (told, _, _) in enumerate(samples):
        own = told.filter("part = -1").select(F.col("origin").alias("part"), F.lit(k).alias("k"), "payload")
        spoken = own if spoken is None else spoken.unionByName(own)
    asks = lambda kind: counted.filter(f"kind = {kind} and block >= 0").select("part", "block", "payload")
    word_rows = word_state.withColumn("what", F.lit(-1)).unionByName(spoken.select("part", "payload", F.col("k").alias("what")))
    pair_rows = pair_state.withColumn("what", F.lit(0)).unionByName(seats)

    def answer(kind: int):
        def run(names: tuple, asked: pa.Table, own: pa.Table) -> pa.Table:
            part, held = names[0].as_py(), dict(zip(own.column("what").to_pylist(), own.column("payload").to_pylist()))
            if kind == 0:
                _, c = unbundle(held[-1], np.uint64, np.int64)
                columns, single = [c.astype(np.uint32)], [1, *[0, 0, 1] * s.samples]
                for k in range(s.samples):
                    columns += unbundle(held[k], np.uint32, np.uint32, np.uint32)
            else:
                _, _, c, _, total = _restaurants(own)
                columns, single = [(c - d * total / s.samples).astype(np.float32)], [1.0 - d]
            columns = [np.concatenate(([one], x)).astype(x.dtype) for one, x in zip(single, columns)]
            rows = []
            for block, payload in zip(asked.column("block").to_pylist(), asked.column("payload").to_pylist()):
                steps, where = unbundle(payload, np.uint32, np.uint32)
                rows.append((kind, part, block, bundle(steps, *(x[where] for x in columns))))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
            return pa.table([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=["kind", "part", "block", "payload"])

        return run

    said = [
        asks(kind).groupBy("part").cogroup(rows.groupBy("part")).applyInArrow(answer(kind), "kind int, part int, block long, payload binary")
        for kind, rows in ((0, word_rows), (1, pair_rows))
    ]
    totals = [t[1:] for t in samples]

    def score(own: pa.Table, told: pa.Table) -> pa.Table:
        b = Block.open(*(own.column(c)[0].as_py() for c in ("held", "sizes", "words", "tokens")), parts, word_parts)
        answers = {(k, p): x for k, p, x in zip(*(told.column(c).to_pylist() for c in ("kind", "part", "payload")))}
        # Words that the ranges say nothing of stand once, here, or nowhere.
        once = (b.word_counts > 0).astype(float)
        c, tables, number = once.copy(), np.repeat(once[None], s.samples, 0), np.repeat(once[None] * (1 - d0), s.samples, 0)
        whole = lambda x: x.astype(np.int64)
        for p, at in _runs(b.word_part):
            if (0, p) in answers:
                steps, count, *columns = unbundle(answers[0, p], *[np.uint32] * (2 + 3 * s.samples))
                place, count = at.start + np.cumsum(whole(steps)), whole(count)
                c[place] = count
                for k in range(s.samples):
                    shared_u, shared_w, shares = map(whole, columns[3 * k : 3 * k + 3])
                    tables[k, place] = count - shared_u
                    number[k, place] = np.maximum(count - shared_w, 1) - d0 * shares
        left = np.where(b.pair_counts > 0, 1.0 - d, 0.0)
        for p, at in _runs(b.part):
            if (1, p) in answers:
                steps, rest = unbundle(answers[1, p], np.uint32, np.float32)
                left[at.start + np.cumsum(steps.astype(np.int64))] = rest
        above = np.zeros(len(b.u))
        for k, (customers, tables0) in enumerate(totals):
            chance = (number[k] + (s.root_strength + d0 * tables0) / (words + 1)) / (s.root_strength + customers)
            above += (s.strength + d * tables[k][b.u]) * chance[b.w]
        pair = np.log10((left + above / s.samples) / (s.strength + c[b.u]))
        base = np.log10((c + s.add) / (tokens + s.add * (words + 1)))
        first = np.cumsum(b.sizes) - b.sizes
        add = lambda x: np.add.reduceat(x, first)
        columns = {
            key: own.column("keys").combine_chunks().flatten(),
            "held_out": pa.array(b.held),
            "n_tokens": pa.array(b.sizes),
            "n_known": pa.array(add((c > 0).astype(np.int64)[b.tokens])),
            "train_tokens": pa.array(np.full(len(b.sizes), tokens)),
            "base_score": pa.array(add(base[b.tokens])),
            "score": pa.array(add(pair[b.pair])),
        }
        return pa.table(columns)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(said[0].unionByName(said[1]).groupBy("block")).applyInArrow(score, schema)


def _seats(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows) if rows else [[]] * 3
    return pa.table([pa.array(x, k) for x, k in zip(columns, (pa.int32(), pa.binary(), pa.int32()))], names=["part", "payload", "what"])


def _restaurants(own: pa.Table) -> tuple[np.ndarray, ...]:
    """Context, word, customers, tables and summed tables of a pair range's pairs. Row 0 has the
    pairs, row 1, once there is one, the seats."""
    held = dict(zip(own.column("what").to_pylist(), own.column("payload").to_pylist()))
    steps, w, c = unbundle(held[0], np.uint32, np.uint32, np.uint32)
    u, c = np.cumsum(steps.astype(np.int64)), c.astype(np.int64)
    if 1 in held:
        t, total = (x.astype(np.int64) for x in unbundle(held[1], np.uint32, np.uint32))
    else:
        t, total = np.ones(len(c), np.int64), np.zeros(len(c), np.int64)
    return u, w.astype(np.int64), c, t, total


def perplexity(scored: DataFrame, by: str = "held_out", score: str = "score") -> DataFrame:
    """Texts, tokens and perplexity 10^(-score / tokens) of each value of ``by``; null counts as a value.
    No rows, no result; a text has its end token at least, so the division is defined."""
    sums = scored.groupBy(by).agg(F.count("*").alias("texts"), F.sum("n_tokens").alias("tokens"), F.sum(score).alias("_score"))
    return sums.select(by, "texts", "tokens", F.pow(F.lit(10.0), -F.col("_score") / F.col("tokens")).alias("perplexity"))
