"""SimHash near-duplicates: fingerprints of word shingles, linked inside shards by BK-trees.

Fingerprint: lower-case A-Z, words between white space, shingles of ``words`` words joined by one
blank (fewer words: the whole sequence), XXH64 with seed 42 of each, repeats included; a bit is set
if it is set in over half of the hashes. Texts without a word have fingerprint zero.

Links: the 64 bits are cut into ``blocks`` runs. Two fingerprints that differ in at most ``radius``
bits agree on at least ``blocks - radius`` whole runs, so each fingerprint enters one shard for each
choice of so many runs, keyed by their bits: no pair within the radius is missed. A shard holds different
fingerprints only (exact copies are one), and builds a BK-tree: children hang on the edge of their
Hamming distance to the parent, and a search follows only the edges within the radius of its own
distance. A shard over ``shard`` members is cut into slices, one tree for each; the other slices'
members search it in cells of their own. Cells emit a star for each group found, never all pairs.
Groups are then contracted: every node hooks onto the smallest hash among its neighbours until no link is left.

Cases: null text is empty. Rows with a null id get a fingerprint but no component and link nothing.
Repeated ids are one document. Fingerprint zero is linked like any other. Empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.blocks import mix, text_slices
from faultlens.operators.sizing import lookup_join, settle

SHARD = 8_192  # members of one tree, and searches sent to one tree at a time


def ones(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each text, how many of its hashes have each bit (the highest first) set."""
    out = np.zeros((len(sizes), 64), np.int64)
    held = np.flatnonzero(sizes)
    if len(held):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        out[held] = np.add.reduceat(bits, (np.cumsum(sizes) - sizes)[held], axis=0, dtype=np.int32)
    return out


def majority(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bits that are set in over half of a text's hashes, as one number."""
    packed = np.packbits(2 * counts > sizes[:, None], axis=1)
    return packed.reshape(-1, 8).copy().view(">u8").reshape(-1).astype(np.uint64)


def shingle_hashes(text: str | None, words: int) -> list[int]:
    # bytes.lower changes A-Z only; bytes.split cuts at the six white-space bytes only.
    found = text.encode().lower().split() if text else []
    if not found:
        return []
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return [digest(joined, 42)]
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-words] + 1)).tolist()
    return [digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist())]


def fingerprints(docs: DataFrame, words: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``_fp``, the fingerprint as a signed 64-bit number."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches, "_text"):
            each = [shingle_hashes(t, words) for t in piece.column("_text").to_pylist()]
            sizes = np.array([len(x) for x in each], np.int64)
            flat = np.fromiter((h for x in each for h in x), np.uint64, int(sizes.sum()))
            prints = majority(ones(flat, sizes), sizes).view(np.int64)
            yield pa.RecordBatch.from_arrays([piece.column("_key"), pa.array(prints)], [key, "_fp"])

    return docs.select(docs[key].alias("_key"), docs[text].alias("_text")).mapInArrow(run, f"`{key}` {kind}, _fp long")


def _shard_keys(fp: Column, blocks: int, radius: int) -> Column:
    """One key for each choice of ``blocks - radius`` runs of bits."""
    widths = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    lows = [sum(widths[:i]) for i in range(blocks)]
    masks = [((1 << w) - 1) << low for w, low in zip(widths, lows)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    chosen = list(combinations(range(blocks), blocks - radius))
    return F.array(
        *[
            F.struct(F.lit(i).cast("int").alias("choice"), fp.bitwiseAND(F.lit(signed(sum(masks[k] for k in c)))).alias("bits"))
            for i, c in enumerate(chosen)
        ]
    )


def _distance(prints: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Hamming distance of rows of 64-bit lanes to one row."""
    return np.bitwise_count(prints ^ one).sum(axis=1, dtype=np.int64)


class BKTree:
    """Tree over different fingerprints (rows of 64-bit lanes). A node is (member, {distance: subtree})."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.root = None
        work: list[tuple[np.ndarray, dict | None, int]] = [(np.arange(len(prints)), None, 0)]
        while work:
            members, above, edge = work.pop()
            node = (int(members[0]), {})
            if above is None:
                self.root = node
            else:
                above[edge] = node
            rest = members[1:]
            if len(rest):
                far = _distance(prints[rest], prints[members[0]])
                for d in np.unique(far).tolist():
                    work.append((rest[far == d], node[1], d))

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(member, indices of the queries within the radius of it), for all queries together."""
        work = [(self.root, np.arange(len(queries)))]
        while work:
            (member, children), asking = work.pop()
            far = _distance(queries[asking], self.prints[member])
            if (near := far <= radius).any():
                yield member, asking[near]
            for edge, child in children.items():
                follow = np.abs(far - edge) <= radius
                if follow.any():
                    work.append((child, asking[follow]))


def stars(tree: np.ndarray, queries: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Groups linked through one tree, as (member, first of its group), places in tree + queries.
    Stops when all are one group: further links could join nothing more."""
    n = len(tree) + (0 if queries is None else len(queries))
    asked, shift = (tree, 0) if queries is None else (queries, len(tree))
    parent = np.arange(n)
    groups = n

    def roots(x: np.ndarray) -> np.ndarray:
        up = parent[x]
        while (parent[up] != up).any():
            up = parent[up]
        parent[x] = up
        return up

    for member, near in BKTree(tree).search(asked, radius):
        met = np.unique(roots(np.append(near + shift, member)))
        if len(met) > 1:
            parent[met] = met[0]
            groups -= len(met) - 1
            if groups == 1:
                break
    final = roots(np.arange(n))
    moved = np.flatnonzero(final != np.arange(n))
    return moved, final[moved]


def linked(keyed: DataFrame, lanes: list[str], radius: int, shard: int = SHARD) -> DataFrame:
    """Links (a, b) of ``_node`` numbers whose closure is that of all links within the radius
    between rows that share a shard ``_key`` (long). ``lanes`` are the fingerprint's columns."""
    # Written first: the join below then deals both sides itself and can split a hot key.
    sizes = settle(keyed.groupBy("_key").count().filter(F.col("count") > 1))
    slices = F.ceil(F.col("count") / F.lit(shard)).cast("int")
    own = F.pmod(F.xxhash64("_node", F.lit(1)), slices).cast("long")
    cells = (
        keyed.join(sizes, "_key")
        .select("_key", "_node", *lanes, own.alias("_own"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("_other"))
        .select("_key", F.least("_own", "_other").alias("_a"), F.greatest("_own", "_other").alias("_b"), "_own", "_node", *lanes)
    )
    cell = ["_key", "_a", "_b"]
    together = cells.repartition(*cell).sortWithinPartitions(*cell, "_own", "_node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            columns = np.stack([batch.column(i).to_numpy() for i in range(batch.num_columns)], axis=1)
            whole = columns if not held else np.concatenate((*held, columns))
            # The last cell may go on in the next batch.
            change = np.flatnonzero((whole[1:, :3] != whole[:-1, :3]).any(axis=1)) + 1
            if len(change):
                yield from finish(whole[: change[-1]], change[:-1])
                held = [whole[change[-1] :]]
            else:
                held = [whole]
        if held and len(held[0]):
            yield from finish(held[0], np.empty(0, np.int64))

    def finish(rows: np.ndarray, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        found_a, found_b = [], []
        for part in np.split(rows, cuts):
            own, other, nodes = part[0, 1], part[0, 2], part[:, 4]
            prints = np.ascontiguousarray(part[:, 5:]).view(np.uint64)
            first = part[:, 3] == own
            if len(part) < 2 or (own != other and (first.all() or not first.any())):
                continue
            at = np.arange(len(part)) if own == other else np.concatenate((np.flatnonzero(first), np.flatnonzero(~first)))
            order, cell_ = nodes[at], (prints, None) if own == other else (prints[first], prints[~first])
            a, b = stars(*cell_, radius)
            found_a.append(order[a])
            found_b.append(order[b])
        if found_a:
            columns = [pa.array(np.concatenate(x)) for x in (found_a, found_b)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b"])

    return together.select(*cell, "_own", "_node", *lanes).mapInArrow(run, "a long, b long").distinct()


def links(prints: DataFrame, radius: int = 4, blocks: int = 6, shard: int = SHARD) -> DataFrame:
    """Links between different fingerprints ``_fp``; no pair within the radius is missed."""
    keys = prints.select("_fp", F.explode(_shard_keys(F.col("_fp"), blocks, radius)).alias("_key"))
    # The choice and its bits as one number; shards that met in it would only be searched together.
    return linked(keys.select(F.xxhash64("_key.choice", "_key.bits").alias("_key"), F.col("_fp").alias("_node"), "_fp"), ["_fp"], radius, shard)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b); the root stands for its component.

    Each round every node hooks onto the neighbour whose hash is smallest (or stays), and links move to
    the hooks; those inside a hook's own group vanish. Hashes make the hooking order random, so
    chains are short and each round leaves a fraction of the nodes. Tables only; nothing is collected."""
    moves: list[DataFrame] = []
    left = settle(edges.filter("a <> b"))
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
        hook = settle(both.groupBy("a").agg(F.least(F.min(rank("b")), F.min(rank("a"))).getField("n").alias("to")).withColumnRenamed("a", "node"))
        moves.append(hook)
        one = left.join(hook.withColumnRenamed("node", "a"), "a").select("b", F.col("to").alias("x"))
        two = one.join(hook.withColumnRenamed("node", "b").withColumnRenamed("to", "y"), "b").filter("x <> y")
        left = settle(two.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not moves:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    final = moves.pop()
    while moves:
        earlier = moves.pop()
        up = final.select(F.col("node").alias("to"), F.col("to").alias("up"))
        final = earlier.join(up, "to", "left").select("node", F.coalesce("up", "to").alias("to"))
    return final.withColumnRenamed("to", "root")


def near_duplicates(
    docs: DataFrame, words: int = 4, radius: int = 4, blocks: int = 6, shard: int = SHARD, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row for each document: key, fingerprint (16 hex digits), component_id: the smallest
    key that links lead to."""
    prints = settle(fingerprints(docs, words, key, text))
    known = prints.filter(F.col(key).isNotNull())
    # Rows that share an id are one document: their fingerprints are linked as well.
    same = known.groupBy(key).agg(F.min("_fp").alias("a"), F.max("_fp").alias("b")).filter("a <> b").select(key, "a")
    repeats = known.join(same, key).select("a", F.col("_fp").alias("b")).distinct()
    unique = known.groupBy("_fp").agg(F.min(key).alias("_least"))
    roots = settle(components(links(unique, radius, blocks, shard).unionByName(repeats)))
    rooted = unique.join(roots.withColumnRenamed("node", "_fp"), "_fp", "left").withColumn("root", F.coalesce("root", "_fp"))
    # Written first: the join then deals both sides itself and can split a hot component.
    least = settle(rooted.groupBy("root").agg(F.min("_least").alias("component_id")))
    named = rooted.join(least, "root").select("_fp", "component_id")
    out = prints.join(named, "_fp", "left")
    return out.select(
        key,
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col(key).isNotNull(), F.col("component_id")).alias("component_id"),
    )


LANES = 4  # 64-bit lanes of the wide fingerprint
BANDS, BAND_ROWS = 24, 5  # shard keys of a text, and minima in a key: 1 - (1 - 0.8^5)^24 of pairs at 0.8 share one, 0.99993
REACH = (24, 48, 72)  # bits of the wide fingerprint in which candidates may differ, closest first; at Jaccard 0.8 the mean is 39
STAR = 4_096  # sets compared with one set in one task
SHINGLES = 1 << 19  # shingles of the sets that are compared with each other in one task

_FACTORS = mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Different shingle hashes of a text, ascending."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def _set_number(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), 7)


def _bands(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Shard keys of each set that is not empty: a hash of ``BAND_ROWS`` minima, each under another
    multiplier of the shingle hashes. Two sets share a minimum with the chance of their Jaccard similarity."""
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    keys = np.empty((len(starts), BANDS), np.uint64)
    for band in range(BANDS if len(starts) else 0):
        key = np.full(len(starts), band + 1, np.uint64)
        for factor in _FACTORS[band * BAND_ROWS : (band + 1) * BAND_ROWS]:
            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + np.minimum.reduceat(flat * factor, starts))
        keys[:, band] = key
    return keys.view(np.int64)


def wide_fingerprints(docs: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """Key, ``_node`` (a number of the text's set of shingles), ``_size`` of the set, lanes f0 to f3 and shard
    keys of each text. Lanes take different mixes of the shingle hashes, each shingle once. Texts without a
    word have no shard key."""
    kind = docs.schema[key].dataType.simpleString()
    lanes = [f"f{k}" for k in range(LANES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches, "_text"):
            each = [shingle_set(t, words) for t in piece.column("_text").to_pylist()]
            sizes = np.array([len(x) for x in each], np.int64)
            flat = np.concatenate(each)
            mixed = [flat if k == 0 else mix(flat * np.uint64(2 * k + 1) + np.uint64(k)) for k in range(LANES)]
            prints = [majority(ones(x, sizes), sizes).view(np.int64) for x in mixed]
            nodes = np.array([_set_number(x) for x in each], np.uint64).view(np.int64)
            arrays = [pa.array(nodes), pa.array(sizes), *(pa.array(p) for p in prints)]
            ends = np.concatenate(([0], np.cumsum(np.where(sizes > 0, BANDS, 0)))).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(_bands(flat, sizes).reshape(-1))))
            yield pa.RecordBatch.from_arrays([piece.column("_key"), *arrays], [key, "_node", "_size", *lanes, "_keys"])

    columns = ", ".join(f"{x} long" for x in ("_node", "_size", *lanes))
    return docs.select(docs[key].alias("_key"), docs[text].alias("_text")).mapInArrow(run, f"`{key}` {kind}, {columns}, _keys array<long>")


class Groups:
    """Union-find over places."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.left = n

    def roots(self, x: np.ndarray) -> np.ndarray:
        up = self.parent[x]
        while (self.parent[up] != up).any():
            up = self.parent[up]
        self.parent[x] = up
        return up

    def new(self, one: int, many: np.ndarray) -> np.ndarray:
        """Joins ``one`` with those of ``many`` in other groups, and returns one place for each such group."""
        tops, first = np.unique(self.roots(many), return_index=True)
        top = self.roots(np.array([one]))[0]
        first = first[tops != top]
        self.parent[tops] = top
        self.left -= len(first)
        return many[first]


def forest(prints: np.ndarray, sizes: np.ndarray, asked: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of candidates that join all that candidates join, and the place that stands for each pair's tree.
    Candidates: fingerprints within the reach, set sizes that allow the similarity. Places up to ``asked``
    are in the BK-tree, the later ones search it; if none is later, the tree's own. Near pairs are taken first."""
    n = len(prints)
    shift = asked if asked < n else 0
    tree, groups = BKTree(prints[:asked]), Groups(n)
    found_a, found_b = [], []
    for radius in REACH:
        for member, near in tree.search(prints[shift:], radius):
            near = near + shift
            small, large = np.minimum(sizes[near], sizes[member]), np.maximum(sizes[near], sizes[member])
            near = groups.new(member, near[small >= similarity * large - 1e-9])
            found_a.append(np.full(len(near), member))
            found_b.append(near)
            if groups.left == 1:
                break
        if groups.left == 1:
            break
    a, b = (np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in (found_a, found_b))
    return a, b, groups.roots(a)


def candidates(unique: DataFrame, similarity: float, shard: int) -> DataFrame:
    """Candidate pairs (a, b) of nodes, a below b, with ``_tree``, a number of the cell and the tree in it.
    A shard over ``shard`` members is cut into slices, one BK-tree for each, and cells of two slices."""
    lanes = [f"f{k}" for k in range(LANES)]
    keyed = unique.select("_node", "_size", *lanes, F.explode("_keys").alias("_key"))
    slices = F.ceil(F.col("count") / F.lit(shard)).cast("int").alias("_slices")
    hot = settle(keyed.groupBy("_key").count().filter(F.col("count") > shard).select("_key", slices))
    if not hot.isEmpty():
        keyed = lookup_join(keyed, hot, "_key", "left")
        own = F.pmod(F.xxhash64("_node", F.lit(1)), F.coalesce("_slices", F.lit(1))).cast("long")
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_slices", F.lit(1)).cast("long") - 1))
    else:
        own = every = F.lit(0).cast("long")
    cells = keyed.select("_key", "_node", "_size", *lanes, own.alias("_own"), every.alias("_other"))
    cells = cells.select("_key", F.least("_own", "_other").alias("_x"), F.greatest("_own", "_other").alias("_y"), "_own", "_node", "_size", *lanes)
    cell = ["_key", "_x", "_y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 6 + LANES), np.int64)
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy() for i in range(batch.num_columns)], axis=1)
            whole = np.concatenate((held, rows))
            # The last cell may go on in the next batch.
            cuts = np.flatnonzero((whole[1:, :3] != whole[:-1, :3]).any(axis=1)) + 1
            if len(cuts):
                yield finish(whole[: cuts[-1]], np.concatenate(([0], cuts)))
                held = whole[cuts[-1] :].copy()
            else:
                held = whole
        yield finish(held, np.array([0, len(held)]))

    def finish(rows: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
        found = []
        sizes = np.diff(cuts)
        # Cells of two are most of all: at once.
        first = cuts[:-1][(sizes == 2)]
        first = first[rows[first, 1] == rows[first, 2]]
        x, y = rows[first], rows[first + 1]
        far = np.bitwise_count(x[:, 6:].view(np.uint64) ^ y[:, 6:].view(np.uint64)).sum(axis=1, dtype=np.int64)
        good = (far <= REACH[-1]) & (np.minimum(x[:, 5], y[:, 5]) >= similarity * np.maximum(x[:, 5], y[:, 5]) - 1e-9)
        found.append(named(x[good, :3], x[good, 4], x[good, 4], y[good, 4]))
        done = np.zeros(len(rows) + 1, bool)
        done[first] = True
        for at in np.flatnonzero((sizes > 1) & ~done[cuts[:-1]]):
            part = rows[cuts[at] : cuts[at + 1]]
            asked = len(part)
            if part[0, 1] != part[0, 2]:
                part = part[np.argsort(part[:, 3] != part[0, 1], kind="stable")]
                asked = int((part[:, 3] == part[0, 1]).sum())
                if asked == len(part) or part[0, 3] != part[0, 1]:
                    continue
            a, b, top = forest(np.ascontiguousarray(part[:, 6:]).view(np.uint64), part[:, 5], asked, similarity)
            if len(a):
                found.append(named(part[:1, :3], part[top, 4], part[a, 4], part[b, 4]))
        columns = [np.concatenate(c) for c in zip(*found)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["_tree", "a", "b"])

    def named(where: np.ndarray, top: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tree = top.astype(np.uint64)
        for k in range(3):
            tree = mix(tree * np.uint64(0x9E3779B97F4A7C15) + where[:, k].astype(np.uint64))
        return tree.view(np.int64), np.minimum(a, b), np.maximum(a, b)

    together = cells.repartition(*cell).sortWithinPartitions(*cell, "_own", "_node")
    return together.select(*cell, "_own", "_node", "_size", *lanes).mapInArrow(run, "_tree long, a long, b long")


_PLACE = "_node long, _to long, _x int, _y int, _role int, _group long"


def sets_at(places: DataFrame, unique: DataFrame, docs: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """The shingle set of every place's node, together and in order by (_to, _x, _y, _role, _node). A text is read
    once and its set made in the task that reads it; sets travel once for each place."""
    names = [c.split()[0] for c in _PLACE.split(", ")]
    asked = places.join(unique.select("_node", F.col("_least").alias("_id")), "_node")
    asked = asked.groupBy("_id").agg(F.collect_list(F.struct(*names)).alias("_places"))
    texts = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(asked.hint("merge"), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches, "_text"):
            for value, wanted in zip(piece.column("_text"), piece.column("_places")):
                held = shingle_set(value.as_py(), words)
                node = int(np.uint64(_set_number(held)).astype(np.int64))
                # Rows that repeat an id may have several texts; each has its own node.
                rows = [p for p in wanted.as_py() if p["_node"] == node]
                for at in range(0, len(rows), 64):
                    part = rows[at : at + 64]
                    columns = [pa.array([p[n] for p in part], pa.int64() if n in ("_node", "_to", "_group") else pa.int32()) for n in names]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([held.tobytes()] * len(part), pa.binary())], [*names, "_set"])

    moved = texts.select("_text", "_places").mapInArrow(run, f"{_PLACE}, _set binary")
    return moved.repartition("_to", "_x", "_y").sortWithinPartitions("_to", "_x", "_y", "_role", "_node")


def _similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def confirmed(pairs: DataFrame, unique: DataFrame, docs: DataFrame, words: int, similarity: float, key: str, text: str) -> DataFrame:
    """The pairs (a, b) whose sets have at least this Jaccard similarity. The node of a pair that has more pairs
    is its hub: a hub's set is sent once for up to ``STAR`` pairs, the other node's once for each pair. As hubs have
    the higher degree, a node is the other one in few pairs, however many it has."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("_n"))
    degree = settle(ends.groupBy("_n").count())
    of = lambda c: degree.select(F.col("_n").alias(c), F.col("count").alias(f"_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    is_a = F.col("_a") >= F.col("_b")
    starred = settle(
        both.select(
            F.when(is_a, F.col("a")).otherwise(F.col("b")).alias("_to"),
            F.when(is_a, F.col("b")).otherwise(F.col("a")).alias("_node"),
            F.ceil(F.greatest("_a", "_b") / F.lit(STAR)).cast("int").alias("_slices"),
        )
    )
    part = F.pmod(F.xxhash64("_node", F.lit(2)), F.col("_slices")).cast("int").alias("_x")
    none, zero = F.lit(None).cast("long").alias("_group"), F.lit(0).alias("_y")
    members = starred.select("_node", "_to", part, zero, F.lit(1).alias("_role"), none)
    hubs = starred.select("_to", part).distinct().select(F.col("_to").alias("_node"), "_to", "_x", zero, F.lit(0).alias("_role"), none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = None
        for batch in batches:
            good = []
            nodes, tos, roles = (batch.column(n).to_numpy() for n in ("_node", "_to", "_role"))
            for node, to, role, held in zip(nodes, tos, roles, batch.column("_set")):
                held = np.frombuffer(held.as_buffer(), np.uint64)
                if role == 0:
                    hub = held.copy()
                elif _similar(hub, held, similarity):
                    good.append((min(node, to), max(node, to)))
            kept = np.array(good, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(kept[:, 0]), pa.array(kept[:, 1])], ["a", "b"])

    return sets_at(hubs.unionByName(members), unique, docs, words, key, text).mapInArrow(run, "a long, b long").distinct()


def similar_groups(sets: list[np.ndarray], groups: np.ndarray, roles: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of places that join all groups which similar sets of different roles (of any, if there is one
    role) join. Common shingles of a set and all others are counted by lists of each shingle's owners."""
    _, start = np.unique(groups, return_index=True)
    joined = Groups(len(sets))
    joined.parent = start[np.unique(groups, return_inverse=True)[1]]
    joined.left = len(start)
    sizes = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owners = np.repeat(np.arange(len(sets)), sizes)[np.argsort(ids, kind="stable")]
    ends = np.cumsum(np.bincount(ids))
    begins = np.concatenate(([0], ends[:-1]))
    one_role = (roles == roles[0]).all()
    out, at = [], 0
    for i, size in enumerate(sizes):
        mine = ids[at : at + size]
        at += size
        if not one_role and roles[i] != roles[0]:
            continue
        many = ends[mine] - begins[mine]
        lists = np.repeat(begins[mine] - np.cumsum(many) + many, many) + np.arange(many.sum())
        common = np.bincount(owners[lists], minlength=len(sets))
        alike = common >= similarity * (size + sizes - common) - 1e-9
        alike &= (np.arange(len(sets)) > i) if one_role else (roles != roles[i])
        out += [(i, int(j)) for j in joined.new(i, np.flatnonzero(alike))]
        if joined.left == 1:
            break
    return out


def confirmed_inside(trees: DataFrame, unique: DataFrame, docs: DataFrame, words: int, similarity: float, key: str, text: str) -> DataFrame:
    """Links (a, b) that join all groups which similar sets of one tree join. ``trees`` has _tree, _node and the
    ``_group`` that the node is known to be in. Sets of a tree over ``SHINGLES`` are cut into slices, and
    slices meet in pairs; what leaves a task is a forest, never all pairs."""
    sized = settle(trees.join(unique.select("_node", "_size"), "_node"))
    same = [F.bit_xor(F.xxhash64("_node", F.lit(k))).alias(f"_h{k}") for k in (1, 2)]
    slices = F.ceil(F.sum("_size") / F.lit(SHINGLES)).cast("int").alias("_slices")
    each = sized.groupBy("_tree").agg(F.count("*").alias("_n"), *same, slices, F.min("_group").alias("_low"), F.max("_group").alias("_high"))
    # The same nodes may be a tree in several shards: one of these is enough.
    each = each.filter("_low <> _high").groupBy("_n", "_h1", "_h2", "_slices").agg(F.min("_tree").alias("_tree"))
    rows = sized.join(settle(each.select("_tree", "_slices")), "_tree")
    own = F.pmod(F.xxhash64("_node", F.lit(3)), F.col("_slices")).cast("int")
    rows = rows.select("_node", "_tree", "_group", own.alias("_role"), F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_other"))
    low, high = F.least("_role", "_other").alias("_x"), F.greatest("_role", "_other").alias("_y")
    places = rows.select("_node", F.col("_tree").alias("_to"), low, high, "_role", "_group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cell = {}, None
        for batch in batches:
            numbers = [batch.column(n).to_numpy() for n in ("_to", "_x", "_y", "_node", "_group", "_role")]
            for *where, node, group, role, kept in zip(*numbers, batch.column("_set")):
                if where != cell:
                    yield finish(held)
                    held, cell = {}, where
                held[int(node)] = (np.frombuffer(kept.as_buffer(), np.uint64).copy(), int(group), int(role))
        yield finish(held)

    def finish(held: dict) -> pa.RecordBatch:
        found = []
        if len(held) > 1:
            sets, groups, roles = zip(*held.values())
            found = similar_groups(list(sets), np.array(groups), np.array(roles), similarity)
        nodes, pairs = np.array(list(held), np.int64), np.array(found, np.int64).reshape(-1, 2)
        a, b = nodes[pairs[:, 0]], nodes[pairs[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return sets_at(places, unique, docs, words, key, text).mapInArrow(run, "a long, b long")


def set_links(unique: DataFrame, docs: DataFrame, words: int, similarity: float, shard: int, key: str, text: str) -> DataFrame:
    """Links (a, b) between nodes whose closure is that of all candidates with this Jaccard similarity.
    First a forest of each shard's candidates is confirmed. A tree in which every pair was confirmed can join nothing
    more; of the others, the sets of nodes that are still apart are compared inside the tree."""
    found = settle(candidates(unique, similarity, shard))
    first = settle(confirmed(found.select("a", "b").distinct(), unique, docs, words, similarity, key, text))
    open_trees = settle(found.join(first.hint("merge"), ["a", "b"], "left_anti").select("_tree").distinct())
    if open_trees.isEmpty():
        return first
    groups = settle(components(first)).select(F.col("node").alias("_node"), F.col("root").alias("_group"))
    nodes = found.join(open_trees.hint("merge"), "_tree", "left_semi").select("_tree", F.explode(F.array("a", "b")).alias("_node")).distinct()
    nodes = nodes.join(groups, "_node", "left").withColumn("_group", F.coalesce("_group", "_node"))
    return first.unionByName(settle(confirmed_inside(nodes, unique, docs, words, similarity, key, text)))


def keep_representatives(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, shard: int = SHARD, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the document with the smallest id stays.

    Two texts are near-duplicates if their sets of word shingles have a Jaccard similarity of at least
    ``similarity``; groups follow the links. Candidates share a shard (one of ``BANDS`` keys of ``BAND_ROWS`` minima each,
    64 bits, so shards don't grow with the number of unlike texts), and are within the reach of the wide fingerprint in the
    shard's BK-tree; every link is confirmed by the sets. Texts without a word are like each other only. Rows with
    a null id stay; rows that repeat an id are one document, of which the row with the smallest text stays."""
    known = docs.filter(F.col(key).isNotNull())
    prints = settle(wide_fingerprints(known, words, key, text))
    node = F.col("_node")
    # Equal nodes are equal sets, so they have equal sizes, lanes and keys.
    same = [F.first(c).alias(c) for c in ("_size", *(f"f{k}" for k in range(LANES)), "_keys")]
    unique = settle(prints.groupBy("_node").agg(F.min(key).alias("_least"), *same))
    repeats = prints.groupBy(key).agg(F.count("*").alias("n"), F.min(node).alias("a"), F.max(node).alias("b")).filter("n > 1")
    repeats = settle(repeats)
    found = set_links(unique, known, words, similarity, shard, key, text)
    roots = settle(components(found.unionByName(repeats.select("a", "b").filter("a <> b"))))
    rooted = unique.select("_node", "_least").join(roots.withColumnRenamed("node", "_node"), "_node", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "_node"))
    # Written first: the join then deals both sides itself and can split a hot component.
    least = settle(rooted.groupBy("root").agg(F.min("_least").alias("_kept")))
    named = settle(rooted.join(least, "root").select("_node", "_kept"))
    # Only ids that go are sent to the texts.
    gone = settle(prints.select(key, "_node").join(named, "_node").filter(F.col(key) != F.col("_kept")).select(key).distinct())
    # One plan at every size: the ids that go grow with the corpus, so they are never sent whole.
    left = docs.join(gone.hint("merge"), key, "left_anti").select(docs.columns)
    if repeats.isEmpty():
        return left
    twice = left.join(repeats.select(key), key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*docs.columns), F.struct(F.col(text))).alias("_row"))
    return left.join(repeats.select(key), key, "left_anti").select(docs.columns).unionByName(twice.select("_row.*"))
