"""Operators on whole texts against plain code."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from faultlens.llm import blocks, catalog, chunks, decontaminate, hpylm, langid, line_windows, simhash
from pyspark.sql import functions as F

from .conftest import SMALL


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_word_hashes():
    texts = ["One two  one", None, "", "\tTWO\n", "ü Ü"]
    hashed, counts = blocks.word_hashes(pa.array(texts, pa.string()))
    flat = [w for t in texts for w in words(t)]
    assert counts.tolist() == [len(words(t)) for t in texts]
    assert len(set(hashed.tolist())) == len(set(flat)) == len({(w, h) for w, h in zip(flat, hashed.tolist())})


# SimHash


def plain_components(rows, radius, n=4):
    prints = []
    for _, text in rows:
        w = [x.encode() for x in words(text)]
        shingles = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        near = (prints[i] ^ prints[j]).bit_count() <= radius or rows[i][0] == rows[j][0]
        if near and rows[i][0] is not None and rows[j][0] is not None:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        least[root(i)].append(key)
    return Counter((k, f"{p:016x}", min(least[root(i)]) if k is not None else None) for i, ((k, _), p) in enumerate(zip(rows, prints)))


@pytest.mark.parametrize("shard", [3, 8192])
def test_simhash_equals_plain(spark, documents, odd, shard):
    for docs, radius in ((documents, 4), (documents, 12), (odd, 4)):
        blocks_ = 6 if radius == 4 else 14
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        if radius == 12:
            rows, docs = rows[:60], docs.limit(60)
            rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        if blocks_ == 14 and shard == 3:
            continue
        prints = simhash.near_duplicates(docs, radius=radius, blocks=blocks_, shard=shard)
        assert Counter(map(tuple, prints.collect())) == plain_components(rows, radius)


def test_stars_find_all_groups():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 12, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 62, (240, 3)).astype(np.uint64), axis=1)
    prints = np.unique(np.repeat(base, 20) ^ flips)[:, None]
    member, first = simhash.stars(prints, None, 4)
    group = np.arange(len(prints))
    for a, b in zip(member, first):
        group[a] = b
    far = np.bitwise_count(prints ^ prints.T)
    plain = np.arange(len(prints))
    for _ in range(len(prints)):
        plain = np.array([plain[row <= 4].min() for row in far])
    assert len(set(zip(group.tolist(), plain.tolist()))) == len(set(plain.tolist())) == len(set(group.tolist()))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert len({roots[i] for i in range(41)}) == 1 and roots[100] == roots[101] != roots[0]


def test_representatives(spark, documents, odd, none):
    kept = [r.doc_id for r in simhash.keep_representatives(documents).select("doc_id").collect()]
    texts = {r.doc_id: set(simhash.shingle_hashes(r.text, 5)) for r in documents.select("doc_id", "text").collect()}
    assert len(kept) == len(set(kept))
    share = lambda a, b: len(texts[a] & texts[b]) / max(1, len(texts[a] | texts[b]))
    assert not [(a, b) for a, b in combinations(kept, 2) if share(a, b) >= 0.8]
    group = {i: i for i in texts}  # the smallest id that links of at least 0.8 lead to; texts without a word are alike
    links = [(a, b) for a, b in combinations(texts, 2) if share(a, b) >= 0.8 or not (texts[a] or texts[b])]
    for _ in texts:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    assert sorted(kept) == sorted(set(group.values()))
    rows = simhash.keep_representatives(odd).collect()
    ids = [r.doc_id for r in rows]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 6, 8, 9] and None in ids  # 7 is 1 again; 2 shares 8 of 11 shingles with 1; 4 and 5 have no word, like 3
    assert list(rows[0].asDict()) == odd.columns
    assert simhash.keep_representatives(none).count() == 0


def plain_kept(rows, words=5, similarity=0.8):
    """Smallest id of every group that links of this similarity make, by comparing all pairs."""
    sets = {i: set(simhash.shingle_hashes(t, words)) for i, t in rows}
    group = {i: i for i in sets}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both >= similarity * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((top(a), top(b)))
            group[b] = a
    return sorted(i for i in group if group[i] == i)


def families(n, size, rng, edits=(1, 2, 3)):
    """Families of texts with scattered edits of one another, alike in about 0.6 to 0.95 of their shingles."""
    rows = []
    for f in range(n):
        texts = [rng.integers(0, 10**9, int(rng.integers(*size))).astype(str)]
        for _ in range(11):
            text = texts[int(rng.integers(len(texts)))].copy()
            for _ in range(int(rng.choice(edits))):
                text[int(rng.integers(len(text)))] = str(rng.integers(0, 10**9))
            texts.append(text)
        rows += [(100 * f + k, " ".join(t)) for k, t in enumerate(texts)]
    return rows


@pytest.mark.parametrize("limits", [None, (3, 2, 150)])
def test_representatives_of_families(spark, monkeypatch, limits):
    """Scattered edits on both sides of 0.8, whole shards and ones cut into slices: as by comparing all pairs."""
    rng = np.random.default_rng(21)
    rows = families(25, (30, 90), rng) + [(10_000 + i, t) for i, t in families(25, (7, 20), rng, (1,))]
    shard = simhash.SHARD
    if limits:
        shard, star, shingles = limits
        monkeypatch.setattr(simhash, "STAR", star)
        monkeypatch.setattr(simhash, "SHINGLES", shingles)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in simhash.keep_representatives(docs, shard=shard).select("doc_id").collect()]
    assert sorted(kept) == plain_kept(rows)


def test_refused_links_do_not_part_groups(spark):
    """A tree whose forest holds refused pairs is compared by its sets: 3 links 1 and 2, which are not alike."""
    words = [str(i) for i in range(1000, 1104)]
    left, right = [*words[:94], *("a" * k for k in range(1, 11))], [*("b" * k for k in range(1, 11)), *words[10:]]
    rows = [(1, " ".join(left)), (2, " ".join(right)), (3, " ".join(words)), (4, " ".join(words[::-1]))]
    sets = [np.array(sorted(set(simhash.shingle_hashes(t, 5))), np.uint64) for _, t in rows]
    assert not simhash._similar(sets[0], sets[1], 0.8)
    assert simhash.similar_groups(sets, np.arange(4), np.zeros(4, int), 0.8) == [(0, 2), (1, 2)]
    assert sorted(simhash.similar_groups(sets, np.arange(4), np.array([0, 0, 1, 1]), 0.8)) == [(0, 2), (1, 2)]
    assert simhash.similar_groups(sets, np.array([5, 5, 5, 9]), np.zeros(4, int), 0.8) == []
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in simhash.keep_representatives(docs).orderBy("doc_id").collect()] == plain_kept(rows) == [1, 4]


@pytest.mark.parametrize(("low", "high", "lost"), [(0.8, 0.85, 8), (0.85, 0.9, 0), (0.9, 1.0, 0)])
def test_recall_of_candidates_by_band(low, high, lost):
    """Pairs of sets of 5 to 400 shingles share a shard key and lie within the reach; the formula loses
    0.00007 of the pairs at 0.8, and smaller sets are the hardest for the fingerprint."""
    rng = np.random.default_rng(5)
    missed = seen = 0
    for _ in range(40):
        pairs, sizes = [], []
        while len(pairs) < 500:
            n, similarity = int(rng.choice([5, 8, 12, 20, 40, 100, 400])), rng.uniform(low, high)
            common = int(np.ceil(2 * n * similarity / (1 + similarity)))
            if not low <= common / (2 * n - common) <= high:
                common = n - 1
            union = rng.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64)
            a, b = union[:n], np.concatenate((union[:common], union[n:]))
            if common == n - 1:
                b = union[:common]  # one shingle more
            if not low <= len(np.intersect1d(a, b)) / len(np.union1d(a, b)) <= high:
                continue
            pairs += [a, b]
            sizes += [len(a), len(b)]
        flat, sizes = np.concatenate(pairs), np.array(sizes)
        keys = simhash._bands(flat, sizes)
        mixed = [flat if k == 0 else blocks.mix(flat * np.uint64(2 * k + 1) + np.uint64(k)) for k in range(simhash.LANES)]
        prints = np.stack([simhash.majority(simhash.ones(x, sizes), sizes) for x in mixed], axis=1)
        far = np.bitwise_count(prints[::2] ^ prints[1::2]).sum(axis=1)
        met = (keys[::2] == keys[1::2]).any(axis=1) & (far <= simhash.REACH[-1])
        missed, seen = missed + int((~met).sum()), seen + len(met)
    assert seen == 10_000 and missed <= lost


def near_texts(n, similarity, rng):
    """Pairs of texts of which about this share of all 5-word shingles is common: words changed at the end."""
    rows = []
    for i in range(n):
        size = int(rng.choice([40, 200, 1000]))
        base = rng.integers(0, 10**9, size + 4).astype(str)
        changed = base.copy()
        k = int(np.floor(size * (1 - similarity) / (1 + similarity)))  # last k shingles differ: (size - k) / (size + k)
        changed[len(changed) - k :] = rng.integers(0, 10**9, k).astype(str)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(changed))]
    return rows


def test_no_near_pair_is_lost(spark):
    docs = spark.createDataFrame(near_texts(1500, 0.8, np.random.default_rng(8)), "doc_id long, text string")
    kept = [r.doc_id for r in simhash.keep_representatives(docs).select("doc_id").collect()]
    assert sorted(kept) == list(range(0, 3000, 2))


def test_links_are_confirmed(spark):
    rows = near_texts(200, 0.73, np.random.default_rng(9))  # of all these pairs at most 0.75 is common
    rows += [(1000, ""), (1001, None), *((2000 + i, " ".join(f"{i}x{k}" for k in range(6))) for i in range(300))]
    kept = {r.doc_id for r in simhash.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {r[0] for r in rows} - {1001}


# Lines


def plain_lines(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first = {}
    for key, text in order:
        lines = (text or "").split("\n") if text is not None else []
        for i in range(len(lines) - 2):
            first.setdefault(tuple(lines[i : i + 3]), (key, i))
    out = []
    for key, text in rows:
        lines = text.split("\n") if text is not None else []
        gone = {i + d for i in range(len(lines) - 2) if first[tuple(lines[i : i + 3])] != (key, i) for d in range(3)}
        out.append((key, None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)))
    return Counter(out)


def test_lines_equal_plain(spark, documents, odd, none):
    for docs in (documents, odd):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = line_windows.remove_repeats(docs)
        assert Counter(map(tuple, got.select("doc_id", "text", "n_lines_removed").collect())) == plain_lines(rows)
        assert set(docs.columns) < set(got.columns)
    assert line_windows.remove_repeats(none).count() == 0


def test_lines_repeated_in_one_text(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\na\nb\nc\nd"), (2, "\n\n\n\n")], "doc_id long, text string")
    assert Counter(map(tuple, line_windows.remove_repeats(docs).select("doc_id", "text", "n_lines_removed").collect())) == plain_lines([(1, "a\nb\nc\na\nb\nc\nd"), (2, "\n\n\n\n")])


# Chunks


def test_chunks_follow_content():
    base = " ".join(f"w{i * 7919 % 1000}" for i in range(400))
    cut = lambda t: chunks.chunk_texts(pa.array([t]))[1].tolist()
    whole, moved = cut(base), cut("inserted words in front " + base)
    assert len(set(whole) - set(moved)) <= 3
    n, _, sizes, _ = chunks.chunk_texts(pa.array([base, None, "", "x" * 5000, "de " * 900]))
    assert n.sum() == len(sizes) and sizes.max() <= chunks.LONGEST and n[1] == n[2] == 0
    assert [int(s.sum()) for s in np.split(sizes.astype(int), np.cumsum(n)[:-1])] == [len(base), 0, 0, 5000, 2700]


def test_repeated_passages(spark, none):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(60) for _ in range(20)]
    rows = [(i, f"{text(80)} {passages[i % 20]}, {text(40)}") for i in range(60)] + [(100 + i, text(200)) for i in range(40)]
    rows += [(None, rows[0][1]), (300, None), (301, ""), (302, passages[3] + " - " + passages[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = chunks.repeated_passages(docs).collect()
    assert {r.doc_id for r in found} == {i for i in range(20, 60)} | {302}
    for r in found:
        assert r.source < r.doc_id and r.n_words >= chunks.WORDS
        assert r.doc_id == 302 or r.source % 20 == r.doc_id % 20
    cut = {r.doc_id: r.text for r in chunks.remove_passages(docs, chunks.repeated_passages(docs)).collect()}
    assert cut[0] == rows[0][1] and len(cut[20].split()) < 150 and cut[300] is None
    assert chunks.repeated_passages(none).count() == 0


# Decontamination


def items(spark):
    rows = [
        (1, "What colour has the morning sky above northern harbours? Pale copper with violet edges, said the keeper."),
        (2, "What colour has the morning sky above northern harbours? Pale copper with violet edges, said the keeper."),
        (3, None),
        (4, ""),
        (5, "Short one."),
        (6, "Which engine moves the slow barge through narrow locks? An old diesel from the quarry."),
    ]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_leaks(spark, odd, none):
    filler = " ".join(f"filler{i}" for i in range(300))
    question = items(spark).collect()[0].text
    rows = [
        (1, f"{filler} {question} {filler}"),
        (2, filler),
        (3, f"{filler} {question.upper().replace(',', ' ;')} {filler}"),
        (4, "Which engine moves the slow barge through narrow locks?"),
        (5, None),
        (6, f"The morning sky has colour above harbours. {filler}"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items(spark)).collect()}
    assert {(1, 1), (1, 2), (3, 1), (3, 2)} <= found and not {d for d, _ in found} & {2, 5, 6}
    assert len(found) == decontaminate.find_leaks(docs, items(spark)).count()
    for size in (30, 60, 150, 300):
        small = decontaminate.Settings(shard_bytes=size)
        assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items(spark), small).collect()} == found
    left = decontaminate.remove_leaks(odd, items(spark))
    assert left.columns == odd.columns and left.count() == odd.count()
    assert decontaminate.find_leaks(docs, items(spark).limit(0)).count() == decontaminate.find_leaks(none, items(spark)).count() == 0
    assert decontaminate.remove_leaks(docs, items(spark)).filter("doc_id in (1, 3)").count() == 0


def test_wand_equals_plain_scores(spark, documents):
    (shard,) = decontaminate.indexes(spark.read.parquet(f"{SMALL}/benchmark.parquet"))
    assert sorted(i.window for i in shard) == [i.window for i in shard] and len(shard) > 1
    for row, index in itertools.product(documents.select("text").limit(60).collect(), shard):
        words_, _ = decontaminate.hashed([row.text])
        for start in range(0, len(words_), index.window):
            _, terms = index.spots(np.unique(words_[start : start + index.window]))
            plain = defaultdict(float)
            for t in terms.tolist():
                for item, part in zip(*index.lists[t][:2]):
                    plain[item] += part
            for threshold in (0.5, 0.1):
                index.settings = decontaminate.Settings(threshold=threshold, block=4)
                index.lists = [(a, w, [max(w[i : i + 4]) for i in range(0, len(w), 4)]) for a, w, _ in index.lists]
                assert {i for i, _ in index.search(terms.tolist())} == {i for i, v in plain.items() if v >= threshold - 1e-9}


def test_windows_are_the_items_own(spark):
    """A 16-word item near a text that holds two thirds of it: neither longer items nor shards change the result."""
    rng = np.random.default_rng(8)
    word = lambda n: [f"{a}{b}" for a, b in zip(rng.choice(list("abcdefgh"), n), rng.integers(0, 4000, n))]
    short, long = word(16), word(300)
    docs = [(1, " ".join([*word(50), *short[:7], *word(30), *short[9:], *word(50)])), (2, " ".join([*word(9), *short[:7], "x", *short[8:], *word(9)]))]
    docs += [(3, " ".join(long[20:280])), (4, " ".join(word(400))), (5, " ".join(short))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    asked = [(1, " ".join(short)), (2, " ".join(long)), (3, " ".join(word(3))), (4, " ".join(word(40)))]
    marks = spark.createDataFrame(asked, "item_id long, text string")
    # Word statistics are of all items, so the comparison of shards has the same items throughout.
    want = {tuple(r) for r in decontaminate.find_leaks(df, marks).collect()}
    assert {r[:2] for r in want} == {(2, 1), (3, 2), (5, 1)}
    for size in (50, 200, 1000):
        assert {tuple(r) for r in decontaminate.find_leaks(df, marks, decontaminate.Settings(shard_bytes=size)).collect()} == want
    assert {tuple(r)[:2] for r in decontaminate.find_leaks(df, marks.filter("item_id = 1")).collect()} == {(2, 1), (5, 1)}
    assert [decontaminate.length_class(n) for n in (1, 8, 9, 16, 17)] == [8, 8, 16, 16, 32]


def test_all_leaks_of_the_tables(spark, documents):
    marks = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    want = {(r.doc_id, i) for r in documents.collect() for i, t in marks.items() if t in r.text}
    got = {(r.doc_id, r.item_id) for r in catalog.QUERIES["op5_decontaminate"](spark, SMALL).collect()}
    assert want <= got and len(got - want) <= 2


# Language


def test_languages(spark, odd, none):
    rows = {r.doc_id: r for r in catalog.QUERIES["op3_langid"](spark, SMALL).collect()}
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    held = [k for k, r in rows.items() if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in rows.items())
    assert np.mean([rows[k].lang_pred == truth[k][0] for k in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows.values())
    model = langid.fit(spark.read.parquet(f"{SMALL}/documents.parquet"), "text", "lang", F.col("doc_id"))
    found = langid.predict(odd, model)
    for r in found.collect():
        blank = not any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und" and r.rejected and r.score == 0) if blank else r.lang_pred in model.labels
    assert found.count() == odd.count() and langid.predict(none, model).count() == 0
    assert langid.fit(none, "text", "lang", F.col("doc_id")) is None
    signs = spark.createDataFrame([(1, "½ ²"), (2, "① Ⅷ 12 ¾_"), (3, "½ the house² and ①more")], "doc_id long, text string")
    assert [r.lang_pred == "und" and r.score == 0 and r.rejected for r in langid.predict(signs, model).orderBy("doc_id").collect()] == [True, True, False]
    assert langid.letter_runs("½ the house² x①y é_ß 日本") == ["the", "house", "x", "y", "é", "ß", "日本"]
    unlearned = langid.predict(odd, None).collect()
    assert {r.lang_pred for r in unlearned} == {"und"} and all(r.rejected == (not any(c.isalpha() for c in r.text or "")) for r in unlearned)


# Language model


def test_stirling_draws():
    d, x = 0.6, 0.8
    table = hpylm.log_stirling(5, d)
    assert np.isclose(np.exp(table[2, 1]), 1 - d) and np.isclose(np.exp(table[3, 2]), 3 * (1 - d))
    rng = np.random.default_rng(0)
    drawn = hpylm.draw_tables(np.full(40_000, 4), np.full(40_000, x), d, rng)
    weight = np.exp(table[4, 1:5]) * x ** np.arange(1, 5)
    assert np.abs(np.bincount(drawn, minlength=5)[1:] / 40_000 - weight / weight.sum()).max() < 0.01
    few = hpylm.draw_tables(np.array([1, 0]), np.array([1.0, 1.0]), d, rng)
    assert few.tolist() == [1, 0]
    # S_d(c, t) x^t tends to (x / d)^t / Gamma(t) for large c: one more than a Poisson number of mean x / d
    large = hpylm.draw_tables(np.full(400, 100_000), np.full(400, 50.0), d, rng)
    assert abs(large.mean() - (1 + 50 / d)) < 4 * np.sqrt(50 / d / 400)



@pytest.mark.parametrize("d", [0.1, 0.6, 0.95])
@pytest.mark.parametrize("c", [127, 128, 129, 1500])
@pytest.mark.parametrize("x", [0.05, 1.0, 20.0, 3000.0])
def test_one_law_at_every_size(c, d, x):
    weight = hpylm.log_stirling(c, d)[c, 1:] + np.log(x) * np.arange(1, c + 1)
    share = np.exp(weight - weight.max())
    share /= share.sum()
    mean = share @ np.arange(1, c + 1)
    drawn = hpylm.draw_tables(np.full(20_000, c), np.full(20_000, x), d, np.random.default_rng(3))
    spread = np.sqrt(share @ (np.arange(1, c + 1) - mean) ** 2)
    assert abs(drawn.mean() - mean) <= 5 * spread / np.sqrt(20_000) + 1e-3
    assert np.abs(np.bincount(drawn, minlength=c + 1)[1:] / 20_000 - share).max() < 0.02


@pytest.mark.parametrize("d,s,chances,customers", [(0.7, 1.0, [0.3, 0.5], [4, 3]), (0.4, 2.0, [0.6, 0.1, 0.2], [5, 2, 1]), (0.9, 0.5, [0.9], [7])])
def test_restaurant_equals_enumeration(d, s, chances, customers):
    """All seatings of a restaurant: blocks of customers at tables, each dish apart."""

    def partitions(n):
        if n == 0:
            yield []
            return
        for rest in partitions(n - 1):
            for i in range(len(rest)):
                yield [*rest[:i], rest[i] + 1, *rest[i + 1 :]]
            yield [*rest, 1]

    law = Counter()
    for seating in itertools.product(*(list(partitions(c)) for c in customers)):
        sizes, t = [n for x in seating for n in x], tuple(map(len, seating))
        weight = math.prod(math.prod(j - d for j in range(1, n)) for n in sizes)
        weight *= math.prod(s + d * k for k in range(1, len(sizes)))
        law[t] += weight * math.prod(p**k for p, k in zip(chances, t))
    total = sum(law.values())
    rng, n = np.random.default_rng(5), 20_000
    t = np.ones((len(customers), n), np.int64)
    for _ in range(60):
        g = hpylm.restaurant_weight(t.sum(0), s, d, rng)
        t = np.array([hpylm.draw_tables(np.full(n, c), d * p * g, d, rng) for c, p in zip(customers, chances)])
    got = Counter(map(tuple, t.T.tolist()))
    assert all(abs(got[k] / n - w / total) < 5 * math.sqrt(0.25 / n) for k, w in law.items())


def test_dominant_follower():
    """One dish of c customers beside T tables: weights S_d(c, t) P^t times the restaurant's growth, summed."""
    rng, d, n = np.random.default_rng(6), 0.7, 20_000
    for c, others, p in ((100, 0, 0.3), (30, 0, 0.5), (100, 3, 0.05), (300, 0, 0.3)):
        t = np.arange(1, c + 1)
        growth = np.array([math.lgamma(1 / d + others + k) for k in t])
        weight = hpylm.log_stirling(c, d)[c, 1:] + t * np.log(d * p) + growth
        mean = np.average(t, weights=np.exp(weight - weight.max()))
        drawn = np.ones(n, np.int64)
        for _ in range(40):
            g = hpylm.restaurant_weight(others + drawn, 1.0, d, rng)
            drawn = hpylm.draw_tables(np.full(n, c), d * p * g, d, rng)
        assert abs(drawn.mean() - mean) < 5 * drawn.std() / math.sqrt(n) + 1e-3


def test_perplexity(spark, none):
    rows = [(True, 2, -4.0), (True, 3, -6.0), (False, 1, -1.0), (None, 1, 0.0)]
    df = spark.createDataFrame(rows, "held_out boolean, n_tokens long, score double")
    assert {tuple(r) for r in hpylm.perplexity(df).collect()} == {(True, 2, 5, 100.0), (False, 1, 1, 10.0), (None, 1, 1, 1.0)}
    assert hpylm.perplexity(df.limit(0)).count() == 0
    got = {r.held_out: r.perplexity for r in hpylm.perplexity(catalog.QUERIES["op1_hpylm"](spark, SMALL)).collect()}
    base = {r.held_out: r.perplexity for r in hpylm.perplexity(catalog.QUERIES["op1_hpylm"](spark, SMALL), score="base_score").collect()}
    assert 1 < got[False] < got[True] < base[True]


def test_draws_of_many_customers():
    for c in (100_000, 10**9):  # here the law tends to 1 + Poisson(x / d)
        drawn = hpylm.draw_tables(np.full(5_000, c), np.full(5_000, 6.0), 0.6, np.random.default_rng(4))
        assert abs(drawn.mean() - 11) < 0.25 and abs(drawn.var() - 10) < 1.2


def plain_counts(rows):
    held = [zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0 for k, _ in rows]
    count = Counter(w for (_, t), h in zip(rows, held) if not h for w in [*words(t), None])
    n, v = sum(count.values()), len(count)
    base = lambda w: math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1)))
    return [(k, h, len(words(t)) + 1, sum(count[w] > 0 for w in [*words(t), None]), n, round(sum(map(base, [*words(t), None])), 6)) for (k, t), h in zip(rows, held)]


def test_language_model(spark, documents, odd, none):
    for docs in (documents, odd):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = hpylm.score_texts(docs, catalog.id_remainder("doc_id", 10) == 0).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == Counter(plain_counts(rows))
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    got = catalog.QUERIES["op1_hpylm"](spark, SMALL).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert {(r.doc_id, r.score) for r in got} == {(r.doc_id, r.score) for r in catalog.QUERIES["op1_hpylm"](spark, SMALL).collect()}
    assert hpylm.score_texts(none, F.lit(False)).count() == 0


def test_language_model_is_a_distribution(spark):
    """All one-word texts and the empty one, of known words or the unknown one, share the mass of
    two tokens: first word and end. Sum over first words of P(word | end) is 1."""
    train = [(i, " ".join(np.random.default_rng(i).choice(list("abcdef"), 12))) for i in range(40)]
    known = list("abcdef")
    asked = [(1000 + i, w) for i, w in enumerate(known)]
    docs = spark.createDataFrame(train + asked, "doc_id long, text string")
    scored = {r.doc_id: r for r in hpylm.score_texts(docs, F.col("doc_id") >= 1000).collect()}
    # P(w | end) P(end | w) summed over w is at most the chance of a one-word text: below 1.
    assert 0 < sum(10 ** scored[1000 + i].score for i in range(len(known))) < 1
    assert all(scored[1000 + i].n_known == 2 for i in range(len(known)))
