"""Hard negatives, multiset fingerprints and spelling variants against plain code."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from faultlens.llm import catalog, hard_negatives, multiset_hash, variants
from pyspark.sql import functions as F

from .conftest import ODD, SMALL


def plain_mined(rows, every, k, m):
    held = [
        (i, label, np.floor(256 * np.array(v, float)).astype(int))
        for i, v, label in rows
        if None not in (i, v, label) and all(c is not None and np.isfinite(c) for c in v)
    ]
    width = max((len(v) for *_, v in held), default=0)
    held = [(i, label, np.pad(v, (0, width - len(v)))) for i, label, v in held]
    out = []
    for i, label, v in held:
        if i % every:
            continue
        scored = sorted((-int(v @ w), j, other) for j, other, w in held if j != i)
        for p, j, _ in [s for s in scored if s[2] == label][:k]:
            fits = [(n, c) for n, c, other in scored if other != label and 30 * -p <= 100 * -n <= 90 * -p]
            out += [(i, j, r + 1, c, -p, -n) for r, (n, c) in enumerate(fits[:m])]
    return sorted(out)


VECTORS = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("shard, block, width", [(7, 3, 11), (16_384, 16_384, 16)])
def test_hard_negatives_equal_plain(spark, shard, block, width):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0.1, 0.2, width).round(1).tolist(), int(rng.integers(4))) for i in range(220)]  # many equal scores
    rows += [rows[0], rows[20], (40, rows[3][1], 2), (500, rows[1][1], 3)]  # repeated ids, a repeated vector
    rows += [(300, None, 1), (None, [1.0] * width, 1), (301, [1.0, None], 1), (302, [float("nan")] * width, 1), (303, [0.5], 1), (304, [], 1), (305, [0.5], None)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("_id", F.lit("clash")).withColumn("_row", F.lit(1)).withColumn("rank", F.lit(0))
    got = hard_negatives.mine(df, F.col("vec_id") % 20 == 0, positives=3, negatives=4, shard=shard, block=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain_mined(rows, 20, 3, 4)


def test_hard_negatives_few_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 9.0], 2), (3, [-1.0, 0.0], 2)]
    df = spark.createDataFrame(rows, VECTORS)
    mine = lambda d: [tuple(r) for r in hard_negatives.mine(d, F.col("vec_id") == 0).collect()]
    assert mine(df) == [(0, 1, 1, 2, 65536, 32768)]
    assert mine(df.limit(0)) == mine(df.filter("vec_id = 0")) == mine(df.filter("label = 2")) == []
    assert hard_negatives.mine(df, F.lit(None).cast("boolean")).isEmpty()
    with pytest.raises(ValueError):
        mine(spark.createDataFrame([(0, [1e30], 1)], VECTORS))


def test_scores_are_exact_for_any_width():
    rng = np.random.default_rng(6)
    for dims, most in ((1, 1), (8, 200), (13, 1 << 20), (64, 1 << 25)):
        a, x = (rng.integers(-most, most + 1, (n, dims)) for n in (70, 33))
        bits = most.bit_length() + 1
        assert (hard_negatives.scores(a, hard_negatives.bit_planes(x, bits)) == a @ x.T).all()


def plain_edited(texts):
    """Of texts in key order: length, digest of the edited text, the texts themselves."""
    out = []
    for i, t in enumerate(texts):
        half = len(t) // 2
        out.append((t, t[: len(t) - half] + texts[(i + 1) % len(texts)][:half]))
    return out


def test_edited_texts_equal_plain(spark, odd):
    ordered = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    whole = plain_edited([r[1] or "" for r in ordered])
    for size in (40, 1 << 25):  # a block for each text, one block
        got = multiset_hash.edited(odd, block_bytes=size).collect()
        assert len(got) == len(ODD)
        want = sorted((str(r[0]), len(a), hashlib.sha256(b.encode()).hexdigest()) for r, (a, b) in zip(ordered, whole))
        assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == want
        prints = {r.fingerprint for r in got}
        assert len(prints) == len({a for a, _ in whole})
    by_text = multiset_hash.written(multiset_hash.fingerprints([b.encode() for _, b in whole]))
    assert sorted(by_text) == sorted(r.edited_fingerprint for r in got)


def test_edited_one_row_and_none(spark, odd, none):
    assert multiset_hash.edited(none).collect() == []
    (r,) = multiset_hash.edited(odd.filter("doc_id = 1")).collect()
    assert r.near_next == 1.0 and 0 < r.near_edited < 1


def test_multiset_hash_is_homomorphic():
    rng = np.random.default_rng(7)
    paragraphs = [" ".join(f"w{x}" for x in rng.integers(0, 900, n)) for n in (0, 1, 2, 30, 200, 30)]
    one = multiset_hash.fingerprints(["\n".join(paragraphs).encode()])
    mixed = multiset_hash.fingerprints(["\n".join(paragraphs[::-1]).encode()])
    fewer = multiset_hash.fingerprints(["\n".join(paragraphs[:4]).encode()])
    rest = multiset_hash.fingerprints(["\n".join(paragraphs[4:]).encode()])
    same = lambda a, b: all((x == y).all() for x, y in zip(a, b))
    assert same(one, mixed) and same(multiset_hash.added(fewer, rest), one) and same(multiset_hash.added(one, rest, -1), fewer)
    assert not same(one, fewer) and same(multiset_hash.parsed(multiset_hash.written(multiset_hash.added(fewer, one, -1))), multiset_hash.added(fewer, one, -1))
    assert multiset_hash.likeness(one, mixed)[0] == 1.0


def test_likeness_follows_the_share_of_common_text():
    rng = np.random.default_rng(8)
    lines = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 12)) for _ in range(200)]
    texts = ["\n".join(lines[k : k + 100]).encode() for k in (0, 10, 25, 50, 90, 100)]
    prints = multiset_hash.fingerprints(texts)
    first = tuple(np.repeat(x[:1], len(texts), 0) for x in prints)
    assert np.abs(multiset_hash.likeness(first, prints) - np.array([1, 0.9, 0.75, 0.5, 0.1, 0])).max() < 0.13
    blank = multiset_hash.fingerprints([b"", b"\n", b"a"])
    assert multiset_hash.likeness(blank, tuple(x[[0, 0, 0]] for x in blank)).tolist() == [1, 0, 0]


def test_edited_texts_of_the_tables(spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]
    whole = plain_edited(texts)
    got = catalog.QUERIES["op12_multiset_hash"](spark, SMALL).orderBy("doc_id").collect()
    assert [r.edited_sha256 for r in got] == [hashlib.sha256(b.encode()).hexdigest() for _, b in whole]
    prints = multiset_hash.fingerprints([t.encode() for t in texts])
    new = multiset_hash.fingerprints([b.encode() for _, b in whole])
    assert [r.fingerprint for r in got] == multiset_hash.written(prints) and [r.edited_fingerprint for r in got] == multiset_hash.written(new)
    following = tuple(np.roll(x, -1, 0) for x in prints)
    assert [r.near_next for r in got] == multiset_hash.likeness(prints, following).tolist()
    assert [r.near_edited for r in got] == multiset_hash.likeness(prints, new).tolist()


def plain_counts(rows, every):
    out = Counter()
    for i, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            out[w[: h % len(w)] + w[h % len(w) + 1 :] if h % every == 0 else w] += 1
    return Counter({w: n for w, n in out.items() if w})


def plain_group(counts):
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    shapes = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            shapes[w[:i] + "*" + w[i + 1 :]].add(w)
    near = {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            near[w] |= shapes[w[:i] + "*" + w[i + 1 :]] - {w}
            if (shorter := w[:i] + w[i + 1 :]) in words:
                near[w].add(shorter)
                near[shorter].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 2 * n:
            form[w] = best
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None)
    return out


def read_group(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = df.collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_variants_of_the_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert read_group(catalog.QUERIES["op13_spelling_variants"](spark, SMALL)) == plain_group(plain_counts(docs, 97))


def test_variants_of_odd_rows(spark, odd, none):
    counts = variants.run_counts(odd, 3).groupBy("word").agg(F.sum("n").alias("n"))
    assert {r.word: r.n for r in counts.collect()} == plain_counts([(r[0], r[1]) for r in ODD], 3)
    assert variants.group(variants.run_counts(none, 97)).collect() == []
    long = "ab" * 3000
    words = {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaab": 100, "baaaa": 5, "Éaaaa": 10, "zzzzz": 2, "four": 9, long: 3, long + "b": 7, "aaaba": 3, "aabaa": 3, "abaaa": 3}
    rows = [(w, n) for w, n in words.items()] + [("zzzzz", 1), ("zzzzz", None), (None, 5), ("zzzzy", None)]
    df = spark.createDataFrame(rows, "word string, n long").withColumn("_w", F.lit(1)).withColumn("best", F.lit(1))
    assert read_group(variants.group(df)) == plain_group(words | {"zzzzz": 3})


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_of_few_letters(spark, seed):
    """Short words over two letters: nearly all are near, runs of equal letters everywhere."""
    rng = np.random.default_rng(seed)
    words = Counter("".join(rng.choice(list("ab"), rng.integers(4, 9))) for _ in range(1500))
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert read_group(variants.group(df)) == plain_group(words)


def test_variants_lead_far(spark):
    """A chain of forms that is longer than one step of the doubling."""
    words = {"a" * (5 + i): 3 * 2**i for i in range(12)}
    got = read_group(variants.group(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == plain_group(words) and {r[1] for r in got.values()} == {"a" * 16}
