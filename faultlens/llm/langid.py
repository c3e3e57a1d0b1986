"""Language identification: averaged embeddings of hashed subwords, linear softmax, SGD in numpy.

A text is the average of the vectors of its words' subwords (runs of 2 to 4 characters of
``<word>``, hashed into a fixed number of rows); a linear layer and softmax follow. Training reads a
sample whose size is bounded by documented parameters (``per_label`` texts of each label, of at most
``longest`` characters each); the sample is chosen by hash, so it doesn't depend on partitions.
A held-back part of the sample sets a temperature (calibration) and the confidence under which a
prediction is rejected. Prediction reads whole texts; as the layers are linear, each bucket's row is
multiplied with the output layer once, and each different word of a block is looked up once.

Cases: null text, empty text and text without a letter get ``und``, score 0 and are rejected. With no
labelled text at all every row is ``und`` with score 0, and only those without a letter are rejected. Any length, repeated rows and clashing extra
columns are fine; ties between labels go to the first label in ascending order.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.blocks import text_slices

UNKNOWN = "und"
_RUN = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    """Runs of letters. The pattern also takes numeric characters such as a half sign; these cut a run."""
    runs = _RUN.findall(text)
    if all(map(str.isalpha, runs)):
        return runs
    return "".join(c if c.isalpha() else " " for c in " ".join(runs)).split()


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 16  # rows of the embedding table
    dimensions: int = 16
    shortest: int = 2
    longest_run: int = 4
    per_label: int = 500  # texts of one label in the training sample
    longest: int = 50_000  # characters of a text that may be in the training sample
    epochs: int = 6
    rate: float = 0.5
    held_back: float = 0.2  # share of the sample for calibration
    rejected: float = 0.001  # share of rightly labelled calibration texts that may fall under the threshold
    lowest: float = 0.5  # the threshold is never above this confidence
    seed: int = 7


@dataclass(frozen=True)
class Model:
    labels: list[str]
    table: np.ndarray  # embedding times output layer: buckets x labels
    bias: np.ndarray
    temperature: float
    threshold: float
    settings: Settings


def subwords(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword of every word, and the index of its word."""
    joined = "".join(f"<{w}>" for w in words)
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(code))  # characters up to the word's end
    buckets, owners = [], []
    state = np.zeros(len(code), np.uint64)
    for n in range(1, s.longest_run + 1):
        ahead = np.zeros(len(code), np.uint64)
        ahead[: max(0, len(code) - n + 1)] = code[n - 1 :]
        state = (state ^ ahead) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
        if n >= s.shortest:
            whole = left >= n
            buckets.append(((state[whole] >> np.uint64(24)) % np.uint64(s.buckets)).astype(np.int64))
            owners.append(owner[whole])
    return np.concatenate(buckets), np.concatenate(owners)


def _features(text: str, s: Settings) -> tuple[np.ndarray, np.ndarray] | None:
    found = letter_runs(text.lower())
    if not found:
        return None
    ids, number = np.unique(subwords(found, s)[0], return_counts=True)
    return ids, number / number.sum()


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_rows(rows: list[tuple[str, str]], s: Settings) -> Model | None:
    """Train on (text, label) rows. The rows are a bounded sample."""
    labels = sorted({label for _, label in rows})
    data = [(f, labels.index(label)) for text, label in rows if (f := _features(text, s)) is not None]
    if not data:
        return None
    rng = np.random.default_rng(s.seed)
    order = rng.permutation(len(data))
    cut = int(len(data) * s.held_back)
    check, train = [data[i] for i in order[:cut]], [data[i] for i in order[cut:]]
    embedding = rng.uniform(-1, 1, (s.buckets, s.dimensions)) / s.dimensions
    output, bias = np.zeros((s.dimensions, len(labels))), np.zeros(len(labels))
    steps, done = max(1, s.epochs * len(train)), 0
    # A label with few texts counts as much as one with many.
    sizes = np.bincount([y for _, y in train], minlength=len(labels)).clip(1)
    weight = sizes.mean() / sizes
    for _ in range(s.epochs):
        for i in rng.permutation(len(train)):
            (ids, share), y = train[i]
            rate = s.rate * (1 - done / steps) * min(4.0, weight[y])
            hidden = share @ embedding[ids]
            error = _softmax(hidden @ output + bias)
            error[y] -= 1
            back = output @ error
            output -= rate * np.outer(hidden, error)
            bias -= rate * 0.1 * error
            # Averaging makes a row's slope small; frequent subwords get their share, scaled up.
            embedding[ids] -= rate * 20 * np.minimum(share, 0.05)[:, None] * back
            done += 1
    table = embedding @ output
    temperature, threshold = 1.0, min(s.lowest, 1.0)
    if check:
        scores = np.array([share @ table[ids] + bias for (ids, share), _ in check])
        truth = np.array([y for _, y in check])
        grid = np.geomspace(0.05, 10, 60)
        loss = [-np.log(_softmax(scores / t)[np.arange(len(truth)), truth].clip(1e-12)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
        sure = _softmax(scores / temperature)
        right = sure.max(1)[sure.argmax(1) == truth]
        threshold = float(min(s.lowest, np.quantile(right, s.rejected))) if len(right) else 0.0
    return Model(labels, table.astype(np.float32), bias, temperature, threshold, s)


def fit(labelled: DataFrame, text: str, label: str, key: Column, settings: Settings = Settings()) -> Model | None:
    """Train on a hash-chosen sample of the rows that have both text and label."""
    s = settings
    rows = labelled.select(
        F.col(text).alias("text"), F.col(label).cast("string").alias("label"), F.abs(F.xxhash64(key)).alias("draw")
    ).filter(F.col("text").isNotNull() & F.col("label").isNotNull() & (F.length("text") <= s.longest))
    sizes = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if not sizes:
        return None
    # A little more than needed is drawn, then cut at the same hash order everywhere.
    share = {k: min(1.0, (1.3 * s.per_label + 30) / n) for k, n in sizes.items()}
    chances = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])
    drawn = rows.filter(F.col("draw") <= chances[F.col("label")] * F.lit(float(2**63 - 1))).collect()
    drawn.sort(key=lambda r: (r.draw, r.label, r.text))
    taken: dict[str, int] = defaultdict(int)
    sample = []
    for r in drawn:
        if taken[r.label] < s.per_label:
            taken[r.label] += 1
            sample.append((r.text, r.label))
    return fit_rows(sample, s)


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """All columns of the rows, and lang_pred, score (calibrated), rejected."""
    columns = [f"_c{i}" for i in range(len(docs.columns))]
    at = f"_c{docs.columns.index(text)}"
    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(columns, docs.schema.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches, at):
            yield _label(piece, piece.column(at).to_pylist())

    def _label(piece: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
        n = len(texts)
        names, score, rejected = np.full(n, UNKNOWN, object), np.zeros(n), np.ones(n, bool)
        seen: dict[str, int] = defaultdict(count().__next__)
        found = [letter_runs(t.lower()) if t else [] for t in texts]
        sizes = np.array([len(f) for f in found], np.int64)
        if model is not None and sizes.any():
            ids = np.fromiter((seen[w] for f in found for w in f), np.int64, int(sizes.sum()))
            buckets, owner = subwords(list(seen), model.settings)
            runs = np.bincount(owner, minlength=len(seen)).astype(float)
            doc = np.repeat(np.arange(n), sizes)
            total = np.bincount(doc, runs[ids], n)
            logits = np.empty((n, len(model.labels)))
            for k in range(len(model.labels)):
                word = np.bincount(owner, model.table[buckets, k], len(seen))
                logits[:, k] = np.bincount(doc, word[ids], n) / np.maximum(total, 1) + model.bias[k]
            sure = _softmax(logits / model.temperature)
            best, some = sure.argmax(1), total > 0
            names[some] = np.array(model.labels, object)[best[some]]
            score[some] = sure.max(1)[some]
            rejected = ~some | (score < model.threshold)
        if model is None:
            rejected = sizes == 0
        extra = [pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)]
        return pa.RecordBatch.from_arrays([*piece.columns, *extra], [*columns, "_lang_pred", "_score", "_rejected"])

    out = docs.toDF(*columns).mapInArrow(run, f"{schema}, _lang_pred string, _score double, _rejected boolean")
    kept = [F.col(c).alias(name) for c, name in zip(columns, docs.columns) if name not in ("lang_pred", "score", "rejected")]
    return out.select(*kept, *[F.col(f"_{c}").alias(c) for c in ("lang_pred", "score", "rejected")])
