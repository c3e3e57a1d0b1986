"""Lemmas: a noun table made from a lexicon, and its application to token lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.functions import text as T
from faultlens.functions.wordlists import ENGLISH_STOP_WORDS, NOUN_SUFFIX_RULES
from faultlens.operators.batches import list_sizes, list_slices
from faultlens.operators.sizing import BROADCAST_ROWS, HOT_ROWS, lookup_join, settle

SENT_LEMMAS = 500_000  # (form, lemma) pairs that may be sent to every executor


def distinct_words(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Distinct tokens as ``word``; repeats inside a row are dropped before they travel.

    The exploded expression is not a plain column on purpose: for a plain column the optimiser
    adds a not-empty filter that computes the whole cleaning chain a second time.
    """
    return df.select(F.explode(F.array_distinct(tokens)).alias("word")).distinct()


def noun_lemma_table(forms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(form, lemma) for the forms whose lemma differs.

    Candidates are the form itself and the form after each suffix rule; those in the lexicon
    count, the shortest wins, the earlier rule on ties. Each form has at most ten candidates, so
    the semi join sees ten times the distinct forms, not the texts.
    """
    form = F.col("word")
    tries = [F.struct(F.lit(0).alias("rule"), form.alias("candidate"))]
    for rule, (suffix, ending) in enumerate(NOUN_SUFFIX_RULES, start=1):
        swapped = F.concat(F.substring(form, F.lit(1), F.length(form) - len(suffix)), F.lit(ending))
        tries.append(F.when(form.endswith(suffix), F.struct(F.lit(rule).alias("rule"), swapped.alias("candidate"))))
    candidates = (
        forms.select("word")
        .distinct()
        .select("word", F.explode(F.filter(F.array(*tries), lambda t: t.isNotNull())).alias("t"))
        .select(form.alias("form"), "t.rule", F.col("t.candidate").alias("word"))
        .filter(F.col("word") != "")
    )
    known = candidates.join(lexicon.select("word").distinct(), "word", "left_semi")
    best = F.min(F.struct(F.length("word").alias("size"), "rule", F.col("word").alias("lemma")))
    lemmas = known.groupBy("form").agg(best.alias("best")).select("form", F.col("best.lemma").alias("lemma"))
    return lemmas.filter(F.col("form") != F.col("lemma"))


def _replace_in_batches(df: DataFrame, tokens: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Arrow batches of tokens, in pieces of bounded size, against the sent table: one hash look-up per piece, no
    shuffle, no Python work per token."""
    forms, lemmas = zip(*pairs)
    shared = df.sparkSession.sparkContext.broadcast((pa.array(forms, pa.string()), pa.array(lemmas, pa.string())))

    @F.arrow_udf("array<string>")
    def replace(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, target = shared.value
        for batch in batches:
            for start, stop in list_slices(batch):
                lists = batch.slice(start, stop - start)
                flat = lists.flatten().cast(pa.string())
                found = pc.take(target, pc.index_in(flat, value_set=known))
                offsets = pa.array(np.append(0, np.cumsum(list_sizes(lists))), pa.int32())
                yield pa.ListArray.from_arrays(offsets, pc.coalesce(found, flat), mask=lists.is_null())

    return df.withColumn(tokens, replace(F.col(tokens)))


def lemmatize(
    df: DataFrame,
    lemmas: DataFrame,
    tokens: str = "tokens",
    limit: int = SENT_LEMMAS,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Replace each token by its lemma; tokens without one stay, and so does a null list. Of a form
    with several lemmas the first in order counts.

    A table of up to ``limit`` rows is sent to the executors, and rows stay where they are. A
    larger one is joined: only the distinct (row, word) pairs travel, and what comes back per row
    is the short list of changed words.
    """
    lemmas = settle(lemmas.filter(F.col("form").isNotNull() & F.col("lemma").isNotNull()).groupBy("form").agg(F.min("lemma").alias("lemma")))
    pairs = [tuple(r) for r in lemmas.select("form", "lemma").limit(limit + 1).collect()]
    if not pairs:
        return df
    if len(pairs) <= limit:
        return _replace_in_batches(df, tokens, pairs)
    # Rows get a number of their own, as ids may repeat; written, so that it stays.
    numbered = settle(df.withColumn("_row", F.monotonically_increasing_id()))
    words = numbered.select("_row", F.explode(F.array_distinct(tokens)).alias("form"))
    found = lookup_join(words, lemmas, "form", "inner", broadcast_rows, hot_rows)
    changes = found.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("form", "lemma"))).alias("_lemmas"))
    joined = numbered.join(changes, "_row", "left")
    replaced = F.transform(tokens, lambda t: F.coalesce(F.try_element_at("_lemmas", t), t))
    return joined.withColumn(tokens, F.when(F.col("_lemmas").isNull(), F.col(tokens)).otherwise(replaced)).select(df.columns)


def preprocess_text(
    df: DataFrame,
    lemmas: DataFrame | Callable[[DataFrame], DataFrame] | None,
    text: str = "text_input",
    stop_words=ENGLISH_STOP_WORDS,
    keep: list[str] | None = None,
    **limits,
) -> DataFrame:
    """Template, camel case, cleaning, stop words, lemmas; result in ``processed_text``.

    ``lemmas`` may be a function that makes the table from the token lists, which are then
    written, so that texts are cleaned once. ``keep`` names the columns that stay beside the result (all if not
    given): a raw text that is not among them is not written."""
    tokenised = df.withColumn("tokens", T.content_tokens(F.col(text), stop_words))
    if keep is not None:
        tokenised = tokenised.select(*keep, "tokens")
    if callable(lemmas):
        tokenised = settle(tokenised)
        lemmas = lemmas(tokenised)
    if lemmas is not None:
        tokenised = lemmatize(tokenised, lemmas, **limits)
    return tokenised.withColumn("processed_text", F.array_join("tokens", " ")).drop("tokens")
