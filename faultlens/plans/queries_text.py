"""Text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultlens.functions import text as T
from faultlens.functions.wordlists import ENGLISH_STOP_WORDS, NOUN_SUFFIX_RULES
from faultlens.operators import lemmas as C
from faultlens.operators.sizing import settle
from faultlens.plans import stand_ins as S
from faultlens.plans.registry import cte, query

COMBINED = "coalesce(title, '') || ' ' || coalesce(description, '')"
PHRASES = "|".join(T.TEMPLATE_PHRASES)
STOP_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS) + "]"


def stripped_sql(text: str) -> str:
    return rf"regexp_replace({text}, '(?i)(?:{PHRASES})\s*:?\s*', '', 'g')"


def split_case_sql(text: str) -> str:
    once = rf"regexp_replace({text}, '([a-z])([A-Z])', '\1 \2', 'g')"
    return rf"regexp_replace({once}, '(?s)(.)([A-Z][a-z])', '\1 \2', 'g')"


def squeezed_sql(text: str) -> str:
    return rf"trim(regexp_replace({text}, '[\s\p{{Z}}\x0b\x{{85}}\x1c-\x1f]+', ' ', 'g'))"


def cleaned_sql(text: str) -> str:
    letters = rf"regexp_replace(lower({text}), '[^a-z\s\p{{Z}}\x0b\x{{85}}\x1c-\x1f]', '', 'g')"
    return squeezed_sql(letters)


def tokens_sql(cleaned: str) -> str:
    return f"list_filter(string_split({cleaned}, ' '), lambda x: x <> '')"


def content_sql(text: str) -> str:
    tokens = tokens_sql(cleaned_sql(split_case_sql(stripped_sql(text))))
    return f"list_filter({tokens}, lambda x: NOT list_contains({STOP_SQL}, x))"


cte("doc_tokens", f"SELECT id, {content_sql(COMBINED)} AS tokens FROM doc_texts")
cte(
    "prepared",
    "SELECT d.id, coalesce(l.processed_text, '') AS processed_text, label_list FROM doc_tokens d"
    " LEFT JOIN lemma_docs l ON d.id = l.id JOIN doc_labels ON d.id = doc_labels.id",
)
cte("words", "SELECT DISTINCT unnest(tokens) AS word FROM doc_tokens")
cte(
    "lemma_tries",
    " UNION ALL ".join(
        ["SELECT word AS form, 0 AS rule, word AS candidate FROM words"]
        + [
            f"SELECT word, {i}, left(word, length(word) - {len(suffix)}) || '{ending}' FROM words WHERE ends_with(word, '{suffix}')"
            for i, (suffix, ending) in enumerate(NOUN_SUFFIX_RULES, start=1)
        ]
    ),
)
cte(
    "noun_lemmas",
    "SELECT form, lemma FROM (SELECT form, arg_min(candidate, length(candidate) * 100 + rule) AS lemma FROM lemma_tries"
    " WHERE candidate IN (SELECT word FROM words) GROUP BY form) WHERE form <> lemma",
)
cte(
    "lemma_docs",
    "SELECT id, coalesce(string_agg(coalesce(lemma, t), ' ' ORDER BY p), '') AS processed_text FROM"
    " (SELECT id, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS p FROM doc_tokens)"
    " LEFT JOIN noun_lemmas ON t = form GROUP BY id",
)


def text_query(name, column, sql, run):
    query(name, f"SELECT id, {sql} AS {column} FROM doc_texts")(
        lambda spark, folder: S.combined(spark, folder).select("id", run(F.col("text_input")).alias(column))
    )


text_query("combine_text", "text_input", COMBINED, lambda c: c)
text_query("strip_template", "text", stripped_sql(COMBINED), T.strip_template)
text_query(
    "decamelcase",
    "text",
    squeezed_sql(split_case_sql(COMBINED)),
    lambda c: F.trim(F.regexp_replace(T.decamelcase(c), r"(?U)\s+", " ")),
)
text_query("clean_text", "text", cleaned_sql(COMBINED), T.clean_text)
text_query(
    "tokenize",
    "tokens",
    f"array_to_string({tokens_sql(cleaned_sql(COMBINED))}, '|')",
    lambda c: F.array_join(T.tokenize(T.clean_text(c)), "|"),
)
text_query(
    "remove_stopwords",
    "tokens",
    f"array_to_string(list_filter({tokens_sql(cleaned_sql(COMBINED))}, lambda x: NOT list_contains({STOP_SQL}, x)), '|')",
    lambda c: F.array_join(T.remove_stopwords(T.tokenize(T.clean_text(c))), "|"),
)


@query("noun_lemmas", "SELECT form, lemma FROM noun_lemmas")
def noun_lemmas(spark, folder):
    return S.corpus_lemmas(S.doc_tokens(spark, folder))


@query(
    "lemmatize",
    "SELECT d.id, coalesce(processed_text, '') AS tokens FROM doc_tokens d LEFT JOIN lemma_docs l ON d.id = l.id",
)
def lemmatize(spark, folder):
    tokens = settle(S.doc_tokens(spark, folder))
    done = C.lemmatize(tokens, S.corpus_lemmas(tokens))
    return done.select("id", F.array_join("tokens", " ").alias("tokens"))


@query(
    "preprocess_text",
    "SELECT d.id, coalesce(processed_text, '') AS processed_text FROM doc_tokens d LEFT JOIN lemma_docs l ON d.id = l.id",
)
def preprocess_text(spark, folder):
    return S.cleaned_documents(spark, folder)
