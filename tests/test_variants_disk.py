import pytest
from pyspark.sql import functions as F

from faultlens.operators import augment as E
from faultlens.operators import features as X
from faultlens.operators import sizing as Z
from faultlens.plans import queries_augment as A


@pytest.fixture
def folder(spark, tmp_path):
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]
    docs = [(i, " ".join(words[(i * j) % 7] for j in range(1, 6)), ["en", "de"][i % 2], f"s{i % 3}", 30) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def plain(rows):
    """The sums of each variant's own TF-IDF, all variants written whole."""
    out = {}
    for name in E.VARIANTS:
        own = rows.filter(F.col("variant") == name)
        cells = X.tfidf(own, X.idf(X.vocabulary(X.term_stats(own), 2), own.count()), key="row_id")
        for r in cells.groupBy("row_id").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect():
            out[r["row_id"]] = (r["n"], round(r["w"], 6))
    return out


@pytest.mark.parametrize("limit", [X.DRIVER_TERMS, 0])
def test_unchanged_rows_are_written_once(spark, folder, monkeypatch, limit):
    tables = []

    def recorded(write):
        def kept(df, *args, **more):
            out = write(df, *args, **more)
            tables.append((out, out.count()))
            return out

        return kept

    for name in ("settle", "settle_instead"):
        monkeypatch.setattr(A, name, recorded(getattr(Z, name)))
    whole = X.tfidf
    monkeypatch.setattr(X, "tfidf", lambda *args, **more: whole(*args, **more, limit=limit))
    got = {r["row_id"]: (r["n_terms"], round(r["weight"], 6)) for r in A.tfidf_variants(spark, folder).collect()}
    written = sum(n for t, n in tables if "terms" in t.columns)
    rows = Z.settle(X.with_terms(A.variants(spark, folder)))
    unchanged = rows.filter("variant = 'OG'").count()
    assert written == unchanged + rows.filter("replica > 0").count() < rows.count()
    wanted = plain(rows)
    assert len(got) == rows.count() and {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in wanted.items()}
    assert all(abs(w - wanted[k][1]) < 2e-6 for k, (_, w) in got.items())
    # Of the token lists only the unchanged ones are left.
    left = [t for t, _ in tables if "terms" in t.columns and spark._jvm.java.io.File(t.settled_path.removeprefix("file:")).exists()]
    assert [t.count() for t in left] == [unchanged]
