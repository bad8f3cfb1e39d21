import pytest

from waymark.llm import quality
from waymark.llm.quality import keep_good, with_quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    seen, held = labels.where("doc_id % 5 <> 0"), labels.where("doc_id % 5 = 0")
    found = with_quality(docs, seen).join(held.select("doc_id", held["quality"].alias("y")), "doc_id")
    right, good_kept, bad_kept, n = found.selectExpr("avg(int((quality.score >= 0.5) = (y = 1)))", "avg(CASE WHEN y = 1 THEN int(quality.score >= 0.3) END)", "avg(CASE WHEN y = 0 THEN int(quality.score >= 0.3) END)", "count(*)").first()
    assert n > 500 and right > 0.98 and good_kept > 0.998 and bad_kept < 0.1


def test_bounded_samples(spark, monkeypatch):
    monkeypatch.setattr(quality, "LABELLED", 300)
    monkeypatch.setattr(quality, "POOL", 200)
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = with_quality(docs, labels).join(labels.select("doc_id", labels["quality"].alias("y")), "doc_id")
    assert found.selectExpr("avg(int((quality.score >= 0.5) = (y = 1)))").first()[0] > 0.95


def test_odd_rows_and_labels(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, "x"), (None, "", "en", "s", -4, "x"), (2, "a " * 400_000, "en", "s", 5, "x"), (2, "b", "en", "s", 5, "x")], "doc_id long, text string, lang string, source string, n_chars long, y string")
    few = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (3, 7)], "doc_id long, quality int")
    out = with_quality(docs, few).collect()
    assert len(out) == 4 and all(r.quality is None for r in out)
    assert keep_good(docs, few.limit(0), 0.3).count() == 4 and keep_good(docs, few, 0.3).columns == docs.columns
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    more = whole.withColumn("y", whole["lang"]).unionByName(docs)
    scored = with_quality(more, spark.read.parquet(f"{SF}/labels.parquet")).where("y = 'x'").collect()
    assert len(scored) == 4 and all(0 <= r.quality.score <= 1 for r in scored)
    assert with_quality(whole.limit(0), few).collect() == []


@pytest.mark.parametrize("parts", [1, 7])
def test_same_scores_however_dealt(spark, parts):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    one = {r.doc_id: r.quality.score for r in with_quality(docs, labels).collect()}
    other = {r.doc_id: r.quality.score for r in with_quality(docs.repartition(parts), labels.repartition(parts)).collect()}
    assert other == pytest.approx(one, abs=1e-9)


def test_an_id_of_many_rows_and_clashing_names(spark):
    """One labelled id repeated 100,000 times stands for one row of the fit, and no column is lost."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    first = labels.first().doc_id
    many = spark.range(100_000).selectExpr(f"{first}L AS doc_id", "concat('same id ', id) AS text", "'en' AS lang", "'s' AS source", "10L AS n_chars")
    whole = docs.unionByName(many.select([many[f.name].cast(f.dataType).alias(f.name) for f in docs.schema]))
    sizes, real = [], quality.CoTrained
    quality.CoTrained = lambda views, y, pools, held: sizes.append(len(y)) or real(views, y, pools, held)
    try:
        kept = keep_good(whole.withColumn("__quality", quality.F.lit(7)), labels, 0.3)
    finally:
        quality.CoTrained = real
    assert sizes == [labels.select("doc_id").join(docs, "doc_id").distinct().count()]
    assert kept.columns == [*docs.columns, "__quality"] and {r[0] for r in kept.select("__quality").distinct().collect()} == {7}
