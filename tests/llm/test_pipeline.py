import re

import corpus_pipeline as pipeline
from pyspark.sql import functions as F
from test_line_dedup import brute as lines_brute
from test_near_copies import brute as near_brute

SF = "/root/testdata/sf0.001"


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "secret scans", "best-fit packing"]
    good = pipeline.quality(spark, docs, SF)
    assert good.columns == docs.columns and good.schema == docs.schema
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in clean) >= 0.98 * len(clean)
    assert sum(q == 0 and i in kept for i, q in labels.items()) <= 0.1 * len(labels)

    lined = pipeline.line_dedup(spark, docs, SF)
    have = docs.orderBy("doc_id").collect()
    want = [t for t, _, _ in lines_brute([r.text for r in have], 10)]
    assert rows_of(lined) == sorted(((r.doc_id, t, r.lang, r.source, len(t)) for r, t in zip(have, want, strict=True)), key=str)

    single = pipeline.near_dedup(spark, docs, SF)
    assert sorted((r.doc_id, r.text) for r in single.collect()) == near_brute([(r.doc_id, r.text) for r in have])

    hidden = pipeline.secret_scan(spark, docs, SF)
    texts = {r.doc_id: r.text for r in hidden.collect()}
    for r in have:
        bare = re.sub(r'token = "[0-9a-f]{40}"', 'token = "[SECRET]"', r.text)
        assert not re.search(r'token = "[0-9a-f]{40}"', texts[r.doc_id])
        assert texts[r.doc_id] == bare or "[SECRET]" in texts[r.doc_id]


def test_odd_rows_through_all_stages(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, None), (None, "no id here", "en", "s", 10), (2, "", "en", "s", 0), (3, "same words in here now", "en", "s", 22), (3, "same words in here now", "en", "s", 22), (4, "same words in here now", "en", "s", 22)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    now = docs
    for _, stage in pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.schema.simpleString() == docs.schema.simpleString()
    single = pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in single) == ["1", "2", "3", "None"]
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_clashing_names_through_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    names = ["__quality", "__rank", "__node", "__hits", "____hits_found", "n_lines", "n_dropped", "a.b"]
    now = docs.select("*", *(F.lit(n).alias(n) for n in names))
    wide = now.schema.simpleString()
    for _, stage in pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.schema.simpleString() == wide
        assert all(r[n] == n for r in now.collect() for n in names)


def test_run(spark):
    out = pipeline.run(spark, SF).collect()
    assert out and {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out[0].asDict())
