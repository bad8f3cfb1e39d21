"""The Merkle manifest against a brute-force tree in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from waymark.llm.merkle import build, folded, numbered, proof_digest, prove, tamper_test

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos int, digest string"


def digest_of(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return digest_of([*(field(row[c]) for c in ("doc_id", "source", "lang", "n_chars")), field(text)])


def tree_of(digests):
    """The root, and for each leaf its (digit, siblings) from the leaf up."""
    paths, nodes = [[] for _ in digests], [(d, [i]) for i, d in enumerate(digests)]
    while len(nodes) > 1:
        above = []
        for a in range(0, len(nodes), 8):
            run = nodes[a : a + 8]
            for k, (_, own) in enumerate(run):
                for i in own:
                    paths[i].append((k, [x[0] for j, x in enumerate(run) if j != k]))
            above.append((digest_of([x[0] for x in run]), [i for x in run for i in x[1]]))
        nodes = above
    return nodes[0][0], paths


def brute(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), r))
    groups = [sorted(langs[k], key=lambda x: x[:3]) for k in sorted(langs, key=lambda k: (k is not None, (k or "").encode()))]
    trees = [tree_of([x[2] for x in own]) for own in groups]
    if not trees:
        return []
    root, tops = tree_of([t[0] for t in trees])
    out = []
    for own, (sub, paths), top in zip(groups, trees, tops, strict=True):
        for (_, _, leaf, r), path in zip(own, paths, strict=True):
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            again = leaf_of(r, text)
            for k, siblings in path + top:
                again = digest_of([*siblings[:k], again, *siblings[k:]])
            out.append((r["doc_id"], leaf, sub, root, digest_of([y for _, s in path + top for y in s]), again, again == root))
    return out


def documents(n, langs, long=False):
    rows = [(i, f"Text {i} ÄÉ" * (1 + i % 3), langs[i % len(langs)], f"s{i % 5}", 10 * i) for i in range(n)]
    rows += [(None, "No id", langs[0], None, None), (None, None, None, None, 3), (7, "again", langs[0], "", 0), (7, "again", langs[0], "", 0), (3, "", "", "x", 1)] if long else []
    return [(*r, "clash", 5, "clash") for r in rows]


@pytest.mark.parametrize(
    "rows",
    [
        documents(0, ["en"]), documents(1, ["en"]), documents(2, ["en", "de"]), documents(8, ["en"]), documents(9, ["en"]), documents(65, ["en"]),
        documents(150, ["en", "de", "en", None], long=True), documents(300, [f"l{k}" for k in range(20)], long=True), [(1, "x" * 300_000, "en", "s", 1, "", 1, "")] * 40,
    ],
)
def test_against_brute_force(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(repr, map(tuple, tamper_test(frame).collect())))
    assert got == sorted(map(repr, brute([r.asDict() for r in frame.collect()])))


def test_some_leaves_asked_for(spark):
    rows = documents(700, ["en", "de", "fr"])
    frame = spark.createDataFrame(rows, SCHEMA)
    leaves = frame.select(F.col("lang").alias("grp"), F.col("doc_id").alias("key"), F.sha2("text", 256).alias("leaf"))
    manifest = build(leaves)
    whole = {(r.tree, r.pos): r for r in prove(manifest).collect()}
    asked = spark.createDataFrame([(0, 0), (1, 233), (2, 17), (2, 17), (9, 9), (0, 233)], "tree long, pos long")
    some = prove(manifest, asked).withColumn("again", folded(F.col("leaf"), F.col("path"))).withColumn("proof", proof_digest(F.col("path"))).collect()
    assert {(r.tree, r.pos) for r in some} == {(0, 0), (1, 233), (2, 17)} and len(some) == 3
    assert all(r.again == manifest.root and r.path == whole[r.tree, r.pos].path for r in some)


def test_large_group_is_numbered_in_many_slices(spark):
    """One group of 20 000 rows with few unlike keys and equal leaves: no slice holds much more than its share."""
    frame = spark.range(20_000).select(F.lit("en").alias("grp"), (F.col("id") % 7).alias("key"), F.lit("same").alias("leaf"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = numbered(frame.repartition(6)).cache()
        assert found.select("pos").distinct().count() == 20_000 and found.agg(F.max("pos")).first()[0] == 19_999
        steps = found.groupBy("key").agg(F.min("pos").alias("a"), F.max("pos").alias("b")).orderBy("key").collect()
        assert all(x.b < y.a for x, y in zip(steps, steps[1:], strict=False))
        assert max(r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()) < 9_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
