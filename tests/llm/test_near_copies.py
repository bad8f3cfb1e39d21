"""The pipeline's near-dedup stage against brute-force similarity of five-word sets."""

import itertools
import random
import re

import corpus_pipeline as pipeline
from waymark.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def five_words(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))}


def brute(rows):
    """Places of the rows that stay: one of each component of pairs from 0.8 on, of the least id."""
    sets = [five_words(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            up[root(j)] = root(i)
    best = {}
    for i, (key, text) in enumerate(rows):
        best[root(i)] = min(best.get(root(i), (key, text)), (key, text))
    return sorted(best.values())


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    return sorted((r.doc_id, r.text) for r in pipeline.near_dedup(spark, docs, "").collect())


def test_near_copies_and_strangers(spark):
    rng = random.Random(4)
    rows = []
    for base in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append((len(rows), " ".join(words)))
        for edits in (1, 2, 3, 4, 5, 6, 8):
            own = list(words)
            for at in rng.sample(range(5, 195), edits):
                own[at] = f"x{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(own)))
    assert kept(spark, rows) == brute(rows)


def test_a_large_group_and_texts_of_its_bands(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(words[: 120 - k % 3] + [f"end{k}"])) for k in range(60)]
    rows += [(100 + k, " ".join(words[: 80 + k] + [f"y{rng.random()}" for _ in range(30)])) for k in range(25)]
    assert kept(spark, rows) == brute(rows)


def test_unlike_texts_of_one_id_stay(spark):
    rng = random.Random(6)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(50))
    copied = text()
    rows = [(7, text()) for _ in range(20)] + [(3, copied), (7, copied)]
    got = kept(spark, rows)
    assert len(got) == 21 and got == sorted(rows[:21])


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((r.doc_id, r.text) for r in pipeline.near_dedup(spark, docs, "").collect())
    assert got == brute(rows)
    assert simhash.SHARE == (4, 5)


def test_a_group_around_a_hub(spark):
    """Copies of one text with many and few edits, cuts and copies of copies: links that don't go through the hub are found."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = []

    def edited(words, n):
        own = list(words)
        for _ in range(n):
            at = rng.randrange(len(own))
            kind = rng.randrange(3)
            if kind == 0:
                own[at] = f"e{rng.randrange(30)}"
            elif kind == 1:
                del own[at]
            else:
                own.insert(at, f"e{rng.randrange(30)}")
        return own

    for k in range(150):
        own = edited(base, rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 9]))
        rows.append((len(rows), " ".join(own)))
        if k % 10 == 0:
            rows += [(len(rows) + j, " ".join(edited(own, j))) for j in range(1, 4)]
    rows += [(len(rows) + k, " ".join(base[: 60 + k])) for k in range(0, 50, 2)]
    assert kept(spark, rows) == brute(rows)


def test_the_hub_is_the_text_in_the_middle(spark, monkeypatch):
    """Copies that share few of many possible cuts: the original is the hub of its component, and few of all pairs are left to test.

    Bands that hold none of that component have hubs of their own.
    """
    rng = random.Random(11)
    base = [f"w{k}" for k in range(150)]
    rows = [(1000, " ".join(base))]
    for k in range(250):
        cut = set(rng.sample(range(150), rng.choice([1, 2, 3, 4, 5, 6, 8, 10])))
        rows.append((k, " ".join(w for i, w in enumerate(base) if i not in cut)))
    seen = []

    def watched(members, sets, found=simhash._by_differences):
        pairs = found(members, sets)
        seen.append(({r.hub for r in members.select("hub").distinct().collect()}, pairs.count()))
        return pairs

    monkeypatch.setattr(simhash, "_by_differences", watched)
    assert kept(spark, rows) == brute(rows)
    ((hubs, pairs),) = seen
    middle = spark.createDataFrame(rows[:1], "id long, text string").select(simhash.word_key("text")).first()[0]
    assert middle in hubs
    assert pairs <= 0.05 * len(rows) * (len(rows) - 1) / 2  # 1 043 of 31 375 when this was written: cuts are shared


def test_no_join_is_broadcast_from_the_driver(spark, monkeypatch):
    """Near copies join dozens of tables; relations of them, each made in the driver, took it beyond its memory."""
    plans, cut = [], simhash.cut_lineage

    def watched(frame):
        done = cut(frame)
        plans.append(frame._jdf.queryExecution().executedPlan().toString())  # as it was run, not as it was begun
        return done

    monkeypatch.setattr(simhash, "cut_lineage", watched)
    monkeypatch.setattr(simhash, "BROADCAST", 0)  # the one table that is broadcast, of a bounded size
    rng = random.Random(12)
    words = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join(w if rng.random() > 0.03 else f"x{rng.randrange(9)}" for w in words)) for i in range(30)]
    assert kept(spark, rows) == brute(rows)
    assert any("SortMergeJoin" in p for p in plans)
    assert not any("BroadcastHashJoin" in p for p in plans)
