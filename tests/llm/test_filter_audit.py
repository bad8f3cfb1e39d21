"""The filter audit against counting each row at each step of each order."""

import re
from collections import Counter
from itertools import permutations

from waymark.llm.filter_audit import Counters, audit_documents, audited

DOCS = "doc_id long, text string, lang string, source string, n_chars long, mask int, n long, print string"
LABELS = "doc_id long, quality int, toxic int, good boolean"


def failing(text, doc_id, least):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    capitals = sum("A" <= c <= "Z" for c in text)
    said = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * capitals > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
    return {x for x, yes in said.items() if yes} | ({"E"} if doc_id is not None and doc_id > least.get(text, doc_id) else set())


def brute(docs, labels):
    good, toxic = ({r[0] for r in labels if r[k] == 1 and r[0] is not None} for k in (1, 2))
    texts = [(r[0], r[1] or "", r[3] or "") for r in docs]
    least: dict = {}
    for i, text, _ in texts:
        if i is not None:
            least[text] = min(i, least.get(text, i))
    rows = [(part, failing(text, i, least), i in good, i in toxic) for i, text, part in texts]
    counts, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                c = counts[part, order, step] = Counter()
                for p, fails, is_good, is_toxic in rows:
                    if p != part:
                        continue
                    earlier = bool(fails & set(order[: step - 1]))
                    removed = x in fails and not earlier
                    c.update({"kept": not earlier and not removed, "removed": removed, "redundant": x in fails and earlier, "unique": fails == {x}, "good": removed and is_good, "toxic": removed and is_toxic})
                shapley[part, x] += c["removed"]
    return sorted((*k, *(c[n] for n in ("kept", "removed", "redundant", "unique", "good", "toxic")), shapley[k[0], k[1][k[2] - 1]]) for k, c in counts.items())


def test_against_brute_force(spark):
    long = " ".join(f"word{k}" for k in range(60))
    texts = [long, long, long + " LOUD" * 20, "a b " * 40, "", None, "  \t\n", "50 % off", long + " #", "SHOUT", long.replace("word", "Ä"), "x" * 100_000 + " " + long, "a b c"]
    docs = [(k * 3 % 40, texts[k % len(texts)], "en", ["s0", "s1", "", None][k % 4], 1, 3, 9, "p") for k in range(80)]
    docs += [(None, long, "en", "s0", 1, 3, 9, "p"), (None, None, None, None, None, None, None, None)] * 2 + [docs[0], docs[0]]
    labels = [(k, k % 2, k % 5 == 0, False) for k in range(0, 40, 2)] + [(3, None, 1, True), (3, 1, None, True), (None, 1, 1, True)]
    labels = [(a, b, None if c is None else int(c), d) for a, b, c, d in labels]
    found = audit_documents(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, LABELS))
    assert sorted(map(tuple, found.collect())) == brute(docs, labels)


def test_empty_tables(spark):
    assert audit_documents(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
    one = audit_documents(spark.createDataFrame([(1, "x", "", None, 1, 1, 1, "")], DOCS), spark.createDataFrame([], LABELS))
    assert one.count() == 600 and {r.part for r in one.collect()} == {""}


def test_full_fields_do_not_run_over(spark):
    n = (1 << 54) - 1
    rows = [("p", 31, True, True, n), ("p", 31, True, False, n), ("p", 0, False, False, 1)]
    found = audited(spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean, n long"), "ABCDE")
    first = found.where("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [(r.kept, r.removed, r.redundant, r.unique_fails) for r in first] == [(1, 2 * n, 0, 0), *[(1, 0, 2 * n, 0)] * 4]
    assert first[0].good_lost == 2 * n and first[0].toxic_lost == n


def test_every_mask_packs_its_600_outcomes():
    counters = Counters("ABCDE")
    assert len(counters.steps) == 600
    for mask, packed in enumerate(counters.of_mask):
        removed = counters.unpacked(packed)[:600]
        assert removed.sum() == (120 if mask else 0)  # once in each order, at its first failing step
