"""Filter interaction audit: what each filter of a chain removes, in every order of the filters, by wide packed counters.

A row's mask says which filters it fails. What happens to it at each step of each order follows from the mask alone, so every
mask stands for one big integer, whose fields of ``WIDTH`` bits hold a 1 for each step that removes such a row, each filter that it
fails and each that it alone fails, and for the row itself. Summing integers counts all steps at once. Tasks sum their own rows for each part;
the sums meet in two rounds (by part and ``FAN``-th task, then by part), so no task holds more than a bounded number of them. A field
counts at most the rows of the part, far below 2^WIDTH, so none runs over into the next. Kept and redundant rows
and the Shapley sums follow from the unpacked counts.

Copies are found without bringing a group together: the least id of each text (with map-side combine) is joined on
text and id, so a text of a third of all rows is spread by its ids. Rows equal in id, text and part are counted to one first.

Null texts are empty; an empty text fails as its counts say. Null ids are no copies of anything and have no label. Repeated ids: all
rows of the least id of a text pass as first. An id is good or toxic if any of its label rows says so. Null and empty parts are one part.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import BLANKS, cut_lineage

#: Bits of a field.
WIDTH = 64
#: Sums of tasks that meet first: as many heaps for each part.
FAN = 256

OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


class Counters:
    """The big integers of the masks of ``letters``, and what their sums say."""

    def __init__(self, letters: str):
        self.letters = letters
        self.orders = ["".join(p) for p in permutations(letters)]
        self.steps = [(order, k) for order in self.orders for k in range(len(letters))]
        self.fields = len(self.steps) + 2 * len(letters) + 1
        self.of_mask = [self._packed(mask) for mask in range(1 << len(letters))]

    def _packed(self, mask: int) -> int:
        """Bit k of the mask: the row fails letters[k]."""
        fails = {x for k, x in enumerate(self.letters) if mask >> k & 1}
        ones = [order[k] in fails and not fails & set(order[:k]) for order, k in self.steps]
        ones += [x in fails for x in self.letters] + [fails == {x} for x in self.letters] + [True]
        return sum(1 << WIDTH * i for i, one in enumerate(ones) if one)

    def to_bytes(self, packed: int) -> bytes:
        return packed.to_bytes(self.fields * WIDTH // 8, "little")

    def unpacked(self, packed: int) -> np.ndarray:
        return np.frombuffer(self.to_bytes(packed), "<u8").astype(np.int64)

    def rows(self, part: str, whole: int, good: int, toxic: int) -> list[dict]:
        n, own = len(self.steps), len(self.letters)
        counts, lost_good, lost_toxic = (self.unpacked(x).tolist() for x in (whole, good, toxic))
        fails, unique = dict(zip(self.letters, counts[n:], strict=False)), dict(zip(self.letters, counts[n + own :], strict=False))
        shapley: dict[str, int] = defaultdict(int)
        for (order, k), removed in zip(self.steps, counts, strict=False):
            shapley[order[k]] += removed
        out, kept = [], 0
        for i, (order, k) in enumerate(self.steps):
            x, kept = order[k], (kept if k else counts[-1]) - counts[i]
            out.append({
                "part": part, "filter_order": order, "step": k + 1, "kept": kept, "removed": counts[i], "redundant": fails[x] - counts[i], "unique_fails": unique[x],
                "good_lost": lost_good[i], "toxic_lost": lost_toxic[i], "shapley": shapley[x],
            })
        return out


def audited(masks: DataFrame, letters: str) -> DataFrame:
    """A row for each part, order of ``letters`` and step, of ``masks`` (part, mask int, good and toxic boolean, n long: rows that it stands for)."""
    counters = Counters(letters)
    packed = "part string, heap int, whole binary, good binary, toxic binary"

    def table(sums: dict[tuple[str, int], list[int]]) -> pa.Table:
        rows = [{"part": part, "heap": heap} | dict(zip(("whole", "good", "toxic"), map(counters.to_bytes, own), strict=True)) for (part, heap), own in sums.items()]
        return pa.Table.from_pylist(rows, pa.schema([("part", pa.string()), ("heap", pa.int32()), *((c, pa.binary()) for c in ("whole", "good", "toxic"))]))

    def summed(batches):
        sums: dict[tuple[str, int], list[int]] = {}
        heap = TaskContext.get().partitionId() % FAN
        for batch in batches:
            for part, mask, good, toxic, n in zip(*(batch.column(c).to_pylist() for c in ("part", "mask", "good", "toxic", "n")), strict=True):
                own = sums.setdefault((part, heap), [0, 0, 0])
                big = counters.of_mask[mask] * n
                own[0] += big
                if good:
                    own[1] += big
                if toxic:
                    own[2] += big
        yield from table(sums).to_batches()

    def met(group: pa.Table) -> list[int]:
        return [sum(int.from_bytes(x, "little") for x in group.column(c).to_pylist()) for c in ("whole", "good", "toxic")]

    def merged(group: pa.Table) -> pa.Table:
        return table({(group.column("part")[0].as_py(), group.column("heap")[0].as_py()): met(group)})

    def unpacked(group: pa.Table) -> pa.Table:
        kinds = [(c, pa.string() if c in ("part", "filter_order") else pa.int32() if c == "step" else pa.int64()) for c in (x.split()[0] for x in OUT.split(", "))]
        return pa.Table.from_pylist(counters.rows(group.column("part")[0].as_py(), *met(group)), pa.schema(kinds))

    sums = masks.select("part", "mask", "good", "toxic", "n").mapInArrow(summed, packed)
    return sums.groupBy("part", "heap").applyInArrow(merged, packed).groupBy("part").applyInArrow(unpacked, OUT)


def text_fails(text) -> dict:
    """Filters A to D on a text column without nulls."""
    bare = F.btrim(text, F.lit(BLANKS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    # each look at the words through one binding, so that a text is split once
    few = F.transform(F.array(words), lambda w: F.struct((F.size(w) < 50).alias("A"), (100 * F.size(F.array_distinct(w)) < 65 * F.size(w)).alias("B")))[0]
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"words": few, "C": 100 * capitals > 5 * F.length(text), "D": text.rlike("[#$%&*|]")}


def audit_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A (short), B (repetitive), C (capitals), D (signs) and E (copies) over ``documents``, by source."""
    whole = F.coalesce("text", F.lit(""))
    fails = text_fails(F.col("whole"))
    read = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), whole.alias("whole"))
    read = read.select("doc_id", "part", F.unhex(F.sha2("whole", 256)).alias("print"), fails["words"].alias("few"), fails["C"].alias("c"), fails["D"].alias("d"))
    bits = [F.col("few.A"), F.col("few.B"), F.col("c"), F.col("d")]
    mask = sum((bit.cast("int") * (1 << k) for k, bit in enumerate(bits)), F.lit(0))
    rows = cut_lineage(read.select("doc_id", "part", "print", mask.alias("mask")).groupBy("doc_id", "part", "print", "mask").agg(F.count("*").alias("n")))

    first = rows.where("doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    told = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    named = rows.where("doc_id IS NOT NULL").join(first, ["doc_id", "print"], "left").join(told, "doc_id", "left")
    copy = F.when(F.col("first"), F.lit(0)).otherwise(F.lit(1 << 4))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    masks = named.select("part", (F.col("mask") + copy).alias("mask"), yes("good"), yes("toxic"), "n")
    nameless = rows.where("doc_id IS NULL").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "n")
    return audited(masks.union(nameless), "ABCDE")
