"""Merkle dataset manifest: leaves in groups, eight children a node, digests to children in a store, proofs by descent.

Building. Rows are dealt by ranges of (group, key) and numbered inside their partitions; a small table of the rows of each
partition and group gives the offsets, so no group is ordered in one task. Runs of eight leaves become nodes, runs of eight nodes the
next level, until one node of each group is left, its subroot; the subroots, in order of their groups, make a tree of the same kind.
Each level is written as records from a node's digest to its children's.

Proving. Requests go down from the root by the digits of their rank in base eight: the digest finds its record, the digit selects a child, the
others are collected as a segment of the path. Requests with the same leading digits are one row until they part, so a level has as many rows as it
has nodes. Segments are reversed at the end: a proof runs from the leaf up. Folding a leaf with its segments gives the root again, if nothing was changed.

Nulls: a null field is written ``-``, the null group comes first, null keys come first in their group. Rows that repeat a key
are ordered by their digest; equal rows are leaves of their own, side by side, and equal nodes share a record. A single leaf is its
subroot, a single subroot is the root; a leaf without siblings has the proof of no digests. An empty table has no root and no rows. Other columns
are not read; long texts are hashed whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import ascii_lower, cut_lineage

#: Children of a node.
ARITY = 8
#: Offsets broadcast at most (rows of about 40 bytes).
OFFSETS = 100_000


def digest(fields: list[Column]) -> Column:
    """Lowercase hex sha256 of the fields, each ``-`` or its UTF-8 bytes' number, a colon and itself."""
    written = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields]
    return F.sha2(F.concat(*written).cast("binary"), 256)


def _joined(digests: Column) -> Column:
    """The node over these digests."""
    return F.sha2(F.array_join(digests, "").cast("binary"), 256)


def numbered(leaves: DataFrame) -> DataFrame:
    """``leaves`` (grp, key, leaf, ...) with tree (the group's number in order), pos (the row's number in its group) and width (the group's rows)."""
    keys = [F.asc_nulls_first("grp"), F.asc_nulls_first("key"), F.asc("leaf"), F.asc("tie")]
    # equal rows may stand in any order, so a tie of their own lets a large group of them fall apart
    dealt = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    rows = cut_lineage(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("slice", F.shiftright("at", 33)))
    spans = cut_lineage(rows.groupBy("slice", "grp").agg(F.count("*").alias("n"), F.min("at").alias("from")))
    # rows of a window here: the slices of a group, the groups that begin in a slice, the slices
    groups = spans.groupBy("grp").agg(F.min("slice").alias("first"), F.sum("n").alias("width"))
    begun = groups.groupBy(F.col("first").alias("slice")).agg(F.count("*").alias("begun"))
    ahead = begun.select(F.col("slice").alias("first"), (F.sum("begun").over(Window.orderBy("slice")) - F.col("begun")).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("first").orderBy(F.asc_nulls_first("grp"))) - 1
    trees = groups.withColumn("inside", inside).join(ahead, "first").select(F.col("grp").alias("g"), "width", (F.col("inside") + F.col("ahead")).alias("tree"))
    before = F.sum("n").over(Window.partitionBy("grp").orderBy("slice")) - F.col("n")
    offsets = spans.withColumn("before", before).join(trees, F.col("grp").eqNullSafe(F.col("g")))
    offsets = cut_lineage(offsets.select(F.col("slice").alias("s"), "g", "tree", "width", (F.col("before") - F.col("from")).alias("offset")))
    few = F.broadcast(offsets) if offsets.count() <= OFFSETS else offsets
    met = rows.join(few, (F.col("slice") == F.col("s")) & F.col("grp").eqNullSafe(F.col("g")))
    return met.select(*(c for c in leaves.columns), "tree", (F.col("at") + F.col("offset")).alias("pos"), "width")


def _climbed(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``nodes`` (tree, pos, digest, width) joined by runs until each tree has one: tops (tree, depth, digest), and records (digest, children) by level."""
    tops, levels, depth = [], [], 0
    while True:
        tops.append(nodes.where("width = 1").select("tree", F.lit(depth).alias("depth"), "digest"))
        rest = nodes.where("width > 1")
        runs = rest.groupBy("tree", F.expr(f"pos div {ARITY}").alias("pos"), F.expr(f"(width + {ARITY - 1}) div {ARITY}").alias("width"))
        children = F.transform(F.sort_array(F.collect_list(F.struct(F.col("pos").alias("p"), "digest"))), lambda x: x["digest"])
        above = cut_lineage(runs.agg(children.alias("children")).withColumn("digest", _joined(F.col("children"))))
        if above.isEmpty():
            whole = tops[0]
            for top in tops[1:]:
                whole = whole.union(top)
            return cut_lineage(whole), levels
        levels.append(above.select("digest", "children"))
        nodes, depth = above.select("tree", "pos", "digest", "width"), depth + 1


@dataclass
class Manifest:
    """What was built: ``leaves`` by runs (tree, run, members), the store's levels, and the roots."""

    runs: DataFrame
    tops: DataFrame
    levels: list[DataFrame]
    root: str | None
    root_depth: int
    root_levels: list[DataFrame]


def build(leaves: DataFrame) -> Manifest:
    """The manifest over ``leaves`` (grp, key, leaf, and other columns, which stay with them)."""
    own = F.struct("pos", *leaves.columns)
    runs = cut_lineage(numbered(leaves).groupBy("tree", F.expr(f"pos div {ARITY}").alias("run"), "width").agg(F.sort_array(F.collect_list(own)).alias("members")))
    nodes = runs.select("tree", "width", F.inline("members")).select("tree", "pos", F.col("leaf").alias("digest"), "width")
    tops, levels = _climbed(nodes)
    roots, root_levels = _climbed(tops.select(F.lit(0).alias("tree"), F.col("tree").alias("pos"), "digest", F.lit(tops.count()).alias("width")))
    last = roots.first()
    return Manifest(runs, tops, levels, last.digest if last else None, last.depth if last else 0, root_levels)


def _descended(front: DataFrame, records: DataFrame, keep: list[str]) -> DataFrame:
    """A level down: ``front`` (pos, digest, path, ...) opened into its children, the siblings of each a further segment."""
    opened = front.join(records.dropDuplicates(["digest"]), "digest").select(*keep, "pos", "path", "children", F.posexplode("children").alias("digit", "child"))
    siblings = F.filter("children", lambda _, i: i != F.col("digit"))
    segment = F.array(F.struct(F.col("digit"), siblings.alias("siblings")))
    return opened.select(*keep, (F.col("pos") * ARITY + F.col("digit")).alias("pos"), F.col("child").alias("digest"), F.concat("path", segment).alias("path"))


def _asked(front: DataFrame, wanted: DataFrame | None, level: int) -> DataFrame:
    """The rows that lead to a wanted leaf."""
    if wanted is None:
        return front
    return front.join(wanted.select("tree", F.floor(F.col("pos") / ARITY**level).alias("pos")).distinct(), ["tree", "pos"], "left_semi")


def prove(manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """The leaves with all their columns, subroot, root and path (digit and siblings of each level, from the leaf up).

    ``wanted``: tree and pos of the leaves asked for, each once; without it, all leaves.
    """
    spark = manifest.runs.sparkSession
    path = "array<struct<digit:int,siblings:array<string>>>"
    front = spark.range(1 if manifest.root else 0).select(F.lit(0).cast("long").alias("pos"), F.lit(manifest.root).cast("string").alias("digest"), F.array().cast(path).alias("path"))
    for level in range(manifest.root_depth, 0, -1):
        front = _descended(front, manifest.root_levels[level - 1], [])
        if wanted is not None:
            front = front.join(wanted.select(F.floor(F.col("tree") / ARITY ** (level - 1)).alias("pos")).distinct(), "pos", "left_semi")
    trees = front.select(F.col("pos").alias("tree"), F.col("digest").alias("subroot"), "path").join(manifest.tops.select("tree", "depth"), "tree")
    trees = cut_lineage(trees.select("tree", "depth", F.lit(0).cast("long").alias("pos"), F.col("subroot").alias("digest"), "path", "subroot"))

    def begun(depth: int) -> DataFrame:
        return trees.where(F.col("depth") == depth).drop("depth")

    keep, front = ["tree", "subroot"], begun(len(manifest.levels))
    for level in range(len(manifest.levels), 1, -1):
        front = _asked(_descended(front, manifest.levels[level - 1], keep), wanted, level - 1).unionByName(begun(level - 1))
    # the last digit is the leaf's place in its run: the leaves of a run are read together
    if manifest.levels:
        front = front.join(manifest.levels[0].dropDuplicates(["digest"]), "digest").select("tree", "subroot", F.col("pos").alias("run"), "path", "children")
        alone = begun(0).select("tree", "subroot", F.lit(0).cast("long").alias("run"), "path", F.lit(None).cast("array<string>").alias("children"))
        front = front.unionByName(alone)
    else:
        front = begun(0).select("tree", "subroot", F.lit(0).cast("long").alias("run"), "path", F.lit(None).cast("array<string>").alias("children"))
    leaves = front.join(manifest.runs.drop("width"), ["tree", "run"])
    leaves = leaves.select("tree", "subroot", "path", "children", F.posexplode("members").alias("digit", "m"))
    siblings = F.filter("children", lambda _, i: i != F.col("digit"))
    last = F.when(F.col("children").isNull(), F.array().cast(path)).otherwise(F.array(F.struct("digit", siblings.alias("siblings"))))
    found = leaves.select("tree", "m.*", "subroot", F.lit(manifest.root).alias("root"), F.concat(last, F.reverse("path")).alias("path"))
    return found if wanted is None else found.join(wanted.select("tree", "pos").distinct(), ["tree", "pos"], "left_semi")


def proof_digest(path: Column) -> Column:
    """The digest of all siblings, from the leaf up, each level from left to right."""
    return _joined(F.flatten(F.transform(path, lambda s: s["siblings"])))


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``path`` give."""

    def up(below: Column, s: Column) -> Column:
        return _joined(F.concat(F.slice(s["siblings"], F.lit(1), s["digit"]), F.array(below), F.slice(s["siblings"], s["digit"] + 1, F.lit(ARITY))))

    return F.aggregate(path, leaf, up)


def tamper_test(documents: DataFrame) -> DataFrame:
    """The manifest of ``documents`` by lang, and what verifying finds where a third of the texts is lower-cased (a contract's test)."""
    other = ["doc_id", "source", "lang", "n_chars"]
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    leaf = digest([F.col(c) for c in (*other, "text")])
    changed = F.when(chosen, digest([*(F.col(c) for c in other), ascii_lower(F.col("text"))]))
    leaves = documents.select(F.col("lang").alias("grp"), F.col("doc_id").alias("key"), leaf.alias("leaf"), changed.alias("changed"))
    proved = prove(build(leaves))
    again = folded(F.coalesce("changed", "leaf"), F.col("path"))
    found = proved.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), again.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
