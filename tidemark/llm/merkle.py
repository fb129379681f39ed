"""Merkle manifest of a dataset, stored at every few levels and recomputed between them.

Rows are leaves, one tree for each value of `by` with its leaves in order of the key, and one tree over the roots of those. Of each
tree only every STEP-th level is written: a row of a stored level holds an aligned subtree's 2^STEP lowest nodes. The nodes between are
recomputed from them, once to find the level above and once more when proofs are drawn, and dropped.

A node's hash is that of its two children's hexadecimal hashes, a last child without a partner is hashed alone, and this goes on
while a level has more than one node. Leaves are dealt by ranges of (by, key), so a large tree is many tasks' work;
what reaches the driver is a count of leaves, and the root.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

#: Levels from one stored level to the next.
STEP = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: All levels of a subtree, its lowest nodes first.
_LEVELS = """aggregate(sequence(1, steps), array(transform(members, m -> m.hash)), (all, i) -> concat(all, array(transform(
  sequence(0, int((size(element_at(all, -1)) - 1) div 2)), j -> sha2(concat(element_at(all, -1)[2 * j], coalesce(get(element_at(all, -1), 2 * j + 1), '')), 256)))))"""
#: The sibling at each level of member i of a subtree: L or R, the side where it stands, and its hash; empty where there is none.
_SIBLINGS = """transform(sequence(0, steps - 1), s -> if(shiftright(i, s) % 2 = 1, concat('L', levels[s][shiftright(i, s) - 1]),
  coalesce(concat('R', get(levels[s], shiftright(i, s) + 1)), '')))"""


def packed(value: Column) -> Column:
    """A value as `-` if null, else its bytes' number, a colon and itself: no two rows are packed alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[packed(v) for v in values]), 256)


@dataclass(frozen=True)
class Tree:
    """Stored levels of trees: `groups` are tables (tree, pos, n, steps, members), lowest first; `singles` the levels' trees of one node; `roots` (tree, root)."""

    groups: list[DataFrame] = field(default_factory=list)
    singles: list[DataFrame] = field(default_factory=list)
    roots: DataFrame | None = None


@dataclass(frozen=True)
class Manifest:
    """The trees of a dataset's parts, the tree over their roots, and its root (None without a row)."""

    parts: Tree
    top: Tree
    root: str | None


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows (tree, ...) with pos, a row's place in its tree by `order`, and n, the tree's rows. Nulls come first, equal rows stand in either order."""
    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    dealt = saved(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    runs = dealt.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_k"))
    tree = W.partitionBy("tree")  # a row for each task that has rows of the tree
    runs = runs.withColumns({"_start": F.coalesce(F.sum("_k").over(tree.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("_k").over(tree)})
    return dealt.join(runs, ["tree", "_part"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_start")).drop("_part", "_at", "_first", "_start", "_k")


def grown(level: DataFrame, step: int = STEP) -> Tree:
    """Trees over the nodes (tree, pos, n, hash, row), from leaves to roots; `row` goes along with a leaf."""
    most = level.agg(F.max("n")).first()[0] or 0
    groups, singles = [], []
    while True:
        singles.append(level.where("n = 1"))
        if most <= 1:
            break
        found = level.where("n > 1").groupBy("tree", F.shiftright("pos", step).alias("pos")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct(F.col("pos").alias("at"), "hash", "row"))).alias("members"))
        groups.append(saved(found.withColumn("steps", F.expr(f"int(least({step}, length(bin(n - 1))))"))))
        up = groups[-1].select("tree", "pos", F.expr("shiftright(n + shiftleft(1L, steps) - 1, steps)").alias("n"), F.expr(f"element_at({_LEVELS}, -1)[0]").alias("hash"))
        level, most = saved(up.withColumn("row", F.lit(None).cast(level.schema["row"].dataType))), -(-most // 2**step)
    roots = singles[0].select("tree", F.col("hash").alias("root"))
    for one in singles[1:]:
        roots = roots.unionByName(one.select("tree", F.col("hash").alias("root")))
    return Tree(groups, singles, saved(roots))


def proofs(trees: Tree, above: DataFrame) -> DataFrame:
    """(tree, root, hash, row, proof) of every leaf; above (tree, root, above) has the proof of each tree's root.

    From the top down: a subtree's nodes are recomputed from the level stored below it, each member's siblings are taken, and the
    proof of the subtree's own root is appended.
    """
    ends = [one.join(above, "tree").select("tree", "pos", "root", "hash", "row", F.col("above").alias("proof")) for one in trees.singles]
    got = ends[-1]
    for groups, one in zip(reversed(trees.groups), reversed(ends[:-1])):
        upper = got.select("tree", "pos", "root", F.col("proof").alias("_upper"))
        met = groups.join(upper, ["tree", "pos"]).withColumn("levels", F.expr(_LEVELS))
        each = met.select("tree", "root", "levels", "steps", "_upper", F.posexplode("members").alias("i", "m"))
        own = each.select("tree", F.col("m.at").alias("pos"), "root", "m.hash", "m.row", F.concat(F.expr(_SIBLINGS), "_upper").alias("proof"))
        got = own.unionByName(one)
    return got.drop("pos")


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf's hash and a proof give."""
    up = lambda h, s: F.when(s == "", h).when(s.startswith("L"), F.concat(F.substring(s, 2, 64), h)).otherwise(F.concat(h, F.substring(s, 2, 64)))
    return F.aggregate(proof, start, lambda h, s: F.sha2(up(h, s), 256))


def proof_hash(proof: Column) -> Column:
    """Hash of a proof's siblings, from the leaf up."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.substring(s, 2, 64)), ""), 256)


def build(docs: DataFrame, leaf_of: Column | None = None, by: str = "lang", key: str = "doc_id", row: Column | None = None, step: int = STEP) -> Manifest:
    """The manifest of docs: a tree for each value of `by` (null is a value of its own and comes first), leaves by key (nulls first), then by hash.

    leaf_of: a row's hash, of FIELDS unless given; row: what is kept with a leaf for its proof, the key unless given. Rows with the
    same key are leaves of their own. An empty table has no root. Other columns are not looked at.
    """
    kept = F.struct(F.col(key)) if row is None else row
    leaves = docs.select(F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("-")).alias("tree"), F.col(key).alias("_key"), (leaf(*[F.col(c) for c in FIELDS]) if leaf_of is None else leaf_of).alias("hash"), kept.alias("row"))
    parts = grown(placed(saved(leaves), "_key", "hash").drop("_key"), step)
    tops = parts.roots.select(F.lit("").alias("tree"), F.col("tree").alias("part"), F.col("root").alias("hash"))
    top = grown(placed(tops, "part").withColumn("row", F.struct("part")).drop("part"), step)
    root = top.roots.first()
    return Manifest(parts, top, root and root["root"])


def proven(manifest: Manifest) -> DataFrame:
    """(row, leaf, subroot, root, proof) of every row: its hash, its part's root, the whole root, and the siblings from it to the root."""
    none = F.array().cast("array<string>")
    above = proofs(manifest.top, manifest.top.roots.select("tree", "root", none.alias("above"))).select(F.col("row.part").alias("tree"), F.col("hash").alias("root"), F.col("proof").alias("above"))
    got = proofs(manifest.parts, saved(above))
    return got.select("row", F.col("hash").alias("leaf"), F.col("root").alias("subroot"), F.lit(manifest.root).alias("root"), "proof")


def audit(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row, some of them tampered with.

    Rows whose decimal doc_id has a crc32 that 7 divides are folded with n_chars greater by one, unless it is null; a null doc_id is
    never tampered with. Rows may be equal, texts empty or null; an empty table gives no rows.
    """
    fields = {c: F.col(c) for c in FIELDS}
    own = leaf(*fields.values())
    bad = leaf(*(fields | {"n_chars": F.col("n_chars") + 1}).values())
    hit = F.coalesce((F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull(), F.lit(False))
    got = proven(build(docs, row=F.struct("doc_id", F.when(hit, bad).alias("seen")), leaf_of=own))
    got = got.withColumn("folded_root", folded(F.coalesce("row.seen", "leaf"), F.col("proof")))
    return got.select("row.doc_id", "leaf", "subroot", "root", proof_hash(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
