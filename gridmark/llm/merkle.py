"""Merkle manifest of a table: a tree a group, and one tree over the groups' roots.

Nodes are rows with a place among the nodes of their group. At each level fixed-offset lag and lead
columns, masked by a node's slot in its run of FAN and by the run's length, are its siblings, and the first
row of each run hashes the run to the parent. Windows hold CHUNK nodes, so a group with a third of all rows is many
partitions. Places come from one range partitioning and the row counts of its parts. On the way down every node
gets the siblings of all its ancestors from its parent, by a join on group and place; the last join
meets the leaves, which hash their proof and fold what is claimed of them up to the root.

Each level is stored in the shared folder; the driver learns the depth of the deepest group, the root, and nothing else.

Defined results: nulls are `-` in a leaf and sort first; equal ids are ordered by their leaves; equal rows are
equal leaves, each with its own place (which of them has which place is open, and shows in their proofs only);
a group of one leaf has that leaf as its subroot; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmark.session import materialize

FAN = 16
CHUNK = 64  # nodes of a window, a multiple of FAN


def field(value: Column) -> Column:
    """A value with its length in front; null is `-`."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Rows with `place` (from 0) in the order of their group, and `n`, the group's rows.

    `rows` must be stored. Rows are ranged over all keys and a row number, so neither a large group nor equal rows
    land in one task; the rows of a group within a task are consecutive.
    """
    ranged = rows.withColumn("_row", F.monotonically_increasing_id())
    keys = [group, *order, "_row"]
    sorted_ = ranged.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
    stored = materialize(sorted_.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).select(
        group, "_part", (F.col("_first") - F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_zero"), F.sum("_n").over(whole).alias("n")
    )
    return stored.join(parts, [group, "_part"]).withColumn("place", F.col("_at") - F.col("_zero")).drop("_at", "_part", "_zero")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Nodes (group, place, n, digest, ...) with `left` and `right`, the digests of the rest of their run."""
    order = Window.partitionBy("group", F.floor(F.col("place") / CHUNK)).orderBy("place")
    slot = F.col("place") % FAN
    run = F.least(F.lit(FAN), F.col("n") - F.col("place") + slot)
    other = lambda inside, value: F.when(inside, value).otherwise("")
    left = [other(slot >= k, F.lag("digest", k).over(order)) for k in range(FAN - 1, 0, -1)]
    right = [other(slot + k < run, F.lead("digest", k).over(order)) for k in range(1, FAN)]
    return nodes.withColumns({"left": F.concat(*left), "right": F.concat(*right)})


def parents(nodes: DataFrame) -> DataFrame:
    """The level above: one node a run, hashed by the run's first row."""
    first = nodes.where((F.col("n") > 1) & (F.col("place") % FAN == 0))
    return first.select(
        "group", (F.col("place") / FAN).cast("bigint").alias("place"), F.ceil(F.col("n") / FAN).cast("bigint").alias("n"),
        F.sha2(F.concat("digest", "right"), 256).alias("digest"),
    )


def levels(nodes: DataFrame) -> list[DataFrame]:
    """All levels from the given one up, stored; groups of one node end where they are."""
    found = [materialize(with_siblings(nodes))]
    most = found[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        most, above = -(-most // FAN), parents(found[-1])
        alone = above.withColumns({"left": F.lit(""), "right": F.lit("")})
        found.append(materialize(with_siblings(above) if most > 1 else alone))
    return found


def paths(tree: list[DataFrame], above: DataFrame, *keep: str) -> DataFrame:
    """The lowest level's nodes with what `above` has of their group, `ups` in front extended by their own way up.

    above(group, ups, ...): one row a group; ups are the siblings (left, right) on the way up from the group's root.
    """
    carried = [c for c in above.columns if c not in ("group", "ups")]
    known = None
    for level in reversed(tree):
        kept = keep if level is tree[0] else ()
        parts = [level.where("n = 1").join(above, "group").select("group", "place", *kept, *carried, "ups")]
        if known is not None:
            higher = known.withColumnRenamed("place", "_parent")
            own = level.where("n > 1").withColumn("_parent", F.floor(F.col("place") / FAN)).join(higher, ["group", "_parent"])
            way = F.concat(F.array(F.struct("left", "right")), "ups").alias("ups")
            parts.append(own.select("group", "place", *kept, *carried, way))
        known = reduce(DataFrame.unionByName, parts)
        if level is not tree[0]:
            known = materialize(known)
    return known


def fold(start: Column, ups: Column) -> Column:
    """The root that a leaf and the siblings on its way up give."""
    return F.aggregate(ups, start, lambda digest, up: F.sha2(F.concat(up["left"], digest, up["right"]), 256))


def manifest(leaves: DataFrame, key: str = "doc_id", group: str = "source") -> DataFrame:
    """The key, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    leaves(key, group, leaf, claimed): claimed is the leaf to verify, null where it is the leaf itself.
    """
    # Null sorts before every text, and joins like any other value.
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    given = materialize(leaves.select(F.col(key).alias("key"), named.alias("group"), F.col("leaf").alias("digest"), F.col("claimed").alias("claimed")))
    trees = levels(numbered(given, "group", ["key", "digest", "claimed"]))
    roots = reduce(DataFrame.unionByName, [level.where("n = 1").select("group", "digest") for level in trees])
    subroots = materialize(roots.select(F.lit("").alias("group"), F.col("group").alias("name"), "digest"))
    top = levels(numbered(subroots, "group", ["name"]))
    last = top[-1].where("n = 1").first()
    root = F.lit(last["digest"] if last else None).cast("string")
    none = F.array().cast("array<struct<left:string,right:string>>")
    over = leaves.sparkSession.range(1).select(F.lit("").alias("group"), none.alias("ups"))
    above = paths(top, over, "name", "digest").select(F.col("name").alias("group"), F.col("digest").alias("subroot"), "ups")
    proven = paths(trees, materialize(above), "key", "digest", "claimed")
    folded = fold(F.coalesce("claimed", "digest"), F.col("ups"))
    siblings = F.array_join(F.transform("ups", lambda up: F.concat(up["left"], up["right"])), "")
    return proven.select(
        F.col("key").alias(key), F.col("digest").alias("leaf"), "subroot", root.alias("root"), F.sha2(siblings, 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def document_leaves(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), changed: Column | None = None,
                    change: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, source, leaf, claimed of documents; where `changed`, claimed is the leaf of the rows as changed."""
    leaf = leaf_hash(*[F.col(f) for f in fields])
    claimed = F.lit(None).cast("string")
    if changed is not None:
        claimed = F.when(changed, leaf_hash(*[(change or {}).get(f, F.col(f)) for f in fields]))
    return docs.select("doc_id", "source", leaf.alias("leaf"), claimed.alias("claimed"))


def lower_ascii(text: Column) -> Column:
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())
