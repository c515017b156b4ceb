"""Merkle manifest of a table: leaf digests, one tree per group, one tree over the groups' roots.

Every level of a tree is a table of nodes ``(grp, idx, n, digest)``, numbered
from 0 within their group.  A node finds the rest of its run of ``fanout``
nodes by equijoins of the level with itself on a computed index: ``idx XOR 1``
in a binary tree, ``run * fanout + (slot + offset) % fanout`` for every offset
otherwise.  Rows of slot zero then emit the parents, and the siblings of all
rows are kept as that level's part of the proofs.  Each level is written once;
levels halve, so all of them hold twice the leaves.

Proofs go down again: a node's proof is its own siblings before those of its
parent, by one join a level on ``(grp, idx div fanout)``, so the tables joined
add up to twice the leaves as well, whatever the height.

Numbers of leaves come from a range partitioning with a count per partition,
never from one sort of a group: a window sees one row per partition and group.

Cases: a null field is hashed as ``-`` and so differs from an empty one; a null
group is a group of its own, before all others; a null key sorts first; rows
with equal keys are ordered by their digests, and repeated rows are leaves of
their own; a group of one leaf has that leaf as its root; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readpaths.llm.shared import stored

FANOUT = 2
DIGEST = 64      # hexadecimal digits
CUT_LEVELS = 6   # joins between two written tables on the way down
PROOF = "array<struct<slot:int,siblings:binary>>"


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf(fields: Sequence[Column]) -> Column:
    """Digest (hexadecimal) of the fields: each its UTF-8 byte count, ``:`` and its value, or ``-`` if null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def fold(digest: Column, proof: Column) -> Column:
    """The root (hexadecimal) that a leaf's digest and its proof lead to."""

    def step(own: Column, level: Column) -> Column:
        others = _hex(level["siblings"])
        at = level["slot"] * DIGEST
        return F.sha2(F.concat(F.substr(others, F.lit(1), at), own, F.substr(others, at + 1)), 256)

    return F.aggregate(proof, digest, step)


def proof_digest(proof: Column) -> Column:
    """Digest (hexadecimal) of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda level: _hex(level["siblings"])), ""), 256)


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (stored) with ``idx``, their number within ``grp`` by ``order``, and ``n``, the size of the group."""
    keys = ["grp", *order]
    placed = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("row_", F.monotonically_increasing_id()), "merkle-order")
    placed = placed.withColumn("part_", F.shiftright("row_", 33))
    runs = placed.groupBy("grp", "part_").agg(F.min("row_").alias("first_"), F.count(F.lit(1)).alias("size_"))
    group = W.partitionBy("grp")
    before = F.sum("size_").over(group.orderBy("part_").rowsBetween(W.unboundedPreceding, -1))
    runs = runs.select("grp", "part_", "first_", F.coalesce(before, F.lit(0)).alias("before_"), F.sum("size_").over(group).alias("n"))
    joined = placed.join(runs, ["grp", "part_"])
    return joined.withColumn("idx", F.col("row_") - F.col("first_") + F.col("before_")).drop("row_", "part_", "first_", "before_")


def with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` with ``slot`` and ``siblings``, the digests of the rest of their run in order, by equijoins of the level with itself."""
    slot = F.pmod("idx", F.lit(fanout)).cast("int")
    out = nodes.withColumn("slot", slot)
    digests = nodes.select("grp", F.col("idx").alias("at_"), F.col("digest").alias("sibling_"))
    for offset in range(1, fanout):
        other = F.pmod(F.col("slot") + offset, F.lit(fanout))
        at = F.col("idx").bitwiseXOR(F.lit(1).cast("long")) if fanout == 2 else F.col("idx") - F.col("slot") + other
        out = out.withColumn("at_", at).join(digests, ["grp", "at_"], "left").withColumnRenamed("sibling_", f"sibling_{offset}").drop("at_")
    found = F.array_sort(F.array(*(F.struct(F.pmod(F.col("slot") + o, F.lit(fanout)).alias("at"), F.col(f"sibling_{o}").alias("digest")) for o in range(1, fanout))))
    digests_in_order = F.transform(found, lambda s: F.coalesce(_hex(s["digest"]), F.lit("")))
    return out.withColumn("siblings", F.unhex(F.array_join(digests_in_order, ""))).drop(*(f"sibling_{o}" for o in range(1, fanout)))


def _parents(level: DataFrame, fanout: int) -> DataFrame:
    size = F.lit(fanout).cast("long")
    up = F.call_function("div", "idx", size)
    digest = F.unhex(F.sha2(F.concat(_hex(F.col("digest")), _hex(F.col("siblings"))), 256))
    return level.where(F.col("slot") == 0).select("grp", up.alias("idx"), F.call_function("div", F.col("n") + (fanout - 1), size).alias("n"), digest.alias("digest"))


def climb(leaves: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """All levels with their siblings, and ``grp, height, digest`` of each group's root.

    ``leaves`` (``grp, idx, n, digest`` and more) is a stored table.
    """
    levels, nodes, tops = [], leaves, None
    most = leaves.agg(F.max("n")).first()[0] or 0
    while True:
        done = nodes.where(F.col("n") == 1).select("grp", F.lit(len(levels)).alias("height"), "digest")
        tops = done if tops is None else tops.unionByName(done)
        if most <= 1:
            return levels, stored(tops, "merkle-roots")
        levels.append(stored(with_siblings(nodes.where(F.col("n") > 1), fanout), f"merkle-level{len(levels)}"))
        nodes, most = _parents(levels[-1], fanout), -(-most // fanout)


def descend(leaves: DataFrame, levels: Sequence[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """The columns of ``leaves`` with ``subroot`` and ``proof``; ``tops`` has ``grp, height, digest, proof`` (that of the group's root)."""
    begun = tops.select("grp", "height", F.col("digest").alias("subroot"), "proof")
    above = begun.where(F.col("height") == len(levels)).select("grp", F.lit(0).cast("long").alias("up_"), "subroot", "proof")
    for height in range(len(levels) - 1, -1, -1):
        own = F.array(F.struct("slot", "siblings")).cast(PROOF)
        down = levels[height].withColumn("up_", F.call_function("div", "idx", F.lit(fanout).cast("long")))
        joined = down.join(above, ["grp", "up_"]).withColumn("proof", F.concat(own, "proof")).drop("up_", "slot", "siblings")
        if not height:
            lone = leaves.where(F.col("n") == 1).join(begun.where("height = 0").drop("height"), "grp")
            return joined.unionByName(lone)
        starts = begun.where(F.col("height") == height).select("grp", F.lit(0).cast("long").alias("up_"), "subroot", "proof")
        above = joined.select("grp", F.col("idx").alias("up_"), "subroot", "proof").unionByName(starts)
        if height % CUT_LEVELS == 0:
            above = stored(above, f"merkle-proofs{height}")
    return leaves.join(begun.drop("height"), "grp")


def manifest(docs: DataFrame, fields: Sequence[str], key: str, group: str, fanout: int = FANOUT, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """``key, group, idx, leaf, subroot, root, proof`` of every row, and the columns of ``carry``.

    ``leaf``, ``subroot`` and ``root`` are binary digests; ``proof`` lists, from
    the leaf to the root, a node's slot in its run and the other nodes' digests.
    """
    carried = {f"carry_{name}": c for name, c in (carry or {}).items()}
    named = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    rows = docs.select(F.col(key).alias("key_"), named.alias("grp"), F.col(group).alias("name_"), F.unhex(leaf([F.col(f) for f in fields])).alias("digest"),
                       *(c.alias(name) for name, c in carried.items()), F.monotonically_increasing_id().alias("copy_"))
    leaves = stored(numbered(stored(rows, "merkle-leaves"), ["key_", "digest", "copy_"]).drop("copy_"), "merkle-level")
    levels, subroots = climb(leaves, fanout)

    # the tree over the groups' roots, in the order of the groups
    over = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("member_"), "height", "digest")
    over = stored(numbered(stored(over, "merkle-groups"), ["member_"]).withColumnRenamed("height", "member_height_"), "merkle-group-level")
    over_levels, top = climb(over, fanout)
    proved = descend(over, over_levels, top.withColumn("proof", F.array().cast(PROOF)), fanout)
    tops = stored(proved.select(F.col("member_").alias("grp"), F.col("member_height_").alias("height"), "digest", "proof"), "merkle-subroots")

    found = top.first()
    root = F.lit(bytes(found["digest"])) if found else F.lit(None).cast("binary")
    out = descend(leaves, levels, tops, fanout)
    return out.select(F.col("key_").alias(key), F.col("name_").alias(group), "idx", F.col("digest").alias("leaf"), "subroot", root.alias("root"), "proof",
                      *(F.col(name).alias(name.removeprefix("carry_")) for name in carried))
