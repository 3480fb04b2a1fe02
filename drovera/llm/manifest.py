"""Merkle manifest of a dataset with a proof for every row, built by pointer jumping.

Rows are leaves; the leaves of a group form a binary tree, the group's roots (subroots) form one tree above. Every
node below the root points at an ancestor and holds the sibling digests between itself and that
ancestor. In a round each node joins the node it points at, appends that node's segment and takes
over its pointer, so the distance doubles and all leaves hold their whole path after about
``log2(height)`` rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import discard, stage

#: Levels that one task computes for a run of 2**LEVELS neighbours.
LEVELS = 10
#: The tree above the groups' trees.
TOP = -1

_NODE = "tree long, level int, pos long, nodes long, kind int, digest binary"
_INNER, _CARRIED, _ROOT = 0, 1, 2


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(values: Sequence[Column]) -> Column:
    """``digest`` of the values: ``-`` for null, else their UTF-8 length, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _alike(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def place(rows: DataFrame, group: str | None, order: Sequence[str], label: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their ``place`` from 0 among their group's rows in ``order`` (nulls first), and the groups.

    Rows are sorted by range over all tasks, whatever the size of a group; places follow from counts
    for each group and task. Also returned: ``(part, group, place, size)``, where each group starts in each part. The
    rows carry ``part`` and ``group`` to look such starts up by.
    """
    named = rows.withColumn("grp", F.col(group) if group else F.lit(0)).withColumn("tie", F.monotonically_increasing_id())
    keys = ["grp", *order, "tie"]
    ranged = named.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # Tasks hold ascending ranges, so this number rises in the order of all rows.
    ranged = stage(ranged.withColumn("seq", F.monotonically_increasing_id()).drop("tie"), label)
    ranged = ranged.withColumn("part", F.shiftright("seq", 33))
    counts = ranged.groupBy("part", "grp").agg(F.min("seq").alias("low"), F.count("*").alias("n"))
    before = Window.partitionBy("grp").orderBy("part")
    starts = stage(counts.select(
        "part", "grp", "low", F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"),
        F.sum("n").over(Window.partitionBy("grp")).alias("size"), "n",
    ).select("part", "grp", (F.col("upto") - F.col("n") - F.col("low")).alias("shift"), "size"), f"{label}_starts")
    placed = ranged.alias("r").join(
        starts.alias("s"), (F.col("r.part") == F.col("s.part")) & _alike(F.col("r.grp"), F.col("s.grp"))
    ).select("r.*", (F.col("r.seq") + F.col("s.shift")).alias("place"), F.col("s.size").alias("size")).drop("seq")
    return placed, starts


def _climb(levels: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Levels above a run of neighbours: each node's sibling, then what the next round goes on with."""
    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        tree, level, count = int(group["tree"].iloc[0]), int(group["level"].iloc[0]), int(group["nodes"].iloc[0])
        at, hashes = int(group["pos"].iloc[0]), [x.hex() for x in group["digest"]]
        rows = []
        for _ in range(levels):
            if count == 1:
                break
            for i in range(len(hashes)):
                other = hashes[i ^ 1] if i ^ 1 < len(hashes) else None
                rows.append((tree, level, at + i, count, _INNER, other and bytes.fromhex(other)))
            hashes = [hashlib.sha256("".join(hashes[i : i + 2]).encode()).hexdigest() for i in range(0, len(hashes), 2)]
            level, at, count = level + 1, at >> 1, (count + 1) >> 1
        kind = _ROOT if count == 1 else _CARRIED
        rows.extend((tree, level, at + i, count, kind, bytes.fromhex(h)) for i, h in enumerate(hashes))
        return pd.DataFrame(rows, columns=["tree", "level", "pos", "nodes", "kind", "digest"])

    return work


def grow(leaves: DataFrame, largest: int, label: str, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """All nodes over ``leaves(tree, level, pos, nodes, digest)`` with their siblings, and the trees' roots."""
    found, here, height = [], leaves, 0
    while True:
        up = stage(here.groupBy("tree", F.shiftright("pos", levels).alias("run")).applyInPandas(_climb(levels), _NODE), label)
        found.append(up)
        height += levels
        if largest <= 1 << height:
            break
        here = up.where(F.col("kind") == _CARRIED).drop("kind")
    inner = [x.where(F.col("kind") == _INNER) for x in found]
    roots = found[0].where(F.col("kind") == _ROOT)
    for x in found[1:]:
        roots = roots.unionAll(x.where(F.col("kind") == _ROOT))
    return inner, roots.select("tree", "digest")


def _height(leaves: int) -> int:
    return (leaves - 1).bit_length()


def jump(nodes: DataFrame, height: int, levels: int = LEVELS) -> DataFrame:
    """Segments of all leaves up to the root: ``(tree, pos, path)``, a null where a node has no sibling.

    ``nodes``: ``(tree, level, pos, to_tree, to_level, to_pos, path)``; a pointer without ``to_tree``
    has arrived. After each round only levels that later rounds can meet are kept, leaves always.
    """
    leaf = (F.col("level") == 0) & (F.col("tree") != TOP)
    reach = 1
    for _ in range(height.bit_length()):
        # Up to 2**reach nodes of a level point at one ancestor: it is copied, they are dealt to its copies.
        copies = 1 << max(0, reach - levels)
        ancestors = nodes.where(~leaf).select(
            F.col("tree").alias("to_tree"), F.col("level").alias("to_level"), F.col("pos").alias("to_pos"),
            F.struct("to_tree", "to_level", "to_pos").alias("next"), F.col("path").alias("more"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias("copy"),
        )
        below = nodes.where("to_tree is not null").withColumn("copy", F.pmod("pos", F.lit(copies).cast("long")))
        moved = below.join(ancestors, ["to_tree", "to_level", "to_pos", "copy"]).select(
            "tree", "level", "pos", "next.*", F.concat("path", "more").alias("path")
        )
        reach *= 2
        later = (F.col("tree") == TOP) | (F.col("level") % reach == 0)
        after = stage(moved.unionByName(nodes.where("to_tree is null")).where(later), "jump")
        discard(nodes)
        nodes = after
    return nodes.where(leaf).select("tree", "pos", "path")


def manifest(
    rows: DataFrame, fields: Sequence[str], id_col: str = "doc_id", group_col: str = "lang", carry: dict[str, Column] | None = None,
    levels: int = LEVELS,
) -> DataFrame:
    """One row per row: ``id grp leaf subroot root proof`` and the ``carry`` columns.

    ``leaf`` is ``leaf_digest`` of ``fields``. In a group leaves ascend by id, nulls first, equal ids
    by digest; two neighbours (the last may be alone) hash to a node until one is left, the
    subroot. Subroots in ascending order of their group, null first, give ``root`` the same way. ``proof``
    lists ``(side, digest)`` of the siblings from the leaf to the root; both are null where a node
    was alone. ``folded(leaf, proof)`` recomputes a root. Null groups form a group; repeated rows each
    have a leaf; an empty table gives no rows; other columns are not read.
    """
    spark = rows.sparkSession
    extra = carry or {}
    hashed = stage(rows.select(
        F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("gname"),
        F.unhex(leaf_digest([F.col(c) for c in fields])).alias("digest"), *[c.alias(k) for k, c in extra.items()],
    ), "leaves")
    placed, starts = place(hashed, "gname", ["id", "digest"], "sorted")
    groups, _ = place(starts.groupBy("grp").agg(F.first("size").alias("leaves")).withColumnRenamed("grp", "name"), None, ["name"], "groups")
    groups = stage(groups.select("name", "leaves", F.col("place").alias("tree"), F.col("size").alias("trees")), "trees")
    tall = groups.agg(F.max("leaves"), F.max("trees")).first()
    if tall[0] is None:
        void = ", ".join(f"{k} {t}" for k, t in hashed.select(*extra).dtypes) if extra else ""
        kind = dict(hashed.dtypes)["id"]
        return spark.createDataFrame([], f"id {kind}, grp string, leaf string, subroot string, root string, proof array<struct<side: string, digest: string>>" + (", " + void if void else ""))
    # A group's number is looked up by group and part, so a large group is no hot key.
    local = stage(starts.select("part", "grp").join(groups, _alike(F.col("grp"), F.col("name"))).select("part", "grp", "tree"), "local")
    leaves = stage(
        placed.alias("r").join(local.alias("g"), (F.col("r.part") == F.col("g.part")) & _alike(F.col("r.grp"), F.col("g.grp")))
        .select("r.id", "r.grp", "r.part", "r.digest", *[f"r.{k}" for k in extra], "g.tree", F.col("r.place").alias("pos"), F.col("r.size").alias("leaves")),
        "placed",
    )
    level = F.lit(0).alias("level")
    inner, roots = grow(leaves.select("tree", level, "pos", F.col("leaves").alias("nodes"), "digest"), tall[0], "nodes", levels)
    roots = stage(roots, "subroots")
    top, root = grow(roots.select(F.lit(TOP).cast("long").alias("tree"), level, F.col("tree").alias("pos"), F.lit(tall[1]).alias("nodes"), "digest"), tall[1], "top", levels)
    whole = root.first()["digest"].hex()
    # Parents: in the tree, the tree's leaf of the tree above, or nothing at the root.
    ends, above = F.col("nodes") <= 2, F.col("tree") == TOP
    lone = tall[1] == 1
    to_tree = F.when(ends, F.when(above | F.lit(lone), None).otherwise(TOP)).otherwise(F.col("tree")).cast("long")
    pointers = lambda x: x.select(
        "tree", "level", "pos", to_tree.alias("to_tree"), F.when(ends, 0).otherwise(F.col("level") + 1).alias("to_level"),
        F.when(ends, F.col("tree")).otherwise(F.shiftright("pos", 1)).alias("to_pos"), F.array("digest").alias("path"),
    )
    nodes = pointers(inner[0])
    for x in inner[1:] + top:
        nodes = nodes.unionAll(pointers(x))
    single = leaves.where("leaves = 1").select(
        "tree", level, "pos", F.lit(None if lone else TOP).cast("long").alias("to_tree"), F.lit(0).alias("to_level"),
        F.col("tree").alias("to_pos"), F.array().cast("array<binary>").alias("path"),
    )
    paths = jump(stage(nodes.unionAll(single), "pointers"), _height(tall[0]) + _height(tall[1]), levels)
    subs = local.join(roots.withColumnRenamed("digest", "subroot"), "tree").select("part", "tree", "subroot")
    named = leaves.join(subs, ["part", "tree"]).join(paths, ["tree", "pos"])
    high = F.when(F.col("leaves") > 1, F.length(F.bin(F.col("leaves") - 1))).otherwise(0)

    def step(sibling: Column, i: Column) -> Column:
        bit = F.when(i < high, F.call_function("shiftright", F.col("pos"), i)).otherwise(F.call_function("shiftright", F.col("tree"), i - high))
        side = F.when(sibling.isNotNull(), F.when(bit.bitwiseAND(F.lit(1)) == 1, "left").otherwise("right"))
        return F.struct(side.alias("side"), F.lower(F.hex(sibling)).alias("digest"))

    as_hex = lambda c: F.lower(F.hex(c))
    return named.select(
        "id", "grp", as_hex(F.col("digest")).alias("leaf"), as_hex(F.col("subroot")).alias("subroot"), F.lit(whole).alias("root"),
        F.transform("path", step).alias("proof"), *extra,
    )


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of a proof give."""
    def up(h: Column, s: Column) -> Column:
        other = F.coalesce(s["digest"], F.lit(""))
        return F.when(s["side"] == "left", digest(other, h)).otherwise(digest(h, other))

    return F.aggregate(proof, leaf, up)


def proof_digest(proof: Column) -> Column:
    """``digest`` of the siblings of a proof, from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: s["digest"]), ""), 256)
