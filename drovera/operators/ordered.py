"""Ordered operators that stay parallel inside one hot key.

A window partitioned by the key alone puts a whole flight into one task. Here every key is first
cut into contiguous blocks of bounded size; the window runs per (key, block), and what a block
must know about earlier blocks enters as a carry computed from one summary row per block.
Summaries are plain group-bys, so they are combined before the shuffle.

Two ways to bound a block:

* ``seq_blocks`` for integer sequences that are unique within the key (frame_id, kf_seq, seq):
  a block of ``size`` consecutive numbers can never hold more than ``size`` rows;
* ``time_blocks`` for timestamps: fixed-width bins, and bins that hold more than ``target_rows``
  are cut into equal sub-bins in proportion to their count.

Operators with bounded look-back do not need a carry: ``with_halo`` copies the last (first) few
sequence numbers of a block to its neighbour, and one shuffle is enough.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

BLK = "_blk"
SEQ_BLOCK = 65_536
TARGET_ROWS = 4_000_000


def seq_blocks(df: DataFrame, seq: str, *, size: int = SEQ_BLOCK) -> DataFrame:
    return df.withColumn(BLK, F.expr(f"(`{seq}` - pmod(`{seq}`, {size}L)) div {size}L"))


def time_blocks(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    *,
    width_us: int,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Block id = start of the block in microseconds, increasing with ``ts``.

    The broadcast table lists only bins above ``target_rows``, hence has fewer than
    rows / target_rows entries whatever the data look like.
    """
    start = F.expr(f"`{ts}` - pmod(`{ts}`, {width_us}L)")
    hot = (
        df.select(*keys, start.alias("_bin"))
        .groupBy(*keys, "_bin")
        .count()
        .filter(F.col("count") > target_rows)
        .select(
            *keys,
            "_bin",
            F.expr(
                f"greatest(1L, cast(ceil({width_us} / ceil(`count` / {target_rows})) as bigint))"
            ).alias("_step"),
        )
    )
    return (
        df.withColumn("_bin", start)
        .join(F.broadcast(hot), [*keys, "_bin"], "left")
        .withColumn(
            BLK,
            F.expr(f"`_bin` + ((`{ts}` - `_bin`) div coalesce(`_step`, {width_us}L)) "
                   f"* coalesce(`_step`, {width_us}L)"),
        )
        .drop("_bin", "_step")
    )


def block_window(keys: Sequence[str], order: Sequence[Column | str], *extra: str) -> WindowSpec:
    return Window.partitionBy(*keys, BLK, *extra).orderBy(*order)


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def carry_table(
    df: DataFrame,
    keys: Sequence[str],
    summaries: dict[str, Column],
    carries: dict[str, Callable[[WindowSpec], Column]],
    *,
    backward: bool = False,
) -> DataFrame:
    """What enters each block: ``carries`` are evaluated over the summaries of the blocks before it
    (after it if ``backward``). The window reads one row per block."""
    per_block = df.groupBy(*keys, BLK).agg(*[e.alias(n) for n, e in summaries.items()])
    order = F.col(BLK).desc() if backward else F.col(BLK).asc()
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return per_block.select(*keys, BLK, *[fn(w).alias(n) for n, fn in carries.items()])


def with_carry(df: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(carry, [*keys, BLK], "left")


def row_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str
) -> DataFrame:
    """Dense 1-based row number of a blocked frame within the whole key."""
    carry = carry_table(
        df, keys, {"_n": F.count(F.lit(1))}, {"_before": lambda w: F.sum("_n").over(w)}
    )
    local = F.row_number().over(block_window(keys, order)).cast("bigint")
    return (
        with_carry(df.withColumn(name, local), carry, keys)
        .withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
        .drop("_before")
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], exprs: dict[str, Column]
) -> DataFrame:
    """Running sums within the whole key; the expressions must not contain window functions."""
    df = df.select("*", *[e.alias(f"_v_{n}") for n, e in exprs.items()])
    carry = carry_table(
        df,
        keys,
        {f"_s_{n}": F.sum(f"_v_{n}") for n in exprs},
        {f"_c_{n}": (lambda w, n=n: F.sum(f"_s_{n}").over(w)) for n in exprs},
    )
    w = running(block_window(keys, order))
    out = df.select("*", *[F.sum(f"_v_{n}").over(w).alias(f"_l_{n}") for n in exprs])
    out = with_carry(out, carry, keys)
    total = {n: F.col(f"_l_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in exprs}
    return out.withColumns(total).drop(
        *[f"_{p}_{n}" for p in ("v", "l", "c") for n in exprs]
    )


def running_last(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    exprs: dict[str, Column],
) -> DataFrame:
    """Last non-null value so far (last observation carried forward) within the whole key.

    ``order`` must be unique within the key.
    """
    df = df.select("*", *[e.alias(f"_v_{n}") for n, e in exprs.items()])
    carry = carry_table(
        df,
        keys,
        {
            f"_s_{n}": F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order)))
            for n in exprs
        },
        {f"_c_{n}": (lambda w, n=n: F.last(f"_s_{n}", ignorenulls=True).over(w)) for n in exprs},
    )
    w = running(block_window(keys, [order]))
    out = df.select(
        "*", *[F.last(f"_v_{n}", ignorenulls=True).over(w).alias(f"_l_{n}") for n in exprs]
    )
    out = with_carry(out, carry, keys)
    value = {n: F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n in exprs}
    return out.withColumns(value).drop(*[f"_{p}_{n}" for p in ("v", "l", "c") for n in exprs])


def lag_row(
    df: DataFrame, keys: Sequence[str], order: str, exprs: dict[str, Column]
) -> DataFrame:
    """Values of the previous row of the key, across block borders. ``order`` must be unique."""
    df = df.select("*", *[e.alias(f"_v_{n}") for n, e in exprs.items()], F.lit(True).alias("_has"))
    carry = carry_table(
        df,
        keys,
        {f"_s_{n}": F.max_by(f"_v_{n}", order) for n in exprs},
        {f"_c_{n}": (lambda w, n=n: F.last(f"_s_{n}").over(w)) for n in exprs},
    )
    w = block_window(keys, [order])
    out = df.select(
        "*",
        *[F.lag(f"_v_{n}").over(w).alias(f"_l_{n}") for n in exprs],
        F.lag("_has").over(w).alias("_inner"),
    )
    out = with_carry(out, carry, keys)
    value = {
        n: F.when(F.col("_inner"), F.col(f"_l_{n}")).otherwise(F.col(f"_c_{n}")) for n in exprs
    }
    return out.withColumns(value).drop(
        "_has", "_inner", *[f"_{p}_{n}" for p in ("v", "l", "c") for n in exprs]
    )


def with_halo(
    df: DataFrame, seq: str, *, size: int = SEQ_BLOCK, back: int = 0, ahead: int = 0
) -> DataFrame:
    """Blocks of ``size`` sequence numbers plus copies of bordering rows.

    Rows within ``back`` numbers of the end of a block are copied into the next block, rows within
    ``ahead`` numbers of its start into the previous one. ``_own`` marks the originals; drop the
    copies (``own_rows``) once the look-back or look-ahead is done.
    """
    if max(back, ahead) > size:
        raise ValueError("halo wider than a block")
    blk = f"((`{seq}` - pmod(`{seq}`, {size}L)) div {size}L)"
    pos = f"pmod(`{seq}`, {size}L)"
    copies = [f"named_struct('b', {blk}, 'o', true)"]
    if back:
        copies.append(f"if({pos} >= {size - back}, named_struct('b', {blk} + 1L, 'o', false), null)")
    if ahead:
        copies.append(f"if({pos} < {ahead}, named_struct('b', {blk} - 1L, 'o', false), null)")
    if len(copies) == 1:
        return df.withColumn(BLK, F.expr(blk)).withColumn("_own", F.lit(True))
    return (
        df.withColumn("_copy", F.explode(F.expr(f"array_compact(array({', '.join(copies)}))")))
        .withColumn(BLK, F.col("_copy.b"))
        .withColumn("_own", F.col("_copy.o"))
        .drop("_copy")
    )


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_own", BLK)
