from __future__ import annotations

import random

from pyspark.sql import functions as F

from drovera.operators import ordered as O


def sample(n=400, seed=1):
    rnd = random.Random(seed)
    # key 1 holds most rows
    return [(1 if rnd.random() < 0.8 else 2, i, i * 7 + rnd.randint(0, 3),
             rnd.choice([None, None, float(i)])) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k BIGINT, seq BIGINT, ts BIGINT, v DOUBLE")


def test_running_operators_cross_block_borders(spark):
    rows = sample()
    df = O.seq_blocks(frame(spark, rows), "seq", size=7)
    df = O.row_index(df, ["k"], ["seq"], "n")
    df = O.running_sum(df, ["k"], ["seq"], {"c": F.col("v").isNull().cast("int")})
    df = O.running_last(df, ["k"], "seq", {"last": F.col("v")})
    df = O.lag_row(df, ["k"], "seq", {"prev": F.col("v"), "prev_seq": F.col("seq")})
    got = {(r.k, r.seq): (r.n, r.c, r["last"], r.prev, r.prev_seq) for r in df.collect()}
    state = {}
    for k, seq, _, v in rows:
        n, c, last, prev = state.get(k, (0, 0, None, (None, None)))
        n, c = n + 1, c + (v is None)
        last = v if v is not None else last
        assert got[k, seq] == (n, c, last, *prev)
        state[k] = (n, c, last, (v, seq))
    assert len(got) == len(rows)


def test_time_blocks_split_hot_bins(spark):
    rows = [(1, i, i // 3, None) for i in range(3000)] + [(2, i, i * 50, None) for i in range(20)]
    df = O.time_blocks(frame(spark, rows), ["k"], "ts", width_us=500, target_rows=100)
    sizes = df.groupBy("k", O.BLK).agg(
        F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")
    ).orderBy("k", O.BLK).collect()
    assert sum(r.n for r in sizes) == len(rows)
    assert max(r.n for r in sizes if r.k == 1) <= 110
    for p, q in zip(sizes, sizes[1:]):
        assert p.k != q.k or p.b < q.a  # contiguous and in order


def test_halo_copies(spark):
    rows = [(1, i, i, None) for i in range(20)]
    df = O.with_halo(frame(spark, rows), "seq", size=8, back=2, ahead=1)
    per = {b: sorted(r.seq for r in df.collect() if r[O.BLK] == b) for b in (0, 1, 2)}
    assert per[0] == [*range(8), 8]
    assert per[1] == [6, 7, *range(8, 16), 16]
    assert sorted(r.seq for r in O.own_rows(df).collect()) == list(range(20))
