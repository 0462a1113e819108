import numpy as np
from pyspark.sql import functions as F

from gridmark.llm.common import Scratch, blocked, join_by_key, ranked


def test_ranked_over_partitions(spark):
    rng = np.random.default_rng(51)
    hot = [(7, 1, i) for i in range(400)]  # a group that fills several partitions
    rows = [*hot, *((7, 2, i) for i in range(300)), *((int(a), int(b), int(c)) for a, b, c in rng.integers(0, 9, (500, 3)))]
    rows = [(k, s, o, 1000 + i) for i, (k, s, o) in enumerate(dict.fromkeys(rows))]
    df = spark.createDataFrame(rows, "k long, s int, o int, x long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {(r.k, r.s, r.o): (r.first_o, r.first_x, r.head_o, r.head_x) for r in ranked(df, ["k"], ["s"], ["o"], ["x"], Scratch(spark)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == len(rows)
    for k, s, o, _ in rows:
        first = min((r[2], r[3]) for r in rows if r[:2] == (k, s))
        head = min((r[1], r[2], r[3]) for r in rows if r[0] == k)
        assert got[k, s, o] == (*first, *head[1:]), (k, s, o)
    assert ranked(df.limit(0), ["k"], ["s"], ["o"], ["x"], Scratch(spark)).count() == 0


def test_join_by_key_with_hot_keys(spark):
    scratch = Scratch(spark)
    rows = scratch.write(spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 4000).alias("k")))
    groups = scratch.write(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")))
    got = join_by_key(rows, groups, "k", "n", 6000)
    assert got.count() == 6000 and got.filter("k = -1").agg(F.min("n"), F.count(F.lit(1))).first()[:] == (2000, 2000)


def test_blocks_hold_every_pair_once(spark):
    scratch = Scratch(spark)
    rows = scratch.write(spark.range(90).select(F.col("id").alias("uid"), F.when(F.col("id") < 60, 1).when(F.col("id") < 80, 2).otherwise(F.col("id")).alias("k")))
    seen = {}
    for r in blocked(rows, "k", "uid", 16, scratch).collect():
        seen.setdefault((r.k, r.block_a, r.block_b), []).append((r.uid, r.block))
    pairs = [(u, v) for (_, a, b), m in seen.items() for u, x in m for v, y in m if u < v and (a == b or x != y)]
    assert len(pairs) == len(set(pairs)) == 60 * 59 // 2 + 20 * 19 // 2
