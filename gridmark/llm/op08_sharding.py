"""Sharding along a Hilbert curve.

Every metadata dimension is quantised at its own percentiles over all rows, the cell of a row gets
its place on a Hilbert curve through all dimensions, rows are range-sorted by that place, and the
sorted rows are cut into runs of near equal bytes. Neighbouring rows on the curve are close in every
dimension, so a filter on any of them prunes most shards (or files within a shard).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, free_name, table

SHARDS, BITS = 40, 4


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the curve of each row of ``cells`` (n, dimensions), by Skilling's transposition."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) > 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


def _counted(df: DataFrame, order: list[str], size: str, names: tuple[str, str, str], scratch: Scratch) -> tuple[DataFrame, list]:
    """``df`` sorted by range of ``order``, with its partition, row and sum of ``size`` before it in the partition
    under ``names``, written; and (partition, rows, sum) of every partition."""
    part, row, before = names
    columns = [*df.columns, *names]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{part}` int, `{row}` bigint, `{before}` bigint"

    def count(batches):
        own, rows, total = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            s = b.column(b.schema.get_field_index(size)).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(s), own, np.int32)), pa.array(rows + np.arange(len(s))), pa.array(total + np.cumsum(s) - s)], names=columns)
            rows, total = rows + len(s), total + int(s.sum())

    out = scratch.write(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(count, kinds))
    return out, sorted(out.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).collect())


def text_cuts(df: DataFrame, name: str, levels: int, scratch: Scratch) -> list:
    """At most ``levels`` - 1 values of a text column that part its rows evenly, by whole texts: a row's level
    is how many of them it is greater than."""
    spark, n = df.sparkSession, "rows_of_value"
    values = df.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias(n))
    ordered, parts = _counted(values, ["value"], n, ("part_", "row_", "before_"), scratch)
    before = np.cumsum([0, *(r.b for r in parts)]).tolist()
    if not before[-1]:
        return []
    starts = spark.createDataFrame([(r.part_, before[i]) for i, r in enumerate(parts)], "part_ int, rows_before long")
    end = F.col("rows_before") + F.col("before_") + F.col(n)
    level = F.floor(end * levels / F.lit(before[-1]))
    ends = ordered.join(F.broadcast(starts), "part_").groupBy(level.alias("level")).agg(F.min("value").alias("value"))
    return sorted({r.value for r in ends.collect() if 0 < r.level < levels})  # a row for each level


def hilbert_shards(df: DataFrame, dims: list[str], size: Column, shards: int = SHARDS, bits: int = BITS, ties: list[str] | None = None) -> DataFrame:
    """``df`` with ``size_bytes``, ``hilbert``, ``shard`` (0 to ``shards`` - 1) and ``slot``.

    Shards are runs of the order (place on the curve, ``ties``, row) whose bytes are equal to within
    the largest row; slots count from 0 in that order. A dimension has 2 ** ``bits`` levels of about as
    many rows; texts are compared whole. Nulls in a dimension come first; a null size counts as zero.
    Repeated rows and ties are told apart by a row number, so that no value, however frequent, stays in
    one task. Columns named like one of these four are replaced, all others stay. Empty in, empty out.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    added = ("size_bytes", "hilbert", "shard", "slot")
    own = [c for c in df.columns if c.lower() not in added]
    names = {c: c for c in added}
    for c in ("uid", "part", "row", "before", "rows_before", "bytes_before", "first_row", *(f"dim_{i}" for i in range(len(dims)))):
        names[c] = free_name(df, c)
    at = [names[f"dim_{i}"] for i in range(len(dims))]
    kinds = [df.schema[d].dataType.typeName() for d in dims]
    as_dim = lambda d, k: F.col(f"`{d}`").cast("string") if k in ("string", "binary") else F.col(f"`{d}`").cast("double")
    base = scratch.write(df.select(*[F.col(f"`{c}`") for c in own], F.coalesce(size, F.lit(0)).cast("long").alias(names["size_bytes"]), *[as_dim(d, k).alias(n) for d, k, n in zip(dims, kinds, at, strict=True)], F.monotonically_increasing_id().alias(names["uid"])))
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    texts = [k in ("string", "binary") for k in kinds]
    numbers = [F.percentile_approx(n, steps, 10_000).alias(n) for n, t in zip(at, texts, strict=True) if not t]
    found = base.agg(*numbers).first() if numbers else None
    levels = []
    for n, t in zip(at, texts, strict=True):
        level = F.lit(0)
        for v in text_cuts(base, n, 1 << bits, scratch) if t else sorted(set(found[n] or [])):
            level = level + F.when(F.col(n) > v, 1).otherwise(0)
        levels.append(level)

    @F.pandas_udf("long")
    def place(*cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in cells], 1), bits))

    curve = place(*levels) if levels else F.lit(0).cast("long")
    placed = base.withColumn(names["hilbert"], curve).drop(*at)
    order = [names["hilbert"], *(ties or []), names["uid"]]
    ordered, parts = _counted(placed, order, names["size_bytes"], (names["part"], names["row"], names["before"]), scratch)
    scratch.drop(base)
    # one row for each partition of the sort, and one for each shard
    n, b = (np.concatenate([[0], np.cumsum([r[k] for r in parts])]).astype(int).tolist() for k in (1, 2))
    starts = spark.createDataFrame([(r[0], n[i], b[i]) for i, r in enumerate(parts)], f"`{names['part']}` int, `{names['rows_before']}` long, `{names['bytes_before']}` long")
    total = max(1, b[-1])
    middle = (F.col(names["bytes_before"]) + F.col(names["before"])) * 2 + F.col(names["size_bytes"])
    shard = F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / (2 * total))).cast("int")
    out = ordered.join(F.broadcast(starts), names["part"]).withColumn(names["row"], F.col(names["rows_before"]) + F.col(names["row"])).withColumn(names["shard"], shard)
    first = out.groupBy(names["shard"]).agg(F.min(names["row"]).alias(names["first_row"]))
    first = spark.createDataFrame(first.collect(), first.schema)  # at most a row for each shard
    out = out.join(F.broadcast(first), names["shard"])
    return out.select(*[F.col(f"`{c}`") for c in own], names["size_bytes"], names["hilbert"], names["shard"], (F.col(names["row"]) - F.col(names["first_row"])).alias(names["slot"]))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 40 shards of near equal bytes, along a curve through source, lang and length.

    Null texts have no bytes and the checksum of the empty text.
    """
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", "lang", "n_chars", F.crc32(text.cast("binary")).alias("text_crc32"), F.octet_length(text).alias("n_bytes"))
    out = hilbert_shards(rows, ["source", "lang", "n_chars"], F.col("n_bytes") + 16, ties=["text_crc32", "doc_id"])
    return out.select("doc_id", F.col("size_bytes").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
