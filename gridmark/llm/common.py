"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import glob
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: the white space that ends a word: 0x20 and 0x09-0x0D, which is what bytes.split() uses
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: Spark's setting that removes a query's shuffle files as soon as it has ended, not when its objects are collected
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@functools.cache
def one_thread() -> None:
    """Keeps numpy's matrix products in this worker to one thread: a task has one core, and small products
    on several threads take many times as long. Without a known library nothing changes."""
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), "..", "numpy.libs", "*openblas*")):
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            f = getattr(ctypes.CDLL(path), name, None)
            if f is not None:
                f(1)
                break


#: what empties the caches that a worker holds between tasks
CACHES: list[Callable[[], None]] = []


def give_up() -> None:
    """Empties this worker's caches."""
    for clear in CACHES:
        clear()


def trim() -> None:
    """Returns to the system what this worker's memory pools hold without need."""
    pa.default_memory_pool().release_unused()
    if trim_ := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim_(0)


def lean(fn: Callable, keep: bool = False) -> Callable:
    """``fn`` over batches in a worker that first gives up what other operators' tasks left in it (not with
    ``keep``) and in the end what its pools hold: workers outlive their tasks, and idle ones count too."""

    def run(batches):
        if not keep:
            give_up()
        yield from fn(batches)
        trim()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by whatever file system the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where the setting is absent (tests, a single machine) one is made and set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = known.get() if known.isDefined() else f"file://{tempfile.mkdtemp(prefix='gridmark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class Scratch:
    """Intermediate tables in the shared folder.

    A written table cuts lineage: a lost executor costs a reread, not a recomputation, and what was
    computed from ``monotonically_increasing_id`` stays fixed. Tables that a lazy result still reads
    go when the JVM ends; others go with ``drop`` as soon as they have been used.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark)}/gridmark-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.base)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.deleteOnExit(path)
        self.at: dict[int, str] = {}

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{uuid.uuid4().hex}"
        before = self.spark.conf.get(_RELEASE, None)
        self.spark.conf.set(_RELEASE, "true")  # the shuffles of a table that is written are not needed any more
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(_RELEASE) if before is None else self.spark.conf.set(_RELEASE, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.at[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := self.at.pop(id(df), None):
                self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, lengthened until no column of ``df`` has that name (case does not count)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The same rows, at most ``rows`` at once: what a task makes of a batch is some times its size."""
    return (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))


def groups_of(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Runs of equal keys over the batches of a partition that is sorted by them.

    Yields ``(table, starts, ends)``: whole groups only, as many as came together; a group that
    goes on over the end of a batch waits for its rest. Keys are long columns without nulls.
    """
    held: list[pa.RecordBatch] = []

    def key_at(b: pa.RecordBatch, i: int) -> tuple:
        return tuple(b.column(k)[i].as_py() for k in keys)

    for b in batches:
        if not b.num_rows:
            continue
        if held and key_at(held[0], 0) != key_at(b, 0):
            t = pa.Table.from_batches(held)
            yield t, np.array([0]), np.array([t.num_rows])
            held = []
        change = np.zeros(b.num_rows - 1, dtype=bool)
        for k in keys:
            v = b.column(k).to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        at = np.flatnonzero(change) + 1
        if not len(at):
            held.append(b)
            continue
        t = pa.Table.from_batches([*held, b.slice(0, int(at[-1]))])
        ends = at + sum(x.num_rows for x in held)
        yield t, np.concatenate([[0], ends[:-1]]), ends
        held = [b.slice(int(at[-1]))]
    if held:
        t = pa.Table.from_batches(held)
        yield t, np.array([0]), np.array([t.num_rows])


def by_key(df: DataFrame, keys: list[str], then: list[str], fn: Callable, schema: str, keep: bool = False) -> DataFrame:
    """``fn`` over the batches of partitions that are dealt and sorted by long ``keys``.

    Unlike a grouped map it has no cost for each group, so that millions of small groups are fine.
    ``keep``: the workers' caches stay.
    """
    return df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *then).mapInArrow(lean(fn, keep), schema)


#: keys that may be broadcast as hot: those with more than one in HOT_KEYS of all rows
HOT_KEYS = 1000


def join_by_key(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, one row for each ``key``, of ``size`` rows out of ``total``.

    Keys with more than one in ``HOT_KEYS`` of the rows, so at most ``HOT_KEYS``, are broadcast: their
    rows stay where they are. The others meet in a shuffle. Both sides are read twice.
    """
    hot = F.col(size) > total / HOT_KEYS
    often = F.broadcast(groups.filter(hot))
    rest = rows.join(often.select(key), key, "left_anti").join(groups.filter(~hot), key)
    return rows.join(often, key).unionByName(rest)


def blocked(df: DataFrame, key: str, uid: str, cap: int, scratch: Scratch) -> DataFrame:
    """Splits large groups into pairs of blocks, so that all pairs of a group can be compared.

    ``df``: a written table, read several times. Keys of a single row have no pairs and go. A key with
    more than ``cap`` rows becomes blocks of about ``cap`` rows; each row goes to every pair of blocks
    that holds its own. Adds ``block_a`` <= ``block_b`` and ``block`` (the row's own). Two rows of a key
    meet in exactly one (key, block_a, block_b). Hot keys are split where they are, before any shuffle.
    """
    n, t = "n_rows_of_key", "block_other"
    sizes = scratch.write(df.groupBy(key).agg(F.count(F.lit(1)).alias(n)).filter(F.col(n) > 1))
    total = sizes.agg(F.sum(n)).first()[0] or 0
    out = join_by_key(df, sizes, key, n, total)
    blocks = F.ceil(F.col(n) / cap).cast("long")
    out = out.withColumn("block", F.pmod(F.xxhash64(F.col(uid), F.lit(7)), blocks))
    out = out.withColumn(t, F.explode(F.sequence(F.lit(0).cast("long"), blocks - F.lit(1).cast("long"))))
    return out.withColumns({"block_a": F.least("block", t), "block_b": F.greatest("block", t)}).drop(n, t)


def ranked(df: DataFrame, key: list[str], sub: list[str], order: list[str], more: list[str], scratch: Scratch) -> DataFrame:
    """Rows with ``first_*`` of the first row that is equal in ``key`` and ``sub``, and ``head_*`` of the first
    that is equal in ``key``, for all columns of ``order`` and ``more``. All of these are integers without nulls.

    All rows are sorted by range of (key, sub, order), so that a group of any size lies in as many
    partitions as it fills, and every row is compared with the one before it. What is open at the start
    of a partition is settled from two rows that each partition says about its ends.
    """
    spark = df.sparkSession
    keys, values, names = [*key, *sub], [*order, *more], df.columns
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    added = [*(f"first_{c}" for c in values), *(f"head_{c}" for c in values)]
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in names] + [f"`{a}` bigint" for a in added] + ["part int", "role int", "open_class boolean", "open_key boolean"])

    def run(batches):
        part = TaskContext.get().partitionId()
        carry: dict = {}  # the row before: keys, first and head values, open flags

        def told(b: pa.RecordBatch, at: int, role: int, first: list, head: list, open_: tuple[bool, bool]) -> pa.RecordBatch:
            arrays = [*b.slice(at, 1).columns, *(pa.array([int(x)], pa.int64()) for x in (*first, *head)), pa.array([part], pa.int32()), pa.array([role], pa.int32()), pa.array([open_[0]]), pa.array([open_[1]])]
            return pa.RecordBatch.from_arrays(arrays, names=[*names, *added, "part", "role", "open_class", "open_key"])

        last = None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            col = {c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in dict.fromkeys([*keys, *values])}
            new_key, new_class = np.zeros(n, bool), np.zeros(n, bool)
            for c in keys:
                differs = np.concatenate([[bool(carry) and carry["key"][c] != col[c][0]], col[c][1:] != col[c][:-1]])
                new_class |= differs
                if c in key:
                    new_key |= differs
            out, opens = [], []
            if not carry:
                own = [col[c][0] for c in values]
                carry = {"first": own, "head": own, "open": (True, True)}
                yield told(b, 0, 1, own, own, (True, True))
            for change, name, flag in ((new_class, "first", 0), (new_key, "head", 1)):
                at = np.maximum.accumulate(np.where(change, np.arange(n), -1))
                before = at < 0
                out += [np.where(before, x, col[c][np.maximum(at, 0)]) for c, x in zip(values, carry[name], strict=True)]
                opens.append(before & carry["open"][flag])
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, out), pa.array(np.full(n, part, np.int32)), pa.array(np.zeros(n, np.int32)), *map(pa.array, opens)], names=[*names, *added, "part", "role", "open_class", "open_key"])
            m = len(values)
            carry = {"key": {c: col[c][-1] for c in keys}, "first": [x[-1] for x in out[:m]], "head": [x[-1] for x in out[m:]], "open": (bool(opens[0][-1]), bool(opens[1][-1]))}
            last = b
        if last is not None:
            yield told(last, last.num_rows - 1, 2, carry["first"], carry["head"], carry["open"])

    cols = [*keys, *order]
    found = scratch.write(df.repartitionByRange(*cols).sortWithinPartitions(*cols).mapInArrow(lean(run), schema))
    ends = found.filter("role > 0").select("part", "role", *keys, *added, "open_class", "open_key").collect()  # two rows for each partition
    fix, state = [], None
    for r in sorted(ends, key=lambda r: (r.part, r.role)):
        if r.role == 1:
            same_key = state is not None and all(state["key"][c] == r[c] for c in key)
            same_class = same_key and all(state["key"][c] == r[c] for c in sub)
            begun = (same_class, same_key, state)
            fix.append((r.part, same_class, same_key, *(state["first"] + state["head"] if state else [0] * len(added))))
        else:
            m = len(values)
            first, head = [r[a] for a in added[:m]], [r[a] for a in added[m:]]
            if r.open_class and begun[0]:
                first = begun[2]["first"]
            if r.open_key and begun[1]:
                head = begun[2]["head"]
            state = {"key": {c: r[c] for c in keys}, "first": first, "head": head}
    fixed = spark.createDataFrame(fix, "part int, same_class boolean, same_key boolean, " + ", ".join(f"`fix_{a}` bigint" for a in added))
    out = found.filter("role = 0").join(F.broadcast(fixed), "part")
    of = lambda a: F.when(F.col("open_class" if a.startswith("first_") else "open_key") & F.col("same_class" if a.startswith("first_") else "same_key"), F.col(f"fix_{a}")).otherwise(F.col(a)).alias(a)
    return out.select(*[F.col(f"`{c}`") for c in names], *[of(a) for a in added])


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` of longs: ``(node, root)``, root the smallest node.

    Alternating large-star and small-star steps: every round is one shuffle a step on the edges, no
    node's neighbours are gathered (only their smallest), and each round's edges are written to the
    shared folder. Ends when the number of edges and the sum of their ends stop changing.
    """
    def shape(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(r)

    def star(e: DataFrame, small: bool) -> DataFrame:
        # every node with its neighbours; small: only the smaller ones, and itself
        if small:
            sides = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        else:
            sides = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = sides.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select(F.col("u").alias("lu"), F.least("u", "m").alias("m"))
        out = sides.join(low, F.col("u") == F.col("lu"))
        if small:
            out = out.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select("lu", "m").toDF("a", "b"))
        else:
            out = out.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        return out.filter(F.col("a") != F.col("b")).distinct()

    now = scratch.write(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct())
    seen = shape(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        new = scratch.write(star(star(now, False), True))
        scratch.drop(now)
        now, before = new, seen
        seen = shape(now)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    low = now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    return low.union(low.select(F.col("root").alias("node"), "root").distinct())
