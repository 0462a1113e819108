"""Best-fit packing with certified bin counts.

Documents become token pieces of at most ``capacity``; pieces are dealt evenly over partitions of a
bounded number of pieces and every partition packs its own by best-fit decreasing. A lower bound
from dual-feasible functions certifies the partition's bin count. Partitions with a gap give up their
emptiest bins, up to a bounded number of pieces, certified ones only their emptiest bin; the pieces
given up are dealt anew over an eighth as many partitions and packed again, until there is one
partition: as many rounds as the number of partitions has digits to the base of eight. A packing that
is not better than the one its pieces came with is not used, so no round adds a sequence. Only lengths
move in these rounds, never texts or ids.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_path, encoder
from .common import Scratch, by_key, free_name, groups_of, lean, table

#: pieces that a partition packs at once, about
DEAL = 60_000
SHRINK = 8
#: pieces in the young half of a worker's cache
PIECES = 550_000


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs at least: the best of several dual-feasible functions."""
    if not len(sizes):
        return 0
    n = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    s = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((n * s).sum()) // capacity)
    for k in range(1, 25):  # stepwise rounding: (k+1)x to its floor over k, where it is not whole
        up = (k + 1) * s
        value = np.where(up % capacity == 0, s * k, up // capacity * capacity)
        best = max(best, -(-int((n * value).sum()) // (k * capacity)))
    count, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * s)])
    half = capacity // 2
    for a in range(0, half + 1):  # items over capacity - a count as bins, those below a as nothing
        large = count[capacity + 1] - count[capacity - a + 1]
        mid, mid_sum = count[capacity - a + 1] - count[half + 1], total[capacity - a + 1] - total[half + 1]
        small = total[half + 1] - total[a]
        best = max(best, int(large + mid + max(0, -(-(small - (mid * capacity - mid_sum)) // capacity))))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; ties of size in input order."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, made = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            b, room, made = made, capacity, made + 1
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        if left:
            free[left].append(b)
            mask |= 1 << left
    return bins, offsets


def pack_group(sizes: np.ndarray, capacity: int, seq: np.ndarray, off: np.ndarray, base: int, last: bool, most: int | None = None):
    """One partition's round: sequence and offset of each piece, which it gives up (``most``, if there is a
    gap), and whether its number of sequences is certified."""
    bins, offsets = best_fit_decreasing(sizes, capacity)
    n_bins = int(bins.max()) + 1 if len(bins) else 0
    before = np.unique(seq[seq >= 0])
    if len(before) and (seq >= 0).all() and n_bins >= len(before):
        bins, offsets = np.searchsorted(before, seq), off
        n_bins, ids = len(before), before
    else:
        ids = base + np.arange(n_bins, dtype=np.int64)
    fill = np.bincount(bins, weights=sizes, minlength=n_bins).astype(np.int64)
    certified = n_bins == lower_bound(sizes, capacity)
    loose = np.zeros(n_bins, bool)
    if not last and n_bins:
        order = np.argsort(fill, kind="stable")
        n = 1
        if not certified:
            held = np.cumsum(np.bincount(bins, minlength=n_bins)[order])
            n = n_bins if most is None else max(1, int(np.searchsorted(held, most, side="right")))
        loose[order[:n]] = fill[order[:n]] < capacity
    return ids[bins], offsets, loose[bins], certified


def _pieces(docs: DataFrame, text: str, path: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    kept = [c for c in docs.columns if c != text]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept]
    end = np.array([end_id], "<u4").tobytes()
    width = 4 * capacity
    new = ["piece", "start", "length", "ids_crc32", "pid"] + ["ids"] * with_ids

    def run(batches):
        enc, n = encoder(path, PIECES), 0
        base = TaskContext.get().partitionId() << 36
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
            rows: dict[str, list] = {c: [] for c in ("at", *new)}
            for i, ids in enumerate(enc.encode([t or b"" for t in texts])):
                ids += end
                for p, start in enumerate(range(0, len(ids), width)):
                    part = ids[start : start + width]
                    rows["at"].append(i)
                    rows["piece"].append(p)
                    rows["start"].append(start // 4)
                    rows["length"].append(len(part) // 4)
                    rows["ids_crc32"].append(zlib.crc32(part))
                    rows["pid"].append(base + n)
                    if with_ids:
                        rows["ids"].append(part)
                    n += 1
            at = pa.array(rows["at"], pa.int64())
            own = [b.column(b.schema.get_field_index(c)).take(at) for c in kept]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(rows[c], t) for c, t in zip(new, types, strict=False))], names=[*kept, *new])

    schema = [*kinds, "piece int", "start bigint", "length bigint", "ids_crc32 bigint", "pid bigint"] + ["ids binary"] * with_ids
    return docs.mapInArrow(lean(run, keep=True), ", ".join(schema))


def best_fit_pack(docs: DataFrame, text: str = "text", path: str | None = None, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, deal: int = DEAL) -> DataFrame:
    """Packs whole documents into sequences of at most ``capacity`` tokens, as few as it can.

    A document is its ids and ``end_id``; only longer ones are cut, at multiples of ``capacity``.
    Returns for each piece the columns of ``docs`` but the text (those named like a new column get an
    underscore), ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``, ``certified``
    (the partition that packed the sequence met its lower bound) and, with ``with_ids``, ``ids``. Null and empty texts are the end id alone. Repeated rows are packed each on
    their own. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    for c in ("piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified", "ids", "pid", "deal", "seq", "off", "loose"):
        for own in [x for x in docs.columns if x.lower() == c and x != text]:
            docs = docs.withColumnRenamed(own, free_name(docs, own + "_"))
    pieces = scratch.write(_pieces(docs, text, path or default_path(), capacity, end_id, with_ids))
    full = F.col("length") == capacity
    lengths = pieces.select("pid", "length")
    done = lengths.filter(full).select("pid", (F.col("pid") + F.lit(1 << 62)).alias("seq"), F.lit(0).cast("long").alias("off"), F.lit(True).alias("certified"))
    pool = lengths.filter(~full).select("pid", "length", F.lit(-1).cast("long").alias("seq"), F.lit(0).cast("long").alias("off"))
    parts, step = max(1, -(-pool.count() // deal)), 0
    while True:
        last, base = parts == 1, step << 54
        dealt = pool.withColumn("deal", F.pmod(F.xxhash64("seq", F.when(F.col("seq") < 0, F.col("pid")), F.lit(step)), F.lit(parts)))

        def run(batches, last=last, base=base):
            for t, starts, ends in groups_of(batches, ["deal"]):
                pid, size, seq, off, own = (t.column(c).to_numpy() for c in ("pid", "length", "seq", "off", "deal"))
                for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                    g = slice(a, b)
                    new_seq, new_off, loose, certified = pack_group(size[g], capacity, seq[g], off[g], base + (int(own[a]) << 30), last, max(1, deal // SHRINK))
                    out = (pid[g], size[g], new_seq, new_off, loose, np.full(b - a, certified))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["pid", "length", "seq", "off", "loose", "certified"])

        out = scratch.write(by_key(dealt, ["deal"], ["pid"], run, "pid bigint, length bigint, seq bigint, off bigint, loose boolean, certified boolean"))
        done = done.union(out.filter(~F.col("loose")).select("pid", "seq", "off", "certified"))
        if last:
            break
        pool = out.filter("loose").drop("loose", "certified")
        parts, step = -(-parts // SHRINK), step + 1
    placed = pieces.join(done.withColumnRenamed("pid", "placed_pid"), F.col("pid") == F.col("placed_pid"))
    ids = [F.expr("transform(sequence(0, length - 1), i -> cast(conv(hex(reverse(substring(ids, cast(4 * i + 1 as int), 4))), 16, 10) as int)) as ids")] if with_ids else []
    own = [F.col(f"`{c}`") for c in docs.columns if c != text]
    return placed.select(*own, "piece", "start", "length", "ids_crc32", F.col("seq").alias("sequence_id"), F.col("off").alias("offset"), "certified", *ids)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 2048 tokens."""
    return best_fit_pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
