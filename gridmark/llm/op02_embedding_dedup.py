"""Near-duplicate vectors by cross-polytope hashing.

Equal vectors are one class from the start, with their number. A class's vector is turned by three
rounds of random signs and a fast Hadamard transform and hashed to the signed axis nearest to it; a
bucket is the combination of several such hashes. Each vector also goes to the buckets of its
next-nearest axes (all rank combinations of sum at most two), in several tables. Hashes to a bucket
follow from the number of vectors, so that buckets stay small; the number of tables follows from the
odds that a pair at the least cosine meets in one (measured on random pairs of that length), so that at
every size and length all tables miss it with odds of ``MISS`` at most. Bucket rows carry the vector in
8-bit components; pairs whose rounded cosine is within ``MARGIN`` become candidates, of which a task
gives a spanning forest only.

Candidate components are then compared exactly, in double precision on the original vectors, all
pairs of a component's classes in bounded blocks. That gives every link within a component, each
vector's number of links, and the components of the true links.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, blocked, by_key, components, groups_of, join_by_key, one_thread, table
from .op10_simhash import _ranges, forest
from .vectors import matrix, numbered, unit

LEAST, MARGIN = 0.9, 0.03
#: rows that are compared with each other at once
BLOCK = 2048
#: odds that no table brings a pair at the least cosine together; rows of a bucket that random vectors fill
MISS, BUCKET = 1e-4, 128


def hadamard(x: np.ndarray) -> np.ndarray:
    """The (unnormalised) transform of rows whose length is a power of two."""
    n, d, h = len(x), x.shape[1], 1
    while h < d:
        x = x.reshape(n, -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x


def nearest_axes(x: np.ndarray, seed: int, ranks: int) -> np.ndarray:
    """The ``ranks`` signed axes nearest to each turned row, nearest first."""
    d = 1 << max(0, (x.shape[1] - 1).bit_length())
    v = np.zeros((len(x), d))
    v[:, : x.shape[1]] = x
    rng = np.random.default_rng(seed)
    for _ in range(3):
        v = hadamard(v * rng.choice([-1.0, 1.0], d)) / np.sqrt(d)
    order = np.argsort(-np.abs(v), axis=1, kind="stable")[:, : min(ranks, d)]
    axes = 2 * order + (np.take_along_axis(v, order, 1) > 0)
    return np.pad(axes, ((0, 0), (0, ranks - axes.shape[1])), mode="edge")


def bucket_keys(x: np.ndarray, hashes: int, tables: int) -> np.ndarray:
    """(n, tables * probes) keys."""
    probes = [p for p in itertools.product(range(3), repeat=hashes) if sum(p) <= 2]
    out = []
    for t in range(tables):
        axes = [nearest_axes(x, 1000 * t + k, 3).astype(np.int64) for k in range(hashes)]
        for p in probes:
            key = np.full(len(x), t, np.int64)
            for a, r in zip(axes, p, strict=True):
                key = key << 14 | a[:, r]
            out.append(key)
    return np.stack(out, 1)


def meeting_odds(dim: int, hashes: int, least: float, pairs: int = 600) -> float:
    """Share of random pairs of cosine ``least`` that meet in one table, less two deviations."""
    rng = np.random.default_rng(dim * 8 + hashes)
    x = unit(rng.normal(size=(pairs, dim)))
    z = rng.normal(size=(pairs, dim))
    z -= (x * z).sum(1)[:, None] * x
    z /= np.maximum(np.sqrt((z * z).sum(1)), 1e-300)[:, None]
    y = least * x + np.sqrt(1 - least * least) * z if dim > 1 else x
    a, b = (bucket_keys(v, hashes, 1) for v in (x, y))
    p = float((a[:, :, None] == b[:, None, :]).any((1, 2)).mean())
    return max(0.02, p - 2 * np.sqrt(p * (1 - p) / pairs) - 1 / pairs)


@functools.lru_cache(maxsize=256)
def plan(n: int, dim: int, least: float) -> tuple[int, int]:
    """Hashes to a bucket and tables for ``n`` vectors of a length."""
    axes, hashes = 2 << max(0, (dim - 1).bit_length()), 2
    while hashes < 4 and n > BUCKET * axes**hashes:
        hashes += 1
    p = meeting_odds(dim, hashes, least)
    return hashes, max(2, int(np.ceil(np.log(MISS) / np.log(1 - p))))


def _pairs_of_runs(starts: np.ndarray, ends: np.ndarray, own: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = 400_000):
    """All pairs of rows of each group, between its two blocks where they differ, in bounded parts."""
    n = ends - starts
    for g in np.flatnonzero(n * n > most).tolist():
        s, e = int(starts[g]), int(ends[g])
        cross = a[s] != b[s]
        left = np.arange(s, e)[own[s:e] == a[s]] if cross else np.arange(s, e)
        right = np.arange(s, e)[own[s:e] == b[s]] if cross else left
        step = max(1, most // max(len(right), 1))
        for at in range(0, len(left), step):
            i, j = (x.ravel() for x in np.meshgrid(left[at : at + step], right, indexing="ij"))
            keep = slice(None) if cross else i < j
            yield i[keep], j[keep]
    s, n = starts[n * n <= most], n[n * n <= most]
    at = 0
    while at < len(s):
        m = max(1, int(np.searchsorted(np.cumsum(n[at:] ** 2), most, side="right")))
        gs, gn = s[at : at + m], n[at : at + m]
        at += m
        first = np.repeat(gs, gn) + _ranges(gn)
        times = np.repeat(gn, gn)
        i = np.repeat(first, times)
        j = np.repeat(np.repeat(gs, gn), times) + _ranges(times)
        keep = (i < j) & ((a[i] == b[i]) | (own[i] != own[j]))
        yield i[keep], j[keep]


def _pairs(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, own: np.ndarray, a: np.ndarray, b: np.ndarray, least: float):
    """Pairs of rows of each group of cosine >= least; x has unit rows."""
    small = ends - starts <= 48
    for s, e in zip(starts[~small].tolist(), ends[~small].tolist(), strict=True):
        cross = a[s] != b[s]
        left = np.arange(s, e)[own[s:e] == a[s]] if cross else np.arange(s, e)
        right = np.arange(s, e)[own[s:e] == b[s]] if cross else left
        for at in range(0, len(left), 512):
            rows = left[at : at + 512]
            i, j = np.nonzero(x[rows] @ x[right].T >= least)
            i, j = rows[i], right[j]
            keep = slice(None) if cross else i < j
            yield i[keep], j[keep]
    for i, j in _pairs_of_runs(starts[small], ends[small], own, a, b):
        ok = np.einsum("ij,ij->i", x[i], x[j]) >= least
        yield i[ok], j[ok]


def candidate_components(vectors: DataFrame, scratch: Scratch, least: float, hashes: int | None = None, tables: int | None = None) -> DataFrame:
    """``(node, root)`` of rows ``(uid, dim, vec)`` that may belong together."""
    sizes = {r.dim: r["count"] for r in vectors.groupBy("dim").count().collect()}  # a row for each length

    def hash_(batches):
        for batch in batches:
            for dim in np.unique(batch.column("dim").to_numpy()).tolist():
                b = batch.filter(pa.compute.equal(batch.column("dim"), dim))
                x = matrix(b.column("vec"), dim)
                top = np.abs(x).max(1, keepdims=True)
                q = np.rint(x / top * 127).astype(np.int8)
                h, t = plan(sizes[dim], dim, least)
                keys = np.sort(bucket_keys(x / top, hashes or h, tables or t), axis=1)
                first = np.concatenate([np.ones((len(x), 1), bool), keys[:, 1:] != keys[:, :-1]], axis=1)
                row, col = np.nonzero(first)
                for s in range(0, len(row), 100_000):
                    r = row[s : s + 100_000]
                    small = pa.array([v.tobytes() for v in q], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(keys[r, col[s : s + 100_000]]), b.column("dim").take(pa.array(r)), b.column("uid").take(pa.array(r)), small.take(pa.array(r))], names=["key", "dim", "uid", "q"])

    def meet(batches):
        one_thread()
        for t, starts, ends in groups_of(batches, ["key", "dim", "block_a", "block_b"]):
            uid, own, a, b, dims = (t.column(c).to_numpy() for c in ("uid", "block", "block_a", "block_b", "dim"))
            multi = ends - starts > 1
            starts, ends = starts[multi], ends[multi]
            found: list = []
            for dim in np.unique(dims[starts]).tolist() if len(starts) else []:
                of = dims[starts] == dim
                rows = np.repeat(starts[of], (ends - starts)[of]) + _ranges((ends - starts)[of])
                n = (ends - starts)[of]
                x = np.frombuffer(b"".join(t.column("q").take(pa.array(rows)).to_pylist()), np.int8).reshape(-1, dim).astype(np.float32)
                x /= np.sqrt((x * x).sum(1))[:, None]
                ends_ = np.cumsum(n)
                u = uid[rows]
                for i, j in _pairs(x, ends_ - n, ends_, own[rows], a[rows], b[rows], least - MARGIN):
                    found.append(forest(u[i], u[j]))
                    if sum(len(f[0]) for f in found) > 200_000:
                        found = [forest(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))]
            if found:
                i, j = forest(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j)], names=["a", "b"])

    rows = vectors.select("uid", "dim", "vec").mapInArrow(hash_, "key bigint, dim bigint, uid bigint, q binary")
    edges = by_key(blocked(scratch.write(rows), "key", "uid", BLOCK, scratch), ["key", "dim", "block_a", "block_b"], [], meet, "a bigint, b bigint")
    return components(vectors.sparkSession, edges, scratch)


def exact_links(members: DataFrame, scratch: Scratch, least: float) -> tuple[DataFrame, DataFrame]:
    """Of rows ``(root, uid, dim, vec, size)``: ``(uid, n_links)``, counting each row as ``size`` of them, and
    links that span the true components."""

    def compare(batches):
        one_thread()
        for t, starts, ends in groups_of(batches, ["root", "block_a", "block_b"]):
            uid, own, a, b, dims, weight = (t.column(c).to_numpy() for c in ("uid", "block", "block_a", "block_b", "dim", "size"))
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                x, size = unit(matrix(t.column("vec").slice(s, e - s), int(dims[s]))), weight[s:e]
                cross = a[s] != b[s]
                left = np.flatnonzero(own[s:e] == a[s]) if cross else np.arange(e - s)
                right = np.flatnonzero(own[s:e] == b[s]) if cross else left
                n, found = np.zeros(e - s, np.int64), []
                for at in range(0, len(left), 512):
                    rows = left[at : at + 512]
                    hit = x[rows] @ x[right].T >= least
                    if not cross:
                        hit[np.arange(len(rows)), at + np.arange(len(rows))] = False
                    n[rows] += hit @ size[right]
                    if cross:
                        n[right] += size[rows] @ hit
                    i, j = np.nonzero(hit)
                    found.append(forest(uid[s + rows[i]], uid[s + right[j]]))
                i, j = forest(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (uid[:0], uid[:0])
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([uid[s:e][some], i])), pa.array(np.concatenate([np.full(len(some), -1), j])), pa.array(np.concatenate([n[some], np.zeros(len(i), np.int64)]))], names=["a", "b", "n"])

    out = scratch.write(by_key(blocked(scratch.write(members), "root", "uid", BLOCK, scratch), ["root", "block_a", "block_b"], [], compare, "a bigint, b bigint, n bigint"))
    return out.filter("b < 0").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("n_links")), out.filter("b >= 0").select("a", "b")


def embedding_near_dedup(df: DataFrame, vec: str = "embedding", id: str = "vec_id", least: float = LEAST, tables: int | None = None, hashes: int | None = None) -> DataFrame:
    """Links of cosine >= ``least`` between all rows: (id, n_links, component_id, kept), a row for each.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
    vectors of different lengths not with each other. Ties and equal rows link like all others. A null
    id takes its component's smallest id and is not kept. Other columns are not read; empty in, empty
    out.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    # equal vectors, by two 64-bit hashes, are one class
    same = F.struct(F.xxhash64("vec").alias("a"), F.xxhash64(F.lit(1), "vec").alias("b"))
    rows = scratch.write(numbered(df, vec, id).withColumn("same", same))
    good = rows.filter("vec is not null")
    classes = scratch.write(good.groupBy("same").agg(F.min("uid").alias("uid"), F.min("id").alias("id"), F.count(F.lit(1)).alias("size"), F.first("dim").alias("dim"), F.first("vec").alias("vec")))
    total = classes.agg(F.sum("size")).first()[0] or 0
    may = scratch.write(candidate_components(classes, scratch, least, hashes, tables))
    members = classes.join(may.withColumnRenamed("node", "uid"), "uid")
    n, links = exact_links(members.select("root", "uid", "dim", "vec", "size"), scratch, least)
    roots = components(spark, links, scratch).withColumnRenamed("node", "uid")
    rooted = scratch.write(classes.select("same", "uid", "id", "size").join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid")))
    low = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    facts = rooted.join(low, "root").join(n, "uid", "left")
    facts = scratch.write(facts.select("same", "size", (F.coalesce("n_links", F.lit(0)) + F.col("size") - 1).cast("long").alias("n_links"), "component_id"))
    out = join_by_key(good.select("id", "same"), facts, "same", "size", total).select("id", "n_links", "component_id")
    out = out.unionByName(rows.filter("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings``: vec_id, n_links, component_id, kept."""
    return embedding_near_dedup(table(spark, sf_dir, "embeddings"))
