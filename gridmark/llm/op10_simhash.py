"""SimHash fingerprints linked by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments A (23 bits), B (23) and C (18, filled with zeros). The
Golay code maps a segment to the index of its nearest codeword; a segment and all its neighbours at
one bit give one or six indices, among them that of every segment one bit away. At most three bits
over three segments leave these cases: A and B have at most one error each, or one of them has two
or three and the other two segments have at most one together, so that one is equal and the other
has at most one. Each case has a family of keys:

    (A index, B index), (B equal, C index), (C equal, B index), (A equal, C index), (C equal, A index)

Every distinct fingerprint is filed under its own indices and looked up under all neighbouring
ones, so all pairs within three bits meet; each meeting is verified by counting bits. A task that
finds links gives a spanning forest of them, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, by_key, components, groups_of, join_by_key, lean, table
from .golay import BITS, ball, index_table

SHINGLE, RADIUS, SEED = 3, 3, 42
_BIT = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def shingle_hashes(words: list[bytes], k: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every ``k`` neighbouring words, space-joined; of all words where there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    k = min(k, len(words))
    xx = xxhash.xxh64_intdigest
    ends = (ends[k - 1 :] - 1).tolist()
    return np.array([xx(joined[a:b], seed) for a, b in zip(starts.tolist(), ends, strict=False)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; zero without hashes."""
    n = len(hashes)
    if not n:
        return 0
    b = hashes.astype("<u8").view(np.uint8).reshape(n, 8)
    seen = np.bincount((b + (np.arange(8, dtype=np.int64) << 8)).ravel(), minlength=2048).reshape(8, 256)
    set_bits = (seen @ _BIT).ravel() * 2 > n
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str, keep: list[str], k: int = SHINGLE, out: str = "fp") -> DataFrame:
    """``keep`` columns and the fingerprint of each whole text as a (signed) long."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep)

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(shingle_hashes((t or b"").lower().split(), k)) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(fp)], names=[*keep, out])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(lean(run), f"{kinds}, `{out}` bigint")


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, key, role)``: role 0 files a fingerprint, role 1 looks it up."""
    u = fps.view(np.uint64)
    low = np.uint64((1 << BITS) - 1)
    a, b, c = (u & low).astype(np.int64), (u >> np.uint64(BITS) & low).astype(np.int64), (u >> np.uint64(2 * BITS)).astype(np.int64)
    index = index_table()
    own = {s: index[v].astype(np.int64) for s, v in (("a", a), ("b", b), ("c", c))}
    near = {s: ball(v, n).astype(np.int64) for s, v, n in (("a", a, BITS), ("b", b, BITS), ("c", c, 64 - 2 * BITS))}
    rows, keys, roles = [], [], []

    def add(family: int, filed: np.ndarray, looked: np.ndarray) -> None:
        n, m = looked.shape
        at = np.repeat(np.arange(n), m)
        pairs = np.unique(at << 40 | looked.ravel())  # a neighbour's index comes many times
        rows.extend([np.arange(n), pairs >> 40])
        keys.extend([filed | family << 40, pairs & ((1 << 40) - 1) | family << 40])
        roles.extend([np.zeros(n, np.int8), np.ones(len(pairs), np.int8)])

    def distinct(x: np.ndarray) -> np.ndarray:
        # at most six different indices; the rest repeats the last one
        s = np.sort(x, axis=1)
        first = np.concatenate([np.ones((len(s), 1), bool), s[:, 1:] != s[:, :-1]], axis=1)
        order = np.argsort(~first, axis=1, kind="stable")[:, : max(1, int(first.sum(1).max(initial=1)))]
        got, ok = np.take_along_axis(s, order, 1), np.take_along_axis(first, order, 1)
        return np.where(ok, got, got[:, :1])

    near = {s: distinct(v) for s, v in near.items()}
    add(0, own["a"] << 12 | own["b"], (near["a"][:, :, None] << 12 | near["b"][:, None, :]).reshape(len(u), -1))
    for family, (equal, fuzzy) in enumerate((((b, "c")), ((c, "b")), ((a, "c")), ((c, "a"))), 1):
        add(family, equal << 12 | own[fuzzy], equal[:, None] << 12 | near[fuzzy])
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(roles)


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the links x-y, without the roots themselves."""
    nodes, inv = np.unique(np.concatenate([x, y]), return_inverse=True)
    i, j = inv[: len(x)], inv[len(x) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if (root == before).all():
            break
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def _meet(fp: np.ndarray, role: np.ndarray, starts: np.ndarray, ends: np.ndarray, radius: int, most: int = 2_000_000):
    """Verified links of groups whose rows are sorted by role; in bounded blocks."""
    u = fp.view(np.uint64)
    filed = np.add.reduceat(role == 0, starts) if len(starts) else np.zeros(0, int)
    filed = filed.astype(np.int64)
    looked = (ends - starts) - filed
    work = filed * looked
    both = np.flatnonzero((work > 0) & ~((filed == 1) & (looked == 1) & (u[starts] == u[ends - 1])))
    at = 0
    while at < len(both):
        total = np.cumsum(work[both[at:]])
        n = max(1, int(np.searchsorted(total, most, side="right")))
        some = both[at : at + n]
        at += n
        if n == 1 and work[some[0]] > most:
            g = some[0]
            files, looks = u[starts[g] : starts[g] + filed[g]], u[starts[g] + filed[g] : ends[g]]
            step = max(1, most // len(files))
            for a in range(0, len(looks), step):
                i, j = np.nonzero(np.bitwise_count(looks[a : a + step, None] ^ files[None, :]) <= radius)
                yield looks[a + i], files[j]
            continue
        q = filed[some]
        probe = np.repeat(starts[some] + q, looked[some]) + _ranges(looked[some])
        times = np.repeat(q, looked[some])
        left = np.repeat(probe, times)
        right = np.repeat(np.repeat(starts[some], looked[some]), times) + _ranges(times)
        ok = np.bitwise_count(u[left] ^ u[right]) <= radius
        yield u[left[ok]], u[right[ok]]


def _ranges(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, ..."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n, n)


def fuzzy_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct longs ``fp`` within ``radius`` (at most 3) bits."""
    if not 0 <= radius <= RADIUS:
        raise ValueError("the key families cover at most three bits")

    def file(batches):
        for b in batches:
            fp = b.column(0).to_numpy()
            for at in range(0, len(fp), 20_000):
                part = fp[at : at + 20_000]
                row, key, role = keys_of(part)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(role), pa.array(part[row])], names=["key", "role", "fp"])

    def meet(batches):
        for t, starts, ends in groups_of(batches, ["key"]):
            fp, role = t.column("fp").to_numpy(), t.column("role").to_numpy()
            found: list = []
            for x, y in _meet(fp, role, starts, ends, radius):
                ok = x != y
                found.append(forest(x[ok], y[ok]))
                if sum(len(f[0]) for f in found) > 1_000_000:
                    found = [forest(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))]
            if found:
                x, y = forest(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    filed = fps.select("fp").mapInArrow(lean(file), "key bigint, role tinyint, fp bigint")
    return by_key(filed, ["key"], ["role"], meet, "a bigint, b bigint")


def simhash_groups(rows: DataFrame, scratch: Scratch, order: str, link: Callable[[DataFrame], DataFrame] = fuzzy_links) -> DataFrame:
    """``(fp, n, first)``: each distinct fingerprint of ``rows(order, fp)``, its rows, and the smallest ``order``
    of all rows whose fingerprints can be reached from it by links."""
    spark = rows.sparkSession
    fps = scratch.write(rows.groupBy("fp").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")))
    links = components(spark, link(fps), scratch)
    rooted = scratch.write(fps.join(links.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    low = rooted.groupBy("root").agg(F.min("first").alias("low"))
    return rooted.join(low, "root").select("fp", "n", F.col("low").alias("first"))


def simhash_near_dedup(df: DataFrame, text: str = "text", id: str = "doc_id", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Fingerprint and group of every whole text: (id, ``fingerprint``, ``component_id``).

    ``component_id`` is the smallest id reachable by links. Null and empty texts have fingerprint
    zero and link like any other; a null id takes its group's smallest id (null if all are null).
    Repeated rows stay, each with the same result; other columns are not read. An empty table gives
    no rows.
    """
    scratch = Scratch(df.sparkSession)
    rows = scratch.write(fingerprints(df.select(F.col(id).alias("id"), F.col(text).alias("text")), "text", ["id"], shingle))
    groups = scratch.write(simhash_groups(rows, scratch, "id"))
    total = groups.agg(F.sum("n")).first()[0] or 0
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return join_by_key(rows, groups, "fp", "n", total).select(F.col("id").alias(id), hexed.alias("fingerprint"), F.col("first").alias("component_id"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: doc_id, fingerprint, component_id."""
    return simhash_near_dedup(table(spark, sf_dir, "documents"))
