import numpy as np
import pyarrow.parquet as pq

from gridmark.llm import op02_embedding_dedup as op


def brute(rows, least=0.9):
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for dim in {len(rows[i][1]) for i in good}:
        own = [i for i in good if len(rows[i][1]) == dim]
        x = np.array([rows[i][1] for i in own], float)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        for i, j in zip(*np.nonzero(np.triu(x @ x.T >= least, 1)), strict=True):
            n[own[i]] += 1
            n[own[j]] += 1
            a, b = find(own[i]), find(own[j])
            root[max(a, b)] = min(a, b)
    low = {}
    for i, (id_, _) in enumerate(rows):
        if id_ is not None:
            low[find(i)] = min(low.get(find(i), id_), id_)
    return sorted(((id_ is None, id_ or 0), n[i], low.get(find(i)), id_ is not None and low.get(find(i)) == id_) for i, (id_, _) in enumerate(rows))


def got(df, **kw):
    return sorted(((r.vec_id is None, r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in op.embedding_near_dedup(df, **kw).collect())


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(op.hadamard(x), axis=1), 4 * np.linalg.norm(x, axis=1))


def sample(rng, n, dim=64):
    rows = []
    while len(rows) < n:
        c = rng.normal(size=dim)
        for _ in range(int(rng.integers(1, 6))):
            v = c + rng.normal(size=dim) * rng.choice([0.05, 0.3, 0.45])
            rows.append((len(rows), (v * rng.choice([0.01, 1, 50])).astype(np.float32).astype(float).tolist()))
    return rows


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 64)
    rng = np.random.default_rng(15)
    rows = sample(rng, 500)
    hot = rng.normal(size=64)
    rows += [(1000 + i, (hot + 0.15 * rng.normal(size=64)).tolist()) for i in range(200)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 64), (2003, [float("nan")] + [1.0] * 63), (2004, [None] + [1.0] * 63), (2005, [float("inf")] * 64)]
    rows += [(2006, [1.0, 2.0, 3.0]), (2007, [1.0, 2.0, 3.1]), (2008, [1.0] * 64), (2008, [1.0] * 64), (None, [1.0] * 64), (2010, [5.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, n_links int").repartition(3)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got(df) == brute(rows)
    assert got(df, hashes=3, tables=8) == brute(rows)
    assert got(df.limit(0)) == []


def test_test_data(spark):
    path = "/root/testdata/sf0.01/embeddings.parquet"
    t = pq.read_table(path).to_pydict()
    rows = [(i, None if v is None else [float(x) if x is not None else None for x in v]) for i, v in zip(t["vec_id"], t["embedding"], strict=True)]
    assert got(spark.read.parquet(path)) == brute(rows)


def test_plans_miss_few_pairs_at_any_size():
    """At every size and length all tables miss a pair at 0.9 with odds near ``MISS``, on pairs not used in planning."""
    for dim in (8, 64, 384):
        rng = np.random.default_rng(77 + dim)
        a, z = rng.normal(size=(400, dim)), rng.normal(size=(400, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        z -= (z * a).sum(1, keepdims=True) * a
        b = 0.9 * a + np.sqrt(1 - 0.81) * z / np.linalg.norm(z, axis=1, keepdims=True)
        met = {}
        for n in (10, 10**6, 10**8, 10**11):
            hashes, tables = op.plan(n, dim, 0.9)
            axes = 2 << (dim - 1).bit_length()
            assert hashes == 4 or n <= op.BUCKET * axes**hashes
            if hashes not in met:
                k = [op.bucket_keys(x, hashes, 2).reshape(len(a), 2, -1) for x in (a, b)]
                met[hashes] = (k[0][:, :, :, None] == k[1][:, :, None, :]).any((2, 3)).mean()
            assert (1 - met[hashes]) ** tables < 5 * op.MISS, (dim, n)


def test_equal_vectors_are_one_class(spark):
    rng = np.random.default_rng(78)
    base = rng.normal(size=(4, 16))
    rows = [(i, base[0].tolist()) for i in range(2000)] + [(3000 + i, (base[0] + 0.01 * rng.normal(size=16)).tolist()) for i in range(3)]
    rows += [(4000, (2 * base[0]).tolist()), (5000, base[1].tolist()), (None, base[1].tolist()), (None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: r for r in op.embedding_near_dedup(df).collect() if r.vec_id is not None}
    assert all(got[i].n_links == 2003 and got[i].component_id == 0 for i in [*range(2000), 3000, 3001, 3002, 4000])
    assert got[5000].n_links == 1 and got[5000].kept and sum(r.kept for r in got.values()) == 2
