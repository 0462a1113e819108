import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridmark.llm.common import Scratch, components
from gridmark.llm.golay import index_table
from gridmark.llm.op10_simhash import fingerprint, fuzzy_links, shingle_hashes, simhash_near_dedup


def brute_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=3):
    root = {i: i for i in range(len(ids))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i in range(len(ids)):
        r = find(i)
        if ids[i] is not None:
            low[r] = min(low.get(r, ids[i]), ids[i])
    return [low.get(find(i)) for i in range(len(ids))]


def test_golay_is_perfect():
    n = np.bincount(index_table())
    assert len(n) == 4096 and (n == 2048).all()


def test_fingerprint():
    for t in ["", "One", "one two", "a b c d e f g", "x " * 999, "Ä ä İ a b c"]:
        assert fingerprint(shingle_hashes(t.encode().lower().split(), 3)) == brute_fingerprint(t)


def test_spark_has_the_same_hash(spark):
    r = spark.sql("select xxhash64('the quick été') as h").first().h
    assert r & (2**64 - 1) == xxhash.xxh64_intdigest("the quick été", 42)


@pytest.mark.parametrize("radius", [3, 1])
def test_links_lose_nothing(spark, radius):
    rng = np.random.default_rng(5)
    fps = set()
    for base in rng.integers(0, 2**64, 150, dtype=np.uint64).tolist():
        for _ in range(8):
            x = base
            for j in rng.choice(64, int(rng.integers(0, 5)), replace=False):
                x ^= 1 << int(j)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    got = components(spark, fuzzy_links(df, radius), Scratch(spark)).collect()
    root = {r.node: r.root for r in got}
    want = brute_components(list(range(len(fps))), fps, radius)
    mine = [root.get(x - 2**64 if x >= 2**63 else x, x - 2**64 if x >= 2**63 else x) for x in fps]
    first = {}
    for i, m in enumerate(mine):
        first.setdefault(m, i)
    assert [first[m] for m in mine] == want


def test_frame(spark):
    rng = np.random.default_rng(6)
    docs = []
    for i in range(60):
        w = [f"w{x}" for x in rng.integers(0, 400, 80)]
        docs.append(" ".join(w))
        docs.append(" ".join([*w[:70], "new", *w[71:]]))
    rows = [(i + 10, t, 1) for i, t in enumerate(docs)] + [(3, None, 1), (2, "", 1), (1, "  \n", 1), (None, docs[0], 1), (5, docs[4], 1), (5, docs[4], 1), (9, "word " * 30_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    fps = [brute_fingerprint(r[1]) for r in rows]
    comp = brute_components([r[0] for r in rows], fps)
    want = sorted(((r[0] is None, r[0] or 0), f"{f:016x}", c) for r, f, c in zip(rows, fps, comp, strict=True))
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.fingerprint, r.component_id) for r in simhash_near_dedup(df).collect())
    assert got == want
    assert simhash_near_dedup(df.limit(0)).count() == 0


def test_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(spark, edges, Scratch(spark)).collect()
    assert len(got) == 301 and {r.root for r in got} == {0}
