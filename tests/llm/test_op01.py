import math
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from gridmark.llm import op01_scoring as op
from gridmark.llm.attention import BLOCK, DIM, Scorer, Trainer, Vocabulary, lay_out, start, views
from gridmark.llm.common import Scratch


def small_vocab(rng, n=300):
    return Vocabulary(rng.integers(0, 50, (n, 16)).astype(float) * (rng.random((n, 1)) < 0.8))


def plain_score(ids, flat, vocab, end):
    """One token at a time, in double precision."""
    p = {k: v.astype(np.float64) for k, v in views(flat, vocab.rows).items()}
    inp = [vocab.bos, *(int(vocab.row[i]) for i in ids)]
    out = 0.0
    for t, target in enumerate([*ids, end]):
        low = max(0, t // BLOCK * BLOCK - BLOCK)
        x = p["emb"][inp[low : t + 1]]
        s = (x[-1] @ p["wq"]) @ (x @ p["wk"]).T / math.sqrt(DIM) + p["rel"][[t - j for j in range(low, t + 1)]]
        a = np.exp(s - s.max())
        h = x[-1] + (a / a.sum()) @ (x @ p["wv"])
        z = np.tanh(h @ p["w1"] + p["b1"]) @ p["wo"] + p["bo"]
        z = z - z.max()
        out += (z - np.log(np.exp(z).sum()))[vocab.cls[target]] / math.log(10) + vocab.within[target]
    return out


def test_batched_scores_equal_plain_ones_and_sum_to_one():
    rng = np.random.default_rng(8)
    vocab = small_vocab(rng)
    flat = start(vocab) + rng.normal(0, 0.1, len(start(vocab))).astype(np.float32)
    texts = [rng.integers(0, 300, n) for n in (0, 1, 15, 16, 17, 100)]
    cur, prev, tgt, first = lay_out(np.concatenate(texts), np.array([len(t) for t in texts]), vocab, 7)
    got = np.add.reduceat(Scorer(flat, vocab).blocks(cur, prev, tgt), first)
    want = [plain_score(t.tolist(), flat, vocab, 7) for t in texts]
    assert np.allclose(got, want, rtol=1e-4, atol=1e-3)
    assert (tgt >= 0).sum() == sum(len(t) + 1 for t in texts)
    total = sum(10 ** plain_next for plain_next in (plain_score([5, i], flat, vocab, 7) - plain_end(5, i, flat, vocab) for i in range(300)))
    assert abs(total / 10 ** (plain_score([5], flat, vocab, 7) - plain_end(None, 5, flat, vocab)) - 1) < 1e-6


def plain_end(before, last, flat, vocab):
    ids = [i for i in (before, last) if i is not None]
    return plain_score(ids, flat, vocab, 7) - sum_without_end(ids, flat, vocab)


def sum_without_end(ids, flat, vocab):
    p = 0.0
    for i in range(len(ids)):
        p += plain_score(ids[:i], flat, vocab, ids[i]) - (sum_without_end(ids[:i], flat, vocab) if i else 0.0)
    return p


def test_gradient():
    rng = np.random.default_rng(9)
    vocab = small_vocab(rng)
    flat = (start(vocab).astype(np.float64) + rng.normal(0, 0.1, len(start(vocab))))
    cur, prev, tgt, _ = lay_out(rng.integers(0, 300, 60), np.array([20, 40]), vocab, 7)

    class Probe(Trainer):
        def loss_and_grad(self, f):
            self.flat[:] = f
            self.m[:], self.s[:], self.t = 0, 0, 0
            loss = self.step(cur, prev, tgt)
            return loss, self.m.copy() * 10

    probe = Probe(flat, vocab)
    _, grad = probe.loss_and_grad(flat)
    big = np.argsort(-np.abs(grad))[::7][:40]
    for i in big:
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-4
        down[i] -= 1e-4
        want = (probe.loss_and_grad(up)[0] - probe.loss_and_grad(down)[0]) / 2e-4
        assert abs(grad[i] - want) < 2e-3 * max(1e-2, abs(want)), i


@pytest.mark.parametrize("hot", [1 << 19, 40, 0])
def test_frame(spark, hot, monkeypatch):
    monkeypatch.setattr(op, "HOT", hot)
    monkeypatch.setattr(op, "EVERY", 2)
    rng = np.random.default_rng(10)
    words = ["the", "The", "cat", "été", "sat,", "mat", "x y", *(f"w{i}" for i in range(200))]
    docs = [(i, " ".join(words[min(int(rng.exponential(12)), 206)] for _ in range(int(rng.integers(0, 150)))), 1) for i in range(120)]
    docs += [(500, None, 1), (501, "", 1), (None, "the cat", 1), (502, "the cat", 1), (502, "the cat", 1), (503, "long words " * 20_000, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score int")
    scratch = Scratch(spark)
    model = op.fit(df.filter(~op.held_out("doc_id")), scratch)
    rows = op.score(df, model, scratch, op.held_out("doc_id")).collect()
    tokens = {i: [w.lower() for w in (t or "").encode().split()] + [None] for i, (_, t, _) in enumerate(docs)}
    held = [zlib.crc32(str("" if d is None else d).encode()) % 7 == 2 for d, _, _ in docs]
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((d is None, d or 0, held[i], len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ((d, _, _), ws) in enumerate(zip(docs, tokens.values(), strict=True)))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert [g[:6] for g in got] == [w[:6] for w in want]
    assert np.allclose([g[6] for g in got], [w[6] for w in want], atol=1e-5)
    assert all(r.score < 0 for r in rows)
    assert op.score(df.limit(0), model, scratch, op.held_out("doc_id")).count() == 0


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    scratch = Scratch(spark)
    model = op.fit(df.limit(0), scratch)
    (r,) = op.score(df, model, scratch, op.held_out("doc_id")).collect()
    assert r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 and r.score < 0


def test_learns(spark, monkeypatch):
    rng = np.random.default_rng(12)
    a, b = ["alpha beta", "gamma delta"], ["uno dos", "tres cuatro"]
    texts = [" ".join(rng.choice(a if i % 2 else b, 60)) for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    total = []
    for rounds in (0, op.ROUNDS):
        monkeypatch.setattr(op, "ROUNDS", rounds)
        scratch = Scratch(spark)
        model = op.fit(df.filter(~op.held_out("doc_id")), scratch)
        total.append(sum(r.score for r in op.score(df, model, scratch, op.held_out("doc_id")).filter("held_out").collect()))
    assert total[1] > total[0] + 500


def test_every_training_text_is_trained_on_whole(monkeypatch):
    rng = np.random.default_rng(13)
    enc = op.encoder(op.default_path())
    texts = [" ".join(f"w{int(i)}" for i in rng.integers(0, 50, n)) for n in (0, 1, 3, 20, 40, 70, 150, 2000)] * 4
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})
    vocab = small_vocab(rng, len(enc.names))
    seen = Counter()

    class Recorder(Trainer):
        def step(self, cur, prev, tgt):
            seen.update(tgt[tgt >= 0].tolist())
            self.tokens += int((tgt >= 0).sum())

    monkeypatch.setattr(op, "Trainer", Recorder)
    for part in range(op.ROUNDS):
        list(op._train(SimpleNamespace(value={"vocab": vocab, "flat": start(vocab)}), op.default_path(), part)([batch]))
    end = enc.tok.token_to_id("<|endoftext|>") or 0
    want = Counter(i for ids in enc.encode([t.encode() for t in texts]) for i in np.frombuffer(ids, "<u4").tolist())
    want[end] += len(texts)
    assert seen == want


def test_partitionings_give_like_scores(spark):
    """Copies of the model see other texts under another partitioning; all scores together differ by a twentieth at most."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    totals = []
    for n in (3, 5):
        scratch = Scratch(spark)
        part = docs.repartition(n, "doc_id")
        model = op.fit(part.filter(~op.held_out("doc_id")), scratch)
        rows = op.score(part, model, scratch, op.held_out("doc_id")).collect()
        totals.append((sum(r.score for r in rows), sum(r.base_score for r in rows)))
    assert abs(totals[0][1] - totals[1][1]) < 1e-6 * abs(totals[0][1])
    assert abs(totals[0][0] - totals[1][0]) < 0.05 * abs(totals[0][0]), totals


def test_means_by_bucket_equal_the_mean_of_all(spark):
    rng = np.random.default_rng(9)
    rows = [(i % 2, b, int(rng.integers(1, 9)), rng.normal(size=5).astype(np.float32).tobytes()) for i in range(40) for b in (0, 1, 2)]
    df = spark.createDataFrame(rows, "slice long, bucket long, n long, w binary").repartition(4)
    for keys in (["slice", "bucket"], ["slice"]):
        df = op.by_key(df, keys, [], op._mean(keys), "slice bigint, n bigint, w binary" if keys == ["slice"] else "slice bigint, n bigint, w binary")
    for r in df.collect():
        own = [(x[2], np.frombuffer(x[3], np.float32)) for x in rows if x[0] == r.slice]
        assert r.n == sum(n for n, _ in own)
        assert np.allclose(np.frombuffer(r.w, np.float32), sum(n * w for n, w in own) / r.n, atol=1e-5)


def test_every_partitioning_gives_the_same_model(spark, monkeypatch):
    """What a copy is trained on, and in which order, follows from ids and texts: with one copy and with several."""
    rng = np.random.default_rng(14)
    rows = [(i if i % 50 else None, " ".join(f"w{int(x)}" for x in rng.integers(0, 90, n))) for i, n in enumerate(rng.integers(0, 200, 300))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for share in (op.SHARE, 9000):
        monkeypatch.setattr(op, "SHARE", share)
        flat = [op.fit(df.repartition(n, "text").sortWithinPartitions("text", ascending=n > 3), Scratch(spark)).shared.value["flat"] for n in (1, 3, 5)]
        for other in flat[1:]:
            assert np.allclose(flat[0], other, atol=1e-5), share


def test_all_texts_are_dealt_to_rounds_and_copies(spark):
    rows = [(None, "x"), (None, None), *((i, f"text {i}") for i in range(500)), (3, "text 3")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    got = [(r.id, r.text, part, r.copy) for part in range(op.ROUNDS) for r in op._dealt(df, part, 4).selectExpr("id", "text", "spark_partition_id() as copy").collect()]
    assert sorted(map(str, (g[:2] for g in got))) == sorted(str((str(i), t)) for i, t in rows)
    assert all(zlib.crc32(str(i).encode()) % op.EVERY == part * (op.EVERY // op.ROUNDS) % op.EVERY for i, _, part, _ in got)
    assert {c for *_, c in got} == set(range(4))


def test_workers_remember_ids_of_frequent_words_and_few_pieces():
    """What a worker keeps between tasks is bounded by the frequent words' ids and a small cache of pieces, and results are as if it kept nothing."""
    path = op.default_path()
    words = [f"word{i}é" if i % 3 else f"w{i}" for i in range(900)]
    often = np.array(sorted(map(op.word_key, (w.encode() for w in words[:300]))))
    enc = op._encoder(path)
    assert enc.most <= 150_000
    seen = op._Words(often, np.arange(300), enc)
    for part in (words[:600], words[200:], words[::-1], []):
        part = [w.encode() for w in part for _ in range(2)]
        value, key, n, ids = seen.read(part)
        want = [np.frombuffer(x, "<u4").tolist() for x in enc.encode(part)]
        assert np.split(ids, np.cumsum(n)[:-1])[0].tolist() == (want[0] if want else [])
        assert ids.tolist() == sum(want, []) and n.tolist() == list(map(len, want)) and key.tolist() == list(map(op.word_key, part))
        assert [None if np.isnan(v) else v for v in value] == [math.log10(np.searchsorted(often, k) + 1) if k in often else None for k in key.tolist()]
    held = [x for x in vars(seen).values() if isinstance(x, dict | list | set)]
    assert not held and len(seen.flat) == sum(len(x) // 4 for x in enc.encode([w.encode() for w in words[:300]]))


def test_texts_are_read_once_for_fitting_and_scoring(spark):
    """What reading writes is all that training and scoring need: keys, ids and counts as of the texts, and the same copy of the model."""
    texts = ["The cat  sat,\tété THE", None, "", " x　y &&& don't Žluť é", "w1 " * 3000, "the cat", *(f"w{i} cat{i}é.\n" * (i % 7) for i in range(80))]
    df = spark.createDataFrame([(i if i != 5 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    read = op.read(df.repartition(2), Scratch(spark), op.held_out("doc_id"))
    rows = {r.id: r for r in read.rows.collect()}
    enc = op._encoder(op.default_path())
    end = enc.tok.token_to_id("<|endoftext|>") or 0
    words, pairs = Counter(), Counter()
    for i, t in enumerate(texts):
        r, raw = rows[i if i != 5 else None], (t or "").encode()
        ids = [np.frombuffer(x, "<u4").tolist() for x in enc.encode(raw.lower().split())]
        assert np.frombuffer(r.keys, np.int64).tolist() == list(map(op.word_key, raw.lower().split())) and r.n == len(raw)
        assert np.frombuffer(r.ids, op._kind(enc)).tolist() == sum(ids, []) == enc.tok.encode(" ".join(raw.lower().decode().split(" ")), add_special_tokens=False).ids
        if not r.held_out:
            words.update([*map(op.word_key, raw.lower().split()), op.END_KEY])
            pairs.update([x * op.BUCKETS + b * 2654435761 % 4294967296 * op.BUCKETS // 4294967296 for one in ids for b, x in zip([end, *one], one)] + [end * op.BUCKETS])
    assert len(rows) == len(texts) and {r.held_out for r in rows.values()} == {True, False}
    got = [Counter(), Counter()]
    for r in read.stats.collect():
        got[r.kind][r.key] += r.n
    assert got == [words, pairs]
    # the same training, from what was read and from texts
    vocab = small_vocab(np.random.default_rng(15), len(enc.names))
    task = op._train(SimpleNamespace(value={"vocab": vocab, "flat": start(vocab)}), op.default_path(), 1)
    own = [i for i in range(len(texts)) if i != 5]
    batches = [
        pa.RecordBatch.from_pydict({"id": own, "text": [texts[i] for i in own]}),
        pa.RecordBatch.from_pydict({"id": own, "n": [rows[i].n for i in own], "ids": [bytes(rows[i].ids) for i in own]}),
    ]
    copies = [[b.column(3).to_pylist() for b in task([x])] for x in batches]
    assert copies[0] and copies[0] == copies[1]


def test_a_step_of_blocks_equals_the_sum_of_its_texts():
    """Keys and values are made once a place, and a block sees the one before it only in its own text."""
    rng = np.random.default_rng(16)
    vocab = small_vocab(rng)
    flat = start(vocab) + rng.normal(0, 0.1, len(start(vocab)))
    texts = [rng.integers(0, 300, n) for n in (5, 16, 40, 0, 31)]

    def grad(some):
        cur, prev, tgt, _ = lay_out(np.concatenate(some), np.array([len(t) for t in some]), vocab, 7)
        trainer = Trainer(flat, vocab)
        loss = trainer.step(cur, prev, tgt)
        return trainer.m * 10 * trainer.tokens, loss * trainer.tokens, trainer.tokens

    whole, parts = grad(texts), [grad([t]) for t in texts]
    assert whole[2] == sum(p[2] for p in parts) and abs(whole[1] - sum(p[1] for p in parts)) < 1e-8 * abs(whole[1])
    assert np.allclose(whole[0], sum(p[0] for p in parts), atol=1e-9)
