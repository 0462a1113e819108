import numpy as np

from gridmark.llm import op04_quality as op


def test_fit_finds_known_thresholds():
    rng = np.random.default_rng(18)
    active = [np.flatnonzero(rng.random(4) < 0.5) for _ in range(6000)]
    w, th = np.array([2.0, -1.0, 0.0, 1.0]), np.array([-1.0, 1.5])
    s = np.array([w[a].sum() for a in active]) + rng.logistic(size=6000)
    got_w, got_th = op.fit_ordinal(active, np.searchsorted(th, s), 4)
    assert np.allclose(got_w, w, atol=0.25) and np.allclose(got_th, th, atol=0.25)


def test_gradient_ends_at_a_minimum():
    rng = np.random.default_rng(19)
    active = [np.flatnonzero(rng.random(3) < 0.5) for _ in range(300)]
    grade = rng.integers(0, 3, 300)
    w, th = op.fit_ordinal(active, grade, 3, steps=1500, rate=0.02)

    def loss(w, th):
        s = np.array([w[a].sum() for a in active])
        e = np.concatenate([[-np.inf], th, [np.inf]])
        p = op._sigmoid(e[grade + 1] - s) - op._sigmoid(e[grade] - s)
        return -np.log(p).mean() + 0.5e-4 * (w * w).sum()

    best = loss(w, th)
    for i in range(3):
        for d in (-0.05, 0.05):
            assert loss(w + d * (np.arange(3) == i), th) > best
    for i in range(2):
        for d in (-0.05, 0.05):
            assert loss(w, th + d * (np.arange(2) == i)) > best


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    ratings = op.ratings_of(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    seen, unseen = ratings.filter("doc_id % 2 = 0"), ratings.filter("doc_id % 2 = 1")
    model = op.fit(docs, seen)
    assert (np.diff(model.thresholds) > 0).all()
    rows = op.score_quality(docs, model).join(unseen, "doc_id").select("grade", "p_good", "expected_grade").collect()
    good = [r.p_good >= 0.5 for r in rows if r.grade == 2]
    bad = [r.p_good >= 0.5 for r in rows if r.grade < 2]
    assert len(bad) > 100 and sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.06
    by = [np.mean([r.expected_grade for r in rows if r.grade == g]) for g in range(3)]
    assert by == sorted(by)


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "some words", 5), (3, "idiot " * 90_000, 5), (3, "some words", 5), (3, "some words", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_good int")
    none = spark.createDataFrame([], "doc_id long, grade int")
    out = op.score_quality(docs, op.fit(docs, none)).collect()
    assert len(out) == 6 and all(r.p_good_ > 0.5 for r in out) and {r.p_good for r in out} == {5}
    odd = spark.createDataFrame([(1, 2), (1, 0), (None, 1), (2, None), (3, 7), (9, 1)], "doc_id long, grade int")
    out = op.score_quality(docs, op.fit(docs, odd)).collect()
    assert len(out) == 6 and all(0 <= r.expected_grade <= 2 for r in out)
    assert op.score_quality(docs.limit(0), op.fit(docs, odd)).count() == 0


def test_scores_against_plain_python(spark):
    """Score of a text: the weights of its distinct words' hashes and of its shares' bins, one by one."""
    import bisect
    import math

    import xxhash

    rng = np.random.default_rng(20)
    model = op.Ordinal(rng.normal(0, 1, op.WIDTH).astype(np.float32), rng.normal(0, 1, op.N_BINS), np.array([-1.0, 2.0]))

    def shape(word):
        out = []
        for b in word.encode():
            c = "A" if 65 <= b < 91 else "a" if 97 <= b < 123 or b > 127 else "0" if 48 <= b < 58 else chr(b)
            if not (out and out[-1] == c and (c in "Aa0" or len(out) > 1 and out[-2] == c)):
                out.append(c)
        return "".join(out)

    def score(text):
        words, total = text.split(), 0.0
        h = lambda x: float(model.weights[xxhash.xxh64_intdigest(x) % op.WIDTH])
        for w in set(words):
            core = w.strip(op._EDGES).lower()
            total += sum([h(core)] * (core != "") + [h("^" + core[:n]) for n in (4, 5) if len(core) >= n]) + h(" " + shape(w))
        alnum = [sum(b > 127 or chr(b).isalnum() for b in w.encode()) for w in words]
        size = [len(w.encode()) for w in words]
        sums = [
            sum(s > 1 and w.isupper() for w, s in zip(words, size, strict=True)), sum(a == 0 for a in alnum), sum(1 - a / s for a, s in zip(alnum, size, strict=True)),
            sum(a == b for a, b in zip(words, words[1:], strict=False)), len(set(words)) + 10,
        ]
        for j, x in enumerate(sums):
            total += float(model.bins[j * (len(op._BINS) + 1) + bisect.bisect_left(op._BINS, round(x / (len(words) + 10), 6))])
        return total

    pieces = ["word", "Word", "UPPER", "x", "12-3", "%%%", "a%%%%", "|", "élan", "ÉLAN!!", "naïveté", "«ja»", "...", "don't", "A1", "same"]
    texts = ["", " \n", *(" ".join(rng.choice(pieces, int(rng.integers(1, 60)))) for _ in range(200)), "same " * 30_000, None]
    got = {r.doc_id: r for r in op.score_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), model).collect()}
    for i, t in enumerate(texts):
        p = [1 / (1 + math.exp(th - score(t or ""))) for th in (-1.0, 2.0)]
        assert abs(got[i].p_good - p[1]) < 1e-6 and abs(got[i].expected_grade - sum(p)) < 1e-6, t


def test_repeated_ids_count_once(spark):
    rows = [(1, "good words here", 2), (2, "bad idiot words", 0)] * 1
    docs = [(i, t) for i, t, _ in rows] + [(1, f"copy {i}") for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows] * 50, "doc_id long, grade int")
    seen = []
    keep, op.fit_rows = op.fit_rows, lambda grade, rows: seen.append((sorted(grade.tolist()), len(rows))) or keep(grade, rows)
    try:
        op.fit(df, ratings)
    finally:
        op.fit_rows = keep
    assert seen == [([0, 2], 2)]
