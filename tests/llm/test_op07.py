from collections import defaultdict

import numpy as np
import pytest

from gridmark.llm.common import Scratch
from gridmark.llm.op07_suffix import places, remove_repeats, repeated_spans


def brute(rows, least):
    """Every window against every earlier one; rows equal in id and text are one."""
    texts = sorted({(2**63 - 1 if i is None else i, t or "") for i, t in rows})
    seen, marks = {}, defaultdict(set)
    order = {}
    for d, t in texts:
        words = t.split()
        for s in range(len(words) - least + 1):
            w = tuple(words[s : s + least])
            if w in seen:
                marks[d, t].update(range(s, s + least))
            else:
                seen[w] = order[w] = (d, s)
    return {k: sorted(v) for k, v in marks.items()}


def words_of(spans):
    return sorted(x for s in spans for x in range(s["start"], s["end"]))


@pytest.mark.parametrize("least,gram", [(12, 4), (50, 10)])
def test_against_all_windows(spark, least, gram):
    rng = np.random.default_rng(13)
    vocab = [f"w{i}" for i in range(3000)]
    passages = [list(rng.choice(vocab, least + int(rng.integers(-2, 30)))) for _ in range(8)]
    rows = []
    for i in range(150):
        body = list(rng.choice(vocab, int(rng.integers(0, 5 * least))))
        for _ in range(int(rng.integers(0, 3))):
            at = int(rng.integers(0, len(body) + 1))
            body[at:at] = passages[int(rng.integers(0, 8))]
        rows.append((i, " ".join(body)))
    for i in range(40):  # near copies: other words at a few places
        words = rows[i][1].split()
        for at in rng.integers(0, max(1, len(words)), 2):
            if words:
                words[int(at)] = "new"
        rows.append((200 + i, "\n".join(words)))
    rows += [(300 + i, rows[3][1]) for i in range(30)]
    rows += [(400, "ab cd " * 200), (401, "x " * 300), (None, rows[5][1] + " end"), (None, None), (402, ""), (403, "one"), (7, rows[7][1]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = repeated_spans(df, Scratch(spark), least=least, gram=gram).collect()
    want = brute(rows, least)
    assert sorted((r.d, words_of(r.spans)) for r in got) == sorted((d, w) for (d, _), w in want.items())


def test_sources(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(9, f"a {passage}"), (4, f"b {passage} c"), (7, f"{passage} d"), (8, "clean text"), (None, passage)]
    got = {r.d: r.sources for r in repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).collect()}
    assert got == {7: [4], 9: [4], 2**63 - 1: [4]}


def test_texts_without_repeats(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"one  {passage}\ntail", "x"), (2, f"two\t{passage}", "y"), (3, f" {passage}  three  four ", "z"), (4, None, "n"), (5, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r.doc_id: (r.text, r.spans) for r in remove_repeats(df).collect()}
    assert got == {1: (rows[0][1], "x"), 2: ("two\t", "y"), 3: (" three  four ", "z"), 4: (None, "n"), 5: ("", "e")}
    assert remove_repeats(df.limit(0)).count() == 0


def test_equal_windows_retain_the_same_place():
    rng = np.random.default_rng(14)
    h = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    part = h[1000:1200]
    t, g, _, lo, hi = places(np.concatenate([h, rng.integers(0, 2**64, 33, dtype=np.uint64), part]), np.array([5000, 233]))
    a = {(int(x), int(s)) for x, l, e, k in zip(g, lo, hi, t, strict=True) if k == 0 for s in range(l, e + 1)}
    b = {(int(x), int(s)) for x, l, e, k in zip(g, lo, hi, t, strict=True) if k == 1 for s in range(l, e + 1)}
    assert {(x, s - 33 + 1000) for x, s in b if s >= 33} <= a
    assert len(g) < 5233 / 15
