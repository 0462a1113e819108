"""Quality by ordinal cumulative-link regression on graded ratings.

Grades 0 (toxic), 1 (poor but harmless) and 2 (good) share one weight vector over hashed text: every
distinct word of a text, the word's beginnings and its shape are hashed to ``WIDTH`` weights, beside
bins of the text's general statistics. Ordered thresholds turn the score into P(grade <= k) =
sigmoid(threshold_k - score), and so into an expected grade and a tail probability for selection.

The fit uses at most ``SAMPLE`` labelled texts (those of the smallest id hashes); scoring reads every
text whole. Words count by presence, so that one word in a long text weighs as much as in a short one.
"""

from __future__ import annotations

import string
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, lean, table

#: bounds of the fit: labelled texts, hashed weights
SAMPLE, WIDTH = 20_000, 1 << 20
#: texts in which a weight must be met to be learnt; texts of a step, least steps, passes over the sample, penalty
LEAST_DF, STEP, STEPS, PASSES, SPARSE = 4, 256, 800, 10, 2.0
GRADES = 3
_EDGES = string.punctuation + "¡¿«»…“”„–—"
#: what a byte of a word is for its shape: a capital, another letter (so all beyond ASCII), a digit, itself
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58] = 65, 97, 97, 48
_ALNUM = (_SHAPE == 65) | (_SHAPE == 97) | (_SHAPE == 48)
_BINS = (0.0, 0.01, 0.03, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97)
#: shares of a text: capital words, words without letters and digits, symbols, neighbours repeated, distinct words
_SHAPES = ("upper", "bare", "symbols", "same", "unique")
N_BINS = len(_SHAPES) * (len(_BINS) + 1)
_KEPT = 150_000
_PREFIXES = (4, 5)
#: hashes of a word: itself, its beginnings, its shape
_HASHES = 2 + len(_PREFIXES)
#: words that a text's shares are shrunk by, so that a few words say little about its shape
_SHRINK = 10


def word_facts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each word its weights' numbers (-1 for one it lacks) and (capital, bare, share of symbols).

    The weights are those of the word without symbols at its ends, of its beginnings, and of its shape:
    letters and digits as one each, symbols as one or two.
    """
    xx = xxhash.xxh64_intdigest
    hashes = np.full((len(words), _HASHES), -1, np.int32)
    for i, core in enumerate(w.strip(_EDGES).lower() for w in words):
        if core:
            hashes[i, 0] = xx(core) % WIDTH
            for j, n in enumerate(_PREFIXES, 1):
                if len(core) >= n:
                    hashes[i, j] = xx("^" + core[:n]) % WIDTH
    raw = np.frombuffer(" ".join(words).encode() + b" ", np.uint8)  # no word holds a space
    kind = _SHAPE[raw]
    same = np.concatenate([[False], kind[1:] == kind[:-1]])
    shapes = kind[~same | ~_ALNUM[kind] & ~np.concatenate([[False], same[:-1]])].tobytes().split(b" ")[:-1]
    of = {x: xx(b" " + x) % WIDTH for x in set(shapes)}
    hashes[:, -1] = np.fromiter(map(of.__getitem__, shapes), np.int64, len(words))
    ends = np.flatnonzero(raw == 32)
    size = np.diff(ends, prepend=-1) - 1
    letters = np.diff(np.cumsum(_ALNUM[kind])[ends], prepend=0)
    upper = np.fromiter(map(str.isupper, words), bool, len(words)) & (size > 1)
    return hashes, np.stack([upper, letters == 0, 1 - letters / size], 1).astype(np.float32)


class Reader:
    """Hashes and shape of texts; facts about a word are remembered up to a bound.

    ``weights``: of hashes, to sum up by text; None to report every text's hashes.
    """

    def __init__(self, weights: np.ndarray | None):
        self.weights = weights
        self._forget()

    def _forget(self) -> None:
        self.code: dict[str, int] = {}
        self.hash, self.kind = np.zeros((0, _HASHES) if self.weights is None else (0,), np.int32 if self.weights is None else np.float64), np.zeros((0, 3), np.float32)

    def _learn(self, new: list[str]) -> None:
        self.code.update(zip(new, range(len(self.code), len(self.code) + len(new)), strict=True))
        hashes, kind = word_facts(new)
        if self.weights is not None:
            hashes = np.where(hashes >= 0, self.weights[hashes], 0).sum(1)
        self.hash, self.kind = np.concatenate([self.hash, hashes]), np.concatenate([self.kind, kind])

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, fact) of each distinct word of each text, and the bins of each text's shares.

        The fact is the word's weight or, without weights, its hashes.
        """
        split = [t.split() for t in texts]
        flat = [w for ws in split for w in ws]
        new = list(set(flat).difference(self.code))
        if len(self.code) + len(new) > _KEPT:
            self._forget()
            new = list(set(flat))
        if new:
            self._learn(new)
        code = np.fromiter(map(self.code.__getitem__, flat), np.int64, len(flat))
        n = np.fromiter(map(len, split), np.int64, len(split))
        text = np.repeat(np.arange(len(split)), n)
        seen = np.unique(text << 32 | code)
        of, code_seen = seen >> 32, seen & 0xFFFFFFFF
        again = np.zeros(len(flat))
        again[1:] = (code[1:] == code[:-1]) & (text[1:] == text[:-1])
        ends = np.concatenate([[0], np.cumsum(n)])
        total = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])[ends])
        shares = [total(self.kind[code, j]) for j in range(3)] + [total(again), np.bincount(of, minlength=len(split)) + _SHRINK]
        shares = np.stack(shares, 1) / (n + _SHRINK)[:, None]
        return of, self.hash[code_seen], np.searchsorted(_BINS, np.round(shares, 9), side="left") + np.arange(len(_SHAPES)) * (len(_BINS) + 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


@dataclass
class Ordinal:
    """``WIDTH`` hashed weights and those of the bins; increasing thresholds."""

    weights: np.ndarray
    bins: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 to GRADES - 1, (n, GRADES - 1)."""
        return 1 - _sigmoid(self.thresholds[None, :] - np.asarray(score)[:, None])


def fit_ordinal(active: list[np.ndarray] | tuple[np.ndarray, np.ndarray], grade: np.ndarray, n_features: int, steps: int = 600, rate: float = 0.05, ridge: float = 1e-4, batch: int | None = None, price: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest penalised likelihood, by Adam.

    ``active``: the features present in each row, or (all of them, where each row ends). A step takes
    all rows or ``batch`` of them, in turn; with batches the rate falls to nothing. ``price``
    of each weight's size sets most weights to zero.
    """
    counts = np.bincount(grade, minlength=GRADES) + np.array([0.01] * (GRADES - 1) + [1.0])
    p = np.cumsum(counts)[:-1] / counts.sum()
    first, gaps = np.log(p[0] / (1 - p[0])), np.log(np.maximum(np.diff(np.log(p / (1 - p))), 1e-2))
    w, th = np.zeros(n_features), np.concatenate([[first], gaps])
    levels = lambda: th[0] + np.concatenate([[0], np.cumsum(np.exp(th[1:]))])
    if not len(grade) or len(set(grade.tolist())) < 2:
        return w, levels()
    if not isinstance(active, tuple):
        active = (np.concatenate(active), np.cumsum([len(a) for a in active]))
    idx, ends = active
    starts = np.concatenate([[0], ends[:-1]])
    size = len(grade) if batch is None else min(batch, len(grade))
    m, v, m_th, v_th = np.zeros(n_features), np.zeros(n_features), np.zeros(len(th)), np.zeros(len(th))
    at = 0
    for t in range(1, steps + 1):
        a, b = at, min(at + size, len(grade))
        at = b % len(grade)
        g, own, n = grade[a:b], idx[starts[a] : ends[b - 1]], b - a
        row = np.repeat(np.arange(n), ends[a:b] - starts[a:b])
        s = np.bincount(row, w[own], minlength=n)
        edges = np.concatenate([[-np.inf], levels(), [np.inf]])
        hi, lo = _sigmoid(edges[g + 1] - s), _sigmoid(edges[g] - s)
        prob = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / prob, lo * (1 - lo) / prob
        d_s = (d_hi - d_lo) / n  # of the negative log likelihood
        d_level = np.array([-(d_hi[g == k].sum() - d_lo[g == k + 1].sum()) / n for k in range(GRADES - 1)])
        grad = np.bincount(own, d_s[row], minlength=n_features) + ridge * w
        grad_th = np.array([d_level.sum()] + [d_level[k + 1 :].sum() * np.exp(th[1 + k]) for k in range(GRADES - 2)])
        now = rate if batch is None else rate * (1 - (t - 1) / steps)
        for x, d, m_, v_ in ((w, grad, m, v), (th, grad_th, m_th, v_th)):
            m_ += 0.1 * (d - m_)
            v_ += 0.01 * (d * d - v_)
            scale = now / (np.sqrt(v_ / (1 - 0.99**t)) + 1e-9)
            x -= scale * m_ / (1 - 0.9**t)
            if price is not None and x is w:
                x[:] = np.sign(x) * np.maximum(np.abs(x) - np.minimum(scale, 50.0) * price, 0)
    return w, levels()


def _texts(b: pa.RecordBatch, name: str):
    """Groups of a batch's texts of bounded size: (first row, texts)."""
    column = b.column(b.schema.get_field_index(name)).to_pylist()
    at = 0
    while at < len(column):
        first, size, out = at, 0, []
        while at < len(column) and size < 1_000_000:
            out.append(column[at] or "")
            size += len(out[-1])
            at += 1
        yield first, out


def pack_row(numbers: np.ndarray) -> bytes:
    """Increasing numbers, as their compressed steps."""
    return zlib.compress(np.diff(numbers, prepend=0).astype("<i4").tobytes(), 1)


def unpack_row(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(packed), "<i4"), dtype=np.int32)


def _hashed(batches):
    """Labelled texts as packed numbers of their weights: hashes, then ``WIDTH`` and their bins.

    Of an id's texts only those go on whose hash is below those seen before in the task.
    """
    reader = Reader(None)
    least: dict = {}  # at most SAMPLE ids
    for b in batches:
        ids, th = b.column("own_id").to_pylist(), b.column("th").to_pylist()
        rows = []
        for i, (id_, h) in enumerate(zip(ids, th, strict=True)):
            if h < least.get(id_, 1 << 63):
                least[id_] = h
                rows.append(i)
        if not rows:
            continue
        b, out = b.take(pa.array(rows)), []
        for _, texts in _texts(b, "text"):
            of, hashes, bins = reader.read(texts)
            seen = np.unique((of[:, None] << 32 | hashes)[hashes >= 0])
            for i, own in enumerate(np.split(seen & 0xFFFFFFFF, np.searchsorted(seen >> 32, np.arange(1, len(texts))))):
                out.append(pack_row(np.concatenate([own, WIDTH + bins[i]])))
        yield pa.RecordBatch.from_arrays([b.column("own_id"), b.column("th"), b.column("grade"), pa.array(out, pa.binary())], names=["own_id", "th", "grade", "active"])


def _placed(rows: list[np.ndarray], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with their numbers as ``place`` has them, negative ones left out: all of them, and where each ends."""
    ends = np.cumsum([int((place[r] >= 0).sum()) for r in rows])
    flat = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
    for r, end in zip(rows, ends.tolist(), strict=True):
        own = place[r]
        own = own[own >= 0]
        flat[end - len(own) : end] = own
    return flat, ends


class _Packed:
    """Packed rows, unpacked one at a time whenever they are gone through."""

    def __init__(self, rows: list):
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __iter__(self):
        return map(unpack_row, self.rows)


def fit_rows(grade: np.ndarray, rows) -> Ordinal:
    """Fits on ``rows`` of distinct weights' numbers."""
    df = np.zeros(WIDTH + N_BINS, np.int32)
    for r in rows:
        df[r] += 1
    known = df >= LEAST_DF
    known[WIDTH:] = True
    n = int(known.sum())
    flat, ends = _placed(rows, np.where(known, np.cumsum(known) - 1, -1).astype(np.int32))
    steps = max(STEPS, PASSES * -(-len(grade) // STEP))
    # most weights go in a first fit; the others, which it pulls towards zero, are fitted again
    met = np.minimum(df[known] / max(len(grade), 1), 1)
    price = SPARSE * np.sqrt(met * (1 - met) / max(len(grade), 1))  # what chance alone pulls a weight by, times SPARSE
    price[n - N_BINS :] = 0
    w, _ = fit_ordinal((flat, ends), grade, n, steps=steps, ridge=1e-5, batch=STEP, price=price)
    left = w != 0
    left[n - N_BINS :] = True
    del flat
    place = np.full(len(known), -1, np.int32)
    place[np.flatnonzero(known)[left]] = np.arange(int(left.sum()))
    w[left], thresholds = fit_ordinal(_placed(rows, place), grade, int(left.sum()), steps=1500)
    weights = np.zeros(WIDTH + N_BINS)
    weights[known] = w
    return Ordinal(weights[:WIDTH].astype(np.float32), weights[WIDTH:], thresholds)


def fit(docs: DataFrame, ratings: DataFrame, text: str = "text", id: str = "doc_id") -> Ordinal:
    """Fits on ``ratings(id, grade)``, grades 0 to 2. Null ids and grades are left out; of several
    ratings of an id the lowest holds. Of an id's several texts one counts, that of the smallest hash.
    Without ratings of two grades all texts get the same result."""
    rated = ratings.select(F.col(id).alias("rated_id"), F.col("grade").cast("int").alias("grade")).dropna().filter(F.col("grade").between(0, GRADES - 1))
    rated = rated.groupBy("rated_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("rated_id"), "rated_id").limit(SAMPLE)
    texts = docs.select(F.col(id).alias("own_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text")).join(F.broadcast(rated), F.col("own_id") == F.col("rated_id"))
    hashed = texts.select("own_id", "th", "grade", "text").mapInArrow(lean(_hashed), f"own_id {docs.schema[id].dataType.simpleString()}, th bigint, grade int, active binary")
    rows = hashed.groupBy("own_id").agg(F.min_by(F.struct("th", "grade", "active"), "th").alias("r")).select("own_id", "r.*")
    rows = rows.toArrow()  # at most SAMPLE rows
    order = np.lexsort((rows.column("own_id").to_numpy(), rows.column("th").to_numpy()))
    packed = rows.column("active").to_pylist()
    return fit_rows(rows.column("grade").to_numpy()[order].astype(np.int64), _Packed([packed[i] for i in order.tolist()]))


def score_quality(docs: DataFrame, model: Ordinal, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) with ``expected_grade`` and ``p_good``, the top grade's probability.

    Null texts count as empty. Added columns whose names are taken get an underscore. Every row gets
    its result, repeated ones the same; an empty table stays empty.
    """
    shared: Broadcast = docs.sparkSession.sparkContext.broadcast(model)
    keep = docs.columns if keep is None else keep
    docs = docs.select(*dict.fromkeys([*keep, text]))
    names = [*keep, free_name(docs, "expected_grade"), free_name(docs, "p_good")]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep] + [f"`{c}` double" for c in names[-2:]]

    def run(batches):
        m = shared.value
        reader = Reader(m.weights)
        for b in batches:
            scores = [np.zeros(0)]
            for _, texts in _texts(b, text):
                of, weight, bins = reader.read(texts)
                scores.append(np.bincount(of, weight, minlength=len(texts)) + m.bins[bins].sum(1))
            tails = m.tails(np.concatenate(scores))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(tails.sum(1)), pa.array(tails[:, -1])], names=names)

    return docs.mapInArrow(lean(run), ", ".join(kinds))


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades from binary labels: toxic 0, poor quality 1, else 2.

    Toxic words add up without end, so their grade is the lowest; the shape of poor text does not.
    """
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: doc_id, expected_grade, p_good, kept (p_good of at least one half)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, ratings_of(table(spark, sf_dir, "labels")))
    return score_quality(docs, model, keep=["doc_id"]).withColumn("kept", F.col("p_good") >= 0.5)
