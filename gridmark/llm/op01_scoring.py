"""Language-model scoring: a word-count baseline and a causal self-attention model on subword ids.

Texts are read once: a pass writes every text's word keys and subword ids to the shared folder and counts, of
training texts, words and, within them, subword pairs (partial counts of every task meet in a shuffle). Then each
training round deals its texts, whole, to tasks, lets every task
train a copy of the model on its share, and averages the copies by their tokens; each text is trained on in one
of the rounds. Number of words, ids and texts alone say how many copies there are, what each trains on and in
which order, so the model does not depend on how files are split. Copies are averaged by bucket and then over buckets. What is gathered grows with the input; what is collected is bounded by the subword vocabulary and the model's size.

Scoring is one pass over keys and ids. Frequent words (at most ``HOT`` of them, by a threshold on counts) are broadcast;
the counts of all other words are joined to the texts' remaining words in a shuffle.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, ByteType, LongType, StructField, StructType

from .attention import BLOCK, Scorer, Trainer, Vocabulary, lay_out, start
from .bpe import WordEncoder, default_path, encoder
from .common import Scratch, by_key, groups_of, lean, one_thread, slices, table

#: words whose counts may be broadcast: 16 bytes each
HOT = 1 << 19
BUCKETS = 16
#: pieces of words in the young half of a worker's encoder
PIECES = 150_000
#: of the texts, one of EVERY is trained on, whole, in each of ROUNDS rounds: all of them where both are the same
EVERY, ROUNDS = 2, 2
#: blocks of a training step; texts wait until there are WAIT bytes of them
STEP, WAIT = 128, 200_000
#: bytes of texts that are read or scored at once
PART = 1_500_000
#: words that a copy of the model is trained on in all rounds, about
SHARE = 1 << 21
#: numbers of the model that are averaged together; buckets of tasks that are averaged first
_SLICE, COPIES = 4096, 1024
#: the key of a text's end; words have the XXH64 of their bytes
END_KEY = xxhash.xxh64_intdigest(b" end of text ") - (1 << 63)


def word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def _encoder(path: str) -> WordEncoder:
    return encoder(path, PIECES)


def held_out(id: str) -> Column:
    """Remainder 2 of crc32(id as text) by 7; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % 7 == 2


@dataclass
class Model:
    """``base``: the word counts ``(key, n)``; tokens N and distinct words V; the attention model."""

    counts: DataFrame
    tokens: int
    distinct: int
    hot_from: int
    shared: Broadcast
    path: str


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [t or b"" for t in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def _kind(enc: WordEncoder) -> str:
    """How ids are written: in two bytes where that holds them all."""
    return "<u2" if 0 < len(enc.names) <= 1 << 16 else "<u4"


def _read(path: str, schema: pa.Schema):
    """Rows of kind 2, a text's keys and ids, and of kinds 0 and 1, the counts of words and of pairs in training texts."""

    def run(batches):
        enc = _encoder(path)
        kind, end = _kind(enc), enc.tok.token_to_id("<|endoftext|>") or 0
        words = _Words(np.zeros(0, np.int64), np.zeros(0), enc)
        pairs, ends, held, size = np.zeros(len(enc.names) * BUCKETS), 0, [], 0

        def told(**columns) -> pa.RecordBatch:
            """A batch of ``schema``; columns that are not given are null."""
            arrays = {name: x if isinstance(x, pa.Array) else pa.array(x, schema.field(name).type) for name, x in columns.items()}
            return pa.RecordBatch.from_arrays([arrays[f.name] if f.name in arrays else pa.nulls(len(arrays["kind"]), f.type) for f in schema], names=schema.names)

        def counted(what: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return told(kind=np.full(len(key), what, np.int8), key=key, n=n)

        def summed() -> pa.RecordBatch:
            key, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)
            held.clear()
            return counted(0, key, n)

        for b in slices(batches):
            texts, doc, out = (b.column(b.schema.get_field_index(c)) for c in ("text", "id", "held_out"))
            texts, learn = _texts(b, "text"), ~out.to_numpy(zero_copy_only=False)
            at = 0
            while at < len(texts):
                split, first, chars = [], at, 0
                while at < len(texts) and chars < PART:
                    split.append(texts[at].lower().split())
                    chars += len(texts[at])
                    at += 1
                lengths = np.array([len(ws) for ws in split])
                _, key, n, ids = words.read([w for ws in split for w in ws])
                of_word, of_text = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(lengths)])
                mine = np.repeat(learn[first:at], lengths)
                held.append(np.unique(key[mine], return_counts=True))
                size += len(held[-1][0])
                ends += int(learn[first:at].sum())
                # subword pairs of the words: an id and the one before it
                before = np.concatenate([[end], ids[:-1]]).astype(np.int64)[: len(ids)]
                before[of_word[:-1][n > 0]] = end
                own = np.repeat(mine, n)
                pairs += np.bincount(ids[own].astype(np.int64) * BUCKETS + before[own] * 2654435761 % 4294967296 * BUCKETS // 4294967296, minlength=len(pairs))
                narrow, cut = ids.astype(kind), of_word[of_text]
                yield told(
                    kind=np.full(at - first, 2, np.int8), n=[len(t) for t in texts[first:at]], id=doc.slice(first, at - first), held_out=out.slice(first, at - first),
                    keys=[key[a:z].tobytes() for a, z in zip(of_text, of_text[1:])], ids=[narrow[a:z].tobytes() for a, z in zip(cut, cut[1:])],
                )
                if size > 600_000:
                    yield summed()
                    size = 0
        if held:
            yield summed()
        at = np.flatnonzero(pairs)
        yield counted(1, at, pairs[at].astype(np.int64))
        if ends:
            yield counted(0, np.array([END_KEY]), np.array([ends]))
            yield counted(1, np.array([end * BUCKETS]), np.array([ends]))

    return run


@dataclass
class Texts:
    """``rows``: (id, held_out, n, keys, ids) of every text, n its bytes; ``stats``: counts (kind, key, n) of those not held out."""

    rows: DataFrame
    stats: DataFrame
    path: str


def read(docs: DataFrame, scratch: Scratch, out: Column, id: str = "doc_id", text: str = "text", path: str | None = None) -> Texts:
    """Splits and encodes all rows of ``docs`` once, for ``fit`` and ``score``. Null texts are empty ones."""
    path = path or default_path()
    rows = docs.select(F.col(id).alias("id"), F.coalesce(out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    schema = StructType([StructField("kind", ByteType()), StructField("key", LongType()), StructField("n", LongType()), rows.schema["id"], rows.schema["held_out"], StructField("keys", BinaryType()), StructField("ids", BinaryType())])
    schema = StructType([StructField(f.name, f.dataType) for f in schema])
    found = scratch.write(rows.mapInArrow(lean(_read(path, to_arrow_schema(schema)), keep=True), schema))
    return Texts(found.filter("kind = 2").select("id", "held_out", "n", "keys", "ids"), found.filter("kind < 2").select("kind", "key", "n"), path)


def _dealt(docs: DataFrame, part: int, copies: int, text: str = "text") -> DataFrame:
    """The texts of a round, their id as string: a partition for each copy, dealt by and in order of id and ``text``."""
    name = F.coalesce(F.col("id").cast("string"), F.lit("None"))
    mine = docs.withColumn("id", name).filter(F.crc32(F.col("id").cast("binary")) % EVERY == part * (EVERY // ROUNDS) % EVERY)
    copy = F.pmod(F.xxhash64("id", text, F.lit(part)), F.lit(copies)).cast("int")
    return mine.repartitionById(copies, copy).sortWithinPartitions("id", F.xxhash64(text))


def _train(shared: Broadcast, path: str, part: int):
    def run(batches):
        one_thread()
        enc = _encoder(path)
        end = enc.tok.token_to_id("<|endoftext|>") or 0
        vocab, flat = shared.value["vocab"], shared.value["flat"]
        trainer = Trainer(flat, vocab)
        waiting: list[np.ndarray] = []
        size = 0

        def of(b: pa.RecordBatch) -> tuple[list[np.ndarray], list[int]]:
            """Ids and bytes of the texts, which have been read, or are here."""
            if "ids" in b.schema.names:
                return [np.frombuffer(x, _kind(enc)) for x in b.column(b.schema.get_field_index("ids")).to_pylist()], b.column(b.schema.get_field_index("n")).to_pylist()
            texts = _texts(b, "text")
            return [np.frombuffer(x, "<u4") for x in enc.encode([b" ".join(t.lower().split()) for t in texts])], list(map(len, texts))

        def learn() -> None:
            ids = waiting
            cur, prev, tgt, _ = lay_out(np.concatenate(ids), np.array([len(x) for x in ids]), vocab, end)
            for a in range(0, len(cur), STEP):
                trainer.step(cur[a : a + STEP], prev[a : a + STEP], tgt[a : a + STEP])
            waiting.clear()

        for b in slices(batches):
            for doc, ids, n in zip(b.column(b.schema.get_field_index("id")).to_pylist(), *of(b), strict=True):
                if zlib.crc32(str(doc).encode()) % EVERY != part * (EVERY // ROUNDS) % EVERY:
                    continue
                waiting.append(ids)
                size += n
                if size >= WAIT:
                    learn()
                    size = 0
        if waiting:
            learn()
        if trainer.tokens:
            task = TaskContext.get()
            bucket = task.partitionId() % COPIES if task else 0
            for i, a in enumerate(range(0, len(flat), _SLICE)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([bucket], pa.int64()), pa.array([trainer.tokens], pa.int64()), pa.array([trainer.flat[a : a + _SLICE].tobytes()])], names=["slice", "bucket", "n", "w"])

    return run


def _mean(keys: list[str]):
    """Means of the copies of a slice, weighted by tokens: of each bucket of tasks, then of the buckets."""

    def run(batches):
        for t, starts, ends in groups_of(batches, keys):
            own, n, w = t.column("slice").to_numpy(), t.column("n").to_numpy(), t.column("w")
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                total = sum(float(n[i]) * np.frombuffer(w[i].as_py(), np.float32).astype(np.float64) for i in range(a, b))
                yield pa.RecordBatch.from_arrays([pa.array([int(own[a])], pa.int64()), pa.array([int(n[a:b].sum())], pa.int64()), pa.array([(total / n[a:b].sum()).astype(np.float32).tobytes()])], names=["slice", "n", "w"])

    return run


def fit(docs: DataFrame | Texts, scratch: Scratch, id: str = "doc_id", text: str = "text", path: str | None = None) -> Model:
    """Fits on all rows of ``docs``, or on those texts read that are not held out. Null texts are empty ones (an end each)."""
    if not isinstance(docs, Texts):
        docs = read(docs, scratch, F.lit(False), id, text, path)
    spark, path = docs.rows.sparkSession, docs.path
    learn = docs.rows.filter(~F.col("held_out")).select("id", "n", "ids")
    stats = scratch.write(docs.stats.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    counts = stats.filter("kind = 0").select("key", "n")
    level = F.floor(F.log2("n") * 4).cast("int")  # a few hundred levels at most
    levels = sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n"), F.min("n").alias("low")).collect(), reverse=True)
    hot_from, seen = 1 << 62, 0
    for r in levels:
        seen += r.v
        if seen > HOT:
            break
        hot_from = r.low
    hot = counts.filter(F.col("n") >= hot_from).toArrow()
    key, n = hot.column("key").to_numpy(), hot.column("n").to_numpy()
    order = np.argsort(key)
    # at most one row for each subword id and bucket
    pairs = stats.filter("kind = 1").select("key", "n").toArrow()
    of = np.zeros(len(_encoder(path).names) * BUCKETS)
    of[pairs.column("key").to_numpy()] = pairs.column("n").to_numpy()
    vocab = Vocabulary(of.reshape(-1, BUCKETS))
    flat = start(vocab)
    n_copies = max(1, -(-sum(r.n for r in levels) // SHARE))
    for r in range(ROUNDS):
        shared = spark.sparkContext.broadcast({"vocab": vocab, "flat": flat})
        copies = _dealt(learn, r, n_copies, "ids").mapInArrow(lean(_train(shared, path, r), keep=True), "slice bigint, bucket bigint, n bigint, w binary")
        for keys in (["slice", "bucket"], ["slice"]):
            copies = by_key(copies, keys, [], _mean(keys), "slice bigint, n bigint, w binary", keep=True)
        means = copies.collect()  # the model's size
        for s in means:
            w = np.frombuffer(s.w, np.float32)
            flat[s.slice * _SLICE : s.slice * _SLICE + len(w)] = w
        shared.unpersist()
    shared = spark.sparkContext.broadcast({"vocab": vocab, "flat": flat, "key": key[order], "n": n[order]})
    return Model(counts, sum(r.n for r in levels), sum(r.v for r in levels), hot_from, shared, path)


class _Codes(dict):
    """Words by number in order of appearance; ``new`` gathers those not seen before."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class _Words:
    """Of words: log10(count + 1) (NaN: not a frequent word), key and ids.

    The ids of frequent words, at most ``HOT``, are remembered for all tasks of a worker, in arrays beside
    their keys; words themselves, and what is known of all others, only for the texts at hand.
    """

    def __init__(self, hot: np.ndarray, n_hot: np.ndarray, enc):
        levels, level = np.unique(n_hot, return_inverse=True)
        self.hot, self.enc, self.value = hot, enc, np.array([math.log10(x + 1) for x in levels.tolist()])[level]  # numpy's logarithms differ with the processor
        # ids of a frequent word: flat[at : at + size]; at is negative until it came
        self.at, self.size, self.flat = np.full(len(hot), -1, np.int64), np.zeros(len(hot), np.int64), np.zeros(0, np.uint32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether these are frequent, and where among the frequent ones."""
        if not len(self.hot):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.hot, keys), len(self.hot) - 1)
        return self.hot[at] == keys, at

    def look(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), np.nan)
        often, where = self.find(keys)
        out[often] = self.value[where[often]]
        return out

    def read(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """(value, key, number of ids) of each word, and all their ids in order."""
        known = _Codes()
        code = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        key = np.fromiter(map(word_key, known.new), np.int64, len(known.new))
        often, where = self.find(key)
        value, at, size = np.full(len(key), np.nan), np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
        value[often], at[often], size[often] = self.value[where[often]], self.at[where[often]], self.size[where[often]]
        # frequent words first, so that theirs are the ids that stay
        new = np.flatnonzero(at < 0)
        new = new[np.argsort(~often[new], kind="stable")]
        own = self.enc.encode([known.new[i] for i in new.tolist()])
        size[new] = np.fromiter(map(len, own), np.int64, len(new)) // 4
        at[new] = len(self.flat) + np.cumsum(size[new]) - size[new]
        flat = np.concatenate([self.flat, np.frombuffer(b"".join(own), "<u4")])
        stay = new[often[new]]
        self.at[where[stay]], self.size[where[stay]] = at[stay], size[stay]
        if len(stay):
            self.flat = flat[: len(self.flat) + int(size[stay].sum())].copy()
        n = size[code]
        ids = flat[np.arange(int(n.sum())) + np.repeat(at[code] - (np.cumsum(n) - n), n)] if len(code) else flat[:0]
        return value[code], key[code], n, ids


def _score(shared: Broadcast, path: str, names: list[str]):
    def run(batches):
        one_thread()
        m, enc = shared.value, _encoder(path)
        vocab, hot, n_hot = m["vocab"], m["key"], m["n"]
        scorer = Scorer(m["flat"], vocab)
        end_id, kind = enc.tok.token_to_id("<|endoftext|>") or 0, _kind(enc)
        seen = m.setdefault("words", _Words(hot, n_hot, enc))
        end_value, uid = seen.look(np.array([END_KEY]))[0], TaskContext.get().partitionId() << 36
        for b in slices(batches):
            doc, out, all_keys, all_ids, size = (b.column(b.schema.get_field_index(c)) for c in ("id", "held_out", "keys", "ids", "n"))
            size = size.to_pylist()
            at = 0
            while at < len(size):
                first, chars = at, 0
                while at < len(size) and chars < PART:
                    chars += size[at]
                    at += 1
                keys, ids = all_keys.slice(first, at - first).to_pylist(), all_ids.slice(first, at - first).to_pylist()
                key, flat = np.frombuffer(b"".join(keys), np.int64), np.frombuffer(b"".join(ids), kind)
                lengths = np.array([len(x) for x in keys], np.int64) // 8
                n_ids = np.array([len(x) for x in ids], np.int64) // flat.itemsize
                v = seen.look(key)
                ends = np.cumsum(lengths)
                cum = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])  # noqa: E731,B023
                rare = np.isnan(v)
                cur, prev, tgt, starts = lay_out(flat, n_ids, vocab, end_id)
                logp = np.add.reduceat(scorer.blocks(cur, prev, tgt), starts)
                n_rare = cum(rare) + np.isnan(end_value)
                sums, n_known = np.empty(len(lengths)), np.empty(len(lengths), np.int64)
                for i, e in enumerate(ends.tolist()):
                    own = v[e - lengths[i] : e]
                    own = own[~np.isnan(own)]
                    sums[i], n_known[i] = own.sum() + np.nan_to_num(end_value), len(own) + (not np.isnan(end_value))
                rare_keys = key[rare]
                if np.isnan(end_value):
                    rare_keys = np.insert(rare_keys, np.cumsum(cum(rare)), END_KEY)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_rare)]), pa.int32()), pa.array(rare_keys))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid + np.arange(len(lengths))), doc.slice(first, len(lengths)), out.slice(first, len(lengths)), pa.array(lengths + 1), pa.array(n_known), pa.array(sums), pa.array(logp), lists],
                    names=names,
                )
                uid += len(lengths)

    return run


def score(docs: DataFrame | Texts, model: Model, scratch: Scratch, out: Column | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores all rows of ``docs``, or all texts read: (id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Words have ASCII capitals lowered and are split at ASCII white space; each text has one end,
    counted as a token. Null texts are empty. Repeated rows and null ids each get their row.
    """
    rows = (docs if isinstance(docs, Texts) else read(docs, scratch, out, id, text, model.path)).rows
    kind = rows.schema["id"].dataType.simpleString()
    names = ["uid", "id", "held_out", "n_tokens", "n_hot", "hot_sum", "score", "rare"]
    rows = scratch.write(rows.mapInArrow(lean(_score(model.shared, model.path, names), keep=True), f"uid bigint, id {kind}, held_out boolean, n_tokens bigint, n_hot bigint, hot_sum double, score double, rare array<bigint>"))
    rare = rows.select("uid", F.explode("rare").alias("key")).join(model.counts.filter(F.col("n") < model.hot_from), "key")
    rare = rare.groupBy("uid").agg(F.count(F.lit(1)).alias("n_rare"), F.sum(F.log10(F.col("n") + 1)).alias("rare_sum"))
    all_ = F.lit(float(np.log10(model.tokens + model.distinct + 1.0)))
    return rows.drop("rare").join(rare, "uid", "left").select(
        F.col("id").alias(id), "held_out", "n_tokens", (F.col("n_hot") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("hot_sum") + F.coalesce("rare_sum", F.lit(0.0)) - F.col("n_tokens") * all_).alias("base_score"), "score",
    )


def op1_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all ``documents``, learning from those that are not held out."""
    scratch = Scratch(spark)
    texts = read(table(spark, sf_dir, "documents"), scratch, held_out("doc_id"))
    return score(texts, fit(texts, scratch), scratch)
