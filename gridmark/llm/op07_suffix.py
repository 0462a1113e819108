"""Removal of repeated passages by a sparse suffix array.

Suffixes are retained only where a passage's own content says so: a window of ``MIN_WORDS`` words
retains the suffix at the smallest hash among its ``GRAM``-word grams (its minimiser), so that equal
windows retain the same place, about one word in twenty. Retained suffixes are sorted by their first
``GRAM`` words and, among equals, by what extends them left and right over all windows that the place
stands for (its neighbourhood); every suffix is compared with its neighbour in that order.

* Neighbouring places form runs, cut where their content says so; a run that occurred earlier as a
  whole is done at once, in one row however long it is. Only first runs go on.
* A suffix whose neighbourhood equals its neighbour's repeats all windows of the first of them.
* Where one gram has several neighbourhoods, matches may end within them. Only for the first member of
  each are the windows looked at one by one, from the text, and sorted and compared likewise.

The earliest occurrence of a window (by id, then text hash, then place) stays, every later one is a
repeat; a word goes if any repeated window covers it. That is what a comparison of all windows with
each other gives. Words are ordered by 64-bit hashes of those that are compared: the words of all
suffixes in raw order would be more bytes than the input. The sort is by range and its last keys tell
all rows apart, so that a passage of any frequency spreads over partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, free_name, lean, ranked, table

MIN_WORDS, GRAM = 50, 10
#: places that follow each other in a run, on average
RUN = 2
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: low bits that hold a place among the texts taken at once; the first of equal hashes is retained
_POS_BITS = 31
_KNOWN = 150_000
#: words and texts taken at once
_FLAT, _ROWS = 60_000, 1_000
#: a place as packed into a run: little-endian, without padding
_PLACE = np.dtype([("gram", "<i8"), ("around", "<i8"), ("lo", "<i4"), ("hi", "<i4")])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Words:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        new = set(words).difference(self.known)
        if new:
            if len(self.known) + len(new) > _KNOWN:
                self.known.clear()
                new = set(words)
            xx = xxhash.xxh64_intdigest
            self.known.update((w, xx(w, 7)) for w in new)
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def prefixes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and inverse powers by which the words a..b-1 hash to (sums[b] - sums[a]) * inverse[a]."""
    n = len(h)
    power = np.cumprod(np.full(n, _BASE, np.uint64), dtype=np.uint64)
    inverse = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _INVERSE, np.uint64), dtype=np.uint64)])
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power, dtype=np.uint64)]), inverse


def places(h: np.ndarray, lengths: np.ndarray, least: int = MIN_WORDS, gram: int = GRAM):
    """Retained places of texts whose word hashes stand one after the other.

    Returns text, gram hash, neighbourhood hash, and the first and last window start (in the text).
    """
    n, span = len(h), least - gram + 1
    empty = np.zeros(0, np.int64)
    if n < least:
        return empty, empty, empty, empty, empty
    sums, inverse = prefixes(h)
    grams = mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    key = grams & ~np.uint64((1 << _POS_BITS) - 1) | np.arange(len(grams), dtype=np.uint64)
    low, width = key, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    at = (low & np.uint64((1 << _POS_BITS) - 1)).astype(np.int64)  # for each window start of the flat words
    ends = np.cumsum(lengths)
    starts = ends - lengths
    n_win = np.maximum(lengths - least + 1, 0)
    text = np.repeat(np.arange(len(lengths)), n_win)
    win = np.arange(len(text)) - np.repeat(np.cumsum(n_win) - n_win, n_win) + np.repeat(starts, n_win)
    if not len(win):
        return empty, empty, empty, empty, empty
    at = at[win]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([new[1:] - 1, [len(win) - 1]])
    a, b, t = win[new], win[last], text[new]
    around = mix((sums[b + least] - sums[a]) * inverse[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return t, grams[at[new]].view(np.int64), around.view(np.int64), a - starts[t], b - starts[t]


def _key(df: DataFrame, id: str, text: str) -> tuple[Column, Column]:
    return F.coalesce(F.col(id).cast("long"), F.lit(2**63 - 1)), F.xxhash64(text)


def runs_of(text: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Where runs of neighbouring places begin: with a text, and at grams that their hash selects."""
    if not len(text):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]) | (grams % RUN == 0))


def _slices(batches):
    """The same rows, at most ``_ROWS`` at once."""
    return (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS))


def _find(least: int, gram: int):
    def run(batches):
        words = Words()
        for b in _slices(batches):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            at = 0
            while at < len(texts):
                flat, lengths, first = [], [], at
                while at < len(texts) and len(flat) < _FLAT:
                    ws = (texts[at] or b"").split()
                    flat += ws
                    lengths.append(len(ws))
                    at += 1
                t, g, around, lo, hi = places(words.hashes(flat), np.array(lengths, np.int64), least, gram)
                start = runs_of(t, g)
                end = np.append(start, len(t))[1:]
                sums, inverse = prefixes(around.view(np.uint64))
                run_hash = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64)).view(np.int64)
                lo, hi = lo.astype(np.int32), hi.astype(np.int32)
                packed = np.empty(len(t), _PLACE)
                packed["gram"], packed["around"], packed["lo"], packed["hi"] = g, around, lo, hi
                cuts = (np.append(start, len(t)) * _PLACE.itemsize).astype(np.int32)
                each = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(cuts), pa.py_buffer(packed.tobytes())])
                rows = pa.array(t[start] + first)
                yield pa.RecordBatch.from_arrays(
                    [b.column("d").take(rows), b.column("th").take(rows), pa.array(run_hash), pa.array(lo[start]), pa.array(hi[end - 1] if len(end) else hi), each],
                    names=["d", "th", "run", "lo", "hi", "places"],
                )

    return run


def _unpacked(batches):
    """A row for each place of the runs."""
    for b in batches:
        raw = b.column("places").to_pylist()
        places = np.frombuffer(b"".join(raw), _PLACE)
        of = pa.array(np.repeat(np.arange(len(raw)), [len(x) // _PLACE.itemsize for x in raw]))
        own = [pa.array(np.ascontiguousarray(places[c])) for c in _PLACE.names]
        yield pa.RecordBatch.from_arrays([b.column("d").take(of), b.column("th").take(of), *own], names=["d", "th", *_PLACE.names])


def _windows(least: int):
    def run(batches):
        words = Words()
        for b in _slices(batches):
            d, th = b.column("d"), b.column("th")
            runs = b.column("runs").to_pylist()
            for i, text in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                sums, inverse = prefixes(words.hashes(text.split()))
                s = np.unique(np.concatenate([np.arange(r["lo"], r["hi"] + 1) for r in runs[i]]))
                w = mix((sums[s + least] - sums[s]) * inverse[s]).view(np.int64)
                same = pa.array(np.full(len(s), i))
                yield pa.RecordBatch.from_arrays([d.take(same), th.take(same), pa.array(w), pa.array(s.astype(np.int32))], names=["d", "th", "w", "lo"])

    return run


def _merged(least: int):
    def run(batches):
        for b in _slices(batches):
            spans = []
            for runs in b.column("runs").to_pylist():
                out: list[list[int]] = []
                for r in sorted(runs, key=lambda r: (r["lo"], r["hi"])):
                    if out and r["lo"] <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], r["hi"] + least)
                    else:
                        out.append([r["lo"], r["hi"] + least])
                spans.append([{"start": s, "end": e} for s, e in out])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column("d"), b.column("th"), b.column("sources"), pa.array(spans, kind)], names=["d", "th", "sources", "spans"])

    return run


def repeated_spans(docs: DataFrame, scratch: Scratch, text: str = "text", id: str = "doc_id", least: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """``(d, th, sources, spans)`` of every text with repeats: words [start, end) that occur earlier, and
    the ids of the texts in which they occur first.

    ``d`` is the id (the largest long for a null id, which so comes last), ``th`` the text's XXH64.
    Rows equal in both are one text: they are not repeats of each other and share their result.
    Words are split at ASCII white space and compared as they are. Null and short texts have no
    spans. Repeats within a text count too.
    """
    d, th = _key(docs, id, text)
    docs = docs.select(d.alias("d"), th.alias("th"), F.col(text).alias("text"))
    found = scratch.write(docs.mapInArrow(lean(_find(least, gram)), "d bigint, th bigint, run bigint, lo int, hi int, places binary"))
    repeats = (F.col("d") != F.col("first_d")) | (F.col("th") != F.col("first_th")) | (F.col("lo") != F.col("first_lo"))
    said = ["d", "th", "lo", "hi", F.col("first_d").alias("source")]
    # runs of places first: what repeats an earlier run as a whole is done in one row
    found = scratch.write(ranked(found, ["run"], [], ["d", "th", "lo"], [], scratch).select("d", "th", "lo", "hi", "places", "first_d", repeats.alias("repeat")))
    runs = found.filter("repeat").select(*said)
    # then places, neighbours in the order of their grams: equal neighbourhoods repeat those of the first
    each = found.filter("not repeat").select("d", "th", "places").mapInArrow(lean(_unpacked), "d bigint, th bigint, gram bigint, around bigint, lo int, hi int")
    order = scratch.write(ranked(each, ["gram"], ["around"], ["d", "th", "lo"], ["hi"], scratch).withColumn("repeat", repeats))
    whole = order.filter("repeat").select(*said)
    # windows of first members, where a gram has several neighbourhoods: these, and the first of all
    other = order.filter(~F.col("repeat") & ((F.col("d") != F.col("head_d")) | (F.col("th") != F.col("head_th")) | (F.col("lo") != F.col("head_lo"))))
    part = other.select("d", "th", "lo", "hi").union(other.select("head_d", "head_th", "head_lo", "head_hi")).distinct()
    part = part.groupBy("d", "th").agg(F.collect_list(F.struct(F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"))).alias("runs"))
    part = docs.withColumnsRenamed({"d": "doc_d", "th": "doc_th"}).join(part, (F.col("doc_d") == F.col("d")) & (F.col("doc_th") == F.col("th")))
    windows = scratch.write(part.select("d", "th", "text", "runs").mapInArrow(lean(_windows(least)), "d bigint, th bigint, w bigint, lo int"))
    single = ranked(windows.withColumn("hi", F.col("lo")), ["w"], [], ["d", "th", "lo"], [], scratch).filter(repeats).select(*said)
    runs = runs.union(whole).union(single).groupBy("d", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"), F.sort_array(F.collect_set(F.nullif("source", F.lit(2**63 - 1)))).alias("sources"))
    return runs.mapInArrow(lean(_merged(least)), "d bigint, th bigint, sources array<bigint>, spans array<struct<start: int, end: int>>")


def _cut(keep: list[str], text: str, spans: str):
    import re

    word = re.compile(rb"[^\x20\x09-\x0d]+")

    def run(batches):
        for b in batches:
            out = []
            at_text, at_spans = b.schema.get_field_index(text), b.schema.get_field_index(spans)
            for t, s in zip(b.column(at_text).cast(pa.binary()).to_pylist(), b.column(at_spans).to_pylist(), strict=True):
                if s:
                    # what stands between the end of the last word kept and the span's end goes
                    where = [m.span() for m in word.finditer(t)]
                    parts, last = [], 0
                    for x in s:
                        parts.append(t[last : where[x["start"]][0]])
                        last = where[x["end"]][0] if x["end"] < len(where) else len(t)
                    parts.append(t[last:])
                    t = b"".join(parts)
                out.append(None if t is None else t.decode("utf-8"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text else b.column(b.schema.get_field_index(c)) for c in keep], names=keep)

    return run


def remove_repeats(docs: DataFrame, text: str = "text", id: str = "doc_id", least: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """``docs`` with every passage of at least ``least`` words that occurs earlier taken out of its texts.

    All rows and columns stay; what remains of a text is unchanged, and a text may become empty.
    """
    scratch = Scratch(docs.sparkSession)
    spans = repeated_spans(docs, scratch, text, id, least, gram).drop("sources")
    names = {n: free_name(docs, n + "_of_repeat") for n in ("d", "th", "spans")}
    spans = spans.withColumnsRenamed(names)
    d, th = _key(docs, id, text)
    joined = docs.join(spans, (d == F.col(names["d"])) & (th == F.col(names["th"])), "left").drop(names["d"], names["th"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(lean(_cut(docs.columns, text, names["spans"])), schema)


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` with the words that repeat earlier passages of 50 words or more.

    doc_id, n_spans, n_repeated_words, spans (words [start, end) at ASCII white space; null: none) and
    sources, the ids of the documents in which these passages occur first.
    """
    docs, scratch = table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark)
    spans = repeated_spans(docs, scratch)
    d, th = _key(docs, "doc_id", "text")
    own = docs.select("doc_id", d.alias("doc_d"), th.alias("doc_th"))
    out = own.join(spans, (F.col("doc_d") == F.col("d")) & (F.col("doc_th") == F.col("th")), "left")
    words = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", F.coalesce(F.size("spans"), F.lit(0)).cast("int").alias("n_spans"), F.coalesce(words, F.lit(0)).cast("long").alias("n_repeated_words"), "spans", "sources")
