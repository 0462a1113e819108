"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the UTF-8 bytes cuts every text where its content says so, so that texts with
common passages have common chunks. A task encodes each distinct chunk once and keeps it in a
bounded cache under its bytes (no hash can confuse two chunks). Where two chunks meet, the words
around the cut are encoded again together with one more word on either side; these witnesses must
come out with the ids that they had in their chunks, else both chunks are encoded again as one, and so
on until all agree.

Chunks are shared within a task, not over the cluster: sending every chunk to one place and its ids
back would move more bytes than the input has, to save work on the shared part only. The operator
has no shuffle; memory is bounded by a batch and the caches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import WordEncoder, default_path, encoder
from .common import free_name, table

_GEAR = np.random.default_rng(20_240_601).integers(0, 2**32, 256, dtype=np.uint32)
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: bytes of chunks, and of their ids, that a task remembers
CACHE_BYTES = 24_000_000


def cuts(data: np.ndarray, bits: int = 10) -> np.ndarray:
    """Places where a 32-byte gear hash has ``bits`` leading zeros; never inside a character."""
    h = _GEAR[data]
    for w in (1, 2, 4, 8, 16):  # h over 2w bytes from two over w
        h[w:] += h[:-w] << np.uint32(w)
    at = np.flatnonzero(h < np.uint32(1 << (32 - bits))) + 1
    at = at[at < len(data)]
    while len(inside := np.flatnonzero((data[at] & 0xC0) == 0x80)):
        at[inside] += 1
        at = at[at < len(data)]
    return np.unique(at)


class Chunk:
    """A chunk and the ids of its whole words; ``open``: it has none, and is part of a seam.

    ``head`` and ``tail`` are what stands before the first and after the last white space: words
    that may go on in the neighbouring chunks. ``first`` and ``last`` are the outermost whole words,
    the witnesses of a repair.
    """

    __slots__ = ("open", "head", "tail", "first", "last", "middle", "ids")

    def __init__(self, text: bytes):
        space = _SPACE.search(text)
        self.open = space is None
        self.head, self.first, self.middle, self.last, self.tail = text, b"", b"", b"", b""
        self.ids = (b"", b"", b"")
        if self.open:
            return
        body, tail = text[space.start() :], b""
        if body[-1] not in b" \t\n\x0b\x0c\r":
            body, tail = _last(body)
        body = body.strip()
        self.open = not body
        if body:
            self.head, self.tail = text[: space.start()], tail
            self.first, *rest = body.split(None, 1)
            if rest:
                self.middle, self.last = _last(rest[0])

    def outer(self) -> tuple[bytes, bytes]:
        """The last whole word and its ids; they may be empty."""
        return (self.last, self.ids[2]) if self.last else (self.first, self.ids[0])


def _last(body: bytes) -> tuple[bytes, bytes]:
    parts = body.rsplit(None, 1)
    if len(parts) == 2:
        return parts[0], parts[1]
    return b"", parts[0] if parts else b""


class ChunkEncoder:
    """Encodes texts, given as their pieces, chunk by chunk."""

    def __init__(self, enc: WordEncoder, bits: int = 10):
        self.enc, self.bits, self.known, self.size = enc, bits, {}, 0
        self.reused = self.made = self.widened = 0

    def encode(self, texts: list[list[bytes]]) -> list[bytes]:
        """The ids of each text."""
        if self.size > CACHE_BYTES:
            self.known.clear()
            self.size = 0
        new, todo, plans = [], [], []
        for pieces in texts:
            # a plan: chunks, and between them the seams: chunk before, text, chunk after, pieces from and to
            plan, seam, before, start = [], b"", None, 0
            for i, piece in enumerate(pieces):
                c = self.known.get(piece)
                if c is None:
                    c = self.known[piece] = Chunk(piece)
                    self.size += 8 * len(piece)
                    new.append(c)
                else:
                    self.reused += 1
                seam += c.head
                if not c.open:
                    plan += [(before, seam, c, start, i), c]
                    before, seam, start = c, c.tail, i
            plan.append((before, seam, None, start, max(len(pieces) - 1, 0)))
            todo += [b" ".join([x[0].outer()[0] if x[0] else b"", x[1], x[2].first if x[2] else b""]) for x in plan if isinstance(x, tuple) and x[1]]
            plans.append(plan)
        self.made += len(new)
        ids = self.enc.encode([*todo, *(x for c in new for x in (c.first, c.middle, c.last))])
        at = len(todo)
        for c in new:
            c.ids = (ids[at], ids[at + 1], ids[at + 2])
            at += 3
        seams = iter(ids)
        return [self._joined(plan, pieces, seams) for plan, pieces in zip(plans, texts, strict=True)]

    def _joined(self, plan: list, pieces: list[bytes], seams: Iterator[bytes]) -> bytes:
        out, wrong = [], []
        for x in plan:
            if isinstance(x, Chunk):
                out += x.ids
            elif x[1]:
                got = next(seams)
                left = x[0].outer()[1] if x[0] else b""
                right = x[2].ids[0] if x[2] else b""
                # the witnesses must have the ids that they have in their chunks
                if not (got.startswith(left) and got.endswith(right) and len(got) >= len(left) + len(right)):
                    wrong.append(x[3:])
                out.append(got[len(left) : len(got) - len(right)])
        if not wrong:
            return b"".join(out)
        # chunks on both sides of a seam that does not agree become one, until all seams agree
        self.widened += 1
        wider, at = [], 0
        for a, b in wrong:
            if a < at:  # goes on from the one before
                wider[-1] += b"".join(pieces[at : b + 1])
            else:
                wider += [*pieces[at:a], b"".join(pieces[a : b + 1])]
            at = b + 1
        wider += pieces[at:]
        if len(wider) < len(pieces):
            return self.encode([wider])[0]
        return self.enc.encode([b"".join(pieces)])[0]

    def texts(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of each text of a string column."""
        todo, size = [], 0
        for text in column.cast(pa.binary()).to_pylist():
            text = text or b""
            if not self.enc.by_word:
                yield self.enc.encode([text])[0]
                continue
            at = cuts(np.frombuffer(text, dtype=np.uint8), self.bits).tolist()
            todo.append([text[a:b] for a, b in zip([0, *at], [*at, len(text)], strict=True)] if text else [])
            size += len(text)
            if size > 1_500_000:
                yield from self.encode(todo)
                todo, size = [], 0
        yield from self.encode(todo)


def bpe_roundtrip(df: DataFrame, text: str = "text", path: str | None = None, bits: int = 10, digest: bool = False) -> DataFrame:
    """Encodes and decodes every whole text: adds ``ids`` (array<int>) and ``decoded``.

    ``digest``: adds ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` in place of these. Null text
    counts as empty: no ids, empty decoded text. Added columns whose names are taken get an
    underscore. Repeated rows stay; an empty table stays empty.
    """
    path = path or default_path()
    names = {c: free_name(df, c) for c in (("n_tokens", "ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))}
    kinds = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string", "ids": "array<int>", "decoded": "string"}
    kept = [c for c in df.columns if not (digest and c == text)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept] + [f"`{n}` {kinds[c]}" for c, n in names.items()])

    def run(batches):
        chunks = ChunkEncoder(encoder(path), bits)
        enc = chunks.enc
        for b in batches:
            own = [b.column(b.schema.get_field_index(c)) for c in kept]
            if digest:
                n, ids_hex, text_hex = [], [], []
                for ids in chunks.texts(b.column(b.schema.get_field_index(text))):
                    n.append(len(ids) // 4)
                    ids_hex.append(hashlib.sha256(ids).hexdigest())
                    text_hex.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
                new = [pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
            else:
                got = list(chunks.texts(b.column(b.schema.get_field_index(text))))
                new = [
                    pa.array([np.frombuffer(p, dtype="<u4").astype(np.int32) for p in got], pa.list_(pa.int32())),
                    pa.array([enc.decode(p) for p in got], pa.string()),
                ]
            yield pa.RecordBatch.from_arrays([*own, *new], names=[*kept, *names.values()])

    return df.mapInArrow(run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents``: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_roundtrip(docs, digest=True)
