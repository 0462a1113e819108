import hashlib
import re

import numpy as np
from tokenizers import Tokenizer

from gridmark.llm.bpe import WordEncoder, default_path
from gridmark.llm.op06_bpe import ChunkEncoder, bpe_roundtrip, cuts

TEXTS = [
    None, "", " ", "a", "It's the END, they'll re'd 12² it’s", "<|startoftext|>x<|ENDOFTEXT|> <|endoftext|>",
    "x y\u0085z \x1c1\x1d2   é ́a İstanbul ΣΑΣ ＡＢＣ 中文字 😀😀 ´ ` ª º µ ß", "ab" * 3000, "été " * 2000,
    "same passage of words that goes on, " * 60 + "end one", "other start " + "same passage of words that goes on, " * 60 + "tail", "\t\n x\n\n y \r\n",
]


def library(texts):
    tok = Tokenizer.from_file(default_path())
    tok.no_truncation()
    tok.no_padding()
    ids = [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    return ids, [tok.decode(i, skip_special_tokens=False) for i in ids]


def test_words_equal_library():
    enc = WordEncoder(default_path())
    assert enc.by_word
    ids, said = library(TEXTS)
    got = enc.encode([(t or "").encode() for t in TEXTS])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == ids
    assert [enc.decode(g) for g in got] == said


def test_chunks_equal_library_at_any_cut():
    rng = np.random.default_rng(1)
    chunks = ChunkEncoder(WordEncoder(default_path()))
    texts = [t for t in TEXTS if t] * 5
    want = library(texts)[0]
    for text, ids in zip(texts, want, strict=True):
        data = text.encode()
        at = sorted({int(x) for x in rng.integers(0, len(data) + 1, 7)} - {0, len(data)})
        at = [a for a in at if data[a] & 0xC0 != 0x80]
        pieces = [data[a:b] for a, b in zip([0, *at], [*at, len(data)], strict=True)]
        assert np.frombuffer(chunks.encode([pieces])[0], "<u4").tolist() == ids, text[:40]
    assert chunks.reused


def test_cuts_follow_content():
    rng = np.random.default_rng(2)
    body = rng.integers(97, 123, 20_000, dtype=np.uint8)
    a, b = cuts(body), cuts(np.concatenate([rng.integers(97, 123, 777, dtype=np.uint8), body]))
    assert len(a) > 5 and set((a[a > 32] + 777).tolist()) <= set(b.tolist())


def test_frame(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "twice", None), (None, "twice", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    ids, said = library([r[1] for r in rows])
    got = sorted(bpe_roundtrip(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [r.ids_ for r in got] == ids and [r.decoded for r in got] == said
    got = sorted(bpe_roundtrip(df, digest=True).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [r.ids_sha256 for r in got] == [hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest() for i in ids]
    assert [r.decoded_sha256 for r in got] == [hashlib.sha256(s.encode()).hexdigest() for s in said]
    assert bpe_roundtrip(df.limit(0)).count() == 0


def test_latin_letters_and_digits_are_those_of_unicode():
    import unicodedata

    from gridmark.llm import bpe

    enc = WordEncoder(default_path())
    low = [chr(i) for i in range(33, 256) if not enc.odd.search(chr(i)) and chr(i).lower() == chr(i)]
    letters, digits = re.compile(f"[{bpe._LETTERS}]"), re.compile(f"[{bpe._DIGITS}]")
    for c in low:
        kind = unicodedata.category(c)[0]
        assert bool(letters.match(c)) == (kind == "L") and bool(digits.match(c)) == (kind == "N"), c


def test_many_words_equal_library():
    rng = np.random.default_rng(3)
    chars = [chr(i) for i in range(33, 600)] + list("'stremvld'''***  ..") * 15
    words = ["".join(rng.choice(chars, int(rng.integers(1, 12)))) for _ in range(20_000)]
    enc = WordEncoder(default_path())
    text = " ".join(words)
    assert np.frombuffer(enc.encode([text.encode()])[0], "<u4").tolist() == library([text])[0][0]


def test_words_without_ids_at_seams():
    """Lone Unicode spaces are words without ids: alone, in a row, at the ends, at every cut."""
    fixed = ["On dit oui   dit", "x the 　 the", "he said so   said", " ", "    a", "a   　 a a", "a b   b"]
    rng = np.random.default_rng(4)
    words = ["the", "dit", "so", " ", " ", "　", "\u0085", " ", "été", "12"]
    texts = fixed + [" ".join(rng.choice(words, int(rng.integers(1, 14)))) for _ in range(300)]
    want = library(texts)[0]
    chunks = ChunkEncoder(WordEncoder(default_path()), bits=3)
    for text, ids in zip(texts, want, strict=True):
        data = text.encode()
        for cut in ([], *([a] for a in range(1, len(data)) if data[a] & 0xC0 != 0x80)):
            pieces = [data[a:b] for a, b in zip([0, *cut], [*cut, len(data)], strict=True)]
            assert np.frombuffer(chunks.encode([pieces])[0], "<u4").tolist() == ids, (text, cut)


class OfTheWordBefore:
    """Ids that depend on the word before, so that seams disagree."""

    by_word = True

    def __init__(self, depends):
        self.depends = depends

    def encode(self, texts):
        out = []
        for t in texts:
            w = t.split()
            out.append(b"".join((hash((x, w[i - 1] if i and self.depends else b"")) & 0xFFFFFFFF).to_bytes(4, "little") for i, x in enumerate(w)))
        return out


def test_joins_widen_until_they_agree():
    rng = np.random.default_rng(5)
    for depends in (False, True):
        enc = OfTheWordBefore(depends)
        chunks = ChunkEncoder(enc)
        for _ in range(200):
            data = " ".join(rng.choice(["aaa", "bb", "cccc"], int(rng.integers(1, 40)))).encode()
            inside = [i for i in range(1, len(data)) if data[i - 1] != 32 and data[i] != 32]
            at = sorted({inside[int(x)] for x in rng.integers(0, len(inside), 6)})
            pieces = [data[a:b] for a, b in zip([0, *at], [*at, len(data)], strict=True)]
            assert chunks.encode([pieces])[0] == enc.encode([data])[0]
        assert (chunks.widened > 0) == depends


def test_new_pieces_go_to_the_model_together(monkeypatch):
    """Pieces of plain words skip the library's normaliser and splitter; their ids are those of the library."""
    enc = WordEncoder(default_path())
    rng = np.random.default_rng(17)
    letters = "abcdefghijklmnopqrstuvwxyzàéîõüßñç"
    words = ["".join(letters[i] for i in rng.integers(0, len(letters), n)) for n in rng.integers(1, 25, 3000)]
    texts = [" ".join(words), "don't we'll 12 ½ &&& ***", "", "x", "A\tB\nC"]
    want = [np.asarray(enc.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]

    def library(_):
        raise AssertionError("the library was asked")

    monkeypatch.setattr(enc, "_library", library)
    assert enc.encode([t.encode() for t in texts[:1]] + [b"we 12 &&& ***", b""])[0] == want[0]
    monkeypatch.undo()
    assert enc.encode([t.encode() for t in texts]) == want
    # a vocabulary whose names do not add up to the pieces' bytes is left to the library
    enc.bytes_of, enc.pieces, enc.old_pieces = enc.bytes_of + 1, {}, {}
    assert enc.encode([t.encode() for t in texts]) == want
