"""A tokenizer file applied piece by piece, with a bounded cache.

For tokenizers of the shape "NFC, collapse white space, lower case; split by a pattern that never
holds white space; byte-level BPE" the ids of a text are those of its words, one after the other.
For any other file every text goes to the library whole.
"""

from __future__ import annotations

import functools
import json
import os
import re
import sys
from array import array

import numpy as np

from .common import CACHES

#: printable Latin-1 and ASCII white space need neither normalisation nor Unicode tables
_ODD = "[^\x09-\x0d -~¡-¬®-ÿ]"
_SPACE = "\x09-\x0d "
_LETTERS = "a-zªµºß-öø-ÿ"
_DIGITS = "0-9²³¹¼-¾"
#: entries of a cache's young half; what is used again while old becomes young
_PIECES = 600_000
#: between texts, and in place of ids between their ids
_NUL, _MARK = "\x00", b"\xff\xff\xff\xff"
#: bytes of easy texts; a byte 0xC2 (other printable Latin-1) takes the longer way
_PLAIN = bytes([*range(9, 14), *range(32, 127), *range(128, 192), 0xC3])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers, equal to the library's."""

    def __init__(self, path: str, most: int = _PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm = [(n.get("type"), n.get("pattern"), n.get("content")) for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        split = (pre[0].get("pattern") or {}).get("Regex", "")
        self.by_word = (
            norm == [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)]
            and len(pre) == 2
            and (pre[0].get("type"), pre[0].get("behavior"), pre[0].get("invert")) == ("Split", "Removed", True)
            and split.endswith("[^\\s\\p{L}\\p{N}]+")
            and (pre[1].get("type"), pre[1].get("add_prefix_space"), pre[1].get("use_regex")) == ("ByteLevel", False, False)
            and spec.get("post_processor") is None
            and not any(a["lstrip"] or a["rstrip"] or a["normalized"] or re.search(r"\s", a["content"]) for a in spec["added_tokens"])
        )
        odd = "|".join([_ODD, *(re.escape(a["content"]) for a in spec["added_tokens"])])
        self.odd = re.compile(odd)
        self.added = [a["content"].encode() for a in spec["added_tokens"]]
        self.odd_word = re.compile(f"([^{_SPACE}]*(?:{odd})[^{_SPACE}]*)")
        # the same pattern over lower-case printable Latin-1, and the marks between texts
        last = split.rfind("|[\\p{L}]+|[\\p{N}]|")
        self.by_word = self.by_word and last >= 0
        self.easy = re.compile(f"\x00|{split[: max(last, 0)]}|[{_LETTERS}]+|[{_DIGITS}]|[^\x00{_SPACE}{_LETTERS}{_DIGITS}]+") if self.by_word else None
        self.plain_decode = spec.get("decoder") is None
        self.names = [self.tok.id_to_token(i) or "" for i in range(max(self.tok.get_vocab().values()) + 1)] if self.plain_decode else []
        # pieces may go to the model many in one text, parted at white space; their ids are told apart by their bytes
        self.bare, end = None, spec.get("model", {}).get("end_of_word_suffix") or ""
        if self.by_word and self.names and spec["model"].get("type") == "BPE":
            self.bare = Tokenizer(self.tok.model)
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.bytes_of = np.array([len(x.removesuffix(end)) for x in self.names])
        self.most = most
        self.pieces: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        many = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        if sys.byteorder == "little" and array("I").itemsize == 4:
            return [array("I", e.ids).tobytes() for e in many]
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in many]

    def _model(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces as ``_easy`` finds them, which need neither normalisation nor splitting."""
        if self.bare is not None:
            some = self.bare.encode_batch_fast(["\n".join(pieces[at : at + 500]) for at in range(0, len(pieces), 500)], add_special_tokens=False)
            ids = np.concatenate([np.asarray(e.ids, "<u4") for e in some])
            at = np.concatenate([[0], np.cumsum(self.bytes_of[ids])])
            ends = np.cumsum([0, *(len(p.encode()) for p in pieces)])
            cut = np.searchsorted(at, ends)
            if at[-1] == ends[-1] and (at[cut] == ends).all() and (self.bytes_of[ids] > 0).all():
                flat, cut = ids.tobytes(), (4 * cut).tolist()
                return [flat[a:z] for a, z in zip(cut, cut[1:])]
        return self._library(pieces)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text."""
        if not self.by_word:
            return self._library([t.decode("utf-8") for t in texts])
        out, todo, size = [], [], 0
        for t in texts:
            todo.append(t)
            size += len(t)
            if size > 1_500_000:
                out += self._some(todo)
                todo, size = [], 0
        return out + self._some(todo) if todo else out

    def _some(self, texts: list[bytes]) -> list[bytes]:
        joined = b"\x00".join(texts)
        left = joined.translate(None, _PLAIN)
        if left.count(b"\x00") == len(texts) - 1 and not left.strip(b"\x00") and not any(a in joined for a in self.added):
            return self._easy(joined.decode("utf-8"))
        # words with other characters go to the library, each on its own
        easy, hard, shape = [], [], []
        for t in texts:
            parts = self.odd_word.split(t.decode("utf-8"))
            easy += parts[::2]
            hard += parts[1::2]
            shape.append(len(parts))
        easy, hard = iter(self._easy(_NUL.join(easy))), iter(self._library(hard))
        return [b"".join(next(hard) if i % 2 else next(easy) for i in range(n)) for n in shape]

    def _easy(self, joined: str) -> list[bytes]:
        found = self.easy.findall(joined.lower())
        if len(self.pieces) > self.most:
            self.old_pieces, self.pieces = self.pieces, {}
        of = self.pieces
        of[_NUL] = _MARK
        missing = set(found).difference(of)
        again = [p for p in missing if p in self.old_pieces]
        of.update(zip(again, map(self.old_pieces.__getitem__, again), strict=True))
        missing = list(missing.difference(again))
        if missing:
            of.update(zip(missing, self._model(missing), strict=True))
        return b"".join(map(of.__getitem__, found)).split(_MARK)

    def decode(self, ids: bytes) -> str:
        """The library's decode(ids, skip_special_tokens=False)."""
        nums = np.frombuffer(ids, dtype="<u4").tolist()
        if self.plain_decode:
            return " ".join(map(self.names.__getitem__, nums))
        return self.tok.decode(nums, skip_special_tokens=False)


@functools.lru_cache(maxsize=2)
def encoder(path: str, most: int = _PIECES) -> WordEncoder:
    """One encoder for each file and size of its cache in a Python worker."""
    return WordEncoder(path, most)


CACHES.append(encoder.cache_clear)
