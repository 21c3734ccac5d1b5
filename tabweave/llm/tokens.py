"""Token ids of whole texts by a public tokenizer file, with each distinct piece encoded once per worker and cache life.

A vocabulary whose pre-tokenizer never joins characters across white space gives the same ids for a text as for its
white-space separated words one after another. ``Encoder`` checks that the file is of this kind (it replaces white
space, splits by a pattern that excludes white space, and has no tokens that take white space along). Arrow tells the
distinct words of a batch and their distinct pieces apart; ids of pieces are kept in a bounded cache, and a full one
becomes the old one, from which what is met again is taken back, so that frequent pieces are never encoded twice. New
pieces go to the library as one string, and the file's suffix marks the last id of each. Words that leave U+0000 to
U+024F, themselves or in lower case, and texts with other white
space than ASCII's go to the library as they are; for all others a test compares the ids of every character of that
range, in several places of a word, with the library's."""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters up to U+024F that are letters or numbers after lower-casing, as the file's \\p{L} and \\p{N} have them.
_LETTERS = "a-zªµºß-öø-ɏ"
_NUMBERS = "0-9²³¹¼-¾"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
_PIECES_OR_END = re.compile(_PIECES.pattern + "|\n")
#: Characters that Python's split or the file's pattern may take for white space, beyond ASCII's six.
_OTHER_WHITE = [chr(c) for c in (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]
#: Letters of that range whose lower case leaves it; words with them go to the library.
_LEAVING = "".join(c for c in map(chr, range(0x250)) if max(map(ord, c.lower())) > 0x24F)
_PLAIN = re.compile(rf"[^{_LEAVING}ɐ-\U0010FFFF]*\Z")
_SUFFIX = "</w>"
_EXPECTED = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    "split": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _take(ids: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of neighbouring groups of ``ids`` those numbered ``which``, one after another, and where each begins and the last ends."""
    total = int(size[which].sum())
    size = size.astype(np.int32 if total < 1 << 31 else np.int64)  # half the memory, but for very large texts
    each = size[which]
    ends = np.concatenate((np.zeros(1, size.dtype), np.cumsum(each, dtype=size.dtype)))
    at = np.repeat((np.cumsum(size, dtype=size.dtype) - size)[which] - ends[:-1], each)
    at += np.arange(total, dtype=size.dtype)
    return ids[at], ends


class Encoder:
    """``encode_batch(texts)`` gives the little-endian ids of each text as bytes of ``dtype``; ``most_words`` distinct words are split at a time."""

    def __init__(self, path: str, most_words: int = 400_000, most_pieces: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.whole = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() < 1 << 16 else "<u4")
        self.special = [t["content"] for t in spec["added_tokens"]]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_word = (
            (spec.get("normalizer") or {}).get("normalizers") == _EXPECTED["normalizer"] and pre[0].get("pattern", {}).get("Regex") == _EXPECTED["split"]
            and len(pre) == 2 and not any(t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]) and spec.get("post_processor") is None
            and spec["model"].get("end_of_word_suffix") == _SUFFIX
        )
        self.pieces, self.old_pieces = {}, {}
        self.most_words, self.most_pieces = most_words, most_pieces
        if self.by_word:  # the same model and byte step for pieces that are already normalised and split, one a line
            lines = {"type": "Split", "pattern": {"String": "\n"}, "behavior": "Removed", "invert": False}
            self.piece = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": spec["pre_tokenizer"] | {"pretokenizers": [lines, pre[1]]}}))
            self.last = np.zeros(self.whole.get_vocab_size(), bool)
            self.last[[i for t, i in spec["model"]["vocab"].items() if t.endswith(_SUFFIX)]] = True

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [self._bytes(e.ids) for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``words`` one after another, and how many each has: all are lower-cased and split as one string, in which each ends in a line feed."""
        joined, odd = "\n".join([*words, ""]), []
        if not _PLAIN.match(joined) or "<|" in joined:
            odd = [k for k, w in enumerate(words) if not _PLAIN.match(w) or "<|" in w]
            special = [np.frombuffer(b, self.dtype) for b in self._whole([words[k] for k in odd])]
            plain = words.copy()
            for k in odd:
                plain[k] = ""
            joined = "\n".join([*plain, ""])
        pieces = pa.array(_PIECES_OR_END.findall(joined.lower()), pa.large_string()).dictionary_encode()
        met, which = pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), pieces.indices.to_numpy()
        own = self._pieces(met)
        ids, ends = _take(np.frombuffer(b"".join(own), self.dtype), np.fromiter(map(len, own), np.int64, len(own)) // self.dtype.itemsize, which)
        size = np.diff(ends[np.flatnonzero(which == met.index("\n"))].astype(np.int64), prepend=0)
        if odd:
            n = np.array([len(x) for x in special])
            ids = np.insert(ids, np.repeat((np.cumsum(size) - size)[odd], n), np.concatenate(special))
            size[odd] = n
        return ids, size

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces; a line feed has none."""
        if len(self.pieces) > self.most_pieces:
            self.old_pieces, self.pieces = self.pieces, {}
        self.pieces["\n"] = b""
        if new := self._unknown(pieces, self.pieces, self.old_pieces):
            self.pieces.update(zip(new, self._library(new), strict=True))
        return list(map(self.pieces.__getitem__, pieces))

    @staticmethod
    def _unknown(keys: Iterable[str], now: dict[str, bytes], old: dict[str, bytes]) -> list[str]:
        """The keys that neither cache has; those of the old one are taken over."""
        new = [k for k in keys if k not in now]
        if old:
            now.update((k, old[k]) for k in new if k in old)
            new = [k for k in new if k not in now]
        return new

    def _library(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces in one call, which are told apart by their last ids."""
        ids = np.array(self.piece.encode_batch_fast(["\n".join(pieces)], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(pieces) or ends[-1] != len(ids):  # a vocabulary that leaves the suffix out somewhere
            return [self._bytes(e.ids) for e in self.piece.encode_batch_fast(pieces, add_special_tokens=False)]
        flat, at = ids.tobytes(), (ends * self.dtype.itemsize).tolist()
        return list(map(flat.__getitem__, map(slice, [0, *at[:-1]], at)))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._whole(texts)
        if any(c in t for t in ("\n".join(texts),) for c in _OTHER_WHITE):
            return [b for t in texts for b in (self._whole([t]) if any(c in t for c in _OTHER_WHITE) else self._by_word([t]))]
        return self._by_word(texts)

    def _by_word(self, texts: list[str]) -> list[bytes]:
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        flat = split.flatten().dictionary_encode()
        met, which = flat.dictionary.to_numpy(zero_copy_only=False).tolist(), flat.indices.to_numpy()
        parts = [self._words(met[k : k + self.most_words]) for k in range(0, len(met), self.most_words)] or [(np.zeros(0, self.dtype), np.zeros(0, np.int64))]
        ids, ends = _take(*map(np.concatenate, zip(*parts, strict=True)), which)
        at, ids = (ends[split.offsets.to_numpy()].astype(np.int64) * self.dtype.itemsize).tolist(), ids.tobytes()
        return list(map(ids.__getitem__, map(slice, at[:-1], at[1:])))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file; Spark reuses workers, so the cache serves many tasks."""
    return Encoder(path)


def text_parts(texts: list[str], most_chars: int = 8 << 20):
    """(first, last) of neighbouring texts with about ``most_chars`` characters."""
    i, size = 0, 0
    for j, t in enumerate(texts):
        if size and size + len(t) > most_chars:
            yield i, j
            i, size = j, 0
        size += len(t)
    if i < len(texts):
        yield i, len(texts)
