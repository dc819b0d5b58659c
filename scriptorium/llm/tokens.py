"""Token ids of whole texts, each distinct word encoded once per worker.

The vocabularies in use split a text at white space before they merge anything, so
the ids of a text are the ids of its blank-separated words in order. Words repeat far
more often than texts do; a bounded table from word to ids turns most of the work
into lookups. Vocabularies with other steps than those (:func:`by_words`) encode whole
texts with the library.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: Longer words are encoded but not remembered, so the tables' size has a bound.
_LONGEST = 64
#: Latin letters, then ASCII marks without the apostrophe: the vocabulary always cuts
#: between the two, and lower-cases these letters one by one, as str.lower does.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: A mark that ends in . or , at a word's end: such a run is one token's worth and stays whole.
_RUN = re.compile(r"[^A-Za-z0-9À-ÖØ-öø-ÿ ][.,](?: |\Z)")
_LOWER = re.compile(r"[a-zß-öø-ÿ]+")


# The steps before the merges that :class:`WordEncoder` is made for.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def by_words(path: str) -> bool:
    """Whether the vocabulary file has exactly the steps that :class:`WordEncoder` is made for."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    return found["normalizer"] == NORMALIZER and found["pre_tokenizer"] == PRE_TOKENIZER and found["model"]["type"] == "BPE" and not found["model"].get("dropout")


class TextEncoder:
    """ids of whole texts as little-endian unsigned 32-bit bytes, with any vocabulary file; null texts count as empty."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), 16):
            found = self.full.encode_batch([t or "" for t in texts[at : at + 16]], add_special_tokens=False)
            out += [np.asarray(f.ids, dtype="<u4").tobytes() for f in found]
        return out


class WordEncoder:
    """ids of texts as little-endian unsigned 32-bit bytes.

    Null texts count as empty and give no ids. The table holds words as they stand and
    the parts (small letters, runs of marks) that words are put together from. It starts
    afresh once it would hold over ``most`` entries, which costs time and changes no
    result.
    """

    def __init__(self, path: str, most: int = 700_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        if not by_words(path):
            raise ValueError(f"{path} needs whole texts")
        self.most, self.words = most, {"": b""}
        self.full, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # for letters that are normal and whole already: the same merges without the steps before them
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    @staticmethod
    def _learn(tokenizer, parts: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        for at in range(0, len(parts), 20_000):
            some = parts[at : at + 20_000]
            found = tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids = np.asarray(found.ids, dtype="<u4").tobytes()
            ends = (np.searchsorted(np.asarray(found.word_ids, dtype=np.int64), np.arange(len(some)), side="right") * 4).tolist()
            start = 0
            for part, end in zip(some, ends, strict=True):
                out[part] = ids[start:end]
                start = end
        return out

    def _spell(self, words: list[str]) -> dict[str, bytes]:
        """ids of words not in the table, and of the parts they were put together from."""
        cut = {w: (m[1].lower(), m[2]) for w in words if not _LOWER.fullmatch(w) and (m := _PLAIN.fullmatch(w))}
        new = {p for two in cut.values() for p in two if p not in self.words} | {w for w in words if w not in cut}
        bare = {p for p in new if _LOWER.fullmatch(p)}
        out = self._learn(self.bare, list(bare)) | self._learn(self.full, list(new - bare))
        get = lambda p: self.words[p] if p in self.words else out[p]
        return out | {w: get(a) + get(b) for w, (a, b) in cut.items()}

    @staticmethod
    def _split(text: str | None) -> list[str]:
        """Words of a text; where that cannot change its ids, in small letters and with . and , by themselves."""
        if not text:
            return []
        text = text.replace("\n", " ")
        if _is_latin(text) and "<|" not in text:
            text = text.lower()
            if not _RUN.search(text):
                text = text.replace(", ", " , ").replace(". ", " . ")
                if text[-1] in ".,":
                    text = f"{text[:-1]} {text[-1]}"
        return text.split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        done: list[bytes] = []
        for at in range(0, len(texts), 64):
            split = [self._split(t) for t in texts[at : at + 64]]
            found = [list(map(self.words.get, words)) for words in split]
            gaps = [(ids, words, k) for ids, words in zip(found, split, strict=True) for k in _places(ids)]
            if gaps:
                learned = self._spell(list({words[k] for _, words, k in gaps}))
                for ids, words, k in gaps:
                    ids[k] = learned[words[k]]
                if len(self.words) + len(learned) > self.most:
                    self.words = {"": b""}
                self.words.update(item for item in learned.items() if len(item[0]) <= _LONGEST)
            done += map(b"".join, found)
        return done


def _places(found: list[bytes | None]) -> list[int]:
    """Where a word was not in the table."""
    out, at = [], -1
    for _ in range(found.count(None)):
        out.append(at := found.index(None, at + 1))
    return out


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_encoders: dict[str, WordEncoder | TextEncoder] = {}


def encoder(path: str) -> WordEncoder | TextEncoder:
    """One encoder for each vocabulary and Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path) if by_words(path) else TextEncoder(path)
    return _encoders[path]
