"""A table of distinct words and their token ids, and the split of texts into words that encode independently."""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from changeloom.llm.common import coded, ragged, worker_cache

#: White space in the sense of Unicode and of Python: texts are split only next to characters outside this set.
_SPACE = r"\s\x1c-\x1f\x85"
_BOUNDARY = re.compile(rf"(?<=[^{_SPACE}])(?= [^{_SPACE}])|(?<=[^{_SPACE}])(?=\n[^{_SPACE}])|(?<=[^{_SPACE}]\n)(?=[^{_SPACE}])")
#: Texts with other white space than single spaces and line breaks, for Arrow's regular expressions.
_ODD = r"[\x00\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|  | \n|\n[ \n]|^[ \n]|[ \n]$"
#: Words whose letters, case and normal form have been the same in every version of Unicode.
_PLAIN = re.compile("[ \n]?[!-~¡-¬®-ÿ]+|[ \n]")
#: Words of one pre-token.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: A pre-token ends between a letter and one of these signs, whatever stands around them.
_END = ("([A-Za-zÀ-ÖØ-öø-ÿ])([!#$%&*,.|])", "\\1\0\\2")

_loaded: dict[str, tuple] = worker_cache()


def tokenizer(path: str):
    """The tokenizer at path without truncation or padding, and its special strings; one per Python worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = (t, tuple(a.content for a in t.get_added_tokens_decoder().values()))
    return _loaded[path]


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (c for c in range(256) if c not in plain)
    return {c: chr(c) for c in plain} | {c: chr(256 + k) for k, c in enumerate(rest)}


class Splitter:
    """The pre-tokens of a plain word, as the tokenizer's own settings define them; None where the settings aren't known."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        normalizers = told["normalizer"] and told["normalizer"]["normalizers"] or []
        self.lower = any(x["type"] == "Lowercase" for x in normalizers)
        known = all(x["type"] in ("NFC", "Lowercase") or x == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "} for x in normalizers)
        pre = told["pre_tokenizer"]
        steps = pre.get("pretokenizers", [pre])
        split = [x for x in steps if x["type"] == "Split"]
        level = [x for x in steps if x["type"] == "ByteLevel"]
        known &= len(steps) == len(split) + 1 and len(level) == 1 and not level[0]["add_prefix_space"] and told["post_processor"] is None
        if split:
            known &= split[0]["invert"] and split[0]["behavior"] == "Removed" and len(split) == 1
            self.pattern = regex.compile(split[0]["pattern"]["Regex"])
        else:
            import public_tokenizers

            self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.known, self.letters = known, byte_letters()

    def __call__(self, word: str) -> list[str]:
        return self.pattern.findall(word.lower() if self.lower else word)


class WordTable:
    """Distinct words -> ids. Each word is encoded once while it is in the table; beyond `limit` words the table starts anew.

    A word keeps its leading space or line break, so that encoding a text equals the encodings of its words in order. Texts
    that hold a special string, or white space other than single spaces and line breaks, are split more coarsely. Plain words
    go to the library's model by pre-token, each distinct pre-token once; all others go through the whole tokenizer."""

    def __init__(self, path: str, limit: int = 500_000):
        self.tok, self.special = tokenizer(path)
        self.model, self.split = self.tok.model, Splitter(path)
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.parts: dict[str, list[int]] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = 0

    def part(self, text: str) -> list[int]:
        if (ids := self.parts.get(text)) is None:
            letters = self.split.letters
            ids = self.parts[text] = [t.id for t in self.model.tokenize("".join([letters[c] for c in text.encode()]))]
        return ids

    def ids_of(self, new: list[str]) -> list[list[int]]:
        got: list = [None] * len(new)
        if self.split.known:
            spaced = not self.split.lower
            for k, w in enumerate(new):
                if _LETTERS.fullmatch(w, w[0] == " " if w else 0):
                    got[k] = self.part(w if spaced else w.strip(" ").lower())
                elif _PLAIN.fullmatch(w) and not any(s in w for s in self.special):
                    got[k] = [i for p in self.split(w) for i in self.part(p)]
        if rest := [k for k, g in enumerate(got) if g is None]:
            for k, e in zip(rest, self.tok.encode_batch_fast([new[k] for k in rest], add_special_tokens=False), strict=True):
                got[k] = e.ids
        return got

    def add(self, new: list[str]) -> None:
        got = self.ids_of(new)
        lens = np.fromiter(map(len, got), np.int64, len(got))
        n, m, total = len(self.at), len(new), int(lens.sum())
        while len(self.start) < n + m:
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        while len(self.flat) < self.used + total:
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + total] = np.fromiter((i for g in got for i in g), np.int32, total)
        self.start[n : n + m] = self.used + np.cumsum(lens) - lens
        self.size[n : n + m] = lens
        self.used += total
        self.at.update(zip(new, range(n, n + m), strict=True))

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Places in the table of distinct words; new ones are added."""
        said = words.to_pylist()
        if new := [w for w in said if w not in self.at]:
            self.add(new)
        return np.fromiter(map(self.at.__getitem__, said), np.int64, len(said))

    def rough(self, text: str) -> list[str]:
        return [text] if any(s in text for s in self.special) else [w for w in _BOUNDARY.split(text) if w]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: none), one text after the other, and the number of ids of each text."""
        if len(self.at) > self.limit:
            self.clear()
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, _ODD)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s, ignore_case=self.split.lower))
        cut = pc.if_else(odd, "", texts)
        if self.split.known and self.split.lower:
            cut = pc.ascii_lower(cut)
        if self.split.known:
            cut = pc.replace_substring_regex(cut, *_END)
        cut = pc.replace_substring(pc.replace_substring(cut, " ", "\0 "), "\n", "\0\n\0")
        codes, words, lens = coded(pc.split_pattern(cut, "\0"))
        index = self.numbers(words)[codes] if len(codes) else np.zeros(0, np.int64)
        if (rows := np.flatnonzero(odd.to_numpy(zero_copy_only=False))).size:
            codes, words, more = coded(pa.array([self.rough(t) for t in texts.take(pa.array(rows)).to_pylist()], pa.list_(pa.string())))
            starts = np.cumsum(lens) - lens
            starts[rows], lens[rows] = len(index) + np.cumsum(more) - more, more
            index = np.concatenate([index, self.numbers(words)[codes]])[ragged(starts, lens)]
        sizes = self.size[index]
        ids = self.flat[ragged(self.start[index], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(lens)])])
