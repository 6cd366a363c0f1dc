"""Exact token ids of public tokenizers that drop white space, each distinct word encoded once.

Words of plain letters, with or without marks after them, go straight to the library's
merging model; all others through the whole library.  That, and lower-casing A-Z
beforehand, is done only for tokenizers that pass a test of it when they are loaded.
"""

from __future__ import annotations

import gc
import os
import re
from itertools import chain

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs as many workers as there are cores

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
import pyarrow.compute as pc  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from cairn.llm.common import LOWER, buffers  # noqa: E402

#: Distinct words kept by a worker; further ones are encoded again in each batch. Bounds memory only.
KEPT = 300_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


PLAIN = re.compile("([a-zß-öø-ÿ]+)([.,!?;:#$%&*|]*)")
PROBES = ["the", "THE", "été,", "ÜBER!!", "straße.", "thnd***", "a", "ñandú|", "hello?!", "ofthnd$$$", "çà&&&", "zzzzqqqq", "I.", "ÿ:"]


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next one from U+0100."""
    out, spare = [], 256
    for b in range(256):
        shown = 33 <= b < 127 or 161 <= b < 173 or b >= 174
        out.append(chr(b if shown else spare))
        spare += not shown
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run in turn."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class WordIds:
    """Ids of a tokenizer that removes white space: a text's ids are those of its words in turn.

    Words are the parts between ASCII white space; the library itself encodes each distinct one.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.letters = str.maketrans({bytes([b]).decode("latin-1"): c for b, c in enumerate(byte_letters())})
        self.row: dict[str, int] = {}
        self.marks: dict[str, list[int]] = {"": []}
        whole = [self._whole(w) for w in PROBES]
        self.lowers = whole == [self._whole(pc.ascii_lower(w).as_py()) for w in PROBES]
        self.plain = self.lowers and whole == [self._word(pc.utf8_lower(w).as_py()) for w in PROBES]
        self.flat, self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _whole(self, word: str) -> list[int]:
        return self.library.encode(word, add_special_tokens=False).ids

    def _word(self, word: str) -> list[int]:
        """Ids of letters by the merging model, and of marks after them by the library."""
        letters, marks = PLAIN.fullmatch(word).groups()
        if marks not in self.marks:
            if len(self.marks) > KEPT:
                self.marks = {"": []}
            self.marks[marks] = self._whole(marks)
        found = self.library.model.tokenize(letters if letters.isascii() else letters.encode("utf-8").decode("latin-1").translate(self.letters))
        return [t.id for t in found] + self.marks[marks]

    def _learn(self, words: list[str]) -> list[list[int]]:
        out: list = [None] * len(words)
        rest = list(range(len(words)))
        if self.plain:
            cores: dict[str, list[int]] = {}
            rest, merge, letters, known, marks = [], self.library.model.tokenize, self.letters, self.row, self.marks
            for i, m in enumerate(map(PLAIN.fullmatch, words)):
                if m is None:
                    rest.append(i)
                    continue
                core, mark = m.groups()
                ids = cores.get(core)
                if ids is None:
                    if mark and (at := known.get(core, -1)) >= 0:
                        ids = self.flat[self.first[at] : self.first[at] + self.size[at]].tolist()
                    else:
                        ids = [t.id for t in merge(core if core.isascii() else core.encode("utf-8").decode("latin-1").translate(letters))]
                    cores[core] = ids
                if mark:
                    if mark not in marks:
                        self._word("a" + mark)
                    ids = ids + self.marks[mark]
                out[i] = ids
        for a in range(0, len(rest), 8192):
            for i, e in zip(rest[a : a + 8192], self.library.encode_batch_fast([words[i] for i in rest[a : a + 8192]], add_special_tokens=False)):
                out[i] = e.ids
        return out

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's begin (with a last end)."""
        data, off = buffers(texts)
        if self.lowers and not pc.any(pc.match_substring(texts, "<|")).as_py():  # special strings are told by their case
            data = LOWER[data]
        texts = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data)))
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        distinct, at = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        get = self.row.get
        rows = np.fromiter((get(w, -1) for w in distinct), dtype=np.int64, count=len(distinct))
        missing = np.flatnonzero(rows < 0)
        flat, first, size = self.flat, self.first, self.size
        if len(missing):
            words = [distinct[i] for i in missing]
            gc.disable()  # many small lists and no cycles
            each = self._learn(words)
            gc.enable()
            lengths = np.fromiter(map(len, each), dtype=np.int64, count=len(words))
            found = np.fromiter(chain.from_iterable(each), dtype=np.uint32, count=int(lengths.sum()))
            rows[missing] = len(first) + np.arange(len(words))
            first = np.concatenate((first, len(flat) + np.cumsum(lengths) - lengths))
            size, flat = np.concatenate((size, lengths)), np.concatenate((flat, found))
            keep = min(len(words), max(0, KEPT - len(self.row)))
            if keep:
                self.row.update(zip(words[:keep], rows[missing[:keep]].tolist()))
                total = len(self.row)
                self.first, self.size = first[:total], size[:total]
                self.flat = flat[: int(self.first[-1] + self.size[-1])]
        per_word = size[rows][at] if len(at) else np.zeros(0, np.int64)
        ids = flat[ragged(first[rows][at], per_word)] if len(at) else np.zeros(0, np.uint32)
        ends = np.concatenate(([0], np.cumsum(per_word)))
        of = lists.offsets.to_numpy()
        return ids, ends[of - of[0]]

    def sentence_ends(self) -> np.ndarray:
        """By id, whether the token ends a sentence: its last visible character is one of . ! ?"""
        vocabulary = self.library.get_vocab()
        out = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            out[i] = token.removesuffix("</w>")[-1:] in (".", "!", "?")
        return out

    def id_type(self) -> str:
        """The narrowest little-endian type of all ids."""
        return "<u2" if max(self.library.get_vocab().values()) < 1 << 16 else "<u4"


_made: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per worker and file."""
    if path not in _made:
        _made[path] = WordIds(path)
    return _made[path]
