"""Exact token counts at every prefix of a text, by dynamic programming over byte prefixes.

The last token of a prefix is the one vocabulary entry t that ends there and stands
next to the last token u of what precedes it as byte-pair merging would leave them
(merging u + t gives u, t again); the count is one more than the count there.  That
gives the counts of all prefixes of a piece in one pass, so truncation points and
budgets are looked up and nothing is encoded again.  Pieces are split where the
tokenizer splits; each distinct one is solved once by a worker.

Cases: null or empty text: 0.  Special strings in a text are one token each, as is
the library's default.  Null doc_ids and repeated rows are kept; extra columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from cairn.llm.common import slices, text_array
from cairn.llm.tokens import byte_letters

#: Units and pairs that a worker keeps; beyond, they are solved again. Bounds memory only.
KEPT, KEPT_PAIRS = 500_000, 2_000_000
#: Unicode white space, as the tokenizer's split has it.
BLANK = r"\t-\r \x85\xa0  -     　"
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
RUN = regex.compile(rf"[{BLANK}]+")
CONTRACTIONS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}
UNIT = regex.compile(rf"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
WIDE = "\u0085| | |[ - ]| | | | |　"


class PrefixCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocabulary = set(spec["model"]["vocab"])
        merges = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"])
        self.rank = {m: i for i, m in enumerate(merges)}
        # every end of a vocabulary entry, and whether it is an entry itself
        self.ends = {t[i:]: False for t in self.vocabulary for i in range(len(t))}
        self.ends.update(dict.fromkeys(self.vocabulary, True))
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.letters = str.maketrans({bytes([b]).decode("latin-1"): c for b, c in enumerate(byte_letters())})
        self.beside: dict[tuple[str, str], bool] = {}
        self.known: dict[str, int] = {}
        self.solved: dict[str, int] = {}

    def merged(self, letters: str) -> list[str]:
        """Byte-pair merging, lowest rank first."""
        parts = list(letters)
        while len(parts) > 1:
            low, at = min((self.rank.get((a, b), len(self.rank)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if low == len(self.rank):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, before: str, token: str) -> bool:
        got = self.beside.get((before, token))
        if got is None:
            if len(self.beside) > KEPT_PAIRS:
                self.beside.clear()
            got = self.beside[before, token] = self.merged(before + token) == ([before, token] if before else [token])
        return got

    def piece(self, letters: str) -> list[int]:
        """Counts at the prefixes of 1, 2, ... bytes of one piece."""
        counts, last = [0], [""]
        beside, ends = self.beside, self.ends
        for end in range(1, len(letters) + 1):
            fitting, start = (), end
            # the entries that end here, from the shortest on, as far as any entry goes on
            while start and (known := ends.get(letters[start - 1 : end])) is not None:
                start -= 1
                if known:
                    fitting = (start, *fitting)
            for start in fitting:
                token = letters[start:end]
                got = beside.get((last[start], token))
                if got or (got is None and self.fits(last[start], token)):
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break
        return counts[1:]

    def as_letters(self, text: str) -> str:
        return text.encode("utf-8").decode("latin-1").translate(self.letters)

    def whole(self, piece: str) -> int:
        got = self.solved.get(piece)
        if got is None:
            got = self.piece(self.as_letters(piece))[-1]
            if len(self.solved) < KEPT:
                self.solved[piece] = got
        return got

    def unit(self, text: str) -> int:
        """Tokens of a unit: white space and what follows it, up to the next white space."""
        got = self.known.get(text)
        if got is None:
            got = sum(map(self.whole, SPLIT.findall(text)))
            if len(self.known) < KEPT:
                self.known[text] = got
        return got

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Stretches between special strings, and those."""
        at = 0
        for m in self.specials.finditer(text) if self.specials else ():
            yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        yield text[at:], False

    def count(self, text: str) -> int:
        return sum(1 if special else sum(map(self.unit, UNIT.findall(part))) for part, special in self.parts(text))

    def by_points(self, piece: str) -> list[int]:
        """Counts at the prefixes of a piece by code points."""
        counts = self.piece(self.as_letters(piece))
        return counts if piece.isascii() else [counts[i - 1] for i in accumulate(len(c.encode("utf-8")) for c in piece)]

    def ordinary(self, text: str) -> list[int]:
        """The count of text[:i] for every i from 0, no special strings in it, in one pass.

        A prefix is split like the text but for its end: white space there is one piece, while in the
        text its last blank is not (it goes with what follows, or alone); a contraction is one only when
        it is complete, and before that a mark and a letter.
        """
        out, base, at, lead = [0], 0, 0, ""
        for m in chain(RUN.finditer(text), (None,)):
            start, end = m.span() if m else (len(text), len(text))
            for piece in SPLIT.findall(lead + text[at:start]) if at < start else ():
                counts, skip = self.by_points(piece), len(lead)
                if piece in CONTRACTIONS:
                    mark = self.whole("'")
                    counts = [mark, mark + self.whole(piece[1]), counts[-1]][: len(piece) - 1] + counts[-1:]
                out += [base + c for c in counts[skip:]]
                base += counts[-1]
                lead = ""
            if m:
                blanks = m[0]
                counts = self.by_points(blanks)
                out += [base + c for c in counts]
                if end == len(text):
                    break
                base += counts[-2] if len(blanks) > 1 else 0
                lead = " " if blanks[-1] == " " else ""
                base += 0 if lead else self.whole(blanks[-1])
            at = end
        return out

    def prefixes(self, text: str) -> np.ndarray:
        """The exact token count of text[:i] for every i from 0; a special string counts when it is complete."""
        out, base, parts = [0], 0, list(self.parts(text))
        for k in range(0, len(parts), 2):
            part, special = parts[k][0], parts[k + 1][0] if k + 1 < len(parts) else ""
            counts = self.ordinary(part + special[:-1])
            out += [base + c for c in counts[1:]]
            if special:
                base += counts[len(part)] + 1
                out.append(base)
        return np.array(out, dtype=np.int64)

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix of at most budget tokens."""
        return text[: int(np.flatnonzero(self.prefixes(text) <= budget)[-1])]

    def count_all(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text.

        Where no blank but single spaces precedes a space, units are the parts between spaces,
        with the space before them; such texts are counted by their distinct parts.
        """
        texts = texts.cast(pa.large_string())
        hard = pc.match_substring_regex(texts, "[\\t-\\r ] |" + WIDE)
        for s in self.special:
            hard = pc.or_(hard, pc.match_substring(texts, s))
        hard = hard.to_numpy(zero_copy_only=False)
        out = np.zeros(len(texts), dtype=np.int64)
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        distinct, at, of = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        of = of - of[0]
        easy = ~hard
        later = np.ones(len(at), dtype=bool)
        later[of[:-1]] = False
        used = np.unique(at[later & np.repeat(easy, np.diff(of))])
        size = np.zeros(len(distinct), dtype=np.int64)
        size[used] = [self.unit(" " + distinct[i]) for i in used]
        sizes = np.concatenate(([0], np.cumsum(np.where(later, size[at], 0))))
        out[easy] = (sizes[of[1:]] - sizes[of[:-1]])[easy]
        for i in np.flatnonzero(easy):
            out[i] += self.count(distinct[at[of[i]]])
        for i in np.flatnonzero(hard):
            out[i] = self.count(texts[i].as_py())
        return out


_made: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _made:
        _made[path] = PrefixCounter(path)
    return _made[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = text_array(batch.column("text"))
                n = counter(tokenizer).count_all(texts)
                yield pa.RecordBatch.from_arrays([pc.cast(batch.column("doc_id"), pa.int64()), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def prefix_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and counts, the token count of every prefix by code points, from the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 18):
                rows = [counter(tokenizer).prefixes(t) for t in text_array(batch.column("text")).to_pylist()]
                yield pa.RecordBatch.from_arrays([pc.cast(batch.column("doc_id"), pa.int64()), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, counts array<long>")


def budgets(docs: DataFrame, tokenizer: str, limits: tuple[int, ...] = (128, 1024)) -> DataFrame:
    """doc_id, n_tokens and, for each limit, the code points of the longest prefix within it (within_<limit>), looked up among the counts of all prefixes."""
    names = ["doc_id", "n_tokens", *(f"within_{n}" for n in limits)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 18):
                found = [counter(tokenizer).prefixes(t) for t in text_array(batch.column("text")).to_pylist()]
                cuts = [pa.array([int(np.flatnonzero(x <= n)[-1]) for x in found], pa.int64()) for n in limits]
                yield pa.RecordBatch.from_arrays([pc.cast(batch.column("doc_id"), pa.int64()), pa.array([int(x[-1]) for x in found], pa.int64()), *cuts], names)

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))
