"""Order-preserving packing of token ids into windows.

Documents follow each other by doc_id.  Cuts between windows are chosen by
dynamic programming: cost is padding plus a penalty for a cut inside a document,
smaller at a sentence end than elsewhere.  With f(j) the least cost of what ends
at cut j, f(j) = penalty(j) + capacity - j + min over i in [j - capacity, j) of
(f(i) + i): a sliding minimum, kept in a monotone queue.  The queue's state goes on from one
stretch of tokens to the next.  Whatever comes later, the best plan runs through one of the
queue's cuts; as far as the plans to all of these agree, windows are given out and forgotten.
What is held is the part on which the queue's plans still differ; once that is HELD tokens, the
plan to the cheapest of its cuts is taken, which may cost a few tokens more than the least.
Up to HELD tokens the cost is the least.  Each task ends with a window that may be short.

Cases: null or empty text: its end id alone.  Null doc_ids come first.  Repeated
rows are packed as often as they occur.  Extra columns are not read.  An empty
table gives no pieces.
"""

from __future__ import annotations

import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import slices, text_array
from cairn.llm.tokens import word_ids

CAPACITY = 4096
SENTENCE_PENALTY, INNER_PENALTY = 4.0, 16.0
#: Where sentences are longer than this, cuts may fall inside them at its multiples.
STRIDE = 64
#: Tokens that are read before windows are given out; tokens without windows at most, which bounds memory.
STRETCH, HELD = 1 << 17, 1 << 22


class Windows:
    """Window ends that cost least, for cuts that come in turn.

    The cost of a window from cut i to cut j is capacity - (j - i) plus the penalty of j.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.at, self.come, self.fee, self.first = array("q", [0]), array("q", [0]), array("d", [0.0]), 0  # places, best predecessors and penalties of the cuts from number first on
        self.queue: deque[tuple[float, int]] = deque([(0.0, 0)])

    def add(self, cuts: np.ndarray, penalty: np.ndarray) -> None:
        """Further cuts, ascending and with no gap over capacity."""
        at, come, queue, capacity, first = self.at, self.come, self.queue, self.capacity, self.first
        self.fee.extend(penalty.tolist())
        for here, fee in zip(cuts.tolist(), penalty.tolist()):
            while at[queue[0][1] - first] < here - capacity:
                queue.popleft()
            low, i = queue[0]
            value = low + capacity + fee  # f(j) + j
            while queue and queue[-1][0] >= value:
                queue.pop()
            queue.append((value, first + len(at)))
            at.append(here)
            come.append(i)

    def _path(self, end: int) -> list[int]:
        out, first = [], self.first
        while end > first:
            out.append(self.at[end - first])
            end = self.come[end - first]
        return out[::-1]

    def agreed(self) -> list[int]:
        """Window ends that every plan through the queue has in common; they are forgotten but for the last."""
        heads = {i for _, i in self.queue}
        while len(heads) > 1:
            last = max(heads)
            heads.remove(last)
            heads.add(self.come[last - self.first])
        root = heads.pop()
        return self._forget(root)

    def cheapest(self) -> list[int]:
        """The window ends of the plan to the queue's cheapest cut; what follows it is planned again."""
        root = min(self.queue, key=lambda x: x[0] - self.at[x[1] - self.first])[1]
        out = self._forget(root)
        later, fee = np.array(self.at[1:], dtype=np.int64), np.array(self.fee[1:])
        del self.at[1:], self.come[1:], self.fee[1:]
        self.queue = deque([(float(self.at[0]), root)])
        self.add(later, fee)
        return out

    def held(self) -> int:
        """Tokens between the first and the last cut."""
        return self.at[-1] - self.at[0]

    def _forget(self, root: int) -> list[int]:
        out, skip = self._path(root), root - self.first
        del self.at[:skip], self.come[:skip], self.fee[:skip]
        self.first = root
        return out

    def rest(self) -> list[int]:
        """The remaining window ends, the last cut being one."""
        return self._path(self.first + len(self.at) - 1)


def window_cuts(cuts: np.ndarray, penalty: np.ndarray, capacity: int) -> list[int]:
    """Indices into cuts (ascending, from 0) of the window ends that cost least, the last being one and free."""
    plan = Windows(capacity)
    plan.add(cuts[1:], penalty[1:])
    return np.searchsorted(cuts, plan.rest()).tolist()


def cut_points(ids: np.ndarray, ends: np.ndarray, stops: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """0 and the places where windows may end, with their penalties: document ends (free), sentence ends, and fill between far ones."""
    kind = np.full(len(ids) + 1, -1, dtype=np.int8)
    kind[[0, len(ids)]] = 2
    kind[np.flatnonzero(stops[np.minimum(ids, len(stops) - 1)]) + 1] = 1
    kind[ends] = 0
    cuts = np.flatnonzero(kind >= 0)
    gaps = np.diff(cuts)
    wide = np.flatnonzero(gaps > stride)
    if len(wide):
        more = np.concatenate([np.arange(cuts[w] + stride, cuts[w + 1], stride) for w in wide])
        kind[more] = 2
        cuts = np.flatnonzero(kind >= 0)
    return cuts, np.array([0.0, SENTENCE_PENALTY, INNER_PENALTY])[kind[cuts]]


class Packer:
    """Takes documents in order, gives pieces (document, start, length, crc32, tokens, window, offset)."""

    def __init__(self, stops: np.ndarray, capacity: int = CAPACITY, stretch: int = STRETCH, most: int = HELD):
        self.stops, self.stretch, self.plan, self.most = stops, max(stretch, capacity), Windows(capacity), most
        self.parts: deque[tuple[object, int, np.ndarray, int, int]] = deque()  # document, start of the part, its ids, tokens of the document, place of the part
        self.fresh: list[tuple[np.ndarray, bool]] = []  # ids without cuts yet, and whether a document ends with them
        self.end, self.cut, self.begin, self.window = 0, 0, 0, 0

    def add(self, doc: object, ids: np.ndarray) -> Iterator[tuple]:
        for at in range(0, len(ids), self.stretch):
            part = ids[at : at + self.stretch]
            self.parts.append((doc, at, part, len(ids), self.end))
            self.fresh.append((part, at + len(part) == len(ids)))
            self.end += len(part)
            if self.end - self.cut >= self.stretch:
                self._cut()
                yield from self._give(self.plan.agreed())
                if self.plan.held() > self.most:
                    yield from self._give(self.plan.cheapest())

    def finish(self) -> Iterator[tuple]:
        if self.end:
            self._cut()
            yield from self._give(self.plan.rest())

    def _cut(self) -> None:
        if self.fresh:
            bounds = np.cumsum([len(x) for x, _ in self.fresh])
            cuts, penalty = cut_points(np.concatenate([x for x, _ in self.fresh]), bounds[[whole for _, whole in self.fresh]], self.stops)
            self.plan.add(cuts[1:] + self.cut, penalty[1:])
            self.fresh, self.cut = [], self.end

    def _give(self, ends: list[int]) -> Iterator[tuple]:
        for end in ends:
            at = self.begin
            while at < end:
                doc, start, ids, tokens, place = self.parts[0]
                to = min(end, place + len(ids))
                yield doc, start + at - place, to - at, zlib.crc32(ids[at - place : to - place].astype("<u4").tobytes()), tokens, self.window, at - self.begin
                at = to
                if to == place + len(ids):
                    self.parts.popleft()
            self.begin = end
            self.window += 1


def in_order(docs: DataFrame, content: str = "text") -> DataFrame:
    """doc_id and content dealt by ranges of doc_id, each in order (repeated ids by content)."""
    key = F.col("doc_id").asc_nulls_first()
    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), content)
    return two.repartitionByRange(key).sortWithinPartitions(key, F.col(content).asc_nulls_first())


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece; window numbers are unique over all partitions (partition number in the high bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        words = word_ids(tokenizer)
        packer = Packer(words.sentence_ends(), capacity)
        end = np.array([end_id], dtype=np.uint32)

        def rows(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found))
            cols[5] = tuple(base + x for x in cols[5])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], NAMES)

        for whole in batches:
            for batch in slices(whole, "text"):
                ids, of = words.encode_all(text_array(batch.column("text")))
                found = []
                for doc, a, b in zip(batch.column("doc_id").to_pylist(), of[:-1], of[1:]):
                    found += packer.add(doc, np.concatenate((ids[a:b], end)))
                if found:
                    yield rows(found)
        if found := list(packer.finish()):
            yield rows(found)

    return in_order(docs).mapInArrow(run, ", ".join(f"{n} long" for n in NAMES))


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
