"""Token ids as canonical length-limited Huffman codes.

The file format is a Parquet table of independent blocks.  A block holds whole
documents in ascending doc_id order: their ids and token counts, the coded ids,
and the bit offset of every CHECKPOINT-th id, from which decoding can start; a
table beside it holds the code lengths.  Decoding runs all checkpoints of a block
side by side through one lookup table.

Codes have up to LIMIT bits, or as many as it takes to tell all ids that occur apart.

Cases: null or empty text: the end id alone.  Null doc_ids come first.  Repeated
rows are kept.  Extra columns are not read.  An empty table gives empty files.
A text whose ids alone exceed the 2 GB that a value may have is refused by an error:
it has over 500 million ids, or over a billion with vocabularies of up to 65,536.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import shared_dir, slices, text_array
from cairn.llm.packing import in_order
from cairn.llm.tokens import word_ids

LIMIT = 16
CHECKPOINT = 128
#: A block is closed when it holds so many ids.
BLOCK_IDS = 1 << 18


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most limit bits (more where the ids that occur need them) by package-merge; 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    limit = max(limit, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.int64)
    levels, merged = [], np.zeros(0, dtype=np.int64)
    for _ in range(limit):
        weight = np.concatenate((leaf, merged))
        rank = np.argsort(weight, kind="stable")
        levels.append(rank < len(leaf))  # by place: a leaf, or a package of two places one level down
        weight = weight[rank]
        merged = weight[0 : len(weight) // 2 * 2 : 2] + weight[1 : len(weight) // 2 * 2 : 2]
    take = 2 * len(leaf) - 2
    depth = np.zeros(len(leaf), dtype=np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())  # the cheapest leaves, as each level is sorted
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = depth
    return out


class Code:
    """The canonical code of some lengths: shorter codes first, then smaller ids."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.limit = max(1, int(lengths.max(initial=0)))
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        width = np.int64(1) << (self.limit - self.lengths[order])
        first = np.cumsum(width) - width
        self.codes = np.zeros(len(lengths), dtype=np.int64)
        self.codes[order] = first >> (self.limit - self.lengths[order])
        self.symbol = np.zeros(1 << self.limit, dtype=np.int64)
        filled = np.repeat(order, width)
        self.symbol[: len(filled)] = filled
        self.step = np.maximum(self.lengths[self.symbol], 1)

    def encode(self, ids: np.ndarray, every: int = CHECKPOINT) -> tuple[bytes, np.ndarray]:
        """The bits, padded to whole 32-bit words, and the bit offset of every so-manieth id."""
        size = self.lengths[ids]
        end = np.cumsum(size)
        at = end - size
        words = int(end[-1] + 31) // 32 if len(ids) else 0
        slot = at >> 5
        wide = self.codes[ids] << (64 - size - (at & 31))  # size + 31 bits at most from the top
        high, low = (wide >> 32) & 0xFFFFFFFF, wide & 0xFFFFFFFF
        # codes do not overlap, so sums are unions of bits; all below 2**32 and exact
        bits = np.bincount(slot, weights=high, minlength=words + 1) + np.concatenate(([0.0], np.bincount(slot, weights=low, minlength=words + 1)[:-1]))
        return bits[:words].astype(np.uint64).astype(">u4").tobytes(), at[::every].astype(np.int64)

    def decode(self, payload: bytes, offsets: np.ndarray, n: int, every: int = CHECKPOINT) -> np.ndarray:
        """The n ids; every checkpoint is a lane."""
        if not n:
            return np.zeros(0, dtype=np.int64)
        raw = np.frombuffer(payload, dtype=">u4").astype(np.int64)
        raw = np.concatenate((raw, np.zeros(3, dtype=np.int64)))
        pairs = (raw[:-1] << 32) | raw[1:]
        at = offsets.astype(np.int64).copy()
        out = np.empty((len(at), every), dtype=np.int64)
        mask, top = (1 << self.limit) - 1, len(pairs) - 1
        for k in range(every):
            seen = (pairs[np.minimum(at >> 5, top)] >> (64 - self.limit - (at & 31))) & mask
            out[:, k] = self.symbol[seen]
            at += self.step[seen]
        return out.ravel()[:n]


def _encoded(docs: DataFrame, tokenizer: str, end_id: int, kind: str) -> DataFrame:
    """doc_id and the ids of each document, in the narrowest type."""
    import pyarrow.compute as pc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                ids, of = words.encode_all(text_array(batch.column("text")))
                ended = np.insert(ids, of[1:], end_id).astype(kind)
                of = (of + np.arange(len(of))) * ended.itemsize
                if of[-1] < 1 << 31:
                    raw = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(of.astype(np.int32)), pa.py_buffer(ended)])
                else:  # one text beyond 2 GB of ids
                    raise ValueError("a text's ids exceed the 2 GB of an Arrow value")
                yield pa.RecordBatch.from_arrays([pc.cast(batch.column("doc_id"), pa.int64()), raw], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def id_counts(encoded: DataFrame, kind: str) -> np.ndarray:
    """How often each id occurs in all documents; at most one row per id reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)

        def add(ids: np.ndarray) -> None:
            nonlocal total
            more = np.bincount(ids, minlength=len(total))
            more[: len(total)] += total
            total = more

        for batch in batches:
            raw = [x.as_buffer() for x in batch.column("ids")]
            for x in raw:
                if len(x) > 1 << 16:
                    add(np.frombuffer(x, dtype=kind))
            add(np.frombuffer(b"".join(x for x in raw if len(x) <= 1 << 16), dtype=kind))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    got = encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(got["id"].max()) + 1 if len(got) else 1, dtype=np.int64)
    out[got["id"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    return out


BLOCK = "part long, block long, first long, n_ids long, doc_ids array<long>, doc_tokens array<long>, checkpoints array<long>, payload binary"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, limit: int = LIMIT) -> None:
    """Code all documents, each with end_id appended, into path."""
    spark = docs.sparkSession
    kind = word_ids(tokenizer).id_type()
    _encoded(docs, tokenizer, end_id, kind).write.option("compression", "zstd").parquet(f"{path}/ids")
    encoded = spark.read.schema("doc_id long, ids binary").parquet(f"{path}/ids")
    lengths = code_lengths(id_counts(encoded, kind), limit)
    spark.createDataFrame([(lengths.tobytes(), end_id, CHECKPOINT)], "lengths binary, end_id long, every long").coalesce(1).write.parquet(f"{path}/code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, code, held, docs, block, first = TaskContext.get().partitionId(), Code(lengths), 0, [], 0, 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in docs), dtype=kind)
            payload, at = code.encode(ids)
            row = [[part], [block], [first], [len(ids)], [[d for d, _ in docs]], [[len(x) // np.dtype(kind).itemsize for _, x in docs]], [at], [payload]]
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 3 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)], [x.split()[0] for x in BLOCK.split(", ")])

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                docs.append((doc, ids))
                held += len(ids) // np.dtype(kind).itemsize
                if held >= BLOCK_IDS:
                    yield close()
                    first, block, held, docs = first + held, block + 1, 0, []
        if docs:
            yield close()

    in_order(encoded, "ids").mapInArrow(run, BLOCK).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in the files at path."""
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    row = spark.read.parquet(f"{path}/code").first()
    lengths, every = np.frombuffer(row["lengths"], dtype=np.uint8), row["every"]
    totals = sorted(tuple(x) for x in blocks.groupBy("part").agg(F.sum("n_ids")).collect())  # a row per written file
    base = dict(zip((p for p, _ in totals), accumulate((n for _, n in totals), initial=0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in batches:
            for x in batch.to_pylist():
                ids = code.decode(x["payload"], np.asarray(x["checkpoints"]), x["n_ids"], every).astype("<u4")
                ends = np.cumsum(x["doc_tokens"])
                starts = ends - np.asarray(x["doc_tokens"])
                parts = [ids[a:b] for a, b in zip(starts, ends)]
                cols = [pa.array(x["doc_ids"], pa.int64()), pa.array(starts + (base[x["part"]] + x["first"]), pa.int64()), pa.array(x["doc_tokens"], pa.int64()), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array([p.tolist() for p in parts], pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    # few rows, large ones: keep batches small
    return blocks.select("part", "first", "n_ids", "doc_ids", "doc_tokens", "checkpoints", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/cairn/ids-{uuid.uuid4().hex}"
