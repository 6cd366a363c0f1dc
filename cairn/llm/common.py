"""Shared plumbing: shared-folder tables, Arrow helpers, vectorised word hashing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import discard, shared_dir  # noqa: F401
from cairn.session import settle as materialize  # noqa: F401

U64 = np.uint64
#: ASCII white space of the word rule [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = U64(0x9E3779B97F4A7C15)
#: Words hashed at a time, which bounds the temporary arrays; bytes up to which a word is hashed by lanes of eight.
WINDOW, LANES = 1 << 17, 64
#: Keys that may count as heavy at most in a skewed join; rows up to which all its keys are broadcast.
HEAVY, SMALL = 50_000, 300_000
#: Copies of one row that one task makes.
CHUNK = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_or_shuffled(df: DataFrame, rows: int, row_bytes: int, limit: int = 16 << 20) -> DataFrame:
    """df with a broadcast hint if rows * row_bytes is within limit, else as it is (a shuffled join)."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def skew_join(rows: DataFrame, keyed: DataFrame, key: list[str], weight: str, n: int, how: str = "inner") -> DataFrame:
    """rows joined with keyed (one row a key, weight: how many of the n rows have it) on key, whatever the skew.

    Keys of more than n / HEAVY rows, of which there are HEAVY at most, are broadcast; the others are
    shuffled, and none of them fills a task.  Up to SMALL rows all keys are broadcast.  weight does not come along.
    """
    known = keyed.drop(weight)
    if n <= SMALL:
        return rows.join(F.broadcast(known), key, how)
    bar = max(1000, n // HEAVY)
    heavy = keyed.filter(F.col(weight) > bar).drop(weight)
    if heavy.isEmpty():
        return rows.join(known, key, how)
    light = rows.join(F.broadcast(heavy.select(*key)), key, "left_anti").join(keyed.filter(F.col(weight) <= bar).drop(weight), key, how)
    return light.unionByName(rows.join(F.broadcast(heavy), key).select(*light.columns))


def row_keys(*names: str) -> tuple[Column, Column]:
    """128 bits that tell rows by these columns (doc_id and text if none are named)."""
    parts = [x for n in names or ("doc_id", "text") for x in (F.col(n).isNull(), F.col(n))]
    return F.xxhash64(*parts), F.xxhash64(F.lit(7), *parts[::-1])


def repeated(df: DataFrame, times: str, number: str) -> DataFrame:
    """Every row as often as times says, numbered from 0; the copies of a row of many are dealt over tasks."""
    few = df.filter(F.col(times).between(1, CHUNK)).withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1)))
    many = df.filter(F.col(times) > CHUNK).withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(CHUNK).cast("long"))))
    many = many.repartition(number).withColumn(number, F.explode(F.sequence(F.col(number), F.least(F.col(number) + CHUNK, F.col(times)) - 1)))
    return few.unionByName(many)


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Texts with nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their int64 offsets, from 0."""
    texts = texts.cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[off[0] : off[-1]] if raw is not None and len(texts) else np.zeros(0, np.uint8)
    return data, (off - off[0] if len(off) else np.zeros(1, np.int64))


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows holding about limit bytes of text each (one row at least)."""
    if batch.num_rows:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shift and multiply twice."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each text, and the index of each text's first word (with a last end)."""
    solid = ~SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    full = np.flatnonzero(off[1:] > off[:-1])
    first[off[full]] = solid[off[full]]
    last[off[full + 1] - 1] = solid[off[full + 1] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word with A-Z lower-cased, and the index of each text's first word (with a last end).

    Lanes of eight bytes go one by one through a mixing function that is one to one, so that words of up to
    eight bytes and equal length never collide; words beyond LANES bytes are hashed by BLAKE2.
    """
    start, end, of = word_spans(data, off)
    length = end - start
    out = np.empty(len(start), dtype=np.uint64)
    low = np.concatenate((LOWER[data], np.zeros(8, dtype=np.uint8)))
    eight = np.arange(8)
    for at in range(0, len(start), WINDOW):
        s, n = start[at : at + WINDOW], length[at : at + WINDOW]
        h = mix(n.astype(np.uint64) + BASE)
        live = np.flatnonzero(n <= LANES)
        for k in range(0, LANES, 8):
            live = live[n[live] > k]
            if not len(live):
                break
            lane = low[(s[live] + k)[:, None] + eight].view("<u8")[:, 0]
            over = np.maximum(8 - (n[live] - k), 0).astype(np.uint64) * U64(8)
            h[live] = mix(h[live] * BASE + (lane << over >> over))
        for i in np.flatnonzero(n > LANES):
            h[i] = int.from_bytes(hashlib.blake2b(low[s[i] : s[i] + n[i]].tobytes(), digest_size=8).digest(), "little")
        out[at : at + WINDOW] = h
    return out, of


def int64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)
