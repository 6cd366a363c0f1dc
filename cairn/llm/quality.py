"""Quality classifier from weak labels.

Heuristic labellers each vote good, bad or nothing on a document.  Expectation-maximisation
over the counts of all vote patterns of the corpus estimates how accurate each is and so the
probability that a document of a pattern is good.  These posteriors label a bounded sample,
the SAMPLE distinct documents (by id and text) of the smallest hashes, on which a logistic
scorer over hashed word shapes is trained; it scores every document.

Cases: null or empty text, or text without words: score 0, rejected.  Null doc_ids and
repeated rows are kept; rows equal in id and text count as often as they occur in the
patterns, and once in the sample; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import U64, buffers, materialize, slices, text_array, word_hashes, word_spans

#: Hashed features, documents that the scorer is trained on at most, share of good documents that EM starts from.
FEATURES, SAMPLE, PRIOR = 512, 6000, 0.8
ABSTAIN, BAD, GOOD = 0, 1, 2
CUTOFF = 0.5
#: Statistic, share from which a labeller votes bad, share up to which it votes good (None: never).
LABELLERS = [
    ("symbols", 0.10, 0.02),  # words that end in two or more of # $ % & *
    ("shouts", 0.15, 0.05),  # words that end in !!
    ("capitals", 0.25, 0.08),  # words of two or more letters, all capitals
    ("bars", 0.08, 0.02),  # words that are |
    ("repeats", 0.08, 0.03),  # words that are the word before them
    ("marked", 0.15, 0.05),  # words with a byte that is neither letter, digit, common punctuation nor beyond ASCII
    ("echoes", 0.20, 0.10),  # words that begin a run of three words seen before in the text
    ("lines", 0.30, None),  # characters of lines of eight or more that stood before in the text
    ("links", 0.10, None),  # words that hold :// or begin with www.
    ("numbers", 0.30, None),  # words without a letter
    ("lengths", 0.15, None),  # words of more than 20 letters, or of one other than a, e, i, o, u, y
]
_CLASS = np.zeros(256, dtype=np.uint8)  # 0 others beyond ASCII and lower case
_CLASS[65:91] = 1
_CLASS[48:58] = 2
for _c in b".,;:'\"()?-":
    _CLASS[_c] = 3
for _c in b"#$%&*":
    _CLASS[_c] = 4
_CLASS[ord("!")] = 5
_CLASS[ord("|")] = 6
for _c in b"+/<=>@[\\]^_`{}~":
    _CLASS[_c] = 7
_LETTER = np.arange(256) >= 128
_LETTER[65:91] = _LETTER[97:123] = True
_VOWEL = np.isin(np.arange(256), list(b"aeiouyAEIOUY"))


def _counts(flags: np.ndarray, of: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[of[1:]] - total[of[:-1]]


def read(data: np.ndarray, off: np.ndarray, judged: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, shares of the labellers' statistics (none unless judged), and the hashed shape of each word with the words' offsets."""
    start, end, of = word_spans(data, off)
    hashes, _ = word_hashes(data, off)
    kind = _CLASS[data]
    length = end - start

    def inside(which: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(which)))
        return total[end] - total[start]

    first, last = kind[start], kind[end - 1]
    before = np.where(length > 1, kind[np.maximum(end - 2, 0)], 0)
    upper, odd = inside(kind == 1), inside((kind >= 4))
    plain = inside((kind == 0) | (kind == 1)) if judged else upper
    inner = np.ones(len(start), dtype=bool)
    inner[of[:-1][of[:-1] < of[1:]]] = False
    same = inner.copy()
    if len(hashes):
        same[1:] &= hashes[1:] == hashes[:-1]
    n, echoes = np.diff(of), _echoes(hashes, of)
    shares = np.zeros((len(n), 0))
    if judged:
        flags = {
            "symbols": (last == 4) & (before == 4),
            "shouts": (last == 5) & (before == 5),
            "capitals": (upper >= 2) & (upper == plain),
            "bars": (first == 6) & (length == 1),
            "repeats": same,
            "marked": odd > 0,
            "echoes": echoes,
            "links": _links(data, start, end),
            "numbers": inside(_LETTER[data]) == 0,
            "lengths": (length > 20) | ((length == 1) & ~_VOWEL[data[start]] & _LETTER[data[start]]),
        }
        counts = [_lines(data, off) if name == "lines" else _counts(flags[name], of) / np.maximum(n, 1) for name, _, _ in LABELLERS]
        shares = np.stack(counts, axis=1)
    shape = np.stack((first, last, before, np.minimum(length, 15), np.minimum(upper, 3), np.minimum(odd, 3), same.astype(np.int64), echoes.astype(np.int64)))
    code = np.zeros(len(start), dtype=np.uint64)
    for row in shape:
        code = (code + row.astype(np.uint64) + U64(1)) * U64(0x9E3779B97F4A7C15)
        code ^= code >> U64(29)
    return n, shares, (code % U64(FEATURES)).astype(np.int64), of


def _links(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each word holds :// or begins with www."""
    out = np.zeros(len(start), dtype=bool)
    for mark, first in ((b"://", False), (b"www.", True)):
        at = np.flatnonzero(data[: max(0, len(data) - len(mark) + 1)] == mark[0])
        for k in range(1, len(mark)):
            at = at[data[at + k] == mark[k]]
        word = np.searchsorted(start, at, side="right") - 1
        ok = (word >= 0) & (at + len(mark) <= end[np.maximum(word, 0)]) if len(start) else np.zeros(len(at), dtype=bool)
        word, at = word[ok], at[ok]
        out[word[start[word] == at] if first else word] = True
    return out


def _lines(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The share of each text's bytes that are in lines of eight or more bytes that stood before in it."""
    out = np.zeros(len(off) - 1)
    for i in np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(data == 10)))[off]) > 0):
        text = data[off[i] : off[i + 1]].tobytes()
        seen, again = set(), 0
        for line in text.split(b"\n"):
            if len(line) >= 8:
                again += len(line) * (line in seen)
                seen.add(line)
        out[i] = again / len(text)
    return out


def _echoes(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hashes), dtype=bool)
    if len(hashes) < 3:
        return out
    runs = hashes[:-2] * U64(3) + hashes[1:-1] * U64(0xBF58476D1CE4E5B9) + hashes[2:] * U64(0x94D049BB133111EB)
    doc = np.repeat(np.arange(len(of) - 1), np.diff(of))
    runs = runs + doc[:-2].astype(np.uint64) * U64(0xD6E8FEB86659FD93)
    order = np.argsort(runs, kind="stable")
    again = np.zeros(len(runs), dtype=bool)
    again[order[1:]] = runs[order[1:]] == runs[order[:-1]]
    out[:-2] = again & (doc[:-2] == doc[2:])
    return out


def votes(n: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """ABSTAIN, BAD or GOOD by text and labeller."""
    out = np.zeros(shares.shape, dtype=np.int64)
    for k, (_, bad, good) in enumerate(LABELLERS):
        out[:, k] = np.where(shares[:, k] >= bad, BAD, np.where(shares[:, k] <= (-1.0 if good is None else good), GOOD, ABSTAIN))
    out[n == 0] = ABSTAIN
    return out


def features(n: np.ndarray, code: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Square roots of the shares of the hashed shapes."""
    doc = np.repeat(np.arange(len(of) - 1), np.diff(of))
    return np.sqrt(np.bincount(doc * FEATURES + code, minlength=len(n) * FEATURES).reshape(len(n), FEATURES) / np.maximum(n, 1)[:, None])


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good by pattern, chance of each vote by labeller and class, and share of good.

    Starts from labellers better than chance, any bad vote telling more than a good one.
    """
    k = patterns.shape[1]
    chance = np.empty((k, 2, 3))
    chance[:, 0] = [0.2, 0.4, 0.4]  # a bad document is bad in some respects only
    chance[:, 1] = [0.1, 0.02, 0.88]
    silent = ~(patterns == GOOD).any(axis=0)  # labellers that never vote good
    chance[silent, 0], chance[silent, 1] = [0.9, 0.09, 0.01], [0.9, 0.01, 0.09]  # silence tells nothing at first
    share, weight, post = PRIOR, counts.astype(np.float64), np.zeros(len(patterns))
    for _ in range(rounds):
        like = np.stack([np.log(chance[np.arange(k), c, patterns]).sum(axis=1) for c in (0, 1)], axis=1)
        like += np.log([1 - share, share])
        post = 1 / (1 + np.exp(like[:, 0] - like[:, 1]))
        share = float(np.clip((weight * post).sum() / max(weight.sum(), 1), 1e-3, 1 - 1e-3))
        for c, w in ((0, weight * (1 - post)), (1, weight * post)):
            for v in range(3):
                chance[:, c, v] = ((patterns == v) * w[:, None]).sum(axis=0) + 0.5
            chance[:, c] /= chance[:, c].sum(axis=1, keepdims=True)
    return post, chance, share


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.05, shrink: float = 1e-4) -> np.ndarray:
    """Weights and, last, the bias of a logistic scorer on soft labels, by Adam on all rows."""
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    w, m, s = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, rounds + 1):
        g = x.T @ (1 / (1 + np.exp(-(x @ w))) - y) / max(len(x), 1) + shrink * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return w


def pattern_code(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def pattern_votes(code: np.ndarray) -> np.ndarray:
    return code[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def train(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The scorer's weights.

    Patterns are counted over all documents with words; the sample distinct documents of the smallest
    hashes of id and text are read again as feature rows to train on.
    """
    place = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                n, shares, _, _ = read(*buffers(text_array(batch.column("text"))))
                yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(n > 0), pa.array(pattern_code(votes(n, shares)).astype(np.int64))], ["place", "some", "pattern"])

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                n, _, code, of = read(*buffers(text_array(batch.column("text"))), judged=False)
                yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array([r.tobytes() for r in features(n, code, of).astype(np.float32)], pa.binary())], ["place", "x"])

    placed = docs.select(place.alias("place"), "text")
    seen = materialize(placed.mapInArrow(vote, "place long, some boolean, pattern long").filter("some").drop("some"), "votes")
    counts = seen.groupBy("pattern").count().orderBy("pattern").toPandas()  # 3 ** len(LABELLERS) rows at most
    if not len(counts):
        return np.zeros(FEATURES + 1)
    code = counts["pattern"].to_numpy(dtype=np.int64)
    posterior, _, _ = expectation_maximisation(pattern_votes(code), counts["count"].to_numpy())
    known = dict(zip(code.tolist(), posterior.tolist()))
    drawn = seen.groupBy("place").agg(F.min("pattern").alias("pattern")).orderBy("place").limit(sample).toPandas()
    label = dict(zip(drawn["place"].tolist(), (known[p] for p in drawn["pattern"].tolist())))
    wanted = placed.filter(F.col("place") <= F.lit(int(drawn["place"].max()))).filter(F.col("text").isNotNull()).dropDuplicates(["place"])
    learnt = wanted.mapInArrow(shape, "place long, x binary").toPandas().sort_values("place")  # some sample rows
    learnt = learnt[learnt["place"].isin(label)]
    x = np.stack([np.frombuffer(r, dtype=np.float32) for r in learnt["x"]])
    return fit_scorer(x.astype(np.float64), np.array([label[p] for p in learnt["place"].tolist()]))


def score_texts(texts: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and score of each text."""
    n, _, code, of = read(*buffers(texts), judged=False)
    # the weighted sum of square roots, feature by feature as documents have them
    doc = np.repeat(np.arange(len(n)), np.diff(of))
    place, many = np.unique(doc * FEATURES + code, return_counts=True)
    value = np.sqrt(many / n[place // FEATURES]) * weights[place % FEATURES]
    logit = np.bincount(place // FEATURES, weights=value, minlength=len(n)) + weights[-1]
    return n, np.where(n > 0, 1 / (1 + np.exp(-logit)), 0.0)


def score(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_words, score, kept of every row."""
    weights = train(docs) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                n, p = score_texts(text_array(batch.column("text")), weights)
                yield pa.RecordBatch.from_arrays([pc.cast(batch.column("doc_id"), pa.int64()), pa.array(n.astype(np.int64)), pa.array(p), pa.array((p >= CUTOFF) & (n > 0))], ["doc_id", "n_words", "score", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, score double, kept boolean")


def keep_good(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """The rows of docs that the classifier keeps, all columns as they are."""
    weights = train(docs) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                n, p = score_texts(text_array(batch.column("text")), weights)
                yield batch.filter(pa.array((p >= CUTOFF) & (n > 0)))

    return docs.mapInArrow(run, docs.schema)
