"""Secret scans: three rules, and a character convolutional network for what they miss.

Candidates are the rules' findings and what the findings leave of every unbroken run of
SHORTEST or more key characters, in pieces as long, but for plain words: letters of one case
(the first may be a capital) and, at the end, full stops, fewer than WORDLIKE in all.  The
network reads each with its surrounding text; over a long one its window slides, and the
highest score counts.

It is trained here, in numpy, on labelled findings of seeded templates.  Calibration and
threshold come from findings of other formats, which training never saw: the threshold is
the highest that keeps RECALL of the secrets among them.  Findings of the rules stay
whatever it says; it adds spans of kind net, also for findings that it takes for secrets.

Cases: null or empty text: no spans (sha256 of the empty string).  Null doc_ids and
repeated rows are kept; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cairn.llm.common import slices, text_array

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more: what stays of all runs
SHORTEST, WORDLIKE = 12, 24
OTHER = re.compile(rf"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{{{SHORTEST},}}")
PLAIN = re.compile(rf"(?=.{{,{WORDLIKE - 1}}}\Z)(?:[A-Za-z]?[a-z]*|[A-Z]*)\Z", re.DOTALL)
KINDS = ["assign", "access", "hex", "net"]
#: Cheap tests of a text, each true wherever its rule could find something.
HINTS = {"assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]", "access": "AKIA", "hex": "[0-9a-f]{24}", "net": rf"[A-Za-z0-9+/_=.-]{{{SHORTEST}}}"}

BEFORE, INSIDE, AFTER = 20, 40, 8
WIDTH, FILTERS, TAPS = BEFORE + INSIDE + AFTER, 16, 5
#: Steps by which the window goes over a candidate longer than INSIDE, windows scored at a time.
SLIDE, SCORED = 4, 2048
CLASSES = 24
RECALL = 0.97
TRAINED_ON = 5000


def char_classes() -> np.ndarray:
    """Class of each code point below 256; 0 pads, the last class is for all others."""
    out = np.full(256, CLASSES - 1, dtype=np.int64)
    groups = ["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", " ", "\n\t\r", "=", ":", "\"'", "-", "_", "+", "/", ".", ",", "@", "!?", "#$%&*", "()[]{}<>"]
    for i, letters in enumerate(groups, 1):
        for c in letters:
            out[ord(c)] = i
    return out


TABLE = char_classes()


def base_findings(text: str, hints: set[str]) -> list[tuple[int, int, str]]:
    out = []
    if "assign" in hints:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "access" in hints:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if "hex" in hints:
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def other_candidates(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """What the base findings (by start) leave of every run, less plain words."""
    out, first = [], 0

    def add(at: int, end: int) -> None:
        piece = text[at:end].rstrip(".")
        if len(piece) >= SHORTEST and not PLAIN.match(piece):
            out.append((at, at + len(piece)))

    for m in OTHER.finditer(text):
        at, end = m.span()
        while first < len(found) and found[first][1] <= at:
            first += 1
        k = first
        while k < len(found) and found[k][0] < end:
            add(at, found[k][0])
            at = max(at, found[k][1])
            k += 1
        add(at, end)
    return out


def window(text: str, s: int, e: int, at: int | None = None) -> np.ndarray:
    """Classes of the characters around and in a candidate (of a long one INSIDE from at, its start if not given), each part at its own place."""
    a = s if at is None else at
    out = np.zeros(WIDTH, dtype=np.int64)
    for part, at in ((text[max(0, s - BEFORE) : s], None), (text[a : min(e, a + INSIDE)], BEFORE), (text[e : e + AFTER], BEFORE + INSIDE)):
        codes = np.fromiter((TABLE[ord(c)] if ord(c) < 256 else CLASSES - 1 for c in part), dtype=np.int64, count=len(part))
        at = BEFORE - len(part) if at is None else at
        out[at : at + len(part)] = codes
    return out


def windows(text: str, s: int, e: int) -> Iterator[np.ndarray]:
    """Windows that together read the whole candidate; the last ends with it."""
    for at in range(s, max(s + 1, e - INSIDE), SLIDE):
        yield window(text, s, e, at)
    if e - s > INSIDE:
        yield window(text, s, e, e - INSIDE)


HEXES, LOWS, CAPS, DIGITS = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ANY = LOWS + CAPS + DIGITS


class Templates:
    """Invented findings of seeded random: formats to train on, and others to calibrate and set the threshold by."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def pick(self, letters: str, low: int, high: int | None = None) -> str:
        return "".join(self.r.choice(list(letters), low if high is None else int(self.r.integers(low, high))))

    def word(self) -> str:
        return self.pick("etaoinshrdlu" + "etaoin" + LOWS, 2, 10)

    def words(self, low: int, high: int, between: str) -> str:
        return between.join(self.word() for _ in range(int(self.r.integers(low, high))))

    def trained(self, secret: bool) -> str:
        p, d, w, ws = self.pick, lambda n: self.pick(DIGITS, n), self.word, self.words
        if secret:
            makers = [lambda: p(HEXES, int(self.r.choice([32, 40, 64]))), lambda: "AKIA" + p(CAPS + DIGITS, 16), lambda: "ghp_" + p(ANY, 36), lambda: "sk_live_" + p(ANY, 24), lambda: "xoxb-" + d(12) + "-" + p(ANY, 24), lambda: "AIza" + p(ANY + "-_", 35), lambda: "eyJ" + p(ANY, 30) + "." + p(ANY + "-_", 30), lambda: p(ANY + "+/", 30, 60) + "=" * int(self.r.integers(0, 3)), lambda: p(ANY, 18, 44), lambda: p(LOWS + DIGITS, 24, 40), lambda: p(HEXES.upper(), int(self.r.choice([32, 40]))), lambda: p(ANY + "-_", 20, 44), lambda: w() + "_" + p(ANY, 24, 40)]
        else:
            makers = [lambda: ws(3, 6, "-") + d(2), lambda: ws(3, 5, "_") + "_" + d(1), lambda: ws(3, 7, "/") + "/" + d(4) + ".html", lambda: f"20{d(2)}-0{d(1)}-1{d(1)}T1{d(1)}.{d(6)}Z", lambda: w() + d(1) + "." + w() + w() + "." + w(), lambda: ws(3, 5, "") + d(2), lambda: d(4) + "-" + w() + "-" + d(4) + "-" + w(), lambda: f"v{d(1)}.{d(2)}.{d(1)}-{w()}-{w()}-x{d(2)}", lambda: w().upper() + "-" + d(6) + "-" + w().upper() + "-" + d(4), lambda: d(int(self.r.integers(12, 20))), lambda: ".".join(p("123456789", 1) + d(2) for _ in range(4)), lambda: ws(4, 8, ""), lambda: p("-=_.", 1) * int(self.r.integers(12, 60)), lambda: "".join(x.capitalize() for x in ws(3, 6, " ").split()), lambda: ws(2, 5, ".") + "." + w().capitalize() + w().capitalize(), lambda: "/" + ws(3, 8, "/"), lambda: w() + "=" + w() + "_" + w(), lambda: ws(2, 3, "").capitalize() + "." + d(2), lambda: "+" + d(2) + "-" + d(3) + "-" + d(4) + "-" + d(3)]
        return makers[int(self.r.integers(len(makers)))]()

    def held_out(self, secret: bool) -> str:
        p, d, w, ws = self.pick, lambda n: self.pick(DIGITS, n), self.word, self.words
        if secret:
            makers = [lambda: "glpat-" + p(ANY + "-_", 20), lambda: "npm_" + p(ANY, 36), lambda: "SG." + p(ANY + "-_", 22) + "." + p(ANY + "-_", 43), lambda: "hf_" + p(ANY, 34), lambda: p(HEXES, int(self.r.choice([48, 56]))), lambda: "dop_v1_" + p(HEXES, 64), lambda: p(CAPS + LOWS + DIGITS + "/+", 40), lambda: "shpat_" + p(HEXES, 32), lambda: "ya29." + p(ANY + "-_", 60), lambda: p(CAPS + "234567", 32)]
        else:
            makers = [lambda: w() + "".join(x.capitalize() for x in ws(2, 5, " ").split()), lambda: "978-" + d(1) + "-" + d(2) + "-" + d(6) + "-" + d(1), lambda: "IMG_20" + d(6) + "_" + d(6) + ".jpg", lambda: "_".join(x.upper() for x in ws(3, 5, " ").split()), lambda: ws(2, 4, "/") + "/" + ws(2, 3, "_") + ".py", lambda: f"20{d(2)}-0{d(1)}-0{d(1)}/20{d(2)}-1{d(1)}-2{d(1)}", lambda: w() + "-" + d(1) + "." + d(1) + "." + d(1) + ".tar.gz", lambda: w() + "." + w() + "." + ws(2, 3, "-") + ".org", lambda: d(3) + "." + d(3) + "." + d(3) + "-" + d(2), lambda: ws(2, 4, "--")]
        return makers[int(self.r.integers(len(makers)))]()


def examples(n: int, seed: int, held_out: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Labelled findings in invented contexts, secrets and harmless runs by turns."""
    t = Templates(seed)
    leads = ["key is ", "auth: ", "login with ", "pass "] if held_out else ["key: ", "auth=", 'bearer "', "export KEY=", "credential: "]
    x, y = [], []
    for i in range(n):
        secret = i % 2 == 0
        core = ""
        while len(core) < SHORTEST:
            core = (t.held_out if held_out else t.trained)(secret)
        lead = t.words(4, 5, " ") + " "
        if secret and t.r.random() < 0.3:
            lead += str(t.r.choice(leads))
        text = lead + core + str(t.r.choice(["", " ", '"', "\n", ". "])) + t.word()
        at = len(lead)
        if len(core) > INSIDE and t.r.random() < 0.7:  # as the window slides
            at += int(t.r.integers(0, len(core) - INSIDE + 1))
        x.append(window(text, len(lead), len(lead) + len(core), at))
        y.append(secret)
    return np.array(x), np.array(y, dtype=np.float64)


class Network:
    """One convolution over one-hot classes, ReLU, mean and maximum over positions, one linear unit."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"w": r.normal(0, 0.2, (TAPS, CLASSES, FILTERS)), "b": np.zeros(FILTERS), "v": r.normal(0, 0.2, 2 * FILTERS), "c": np.zeros(1)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        n = WIDTH - TAPS + 1
        z = self.p["b"] + sum(self.p["w"][k][x[:, k : k + n]] for k in range(TAPS))
        a = np.maximum(z, 0)
        top = a.argmax(axis=1)
        pooled = np.concatenate((a.mean(axis=1), np.take_along_axis(a, top[:, None], axis=1)[:, 0]), axis=1)
        return pooled @ self.p["v"] + self.p["c"][0], pooled, a, top

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict:
        logit, pooled, a, top = self._forward(x)
        d = (1 / (1 + np.exp(-logit)) - y) / len(x)
        dp = d[:, None] * self.p["v"]
        n = a.shape[1]
        da = np.repeat(dp[:, None, :FILTERS] / n, n, axis=1)
        np.put_along_axis(da, top[:, None], np.take_along_axis(da, top[:, None], axis=1) + dp[:, None, FILTERS:], axis=1)
        da *= a > 0
        w = np.empty_like(self.p["w"])
        for k in range(TAPS):
            hot = x[:, k : k + n].ravel()
            flat = da.reshape(-1, FILTERS)
            w[k] = np.stack([np.bincount(hot, weights=flat[:, f], minlength=CLASSES) for f in range(FILTERS)], axis=1)
        return {"w": w + 1e-4 * self.p["w"], "b": da.sum(axis=(0, 1)), "v": pooled.T @ d + 1e-4 * self.p["v"], "c": np.array([d.sum()])}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, size: int = 128, rate: float = 0.02) -> None:
        r, m, s, t = np.random.default_rng(11), {}, {}, 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for at in range(0, len(x), size):
                t += 1
                for k, g in self._gradient(x[order[at : at + size]], y[order[at : at + size]]).items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    s[k] = 0.99 * s.get(k, 0) + 0.01 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Platt scaling by gradient descent, then the highest threshold that keeps recall."""
        z = self._forward(x)[0]
        for _ in range(500):
            d = 1 / (1 + np.exp(-(self.scale * z + self.shift))) - y
            self.scale -= 0.1 * float((d * z).mean()) / (1 + float((z * z).mean()))
            self.shift -= 0.1 * float(d.mean())
        kept = np.sort(self.score(x)[y == 1])
        self.threshold = float(kept[int(np.floor((1 - recall) * len(kept)))])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        out = [1 / (1 + np.exp(-(self.scale * self._forward(x[a : a + 2048])[0] + self.shift))) for a in range(0, len(x), 2048)]
        return np.concatenate(out) if out else np.zeros(0)


@lru_cache(maxsize=1)
def trained() -> Network:
    """Trained once a process: some seconds."""
    net = Network()
    net.fit(*examples(TRAINED_ON, 1))
    net.calibrate(*examples(TRAINED_ON // 3, 2, True), RECALL)
    return net


def find_all(texts: pa.Array, net: Network) -> list[list[tuple[int, int, str]]]:
    """All spans of each text, by start and then by kind."""
    hints = {k: pc.match_substring_regex(texts, pattern=p).to_numpy(zero_copy_only=False) for k, p in HINTS.items()}
    out: list[list[tuple[int, int, str]]] = [[] for _ in range(len(texts))]
    rows, places, hit = [], [], set()

    def judge() -> None:
        hit.update(p for p, score in zip(places, net.score(np.array(rows))) if score >= net.threshold)
        rows.clear()
        places.clear()

    for i in np.flatnonzero(np.any(list(hints.values()), axis=0)).tolist():
        text = texts[i].as_py()
        out[i] = base_findings(text, {k for k in KINDS if hints[k][i]})
        others = other_candidates(text, out[i]) if hints["net"][i] else []
        for s, e in [x[:2] for x in out[i]] + others:
            for x in windows(text, s, e):
                rows.append(x)
                places.append((i, s, e))
                if len(rows) == SCORED:
                    judge()
    judge()
    for i, s, e in hit:
        out[i].append((s, e, "net"))
    for i in {p[0] for p in hit}:
        out[i].sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return out


def _named(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    net = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = find_all(text_array(batch.column("text")), net)
                counts = [pa.array([sum(x[2] == k for x in spans) for spans in found], pa.int64()) for k in KINDS[:3]]
                digests = [hashlib.sha256(_named([x for x in spans if x[2] != "net"]).encode()).hexdigest() for spans in found]
                yield pa.RecordBatch.from_arrays(
                    [pc.cast(batch.column("doc_id"), pa.int64()), *counts, pa.array(digests, pa.string()), pa.array(list(map(_named, found)), pa.string())],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def cut_out(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """text with every stretch covered by spans replaced by mark."""
    out, at = [], 0
    for s, e, _ in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with secrets replaced in text, and n_chars, if there, counted anew for those rows; other columns as they are."""
    net = trained()
    names, kinds = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = find_all(text_array(batch.column("text")), net)
                hit = [i for i, spans in enumerate(found) if spans]
                if hit:
                    texts = batch.column("text").to_pylist()
                    for i in hit:
                        texts[i] = cut_out(texts[i], found[i])
                    cols = {n: batch.column(j) for j, n in enumerate(names)}
                    cols["text"] = pa.array(texts, cols["text"].type)
                    if "n_chars" in cols:
                        counts = cols["n_chars"].to_pylist()
                        for i in hit:
                            counts[i] = len(texts[i])
                        cols["n_chars"] = pa.array(counts, cols["n_chars"].type)
                    batch = pa.RecordBatch.from_arrays([cols[n] for n in names], names)
                yield batch

    return docs.mapInArrow(run, kinds)
