"""Embedding near-dedup over hierarchical navigable small-world graphs, one per shard.

Every shard (vectors dealt by a hash of their id) builds a graph in batches: new
points search the graph that stands, meet each other directly, and link to a diverse
choice of what was found.  A shard's beam is found by an audit against planted links: members turned by
a random angle up to the threshold, whose link with the member is known; the beam widens
until TARGET of them are found, and WIDENED times at most, after which the shard counts as
one that no search can be trusted with and is compared outright.

Every vector then queries every shard in lock-step beam searches over blocks of queries.
In each block some queries are audited against brute force besides, and the beam widens
until TARGET of their links to others are found too.  A query whose beam holds little else
than links searches again with a wider one, and beyond the widest is compared with the
shard outright.  Found pairs are verified by cosine in double precision; every block returns
each vector's number of links and a forest of them, and the forests are united to components.

Equal vectors are one vertex with their number, so a group of copies costs what one costs.

Cases: vectors that are null, empty, zero or hold null or non-finite components link
with nothing; vectors link only with those of equal length; a null id has n_links 0 and
component null and counts for nobody; rows that repeat an id are vectors of their own;
extra columns are not read; an empty table gives no rows.  A shard holds SHARD vectors and
SHARD_BYTES of components at most, whatever their length.

Memory: shards with their graphs, and blocks of queries, travel as rows of PIECE bytes, so that the
JVM never holds one whole; a worker holds one shard and the blocks of one lane, gathers HELD bytes
of vectors at a time, and reduces the pairs it finds to counts and a forest as it goes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import materialize, skew_join
from cairn.llm.graph import components
from cairn.llm.topk import usable

#: Vectors, and bytes of components, in a shard at most, shards at least.
SHARD, SHARD_BYTES, SHARDS = 50_000, 64 << 20, 4
#: Queries, and bytes of components, in a block, blocks that one task takes through a graph, tasks at least.
QUERIES, QUERY_BYTES, LANE, TASKS = 4096, 4 << 20, 16, 24
#: Bytes of a row that holds a part of a shard or block, and such rows of a file.
PIECE, FILE = 1 << 20, 4
#: Links of a vector, beam of building and of the first search, how often it doubles before a shard is compared outright.
NEIGHBOURS, BEAM, WIDENED = 16, 48, 4
#: Points that join a graph together at most.
GROWTH = 512
#: Planted links of a shard's audit, queries of a block's audit, share of the links to be found.
PLANTED, AUDIT, TARGET = 300, 32, 0.99
LEVEL = 24
#: Bytes of vectors that are gathered at a time, and so many that they stay in a core's cache; queries that search together.
HELD, CACHED, TOGETHER = 8 << 20, 1 << 19, 512


class Graph:
    """Unit vectors (float32) and, by level, the neighbours of those that reach it."""

    def __init__(self, x: np.ndarray, seed: int = 5):
        self.x = x
        n = len(x)
        r = np.random.default_rng(seed)
        height = np.floor(-np.log(r.random(n)) / np.log(LEVEL)).astype(int) if n else np.zeros(0, int)
        order = np.argsort(-height, kind="stable")
        self.nodes: list[np.ndarray] = []  # by level, vectors in the order of insertion, those of the level above first
        level = 0
        while level == 0 or (height >= level).sum() > LEVEL:
            self.nodes.append(order[: (height >= level).sum()])
            level += 1
        self.links = [np.full((n, 2 * NEIGHBOURS if lv == 0 else NEIGHBOURS), -1, dtype=np.int32) for lv in range(level)]
        self.size: list[int] = [0] * level
        for lv in reversed(range(level)):
            self._build(lv)

    def dump(self) -> bytes:
        return pickle.dumps((self.nodes, self.links, self.size), protocol=5)

    @classmethod
    def load(cls, x: np.ndarray, raw: bytes) -> "Graph":
        out = cls.__new__(cls)
        out.x = x
        out.nodes, out.links, out.size = pickle.loads(raw)
        return out

    def _build(self, level: int) -> None:
        nodes = self.nodes[level]
        above = len(self.nodes[level + 1]) if level + 1 < len(self.nodes) else 0
        done = 0
        while done < len(nodes):
            new = nodes[done : done + min(max(256, done // 2), GROWTH)]
            if done < max(256, above):  # searches of this level start at those of the level above, so these stand first
                near = nodes[: done + len(new)]
                self._join(level, new, [(near, self.x[new] @ self.x[near].T)])
            else:
                ids, score = self.search(self.x[new], BEAM, level)
                self._join(level, new, [(ids, score), (new, self.x[new] @ self.x[new].T)])
            done += len(new)
            self.size[level] = done
        self._reach(level)

    def _reach(self, level: int) -> None:
        """Link what no walk over a level can come to, as all its neighbours chose others, from the nearest neighbour that walks come to."""
        nodes, reached = self.nodes[level], np.zeros(len(self.x), dtype=bool)
        front = self.nodes[level + 1] if level + 1 < len(self.nodes) else nodes[:64]
        while True:
            while len(front):
                reached[front] = True
                front = np.unique(self.links[level][front])
                front = front[(front >= 0) & ~reached[front]]
            lost = nodes[~reached[nodes]]
            if not len(lost):
                return
            near = self.links[level][lost]
            score = np.where((near >= 0) & reached[near], np.einsum("nkd,nd->nk", self.x[near], self.x[lost]), -np.inf)
            known = np.isfinite(score.max(axis=1))
            if known.any():
                front, by = lost[known], near[known, score[known].argmax(axis=1)]
            else:
                some = nodes[reached[nodes]]
                front, by = lost[:1], some[[(self.x[some] @ self.x[lost[0]]).argmax()]]
            order = np.argsort(by, kind="stable")
            front, by = front[order], by[order]
            at = (self.links[level][by] >= 0).sum(axis=1) + np.arange(len(by)) - np.searchsorted(by, by)
            room = int(at.max()) + 1 - self.links[level].shape[1]
            self.links[level] = np.pad(self.links[level], ((0, 0), (0, max(0, room))), constant_values=-1)
            self.links[level][by, at] = front

    def _join(self, level: int, new: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Link new points to a diverse choice of found ones, and those back."""
        width = self.links[level].shape[1]
        m = NEIGHBOURS
        ids = np.concatenate([np.broadcast_to(i, s.shape) for i, s in found], axis=1)
        score = np.concatenate([np.where(np.broadcast_to(i, s.shape) == new[:, None], -np.inf, s) for i, s in found], axis=1)
        if ids.shape[1] > 4 * m:
            top = np.argpartition(-score, 4 * m, axis=1)[:, : 4 * m]
            ids, score = np.take_along_axis(ids, top, 1), np.take_along_axis(score, top, 1)
        step = self._rows(ids.shape[1])
        chosen = np.concatenate([self._diverse(ids[at : at + step], score[at : at + step], m) for at in range(0, len(new), step)])
        self.links[level][new, :m] = chosen
        a = np.repeat(new, m)
        b = chosen.ravel()
        a, b = a[b >= 0], b[b >= 0]
        apart = (self.links[level][b] != a[:, None]).all(axis=1)
        a, b = a[apart], b[apart]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        to, first, many = np.unique(b, return_index=True, return_counts=True)
        nth = np.arange(len(b)) - np.repeat(first, many)
        taken = (self.links[level][to] >= 0).sum(axis=1)
        # lists with room take their links, which stand in front; only those that overflow are chosen anew
        fits = np.repeat(taken + many <= width, many)
        self.links[level][b[fits], (np.repeat(taken, many) + nth)[fits]] = a[fits]
        over = np.flatnonzero(taken + many > width)
        over = over[np.argsort(many[over], kind="stable")]
        at = 0
        while at < len(over):
            # as many lists as may be gathered if all are as long as the last, by rising length
            end = at + max(1, int((np.arange(1, len(over) - at + 1) * (width + many[over[at:]]) <= self._rows()).sum()))
            some, at = over[at:end], end
            own, room = to[some], int(many[some].max())
            more = np.full((len(some), room), -1, dtype=np.int32)
            row = np.repeat(np.arange(len(some)), many[some])
            col = np.arange(len(row)) - np.repeat(np.cumsum(many[some]) - many[some], many[some])
            more[row, col] = a[first[some][row] + col]
            both = np.concatenate((self.links[level][own], more), axis=1)
            near = np.matmul(self.x.take(both, axis=0), self.x[own][:, :, None])[:, :, 0]
            near[both < 0] = -np.inf
            if both.shape[1] > 3 * width:
                top = np.argpartition(-near, 3 * width, axis=1)[:, : 3 * width]
                both, near = np.take_along_axis(both, top, 1), np.take_along_axis(near, top, 1)
            self.links[level][own] = self._diverse(both, near, width)

    def _rows(self, many: int = 1) -> int:
        """Rows of so many vectors each that are gathered at a time."""
        return max(1, HELD // (self.x.itemsize * self.x.shape[1] * max(1, many)))

    def _diverse(self, ids: np.ndarray, score: np.ndarray, m: int) -> np.ndarray:
        """Up to m of each row: by falling score, those nearer to the row's point than to any taken; then the best others."""
        order = np.argsort(-score, axis=1, kind="stable")
        ids, score = np.take_along_axis(ids, order, 1).astype(np.int32), np.take_along_axis(score, order, 1)
        same = np.zeros(ids.shape, dtype=bool)
        same[:, 1:] = ids[:, 1:] == ids[:, :-1]
        dead = same | ~np.isfinite(score)
        rows = np.arange(len(ids))
        free, taken = ~dead, np.zeros(ids.shape, dtype=bool)
        vectors = self.x.take(ids, axis=0)
        between = np.matmul(vectors, vectors.transpose(0, 2, 1))
        for _ in range(m):
            pick = free.argmax(axis=1)
            on = free[rows, pick]
            if not on.any():
                break
            taken[rows[on], pick[on]] = True
            free &= ~(on[:, None] & (between[rows, pick] > score))
            free[rows, pick] = False
        want = np.where(dead, 3, np.where(taken, 1, 2))
        best = np.argsort(want, axis=1, kind="stable")[:, :m]
        out = np.where(np.take_along_axis(dead, best, 1), -1, np.take_along_axis(ids, best, 1))
        return out if out.shape[1] == m else np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)

    def search(self, q: np.ndarray, beam: int, stop: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the beam of each query on level stop (-1 pads), from the levels above."""
        top = max((lv for lv in range(len(self.nodes)) if self.size[lv]), default=stop)
        start = self.nodes[top][: min(self.size[top], 64)]
        score = q @ self.x[start].T
        ids = np.broadcast_to(start.astype(np.int32), score.shape)
        for lv in range(top, stop - 1, -1):
            ids, score = self._walk(q, ids, score, beam if lv == stop else 8, lv)
        return ids, score

    def _walk(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray, beam: int, level: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        n, size, links = len(q), len(self.x), self.links[level]
        keys = np.full((n, max(beam, ids.shape[1])), PAD)
        keys[:, : ids.shape[1]] = _keys(ids, score)
        keys = np.sort(keys, axis=1)[:, :beam]
        seen = np.zeros(n * size, dtype=bool)
        row, col = np.nonzero(keys < PAD)
        seen[row * size + _places(keys[row, col])] = True
        live = np.arange(n)
        while len(live):
            # the first few of each beam that have not been expanded
            left = (keys[live] & 1) == 0
            row, col = np.nonzero(left & (np.cumsum(left, axis=1, dtype=np.int32) <= step))
            live, row = live[left.any(axis=1)], live[row]
            if not len(live):
                break
            near = links[_places(keys[row, col])]
            keys[row, col] |= 1
            cell = (row[:, None] * size + near)[near >= 0]
            cell = np.sort(cell[~seen[cell]])
            cell = cell[np.diff(cell, prepend=-1) > 0]
            seen[cell] = True
            row = cell // size
            col = cell - row * size
            got = np.empty(len(cell), dtype=np.float32)
            for at in range(0, len(cell), many := max(1, CACHED // (4 * self.x.shape[1]))):
                got[at : at + many] = np.einsum("nd,nd->n", q.take(row[at : at + many], axis=0), self.x.take(col[at : at + many], axis=0))
            new = _keys(col, got)
            better = new < keys[row, -1]
            row, new = row[better], new[better]
            head = np.flatnonzero(np.diff(row, prepend=-1))
            many = np.diff(head, append=len(row))
            more = np.full((len(head), int(many.max(initial=0))), PAD)
            more[np.repeat(np.arange(len(head)), many), np.arange(len(row)) - np.repeat(head, many)] = new
            keys[row[head]] = np.sort(np.concatenate((keys[row[head]], more), axis=1), axis=1)[:, :beam]
        return np.where(keys < PAD, _places(keys), -1).astype(np.int32), np.where(keys < PAD, _scores(keys), -np.inf).astype(np.float32)


#: The key of a free place in a beam.
PAD = np.iinfo(np.int64).max


def _keys(ids: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Integers that sort by falling float32 score, then by id, with a last bit that is set once the vector has been expanded; PAD for id -1."""
    bits = np.ascontiguousarray(score, dtype=np.float32).view(np.int32)
    rising = bits ^ ((bits >> 31) & 0x7FFFFFFF)
    return np.where(ids < 0, PAD, (~rising).astype(np.int64) << 32 | ids.astype(np.int64) << 1)


def _places(keys: np.ndarray) -> np.ndarray:
    return (keys & 0xFFFFFFFF) >> 1


def _scores(keys: np.ndarray) -> np.ndarray:
    rising = ~(keys >> 32).astype(np.int32)
    return (rising ^ ((rising >> 31) & 0x7FFFFFFF)).view(np.float32)


def turned(x: np.ndarray, cosine: np.ndarray, seed: int) -> np.ndarray:
    """Unit vectors at the given cosines from those of x, each in a random direction."""
    aside = np.random.default_rng(seed).normal(size=x.shape)
    aside -= (aside * x).sum(axis=1, keepdims=True) * x
    size = np.linalg.norm(aside, axis=1, keepdims=True)
    aside = np.divide(aside, size, out=np.zeros_like(aside), where=size > 0)
    return (cosine[:, None] * x + np.sqrt(1 - cosine**2)[:, None] * aside).astype(np.float32)


def trusted_beam(graph: Graph, bar: float, seed: int = 0) -> tuple[int, int, int]:
    """The first beam that finds TARGET of the planted links (0: none does), links planted, links found by it."""
    n = len(graph.x)
    some = np.random.default_rng(seed).permutation(n)[:PLANTED]
    planted = turned(graph.x[some], np.linspace(bar, 1, len(some), endpoint=False), seed)
    beam = BEAM
    for _ in range(WIDENED + 1):
        if beam >= n:
            break
        ids, _ = graph.search(planted, beam)
        found = int((ids == some[:, None]).any(axis=1).sum())
        if found >= TARGET * len(some):
            return beam, len(some), found
        beam *= 2
    return 0, len(some), len(some)


def audited(graph: Graph, q: np.ndarray, bar: float, beam: int, seed: int = 0, qid: np.ndarray | None = None, xid: np.ndarray | None = None) -> tuple[int, int, int]:
    """The beam from the given one on that passes the audit of a block (0: none does), audited links, and those found.

    The ids of queries and vectors, if given, keep a query's match with itself out of the audit.
    """
    some = np.random.default_rng(seed).permutation(len(q))[:AUDIT]

    def others(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Links of each audited query to others."""
        return np.bincount(a if qid is None or xid is None else a[qid[some[a]] != xid[b]], minlength=len(some))

    truth, widest = sum(others(a, b) for a, b in _outright(graph, q[some], bar)), BEAM << WIDENED
    while 0 < beam <= widest and beam < len(graph.x):
        ids, score = graph.search(q[some], beam)
        x, y = np.nonzero(score >= bar)
        whole = (score >= bar).sum(axis=1) * 2 <= beam
        wanted, found = int(truth[whole].sum()), int(others(x, ids[x, y])[whole].sum())
        if found >= TARGET * wanted:
            return beam, wanted, found
        beam *= 2
    return 0, int(truth.sum()), int(truth.sum())


def pairs_within(graph: Graph, q: np.ndarray, bar: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, vector) whose float32 cosine reaches bar, as searches of this beam find them (0: compared outright), some at a time."""
    rest, wide, widest = np.arange(len(q)), beam, BEAM << WIDENED
    while len(rest) and 0 < wide <= widest and wide < len(graph.x):
        full = []
        for at in range(0, len(rest), TOGETHER):
            some = rest[at : at + TOGETHER]
            ids, score = graph.search(q[some], wide)
            hit = score >= bar
            many = hit.sum(axis=1) * 2 > wide
            x, y = np.nonzero(hit & ~many[:, None])
            yield some[x], ids[x, y].astype(np.int64)
            full.append(some[many])
        rest, wide = np.concatenate(full), wide * 4
    for x, y in _outright(graph, q[rest], bar):
        yield rest[x], y


def within(graph: Graph, q: np.ndarray, bar: float, beam: int, seed: int = 0, qid: np.ndarray | None = None, xid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int, int]:
    """All pairs_within by searches that pass the audit; audited links, and those found."""
    none = np.zeros(0, int)
    if not len(graph.x) or not len(q):
        return none, none, 0, 0
    beam, wanted, found = audited(graph, q, bar, beam, seed, qid, xid)
    a, b = (np.concatenate(x) for x in zip((none, none), *pairs_within(graph, q, bar, beam)))
    return a, b, wanted, found


def _outright(graph: Graph, q: np.ndarray, bar: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step = max(1, 2 * HELD // (4 * max(1, len(graph.x))))
    for at in range(0, len(q), step):
        a, b = np.nonzero(q[at : at + step] @ graph.x.T >= bar)
        yield a + at, b


class Forest:
    """Of all edges between some nodes those that connect what the edges before them do not."""

    def __init__(self, *nodes: np.ndarray):
        self.nodes = np.unique(np.concatenate(nodes))
        self.root = np.arange(len(self.nodes))
        self.edges: list[tuple[np.ndarray, np.ndarray]] = [(self.nodes[:0], self.nodes[:0])]

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        i, j = np.searchsorted(self.nodes, a), np.searchsorted(self.nodes, b)
        while True:
            apart = self.root[i] != self.root[j]
            i, j = i[apart], j[apart]
            if not len(i):
                return
            # one edge of every node; the others are looked at again once these have been taken
            some = np.union1d(np.unique(i, return_index=True)[1], np.unique(j, return_index=True)[1])
            up: dict[int, int] = {}

            def find(k: int) -> int:
                while (over := up.setdefault(k, k)) != k:
                    up[k] = up[over]
                    k = over
                return k

            keep = np.zeros(len(some), dtype=bool)
            for n, (x, y) in enumerate(zip(self.root[i[some]].tolist(), self.root[j[some]].tolist())):
                x, y = find(x), find(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
                    keep[n] = True
            self.edges.append((self.nodes[i[some[keep]]], self.nodes[j[some[keep]]]))
            now = np.arange(len(self.nodes))
            now[list(up)] = [find(k) for k in list(up)]
            self.root = now[self.root]

    def kept(self) -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate(x) for x in zip(*self.edges))
        return a, b


def near_vectors(vectors: DataFrame, threshold: float = 0.9, shards: int | None = None, with_recall: bool = False) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row; with_recall the audited share of links found, too (null without links)."""
    v = F.col("embedding").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & usable(v) & F.exists(v, lambda x: x != 0)
    hashes = [F.when(ok, h).alias(k) for k, h in (("k1", F.xxhash64(v)), ("k2", F.xxhash64(F.lit(7), v)))]
    as_given = F.col("embedding") if dict(vectors.dtypes)["embedding"] == "array<float>" else v
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), *hashes, as_given.alias("v"))
    made = rows.filter("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("m"), F.first("v").alias("v"))
    good = materialize(made.withColumn("id", F.monotonically_increasing_id()).withColumn("width", F.size("v").cast("long")), "vectors")
    n, cells, total = good.agg(F.count(F.lit(1)), F.coalesce(F.sum("width"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
    shards = shards or max(SHARDS, -(-n // SHARD), -(-cells * 8 // SHARD_BYTES))
    parts = max(1, -(-n // QUERIES), -(-cells * 8 // QUERY_BYTES))
    lanes = max(-(-parts // LANE), min(parts, -(-TASKS // shards)))
    dealt = good.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int"))
    # numbers of partitions are given, as they hold few rows and hours of work, and are not to be put together
    spread = lambda df, many, *keys: df.repartition(min(4 * many, 10_000), *keys)
    in_shards = spread(dealt.select("width", "shard", "id", "m", "v"), shards, "width", "shard").groupBy("width", "shard")
    graphs = materialize(in_shards.applyInArrow(_graphs(threshold), GRAPHS), "graphs", FILE)
    in_parts = spread(dealt.select("width", "part", "id", "v"), parts, "width", "part").groupBy("width", "part")
    asked = materialize(in_parts.applyInArrow(_blocks, BLOCKS), "blocks", FILE)
    met = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("lane", F.pmod("part", F.lit(lanes)))
    ready = graphs.select("width", "shard", "no", "piece", "beam").withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    schema = "id long, other long, links long, wanted long, found long"

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        cols: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 5]

        def give(id_: np.ndarray, other: np.ndarray | int = -1, links: np.ndarray | int = 0, wanted: int = 0, found: int = 0) -> None:
            cols.append([np.broadcast_to(np.asarray(x, dtype=np.int64), np.shape(id_)) for x in (id_, other, links, wanted, found)])

        if left.num_rows and right.num_rows:
            xid, size, flat, links_of = _whole(right)
            x = Units(flat, key[0].as_py())
            graph = Graph.load(x.single(), links_of)
            for part in left.column("part").unique():
                qid, flat = _whole(left.filter(pc.equal(left.column("part"), part)))
                q = Units(flat, key[0].as_py())
                single, bar, links, trees = q.single(), threshold - 1e-5, np.zeros(len(qid), dtype=np.int64), Forest(qid, xid)
                beam, wanted, found = audited(graph, single, bar, right.column("beam")[0].as_py(), qid=qid, xid=xid)
                for a, b in pairs_within(graph, single, bar, beam):
                    for at in range(0, len(a), step := q.rows()):
                        i, j = a[at : at + step], b[at : at + step]
                        linked = (np.einsum("nd,nd->n", q[i], x[j]) >= threshold) & (qid[i] != xid[j])
                        i, j = i[linked], j[linked]
                        np.add.at(links, i, size[j])
                        trees.add(qid[i], xid[j])
                give(qid[links > 0], links=links[links > 0])
                a, b = trees.kept()
                give(a, other=b)
                give(np.array([-1]), wanted=wanted, found=found)
        return pa.table(dict(zip([c.split()[0] for c in schema.split(", ")], (np.concatenate(c) for c in zip(*cols)))))

    keys = ["width", "shard", "lane"]
    pairs = spread(met, shards * lanes, *keys).groupBy(*keys).cogroup(spread(ready, shards * lanes, *keys).groupBy(*keys)).applyInArrow(compare, schema)
    met_all = materialize(pairs, "links")
    joined = components(met_all.filter("other >= 0"), "id", "other", "top").withColumnRenamed("node", "id")
    links = met_all.filter("links > 0").groupBy("id").agg(F.sum("links").alias("links"))
    named = good.select("id", "k1", "k2", "m", "low").join(joined, "id", "left").join(links, "id", "left")
    named = materialize(named.withColumn("top", F.coalesce("top", "id")).withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("m") - 1), "named")
    least = materialize(named.groupBy("top").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("of")), "least")
    named = materialize(skew_join(named, least, ["top"], "of", n).select("k1", "k2", "m", "n_links", "component_id"), "named")
    out = skew_join(rows.select("vec_id", "k1", "k2"), named, ["k1", "k2"], "m", total, "left")
    low = F.coalesce("component_id", "vec_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), low.alias("component_id"), F.col("vec_id").eqNullSafe(low).alias("kept"))
    if with_recall:
        wanted, found = graphs.agg(F.sum("wanted"), F.sum("found")).first()
        more = met_all.filter("id = -1").agg(F.sum("wanted"), F.sum("found")).first()
        wanted, found = (wanted or 0) + (more[0] or 0), (found or 0) + (more[1] or 0)
        out = out.withColumn("recall", F.lit(found / wanted if wanted else None).cast("double"))
    return out


BLOCKS = "width long, part int, no int, piece binary"
GRAPHS = "width long, shard int, no int, piece binary, beam int, wanted long, found long"


class Units:
    """Vectors of one width as they are given, in single precision if that holds them, and as unit vectors in double precision by row."""

    def __init__(self, flat: np.ndarray, width: int):
        self.x = flat.reshape(-1, width)
        self.norm = np.concatenate([np.zeros(0), *(np.linalg.norm(x.astype(np.float64), axis=1) for x in self._some())])

    def rows(self) -> int:
        return max(1, HELD // (8 * self.x.shape[1]))

    def _some(self) -> Iterator[np.ndarray]:
        return (self.x[at : at + self.rows()] for at in range(0, len(self.x), self.rows()))

    def __getitem__(self, rows: np.ndarray | slice) -> np.ndarray:
        return self.x[rows] / self.norm[rows, None]

    def single(self) -> np.ndarray:
        out = np.empty(self.x.shape, dtype=np.float32)
        for at in range(0, len(out), step := self.rows()):
            out[at : at + step] = self[at : at + step]
        return out


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    """The components of all vectors, in single precision if that holds them."""
    flat = np.concatenate([c.flatten().to_numpy() for c in column.chunks])
    if flat.dtype == np.float64:
        with np.errstate(over="ignore"):
            low = flat.astype(np.float32)
        flat = low if np.array_equal(low, flat) else flat
    return flat


def _cut(table: pa.Table, name: str, whole: tuple, **more: int) -> pa.Table:
    """Rows of PIECE bytes that hold whole for the table's width and name; more stands in the first one, beam in all."""
    raw = pickle.dumps(whole, protocol=5)
    pieces = [raw[at : at + PIECE] for at in range(0, len(raw), PIECE)]
    fields = [table.schema.field(c) for c in ("width", name)]
    cols = {f.name: pa.array([table.column(f.name)[0].as_py()] * len(pieces), f.type) for f in fields}
    cols |= {"no": pa.array(range(len(pieces)), pa.int32()), "piece": pa.array(pieces, pa.binary())}
    for k, v in more.items():
        cols[k] = pa.array([v] * len(pieces), pa.int32()) if k == "beam" else pa.array([v] + [0] * (len(pieces) - 1), pa.int64())
    return pa.table(cols)


def _whole(table: pa.Table) -> tuple:
    """What the rows of one shard or block hold."""
    pieces = dict(zip(table.column("no").to_pylist(), (p for c in table.column("piece").chunks for p in c)))
    return pickle.loads(b"".join(pieces[k].as_buffer() for k in range(len(pieces))))


def _graphs(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        flat = _flat(table.column("v"))
        graph = Graph(Units(flat, table.column("width")[0].as_py()).single())
        beam, wanted, found = trusted_beam(graph, threshold)
        return _cut(table, "shard", (table.column("id").to_numpy(), table.column("m").to_numpy(), flat, graph.dump()), beam=beam, wanted=wanted, found=found)

    return run


def _blocks(table: pa.Table) -> pa.Table:
    return _cut(table, "part", (table.column("id").to_numpy(), _flat(table.column("v"))))
