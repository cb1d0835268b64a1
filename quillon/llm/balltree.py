"""Hard negatives by branch and bound over ball trees.

Rows (vec_id, label, vector) become trees of up to ``ROWS`` rows each as they are read, without a
shuffle.  A node holds the centre and radius of its rows, so the inner product of an anchor with any
of them lies within ``anchor . centre -+ |anchor| radius``.  Anchors come in blocks; a node is left
out for an anchor if none of its rows can have the right label, if its bounds lie outside the
anchor's window of scores, or if its upper bound is strictly beneath the anchor's current k-th
score (equal scores may still win by a smaller id).  What is left is scored exactly.

Vectors hold whole numbers.  Scores are exact integers, and saturate at the ends of 64 bits.  Rows
without id, label or vector, or with a null or infinite component or one that isn't a number, take
no part.  Vectors of different lengths never meet.  Repeated rows count each as a partner; an
anchor's partners are rows with another id, and a repeated anchor is asked once.  An empty table or
one without anchors gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.blocks import BLOCKS, UNITS, dump, grouped, load, meet
from quillon.llm.shared import frugal, kept

#: Rows of a tree and of a leaf, anchors of a block.
ROWS, LEAF, ANCHORS = 8192, 128, 256
_LOW = np.iinfo(np.int64).min
_FOUND = "anchor binary, target long, partner long, score long"


def usable(vec_id: str = "vec_id", label: str = "label", vector: str = "vector") -> Column:
    """Which rows take part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.coalesce(sound, F.lit(False))


def _bit(labels: np.ndarray) -> np.ndarray:
    """One of 64 bits for each label."""
    h = labels.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.uint64(1) << (h >> np.uint64(58))


def tree(ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """Nodes as a complete binary tree (the children of i are 2 i + 1 and 2 i + 2) over reordered rows."""
    depth = max(0, int(np.ceil(np.log2(max(1, len(ids)) / LEAF))))
    n = 2 ** (depth + 1) - 1
    lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    centre, radius, mask, only = np.zeros((n, x.shape[1])), np.zeros(n), np.zeros(n, np.uint64), np.zeros(n, bool)
    order = np.arange(len(ids))
    hi[0] = len(ids)
    for i in range(n):
        rows = order[lo[i] : hi[i]]
        some = x[rows]
        centre[i] = some.mean(axis=0)
        radius[i] = np.sqrt(((some - centre[i]) ** 2).sum(axis=1).max())
        own = labels[rows]
        mask[i], only[i] = np.bitwise_or.reduce(_bit(own)), (own == own[0]).all()
        if 2 * i + 2 < n:
            half = len(rows) // 2
            if x.shape[1]:
                order[lo[i] : hi[i]] = rows[np.argpartition(some[:, some.var(axis=0).argmax()], half)]
            lo[2 * i + 1], hi[2 * i + 1], lo[2 * i + 2], hi[2 * i + 2] = lo[i], lo[i] + half, lo[i] + half, hi[i]
    small = x.astype(np.int16) if np.abs(x).max(initial=0) < 2**15 else x
    return {"ids": ids[order], "labels": labels[order], "x": small[order], "lo": lo, "hi": hi, "centre": centre, "radius": radius, "mask": mask, "only": only}


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    if np.abs(a).max(initial=0) * np.abs(x).max(initial=0) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    whole = np.array([[int(v) for v in r] for r in a], dtype=object).reshape(a.shape) @ np.array([[int(v) for v in r] for r in x], dtype=object).reshape(x.shape).T
    return np.clip(whole, _LOW + 1, np.iinfo(np.int64).max).astype(np.int64)


class Search:
    """The ``k`` best partners of each query in any number of trees, one tree after the other.

    Query i is anchor ``who[i]`` with the window low[i] .. high[i]; ``same``: partners have the anchor's
    label, else another.  scored counts the exact products made.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, a: np.ndarray, who: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.ids, self.labels, self.a, self.who, self.low, self.high, self.same, self.k = ids, labels, a, who, low, high, same, k
        self.norm, self.bit = np.sqrt((a.astype(np.float64) ** 2).sum(axis=1)), _bit(labels)
        self.top = np.full((len(who), k), _LOW, dtype=np.int64)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.scored = 0

    def visit(self, t: dict[str, np.ndarray]) -> None:
        length = np.sqrt((t["centre"] ** 2).sum(axis=1))
        todo = [(0, np.arange(len(self.who)))]
        while todo:
            i, asks = todo.pop()
            if t["lo"][i] == t["hi"][i]:
                continue
            asks = self._alive(t, i, asks, length[i])
            if not len(asks):
                continue
            if 2 * i + 2 < len(t["lo"]):  # the likelier child is looked at first
                a = self.a[self.who[asks]].mean(axis=0)
                first = int(a @ t["centre"][2 * i + 2] > a @ t["centre"][2 * i + 1])
                todo += [(2 * i + 2 - first, asks), (2 * i + 1 + first, asks)]
            else:
                self._leaf(t, i, asks)
        self._compact()

    def _alive(self, t, i: int, asks: np.ndarray, length: float) -> np.ndarray:
        who = self.who[asks]
        if self.same:
            asks = asks[(self.bit[who] & t["mask"][i]) != 0]
        elif t["only"][i]:
            asks = asks[self.labels[who] != t["labels"][t["lo"][i]]]
        who = self.who[asks]
        mid, far = self.a[who] @ t["centre"][i], self.norm[who] * t["radius"][i]
        slack = 1e-6 + 1e-9 * self.norm[who] * (length + t["radius"][i])
        upper, lower = mid + far + slack, mid - far - slack
        ok = (upper >= self.low[asks]) & (lower <= self.high[asks]) & (upper >= self.top[asks].min(axis=1))
        return asks[ok]

    def _leaf(self, t, i: int, asks: np.ndarray) -> None:
        lo, hi = int(t["lo"][i]), int(t["hi"][i])
        who, back = np.unique(self.who[asks], return_inverse=True)
        score = products(self.a[who], t["x"][lo:hi])
        self.scored += score.size
        ids, labels = t["ids"][lo:hi], t["labels"][lo:hi]
        ok = (self.labels[who][:, None] == labels) == self.same
        ok &= self.ids[who][:, None] != ids
        score, ok = score[back], ok[back] & (score[back] >= self.low[asks][:, None]) & (score[back] <= self.high[asks][:, None])
        both = np.concatenate([self.top[asks], np.where(ok, score, _LOW)], axis=1)
        self.top[asks] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
        q, r = np.nonzero(ok & (score >= self.top[asks].min(axis=1)[:, None]))
        self.found.append((asks[q], score[q, r], ids[r]))
        if sum(len(x[0]) for x in self.found) > 1 << 20:
            self._compact()

    def _compact(self) -> None:
        if self.found:
            q, score, ids = (np.concatenate(x) for x in zip(*self.found))
            order = np.lexsort((ids, -score, q))
            q, score, ids = q[order], score[order], ids[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            self.found = [(q[rank < self.k], score[rank < self.k], ids[rank < self.k])]

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, id) of the best so far."""
        self._compact()
        return self.found[0] if self.found else (np.zeros(0, np.int64),) * 3


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _by_length(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows again in batches of at most ``most`` whose vectors have one length."""
    waiting: dict[int, list[pa.RecordBatch]] = {}
    for b in batches:
        sizes = pc.list_value_length(b.column(column)).to_numpy(zero_copy_only=False)
        for d in np.unique(sizes).tolist():
            here = b.filter(pa.array(sizes == d))
            while here.num_rows:
                have = waiting.setdefault(d, [])
                some = here.slice(0, most - sum(x.num_rows for x in have))
                here = here.slice(some.num_rows)
                have.append(some)
                if sum(x.num_rows for x in have) == most:
                    yield from pa.Table.from_batches(waiting.pop(d)).combine_chunks().to_batches()
    for have in waiting.values():
        yield from pa.Table.from_batches(have).combine_chunks().to_batches()


def trees(rows: DataFrame) -> DataFrame:
    """(unit, length, data): the trees of ``rows`` (vec_id long, label long, vector array<double>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _by_length(batches, 2, ROWS):
            x = _matrix(b.column(2))
            data = dump(**tree(b.column(0).to_numpy(), b.column(1).to_numpy(), x))
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh64_intdigest(data) >> 1], pa.int64()), pa.array([x.shape[1]], pa.int32()), pa.array([data], pa.binary())], ["unit", "length", "data"])

    return rows.select("vec_id", "label", "vector").mapInArrow(frugal(run), "unit long, length int, data binary")


def blocks(anchors: DataFrame) -> DataFrame:
    """(block, length, data): anchors (anchor, vec_id, label, vector, targets) in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _by_length(batches, 3, ANCHORS):
            targets = b.column(4).to_pylist()
            sizes = np.array([len(x) if x is not None else -1 for x in targets], dtype=np.int64)
            a = _matrix(b.column(3))
            data = dump(
                anchor=np.frombuffer(b"".join(b.column(0).to_pylist()), dtype="V16"), ids=b.column(1).to_numpy(), labels=b.column(2).to_numpy(), a=a, sizes=sizes,
                targets=np.array([v for x in targets for v in x or []], dtype=np.int64),
            )
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh64_intdigest(data) >> 1], pa.int64()), pa.array([a.shape[1]], pa.int32()), pa.array([data], pa.binary())], ["block", "length", "data"])

    return anchors.select("anchor", "vec_id", "label", "vector", "targets").mapInArrow(frugal(run), "block long, length int, data binary")


def _meeting(same: bool, k: int, share: tuple[int, int]):
    """Partners of the anchors of some blocks in some trees; a target t stands for scores of at least
    share[0] / share[1] of it and at most itself."""

    def run(units: pa.Table, asks: pa.Table) -> pa.Table:
        out: list[list[pa.Array]] = [[], [], [], []]
        for length, data in zip(asks["length"].to_pylist(), asks["data"]):
            q = load(data.as_py())
            free = q["sizes"] < 0
            who = np.repeat(np.arange(len(free)), np.where(free, 1, q["sizes"]))
            target = np.zeros(len(who), dtype=np.int64)
            target[~free[who]] = q["targets"]
            part = [-((-int(t) * share[0]) // share[1]) for t in target.tolist()]
            low = np.where(free[who], _LOW, np.array(part, dtype=np.int64))
            high = np.where(free[who], np.iinfo(np.int64).max, target)
            s = Search(q["ids"], q["labels"], q["a"], who, low, high, same, k)
            for n, t in zip(units["length"].to_pylist(), units["data"]):
                if n == length:
                    s.visit(load(t.as_py()))
            i, score, ids = s.best()
            rows = (pa.array([x.tobytes() for x in q["anchor"][who[i]]], pa.binary()), pa.array(target[i], pa.int64(), mask=free[who[i]]), pa.array(ids, pa.int64()), pa.array(score, pa.int64()))
            for c, v in zip(out, rows):
                c.append(v)
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.chunked_array(c, k) for c, k in zip(out, kinds)], [x.split()[0] for x in _FOUND.split(", ")])

    return run


def partners(units: tuple[DataFrame, int], anchors: DataFrame, same: bool, k: int, share: tuple[int, int] = (1, 1)) -> DataFrame:
    """(anchor, target, partner, score, rank): the best ``k`` partners of each anchor and target."""
    parts = max(1, -(-anchors.count() // (BLOCKS * ANCHORS)))
    asks = grouped(kept(blocks(anchors.coalesce(parts)), "anchor-blocks"), "block", BLOCKS)
    found = meet(units, asks, _meeting(same, k, share), _FOUND)
    order = Window.partitionBy("anchor", "target").orderBy(F.desc("score"), "partner")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows (vec_id, label, vector): ``usable`` ones.  Each anchor's ``positives`` best rows of its label, and
    for each of those the ``negatives`` best rows of other labels whose score is at least the share
    of the positive's and at most the positive's; equal scores by smaller id.
    """
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    units = grouped(kept(trees(rows), "trees"), "unit", UNITS)
    key = F.unhex(F.md5(F.to_json(F.struct("vec_id", "label", "vector"))))
    anchors = kept(rows.where(is_anchor).withColumn("anchor", key).dropDuplicates(["anchor"]), "anchors")
    near = kept(partners(units, anchors.withColumn("targets", F.lit(None).cast("array<bigint>")), True, positives).drop("target"), "positives")
    targets = near.groupBy("anchor").agg(F.collect_set("score").alias("targets"))
    far = partners(units, anchors.join(targets, "anchor"), False, negatives, share)
    near = near.join(anchors.select("anchor", "vec_id"), "anchor")
    pairs = near.select("anchor", F.col("vec_id").alias("anchor_id"), F.col("partner").alias("positive_id"), F.col("score").alias("target"))
    return pairs.join(far, ["anchor", "target"]).select("anchor_id", "positive_id", "rank", F.col("partner").alias("negative_id"), F.col("target").alias("positive_score"), F.col("score").alias("negative_score"))
