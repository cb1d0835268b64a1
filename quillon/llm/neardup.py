"""Near-duplicate groups by SetSketch registers.

A document's set is its distinct word shingles.  Its sketch holds, for each of m hash functions,
the smallest hash of the set as an exponential of rate ``RATE``, on the truncated logarithmic
scale of base ``BASE``: register = floor(1 - log_b(minimum)), between 0 and ``LIMIT`` + 1.  Registers
of a union are the larger of each two, so sketches merge; equal registers are likelier the more
two sets overlap, so bands of them find candidates.  For a candidate the number of larger, smaller
and equal registers give the likelihood of a similarity; unlikely pairs go, the rest are compared
on their full sets.

No bucket is expanded into all its pairs.  Equal sets are one class.  In the first round a class
meets the smallest class of each bucket, and is compared with the likeliest of those it shares
most bands with; what is linked then counts as one component.  In the second round the classes that buckets still hold from two or more
components are laid out in blocks, by the groups that such buckets chain together, and every pair
across two components is compared, so no link between components is missed.  Links and components stay in
tables; components come from repeated minimum and pointer steps over them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.shared import frugal, kept, row_key
from quillon.llm.text import Words, mix, rolling, slices, within

SHINGLE = 5
BASE, RATE, LIMIT = 1.001, 20.0, 65534
ROWS = 6
#: Chance that a pair at the threshold shares no band.
MISS = 1e-6
#: Standard errors below the threshold at which an estimate still leads to a comparison.
SLACK = 5.0
#: Shingles, and sets, that are compared together.
BLOCK, MEMBERS = 200_000, 2000
#: Likely partners of a class in the first round; the second covers all others.
PARTNERS = 2
#: Pairs whose registers are judged at once.
PAIRS = 200_000
#: Pairs that are Python numbers at once.
STRETCH = 1 << 16
#: Documents without an id are nodes from here on.
NO_ID = 1 << 62


def bands_for(threshold: float) -> int:
    """Bands needed so that a pair at the threshold is missed with a chance below ``MISS``."""
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


def sets(column: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): distinct shingles of each text, sorted, as one array with row bounds.

    Fewer words than ``width`` make one shingle, none make an empty set.
    """
    w = Words(column, lower=True)
    key = w.key
    n_docs = len(w.count)
    run = rolling(key, width)
    ok = within(w.first, width, len(run))
    docs = [np.repeat(np.arange(n_docs), np.maximum(w.count - width + 1, 0))]
    found = [run[ok]]
    for short in range(1, width):
        at = np.flatnonzero(w.count == short)
        if len(at):
            docs.append(at)
            found.append(mix(rolling(key, short)[w.first[at]] + np.uint64(short)))
    doc, h = np.concatenate(docs), np.concatenate(found)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(n_docs + 1))


def registers(h: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """Register rows (uint16) of non-empty sets given as in ``sets``; first has no repeats."""
    rng = np.random.default_rng(77)
    mult, add = rng.integers(1, 1 << 63, m, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, m, dtype=np.uint64)
    least = np.empty((len(first) - 1, m), dtype=np.float64)
    for i in range(m):
        least[:, i] = np.minimum.reduceat(h * mult[i] + add[i], first[:-1])
    e = -np.log1p(-np.minimum((least + 1.0) / 2.0**64, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(e) / math.log(BASE)), 0, LIMIT + 1).astype("<u2")


def _likelihood_terms(j: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    more, less = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
    return np.log(more), np.log(less), np.log(np.maximum(1 - more - less, 1e-12))


def similarity(more: np.ndarray, less: np.ndarray, m: int, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely similarity of set pairs, jointly from how many of their ``m`` registers are
    larger and smaller, and their sizes."""
    same = m - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)

    def value(j: np.ndarray) -> np.ndarray:
        x, y, z = _likelihood_terms(j, u, v)
        return more * x + less * y + same * z

    g = (math.sqrt(5) - 1) / 2
    for _ in range(24):  # golden section; the likelihood has one maximum
        c, d = hi - g * (hi - lo), lo + g * (hi - lo)
        left = value(c) > value(d)
        lo, hi = np.where(left, lo, c), np.where(left, d, hi)
    return (lo + hi) / 2


SKETCH = "id long, row binary, n_shingles long, c1 long, c2 long, regs binary"


def sketches(docs: DataFrame, m: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, row, n_shingles, the set's 128-bit content key (c1, c2) and its registers for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(2)):
                part = b.slice(lo, hi - lo)
                h, first = sets(part.column(2))
                n = np.diff(first)
                full = n > 0
                c1, c2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                regs = np.empty(len(n), dtype=object)
                if full.any():
                    at = np.append(first[:-1][full], first[-1])
                    c1[full] = np.add.reduceat(mix(h), at[:-1])
                    c2[full] = np.add.reduceat(mix(h ^ np.uint64(0xA5A5A5A55A5A5A5A)), at[:-1])
                    rows = registers(h, at, m)
                    regs[full] = [r.tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n.astype(np.int64)), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), pa.array([r if f else b"" for r, f in zip(regs, full)], pa.binary())],
                    ["id", "row", "n_shingles", "c1", "c2", "regs"],
                )

    return docs.select(F.col(key).cast("long").alias("id"), row_key(key, text).alias("row"), F.col(text)).mapInArrow(frugal(run), SKETCH)


def _band_keys(classes: DataFrame, n_bands: int) -> DataFrame:
    """(node, n_shingles, key) for each class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                regs = np.stack([np.frombuffer(x.as_py(), "<u2") for x in part.column(2)]).reshape(part.num_rows, n_bands, ROWS).astype(np.uint64)
                h = np.broadcast_to(np.arange(n_bands, dtype=np.uint64) + np.uint64(1), regs.shape[:2]).copy()
                for i in range(ROWS):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + regs[:, :, i])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part.column(0).to_numpy(), n_bands)), pa.array(np.repeat(part.column(1).to_numpy(), n_bands)), pa.array(h.ravel().view(np.int64))], ["node", "n_shingles", "key"]
                )

    return classes.select("node", "n_shingles", "regs").mapInArrow(frugal(run), "node long, n_shingles long, key long")


def _likely(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose most likely similarity is at least ``least``, with it as ``est``."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n_shingles").alias("n_" + x), F.col("regs").alias("r_" + x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                p = b.slice(lo, 4096)
                x, y = (np.stack([np.frombuffer(v.as_py(), "<u2") for v in p.column(i)]) for i in (3, 5))
                est = similarity((x > y).sum(axis=1), (x < y).sum(axis=1), x.shape[1], p.column(2).to_numpy().astype(float), p.column(4).to_numpy().astype(float))
                ok = est >= least
                yield pa.RecordBatch.from_arrays([p.column(0).filter(pa.array(ok)), p.column(1).filter(pa.array(ok)), pa.array(est[ok])], ["a", "b", "est"])

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "r_a", "n_b", "r_b")
    return both.mapInArrow(frugal(run), "a long, b long, est double")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, key: str, text: str) -> DataFrame:
    """Those pairs (a, b) whose full sets reach the threshold; ``pairs`` is a kept table."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    texts = kept(_texts(nodes.join(classes, "node"), docs, key, text), "candidate-texts")
    both = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("t_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("t_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for t, s in zip(b.column(2), b.column(3)):
                h, first = sets(pa.array([t.as_py(), s.as_py()], pa.string()))
                union = len(np.unique(h))
                ok.append(100 * (first[2] - union) >= percent * union)
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    return both.select("a", "b", "t_a", "t_b").mapInArrow(frugal(run), "a long, b long")


def _texts(nodes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(node, text) of ``nodes`` (node, row)."""
    rows = docs.select(row_key(key, text).alias("row"), F.col(text).alias("text"))
    return rows.join(nodes.select("node", "row"), "row").groupBy("node").agg(F.first("text").alias("text"))


def _across(members: DataFrame, docs: DataFrame, percent: int, least: float, key: str, text: str) -> DataFrame:
    """Links (a, b) between members of one group that have different labels.

    members: group, node, row, label, n_shingles, regs.  A group is laid out in blocks of at most
    ``BLOCK`` shingles and ``MEMBERS`` sets (or one larger set), by label; each two blocks meet in one task, unless all
    their members have one label.  Only confirmed links leave it.
    """
    order = Window.partitionBy("group").orderBy("label", "node").rowsBetween(Window.unboundedPreceding, 0)
    slim = members.select("group", "node", "label", "n_shingles").withColumn("block", F.floor((F.sum(F.greatest("n_shingles", F.lit(BLOCK // MEMBERS))).over(order) - 1) / F.lit(BLOCK)))
    placed = kept(slim, "blocks")
    blocks = placed.groupBy("group", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    i, j = (blocks.select("group", F.col("block").alias(x), F.col("lo").alias("lo_" + x), F.col("hi").alias("hi_" + x)) for x in "ij")
    meet = i.join(j, "group").where("i <= j and least(lo_i, lo_j) < greatest(hi_i, hi_j)").select("group", "i", "j")
    jobs = meet.select("group", "i", "j", F.col("i").alias("block")).union(meet.where("i < j").select("group", "i", "j", F.col("j").alias("block")))
    full = placed.join(_texts(members, docs, key, text), "node").join(members.select("node", "regs"), "node")
    rows = full.join(jobs, ["group", "block"])

    def compare(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["block", "node"], ignore_index=True)
        first_block = int((p.block == p.i).sum())
        one = p.i[0] == p.j[0]
        h, first = sets(pa.array(p.text, pa.string()))
        code = np.unique(h, return_inverse=True)[1]
        regs = np.stack([np.frombuffer(x, "<u2") for x in p.regs])
        n, label, node = p.n_shingles.to_numpy(), p.label.to_numpy(), p.node.to_numpy()
        likely, waiting, held = [], [], 0

        def judge() -> None:
            x, y, more, less = map(np.concatenate, zip(*waiting))
            ok = similarity(more, less, regs.shape[1], n[x].astype(float), n[y].astype(float)) >= least
            likely.append((x[ok], y[ok]))
            waiting.clear()

        for x in range(first_block):
            y = np.arange(x + 1 if one else first_block, len(p))
            y = y[(label[y] != label[x]) & (np.minimum(n[y], n[x]) * 100 >= np.maximum(n[y], n[x]) * percent)]
            if len(y):
                waiting.append((np.full(len(y), x), y, (regs[x] > regs[y]).sum(axis=1), (regs[x] < regs[y]).sum(axis=1)))
                held += len(y)
            if held >= PAIRS:
                judge()
                held = 0
        if waiting:
            judge()
        if not likely:
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        x, y = map(np.concatenate, zip(*likely))
        mark, now, common = np.zeros(len(code) and code.max() + 1, dtype=bool), -1, np.zeros(len(x), np.int64)
        for lo in range(0, len(x), STRETCH):  # a stretch of pairs at a time as Python numbers
            for k, (s, t) in enumerate(zip(x[lo : lo + STRETCH].tolist(), y[lo : lo + STRETCH].tolist()), lo):
                if s != now:
                    mark[:] = False
                    mark[code[first[s] : first[s + 1]]] = True
                    now = s
                common[k] = mark[code[first[t] : first[t + 1]]].sum()
        linked = 100 * common >= percent * (n[x] + n[y] - common)
        return pd.DataFrame({"a": node[x[linked]], "b": node[y[linked]]})

    return rows.groupBy("group", "i", "j").applyInPandas(compare, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of a table of links (a, b) reaches.

    Each round every node moves to the root of the tree of smallest neighbours that it is in, and links
    are drawn again between roots, without repeats: at least half of the nodes that have links go, so
    rounds are few and shrink fast.
    """
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    edges, labels = kept(links.where("a != b").select(*pair("a", "b")).distinct(), "edges"), None
    while labels is None or edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        up = kept(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("up")), "up")
        while True:
            above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            higher = kept(up.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "up")
            up = higher.select("node", "up")
            if not higher.where("moved").limit(1).count():
                break
        if labels is None:
            labels = up.select("node", F.col("up").alias("label"))
        else:
            root = up.select(F.col("node").alias("label"), F.col("up").alias("root"))
            labels = kept(labels.join(root, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
        ends = [up.select(F.col("node").alias(x), F.col("up").alias("root_" + x)) for x in "ab"]
        moved = edges.join(ends[0], "a").join(ends[1], "b").where("root_a != root_b")
        edges = kept(moved.select(*pair("root_a", "root_b")).distinct(), "edges")
    return labels


def groups(docs: DataFrame, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, row, n_shingles, component and label (of its group; null without shingles) of each row.

    Links join documents with 100 * intersection >= percent * union of their sets.  component is
    the smallest id reachable.  Null or empty text: no shingles, a component of its own.  Rows
    with one id and several texts are documents of their own.  Documents without an id link like
    others; a component of none but such has a null component.
    """
    threshold = percent / 100
    n_bands = bands_for(threshold)
    m = n_bands * ROWS
    least = threshold - SLACK * math.sqrt(threshold * (1 - threshold) / m)
    sketched = kept(sketches(docs, m, key, text), "sketches")
    node = F.coalesce(F.col("id"), F.lit(NO_ID) + F.pmod(F.col("c1"), F.lit(1 << 60)))
    full = sketched.where(F.col("n_shingles") > 0).withColumn("node", node)
    content = ["n_shingles", "c1", "c2"]
    found = full.groupBy(*content).agg(F.min(F.struct("node", "row")).alias("x"), F.first("regs").alias("regs")).select(*content, F.col("x.node").alias("home"), "x.row", "regs")
    # the further texts of an id are nodes of their own
    again = F.row_number().over(Window.partitionBy("home").orderBy("c1", "c2")) > 1
    found = found.withColumn("node", F.when(again, F.lit(NO_ID) + F.pmod(F.col("c1"), F.lit(1 << 60))).otherwise(F.col("home")))
    classes = kept(found, "classes")
    keys = kept(_band_keys(classes, n_bands), "bands")

    centre = keys.groupBy("key").agg(F.min(F.struct("node", "n_shingles")).alias("c"), F.count("*").alias("n")).where(F.col("n") > 1).select("key", F.col("c.node").alias("b"), F.col("c.n_shingles").alias("n_b"))
    close = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    first = keys.join(centre, "key").where((F.col("node") != F.col("b")) & close(F.col("n_shingles"), F.col("n_b"))).groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("shared"))
    most = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("shared"), "b"))
    first = first.withColumn("place", most).where(F.col("place") <= PARTNERS).select("a", "b")
    best = kept(_likely(first, classes, least).groupBy("a").agg(F.min("b").alias("b")), "first-pairs")
    links = kept(_confirmed(best, classes, docs, percent, key, text), "first-links")
    labels = components(links)

    labelled = keys.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = kept(labelled.join(labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi"), "key"), "open-buckets")
    if labelled.limit(1).count():
        hub = labelled.join(labelled.groupBy("key").agg(F.min("node").alias("b")), "key").select(F.col("node").alias("a"), "b").where("a != b").distinct()
        near = components(hub).withColumnRenamed("label", "group")
        members = near.join(classes, "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        members = kept(members.select("group", "node", "row", "label", "n_shingles", "regs"), "open-groups")
        links = kept(links.union(_across(members, docs, percent, least, key, text)), "links-of-both")
        labels = components(links)

    by_class = kept(classes.join(labels, "node", "left").select(*content, "home", F.coalesce("label", "node").alias("label")), "class-labels")
    least_id = by_class.groupBy("label").agg(F.min(F.when(F.col("home") < NO_ID, F.col("home"))).alias("least_id"))
    other = least_id.where(F.col("least_id") != F.col("label"))  # only where an id has several texts
    by_class = by_class.join(other, "label", "left").select(*content, "label", F.coalesce("least_id", F.when(F.col("label") < NO_ID, F.col("label"))).alias("whole"))
    out = sketched.join(by_class, content, "left")
    return out.select("id", "row", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("whole")).otherwise(F.col("id")).alias("component"), "label")
