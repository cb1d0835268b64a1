"""Ranked search over a two-level quantised index.

Documents become segments as they are read: for each term of a segment the documents that hold it,
in order.  The first level keeps each posting's impact, rounded upward to a byte, the second its
exact count and the documents' lengths.  A search adds bytes: that bounds every document's score
from above, and, one step less for each term, from below.  The k-th best lower bound of all
segments is what a document must reach; each one whose upper bound does is scored again in whole
numbers from the second level.

The score of a document for an item is the sum over the item's distinct terms of
``w * ((1000000000 * tf) div (1000 * tf + 20 * m))`` with ``w = floor(1000 * ln((2 N + 2) / (2 df + 1)))`` and
``m = 50 + (50 * n * N) div L``: N documents with a term, L terms in all, n in the document.

Terms are told apart by 64-bit hashes.  Null texts and texts without a term are no documents.  Rows
that share an id or repeat are documents of their own; documents without an id come last among
equal scores.  Repeated rows of items are one item.  Items without a term that some document holds,
and empty tables, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.blocks import BLOCKS, UNITS, dump, grouped, load, meet
from quillon.llm.shared import frugal, gathered, kept, row_key
from quillon.llm.text import SIGNS, Words

#: Documents and bytes of text of a segment (a longer text is a segment alone); items of a block.
SEGMENT, SEGMENT_BYTES, ITEMS = 4096, 4 << 20, 128
#: One step of a byte impact: 255 of them hold the largest impact, which is below a million.
STEP = 3922
#: One group of segments in this many is searched first, for lower bounds to start the others from.
SEED = 32
_BOUNDS = "item binary, unit long, doc int, upper long, lower long"


def _impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _weights(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """m of each document, by Python's unbounded integers."""
    return np.array([50 + (50 * x * documents) // max(1, terms) for x in n.tolist()], dtype=np.int64)


def segments(docs: DataFrame) -> DataFrame:
    """(unit, documents, terms, keys, df, data): segments of ``docs`` (doc_id long, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, 1, SEGMENT_BYTES):
            for lo in range(0, b.num_rows, SEGMENT):
                some = b.slice(lo, SEGMENT)
                w = Words(some.column(1), lower=True, blank=SIGNS)
                key = w.key.view(np.int64)
                doc = np.repeat(np.arange(len(w.count)), w.count)
                terms, which = np.unique(key, return_inverse=True)
                pairs, tf = np.unique(which.astype(np.int64) * len(w.count) + doc, return_counts=True)
                term = pairs // max(1, len(w.count))
                df = np.bincount(term, minlength=len(terms))
                data = dump(
                    keys=terms, df=df.astype(np.int32), docs=(pairs % max(1, len(w.count))).astype(np.uint16), tf=tf.astype(np.min_scalar_type(int(tf.max(initial=0)))), n=w.count.astype(np.int64),
                    ids=some.column(0).fill_null(0).to_numpy(), null=some.column(0).is_null().to_numpy(zero_copy_only=False),
                )
                lists = [pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), pa.array(x, pa.int64())) for x in (terms, df)]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh64_intdigest(data) >> 1]), pa.array([int((w.count > 0).sum())]), pa.array([int(w.count.sum())]), *lists, pa.array([data], pa.binary())], ["unit", "documents", "terms", "keys", "df", "data"])

    schema = "unit long, documents long, terms long, keys array<long>, df array<long>, data binary"
    return docs.select("doc_id", "text").mapInArrow(frugal(run), schema)


def quantised(exact: DataFrame, documents: int, terms: int) -> DataFrame:
    """(unit, data): the first level of segments, each impact as a byte rounded upward."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for unit, data in zip(b.column(0).to_pylist(), b.column(1)):
                s = load(data.as_py())
                f = _impacts(s["tf"], _weights(s["n"], documents, terms)[s["docs"]])
                first = dump(keys=s["keys"], df=s["df"], docs=s["docs"], byte=(-(-f // STEP)).astype(np.uint8), size=np.array([len(s["n"])]))
                yield pa.RecordBatch.from_arrays([pa.array([unit]), pa.array([first], pa.binary())], ["unit", "data"])

    return exact.select("unit", "data").mapInArrow(frugal(run), "unit long, data binary")


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, key): the distinct terms of each distinct item (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = Words(b.column(2), lower=True, blank=SIGNS)
            key = w.key.view(np.int64)
            found = [np.unique(key[a:z]) for a, z in zip(w.first, w.first[1:])]
            row = pa.array(np.repeat(np.arange(b.num_rows), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))], ["item", "item_id", "key"])

    kind = dict(items.dtypes)["item_id"]
    return items.select(row_key("item_id").alias("item"), "item_id", "text").dropDuplicates(["item"]).mapInArrow(frugal(run), f"item binary, item_id {kind}, key long")


def _blocks(items: DataFrame) -> DataFrame:
    """(block, data): items (item, start, terms) in blocks of ``ITEMS``; start is a score's known lower bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, ITEMS):
                some = b.slice(lo, ITEMS)
                terms = some.column(2).to_pylist()
                key = np.array([t["key"] for x in terms for t in x], dtype=np.int64)
                who = np.repeat(np.arange(len(terms)), [len(x) for x in terms])
                order = np.lexsort((who, key))
                keys, first = np.unique(key[order], return_index=True)
                w = np.array([t["w"] for x in terms for t in x], dtype=np.int64)[order]
                data = dump(item=np.frombuffer(b"".join(some.column(0).to_pylist()), dtype="V16"), start=np.array(some.column(1).to_pylist(), dtype=np.int64), keys=keys, first=np.append(first, len(key)), who=who[order], w=w[first])
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh64_intdigest(data) >> 1]), pa.array([data], pa.binary())], ["block", "data"])

    return items.select("item", "start", "terms").mapInArrow(frugal(run), "block long, data binary")


def bounds(first: dict, q: dict) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower bounds of the scores (items x documents) of a segment."""
    size, n = int(first["size"][0]), len(q["item"])
    steps, weight = np.zeros((n, size), dtype=np.int64), np.zeros((n, size), dtype=np.int64)
    edge = np.concatenate([[0], np.cumsum(first["df"], dtype=np.int64)])
    _, here, there = np.intersect1d(first["keys"], q["keys"], assume_unique=True, return_indices=True)
    for a, z, lo, hi, w in zip(edge[here].tolist(), edge[here + 1].tolist(), q["first"][there].tolist(), q["first"][there + 1].tolist(), q["w"][there].tolist()):
        docs, add = first["docs"][a:z], w * first["byte"][a:z].astype(np.int64)
        for i in q["who"][lo:hi].tolist():
            steps[i, docs] += add
            weight[i, docs] += w
    return steps * STEP, steps * STEP - weight * (STEP - 1)


def _searched(k: int):
    """Documents of some segments that may be among the ``k`` best of the items of some blocks."""

    def run(units: pa.Table, asks: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        for data in asks["data"]:
            q = load(data.as_py())
            best = np.zeros((len(q["item"]), k), dtype=np.int64)
            found = []
            for unit, first in zip(units["unit"].to_pylist(), units["data"]):
                upper, lower = bounds(load(first.as_py()), q)
                both = np.concatenate([best, lower], axis=1)
                best = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                reach = np.maximum(np.maximum(best.min(axis=1), q["start"]), 1)
                i, d = np.nonzero(upper >= reach[:, None])
                found.append((i, np.full(len(i), unit), d, upper[i, d], lower[i, d]))
            i, unit, d, upper, lower = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 5
            ok = upper >= np.maximum(best.min(axis=1), q["start"])[i]
            for c, v in zip(out, (pa.array([x.tobytes() for x in q["item"][i[ok]]], pa.binary()), pa.array(unit[ok], pa.int64()), pa.array(d[ok], pa.int32()), pa.array(upper[ok], pa.int64()), pa.array(lower[ok], pa.int64()))):
                c.append(v)
        kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.chunked_array(c, t) for c, t in zip(out, kinds)], [x.split()[0] for x in _BOUNDS.split(", ")])

    return run


def _reach(found: DataFrame, k: int) -> DataFrame:
    """(item, reach): the ``k``-th best lower bound of items with so many documents."""
    order = Window.partitionBy("item").orderBy(F.desc("lower"))
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).where(F.col("_r") == k).select("item", F.col("lower").alias("reach"))


def _scored(documents: int, terms: int):
    """Exact scores of chosen documents of a segment."""

    def run(units: pa.Table, asks: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        for data in units["data"]:
            s = load(data.as_py())
            m = _weights(s["n"], documents, terms)
            edge = np.concatenate([[0], np.cumsum(s["df"], dtype=np.int64)])
            for item, docs, known in zip(*(asks[c].to_pylist() for c in ("item", "docs", "terms"))):
                docs = np.array(docs, dtype=np.int64)
                score = np.zeros(len(docs), dtype=np.int64)
                for t in known:
                    i = int(np.searchsorted(s["keys"], t["key"]))
                    if i < len(s["keys"]) and s["keys"][i] == t["key"]:
                        a, z = int(edge[i]), int(edge[i + 1])
                        at = np.minimum(np.searchsorted(s["docs"][a:z], docs), z - a - 1)
                        hit = s["docs"][a:z][at] == docs
                        score[hit] += t["w"] * _impacts(s["tf"][a:z][at[hit]], m[docs[hit]])
                out[0].append(pa.array([item] * len(docs), pa.binary()))
                out[1].append(pa.array(s["ids"][docs], pa.int64(), mask=s["null"][docs]))
                out[2].append(pa.array(score, pa.int64()))
        return pa.Table.from_arrays([pa.chunked_array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])

    return run


class Index:
    """Both levels of all documents (doc_id, text), kept in the shared folder."""

    def __init__(self, docs: DataFrame):
        self.exact = kept(segments(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "segments")
        x = self.exact.agg(F.sum("documents").alias("n"), F.sum("terms").alias("l")).first()
        self.documents, self.terms = x["n"] or 0, x["l"] or 0
        self.first = kept(quantised(self.exact, self.documents, self.terms), "impacts")

    def weighted(self, items: DataFrame) -> DataFrame:
        """(item, item_id, terms): the terms of items that some document holds, with their weights."""
        asked = kept(item_terms(items), "items")
        vocabulary = self.exact.select(F.inline(F.arrays_zip("keys", "df"))).withColumnRenamed("keys", "key")
        df = vocabulary.join(asked.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.sum("df").alias("df"))
        w = F.floor(1000 * F.log(F.lit(2.0 * self.documents + 2) / (2 * F.col("df") + 1))).cast("long")
        return asked.join(df, "key").groupBy("item", "item_id").agg(F.collect_list(F.struct("key", w.alias("w"))).alias("terms"))

    def search(self, items: DataFrame, k: int = 50) -> DataFrame:
        """(item_id, rank, doc_id, score): the ``k`` best documents of each item (item_id, text)."""
        known = kept(self.weighted(items), "weighted")
        units = grouped(self.first, "unit", UNITS)
        parts = max(1, -(-known.count() // (BLOCKS * ITEMS)))
        blocks = lambda x: grouped(kept(_blocks(x.coalesce(parts)), "item-blocks"), "block", BLOCKS)
        seeds = (units[0].where(F.col("_group") % SEED == 0), units[1])
        start = _reach(meet(seeds, blocks(known.withColumn("start", F.lit(0).cast("long"))), _searched(k), _BOUNDS), k)
        begun = known.join(start, "item", "left").withColumn("start", F.coalesce("reach", F.lit(0)))
        found = kept(meet(units, blocks(begun), _searched(k), _BOUNDS), "bounds")
        likely = found.join(_reach(found, k), "item", "left").where("upper >= coalesce(reach, 1)")
        chosen = likely.groupBy("unit", "item").agg(F.collect_list("doc").alias("docs")).join(known.select("item", "terms"), "item")
        few = self.exact.select("unit", "data").join(likely.select("unit").distinct(), "unit", "left_semi")
        scored = few.groupBy("unit").cogroup(chosen.groupBy("unit")).applyInArrow(_scored(self.documents, self.terms), "item binary, doc_id long, score long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = scored.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return best.join(known.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
