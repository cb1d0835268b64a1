"""Substring dedup by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words.  Its minimiser is the smallest hash of its runs of
``CORE`` words, so equal windows have equal minimisers.  Consecutive windows that share one
travel to its bucket as one packed string (the words they span, joined by spaces), and there the
windows of all strings are sorted: equal ones stand together, and each string learns which of its
windows start in a document with a smaller id than its own.

Minimisers are counted first: a bucket that only one document reaches can't hold a repeat, so
only strings of shared buckets travel.  Equal strings are aggregated before they are shuffled and
keep their smallest id, so a passage in very many documents is one string.  A bucket that more than
``HOT`` different strings reach is dealt by its windows' hashes instead: of all its strings' windows
only equal ones need to meet.
Windows are told apart by a 128-bit hash of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import frugal, kept, row_key
from quillon.llm.text import Words, pool_min, rolling, slices

WINDOW, CORE = 50, 12
#: Strings of a bucket that are sorted in one task.
HOT = 1000
#: A document without an id comes after all others.
LAST = (1 << 63) - 1


def _runs(w: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each document with windows: its index, and start, end and minimiser of its runs of windows."""
    core = rolling(w.key, CORE)
    for d in np.flatnonzero(w.count >= WINDOW):
        a = w.first[d]
        least = pool_min(core[a : a + w.count[d] - CORE + 1], WINDOW - CORE + 1)
        cut = np.flatnonzero(least[1:] != least[:-1]) + 1
        start = np.concatenate([[0], cut])
        yield d, start, np.append(cut, len(least)), least[start].view(np.int64)


def minimisers(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(mini, id, row): the distinct minimisers of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(2)):
                part = b.slice(lo, hi - lo)
                found = [(d, np.unique(mini)) for d, _, _, mini in _runs(Words(part.column(2)))]
                if found:
                    at = np.repeat([d for d, _ in found], [len(x) for _, x in found])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for _, x in found])), part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at))], ["mini", "id", "row"])

    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), row_key(key, text).alias("row"), F.col(text)).mapInArrow(frugal(run), "mini long, id long, row binary")


def super_kmers(texts: DataFrame) -> DataFrame:
    """Packed strings of ``texts`` (id, row, text, minis), of the buckets in minis only.

    start: the first window's place in its document; windows: how many the string holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(2)):
                part = b.slice(lo, hi - lo)
                w = Words(part.column(2))
                joined, at = w.joined()
                data = joined.tobytes()
                out: tuple[list, ...] = ([], [], [], [], [])
                for d, start, end, mini in _runs(w):
                    shared = np.isin(mini, part.column(3)[int(d)].values.to_numpy(zero_copy_only=False))
                    a = w.first[d]
                    for s, e, x in zip(start[shared].tolist(), end[shared].tolist(), mini[shared].tolist()):
                        packed = data[at[a + s] : at[a + e + WINDOW - 1] - 1]
                        for c, v in zip(out, (d, x, s, e - s, packed)):
                            c.append(v)
                take = pa.array(out[0], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[1], pa.int64()), pa.array(out[4], pa.binary()), pa.array([xxhash.xxh3_128_digest(p) for p in out[4]], pa.binary()), part.column(0).take(take), part.column(1).take(take), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())],
                    ["mini", "packed", "pid", "id", "row", "start", "windows"],
                )

    return texts.select("id", "row", "text", "minis").mapInArrow(frugal(run), "mini long, packed binary, pid binary, id long, row binary, start int, windows int")


def _windows(strings: DataFrame) -> DataFrame:
    """(w, least, pid, at) for each window of packed strings (pid, packed, least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                w, least, pid, at = [], [], [], []
                for p, packed, n in zip(*(c.to_pylist() for c in b.slice(lo, 1000).columns)):
                    ends = [-1, *np.flatnonzero(np.frombuffer(packed, np.uint8) == 32).tolist(), len(packed)]
                    k = len(ends) - WINDOW
                    w += [xxhash.xxh3_128_digest(packed[ends[i] + 1 : ends[i + WINDOW]]) for i in range(k)]
                    least += [n] * k
                    pid += [p] * k
                    at += range(k)
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(least, pa.int64()), pa.array(pid, pa.binary()), pa.array(at, pa.int32())], ["w", "least", "pid", "at"])

    return strings.select("pid", "packed", "least").mapInArrow(frugal(run), "w binary, least long, pid binary, at int")


def _earlier(ordered: DataFrame) -> DataFrame:
    """(pid, at, least) of windows that an earlier document has, from windows sorted by w and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, low = None, 0
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for w, least, pid, at in zip(*(c.to_pylist() for c in b.columns)):
                if w != last:
                    last, low = w, least
                elif least > low:
                    for c, v in zip(out, (pid, at, low)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64())], ["pid", "at", "least"])

    return ordered.mapInArrow(frugal(run), "pid binary, at int, least long")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts (id, row, text) of documents in shared buckets, and for rows with
    repeats their spans (array of word ranges start, end) to remove."""
    minis = kept(minimisers(docs, key, text), "minimisers")
    shared = minis.groupBy("mini").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("mini")
    need = minis.join(shared, "mini").groupBy("row").agg(F.collect_set("mini").alias("minis"))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), row_key(key, text).alias("row"), F.col(text).alias("text"))
    texts = kept(rows.join(need, "row").select("id", "row", "text", "minis"), "shared-texts")

    strings = kept(super_kmers(texts).groupBy("mini", "packed").agg(F.first("pid").alias("pid"), F.min("id").alias("least")), "super-kmers")
    hot = kept(strings.groupBy("mini").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("mini"), "hot-buckets")
    in_buckets = _windows(strings.join(hot, "mini", "left_anti").repartition("mini"))
    by_window = _windows(strings.join(hot, "mini", "left_semi")).repartition("w")
    found = [_earlier(x.sortWithinPartitions("w", "least")) for x in (in_buckets, by_window)]
    earlier = found[0].union(found[1]).groupBy("pid").agg(F.collect_list(F.struct("at", "least")).alias("earlier"))
    known = kept(strings.select("pid", "least").join(earlier, "pid", "left"), "known-strings")  # a table, so that a string in very many documents can be split
    places = super_kmers(texts).select("pid", "id", "row", "start", "windows").join(known, "pid")
    span = lambda a, z: F.struct(a.cast("long").alias("start"), z.cast("long").alias("end"))
    whole = F.array(span(F.col("start"), F.col("start") + F.col("windows") - 1 + WINDOW))
    some = F.transform(F.filter("earlier", lambda e: e["least"] < F.col("id")), lambda e: span(F.col("start") + e["at"], F.col("start") + e["at"] + WINDOW))
    found = places.where((F.col("least") < F.col("id")) | F.col("earlier").isNotNull()).select("row", F.explode(F.when(F.col("least") < F.col("id"), whole).otherwise(some)).alias("s"))
    return texts.select("id", "row", "text"), found.groupBy("row").agg(F.array_sort(F.collect_set("s")).alias("spans"))


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row, n_removed, kept_text for each row from which words are removed; others are unchanged.

    A word goes if a window over it has a word sequence that also starts in a document with a
    smaller id, judged on the input.  kept_text: the words left, joined by one space.  Null or
    short texts have no windows.  Repeated rows share one ``row`` and result; rows with one id
    never count against each other; a row without an id comes after all others.
    """
    texts, spans = repeats(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list] = ([], [])
            for i in range(b.num_rows):
                words = _split(b.column(1)[i].as_py())
                gone = np.zeros(len(words), dtype=bool)
                for s in b.column(2)[i].as_py():
                    gone[s["start"] : s["end"]] = True
                out[0].append(int(gone.sum()))
                out[1].append(" ".join(w for w, g in zip(words, gone.tolist()) if not g))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string())], ["row", "n_removed", "kept_text"])

    once = texts.join(spans, "row").groupBy("row").agg(F.first("text").alias("text"), F.first("spans").alias("spans"))
    return once.mapInArrow(frugal(run), "row binary, n_removed long, kept_text string")


_BLANKS = str.maketrans({c: " " for c in "\t\n\v\f\r"})


def _split(text: str | None) -> list[str]:
    return [w for w in (text or "").translate(_BLANKS).split(" ") if w]


def word_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, row, n_words and kept_sha256 (all words joined by one space) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count, sha = [], []
            for x in b.column(2):
                words = _split(x.as_py())
                count.append(len(words))
                sha.append(hashlib.sha256(" ".join(words).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(count, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "row", "n_words", "all_sha256"])

    return docs.select(F.col(key).cast("long"), row_key(key, text).alias("row"), F.col(text)).mapInArrow(frugal(run), "doc_id long, row binary, n_words long, all_sha256 string")
