"""LM scoring with an Elias-Fano n-gram trie in memory-mapped levels.

Level 1 holds the words (64-bit hashes, sorted): a word's id is its place.  Level 2 holds the words
that follow each word, level 3 those that follow each pair.  A level's entries are sorted by
context; a context points to the range of its successors by a monotone pointer sequence, and a
successor is stored relative to its context (context's place * words + word), so that the whole
level is monotone too.  Keys, pointers and the words' counts (as steps of their running sum) are
Elias-Fano coded.  Scoring searches a word among the successors of its context only.

Probabilities are smoothed by absolute discounting and interpolation: an entry keeps the discounted
probability and each context the weight of the next lower order, both as 8-bit steps of log10; the
lowest order is add-one unigrams with exact counts.  The history of a text's first word is the end
mark alone.  All n-grams are kept, those seen once too.

Levels 2 and 3 come from one count of triples over all training documents.  Contexts are dealt to
segments of about ``SEGMENT`` training tokens by their first word's id, which is a rank of hashes and
so independent of frequency; a word with more than a quarter of that has segments of its own, dealt
by the second word's id.  Tasks send counts as packed sorted arrays, one for each segment they met;
a segment's builder merges them as they come, so copies of a passage meet as one entry.

Segments are built one by one, but stand behind each other in at most ``FILES`` volumes whose
sequences go on from segment to segment: what a group of texts costs to score doesn't grow with the
number of segments.

Levels are files under ``spark.checkpoint.dir``, which must be mounted (a ``file:`` path) on all
machines; each is written aside and renamed, so a repeated task leaves the same one.  Workers map
the files instead of reading them.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.eliasfano import EliasFano, arrays, low_bits
from quillon.llm.shared import frugal, gathered, shared_dir
from quillon.llm.text import Words, mix, slices

U = np.uint64
END = mix(np.array([0xE0D0F7E87], dtype=np.uint64))[0]
DISCOUNT = 0.75
#: Steps of a quantised log10 probability in one decade; 255 of them are nearly 16 decades.
STEPS = 16.0
#: Training tokens of a segment's contexts.
SEGMENT = 1 << 20
#: Bytes of text, and tokens, that are worked on together.
GROUP, CHUNK = 4 << 20, 1 << 19
#: Distinct words whose counts a task holds before it sends them on.
HOLD = 1 << 19
#: Counted triples, copies of a passage included, that a task holds before it sends them on.
HOLD3 = 3 << 19
#: Files of level 1, and volumes of levels 2 and 3.
FILES = 64
NONE = (1 << 32) - 1
_P = 10.0 ** (-np.arange(256) / STEPS)


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-np.log10(np.maximum(p, 1e-300)) * STEPS), 0, 255).astype(np.uint8)


def _store(path: str, parts: dict[str, np.ndarray]) -> None:
    """One file: the length of a JSON index, the index (type, offset, count of each array), the arrays."""
    index, at = {}, 0
    for k, v in parts.items():
        index[k] = (v.dtype.str, at, len(v))
        at += -(-v.nbytes // 64) * 64
    head = json.dumps(index).encode()
    head += b" " * (-(len(head) + 8) % 64)
    aside = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
    with open(aside, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head)
        for v in parts.values():
            f.write(np.ascontiguousarray(v).data)
            f.write(b"\0" * (-v.nbytes % 64))
    os.replace(aside, path)


class Segment:
    """The arrays of one file, mapped; ``coded``: an Elias-Fano sequence among them."""

    def __init__(self, path: str):
        self.raw = np.memmap(path, dtype=np.uint8, mode="r")
        size = int(self.raw[:8].view("<i8")[0])
        self.index, self.base, self.known = json.loads(self.raw[8 : 8 + size].tobytes()), 8 + size, {}

    def __getitem__(self, name: str) -> np.ndarray:
        kind, at, n = self.index[name]
        kind = np.dtype(kind)
        return self.raw[self.base + at : self.base + at + n * kind.itemsize].view(kind).view(np.ndarray)

    def coded(self, name: str) -> EliasFano:
        if name not in self.known:
            self.known[name] = EliasFano({k.split(".")[1]: self[k] for k in self.index if k.startswith(name + ".")})
        return self.known[name]


class Chain:
    """Writes a volume: each array is a file of its folder, and segments are appended to all of them.

    ``index`` says of each segment where its rows of a plain array, or its numbers of a coded sequence, start,
    and of the latter what is added to them (``shift``).
    """

    def __init__(self, path: str, bits: dict[str, int]):
        self.path, self.aside, self.bits = path, f"{os.path.dirname(path)}/.{uuid.uuid4().hex}", bits
        os.makedirs(self.aside)
        self.rows: dict[str, int] = {}
        self.index: dict[str, list[int]] = {"part": []}
        self.meta: dict[str, np.ndarray] = {}

    def _append(self, name: str, v: np.ndarray) -> int:
        at = self.rows.get(name, 0)
        with open(f"{self.aside}/{name}{v.dtype.str[1:]}", "ab") as f:
            f.write(np.ascontiguousarray(v).data)
        self.rows[name] = at + len(v)
        return at

    def add(self, part: int, coded: dict[str, np.ndarray], plain: dict[str, np.ndarray]) -> None:
        self.index["part"].append(part)
        for k, v in plain.items():
            self.index.setdefault(k, []).append(self._append(k, v))
        for k, v in coded.items():
            found = arrays(v.astype(np.uint64), self.bits[k])
            n, bits, top = (int(x) for x in found.pop("meta"))
            ones, places = int(self.meta[k][0]) if k in self.meta else 0, self.rows.get(f"{k}.bits", 0) * 64
            zeros = places - ones
            found["ones"] += ones
            found["zeros"] += zeros
            for x, y in found.items():
                self._append(f"{k}.{x}", y)
            self.meta[k] = np.array([ones + n, bits, zeros + top], dtype=np.int64)
            self.index.setdefault(k, []).append(ones)
            self.index.setdefault(f"{k}.shift", []).append(zeros << bits)

    def close(self) -> None:
        for k, v in self.meta.items():
            self._append(f"{k}.meta", v)
        for k, v in self.index.items():
            self._append(f"of.{k}", np.array(v, dtype=np.int64))
        try:
            os.rename(self.aside, self.path)
        except OSError:  # a task before this one has left the same
            if not os.path.isdir(self.path):
                raise
            shutil.rmtree(self.aside)


class Volume:
    """What a ``Chain`` has written, mapped."""

    def __init__(self, path: str):
        self.known: dict[str, EliasFano] = {}
        self.parts: dict[str, np.ndarray] = {}
        for e in os.scandir(path):
            kind = np.dtype("<" + e.name[-2:])
            v = np.memmap(e.path, dtype=kind, mode="r").view(np.ndarray) if e.stat().st_size else np.zeros(0, kind)
            self.parts[e.name[:-2]] = v

    def __getitem__(self, name: str) -> np.ndarray:
        return self.parts[name]

    def coded(self, name: str) -> EliasFano:
        if name not in self.known:
            self.known[name] = EliasFano({k.split(".")[1]: v for k, v in self.parts.items() if k.startswith(name + ".")})
        return self.known[name]

    def of(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of ``part`` that have a segment here, its number)."""
        have = self["of.part"]
        j = np.minimum(np.searchsorted(have, part), len(have) - 1)
        there = np.flatnonzero(have[j] == part)
        return there, j[there]


def _coded(name: str, v: np.ndarray) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": x for k, x in arrays(v.astype(np.uint64)).items()}


@dataclass
class Model:
    """folder: the levels; total: training tokens; size: distinct ones.

    word_base: ids before each file of level 1; cold: segments of words that are not hot; hot:
    ids of split words, with the first and the number of their segments and their back-off weight;
    volumes: their number; built: those that hold any segment.
    """

    folder: str
    word_base: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    total: int = 0
    size: int = 0
    cold: int = 1
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    hot_first: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    hot_parts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    hot_count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    hot_rest: np.ndarray = field(default_factory=lambda: np.zeros(0))
    volumes: int = 1
    built: set[int] = field(default_factory=set)

    def __post_init__(self):
        self._mapped: dict[str, Segment | Volume] = {}

    def __getstate__(self):
        return self.__dict__ | {"_mapped": {}}

    def segment(self, name: str) -> Segment | Volume:
        if name not in self._mapped:
            self._mapped[name] = (Segment if name.startswith("1-") else Volume)(f"{self.folder}/{name}")
        return self._mapped[name]

    @property
    def parts(self) -> int:
        """Segments of levels 2 and 3."""
        return self.cold + int(self.hot_parts.sum())

    def volume(self, part: np.ndarray | int) -> np.ndarray | int:
        """The volume that holds a segment: adjoining ones share it."""
        return part * self.volumes // self.parts

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count) of sorted word keys; -1 and 0 where unknown."""
        ids, counts = np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        parts = len(self.word_base) - 1
        if not self.total:
            return ids, counts
        cut = np.searchsorted(word_part(keys, parts), np.arange(parts + 1))
        for i, (lo, hi) in enumerate(zip(cut, cut[1:])):
            if lo < hi and self.word_base[i] < self.word_base[i + 1]:
                seg = self.segment(f"1-{i}")
                x = keys[lo:hi]
                least = seg["least"][0]
                at = np.where(x >= least, seg.coded("key").find(np.maximum(x, least) - least), -1)
                there = np.flatnonzero(at >= 0)
                a, b = seg.coded("count").two(at[there])
                ids[lo + there] = at[there] + self.word_base[i]
                counts[lo + there] = b - a
        return ids, counts

    def part_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Segment of successors ``b`` of words ``a``."""
        part = a * self.cold // max(self.size, 1)
        if len(self.hot):
            j = np.minimum(np.searchsorted(self.hot, a), len(self.hot) - 1)
            at = np.flatnonzero(self.hot[j] == a)
            j = j[at]
            part[at] = self.hot_first[j] + b[at] * self.hot_parts[j] // self.size
        return part

    def contexts(self, part: np.ndarray) -> np.ndarray:
        """The first word whose successors each segment holds."""
        lo = -(-part * self.size // self.cold)
        at = np.flatnonzero(part >= self.cold)
        lo[at] = self.hot[np.searchsorted(self.hot_first, part[at], "right") - 1] if len(at) else 0
        return lo

    def by_volume(self, part: np.ndarray) -> Iterator[tuple[Volume, np.ndarray, np.ndarray]]:
        """Each volume met, with the places of its rows in ``part``, by segment, and their segments' numbers there;
        rows without a segment that was built don't occur."""
        order = np.argsort(part, kind="stable")
        file = self.volume(part[order])
        edge = np.flatnonzero(np.diff(file, prepend=-1, append=-1))
        for lo, hi in zip(edge, edge[1:]):
            if (i := int(file[lo])) in self.built:
                volume = self.segment(f"2-{i}")
                there, j = volume.of(part[order[lo:hi]])
                if len(there):
                    yield volume, order[lo:hi][there], j

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(part, place, probability, rest) of sorted pairs of ids: where the pair stands in its volume (-1:
        nowhere), its discounted probability (0: none) and the weight of the lower order after ``a``."""
        part, place = self.part_of(a, b), np.full(len(a), -1, dtype=np.int64)
        p, rest = np.zeros(len(a)), np.ones(len(a))
        for seg, rows, j in self.by_volume(part):
            rel = a[rows] - self.contexts(part[rows])
            asked, which = np.unique(seg["of.ptr2"][j] + rel, return_inverse=True)
            move = seg["of.key2"][j] - seg["of.ptr2.shift"][j]
            first, end = (x[which] + move for x in seg.coded("ptr2").two(asked))
            at = seg.coded("key2").find((rel * self.size + b[rows] + seg["of.key2.shift"][j]).astype(np.uint64), first, end)
            place[rows] = at
            found = at >= 0
            p[rows[found]] = _P[seg["prob2"][at[found]]]
            rest[rows] = _P[seg["rest1"][seg["of.rest1"][j] + rel]]
        if len(self.hot):
            j = np.minimum(np.searchsorted(self.hot, a), len(self.hot) - 1)
            rest = np.where(self.hot[j] == a, self.hot_rest[j], rest)
        return part, place, p, rest

    def triples(self, part: np.ndarray, place: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability, rest) of words ``c`` after pairs at the given places: discounted (0: none), and
        the weight of the lower order."""
        p, rest = np.zeros(len(c)), np.ones(len(c))
        for seg, rows, j in self.by_volume(part):
            at = place[rows]
            rel = at - seg["of.key2"][j]
            move = seg["of.key3"][j] - seg["of.ptr3.shift"][j]
            first, end = (x + move for x in seg.coded("ptr3").two(seg["of.ptr3"][j] + rel))
            known = c[rows] >= 0
            found = seg.coded("key3").find((rel * self.size + c[rows] + seg["of.key3.shift"][j])[known].astype(np.uint64), first[known], end[known])
            there = found >= 0
            p[rows[known][there]] = _P[seg["prob3"][found[there]]]
            rest[rows] = _P[seg["rest2"][at]]
        return p, rest


def word_part(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> U(32)) * U(parts) >> U(32)).astype(np.int64)


def _tokens(batch: pa.RecordBatch, column: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(keys, first): words and one end of each text, and each text's bounds."""
    keys, count = [], []
    for lo, hi in slices(batch.column(column)):
        w = Words(batch.column(column).slice(lo, hi - lo), lower=True)
        keys.append(np.insert(w.key, w.first[1:], END))
        count.append(w.count + 1)
    return np.concatenate(keys), np.concatenate([[0], *count]).cumsum()


def _runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers starts."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])[: len(x)])


def _packed(*columns: np.ndarray) -> bytes:
    """Sorted first column as differences, all columns by bytes, compressed."""
    first = np.diff(columns[0].astype(np.uint64), prepend=U(0))
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in (first, *(c.astype(np.uint32) for c in columns[1:])))
    return len(first).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(blob: bytes, columns: int) -> list[np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.decompress(blob[8:], n * (4 + 4 * columns), codec="zstd", asbytes=True), dtype=np.uint8)
    out = [np.cumsum(raw[: 8 * n].reshape(8, n).T.copy().view(np.uint64).ravel(), dtype=np.uint64)]
    return out + [raw[4 * n * k : 4 * n * (k + 1)].reshape(4, n).T.copy().view(np.uint32).ravel() for k in range(2, columns + 1)]


def _parts(batches: Iterator[pa.RecordBatch], columns: int, merge, most: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each part of rows (part, blob), sorted by part, with its columns merged."""
    now, waiting, size = None, [], 0
    for b in batches:
        for part, blob in zip(b.column(0).to_pylist(), b.column(1)):
            if part != now:
                if waiting:
                    yield now, merge(waiting)
                now, waiting, size = part, [], 0
            waiting.append(_unpacked(blob.as_py(), columns))
            size += len(waiting[-1][0])
            if size > most:
                waiting = [merge(waiting)]
                size = len(waiting[0][0])
                most = max(most, 2 * size)
    if waiting:
        yield now, merge(waiting)


def _merged_words(found: list[list[np.ndarray]]) -> list[np.ndarray]:
    key, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return [key, np.bincount(at, np.concatenate([n for _, n in found]), len(key)).astype(np.int64)]


def _merged_triples(found: list[list[np.ndarray]]) -> list[np.ndarray]:
    pair, c, n = (np.concatenate(x) for x in zip(*found))
    known, which = np.unique(pair, return_inverse=True)
    both = (which.astype(np.uint64) << U(32)) | c
    order = np.argsort(both)
    both = both[order]
    at = _runs(both)
    both = both[at]
    return [known[(both >> U(32)).astype(np.int64)], (both & U(NONE)).astype(np.uint32), np.add.reduceat(n[order].astype(np.int64), at)]


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Rows (part, blob) with those of a part together, in order, in one task of adjoining parts."""
    tasks = min(parts, FILES)
    return rows.repartitionById(tasks, F.floor(F.col("part").cast("long") * tasks / parts).cast("int")).sortWithinPartitions("part")


def train(docs: DataFrame, text: str = "text", segment: int | None = None) -> Model:
    """Counts all texts of ``docs`` (null: empty) and builds the levels; an empty table gives a
    model that knows nothing.  Repeated rows count as often as they stand there."""
    spark, segment = docs.sparkSession, segment or SEGMENT
    place = urlparse(shared_dir(spark))
    if place.scheme not in ("", "file"):
        raise ValueError("memory-mapped levels need spark.checkpoint.dir on a path mounted on all machines")
    folder = f"{place.path}/trie-{uuid.uuid4().hex}"
    os.makedirs(folder)
    texts = docs.select(F.col(text))
    word_parts = min(FILES, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def blobs(part: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
        edge = np.append(_runs(part), len(part))
        return pa.RecordBatch.from_arrays(
            [pa.array(part[edge[:-1]], pa.int32()), pa.array([_packed(*(c[lo:hi] for c in columns)) for lo, hi in zip(edge, edge[1:])], pa.binary())], ["part", "blob"]
        )

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in gathered(batches, 0, GROUP):
            held = [_merged_words([*held, list(np.unique(_tokens(b)[0], return_counts=True))])]
            if len(held[0][0]) > HOLD or held[0][1].max() > 1 << 30:
                yield blobs(word_part(held[0][0], word_parts), *held.pop())
        for key, n in held:
            yield blobs(word_part(key, word_parts), key, n)

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (key, n) in _parts(batches, 2, _merged_words, 2 * HOLD):
            _store(f"{folder}/1-{part}", {"least": key[:1]} | _coded("key", key - key[0]) | _coded("count", np.concatenate([[0], np.cumsum(n)])))
            at = np.flatnonzero(n > segment // 4)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((part, len(key), int(n.sum()), at, n[at]), kinds)], ["part", "n", "total", "hot", "hot_n"])

    counts = _dealt(texts.mapInArrow(frugal(count_words), "part int, blob binary"), word_parts)
    said = counts.mapInArrow(frugal(write_words), "part int, n long, total long, hot array<long>, hot_n array<long>").collect()  # a row a segment
    if not said:
        return Model(folder)
    size = np.zeros(word_parts, dtype=np.int64)
    size[[r.part for r in said]] = [r.n for r in said]
    base = np.concatenate([[0], np.cumsum(size)])
    hot = sorted((int(base[r.part]) + i, n) for r in said for i, n in zip(r.hot, r.hot_n))  # below four for each segment of tokens
    total = sum(r.total for r in said)
    cold, split = -(-total // segment), np.array([-(-4 * n // segment) for _, n in hot], dtype=np.int64)
    model = Model(folder, base, total, int(base[-1]), cold, np.array([i for i, _ in hot], np.int64), cold + np.cumsum(split) - split, split, np.array([n for _, n in hot], np.int64))
    model.volumes = min(model.parts, FILES)
    if model.size >= 1 << 31:
        raise ValueError("more than 2 ** 31 distinct words")

    def count_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def sent() -> pa.RecordBatch:
            pair, c, n = _merged_triples(held)
            held.clear()
            part = model.part_of((pair >> U(32)).astype(np.int64), (pair & U(NONE)).astype(np.int64))
            order = np.argsort(part, kind="stable")  # segments of split words come last
            return blobs(part[order], pair[order], c[order], n[order])

        for b in gathered(batches, 0, GROUP):
            keys, first = _tokens(b)
            start, last = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
            start[first[:-1]], last[first[1:] - 1] = True, True
            for lo in range(0, len(keys), CHUNK):
                hi = min(lo + CHUNK, len(keys))
                distinct, at = np.unique(np.concatenate([[END], keys[max(lo - 1, 0) : hi + 1], [END]]), return_inverse=True)
                at = at.astype(np.uint64)
                now = np.arange(hi - lo) + (2 if lo else 1)
                before = np.where(start[lo:hi], at[0], at[now - 1])
                after = np.where(last[lo:hi], U((1 << 21) - 1), at[now + 1])
                triples = np.sort((before << U(42)) | (at[now] << U(21)) | after)
                edge = _runs(triples)
                n = np.diff(np.append(edge, len(triples)))
                triples = triples[edge]
                ids, _ = model.look_up(distinct)
                a, m, c = (((triples >> U(k)) & U((1 << 21) - 1)).astype(np.int64) for k in (42, 21, 0))
                a, m, c = ids[a], ids[m], np.where(c == (1 << 21) - 1, NONE, np.append(ids, 0)[np.minimum(c, len(ids))])
                held.append([((a << 32) | m).astype(np.uint64), c.astype(np.uint32), n.astype(np.uint32)])
                if sum(len(x[0]) for x in held) > HOLD3:
                    yield sent()
        if held:
            yield sent()

    # one number of low bits for all segments, as for one half full: their sequences go on from one to the next
    heads, some = -(-model.size // cold), max(1, segment // 2)
    bits = {k: low_bits(n, top) for k, n, top in (("ptr2", heads, some), ("key2", some, heads * model.size), ("ptr3", some, some), ("key3", some, some * model.size))}

    def write_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = None
        for part, (pair, c, n) in _parts(batches, 3, _merged_triples, segment):
            chain = chain or Chain(f"{folder}/2-{model.volume(part)}", bits)
            lo = int(model.contexts(np.array([part]))[0])
            heads = 1 if part >= cold else -(-(part + 1) * model.size // cold) - lo
            edge = _runs(pair)
            pair, n2 = pair[edge], np.add.reduceat(n, edge)
            rel, b = (pair >> U(32)).astype(np.int64) - lo, (pair & U(NONE)).astype(np.int64)
            bounds2 = np.searchsorted(rel, np.arange(heads + 1))
            of = model.hot_count[np.searchsorted(model.hot, [lo])] if part >= model.cold else np.bincount(rel, n2, heads)
            whole = np.flatnonzero(c != NONE)
            of_pair = np.repeat(np.arange(len(pair)), np.diff(np.append(edge, len(c))))[whole]
            c3, n3 = c[whole].astype(np.int64), n[whole]
            bounds3 = np.searchsorted(of_pair, np.arange(len(pair) + 1))
            columns = {"prob2": quantised((n2 - DISCOUNT) / of[rel]), "rest1": quantised(DISCOUNT * np.diff(bounds2) / np.maximum(of, 1))}
            columns |= {"prob3": quantised((n3 - DISCOUNT) / n2[of_pair]), "rest2": quantised(DISCOUNT * np.diff(bounds3) / n2)}
            chain.add(part, {"ptr2": bounds2, "key2": rel * model.size + b, "ptr3": bounds3, "key3": of_pair * model.size + c3}, columns)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(pair)], pa.int64()), pa.array([len(c3)], pa.int64())], ["part", "pairs", "triples"])
        if chain:
            chain.close()

    triples = _dealt(texts.mapInArrow(frugal(count_triples), "part int, blob binary"), model.parts)
    said = triples.mapInArrow(frugal(write_triples), "part int, pairs long, triples long").collect()  # a row a segment
    model.built = {model.volume(r.part) for r in said}
    followers = np.zeros(len(hot))
    for r in said:
        if r.part >= cold:
            followers[np.searchsorted(model.hot_first, r.part, "right") - 1] += r.pairs
    model.hot_rest = _P[quantised(DISCOUNT * followers / np.maximum(model.hot_count, 1))]
    return model


SCORES = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(model: Model, keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known tokens, base score, score) of each text."""
    known, base, score = (np.zeros(len(first) - 1) for _ in range(3))
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.zeros(len(keys), dtype=bool)
    start[first[:-1]] = True
    for lo in range(0, len(keys), CHUNK):
        hi = min(lo + CHUNK, len(keys))
        far = max(lo - 2, 0)
        distinct, at = np.unique(np.append(keys[far:hi], END), return_inverse=True)
        ids, counts = model.look_up(distinct)
        p1 = (counts + 1) / (model.total + model.size + 1)
        end, at = at[-1], at[:-1]
        near = max(lo - 1, 0)  # pairs start one token earlier: the first token's context
        cur = at[near - far :]
        before = np.where(start[near:hi], end, at[np.maximum(np.arange(near, hi) - 1 - far, 0)])
        pair, which = np.unique((before.astype(np.uint64) << U(32)) | cur.astype(np.uint64), return_inverse=True)
        a, b = (pair >> U(32)).astype(np.int64), (pair & U(NONE)).astype(np.int64)
        part, place, p2, rest = np.zeros(len(pair), np.int64), np.full(len(pair), -1), np.zeros(len(pair)), np.ones(len(pair))
        ask = np.flatnonzero((ids[a] >= 0) & (ids[b] >= 0))
        part[ask], place[ask], p2[ask], rest[ask] = model.pairs(ids[a[ask]], ids[b[ask]])
        ask = np.flatnonzero((ids[a] >= 0) & (ids[b] < 0))  # the weight after a doesn't depend on b
        rest[ask] = model.pairs(ids[a[ask]], np.zeros(len(ask), np.int64))[3]
        p2 += rest * p1[b]
        p = p2[which]
        then = np.flatnonzero(~start[near:hi] & (np.arange(near, hi) >= max(lo, 1)))
        then = then[place[which[then - 1]] >= 0]
        triple, of = np.unique((which[then - 1].astype(np.uint64) << U(32)) | cur[then].astype(np.uint64), return_inverse=True)
        context, c = (triple >> U(32)).astype(np.int64), (triple & U(NONE)).astype(np.int64)
        p3, rest2 = model.triples(part[context], place[context], ids[c])
        p[then] = p3[of] + rest2[of] * p[then]
        own = slice(lo - near, None)
        d = doc[lo:hi]
        for total, x in ((known, counts[cur] > 0), (base, np.log10(p1)[cur]), (score, np.log10(p))):
            total += np.bincount(d, x[own], len(total))
    return known, base, score


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns ``extra`` and ``SCORES`` of each row, over its whole text (null: empty).

    base_score uses exact unigram counts, score the trie.  Repeated rows repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, 0, GROUP):
            keys, first = _tokens(b)
            known, base, total = _scored(model, keys, first)
            n = np.diff(first)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[1:], pa.array(n), pa.array(known.astype(np.int64)), pa.array(np.full(len(n), model.total)), pa.array(base), pa.array(total)],
                [*b.schema.names[1:], *(x.split()[0] for x in SCORES.split(", "))],
            )

    rows = docs.select(F.col(text).alias("_text"), F.col(key), *(F.col(c) for c in extra))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]]
    return rows.mapInArrow(frugal(run), ", ".join([*kinds, SCORES]))
