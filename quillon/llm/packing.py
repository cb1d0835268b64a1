"""Best-fit packing by a plan over the length histogram.

Documents become token sequences; those longer than ``SEQUENCE`` are cut into pieces.  The plan
is made from the histogram of piece lengths (at most ``SEQUENCE`` numbers): best fit decreasing,
carried out on counts.  Sequences with the same contents are one class with a count, so the plan
holds ranges of sequences, never documents.  Pieces then take the planned slots by joining on
their rank within their length.

Ranks are dealt in two steps (a base for each length and salt, then a row number within it), so
no task sees all pieces of a length, however common it is.
"""

from __future__ import annotations

import heapq
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.shared import frugal, held, kept
from quillon.llm.text import slices, span_keys

SEQUENCE = 2048
END = 0
SALTS = 256
#: Parts of words whose ids a worker keeps: twice this many at most, about 40 MB.
MEMORY = 100_000
#: Parts given to the merges in one call.
TOGETHER = 1000

#: Bytes of text that are cut into parts together.
TEXTS = 1 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, text_sha long"


class Encoder:
    """Token ids of texts by a vocabulary file whose pre-tokenizer breaks at white space.

    Texts of printable Latin-1 are lower-cased and cut as the vocabulary's pre-tokenizer cuts them,
    many texts at once as one array of bytes; distinct parts go to the merges many at a time, as each
    part's last id is one that ends a word and the ids fall apart again there.  Ids of parts are
    remembered in two generations: those met lately outlive the rest.  Other texts are encoded word
    by word by the whole tokenizer, read when the first comes; this gives the same ids as the text.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path, self.load, self.merges = path, Tokenizer.from_file, Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.former: dict[bytes, bytes] = {}
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        words = self.merges.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, dtype=bool)
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True

    @cached_property
    def whole(self):
        return self.load(self.path)

    def ids_of(self, parts: list[bytes]) -> list[bytes]:
        """Ids of distinct parts, given in Latin-1."""
        known, former = self.known, self.former
        out: list[bytes | None] = [known.get(p) for p in parts]
        fresh = []
        for i, x in enumerate(out):
            if x is None:
                x = out[i] = former.get(parts[i])
                if x is None:
                    fresh.append(i)
                else:
                    known[parts[i]] = x
        for lo in range(0, len(fresh), TOGETHER):
            some = fresh[lo : lo + TOGETHER]
            ids = np.array(self.merges.encode_batch_fast([b" ".join([parts[i] for i in some]).decode("latin-1")], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(stops) != len(some):
                raise ValueError("the vocabulary doesn't end each word with an id of its own kind")
            raw = ids.tobytes()
            for i, a, z in zip(some, [0, *stops], stops):
                out[i] = known[parts[i]] = raw[a:z]
        if len(known) > MEMORY:
            self.former, self.known = known, {}
        return out

    def _latin(self, texts: list[bytes]) -> list[bytes]:
        """Ids of lower-cased texts of printable Latin-1 and white space, each with the end id."""
        data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        start, end = cuts(data)
        if not len(start):
            return [_END] * len(texts)
        _, first, which = np.unique(span_keys(data, start, end), return_index=True, return_inverse=True)
        raw = data.tobytes()
        ids = self.ids_of([raw[a:z] for a, z in zip(start[first].tolist(), end[first].tolist())])
        size = np.array([len(x) for x in ids], dtype=np.int64) >> 2
        table, base = np.frombuffer(b"".join(ids), dtype="<u4"), np.cumsum(size) - size
        n = size[which]
        upto = np.concatenate([[0], np.cumsum(n)])
        out = table[np.repeat(base[which] - upto[:-1], n) + np.arange(upto[-1])].tobytes()
        length = np.array([len(x) + 1 for x in texts], dtype=np.int64)
        edge = upto[np.searchsorted(start, np.concatenate([[0], np.cumsum(length)]))].tolist()
        return [out[4 * a : 4 * z] + _END for a, z in zip(edge, edge[1:])]

    def _other(self, text: str) -> bytes:
        # str.split also breaks at four controls that the pre-tokenizer takes for signs
        words = text.translate(_BLANKS).split(" ") if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        words = [w for w in words if w]
        new = list(set(words))
        known = {w: np.array(e.ids, dtype="<u4").tobytes() for lo in range(0, len(new), TOGETHER) for w, e in zip(new[lo : lo + TOGETHER], self.whole.encode_batch_fast(new[lo : lo + TOGETHER], add_special_tokens=False))}
        return b"".join([known[w] for w in words]) + _END

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text and the end id; null counts as empty."""
        latin: list[bytes | None] = [plain(x or "") for x in texts]
        found = iter(self._latin([x for x in latin if x is not None]))
        return [self._other(t) if x is None else next(found) for x, t in zip(latin, texts)]


_END = END.to_bytes(4, "little")
_BLANKS = str.maketrans({c: " " for c in map(chr, range(0x3001)) if c.isspace() and c not in "\x1c\x1d\x1e\x1f"})
_ODD = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f]|<\|").search
#: Kinds of Latin-1 characters: 0 white space, 1 letter, 2 number, 3 other.
_KIND = np.array([0 if chr(c).isspace() else 1 if chr(c).isalpha() else 2 if unicodedata.category(chr(c))[0] == "N" else 3 for c in range(256)], dtype=np.uint8)
_QUOTE = ord("'")
_ONE = np.isin(np.arange(256), [ord(c) for c in "stmd"])
_TWO = np.zeros((256, 256), dtype=bool)
for _x in ("re", "ve", "ll"):
    _TWO[ord(_x[0]), ord(_x[1])] = True


def plain(text: str) -> bytes | None:
    """The lower-cased text in Latin-1, None if it holds other characters, controls or special marks."""
    try:
        raw = text.lower().encode("latin-1") if text.isascii() else text.encode("latin-1").decode("latin-1").lower().encode("latin-1")
    except UnicodeEncodeError:
        return None
    return None if _ODD(raw) else raw


def cuts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the parts of lower-cased Latin-1 text: an English ending after an apostrophe
    that begins a part, a run of letters, one number, or a run of other signs."""
    kind = _KIND[data]
    new = np.empty(len(data) + 1, dtype=bool)
    new[0] = True
    new[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    new[-1] = True
    near = np.concatenate([data, np.zeros(2, np.uint8)])
    at = np.flatnonzero((data == _QUOTE) & new[:-1])
    one, two = _ONE[near[at + 1]], _TWO[near[at + 1], near[at + 2]]
    at, size = at[one | two], np.where(one, 2, 3)[one | two]
    new[at + 1] = False
    new[at + size] = True
    edge = np.flatnonzero(new)
    start, end = edge[:-1], edge[1:]
    is_part = kind[start] > 0
    return start[is_part], end[is_part]


def pieces(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32, text_sha.

    Null or empty text: one piece, the end id alone.  Repeated rows give repeated pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = held("encoder " + vocabulary, lambda: Encoder(vocabulary))
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for lo, hi in slices(b.column(1), TEXTS):
                texts = b.column(1).slice(lo, hi - lo).to_pylist()
                for doc, x, ids in zip(b.column(0).slice(lo, hi - lo).to_pylist(), texts, encode(texts)):
                    sha = zlib.crc32((x or "").encode())
                    for n, at in enumerate(range(0, len(ids), 4 * sequence)):
                        part = ids[at : at + 4 * sequence]
                        for c, v in zip(out, (doc, n, at // 4, len(part) // 4, zlib.crc32(part), sha)):
                            c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], [x.split()[0] for x in PIECES.split(", ")])

    return docs.select(key, text).mapInArrow(frugal(run, "encoder " + vocabulary), PIECES)


def plan(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, rank from, rank to, first sequence, offset), ends exclusive.

    Best fit decreasing over counts: all items of a length go at once to the fullest class of
    sequences that still holds them.  An empty histogram gives no slots.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges (first sequence, count)
    open_rooms: list[int] = []  # heap of keys of ``room``
    fresh = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        skipped = []
        while left:
            while open_rooms and (open_rooms[0] < length or not room.get(open_rooms[0])):
                r = heapq.heappop(open_rooms)
                if room.get(r):
                    skipped.append(r)
            if open_rooms:
                r = open_rooms[0]
                first, count = room[r].pop()
                each = r // length  # a sequence with the least room stays the best fit until it is full
                used = min(count, -(-left // each))
                if used < count:
                    room[r].append((first + used, count - used))
            else:
                r, each, first = sequence, sequence // length, fresh
                used = -(-left // each)
                fresh += used
            full, more = divmod(left, each) if used * each > left else (used, 0)
            for k in range(each):
                n = full + (1 if k < more else 0)
                if n:
                    slots.append((length, rank, rank + n, first, sequence - r + k * length))
                    rank += n
                    left -= n
            for a, n, held in ((first, full, each), (first + full, used - full, more)):
                rest = r - held * length
                if n and rest:
                    room.setdefault(rest, []).append((a, n))
                    heapq.heappush(open_rooms, rest)
        for r in skipped:
            heapq.heappush(open_rooms, r)
    return slots


def pack(found: DataFrame, sequence: int = SEQUENCE, salts: int = SALTS) -> DataFrame:
    """Every piece with sequence_id and offset; ``found`` is read several times: pass a kept table.

    Lengths must lie between 1 and ``sequence``.
    """
    spark = found.sparkSession
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "text_sha"), F.lit(salts)))
    counts = kept(salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")), "length-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    schema = T.StructType([T.StructField(n, T.LongType(), False) for n in ("length", "_from", "_to", "_first", "_at")])
    slots = spark.createDataFrame(plan(histogram, sequence), schema)
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "text_sha", "ids_crc32")
    ranked = salted.withColumn("_i", F.row_number().over(within) - 1).join(base, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_i"))
    # the plan's size is bounded by the sequence length, not by the documents
    placed = ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return placed.select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("_first") + F.col("_rank") - F.col("_from")).alias("sequence_id"), F.col("_at").alias("offset"), "text_sha"
    )
