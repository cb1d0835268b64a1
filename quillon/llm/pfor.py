"""A file format for token ids: patched frame-of-reference blocks, as a Spark data source.

A file holds the ids of some documents as one sequence, cut into blocks of ``BLOCK`` ids.  A block
keeps its minimum and, for each id, what exceeds it, in as many bits as ``SHARE`` of the ids need;
the rest are exceptions: their place in the block and the bits that didn't fit.  After the blocks
come the documents (id, number of ids) and the byte at which each block starts, so that any
document can be read alone.

A folder holds the files and a manifest with the order of the files and the number of documents
and ids in each.  The manifest is written when all tasks have ended, and files that it doesn't
name don't count: what failed or repeated attempts leave behind is never read.  Folders can lie on
any file system that Arrow reaches by its URI.

    df.select("doc_id", "ids").write.format("pfor").mode("overwrite").save(folder)
    spark.read.format("pfor").load(folder)          # doc_id, start, ids

``ids`` is binary: little-endian unsigned 32-bit integers, as in ``array('I')``; ``start`` counts
the ids of all documents before.  Null ``ids`` are none; null ``doc_id`` stays null; an empty
table gives a folder without files, which reads as an empty table.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

BLOCK = 1024
#: Share of a block's ids that its width must hold.
SHARE = 0.9
#: Blocks that are packed or unpacked together; ids that one reading task takes.
TOGETHER, TASK_IDS = 64, 8 << 20
#: Bytes of ids in one Arrow batch that a reader gives (a longer document comes alone).
GIVEN = 2 << 20

MAGIC, MANIFEST = b"QPF1", "_manifest.json"
_HEAD = struct.Struct("<IBxH")  # minimum, width, exceptions
_COUNTS, _TAIL = struct.Struct("<QQQQ"), struct.Struct("<32sI4s")  # documents, ids, blocks, footer's start; those, crc32 with the footer, magic
SCHEMA = "doc_id long, start long, ids binary"


def bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def _packed(low: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``width``-bit numbers as rows of bytes."""
    kind = "<u2" if width <= 16 else "<u4"
    bits = np.unpackbits(low.astype(kind).view(np.uint8), axis=1, bitorder="little").reshape(len(low), low.shape[1], -1)
    return np.packbits(bits[:, :, :width].reshape(len(low), -1), axis=1, bitorder="little")


def _unpacked(raw: np.ndarray, width: int) -> np.ndarray:
    bits = np.unpackbits(raw, axis=1, bitorder="little")[:, : BLOCK * width].reshape(len(raw), BLOCK, width)
    size = 16 if width <= 16 else 32
    wide = np.zeros((len(raw), BLOCK, size), dtype=np.uint8)
    wide[:, :, :width] = bits
    return np.packbits(wide.reshape(len(raw), -1), axis=1, bitorder="little").view("<u2" if size == 16 else "<u4").astype(np.uint32)


def pack(ids: np.ndarray, share: float = SHARE) -> list[bytes]:
    """Blocks of ``ids`` (a multiple of ``BLOCK``, unsigned 32-bit)."""
    rows = ids.reshape(-1, BLOCK)
    base = rows.min(axis=1)
    over = rows - base[:, None]
    need = bit_lengths(over)
    width = np.partition(need, max(0, int(np.ceil(share * BLOCK)) - 1), axis=1)[:, max(0, int(np.ceil(share * BLOCK)) - 1)]
    out: list[bytes] = [b""] * len(rows)
    for w in np.unique(width).tolist():
        which = np.flatnonzero(width == w)
        some = over[which]
        packed = _packed(some & np.uint32((1 << w) - 1), w) if w else np.zeros((len(which), 0), np.uint8)
        beyond = need[which] > w
        for k, i in enumerate(which.tolist()):
            at = np.flatnonzero(beyond[k])
            high = (some[k][at].astype(np.uint64) >> np.uint64(w)).astype("<u4")
            out[i] = _HEAD.pack(int(base[i]), w, len(at)) + packed[k].tobytes() + at.astype("<u2").tobytes() + high.tobytes()
    return out


def unpack(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks that begin at ``starts`` in ``data``."""
    out = np.empty((len(starts), BLOCK), dtype=np.uint32)
    heads = [_HEAD.unpack_from(data, s) for s in starts.tolist()]
    width = np.array([h[1] for h in heads], dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)
    for w in np.unique(width).tolist():
        which = np.flatnonzero(width == w)
        if w:
            span = starts[which][:, None] + _HEAD.size + np.arange(BLOCK * w // 8)
            out[which] = _unpacked(raw[span], w)
        else:
            out[which] = 0
    for i, (base, w, n) in enumerate(heads):
        if n:
            at = int(starts[i]) + _HEAD.size + BLOCK * w // 8
            place = np.frombuffer(data, dtype="<u2", count=n, offset=at)
            out[i, place] |= (np.frombuffer(data, dtype="<u4", count=n, offset=at + 2 * n).astype(np.uint64) << np.uint64(w)).astype(np.uint32)
        out[i] += np.uint32(base)
    return out.ravel()


class FileWriter:
    """One file, written in order and closed once."""

    def __init__(self, sink):
        self.sink, self.at = sink, 0
        self.starts: list[int] = []
        self.keys: list[int | None] = []
        self.sizes: list[int] = []
        self.waiting: list[bytes] = []
        self.held = self.total = 0

    def add(self, key: int | None, ids: bytes | None) -> None:
        ids = ids or b""
        self.keys.append(key)
        self.sizes.append(len(ids) // 4)
        self.total += len(ids) // 4
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= 4 * BLOCK * TOGETHER:
            self._flush(False)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), dtype="<u4")
        whole = len(ids) if last else len(ids) - len(ids) % BLOCK
        for lo in range(0, whole, BLOCK * TOGETHER):
            some = ids[lo : min(whole, lo + BLOCK * TOGETHER)]
            if len(some) % BLOCK:  # the last block: filled up with its minimum, cut again by the number of ids
                some = np.concatenate([some, np.full(-len(some) % BLOCK, some[-(len(some) % BLOCK) :].min(), dtype="<u4")])
            blocks = pack(some)
            for b in blocks:
                self.starts.append(self.at)
                self.at += len(b)
            self.sink.write(b"".join(blocks))
        rest = ids[whole:].tobytes()
        self.waiting, self.held = [rest], len(rest)

    def close(self) -> None:
        self._flush(True)
        begin = self.at
        null = np.array([k is None for k in self.keys], dtype=bool)
        footer = np.array([k or 0 for k in self.keys], dtype="<i8").tobytes() + np.packbits(null, bitorder="little").tobytes() + np.array(self.sizes, dtype="<u4").tobytes() + np.array(self.starts, dtype="<u8").tobytes()
        self._put(footer)
        counts = _COUNTS.pack(len(self.keys), self.total, len(self.starts), begin)
        self._put(_TAIL.pack(counts, zlib.crc32(footer + counts), MAGIC))


class FileReader:
    """One open file: its documents, and their ids a stretch at a time."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - _TAIL.size)
        counts, crc, magic = _TAIL.unpack(source.read(_TAIL.size))
        n, self.total, blocks, begin = _COUNTS.unpack(counts)
        if magic != MAGIC or begin > size:
            raise ValueError("not a file of token blocks")
        source.seek(begin)
        footer = source.read(size - _TAIL.size - begin)
        if zlib.crc32(footer + counts) != crc:
            raise ValueError("the file's footer is damaged")
        self.keys = np.frombuffer(footer, dtype="<i8", count=n)
        at = 8 * n
        self.null = np.unpackbits(np.frombuffer(footer, dtype=np.uint8, count=(n + 7) // 8, offset=at), bitorder="little")[:n].astype(bool)
        at += (n + 7) // 8
        self.starts = np.append(np.frombuffer(footer, dtype="<u8", count=blocks, offset=at + 4 * n), begin).astype(np.int64)
        self.upto = np.concatenate([[0], np.cumsum(np.frombuffer(footer, dtype="<u4", count=n, offset=at), dtype=np.int64)])

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo .. hi of the file; only the blocks that hold them are read."""
        first, last = lo // BLOCK, -(-hi // BLOCK)
        if hi <= lo:
            return np.zeros(0, dtype=np.uint32)
        begin = int(self.starts[first])
        self.source.seek(begin)
        data = self.source.read(int(self.starts[last]) - begin)
        found = [unpack(data, self.starts[b : min(last, b + TOGETHER)] - begin) for b in range(first, last, TOGETHER)]
        return np.concatenate(found)[lo - first * BLOCK : hi - first * BLOCK]

    def documents(self, lo: int, hi: int) -> Iterator[tuple[int, int]]:
        """Ranges of documents, together within ``GIVEN`` bytes or one alone, whose first id lies in lo .. hi
        (documents without ids lie at the place of the next id)."""
        a, z = (int(np.searchsorted(self.upto[:-1], x)) for x in (lo, hi))
        if hi >= self.total:
            z = len(self.keys)
        while a < z:
            b = max(a + 1, min(z, int(np.searchsorted(self.upto, self.upto[a] + GIVEN // 4, "right")) - 1))
            yield a, b
            a = b


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that is named by a path or URI."""
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    if "://" not in folder:
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str
    documents: int
    ids: int


class Stretch(InputPartition):
    """Documents of a file whose first id, counted in the file, lies in lo .. hi."""

    def __init__(self, name: str, base: int, lo: int, hi: int):
        self.name, self.base, self.lo, self.hi = name, base, lo, hi


class TokenBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pfor"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Stretch]:
        where, root = opened(self.folder)
        with where.open_input_stream(f"{root}/{MANIFEST}") as f:
            files = json.loads(f.read())
        out, base = [], 0
        for x in files:
            out += [Stretch(x["name"], base, lo, min(x["ids"], lo + TASK_IDS)) for lo in range(0, max(1, x["ids"]), TASK_IDS)]
            base += x["ids"]
        return out or [Stretch("", 0, 0, 0)]

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        if not part.name:
            return
        where, root = opened(self.folder)
        with where.open_input_file(f"{root}/{part.name}") as f:
            file = FileReader(f)
            for a, z in file.documents(part.lo, part.hi):
                edge = file.upto[a : z + 1]
                raw = file.ids(int(edge[0]), int(edge[-1])).astype("<u4").tobytes()
                ids = pa.Array.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(((edge - edge[0]) * 4).astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([pa.array(file.keys[a:z], pa.int64(), mask=file.null[a:z]), pa.array(edge[:-1] + part.base, pa.int64()), ids], ["doc_id", "start", "ids"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        name = f"part-{partition:06d}-{uuid.uuid4().hex}.pfor"
        where, root = opened(self.folder)
        where.create_dir(root, recursive=True)
        with where.open_output_stream(f"{root}/{name}") as f:
            file = FileWriter(f)
            for b in iterator:
                for key, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    file.add(key, ids)
            file.close()
        return Written(partition, name, len(file.keys), file.total)

    def commit(self, messages: list[Written | None]) -> None:
        where, root = opened(self.folder)
        where.create_dir(root, recursive=True)
        before: list[dict] = []
        if not self.overwrite and where.get_file_info(f"{root}/{MANIFEST}").type != fs.FileType.NotFound:
            with where.open_input_stream(f"{root}/{MANIFEST}") as f:
                before = json.loads(f.read())
        new = [{"name": m.name, "documents": m.documents, "ids": m.ids} for m in sorted((m for m in messages if m), key=lambda m: m.partition) if m.documents]
        part = f"{root}/{MANIFEST}.{uuid.uuid4().hex}"
        with where.open_output_stream(part) as f:
            f.write(json.dumps(before + new).encode())
        where.move(part, f"{root}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        where, root = opened(self.folder)
        for m in messages:
            if m:
                where.delete_file(f"{root}/{m.name}")
