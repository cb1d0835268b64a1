"""Members of archives as rows, by a Spark data source: several tasks read one large archive.

    spark.dataSource.register(Archives)
    spark.read.format("archives").option("cap", 1 << 20).load(folder)

Rows are archive (its path), member, size (as the archive states it), content and problem.  The driver
only lists files.  An archive is cut into stretches of ``stretch`` bytes; a task opens it, reads its
directory (zip) or goes from header to header (tar), and takes the members whose headers begin in
its stretch, one at a time.  Compressed tars cannot be entered in the middle and are read by one
task, as a stream.  No more than ``cap`` bytes of a member are ever read: a larger one has no content
and the problem ``too large``, whatever size it states.  What isn't an archive, or breaks off, is a row
with its problem; links and other members without contents are left out.

With option ``pushdown`` (for sessions with ``spark.sql.python.filterPushdown.enabled``) equality and ``IN`` on
archive are pushed down: other archives aren't opened.
"""

from __future__ import annotations

import tarfile
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "archive string, member string, size long, content binary, problem string"
STRETCH, CAP = 128 << 20, 64 << 20
ENDINGS = (".zip", ".jar", ".whl", ".crate", ".tar", ".tgz", ".tar.gz", ".tar.bz2", ".tar.xz")
#: Bytes of contents in one Arrow batch (a larger member comes alone).
GIVEN = 4 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path that a path or URI names."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Stretch(InputPartition):
    def __init__(self, path: str, lo: int, hi: int):
        self.path, self.lo, self.hi = path, lo, hi


def is_tar(head: bytes) -> bool:
    return head[257:262] == b"ustar"


def members(source, lo: int, hi: int, cap: int) -> Iterator[tuple[str | None, int | None, bytes | None, str | None]]:
    """(member, size, content, problem) of the members of an open archive that begin at bytes lo .. hi - 1."""

    def taken(name: str, size: int, f) -> tuple[str, int, bytes | None, str | None]:
        data = f.read(cap + 1)
        return (name, size, None, "too large") if len(data) > cap else (name, size, data, None)

    head = source.read(512)
    source.seek(0)
    if head[:2] == b"PK":
        with zipfile.ZipFile(source) as z:
            for m in z.infolist():
                if lo <= m.header_offset < hi and not m.is_dir():
                    try:
                        with z.open(m) as f:
                            yield taken(m.filename, m.file_size, f)
                    except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, OSError) as e:
                        yield m.filename, m.file_size, None, f"unreadable: {type(e).__name__}"
    elif is_tar(head):
        with tarfile.open(fileobj=source, mode="r:") as t:
            while (m := t.next()) is not None and m.offset < hi:
                t.members = []  # headers gone by aren't kept
                if m.isreg() and m.offset >= lo:
                    yield taken(m.name, m.size, t.extractfile(m))
    elif lo == 0:
        with tarfile.open(fileobj=source, mode="r|*") as t:
            for m in t:
                t.members = []
                if m.isreg():
                    yield taken(m.name, m.size, t.extractfile(m))


class Archives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        kind = _Filtering if self.options.get("pushdown", "false").lower() == "true" else _Reader
        return kind(self.options["path"], int(self.options.get("stretch", STRETCH)), int(self.options.get("cap", CAP)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, stretch: int, cap: int):
        self.path, self.stretch, self.cap = path, stretch, cap
        self.only: set[str] | None = None

    def partitions(self) -> list[Stretch]:
        where, root = opened(self.path)
        info = where.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else [x for x in where.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File and x.path.lower().endswith(ENDINGS)]
        out = []
        for x in found:
            if self.only is None or x.path in self.only:
                whole = x.path.lower().endswith((".tgz", ".gz", ".bz2", ".xz"))
                step = max(1, x.size) if whole else self.stretch
                out += [Stretch(x.path, lo, lo + step) for lo in range(0, max(1, x.size), step)]
        return out or [Stretch("", 0, 0)]

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        rows, held = [], 0
        for row in self._rows(part):
            rows.append((part.path, *row))
            held += len(row[2] or b"")
            if held >= GIVEN:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _rows(self, part: Stretch) -> Iterator[tuple]:
        where, _ = opened(self.path)
        with where.open_input_file(part.path) as source:
            try:
                yield from members(source, part.lo, part.hi, self.cap)
            except (tarfile.TarError, zipfile.BadZipFile, EOFError, OSError) as e:
                if part.lo == 0:  # said once
                    yield None, None, None, f"not a whole archive: {type(e).__name__}"


class _Filtering(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("archive",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = wanted if self.only is None else self.only & wanted
            else:
                yield f


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in SCHEMA.split(", ")])
