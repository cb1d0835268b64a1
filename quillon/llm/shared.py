"""What the operators of this package need from the session: shared storage and row identity."""

from __future__ import annotations

import contextlib
import ctypes
import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that Spark hands to a Python worker at once (one longer row comes alone).
BATCH, BATCH_BYTES = 4096, 2 << 20
_held: dict[str, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session on one machine that names none (a test) gets a temporary folder.
    """
    sc = spark.sparkContext
    have = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not have:
        now = sc._jsc.sc().getCheckpointDir()
        if not now.isDefined():
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="shared-"))
        have = sc._jsc.sc().getCheckpointDir().get()
    return have.rstrip("/")


def kept(df: DataFrame, name: str = "part") -> DataFrame:
    """``df`` written once to the shared folder and read back: later uses survive lost executors.

    The files stay until the cluster clears that folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128-bit identity of a row by id and text, null and empty text being different: repeated equal
    rows share it and get equal results."""
    of = lambda c: F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit(":"), c.cast("string")))
    return F.unhex(F.md5(F.concat(of(F.col(doc_id)), F.lit("/"), of(F.col(text)))))


def held(key: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept by a Python worker from task to task of the operator that names ``key``."""
    if key not in _held:
        _held[key] = make()
    return _held[key]


def _begin(keep: str) -> None:
    for key in [k for k in _held if k != keep]:
        del _held[key]


def _end() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run: Callable, keep: str = "") -> Callable:
    """``run`` over Arrow batches so that an idle worker holds little: what other operators ``held`` goes
    first, and memory that the task has freed returns to the system at its end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(keep)
        try:
            yield from run(batches)
        finally:
            _end()

    return task


def gathered(batches: Iterator[pa.RecordBatch], column: int, cap: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts in ``column`` reach ``cap`` bytes (the last may not)."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if b.num_rows:
            waiting.append(b)
            size += b.column(column).nbytes
        if size >= cap:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
            waiting, size = [], 0
    if waiting:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def ship(spark: SparkSession) -> None:
    """Let executors import this package, wherever they run; once for each context.

    Batches for Python are set to at most ``BATCH`` rows and ``BATCH_BYTES``: workers hold whole texts
    of a batch.
    """
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if getattr(sc, "_quillon_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    place = Path(tempfile.mkdtemp()) / "quillon.zip"  # the driver serves it from here
    place.write_bytes(packed.getvalue())
    sc.addPyFile(str(place))
    sc._quillon_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, with the package shipped to the executors that will read it."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
