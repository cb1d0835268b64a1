"""What jobs need from a session: this package on every executor, and tables that cut lineage."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Let executors import this package, wherever they run; once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_quillon_shipped", False):
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    place = Path(tempfile.mkdtemp()) / "quillon.zip"  # the driver serves it from here
    place.write_bytes(packed.getvalue())
    sc.addPyFile(str(place))
    sc._quillon_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Only a session on one machine
    that names none (a test) gets a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        now = sc._jsc.sc().getCheckpointDir()
        if not now.isDefined():
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="shared-"))
        named = sc._jsc.sc().getCheckpointDir().get()
    return named.rstrip("/")


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """``df`` as a table of the shared folder: a round that reads it doesn't run the rounds before again,
    and a lost executor loses nothing of it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
