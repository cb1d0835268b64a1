"""A sweep over files as they arrive: verdicts and clusters kept up to date by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.streaming import StreamingQuery

from quillon.runtime import ship

RESULTS = "path string, sha256 string, signature string, valid boolean, at timestamp"


def results(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """The stream of parse results written as Parquet below ``folder``; signature is null for a pass."""
    return spark.readStream.schema(RESULTS).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def clusters(stream: DataFrame) -> DataFrame:
    """Counts of each failure signature so far; the state holds one row a signature."""
    failed = stream.where(F.col("signature").isNotNull())
    return failed.groupBy("signature").agg(F.count("*").alias("count"), F.count_if("valid").alias("valid"))


def rates(stream: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Files and failures of each window of time; a window's state goes once it is past ``late``."""
    by = stream.withWatermark("at", late).groupBy(F.window("at", window).alias("w"))
    return by.agg(F.count("*").alias("files"), F.count("signature").alias("failed")).select("w.start", "w.end", "files", "failed")


def first_seen(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Each content once, however often its file arrives within ``late``."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["sha256"])


def write(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append", once: bool = True) -> StreamingQuery:
    """Starts writing to ``folder``; updated tables (mode complete) replace it batch by batch.

    A batch that is run again after a failure writes the same rows.
    """
    out = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode)
    if once:
        out = out.trigger(availableNow=True)
    if mode == "complete":
        return out.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(folder)).start()
    return out.format("parquet").option("path", folder).start()


#: Files to be judged, and what became of them; skipped: the content passed before under the same fingerprint.
WORK = "path string, sha256 string, text string, fingerprint string"
JUDGED = "path string, sha256 string, fingerprint string, signature string, skipped boolean"


class _Passed(StatefulProcessor):
    """State of a content: the fingerprint of the grammar under which it passed last."""

    def __init__(self, judge: Callable[[str], str | None]):
        self.judge = judge

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.passed = handle.getValueState("passed", "fingerprint string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        known = self.passed.get()[0] if self.passed.exists() else None
        failed: dict[str, str] = {}
        for part in rows:
            out = []
            for path, sha, text, fingerprint in zip(part["path"], part["sha256"], part["text"], part["fingerprint"]):
                skipped = known is not None and known == fingerprint
                if not skipped and fingerprint not in failed:
                    found = self.judge(text or "")
                    if found is None:
                        known = fingerprint
                        self.passed.update((fingerprint,))
                    else:
                        failed[fingerprint] = found
                        if known is not None:  # what passed under another grammar is no pass any more
                            known = None
                            self.passed.clear()
                out.append((path, sha, fingerprint, failed.get(fingerprint), skipped))
            yield pd.DataFrame(out, columns=["path", "sha256", "fingerprint", "signature", "skipped"])

    def close(self) -> None:
        pass


def judged(work: DataFrame, judge: Callable[[str], str | None]) -> DataFrame:
    """``JUDGED`` rows of a stream of ``WORK``: content that passed under the same fingerprint is skipped, failures
    are judged again when they come again, and a new fingerprint starts anew.

    ``judge`` gives a text's failure signature, or None for a pass; it is asked once for each content and
    fingerprint of a batch, however many files share them.  The state is one row a content that passed; it
    is kept by RocksDB and comes back from the checkpoint.
    """
    ship(work.sparkSession)
    return work.groupBy("sha256").transformWithStateInPandas(_Passed(judge), JUDGED, "Append", "None")
