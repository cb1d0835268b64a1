"""Sinks: reports, pass caches and manifests, each written by Spark's committer."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pass_cache(passed: DataFrame, fingerprint: str, path: str) -> None:
    """The distinct sha256 that passed under a grammar, as the partition of its fingerprint."""
    rows = passed.select("sha256").distinct().withColumn("fingerprint", F.lit(fingerprint))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fingerprint").parquet(path)


def cached(spark: SparkSession, path: str, fingerprint: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("fingerprint") == fingerprint).select("sha256")


def publish(df: DataFrame, path: str, verify: Callable[[DataFrame], bool], form: str = "parquet") -> None:
    """Writes beside ``path``, verifies what was written, then renames; a failure leaves no trace."""
    spark = df.sparkSession
    staged = f"{path}-staging-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        df.write.format(form).save(staged)
        if not verify(spark.read.schema(df.schema).format(form).load(staged)):
            raise ValueError(f"{path}: what was written doesn't hold")
        if fs.exists(place(path)) or not fs.rename(place(staged), place(path)):
            raise FileExistsError(path)
    finally:
        fs.delete(place(staged), True)


def verdict_counts(judged: DataFrame) -> DataFrame:
    """verdict and count, as kept beside an oracle's answers."""
    return judged.groupBy("verdict").agg(F.count("*").alias("count"))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, replaced as a whole, wherever the path's file system is."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(aside)
    try:
        out.write(text.encode())
    finally:
        out.close()
    fs.delete(place, False)
    if not fs.rename(aside, place):
        raise OSError(f"{path} could not be written")


def report_json(**parts: DataFrame | int | str | None) -> str:
    """A report as indented JSON: tables become lists of objects in their order.  Reports are aggregates; what
    reaches the driver is what a reader would page through."""
    made = {k: [r.asDict(recursive=True) for r in v.collect()] if isinstance(v, DataFrame) else v for k, v in parts.items()}
    return json.dumps(made, indent=2, ensure_ascii=False, default=str) + "\n"


def work_queue(language: str, totals: Mapping[str, int], clusters: Iterable[Mapping]) -> str:
    """The Markdown queue of gaps, largest first, with what is no gap listed apart.

    totals: files, passed, failed, gap_files, noise_files, config_files, version_files; clusters: signature, verdict,
    valid, examples (text: path, line, snippet), macros, macro_files, config_files, version_files.
    """
    clusters = list(clusters)
    out = [f"# Sweep of {language}", "", f"- {totals['files']} files: **{totals['passed']} passed, {totals['failed']} failed**", f"- {totals['gap_files']} are valid and rejected (gaps), {totals['noise_files']} are invalid (noise)"]
    for key, why in (("config_files", "are valid but no tree can hold all their configurations"), ("version_files", "are valid in an older version only and rejected on purpose")):
        if totals.get(key):
            out.append(f"- {totals[key]} {why}")
    gaps = [c for c in clusters if c["verdict"] == "gap"]
    out += ["", "## Gaps, largest first" if gaps else "No gaps."]
    for n, c in enumerate(gaps, 1):
        out += ["", f"### {n}. `{c['signature']}`: {c['valid']} valid file(s)", ""]
        if c.get("macro_files"):
            out += [f"{c['macro_files']} of these parse once macros are expanded; most common: {c['macros']}.", ""]
        out += [f"- `{e}`" for e in c["examples"][:3]]
    for verdict, key, title in (("config", "config_files", "split by conditionals"), ("version", "version_files", "rejected by version policy")):
        some = sorted((c for c in clusters if c["verdict"] == verdict), key=lambda c: (-c[key], c["signature"]))
        if some:
            out += ["", f"## No gaps: {title}", "", *(f"- `{c['signature']}`: {c[key]} file(s)" for c in some)]
    return "\n".join(out) + "\n"


def ledger_block(text: str, language: str, totals: Mapping[str, int]) -> str:
    """A ledger's text with the numbers of ``[corpus.<language>_sweep]``, else of ``[corpus.sweep]``, replaced; without
    either it stays as it is."""
    header = next((h for h in (f"[corpus.{language}_sweep]", "[corpus.sweep]") if h in text), None)
    if header is None:
        return text
    start = text.index(header)
    end = text.find("\n[", start + 1)
    rate = 100 * totals["passed"] / max(1, totals["files"])
    block = [header, *(f"{k} = {totals[k]}" for k in ("files", "passed", "failed", "gap_files", "noise_files")), f"pass_rate = '{rate:.2f}%'", ""]
    return text[:start] + "\n".join(block) + ("\n" + text[end + 1 :] if end >= 0 else "")


def write_manifest(files: DataFrame, language: str, path: str, form: str = "json") -> None:
    """One document a language: packages with their files, from rows (package, version, downloads, url, bytes, sha256,
    file, file_bytes, file_sha256, dialect, ord)."""
    one = F.struct(F.col("ord"), F.col("file").alias("path"), F.col("file_bytes").alias("bytes"), F.col("file_sha256").alias("sha256"), "dialect")
    plain = F.transform(F.array_sort(F.collect_list(one)), lambda f: F.struct(f["path"].alias("path"), f["bytes"].alias("bytes"), f["sha256"].alias("sha256"), f["dialect"].alias("dialect")))
    packages = files.groupBy("package", "version", "downloads", "url", "bytes", "sha256").agg(plain.alias("files"), F.min("ord").alias("ord"))
    rows = packages.select(F.struct("ord", "package", "version", "downloads", F.struct("url", "bytes", "sha256").alias("artifact"), "files").alias("p"))
    whole = rows.agg(F.array_sort(F.collect_list("p")).alias("ps")).select(F.lit(language).alias("language"), F.transform("ps", lambda p: p.dropFields("ord")).alias("packages"))
    whole.coalesce(1).write.format(form).mode("overwrite").save(path)


def table_text(rows: Iterable[Mapping], columns: list[str], markdown: bool = False) -> str:
    """Rows as an aligned or Markdown table; whole numbers get their thousands grouped."""
    show = lambda v: f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else "-" if v is None else str(v)
    cells = [columns, *([show(r[c]) for c in columns] for r in rows)]
    if markdown:
        cells.insert(1, ["---"] * len(columns))
        return "".join("| " + " | ".join(x.replace("|", "\\|") for x in r) + " |\n" for r in cells)
    width = [max(len(r[i]) for r in cells) for i in range(len(columns))]
    return "".join("  ".join(x.ljust(w) for x, w in zip(r, width)).rstrip() + "\n" for r in cells)
