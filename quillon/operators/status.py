"""The state of all grammars: facts from many sources joined by name, what is missing, and the gates."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.paths import is_sha256

#: Keys of a ledger that stand for a measurement, and where a declared item names itself.
CHECKS = {
    "shape": "shape_check", "mutation": "mutation_check", "errors": "error_positions", "fuzz": "fuzz_check", "incremental": "incremental_check",
    "recovery": "recovery_check", "roundtrip": "roundtrip_check", "reformat": "reformat_check", "kinds": "kinds_check", "lexical": "lexical_check",
}
SUMMARIES = ("construct", "what", "signature", "name")
EVIDENCE = "grammar string, language string, files long, passed long, failed long, gap_files long, noise_files long, pass_rate string"
ITEMS = "grammar string, list string, summary string, files long"


def _whole(x) -> int | None:
    return x if isinstance(x, int) and not isinstance(x, bool) and x >= 0 else None


def evidence(grammar: str, ledger: str) -> tuple[list[tuple], list[str], list[tuple]]:
    """(corpora as in ``EVIDENCE``, measurements, declared items as in ``ITEMS``) of one ledger's text.

    Blocks of ``corpus`` that end in ``sweep`` and count files are corpora, the rest measurements.
    """
    doc = tomllib.loads(ledger)
    corpus = doc.get("corpus", {}) if isinstance(doc.get("corpus"), dict) else {}
    measured = {"sweep", *(name for name, key in CHECKS.items() if key in doc), *(k for k in corpus if k not in ("sweep", "gaps") and not k.endswith("_sweep"))}
    rows = []
    for name, block in corpus.items():
        if isinstance(block, dict) and name.endswith("sweep") and "files" in block:
            language = grammar if name == "sweep" else name.removesuffix("_sweep")
            numbers = [_whole(block.get(k)) or 0 for k in ("files", "passed", "failed", "gap_files", "noise_files")]
            rows.append((grammar, language, *numbers, block["pass_rate"] if isinstance(block.get("pass_rate"), str) else None))
    items = []
    for key in ("known_gaps", "known_widenings", "deviations"):
        for item in doc.get(key, []) if isinstance(doc.get(key), list) else []:
            if isinstance(item, dict):
                said = next((item[k] for k in SUMMARIES if isinstance(item.get(k), str)), "declared item")
                items.append((grammar, key, " ".join(said.split()), _whole(item.get("files"))))
    return sorted(rows), sorted(measured), items


def collected(languages: DataFrame, **facts: DataFrame) -> DataFrame:
    """One row a grammar: its languages, and what each table of facts (grammar, ...) says of it, null if nothing."""
    out = languages.groupBy("grammar").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), ",").alias("languages"), F.min("ord").alias("ord"))
    for name, d in facts.items():
        clash = [c for c in d.columns if c != "grammar" and c in out.columns]
        if clash:
            raise ValueError(f"{name} repeats {clash}")
        out = out.join(d, "grammar", "left")
    return out


def missing_types(languages: DataFrame, claimed: DataFrame) -> DataFrame:
    """(grammar, extension) that the registry has and a grammar's manifest (grammar, extension) doesn't claim."""
    return languages.select("grammar", F.explode("extensions").alias("extension")).distinct().join(claimed, ["grammar", "extension"], "left_anti")


def unpaired(ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """``key`` and side (``missing`` there, ``unknown`` here) of what only one of two tables has."""
    a, b = ours.select(key).distinct().withColumn("_a", F.lit(1)), theirs.select(key).distinct().withColumn("_b", F.lit(1))
    j = a.join(b, key, "full_outer").where("_a is null or _b is null")
    return j.select(key, F.when(F.col("_b").isNull(), "missing").otherwise("unknown").alias("side"))


def summary(status: DataFrame, flags: list[str], numbers: list[str]) -> DataFrame:
    """One row: grammars, how many have each flag, and the sum of each number."""
    return status.agg(F.count("*").alias("grammars"), *(F.count_if(F.coalesce(F.col(f), F.lit(False))).alias(f) for f in flags), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in numbers))


def lock_errors(packages: DataFrame, language: str) -> DataFrame:
    """subject, error of a lock's packages (language, package, version, artifact, files): wrong language, no or
    invalid provenance, invalid files, and file identities that occur twice."""
    name = F.concat(F.regexp_replace("package", "[/:]", "__"), F.lit("-"), "version")
    rows = packages.withColumn("_name", name)
    wrong = rows.where(~F.col("language").eqNullSafe(F.lit(language))).select(F.coalesce("language", F.lit("none")).alias("subject"), F.lit("language").alias("error")).distinct()
    a = F.col("artifact")
    bad = ~((F.coalesce(a["url"], F.lit("")) != "") & (F.coalesce(a["bytes"], F.lit(0)) > 0) & F.coalesce(is_sha256(a["sha256"]), F.lit(False)))
    source = rows.where(a.isNull() | bad).select(F.col("_name").alias("subject"), F.when(a.isNull(), "no archive provenance").otherwise("invalid archive provenance").alias("error"))
    files = rows.where(a.isNotNull()).select("_name", F.explode("files").alias("f")).select(F.concat_ws("/", "_name", "f.path").alias("subject"), F.col("f.path").alias("path"), F.col("f.sha256").alias("sha"))
    invalid = files.where((F.coalesce("path", F.lit("")) == "") | ~F.coalesce(is_sha256(F.col("sha")), F.lit(False))).select("subject", F.lit("invalid file provenance").alias("error"))
    twice = files.groupBy("subject").agg(F.count("*").alias("n")).where("n > 1").select("subject", F.lit("duplicate file identity").alias("error"))
    return wrong.union(source).union(invalid).union(twice)


def gates(spark: SparkSession, **checks: DataFrame) -> DataFrame:
    """gate, ok, failures of each check, a table of its failures: all run, whatever fails first."""
    out = None
    for name, failures in checks.items():
        one = failures.agg(F.count("*").alias("failures")).select(F.lit(name).alias("gate"), (F.col("failures") == 0).alias("ok"), "failures")
        out = one if out is None else out.union(one)
    return out if out is not None else spark.createDataFrame([], "gate string, ok boolean, failures long")


def warns(valid: Column, indeterminate: Column) -> Column:
    """Whether an oracle that often can't tell says too little to mean anything."""
    return indeterminate > valid
