"""Differential reports: verdict joins, clusters, distributions, ratchets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cached_split(files: DataFrame, passed: DataFrame, key: str = "sha256") -> tuple[DataFrame, DataFrame]:
    """(skipped, work): content that already passed, and the rest."""
    return files.join(passed, key, "left_semi"), files.join(passed, key, "left_anti")


def with_verdicts(failures: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Failures with valid and unanswered: a missing verdict is an error of its own, never invalid."""
    return failures.join(verdicts, key, "left").withColumn("unanswered", F.col("valid").isNull())


def clusters(failures: DataFrame, examples: int = 5) -> DataFrame:
    """signature, count, valid, verdict and the first examples of failures (signature, label, valid, ord, path),
    most valid first, then most failures, then by signature.

    Counts are combined before they are shuffled, and only the first rows of each task are ranked, so a
    cluster that most failures fall into never meets in one task.  The verdict is the first of gap,
    version, config that the cluster has, else noise.
    """
    rank = F.row_number().over(Window.partitionBy("signature").orderBy("ord"))
    first = failures.select("signature", "ord", "path").withColumn("_r", rank).where(F.col("_r") <= examples)
    few = first.groupBy("signature").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "path"))), lambda x: x["path"]), ",").alias("examples"))
    has = lambda x: F.count_if(F.col("label") == x) > 0
    verdict = F.when(has("gap"), "gap").when(has("version"), "version").when(has("config"), "config").otherwise("noise")
    g = failures.groupBy("signature").agg(F.count("*").alias("count"), F.count_if("valid").alias("valid"), verdict.alias("verdict"))
    return g.join(few, "signature").orderBy(F.desc("valid"), F.desc("count"), "signature")


#: Values that are ranked together, and keys of a group that are numbered together.
STRETCH = 1 << 16


def nearest_rank(rows: DataFrame, value: str, place: Column) -> DataFrame:
    """The value at a 0-based place among all, place being given in terms of ``n``; 0 for no rows.

    Counts of distinct values are summed for stretches of the number line, the stretch that holds the
    place is found among those, and only its values are ordered.
    """
    counts = rows.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c")).withColumn("w", F.floor(F.col("v") / STRETCH))
    order = Window.orderBy("w")
    wide = counts.groupBy("w").agg(F.sum("c").alias("c"))
    wide = wide.select("w", F.sum("c").over(order).alias("upto"), F.col("c"), F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    hit = wide.where(F.col("upto") > place).orderBy("w").limit(1).select("w", (F.col("upto") - F.col("c")).alias("before"), "n")
    inner = counts.join(F.broadcast(hit), "w")  # one row
    ranked = inner.select("v", "n", (F.col("before") + F.sum("c").over(Window.orderBy("v"))).alias("upto"))
    return ranked.where(F.col("upto") > place).agg(F.coalesce(F.min("v"), F.lit(0)).alias("value"))


def numbered(rows: DataFrame, group: str, key: str) -> DataFrame:
    """``rows`` with i, their place from 0 in the order of ``group`` and the number ``key``, and n, how many there are.

    Stretches of a group are counted first, so rows are numbered within stretches.
    """
    part = rows.withColumn("_s", F.floor(F.col(key) / STRETCH))
    counts = part.groupBy(group, "_s").agg(F.count("*").alias("_c"))
    order = Window.orderBy(group, "_s")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = counts.select(group, "_s", (F.sum("_c").over(order) - F.col("_c")).alias("_b"), F.sum("_c").over(whole).alias("n"))
    inner = F.row_number().over(Window.partitionBy(group, "_s").orderBy(key)) - 1
    return part.withColumn("_i", inner).join(base, [group, "_s"]).select(*rows.columns, (F.col("_b") + F.col("_i")).alias("i"), "n")


def with_quantiles(one: DataFrame, rows: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """A one-row table with a column for each share: the value at its nearest rank."""
    out = one.withColumn("_k", F.lit(1))
    for name, q in shares.items():
        out = out.join(nearest_rank(rows, value, quantile_place(q)).select(F.col("value").alias(name), F.lit(1).alias("_k")), "_k")
    return out.drop("_k")


def count_matrix(programs: DataFrame, queries: list[str], found: DataFrame) -> DataFrame:
    """program, language, query, n, agrees: captures (page_id, query) counted for each program (page_id,
    program, language) and query, none included; agrees with the program's first language."""
    every = programs.select("*", F.explode(F.array(*map(F.lit, queries))).alias("query"))
    n = found.groupBy("page_id", "query").agg(F.count("*").alias("n"))
    rows = every.join(n, ["page_id", "query"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = F.first("n").over(Window.partitionBy("program", "query").orderBy("language"))
    return rows.select("program", "language", "query", "n", (F.col("n") == first).alias("agrees"))


def median_place() -> Column:
    return F.expr("floor(n / 2)")


def quantile_place(q: float) -> Column:
    return F.expr(f"floor((n - 1) * {q}D + 0.5D)")


def buckets(delta: Column) -> list[Column]:
    """Disjoint counts of 0, 1-16, 17-128 and more."""
    d = F.abs(delta)
    return [F.count_if(d == 0).alias("exact"), F.count_if(d.between(1, 16)).alias("near"), F.count_if(d.between(17, 128)).alias("mid"), F.count_if(d > 128).alias("far")]


def lock_diff(locked: DataFrame, found: DataFrame) -> DataFrame:
    """path, state (missing, extra, changed) of two tables (path, sha256)."""
    a, b = locked.select("path", F.col("sha256").alias("a")), found.select("path", F.col("sha256").alias("b"))
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "path", "full_outer").select("path", state.alias("state")).where("state is not null")


def ratchet(metrics: DataFrame, baselines: DataFrame, keys: tuple[str, ...] | list[str] = ("metric",)) -> DataFrame:
    """``keys``, value, baseline, state: fail above, remind below, ok at, advisory without a baseline."""
    j = metrics.join(baselines, list(keys), "left")
    state = F.when(F.col("baseline").isNull(), "advisory").when(F.col("value") > F.col("baseline"), "fail").when(F.col("value") < F.col("baseline"), "remind").otherwise("ok")
    return j.select(*keys, "value", "baseline", state.alias("state"))


def stale(declared: DataFrame, seen: DataFrame) -> DataFrame:
    return declared.join(seen.select("signature").distinct(), "signature", "left_anti")


def zip_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """First divergence of two sequences (file_id, seq, item): file_id, seq, ours, theirs."""
    j = a.select("file_id", "seq", F.col("item").alias("ours")).join(b.select("file_id", "seq", F.col("item").alias("theirs")), ["file_id", "seq"], "full_outer")
    d = j.where(~F.col("ours").eqNullSafe(F.col("theirs"))).groupBy("file_id").agg(F.min(F.struct("seq", "ours", "theirs")).alias("d"))
    return d.select("file_id", "d.*")


def first_rows(rows: DataFrame, order: list, n: int) -> DataFrame:
    """The first ``n`` rows in an order, with their place from 1."""
    return rows.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def furthest(rows: DataFrame, delta: str, ties: list[str], keep: int = 10) -> DataFrame:
    """The rows whose ``delta`` is furthest from zero."""
    return rows.orderBy(F.abs(delta).desc(), *ties).limit(keep)


def labelled(failures: DataFrame, declared: DataFrame) -> DataFrame:
    """signature, count, gap, version, config and verdict of failures (signature, valid, current, config).

    A valid file that parses without its dead branches is config; one whose signature is declared
    and that the current version rejects is version; other valid ones are gaps, invalid ones noise.
    """
    known = declared.select("signature").distinct().withColumn("_declared", F.lit(True))
    label = F.when(~F.col("valid"), "noise").when(F.col("config"), "config").when(F.col("_declared") & ~F.col("current"), "version").otherwise("gap")
    rows = failures.join(known, "signature", "left").withColumn("_declared", F.coalesce("_declared", F.lit(False))).withColumn("label", label)
    n = {x: F.count_if(F.col("label") == x) for x in ("gap", "version", "config")}
    verdict = F.when(n["gap"] > 0, "gap").when(n["version"] > 0, "version").when(n["config"] > 0, "config").otherwise("noise")
    return rows.groupBy("signature").agg(F.count("*").alias("count"), *(c.alias(x) for x, c in n.items()), verdict.alias("verdict"))
