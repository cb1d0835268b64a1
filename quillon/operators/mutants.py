"""Mutants of clean files and the differential filter that finds what a parser wrongly accepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("delete", "duplicate", "swap", "replace")


def mutants(files: DataFrame, per_file: int, seed: int = 0) -> DataFrame:
    """path, mutant, kind, token (the one edited) and tokens of ``per_file`` edits of each file (path, tokens array<string>).

    An edit deletes a token, repeats it, swaps it with the next or puts another token of the file
    in its place.  Places follow from path, number and seed.  Edits that change nothing are
    dropped, and files of fewer than three tokens.
    """
    rows = files.where(F.size("tokens") >= 3).select("path", "tokens", F.explode(F.sequence(F.lit(0), F.lit(per_file - 1))).alias("mutant"))
    digest = lambda what: F.md5(F.concat_ws("/", F.col("path").cast("string"), F.col("mutant").cast("string"), F.lit(str(seed)), F.lit(what)))
    draw = lambda what, n: (F.conv(F.substring(digest(what), 1, 8), 16, 10).cast("long") % n).cast("int")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), draw("kind", F.lit(len(KINDS))) + 1)
    last = F.when(kind == "swap", F.size("tokens") - 1).otherwise(F.size("tokens"))
    rows = rows.select("path", "tokens", "mutant", kind.alias("kind"), (draw("place", last) + 1).alias("i"), (draw("other", F.size("tokens")) + 1).alias("j"))
    here, after = F.element_at("tokens", F.col("i")), F.try_element_at("tokens", F.col("i") + 1)
    middle = (
        F.when(F.col("kind") == "delete", F.array().cast("array<string>"))
        .when(F.col("kind") == "duplicate", F.array(here, here))
        .when(F.col("kind") == "swap", F.array(after, here))
        .otherwise(F.array(F.element_at("tokens", F.col("j"))))
    )
    rest = F.col("i") + F.when(F.col("kind") == "swap", 2).otherwise(1)
    edited = F.concat(F.slice("tokens", F.lit(1), F.col("i") - 1), middle, F.slice("tokens", rest, F.size("tokens")))
    return rows.select("path", "mutant", "kind", here.alias("token"), "tokens", edited.alias("edited")).where("edited <> tokens").select("path", "mutant", "kind", "token", F.col("edited").alias("tokens"))


def widenings(base: DataFrame, found: DataFrame, valid: Column, accepted: Column) -> DataFrame:
    """Mutants of files in ``base`` (path) that the parser accepts and the oracle calls invalid.

    ``accepted`` is evaluated first; an oracle without an answer (null) is no finding.
    """
    return found.join(base.select("path").distinct(), "path", "left_semi").where(accepted).where(~valid)
