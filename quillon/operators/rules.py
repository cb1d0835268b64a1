"""Vocabulary constraint rules and supertype closure."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce as chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.runtime import written

# fixed values of the shared vocabulary
TABLE_TERMS = (
    "_statement", "_expression", "_declaration", "_pattern", "_type", "_name", "_literal", "_parameter", "_argument", "_member", "_modifier",
    "_attribute", "_directive", "_body", "_control_flow", "_branch", "_loop", "_jump", "_assignment", "_invocation", "_access", "_interpolation",
)
FACET_TERMS = ("_callable", "_binding", "_scope", "_comment", "_clause", "_identifier", "_string")
EITHER_TIER = ("_parameter", "_modifier", "_declaration")
CONTAINMENTS = [("_literal", "_expression"), ("_branch", "_control_flow"), ("_loop", "_control_flow"), ("_jump", "_control_flow")]
VERSION = "0.1.0"


def closure(subtypes: DataFrame) -> DataFrame:
    """(start, reached) over (supertype, subtype), each start included; cycles are harmless.

    Each round goes one step on from the pairs that the last one found; pairs are kept in tables.
    """
    links = written(subtypes.select("supertype", "subtype").distinct(), "links")
    names = links.select(F.col("supertype").alias("start")).union(links.select("subtype")).distinct()
    new = reached = written(names.select("start", F.col("start").alias("reached")), "reached")
    while new.take(1):
        step = new.join(links, new["reached"] == links["supertype"]).select("start", F.col("subtype").alias("reached")).distinct()
        new = written(step.join(reached, ["start", "reached"], "left_anti"), "reached")
        reached = reached.union(new)
    return reached


@dataclass
class Manifest:
    """A grammar's roles: facets, demoted terms and uncategorised nodes."""

    vocabulary: str = VERSION
    facets: dict[str, list[str]] = field(default_factory=dict)
    demoted: dict[str, str] = field(default_factory=dict)
    uncategorised: list[tuple[str, str]] = field(default_factory=list)


def findings(spark: SparkSession, m: Manifest, named: list[str], supertypes: dict[str, list[str]]) -> DataFrame:
    """(rule, subject) of every rule that one grammar's manifest breaks."""
    table = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))
    return broken(
        m.vocabulary, table([(x,) for x in named], "x"), table([(x,) for x in supertypes], "x"), table([(k, v) for k, vs in supertypes.items() for v in vs], "supertype subtype"),
        table([(k, v) for k, vs in m.facets.items() for v in vs or [None]], "facet x"), table(list(m.demoted.items()), "x why"), table(m.uncategorised, "x why"),
    )


def broken(vocabulary: str, named: DataFrame, supertypes: DataFrame, subtypes: DataFrame, facets: DataFrame, demoted: DataFrame, uncategorised: DataFrame) -> DataFrame:
    """(rule, subject) of every broken rule, as one union of anti and semi joins over tables.

    named, supertypes (x); subtypes (supertype, subtype); facets (facet, x: null for one without members);
    demoted, uncategorised (x, why).  A subject appears once for each row that breaks a rule.
    """
    spark = named.sparkSession
    terms = lambda rows, names="x": spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], ", ".join(f"{n} string" for n in names.split()))
    keys, members = facets.select(F.col("facet").alias("x")).distinct(), facets.where("x is not null")
    reach = closure(subtypes)
    covered = reach.join(supertypes.withColumnRenamed("x", "start"), "start", "left_semi").select(F.col("reached").alias("x")).union(supertypes).union(members.select("x")).distinct()
    blank = F.trim(F.coalesce("why", F.lit(""))) == ""
    # inner vocabulary terms: what they stand for lies within the outer one, or the outer one names them
    pairs = terms(CONTAINMENTS, "i o").join(supertypes.withColumnRenamed("x", "i"), "i", "left_semi").join(supertypes.withColumnRenamed("x", "o"), "o", "left_semi")
    inner = reach.where("start <> reached").select(F.col("start").alias("i"), "reached")
    outer = reach.select(F.col("start").alias("o"), "reached")
    outside = pairs.join(inner, "i").join(outer, ["o", "reached"], "left_anti").select("i", "o").union(pairs.join(inner, "i", "left_anti").select("i", "o")).distinct()
    open_ = outside.join(reach.select(F.col("start").alias("o"), F.col("reached").alias("i")), ["o", "i"], "left_anti").select(F.concat_ws("/", "i", "o").alias("x"))
    parts = {
        "1": supertypes.join(terms(TABLE_TERMS), "x", "left_anti"),
        "1b-i": demoted.join(terms(EITHER_TIER), "x", "left_anti"),
        "1b-ii": demoted.where(blank),
        "1b-iii": demoted.join(supertypes, "x", "left_semi"),
        "1b-iv": demoted.join(keys, "x", "left_anti"),
        "5a": keys.join(terms(FACET_TERMS), "x", "left_anti").join(demoted, "x", "left_anti"),
        "5b": keys.join(members.select(F.col("facet").alias("x")), "x", "left_anti"),
        "3": members.join(named, "x", "left_anti"),
        "4": open_,
        "2a": named.join(supertypes, "x", "left_anti").join(covered, "x", "left_anti").join(uncategorised, "x", "left_anti"),
        "2b": uncategorised.join(covered, "x", "left_semi"),
        "2c": uncategorised.join(named, "x", "left_anti").select("x").union(uncategorised.where(blank).select("x")),
    }
    if vocabulary != VERSION:
        parts["0"] = terms([vocabulary])
    return chain(DataFrame.union, [d.select(F.lit(rule).alias("rule"), F.col("x").alias("subject")) for rule, d in parts.items()])


def dead_roles(declared: list[str], counts: DataFrame) -> DataFrame:
    """Declared roles that nothing matched, from counts (role, n)."""
    roles = counts.sparkSession.createDataFrame([(r,) for r in declared], "role string")
    return roles.join(counts.where("n > 0").select("role"), "role", "left_anti")


def ledger_version(stated: str) -> str | None:
    """What is wrong with a ledger's vocabulary version, if anything."""
    return None if stated == VERSION else f"the ledger states vocabulary {stated}, not {VERSION}"
