"""Trees as nested-set rows, and the statistics over them.

nodes: file_id, node_id (pre-order), parent_id, depth, kind, start_byte, end_byte, last_desc_id, is_missing,
and how many separators its span begins and ends with and how many blanks come before it.
A descendant's node_id lies in node_id + 1 .. last_desc_id; a leaf's last_desc_id is its own.
All windows are within one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators.intervals import containing
from quillon.operators.rules import closure

#: Bytes that a boundary may be moved past.
SEPARATORS = ";, \t\n\r"
VOID = ("meta", "br", "img", "hr", "input", "link", "area", "base", "col", "embed", "source", "track", "wbr")


def markup_tokens(files: DataFrame, file_id: str = "page_id", text: str = "html") -> DataFrame:
    """Tokens of marked-up texts with byte offsets, what they do to the depth, and running counts.

    seps_before, seps_after: separators at the edges of the token, file_seps at the end of the file;
    blanks_before: blanks at the end of the token before.
    """
    source = F.coalesce(F.col(text), F.lit(""))
    parts = files.select(F.col(file_id).alias("file_id"), (F.octet_length(source) - F.octet_length(F.rtrim(source, F.lit(SEPARATORS)))).cast("long").alias("file_seps"), F.octet_length(source).cast("long").alias("file_size"), F.posexplode(F.regexp_extract_all(source, F.lit("(<[^>]*>|[^<]+|<)"), F.lit(1))).alias("i", "tok"))
    width = F.octet_length("tok").cast("long")
    of = lambda cut: width - F.octet_length(cut)
    name = F.lower(F.regexp_extract("tok", "^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    parts = parts.withColumn("name", name).withColumn("is_end", F.col("tok").startswith("</") & (F.col("name") != ""))
    is_tag = (F.col("name") != "") & ~F.col("is_end")
    parts = parts.withColumn("is_open", is_tag & ~F.col("name").isin(*VOID) & ~F.col("tok").endswith("/>"))
    is_text = ~F.col("tok").startswith("<") & (F.trim(F.regexp_replace("tok", r"\s+", " ")) != "")
    parts = parts.withColumn("is_node", is_tag | is_text).withColumn("kind", F.when(is_tag, F.col("name")).when(is_text, "#text"))
    order = Window.partitionBy("file_id").orderBy("i")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("is_open"), 1).when(F.col("is_end"), -1).otherwise(0)
    return parts.select(
        "file_id", "i", "kind", "is_node", "is_end", (F.sum(step).over(so_far) - F.when(F.col("is_open"), 1).otherwise(0)).alias("depth"), F.sum(F.col("is_node").cast("long")).over(so_far).alias("n_nodes"),
        (F.sum(F.octet_length("tok").cast("long")).over(so_far) - F.octet_length("tok")).alias("start_byte"), F.sum(F.octet_length("tok").cast("long")).over(so_far).alias("end_byte"), "is_open",
        of(F.ltrim("tok", F.lit(SEPARATORS))).alias("seps_before"), of(F.rtrim("tok", F.lit(SEPARATORS))).alias("seps_after"), "file_seps", "file_size", F.coalesce(F.lag(of(F.rtrim("tok", F.lit(" \t")))).over(order), F.lit(0)).alias("blanks_before"),
    )


def nodes(tokens: DataFrame) -> DataFrame:
    """Nodes of ``markup_tokens``: the parent is the nearest earlier open node one level up, the
    subtree ends at the first end tag back on the node's level, else with the file."""
    t = tokens.where("is_node or is_end").withColumn("_tag", F.col("is_open") | F.col("is_end"))
    level = Window.partitionBy("file_id", "depth", "_tag").orderBy("i")
    shut = F.col("is_open") & F.lead("is_end").over(level)
    t = t.withColumn("last", F.when(shut, F.lead("n_nodes").over(level))).withColumn("closed_at", F.when(shut, F.lead("end_byte").over(level)))
    own = t.withColumn("total", F.max("n_nodes").over(Window.partitionBy("file_id"))).withColumnRenamed("file_size", "size").where("is_node")
    own = own.select("file_id", F.col("n_nodes").alias("node_id"), "depth", "kind", "start_byte", F.when(F.col("is_open"), F.coalesce("closed_at", "size")).otherwise(F.col("end_byte")).alias("end_byte"), F.when(F.col("is_open"), F.coalesce("last", "total")).otherwise(F.col("n_nodes")).alias("last_desc_id"), "is_open", (F.col("is_open") & F.col("last").isNull()).alias("is_missing"), "seps_before", F.when(F.col("is_open"), F.when(F.col("closed_at").isNull(), F.col("file_seps")).otherwise(0)).otherwise(F.col("seps_after")).alias("seps_after"), "blanks_before")
    # each node asks on the level above it, and an open one answers on its own: windows only, so a file is dealt once
    place = lambda level, p: F.struct(level.alias("level"), p.cast("long").alias("p"))
    asks, answers = place(F.col("depth") - 1, F.lit(None)), place(F.col("depth"), F.col("node_id"))
    both = own.select("*", F.inline(F.when(F.col("is_open"), F.array(asks, answers)).otherwise(F.array(asks))))
    seek = Window.partitionBy("file_id", "level").orderBy("node_id", F.col("p").asc_nulls_first())
    found = both.withColumn("parent_id", F.last("p", ignorenulls=True).over(seek)).where("p is null")
    return found.drop("is_open", "level", "p")


def unclosed(tokens: DataFrame) -> DataFrame:
    """(file_id, node_id, kind, start_byte) of the nodes of ``markup_tokens`` that no end tag closes."""
    level = Window.partitionBy("file_id", "depth").orderBy("i")
    tags = tokens.where("is_open or is_end").withColumn("_shut", F.coalesce(F.lead("is_end").over(level), F.lit(False)))
    return tags.where("is_open and not _shut").select("file_id", F.col("n_nodes").alias("node_id"), "kind", "start_byte")


def kind_histogram(n: DataFrame) -> DataFrame:
    return n.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("files"))


def edge_histogram(n: DataFrame) -> DataFrame:
    """parent, field (null without one), child and n."""
    p = n.select("file_id", F.col("node_id").alias("parent_id"), F.col("kind").alias("parent"))
    return n.join(p, ["file_id", "parent_id"]).groupBy("parent", "field", F.col("kind").alias("child")).agg(F.count("*").alias("n"))


def possible_edges(spark: SparkSession, node_types: str) -> DataFrame:
    """(parent, field, child) that a node-type catalogue allows, supertypes replaced by what they stand
    for: they never occur in a tree."""
    types = "types:array<struct<type:string>>"
    schema = f"array<struct<type:string,named:boolean,subtypes:array<struct<type:string>>,fields:map<string,struct<{types}>>,children:struct<{types}>>>"
    t = spark.createDataFrame([(node_types,)], "j string").select(F.inline(F.from_json("j", schema)))
    subtypes = t.select(F.col("type").alias("supertype"), F.explode("subtypes.type").alias("subtype"))
    named = t.where("named")
    slots = named.select(F.col("type").alias("parent"), F.explode("fields").alias("field", "v")).select("parent", "field", F.explode("v.types.type").alias("slot"))
    slots = slots.union(named.select(F.col("type").alias("parent"), F.lit(None).cast("string").alias("field"), F.explode("children.types.type").alias("slot")))
    leaves = closure(subtypes).join(subtypes.select(F.col("supertype").alias("reached")).distinct(), "reached", "left_anti")
    return slots.join(leaves, slots["slot"] == leaves["start"], "left").select("parent", "field", F.coalesce("reached", "slot").alias("child")).distinct()


def edge_coverage(possible: DataFrame, seen: DataFrame) -> DataFrame:
    """parent, possible, seen and never: how many of its possible edges some tree has; most missing first."""
    here = seen.select("parent", "field", "child").distinct().withColumn("hit", F.lit(1))
    same = (possible["parent"] == here["parent"]) & possible["field"].eqNullSafe(here["field"]) & (possible["child"] == here["child"])
    j = possible.join(here, same, "left").select(possible["parent"], "hit")
    g = j.groupBy("parent").agg(F.count("*").alias("possible"), F.count("hit").alias("seen"))
    return g.withColumn("never", F.col("possible") - F.col("seen")).orderBy(F.desc("never"), "parent")


def leaves(n: DataFrame) -> DataFrame:
    return n.where((F.col("last_desc_id") == F.col("node_id")) & (F.col("end_byte") > F.col("start_byte")))


def fingerprints(n: DataFrame) -> DataFrame:
    """file_id, shape: hash of the kinds in pre-order, and spans: the same with offsets."""
    seq = F.array_sort(F.collect_list(F.struct("node_id", "kind", "start_byte", "end_byte")))
    g = n.groupBy("file_id").agg(seq.alias("s"))
    return g.select("file_id", F.sha2(F.array_join(F.transform("s", lambda x: x["kind"]), " "), 256).alias("shape"), F.sha2(F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["kind"], x["start_byte"].cast("string"), x["end_byte"].cast("string"))), " "), 256).alias("spans"))


def never_built(possible: DataFrame, n: DataFrame) -> DataFrame:
    return possible.join(n.select("kind").distinct(), "kind", "left_anti")


def outermost(n: DataFrame, kind: str) -> DataFrame:
    """Nodes of a kind without an ancestor of that kind: those beyond every earlier subtree's end."""
    own = n.where(F.col("kind") == kind)
    before = Window.partitionBy("file_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn("_end", F.max("last_desc_id").over(before)).where("_end is null or node_id > _end").drop("_end")


def innermost(n: DataFrame, points: DataFrame) -> DataFrame:
    """points (file_id, at) with the kind of the deepest node whose span covers the byte."""
    hit = containing(points.select("file_id", "at").distinct(), n).where("at < end_byte")
    return hit.groupBy("file_id", "at").agg(F.max_by("kind", F.struct("depth", "node_id")).alias("kind"))
