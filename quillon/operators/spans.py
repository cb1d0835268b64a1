"""Two trees over one text: boundaries, kinds, labelled edges and tokens compared by position.

Ours is a table of ``trees.boundaries``; theirs are spans (file_id, s, e, t, kind), edges (file_id, ps,
pe, pt, parent_kind, name, s, e) and tokens (file_id, s, e), ``t`` and ``pt`` being ``e`` and ``pe`` moved back
before separators.  All joins are equi-joins on the file and a span; what has no counterpart is
joined by containment through the blocks of ``intervals``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import clip
from quillon.operators.intervals import containing

_SPAN = "struct<s:bigint,e:bigint>"


def _span(s: Column, e: Column) -> Column:
    return F.struct(s.cast("long").alias("s"), e.cast("long").alias("e"))


def _some(*spans: tuple[Column, Column, Column]) -> Column:
    """Array of the spans (s, e) whose condition holds."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(ok, _span(s, e)) for ok, s, e in spans))))


def _ends(s: Column) -> list[tuple[Column, Column, Column]]:
    """A start with each end of the node: its own, its content's, and both before separators."""
    b, c = F.col("end_byte"), F.col("content_end")
    inner = (c > s) & (c < b)
    return [(F.lit(True), s, b), (F.lit(True), s, F.greatest(s, F.col("end_in"))), (inner, s, c), (inner, s, F.greatest(s, F.col("content_end_in")))]


def _own_spans(starts: bool) -> Column:
    """Spans that may stand for a node; ``starts``: also from its content and past separators."""
    a, b, c = F.col("start_byte"), F.col("end_byte"), F.col("content_start")
    out = [_some(*_ends(a))]
    if starts:
        for s, ok in ((F.col("start_in"), F.lit(True)), (c, c > a), (F.col("content_start_in"), c > a)):
            out.append(F.when(ok & (s < b), _some(*_ends(s))))
    lead = F.flatten(F.transform(F.filter("lead", lambda s: s < a), lambda s: _some(*(_ends(s) if starts else _ends(s)[:2]))))
    return F.array_distinct(F.concat(*(F.coalesce(x, F.array().cast(f"array<{_SPAN}>")) for x in [*out, lead])))


def span_kinds(nodes: DataFrame) -> DataFrame:
    """(file_id, s, e, kinds): the kinds of all nodes that a span may stand for, sorted."""
    rows = nodes.select("file_id", "kind", F.explode(_own_spans(True)).alias("x"))
    return rows.groupBy("file_id", "x.s", "x.e").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def matched(theirs: DataFrame, nodes: DataFrame, node_map: DataFrame) -> DataFrame:
    """``theirs`` with kinds, exact and state: ok, mismatch, unmapped or miss.

    A span of theirs is found as it stands, else without trailing separators.  node_map (kind,
    expected): the kinds of ours that may answer one of theirs, ``*`` any.  Names that don't agree on
    a span found only without separators are no match at all.
    """
    ours = span_kinds(nodes)
    at = ours.select("file_id", "s", "e", F.col("kinds").alias("exact_kinds"))
    trimmed = ours.select("file_id", "s", F.col("e").alias("t"), F.col("kinds").alias("trim_kinds"))
    j = theirs.join(at, ["file_id", "s", "e"], "left").join(trimmed, ["file_id", "s", "t"], "left").join(node_map, "kind", "left")
    kinds, exact = F.coalesce("exact_kinds", "trim_kinds"), F.col("exact_kinds").isNotNull()
    agrees = F.array_contains("expected", "*") | F.arrays_overlap("expected", kinds)
    state = F.when(kinds.isNull(), "miss").when(F.col("expected").isNull(), "unmapped").when(agrees, "ok").when(exact, "mismatch").otherwise("miss")
    return j.select(*theirs.columns, kinds.alias("kinds"), exact.alias("exact"), state.alias("state"))


def straddlers(missed: DataFrame, nodes: DataFrame) -> DataFrame:
    """``missed`` (file_id, s, e, ...) with built: the kind of the deepest node of ours around each span."""
    inner = nodes.select("file_id", "node_id", "depth", F.col("kind").alias("_kind"), "start_byte", "end_byte")
    around = containing(missed.select("file_id", "s", "e", F.col("s").alias("at")).distinct(), inner).where("end_byte >= e")
    best = around.groupBy("file_id", "s", "e").agg(F.max_by("_kind", F.struct("depth", -F.col("node_id"))).alias("built"))
    return missed.join(best, ["file_id", "s", "e"], "left").withColumn("built", F.coalesce("built", F.lit("<root>")))


def signatures(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Findings of ``matched`` with their signature: ``Kind => a|b`` or, for a miss, ``Kind <- built``."""
    pair = F.concat("kind", F.lit(" => "), F.array_join("kinds", "|"))
    named = found.where(F.col("state").isin("mismatch", "unmapped")).withColumn("signature", pair)
    missed = straddlers(found.where("state = 'miss'"), nodes).withColumn("signature", F.concat("kind", F.lit(" <- "), "built")).drop("built")
    return named.unionByName(missed.select(named.columns))


def allowed(found: DataFrame, policy: DataFrame) -> DataFrame:
    """Findings whose signature isn't declared."""
    return found.join(policy.select("signature").distinct(), "signature", "left_anti")


def edges(nodes: DataFrame) -> DataFrame:
    """(file_id, ps, pe, field, s, e): each labelled child's spans under each span that may stand for
    its parent.

    Besides its own spans a parent may lack up to four first or last children, or take in up to
    three siblings before it, as the other parser draws the line.
    """
    a, b = F.col("start_byte"), F.col("end_byte")
    cut = lambda s: F.array(_span(s, b), _span(s, F.greatest(s, F.col("end_in"))))
    short = lambda e: F.array(_span(a, e[0]), _span(a, F.greatest(a, e[1])))
    heads = F.flatten(F.transform(F.filter("heads", lambda s: (s > a) & (s < b)), cut))
    before = F.flatten(F.transform(F.filter("before", lambda s: s < a), cut))
    ends = F.filter(F.arrays_zip("tails", "tails_in"), lambda x: (x["tails"] > a) & (x["tails"] < b))
    tails = F.flatten(F.transform(ends, lambda x: short((x["tails"], x["tails_in"]))))
    parents = nodes.where(F.size("heads") > 0).select("file_id", F.col("node_id").alias("parent_id"), F.explode(F.array_distinct(F.concat(_own_spans(False), heads, before, tails))).alias("p"))
    kids = nodes.where("field is not null").select("file_id", "parent_id", "field", F.explode(_own_spans(False)).alias("k"))
    return kids.join(parents, ["file_id", "parent_id"]).select("file_id", F.col("p.s").alias("ps"), F.col("p.e").alias("pe"), "field", "k.s", "k.e").distinct()


def edge_matches(theirs: DataFrame, ours: DataFrame, field_map: DataFrame) -> DataFrame:
    """``theirs`` with state (ok, mismatch, unmapped) and signature ``Kind.name => fields of ours``.

    field_map (key, expected): for ``Kind.name`` the forms that answer it: a field whose child has that
    span, ``field>`` with a child around it, ``=`` the parent's own span; an empty list declares a
    child without a label.
    """
    e = theirs.withColumn("key", F.concat("parent_kind", F.lit("."), "name")).withColumn("_id", F.struct(*theirs.columns))
    probes = e.select("*", F.explode(F.array_distinct(F.array("pe", "pt"))).alias("probe"))
    o = ours.select("file_id", "ps", F.col("pe").alias("probe"), "field", F.col("s").alias("ks"), F.col("e").alias("ke"))
    under = probes.join(o, ["file_id", "ps", "probe"], "left").join(field_map, "key", "left")
    same = (F.col("ks") == F.col("s")) & (F.col("ke") == F.col("e"))
    around = (F.col("ks") <= F.col("s")) & (F.col("ke") >= F.col("e"))
    holds = F.exists("expected", lambda f: F.when(f == "=", (F.col("ps") == F.col("s")) & (F.col("probe") == F.col("e"))).when(f.endswith(">"), (F.concat("field", F.lit(">")) == f) & around).otherwise((F.col("field") == f) & same))
    g = under.groupBy("_id", "key").agg(F.array_sort(F.collect_set(F.when(same, F.col("field")))).alias("seen"), F.coalesce(F.bool_or(holds), F.lit(False)).alias("holds"), F.first("expected").alias("expected"))
    state = F.when(F.col("expected").isNull(), "unmapped").when((F.size("expected") == 0) | F.col("holds"), "ok").otherwise("mismatch")
    seen = F.when(F.size("seen") > 0, F.array_join("seen", "|")).otherwise("(no field)")
    return g.select("_id.*", state.alias("state"), F.concat("key", F.lit(" => "), seen).alias("signature"))


def leaf_bounds(nodes: DataFrame) -> DataFrame:
    """(file_id, at): starts and ends of all leaves, those of no width too."""
    leaves = nodes.where(F.col("last_desc_id") == F.col("node_id"))
    return leaves.select("file_id", F.explode(F.array("start_byte", "end_byte")).alias("at")).distinct()


def token_misses(theirs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Tokens of theirs with a boundary inside one of ours: file_id, s, e, signature; the start if both are."""
    sides = theirs.select("file_id", "s", "e", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.lit("start").alias("side"), F.col("s").alias("at")), F.struct(F.lit(1).alias("o"), F.lit("end").alias("side"), F.col("e").alias("at")))).alias("x")).select("file_id", "s", "e", "x.*")
    lost = sides.join(leaf_bounds(nodes), ["file_id", "at"], "left_anti")
    first = lost.groupBy("file_id", "s", "e").agg(F.min(F.struct("o", "side", "at")).alias("m")).select("file_id", "s", "e", "m.side", "m.at")
    point = first.select("file_id", F.greatest(F.col("at") - 1, F.lit(0)).alias("p"), F.col("at").alias("_at")).distinct().withColumnRenamed("p", "at")
    inner = nodes.select("file_id", "node_id", "depth", "kind", "start_byte", "end_byte")
    inside = containing(point, inner).where("end_byte >= _at").groupBy("file_id", F.col("_at").alias("at")).agg(F.max_by("kind", F.struct("depth", -F.col("node_id"))).alias("inside"))
    j = first.join(inside, ["file_id", "at"], "left")
    return j.select("file_id", "s", "e", F.concat(F.lit("token "), "side", F.lit(" inside `"), F.coalesce("inside", F.lit("?")), F.lit("`")).alias("signature"))


def families(found: DataFrame, examples: int = 4) -> DataFrame:
    """signature, count, files and the first examples (file:start, comma-joined), most files first, then
    most findings, then by signature.

    Findings are ranked within a file, so that few rows of a file meet in a cluster.
    """
    own = F.row_number().over(Window.partitionBy("signature", "file_id").orderBy("s", "e"))
    few = found.withColumn("_r", own).where(F.col("_r") <= examples)
    per_file = found.groupBy("signature", "file_id").agg(F.count("*").alias("n"))
    some = few.groupBy("signature", "file_id").agg(F.collect_list(F.struct("s", "e")).alias("x"))
    ranked = F.row_number().over(Window.partitionBy("signature").orderBy("file_id"))
    first = some.withColumn("_f", ranked).where(F.col("_f") <= examples).select("signature", "file_id", F.explode("x").alias("x"))
    first = first.groupBy("signature").agg(F.slice(F.array_sort(F.collect_list(F.struct("file_id", "x.s", "x.e"))), 1, examples).alias("x"))
    text = F.array_join(F.transform("x", lambda y: F.concat_ws(":", y["file_id"].cast("string"), y["s"].cast("string"))), ",")
    g = per_file.groupBy("signature").agg(F.sum("n").alias("count"), F.count("*").alias("files"))
    return g.join(first, "signature").select("signature", "count", "files", text.alias("examples")).orderBy(F.desc("files"), F.desc("count"), "signature")


def excerpt(data: Column, s: Column, e: Column, n: int) -> Column:
    """Text of a span of UTF-8 ``data``, clipped to ``n`` characters on one line."""
    return clip(F.decode(F.substring(data, s.cast("int") + 1, (e - s).cast("int")), "UTF-8"), n)
