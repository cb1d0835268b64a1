"""A front end for marked-up texts: trees as nested-set rows, and what comparing them needs.

``parsed`` has what ``nodes`` holds (see that module) and for each node its place among its siblings (ord),
its field and whether it is an extra (trivia such as a line break).  ``boundaries`` adds the offsets that
comparing with another parser needs:

content_start, content_end: without extras at its edges; start_in, content_start_in: the same moved
past separators; end_in, content_end_in: moved back before separators (not bounded by the start);
before: starts of up to three siblings before it; heads, tails: starts of its first four children
and ends of its last four (tails_in: the latter before separators); lead: starts of the extras
directly before it, the nearest first, each also with the blanks before it.

All of it is joins and windows within a file or a list of siblings; the edge of a node's content
is found by pointer jumping, in rounds as many as the logarithm of the depth.  ``read`` gives the basic
columns of ``nodes`` by a reader in Python, file by file: a second opinion, and the way to read many
short texts made from one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.nodes import VOID, markup_tokens, nodes
from quillon.runtime import ship, written

TOKEN = re.compile(r"<[^>]*>|[^<]+|<")
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
WHITE = " \t\n\x0b\f\r"
#: Fields of this language, by the child's kind.
FIELDS = {"#text": "text", "title": "name", "h1": "name", "h2": "name"}
EXTRAS = ("br", "hr", "meta", "link", "img")

SCHEMA = "node_id long, parent_id long, depth int, kind string, start_byte long, end_byte long, last_desc_id long, is_missing boolean"


def tokens(text: str) -> list[tuple[str, str, bool, int, int]]:
    """(token, tag name, is an end tag, start, end) of each token that isn't blank text."""
    out, at = [], 0
    for t in TOKEN.findall(text):
        end = at + len(t.encode())
        m = NAME.match(t)
        if m or (t[0] != "<" and t.strip(WHITE)):
            out.append((t, m[1].lower() if m else "", bool(m) and t.startswith("</"), at, end))
        at = end
    return out


def tree(text: str | None) -> list[dict]:
    """Nodes of a text in document order.

    A node's parent is the last one opened a level up; a node ends with the first end tag back on
    its level if no other opens there before, else with the file.
    """
    text = text or ""
    size = len(text.encode())
    rows: list[dict] = []
    opened: dict[int, int] = {}
    pending: dict[int, dict] = {}
    depth = 0
    for t, name, is_end, start, end in tokens(text):
        if is_end:
            depth -= 1
            if row := pending.pop(depth, None):
                row.update(end_byte=end, last_desc_id=len(rows), is_missing=False)
            continue
        kind, is_open = name or "#text", bool(name) and name not in VOID and not t.endswith("/>")
        row = {"node_id": len(rows) + 1, "parent_id": opened.get(depth - 1), "depth": depth, "kind": kind, "start_byte": start, "end_byte": end, "last_desc_id": len(rows) + 1, "is_missing": is_open}
        rows.append(row)
        if is_open:
            row.update(end_byte=size, last_desc_id=None)
            opened[depth] = row["node_id"]
            pending[depth] = row
            depth += 1
    for row in rows:
        row["last_desc_id"] = row["last_desc_id"] or len(rows)
    return rows


def read(files: DataFrame, file_id: str = "page_id", text: str = "html") -> DataFrame:
    """file_id and ``SCHEMA`` of the nodes of each file, by a reader in Python; a null text has none."""
    ship(files.sparkSession)
    rows = files.select(F.col(file_id).alias("file_id"), F.col(text).alias("text"))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    types = [kinds[x.split()[1]] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [tree(t) for t in b.column(1).to_pylist()]
            own = b.column(0).take(pa.array([i for i, f in enumerate(found) for _ in f], pa.int64()))
            yield pa.RecordBatch.from_arrays([own, *(pa.array([r[n] for f in found for r in f], k) for n, k in zip(names, types))], ["file_id", *names])

    return rows.mapInArrow(run, f"file_id {rows.schema['file_id'].dataType.simpleString()}, {SCHEMA}")


def parsed(files: DataFrame, file_id: str = "page_id", text: str = "html", extras: Iterable[str] = EXTRAS) -> DataFrame:
    """The nodes of each file with ord, field and extra; a null text has none.  Rows that share an id are
    files of their own only if the caller gives them ids of their own."""
    own = nodes(markup_tokens(files, file_id, text))
    beside = Window.partitionBy("file_id", "parent_id").orderBy("node_id")
    field = F.create_map(*(F.lit(x) for kv in FIELDS.items() for x in kv))[F.col("kind")]
    return own.withColumn("ord", (F.row_number().over(beside) - 1).cast("int")).withColumn("field", field).withColumn("extra", F.col("kind").isin(*extras))


def content_edges(own: DataFrame) -> DataFrame:
    """(file_id, node_id, first, last): where going down by first, or last, children that aren't extras ends.

    Pointer jumping: each round every node points to where the node that it pointed to points.
    """
    inner = own.where("not extra and parent_id is not null").groupBy("file_id", F.col("parent_id").alias("node_id")).agg(F.min("node_id").alias("first"), F.max("node_id").alias("last"))
    at = written(inner, "tree-edges")
    deep = own.agg(F.max("depth")).first()[0] or 0
    for _ in range(max(0, int(deep).bit_length())):
        far = at.select("file_id", F.col("node_id").alias("first"), F.col("first").alias("_first")), at.select("file_id", F.col("node_id").alias("last"), F.col("last").alias("_last"))
        at = at.join(far[0], ["file_id", "first"], "left").join(far[1], ["file_id", "last"], "left")
        at = written(at.select("file_id", "node_id", F.coalesce("_first", "first").alias("first"), F.coalesce("_last", "last").alias("last")), "tree-edges")
    return at


def boundaries(own: DataFrame) -> DataFrame:
    """``parsed`` nodes with the offsets named above; ``own`` is read several times: pass a kept table."""
    own = own.withColumn("start_in", F.col("start_byte") + F.col("seps_before")).withColumn("end_in", F.col("end_byte") - F.col("seps_after"))
    edges = content_edges(own)
    head = own.select("file_id", F.col("node_id").alias("first"), F.col("start_byte").alias("_cs"), F.col("start_in").alias("_csi"))
    tail = own.select("file_id", F.col("node_id").alias("last"), F.col("end_byte").alias("_ce"), F.col("end_in").alias("_cei"))
    content = edges.join(head, ["file_id", "first"]).join(tail, ["file_id", "last"]).select("file_id", "node_id", "_cs", "_csi", "_ce", "_cei")
    beside = Window.partitionBy("file_id", "parent_id").orderBy("ord")
    behind = Window.partitionBy("file_id", "parent_id").orderBy(F.desc("ord"))
    runs = Window.partitionBy("file_id", "parent_id", "_run").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    none = F.array().cast("array<bigint>")
    before = F.array_compact(F.array(*(F.lag("start_byte", n).over(beside) for n in (3, 2, 1))))
    # siblings with one number of non-extras before them: a run of extras and what follows it
    rows = own.withColumn("before", before).withColumn("_run", F.coalesce(F.sum(F.when(F.col("extra"), 0).otherwise(1)).over(beside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_back", F.row_number().over(behind))
    blank = F.when(F.col("blanks_before") > 0, F.array("start_byte", F.col("start_byte") - F.col("blanks_before"))).otherwise(F.array("start_byte"))
    rows = rows.withColumn("lead", F.flatten(F.reverse(F.collect_list(F.when(F.col("extra"), blank)).over(runs))))
    ends = F.struct("ord", "end_byte", "end_in")
    kids = rows.where("parent_id is not null and (ord < 4 or _back <= 4)").groupBy("file_id", F.col("parent_id").alias("node_id")).agg(
        F.array_sort(F.collect_list(F.when(F.col("ord") < 4, F.struct("ord", "start_byte")))).alias("h"), F.array_sort(F.collect_list(F.when(F.col("_back") <= 4, ends))).alias("t"))
    kids = kids.select("file_id", "node_id", F.col("h.start_byte").alias("heads"), F.col("t.end_byte").alias("tails"), F.col("t.end_in").alias("tails_in"))
    j = rows.drop("_run", "_back").join(content, ["file_id", "node_id"], "left").join(kids, ["file_id", "node_id"], "left")
    of = lambda a, b, n: F.coalesce(a, b).alias(n)
    return j.select(
        *own.columns, "before", "lead", of("_cs", "start_byte", "content_start"), of("_csi", "start_in", "content_start_in"), of("_ce", "end_byte", "content_end"), of("_cei", "end_in", "content_end_in"),
        of("heads", none, "heads"), of("tails", none, "tails"), of("tails_in", none, "tails_in"),
    )


def sexp(nodes: DataFrame) -> DataFrame:
    """file_id, sexp: each file's tree as one S-expression, such as ``(ul (li (#text)))``."""
    down = F.coalesce(F.lead("depth").over(Window.partitionBy("file_id").orderBy("node_id")), F.lit(0))
    part = F.concat(F.coalesce(F.concat("field", F.lit(": ")), F.lit("")), F.lit("("), "kind", F.repeat(F.lit(")"), F.col("depth") + 1 - down))
    seq = F.array_sort(F.collect_list(F.struct("node_id", "part")))
    return nodes.withColumn("part", part).groupBy("file_id").agg(seq.alias("s")).select("file_id", F.array_join(F.transform("s", lambda x: x["part"]), " ").alias("sexp"))
