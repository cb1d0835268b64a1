"""Scalar rules shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squash(text: Column) -> Column:
    return F.regexp_replace(text, "[ \\t\\n\\f\\r]", "")


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clip(text: Column, n: int) -> Column:
    return F.replace(F.substring(text, 1, n), F.lit("\n"), F.lit("\\n"))


def line_of(prefix: Column) -> Column:
    """Line number at the end of ``prefix``, from 1."""
    return F.lit(1) + F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit("")))


def signature(parent: Column, missing: Column, kinds: Column, text: Column) -> Column:
    """``parent > MISSING kind``, ``parent > ERROR(k1 k2 k3)`` with ``…`` after a fourth kind, or, without
    children, ``parent > ERROR 'text'``; the root has no parent."""
    inner = F.concat(F.array_join(F.slice(kinds, 1, 4), " "), F.when(F.size(kinds) >= 4, F.lit(" …")).otherwise(""))
    leaf = F.concat(F.lit("ERROR '"), F.substring(one_line(text), 1, 20), F.lit("'"))
    what = F.when(missing.isNotNull(), F.concat(F.lit("MISSING "), missing)).when(F.size(kinds) > 0, F.concat(F.lit("ERROR("), inner, F.lit(")"))).otherwise(leaf)
    return F.concat(F.coalesce(parent, F.lit("<root>")), F.lit(" > "), what)


SEPARATORS = ";, \t\n\r"


def latin(data: Column) -> Column:
    """Binary data as a string of as many characters as bytes, so that offsets hold."""
    return F.decode(data, "ISO-8859-1")


def trim_end(data: Column, start: Column, end: Column) -> Column:
    """Where a span of ``latin`` data ends without trailing separators."""
    return start + F.length(F.rtrim(F.substring(data, start.cast("int") + 1, (end - start).cast("int")), F.lit(SEPARATORS)))


def trim_start(data: Column, start: Column, end: Column) -> Column:
    """Where a span of ``latin`` data starts past leading separators."""
    return end - F.length(F.ltrim(F.substring(data, start.cast("int") + 1, (end - start).cast("int")), F.lit(SEPARATORS)))


def line_and_snippet(data: Column, at: Column) -> Column:
    """struct(line, snippet): number of the line that holds byte ``at`` of ``latin`` data, and its trimmed
    text, up to 160 characters."""
    line = line_of(F.substring(data, 1, at.cast("int")))
    text = F.decode(F.encode(F.get(F.split(data, "\r?\n"), line - 1), "ISO-8859-1"), "UTF-8")
    return F.struct(line.cast("long").alias("line"), F.substring(F.trim(text), 1, 160).alias("snippet"))


def error_line(data: Column, at: Column) -> Column:
    """The untrimmed line around byte ``at`` of ``latin`` data, up to 90 characters."""
    before = F.substring_index(F.substring(data, 1, at.cast("int")), "\n", -1)
    after = F.substring_index(F.substring(data, at.cast("int") + 1, 1 << 30), "\n", 1)
    return F.substring(F.decode(F.encode(F.concat(before, after), "ISO-8859-1"), "UTF-8"), 1, 90)


def row_and_column(data: Column, at: Column) -> Column:
    """struct(row, column) of a byte offset, both from 0."""
    before = F.substring(data, 1, at.cast("int"))
    return F.struct((line_of(before) - 1).cast("long").alias("row"), F.length(F.substring_index(before, "\n", -1)).cast("long").alias("column"))


def floor_boundary(data: Column, at: Column) -> Column:
    """``at``, or the start of the UTF-8 character of ``latin`` data that it falls into."""
    tail = F.regexp_extract(F.substring(data, 1, at.cast("int")), r"[\x{c0}-\x{ff}]?[\x{80}-\x{bf}]*$", 0)
    inside = F.substring(data, at.cast("int") + 1, 1).rlike(r"[\x{80}-\x{bf}]")
    return F.when(inside, at - F.length(tail)).otherwise(F.least(at, F.length(data)))


def percent_encoded(text: Column) -> Column:
    """Letters, digits and ``-_.~`` as they are, a blank as ``+``, other bytes as ``%XX``."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def skip_kind(reason: Column) -> Column:
    """What a printer's message is about: up to a backtick or line end, without a closing colon."""
    head = F.trim(F.regexp_extract(reason, "^[^`\n]*", 0))
    return F.substring(F.regexp_replace(head, ":$", ""), 1, 80)


def first_key(text: Column, section: str = "rules") -> Column:
    """The first key, as written, of an object within JSON text."""
    return F.regexp_extract(text, rf'(?s)"{section}".*?\{{.*?"([^"]*)"', 1)


def include_flags(folders: Column) -> Column:
    """Compiler flags for the folders of a package: itself, ``include`` folders, then the rest."""
    order = F.transform(F.array_distinct(folders), lambda f: F.struct(F.when(f == "", 0).when(f.rlike("(^|/)include$"), 1).otherwise(2).alias("o"), f.alias("f")))
    return F.transform(F.array_sort(order), lambda x: F.concat(F.lit("-I"), F.when(x["f"] == "", ".").otherwise(x["f"])))


def per_10000(part: Column, whole: Column) -> Column:
    return F.floor(part * 10000 / F.greatest(whole, F.lit(1)) + F.lit(0.5)).cast("long")


def c_verdict(parse_errors: Column, other_errors: Column) -> Column:
    """valid, invalid (parse errors only) or indeterminate."""
    return F.when(parse_errors == 0, "valid").when(other_errors == 0, "invalid").otherwise("indeterminate")
