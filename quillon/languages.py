"""The registry of languages and the points at which one is extended.

An ecosystem ranks and resolves packages and takes files by column expressions; an oracle judges
texts; a span oracle lists another parser's nodes; a reformatter and an unparser print.  Python's
own parser is the one oracle that every worker has.
"""

from __future__ import annotations

import ast
import io
import tokenize
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import headers, paths
from quillon.runtime import ship

REGISTRY_SCHEMA = "name string, ord int, extensions array<string>, grammar string, rosetta boolean, spans boolean, formatter boolean, printer boolean"
#: Name, extensions (the first names invented files), grammar, whether programs are compared
#: across languages, and which of spans, formatter and printer there are.
LANGUAGES = [
    ("python", ["py", "pyi"], "python", True, (True, True, True)),
    ("rust", ["rs"], "rust", True, (True, True, True)),
    ("typescript", ["ts", "tsx", "mts", "cts"], "typescript", True, (True, True, True)),
    ("javascript", ["js", "jsx", "mjs", "cjs"], "typescript", False, (True, True, True)),
    ("java", ["java"], "java", False, (True, False, False)),
    ("bash", ["sh", "bash"], "bash", False, (True, False, False)),
    ("c", ["c", "h"], "c", False, (True, False, False)),
    ("cpp", ["cc", "cpp", "cxx", "hpp", "hh", "hxx"], "cpp", False, (True, False, False)),
    ("ruby", ["rb"], "ruby", True, (True, False, False)),
    ("zig", ["zig", "zon"], "zig", False, (False, True, False)),
]


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, i, e, g, r, *caps) for i, (n, e, g, r, caps) in enumerate(LANGUAGES)], REGISTRY_SCHEMA)


def grammar_extensions(languages: DataFrame) -> DataFrame:
    """name, all_extensions: every extension that the language's grammar handles, dialects' included."""
    each = languages.select("grammar", "ord", F.posexplode("extensions").alias("i", "x"))
    every = each.groupBy("grammar").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "i", "x"))), lambda s: s["x"]).alias("all_extensions"))
    return languages.select("name", "grammar").join(every, "grammar").select("name", "all_extensions")


def shared_claims(claims: DataFrame, claim: str, owner: str) -> DataFrame:
    """``claim`` and its owners, comma-joined, where there is more than one."""
    g = claims.select(claim, owner).distinct().groupBy(claim).agg(F.array_sort(F.collect_list(owner)).alias("owners"))
    return g.where(F.size("owners") > 1).select(claim, F.array_join("owners", ",").alias("owners"))


class Oracle(Protocol):
    """Verdicts of the union of versions, the current version, and (None if it can't) the parser alone.
    A text that can't be read is an error, never invalid."""

    def validate(self, texts: list[bytes | None]) -> list[bool | None]: ...

    def validate_current(self, texts: list[bytes | None]) -> list[bool | None]: ...

    def validate_syntax_only(self, texts: list[bytes | None]) -> list[bool | None] | None: ...


class Spans(Protocol):
    def spans(self, text: str) -> list[tuple[int, int, str]]: ...


class Reformatter(Protocol):
    def available(self) -> bool: ...

    def reformat(self, text: str) -> tuple[str | None, str | None]: ...


class Unparser(Protocol):
    def unparse(self, text: str) -> tuple[str | None, str | None]: ...


@dataclass
class Ecosystem:
    """How a language's corpus is taken: by path, then by content."""

    name: str
    max_bytes: int | None = None
    strip: int | None = None
    inner: str | None = None

    def classify(self, path: Column) -> Column:
        return paths.takes(path, self.name)

    def admit(self, path: Column, text: Column) -> Column:
        if self.name == "bash":
            return paths.is_shell(path, text)
        if self.name == "zig":
            return F.instr(text, "\0") == 0
        if self.name in ("c", "cpp"):
            return F.when(paths.extension(path) == "h", headers.header_language(path, text) == self.name).otherwise(F.lit(True))
        return F.lit(True)

    def fits(self, size: Column) -> Column:
        return F.lit(True) if self.max_bytes is None else size <= self.max_bytes


ECOSYSTEMS = {n: Ecosystem(n, 250_000_000 if n in ("bash", "c", "cpp") else None, inner="data.tar.gz" if n == "ruby" else None) for n, *_ in LANGUAGES}


@dataclass
class PythonParser:
    """Python's own parser as oracle, span oracle and unparser."""

    feature_version: tuple[int, int] | None = None
    kinds: tuple[type, ...] = field(default=(ast.stmt, ast.expr, ast.excepthandler, ast.arg, ast.keyword, ast.alias))

    def _accepts(self, text: bytes | None, whole: bool) -> bool | None:
        if text is None:
            return None
        try:
            tree = ast.parse(text, feature_version=self.feature_version)
            if whole:
                compile(tree, "<text>", "exec", dont_inherit=True)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
        return True

    def validate(self, texts):
        return [self._accepts(t, True) for t in texts]

    validate_current = validate

    def validate_syntax_only(self, texts):
        return [self._accepts(t, False) for t in texts]

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) in bytes of every node that has a place."""
        at, starts = 0, []
        for line in text.split("\n"):
            starts.append(at)
            at += len(line.encode()) + 1
        place = lambda line, column: starts[line - 1] + column
        return sorted((place(n.lineno, n.col_offset), place(n.end_lineno, n.end_col_offset), type(n).__name__) for n in ast.walk(ast.parse(text)) if isinstance(n, self.kinds))

    def edges(self, text: str) -> list[tuple[str, str, str]]:
        """(parent kind, field, child kind) of every labelled edge between placed nodes."""
        return [(type(n).__name__, f, type(c).__name__) for n in ast.walk(ast.parse(text)) for f, v in ast.iter_fields(n) for c in (v if isinstance(v, list) else [v]) if isinstance(c, self.kinds)]

    def tokens(self, text: str) -> list[str]:
        return [t.string for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.string.strip()]

    def error_offset(self, text: str) -> int | None:
        """Byte at which the parser gives up, None for a clean text."""
        try:
            ast.parse(text)
        except SyntaxError as e:
            lines = text.split("\n")[: (e.lineno or 1) - 1]
            line = (text.split("\n") + [""])[(e.lineno or 1) - 1]
            return len("\n".join([*lines, ""]).encode()) + len(line[: max(0, (e.offset or 1) - 1)].encode())
        return None

    def unparse(self, text: str) -> tuple[str | None, str | None]:
        """(canonical text, None) or (None, why not)."""
        try:
            return ast.unparse(ast.parse(text)), None
        except (SyntaxError, ValueError, RecursionError) as e:
            return None, f"{type(e).__name__}: {e}"


ORACLES = {"python": PythonParser()}


def judged(files: DataFrame, language: str) -> DataFrame:
    """``files`` (path, content, ...) with valid, current and syntax: the oracle's verdicts, null for what can't be read."""
    ship(files.sparkSession)
    oracle = ORACLES[language]

    @F.pandas_udf("valid boolean, current boolean, syntax boolean")
    def run(content: pd.Series) -> pd.DataFrame:
        texts = [None if x is None else bytes(x) for x in content]
        syntax = oracle.validate_syntax_only(texts) or [None] * len(texts)
        return pd.DataFrame({"valid": oracle.validate(texts), "current": oracle.validate_current(texts), "syntax": syntax}).astype("boolean")

    return files.select("*", run("content").alias("_v")).select(*files.columns, "_v.*")


def union_valid(first: DataFrame, second, key: str = "path") -> DataFrame:
    """``key``, valid by two version oracles: ``second`` is asked about the first's rejects only and can only accept more."""
    rejected = first.where(~F.col("valid"))
    more = second(rejected.drop("valid")).select(key, F.col("valid").alias("_also"))
    return first.join(more, key, "left").select(key, F.coalesce(F.col("valid") | F.coalesce("_also", F.lit(False)), F.col("valid")).alias("valid"))


def unanswered(asked: DataFrame, answered: DataFrame, key: str = "path") -> DataFrame:
    """Inputs that an oracle gave no answer for: any is an error."""
    return asked.select(key).join(answered.select(key), key, "left_anti")


def roundtrip(files: DataFrame, language: str) -> DataFrame:
    """path, rendered (what the printer made of a text), skipped (why it declined) and reparsed (whether the print is valid)."""
    ship(files.sparkSession)
    oracle = ORACLES[language]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            made = [oracle.unparse(t) for t in p["text"]]
            again = [None if x is None else oracle.validate_syntax_only([x.encode()])[0] for x, _ in made]
            yield pd.DataFrame({"path": p["path"], "rendered": [x for x, _ in made], "skipped": [w for _, w in made], "reparsed": pd.array(again, dtype="boolean")})

    return files.select("path", "text").mapInPandas(run, "path string, rendered string, skipped string, reparsed boolean")
