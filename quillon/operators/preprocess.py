"""Conditional branches of C-family sources, as expressions over lines and windows over directives.

``reduced`` blanks what declared symbols rule out: a fold over a file's directives whose state is a stack
with a letter for each open conditional.  Conditions are read by another fold, a machine with a
stack of truth values and operators.  Truth is T, F or U, for what can't be decided.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce as chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.runtime import written

#: What each language declares.  None: known to be undefined.
DECLARED: dict[str, dict[str, int | None]] = {"c": {"__cplusplus": None}, "cpp": {"__cplusplus": 201703}}
_DIRECTIVE = r"(?s)^\s*#\s*(\w+)\s*(.*?)\s*$"
_PART = r"(&&|\|\||\w+|\S)"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def _conj(x: Column, y: Column) -> Column:
    return F.when((x == "F") | (y == "F"), "F").when((x == "U") | (y == "U"), "U").otherwise("T")


def _cut(s: Column, n: int) -> Column:
    """A string without its last ``n`` characters."""
    return F.substring(s, F.lit(1), F.length(s) - n)


def _or_folded(stack: Column) -> Column:
    """``X|Y`` at the end of a stack as one value."""

    def fold(s: Column) -> Column:
        x, y = F.substring(s, -3, 1), F.substring(s, -1, 1)
        both = F.when((x == "T") | (y == "T"), "T").when((x == "U") | (y == "U"), "U").otherwise("F")
        return F.when(s.rlike(r"[TFU]\|[TFU]$"), F.concat(_cut(s, 3), both)).otherwise(s)

    return _let(stack, fold)


def _with_value(stack: Column, value: Column) -> Column:
    """A stack with a value on it, the negations and the conjunction before it carried out."""

    def fold(x: Column) -> Column:
        odd = F.length(F.regexp_extract(x["s"], "(!*)$", 1)) % 2 == 1
        own = F.struct(F.regexp_replace(x["s"], "!+$", "").alias("s"), F.when(odd, F.translate(x["v"], "TF", "FT")).otherwise(x["v"]).alias("v"))
        return _let(own, lambda y: F.when(y["s"].endswith("&"), F.concat(_cut(y["s"], 2), _conj(F.substring(y["s"], -2, 1), y["v"]))).otherwise(F.concat(y["s"], y["v"])))

    return _let(F.struct(stack.alias("s"), value.alias("v")), fold)


def _truth(number: Column) -> Column:
    return F.when(number != 0, "T").otherwise("F")


def _defined(name: Column, own: Column, declared: Column) -> Column:
    known = F.try_element_at(declared, name)
    return F.when(F.map_contains_key(own, name) | (known != "undefined"), "T").when(known.isNotNull(), "F").otherwise("U")


def _word(word: Column, own: Column, declared: Column) -> Column:
    """A word as a value: a number, or the number that a name stands for."""
    number, known = word.try_cast("bigint"), F.coalesce(F.try_element_at(own, word), F.try_element_at(declared, word))
    return F.when(word.rlike("^\\d+$") & number.isNotNull(), _truth(number)).when(known == "undefined", "F").when(known.try_cast("bigint").isNotNull(), _truth(known.try_cast("bigint"))).otherwise("U")


def condition(text: Column, own: Column, declared: Column) -> Column:
    """T, F or U for the condition of an ``#if``; own and declared map names to numbers, to ``undefined`` or,
    where a name stands for something else, to other texts.

    Where a value is due, any word is one; a word in an operator's place, or a bracket too many, leaves
    the whole undecided, and so does what isn't closed or finished where nothing else decides.
    The state is what is due (v a value, o an operator, d p q the parts of ``defined (x)``, e none) and the
    stack; n holds whether the name in ``defined (x)`` is.
    """
    parts = F.regexp_extract_all(text, F.lit(_PART), F.lit(1))
    state = lambda due, stack, n=F.lit(""): F.struct(due.alias("due") if isinstance(due, Column) else F.lit(due).alias("due"), stack.alias("stack"), n.alias("n"))

    def after_value(stack: Column, t: Column) -> Column:
        def one(x: Column) -> Column:
            closed = _let(_or_folded(x), lambda y: _with_value(_cut(y, 2), F.substring(y, -1, 1)))
            return F.when(t == "&&", state("v", F.concat(x, F.lit("&")))).when(t == "||", state("v", F.concat(_or_folded(x), F.lit("|")))).when((t == ")") & x.contains("("), state("o", closed)).otherwise(state("e", x))

        return _let(stack, one)

    def step(s: Column, t: Column) -> Column:
        stack = s["stack"]
        value = F.when(t == "!", state("v", F.concat(stack, F.lit("!")))).when(t == "(", state("v", F.concat(stack, F.lit("(")))).when(t == "defined", state("d", stack)).otherwise(state("o", _with_value(stack, _word(t, own, declared))))
        name = F.when((s["due"] == "d") & (t == "("), state("p", stack)).when(s["due"] == "d", state("o", _with_value(stack, _defined(t, own, declared)))).otherwise(state("q", stack, _defined(t, own, declared)))
        ended = F.when(t == ")", state("o", _with_value(stack, s["n"]))).otherwise(after_value(_with_value(stack, F.lit("U")), t))
        return F.when(s["due"] == "v", value).when(s["due"] == "o", after_value(stack, t)).when(s["due"].isin("d", "p"), name).when(s["due"] == "q", ended).otherwise(s)

    def result(s: Column) -> Column:
        whole = F.when(s["due"].isin("v", "d", "p", "q"), _with_value(s["stack"], F.lit("U"))).otherwise(s["stack"])
        whole = _let(whole, lambda w: F.when(w.contains("("), _with_value(F.regexp_replace(w, r"(?s)\(.*$", ""), F.lit("U"))).otherwise(w))
        return F.when(s["due"] == "e", "U").otherwise(F.substring(_or_folded(whole), -1, 1))

    return F.aggregate(parts, state("v", F.lit("")), step, result)


def directives(lines: Column) -> Column:
    """(i, word, rest) of each directive of an array of lines; i counts from 0."""
    each = F.transform(lines, lambda x, i: F.struct(i.cast("int").alias("i"), F.regexp_extract(x, _DIRECTIVE, 1).alias("word"), F.regexp_extract(x, _DIRECTIVE, 2).alias("rest")))
    return F.filter(each, lambda d: d["word"] != "")


def reduced(text: Column, language: str) -> Column:
    """struct(text, decided, undecided) of a source column; null stays null.

    Lines keep their numbers: dead ones and the directives of decided conditionals are blank.  An
    undecided conditional stays as written, with all its branches; of a decided one the first true
    branch stays, and a branch after untaken ones isn't evaluated.  What a live line defines is known
    below it.  Directives without their ``#if`` are plain lines.

    The stack's letters: u undecided; of a decided conditional a in its branch that stays, n before it,
    z after it.  A line is live if no letter is n or z.
    """
    pairs = [(k, "undefined" if v is None else str(v)) for k, v in DECLARED[language].items()]
    declared = F.create_map(*(F.lit(x) for kv in pairs for x in kv))
    lines = F.split(text, "\n")
    live = lambda stack: ~stack.rlike("[nz]")

    def put(s: Column, stack: Column, own: Column, d: Column, shown: Column, decided: Column, undecided: Column) -> Column:
        row = F.struct(d["i"].alias("i"), shown.alias("shown"), live(stack).alias("live"))
        return F.struct(stack.alias("stack"), own.alias("own"), F.array_append(s["rows"], row).alias("rows"), (s["decided"] + decided).alias("decided"), (s["undecided"] + undecided).alias("undecided"))

    def step(s: Column, d: Column) -> Column:
        stack, own, word, zero = s["stack"], s["own"], d["word"], F.lit(0)
        first = F.regexp_extract(d["rest"], r"^(\S*)", 1)
        given = _defined(first, own, declared)
        value = F.when(word == "ifdef", given).when(word == "ifndef", F.translate(given, "TF", "FT")).otherwise(condition(d["rest"], own, declared))
        value = F.when(live(stack), value).otherwise("U")
        opened = _let(value, lambda v: put(s, F.concat(stack, F.translate(v, "TFU", "anu")), own, d, live(stack) & (v == "U"), (v != "U").cast("int"), (live(stack) & (v == "U")).cast("int")))
        top, below = F.substring(stack, -1, 1), _cut(stack, 1)
        turned = put(s, F.concat(below, F.translate(top, "anz", "zaz")), own, d, live(below) & (top == "u"), zero, zero)
        closed = put(s, below, own, d, live(below) & (top == "u"), zero, zero)
        name, number = F.regexp_extract(d["rest"], r"^([^\s(]*)", 1), F.trim(F.regexp_extract(d["rest"], r"^[^\s(]*[\s(]?(.*)$", 1))
        others = F.map_filter(own, lambda k, v: k != F.when(word == "define", name).otherwise(d["rest"]))
        known = F.when(number.rlike(r"^[+-]?\d+$") & number.try_cast("bigint").isNotNull(), number.try_cast("bigint").cast("string")).otherwise("other")
        grown = F.when((word == "define") & (name != ""), F.map_concat(others, F.create_map(name, known))).when(word == "undef", others).otherwise(own)
        plain = put(s, stack, F.when(live(stack), grown).otherwise(own), d, live(stack), zero, zero)
        inside = stack != ""
        return F.when(word.isin("if", "ifdef", "ifndef"), opened).when(word.isin("elif", "else") & inside, turned).when((word == "endif") & inside, closed).otherwise(plain)

    row = "array<struct<i:int,shown:boolean,live:boolean>>"
    start = F.struct(F.lit("").alias("stack"), F.create_map().cast("map<string,string>").alias("own"), F.array().cast(row).alias("rows"), F.lit(0).alias("decided"), F.lit(0).alias("undecided"))
    done = F.aggregate(directives(lines), start, step)
    # each directive decides for itself and for the lines up to the next one
    stops = lambda r: F.slice(F.concat(F.transform(r, lambda x: x["i"]), F.array(F.size(lines))), 2, F.size(r))
    marks = lambda r: F.concat(
        F.array_repeat(F.lit(True), F.coalesce(F.get(r, F.lit(0))["i"], F.size(lines))),
        F.flatten(F.zip_with(r, stops(r), lambda x, z: F.concat(F.array(x["shown"]), F.array_repeat(x["live"], z - x["i"] - 1)))),
    )
    seen = lambda r: F.zip_with(lines, marks(r), lambda x, m: F.when(m, x).otherwise(""))
    return F.when(text.isNotNull(), _let(done, lambda x: F.struct(F.array_join(seen(x["rows"]), "\n").alias("text"), x["decided"].alias("decided"), x["undecided"].alias("undecided"))))


def forced(lines: Column, start: Column, mid: Column, end: Column, keep_if: Column) -> Column:
    """Lines (an array) with one branch of a region kept, the other and the directives blank; every line keeps its number."""
    boundary = F.coalesce(mid, end)

    def one(line: Column, i: Column) -> Column:
        n = i + 1
        first, second = (n > start) & (n < boundary), mid.isNotNull() & (n > boundary) & (n < end)
        gone = (n == start) | (n == end) | n.eqNullSafe(mid) | (first & ~keep_if) | (second & keep_if)
        return F.when(gone, "").otherwise(line)

    return F.transform(lines, one)


def line_survives(lines: Column, line: Column) -> Column:
    """Whether a line (from 1) is there and not blank."""
    return F.coalesce(F.trim(F.get(lines, line - 1)) != "", F.lit(False))


def region_rows(files: DataFrame, file_id: str, text: str) -> DataFrame:
    """file_id, start, mid, end (lines from 1) of each complete conditional with at most two branches.
    Chains with ``#elif`` or several ``#else`` have no safe two-way split.

    Windows over directives give each its level; a conditional's parts follow each other on its level.
    Directives without their ``#if`` belong to none.
    """
    rows = files.select(F.col(file_id).alias("file_id"), F.inline(directives(F.split(F.col(text), "\n")))).where(F.col("word").isin("if", "ifdef", "ifndef", "elif", "else", "endif"))
    opens = F.col("word").startswith("if")
    order = Window.partitionBy("file_id").orderBy("i")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("raw", F.sum(F.when(opens, 1).when(F.col("word") == "endif", -1).otherwise(0)).over(so_far))
    rows = rows.withColumn("low", F.least(F.lit(0), F.min("raw").over(so_far)))
    stray = (F.col("word") == "endif") & (F.col("raw") < F.coalesce(F.lag("low").over(order), F.lit(0)))
    rows = rows.withColumn("stray", stray).withColumn("level", F.col("raw") - F.col("low") + (F.col("word") == "endif").cast("int")).where("not stray and level > 0")
    own = Window.partitionBy("file_id", "level").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    at = lambda w: F.min(F.when(F.col("word") == w, F.col("i") + 1))
    g = rows.withColumn("_n", F.count(F.when(opens, 1)).over(own)).where("_n > 0").groupBy("file_id", "level", "_n")
    g = g.agg(F.min("i").alias("first"), at("else").alias("mid"), at("endif").alias("end"), F.count_if(F.col("word") == "elif").alias("elifs"), F.count_if(F.col("word") == "else").alias("elses"))
    return g.where("end is not null and elifs = 0 and elses < 2").select("file_id", (F.col("first") + 1).cast("long").alias("start"), F.col("mid").cast("long").alias("mid"), F.col("end").cast("long").alias("end"))


def innermost(regions: DataFrame, points: DataFrame) -> DataFrame:
    """points (file_id, line, ...) with the smallest region (start, mid, end) around each, nulls without one."""
    inner = points.select("file_id", "line").distinct().join(regions, "file_id").where("start <= line and line <= end")
    best = inner.groupBy("file_id", "line").agg(F.min_by(F.struct("start", "mid", "end"), F.struct(F.col("end") - F.col("start"), F.col("end"))).alias("r"))
    return points.join(best, ["file_id", "line"], "left").select(*points.columns, "r.*")


def resolve_splits(files: DataFrame, first_error: Callable[[DataFrame], DataFrame], rounds: int = 8) -> DataFrame:
    """files (file_id, text) with line, the first error that no forced branch explains (null if none is
    left), and solved, the number of splits resolved.

    ``first_error`` gives (key, line) for those texts (key, text) that have an error.  A round forces the
    innermost region around each error either way, for all files at once; a choice counts if the error's own
    line is still there and the text is clean or its first error lies further on, the first branch
    before the second.  Files whose error has no region, or that neither choice helps, leave the rounds.
    """
    errors = first_error(files.select(F.col("file_id").alias("key"), "text")).select(F.col("key").alias("file_id"), "line")
    now = written(files.select("file_id", "text").join(errors, "file_id", "left").withColumn("solved", F.lit(0)), "splits")
    left = []
    for _ in range(rounds):
        found = innermost(region_rows(now.where("line is not null"), "file_id", "text"), now.where("line is not null").select("file_id", "line")).where("start is not null")
        lines = F.split("text", "\n")
        tries = now.join(found, ["file_id", "line"]).withColumn("first", F.explode(F.array(F.lit(True), F.lit(False))))
        tries = tries.withColumn("made", forced(lines, F.col("start"), F.col("mid"), F.col("end"), F.col("first"))).where(line_survives(F.col("made"), F.col("line").cast("int")))
        tries = written(tries.select(F.struct("file_id", "first").alias("key"), "line", "solved", F.array_join("made", "\n").alias("text")), "tries")
        after = first_error(tries.select("key", "text")).select("key", F.col("line").alias("next"))
        better = tries.join(after, "key", "left").where("next is null or next > line").select(F.col("key.file_id").alias("file_id"), F.struct((~F.col("key.first")).alias("o"), "text", F.col("next").alias("line"), (F.col("solved") + 1).alias("solved")).alias("x"))
        better = written(better.groupBy("file_id").agg(F.min("x").alias("x")).select("file_id", "x.text", "x.line", "x.solved"), "splits")
        left.append(now.join(better, "file_id", "left_anti"))
        now = better
        if not now.where("line is not null").take(1):
            break
    return chain(DataFrame.unionByName, [*left, now]).select("file_id", "line", "solved")


def macro_census(files: DataFrame) -> DataFrame:
    """package, name, params (null for a plain macro) and body of files (package, ord, text): the last
    definition of a package's files wins, unless an ``#undef`` comes after it.

    Lines are joined across backslashes first.  Definitions without anything after the name don't count.
    """
    joined = F.regexp_replace(F.regexp_replace("text", r"\\\r?\n", " "), r"\r(?=\n|$)", "")
    lines = files.select("package", "ord", F.posexplode(F.split(joined, "\n")).alias("line", "x")).where(F.col("x").rlike(r"^\s*#\s*(define\s|undef)"))
    define = r"^\s*#\s*define\s+(\w+)(\W.*)$"
    undone = F.regexp_extract("x", r"^\s*#\s*undef\s*(\S+)", 1)
    found = lines.select("package", "ord", "line", F.regexp_extract("x", define, 1).alias("name"), F.regexp_extract("x", define, 2).alias("rest"), undone.alias("undone"))
    closed = F.regexp_extract("rest", r"^\(([^)]*)\)(.*)$", 1)
    is_call = F.col("rest").startswith("(")
    params = F.when(is_call, F.filter(F.transform(F.split(closed, ","), lambda p: F.trim(p)), lambda p: p != ""))
    body = F.trim(F.when(is_call, F.regexp_extract("rest", r"^\(([^)]*)\)(.*)$", 2)).otherwise(F.col("rest")))
    usable = (F.col("undone") != "") | ((F.col("name") != "") & (~is_call | F.col("rest").contains(")")))
    each = found.where(usable).select("package", F.when(F.col("undone") != "", F.col("undone")).otherwise(F.col("name")).alias("name"), F.struct("ord", "line").alias("at"), F.when(F.col("undone") == "", F.struct(params.alias("params"), body.alias("body"))).alias("m"))
    last = each.groupBy("package", "name").agg(F.max_by("m", "at").alias("m"))
    return last.where("m is not null").select("package", "name", "m.params", "m.body")


def names_near(lines: Column, line: Column, names: Column) -> Column:
    """Those of ``names`` that occur in a line (from 1) or its neighbours; distinct, in order."""
    near = F.slice(lines, F.greatest(line - 1, F.lit(1)), F.when(line > 1, 3).otherwise(2))
    words = F.regexp_extract_all(F.array_join(near, "\n"), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), 1)
    return F.array_sort(F.array_distinct(F.array_intersect(words, names)))
