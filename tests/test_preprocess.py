"""Conditionals, their regions and splits, and shared headers, against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.functions import headers
from quillon.operators import preprocess as p
from quillon.plans.corpus_queries import unbalanced
from quillon.sources import sinks


def plain_condition(text, names):
    """names: to a number, None (undefined) or "other"."""
    todo = re.findall(r"&&|\|\||\w+|\S", text)
    is_defined = lambda n: n in names and names[n] is not None if n in names else None

    def disjunction():
        values = [conjunction()]
        while todo[:1] == ["||"]:
            todo.pop(0)
            values.append(conjunction())
        return True if True in values else None if None in values else False

    def conjunction():
        values = [single()]
        while todo[:1] == ["&&"]:
            todo.pop(0)
            values.append(single())
        return False if False in values else None if None in values else True

    def single():
        if not todo:
            return None
        t = todo.pop(0)
        if t == "!":
            inner = single()
            return None if inner is None else not inner
        if t in ("(", "defined"):
            bracket = t == "(" or todo[:1] == ["("] and bool(todo.pop(0))
            value = disjunction() if t == "(" else is_defined(todo.pop(0)) if todo else None
            if bracket and todo[:1] != [")"]:
                return None
            return value if not bracket or todo.pop(0) else None
        known = int(t) if t.isdigit() else names.get(t, "other")
        return None if known == "other" else bool(known)

    value = disjunction()
    return None if todo else value


def plain_reduce(text, declared):
    """One line after the other, a list of [kind, branch] for the open conditionals."""
    out, stack, own, counts = [], [], {}, [0, 0]
    runs = lambda frames: all(kind is None or branch == (0 if kind else 1) for kind, branch in frames)
    for line in text.split("\n"):
        m = re.match(r"\s*#\s*(\w+)\s*(.*?)\s*$", line)
        word, rest = m.groups() if m else ("", "")
        known = {**declared, **own}
        if word in ("if", "ifdef", "ifndef"):
            value, on = None, runs(stack)
            if on:
                name = (rest.split() or [""])[0]
                given = known[name] is not None if name in known else None
                value = plain_condition(rest, known) if word == "if" else given if word == "ifdef" or given is None else not given
                counts[value is None] += 1
            stack.append([value, 0])
            out.append(line if on and value is None else "")
        elif word in ("elif", "else", "endif") and stack:
            out.append(line if runs(stack[:-1]) and stack[-1][0] is None else "")
            if word == "endif":
                stack.pop()
            else:
                stack[-1][1] += 1
        else:
            if runs(stack) and word == "define" and rest:
                name, _, value = re.match(r"([^\s(]*)([\s(]?)(.*)", rest).groups()
                own |= {name: int(value) if re.fullmatch(r"[+-]?\d+", value.strip()) else "other"} if name else {}
            elif runs(stack) and word == "undef":
                own.pop(rest, None)
            out.append(line if runs(stack) else "")
    return "\n".join(out), *counts


CASES = [
    ("", ("", 0, 0)),
    ("a\n#ifdef __cplusplus\nb\n#else\nc\n#endif\nd", ("a\n\n\n\nc\n\nd", 1, 0)),
    ("#if X\na\n#endif", ("#if X\na\n#endif", 0, 1)),
    ("#if 0\n#if X\na\n#endif\n#elif Y\nb\n#else\nc\n#endif", ("\n\n\n\n\nb\n\n\n", 1, 0)),
    ("#define A 1\n# if A && !defined B\na\n#endif", ("#define A 1\n# if A && !defined B\na\n#endif", 0, 1)),
    ("#define A 0\n#if A && X\na\n#endif\n#undef A\n#if A\n#endif", ("#define A 0\n\n\n\n#undef A\n#if A\n#endif", 1, 1)),
    ("#if 1 || X > 2\na\n#endif", ("#if 1 || X > 2\na\n#endif", 0, 1)),
    ("#else\n#endif\nx", ("#else\n#endif\nx", 0, 0)),
]


def sources(n=300):
    rng = random.Random(4)
    parts = ["A", "B", "__cplusplus", "0", "1", "7", "&&", "||", "!", "(", ")", "defined", "defined(A)", "defined B", ">", ""]
    def line():
        any_ = lambda k: " ".join(rng.choice(parts) for _ in range(rng.randint(0, k)))
        return rng.choice(["#if " + any_(7), "# ifdef " + rng.choice(parts[:3]), "#ifndef " + rng.choice(parts[:3]), "#else", "#elif " + any_(3), "#endif", "  #endif ", "#define A " + rng.choice(["1", "0", "x", "-2", ""]), "#define B(x) 1", "#undef A", "text", "", "#error"])
    return ["\n".join(line() for _ in range(rng.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("language", ["c", "cpp"])
def test_reduced(spark, language):
    texts = [t for t, _ in CASES] + sources()
    d = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, s string")
    got = {r.i: r.r for r in d.select("i", p.reduced(F.col("s"), language).alias("r")).collect()}
    assert got[-1] is None
    for i, t in enumerate(texts):
        assert tuple(got[i]) == plain_reduce(t, p.DECLARED[language]), t
    if language == "c":
        assert [tuple(got[i]) for i in range(len(CASES))] == [w for _, w in CASES]


def plain_regions(text):
    out, open_ = [], []
    for n, line in enumerate(text.split("\n"), 1):
        m = re.match(r"\s*#\s*(\w+)", line)
        word = m[1] if m else ""
        if word in ("if", "ifdef", "ifndef"):
            open_.append([n])
        elif word in ("else", "elif") and open_:
            open_[-1].append(n if word == "else" else None)
        elif word == "endif" and open_:
            start, *later = open_.pop()
            if len(later) < 2 and None not in later:
                out.append((start, later[0] if later else None, n))
    return sorted(out, key=str)


def test_regions(spark):
    texts = sources(200)
    rows = p.region_rows(spark.createDataFrame(list(enumerate(texts)), "i int, s string"), "i", "s").collect()
    for i, t in enumerate(texts):
        assert sorted(((r.start, r.mid, r.end) for r in rows if r.file_id == i), key=str) == plain_regions(t), t
    assert len(rows) > 100


WAYS = "begin\n# ifdef WIDE\nopen {\n# else\nopen { more\n# endif\nclose }\nend"


def test_forced(spark):
    lines = F.split(F.lit(WAYS), "\n")
    for keep, kept, gone in ((True, 3, 5), (False, 5, 3)):
        made = p.forced(lines, F.lit(2), F.lit(4), F.lit(6), F.lit(keep))
        r = spark.range(1).select(made.alias("l"), p.line_survives(made, F.lit(kept)).alias("a"), p.line_survives(made, F.lit(gone)).alias("b")).first()
        assert len(r.l) == 8 and (r.a, r.b) == (True, False) and r.l[6] == "close }"


def test_resolve_splits(spark):
    bad = "x\n}\ny"
    nested = "#if A\n#if B\n{\n#else\n{\n{\n#endif\n}\n#else\n}\n#endif"
    texts = ["fine", WAYS, WAYS + "\n" + WAYS, bad, "#if Q\n{{\n#endif", nested, WAYS.replace("open {", "open {{"), None, "\n".join([WAYS] * 10)]
    files = spark.createDataFrame(list(enumerate(texts)), "file_id long, text string")
    got = {r.file_id: (r.line, r.solved) for r in p.resolve_splits(files, unbalanced).collect()}
    # the eighth round leaves the error at the next of ten splits
    assert got == {0: (None, 0), 1: (None, 1), 2: (None, 2), 3: (2, 0), 4: (2, 0), 5: (6, 1), 6: (3, 0), 7: (None, 0), 8: (69, 8)}


def plain_header(path, text):
    """Characters first: comments and literals go, then lines are read."""
    if {"c++", "cxx", "cpp", "include-c++"} & set(path.lower().split("/")[:-1]):
        return "cpp"
    out, at = "", 0
    while at < len(text):
        two, one = text[at : at + 2], text[at]
        if two == "/*":
            end = text.find("*/", at + 2)
            piece = text[at:] if end < 0 else text[at : end + 2]
            out += "\n" * piece.count("\n")
        elif two == "//":
            piece = text[at:].split("\n")[0]
        elif one in "\"'":
            piece = re.match(rf"(?s){one}(?:[^{one}\\]|\\.?)*{one}?", text[at:])[0]
            out += " "
        else:
            piece = one
            out += one
        at += len(piece)
    open_ = []
    for line in map(str.lstrip, out.split("\n")):
        if line.startswith("#"):
            word = (line[1:].split() or [""])[0]
            if word.startswith("if"):
                open_.append("__cplusplus" in line)
            elif word in ("else", "elif") and open_:
                open_[-1] |= "__cplusplus" in line
            elif word == "endif":
                open_ = open_[:-1]
        elif True not in open_ and line.startswith(headers.MARKERS):
            return "cpp"
    return "c"


def test_headers(spark):
    rng = random.Random(6)
    parts = ["class A;", "namespace x {", "int y;", "#ifdef __cplusplus", "#if B", "#else", "#elif __cplusplus", "#endif", "/*", "*/", "//", '"', "'", "\\", "  public:", "subclass z", ""]
    rows = [("a.h", "\n".join("".join(rng.choice(parts) for _ in range(rng.choice([1, 1, 2]))) for _ in range(rng.randint(0, 12)))) for _ in range(400)]
    rows += [("include/C++/x.h", "int a;"), ("c++lib/x.h", "int a;"), ("c++", "int a;"), ("x.h", "y" * 199_994 + "\nclass A"), ("x.h", "y" * 199_995 + "\nclass A"), ("x.h", "é" * 99_999 + "\nclass A"), ("x.h", "/*" + "*x\n" * 60_000), ("x.h", '"' + "\\x" * 50_000 + '"\nclass A')]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, t string")
    got = {r.i: r.x for r in d.select("i", headers.header_language(F.col("p"), F.col("t")).alias("x")).collect()}
    for i, (path, text) in enumerate(rows):
        assert got[i] == plain_header(path, text.encode()[:200_000].decode("utf-8", "replace")), (path, text[:300])
    assert spark.createDataFrame([(None, None), ("x.h", bytearray(b"\xff\nclass A"))], "p string, t binary").select(headers.header_language(F.col("p"), F.col("t"))).collect() == [("c",), ("cpp",)]


def test_names_near(spark):
    d = spark.createDataFrame([(["B a", "A B", "x", "C"], ["C", "B", "A"])], "l array<string>, n array<string>")
    near = lambda i: p.names_near(F.col("l"), F.lit(i), F.col("n"))
    assert list(d.select(near(1), near(2), near(4)).first()) == [["A", "B"], ["A", "B"], ["C"]]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a",), ("a",), ("b",)], "sha256 string")
    sinks.pass_cache(d, "g1", f"{tmp_path}/cache")
    sinks.pass_cache(d.limit(0), "g2", f"{tmp_path}/cache")
    assert sorted(r.sha256 for r in sinks.cached(spark, f"{tmp_path}/cache", "g1").collect()) == ["a", "b"]
    sinks.publish(d, f"{tmp_path}/out", lambda x: x.count() == 3)
    with pytest.raises(ValueError):
        sinks.publish(d, f"{tmp_path}/other", lambda x: False)
    with pytest.raises(FileExistsError):
        sinks.publish(d, f"{tmp_path}/out", lambda x: True)
    assert sorted(x.name for x in tmp_path.iterdir()) == ["cache", "out"]
