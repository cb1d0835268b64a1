"""Grammars as data: rows of their rules, lint metrics, and programs derived from choice tapes.

A grammar is a JSON document.  Its rules are flattened to one row a node, so that every metric is a
count over rows.  A derivation follows a tape of bytes, one for each choice or repetition; off the
end of the tape, and past a depth, the shortest alternative is taken, so a shorter tape always
gives a simpler program and tapes can be cut, changed and shrunk freely.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.recovery import draws
from quillon.runtime import ship

MAX_DEPTH, MAX_STEPS, ENDLESS = 18, 4000, 1 << 20
#: Node types that bear on structure, not on text.
WRAPPERS = {"PREC", "PREC_LEFT", "PREC_RIGHT", "PREC_DYNAMIC", "FIELD", "ALIAS", "TOKEN", "IMMEDIATE_TOKEN", "RESERVED"}
ROWS = "grammar string, rule string, path string, type string, value string, immediate boolean, members int"


def rule_rows(grammars: DataFrame) -> DataFrame:
    """``ROWS`` of each node of the rules of ``grammars`` (grammar, json); immediate: inside an immediate token."""
    ship(grammars.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for name, text in zip(part["grammar"], part["json"]):
                todo = [(rule, rule, node, False) for rule, node in json.loads(text)["rules"].items()]
                while todo:
                    rule, path, node, inside = todo.pop()
                    value = node.get("value", node.get("name"))
                    kids = [*node.get("members", []), *([node["content"]] if "content" in node else [])]
                    out.append((name, rule, path, node["type"], value if isinstance(value, str) else None, inside, len(node.get("members", []))))
                    todo += [(rule, f"{path}/{i}", k, inside or node["type"] == "IMMEDIATE_TOKEN") for i, k in enumerate(kids)]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in ROWS.split(", ")])

    return grammars.select("grammar", "json").mapInPandas(run, ROWS)


def choice_sites(rows: DataFrame) -> DataFrame:
    """(grammar, rule, path, arity) of each choice."""
    return rows.where("type = 'CHOICE'").select("grammar", "rule", "path", F.col("members").alias("arity"))


def conflicts(grammars: DataFrame) -> DataFrame:
    """(grammar, early) of each declared conflict; early: it names a supertype."""
    parsed = grammars.select("grammar", F.from_json("json", "conflicts array<array<string>>, supertypes array<string>").alias("j"))
    each = parsed.select("grammar", F.explode("j.conflicts").alias("c"), F.coalesce("j.supertypes", F.array().cast("array<string>")).alias("s"))
    return each.select("grammar", F.arrays_overlap("c", "s").alias("early"))


def same_text(rows: DataFrame) -> DataFrame:
    """(grammar, value): spellings that are both a plain and an immediate token."""
    strings = rows.where("type = 'STRING'").select("grammar", "value", "immediate").distinct()
    return strings.where("immediate").select("grammar", "value").intersect(strings.where("not immediate").select("grammar", "value"))


def unreserved(grammars: DataFrame, rows: DataFrame) -> DataFrame:
    """(grammar, value): keyword-shaped tokens outside every reserved set, of grammars that name a word token."""
    words = rows.where("type = 'STRING'").where(F.col("value").rlike("^[a-z_][A-Za-z0-9_]+$")).select("grammar", "value")
    parsed = grammars.select("grammar", F.from_json("json", "word string, reserved map<string,array<struct<value:string>>>").alias("j"))
    reserved = parsed.select("grammar", F.explode("j.reserved").alias("k", "v")).select("grammar", F.explode("v.value").alias("value"))
    return words.join(parsed.where("j.word is not null").select("grammar"), "grammar", "left_semi").exceptAll(reserved).distinct().subtract(reserved)


def metrics(grammars: DataFrame) -> DataFrame:
    """(grammar, metric, value) of all grammars: conflicts, early_commits, dynamic, same_text and unreserved."""
    rows = rule_rows(grammars)
    c = conflicts(grammars)
    parts = {"conflicts": c, "early_commits": c.where("early"), "dynamic": rows.where("type = 'PREC_DYNAMIC'"), "same_text": same_text(rows), "unreserved": unreserved(grammars, rows)}
    hits = None
    for name, d in parts.items():
        one = d.groupBy("grammar").agg(F.count("*").alias("value")).withColumn("metric", F.lit(name))
        hits = one if hits is None else hits.unionByName(one)
    every = grammars.select("grammar", F.explode(F.array(*map(F.lit, parts))).alias("metric"))
    return every.join(hits, ["grammar", "metric"], "left").select("grammar", "metric", F.coalesce("value", F.lit(0)).alias("value"))


def scanner_names(source: Column) -> Column:
    """The identifiers of the first enum of a scanner's source, one a comma."""
    body = F.regexp_extract(source, r"(?s)enum .*?\{(.*?)\}", 1)
    return F.filter(F.transform(F.split(body, ","), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: (x != "") & ~x.startswith("//"))


def state_count(source: Column) -> Column:
    return F.regexp_extract(source, r"#define STATE_COUNT ([0-9]+)", 1).try_cast("long")


def first_alternative(pattern: str) -> str:
    """Some text that a pattern of the usual kinds matches, about eight characters at most; where this is
    wrong the program doesn't parse and is dropped."""
    out, i = "", 0
    while i < len(pattern) and len(out) < 8 and pattern[i] != "|":
        c = pattern[i]
        if c == "[":
            close = i + 1
            while close < len(pattern) and pattern[close] != "]":
                close += 2 if pattern[close] == "\\" else 1
            body = pattern[i + 1 : close]
            plain = [x for n, x in enumerate(body) if x.isalnum() and body[n - 1 : n] != "\\"]
            out += "a" if body.startswith("^") or not plain else plain[0]
            i = close + 1
        elif c == "\\" and i + 1 < len(pattern):
            out += {"d": "1", "w": "a", "s": " "}.get(pattern[i + 1], pattern[i + 1])
            i += 2
        else:
            out += "" if c in "()?*+^$" else "a" if c == "." else c
            i += 1
        while i < len(pattern) and pattern[i] in "*+?":
            i += 1
    return out if out.strip() else "a"


class Grammar:
    """Rules, the start rule (the first as written), the choice sites and each rule's shortest length."""

    def __init__(self, text: str, externals: dict[str, str] | None = None):
        self.rules: dict[str, dict] = json.loads(text)["rules"]
        self.start = next(iter(self.rules))
        #: Texts of tokens that a scanner makes; NEWLINE, INDENT, DEDENT and NOTHING are layout.
        self.externals = externals or {}
        self.sites: list[tuple[str, int]] = []
        self.site_of: dict[int, int] = {}
        for rule in sorted(self.rules):
            self._number(rule, self.rules[rule])
        self.shortest = dict.fromkeys(self.rules, ENDLESS)
        while (now := {r: min(self.shortest[r], self.length(n)) for r, n in self.rules.items()}) != self.shortest:
            self.shortest = now

    def _number(self, rule: str, node: dict) -> None:
        for k in kids(node):
            self._number(rule, k)
        if node["type"] == "CHOICE":
            self.site_of[id(node)] = len(self.sites)
            self.sites.append((rule, len(node["members"])))

    def length(self, node: dict) -> int:
        """Fewest characters that a node can give, as far as known."""
        t = node["type"]
        if t == "STRING":
            return max(1, len(node["value"].encode()))
        if t == "SYMBOL":
            return self.shortest.get(node["name"], 1)
        if t == "CHOICE":
            return min(map(self.length, node["members"]), default=0)
        return 1 if t == "PATTERN" else 0 if t == "REPEAT" else min(ENDLESS, sum(map(self.length, kids(node))))

    def reaching(self, wanted: set[str]) -> set[str]:
        """Rules from which a wanted rule can be reached, those included."""
        out = wanted & set(self.rules)
        while more := {r for r, n in self.rules.items() if r not in out and symbols(n) & out}:
            out |= more
        return out


def kids(node: dict) -> list[dict]:
    return node.get("members") or ([node["content"]] if "content" in node else [])


def symbols(node: dict) -> set[str]:
    return ({node["name"]} if node["type"] == "SYMBOL" else set()).union(*map(symbols, kids(node)))


class Derivation:
    """A program from a tape: text, taken (the (site, alternative) pairs) and record (the tape as used).

    With ``fresh`` (pairs already seen) an alternative not taken yet goes first, with ``toward`` (rules) one
    that can reach such a rule: the record is then a tape that gives the same program by itself.
    """

    def __init__(self, grammar: Grammar, tape: bytes, fresh: set | None = None, toward: set[str] | None = None):
        self.g, self.tape, self.fresh, self.toward = grammar, tape, fresh, toward
        self.at = self.steps = self.level = 0
        self.taken: list[tuple[int, int]] = []
        self.record = bytearray()
        self.lines: list[list] = [[None]]  # each: its indentation, then its tokens
        self._node(grammar.rules[grammar.start], 0)
        text = "\n".join("    " * (line[0] or 0) + " ".join(line[1:]) for line in self.lines)
        self.text = text if text.endswith("\n") else text + "\n"

    def _next(self, n: int) -> int:
        if n <= 1:
            return 0
        byte = self.tape[self.at] if self.at < len(self.tape) else 0
        self.at += 1
        self.record.append(byte % n)
        return byte % n

    def _token(self, text: str) -> None:
        line = self.lines[-1]
        line[0] = self.level if line[0] is None else line[0]
        line.append(text)

    def _external(self, name: str) -> None:
        text = self.g.externals.get(name, "a")
        if text == "NEWLINE":
            self.lines.append([None])
        elif text in ("INDENT", "DEDENT"):
            self.level = max(0, self.level + (1 if text == "INDENT" else -1))
        elif text != "NOTHING":
            self._token(text)

    def _alternative(self, node: dict, depth: int) -> int:
        options = node["members"]
        if depth >= MAX_DEPTH or (self.fresh is None and self.at >= len(self.tape)):
            return min(range(len(options)), key=lambda i: self.g.length(options[i]))
        if self.fresh is not None and len(options) > 1:
            site = self.g.site_of[id(node)]
            new = [i for i in range(len(options)) if (site, i) not in self.fresh]
            new = [i for i, o in enumerate(options) if self.toward and symbols(o) & self.toward] or new
            if new:
                byte = self.tape[self.at] if self.at < len(self.tape) else 0
                self.at += 1
                self.record.append(new[byte % len(new)])
                return new[byte % len(new)]
        return self._next(len(options))

    def _node(self, node: dict, depth: int) -> None:
        self.steps += 1
        if self.steps > MAX_STEPS:
            return
        t = node["type"]
        if t == "STRING":
            self._token(node["value"])
        elif t == "PATTERN":
            self._token(first_alternative(node["value"]))
        elif t == "SYMBOL":
            rule = self.g.rules.get(node["name"])
            if rule is None:
                self._external(node["name"])
            elif depth >= MAX_DEPTH:
                self._token("a")
            else:
                self._node(rule, depth + 1)
        elif t == "CHOICE":
            i = self._alternative(node, depth)
            self.taken.append((self.g.site_of[id(node)], i))
            self._node(node["members"][i], depth)
        elif t in ("REPEAT", "REPEAT1"):
            least = int(t == "REPEAT1")
            for _ in range(least if depth >= MAX_DEPTH else least + self._next(3 - least)):
                self._node(node["content"], depth + 1)
        elif t == "SEQ" or t in WRAPPERS:
            for k in kids(node):
                self._node(k, depth)
        elif t != "BLANK":
            raise ValueError(f"unknown grammar node {t}")


def random_tape(drawn: Iterator[int], n: int) -> bytes:
    return bytes(next(drawn) >> 24 & 255 for _ in range(n))


def mutated(tape: bytes, drawn: Iterator[int]) -> bytes:
    """A tape with one byte set, a run of up to 15 repeated, 16 bytes appended, or its end cut off."""
    if not tape:
        return random_tape(drawn, 64)
    how, i = next(drawn) % 4, next(drawn) % len(tape)
    if how == 0:
        return tape[:i] + random_tape(drawn, 1) + tape[i + 1 :]
    if how == 1:
        return tape[:i] + tape[i : i + next(drawn) % 16] + tape[i:]
    return tape + random_tape(drawn, 16) if how == 2 else tape[: max(1, i)]


def shrunk(tape: bytes, alive: Callable[[list[bytes]], list[bool]], rounds: int = 40) -> bytes:
    """A small tape that is still alive: runs of halving width go, then bytes fall to zero; every pass asks
    about all its candidates at once."""
    for _ in range(rounds):
        before, width = tape, max(1, len(tape))
        while width and tape:
            shorter = [tape[:i] + tape[i + width :] for i in range(0, len(tape), width)]
            held = [c for c, ok in zip(shorter, alive(shorter)) if ok]
            tape, width = (min(held, key=len), width) if held else (tape, width // 2)
        zeroed = [i for i, b in enumerate(tape) if b]
        for i, ok in zip(zeroed, alive([tape[:i] + b"\0" + tape[i + 1 :] for i in zeroed])):
            lower = tape[:i] + b"\0" + tape[i + 1 :]
            if ok and alive([lower])[0]:
                tape = lower
        if tape == before:
            break
    return tape


def programs(spark: SparkSession, text: str, tapes: Iterable[bytes], externals: dict[str, str] | None = None) -> DataFrame:
    """(tape, program, taken array<struct<site, alternative>>) of many tapes, derived on the executors."""
    ship(spark)
    rows = spark.createDataFrame([(bytes(t),) for t in tapes], "tape binary")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = Grammar(text, externals)
        for part in parts:
            found = [Derivation(g, bytes(t)) for t in part["tape"]]
            yield pd.DataFrame({"tape": part["tape"], "program": [x.text for x in found], "taken": [[{"site": a, "alternative": b} for a, b in x.taken] for x in found]})

    return rows.mapInPandas(run, "tape binary, program string, taken array<struct<site:int,alternative:int>>")


def campaign(spark: SparkSession, text: str, rounds: int, per_round: int, seed: int = 1, keep: int = 256, rare: set[str] | None = None) -> tuple[DataFrame, set[tuple[int, int]]]:
    """(programs, seen): rounds of derivations, a Spark job each; a third of the tapes is random, a third seeks
    alternatives not seen yet (every other one those that reach a rare rule), a third changes tapes that
    found some.  What is seen is bounded by the grammar's alternatives."""
    g, drawn, seen, pool, out = Grammar(text), draws(seed), set(), [], None
    toward = g.reaching(rare or set())
    for _ in range(rounds):
        tapes = []
        for i in range(per_round):
            if i % 3 == 0:
                tapes.append(random_tape(drawn, 64))
            elif i % 3 == 1 or not pool:
                tapes.append(bytes(Derivation(g, random_tape(drawn, 256), seen, toward if i % 6 == 1 else None).record))
            else:
                tapes.append(mutated(pool[next(drawn) % len(pool)], drawn))
        found = programs(spark, text, tapes)
        for tape in tapes:  # the coverage of a round decides the next
            fresh = set(Derivation(g, tape).taken) - seen
            if fresh and len(pool) < keep:
                pool.append(tape)
            seen |= fresh
        out = found if out is None else out.union(found)
    return out, seen


def findings(bad: DataFrame, policy: DataFrame) -> DataFrame:
    """program, bytes, seeds and declared (the first policy (ord, starts_with, why) whose text starts the
    program) of shrunk programs; shortest first."""
    n = bad.groupBy("program").agg(F.count("*").alias("seeds"))
    p = F.broadcast(policy)  # a file of a grammar's declarations
    why = n.join(p, F.startswith(n["program"], p["starts_with"]), "left").groupBy("program", "seeds").agg(F.min_by("why", "ord").alias("declared"))
    return why.select("program", F.octet_length("program").alias("bytes"), "seeds", "declared").orderBy("bytes", "program")


def coverage(sites: DataFrame, taken: DataFrame) -> DataFrame:
    """alternatives, covered and tenths of a percent of sites (site, rule, arity) by pairs (site, alternative)."""
    total = sites.agg(F.coalesce(F.sum("arity"), F.lit(0)).alias("alternatives"))
    hit = taken.select("site", "alternative").distinct().agg(F.count("*").alias("covered"))
    share = F.floor(F.col("covered") * 1000 / F.greatest("alternatives", F.lit(1)) + F.lit(0.5))
    return total.withColumn("_k", F.lit(1)).join(hit.withColumn("_k", F.lit(1)), "_k").select("alternatives", "covered", share.alias("tenths"))


def uncovered(sites: DataFrame, taken: DataFrame, keep: int = 20) -> DataFrame:
    """rule, missing: alternatives never taken, by rule; most first."""
    n = taken.groupBy("site").agg(F.countDistinct("alternative").alias("n"))
    left = sites.join(n, "site", "left").withColumn("missing", F.col("arity") - F.coalesce("n", F.lit(0)))
    return left.groupBy("rule").agg(F.sum("missing").alias("missing")).where("missing > 0").orderBy(F.desc("missing"), "rule").limit(keep)
