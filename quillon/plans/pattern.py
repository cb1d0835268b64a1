"""The tree-pattern language: patterns are parsed, facets rewritten, and counted bottom-up, then top-down.

    pattern := "(" name { [field ":"] pattern | predicate } ")" | "[" pattern+ "]" | "_" | string
             | "(" pattern { predicate } ")"                      each may be followed by "@" capture
    predicate := "(#eq?" "@" capture ( string | "@" capture ) ")"

``_`` is any node.  Rewriting keeps a facet's member only if it declares each field asked of it; a
pattern that no member fits, or that asks for a field of a supertype, is impossible, and a name
that the grammar doesn't declare is an error: all are refused before anything runs.

Each node of a pattern is a state.  Going up, every tree node gets for each state the number of ways
in which that part of the pattern matches there: a sum over its children for each child of the
pattern, and the product of those sums.  Going down, it gets the number of ways in which the rest of
the pattern matches around it.  A capture occurs as often as the product says.  So any number of
patterns and alternatives is one plan, with one aggregation and join for each level of the deepest.
Only ``#eq?`` of two captures, which ties distant nodes together, is planned as self-joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.runtime import written

TOKEN = re.compile(r'\s+|;[^\n]*|"(?:\\.|[^"\\])*"|[()\[\]]|#[\w-]+\?|@[\w.-]+|[\w.#-]+:|[\w.#-]+')
ANY = "_"


class BadPattern(ValueError):
    pass


class ImpossiblePattern(BadPattern):
    pass


@dataclass
class Node:
    """kinds: any of them; alternatives: instead of kinds, patterns of which one must hold; equal:
    (capture, text or ``@`` and another capture) pairs."""

    kinds: list[str]
    children: list[tuple[str | None, "Node"]] = field(default_factory=list)
    capture: str | None = None
    alternatives: list["Node"] = field(default_factory=list)
    equal: list[tuple[str, str]] = field(default_factory=list)


class _Reader:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise BadPattern(f"unreadable at {at}: {text[at:at + 20]!r}")
            if not m[0].isspace() and m[0][0] != ";":
                self.tokens.append(m[0])
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ""

    def take(self) -> str:
        if not self.peek():
            raise BadPattern("the pattern ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def closed(self, sign: str) -> bool:
        if not self.peek():
            raise BadPattern(f"unbalanced: {sign} is missing")
        return self.peek() == sign

    def predicate(self) -> tuple[str, str]:
        self.take()
        name, left, right = self.take(), self.take(), self.take()
        if name != "#eq?" or left[0] != "@" or right[0] not in "@\"" or self.take() != ")":
            raise BadPattern(f"only #eq? of a capture is known, not {name} {left} {right}")
        return left[1:], right if right[0] == "@" else _unquoted(right)

    def inside(self, out: Node) -> Node:
        while not self.closed(")"):
            if self.peek() == "(" and self.peek(1).startswith("#") and self.peek(1).endswith("?"):
                out.equal.append(self.predicate())
            else:
                name = self.take()[:-1] if self.peek().endswith(":") and self.peek()[0] != '"' else None
                out.children.append((name, self.pattern()))
        self.take()
        return out

    def pattern(self) -> Node:
        t = self.take()
        if t == "(" and self.peek() in ("(", "["):
            inner = self.pattern()
            rest = self.inside(Node([]))
            if rest.children:
                raise BadPattern("a group holds one pattern and predicates")
            inner.equal += rest.equal
            out = inner
        elif t == "(":
            name = self.take()
            if not re.match(r"[\w.#-]+$", name):
                raise BadPattern("a name is missing")
            out = self.inside(Node([name]))
        elif t == "[":
            found = []
            while not self.closed("]"):
                found.append(self.pattern())
            self.take()
            plain = all(not (x.children or x.alternatives or x.capture or x.equal) for x in found)
            out = Node([k for x in found for k in x.kinds]) if plain else Node([], alternatives=found)
        elif t[0] == '"':
            out = Node([_unquoted(t)])
        elif t == ANY:
            out = Node([ANY])
        else:
            raise BadPattern(f"unexpected {t!r}")
        if self.peek().startswith("@"):
            out.capture = self.take()[1:]
        return out


def _unquoted(t: str) -> str:
    return re.sub(r"\\(.)", r"\1", t[1:-1])


def parse(text: str) -> Node:
    reader = _Reader(text)
    root = reader.pattern()
    if reader.peek():
        raise BadPattern("more than one pattern")
    return root


@dataclass
class Catalogue:
    """What a grammar declares: kinds, facets, and for each kind its fields' types (if known)."""

    kinds: set[str]
    facets: dict[str, list[str]] = field(default_factory=dict)
    fields: dict[str, dict[str, set[str]]] = field(default_factory=dict)
    subtypes: dict[str, list[str]] = field(default_factory=dict)

    def closure(self, name: str) -> set[str]:
        out, todo = {name}, [name]
        while todo:
            for s in self.subtypes.get(todo.pop(), []):
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out


def expand(p: Node, c: Catalogue) -> Node:
    """Facets replaced by their fitting members, inside out."""
    children = [(f, expand(x, c)) for f, x in p.children]
    kinds: list[str] = []
    for k in p.kinds:
        if k in c.facets:
            fits = [m for m in c.facets[k] if all(_fits(m, f, x, c) for f, x in children if f)]
            if not fits:
                raise ImpossiblePattern(f"no member of {k} has the fields asked for")
            kinds += fits
        elif k == ANY or k in c.kinds or k in c.subtypes:
            if k in c.subtypes and any(f and not all(x in c.subtypes for x in child.kinds) for f, child in children):
                raise ImpossiblePattern(f"{k} is a supertype: its fields hold supertypes only")
            kinds.append(k)
        else:
            raise BadPattern(f"{k} isn't declared")
    return Node(list(dict.fromkeys(kinds)), children, p.capture, [expand(x, c) for x in p.alternatives], p.equal)


def _fits(member: str, name: str, want: Node, c: Catalogue) -> bool:
    if member not in c.fields:
        return True  # nothing known against it
    declared = c.fields[member].get(name)
    # from what the field declares towards what is asked, never the other way
    return declared is not None and any(set(want.kinds) & c.closure(d) for d in declared)


def _variants(p: Node) -> Iterator[Node]:
    """Patterns without alternatives that together match what ``p`` does."""
    for x in p.alternatives:
        for v in _variants(x):
            yield Node(v.kinds, v.children, p.capture or v.capture, equal=[*v.equal, *p.equal])
    if not p.alternatives:
        for kids in product(*([(f, v) for v in _variants(x)] for f, x in p.children)):
            yield Node(p.kinds, list(kids), p.capture, equal=p.equal)


def _equal(p: Node) -> list[tuple[str, str]]:
    return [*p.equal, *(e for _, x in p.children for e in _equal(x))]


@dataclass
class State:
    """A node of a pattern; alternatives hold at the same tree node, kids (state, field) at its children."""

    kinds: list[str]
    capture: str | None
    texts: list[str]
    kids: list[tuple[int, str | None]] = field(default_factory=list)
    alternatives: list[int] = field(default_factory=list)
    up: int = 0
    down: int = 0


def _flat(p: Node, texts: dict[str, list[str]], out: list[State], capture: str | None, down: int) -> int:
    """Appends the states of ``p``, those it depends on first; gives its number."""
    name = capture or p.capture
    own = State(p.kinds, name, texts.get(name, []) if name else [], down=down)
    if p.alternatives:
        own.alternatives = [_flat(x, texts, out, name, down) for x in p.alternatives]
        own.up = max(out[i].up for i in own.alternatives)
    else:
        own.kids = [(_flat(x, texts, out, None, down + 1), f) for f, x in p.children]
        own.up = 1 + max((out[i].up for i, _ in own.kids), default=-1)
    out.append(own)
    return len(out) - 1


def _captures(p: Node) -> set[str]:
    return {n for n in [p.capture] if n} | {n for _, x in p.children for n in _captures(x)} | {n for x in p.alternatives for n in _captures(x)}


def _all_equal(p: Node) -> list[tuple[str, str]]:
    return [*p.equal, *(e for _, x in p.children for e in _all_equal(x)), *(e for x in p.alternatives for e in _all_equal(x))]


def _kind_test(kinds: list[str], nodes: DataFrame, c: Catalogue):
    if ANY in kinds:
        return F.lit(True)
    tiers = [k for k in kinds if k in c.subtypes] if "derivation" in nodes.columns else []
    ok = F.col("kind").isin(sorted(set().union(*(c.closure(k) for k in kinds if k not in tiers))))
    return ok | F.arrays_overlap("derivation", F.array(*map(F.lit, tiers))) if tiers else ok


def plan(p: Node, nodes: DataFrame, c: Catalogue) -> DataFrame:
    """(file_id, node_id, capture) of every capture of every match; without captures, of the matches.

    ``nodes`` may hold field, derivation (the supertypes that an occurrence went through; without it
    a supertype stands for its closure of kinds) and text, which ``#eq?`` compares.
    """
    return plan_all({"": p}, nodes, c).drop("query")


def plan_all(patterns: dict[str, Node], nodes: DataFrame, c: Catalogue) -> DataFrame:
    """(query, file_id, node_id, capture) as in ``plan`` of all patterns, by one plan over one table of nodes."""
    joined, states, roots = [], [], {}
    for name, p in patterns.items():
        full = expand(p, c)
        pairs = _all_equal(full)
        for left, right in pairs:
            if not {left, *([right[1:]] if right[:1] == "@" else [])} <= _captures(full):
                raise BadPattern(f"no capture @{left} or {right}")
        names = [n for n in _captures(full)]
        # a text test belongs to one state unless the name is given twice
        if any(r[:1] == "@" for _, r in pairs) or (pairs and (len(names) != len(_named(full)) or _has_alternatives(full))):
            joined.append(_joined(full, nodes, c).select(F.lit(name).alias("query"), "*"))
        else:
            texts: dict[str, list[str]] = {}
            for left, right in pairs:
                texts.setdefault(left, []).append(right)
            roots[_flat(full, texts, states, None, 0)] = name
    counted = [_counted(states, roots, nodes, c)] if roots else []
    parts = counted + joined
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _named(p: Node) -> list[str]:
    return [n for n in [p.capture] if n] + [n for _, x in p.children for n in _named(x)] + [n for x in p.alternatives for n in _named(x)]


def _has_alternatives(p: Node) -> bool:
    return bool(p.alternatives) or any(_has_alternatives(x) for _, x in p.children)


def _counted(states: list[State], roots: dict[int, str], nodes: DataFrame, c: Catalogue) -> DataFrame:
    one = F.lit(1).cast("long")
    ok_field = lambda f: F.lit(True) if f is None or "field" not in nodes.columns else F.coalesce(F.col("field") == f, F.lit(False))
    tests = []
    for i, s in enumerate(states):
        test = F.lit(True) if s.alternatives else _kind_test(s.kinds, nodes, c)
        for t in s.texts:
            test = test & (F.col("text") == t)
        tests.append(F.coalesce(test, F.lit(False)).cast("long").alias(f"t{i}"))
    more = [n for n in ("field",) if n in nodes.columns]
    now = nodes.select("file_id", "node_id", "parent_id", *more, *tests)
    top = max(s.up for s in states)
    for level in range(top + 1):
        here = [i for i, s in enumerate(states) if s.up == level]
        for i in here:  # what a state depends on has a smaller number
            value = F.col(f"t{i}")
            for k, _ in states[i].kids:
                value = value * F.col(f"c{k}")
            if states[i].alternatives:
                value = sum((F.col(f"u{k}") for k in states[i].alternatives), F.lit(0).cast("long")) * F.col(f"t{i}")
            now = now.withColumn(f"u{i}", value)
        kids = [(k, f) for s in states for k, f in s.kids if states[k].up == level]
        if kids:
            now = written(now, "pattern-up")
            some = now.where(" or ".join(f"u{k} > 0" for k, _ in kids))
            sums = some.groupBy("file_id", F.col("parent_id").alias("node_id")).agg(*(F.sum(F.when(ok_field(f), F.col(f"u{k}"))).alias(f"c{k}") for k, f in kids))
            now = now.join(sums, ["file_id", "node_id"], "left").fillna(0, [f"c{k}" for k, _ in kids])
    parents = {k: (i, f) for i, s in enumerate(states) for k, f in s.kids}
    for level in range(max(s.down for s in states) + 1):
        for i in reversed(range(len(states))):  # a state comes after its alternatives
            s = states[i]
            if s.down == level:
                if i in roots:
                    now = now.withColumn(f"d{i}", one)
                for k in s.alternatives:
                    now = now.withColumn(f"d{k}", F.col(f"d{i}") * F.col(f"t{i}"))
        kids = [k for k in parents if states[k].down == level + 1]
        if kids:
            now = written(now, "pattern-down")
            given = []
            for k in kids:
                i, _ = parents[k]
                value = F.col(f"d{i}") * F.col(f"t{i}")
                for other, _ in states[i].kids:
                    value = value * F.col(f"c{other}") if other != k else value
                given.append(value.alias(f"p{k}"))
            above = now.select("file_id", F.col("node_id").alias("parent_id"), *given).where(" or ".join(f"p{k} > 0" for k in kids))
            now = now.join(above, ["file_id", "parent_id"], "left")
            for k in kids:
                now = now.withColumn(f"d{k}", F.when(ok_field(parents[k][1]), F.coalesce(f"p{k}", F.lit(0))).otherwise(0)).drop(f"p{k}")
    query: dict[int, str] = {}
    for i in reversed(range(len(states))):
        query[i] = roots[i] if i in roots else query[i]
        for k in [*(k for k, _ in states[i].kids), *states[i].alternatives]:
            query[k] = query[i]
    named = {query[i] for i, s in enumerate(states) if s.capture}
    # the name of alternatives as a whole is counted at each of them
    shown = [i for i, s in enumerate(states) if (s.capture and not s.alternatives) or (i in roots and query[i] not in named)]
    rows = F.array(*(F.struct(F.lit(query[i]).alias("query"), F.lit(states[i].capture or "").alias("capture"), (F.col(f"u{i}") * F.col(f"d{i}")).alias("n")) for i in shown))
    each = now.select("file_id", "node_id", F.explode(F.filter(rows, lambda x: x["n"] > 0)).alias("x"))
    return each.select(F.col("x.query").alias("query"), "file_id", "node_id", F.col("x.capture").alias("capture"), F.explode(F.sequence(F.lit(1), F.col("x.n"))).alias("_i")).drop("_i")


def _joined(p: Node, nodes: DataFrame, c: Catalogue) -> DataFrame:
    """An expanded pattern by self-joins: for texts of captures that are compared with each other."""
    out = None
    for v in _variants(p):
        found, me, names = _match(v, nodes, c, [0])
        where = dict(names)
        for left, right in _equal(v):
            if left not in where or (right[:1] == "@" and right[1:] not in where):
                raise BadPattern(f"no capture @{left} or {right}")
            found = found.where(F.col(where[left] + "t") == (F.col(where[right[1:]] + "t") if right[:1] == "@" else F.lit(right)))
        caps = [F.struct(F.lit(n).alias("capture"), F.col(col).alias("node_id")) for n, col in names]
        rows = found.select("file_id", F.explode(F.array(*caps)).alias("x")).select("file_id", "x.node_id", "x.capture")
        out = rows if out is None else out.union(rows)
    return out


def _match(p: Node, nodes: DataFrame, c: Catalogue, used: list[int]) -> tuple[DataFrame, str, list[tuple[str, str]]]:
    """(rows, the column of the node itself, (capture, column) pairs)."""
    used[0] += 1
    me = f"_n{used[0]}"
    found = nodes.where(_kind_test(p.kinds, nodes, c))
    more = {"field": "f", "text": "t"}
    out = found.select("file_id", F.col("node_id").alias(me), F.col("parent_id").alias(me + "p"), *(F.col(k).alias(me + x) for k, x in more.items() if k in nodes.columns))
    names = [(p.capture, me)] if p.capture else []
    for name, child in p.children:
        sub, top, inner = _match(child, nodes, c, used)
        if name and "field" in nodes.columns:
            sub = sub.where(F.col(top + "f") == name)
        sub = sub.withColumnRenamed("file_id", top + "x")
        out = out.join(sub, (F.col("file_id") == F.col(top + "x")) & (F.col(me) == F.col(top + "p"))).drop(top + "x")
        names += inner
    return out, me, names
