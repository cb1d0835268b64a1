"""The pattern language: parsing, facets, refusals, and plans over small trees."""

import pytest

from quillon.operators import trees
from quillon.plans import pattern as p

CATALOGUE = p.Catalogue(
    kinds={"ul", "li", "a", "#text", "h1", "title", "div", "call"},
    facets={"_named": ["h1", "title", "a"], "_none": ["div"]},
    fields={"h1": {"text": {"#text"}}, "title": {"name": {"_word"}}, "a": {}, "div": {}},
    subtypes={"_word": ["#text", "call"], "_item": ["li"]},
)


@pytest.fixture(scope="module")
def nodes(spark):
    pages = [(1, "<ul><li>a</li><li>b<a>c</a></li></ul>"), (2, "<div><h1>t</h1><a>c</a></div>"), (3, None), (4, "")]
    return trees.parsed(spark.createDataFrame(pages, "page_id long, html string")).cache()


def found(text, nodes):
    return sorted((r.file_id, r.node_id, r.capture) for r in p.plan(p.parse(text), nodes, CATALOGUE).collect())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("(ul (li) @x)", [(1, 2, "x"), (1, 4, "x")]),
        ("(ul (_) @x)", [(1, 2, "x"), (1, 4, "x")]),
        ("(_ (a) @x)", [(1, 6, "x"), (2, 4, "x")]),
        ("[(h1) (a)] @x ; a comment", [(1, 6, "x"), (2, 2, "x"), (2, 4, "x")]),
        ("[(li (a) @y) (div (h1) @z)]", [(1, 6, "y"), (2, 2, "z")]),
        ("(_item (a) @x)", [(1, 6, "x")]),
        ("(h1 text: (#text) @t)", [(2, 3, "t")]),
        ("(_named text: (#text) @t)", [(2, 3, "t")]),
        ("(ul (li) @x (li) @y)", [(1, 2, "x"), (1, 2, "x"), (1, 2, "y"), (1, 2, "y"), (1, 4, "x"), (1, 4, "x"), (1, 4, "y"), (1, 4, "y")]),
    ],
)
def test_plan(nodes, text, want):
    assert found(text, nodes) == want


def embeddings(p, row, rows, catalogue):
    """All matches of an expanded pattern at a node, as lists of (capture, node_id)."""
    if p.alternatives:
        named = [type(p)(x.kinds, x.children, p.capture or x.capture, x.alternatives) for x in p.alternatives]
        return [m for x in named for m in embeddings(x, row, rows, catalogue)]
    kinds = set().union(*(catalogue.closure(k) for k in p.kinds))
    if "_" not in kinds and row["kind"] not in kinds:
        return []
    out = [[(p.capture, row["node_id"])] if p.capture else []]
    for name, child in p.children:
        inner = [m for r in rows if r["parent_id"] == row["node_id"] and r["file_id"] == row["file_id"] and name in (None, r["field"]) for m in embeddings(child, r, rows, catalogue)]
        out = [a + b for a in out for b in inner]
    return out


def test_many_patterns_are_one_plan(spark, nodes):
    """Ten alternatives at two places and other patterns together, against all matches one by one."""
    ten = "[(ul) (li (a) @deep) (a) (#text) (h1) (title) (div) (call) (_named) (li (#text) (#text) @twice)]"
    texts = {"ten": f"(_ {ten} @one {ten} @two)", "plain": "(ul (li (#text)))", "named": "(_ text: (#text) @t)", "deep": "(ul (li (a (#text) @x) @y) @z)", "none": "(call)"}
    parsed = {k: p.parse(v) for k, v in texts.items()}
    rows = [r.asDict() for r in nodes.collect()]
    want = []
    for k, x in parsed.items():
        full = p.expand(x, CATALOGUE)
        for r in rows:
            for m in embeddings(full, r, rows, CATALOGUE):
                if p._captures(full):
                    want += [(k, r["file_id"], n, c) for c, n in m]
                else:
                    want.append((k, r["file_id"], r["node_id"], ""))
    found = p.plan_all(parsed, nodes, CATALOGUE)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 1  # one level, the rest is kept in tables
    assert sorted((r.query, r.file_id, r.node_id, r.capture) for r in found.collect()) == sorted(want)


def test_equal_text_and_derivation(spark):
    rows = [(1, 1, None, "call", ["_word"], "f"), (1, 2, 1, "#text", [], "f"), (1, 3, 1, "#text", ["_word"], "g")]
    n = spark.createDataFrame(rows, "file_id long, node_id long, parent_id long, kind string, derivation array<string>, text string")
    assert [x[1] for x in found('((#text) @t (#eq? @t "g"))', n)] == [3]
    assert [x[1:] for x in found("(call (#text) @t (#eq? @t @c)) @c", n)] == [(1, "c"), (2, "t")]
    assert [x[1] for x in found("(_word) @w", n)] == [1, 3]  # an occurrence, not its kind


@pytest.mark.parametrize("text", ["(ul", "ul)", "(ul]", "[(a)", "()", "(ul (li)) (a)", '"open', "(nothing)", "((a) (b))", "(a (#is? @x))", ""])
def test_errors(nodes, text):
    with pytest.raises(p.BadPattern):
        p.plan(p.parse(text), nodes, CATALOGUE)


@pytest.mark.parametrize("text", ["(_none name: (h1))", "[(a) (_none name: (h1))]", "(_item text: (a))"])
def test_impossible(nodes, text):
    with pytest.raises(p.ImpossiblePattern):
        p.plan(p.parse(text), nodes, CATALOGUE)


def test_closure_goes_from_what_is_declared():
    asked = p.expand(p.parse("(_named name: (call))"), CATALOGUE)
    assert asked.kinds == ["title"]  # declared _word reaches call
    with pytest.raises(p.ImpossiblePattern):
        p.expand(p.parse("(_named name: (li))"), CATALOGUE)
    assert p.parse('(a "_named")').children[0][1].kinds == ["_named"]
