"""The markup front end: both renderings agree, spans, deletions and edits."""

import random

from pyspark.sql import functions as F

from quillon.operators import intervals, nodes, recovery, spans, trees

TEXTS = ["", "plain", "<ul><li>a;</li>, <li>b</li></ul>", "<p>open <b>x</p>", "</p><a>q</a></b>", "<br/><img> t <br>u", "<p>é<!-- c --> <i>ü</i></p>\n", "< <<p>>", "<ul>\n<br> <br><li>z</li> </ul>"]


def siblings(text):
    """Basic nodes of a text with ord, field, extra and all boundaries, one node at a time."""
    rows, data = trees.tree(text), (text or "").encode()
    kids = {}
    for row in rows:
        beside = kids.setdefault(row["parent_id"], [])
        row |= {"ord": len(beside), "field": trees.FIELDS.get(row["kind"]), "extra": row["kind"] in trees.EXTRAS}
        beside.append(row)

    def back(i, of=nodes.SEPARATORS.encode()):
        return len(data[:i].rstrip(of))

    def on(i):
        return len(data) - len(data[i:].lstrip(nodes.SEPARATORS.encode()))

    for row in reversed(rows):
        own = kids.get(row["node_id"], [])
        inner = [c for c in own if not c["extra"]] or [{"content_start": row["start_byte"], "content_end": row["end_byte"]}]
        row["content_start"], row["content_end"] = inner[0]["content_start"], inner[-1]["content_end"]
        row |= {n + "_in": f(row[n + p]) for n, p, f in (("start", "_byte", on), ("content_start", "", on), ("end", "_byte", back), ("content_end", "", back))}
        row |= {"heads": [c["start_byte"] for c in own[:4]], "tails": [c["end_byte"] for c in own[-4:]], "tails_in": [c["end_in"] for c in own[-4:]]}
        before = kids[row["parent_id"]][: row["ord"]]
        row["before"], row["lead"] = [c["start_byte"] for c in before[-3:]], []
        while before and before[-1]["extra"]:
            at = before.pop()["start_byte"]
            row["lead"] += sorted({at, back(at, b" \t")}, reverse=True)
    return rows


def markup(rng):
    parts = ["<ul>", "</ul>", "<li>", "</li>", "<br>", "<br/>", "<hr>", " ", "\t", "\n", ";", ", ", "text", "é;", "<p>", "</p>", "<", "<!-- -->", "<h1>", "</h1>"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))


BASIC = ["node_id", "parent_id", "depth", "kind", "start_byte", "end_byte", "last_desc_id", "is_missing"]
MORE = ["ord", "field", "extra", "content_start", "content_end", "start_in", "content_start_in", "end_in", "content_end_in", "before", "heads", "tails", "tails_in", "lead"]


def test_both_renderings_agree(spark):
    files = spark.createDataFrame(list(enumerate(TEXTS)), "page_id long, html string")
    ours, fresh = nodes.nodes(nodes.markup_tokens(files)), trees.read(files)
    cols = ["file_id", *BASIC]
    assert sorted(map(str, ours.select(*cols).collect())) == sorted(map(str, fresh.select(*cols).collect()))
    assert recovery.divergences(ours, fresh, ["file_id"]).count() == 0
    assert recovery.divergences(ours, fresh.where("node_id < 2"), ["file_id"]).count() > 0


def test_boundaries(spark):
    rng = random.Random(7)
    texts = [*TEXTS, None, "<ul>\n<br> <br><li>z;</li> </ul>", "<div>" * 70 + " a ", "<ul>" + "<br> " * 40 + "<li>x", *(markup(rng) for _ in range(200))]
    files = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")
    got = trees.boundaries(trees.parsed(files)).select("file_id", *BASIC, *MORE).collect()
    want = [(i, *(r[c] for c in BASIC + MORE)) for i, t in enumerate(texts) for r in siblings(t)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_offsets():
    rows = siblings("<ul>\n<br> <br><li>z;</li> </ul>")
    ul, br, _, li, text = rows
    assert [r["kind"] for r in rows] == ["ul", "br", "br", "li", "#text"] and [r["ord"] for r in rows] == [0, 0, 1, 2, 0]
    assert li["lead"] == [10, 9, 5] and li["before"] == [5, 10]
    assert (ul["content_start"], ul["content_end"]) == (text["start_byte"], text["end_byte"])
    assert text["end_in"] == text["end_byte"] - 1 and ul["tails"] == [9, 14, 25] and not ul["is_missing"]
    assert trees.tree(None) == [] and trees.tree("<p>")[0]["is_missing"]


def test_containing(spark):
    """Every span that holds a point, once; one file's keys are many."""
    rng = random.Random(2)
    found = [(f, a, a + rng.choice([0, 0, 1, 3, 50, 700, 2**20])) for f in (1, 2) for a in (rng.randrange(1000) for _ in range(150))] + [(1, 0, 2**31 - 2)]
    asked = [(f, rng.randrange(1200)) for f in (1, 2, 3) for _ in range(100)] + [(1, 2**31 - 2)]
    s = spark.createDataFrame([(*x, i) for i, x in enumerate(found)], "file_id long, start_byte long, end_byte long, i int")
    p = spark.createDataFrame([(*x, i) for i, x in enumerate(asked)], "file_id long, at long, j int")
    got = sorted((r.j, r.i) for r in intervals.containing(p, s).collect())
    assert got == sorted((j, i) for j, (f, at) in enumerate(asked) for i, (g, a, z) in enumerate(found) if f == g and a <= at <= z)
    blocks = s.where("end_byte > start_byte").select("start_byte", "end_byte", intervals.cover(F.col("start_byte"), F.col("end_byte")).alias("b")).collect()
    for r in blocks:
        assert sum(2**x.level for x in r.b) == r.end_byte - r.start_byte and len(r.b) <= 62
    one = spark.range(20_000).selectExpr("1L as file_id", "id * 3 as start_byte", "id * 3 + 2 as end_byte", "id as i")
    rows = intervals.containing(spark.range(20_000).selectExpr("1L as file_id", "id * 3 + 1 as at", "id as j"), one)
    assert rows.where("i = j").count() == rows.count() == 20_000


def test_sexp(spark):
    files = spark.createDataFrame([(1, "<ul><li>a</li><li></li></ul><p>"), (2, "x")], "page_id long, html string")
    assert {r.file_id: r.sexp for r in trees.sexp(trees.parsed(files)).collect()} == {1: "(ul (li text: (#text)) (li)) (p)", 2: "text: (#text)"}


def test_equal_trees_match_everywhere(spark):
    own = trees.boundaries(trees.parsed(spark.createDataFrame(list(enumerate(TEXTS)), "page_id long, html string"))).cache()
    theirs = own.selectExpr("file_id", "kind", "start_byte as s", "end_byte as e", "greatest(start_byte, end_in) as t")
    node_map = own.selectExpr("kind", "array(kind) as expected").distinct()
    assert {r.state for r in spans.matched(theirs, own, node_map).collect()} == {"ok"}
    assert spans.token_misses(own.where("last_desc_id = node_id").selectExpr("file_id", "start_byte as s", "end_byte as e"), own).count() == 0
    far = theirs.where("kind = '#text'").selectExpr("file_id", "kind", "s - 1 as s", "e", "t").where("s > 0")
    assert {r.signature for r in spans.signatures(spans.matched(far, own, node_map), own).collect()} >= {"#text <- ul", "#text <- p"}


def test_deletions():
    assert recovery.error_bytes(trees.tree("<p><b>x</p>")) == 11 and recovery.error_bytes(trees.tree("<p>x</p>")) == 0


def test_edits():
    data = "aé日b".encode() * 5
    for seed in range(40):
        found = recovery.edits(data, seed)
        assert [x[2] for x in found] == [b"", b"x = 1\n", b")"] and recovery.edits(data, seed) == found
        for a, z, x in found:
            (data[:a] + x + data[z:]).decode()
            assert a <= z <= a + 11
    assert recovery.edits(b"", 1) == []


def test_theirs_reads_one_byte_beyond_a_node(spark, tmp_path):
    """Ends without separators are those of plain trimming, on a page of many nodes too, and no node reads its page."""
    from quillon.plans import tree_queries

    pages = [(1, "u", "<p>a;</p>, \n<p>b</p>x<br>;;<i>c é</i>\té<b>d</b> ;"), (2, "u", "<ul>" + "".join(f"<li>{i}{',' * (i % 3)}</li>{' é;'[i % 4:]}" for i in range(400))), (3, "u", None), (4, "u", ";; <p>,")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    theirs = tree_queries._theirs(spark, str(tmp_path), tree_queries._bounded(spark, str(tmp_path)))
    rows, data = theirs.collect(), {i: (h or "").encode() for i, _, h in pages}
    assert len(rows) > 600 and {r.file_id for r in rows} == {1, 2, 4}
    assert [r.t for r in rows] == [r.s + len(data[r.file_id][r.s : r.e].rstrip(b";, \t\n\r")) for r in rows]
    assert "decode(" not in theirs._jdf.queryExecution().optimizedPlan().toString()


def test_losses_are_those_of_reading_again():
    """Each deletion's bytes in errors, from one reading of the text, are those of reading what is left."""
    rng, some = random.Random(3), 0
    for _ in range(4000):
        text = "".join(rng.choice(["<p>", "</p>", "<p>", "</p>", "<b>é", "</b>", "<br>", "<i/>", " ", "x", "<", "</ul>", "<!-- -->"]) for _ in range(rng.randint(0, 24)))
        data, want = text.encode(), []
        if not any(r["is_missing"] for r in trees.tree(text)):
            found = trees.tokens(text)
            for token, _, _, a, z in found[:: max(1, len(found) // 8)][:8]:
                left = data[:a] + data[z:]
                want.append((a, token[:24], len(left), recovery.error_bytes(trees.tree(left.decode()))))
        assert list(recovery.losses(text)) == want, text
        some += sum(w[3] > 0 for w in want)
    assert some > 300


def test_a_text_is_read_once_for_its_deletions(monkeypatch):
    calls, tokens = [], trees.tokens
    monkeypatch.setattr(trees, "tokens", lambda text: calls.append(text) or tokens(text))
    assert [x[3] for x in recovery.losses("<ul>" + "<li>a</li>" * 9 + "</ul>") if x[3]] and len(calls) == 1


def test_nodes_are_dealt_once(spark):
    """A file's nodes, parents included, need no join and one shuffle; what is never closed needs no parents."""
    files = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS * 3)], "page_id long, html string")
    tokens = nodes.markup_tokens(files)
    plan = nodes.nodes(tokens)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    want = sorted((r.file_id, r.node_id, r.kind, r.start_byte) for r in trees.read(files).where("is_missing").collect())
    assert sorted(map(tuple, nodes.unclosed(tokens).collect())) == want and len(want) == 3
