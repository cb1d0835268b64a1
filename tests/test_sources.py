"""Scans, feeds, archives, outputs, the registry and its oracle."""

import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon import languages
from quillon.functions import paths, scalars
from quillon.operators import reports, rules, status
from quillon.sources import feeds, scans, sinks


def rows(d):
    return sorted(tuple(r) for r in d.collect())


def test_text_scans(spark, tmp_path):
    (tmp_path / "pop").write_text("#rank name inst\n---\n1 a 30 1\n2 Total 9 9\nx b 3 3\n3 c no 1\n4 d 7\n5 e\n")
    assert rows(scans.popcon(spark, str(tmp_path / "pop"))) == [(1, "a", 30), (4, "d", 7)]
    (tmp_path / "deb").write_text("Package: a\nVersion: 1\nDirectory: p/a\n\nPackage: b\nVersion: 2\nDirectory: p/b\n")
    assert rows(scans.deb822(spark, str(tmp_path / "deb"))) == [("a", "1", "p/a"), ("b", "2", "p/b")]
    (tmp_path / "dump.csv").write_text("n,id,extra\nx,1,q\ny,2,r\n")
    assert rows(scans.dump(spark, str(tmp_path / "dump.csv"), "n string, id long, extra string").select("id", "n")) == [(1, "x"), (2, "y")]
    (tmp_path / "top.js").write_text("export const top = ['a', 'b-c']\n")
    assert rows(scans.quoted_names(spark, str(tmp_path / "top.js"))) == [(1, "a"), (2, "b-c")]
    (tmp_path / "v").write_text("a\tb\tvalid\nc\tinvalid\n\n")
    assert rows(scans.verdict_lines(spark, str(tmp_path / "v"))) == [("a\tb", True), ("c", False)]
    (tmp_path / "s.jsonl").write_text('{"path":"a","spans":[{"start":0,"end":1,"kind":"x"}],"tokens":[]}\n\n{"path":"b","has_edges":false}\n')
    assert rows(scans.span_lines(spark, str(tmp_path / "s.jsonl")).select("path", "has_edges", "has_tokens")) == [("a", True, True), ("b", False, False)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("====\nname\n====\n\nx\n---\n====\nb\n===\n==\n")
    (tmp_path / "t" / "b.md").write_text("====\n====\n")
    assert [r.tests for r in feeds.corpus_tests(spark, str(tmp_path / "t")).collect()] == [2]
    assert [r.path.rsplit("/", 1)[1] for r in feeds.fixtures(spark, str(tmp_path / "t"), ["md", "txt"]).collect()] == ["a.txt", "b.md"]


def test_manifest(spark, tmp_path):
    files = spark.createDataFrame([("p/q", "1", 5, "u", 9, "s", f, 1, "h", None, i) for i, f in enumerate(["b", "a"])], "package string, version string, downloads long, url string, bytes long, sha256 string, file string, file_bytes long, file_sha256 string, dialect string, ord int")
    sinks.write_manifest(files, "python", str(tmp_path / "m"))
    flat = scans.flatten(scans.manifest(spark, str(tmp_path / "m"))).orderBy("package_ord", "file_ord").collect()
    assert [(r.pkgdir, r.path, r.file_ord) for r in flat] == [("p__q-1", "b", 0), ("p__q-1", "a", 1)]


def test_files_and_archives(spark, tmp_path):
    (tmp_path / "f.txt").write_bytes(b"\xffok")
    found = scans.source_files(spark, str(tmp_path), "*.txt")
    wanted = found.select("path").union(spark.createDataFrame([("gone",)], "path string"))
    state = scans.read_state(wanted, found).select("read_ok", scans.lossy(F.col("content")).alias("t"))
    assert sorted(map(str, state.collect())) == sorted(map(str, [*state.where("read_ok").collect(), *state.where("not read_ok").collect()])) and {r.t for r in state.collect()} == {"�ok", None}
    tar, inner, z = io.BytesIO(), io.BytesIO(), io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w:gz") as t:
        for n, b in (("lib/x.rb", b"1"), ("../up", b"2")):
            i = tarfile.TarInfo(n)
            i.size = len(b)
            t.addfile(i, io.BytesIO(b))
    with tarfile.open(fileobj=tar, mode="w:xz") as t:
        for n, b in (("root/a", b"A"), ("root/a", b"B"), ("root/data.tar.gz", inner.getvalue()), ("/abs", b"")):
            i = tarfile.TarInfo(n)
            i.size = len(b)
            t.addfile(i, io.BytesIO(b))
    with zipfile.ZipFile(z, "w") as t:
        t.writestr("d/b", "Z")
    d = spark.createDataFrame([("t", tar.getvalue()), ("z", z.getvalue()), ("bad", b"no")], "archive string, content binary")
    assert {r.archive: r.k for r in d.select("archive", scans.kind_of_archive(F.col("content")).alias("k")).collect()} == {"t": "xz", "z": "zip", "bad": None}
    got = {(r.archive, r.path): bytes(r.content) for r in scans.explode_archives(d, inner="data.tar.gz").collect() if r.error is None}
    assert got == {("t", "a"): b"A", ("t", "lib/x.rb"): b"1", ("z", "d/b"): b"Z"}


def test_documents(spark):
    one = lambda **c: spark.range(1).select(*(F.lit(v).alias(k) for k, v in c.items()))
    feed = one(json=json.dumps({"rows": [{"project": "a", "download_count": 5}, {"project": "b"}, {"project": "c", "download_count": 3}]}))
    assert rows(feeds.project_feed(feed, 9)) == [(1, "a", 5), (2, "c", 3)]
    doc = one(p=json.dumps({"info": {"version": "1.0"}, "urls": [{"packagetype": "bdist_wheel", "url": "w"}, {"packagetype": "sdist", "url": "s"}]}), n=json.dumps({"dist-tags": {"latest": "2"}, "versions": {"2": {"dist": {"tarball": "t"}}}}), g='{"name":"x","version":"3","platform":"java"}', v='[{"number":"3","platform":"java"},{"number":"2","platform":"ruby"}]', m="<a><release> 1.2 </release></a>")
    r = doc.select(feeds.sdist_of(F.col("p")), feeds.tarball_of(F.col("n")), feeds.gem_of(F.col("g"), F.col("v")), feeds.release_of(F.col("m"))).first()
    assert (tuple(r[0]), tuple(r[1]), tuple(r[2]), r[3]) == (("1.0", "s"), ("2", "t"), ("2", "https://rubygems.org/gems/x-2.gem"), "1.2")
    index = spark.createDataFrame([("0.10.1", True), ("0.11.0", True), ("0.12.0", True), ("0.12.1", True), ("0.13.0", False), ("master", True)], "version string, has_source boolean")
    assert rows(scans.newest_releases(index)) == [("0.11.0",), ("0.12.1",)]
    pool = spark.createDataFrame([("a", "1.9", "d", ["a_1.orig.tar.gz", "a_1.orig-b.tar.gz"]), ("a", "1.10", "d", ["a_2.orig.tar.xz"]), ("b", "1", "d", ["b.diff"])], "package string, version string, directory string, files array<string>")
    assert rows(feeds.newest_in_pool(pool, paths.version_key(F.col("version")))) == [("a", "1.10", "d", "a_2.orig.tar.xz")]
    assert scans.toml_rows("[a]\nb = 1\n[[a.c]]\nd = 'x'\n") == [("a", "b", "1"), ("a.c.0", "d", "x")]


def test_outputs(spark, tmp_path):
    ledger = "x = 1\n\n[corpus.sweep]\nfiles = 1\n\n[other]\ny = 2\n"
    totals = dict(files=200, passed=199, failed=1, gap_files=1, noise_files=0, config_files=2, version_files=0)
    new = sinks.ledger_block(ledger, "c", totals)
    assert "files = 200\npassed = 199" in new and "pass_rate = '99.50%'" in new and new.endswith("[other]\ny = 2\n") and new.startswith("x = 1\n")
    assert sinks.ledger_block("[corpus.c_sweep]\n[corpus.sweep]\n", "c", totals).index("files") < len("[corpus.c_sweep]\n") + 1 and sinks.ledger_block("a = 1\n", "c", totals) == "a = 1\n"
    clusters = [dict(signature="s > ERROR 'x'", verdict="gap", valid=3, examples=["p:1 x"], macro_files=2, macros="M (2)"), dict(signature="t", verdict="config", config_files=2, valid=0, examples=[])]
    text = sinks.work_queue("c", totals, clusters)
    assert "### 1. `s > ERROR 'x'`: 3 valid file(s)" in text and "M (2)" in text and "- `t`: 2 file(s)" in text and "No gaps." in sinks.work_queue("c", totals, [])
    report = json.loads(sinks.report_json(lang="c", clusters=spark.createDataFrame([(1, "é")], "n int, s string")))
    assert report == {"lang": "c", "clusters": [{"n": 1, "s": "é"}]}
    for body in ("one", "two"):
        sinks.write_text(spark, f"{tmp_path}/r.md", body)
    assert (tmp_path / "r.md").read_text() == "two" and [x.name for x in tmp_path.iterdir() if not x.name.startswith(".")] == ["r.md"]
    assert sinks.table_text([{"a": 12345, "b": None}], ["a", "b"]) == "a       b\n12,345  -\n"
    assert sinks.table_text([{"a": True, "b": "x|y"}], ["a", "b"], markdown=True) == "| a | b |\n| --- | --- |\n| True | x\\|y |\n"


def test_evidence():
    text = "known_gaps = [{what = 'a   b', files = 3}, {x = 1}]\nshape_check = 1\n[corpus.sweep]\nfiles = 2\npassed = 1\n[corpus.js_sweep]\nfiles = 9\npass_rate = '1%'\n[corpus.note]\nz = 1\n[corpus.gaps]\nq = 1\n"
    corpora, measured, items = status.evidence("ts", text)
    assert corpora == [("ts", "js", 9, 0, 0, 0, 0, "1%"), ("ts", "ts", 2, 1, 0, 0, 0, None)]
    assert measured == ["note", "shape", "sweep"] and items == [("ts", "known_gaps", "a b", 3), ("ts", "known_gaps", "declared item", None)]


def test_registry(spark):
    reg = languages.registry(spark)
    every = {r.name: r.all_extensions for r in languages.grammar_extensions(reg).collect()}
    assert every["javascript"] == every["typescript"] == ["ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs"] and every["zig"] == ["zig", "zon"]
    claims = reg.select("name", F.explode("extensions").alias("x"))
    assert languages.shared_claims(claims, "x", "name").count() == 0
    assert [r.name for r in reg.where("rosetta").orderBy("ord").collect()] == ["python", "rust", "typescript", "ruby"]
    s = status.collected(reg, files=spark.createDataFrame([("python", True, 3)], "grammar string, locked boolean, files long"))
    assert tuple(status.summary(s, ["locked"], ["files"]).first()) == (9, 1, 3)
    with pytest.raises(ValueError):
        status.collected(reg, a=spark.createDataFrame([], "grammar string, languages string"))


def test_admission(spark):
    d = spark.createDataFrame([("a.sh", "#!/usr/bin/env zsh\n"), ("a.sh", "x\0"), ("run", "#! /bin/sh\r\n"), ("run", "text"), ("a.ebuild", "")], "p string, t string")
    eco = languages.ECOSYSTEMS["bash"]
    assert [r[0] for r in d.select(eco.admit(F.col("p"), F.col("t"))).collect()] == [False, False, True, False, True]
    c, cpp = (languages.ECOSYSTEMS[x] for x in ("c", "cpp"))
    h = spark.createDataFrame([("x.h", "class A;"), ("x.h", "int a;"), ("x.c", "class A;")], "p string, t string")
    assert [tuple(r) for r in h.select(c.admit(F.col("p"), F.col("t")), cpp.admit(F.col("p"), F.col("t"))).collect()] == [(False, True), (True, False), (True, True)]


def test_python_oracle():
    o = languages.PythonParser()
    assert o.validate([b"return 1", None, b"x", b"\0"]) == [False, None, True, False] and o.validate_syntax_only([b"return 1"]) == [True]
    assert (0, 5, "Assign") in o.spans("é = 1") or (0, 6, "Assign") in o.spans("é = 1")
    assert ("Assign", "value", "Constant") in o.edges("x = 1") and o.tokens("x = 1") == ["x", "=", "1"]
    assert o.error_offset("a\n(é é") is not None and o.error_offset("a") is None and o.unparse("x=1") == ("x = 1", None) and o.unparse("(")[0] is None


def test_positions(spark):
    text = "a\nbé\n c d "
    d = spark.range(1).select(scalars.latin(F.encode(F.lit(text), "UTF-8")).alias("x"))
    r = d.select(scalars.line_and_snippet(F.col("x"), F.lit(7)), scalars.error_line(F.col("x"), F.lit(7)), scalars.row_and_column(F.col("x"), F.lit(7)), scalars.floor_boundary(F.col("x"), F.lit(4)), scalars.floor_boundary(F.col("x"), F.lit(99))).first()
    assert (tuple(r[0]), r[1], tuple(r[2]), r[3], r[4]) == ((3, "c d"), " c d ", (2, 1), 3, 11)
    t = spark.range(1).select(scalars.trim_end(F.lit("ab;, \n"), F.lit(0), F.lit(6)), scalars.trim_start(F.lit(" ;ab"), F.lit(0), F.lit(4)), scalars.clip(F.lit("a\nb"), 3), scalars.first_key(F.lit('{"rules": {"z": 1, "a": 2}}'))).first()
    assert tuple(t) == (2, 2, "a\\nb", "z")
    flags = spark.createDataFrame([(["src", "", "a/include", "src"],)], "f array<string>").select(scalars.include_flags(F.col("f"))).first()[0]
    assert flags == ["-I.", "-Ia/include", "-Isrc"]


def test_roles(spark):
    ok = rules.Manifest(facets={"_string": ["text"]}, uncategorised=[("blob", "bytes")])
    named, tiers = ["_expression", "_literal", "call", "number", "text", "blob"], {"_expression": ["call", "_literal"], "_literal": ["number"]}
    assert rules.findings(spark, ok, named, tiers).count() == 0
    outside = {"_expression": ["call"], "_literal": ["number"]}
    assert rows(rules.findings(spark, ok, named, outside)) == [("4", "_literal/_expression")]
    both = rules.Manifest(facets={"_parameter": ["text"]}, demoted={"_parameter": "why"}, uncategorised=[("blob", "b")])
    assert rows(rules.findings(spark, both, [*named, "_parameter"], {**tiers, "_parameter": ["text"]})) == [("1b-iii", "_parameter")]
    counts = spark.createDataFrame([("_loop", 0), ("_name", 3)], "role string, n long")
    assert rows(rules.dead_roles(["_loop", "_name", "_jump"], counts)) == [("_jump",), ("_loop",)]
    assert rules.ledger_version("0.1.0") is None and "9" in rules.ledger_version("9")


def test_zip_and_orders(spark):
    a = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "x")], "file_id long, seq long, item string")
    b = spark.createDataFrame([(1, 0, "x"), (1, 1, "z"), (2, 0, "x"), (2, 1, "w")], a.schema)
    assert rows(reports.zip_compare(a, b)) == [(1, 1, "y", "z"), (2, 1, None, "w")]
    f = spark.createDataFrame([("b", "gap", True, 2, "p"), ("a", "gap", True, 1, "q"), ("c", "noise", False, 3, "r"), ("c", "noise", False, 4, "s")], "signature string, label string, valid boolean, ord long, path string")
    assert [r.signature for r in reports.clusters(f).collect()] == ["a", "b", "c"]
