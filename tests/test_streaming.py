import datetime as dt
from collections import Counter

from pyspark.sql import functions as F

from quillon.operators import mutants
from quillon.streaming import sweep


def test_sweep_keeps_up(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    out, mark, src = f"{tmp_path}/out", f"{tmp_path}/mark", f"{tmp_path}/in"
    put = lambda rows: spark.createDataFrame(rows, sweep.RESULTS).write.mode("append").parquet(src)

    def now():
        sweep.write(sweep.clusters(sweep.results(spark, src)), out, mark, "complete").awaitTermination()
        return sorted(map(tuple, spark.read.parquet(out).collect()))

    put([("a", "1", "x", True, at(1)), ("b", "2", None, None, at(1)), ("c", "3", "x", False, at(2))])
    assert now() == [("x", 2, 1)]
    put([("d", "4", "y", None, at(3)), ("e", "1", "x", True, at(3))])
    assert now() == [("x", 3, 2), ("y", 1, 0)]
    sweep.write(sweep.first_seen(sweep.results(spark, src)), f"{tmp_path}/seen", f"{tmp_path}/mark2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/seen").count() == 4
    sweep.write(sweep.rates(sweep.results(spark, src), late="0 hours"), f"{tmp_path}/rates", f"{tmp_path}/mark3").awaitTermination()
    assert {(r.files, r.failed) for r in spark.read.parquet(f"{tmp_path}/rates").collect()} >= {(2, 1), (1, 1)}


def test_passes_are_skipped_across_restarts(spark, tmp_path):
    """Three runs from one checkpoint, the grammar changing between them, against a plain fold."""
    src, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    batches = [
        [("a", "good", "g1"), ("b", "bad x", "g1"), ("c", "good", "g1"), (None, None, "g1")],
        [("a", "good", "g1"), ("b", "bad x", "g1"), ("d", "new", "g1")],
        [("a", "good", "g2"), ("e", "fixed in g2", "g2"), ("d", "new", "g1"), ("f", "good", "g2")],
    ]
    passed, want = {}, Counter()
    for rows in batches:  # rows of one content are told apart by their number only: one of them is judged
        for (text, g), n in Counter((t, g) for _, t, g in rows).items():
            bad, known = (text or "").startswith("bad"), passed.get(text) == g
            skipped = n if known else 0 if bad else n - 1
            want[text, g, True] += skipped
            want[text, g, False] += n - skipped
            passed |= {} if bad else {text: g}
    for rows in batches:
        spark.createDataFrame([(p, str(hash(t)), t, g) for p, t, g in rows], sweep.WORK).write.mode("append").parquet(src)
        stream = spark.readStream.schema(sweep.WORK).parquet(src)
        judge = lambda text: text[:5] if text.startswith("bad") else None
        sweep.write(sweep.judged(stream, judge), out, mark).awaitTermination()
    spark.conf.unset(key)
    got = spark.read.parquet(out).collect()
    text_of = {str(hash(t)): t for rows in batches for _, t, _ in rows}
    assert Counter((text_of[r.sha256], r.fingerprint, r.skipped) for r in got) == +want
    assert {r.signature for r in got if text_of[r.sha256] == "bad x"} == {"bad x"} and {r.signature for r in got if text_of[r.sha256] != "bad x"} == {None}


def test_mutants(spark):
    d = spark.createDataFrame([("p", ["a", "b", "c", "a"]), ("q", ["a", "b"]), ("r", ["z"] * 3)], "path string, tokens array<string>")
    got = mutants.mutants(d, 60).collect()
    assert {r.path for r in got} == {"p", "r"} and {r.kind for r in got if r.path == "r"} == {"delete", "duplicate"}
    n = {"delete": 3, "duplicate": 5, "swap": 4, "replace": 4}
    assert {r.kind for r in got if r.path == "p"} == set(n)
    assert all(len(r.tokens) == n[r.kind] and r.tokens != ["a", "b", "c", "a"] for r in got if r.path == "p")
    assert all(sorted(r.tokens) == ["a", "a", "b", "c"] for r in got if r.path == "p" and r.kind == "swap")
    assert got == mutants.mutants(d, 60).collect()
    wide = mutants.widenings(d.where("path = 'p'"), mutants.mutants(d, 60), F.size("tokens") != 3, F.lit(True))
    assert {r.kind for r in wide.collect()} == {"delete"}
