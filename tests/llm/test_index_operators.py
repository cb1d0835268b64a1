"""Token files, hard negatives and ranked search over awkward tables, against their plain versions."""

import io
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import balltree, pfor, ranked, tokens
from quillon.llm.queries import QUERIES, byte_vocabulary
from quillon.llm.shared import kept, ship
from tests.llm import brute

DATA = "/root/testdata/sf0.001"


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("values", ["small", "wide", "outliers", "equal"])
def test_blocks_round_trip(values):
    rng = np.random.default_rng(3)
    v = {"small": rng.integers(900, 1000, 4096), "wide": rng.integers(0, 2**32, 4096), "equal": np.full(4096, 7), "outliers": np.where(np.arange(4096) % 40, rng.integers(0, 16, 4096), 2**32 - 1)}[values].astype(np.uint32)
    found = pfor.pack(v)
    starts = np.cumsum([0, *map(len, found)])[:-1]
    assert (pfor.unpack(b"".join(found), starts) == v).all()
    if values == "outliers":  # 4 bits for most, and 8 bytes at most for each exception
        assert sum(map(len, found)) < 4096 // 2 + 8 * 103 + 100


def test_file_round_trip_and_damage():
    rng = random.Random(4)
    docs = [(None if i % 5 == 0 else i, np.array([rng.randrange(50_000) for _ in range(rng.choice([0, 1, 3, 1024, 5000]))], "<u4").tobytes()) for i in range(60)]
    sink = io.BytesIO()
    w = pfor.FileWriter(sink)
    for key, ids in docs:
        w.add(key, ids)
    w.close()
    r = pfor.FileReader(Source(sink.getvalue()))
    got = []
    for lo in range(0, r.total, 7000):  # as several tasks would
        for a, z in r.documents(lo, min(r.total, lo + 7000)):
            for d in range(a, z):
                got.append((None if r.null[d] else int(r.keys[d]), r.ids(int(r.upto[d]), int(r.upto[d + 1])).astype("<u4").tobytes()))
    assert got == docs
    with pytest.raises(ValueError):
        pfor.FileReader(Source(sink.getvalue()[:-30] + b"x" + sink.getvalue()[-29:]))


def test_ids_equal_the_library():
    rng = random.Random(1)
    alphabet = "abcS stmdrevl'''  \n\t\x85\xa0éß12²½.,!?º-"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(8000)]
    texts += ["x\x1cy", "\0", "中文 a 🙂", "a <|endoftext|> b", "  ", "\n\n", " 's's're'll", None, "word " * 300_000]
    encode, whole = tokens.ByteEncoder(byte_vocabulary()), Tokenizer.from_file(byte_vocabulary())
    for lo in range(0, len(texts), 500):
        for t, ids in zip(texts[lo : lo + 500], encode(texts[lo : lo + 500])):
            assert np.frombuffer(ids, "<u4").tolist() == [*whole.encode(t or "", add_special_tokens=False).ids, 2]


def plain_tokens(rows):
    t, out, at = Tokenizer.from_file(byte_vocabulary()), [], 0
    for doc, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_query(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op11_token_files"](spark, DATA).collect()
    assert sorted(map(tuple, got)) == plain_tokens(sorted((r.doc_id, r.text) for r in rows))


def test_token_files_of_awkward_rows(spark):
    rows = [(5, "b"), (None, "no id"), (5, "b"), (5, None), (2, ""), (-3, "last words " * 5000), (9, "x" * 3000)]
    docs = spark.createDataFrame([(i, t, 1, 2.0) for i, t in rows], "doc_id long, text string, ids int, start double")
    ship(spark)
    got = tokens.stored(docs.repartition(3), byte_vocabulary()).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, -3, 2, 5, 5, 5, 9]
    assert sorted(r.start for r in got) == np.cumsum([0, *(len(r.ids) // 4 for r in sorted(got, key=lambda r: r.start))])[:-1].tolist()
    whole = Tokenizer.from_file(byte_vocabulary())
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter((i, np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in rows)
    assert tokens.stored(docs.where("doc_id > 100"), byte_vocabulary()).count() == 0


def test_appended_files_and_lost_attempts(spark, tmp_path):
    ship(spark)
    folder = f"file://{tmp_path}/out"
    one = spark.createDataFrame([(1, np.arange(5, dtype="<u4").tobytes())], "doc_id long, ids binary")
    tokens.write(one, folder)
    (tmp_path / "out" / "part-000000-left-behind.pfor").write_bytes(b"half a file")
    one.withColumn("doc_id", F.lit(2).cast("long")).write.format("pfor").mode("append").save(folder)
    assert sorted((r.doc_id, r.start, len(r.ids)) for r in tokens.read(spark, folder).collect()) == [(1, 0, 20), (2, 5, 20)]
    tokens.write(one, folder)
    assert tokens.read(spark, folder).count() == 1


# hard negatives


def plain_negatives(rows):
    """rows (vec_id, label, vector of whole numbers)."""
    dot = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b))
    out = Counter()
    anchors = sorted({(i, y, tuple(v)) for i, y, v in rows if i % 100 == 0})
    for i, y, v in anchors:
        others = sorted(((-dot(v, w), j, z) for j, z, w in rows if j != i and len(w) == len(v)))
        for s, j, z in [x for x in others if x[2] == y][:5]:
            far = [(t, n) for t, n, z in others if z != y and 80 * -s <= 100 * -t <= 100 * -s]
            out.update((i, j, r, n, -s, -t) for r, (t, n) in enumerate(far[:5], 1))
    return out


def vectors():
    rng = random.Random(8)
    rows = [(i, rng.randrange(3), [float(rng.randint(-9, 9)) for _ in range(4)]) for i in range(900)]
    rows += [(i, i % 3, [3.0, 3.0, 1.0, 0.0]) for i in range(1000, 1400)]  # one very common vector
    rows += [rows[100], rows[100], rows[7], (200, 1, [1.0, 1.0, 1.0, 1.0])]  # repeated rows, one id with two vectors
    rows += [(2000 + i, i % 2, [float(i), 1.0]) for i in range(101)] + [(3000, 0, []), (3001, 0, []), (3002, 1, [])]  # other lengths
    rows += [(4000, 0, [2.0**40, 1.0, 0.0, 0.0]), (4001, 0, [2.0**40, 3.0, 0.0, 0.0]), (4002, 1, [2.0**12, 3.0, 0.0, 0.0])]
    return rows


def test_hard_negatives_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(balltree, "ROWS", 300)
    ship(spark)
    rows = [r for r in vectors() if r[0] < 4000]
    useless = [(None, 1, [1.0] * 4), (500, None, [1.0] * 4), (600, 1, None), (700, 1, [1.0, None, 1.0, 1.0]), (800, 1, [float("nan")] * 4), (801, 1, [float("inf")] * 4)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows + useless], "vec_id long, label int, vector array<double>, score int, unit int").repartition(5)
    found = balltree.hard_negatives(table.where(balltree.usable()), F.col("vec_id") % 100 == 0)
    got = Counter(map(tuple, found.collect()))
    assert got == plain_negatives(rows) and len(got) > 100
    assert balltree.hard_negatives(table.where("vec_id = 1"), F.col("vec_id") % 100 == 0).count() == 0
    assert balltree.hard_negatives(table.where("vec_id < 0"), F.col("vec_id") % 100 == 0).count() == 0


def test_products_beyond_doubles():
    a, x = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 3.0], [2.0**60, 1.0], [-(2.0**60), 1.0]])
    assert balltree.products(a, x).tolist() == [[2**60 + 3, 2**63 - 1, -(2**63) + 1]]


def test_trees_prune_on_both_sides():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(16, 8)) * 100
    x = np.floor(np.repeat(centres, 512, axis=0) + rng.normal(size=(8192, 8)))
    ids, labels = np.arange(8192), np.arange(8192) % 2
    t = balltree.tree(ids, labels, x)
    assert sorted(t["ids"].tolist()) == ids.tolist()
    for i in range(len(t["lo"])):  # every node's ball holds its rows
        d = np.sqrt(((t["x"][t["lo"][i] : t["hi"][i]] - t["centre"][i]) ** 2).sum(axis=1))
        assert (d <= t["radius"][i] + 1e-9).all()
    score = balltree.products(x[:4], x)
    for low, high in ((-(2**62), 2**62), (0, int(np.median(score[0]))), (int(score[0].max()) + 1, 2**62)):
        s = balltree.Search(ids[:4], labels[:4], x[:4], np.arange(4), np.full(4, low), np.full(4, high), False, 5)
        s.visit(t)
        q, got, who = s.best()
        for i in range(4):
            want = sorted((-int(score[i, j]), j) for j in range(8192) if labels[j] != labels[i] and low <= score[i, j] <= high)[:5]
            assert [(-a, b) for a, b in zip(got[q == i].tolist(), who[q == i].tolist())] == want
        assert s.scored < 4 * 8192 / 2


# ranked search


def plain_search(docs, items, k=50):
    split = [(i, Counter(brute.words(t)), len(brute.words(t))) for i, t in docs]
    split = [x for x in split if x[2]]
    n, total = len(split), sum(x[2] for x in split)
    df = Counter(w for _, c, _ in split for w in c)
    out = []
    for item, text in sorted(set(items), key=str):
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in set(brute.words(text)) if df[t]}
        scores = []
        for i, c, size in split:
            m = 50 + (50 * size * n) // total
            s = sum(v * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t, v in w.items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def test_ranked_search_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(ranked, "SEGMENT", 40)
    ship(spark)
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdeñé", k=rng.randint(1, 4))) for _ in range(150)]
    docs = [(i, " ".join(rng.choice(vocabulary[: rng.choice([5, 150])]) for _ in range(rng.randint(1, 60)))) for i in range(300)]
    docs += [docs[3], docs[3], (3, "one id with two texts abc"), (None, docs[8][1]), (None, None), (900, ""), (901, "?! -"), (902, "LONG Text " * 3000), (903, None)]
    docs += [(1000 + i, docs[5][1]) for i in range(200)]  # more copies than are returned
    items = [(1, "abc É ñ"), (2, docs[5][1]), (2, docs[5][1]), (3, None), (4, "nothing has this"), (5, "long TEXT long"), (6, " ".join(vocabulary)), (None, "a b c")]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, score int, terms int").repartition(7)
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = ranked.Index(frame).search(asked).collect()
    by = lambda rows: {k: [tuple(r)[1:] for r in sorted(rows, key=lambda r: r[1]) if r[0] == k] for k in {r[0] for r in rows}}
    assert by(got) == by(plain_search(docs, items))
    assert ranked.Index(frame.where("doc_id < 0")).search(asked).count() == 0
    assert ranked.Index(frame).search(asked.where("item_id > 100")).count() == 0


def test_bounds_hold(spark):
    """Level one brackets the exact scores, and its upper bounds are close."""
    ship(spark)
    docs = kept(spark.read.parquet(f"{DATA}/documents.parquet"), "docs")
    index = ranked.Index(docs)
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    known = index.weighted(items).withColumn("start", F.lit(0).cast("long"))
    q = [ranked.load(r.data) for r in ranked._blocks(known.coalesce(1)).collect()]
    exact = defaultdict(dict)
    name = {bytes(r.item): r.item_id for r in known.collect()}
    for item, _, doc, score in plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 10**6):
        exact[item][doc] = score
    second = {r.unit: ranked.load(r.data) for r in index.exact.collect()}
    seen = 0
    for r in index.first.collect():
        for block in q:
            upper, lower = ranked.bounds(ranked.load(r.data), block)
            for i, key in enumerate(block["item"]):
                for d, doc in enumerate(second[r.unit]["ids"].tolist()):
                    s = exact[name[key.tobytes()]].get(doc, 0)
                    assert lower[i, d] <= s <= upper[i, d]
                    seen += s > 0
    assert seen > 1000
