"""Each operator over a small table of awkward rows, against its plain version."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import decontaminate, eliasfano, langid, licences, media, neardup, packing, substrings, trie, urls, warc
from quillon.llm.queries import RULES, vocabulary
from quillon.llm.shared import kept
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, row long, score double"


def _texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgéñ", k=rng.randint(1, 6))) for _ in range(400)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, long = make(70), make(3000)
    base = make(200)
    near = [base[:i] + ["x"] + base[i + 1 :] for i in (3, 50, 120, 199)]
    texts = [" ".join(t) for t in (make(120), base, *near, base, make(30) + passage + make(9), make(5) + passage + make(80), passage[:51], passage[:49], long, long[100:2900], make(3), make(5))]
    texts += ["", None, "   \n\t ", "Ä Ö K K İ", "The MIT License. mit license\nCC-BY cc by nc 4.0", "Licensed under the Apache License, Version 2.0.", "GNU General  Public\tLicense, version 3", "12 34 !!", "the " * 300, "the " * 200]
    texts += ["Permission is hereby granted, free of charge, to any person getting a copy of this software"]
    return texts


@pytest.fixture(scope="module")
def rows():
    found = [(3 * i + 1, t) for i, t in enumerate(_texts())]
    return [*found, found[1], found[4], (None, found[7][1]), (None, None), (7, "one id with two texts"), (10_000, found[2][1])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Extra columns carry names that the operators use themselves."""
    return kept(spark.createDataFrame([(i, t, "en" if i and i % 2 else None, 1, 0.5) for i, t in rows], SCHEMA).repartition(3), "docs")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


def test_media(docs, rows, empty):
    got = media.media_features(media.wav_columns(docs)).collect()
    same([(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got], [(i, *brute.media(t)) for i, t in rows])
    assert len({r.feature for r in got if r.n_bytes == 0}) == 1
    assert media.media_features(media.wav_columns(empty)).count() == 0


def test_media_tone_and_shift():
    t = np.arange(40 * media.HOP)
    tone = (128 + 60 * np.sin(2 * np.pi * t / 16) * (1 + (t // 3000) % 2)).astype(np.uint8)
    at, what, _ = media.fingerprints(tone.tobytes())
    assert {int(x) >> 16 for x in what} & {64}
    later, what2, _ = media.fingerprints(np.concatenate([np.full(4 * media.HOP, 128, np.uint8), tone]).tobytes())
    assert Counter(what.tolist()) & Counter(what2.tolist())
    assert media.from_wav(media.to_wav(b"\x00\xff" * 9)) == b"\x00\xff" * 9


def test_media_last_partial_frame():
    """A sound in the samples after the last whole frame leaves peaks."""
    for units in (2, 9, 15):
        quiet = np.full(576 * units, 128, np.uint8)
        rest = (len(quiet) - media.FRAME) % media.HOP
        heard = quiet.copy()
        heard[-rest:] = 128 + 60 * np.sin(2 * np.pi * np.arange(rest) / 16)
        assert rest and media.fingerprints(quiet.tobytes())[2] == 0 and media.fingerprints(heard.tobytes())[2] > 0


def test_licences(docs, rows, empty):
    templates = licences.ALL
    n, seen = licences.frequencies(docs, templates)
    assert n == len(rows)
    assert {w: c for w, c in seen.items() if c} == {w: c for w in {w for t in templates for w in t.words} if (c := sum(w in brute.words(t) for _, t in rows))}
    clash = docs.withColumn("words", F.lit(1)).withColumn("places", F.lit(2)).withColumn("key", F.lit(3))
    got = licences.summary(licences.scan(clash, templates, n, seen)).collect()
    same([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], [(i, *brute.licences(t)) for i, t in rows])
    labels = {r.labels for r in got}
    assert {"cc-by,cc-by-nc,mit", "apache,apache-2.0", "gpl,gpl-3.0"} <= labels
    assert all(0 <= r.score <= 1 and (r.score > 0) == (r.labels != "") for r in got)
    assert licences.frequencies(empty, templates) == (0, {})
    assert licences.scan(empty, templates, 0, {}).count() == 0


def test_licence_texts_by_relative_position(spark):
    """Places and weights equal those of trying every start; changed wording lowers the score."""
    rng = random.Random(3)
    texts = []
    for t in licences.TEXTS:
        for changes in (0, 3, 12, 40):
            w = ("so it is " * rng.randint(0, 3)).split() + t.text.split()
            for _ in range(changes):
                w[rng.randrange(len(w))] = "other"
            texts.append(" ".join(w))
    texts += [texts[0] + " " + texts[8], "hereby granted free of charge", texts[4][40:], "as is " * 50]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n, seen = licences.frequencies(d, licences.ALL)
    got = {r.doc_id: sorted((p.label, p.start, round(p.weight, 9)) for p in r.places) for r in licences.scan(d, licences.ALL, n, seen).collect()}
    for i, text in enumerate(texts):
        w, want = brute.words(text), []
        for t in licences.ALL:
            found = licences.anchors(t, n, seen)
            for s in range(len(w)):
                weight = sum(share for j, x, share in found if w[s + j : s + j + 1] == [x])
                if weight >= t.share - 1e-9 and all(w[s + at : s + at + len(k)] == k for at, k in t.key_places()):
                    want.append((t.label, s, round(min(weight, 1.0), 9)))
        assert got[i] == sorted(want)
    scores = {p[2] for ps in got.values() for p in ps}
    assert any(0.5 <= x < 0.99 for x in scores) and 1.0 in scores


def test_licence_anchors_of_equal_weight():
    t = licences.Template("x", "a b a c b", ("a b",), 0.5)
    assert [j for j, _, _ in licences.anchors(t, 3, {"a": 1, "b": 1, "c": 1})] == [0, 1, 2, 3, 4]
    assert len(licences.necessary(licences.anchors(t, 3, {}), 1.0)) == 1 and len(licences.necessary(licences.anchors(t, 3, {}), 0.5)) == 3


def test_substrings(docs, rows, empty):
    gone = {r.row: r for r in substrings.cleaned(docs).collect()}
    got = []
    for r in substrings.word_digests(docs).collect():
        x = gone.get(r.row)
        got.append((r.doc_id, r.n_words, x.n_removed if x else 0, brute.sha(x.kept_text) if x else r.all_sha256))
    same(got, brute.substrings(rows))
    assert any(x[2] for x in got)
    assert substrings.cleaned(empty).count() == 0


def test_substrings_of_hot_buckets(spark, docs, rows, monkeypatch):
    """Buckets dealt again by another order of minimisers give the same repeats."""
    rng = random.Random(8)
    core = [f"c{i}" for i in range(60)]
    more = [(100 + i, " ".join(rng.choices("abcdefgh", k=60) + core[: rng.randint(12, 60)] + rng.choices("abcdefgh", k=60))) for i in range(60)]
    d = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    want = {(doc, n) for doc, _, n, _ in brute.substrings([*rows, *more]) if n}
    for hot in (substrings.HOT, 5, 0):
        monkeypatch.setattr(substrings, "HOT", hot)
        ids = {r.row: r.doc_id for r in substrings.word_digests(d).collect()}
        assert {(ids[r.row], r.n_removed) for r in substrings.cleaned(d).collect()} == want


@pytest.mark.parametrize("in_row", [decontaminate.IN_ROW, 3])
def test_decontaminate(spark, docs, rows, empty, monkeypatch, in_row):
    monkeypatch.setattr(decontaminate, "IN_ROW", in_row)
    some = [t.split(" ") for _, t in rows if t]
    items = [(1, " ".join(some[0][20:45]).upper()), (2, " ".join(some[1][:10])), (3, " ".join(some[1][2:9])), (4, "nowhere to be found"), (5, ""), (6, None), (None, " ".join(some[7][25:36])), (2, "12 34"), (8, "the the the")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contained(docs, bench).collect()
    same([(r.doc_id, r.n_words, r.n_hit, len(r["items"]), brute.sha(",".join(r["items"])), r.n_hit > 0) for r in got], brute.decontaminate(rows, items))
    assert decontaminate.contained(empty, bench).count() == 0
    assert {r.n_hit for r in decontaminate.contained(docs, bench.limit(0)).collect()} == {0}


@pytest.mark.parametrize("percent", [80, 85])
def test_neardup(docs, rows, empty, percent):
    got = [(r.id, r.n_shingles, r.component) for r in neardup.groups(docs, percent).collect()]
    same(got, brute.components(rows, percent))
    assert neardup.groups(empty, percent).count() == 0


def test_neardup_chain_of_borderline_pairs(spark):
    """Neighbours are linked, far ones aren't: components need links found in the second round."""
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(500)]
    chain = [(i, " ".join(words[4 * i : 4 * i + 150])) for i in rng.sample(range(80), 80)]
    d = spark.createDataFrame(chain, "doc_id long, text string")
    got = [(r.id, r.n_shingles, r.component) for r in neardup.groups(d, 85).collect()]
    same(got, brute.components(chain, 85))


def test_likelihood_estimate():
    rng = np.random.default_rng(3)
    for j in (0.5, 0.85):
        a = rng.integers(1, 1 << 62, 2000, dtype=np.uint64) * np.uint64(3)
        k = int(2 * j / (1 + j) * 2000)
        h = np.concatenate([a, np.concatenate([a[:k], rng.integers(1, 1 << 62, 2000 - k, dtype=np.uint64) * np.uint64(3)])])
        r = neardup.registers(h, np.array([0, 2000, 4000]), 600).astype(int)
        est = neardup.similarity(np.array([(r[0] > r[1]).sum()]), np.array([(r[0] < r[1]).sum()]), 600, np.array([2000.0]), np.array([2000.0]))[0]
        assert abs(est - j) < 0.08
        union = neardup.registers(h, np.array([0, 4000]), 600)[0]
        assert (union == r.max(axis=0)).all()


def test_packing(docs, rows, empty):
    t = Tokenizer.from_file(vocabulary())
    want = []
    for doc, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(doc, n, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for n, at in enumerate(range(0, len(ids), 2048))]
    got = packing.pack(kept(packing.pieces(docs, vocabulary()), "p")).collect()
    same([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], want)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:i]) for i in range(len(v))] and sum(n for _, n in v) <= 2048
    assert packing.pack(kept(packing.pieces(empty, vocabulary()), "p")).count() == 0


def test_plan_is_best_fit():
    rng = random.Random(2)
    for _ in range(60):
        items = [rng.randint(1, 64) for _ in range(rng.randint(0, 300))]
        room: list[int] = []
        for n in sorted(items, reverse=True):
            fits = [i for i, r in enumerate(room) if r >= n]
            if fits:
                room[min(fits, key=lambda i: room[i])] -= n
            else:
                room.append(64 - n)
        slots = packing.plan(dict(Counter(items)), 64)
        seqs = {f + k for _, a, b, f, _ in slots for k in range(b - a)}
        assert len(seqs) == len(room)
        assert Counter(n for n, a, b, _, _ in slots for _ in range(b - a)) == Counter(items)


def test_language(spark, docs, rows, empty):
    assert langid.train(empty) == {} and langid.predict(empty, {}).count() == 0
    en = "the cat and the dog went to the house with that old man " * 3
    fr = "le chat et le chien sont dans la maison avec une vieille dame " * 3
    train = spark.createDataFrame([(1, en, "en"), (2, fr, "fr"), (3, None, "en"), (4, "xyz", None)], "doc_id long, text string, lang string")
    profiles = langid.train(train)
    assert sorted(profiles) == ["en", "fr"]
    test = spark.createDataFrame([(1, "the dog and the man"), (2, "la dame et le chien"), (3, None), (4, "12 !!"), (5, ""), (5, "")], "doc_id long, text string")
    got = [(r.doc_id, r.lang_pred) for r in langid.predict(test, profiles).collect()]
    same(got, [(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (5, "und")])
    tie = langid.predict(test.where("doc_id = 1"), {"b": profiles["en"], "a": profiles["en"]}).first()
    assert tie.lang_pred == "a"


@pytest.mark.parametrize("piece", [1, 3, 7, 1 << 16])
def test_language_grams_cross_pieces(piece, monkeypatch):
    monkeypatch.setattr(langid, "PIECE", piece)
    rng = random.Random(1)
    for text in ["", "ΑΣ ΣΑ", *("".join(rng.choices("ab ÄΣİ1 ..", k=rng.randint(0, 12))) for _ in range(200))]:
        keys, n = langid.grams(text)
        assert dict(zip(keys.tolist(), n.tolist())) == brute.grams(text)


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("h", langid.fold("doc_id", 4) == 2)
    said = langid.predict(d.where("h"), langid.train(d.where("not h")), extra=("lang",)).where("lang_pred != 'und' and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in said) >= 0.9 * len(said)


@pytest.mark.parametrize("segment", [None, 700])
def test_trie(spark, docs, rows, empty, segment, monkeypatch):
    """Scores equal those of plain counts, with one segment and with several, hot words split."""
    monkeypatch.setattr(trie, "CHUNK", 997)  # counting and scoring cross chunks; workers keep their own
    model = trie.train(docs, segment=segment)
    assert segment is None or (model.cold > 3 and len(model.hot) and max(model.hot_parts) > 1)
    want = brute.lm([t for _, t in rows], [t for _, t in rows], trie.DISCOUNT, trie.STEPS)
    total = sum(x[0] for x in want)
    assert model.total == total
    got = trie.score(docs, model).collect()
    near = lambda x: (x[0], x[1], x[2], x[3], round(x[4], 6), round(x[5], 6))
    same([near((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)) for r in got], [near((i, w[0], w[1], total, w[2], w[3])) for (i, _), w in zip(rows, want)])
    nothing = trie.train(empty)
    assert [(r.n_known, r.base_score) for r in trie.score(docs.limit(1), nothing).collect()] == [(0, 0.0)]


def test_trie_volumes_hold_many_segments(spark, docs, rows, monkeypatch):
    """Texts meet few files however many segments there are, and find the same in them."""
    monkeypatch.setattr(trie, "FILES", 3)
    model = trie.train(docs, segment=300)
    assert model.parts > 30 and len(model.word_base) <= 4 and model.built == {0, 1, 2}
    assert sum(len(model.segment(f"2-{i}")["of.part"]) for i in model.built) > 30
    want = brute.lm([t for _, t in rows], [t for _, t in rows], trie.DISCOUNT, trie.STEPS)
    same([(r.doc_id, r.n_known, round(r.score, 6)) for r in trie.score(docs, model).collect()], [(i, w[1], round(w[3], 6)) for (i, _), w in zip(rows, want)])


def test_trie_held_out(spark, docs, rows):
    """Unknown words, unknown pairs of known words, and texts scored by a model of others."""
    model = trie.train(docs.where("doc_id % 2 = 0"))
    learnt = [t for i, t in rows if i is not None and i % 2 == 0]
    want = brute.lm([t for _, t in rows], learnt, trie.DISCOUNT, trie.STEPS)
    got = trie.score(docs, model).collect()
    same([(r.doc_id, r.n_known, round(r.score, 6)) for r in got], [(i, w[1], round(w[3], 6)) for (i, _), w in zip(rows, want)])


def test_trie_keeps_what_was_seen_once(spark):
    d = spark.createDataFrame([(1, "a b c"), (2, "a c"), (3, "b c")], "doc_id long, text string")
    model = trie.train(d)
    segments = [model.segment(f"2-{i}") for i in model.built]
    assert sum(len(s["prob2"]) for s in segments) == 6  # end-a, a-b, b-c, c-end, a-c, end-b
    assert sum(len(s["prob3"]) for s in segments) == 6  # end-a-b, a-b-c, b-c-end, end-a-c, a-c-end, end-b-c


def test_trie_searches_the_range_of_the_context(spark):
    """Without the pointers' ranges no successor is found."""
    model = trie.train(spark.createDataFrame([(1, "a b c"), (2, "a c"), (3, "b c")], "doc_id long, text string"))
    a, b = (x.ravel() for x in np.meshgrid(np.arange(4), np.arange(4), indexing="ij"))
    assert (model.pairs(a, b)[1] >= 0).sum() == 6
    for i in model.built:
        seg = model.segment(f"2-{i}")
        n = seg.coded("ptr2").n
        seg.known["ptr2"] = eliasfano.EliasFano(eliasfano.arrays(np.zeros(n, dtype=np.uint64)))
    assert (model.pairs(a, b)[1] >= 0).sum() == 0


def test_packed_arrays():
    rng = np.random.default_rng(4)
    for n in (1, 5, 3000):
        key = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        c, m = rng.integers(0, 1 << 32, n), rng.integers(1, 9, n)
        back = trie._unpacked(trie._packed(key, c, m), 3)
        assert (back[0] == key).all() and (back[1] == c).all() and (back[2] == m).all()


def test_elias_fano():
    rng = np.random.default_rng(1)
    dense = np.concatenate([np.arange(500_000, 502_000), rng.integers(0, 10**6, 3000)])  # a long run of ones
    for v in [dense, np.zeros(0), np.arange(1000), *(rng.integers(0, top, n) for n, top in ((1, 5), (1000, 1 << 62), (5000, 6000), (3000, 1 << 40)))]:
        v = np.unique(v).astype(np.uint64)
        ef = eliasfano.EliasFano(eliasfano.arrays(v))
        where = {int(x): i for i, x in enumerate(v)}
        q = np.concatenate([v, rng.integers(0, 1 << 40, 2000).astype(np.uint64)])
        assert ef.find(q).tolist() == [where.get(int(x), -1) for x in q]
        i = np.arange(len(v))
        assert (ef.find(v, i, i + 1) == i).all() and (ef.find(v, i + 1, i + 9) == -1).all() and (ef.find(v, i * 0, i) == -1).all()


def test_elias_fano_sums_with_repeats_and_gaps():
    rng = np.random.default_rng(2)
    for steps in (rng.integers(0, 3, 4000), np.minimum(rng.zipf(1.3, 4000), 10**7), np.zeros(9, np.int64)):
        sums = np.concatenate([[0], np.cumsum(steps)]).astype(np.uint64)
        a, b = eliasfano.EliasFano(eliasfano.arrays(sums)).two(np.arange(len(steps)))
        assert (b - a == steps).all() and (a == sums[:-1].astype(np.int64)).all()


URLS = ["http://Example.org/es/a", "https://www.example.org/en/12?x", "http://a.com/fr/1", "http://a.com/de/1#y", "http://x.net/en/b", "ftp://org", "no scheme", "", None, "http://b.com://c/", "http://example.org/en/1", "http://notexample.org/es/", "http://h.net"]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, f"<p>some words here {i}</p>") for i, u in enumerate(URLS)] + [(None, URLS[0], None)], "page_id long, url string, html string")
    rows = pages.select("page_id", "url", urls.host_of(pages.url).alias("host"), urls.path_of(pages.url).alias("path"))
    rule, verdict = urls.rule_for(rows.host, rows.path, RULES)
    words = urls.lexicon(pages)
    got = {r.page_id: r for r in urls.judge(rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict")), words).collect()}
    for i, u in enumerate(URLS):
        host, path, r, v = brute.url(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, r) and got[i].verdict in ((v,) if v else ("allow", "block"))
    none = urls.judge(rows.limit(0).select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict")), words)
    assert none.count() == 0
    assert split_names(spark, {"spam": 5, "farm": 5}, "spamfarm") == {"spamfarm": ["spam", "farm"]}


def split_names(spark, counts, *names):
    words = spark.createDataFrame(list(counts.items()), "w string, n long")
    return {r.run: list(r.words) for r in urls.split_runs(spark.createDataFrame([(n,) for n in names], "run string"), words).collect()}


def test_urls_with_long_words_and_runs(spark):
    """Words and runs over 63 letters, clashing columns, repeated rows; every row as the plain version says."""
    long, other = "abcdefghij" * 7, "qrstuvwxyz" * 30
    rows = [(f"http://{long}farm.example.org/es/x", f"<b>{long}</b> farm {long}"), (f"http://a.fr/{other}{long}shop", f"shop {long[:64]}"), ("http://a.com/de/" + "z" * 400, "shop farm"), ("http://a.fr/" + "z" * 399 + "farm", None), (None, None), ("nothing", "")]
    rows = rows + rows[:2]
    pages = spark.createDataFrame([(i, u, h, 1, "x") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, w int, token string")
    found = pages.select("page_id", urls.host_of(pages.url).alias("host"), urls.path_of(pages.url).alias("path"), "token")
    got = {r.page_id: r for r in urls.judge(urls.with_rules(found, RULES), urls.lexicon(pages)).collect()}
    for i, (host, path, rule, verdict, p) in enumerate(brute.judged_urls(rows)):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict) and abs(got[i].p_block - p) < 1e-6
    assert split_names(spark, {long: 2, "farm": 1}, long + "farm", other)[long + "farm"] == [long, "farm"]
    assert urls.judge(urls.with_rules(found.limit(0), RULES), urls.lexicon(pages.limit(0))).count() == 0


def test_url_rules_beyond_an_expression(spark, monkeypatch):
    """Joined rules say what the expression says; clashing columns and repeated rows stay."""
    rows = spark.createDataFrame([(i, u) for i, u in enumerate([*URLS, URLS[0], "http://" + "a" * 300_000 + "/es/"])], "h long, url string")
    rows = rows.select("h", F.lit("x").alias("said"), urls.host_of(rows.url).alias("host"), urls.path_of(rows.url).alias("path"))
    want = urls.with_rules(rows, RULES).collect()
    monkeypatch.setattr(urls, "MOST_RULES", 0)
    got = urls.with_rules(rows, RULES)
    assert got.columns == [*rows.columns, "rule", "verdict"]
    same([(r.h, r.rule, r.verdict) for r in got.collect()], [(r.h, r.rule, r.verdict) for r in want])


def test_url_lexicon_keeps_rare_words(spark):
    """A word seen once counts however many words are more frequent."""
    common = " ".join("w" + "".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(50_001))
    pages = spark.createDataFrame([(1, "http://zebrafarm.org/a", f"<p>{common} {common} farm</p>"), (2, None, "zebra zoo"), (3, "http://b.org/", None)], "page_id long, url string, html string")
    words = urls.lexicon(pages)
    assert words.where("w in ('zebra', 'farm', 'zoo') and n = 1").count() == 3 and words.agg(F.sum("n")).first()[0] == 2 * 50_001 + 3
    assert urls.split_runs(spark.createDataFrame([("zebrafarm",)], "run string"), words).first().words == ["zebra", "farm"]


def test_url_tokens_of_all_alphabets(spark):
    words = spark.createDataFrame([("free", 5), ("books", 5)], "w string, n long")
    strings = spark.createDataFrame([("h:", "münchen.freebooks.de"), ("p:", "/Café/日本語/cafe\u0301/12_٣٤٥")], "mark string, s string")
    assert sorted(r.token for r in urls.string_tokens(strings, words).collect()) == sorted(["h:münchen", "h:free", "h:books", "h:de", "p:café", "p:日本語", "p:cafe\u0301", "p:#2", "p:#3"])


PAGE = "page_id long, url string, html string"


def audited(spark, rows, other):
    one, two = (kept(warc.leaves(spark.createDataFrame(r, PAGE).withColumn("path", F.lit("clash")), 64), "l") for r in (rows, other))
    roots, damage = warc.audit(one, two)
    return {(r.page_id, r.status) for r in damage.collect()}, {r.file: r.file_root for r in roots.collect()}


def test_audit(spark):
    """One damaged, lost or added record is one finding, whatever its length."""
    rows = [(i, f"http://h/{i}", "x" * (i % 50)) for i in range(600)] + [(None, None, None), (None, "http://n", "n"), (5, "http://h/5", "xxxxx"), (7, "http://h/7", "y" * 300_000)]
    said, roots = audited(spark, rows, rows[::-1])
    assert not said and len([f for f in roots if f >= 0]) == 10
    other = [(i, u, {17: "x" * 18, 300: "z" * 9, 63: "", None: h}.get(i, h)) for i, u, h in rows if i not in (40, 599)] + [(1000, "u", "new"), (None, "u2", "new")]
    said, changed = audited(spark, rows, other)
    assert said == {(17, "corrupt"), (300, "corrupt"), (63, "corrupt"), (40, "missing"), (599, "missing"), (1000, "extra"), (None, "extra")}
    assert roots == changed  # those of the first replica
    back, other_roots = audited(spark, other, rows)
    assert back == {(i, {"missing": "extra", "extra": "missing"}.get(s, s)) for i, s in said}
    assert {f for f in roots if roots[f] != other_roots.get(f)} >= {0, 4, 9}


def test_audit_copies_and_records_of_one_id(spark):
    rows = [(1, "u", "a")] * 3 + [(1, "u", c) for c in "bcd"] + [(2, "u", "e")]
    assert audited(spark, rows, rows)[0] == set()
    assert audited(spark, rows, rows[1:])[0] == {(1, "corrupt")}  # the number of copies
    said, _ = audited(spark, rows, [r for r in rows if r[2] not in "bc"] + [(1, "u", "q")])
    assert said == {(1, "corrupt"), (1, "missing")}
    leaf = warc.leaves(spark.createDataFrame(rows, PAGE)).orderBy("seq").collect()
    assert sum(r.copies for r in leaf) == 7 and [r.offset for r in leaf] == [sum(x.length * x.copies for x in leaf[:i]) for i in range(len(leaf))]
    assert audited(spark, [], [])[0] == set() and audited(spark, [], rows)[0] == {(1, "extra"), (2, "extra")}


def test_pipeline(spark, docs, rows, tmp_path):
    import corpus_pipeline as c

    spark.createDataFrame([(1, " ".join(rows[0][1].split()[20:40]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = docs
    for name, stage in c.STAGES[:-1]:
        out = kept(stage(spark, d, str(tmp_path)), name)
        assert out.columns == d.columns
        before, after = ([(r.doc_id, r.text) for r in x.collect()] for x in (d, out))
        if name == "language":
            labelled = [(r.text, r.lang) for r in d.collect()]
            scores = brute.language_scores([t for _, t in before], labelled)
            same(after, [x for x, s in zip(before, scores) if s is not None and s >= c.IN_NONE])
            assert len(after) < sum(s is not None for s in scores)  # one text in no known language
        if name == "near_duplicates":
            comp = brute.components(before, c.NEAR)
            assert {i for i, _ in after if i is not None} == {x[2] for x in comp if x[2] is not None}
        if name == "repeated_passages":
            same([(i, brute.sha(" ".join(brute.SPACED.findall(t)))) for i, t in after], [(i, s) for i, n, g, s in brute.substrings(before) if not n or g < n])
        if name == "benchmark_leaks":
            assert {i for i, _ in before} - {i for i, _ in after} == {rows[0][0]}
        d = out
    assert c.packed(spark, d, str(tmp_path)).count() >= d.count()
    assert c.packed(spark, c.benchmark_leaks(spark, d.limit(0), str(tmp_path)), str(tmp_path)).count() == 0


def test_pipeline_language_without_labels(spark):
    import corpus_pipeline as c

    d = spark.createDataFrame([(1, "some words"), (2, None), (3, "12 !!"), (4, "Ä")], "doc_id long, text string").selectExpr("*", "cast(null as string) as lang")
    assert sorted(r.doc_id for r in c.language(spark, d, "").collect()) == [1, 4]


def test_packing_encoder_equals_whole_tokenizer():
    rng = random.Random(5)
    signs = [chr(c) for c in range(0x180)] + list("   　ΣςİǅßſÉ́€’日👍﻿") + ["<|endoftext|>", "<|", "'re", "'LL", "The "]
    texts = ["".join(rng.choice(signs) if rng.random() < 0.6 else rng.choice("abcdEF '.0\n") for _ in range(rng.randrange(40))) for _ in range(5000)]
    encode, whole = packing.Encoder(vocabulary()), Tokenizer.from_file(vocabulary())
    for lo in range(0, len(texts), 250):
        some = texts[lo : lo + 250]
        assert encode(some) == [np.array([*e.ids, packing.END], "<u4").tobytes() for e in whole.encode_batch(some, add_special_tokens=False)]
    assert encode([None, ""]) == [b"\0\0\0\0"] * 2


def test_language_stage(spark):
    """Predictions decide: texts in none of the labelled languages go, short and noisy ones of theirs stay."""
    import corpus_pipeline as c

    prose = {"en": "the cat and the other cat sat there with that hat", "de": "der hund und die andere hündin lagen unter der decke"}
    rows = [(i, t, lang, "s", i) for i, (lang, t) in enumerate(prose.items())] + [(2, "The cat!", None, "s", 1), (3, "DIE %% hündin 123", None, "s", 1), (4, "коты и собаки", None, "s", 1), (5, "12 !", "en", "s", 1), (6, None, "de", "s", 1), (7, "猫と犬", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept_ids = lambda d: sorted(r.doc_id for r in c.language(spark, d, "").collect())
    assert kept_ids(docs) == [0, 1, 2, 3]
    assert kept_ids(docs.withColumn("lang", F.lit(None).cast("string"))) == [0, 1, 2, 3, 4, 7]
    assert c.language(spark, docs.limit(0), "").columns == docs.columns and kept_ids(docs.limit(0)) == []
