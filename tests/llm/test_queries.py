"""Every registered query of the subpackage over whole small tables, against SQL or its plain version."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from quillon.llm import trie
from quillon.llm.queries import ORACLE, QUERIES, vocabulary
from tests.llm import brute

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def documents(duck):
    return duck.sql("select doc_id, text, lang from documents order by doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA), duck.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = sorted(tuple(map(str, r)) for r in got.select(*(f"`{c}`" for c in cols)).collect())
    assert rows and rows == sorted(tuple(map(str, r)) for r in want.select(*(duckdb.ColumnExpression(c) for c in cols)).fetchall())


def test_media_features_follow_the_text(spark, documents):
    got = {r.doc_id: r for r in QUERIES["op1_media"](spark, DATA).collect()}
    assert len(got) == len(documents)
    by_text = defaultdict(set)
    for i, t, _ in documents:
        by_text[t or ""].add(got[i].feature)
        n, pairs, digest = got[i].feature.split(":")
        assert len(got[i].fp_time) == len(got[i].fp_hash) == int(pairs) and list(got[i].fp_time) == sorted(got[i].fp_time)
    assert all(len(x) == 1 for x in by_text.values())


def test_lm_scores(spark, documents):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _, _ in documents}
    want = brute.lm([t for _, t, _ in documents], [t for i, t, _ in documents if not held[i]], trie.DISCOUNT, trie.STEPS)
    got = {r.doc_id: r for r in QUERIES["op6_lm_scores"](spark, DATA).collect()}
    for (i, _, _), (n, known, base, score) in zip(documents, want):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known) == (held[i], n, known)
        assert abs(r.base_score - base) < 1e-6 and abs(r.score - score) < 1e-6


def packed(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:i]) for i in range(len(v))] and sum(n for _, n in v) <= 2048
    return len(by)


def pieces(rows):
    t, out = Tokenizer.from_file(vocabulary()), []
    for doc, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out += [(doc, k, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    return out


def test_packing(spark, documents):
    rows = QUERIES["op8_best_fit_packing"](spark, DATA).collect()
    want = pieces([(i, t) for i, t, _ in documents])
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    room = []
    for n in sorted((x[3] for x in want), reverse=True):  # best fit, one piece at a time
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(2048 - n)
    assert packed(rows) == len(room)


def test_url_filter(spark, duck):
    pages = duck.sql("select page_id, url, html from pages order by page_id").fetchall()
    got = {r.page_id: r for r in QUERIES["op9_url_filter"](spark, DATA).collect()}
    for (i, _, _), (host, path, rule, verdict, p) in zip(pages, brute.judged_urls([(u, h) for _, u, h in pages])):
        r = got[i]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict) and abs(r.p_block - p) < 1e-6


def test_pipeline(spark, duck, documents):
    """All stages over the whole table, each by its plain version."""
    import corpus_pipeline as c

    scores = brute.language_scores([t for _, t, _ in documents], [(t, lang) for _, t, lang in documents])
    rows = [(i, t) for (i, t, _), s in zip(documents, scores) if s is not None and s >= c.IN_NONE]
    rows = [r for r, (i, _, component) in zip(rows, brute.components(rows, c.NEAR)) if i == component]
    kept = []
    for (i, t), (_, n, gone, _) in zip(rows, brute.substrings(rows)):
        if not gone:
            kept.append((i, t))
        elif gone < n:
            kept.append((i, None))  # its text follows below
    left = brute.substrings_left(rows)
    kept = [(i, left[i] if t is None else t) for i, t in kept]
    items = duck.sql("select item_id, text from benchmark").fetchall()
    clean = [r for r, x in zip(kept, brute.decontaminate(kept, items)) if not x[5]]
    got = c.run(spark, DATA).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(pieces(clean))
    assert len(clean) < len(kept) < len(documents)
    packed(got)
