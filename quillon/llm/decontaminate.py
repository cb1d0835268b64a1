"""Benchmark decontamination by a prefix-filtered set join, within DataFrame functions.

A window is ``WINDOW`` consecutive words of an item, or a shorter item as a whole; its set is its
shingles of ``SHINGLE`` words (of all its words where it has fewer).  Shingles are ordered by their
frequency over all documents.  A text that contains a window has all of its shingles, so the
necessary prefix is one: the rarest joins texts and windows, wherever else it stands.  Length and
position bounds drop starts that can't fit; the words around the hit are then compared with the
window, word for word, so equal hashes of different shingles do no harm.

Only hits on rare shingles are shuffled, each with at most ``2 * WINDOW - 1`` words, and counts of
benchmark shingles.  A set of shingles is looked up in an expression while it is below ``IN_ROW``,
and joined as a table beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.native_words import words
from quillon.llm.shared import kept, row_key

WINDOW, SHINGLE = 10, 3
IN_ROW = 20_000


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", width: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(windows: w_id, w_words; owners: w_id, item) of all items; items without words have none.

    A null item id counts as an empty one.
    """
    own = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("ws")).where(F.size("ws") > 0)
    each = own.select("item", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("ws") - width, F.lit(0))), lambda i: F.slice("ws", i + 1, width))).alias("w_words"))
    each = each.select(F.sha2(F.array_join("w_words", " "), 256).alias("w_id"), "w_words", "item")
    return each.select("w_id", "w_words").dropDuplicates(["w_id"]), each.select("w_id", "item").distinct()


def _token(ws: Column, i: Column, k: int) -> Column:
    """Shingle of ``k`` words from place ``i`` on, as a number."""
    return F.xxhash64(F.lit(k), *(F.get(ws, i + j) for j in range(k)))


def _places(ws: Column, k: int, wanted: list[int] | None) -> Column:
    """Starts of all shingles of ``k`` words, or of those that are wanted."""
    every = F.when(F.size(ws) >= k, F.sequence(F.lit(0), F.size(ws) - k)).otherwise(F.array().cast("array<int>"))
    return every if wanted is None else F.filter(every, lambda i: _token(ws, i, k).isin(wanted))


def _few(tokens: DataFrame) -> list[int] | None:
    """The distinct numbers of a one-column table if they are few, else None."""
    found = [r[0] for r in tokens.distinct().limit(IN_ROW + 1).collect()]
    return found if len(found) <= IN_ROW else None


def _all_tokens(rows: DataFrame, k: int, wanted: list[int] | None, *carried: str) -> DataFrame:
    """(carried, k, i, token) for each shingle of ``ws``, or each wanted one."""
    at = rows.select(*carried, "ws", F.explode(_places(F.col("ws"), k, wanted)).alias("i"))
    return at.select(*carried, F.lit(k).alias("k"), "i", _token(F.col("ws"), F.col("i"), k).alias("rare"))


def rarest(found: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(w_id, w_words, k, rare, at): each window's least frequent shingle over all documents.

    Windows with a shingle that no document has are dropped: they can't occur.
    """
    k = F.least(F.lit(SHINGLE), F.size("w_words"))
    each = None
    widths = sorted(r[0] for r in found.select(k).distinct().collect())  # three at most
    for n in widths:
        some = _all_tokens(found.where(k == n).withColumnRenamed("w_words", "ws"), n, None, "w_id", "ws").withColumnRenamed("i", "at")
        each = some if each is None else each.union(some)
    if each is None:
        return found.select("w_id", "w_words", F.lit(0).alias("k"), F.lit(0).cast("long").alias("rare"), F.lit(0).alias("at"))
    vocabulary = each.select("rare")
    wanted = _few(vocabulary)
    rows, counts = docs.select(words(F.col(text)).alias("ws")), None
    for n in widths:
        some = _all_tokens(rows, n, wanted).groupBy("rare").agg(F.count("*").alias("n"))
        counts = some if counts is None else counts.union(some)
    if wanted is None:
        counts = counts.join(vocabulary.distinct(), "rare", "left_semi")
    best = each.join(counts, "rare", "left").groupBy("w_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("rare"), F.col("at"), F.col("k"))).alias("b"), F.first("ws").alias("w_words"))
    return best.where(F.col("b.n") > 0).select("w_id", "w_words", "b.k", "b.rare", "b.at")


def _with_hits(docs: DataFrame, index: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, row, n_words, hits): hits are the places of rare shingles with the words around them."""
    rows = docs.select(F.col(key).alias("key"), row_key(key, text).alias("row"), words(F.col(text)).alias("ws"))
    wanted, widths = _few(index.select("rare")), sorted(r.k for r in index.select("k").distinct().collect())  # three at most

    def around(places: Column, k: int) -> Column:
        near = lambda i: F.slice("ws", F.greatest(i - (width - 1), F.lit(0)) + 1, F.least(i, F.lit(width - 1)) + width)
        return F.transform(places, lambda i: F.struct(_token(F.col("ws"), i, k).alias("rare"), i.alias("i"), near(i).alias("near")))

    def known(k: int) -> Column:
        return F.transform(F.filter("at", lambda x: x["k"] == k), lambda x: x["i"])

    none = F.array().cast("array<struct<rare:bigint,i:int,near:array<string>>>")
    size = F.size("ws").cast("long").alias("n_words")
    if wanted is not None:
        hits = [around(_places(F.col("ws"), k, wanted), k) for k in widths]
        return rows.select("key", "row", size, F.concat(none, *hits).alias("hits"))
    places = None
    for k in widths:
        some = _all_tokens(rows, k, None, "key", "row").join(index.select("rare").distinct(), "rare", "left_semi")
        places = some if places is None else places.union(some)
    places = places.groupBy("key", "row").agg(F.collect_set(F.struct("k", "i")).alias("at"))
    p = places.select(F.col("key").alias("_key"), F.col("row").alias("_row"), "at")
    joined = rows.join(p, F.col("key").eqNullSafe(F.col("_key")) & (F.col("row") == F.col("_row")), "left")
    hits = F.concat(none, *(around(known(k), k) for k in widths))
    return joined.select("key", "row", size, F.when(F.col("at").isNull(), none).otherwise(hits).alias("hits"))


def contained(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """key, n_words, n_hit, items (sorted array) and spans (array of start, length) of each row.

    Null or empty text has no words and no hits.  Repeated rows each get their result; rows with
    one key but different texts are judged apart.  Other columns are not carried.
    """
    found, owners = windows(benchmark, item, item_text, width)
    index = kept(rarest(found, docs, text), "windows")
    base = kept(_with_hits(docs, index, key, text, width), "hits")
    hit = base.where(F.size("hits") > 0).select("key", "row", "n_words", F.explode("hits").alias("h")).select("key", "row", "n_words", "h.*")
    start, length = F.col("i") - F.col("at"), F.size("w_words")
    bound = (start >= 0) & (start + length <= F.col("n_words"))
    here = F.slice("near", F.greatest(F.least(F.col("i"), F.lit(width - 1)) - F.col("at"), F.lit(0)) + 1, length)
    pairs = hit.join(index, "rare").where(bound).where(here == F.col("w_words"))
    spans = pairs.select("key", "row", F.struct(start.alias("start"), length.alias("length")).alias("span"), "w_id").distinct()
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))
    per_doc = spans.join(owners, "w_id").groupBy("key", "row").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    per_doc = per_doc.select(F.col("key").alias("_key"), F.col("row").alias("_row"), "spans", "items", F.size(covered).cast("long").alias("n_hit"))
    joined = base.drop("hits").join(per_doc, F.col("key").eqNullSafe(F.col("_key")) & (F.col("row") == F.col("_row")), "left")
    return joined.select(
        F.col("key").alias(key), "row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>")).alias("spans")
    )
