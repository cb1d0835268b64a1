"""The registered queries of this package, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import balltree, decontaminate, langid, licences, media, neardup, packing, ranked, sql, substrings, tokens, trie, urls, warc
from quillon.llm.shared import kept, table


def vocabulary() -> str:
    """Place of the packing vocabulary among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.wav_columns(table(spark, sf_dir, "documents")))


def damaged(pages: DataFrame) -> DataFrame:
    """A second replica of ``pages`` with known damage: contents that grew or were reversed, records that
    are lost, and records that the first hasn't."""
    at = lambda n, r: F.coalesce(F.col("page_id") % n == r, F.lit(False))
    html = F.when(at(97, 0), F.concat("html", F.lit("!"))).when(at(131, 3), F.reverse("html")).otherwise(F.col("html"))
    added = pages.where(at(89, 5)).withColumn("page_id", F.col("page_id") + 10_000_000)
    return pages.where(~at(61, 7)).withColumn("html", html).unionByName(added)


def op2_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each distinct record of the first replica, and for each that only the second has."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    primary, replica = kept(warc.leaves(pages), "primary"), kept(warc.leaves(damaged(pages)), "replica")
    roots, damage = warc.audit(primary, replica)
    damage = kept(damage, "damage")
    same = primary["file"].eqNullSafe(F.col("d.file")) & primary["page_id"].eqNullSafe(F.col("d.page_id")) & (primary["record_sha256"] == F.col("d.record_sha256"))
    said = primary.join(damage.where("status <> 'extra'").alias("d"), same, "left").select(*(primary[c] for c in primary.columns), F.coalesce("status", F.lit("ok")).alias("status"))
    rows = said.union(damage.where("status = 'extra'")).join(roots, "file", "left")
    return rows.select("page_id", "file", "seq", "offset", "length", "copies", "record_sha256", "file_root", "status")


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n, seen = licences.frequencies(docs, licences.ALL)
    return licences.summary(licences.scan(docs, licences.ALL, n, seen))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    gone = substrings.cleaned(docs).select("row", "n_removed", F.sha2("kept_text", 256).alias("sha"))
    rows = substrings.word_digests(docs).join(gone, "row", "left")
    return rows.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("sha", "all_sha256").alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.fold("doc_id", 7) == 2)
    return trie.score(docs, trie.train(docs.where(~F.col("held_out"))), extra=("held_out",))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.fold("doc_id", 4) == 2)
    profiles = langid.train(docs.where(~F.col("held_out")))
    return langid.predict(docs, profiles, extra=("held_out",))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kept(packing.pieces(table(spark, sf_dir, "documents"), vocabulary()), "pieces")
    return packing.pack(found).drop("text_sha")


#: Fixed rules of the query: verdict, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rows = pages.select("page_id", urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"))
    return urls.judge(urls.with_rules(rows, RULES), urls.lexicon(pages))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.groups(table(spark, sf_dir, "documents"), percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def byte_vocabulary() -> str:
    """Place of the byte-level vocabulary among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens.stored(table(spark, sf_dir, "documents"), byte_vocabulary())
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 100th vector is an anchor, every 7th has a wrong label; components are floor(256 x)."""
    rows = table(spark, sf_dir, "embeddings").where(balltree.usable("vec_id", "label", "embedding"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double"))
    return balltree.hard_negatives(rows.select("vec_id", label.alias("label"), whole.alias("vector")), F.col("vec_id") % 100 == 0)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.Index(table(spark, sf_dir, "documents")).search(table(spark, sf_dir, "benchmark"))


def media_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op1: all but the sound's features."""
    return op1_media(spark, sf_dir).drop("feature", "fp_time", "fp_hash")


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op6: counts and the base score, rounded."""
    return op6_lm_scores(spark, sf_dir).drop("score").withColumn("base_score", F.round("base_score", 6))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op9: host, path and the rules' verdicts."""
    rows = table(spark, sf_dir, "pages").select("page_id", urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"))
    return urls.with_rules(rows, RULES).withColumnRenamed("verdict", "said")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media,
    "op2_fixity_audit": op2_fixity_audit,
    "op3_licence_scan": op3_licence_scan,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_lm_scores": op6_lm_scores,
    "op7_language_id": op7_language_id,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_url_filter": op9_url_filter,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_token_files": op11_token_files,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_ranked_search": op13_ranked_search,
    "media_base": media_base,
    "lm_base": lm_base,
    "url_rules": url_rules,
}

ORACLE: dict[str, str] = sql.ORACLE
