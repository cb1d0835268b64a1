"""URL filters: rules by host and path, and for all other URLs a naive Bayes judge.

Host names run words together, so a unigram Viterbi split cuts them into words of a lexicon
counted over all pages.  Multinomial naive Bayes then scores the segmented host and path tokens.
It learns from the URLs that a rule decides, all of them.

Lexicon, splits, token counts and model are tables: what one run of letters can hold is joined to
it, so no task and no driver holds the lexicon or the model, and tokens are told apart as they are.
Hosts and paths are made distinct first, so a host that very many pages share is split and scored once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import frugal, kept

#: Stretches up to this length are joined to the lexicon as they are; longer words are found by their
#: first letters and then compared whole.
STRETCH = 63
#: Rules that are kept in an expression; more are joined.
MOST_RULES = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule (verdict, host, path), else nulls; of rules equally
    long the last in order."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def with_rules(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``rows`` (host, path, ...) with rule and verdict as in ``rule_for``, for any number of rules."""
    if len(rules) <= MOST_RULES:
        rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
        return rows.select("*", rule.alias("rule"), verdict.alias("verdict"))
    table = rows.sparkSession.createDataFrame(rules, "said string, h string, p string")
    asked = rows.select("host", "path").distinct()
    parts = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    fits = asked.select("host", "path", F.explode(ends).alias("h")).join(table, "h").where(F.col("path").startswith(F.col("p")))
    order = F.struct((F.length("h") + F.length("p")).alias("n"), "said", "h", "p")
    best = fits.groupBy("host", "path").agg(F.max(order).alias("r")).select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.concat("r.h", "r.p").alias("rule"), F.col("r.said").alias("verdict"))
    same = F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p"))
    return rows.join(best, same, "left").drop("_h", "_p")


def lexicon(pages: DataFrame, text: str = "html") -> DataFrame:
    """(w, n): the words (runs of a-z, two letters or more) of all rows with their counts.

    Repeated rows count as often as they stand there; nulls have no words; other columns don't matter.
    """
    words = pages.select(F.explode(F.split(F.lower(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "<[^>]*>", " ")), "[^a-z]+")).alias("w"))
    return words.where(F.length("w") > 1).groupBy("w").agg(F.count("*").alias("n"))


def best_split(run: str, held: list[tuple[int, int, int]], total: float) -> list[str]:
    """The most probable words of a run of letters; held: (start, length, count) of the known words in it, total:
    the logarithm of all words' number.

    An unknown stretch costs ``total`` and 2.5 more a letter; of equal costs the longer last word wins.
    """
    ending: dict[int, list[tuple[int, float]]] = {}
    for i, n, count in held:
        ending.setdefault(i + n, []).append((i, total - math.log(count)))
    best: list[tuple[float, int]] = [(0.0, 0)]
    cheapest = (0.0, 0)  # start of an unknown stretch: cost there less 2.5 for each letter before
    for i in range(1, len(run) + 1):
        options = [(best[j][0] + cost, j) for j, cost in ending.get(i, ())]
        best.append(min([(cheapest[0] + total + 2.5 * i, cheapest[1]), *options]))
        cheapest = min(cheapest, (best[i][0] - 2.5 * i, i))
    out, i = [], len(run)
    while i:
        j = best[i][1]
        out.append(run[j:i])
        i = j
    return out[::-1]


def split_runs(runs: DataFrame, words: DataFrame) -> DataFrame:
    """(run, words) of distinct ``runs`` (run) of letters by the lexicon ``words`` (w, n)."""
    size = words.agg(F.sum("n").alias("n")).first()["n"] or 0
    at = runs.where(F.length("run") > 1).select("run", F.explode(F.sequence(F.lit(1), F.length("run") - 1)).alias("i"))
    ends = F.sequence(F.lit(2), F.least(F.lit(STRETCH), F.length("run") - F.col("i") + 1))
    short = at.select("run", "i", F.explode(F.transform(ends, lambda n: F.substring(F.col("run"), F.col("i"), n))).alias("w")).join(words, "w")
    long = words.where(F.length("w") > STRETCH).select("n", F.col("w").alias("whole"), F.substring("w", 1, STRETCH).alias("w"))
    first = at.where(F.length("run") - F.col("i") + 1 > STRETCH).select("run", "i", F.substring(F.col("run"), F.col("i"), F.lit(STRETCH)).alias("w"))
    both = first.join(long, "w").where(F.substring(F.col("run"), F.col("i"), F.length("whole")) == F.col("whole"))
    found = short.select("run", "i", F.length("w").alias("size"), "n").union(both.select("run", "i", F.length("whole").alias("size"), "n"))
    held = found.groupBy("run").agg(F.collect_list(F.struct((F.col("i") - 1).alias("i"), "size", "n")).alias("held"))
    total = math.log(size + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [best_split(x, [(y["i"], y["size"], y["n"]) for y in known or ()], total) for x, known in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], ["run", "words"])

    return runs.join(held, "run", "left").select("run", "held").mapInArrow(frugal(run), "run string, words array<string>")


def string_tokens(strings: DataFrame, words: DataFrame) -> DataFrame:
    """(mark, s, token) of distinct strings (mark, s): in lower case runs of a-z segmented, runs with other
    letters (marks on them included) whole; runs of digits become their length.  A token begins with its mark."""
    parts = strings.select("mark", "s", F.explode(F.regexp_extract_all(F.lower("s"), F.lit(r"([\p{L}\p{M}]+|\p{Nd}+)"), F.lit(1))).alias("run"))
    parts = kept(parts.withColumn("plain", F.col("run").rlike("^[a-z]+$")), "url-runs")
    split = kept(split_runs(parts.where("plain").select("run").distinct(), words), "url-splits")
    other = F.when(F.col("run").rlike(r"^\p{Nd}"), F.concat(F.lit("#"), F.length("run").cast("string"))).otherwise(F.col("run"))
    found = parts.where("plain").join(split, "run").select("mark", "s", F.explode("words").alias("t")).union(parts.where("not plain").select("mark", "s", other))
    return found.select("mark", "s", F.concat("mark", "t").alias("token"))


def judge(urls: DataFrame, words: DataFrame) -> DataFrame:
    """``urls`` (page_id, host, path, rule, verdict) with every verdict given, and ``p_block``.

    words: a ``lexicon``.  A rule's verdict stands.  Otherwise ``block`` if the posterior exceeds one half;
    with no decided rows to learn from everything else is allowed with ``p_block`` 0.  Rows are judged one
    by one: repeated rows repeat and count in learning as often; other columns are not carried.
    """
    rows = urls.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule", "verdict")
    sides = F.explode(F.array(F.struct(F.lit("h:").alias("mark"), F.col("host").alias("s")), F.struct(F.lit("p:").alias("mark"), F.col("path").alias("s")))).alias("x")
    said = lambda v: F.count_if(F.col("verdict") == v)
    strings = kept(rows.select("verdict", sides).groupBy("x.mark", "x.s").agg(said("allow").alias("allow"), said("block").alias("block")), "url-strings")
    tokens = kept(string_tokens(strings.select("mark", "s"), words), "url-tokens")
    model = kept(tokens.join(strings, ["mark", "s"]).groupBy("token").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")), "url-model")
    known = model.where("allow + block > 0").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"), F.count("*").alias("n")).first()
    n = rows.agg(said("allow").alias("allow"), said("block").alias("block")).first()
    size = max(1, known["n"])
    each = lambda v: F.log((F.col(v) + 1) / F.lit(float((known[v] or 0) + size)))
    lifts = tokens.join(model.select("token", (each("block") - each("allow")).alias("lift")), "token").groupBy("mark", "s").agg(F.sum("lift").alias("lift"))
    side = lambda mark, name: lifts.where(F.col("mark") == mark).select(F.col("s").alias(name), F.col("lift").alias("_" + name))
    j = rows.join(side("h:", "host"), "host", "left").join(side("p:", "path"), "path", "left")
    prior = math.log(((n["block"] or 0) + 1) / ((n["allow"] or 0) + 1))
    odds = F.round(F.lit(prior) + F.coalesce("_host", F.lit(0.0)) + F.coalesce("_path", F.lit(0.0)), 9)  # sums come in any order
    learned = (n["block"] or 0) + (n["allow"] or 0) > 0
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), odds)))) if learned else F.lit(0.0)
    verdict = F.coalesce("verdict", F.when(p > 0.5, "block").otherwise("allow"))
    return j.select("page_id", "host", "path", "rule", verdict.alias("verdict"), p.alias("p_block"))
