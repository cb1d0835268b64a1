"""Queries over reports: orders, exact ranks, policies, and Python's own parser as an oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon import languages
from quillon.functions import scalars
from quillon.operators import reports
from quillon.plans.registry import query
from quillon.plans.registry import table as _t

_DELTA = "(n_chars * 37) % 4001 - 2000"


@query(f"with d as (select doc_id, {_DELTA} as delta from documents) select doc_id, delta from d order by abs(delta) desc, doc_id limit 10")
def worst_errors(spark, d):
    """Offsets furthest from the oracle's, ties in manifest order."""
    rows = _t(spark, d, "documents").select("doc_id", F.expr(_DELTA).alias("delta"))
    return reports.furthest(rows, "delta", ["doc_id"])


@query("""with e as (select doc_id, source as path, quality = 1 as dirty from documents left join labels using (doc_id) where doc_id % 3 = 0) select doc_id, path, coalesce(dirty, true) as dirty from e order by coalesce(dirty, true), path, doc_id limit 20""")
def divergence_examples(spark, d):
    """Divergences on clean texts first."""
    rows = _t(spark, d, "documents").where("doc_id % 3 = 0").join(_t(spark, d, "labels"), "doc_id", "left").select("doc_id", F.col("source").alias("path"), F.coalesce(F.col("quality") == 1, F.lit(True)).alias("dirty"))
    return rows.orderBy("dirty", "path", "doc_id").limit(20)


@query("""with m as (select doc_id, case when doc_id % 4 = 0 then 'MISSING ' || source else '' end as miss, list_slice(['a', 'b', 'c', 'd', 'e', 'f'], 1, cast(doc_id % 7 as int)) as kinds, coalesce(text, '') as text from documents)
  select doc_id, case when doc_id % 5 = 0 then '<root>' else 'p' end || ' > ' || case when miss <> '' then miss when len(kinds) > 0 then 'ERROR(' || array_to_string(list_slice(kinds, 1, 4), ' ') || case when len(kinds) >= 4 then ' …' else '' end || ')' else 'ERROR ''' || left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 20) || '''' end as signature from m""")
def error_signatures(spark, d):
    """Signatures of missing nodes, of errors with children, and of leaves; the root has no parent."""
    kinds = F.slice(F.array(*map(F.lit, "abcdef")), F.lit(1), (F.col("doc_id") % 7).cast("int"))
    s = scalars.signature(F.when(F.col("doc_id") % 5 != 0, "p"), F.when(F.col("doc_id") % 4 == 0, F.col("source")), kinds, F.coalesce("text", F.lit("")))
    return _t(spark, d, "documents").select("doc_id", s.alias("signature"))


@query("""with f as (select doc_id, source as signature, quality = 1 as valid, toxic = 1 as current, doc_id % 5 = 0 as config from documents join labels using (doc_id)), l as (select *, case when valid and config then 'config' when valid and signature in ('src1', 'src2') and not current then 'version' when valid then 'gap' else 'noise' end as label from f)
  select signature, count(*) as count, count(*) filter (label = 'gap') as gap, count(*) filter (label = 'version') as version, count(*) filter (label = 'config') as config, case when count(*) filter (label = 'gap') > 0 then 'gap' when count(*) filter (label = 'version') > 0 then 'version' when count(*) filter (label = 'config') > 0 then 'config' else 'noise' end as verdict from l group by signature""")
def policy_labels(spark, d):
    """Valid failures by what explains them: a configuration, a declared version, or nothing."""
    f = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id").select(F.col("source").alias("signature"), (F.col("quality") == 1).alias("valid"), (F.col("toxic") == 1).alias("current"), (F.col("doc_id") % 5 == 0).alias("config"))
    declared = spark.createDataFrame([("src1",), ("src2",)], "signature string")
    return reports.labelled(f, declared)


_PROGRAMS = ["x = 1\n", "def f(:\n", "for i in y:\n    pass\n", "return 1\n", "print('a'\n", "class A: pass\n", "", "x = = 2\n", "lambda: (yield)\n", "if x:\nreturn\n"]


@query("""select doc_id, list_contains([0, 2, 5, 6, 8], cast(doc_id % 10 as int)) as valid, list_contains([0, 2, 3, 5, 6, 8], cast(doc_id % 10 as int)) as syntax from documents""")
def python_oracle(spark, d):
    """Programs judged by Python's parser and compiler, and by the parser alone."""
    text = F.element_at(F.array(*map(F.lit, _PROGRAMS)), (F.col("doc_id") % 10 + 1).cast("int"))
    rows = _t(spark, d, "documents").select("doc_id", F.encode(text, "UTF-8").alias("content"))
    return languages.judged(rows, "python").select("doc_id", "valid", "syntax")


@query("""with p as (select doc_id % 10 as k, count(*) as n from documents group by 1) select cast(sum(n) filter (k in (0, 2, 3, 5, 6, 8)) as bigint) as rendered, cast(sum(n) filter (k in (0, 2, 3, 5, 6, 8)) as bigint) as reparsed, cast(sum(n) filter (k not in (0, 2, 3, 5, 6, 8)) as bigint) as skipped, count(*) filter (k not in (0, 2, 3, 5, 6, 8)) as programs from p""")
def roundtrip_python(spark, d):
    """Programs printed from their trees and read again."""
    text = F.element_at(F.array(*map(F.lit, _PROGRAMS)), (F.col("doc_id") % 10 + 1).cast("int"))
    r = languages.roundtrip(_t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), text.alias("text")), "python")
    programs = F.countDistinct(F.when(F.col("skipped").isNotNull(), F.col("path").cast("long") % 10))
    return r.agg(F.count("rendered").alias("rendered"), F.count_if("reparsed").alias("reparsed"), F.count("skipped").alias("skipped"), programs.alias("programs"))


@query("""with a as (select doc_id, quality = 1 as v from labels), b as (select doc_id, toxic = 0 as v from labels where quality = 0) select a.doc_id, a.v or coalesce(b.v, false) as valid from a left join b using (doc_id)""")
def version_union(spark, d):
    """Two version oracles: the second is asked about the first's rejects only."""
    labels = _t(spark, d, "labels")
    first = labels.select("doc_id", (F.col("quality") == 1).alias("valid"))
    return languages.union_valid(first, lambda rest: rest.join(labels, "doc_id").select("doc_id", (F.col("toxic") == 0).alias("valid")), "doc_id")
