"""Registered queries over the reference workloads and the SQL they are compared with.

Where the driver's tables have no counterpart, stand-ins are used: documents are files, their
source the package, a symbol or digit the parse error, quality the union verdict and toxic the
current one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import paths, scalars
from quillon.operators import reports, rules
from quillon.plans.registry import ORACLE, QUERIES, query
from quillon.plans.registry import table as _t
from quillon.runtime import written
from quillon.sources import sinks

BAD = "[^0-9#@%*|=<>{}]"
FAIL_SQL = f"""f as (select doc_id, source, lang, text, regexp_extract(text, '^({BAD}*)[0-9#@%*|=<>{{}}]', 1) as prefix,
  substr(text, length(regexp_extract(text, '^({BAD}*)[0-9#@%*|=<>{{}}]', 1)) + 1, 1) as bad
  from documents where regexp_matches(text, '[0-9#@%*|=<>{{}}]'))"""


def failures(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a first error: its prefix and character."""
    docs = _t(spark, d, "documents").where(F.col("text").rlike("[0-9#@%*|=<>{}]"))
    prefix = F.regexp_extract("text", f"^({BAD}*)[0-9#@%*|=<>{{}}]", 1)
    return docs.select("doc_id", "source", "lang", "text", prefix.alias("prefix")).withColumn("bad", F.expr("substring(text, length(prefix) + 1, 1)"))


@query("select doc_id, source || '-' || coalesce(lang, '') as pkgdir, sha256(text) as sha256, cast(strlen(text) as bigint) as bytes from documents")
def manifest_flatten(spark, d):
    return _t(spark, d, "documents").select("doc_id", paths.pkg_dir(F.col("source"), F.coalesce("lang", F.lit(""))).alias("pkgdir"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


@query("select source, count(*) as files, cast(sum(strlen(text)) as bigint) as bytes from documents group by source")
def package_totals(spark, d):
    return _t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))


@query("""with c as (select l_partkey as k, count(*) as n from lineitem group by 1), r as (select k, n, row_number() over (order by n desc, k) as rank from c order by n desc, k limit 200)
  select cast(rank as bigint) as rank, k, n from r join part on k = p_partkey where k % 3 <> 0""")
def rank_with_holes(spark, d):
    top = _t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(200)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "k")).cast("long"))
    return _t(spark, d, "part").select("p_partkey").join(F.broadcast(ranked), F.col("p_partkey") == F.col("k")).where("k % 3 <> 0").select("rank", "k", "n")


@query("""with c as (select o_custkey as k, count(*) as n from orders group by 1), t as (select k, n from c where k % 3 <> 0 order by n desc, k limit 200)
  select cast(row_number() over (order by n desc, k) as bigint) as rank, k, n from t""")
def rank_dense(spark, d):
    top = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n")).where("k % 3 <> 0").orderBy(F.desc("n"), "k").limit(200)
    return top.select(F.row_number().over(Window.orderBy(F.desc("n"), "k")).cast("long").alias("rank"), "k", "n")


@query("""select source, case when coalesce(c,0) >= 2000 and coalesce(c,0) >= coalesce(p,0) then 'c' when coalesce(p,0) >= 2000 and coalesce(p,0) > coalesce(c,0) then 'cpp' when coalesce(s,0) >= 500 then 'bash' end as language
  from (select source, sum(n_chars) filter (lang = 'en') / 100 as c, sum(n_chars) filter (lang = 'fr') / 100 as p, sum(n_chars) filter (lang = 'de') / 100 as s from documents group by source)""")
def sloc_partition(spark, d):
    per = lambda x: F.sum(F.when(F.col("lang") == x, F.col("n_chars"))) / 100
    g = _t(spark, d, "documents").groupBy("source").agg(per("en").alias("c"), per("fr").alias("p"), per("de").alias("s"))
    return g.select("source", paths.sloc_language(F.col("c"), F.col("p"), F.col("s")).alias("language"))


@query("select sha256(text) as sha256, min(doc_id) as doc_id, count(*) as n from documents group by 1")
def dedup_keep_first(spark, d):
    return _t(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


_VERSION_SQL = "p_partkey % 7 || '.' || p_partkey % 11 || case p_partkey % 5 when 0 then 'rc' || p_partkey % 3 when 1 then '' when 2 then '-' || p_partkey % 13 when 3 then '.' || repeat('9', cast(p_partkey % 23 as int)) else 'v' end"


@query(f"""with v as (select p_partkey % 50 as g, {_VERSION_SQL} as v from part), k as (select g, v, list_transform(regexp_extract_all(v, '[0-9]+|[^0-9]+'), lambda p: {{'n': case when regexp_matches(p, '^[0-9]') then case when try_cast(p as hugeint) < 18446744073709551616 then try_cast(p as hugeint) else 0 end else 0 end, 't': case when regexp_matches(p, '^[0-9]') then '' else p end}}) as k from v)
  select g, max(v) as newest from (select g, v, rank() over (partition by g order by k desc) as r from k) where r = 1 group by g""")
def version_newest(spark, d):
    """Newest version of each group: runs of digits as numbers, letters as 0."""
    p = lambda n: (F.col("p_partkey") % n).cast("string")
    end = (
        F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("rc"), p(3))).when(F.col("p_partkey") % 5 == 1, "").when(F.col("p_partkey") % 5 == 2, F.concat(F.lit("-"), p(13)))
        .when(F.col("p_partkey") % 5 == 3, F.concat(F.lit("."), F.repeat(F.lit("9"), (F.col("p_partkey") % 23).cast("int")))).otherwise("v")
    )
    v = _t(spark, d, "part").select((F.col("p_partkey") % 50).alias("g"), F.concat(p(7), F.lit("."), p(11), end).alias("v"))
    return v.groupBy("g").agg(F.max_by("v", F.struct(paths.version_key(F.col("v")), "v")).alias("newest"))


#: Paths for the classification queries, dealt to documents by their id.
PATHS = (
    "src/lib.rs a/_vendor/x.py a/b.py tool/gem.gemspec vendor/x.rb lib/vendor/y.rb Gemfile Gemfile.lock config.ru app.min.js app.mjs x.min.cjs "
    "view.tsx mod.cts A.java bin/run .bashrc x.ebuild inc/a.h inc/a.hpp a.c++ a.tcc build.zig build.zig.zon .simplecov notes.txt a.b/c dir.py/readme x. .py"
).split()
_PATH_SQL = f"list_extract([{', '.join(repr(p) for p in PATHS)}], cast(1 + doc_id % {len(PATHS)} as int))"


def _any(words):
    return ", ".join(f"'{w}'" for w in words)


def _takes_sql(x: str) -> str:
    out = f"e in ({_any(paths.EXTENSIONS[x])})"
    if x in paths.FILE_NAMES:
        out = f"({out} or f in ({_any(paths.FILE_NAMES[x])}))"
    if x == "bash":
        out = f"({out} or not regexp_matches(f, '^.+\\.'))"
    if x in paths.LEFT_OUT:
        out += f" and len(list_intersect(string_split(p, '/'), [{_any(paths.LEFT_OUT[x])}])) = 0"
    return out + (" and not regexp_matches(p, '\\.min\\.(js|mjs|cjs)$')" if x == "javascript" else "")


@query(f"""with a as (select doc_id, {_PATH_SQL} as p from documents), b as (select doc_id, p, list_extract(string_split(p, '/'), -1) as f from a), c as (select *, regexp_extract(f, '^.+\\.([^.]*)$', 1) as e from b)
  select doc_id, concat_ws(',', {", ".join(f"case when {_takes_sql(x)} then '{x}' end" for x in paths.EXTENSIONS)}) as languages, case when e = 'tsx' then 'tsx' end as dialect from c""")
def classify_paths(spark, d):
    path = F.element_at(F.array(*map(F.lit, PATHS)), (F.col("doc_id") % len(PATHS) + 1).cast("int"))
    rows = _t(spark, d, "documents").select("doc_id", path.alias("p"))
    return rows.select("doc_id", F.array_join(paths.languages_of(F.col("p")), ",").alias("languages"), paths.dialect(F.col("p"), "typescript").alias("dialect"))


_HEADS = ["#!/bin/bash", "#! /bin/sh -e", "#!/usr/bin/env -S bash -x", "#!/usr/bin/env zsh", "#!/bin/ksh", "#!/usr/bin/perl", "echo hi", ""]
_TAGS = ["", "{% set x %}", "{%- from 'a' import b %}", "{%setopt%}", "{% comment %}", "{{% if x %}}", "{%endset%}", "{% autoescape off %}", "{% unless x %}"]
_SHELL_SQL = f"""a as (select doc_id, list_extract(['x.sh', 'bin/run', '.bashrc', 'README', 'gen.py', 'a.ebuild'], cast(1 + doc_id % 6 as int)) as p, list_extract([{_any(_HEADS)}], cast(1 + doc_id % 8 as int)) || chr(10) || list_extract([{", ".join("'" + t.replace("'", "''") + "'" for t in _TAGS)}], cast(1 + doc_id % 9 as int)) || chr(10) || coalesce(text, '') as t from documents),
  b as (select *, list_extract(string_split(p, '/'), -1) as f, string_split(regexp_replace(list_extract(string_split(t, chr(10)), 1), '^#![ ]*', '#!'), ' ') as w from a),
  c as (select *, regexp_extract(list_extract(w, 1), '([^/]*)$', 1) as prog, starts_with(list_extract(w, 1), '#!') as bang, list_extract(list_filter(list_slice(w, 2, 99), lambda x: not starts_with(x, '-')), 1) as run from b)"""


@query(f"""with {_SHELL_SQL} select doc_id, regexp_matches(t, '\\{{%-?[ \t\r\n]*({"|".join(paths.TEMPLATE_WORDS)})([^A-Za-z0-9_]|$)') as template,
  not regexp_matches(t, '\\{{%-?[ \t\r\n]*({"|".join(paths.TEMPLATE_WORDS)})([^A-Za-z0-9_]|$)') and case when bang then case when prog = 'env' then run else prog end in ('sh', 'bash', 'dash') else f in ('.bashrc', '.bash_profile') or regexp_extract(f, '^.+\\.([^.]*)$', 1) in ('sh', 'bash', 'ebuild', 'eclass') end as shell from c""")
def admit_filter(spark, d):
    """Shell files by first line, name and extension, templates left out."""
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % n + 1).cast("int"))
    text = F.concat_ws("\n", pick(_HEADS, 8), pick(_TAGS, 9), F.coalesce("text", F.lit("")))
    rows = _t(spark, d, "documents").select("doc_id", pick(["x.sh", "bin/run", ".bashrc", "README", "gen.py", "a.ebuild"], 6).alias("p"), text.alias("t"))
    return rows.select("doc_id", paths.is_template(F.col("t")).alias("template"), paths.is_shell(F.col("p"), F.col("t")).alias("shell"))


@query("""with a as (select cast(doc_id as varchar) as path, sha256(text) as a from documents), b as (select cast(doc_id + (case when doc_id % 13 = 0 then 1000000 else 0 end) as varchar) as path, case when doc_id % 7 = 0 then 'x' else sha256(text) end as b from documents)
  select path, case when b is null then 'missing' when a is null then 'extra' else 'changed' end as state from a full outer join b using (path) where a is distinct from b""")
def lock_diff(spark, d):
    docs = _t(spark, d, "documents").withColumn("sha256", F.sha2("text", 256))
    ours = docs.select(F.col("doc_id").cast("string").alias("path"), "sha256")
    theirs = docs.select((F.col("doc_id") + F.when(F.col("doc_id") % 13 == 0, 1000000).otherwise(0)).cast("string").alias("path"), F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("sha256")).alias("sha256"))
    return reports.lock_diff(ours, theirs)


@query("select source, count(*) as files, count(*) - count(distinct sha256(text)) as duplicates, count(*) filter (strlen(text) = 0) as empty from documents group by source")
def lock_validate(spark, d):
    docs = _t(spark, d, "documents").withColumn("sha", F.sha2("text", 256))
    return docs.where(paths.is_sha256(F.col("sha"))).groupBy("source").agg(F.count("*").alias("files"), (F.count("*") - F.countDistinct("sha")).alias("duplicates"), F.count_if(F.octet_length("text") == 0).alias("empty"))


@query("""with p as (select distinct sha256(text) as s from documents where doc_id % 2 = 0) select sha256(text) in (select s from p) as skipped, count(*) as n from documents group by 1""")
def cache_split(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    skipped, work = reports.cached_split(docs, docs.where("doc_id % 2 = 0").select("sha256").distinct())
    return skipped.withColumn("skipped", F.lit(True)).union(work.withColumn("skipped", F.lit(False))).groupBy("skipped").agg(F.count("*").alias("n"))


@query(f"with {FAIL_SQL} select doc_id, cast(strlen(prefix) as bigint) as start_byte, cast(1 + length(prefix) - length(replace(prefix, chr(10), '')) as bigint) as line, 'line > ERROR ''' || bad || '''' as signature from f")
def first_error(spark, d):
    f = failures(spark, d)
    return f.select("doc_id", F.octet_length("prefix").cast("long").alias("start_byte"), scalars.line_of(F.col("prefix")).cast("long").alias("line"), scalars.signature(F.lit("line"), F.lit(None), F.array(), F.col("bad")).alias("signature"))


@query(f"with {FAIL_SQL} select count(*) as failing, count(*) filter (quality is null) as unanswered, count(*) filter (quality = 1) as valid from f left join labels using (doc_id)")
def verdict_missing(spark, d):
    v = _t(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("valid"))
    j = reports.with_verdicts(failures(spark, d), v, "doc_id")
    return j.agg(F.count("*").alias("failing"), F.count_if("unanswered").alias("unanswered"), F.count_if("valid").alias("valid"))


_LABEL_SQL = "case when quality = 1 and toxic = 0 then 'gap' when quality = 1 then 'version' else 'noise' end"


@query(f"""with {FAIL_SQL}, j as (select 'line > ERROR ''' || bad || '''' as signature, doc_id, quality, {_LABEL_SQL} as label from f left join labels using (doc_id)),
  r as (select *, row_number() over (partition by signature order by doc_id) as r from j)
  select signature, count(*) as count, count(*) filter (quality = 1) as valid, case when count(*) filter (label = 'gap') > 0 then 'gap' when count(*) filter (label = 'version') > 0 then 'version' else 'noise' end as verdict,
  string_agg(cast(doc_id as varchar), ',' order by doc_id) filter (r <= 5) as examples from r group by signature""")
def sweep_clusters(spark, d):
    j = failures(spark, d).join(_t(spark, d, "labels"), "doc_id", "left")
    label = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "gap").when(F.col("quality") == 1, "version").otherwise("noise")
    rows = j.select(scalars.signature(F.lit("line"), F.lit(None), F.array(), F.col("bad")).alias("signature"), label.alias("label"), (F.col("quality") == 1).alias("valid"), F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("path"))
    return reports.clusters(rows)


@query(f"""with {FAIL_SQL}, j as (select {_LABEL_SQL} as label from f left join labels using (doc_id)), t as (select count(*) as files from documents), x as (select count(*) as failed, count(*) filter (label = 'gap') as gap, count(*) filter (label = 'version') as version from j)
  select files, files - failed as passed, failed, gap, version, failed - gap - version as noise, cast(floor((files - failed) * 10000 / greatest(files, 1) + 0.5) as bigint) as pass_rate from t, x""")
def sweep_totals(spark, d):
    c = failures(spark, d).select("doc_id").join(_t(spark, d, "labels"), "doc_id", "left")
    label = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "gap").when(F.col("quality") == 1, "version").otherwise("noise")
    failed = c.select("doc_id", label.alias("label"))
    every = _t(spark, d, "documents").select("doc_id").join(failed, "doc_id", "left")
    g = every.agg(F.count("*").alias("files"), F.count("label").alias("failed"), F.count_if(F.col("label") == "gap").alias("gap"), F.count_if(F.col("label") == "version").alias("version"))
    passed = F.col("files") - F.col("failed")
    return g.select("files", passed.alias("passed"), "failed", "gap", "version", (F.col("failed") - F.col("gap") - F.col("version")).alias("noise"), scalars.per_10000(passed, F.col("files")).alias("pass_rate"))


@query(f"with {FAIL_SQL} select s as signature from (values ('line > ERROR ''#'''), ('line > ERROR ''~'''), ('line > MISSING x')) p(s) where s not in (select 'line > ERROR ''' || bad || '''' from f)")
def stale_policy(spark, d):
    declared = spark.createDataFrame([("line > ERROR '#'",), ("line > ERROR '~'",), ("line > MISSING x",)], "signature string")
    return reports.stale(declared, failures(spark, d).select(scalars.signature(F.lit("line"), F.lit(None), F.array(), F.col("bad")).alias("signature")))


@query(f"with {FAIL_SQL} select doc_id from f join labels using (doc_id) where quality = 0 and toxic = 0")
def hidden_gaps(spark, d):
    return failures(spark, d).select("doc_id").join(_t(spark, d, "labels").where("quality = 0 and toxic = 0"), "doc_id", "left_semi")


@query("select item_id from benchmark where not regexp_matches(text, '[0-9#@%*|=<>{}]')")
def negative_accepted(spark, d):
    return _t(spark, d, "benchmark").where(~F.col("text").rlike("[0-9#@%*|=<>{}]")).select("item_id")


@query("""with recursive s as (select distinct n_name as a, c_mktsegment as b from customer join nation on c_nationkey = n_nationkey where c_custkey % 7 = 0 union select distinct c_mktsegment, o_orderpriority from orders join customer on o_custkey = c_custkey where c_nationkey < 3),
  r(start, reached) as (select distinct x, x from (select a as x from s union all select b from s) union select r.start, s.b from r join s on r.reached = s.a) select * from r""")
def supertype_closure(spark, d):
    """Which names stand for which: nations over segments over priorities, as far as customers link them."""
    c = _t(spark, d, "customer")
    first = c.where("c_custkey % 7 = 0").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("supertype"), F.col("c_mktsegment").alias("subtype"))
    second = _t(spark, d, "orders").join(c.where("c_nationkey < 3"), F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", "o_orderpriority")
    return rules.closure(first.union(second).distinct())


_TIERS = (*rules.TABLE_TERMS, "_thing", "_other")
_FACETS = (*rules.FACET_TERMS, *rules.EITHER_TIER, "_strange")
_DEMOTED = (*rules.EITHER_TIER, "_scope", "_literal")


def _pick(names: tuple[str, ...], number: str) -> str:
    """The name at ``number`` (SQL that both engines read), counted around."""
    return f"case ({number}) % {len(names)} " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(names)) + " end"


_KIND = "concat(lower(c_mktsegment), '_', c_nationkey % 10)"
#: What customers, suppliers and nations say as a grammar's kinds, tiers and roles.
_ROLES = {
    "named": f"select distinct {_KIND} as x from customer where c_custkey % 3 <> 1 union select {_pick(_TIERS, 'n_nationkey')} from nation",
    "subtypes": f"select distinct {_pick(_TIERS, 'c_nationkey')} as supertype, case when c_custkey % 10 = 0 then {_pick(_TIERS, 'c_nationkey * 7 + 6')} else {_KIND} end as subtype from customer where c_custkey % 5 = 0 and c_nationkey < 20",
    "facets": f"select distinct {_pick(_FACETS, 's_nationkey')} as facet, case when s_nationkey % 11 <> 3 then concat('building_', s_suppkey % 12) end as x from supplier",
    "demoted": f"select {_pick(_DEMOTED, 'n_nationkey')} as x, case when n_regionkey = 2 then ' ' else n_name end as why from nation where n_nationkey < 5",
    "uncategorised": "select concat('household_', n_nationkey % 12) as x, case when n_regionkey <> 1 then n_name end as why from nation where n_nationkey < 14",
}
_NOT_IN = lambda what, other: f"not exists (select 1 from {other} o where o.x = {what}.x)"
_NAMES = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"


@query(f"""with recursive {", ".join(f"{k} as ({v})" for k, v in _ROLES.items())}, sup as (select distinct supertype as x from subtypes),
  reach(start, reached) as (select distinct n, n from (select supertype as n from subtypes union select subtype from subtypes) union select r.start, s.subtype from reach r join subtypes s on r.reached = s.supertype),
  covered as (select reached as x from reach where start in (select x from sup) union select x from facets where x is not null),
  keys as (select distinct facet as x from facets), pairs(i, o) as (values {", ".join(f"('{i}', '{o}')" for i, o in rules.CONTAINMENTS)}),
  bad as (select i, o from pairs where i in (select x from sup) and o in (select x from sup) and not exists (select 1 from reach where start = o and reached = i)
    and (not exists (select 1 from reach where start = i and reached <> i) or exists (select 1 from reach a where a.start = i and a.reached <> i and not exists (select 1 from reach b where b.start = o and b.reached = a.reached))))
  select '0' as rule, 'older' as subject
  union all select '1', x from sup where x not in {_NAMES(rules.TABLE_TERMS)}
  union all select '1b-i', x from demoted where x not in {_NAMES(rules.EITHER_TIER)}
  union all select '1b-ii', x from demoted where trim(coalesce(why, '')) = ''
  union all select '1b-iii', x from demoted where x in (select x from sup)
  union all select '1b-iv', x from demoted where {_NOT_IN("demoted", "keys")}
  union all select '5a', x from keys where x not in {_NAMES(rules.FACET_TERMS)} and {_NOT_IN("keys", "demoted")}
  union all select '5b', x from keys where not exists (select 1 from facets f where f.facet = keys.x and f.x is not null)
  union all select '3', x from facets where x is not null and {_NOT_IN("facets", "named")}
  union all select '4', i || '/' || o from bad
  union all select '2a', x from named where {_NOT_IN("named", "sup")} and {_NOT_IN("named", "covered")} and {_NOT_IN("named", "uncategorised")}
  union all select '2b', x from uncategorised where x in (select x from covered)
  union all select '2c', x from uncategorised where {_NOT_IN("uncategorised", "named")}
  union all select '2c', x from uncategorised where trim(coalesce(why, '')) = ''""")
def roles_findings(spark, d):
    """The roles rules over a catalogue of kinds, tiers and roles that the tables make up."""
    tables = {t: _t(spark, d, t) for t in ("customer", "supplier", "nation")}
    said = {}
    for k, v in _ROLES.items():
        own = {t: x for t, x in tables.items() if f"from {t}" in v}
        for t in own:
            v = v.replace(f"from {t}", f"from {{{t}}}")
        said[k] = written(spark.sql(v, **own), k)
    supertypes = said["subtypes"].select(F.col("supertype").alias("x")).distinct()
    return rules.broken("older", said["named"], supertypes, said["subtypes"], said["facets"], said["demoted"], said["uncategorised"])


@query(f"""with {FAIL_SQL}, x as (select cast(strlen(prefix) as bigint) as a, cast(strlen(regexp_extract(text, '^([^0-9|]*)[0-9|]', 1)) as bigint) as b, regexp_matches(text, '[0-9|]') as ok from f), y as (select a - b as delta from x where ok),
  z as (select abs(delta) as v, row_number() over (order by abs(delta)) as r, count(*) over () as n from y)
  select count(*) filter (v = 0) as exact, count(*) filter (v between 1 and 16) as near, count(*) filter (v between 17 and 128) as mid, count(*) filter (v > 128) as far, coalesce(max(v) filter (r = n // 2 + 1), 0) as median, coalesce(max(v) filter (r = cast(floor((n - 1) * 0.9 + 0.5) as bigint) + 1), 0) as p90 from z""")
def error_position_hist(spark, d):
    f = failures(spark, d).where(F.col("text").rlike("[0-9|]"))
    v = f.select(F.abs(F.octet_length("prefix").cast("long") - F.octet_length(F.regexp_extract("text", "^([^0-9|]*)[0-9|]", 1)).cast("long")).alias("v"))
    hist = v.agg(*reports.buckets(F.col("v")))
    median, p90 = (reports.nearest_rank(v, "v", p).withColumnRenamed("value", n) for n, p in (("median", reports.median_place()), ("p90", reports.quantile_place(0.9))))
    one = F.lit(1).alias("_k")
    return hist.select("*", one).join(median.select("*", one), "_k").join(p90.select("*", one), "_k").drop("_k")


@query("""select doc_id, regexp_replace(text, '[ \\t\\n\\f\\r]', '', 'g') = regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '[ \\t\\n\\f\\r]', '', 'g') as same, text <> regexp_replace(text, '\\s+', ' ', 'g') as changed from documents""")
def reformat_invariant(spark, d):
    after = F.regexp_replace("text", r"\s+", " ")
    return _t(spark, d, "documents").select("doc_id", (scalars.squash(F.col("text")) == scalars.squash(after)).alias("same"), (F.col("text") != after).alias("changed"))


@query("""with n as (select count(*) as n from documents), r as (select doc_id, row_number() over (order by source, doc_id) - 1 as i from documents) select doc_id from r, n where i % greatest(1, n // 100) = 0 and i // greatest(1, n // 100) < 100""")
def even_sample(spark, d):
    """Every step-th file in manifest order."""
    r = reports.numbered(_t(spark, d, "documents").select("doc_id", "source"), "source", "doc_id").withColumn("step", F.greatest(F.lit(1), F.floor(F.col("n") / 100)))
    return r.where("i % step = 0 and floor(i / step) < 100").select("doc_id")


@query("""with m as (select source as metric, count(*) as value from documents where n_chars >= 2000 group by 1), b as (select source as metric, count(*) as baseline from documents where n_chars between 1000 and 1999 group by 1)
  select metric, value, baseline, case when baseline is null then 'advisory' when value > baseline then 'fail' when value < baseline then 'remind' else 'ok' end as state from m left join b using (metric)""")
def ratchet_eval(spark, d):
    """Long documents of each source against its medium ones: the count must not be above."""
    docs = _t(spark, d, "documents")
    m = docs.where("n_chars >= 2000").groupBy(F.col("source").alias("metric")).agg(F.count("*").alias("value"))
    return reports.ratchet(m, docs.where("n_chars between 1000 and 1999").groupBy(F.col("source").alias("metric")).agg(F.count("*").alias("baseline")))


@query("""with a as (select conv_id, turn, role from conversations), b as (select conv_id - 1 as conv_id, turn, role from conversations where conv_id > 0), j as (select coalesce(a.conv_id, b.conv_id) as conv_id, coalesce(a.turn, b.turn) as turn, a.role as ours, b.role as theirs
  from a full outer join b on a.conv_id = b.conv_id and a.turn = b.turn) select conv_id, min(turn) as turn from j where ours is distinct from theirs group by conv_id""")
def first_divergence(spark, d):
    """Two sequences zipped by position: the first place at which they differ."""
    c = _t(spark, d, "conversations")
    ours = c.select("conv_id", "turn", F.col("role").alias("ours"))
    theirs = c.where("conv_id > 0").select((F.col("conv_id") - 1).alias("conv_id"), "turn", F.col("role").alias("theirs"))
    return reports.zip_compare(ours.toDF("file_id", "seq", "item"), theirs.toDF("file_id", "seq", "item")).select(F.col("file_id").alias("conv_id"), F.col("seq").alias("turn"))


@query("select doc_id, format('{:,}', n_chars) as grouped, trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')) as line from documents")
def one_line_grouped(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.format_number("n_chars", 0).alias("grouped"), scalars.one_line(F.col("text")).alias("line"))


@query("select case when quality = 1 then 'valid' else 'invalid' end as verdict, count(*) as count from labels group by 1")
def verdict_counts(spark, d):
    return sinks.verdict_counts(_t(spark, d, "labels").select(F.when(F.col("quality") == 1, "valid").otherwise("invalid").alias("verdict")))


from quillon.plans import corpus_queries, grammar_queries, report_queries, tree_queries  # noqa: E402, F401  they register their queries

__all__ = ["ORACLE", "QUERIES"]
