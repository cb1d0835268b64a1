"""Queries over grammars: lint metrics, choice sites, declared programs, coverage."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quillon.functions import scalars
from quillon.operators import grammars, reports
from quillon.plans.registry import query
from quillon.plans.registry import table as _t


def _s(x):
    return {"type": "SYMBOL", "name": x}


def _l(x):
    return {"type": "STRING", "value": x}


def _of(kind, *members):
    return {"type": kind, "members": list(members)} if kind in ("SEQ", "CHOICE") else {"type": kind, "content": members[0]}


TOY = json.dumps({
    "name": "toy", "word": "identifier",
    "rules": {
        "program": _of("REPEAT1", _s("_statement")), "_statement": _of("CHOICE", _s("if_statement"), _s("call"), _s("block")),
        "if_statement": _of("SEQ", _l("if"), _of("FIELD", _s("_expression")), _s("_statement"), _of("CHOICE", _of("SEQ", _l("else"), _s("_statement")), {"type": "BLANK"})),
        "call": _of("SEQ", _s("identifier"), _of("IMMEDIATE_TOKEN", _l("(")), _of("CHOICE", _s("_expression"), {"type": "BLANK"}), _l(")"), _l(";")), "block": _of("SEQ", _l("("), _of("REPEAT", _s("_statement")), _l(")")),
        "_expression": _of("CHOICE", _s("identifier"), _s("number"), _s("binary")), "binary": _of("PREC_DYNAMIC", _of("SEQ", _s("_expression"), _of("CHOICE", _l("and"), _l("+")), _s("_expression"))),
        "identifier": {"type": "PATTERN", "value": "[a-z]\\w*"}, "number": {"type": "PATTERN", "value": "\\d+"},
    },
    "conflicts": [["_expression", "call"], ["call", "block"]], "supertypes": ["_statement", "_expression"], "reserved": {"global": [_l("if")], "none": []}, "externals": [_s("_newline"), _s("_indent")],
})
PLAIN = json.dumps({"name": "plain", "rules": {"list": _of("SEQ", _l("list"), _of("REPEAT", _of("CHOICE", _l("a"), _l("b"), _l("if")))), "tail": _of("PREC_DYNAMIC", _of("PREC_DYNAMIC", _l("z")))}, "conflicts": []})
_SCANNER = "#include <x.h>\\nenum TokenType {\\n  NEWLINE,\\n  INDENT,\\n  // old\\n};\\n#define STATE_COUNT 0\\n"
_G = f"g(grammar, j) as (values ('toy', '{TOY}'::json), ('plain', '{PLAIN}'::json)), tr as (select grammar, x.value as v, x.path as path, x.fullkey as k from g, json_tree(j->'rules') x where x.type = 'OBJECT' and x.value->>'type' is not null)"


def _grammars(spark):
    return spark.createDataFrame([("toy", TOY), ("plain", PLAIN)], "grammar string, json string")


_BASE = [("toy", "conflicts", 1), ("toy", "dynamic", 1), ("plain", "dynamic", 5)]


@query(f"""with {_G}, st as (select t.grammar, t.v->>'value' as value, exists (select 1 from tr i where i.grammar = t.grammar and i.v->>'type' = 'IMMEDIATE_TOKEN' and starts_with(t.k, i.k) and t.k <> i.k) as imm from tr t where t.v->>'type' = 'STRING'),
  cf as (select grammar, c.value as c, j from g, json_each(j->'conflicts') c), rs as (select grammar, w.value->>'value' as value from g, json_each(j->'reserved') s, json_each(s.value) w),
  m as (select grammar, 'conflicts' as metric, (select count(*) from cf where cf.grammar = g.grammar) as value from g union all select grammar, 'early_commits', (select count(*) from cf where cf.grammar = g.grammar and exists (select 1 from json_each(cf.c) a, json_each(cf.j->'supertypes') b where a.value = b.value)) from g
    union all select grammar, 'dynamic', (select count(*) from tr where tr.grammar = g.grammar and v->>'type' = 'PREC_DYNAMIC') from g union all select grammar, 'same_text', (select count(*) from (select value from st where st.grammar = g.grammar and imm intersect select value from st where st.grammar = g.grammar and not imm)) from g
    union all select grammar, 'unreserved', case when j->>'word' is null then 0 else (select count(distinct value) from st where st.grammar = g.grammar and regexp_matches(value, '^[a-z_][A-Za-z0-9_]+$') and value not in (select value from rs where rs.grammar = g.grammar)) end from g),
  b(grammar, metric, baseline) as (values ('toy', 'conflicts', 1), ('toy', 'dynamic', 1), ('plain', 'dynamic', 5))
  select grammar, metric, value, baseline, case when baseline is null then 'advisory' when value > baseline then 'fail' when value < baseline then 'remind' else 'ok' end as state from m left join b using (grammar, metric)""")
def lint_metrics(spark, d):
    """Grammar debt against its baselines."""
    base = spark.createDataFrame(_BASE, "grammar string, metric string, baseline int")
    return reports.ratchet(grammars.metrics(_grammars(spark)), base, ["grammar", "metric"])


@query(f"with {_G} select grammar, split_part(replace(k, '\"', ''), '.', 2) as rule, count(*) as sites, cast(sum(json_array_length(v->'members')) as bigint) as alternatives from tr where v->>'type' = 'CHOICE' group by 1, 2")
def grammar_sites(spark, d):
    return grammars.choice_sites(grammars.rule_rows(_grammars(spark))).groupBy("grammar", "rule").agg(F.count("*").alias("sites"), F.sum("arity").alias("alternatives"))


@query("""with s as (select doc_id, '#include <x.h>' || chr(10) || 'enum TokenType {' || chr(10) || repeat('  T,' || chr(10), cast(doc_id % 5 as int)) || '  LAST' || chr(10) || '};' || chr(10) || '#define STATE_COUNT ' || n_chars || chr(10) as src from documents),
  e as (select doc_id, src, list_filter(list_transform(string_split(regexp_extract(src, 'enum [^{]*\\{([^}]*)\\}', 1), ','), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '' and not starts_with(x, '//')) as names from s)
  select doc_id, len(names) as names, len(names) <> 3 as drift, cast(regexp_extract(src, '#define STATE_COUNT ([0-9]+)', 1) as bigint) as states from e""")
def scanner_census(spark, d):
    """Names of a scanner's enum against three externals, and a parser's state count."""
    head = F.concat(F.lit("#include <x.h>\nenum TokenType {\n"), F.repeat(F.lit("  T,\n"), (F.col("doc_id") % 5).cast("int")), F.lit("  LAST\n};\n#define STATE_COUNT "), F.col("n_chars").cast("string"), F.lit("\n"))
    rows = _t(spark, d, "documents").select("doc_id", head.alias("src"))
    names = F.size(grammars.scanner_names(F.col("src"))).cast("long")
    return rows.select("doc_id", names.alias("names"), (names != 3).alias("drift"), grammars.state_count(F.col("src")).alias("states"))


_POLICY = [(0, "the ", "articles"), (1, "th", "digraph"), (2, "a", "vowel"), (3, "au", "never first")]


@query("""with p(ord, starts_with, why) as (values (0, 'the ', 'articles'), (1, 'th', 'digraph'), (2, 'a', 'vowel'), (3, 'au', 'never first')), n as (select lower(substr(text, 1, 6)) as program, count(*) as seeds from documents where text is not null group by 1)
  select program, strlen(program) as bytes, seeds, (select arg_min(why, ord) from p where starts_with(n.program, p.starts_with)) as declared from n""")
def fuzz_findings(spark, d):
    """Distinct programs with their seeds and the first declaration that starts them."""
    bad = _t(spark, d, "documents").where("text is not null").select(F.lower(F.substring("text", 1, 6)).alias("program"))
    return grammars.findings(bad, spark.createDataFrame(_POLICY, "ord int, starts_with string, why string")).withColumn("bytes", F.col("bytes").cast("long"))


@query("""with s as (select distinct p_size as site, p_type as rule, 7 as arity from part), t as (select p_size as site, p_partkey % 7 as alternative from part where p_partkey % 3 = 0), h as (select count(*) as covered from (select distinct site, alternative from t)), a as (select sum(arity) as alternatives from s)
  select cast(alternatives as bigint) as alternatives, covered, cast(floor(covered * 1000 / cast(greatest(alternatives, 1) as double) + 0.5) as bigint) as tenths from a, h""")
def fuzz_coverage(spark, d):
    p = _t(spark, d, "part")
    sites = p.select(F.col("p_size").alias("site"), F.col("p_type").alias("rule"), F.lit(7).alias("arity")).distinct()
    return grammars.coverage(sites, p.where("p_partkey % 3 = 0").select(F.col("p_size").alias("site"), (F.col("p_partkey") % 7).alias("alternative")))


@query("""with s as (select p_size as site, min(p_type) as rule from part group by 1), t as (select p_size as site, count(distinct p_partkey % 7) as n from part where p_partkey % 3 = 0 group by 1), m as (select rule, 7 - coalesce(n, 0) as missing from s left join t using (site))
  select rule, cast(sum(missing) as bigint) as missing from m group by rule having sum(missing) > 0 order by missing desc, rule limit 20""")
def fuzz_uncovered(spark, d):
    p = _t(spark, d, "part")
    sites = p.groupBy(F.col("p_size").alias("site")).agg(F.min("p_type").alias("rule")).withColumn("arity", F.lit(7))
    return grammars.uncovered(sites, p.where("p_partkey % 3 = 0").select(F.col("p_size").alias("site"), (F.col("p_partkey") % 7).alias("alternative")))


@query()
def fuzz_campaign(spark, d):
    """Programs of the toy grammar over three rounds of tapes, how often each came, and whether its brackets
    balance (a stand-in for the oracle)."""
    rows, _ = grammars.campaign(spark, TOY, 3, 60, rare={"binary"})
    balanced = F.length(F.regexp_replace("program", "[^(]", "")) == F.length(F.regexp_replace("program", "[^)]", ""))
    return rows.groupBy("program").agg(F.count("*").alias("seeds")).withColumn("balanced", balanced)


@query(f"select doc_id, 'program' as start, coalesce(nullif(regexp_replace(trim(regexp_extract(coalesce(text, ''), '^([^`\\n]*)', 1)), ':$', ''), ''), '') as head from documents where false union all select doc_id, 'program', left(regexp_replace(trim(regexp_extract(coalesce(text, ''), '^([^`\\n]*)', 1)), ':$', ''), 80) from documents")
def skip_kinds(spark, d):
    """A message's class, and the first rule of a grammar as written."""
    return _t(spark, d, "documents").select("doc_id", scalars.first_key(F.lit(TOY)).alias("start"), scalars.skip_kind(F.coalesce("text", F.lit(""))).alias("head"))
