"""Queries over corpora: rankings, resolvers, headers, preprocessing, the registry and its state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon import languages
from quillon.functions import headers, scalars
from quillon.operators import macros, preprocess, reports, status
from quillon.plans.registry import query
from quillon.plans.registry import table as _t
from quillon.runtime import written
from quillon.sources import feeds


@query("""with c as (select l_partkey as id, count(*) as n from lineitem group by 1), t as (select id, row_number() over (order by n desc, id) as rank from c order by n desc, id limit 120)
  select rank, p_name as name, n_name as version from t join part on id = p_partkey join supplier on s_suppkey = id % 15 and id % 4 <> 1 join nation on n_nationkey = s_nationkey where n_regionkey <> 2""")
def crates_chain(spark, d):
    """The most downloaded packages through names, default versions and versions; each may be missing."""
    down = _t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("n"))
    crates = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    s = _t(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("version_id"))
    ids = crates.select("id").where("id % 4 <> 1")
    defaults = ids.join(s, F.col("id") % 15 == F.col("s_suppkey")).select("id", "version_id")
    versions = _t(spark, d, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("version_id"), F.col("n_name").alias("version"))
    return feeds.chained(down, crates, defaults, versions, 120)


@query("""with i as (select o_custkey as c, count(*) as n from orders group by 1), k as (select row_number() over (order by n desc, i.c) as ord, i.c, n from i), s as (select c_nationkey, sum(c_acctbal) as b from customer group by 1)
  select row_number() over (order by ord) as rank, c_name as name, c_mktsegment as version, n as downloads from k join customer on c_custkey = c where c_mktsegment <> 'BUILDING' and c_nationkey in (select c_nationkey from s where b >= 2000) order by ord limit 60""")
def popcon_ranked(spark, d):
    """Installs looked up in a pool and a census, in their order."""
    n = _t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("downloads"))
    c = _t(spark, d, "customer")
    named = n.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.struct(-F.col("downloads"), F.col("o_custkey")).alias("ord"), F.col("c_name").alias("name"), "downloads")
    pool = c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("version"))
    big = c.groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("b")).where("b >= 2000")
    return feeds.looked_up(named, pool, c.join(big, "c_nationkey", "left_semi").select(F.col("c_name").alias("name")), 60)


@query("""with p as (select 1 + doc_id // 10 as page, doc_id % 10 as i, case when doc_id % 7 <> 0 then source || case when doc_id % 5 = 0 then '-' else ':' end || doc_id end as name, case when doc_id % 11 <> 0 then n_chars end as downloads from documents where doc_id // 10 <> 12)
  select row_number() over (order by page, i) as rank, name, downloads from p where page < 13 and name is not null and downloads is not null and contains(name, ':') order by page, i limit 70""")
def feed_pages(spark, d):
    """A paged feed whose thirteenth page is empty; names need a group."""
    docs = _t(spark, d, "documents").where("floor(doc_id / 10) <> 12")
    name = F.when(F.col("doc_id") % 7 != 0, F.concat("source", F.when(F.col("doc_id") % 5 == 0, "-").otherwise(":"), F.col("doc_id").cast("string")))
    pages = docs.select((1 + F.floor(F.col("doc_id") / 10)).alias("page"), (F.col("doc_id") % 10).alias("i"), name.alias("name"), F.when(F.col("doc_id") % 11 != 0, F.col("n_chars")).alias("downloads"))
    return feeds.paged_feed(pages, 70, coordinates=True)


@query("""with s as (select doc_id // 60 as query, 1 + (doc_id % 60) // 5 as page, doc_id % 5 as i, source || '/' || doc_id % 41 as name, n_chars as downloads from documents), k as (select * from s where page <= 10), f as (select *, row_number() over (partition by name order by query, page, i) as r from k),
  dry as (select min(query) as q from (select distinct query from k) a where not exists (select 1 from f where f.query = a.query and f.r = 1)) select row_number() over (order by query, page, i) as rank, name, downloads from f where r = 1 and query < coalesce((select q from dry), 1000000000) order by query, page, i limit 90""")
def search_ranked(spark, d):
    """Repeated searches of ten pages, each name where it comes first."""
    x = F.col("doc_id")
    items = _t(spark, d, "documents").select(F.floor(x / 60).alias("query"), (1 + F.floor((x % 60) / 5)).alias("page"), (x % 5).alias("i"), F.concat_ws("/", "source", (x % 41).cast("string")).alias("name"), F.lit("main").alias("branch"), F.col("n_chars").alias("downloads"))
    return feeds.search_cursor(items, 90)


@query("""with v as (select p_partkey, p_type, replace(p_name, ' ', '-') as n, p_size || '.' || p_partkey % 10 as v, 'org.' || p_type || case when p_partkey % 6 = 0 then '.' else ':' end || replace(p_name, ' ', '.') as c, sha256(p_name) as h from part)
  select p_partkey, 'https://static.crates.io/crates/' || n || '/' || n || '-' || v || '.crate' as crate, case when contains(c, ':') then 'https://repo1.maven.org/maven2/' || replace(split_part(c, ':', 1), '.', '/') || '/' || split_part(c, ':', 2) || '/' || v || '/' || split_part(c, ':', 2) || '-' || v || '-sources.jar' end as jar,
  'https://ziglang.org/download/' || v || '/zig-' || v || '.tar.xz' as zig, left(h, 12) as commit, 'https://codeload.github.com/' || n || '/tar.gz/' || h as archive, 'https://m/pool/' || p_type || '/' || n || '_' || v || '.orig.tar.xz' as pool from v""")
def resolver_urls(spark, d):
    v = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 10).cast("string"))
    n = F.replace("p_name", F.lit(" "), F.lit("-"))
    c = F.concat(F.lit("org."), "p_type", F.when(F.col("p_partkey") % 6 == 0, ".").otherwise(":"), F.replace("p_name", F.lit(" "), F.lit(".")))
    commit = feeds.commit_url(n, F.sha2("p_name", 256))
    return _t(spark, d, "part").select("p_partkey", feeds.crate_url(n, v).alias("crate"), feeds.sources_jar_url(c, v).alias("jar"), feeds.zig_url(v).alias("zig"), commit["version"].alias("commit"), commit["url"].alias("archive"), feeds.pool_url("https://m", F.concat_ws("/", F.lit("pool"), "p_type"), F.concat(n, F.lit("_"), v, F.lit(".orig.tar.xz"))).alias("pool"))


def coded(lines: dict[str, str]):
    """Lines made of a document's sentences: one that begins with one of the letters of ``lines`` becomes that
    line, others stay without signs that mean something in sources."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z. ]", " ")

    def one(x):
        first, out = F.lower(F.substring(F.ltrim(x), 1, 1)), x
        for k, v in lines.items():
            out = F.when(first == k, v).otherwise(out)
        return out

    return F.transform(F.split(text, r"\. "), one)


def coded_sql(lines: dict[str, str]) -> str:
    """The same in SQL."""
    case = " ".join(f"when lower(substr(ltrim(x), 1, 1)) = '{k}' then '{v}'" for k, v in lines.items())
    return f"list_transform(string_split(regexp_replace(coalesce(text, ''), '[^A-Za-z. ]', ' ', 'g'), '. '), lambda x: case {case} else x end)"


_HEADER_LINES = {"a": "#ifdef __cplusplus", "e": "#endif", "d": "class D;", "i": "/* open", "b": "close */", "s": "#if B", "t": "#else", "o": "class E;", "h": "// class F"}


@query(f"""with l as (select doc_id, n_chars, list_transform({coded_sql(_HEADER_LINES)}, lambda x: {{'k': x, 'stack': '', 'inside': false, 'found': false}}) as l from documents),
  f as (select doc_id, n_chars, list_reduce(list_prepend({{'k': '', 'stack': '', 'inside': false, 'found': false}}, l), lambda a, x: {{'k': '',
    'stack': case when a.inside then a.stack when x.k = '#ifdef __cplusplus' then a.stack || 'g' when x.k = '#if B' then a.stack || 'o' when x.k = '#endif' and a.stack <> '' then left(a.stack, length(a.stack) - 1) else a.stack end,
    'inside': case when a.inside then x.k <> 'close */' else x.k = '/* open' end,
    'found': a.found or (not a.inside and x.k in ('class D;', 'class E;') and not contains(a.stack, 'g'))}}) as r from l)
  select doc_id, case when r.found or n_chars % 9 = 4 then 'cpp' else 'c' end as language from f""")
def header_partition(spark, d):
    """Shared headers: unguarded text that only C++ has, or a folder of its name."""
    path = F.when(F.col("n_chars") % 9 == 4, "include/C++/a.h").when(F.col("n_chars") % 9 == 5, "c++lib/a.h").otherwise("include/a.h")
    rows = _t(spark, d, "documents").select("doc_id", path.alias("p"), F.array_join(coded(_HEADER_LINES), "\n").alias("t"))
    return rows.select("doc_id", headers.header_language(F.col("p"), F.col("t")).alias("language"))


_BRANCH_LINES = {"a": "#if defined(__cplusplus) || 0", "b": "#ifdef WIDE", "d": "#if !defined(__cplusplus) && 1", "e": "#else", "i": "#endif", "s": "#define WIDE 1", "t": "#if WIDE", "h": "#if A < B"}
_START = "{'k': '', 'v': '', 'stack': '', 'wide': false, 'seen': '', 'decided': 0, 'undecided': 0}"


@query(rf"""with l as (select doc_id, {coded_sql(_BRANCH_LINES)} as l from documents),
  f as (select doc_id, l, list_reduce(list_prepend({_START}, list_transform(l, lambda x: {{'k': split_part(x, ' ', 1), 'v': x, 'stack': '', 'wide': false, 'seen': '', 'decided': 0, 'undecided': 0}})), lambda a, x: {{'k': '', 'v': '',
    'stack': case when x.k in ('#if', '#ifdef') then a.stack || case when regexp_matches(a.stack, '[nz]') then 'u' when contains(x.v, '||') then 'n' when contains(x.v, '&&') or (a.wide and contains(x.v, 'WIDE')) then 'a' else 'u' end
      when x.k = '#else' and a.stack <> '' then left(a.stack, length(a.stack) - 1) || translate(right(a.stack, 1), 'anz', 'zaz') when x.k = '#endif' and a.stack <> '' then left(a.stack, length(a.stack) - 1) else a.stack end,
    'wide': a.wide or (x.k = '#define' and not regexp_matches(a.stack, '[nz]')),
    'seen': a.seen || cast(cast(case when x.k in ('#else', '#endif') and a.stack <> '' then right(a.stack, 1) = 'u' and not regexp_matches(left(a.stack, length(a.stack) - 1), '[nz]')
      when x.k in ('#if', '#ifdef') then not regexp_matches(a.stack, '[nz]') and not contains(x.v, '||') and not contains(x.v, '&&') and not (a.wide and contains(x.v, 'WIDE')) else not regexp_matches(a.stack, '[nz]') end as int) as varchar),
    'decided': a.decided + case when x.k in ('#if', '#ifdef') and not regexp_matches(a.stack, '[nz]') and (contains(x.v, '||') or contains(x.v, '&&') or (a.wide and contains(x.v, 'WIDE'))) then 1 else 0 end,
    'undecided': a.undecided + case when x.k in ('#if', '#ifdef') and not regexp_matches(a.stack, '[nz]') and not (contains(x.v, '||') or contains(x.v, '&&') or (a.wide and contains(x.v, 'WIDE'))) then 1 else 0 end}}) as r from l)
  select doc_id, sha256(array_to_string(list_transform(l, lambda x, i: case when substr(r.seen, i, 1) = '1' then x else '' end), chr(10))) as reduced, cast(r.decided as int) as decided, cast(r.undecided as int) as undecided from f""")
def branch_reduction(spark, d):
    """Documents as C sources without the branches that cannot be."""
    rows = _t(spark, d, "documents").select("doc_id", F.array_join(coded(_BRANCH_LINES), "\n").alias("text"))
    r = rows.select("doc_id", preprocess.reduced(F.col("text"), "c").alias("r"))
    return r.select("doc_id", F.sha2("r.text", 256).alias("reduced"), "r.decided", "r.undecided")


_LINES = {"a": "#if A", "b": "# ifdef B", "e": "#else", "i": "#endif", "s": "#elif C", "d": "#ifndef D", "t": "  #endif", "o": ""}
_LINE_SQL = f"w as (select doc_id, {coded_sql(_LINES)} as l from documents), k as (select doc_id, unnest(l) as x, generate_subscripts(l, 1) as n from w)"


def _sources(spark, d, lines=None):
    """Documents as sources, many lines directives, not always well nested."""
    return _t(spark, d, "documents").select("doc_id", F.array_join(coded(lines or _LINES), "\n").alias("text"))


def unbalanced(texts):
    """(key, line) of the first line of each text (key, text) at which a brace is open twice or closed once too
    often: stands for a parser's first error."""
    each = texts.select("key", F.posexplode(F.split("text", "\n")).alias("i", "x")).where(F.col("x").rlike("[{}]"))
    level = F.sum(F.length(F.regexp_replace("x", "[^{]", "")) - F.length(F.regexp_replace("x", "[^}]", ""))).over(Window.partitionBy("key").orderBy("i"))
    return each.withColumn("n", level).where("n > 1 or n < 0").groupBy("key").agg((F.min("i") + 1).alias("line"))


@query()
def split_resolution(spark, d):
    """How far forcing branches explains each document's first error, in rounds over all documents."""
    lines = {"a": "#if A", "e": "#else", "i": "#endif", "d": "{", "s": "}"}
    files = _sources(spark, d, lines).select(F.col("doc_id").alias("file_id"), "text")
    return preprocess.resolve_splits(files, unbalanced).withColumnRenamed("file_id", "doc_id")


_REGION_SQL = f"""{_LINE_SQL}, st as (select doc_id, n, regexp_extract(x, '^\\s*#\\s*(\\w*)', 1) as w from k where regexp_matches(x, '^\\s*#\\s*(if|ifdef|ifndef|else|elif|endif)\\b')),
  up as (select *, case when w in ('if', 'ifdef', 'ifndef') then 1 when w = 'endif' then -1 else 0 end as s from st),
  h as (select *, sum(s) over (partition by doc_id order by n) as raw from up), lv as (select *, raw - least(0, min(raw) over (partition by doc_id order by n)) as depth from h),
  o as (select *, case when s = 1 then depth when s = 0 then depth else depth + 1 end as level, s = -1 and raw < coalesce(min(raw) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0) and raw < 0 as stray from lv),
  r as (select a.doc_id, a.n as start, (select min(b.n) from o b where b.doc_id = a.doc_id and b.n > a.n and b.s = -1 and b.level = a.level and not b.stray) as stop, a.level from o a where a.s = 1),
  m as (select r.doc_id, r.start, r.stop, count(*) filter (o.w = 'elif') as elifs, count(*) filter (o.w = 'else') as elses, min(o.n) filter (o.w = 'else') as mid from r left join o on o.doc_id = r.doc_id and o.n > r.start and o.n < r.stop and o.s = 0 and o.level = r.level where r.stop is not null group by 1, 2, 3),
  rg as (select doc_id as file_id, start, mid, stop as "end" from m where elifs = 0 and elses < 2)"""


@query(f"with {_REGION_SQL} select * from rg")
def prep_regions(spark, d):
    return preprocess.region_rows(_sources(spark, d), "doc_id", "text")


@query(f"""with {_REGION_SQL}, pt as (select doc_id as file_id, 5 + doc_id % 30 as line from documents), bs as (select pt.file_id, pt.line, arg_min(rg, (rg."end" - rg.start, rg."end")) as r from pt join rg on rg.file_id = pt.file_id and rg.start <= pt.line and rg."end" >= pt.line group by 1, 2),
  f as (select bs.*, list_transform(w.l, lambda x, i: case when i = r.start or i = r."end" or (r.mid is not null and i = r.mid) or (i > r.start and i < coalesce(r.mid, r."end") and file_id % 2 = 1) or (r.mid is not null and i > r.mid and i < r."end" and file_id % 2 = 0) then '' else x end) as l from bs join w on w.doc_id = bs.file_id)
  select file_id, line, r.start as start, sha256(array_to_string(l, chr(10))) as forced, trim(list_extract(l, line)) <> '' as survives from f""")
def prep_force(spark, d):
    """The innermost region around a line, forced one way."""
    sources = _sources(spark, d)
    points = sources.select(F.col("doc_id").alias("file_id"), (5 + F.col("doc_id") % 30).alias("line"))
    found = preprocess.innermost(preprocess.region_rows(sources, "doc_id", "text"), points).where("start is not null")
    j = found.join(sources.select(F.col("doc_id").alias("file_id"), F.split("text", "\n").alias("l")), "file_id")
    j = j.withColumn("l", preprocess.forced(F.col("l"), F.col("start"), F.col("mid"), F.col("end"), F.col("file_id") % 2 == 0))
    return j.select("file_id", "line", "start", F.sha2(F.array_join("l", "\n"), 256).alias("forced"), preprocess.line_survives(F.col("l"), F.col("line").cast("int")).alias("survives"))


_DEFS = ["#define LONG(a, b) \\\\\n  a + b\n#define ONE 1\n", "#define ONE 2\n#undef LONG\n", "# define TWO (ONE)\n#define NOTHING\n", "int x;\n#undef ONE\n", "#define LONG long long\n"]
_DEFS_SQL = ", ".join("'" + x.replace("\\\\\n", "\\\n").replace("'", "''") + "'" for x in _DEFS)


@query(f"""with f as (select source as package, doc_id as ord, regexp_replace(list_extract([{_DEFS_SQL}], cast(1 + doc_id % 5 as int)), '\\\\\\n', ' ', 'g') as t from documents where doc_id % 13 < 5), l as (select package, ord, unnest(string_split(t, chr(10))) as x, generate_subscripts(string_split(t, chr(10)), 1) as n from f),
  m as (select package, ord, n, regexp_extract(x, '^\\s*#\\s*define\\s+(\\w+)(\\W.*)$', 1) as def, regexp_extract(x, '^\\s*#\\s*define\\s+(\\w+)(\\W.*)$', 2) as rest, regexp_extract(x, '^\\s*#\\s*undef\\s*(\\S+)', 1) as und from l),
  e as (select package, case when und <> '' then und else def end as name, ord, n, und = '' as kept, case when starts_with(rest, '(') then array_to_string(list_transform(string_split(regexp_extract(rest, '^\\(([^)]*)\\)', 1), ','), lambda p: trim(p)), ',') end as params, trim(case when starts_with(rest, '(') then regexp_extract(rest, '^\\([^)]*\\)(.*)$', 1) else rest end) as body from m where und <> '' or def <> ''),
  r as (select *, row_number() over (partition by package, name order by ord desc, n desc) as r from e) select package, name, params, body from r where r = 1 and kept""")
def macro_census(spark, d):
    """Each package's macros: the last definition wins, an undefinition removes it."""
    text = F.element_at(F.array(*(F.lit(x.replace("\\\\\n", "\\\n")) for x in _DEFS)), (F.col("doc_id") % 5 + 1).cast("int"))
    files = _t(spark, d, "documents").where("doc_id % 13 < 5").select(F.col("source").alias("package"), F.col("doc_id").alias("ord"), text.alias("text"))
    return preprocess.macro_census(files).select("package", "name", F.array_join("params", ",").alias("params"), "body")


_SHIMS = ", ".join(f"'{x}'" for x in macros.NEVER)


@query(rf"""with t as (
    select doc_id, source, regexp_replace(regexp_replace(coalesce(text, ''), '[^A-Za-z, ]', ' ', 'g'), '([A-Za-z]+), ([A-Za-z]+)', '\1(\2)', 'g') as x from documents),
  w as (select distinct source, unnest(regexp_extract_all(x, '[A-Za-z]+')) as w from t),
  r as (select source, w, row_number() over (partition by source order by w) - 1 as i from w where regexp_matches(w, '^[a-z]{{5}}$') and w not in ({_SHIMS})),
  m as (select source, w, i // 7 as b, i % 7 = 6 as is_call, last_value(w) over k as final, count(*) over k - (i % 7 + 1) as steps
    from r window k as (partition by source, i // 7 order by w rows between unbounded preceding and unbounded following)),
  k as (select doc_id, source, unnest(l) as t, generate_subscripts(l, 1) as i from (select doc_id, source, regexp_extract_all(x, '[A-Za-z]+\([A-Za-z]+\)|[A-Za-z]+|[^A-Za-z]+') as l from t)),
  p as (select *, regexp_extract(t, '^[A-Za-z]+') as a, regexp_extract(t, '\(([A-Za-z]+)\)', 1) as g from k),
  j as (select p.*, coalesce(ma.final, p.a) as fa, coalesce(mg.final, p.g) as fg, coalesce(ma.steps, 0) as sa, coalesce(mg.steps, 0) as sg, coalesce(ma.is_call, false) and p.g <> '' as called, ma.b % 5 = 4 as two
    from p left join m ma on ma.source = p.source and ma.w = p.a left join m mg on mg.source = p.source and mg.w = p.g),
  o as (select doc_id, i, case when a = '' then t when g = '' then fa when called and not two then '[' || fg || ' + ' || fg || ']' else fa || '(' || fg || ')' end as o,
    sa + case when called and not two then 1 + 2 * sg else sg end as n, called and two as refused from j)
  select t.doc_id, sha256(coalesce(string_agg(o, '' order by i), '')) as expanded, cast(coalesce(sum(n), 0) as bigint) as n, coalesce(bool_or(refused), false) as refused from t left join o using (doc_id) group by t.doc_id""")
def prep_expand(spark, d):
    """Each package's words of five letters are its macros: in alphabetical order six in seven stand for the
    next word, the seventh takes one argument, or two in every fifth group.  Texts call the words before commas."""
    docs = _t(spark, d, "documents")
    text = F.coalesce("text", F.lit(""))
    # a blank for each other character; replacing them by the expression costs four times as much, match by match
    other = F.regexp_replace(text, "[A-Za-z, ]++", "")
    plain = F.call_function("translate", text, other, F.repeat(F.lit(" "), F.length(other)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = docs.select("doc_id", "source", "text").repartition(parts, "doc_id").select(F.col("source").alias("package"), F.col("doc_id").alias("file_id"), F.regexp_replace(plain, "(?<![A-Za-z])([A-Za-z]++), ([A-Za-z]+)", "$1($2)").alias("text"))
    files = written(files, "sources")
    words = files.select("package", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("(?<![A-Za-z])([a-z]{5})(?![A-Za-z])"), F.lit(1)))).alias("name")).distinct()
    words = words.where(~F.col("name").isin(*macros.NEVER))
    order = Window.partitionBy("package").orderBy("name")
    census = words.withColumn("i", F.row_number().over(order) - 1).withColumn("next", F.lead("name").over(order))
    calls, two = F.col("i") % 7 == 6, F.floor(F.col("i") / 7) % 5 == 4
    params = F.when(calls & two, F.array(F.lit("a"), F.lit("b"))).when(calls, F.array(F.lit("a")))
    census = census.where(calls | F.col("next").isNotNull()).select("package", "name", params.alias("params"), F.when(calls, "[a + a]").otherwise(F.col("next")).alias("body"))
    x = macros.expanded(files, census)
    return x.select(F.col("file_id").alias("doc_id"), F.sha2("x.text", 256).alias("expanded"), F.size("x.expanded").cast("long").alias("n"), (F.size("x.refused") > 0).alias("refused"))


@query("""with w as (select source as signature, unnest(string_split(lower(coalesce(text, '')), ' ')) as name from documents), n as (select signature, name, count(*) as n from w where regexp_matches(name, '^[a-z]+$') group by 1, 2), r as (select *, row_number() over (partition by signature order by n desc, name) as r from n)
  select signature, string_agg(name || ' (' || n || ')', ', ' order by r) as macros from r where r <= 8 group by signature""")
def macro_tally(spark, d):
    words = _t(spark, d, "documents").select(F.col("source").alias("signature"), F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), " ")).alias("name"))
    return macros.tally(words.where(F.col("name").rlike("^[a-z]+$")))


_REG_SQL = "rg(name, ord, extensions, grammar, rosetta) as (values " + ", ".join(f"('{n}', {i}, {e}, '{g}', {str(r).lower()})" for i, (n, e, g, r, _) in enumerate(languages.LANGUAGES)) + ")"


@query(f"""with {_REG_SQL}, x as (select grammar, ord, unnest(extensions) as e, generate_subscripts(extensions, 1) as i from rg), w as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as e from documents),
  c as (select rg.name, count(distinct doc_id) as files from rg join x using (grammar) join w on w.e = x.e group by 1)
  select name, (select string_agg(e, ',' order by x.ord, i) from x where x.grammar = rg.grammar) as extensions, coalesce(files, 0) as files from rg left join c using (name)""")
def extension_routing(spark, d):
    """Each language's extensions, its grammar's dialects included, and the documents with a word that is one."""
    known = languages.grammar_extensions(languages.registry(spark))
    words = _t(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)))).alias("e"))
    files = words.join(known.select("name", F.explode("all_extensions").alias("e")), "e").groupBy("name").agg(F.countDistinct("doc_id").alias("files"))
    return known.join(files, "name", "left").select("name", F.array_join("all_extensions", ",").alias("extensions"), F.coalesce("files", F.lit(0)).alias("files"))


@query(f"""with {_REG_SQL}, c as (select distinct source as scope, 'g' || doc_id % 3 as grammar from documents where doc_id % 20 < 4), x as (select grammar, unnest(extensions) as extension from rg), cl as (select distinct regexp_extract(url, '([a-z]+)[^a-z]*$', 1) as extension from pages)
  select 'scope' as what, scope as subject, string_agg(grammar, ',' order by grammar) as detail from c group by scope having count(*) > 1 union all select 'type', grammar, extension from (select distinct grammar, extension from x) where extension not in ('py', 'rs', 'ts', 'js', 'java', 'sh', 'c', 'cc', 'rb', 'zig')
  union all select 'grammar', coalesce(a.grammar, b.grammar), case when b.grammar is null then 'missing' else 'unknown' end from (select distinct grammar from rg) a full join (values ('python'), ('rust'), ('cobol')) b(grammar) on a.grammar = b.grammar where a.grammar is null or b.grammar is null""")
def registry_findings(spark, d):
    """Scopes that several grammars claim, file types that none claims, grammars on one side only."""
    reg = languages.registry(spark)
    claims = _t(spark, d, "documents").where("doc_id % 20 < 4").select(F.col("source").alias("scope"), F.concat(F.lit("g"), (F.col("doc_id") % 3).cast("string")).alias("grammar"))
    shared = languages.shared_claims(claims, "scope", "grammar").select(F.lit("scope").alias("what"), F.col("scope").alias("subject"), F.col("owners").alias("detail"))
    known = reg.select("grammar").distinct().select("grammar", F.explode(F.array(*map(F.lit, "py rs ts js java sh c cc rb zig".split()))).alias("extension"))
    types = status.missing_types(reg, known).select(F.lit("type"), "grammar", "extension")
    sides = status.unpaired(reg, spark.createDataFrame([("python",), ("rust",), ("cobol",)], "grammar string"), "grammar").select(F.lit("grammar"), "grammar", "side")
    return shared.union(types).union(sides)


@query(f"""with {_REG_SQL}, f as (select 'python' as grammar, count(*) as files, count(*) filter (quality = 1) as passed from labels union all select 'rust', count(*), count(*) filter (toxic = 0) from labels where quality = 0), t as (select 'zig' as grammar, 3 as tests union all select 'python', 5),
  s as (select g.grammar, g.languages, f.files, f.passed, t.tests from (select grammar, string_agg(name, ',' order by ord) as languages from rg group by 1) g left join f using (grammar) left join t using (grammar)) select grammar, languages, files, passed, tests, files is null as unmeasured from s""")
def grammar_status(spark, d):
    """Facts from many sources, a row a grammar."""
    labels = _t(spark, d, "labels")
    count = lambda rows, g, ok: rows.agg(F.lit(g).alias("grammar"), F.count("*").alias("files"), F.count_if(ok).alias("passed"))
    measured = count(labels, "python", F.col("quality") == 1).union(count(labels.where("quality = 0"), "rust", F.col("toxic") == 0))
    tests = spark.createDataFrame([("zig", 3), ("python", 5)], "grammar string, tests int")
    s = status.collected(languages.registry(spark), measured=measured, tests=tests)
    return s.select("grammar", "languages", "files", "passed", "tests", F.col("files").isNull().alias("unmeasured"))


@query("""with p as (select source as package, lang as version, min(doc_id) as m, list({'path': case when doc_id % 17 = 0 then '' else cast(doc_id % 50 as varchar) end, 'sha256': case when doc_id % 19 = 0 then 'x' else sha256(coalesce(text, '')) end}) as files from documents group by 1, 2), n as (select *, package || '-' || coalesce(version, 'none') as name, m % 3 = 0 as none, m % 3 = 1 and m % 2 = 0 as bad from p),
  f as (select name || '/' || x.path as subject, x.path as path, x.sha256 as sha from (select name, unnest(files) as x from n where not none))
  select name as subject, 'no archive provenance' as error from n where none union all select name, 'invalid archive provenance' from n where bad union all select subject, 'invalid file provenance' from f where path = '' or not regexp_matches(sha, '^[0-9a-fA-F]{64}$') union all select subject, 'duplicate file identity' from f group by subject having count(*) > 1""")
def lock_errors(spark, d):
    """Provenance of a lock's packages and files."""
    docs = _t(spark, d, "documents")
    one = F.struct(F.when(F.col("doc_id") % 17 == 0, "").otherwise((F.col("doc_id") % 50).cast("string")).alias("path"), F.when(F.col("doc_id") % 19 == 0, "x").otherwise(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha256"))
    p = docs.groupBy(F.col("source").alias("package"), F.coalesce("lang", F.lit("none")).alias("version")).agg(F.min("doc_id").alias("m"), F.collect_list(one).alias("files"))
    artifact = F.struct(F.lit("https://x").alias("url"), F.lit(1).cast("long").alias("bytes"), F.when((F.col("m") % 3 == 1) & (F.col("m") % 2 == 0), "short").otherwise(F.sha2("package", 256)).alias("sha256"))
    return status.lock_errors(p.select(F.lit("c").alias("language"), "package", "version", F.when(F.col("m") % 3 != 0, artifact).alias("artifact"), "files"), "c")


@query("""select * from (select 'negative' as gate, count(*) = 0 as ok, count(*) as failures from benchmark where strlen(text) > 100000 union all select 'unanswered', count(*) = 0, count(*) from documents where doc_id not in (select doc_id from labels) union all select 'verdicts', count(*) filter (toxic = 1) <= 0, count(*) filter (toxic = 1) from labels)""")
def gate_report(spark, d):
    """Every gate with its failures."""
    docs, labels = _t(spark, d, "documents"), _t(spark, d, "labels")
    return status.gates(spark, negative=_t(spark, d, "benchmark").where(F.octet_length("text") > 100000), unanswered=languages.unanswered(docs, labels, "doc_id"), verdicts=labels.where("toxic = 1"))


@query("""with v as (select case when quality = 1 then 'valid' when toxic = 1 then 'invalid' else 'indeterminate' end as verdict from labels), c as (select count(*) filter (verdict = 'valid') as valid, count(*) filter (verdict = 'invalid') as invalid, count(*) filter (verdict = 'indeterminate') as indeterminate from v) select *, indeterminate > valid as warning from c""")
def verdict_split(spark, d):
    verdict = F.when(F.col("quality") == 1, "valid").when(F.col("toxic") == 1, "invalid").otherwise("indeterminate")
    c = _t(spark, d, "labels").select(verdict.alias("v")).agg(*(F.count_if(F.col("v") == x).alias(x) for x in ("valid", "invalid", "indeterminate")))
    return c.withColumn("warning", status.warns(F.col("valid"), F.col("indeterminate")))


@query("""with t as (select doc_id, text as x, hex(encode(text)) as h, cast(strlen(text) * (doc_id % 10) // 10 as bigint) as pos from documents where length(text) > 0), b as (select *, substr(h, 1, cast(2 * pos as int)) as before, substr(h, cast(2 * pos + 1 as int)) as after from t),
  c as (select *, length(before) // 2 as nb, len(list_filter(range(0, cast(length(before) // 2 as bigint)), lambda i: substr(before, cast(2 * i + 1 as int), 2) = '0A')) as lines from b), f as (select *, case when substr(h, cast(2 * pos + 1 as int), 1) in ('8', '9', 'A', 'B') then pos - length(regexp_extract(before, '((C|D|E|F).)?((8|9|A|B).)*$', 0)) // 2 else least(pos, strlen(x)) end as floor_ from c)
  select doc_id, 1 + lines as line, floor_ as boundary, left(trim(list_extract(string_split_regex(x, '\\r?\\n'), cast(1 + lines as int))), 160) as snippet from f""")
def positions(spark, d):
    """Line, trimmed line and character boundary of a byte offset."""
    data = scalars.latin(F.encode("text", "UTF-8"))
    rows = _t(spark, d, "documents").where(F.length("text") > 0).select("doc_id", data.alias("x"), F.floor(F.octet_length("text") * (F.col("doc_id") % 10) / 10).alias("pos"))
    at = scalars.line_and_snippet(F.col("x"), F.col("pos"))
    return rows.select("doc_id", at["line"].alias("line"), scalars.floor_boundary(F.col("x"), F.col("pos").cast("int")).cast("long").alias("boundary"), at["snippet"].alias("snippet"))


@query("""select p_partkey, list_reduce(list_transform(regexp_extract_all(p_name || ' ~*' || p_brand, '.'), lambda c: case when regexp_matches(c, '[A-Za-z0-9_.~-]') then c when c = ' ' then '+' else '%' || hex(encode(c)) end), lambda a, b: a || b) as encoded from part""")
def percent_encoding(spark, d):
    return _t(spark, d, "part").select("p_partkey", scalars.percent_encoded(F.concat("p_name", F.lit(" ~*"), "p_brand")).alias("encoded"))


@query("""with p as (select source, lang, count(*) as n, count(*) filter (quality = 1) as good from documents left join labels using (doc_id) group by all) select source, coalesce(lang, '') as lang, n as files, good as valid, row_number() over (order by good desc, n desc, source, lang) as place from p order by good desc, n desc, source, lang limit 40""")
def prefix_limit(spark, d):
    """The first rows in an order, with their places."""
    g = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left").groupBy("source", "lang").agg(F.count("*").alias("files"), F.count_if(F.col("quality") == 1).alias("valid"))
    return reports.first_rows(g, [F.desc("valid"), F.desc("files"), F.col("source"), F.col("lang").asc_nulls_last()], 40).select("source", F.coalesce("lang", F.lit("")).alias("lang"), "files", "valid", "place")
