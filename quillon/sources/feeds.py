"""Package rankings from staged feeds, and the addresses that versions resolve to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.sources.scans import xml_tag

PER_PAGE, PAGES = 100, 10


def _ranked(rows: DataFrame, order: list, k: int) -> DataFrame:
    """rank, name, downloads of the first ``k`` rows in an order, without gaps."""
    top = rows.orderBy(*order).limit(k)
    return top.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"), "name", "downloads")


def project_feed(document: DataFrame, k: int) -> DataFrame:
    """Ranking of a JSON document (json) ``{"rows": [{"project", "download_count"}]}`` in its order; rows that
    lack either don't count."""
    rows = document.select(F.posexplode(F.from_json("json", "rows array<struct<project:string,download_count:bigint>>")["rows"]).alias("i", "r"))
    rows = rows.where("r.project is not null and r.download_count is not null")
    return _ranked(rows.select("i", F.col("r.project").alias("name"), F.col("r.download_count").alias("downloads")), ["i"], k)


def paged_feed(pages: DataFrame, k: int, coordinates: bool = False) -> DataFrame:
    """Ranking of a feed read page by page (page, i, name, downloads) until one is empty; entries without a
    name or number don't count, nor, with ``coordinates``, names without a group."""
    had = pages.select("page").distinct()  # as many rows as pages
    whole = had.withColumn("r", F.row_number().over(Window.orderBy("page"))).where("page = r").select("page")
    rows = pages.join(whole, "page", "left_semi").where("name is not null and downloads is not null")
    if coordinates:
        rows = rows.where(F.col("name").contains(":"))
    return _ranked(rows, ["page", "i"], k)


def search_cursor(items: DataFrame, k: int) -> DataFrame:
    """Ranking of repeated searches (query, page, i, name, branch, downloads): ten pages of each, a name counts
    once, where it comes first; searches end with one that brings nothing new."""
    seen = items.where(F.col("page") <= PAGES).where("name is not null and branch is not null")
    order = F.struct("query", "page", "i")
    once = seen.groupBy("name").agg(F.min(order).alias("at"), F.min_by("downloads", order).alias("downloads"))
    asked = seen.select("query").distinct()
    dry = asked.join(once.select("at.query").distinct(), "query", "left_anti").agg(F.min("query").alias("dry"))
    rows = once.join(F.broadcast(dry), F.col("dry").isNull() | (F.col("at.query") < F.col("dry")))
    return _ranked(rows.select("at.query", "at.page", "at.i", "name", "downloads"), ["query", "page", "i"], k)


def chained(downloads: DataFrame, crates: DataFrame, defaults: DataFrame, versions: DataFrame, k: int) -> DataFrame:
    """rank, name, version of the ``k`` most downloaded (id, n) that have a name (id, name), a default version (id,
    version_id) and that version (version_id, version).  Ranks are given first, so a missing link leaves a hole."""
    top = downloads.orderBy(F.desc("n"), "id").limit(k)
    top = F.broadcast(top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "id")).cast("long")))  # k rows
    named = crates.join(top, "id")
    return defaults.join(F.broadcast(named), "id").join(versions, "version_id").select("rank", "name", "version")


def looked_up(installs: DataFrame, pool: DataFrame, kept: DataFrame, k: int) -> DataFrame:
    """rank, name, version, downloads of installs (ord, name, downloads) in their order, of those in the pool
    (name, version) and among ``kept`` (name)."""
    rows = installs.join(pool, "name").join(kept.select("name").distinct(), "name", "left_semi")
    top = rows.orderBy("ord").limit(k)
    return top.select(F.row_number().over(Window.orderBy("ord")).cast("long").alias("rank"), "name", "version", "downloads")


def newest_in_pool(stanzas: DataFrame, key: Column) -> DataFrame:
    """package, version, directory, file of stanzas (package, version, directory, files): the newest of each by
    ``key``, with its shortest original archive."""
    archives = F.filter("files", lambda f: f.rlike(r"\.orig\.tar\.") & f.rlike(r"\.tar\.(xz|gz|bz2)$"))
    shortest = F.get(F.array_sort(F.transform(archives, lambda f: F.struct(F.length(f).alias("n"), f.alias("f")))), F.lit(0))["f"]
    rows = stanzas.withColumn("file", shortest).where("file is not null and package is not null and version is not null and directory is not null")
    best = rows.groupBy("package").agg(F.max_by(F.struct("version", "directory", "file"), F.struct(key, F.col("version"))).alias("x"))
    return best.select("package", "x.*")


def within(size: Column, cap: int | None) -> Column:
    """Whether a download may be read: a size that isn't known is judged as it is read."""
    return F.lit(True) if cap is None else F.coalesce(size <= cap, F.lit(True))


def crate_url(name: Column, version: Column) -> Column:
    return F.format_string("https://static.crates.io/crates/%s/%s-%s.crate", name, name, version)


def sources_jar_url(coordinate: Column, version: Column) -> Column:
    """Null for a name that isn't group:artifact."""
    group, artifact = F.regexp_extract(coordinate, "^([^:]*):(.*)$", 1), F.regexp_extract(coordinate, "^([^:]*):(.*)$", 2)
    url = F.format_string("https://repo1.maven.org/maven2/%s/%s/%s/%s-%s-sources.jar", F.replace(group, F.lit("."), F.lit("/")), artifact, version, artifact, version)
    return F.when(coordinate.contains(":"), url)


def release_of(metadata: Column) -> Column:
    """The newest release that a metadata document names, else its latest version, else null."""
    release, latest = xml_tag(metadata, "release"), xml_tag(metadata, "latest")
    return F.when(release != "", release).when(latest != "", latest)


def sdist_of(document: Column) -> Column:
    """struct(version, url) of a project's source distribution; null url without one."""
    j = F.from_json(document, "info struct<version:string>, urls array<struct<packagetype:string,url:string>>")
    return F.struct(j["info"]["version"].alias("version"), F.get(F.filter(j["urls"], lambda u: u["packagetype"] == "sdist"), F.lit(0))["url"].alias("url"))


def tarball_of(document: Column) -> Column:
    """struct(version, url) of a registry document's latest version."""
    j = F.from_json(document, "`dist-tags` struct<latest:string>, versions map<string,struct<dist:struct<tarball:string>>>")
    latest = j["dist-tags"]["latest"]
    return F.struct(latest.alias("version"), F.try_element_at(j["versions"], latest)["dist"]["tarball"].alias("url"))


def gem_of(gem: Column, versions: Column) -> Column:
    """struct(version, url): a gem's own release if it is of the source platform, else the newest that is."""
    g = F.from_json(gem, "name string, version string, platform string, gem_uri string")
    newest = F.get(F.filter(F.from_json(versions, "array<struct<number:string,platform:string>>"), lambda v: v["platform"] == "ruby"), F.lit(0))["number"]
    own = g["platform"] == "ruby"
    return F.struct(F.when(own, g["version"]).otherwise(newest).alias("version"), F.when(own, g["gem_uri"]).otherwise(F.format_string("https://rubygems.org/gems/%s-%s.gem", g["name"], newest)).alias("url"))


def zig_url(version: Column) -> Column:
    return F.format_string("https://ziglang.org/download/%s/zig-%s.tar.xz", version, version)


def commit_url(full_name: Column, sha: Column) -> Column:
    """struct(version, url) of a repository at one commit; its version is the first 12 digits."""
    return F.struct(F.substring(sha, 1, 12).alias("version"), F.format_string("https://codeload.github.com/%s/tar.gz/%s", full_name, sha).alias("url"))


def pool_url(mirror: str, directory: Column, file: Column) -> Column:
    return F.concat_ws("/", F.lit(mirror), directory, file)


def fixtures(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """path, content of files below a folder with one of a grammar's extensions, in order of path."""
    glob = "*.{" + ",".join(extensions) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select("path", "content").orderBy("path")


def corpus_tests(spark: SparkSession, folder: str) -> DataFrame:
    """path, tests: how many tests each ``.txt`` file holds, two rules of ``=`` to each."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder)
    return test_counts(lines.select(F.input_file_name().alias("path"), "value"))


def test_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("path").agg(F.floor(F.count_if(F.col("value").rlike("^={3,}$")) / 2).alias("tests"))
