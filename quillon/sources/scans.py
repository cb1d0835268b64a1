"""Sources: manifests, feeds, oracle streams, archives and source files as DataFrames."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import tomllib
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = (
    "language string, packages array<struct<package:string,version:string,downloads:bigint,"
    "artifact:struct<url:string,bytes:bigint,sha256:string>,"
    "files:array<struct<path:string,bytes:bigint,sha256:string,dialect:string>>>>"
)
SPANS = (
    "path string, spans array<struct<start:bigint,end:bigint,kind:string>>, has_edges boolean, "
    "edges array<struct<ps:bigint,pe:bigint,pk:string,field:string,cs:bigint,ce:bigint>>, "
    "tokens array<struct<start:bigint,end:bigint>>, error bigint, skipped string"
)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a manifest or lock document."""
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def flatten(manifests: DataFrame) -> DataFrame:
    """pkgdir, path, bytes, sha256, dialect of each file, with package_ord and file_ord."""
    from quillon.functions.paths import pkg_dir

    p = manifests.select(F.posexplode("packages").alias("package_ord", "p"))
    f = p.select("package_ord", pkg_dir(F.col("p.package"), F.col("p.version")).alias("pkgdir"), F.posexplode("p.files").alias("file_ord", "f"))
    return f.select("pkgdir", "f.*", "package_ord", "file_ord")


def source_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path and content of each file below a folder; whole bytes, any encoding."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select("path", "content")


def read_state(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """wanted (path) with content and read_ok: an unreadable file stays a row of its own."""
    return wanted.join(found, "path", "left").withColumn("read_ok", F.col("content").isNotNull())


def lossy(content: Column) -> Column:
    """Text with U+FFFD where bytes aren't UTF-8."""

    @F.pandas_udf("string")
    def run(c: pd.Series) -> pd.Series:
        return c.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))

    return run(content)


def popcon(spark: SparkSession, path: str) -> DataFrame:
    """rank, name, installs of a popularity contest file; rows without these numbers don't count."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^(#|---)")).select(part.alias("f"))
    number = lambda i: F.get("f", F.lit(i)).try_cast("long")
    return rows.where((F.size("f") >= 3) & number(0).isNotNull() & number(2).isNotNull() & (F.get("f", F.lit(1)) != "Total")).select(number(0).cast("int").alias("rank"), F.get("f", F.lit(1)).alias("name"), number(2).alias("installs"))


def deb822(spark: SparkSession, path: str) -> DataFrame:
    """Package, Version, Directory of each blank-line-separated stanza."""
    rows = spark.read.option("lineSep", "\n\n").text(path)
    field = lambda k: F.regexp_extract("value", rf"(?m)^{k}:[ \t]*(.*)$", 1).alias(k.lower())
    return rows.select(field("Package"), field("Version"), field("Directory")).where("package != ''")


def dump(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV dump by its header's names."""
    return spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE", enforceSchema=False)


def quoted_names(spark: SparkSession, path: str) -> DataFrame:
    """rank, name of the single-quoted names of an array literal, in order."""
    return spark.read.option("wholetext", True).text(path).select(F.posexplode(F.regexp_extract_all("value", F.lit("'([^']*)'"), F.lit(1))).alias("i", "name")).select((F.col("i") + 1).alias("rank"), "name")


def verdict_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, valid from tab-separated lines, cut at the last tab."""
    cut = lambda i: F.regexp_extract("value", r"^(.*)\t([^\t]*)$", i)
    return spark.read.text(path).where(F.col("value").contains("\t")).select(cut(1).alias("path"), (cut(2) == "valid").alias("valid"))


def span_lines(spark: SparkSession, path: str) -> DataFrame:
    """Oracle spans by line: has_edges is true unless said otherwise, has_tokens says whether the field stands."""
    return spark.read.schema(SPANS).json(path).withColumn("has_edges", F.coalesce("has_edges", F.lit(True))).withColumn("has_tokens", F.col("tokens").isNotNull())


def xml_tag(text: Column, tag: str) -> Column:
    """Trimmed body of the first such tag."""
    return F.trim(F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}>", 1))


def newest_releases(index: DataFrame) -> DataFrame:
    """version of an index (version, has_source): the newest patch of each minor from 0.11 on."""
    part = lambda i: F.coalesce(F.try_to_number(F.get(F.split("version", r"\."), F.lit(i)), F.lit("99999")).cast("int"), F.lit(0))
    rows = index.where((F.col("version") != "master") & F.col("has_source")).select("version", F.struct(*(part(i) for i in range(3))).alias("k"))
    rows = rows.where(F.col("k") >= F.struct(F.lit(0), F.lit(11), F.lit(0)))
    return rows.groupBy("k.col1", "k.col2").agg(F.max_by("version", "k").alias("version")).select("version")


def toml_rows(text: str) -> list[tuple[str, str, str]]:
    """(block, key, value) of a small policy or evidence document, read on the driver."""
    out = []

    def walk(at: str, x) -> None:
        for k, v in (x.items() if isinstance(x, dict) else enumerate(x)):
            if isinstance(v, (dict, list)):
                walk(f"{at}.{k}" if at else str(k), v)
            else:
                out.append((at, str(k), str(v)))

    walk("", tomllib.loads(text))
    return out


def kind_of_archive(content: Column) -> Column:
    """zip, gz, bz2, xz, tar or null, by magic bytes."""
    head, ustar = F.hex(F.substring(content, 1, 6)), F.substring(content, 258, 5)
    return F.when(head.startswith("504B0304"), "zip").when(head.startswith("1F8B"), "gz").when(head.startswith("425A68"), "bz2").when(head == "FD377A585A00", "xz").when(F.hex(ustar) == "7573746172", "tar")


def _members(data: bytes, strip: int | None, inner: str | None, depth: int) -> Iterator[tuple[str, bytes | None, str | None]]:
    for magic, opened in ((b"\x1f\x8b", gzip.decompress), (b"BZh", bz2.decompress), (b"\xfd7zXZ\x00", lzma.decompress)):
        if data.startswith(magic):
            data = opened(data)
            break
    found: dict[str, bytes] = {}
    if data.startswith(b"PK\x03\x04"):
        drop = 0 if strip is None else strip
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            every = [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
    else:
        drop = 1 if strip is None else strip
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            every = [(m.name, t.extractfile(m).read()) for m in t.getmembers() if m.isreg()]
    for name, body in every:
        if inner and depth < 1 and name.rpartition("/")[2] == inner:
            try:
                yield from _members(body, 0, None, depth + 1)
            except Exception as e:  # a corrupt inner archive is reported, not fatal
                yield name, None, str(e)[:200]
            continue
        parts = name.split("/")[drop:]
        if parts and all(p not in ("", ".", "..") for p in parts) and not name.startswith("/"):
            found.setdefault("/".join(parts), body)
    yield from ((k, found[k], None) for k in sorted(found))


def explode_archives(archives: DataFrame, strip: int | None = None, inner: str | None = None) -> DataFrame:
    """archive, path, content, error of each regular member of archives (archive, content).

    The root folder of tar files is stripped unless ``strip`` says otherwise; ``inner`` names
    nested archives to open, one level deep.  Paths that leave the archive are left out.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for name, data in zip(p["archive"], p["content"]):
                try:
                    rows = list(_members(bytes(data), strip, inner, 0))
                except Exception as e:
                    rows = [(None, None, str(e)[:200])]
                yield pd.DataFrame([(name, *r) for r in rows], columns=["archive", "path", "content", "error"])

    return archives.select("archive", "content").mapInPandas(run, "archive string, path string, content binary, error string")
