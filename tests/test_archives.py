"""Archives made of documents, read by several tasks."""

import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.runtime import ship
from quillon.sources import archives

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {f"{r.source}/{r.doc_id}.txt": (r.text or "").encode() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    at = tmp_path_factory.mktemp("archives")
    with zipfile.ZipFile(at / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.mkdir("src0")
        for name, data in texts.items():
            z.writestr(name, data)
    for file, mode in (("sub/b.tar", "w"), ("sub/c.tar.gz", "w:gz")):
        (at / file).parent.mkdir(exist_ok=True)
        with tarfile.open(at / file, mode) as t:
            for name, data in texts.items():
                m = tarfile.TarInfo(name)
                m.size = len(data)
                t.addfile(m, io.BytesIO(data))
            link = tarfile.TarInfo("link")
            link.type, link.linkname = tarfile.SYMTYPE, "src0"
            t.addfile(link)
    (at / "broken.zip").write_bytes((at / "a.zip").read_bytes()[:-500])
    (at / "short.tgz").write_bytes((at / "sub/c.tar.gz").read_bytes()[:2000])
    (at / "empty.tar").write_bytes(b"")
    (at / "note.txt").write_text("no archive")
    ship(spark)
    spark.dataSource.register(archives.Archives)
    return at


def test_members(spark, folder, texts):
    rows = spark.read.format("archives").option("stretch", 20_000).load(str(folder))
    for name in ("a.zip", "sub/b.tar", "sub/c.tar.gz"):
        own = rows.where(F.col("archive").endswith(name)).collect()
        assert {r.member: bytes(r.content) for r in own} == texts and len(own) == len(texts) and {r.problem for r in own} == {None}
    assert rows.rdd.getNumPartitions() > 6
    bad = rows.where("member is null").collect()
    assert {r.archive.rsplit("/", 1)[1] for r in bad} >= {"broken.zip", "short.tgz"} and all(r.problem.startswith("not a whole") for r in bad)
    assert rows.where(F.col("archive").endswith("note.txt")).count() == 0


def test_one_archive_many_tasks(spark, folder, texts):
    """Each task takes the members of its stretch, none twice."""
    rows = spark.read.format("archives").option("stretch", 5_000).load(f"file://{folder}/sub/b.tar").withColumn("task", F.spark_partition_id())
    per = rows.groupBy("task").count().collect()
    assert len(per) > 10 and sum(r["count"] for r in per) == len(texts) == rows.select("member").distinct().count()


def test_cap_and_pushed_filters(spark, folder, texts):
    some = sorted(len(v) for v in texts.values())[len(texts) // 2]
    rows = spark.read.format("archives").option("cap", some).load(str(folder)).where(F.col("archive").endswith("a.zip")).collect()
    assert all((r.content is None and r.problem == "too large") if len(texts[r.member]) > some else bytes(r.content) == texts[r.member] for r in rows)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    one = spark.read.format("archives").option("stretch", 20_000).option("pushdown", "true").load(str(folder)).where(F.col("archive") == f"{folder}/sub/c.tar.gz")
    assert one.count() == len(texts) and one.rdd.getNumPartitions() == 1
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert spark.read.format("archives").load(str(folder / "sub")).where("archive = 'none'").count() == 0
