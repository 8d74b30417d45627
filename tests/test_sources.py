import os

import pytest
from pyspark.sql import functions as F

from postweave import session
from postweave.operators import prepare
from postweave.operators.ordering import dense_index
from postweave.sources import (
    LOAD_ORDER,
    read_manifest,
    read_table,
    scan_media,
    write_manifest_csv,
    write_tables,
)


def test_csv_with_line_breaks_quotes_and_missing_words(spark, tmp_path):
    path = tmp_path / "posts.csv"
    path.write_text(
        'label,tweet,image,extra\nfires,"two\nlines, ""quoted""",a.JPG,1\nflood,NA,b.jpg,2\n'
        'null,,"",3\nfires,"  kept  ",c.jpg,4\n',
        encoding="utf-8",
    )
    rows = [tuple(r) for r in read_manifest(spark, str(path)).collect()]
    assert rows == [
        ("a.JPG", 'two\nlines, "quoted"', "fires"),
        ("b.jpg", None, "flood"),
        (None, None, None),
        ("c.jpg", "  kept  ", "fires"),
    ]
    raw = read_manifest(spark, str(path), missing_words=[]).collect()
    assert raw[1]["tweet"] == "NA"


def test_csv_round_trip(spark, tmp_path):
    rows = [
        ("a.jpg", ' "q", \\ back\\" \r\n end ', "fires"),
        ("b.jpg", "\U0001f525\n\n,", "flood"),
        (None, None, "x"),
    ]
    df = spark.createDataFrame(rows, "image string, tweet string, label string")
    write_manifest_csv(df, str(tmp_path / "csv"))
    back = read_manifest(spark, str(tmp_path / "csv")).collect()
    assert sorted(map(str, back)) == sorted(map(str, df.collect()))


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_load_order(spark, tmp_path, fmt):
    rows = [(f"{i:03d}.jpg", f"line\n{(i * 37) % 100}", "fires") for i in range(100)]
    for n, part in enumerate([rows[:60], rows[60:]]):
        df = spark.createDataFrame(part, "image string, tweet string, label string").coalesce(1)
        if fmt == "csv":
            write_manifest_csv(df, str(tmp_path / f"p{n}"))
        else:
            df.write.parquet(str(tmp_path / f"p{n}"))
    paths = [str(tmp_path / f"p{n}") for n in (0, 1)]
    df = read_manifest(spark, paths, fmt, with_order=True)
    found = dense_index(df, LOAD_ORDER).orderBy("row_idx").collect()
    assert [r["image"] for r in found] == [r[0] for r in rows]


def test_unusable_manifests(spark, tmp_path):
    (tmp_path / "p.csv").write_text("image,tweet\na,b\n")
    with pytest.raises(ValueError, match="label"):
        read_manifest(spark, str(tmp_path / "p.csv"))
    with pytest.raises(ValueError):
        read_manifest(spark, "x", "xlsx")


@pytest.fixture
def media_root(tmp_path):
    for name in ["fires/images/a.jpg", "flood/images/b.jpg", "flood/images/deep/c.png", "d.jpg"]:
        target = tmp_path / "media" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(b"x" * len(name))
    return str(tmp_path / "media")


def test_media_listing(spark, media_root):
    rows = {r["path"].removeprefix(media_root + "/"): r for r in scan_media(spark, media_root).collect()}
    assert set(rows) == {
        "fires/images/a.jpg", "flood/images/b.jpg", "flood/images/deep/c.png", "d.jpg"
    }
    assert rows["d.jpg"]["folder"] is None and rows["fires/images/a.jpg"]["folder"] == "fires"
    assert all(r["length"] == len(p) for p, r in rows.items())
    assert scan_media(spark, media_root, "*.png").count() == 1


def test_media_listing_reads_no_content(spark, media_root):
    plan = scan_media(spark, media_root)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_posts_meet_listed_media(spark, media_root):
    posts = spark.createDataFrame([("fires", "a.jpg"), ("fires", "b.jpg")], "dir string, image string")
    pathed = prepare.build_media_path(posts, media_root)
    found = prepare.existing_media(pathed, scan_media(spark, media_root))
    assert [r["image"] for r in found.collect()] == ["a.jpg"]


def test_tables(spark, tmp_path):
    df = spark.range(6).withColumn("split", F.when(F.col("id") < 4, "train").otherwise("valid"))
    paths = write_tables(
        {"rows": df, "few": df.limit(1)}, str(tmp_path), partition_by={"rows": ["split"]}
    )
    assert os.path.isdir(tmp_path / "rows" / "split=train")
    assert spark.read.parquet(paths["rows"]).filter("split = 'train'").count() == 4
    write_tables({"rows": df.limit(2)}, str(tmp_path))
    assert spark.read.parquet(paths["rows"]).count() == 2


def test_tables_are_dealt_to_the_tasks_asked_for(spark, tmp_path):
    from conftest import plan_of

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    dealt = read_table(spark, str(tmp_path / "one"), 5, "id")
    assert dealt.rdd.getNumPartitions() == 5 and dealt.count() == 100
    assert "Exchange" not in plan_of(read_table(spark, str(tmp_path / "one")))


@pytest.mark.parametrize("root", ["flood", "data"])
def test_media_path_where_the_root_text_recurs(spark, tmp_path, root):
    base = tmp_path / root
    deep = base / f"{root}_{root}{base}" / "images"
    deep.mkdir(parents=True)
    (deep / "y.jpg").write_bytes(b"x")
    row = scan_media(spark, str(base)).first()
    assert row["path"] == str(deep / "y.jpg") and row["folder"].startswith(f"{root}_{root}")


class FakeContext:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder


class FakeSession:
    def __init__(self, master, named=None, folder=None):
        self.sparkContext = FakeContext(master, folder)
        self.conf = {"spark.checkpoint.dir": named} if named else {}


def test_shared_folder_comes_from_the_session():
    assert session.shared_dir(FakeSession("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert session.shared_dir(FakeSession("yarn", folder="hdfs:///set")) == "hdfs:///set"
    with pytest.raises(RuntimeError):
        session.shared_dir(FakeSession("yarn"))
