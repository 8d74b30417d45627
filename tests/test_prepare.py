import pytest
from pyspark.sql import functions as F

from postweave import functions as PF
from postweave.operators import prepare

ROWS = [
    (1, "a.JPG.JPG", "Hello", "fires"),
    (2, "b.JpG", "", "flood"),
    (3, None, "x", "flood"),
    (4, "d.jpg", None, "fires"),
    (5, "e.JPG", "\U0001f525", "unknown"),
    (6, "/abs.jpg", "y", "non_damage"),
]


@pytest.fixture(scope="module")
def posts(spark):
    return spark.createDataFrame(ROWS, "post_id int, image string, tweet string, label string")


def by_id(df, col):
    return {r["post_id"]: r[col] for r in df.collect()}


def test_unknown_label_is_null(posts):
    codes = by_id(prepare.encode_label(posts), "label")
    assert codes == {1: 3, 2: 4, 3: 4, 4: 3, 5: None, 6: 0}


def test_mapping_table_gives_the_same_codes(spark, posts):
    table = spark.createDataFrame([("fires", 3), ("flood", 4), ("non_damage", 0)], "name string, code int")
    assert by_id(prepare.encode_label(posts, mapping=table), "label") == by_id(
        prepare.encode_label(posts), "label"
    )


def test_decode_inverts_encode(posts):
    coded = prepare.encode_label(posts)
    names = by_id(prepare.decode_label(coded), "dir")
    assert names[1] == "fires" and names[5] is None


def test_display_label_outside_list_is_null(spark):
    df = spark.createDataFrame([(1, 5), (2, 6), (3, None), (4, -1)], "post_id int, label int")
    assert by_id(prepare.display_label(df), "display") == {1: "HD", 2: None, 3: None, 4: None}


def test_extension_is_literal_and_every_occurrence(posts):
    names = by_id(prepare.normalize_extension(posts), "image")
    assert names[1] == "a.jpg.jpg" and names[2] == "b.JpG" and names[3] is None


def test_media_path(posts):
    named = posts.withColumn("dir", F.col("label"))
    paths = by_id(prepare.build_media_path(named, "root/"), "path")
    assert paths[2] == "root/flood/images/b.JpG"
    assert paths[3] is None and paths[6] is None
    kept = by_id(prepare.build_media_path(named, "root", on_absolute="keep"), "path")
    assert kept[6] == "/abs.jpg"
    flat = by_id(prepare.build_media_path(posts, "root", folder=None), "path")
    assert flat[2] == "root/b.JpG"


def test_text_or_nan(posts):
    assert by_id(prepare.text_or_nan(posts), "tweet")[4] == "nan"
    assert by_id(prepare.text_or_nan(posts, missing_text="empty"), "tweet")[4] == ""


def test_null_audit(posts):
    coded = prepare.encode_label(posts)
    bad = {r["post_id"] for r in prepare.null_rows(coded).collect()}
    assert bad == {3, 4, 5}
    good = {r["post_id"] for r in prepare.drop_missing(coded).collect()}
    assert good == {1, 2, 6}
    profile = prepare.null_profile(coded).first()
    assert profile["rows_with_missing"] == 3 and profile["missing_image"] == 1
    assert profile["n_rows"] == 6 and profile["missing_post_id"] == 0


def test_nan_is_not_missing(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None)], "post_id int, x double")
    assert [r["post_id"] for r in prepare.drop_missing(df).collect()] == [1]


def test_media_existence(spark, posts):
    pathed = prepare.build_media_path(posts, "r", folder=None)
    media = spark.createDataFrame([("r/b.JpG",), ("r/b.JpG",), ("r/other",)], "path string")
    assert [r["post_id"] for r in prepare.existing_media(pathed, media).collect()] == [2]
    lost = prepare.existing_media(pathed, media, missing=True)
    assert sorted(r["post_id"] for r in lost.collect()) == [1, 3, 4, 5, 6]


def test_project_posts(posts):
    assert prepare.project_posts(posts).columns == ["label", "image", "tweet"]
    assert prepare.project_posts(posts, image_only=True).columns == ["label", "image"]


def test_bad_arguments():
    with pytest.raises(ValueError):
        PF.text_or_nan(F.col("x"), "blank")
    with pytest.raises(ValueError):
        PF.media_path("r", F.col("x"), on_absolute="drop")
