"""What the physical plans must and must not contain."""

import pytest

from conftest import plan_of
from postweave.plans import catalog

ROW_UDFS = ["BatchEvalPython", "PythonRDD"]
PAIRS = ["CartesianProduct", "BroadcastNestedLoopJoin"]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_pair_products_and_no_row_udfs(built, name):
    plan = plan_of(built(name))
    for word in [*ROW_UDFS, *PAIRS]:
        assert word not in plan, plan


@pytest.mark.parametrize(
    "name, columns",
    [
        ("encode_label", "struct<doc_id:bigint>"),
        ("predict_class", "struct<vec_id:bigint,embedding:array<float>>"),
        ("split_sizes", "struct<doc_id:bigint,text:string>"),
    ],
)
def test_scans_read_only_what_is_used(built, name, columns):
    assert f"ReadSchema: {columns}" in plan_of(built(name))


def test_row_lookup_reaches_the_scan(spark, folder):
    from postweave.operators import ordering
    from postweave.plans import tables

    plan = plan_of(ordering.row_at(tables.vectors(spark, folder), 7, "vec_id"))
    assert "EqualNullSafe(vec_id,7)" in plan


def test_histogram_scans_the_texts_once(built):
    df = built("length_histogram")
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert final.count("text#") > 0 and final.count("partial_count(1)") == 1


def test_counts_are_partial_before_the_shuffle(built):
    plan = plan_of(built("confusion_matrix"))
    assert "partial_count" in plan
