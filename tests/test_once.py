"""Costly steps that several jobs read are computed once: their readers' plans start from stored rows."""

import numpy as np
import pytest
from conftest import plan_of
from postweave.operators import fusion, ordering, text
from postweave.plans import catalog, experiment
from postweave.plans import tables as T
from pyspark.sql import functions as F


def test_pairs_are_joined_once(spark, folder):
    plan = plan_of(T.split_pairs(spark, folder))
    assert "documents.parquet" not in plan and "Join" not in plan


def test_key_lookups_of_a_split_read_stored_keys(spark, monkeypatch):
    plans, look = [], ordering.key_at
    monkeypatch.setattr(ordering, "key_at", lambda df, *args, **more: plans.append(plan_of(df)) or look(df, *args, **more))
    rows = spark.range(100).select((F.col("id") * 7 % 100).alias("k"))
    shares = ordering.share_split(rows, (7, 10), "k", lookup_rows=10)
    given = ordering.ordered_split(rows, 70, "k", lookup_rows=10)
    for split in (shares, given):
        assert sorted(r["k"] for r in split.filter("split = 'train'").collect()) == list(range(70))
    assert len(plans) == 2 and not any("Range" in p for p in plans)


def test_stored_vectors_equal_those_made_in_place(spark):
    rows = spark.createDataFrame(
        [(1, "a b b c"), (1, "a b b c"), (2, None), (3, ""), (None, "c d, e")], "id int, tweet string")
    model = text.fit_tfidf(rows, 4)
    for make, col in ((text.tfidf_features, "text_features"), (text.tfidf_terms, "text_terms")):
        plain, kept = make(rows, model).select("id", col), make(rows, model, keep=["id"])
        assert kept.columns == ["id", col] and "regexp" not in plan_of(kept)
        assert sorted(map(str, kept.collect())) == sorted(map(str, plain.collect()))


def test_term_stats_count_every_text(spark):
    rows = spark.createDataFrame([("a a b",), ("a",), ("",), (None,)], "tweet string")
    terms, texts = text._term_stats(rows, 5, "tweet", 1)
    assert [tuple(r) for r in terms] == [("a", 3, 2), ("b", 1, 1)] and texts == 3


@pytest.mark.parametrize("name", ["cross_attention", "cross_attention_weights"])
def test_cross_attention_reads_the_texts_once(spark, folder, name):
    assert "documents.parquet" not in plan_of(catalog.QUERIES[name](spark, folder))


def test_cross_attention_sums_images_before_the_value_layer(spark):
    rng = np.random.default_rng(3)
    query, key, value = [(rng.normal(size=s), rng.normal(size=s[0])) for s in ((2, 5), (2, 3), (5, 3))]
    texts = {k: rng.normal(size=5) for k in (1, 2, 3)}
    images = [(1, rng.normal(size=3)), (1, 300 * rng.normal(size=3)), (2, rng.normal(size=3))]
    found = fusion.cross_attention(
        spark.createDataFrame([(k, v.tolist()) for k, v in texts.items()], "post_id int, text_features array<double>"),
        spark.createDataFrame([(k, v.tolist()) for k, v in images] + [(2, None), (None, [1.0] * 3)], "post_id int, features array<double>"),
        "post_id", query, key, value, batches=True)
    plan = plan_of(found)
    assert plan.index("matmul") < plan.index("Summarizer") if "Summarizer" in plan else plan.index("matmul") < plan.index("aggregate")
    got = {r["post_id"]: r["attended"] for r in found.collect()}
    assert set(got) == {1, 2, 3}
    for k, t in texts.items():
        own = [x for post, x in images if post == k]
        s = np.array([(query[0] @ t + query[1]) @ (key[0] @ x + key[1]) for x in own])
        w = np.exp(s - s.max()) / np.exp(s - s.max()).sum() if own else []
        want = t + sum((p * (value[0] @ x + value[1]) for p, x in zip(w, own)), np.zeros(5))
        assert np.allclose(got[k], want)


@pytest.mark.parametrize("kind", experiment.KINDS)
def test_scored_rows_do_not_attend_again(spark, folder, kind):
    run = experiment.run_fusion(T.split_pairs(spark, folder), kind, 1, 0.05, 8)
    plan = plan_of(run.rows)
    assert not any(word in plan for word in ("regexp", "Window", "Join", "documents.parquet"))
    assert run.scored("test").count() == run.rows.filter("split = 'test'").count() > 0


def test_trie_levels_keep_their_number_of_tasks(spark, monkeypatch):
    from postweave.llm import variants

    tasks, keep = {}, variants.stored
    monkeypatch.setattr(variants, "stored", lambda df, name: tasks.update({name: df.rdd.getNumPartitions()}) or keep(df, name))
    words = [a + b + "tail" for a in ("abc", "abd", "xbc") for b in ("mn", "mo", "pn", "m")]
    rows = spark.createDataFrame([(w,) for w in words], "word string").repartition(16)
    found = {tuple(r) for r in variants.neighbours(rows).collect()}
    assert ("abcmntail", "abcmotail") in found and ("abcmntail", "abcmtail") in found
    levels = [n for name, n in tasks.items() if name.startswith("frontier") or name == "trie-edges"]
    assert len(levels) > 2 and max(levels) <= spark.sparkContext.defaultParallelism


def test_trie_levels_join_the_states_twice(spark, monkeypatch):
    from postweave.llm import variants

    joins, keep = {}, variants.stored
    monkeypatch.setattr(variants, "stored", lambda df, name: joins.update({name: plan_of(df).count("Join")}) or keep(df, name))
    rows = spark.createDataFrame([(w,) for w in ("abcdefgh", "abcdefgi", "abcdxfgh", "abcdefg", "bbcdefgh", "mnopqrst")], "word string")
    found = {tuple(sorted(r)) for r in variants.neighbours(rows).collect()}
    assert found == {tuple(sorted(p)) for p in (("abcdefgh", "abcdefgi"), ("abcdefgh", "abcdxfgh"), ("abcdefgh", "abcdefg"),
                                                ("abcdefgh", "bbcdefgh"), ("abcdefgi", "abcdefg"))}
    levels = [n for name, n in joins.items() if name.startswith("frontier")]
    assert levels and max(levels) <= 2
