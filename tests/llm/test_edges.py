"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postweave.llm import chat, exact_dedup, licenses, minhash, mixing, pieces, pii, quality, urls, warc
from postweave.session import scratch_path

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, keep_id string, kept string, "
          "label int, size string, _text string, _word long, _id string, _row int, n_pieces string")


def row(doc_id, text, source="a"):
    return (doc_id, text, "en", source, None if text is None else len(text), "k", "x", 1, "s", "t", 2, "i", 3, "p")


LONG = " ".join(f"word{i % 7919}" for i in range(60_000))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [row(1, None), row(2, ""), row(3, " \t\n"), row(None, "null id here"), row(5, LONG), row(5, LONG),
            row(6, LONG + " "), row(7, "a b c", None), row(7, "a b c", None), row(8, "abc"), row(9, "a  b\tc"),
            row(10, "ｕｎｉ ▁ <|end|> \U0001f600 é", "b"), (11,) + (None,) * 13]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r[0], []).append(r)
    return out


def test_exact_groups(docs):
    found = by_id(exact_dedup.exact_groups(docs))
    assert sum(map(len, found.values())) == 13
    # Null, empty, white-space texts are equal; the longest original stays.
    assert {found[i][0].keep_id for i in (1, 2, 3, 11)} == {3}
    assert found[1][0].group_size == 4 and found[1][0].text_sha256 == hashlib.sha256(b"").hexdigest()
    # Removing white space makes abc, "a b c" and "a  b\tc" equal; length decides.
    assert {r.keep_id for i in (7, 8, 9) for r in found[i]} == {9}
    assert [r.kept for r in found[5]] == [False, False] and found[6][0].kept and found[6][0].group_size == 3
    assert found[None][0].kept and found[None][0].keep_id is None


def test_drop_copies_keeps_columns(docs):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 6, 9, 10]


def test_ties_go_to_one_row(spark):
    same = spark.createDataFrame([row(4, "tie"), row(4, "tie"), row(2, "tie"), row(None, "tie")], SCHEMA)
    assert [r.doc_id for r in exact_dedup.drop_copies(same).collect()] == [2]
    twice = spark.createDataFrame([row(4, "tie")] * 5, SCHEMA)
    assert exact_dedup.drop_copies(twice).count() == 1
    assert exact_dedup.exact_groups(twice).filter("kept").count() == 5


def test_full_filter_gives_the_same_groups(docs):
    tiny = {tuple(r) for r in exact_dedup.exact_groups(docs, max_words=1).collect()}
    assert tiny == {tuple(r) for r in exact_dedup.exact_groups(docs).collect()}


def test_quality_edges(docs):
    found = by_id(quality.score_quality(docs))
    assert sum(map(len, found.values())) == 13
    assert all(found[i][0].n_words == 0 and found[i][0].base_failed for i in (1, 2, 3, 11))
    assert [r.n_words for r in found[5]] == [60_000] * 2
    assert quality.filter_quality(docs).columns == docs.columns


def test_near_edges(docs):
    found = by_id(minhash.near_components(docs))
    assert sum(map(len, found.values())) == 13
    assert all(found[i][0].n_shingles == 0 and found[i][0].component_id == i for i in (1, 2, 3, 11))
    assert {r.component_id for i in (5, 6) for r in found[i]} == {5}
    assert {r.component_id for i in (7, 9) for r in found[i]} == {7} and found[8][0].component_id == 8
    assert found[None][0].component_id is None and found[None][0].kept
    assert minhash.drop_near_copies(docs).columns == docs.columns


def test_mixing_edges(docs):
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == 13 and all(r.taken <= 3 * r.size for r in rows)
    assert mixing.mix_documents(docs).columns == docs.columns


def test_pieces_edges(docs):
    rows = pieces.encode(docs, keep=docs.columns).collect()
    assert len(rows) == 13 and all(r.lossless for r in rows)
    assert {r.n_pieces for r in rows if not r.text} == {0}


def test_license_and_personal_edges(docs):
    assert len(licenses.scan_licenses(docs).collect()) == 13
    assert len(pii.find_personal_data(docs, pii.fit_field([])).collect()) == 13


def test_empty_tables(spark, none):
    for made in (exact_dedup.exact_groups(none), exact_dedup.drop_copies(none), quality.score_quality(none),
                 quality.filter_quality(none), minhash.near_components(none), minhash.drop_near_copies(none),
                 mixing.mix_report(none), mixing.mix_documents(none), mixing.mixed_blocks(none),
                 pieces.encode(none), licenses.scan_licenses(none), pii.find_personal_data(none, pii.fit_field(pii.training_texts(none)))):
        assert made.count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = scratch_path(spark, "warc")
    warc.write_warc(warc.assign_revisits(pages), path).collect()
    assert warc.read_warc(spark, path).count() == 0
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    assert urls.judge_urls(pages, rules).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_turns(chat.join_turns(chat.format_turns(turns))).count() == 0


def test_pipeline_on_edges(spark, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert last.filter(~F.col("lossless")).count() == 0
