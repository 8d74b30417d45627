import math
import re
from collections import Counter

import pytest

from postweave.operators import text

TEXTS = ["The fire, the FIRE!", "a flood; the end", "", None, "\U0001f525 été 3.5"]


@pytest.fixture(scope="module")
def posts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "post_id bigint, tweet string")


def words(t):
    return re.findall(r"[^\W_]+|[^\w\s]|_", ("nan" if t is None else t).lower())


def test_tokens(posts):
    rows = text.tokenize(posts).collect()
    assert rows[0]["tokens"] == ["the", "fire", ",", "the", "fire", "!"]
    assert rows[2]["tokens"] == [] and rows[3]["tokens"] is None
    assert rows[4]["tokens"] == ["\U0001f525", "été", "3", ".", "5"]


def python_vocab(texts, size, min_count=1):
    counts = Counter(w for t in texts if t is not None for w in words(t))
    top = sorted((w for w in counts if counts[w] >= min_count), key=lambda w: (-counts[w], w))
    return {w: i + 4 for i, w in enumerate(top[: size - 4])}


@pytest.mark.parametrize("size, min_count", [(6, 1), (100, 1), (100, 2)])
def test_vocab(posts, size, min_count):
    rows = text.fit_vocab(posts, size, min_count).collect()
    found = {r["token"]: r["id"] for r in rows if r["id"] > 3}
    assert found == python_vocab(TEXTS, size, min_count)
    assert [r["token"] for r in rows if r["id"] < 4] == text.SPECIALS


def expected_ids(t, vocab, max_len):
    body = [vocab.get(w, 1) for w in words(t)][: max_len - 2]
    used = [2, *body, 3]
    return used + [0] * (max_len - len(used)), [1] * len(used) + [0] * (max_len - len(used))


def test_encoding_with_a_vocabulary_too_long_to_send(posts, monkeypatch):
    vocab = text.fit_vocab(posts, 100)
    want = sorted(map(str, text.encode_text(posts, vocab, 8).collect()))
    monkeypatch.setattr(text, "BROADCAST_BYTES", 30)
    monkeypatch.setattr(text, "BROADCAST_ENTRIES", 10)
    assert sorted(map(str, text.encode_text(posts, vocab, 8, lookup="join").collect())) == want
    with pytest.raises(ValueError):
        text.encode_text(posts, vocab, 8)
    with pytest.raises(ValueError):
        text.encode_text(posts, vocab, 8, lookup="guess")


@pytest.mark.parametrize("lookup", text.LOOKUPS)
def test_repeated_ids_stay_apart(spark, posts, lookup):
    vocab = text.fit_vocab(posts, 100)
    rows = spark.createDataFrame(
        [(1, "the fire"), (1, "the fire"), (1, "fire"), (2, None), (None, "the")], "post_id bigint, tweet string"
    )
    encoded = text.encode_text(rows, vocab, 5, lookup=lookup)
    tokens = text.decode_tokens(encoded, vocab, lookup=lookup).collect()
    got = sorted((str(r["post_id"]), [t for t in r["tokens"] if t[:1] != "["]) for r in tokens)
    assert got == [("1", ["fire"]), ("1", ["the", "fire"]), ("1", ["the", "fire"]), ("2", []), ("None", ["the"])]


@pytest.mark.parametrize("max_len", [2, 4, 10])
@pytest.mark.parametrize("lookup, entries", [("batch", 100_000), ("join", 100_000), ("join", 6)])
def test_encoding(posts, monkeypatch, max_len, lookup, entries):
    monkeypatch.setattr(text, "BROADCAST_ENTRIES", entries)
    vocab = text.fit_vocab(posts, 10)
    ids = python_vocab(TEXTS, 10)
    rows = text.encode_text(posts, vocab, max_len, lookup=lookup).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        want = expected_ids(TEXTS[r["post_id"]], ids, max_len)
        assert (r["input_ids"], r["attention_mask"]) == want


@pytest.mark.parametrize("lookup, entries", [("batch", 100_000), ("join", 100_000), ("join", 6)])
def test_decoding(spark, posts, monkeypatch, lookup, entries):
    monkeypatch.setattr(text, "BROADCAST_ENTRIES", entries)
    vocab = text.fit_vocab(posts, 100)
    encoded = text.encode_text(posts, vocab, 10, lookup=lookup)
    rows = text.decode_tokens(encoded, vocab, lookup=lookup).collect()
    first = {r["post_id"]: r["tokens"] for r in rows}[0]
    assert first == ["[CLS]", "the", "fire", ",", "the", "fire", "!", "[SEP]", "[PAD]", "[PAD]"]
    odd = spark.createDataFrame([(1, [2, 999, 3])], "post_id bigint, input_ids array<int>")
    assert text.decode_tokens(odd, vocab, lookup=lookup).first()["tokens"] == ["[CLS]", "", "[SEP]"]


def test_tfidf(posts):
    train = posts.filter("post_id < 3")
    fitted = text.fit_tfidf(train, 3)
    rows = text.tfidf_features(posts, fitted).orderBy("post_id").collect()
    terms = list(python_vocab(TEXTS[:3], 7))
    for r in rows:
        counts = Counter(words(TEXTS[r["post_id"]]))
        want = []
        for term in terms:
            frequency = sum(term in words(t) for t in TEXTS[:3])
            want.append(counts[term] * math.log(4 / (frequency + 1)))
        assert r["text_features"] == pytest.approx(want)


def test_tfidf_model_survives_saving(posts, tmp_path):
    from pyspark.ml import PipelineModel

    fitted = text.fit_tfidf(posts, 4, missing_text="empty")
    fitted.write().overwrite().save(str(tmp_path / "tfidf"))
    again = text.tfidf_features(posts, PipelineModel.load(str(tmp_path / "tfidf")))
    first = text.tfidf_features(posts, fitted)
    assert sorted(map(str, again.collect())) == sorted(map(str, first.collect()))
    assert first.filter("post_id = 3").first()["text_features"] == [0.0] * 4


def test_tfidf_without_tokens(posts):
    with pytest.raises(ValueError):
        text.fit_tfidf(posts.filter("post_id = 2"), 3)
