"""Spelling variants, Merkle manifests and language identification against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from postweave.llm import langid, merkle, queries, variants

# --- spelling variants ------------------------------------------------------------


def deletions(word):
    return {(i, word[:i] + word[i + 1:]) for i in range(len(word))}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    longer, shorter = (a, b) if len(a) > len(b) else (b, a)
    return any(rest == shorter for _, rest in deletions(longer))


def plain_groups(counts, ratio=5):
    found = {}
    for word, n in counts.items():
        mates = [w for w in counts if near(word, w)]
        best = min(mates, key=lambda w: (-counts[w], w), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        found[word] = (form, n, len(mates), counts[form] if form else None)

    def root(word):
        while found[word][0] is not None:
            word = found[word][0]
        return word

    return {w: (f, root(w), n, k, m) for w, (f, n, k, m) in found.items()}


def grouped(spark, counts, **options):
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    return {r.word: tuple(r)[1:] for r in variants.group_variants(words, **options).collect()}


def test_groups_equal_plain_ones(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(120)]
    counts = {}
    for word in base:
        counts[word] = rng.choice([1, 5, 30, 200, 1000])
        for _ in range(3):
            i = rng.randrange(len(word) + 1)
            counts.setdefault(word[:i] + rng.choice("abéz") + word[i + rng.randint(0, 1):], rng.choice([1, 6, 40]))
    counts.pop("", None)
    # Runs of one letter, edits at both ends, a word within a word, a chain and a tie.
    for word, n in [("aaaaaa", 7), ("aaaaa", 7), ("aaaaaaa", 900), ("x" * 300, 2), ("x" * 301, 11), ("x" * 299 + "y", 3),
                    ("tiemaa", 1), ("tiemab", 9), ("tiemac", 9), ("chainw", 1), ("chainww", 5), ("chainwww", 25)]:
        counts[word] = n
    found = grouped(spark, counts)
    assert found == plain_groups(counts)
    assert found["chainw"][1] == "chainwww" and found["tiemaa"][0] == "tiemab"


def test_shuffled_levels_give_the_same_groups(spark, monkeypatch):
    rng = random.Random(4)
    counts = {"".join(rng.choice("abc") for _ in range(6)): rng.randint(1, 100) for _ in range(150)}
    monkeypatch.setattr(variants, "BROADCAST_BYTES", -1)
    assert grouped(spark, counts) == plain_groups(counts)


def test_variants_edges(spark):
    assert grouped(spark, {"single": 4}) == {"single": (None, "single", 4, 0, None)}
    empty = spark.createDataFrame([], "word string, n long")
    assert variants.group_variants(empty).count() == 0
    rows = spark.createDataFrame([("abcdef",)] * 5 + [("abc",)] * 9 + [(None,)], "word string")
    assert [tuple(r) for r in variants.count_words(rows).collect()] == [("abcdef", 5)]


def test_variants_query_counts_like_plain_python(spark, folder, tmp_path):
    runs = Counter()
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            runs[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    kept = {w: n for w, n in runs.items() if len(w) >= 6 and n >= 5}
    assert {r.word: r.n for r in queries.op11_spelling_variants(spark, folder).collect()} == kept
    # Nulls, empty and very long texts, repeated rows and columns of the operator's own names.
    odd = [(None, "Zebras zebras", "w"), (1, None, "w"), (2, "", "w"), (3, "zebras " * 5000, "w"), (3, "zebras " * 5000, "w")]
    spark.createDataFrame(odd, "doc_id long, text string, word string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [(r.word, r.n) for r in queries.op11_spelling_variants(spark, str(tmp_path)).collect()] == [("zebras", 10_002)]


# --- Merkle manifests ---------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_tree(leaves, fanout):
    """The root and, for each leaf, the siblings level by level."""
    proofs, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for i, place in enumerate(at):
            start = place - place % fanout
            proofs[i] += [nodes[j] for j in range(start, min(start + fanout, len(nodes))) if j != place]
        nodes = [digest(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [place // fanout for place in at]
    return nodes[0], proofs


def plain_manifest(rows, fanout):
    groups = {}
    for row in rows:
        groups.setdefault((row[1] is not None, row[1] or ""), []).append(
            ((row[0] is not None, row[0] or 0), plain_leaf(row), row))
    order, tops, found = sorted(groups, key=lambda g: (g[0], g[1].encode())), [], []
    for g in order:
        groups[g].sort(key=lambda x: x[:2])
        tops.append(plain_tree([x[1] for x in groups[g]], fanout))
    root, over = plain_tree([t[0] for t in tops], fanout)
    for g, (top, proofs), upper in zip(order, tops, over):
        found += [(x[2][0], x[1], digest(*proof, *upper), top, root) for x, proof in zip(groups[g], proofs)]
    return sorted(found, key=str)


def sample_rows(n, rng):
    return [(i, rng.choice([None, "", "a", "é", "z" * 5]) if i % 3 else "hot", None if i % 7 == 0 else "en",
             None if i % 5 == 0 else i, rng.choice([None, "", "t\nu", "x" * i])) for i in range(n)]


MERKLE = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("n, fanout, levels", [(1, 3, 2), (2, 3, 1), (40, 3, 1), (83, 3, 1), (200, 2, 1), (200, 4, 2), (30, 3, 7)])
def test_manifest_equals_a_plain_tree(spark, n, fanout, levels):
    rows = sample_rows(n, random.Random(n))
    docs = spark.createDataFrame(rows, MERKLE).repartition(4)
    built = merkle.build_manifest(docs, fanout=fanout, block_levels=levels)
    folded = built.withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof"))).withColumn(
        "siblings", merkle.siblings_digest(F.col("proof"))).collect()
    assert sorted([(r.doc_id, r.leaf, r.siblings, r.subroot, r.root) for r in folded], key=str) == plain_manifest(rows, fanout)
    assert all(r.folded == r.root for r in folded)
    other = digest("another leaf")
    spoiled = built.select(merkle.fold(F.lit(other), F.col("proof")).alias("r"), "root").collect()
    assert all(r.r != r.root for r in spoiled)


def test_manifest_edges(spark):
    rows = [(None, None, None, None, None), (5, "a", "en", 1, "same"), (5, "a", "en", 1, "same"), (5, "a", "de", 1, "same"),
            (None, "a", None, 2, "x" * 200_000), (-1, "", "", 0, "")]
    wide = [(*r, "c", "d") for r in rows]
    docs = spark.createDataFrame(wide, MERKLE + ", leaf string, _tree string")
    built = merkle.build_manifest(docs, carry={"extra": F.col("leaf"), "root": F.lit("no")})
    assert built.columns == ["doc_id", "leaf", "proof", "subroot", "root", "extra"]
    found = built.withColumn("s", merkle.siblings_digest(F.col("proof"))).collect()
    assert sorted([(r.doc_id, r.leaf, r.s, r.subroot, r.root) for r in found], key=str) == plain_manifest(rows, 3)
    assert {r.extra for r in found} == {"c"}
    assert merkle.build_manifest(docs.filter("false")).count() == 0
    hot = spark.createDataFrame([(7, "s", "en", 1, "copy")] * 500, MERKLE).repartition(5)
    rows = merkle.build_manifest(hot, block_levels=2).collect()
    assert sorted([(r.doc_id, r.leaf, r.subroot, r.root) for r in rows]) == sorted(
        [(a, b, d, e) for a, b, _, d, e in plain_manifest([(7, "s", "en", 1, "copy")] * 500, 3)])


# --- language identification ----------------------------------------------------------


def test_gradient_is_the_numeric_one():
    rng = np.random.default_rng(1)
    net = langid.init_network(3, hidden=4, embed=3, seed=2)
    windows = [b"abcab", b"c", b"bb\xc3\xa9", b"cabbage"]
    codes, mask = langid._padded(windows)
    labels = np.array([0, 2, 1, 1])
    _, grad = langid.loss_and_gradient(net, codes, mask, labels)
    for name, values in net.items():
        for _ in range(12):
            at = (int(rng.choice([97, 98, 99, 0xc3])), *[int(rng.integers(k)) for k in values.shape[1:]]) if name == "E" else tuple(
                int(rng.integers(k)) for k in values.shape)
            kept, moved = values[at], []
            for step in (1e-5, -1e-5):
                values[at] = kept + step
                moved.append(langid.loss_and_gradient(net, codes, mask, labels)[0])
            values[at] = kept
            assert abs((moved[0] - moved[1]) / 2e-5 - grad[name][at]) < 1e-8


def plain_scores(net, text, window):
    """Mean of position probabilities, one byte at a time."""
    h, total = net["U"].shape[1], np.zeros(len(net["b"]))
    for at in range(0, len(text), window):
        piece, states = text[at:at + window], []
        for d in range(2):
            state, own = np.zeros(h), []
            for c in piece if d == 0 else reversed(piece):
                x, u = net["E"][c] @ net["W"][d] + net["c"][d], state @ net["U"][d]
                z, r = (1 / (1 + np.exp(-(x[i * h:i * h + h] + u[i * h:i * h + h]))) for i in range(2))
                state = z * state + (1 - z) * np.tanh(x[2 * h:] + r * u[2 * h:])
                own.append(state)
            states.append(own if d == 0 else own[::-1])
        for f, b in zip(*states):
            logits = f @ net["V"][0] + b @ net["V"][1] + net["b"]
            shares = np.exp(logits - logits.max())
            total += shares / shares.sum()
    return total / len(text)


def test_scores_equal_plain_ones():
    net, rng = langid.init_network(4, hidden=5, seed=7), random.Random(5)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (1, 15, 16, 17, 100, 333)]
    flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for group in (3, 1000):
        found = langid.Scorer(net).documents(flat, offsets, window=16, group=group)
        assert np.abs(found - np.array([plain_scores(net, t, 16) for t in texts])).max() < 1e-5


def test_language_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    lang = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = queries.op13_language_id(spark, folder).join(lang, "doc_id").collect()
    assert len(rows) == lang.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    texts = [(i, "the cat and the hat" if i % 2 else "der hund und die katze", "en" if i % 2 else "de") for i in range(40)]
    odd = [(None, "the cat", None), (50, None, "en"), (51, "", "en"), (52, "12 345 .", "en"), (53, "the cat and " * 20_000, None)]
    wide = [(*r, "x", 1.0) for r in texts + odd]
    docs = spark.createDataFrame(wide, "doc_id long, text string, lang string, lang_pred string, score double")
    model = langid.fit_languages(docs, epochs=60)
    assert model["names"] == ["de", "en"]
    # Copies of a text count once in the sample.
    assert langid.training_windows(docs).count() == 2
    found = langid.identify_languages(docs, model, carry={"score": F.lit(9.0), "size": F.length("text")})
    assert found.columns == ["doc_id", "size", "lang_pred", "score"]
    rows = {r.doc_id: r for r in found.collect()}
    assert len(rows) == 45 and {rows[i].lang_pred for i in (50, 51, 52)} == {"und"} and rows[51].score == 0
    assert rows[1].lang_pred == rows[53].lang_pred == "en" and rows[0].lang_pred == "de"
    blank = langid.fit_languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.identify_languages(docs, blank).collect()} == {"und"}
    assert langid.identify_languages(docs.filter("false"), model).count() == 0
    assert langid.fit_languages(docs.filter("false"))["names"] == []
