"""Every corpus query against its SQL or against a plain Python version."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import compare
from postweave.llm import chat, licenses, minhash, mixing, pieces, pii, quality, queries, urls, warc
from postweave.llm.notices import NOTICES
from postweave.session import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(folder):
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{folder}/documents.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, folder, name):
    assert compare.differences(queries.QUERIES[name](spark, folder), compare.connect(folder), name) == []


def base_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    found = []
    for phrase, label in licenses.BASE_PHRASES.items():
        parts = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i:i + len(parts)] == parts]
    return words, found


def test_license_scan(spark, folder, texts):
    rows = {r.doc_id: r for r in queries.op4_license_scan(spark, folder).collect()}
    assert len(rows) == len(texts)
    for doc_id, text, _ in texts:
        words, found = base_places(text)
        r, at = rows[doc_id], [i for i, _ in found]
        labels = sorted({x for _, x in found})
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(found), ",".join(labels))
        assert (r.first_word, r.last_word) == ((min(at), max(at)) if at else (None, None))
        assert set(labels) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_license_method_finds_notices(spark):
    noise = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor"
    rows = [(i, f"{noise}. {n.text}. {noise}") for i, n in enumerate(NOTICES)]
    rows += [(100 + i, noise) for i in range(400)]
    rows += [(900, "apache license apache license gnu general public license cc by-sa")]
    found = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, n in enumerate(NOTICES):
        assert n.label in found[i].labels.split(","), n.label
        assert found[i].score > 0.5
    assert all(found[100 + i].labels == "" and found[100 + i].score == 0 for i in range(400))
    assert (found[900].n_base, found[900].first_word, found[900].last_word) == (4, 0, 8)


def test_license_notice_in_a_third_of_the_rows(spark):
    """A notice is found however common it is, and in a table of two rows that both carry it."""
    noise = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor"
    for n, every, label in ((90, 3, "apache-2.0"), (90, 3, "mit"), (90, 3, "lgpl"), (2, 1, "bsd")):
        text = next(x.text for x in NOTICES if x.label == label)
        rows = [(i, f"{noise}. {text}. {noise}" if i % every == 0 else noise) for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        for r in licenses.scan_licenses(docs).collect():
            if r.doc_id % every:
                assert (r.labels, r.score) == ("", 0)
            else:
                assert label in r.labels.split(",") and r.score == 1


def test_license_file_with_all_notices(spark):
    """Every notice of a file is found, however many words of other notices stand in it."""
    notices = ". ".join(n.text for n in NOTICES)
    rows = [(0, notices)] + [(i, "lorem ipsum dolor sit amet this is not the last of the words") for i in range(1, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = licenses.scan_licenses(docs).filter("doc_id = 0").first()
    assert set(found.labels.split(",")) >= {n.label for n in NOTICES}


def plain_notices(texts, notices, min_share):
    """{id: {label: share}}: the scan in plain Python, window by window."""
    files = {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
             for i, t in texts}
    df = Counter(w for words in files.values() for w in set(words))
    out = {i: {} for i in files}
    for n in notices:
        words = n.words
        ranked = sorted(set(words), key=lambda w: (df[w], w))
        rare = set(ranked[:min(16, max(2, (len(ranked) + 1) // 2))])
        probes = [p for p, w in enumerate(words) if w in rare]
        width = 1 + len(words) // 16
        half = (width + 1) // 2 if width > 1 else 0
        for i, file in files.items():
            stands = lambda p, o: 0 <= p + o < len(file) and file[p + o] == words[p]
            lows = range(-(len(words) // width + 2) * width, len(file) + width, width)
            for low in sorted({*lows, *(x - half for x in lows)}):
                window = range(low, low + width)
                hits = sum(any(stands(p, o) for o in window) for p in probes)
                if (hits >= 2 and hits / len(probes) >= min_share
                        and all(any(all(stands(p, o) for p in at) for o in window) for at in n.phrases)):
                    out[i][n.label] = max(out[i].get(n.label, 0), hits / len(probes))
    return out


def test_license_scan_against_plain_python(spark):
    """Whole, cut, shuffled, gapped and doubled notices: the same labels and scores."""
    rng = random.Random(11)
    noise = "the of to software license copy and free lorem ipsum public version under work".split()
    rows = [(0, None), (1, ""), (2, "our product is not compatible with the GNU lesser general public license"),
            (3, "the Mozilla Public License is a text we discuss, and so is the GNU General Public License, version 3")]
    for n in NOTICES:
        words = n.words
        forms = [words, words[len(words) // 3:], words[:2 * len(words) // 3], rng.sample(words, len(words)), words + noise[:3] + words]
        for gaps in (1, 3):
            form = list(words)
            for _ in range(gaps):
                form.insert(rng.randrange(len(form)), rng.choice(noise))
            forms.append(form)
        forms.append([w for w in words if rng.random() > 0.15])
        for form in forms:
            around = rng.choices(noise, k=rng.randrange(30))
            rows.append((len(rows), " ".join([*around, *form, *rng.choices(noise, k=rng.randrange(30))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = plain_notices(rows, NOTICES, licenses.MIN_SHARE)
    found = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        base = {label for _, label in base_places(text or "")[1]}
        assert set(filter(None, found[i].labels.split(","))) == base | set(expected[i]), text
        assert found[i].score == pytest.approx(max([0.5] * bool(base) + list(expected[i].values()) or [0])), text
    # Texts that only mention a licence, and the words of notices in another order, have no label but base ones.
    shuffled = [i for k in range(len(NOTICES)) for i in [4 + 8 * k + 3]]
    assert not any(expected[i] for i in [2, 3, *shuffled])
    assert sum(bool(x) for x in expected.values()) > 3 * len(NOTICES)


def test_license_scan_has_no_python_and_no_cross_join(spark, folder):
    plan = queries.op4_license_scan(spark, folder)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|CartesianProduct|BroadcastNestedLoopJoin", plan)


PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 13 <= len(digits) <= 19 and pii.luhn(digits)
                    or kind == "phone" and 9 <= len(digits) <= 15):
                found.append((kind, *m.span()))
    return found


def test_base_spans_like_the_patterns(texts):
    rng = random.Random(5)
    made = ["".join(rng.choice("aZ09.@ +-()_%1") for _ in range(rng.randint(0, 50))) for _ in range(5000)]
    for text in [t for _, t, _ in texts] + made:
        assert pii.base_spans(text) == plain_spans(text)


def test_personal_data_query(spark, folder, texts):
    rows = {r.doc_id: r for r in queries.op7_personal_data(spark, folder).collect()}
    assert len(rows) == len(texts)
    for doc_id, text, _ in texts:
        base = plain_spans(text)
        assert [rows[doc_id][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        assert set(pii.joined(base).split(",")) <= set(rows[doc_id].spans.split(","))


def unseen_forms(kind, span):
    """Forms that the trainer does not make."""
    d = re.sub("[^0-9]", "", span)
    return {"email": [span.replace("@", " [at]"), span.replace("@", "(at) ")], "ip": [span.replace(".", "[.]", 1)],
            "card": ["/".join([d[:4], d[4:8], d[8:12], d[12:]])] if len(d) == 16 else [],
            "phone": [f"({d[-10:-7]}) {d[-7:-4]}.{d[-4:]}", f"{d[-10:-7]} {d[-7:-4]} {d[-4:]}"] if len(d) >= 10 else []}[kind]


def test_field_on_held_out_spans():
    """Fitted on half of the documents with spans; rewritten spans of the rest are held out, in known and in unseen forms."""
    texts = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.1/documents.parquet' WHERE doc_id < 4000 ORDER BY doc_id").fetchall()
    held = [t for i, t in texts if i % 2 and plain_spans(t)]
    field = pii.fit_field([t for i, t in texts if i % 2 == 0 and plain_spans(t)][:100])
    rng, found_of, all_of, false, clean = random.Random(1), Counter(), Counter(), 0, 0
    for text in held:
        for kind, s, e in plain_spans(text):
            forms = [(o, label, "known") for o, label in pii.rewritten(kind, text[s:e], rng)]
            for other, label, known in forms + [(o, kind, "unseen") for o in unseen_forms(kind, text[s:e])]:
                made = f"before it {other} and after"
                found = pii.added_spans(field, made, pii.base_spans(made), pii.MARGIN)
                if label:
                    all_of[kind, known] += 1
                    found_of[kind, known] += (kind, 10, 10 + len(other)) in found
                else:
                    false, clean = false + bool(found), clean + 1
    assert len(all_of) == 8 and all(found_of[k] >= 0.9 * n for k, n in all_of.items()) and false <= 0.02 * clean


def test_windows_do_not_cut_words():
    field = pii.fit_field([])
    for left, right in ((45, 7), (50, 50), (500, 300)):
        text = "mail " + "x" * left + "[at]" + "y" * right + ".com now"
        assert ("email", 5, len(text) - 4) in pii.added_spans(field, text, [], -100.0)
    rng = random.Random(2)
    for _ in range(300):  # every token of a window's stretch is decided by one window
        text = "".join(rng.choice("a1@. \n") for _ in range(rng.randint(0, 400)))
        starts = [w.bounds[s][0] for w, low, high in pii.windows(text) for s in range(low, high)]
        assert len(starts) == len(set(starts))
        assert {m.start() for m in pii.TRIGGER.finditer(text)} <= {a for w, _, _ in pii.windows(text) for a, b in w.bounds for a in range(a, b)}


def targets_of(sizes, most=3):
    """Targets in plain Python: shared by weight, none above three times its size."""
    weights, capped, targets = [1 + i % 3 for i in range(len(sizes))], set(), [0.0] * len(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = sum(sizes) - sum(most * sizes[i] for i in capped)
        for i in free:
            targets[i] = rest * weights[i] / sum(weights[k] for k in free)
        over = [i for i in free if targets[i] > most * sizes[i]]
        if not over:
            return targets
        for i in over:
            targets[i] = float(most * sizes[i])
        capped.update(over)


def test_mixing_targets_and_permutation(spark):
    def found(names, sizes):
        made = mixing.source_targets(spark.createDataFrame(list(zip(names, sizes)), "_source string, _source_size long"))
        return [r._target for r in sorted(made.collect(), key=lambda r: r._index)]

    assert found("abc", [100, 100, 100]) == [50, 100, 150]
    # b stops at three times its size; the others share the rest 1 to 3. Null comes last.
    assert found(["a", "b", None], [1000, 10, 1000]) == [495, 30, 1485]
    rng = random.Random(3)
    sizes = [int(10 ** rng.uniform(0, 7)) for _ in range(3000)]
    names = [f"s{i:05d}" for i in range(3000)]
    assert found(names, sizes) == pytest.approx(targets_of(sizes))
    for n in (1, 2, 3, 10, 100, 1000):
        key = np.full(n, 7, dtype=np.uint64)
        assert sorted(mixing.permuted(np.arange(n), n, key).tolist()) == list(range(n))


def test_mixing_query(spark, folder, texts):
    rows = queries.op3_mixing(spark, folder).collect()
    again = queries.op3_mixing(spark, folder).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    sizes, source = {i: len(WORD.findall(t or "")) for i, t, _ in texts}, {i: s for i, _, s in texts}
    total = Counter()
    for i, n in sizes.items():
        total[source[i]] += n
    names = sorted(total)
    target = dict(zip(names, targets_of([total[s] for s in names])))
    taken = Counter()
    for r in rows:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (sizes[r.doc_id], total[s]) and abs(r.target - target[s]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK_WORDS for s in names)


def test_mixing_repeated_rows_and_many_sources(spark):
    """Equal rows are documents of their own in one run, and each source of thousands meets its target."""
    same = [(None, "", "x")] * 30_000 + [(7, "one two three four five", "x")] * 25_000
    rows = same + [(100 + i, "w " * (1 + i % 400), f"s{i % 4000}") for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    report = mixing.mix_report(docs).collect()
    assert len(report) == len(rows) and sorted(map(tuple, report), key=str) == sorted(map(tuple, mixing.mix_report(docs).collect()), key=str)
    assert sum(r.doc_id == 7 for r in report) == 25_000
    taken, target = Counter(), {}
    for r in report:
        assert 0 <= r.taken <= 3 * r.size
        key = "x" if r.doc_id in (None, 7) else f"s{(r.doc_id - 100) % 4000}"
        taken[key] += r.taken
        target[key] = r.target
    assert len(target) == 4001 and all(abs(taken[k] - target[k]) <= 2 * mixing.BLOCK_WORDS for k in target)


def test_mixing_shards_look_alike(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    slots = mixing.Mix(docs, shards=8).slots.toPandas()
    counts = slots.groupby(["_index", "_shard"]).size().unstack(fill_value=0)
    assert counts.shape[1] == 8 and sorted(slots[slots._index == 0]._slot) == list(range(int(counts.loc[0].sum())))
    even = counts.sum(axis=1).to_numpy()[:, None] / 8
    assert (np.abs(counts.to_numpy() - even) <= 6 * np.sqrt(even) + 1).all()


def test_mixed_documents_take_what_the_report_says(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    report = {r.doc_id: r for r in mixing.mix_report(docs).collect()}
    words = Counter()
    for r in mixing.mix_documents(docs).collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert {i: n for i, n in words.items()} == {i: r.taken for i, r in report.items() if r.taken}
    blocks = Counter()
    for r in mixing.mixed_blocks(docs).collect():
        blocks[r.doc_id] += r.words
    assert blocks == words


@pytest.mark.parametrize("limit", [2_000_000, 400])
def test_near_components_in_parts(spark, limit):
    """Chains and stars of near copies, in clusters that fit one task and in clusters cut in parts."""
    rng, rows = random.Random(2), []
    for group in range(4):
        base = [f"g{group}w{k}" for k in range(60)]
        for copy in range(25):
            words = list(base)
            for k in rng.sample(range(60), rng.choice([0, 1, 2, 3])):
                words[k] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(words)))
    drift = [f"d{k}" for k in range(80)]
    for step in range(30):  # a chain: neighbours are linked, ends are not
        drift = drift[3:] + [f"n{step}-{k}" for k in range(3)]
        rows.append((len(rows), " ".join(drift)))
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: r for r in minhash.near_components(docs, part_shingles=limit).collect()}
    assert {i: r.component_id for i, r in found.items()} == {i: find(i) for i in sets}
    assert all(found[i].n_shingles == len(sets[i]) for i in sets)


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    for n in (1, 3, 40, 400, 5000):
        a = np.unique(rng.integers(0, 2**63, size=n, dtype=np.uint64))
        assert len(minhash.sketch(a)) == minhash.COORDINATES
        b = np.unique(np.concatenate([a[: max(1, 3 * len(a) // 4)], rng.integers(0, 2**63, size=len(a) // 8, dtype=np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((minhash.sketch(a) == minhash.sketch(b)).mean() - true) < 0.2


def test_components_of_paths_and_stars(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 200)]
    found = {r.node: r.root for r in minhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {found[k] for k in [*range(1, 41), 200]} == {0} and {found[k] for k in range(101, 140)} == {100}


def test_quality_cross_document_lines(spark):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, f"Cookie Notice \n{body(i)}" if i % 2 else f"COOKIE notice\n{body(i)}", "h") for i in range(100)]
    rows += [(200 + i, "\n".join(" ".join(f"s{k}x{m}" for m in range(9)) for k in range(8)) + f"\nunique{i}", "h")
             for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r for r in quality.score_quality(docs).collect()}
    assert all(found[i].kept for i in range(100))
    assert found[200].kept and not any(found[200 + i].kept for i in range(1, 100))
    clean = {r.doc_id: r.text for r in quality.filter_quality(docs, chars_col=None).collect()}
    assert clean[0].startswith("COOKIE") and clean[5] == body(5)


def test_quality_filter_keeps_each_frequent_line_once(spark):
    """Two overlapping groups whose first homes would be depleted, and a short page with the smallest id."""
    line = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    shared, own, notice = line("shared", 60), line("own", 40), line("notice", 9)
    rows = [(0, notice, "h"), (1, f"{shared}\n{line('early', 50)}", "h")]
    rows += [(10 + i, f"{shared}\n{own}", "h") for i in range(30)]
    rows += [(100 + i, f"{notice}\n{line(f'w{i}x', 60)}", "h") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(2)
    kept = [r.text.split("\n") for r in quality.filter_quality(docs, chars_col=None).collect()]
    assert [sum(x in text for text in kept) for x in (shared, own, notice)] == [1, 1, 1]


def test_pieces_are_reproducible_and_sampled(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(40)
    one = {r.doc_id: r.piece_ids for r in pieces.encode(docs).collect()}
    two = {r.doc_id: r.piece_ids for r in pieces.encode(docs.repartition(5)).collect()}
    other = {r.doc_id: r.piece_ids for r in pieces.encode(docs, seed=1).collect()}
    assert one == two and sum(one[i] != other[i] for i in one) > 20
    back = pieces.decode(pieces.encode(docs, keep=["doc_id", "text"]).withColumnRenamed("text", "original"))
    assert back.filter("text <> original").count() == 0


def test_sampling_follows_path_weights():
    """Frequencies of sampled segmentations against the exact probabilities of all paths."""
    vocabulary = {"pieces": {"▁": 10, "a": 3, "b": 4, "ab": 5, "▁a": 6, "ba": 7, "aba": 8}, "bytes": list(range(20, 276)), "size": 300}
    lattice = pieces.Lattice(vocabulary, 1.0)
    weight, text = lattice.weight, "▁aba"

    def paths(at):
        if at == len(text):
            return [((), 1.0)]
        return [((text[at:e], *rest), weight[text[at:e]] * w) for e in range(at + 1, len(text) + 1) if text[at:e] in weight
                for rest, w in paths(e)]

    exact = {tuple(vocabulary["pieces"][p] for p in path): w for path, w in paths(0)}
    z, n = sum(exact.values()), 40_000
    drawn = Counter(tuple(x.tolist()) for x in pieces.encode_texts(lattice, ["aba"] * n, [pieces.row_key(0, i) for i in range(n)]))
    assert set(drawn) <= set(exact)
    for path, w in exact.items():
        assert abs(drawn[path] / n - w / z) < 0.01


@pytest.mark.parametrize("alpha", [0.5, 1.0, 3.0])
def test_sampling_after_many_rare_characters(alpha):
    """The tail's frequencies after a long lead are those of its paths: the lead's single way carries over."""
    vocabulary = {"pieces": {"▁": 30_000, "a": 3, "b": 4, "ab": 5, "ba": 7, "aba": 8, **{chr(0x4e00 + i): 20_000 + i for i in range(8)}},
                  "bytes": list(range(31_000, 31_256)), "size": 32_000}
    lattice = pieces.Lattice(vocabulary, alpha)
    lattice.weights[:len(lattice.weight)] = [(i + 1.0) ** -alpha for i in lattice.ids[:len(lattice.weight)]]
    weight, tail = {name: (i + 1.0) ** -alpha for name, i in vocabulary["pieces"].items()}, "abaab"

    def paths(at):
        if at == len(tail):
            return [((), 1.0)]
        return [((vocabulary["pieces"][tail[at:e]], *rest), weight[tail[at:e]] * w) for e in range(at + 1, len(tail) + 1)
                if tail[at:e] in weight for rest, w in paths(e)]

    exact = dict(paths(0))
    z, n = sum(exact.values()), 6000
    rare = "".join(chr(0x4e00 + i % 8) for i in range(300)) + "\U0001f600" * 80
    table = pieces.Filtered(lattice, ["▁" + rare + tail])
    assert np.isfinite(table.shares).all()
    found = pieces.encode_texts(lattice, [rare + tail] * n, [pieces.row_key(0, i) for i in range(n)])
    drawn = Counter(tuple(x.tolist()[1 + 300 + 320:]) for x in found)
    assert set(drawn) <= set(exact)
    for path, w in exact.items():
        assert abs(drawn[path] / n - w / z) < 0.03


def test_kept_tables_draw_the_same(monkeypatch):
    vocabulary = pieces.load_vocabulary()
    lattice, rng = pieces.Lattice(vocabulary, 1.0), random.Random(9)
    words = ["".join(rng.choice("abcdé漢") for _ in range(rng.randint(1, 30))) for _ in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(60)]
    alone = [pieces.encode_texts(lattice, [t], [i])[0].tolist() for i, t in enumerate(texts)]
    for most in (0, 500, 10 ** 6):
        tables, monkeyed = pieces.Tables(lattice, most), []
        for start in range(0, 60, 7):
            monkeyed += pieces.encode_texts(lattice, texts[start:start + 7], list(range(start, min(start + 7, 60))), tables)
        assert [x.tolist() for x in monkeyed] == alone


def test_places_are_looked_up_as_far_as_pieces_end_like_that(monkeypatch):
    vocabulary = pieces.load_vocabulary()
    lattice, rng, asked = pieces.Lattice(vocabulary, 1.0), random.Random(6), []
    words = ["▁" + "".join(rng.choice("qzxjkvwpé7漢") for _ in range(60)) for _ in range(50)] + ["▁information", "▁the\n", "▁", "a" * 40]
    find = lattice.find
    monkeypatch.setattr(lattice, "find", lambda hashes: asked.append(len(hashes)) or find(hashes))
    table = pieces.Filtered(lattice, words)
    weights, at = {**vocabulary["pieces"], **{chr(pieces.BYTE_BASE + b): i for b, i in enumerate(vocabulary["bytes"])}}, 0
    for word in lattice.spelled(words):
        for p in range(len(word)):
            want = {k: weights[word[p - k:p + 1]] for k in range(min(p + 1, pieces.MAX_PIECE)) if word[p - k:p + 1] in weights}
            assert {k: table.ids[e] for k, e in enumerate(table.entries[at]) if lattice.weights[e] > 0} == want
            at += 1
    assert at == len(table.entries) and sum(asked) < 6 * at


def test_lossless_for_any_text():
    vocabulary = pieces.load_vocabulary()
    lattice, decoder, rng = pieces.Lattice(vocabulary, 1.0), pieces.Decoder(vocabulary), random.Random(4)
    made = ["", " ", "  a", "▁▁ x▁", "\n\n\t", "<s></s><0x41><unk>", "\x00é漢\U0001f600", "a" * 70_000, " " * 300]
    made += ["".join(rng.choice("ab ▁\né漢\U0001f600<>01") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    for text, ids in zip(made, pieces.encode_texts(lattice, made, list(range(len(made))))):
        assert decoder.text(ids.tolist()) == text


def test_warc_long_headers_and_damage(spark):
    """URLs beyond any chunk are read back; damaged bytes cost the record that they lie in, no other one."""
    rng = random.Random(6)
    hard = "http://h/" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(2 << 20))
    rows = [(1, hard, "<p>1</p>" * 400, "x", 1), (2, "http://two", None, "x", 1), (3, hard[:-1], "y" * 900, "x", 1),
            (4, "http://four", "z" * 5000, "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, file string, offset long").coalesce(1)
    path = scratch_path(spark, "warc")
    warc.write_warc(warc.assign_revisits(pages), path).collect()
    for split_bytes in (1 << 16, 1 << 20, 1 << 30):
        found = {r.page_id: r for r in warc.read_warc(spark, path, split_bytes=split_bytes).collect()}
        assert {i: (r.url, r.payload.decode()) for i, r in found.items()} == {r[0]: (r[1], r[2] or "") for r in rows}
    offsets = sorted((r.offset, r.page_id) for r in found.values())
    file = found[1].file
    data = bytearray(open(file, "rb").read())
    hurt = next(i for (at, i) in offsets if i == 3)
    place = dict((i, at) for at, i in offsets)[hurt] + 5000
    data[place:place + 64] = b"\x00" * 64
    with open(file, "wb") as out:
        out.write(data)
    import os
    crc = os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc")
    assert not os.path.exists(crc)
    for split_bytes in (1 << 16, 1 << 30):
        assert sorted(r.page_id for r in warc.read_warc(spark, path, split_bytes=split_bytes).collect()) == [1, 2, 4]


def test_warc_round_trip(spark):
    same = "x" * 2000
    rows = [(1, "http://a/\r\nb", same), (2, None, same), (3, "http://c", same), (4, "http://d", None), (5, "u", "short"),
            (6, "u", "short"), (None, "n", same), (3, "again", same)] + [(100 + i, f"http://p/{i}", f"<p>{i}</p>" * 300) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("html", "html").repartition(3)
    path = scratch_path(spark, "warc")
    files = warc.write_warc(warc.assign_revisits(pages), path).collect()
    assert sum(f.records for f in files) == len(rows)
    whole = warc.read_warc(spark, path, split_bytes=1 << 30).orderBy("file", "offset").collect()
    for size in (200, 700, 5000):
        assert warc.read_warc(spark, path, split_bytes=size).orderBy("file", "offset").collect() == whole
    assert all(r.block_digest_ok for r in whole)
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in whole if (r.page_id or 0) < 100)
    assert kinds == Counter({(1, "revisit", 3): 1, (2, "revisit", 3): 1, (3, "response", None): 2, (4, "response", None): 1,
                             (5, "response", None): 1, (6, "response", None): 1, (None, "revisit", 3): 1})
    back = {r.page_id: bytes(r.payload).decode() for r in warc.resolve_revisits(warc.read_warc(spark, path)).collect()}
    assert back[1] == same and back[4] == "" and back[130] == "<p>30</p>" * 300


def test_warc_skips_false_magic_and_damage(tmp_path):
    import gzip
    import hashlib as h
    import io

    good = warc._record(1, "u", b"hello", h.sha1(b"hello").hexdigest(), 5, None)
    data = warc.MAGIC + b"junk" + gzip.compress(b"no record") + good + b"\x00" + warc.MAGIC + good[:-9] + good
    rows = list(warc.records_in(io.BytesIO(data), "f", 0, len(data), len(data)))
    assert [r["page_id"] for r in rows] == [1, 1]


def test_urls_against_plain_rules(spark):
    rng, hosts = random.Random(6), ["a.net", "net", "x.example.net", "example.com", "org", "b.org", "notnet", ""]
    made = [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en', '/de/x', '/fr/y/z', '/a//b/'])}{rng.choice(['', '?q=/en/', '#/de/'])}"
            for _ in range(300)] + [None, "no scheme", "HTTP://A.NET/EN/", "http://x.net" + "/a" * 3000]
    rules = [*queries.RULES, ("a.net", "/a//", "allow"), ("b.org", "/", "block")]
    pages = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    found = {r.page_id: r for r in urls.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    for i, url in enumerate(made):
        rest = (url or "").partition("://")[2]
        place = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(place):])[0]
        host = place.lower()
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits)[1:] if fits else (None, "allow")
        assert (found[i].host, found[i].path, found[i].rule, found[i].verdict) == (host, path, *want)


def test_chat_parts_and_escapes(spark):
    texts = ["plain", "<|end|>", "<\\|end|>", "a<", "|x", "<|turn|>user<|body|>", "<\\\\|", "\n", ""]
    rows = [(1, i, "assistant" if i % 2 else "user<|body|>", t) for i, t in enumerate(texts)]
    rows += [(None, None, None, None), (2, 1, "assistant", "b"), (2, 1, "assistant", "a"), (2, None, "user", "last")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    joined = chat.join_turns(chat.format_turns(turns))
    for r in chat.read_turns(joined).collect():
        want = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1] is None, x[1], x[2], x[3]))]
        assert [(t.role, t.text) for t in r.turns] == want
    for r in joined.collect():
        masked = [r.formatted[s.start:s.end] for s in r.loss_spans]
        assert len(masked) == len(r.loss_turns)
    parts = spark.sql("""SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, array(
        named_struct('kind', 'text', 'text', 'see <|image:1|>', 'ref', null, 'units', 0),
        named_struct('kind', 'image', 'text', null, 'ref', 's3://a.png', 'units', 2),
        named_struct('kind', 'text', 'text', ' and ', 'ref', null, 'units', 0),
        named_struct('kind', 'document', 'text', null, 'ref', 'b.pdf', 'units', 3)) AS parts""")
    r = chat.join_turns(chat.format_turns(parts, parts=parts["parts"].cast(chat.PART_TYPE))).first()
    assert r.formatted == "<|turn|>user<|body|>see <\\|image:1|><|image:1|> and <|document:3|><|end|>"
    assert [(a.place, a.part, a.kind, a.ref, a.tokens) for a in r.attachments] == [
        (1, 1, "image", "s3://a.png", 512), (1, 3, "document", "b.pdf", 1536)] and r.expanded_tokens == 2048
    # Equal parts, and several turns: every placeholder has its attachment.
    twice = parts.union(parts.withColumn("turn", F.lit(1).cast("long"))).withColumn("parts", F.concat("parts", F.slice("parts", 2, 1), F.slice("parts", 2, 1)))
    r = chat.join_turns(chat.format_turns(twice, parts=F.col("parts").cast(chat.PART_TYPE))).first()
    turns = r.formatted.split("<|end|>")[:2]
    shown = [(t, int(m[2]), m[1]) for t, text in enumerate(turns, 1) for m in re.finditer(r"<\|(\w+):(\d+)\|>", text)]
    assert shown == [(a.place, a.part, a.kind) for a in r.attachments] and len(shown) == 8


def test_pipeline_keeps_one_of_each_group(spark, folder, texts):
    import corpus_pipeline as line

    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in line.STAGES[:3]:
        docs = line.stored(stage(spark, docs, folder), "t")
        kept.append({r.doc_id for r in docs.collect()})
    good = {r.doc_id for r in quality.score_quality(spark.read.parquet(f"{folder}/documents.parquet")).collect() if r.kept}
    assert kept[0] == good and kept[2] <= kept[1] <= kept[0]
    groups = defaultdict(set)
    for i, t, _ in texts:
        if i in kept[0]:
            groups[re.sub(r"[\x20\x09-\x0D]", "", t)].add(i)
    assert len(kept[1]) == len({min(g) for g in groups.values()})
