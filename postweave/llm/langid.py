"""Language identification by a bidirectional gated recurrent network over bytes.

Network. Every byte has a vector; one gated recurrent layer reads a window from the left, another one from the right,
and a softmax layer on both states labels every position with a language. A text is cut into windows of ``window``
bytes, each of which starts from the zero state; the document's probabilities are the mean over all of its
positions, so every byte of every text has its part in them.

Training, in numpy by backpropagation through time: cross entropy at every position, Adam, a clipped norm. The network is
fitted on a bounded sample: per language ``train_docs`` distinct texts, those with the smallest hash of the text, and of each
``train_windows`` windows, for at most ``max_languages`` languages (the most frequent ones). The driver gets these windows only.

Scoring. Windows of many texts run side by side, longest first, one position of all of them at a time;
a group has at most ``GROUP`` windows, so its memory does not grow with a text. The byte vectors meet the input weights
once, in a table of 256 rows per direction.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so is every text if no row has a
language. A tie goes to the language that comes first by name. Repeated rows are scored alike and count once in the
sample; a null id is scored like any other; texts of any length are read whole; empty tables give empty
results. Extra columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postweave.llm.common import text_of

UNKNOWN = "und"
WINDOW = 128
HIDDEN = 8
EMBED = 8
MAX_LANGUAGES = 64
TRAIN_DOCS = 160
TRAIN_WINDOWS = 4
EPOCHS = 8
BATCH = 128
RATE = 0.02
CLIP = 1.0
#: Windows that are scored side by side.
GROUP = 2048


def init_network(classes: int, hidden: int = HIDDEN, embed: int = EMBED, seed: int = 0) -> dict[str, np.ndarray]:
    """Byte vectors E; input weights W, recurrent weights U, offsets c and output weights V of both directions; b."""
    rng = np.random.default_rng(seed)
    return {"E": rng.normal(0, 0.3, (256, embed)), "W": rng.normal(0, embed ** -0.5, (2, embed, 3 * hidden)),
            "U": rng.normal(0, hidden ** -0.5, (2, hidden, 3 * hidden)), "c": np.zeros((2, 3 * hidden)),
            "V": rng.normal(0, hidden ** -0.5, (2, hidden, classes)), "b": np.zeros(classes)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def loss_and_gradient(net: dict, codes: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
    """Mean cross entropy over all positions and its gradient. ``codes`` and ``mask``: places x windows,
    ``labels``: the class of each window. Both directions take a step at once; the second reads backward."""
    places, count = codes.shape
    h, U, V = net["U"].shape[1], net["U"], net["V"]
    both, there = np.stack([codes, codes[::-1]], axis=1), np.stack([mask, mask[::-1]], axis=1)[..., None]
    inputs = np.einsum("ve,dek->dvk", net["E"], net["W"]) + net["c"][:, None]
    state = np.zeros((2, count, h))
    states, steps = np.empty((places, 2, count, h)), []
    side = np.arange(2)[:, None]
    for t in range(places):
        x, u = inputs[side, both[t]], state @ U
        gates = _sigmoid(x[..., :2 * h] + u[..., :2 * h])
        z, r = gates[..., :h], gates[..., h:]
        new = np.tanh(x[..., 2 * h:] + r * u[..., 2 * h:])
        steps.append((state, z, r, new, u[..., 2 * h:]))
        state = states[t] = np.where(there[t], z * state + (1 - z) * new, state)
    logits = states[:, 0] @ V[0] + states[::-1, 1] @ V[1] + net["b"]
    logits -= logits.max(axis=2, keepdims=True)
    shares = np.exp(logits)
    shares /= shares.sum(axis=2, keepdims=True)
    columns, total = np.arange(count), mask.sum()
    loss = -(np.log(shares[:, columns, labels] + 1e-300) * mask).sum() / total
    shares[:, columns, labels] -= 1
    shares *= mask[:, :, None] / total
    out = np.stack([shares, shares[::-1]], axis=1)
    errors, back = out @ V.transpose(0, 2, 1), np.zeros((2, count, h))
    into, gU = np.empty((places, 2, count, 3 * h)), np.zeros_like(U)
    for t in range(places - 1, -1, -1):
        before, z, r, new, u = steps[t]
        whole = back + errors[t]
        live = whole * there[t]
        dn = live * (1 - z) * (1 - new ** 2)
        into[t, ..., :h] = live * (before - new) * z * (1 - z)
        into[t, ..., h:2 * h] = dn * u * r * (1 - r)
        into[t, ..., 2 * h:] = dn
        through = into[t].copy()
        through[..., 2 * h:] *= r
        gU += before.transpose(0, 2, 1) @ through
        back = whole * ~there[t] + live * z + through @ U.transpose(0, 2, 1)
    # What reached each byte's inputs, summed by byte.
    rows = into.transpose(1, 0, 2, 3).reshape(2, -1, 3 * h)
    gX = np.stack([np.stack([np.bincount(both[:, d].ravel(), rows[d, :, k], 256) for k in range(3 * h)], axis=1) for d in range(2)])
    return float(loss), {
        "b": shares.sum(axis=(0, 1)), "V": np.einsum("tdbh,tdbk->dhk", states, out), "U": gU, "c": gX.sum(axis=1),
        "W": np.einsum("ve,dvk->dek", net["E"], gX), "E": np.einsum("dvk,dek->ve", gX, net["W"])}


def train_network(windows: list[bytes], labels: list[int], classes: int, epochs: int = EPOCHS, batch: int = BATCH,
                  rate: float = RATE, seed: int = 0, **shape) -> dict[str, np.ndarray]:
    """Fit by Adam; the rate falls linearly to a tenth."""
    net, rng = init_network(classes, seed=seed, **shape), np.random.default_rng(seed + 1)
    codes, mask = _padded(windows)
    labels = np.asarray(labels)
    first = {k: np.zeros_like(v) for k, v in net.items()}
    second = {k: np.zeros_like(v) for k, v in net.items()}
    step, steps = 0, epochs * -(-len(windows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            some = order[at:at + batch]
            _, grad = loss_and_gradient(net, codes[:, some], mask[:, some], labels[some])
            norm = np.sqrt(sum(float((g ** 2).sum()) for g in grad.values()))
            scale, step = min(1.0, CLIP / (norm + 1e-12)), step + 1
            pace = rate * (1 - 0.9 * step / steps)
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * scale * g
                second[k] = 0.999 * second[k] + 0.001 * (scale * g) ** 2
                net[k] -= pace * first[k] / (1 - 0.9 ** step) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return net


def _padded(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and mask, places x windows."""
    width = max(map(len, windows))
    codes = np.stack([np.frombuffer(w.ljust(width, b"\0"), dtype=np.uint8) for w in windows], axis=1)
    lengths = np.array([len(w) for w in windows])
    return codes, np.arange(width)[:, None] < lengths


class Scorer:
    """Sums of position probabilities for windows of a byte buffer, in single precision.

    Arrays are features x windows, so that every step works on long contiguous rows."""

    def __init__(self, net: dict) -> None:
        self.hidden, self.classes = net["U"].shape[1], len(net["b"])
        h = self.hidden
        # sigmoid(x) = 1 / (1 + exp(-x)) and tanh(x) = 1 - 2 / (1 + exp(2x)): the factors go into the weights.
        factor = np.concatenate([-np.ones(2 * h), 2 * np.ones(h)])
        tables = np.einsum("ve,dek->dvk", net["E"], net["W"]) + net["c"][:, None]
        self.tables = np.ascontiguousarray((tables * factor).transpose(0, 2, 1), dtype=np.float32)
        self.recur = np.ascontiguousarray((net["U"] * factor).transpose(0, 2, 1), dtype=np.float32)
        self.out = np.ascontiguousarray(net["V"].transpose(0, 2, 1), dtype=np.float32)
        self.bias = net["b"].astype(np.float32)

    def _run(self, side: int, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, live: list[int], sink: np.ndarray) -> None:
        """Adds a direction's part of the logits to ``sink`` (places x classes x windows)."""
        h, table, recur, out = self.hidden, self.tables[side], self.recur[side], self.out[side]
        state = np.zeros((h, len(starts)), dtype=np.float32)
        even = lengths[-1] == lengths[0]
        columns = np.arange(len(starts))
        for t, n in enumerate(live):
            place = t if side == 0 else lengths[:n] - 1 - t
            x = table.take(flat[starts[:n] + place], axis=1)
            own = state[:, :n]
            u = recur @ own
            gates = x[:2 * h]
            gates += u[:2 * h]
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            new = u[2 * h:]
            new *= gates[h:]
            new += x[2 * h:]
            np.exp(new, out=new)
            new += 1
            np.divide(-2, new, out=new)
            new += 1
            own -= new
            own *= gates[:h]
            own += new
            if side == 0:
                sink[t, :, :n] += out @ own
            elif even:
                sink[lengths[0] - 1 - t] += out @ own
            else:
                sink[place, :, columns[:n]] += (out @ own).T

    def sums(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each window (sorted by falling length) the sum of its positions' probabilities."""
        width = int(lengths[0])
        live = np.searchsorted(-lengths, -np.arange(width), side="left").tolist()
        logits = np.empty((width, self.classes, len(starts)), dtype=np.float32)
        logits[:] = self.bias[:, None]
        with np.errstate(over="ignore"):  # exp gives infinity and its reciprocal 0
            for side in range(2):
                self._run(side, flat, starts, lengths, live, logits)
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        if lengths[-1] < width:
            logits *= (np.arange(width)[:, None] < lengths)[:, None, :]
        return logits.sum(axis=0, dtype=np.float64).T

    def documents(self, flat: np.ndarray, offsets: np.ndarray, window: int = WINDOW, group: int = GROUP) -> np.ndarray:
        """Mean probabilities of the texts flat[offsets[i]:offsets[i + 1]], none of them empty."""
        sizes = np.diff(offsets)
        pieces = -(-sizes // window)
        totals = np.zeros((len(sizes), self.classes))
        ends = np.cumsum(pieces)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        starts = offsets[owner] + (np.arange(len(owner)) - (ends - pieces)[owner]) * window
        lengths = np.minimum(window, offsets[owner + 1] - starts)
        # Longest first: whole windows fill their groups, and only the ends of texts are of different lengths.
        order = np.argsort(-lengths, kind="stable")
        for at in range(0, len(order), group):
            some = order[at:at + group]
            np.add.at(totals, owner[some], self.sums(flat, starts[some], lengths[some]))
        return totals / sizes[:, None]


def _share_of(key: Column) -> Column:
    """A hash as a number in [0, 1)."""
    return F.pmod(key, F.lit(1 << 40)) / float(1 << 40)


def training_windows(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", train_docs: int = TRAIN_DOCS,
                     train_windows: int = TRAIN_WINDOWS, window: int = WINDOW, max_languages: int = MAX_LANGUAGES) -> DataFrame:
    """(lang, key, place, piece): at most train_docs texts of each language, train_windows pieces of each.

    Texts are chosen by their hash alone, so copies of a text count once."""
    text = text_of(text_col)
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text).alias("key"), text.alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("key", 0.02).alias("texts"))
    frequent = F.broadcast(sizes.orderBy(F.desc("n"), "lang").limit(max_languages).drop("n"))
    # About twice as many texts as wanted pass by hash; the window then sees those only.
    near = rows.join(frequent, "lang").filter(_share_of(F.col("key")) < 2.0 * train_docs / F.col("texts") + 1e-9)
    length = F.length("text")
    places = F.sequence(F.lit(0), F.lit(train_windows - 1))
    pieces = F.transform(places, lambda i: F.substr(
        "text", (F.pmod(F.xxhash64("key", i), F.greatest(length - window, F.lit(0)) + 1) + 1).cast("int"), F.lit(window)))
    # Texts of one window or less give it once.
    pieces = F.when(length <= window, F.slice(pieces, 1, 1)).otherwise(pieces)
    slim = near.select("lang", "key", pieces.alias("pieces")).groupBy("lang", "key").agg(F.min("pieces").alias("pieces"))
    ranked = slim.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy(_share_of(F.col("key")), "key")))
    chosen = ranked.filter(F.col("_rank") <= train_docs)
    return chosen.select("lang", "key", F.posexplode("pieces").alias("place", "piece"))


def fit_languages(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", window: int = WINDOW, **options) -> dict:
    """names (sorted) and net, None without labelled rows. Options of ``training_windows`` and ``train_network``."""
    sampling = {k: options.pop(k) for k in ("train_docs", "train_windows", "max_languages") if k in options}
    rows = training_windows(docs, lang_col, text_col, window=window, **sampling).collect()  # bounded by the arguments
    rows = sorted((r["lang"], r["key"], r["place"], r["piece"].encode()[:window]) for r in rows)
    names = sorted({r[0] for r in rows})
    if not names:
        return {"names": [], "net": None, "window": window}
    net = train_network([r[3] for r in rows], [names.index(r[0]) for r in rows], len(names), **options)
    return {"names": names, "net": net, "window": window}


def identify_languages(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text",
                       carry: dict[str, Column] | None = None) -> DataFrame:
    """id, the expressions of ``carry``, lang_pred, score: the pooled probability of the predicted language."""
    carry = {n: c for n, c in (carry or {}).items() if n not in (id_col, "lang_pred", "score")}
    kept = [F.col(id_col).alias("_id"), *[c.alias(f"_c{i}") for i, c in enumerate(carry.values())]]
    readable = F.col(text_col).isNotNull() & F.col(text_col).rlike("\\p{L}")
    rows = docs.select(*kept, F.when(readable & F.lit(bool(model["names"])), F.col(text_col)).alias("_text"))
    width, names, kinds = len(kept), model["names"], rows.dtypes[:len(kept)]
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            text = batch.column(width)
            there = np.flatnonzero(text.is_valid().to_numpy(zero_copy_only=False))
            langs, scores = np.full(batch.num_rows, UNKNOWN, dtype=object), np.zeros(batch.num_rows)
            if len(there):
                scorer = scorer or Scorer(shared.value["net"])
                taken = text.take(pa.array(there)).cast(pa.large_binary())
                offsets = np.frombuffer(taken.buffers()[1], dtype=np.int64)[taken.offset:taken.offset + len(taken) + 1]
                flat = np.frombuffer(taken.buffers()[2], dtype=np.uint8)
                shares = scorer.documents(flat, offsets, shared.value["window"])
                best = shares.argmax(axis=1)
                langs[there] = np.array(names, dtype=object)[best]
                scores[there] = np.clip(shares[np.arange(len(there)), best], 0.0, 1.0)
            columns = batch.columns[:width] + [pa.array(langs, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, names=[*(c for c, _ in kinds), "lang_pred", "score"])

    schema = ", ".join([f"{c} {t}" for c, t in kinds] + ["lang_pred string, score double"])
    found = rows.mapInArrow(score, schema)
    return found.select(F.col("_id").alias(id_col), *[F.col(f"_c{i}").alias(n) for i, n in enumerate(carry)],
                        "lang_pred", F.round("score", 6).alias("score"))
