"""Attention layers that are trained: gradients through a softmax over a batch, and through a keyed softmax.

Both networks plug into ``networks.fit_network``. Rows with vectors never gather by batch or post: they stay where
they are stored, partitioned by their id, and only scores, weights and constants (a few numbers, or one
vector per post) are shuffled and joined to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postweave import functions as PF
from postweave.functions.permute import permutation
from postweave.functions.vectors import ERF_P, ERF_Q, ERFC_P, ERFC_Q
from postweave.operators.fusion import LEVEL_WIDTH, softmax_stats
from postweave.operators.networks import (
    TOTALS,
    Params,
    chunk_rows,
    dense_of,
    flat_of,
    shaped_like,
    softmax_errors,
    sum_chunks,
    uniform_layer,
)
from postweave.session import stored


def erf_array(x: np.ndarray) -> np.ndarray:
    """The error function, by the approximation that ``functions.erf`` uses."""
    y, square = np.abs(x), x * x
    near = x * np.polyval([ERF_P[4], *ERF_P[:4]], square) / np.polyval([1.0, *ERF_Q], square)
    small = np.minimum(y, 6.0)
    tail = np.exp(-small * small) * np.polyval([ERFC_P[8], *ERFC_P[:8]], small) / np.polyval([1.0, *ERFC_Q], small)
    return np.where(y <= 0.46875, near, np.sign(x) * np.where(y <= 6.0, 1.0 - tail, 1.0))


def gelu_and_slope(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``x * Phi(x)`` and its derivative."""
    share = 0.5 * (1.0 + erf_array(x / np.sqrt(2.0)))
    return x * share, share + x * np.exp(-0.5 * x * x) / np.sqrt(2.0 * np.pi)


def _numpy(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.names.index(name)).to_numpy(zero_copy_only=False)


def _vectors(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return dense_of(batch.column(batch.schema.names.index(name)), width)


def _lists(matrix: np.ndarray) -> pa.ListArray:
    ends = np.arange(0, matrix.size + 1, matrix.shape[1], dtype="int32")
    return pa.ListArray.from_arrays(ends, matrix.ravel())


def _with_sums(names: list[str], kinds: str) -> str:
    """Schema of rows that hold either a part of a sum or a result row."""
    return f"chunk int, part array<double>, {kinds}"


def _sum_rows(total: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in chunk_rows(total):
        columns = [batch.column(0), batch.column(1), *[pa.nulls(1, f.type) for f in list(schema)[2:]]]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _result_rows(columns: list[pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    n = len(columns[0])
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, schema.field(1).type), *columns], schema=schema)


def _split(df: DataFrame, results: list[str]) -> tuple[np.ndarray | None, DataFrame]:
    """The sum, and the result rows."""
    return sum_chunks(df.filter("chunk is not null").select("chunk", "part")), df.filter("chunk is null").select(*results)


def spread_by_id(rows: DataFrame) -> DataFrame:
    """Partitioned by id for as many tasks as a shuffle has, so that joins by id move the other side only."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "id")


@dataclass(frozen=True)
class BatchAttention:
    """Two modalities, each weighed by the softmax of ``gelu(x W + c) . q`` over the rows of its batch, then a linear layer.

    ``index_col`` is the dense position of a row within its split. The order of the ``train_rows`` train rows is a new permutation
    in every epoch, computed from the position; the other rows are batched in their order.
    A data pass has three parts: scores, from which the softmax constants of each batch are summed; weights joined back, the linear
    layer's gradient, and how the loss depends on each weight, of which the batch's mean is
    summed; the gradient of the attention layers from one number per row and modality.
    """

    classes: int
    widths: tuple[int, int]
    train_rows: int
    attention: int = 512
    batch_size: int = 12
    cols: tuple[str, str] = ("features", "text_features")
    index_col: str = "row_idx"
    seed: int = 50

    def initial(self) -> Params:
        out = {"out": uniform_layer(sum(self.widths), self.classes, self.seed), "out_bias": np.zeros(self.classes)}
        for m, width in enumerate(self.widths):
            out[f"w{m}"] = uniform_layer(width, self.attention, self.seed + 10 + m)
            out[f"c{m}"] = np.zeros(self.attention)
            out[f"q{m}"] = np.random.default_rng(self.seed + 20 + m).normal(size=self.attention)
        return out

    def rows(self, data: DataFrame, label: str, is_train: Column, weight: Column) -> DataFrame:
        known = F.col(label).between(0, self.classes - 1) & F.col(self.cols[0]).isNotNull() & F.col(self.cols[1]).isNotNull()
        index = F.col(self.index_col).cast("long")
        return spread_by_id(data.filter(known).select(
            (index * 2 + is_train.cast("int")).alias("id"), index.alias("index"), F.col(label).cast("int").alias("y"),
            is_train.alias("is_train"), weight.cast("double").alias("weight"),
            *[F.col(c).alias(f"x{m}") for m, c in enumerate(self.cols)]))

    def batch(self, index: Column, is_train: Column, epoch: int) -> Column:
        """The batch of a row in an epoch; train batches are odd, the others even."""
        order = permutation(self.train_rows, self.seed, epoch).column(index)
        place = F.when(is_train, order).otherwise(index)
        return F.floor(place / F.lit(self.batch_size)) * 2 + is_train.cast("int")

    def _scored(self, rows: DataFrame, params: Params) -> DataFrame:
        """id, batch, s0, s1."""
        widths = self.widths

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [batch.column(0), batch.column(1)]
                for m, width in enumerate(widths):
                    act, _ = gelu_and_slope(_vectors(batch, f"x{m}", width) @ params[f"w{m}"] + params[f"c{m}"])
                    out.append(pa.array(act @ params[f"q{m}"]))
                yield pa.RecordBatch.from_arrays(out, names=["id", "batch", "s0", "s1"])

        return rows.select("id", "batch", "x0", "x1").mapInArrow(run, "id long, batch long, s0 double, s1 double")

    def weights(self, rows: DataFrame, params: Params) -> DataFrame:
        """id, batch and each row's weights w0, w1 among its batch; rows: id, batch, x0, x1."""
        scored = stored(self._scored(rows, params), "scores")
        out = scored
        for m in range(2):
            share = F.exp(F.col(f"s{m}") - F.col("_top")) / F.col("_mass")
            out = out.join(softmax_stats(scored, "batch", f"s{m}"), "batch").withColumn(f"w{m}", share).drop("_top", "_mass")
        return out.select("id", "batch", "w0", "w1")

    def data_pass(self, rows: DataFrame, params: Params, epoch: int) -> tuple[Params, np.ndarray]:
        batched = rows.withColumn("batch", self.batch(F.col("index"), F.col("is_train"), epoch))
        weighed = stored(self.weights(batched, params), "weights")
        widths, cut = self.widths, self.widths[0]
        results = ["id", "batch", "w0", "w1", "g0", "g1"]
        schema = pa.schema([("chunk", pa.int32()), ("part", pa.list_(pa.float64())), ("id", pa.int64()), ("batch", pa.int64()),
                            *[(c, pa.float64()) for c in results[2:]]])

        def layer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grad, bias, totals, seen = np.zeros_like(params["out"]), np.zeros_like(params["out_bias"]), np.zeros(TOTALS), False
            for b in batches:
                if not b.num_rows:
                    continue
                seen = True
                x = [_vectors(b, f"x{m}", width) for m, width in enumerate(widths)]
                w = [_numpy(b, f"w{m}") for m in range(2)]
                fused = np.concatenate([x[m] * w[m][:, None] for m in range(2)], axis=1)
                error = softmax_errors(fused @ params["out"] + params["out_bias"], _numpy(b, "y"),
                                       _numpy(b, "is_train").astype(bool), _numpy(b, "weight"), totals)
                grad[:] += fused.T @ error
                bias[:] += error.sum(axis=0)
                back = error @ params["out"].T
                g = [(back[:, :cut] * x[0]).sum(axis=1), (back[:, cut:] * x[1]).sum(axis=1)]
                yield _result_rows([pa.array(_numpy(b, "id")), pa.array(_numpy(b, "batch")), *map(pa.array, [*w, *g])], schema)
            if seen:
                yield from _sum_rows(np.concatenate([grad.ravel(), bias, totals]), schema)

        kinds = "id long, batch long, w0 double, w1 double, g0 double, g1 double"
        joined = rows.join(weighed, "id").select("id", "batch", "y", "is_train", "weight", "x0", "x1", "w0", "w1")
        total, slim = _split(stored(joined.mapInArrow(layer, _with_sums(results, kinds)), "linear"), results)
        if total is None:
            raise ValueError("no rows with inputs and a label of the classes")
        # Through the softmax: w * (g - mean of g under the weights of the batch).
        train = slim.filter(F.col("batch") % 2 == 1)
        means = train.groupBy("batch").agg(*[F.sum(F.col(f"w{m}") * F.col(f"g{m}")).alias(f"m{m}") for m in range(2)])
        slopes = train.join(means, "batch").select("id", *[
            (F.col(f"w{m}") * (F.col(f"g{m}") - F.col(f"m{m}"))).alias(f"d{m}") for m in range(2)])
        layers = {k: v for k, v in params.items() if k not in ("out", "out_bias")}

        def attention(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grad, seen = {k: np.zeros_like(v) for k, v in layers.items()}, False
            for b in batches:
                if not b.num_rows:
                    continue
                seen = True
                for m, width in enumerate(widths):
                    x, d = _vectors(b, f"x{m}", width), _numpy(b, f"d{m}")
                    act, slope = gelu_and_slope(x @ params[f"w{m}"] + params[f"c{m}"])
                    inner = d[:, None] * params[f"q{m}"] * slope
                    grad[f"q{m}"] += act.T @ d
                    grad[f"c{m}"] += inner.sum(axis=0)
                    grad[f"w{m}"] += x.T @ inner
            if seen:
                yield from chunk_rows(flat_of(grad))

        inputs = rows.filter("is_train").join(slopes, "id").select("x0", "x1", "d0", "d1")
        found = sum_chunks(inputs.mapInArrow(attention, "chunk int, part array<double>"))
        found = np.zeros(sum(v.size for v in layers.values())) if found is None else found
        return shaped_like(np.concatenate([total[:-TOTALS], found]), params), total[-TOTALS:]

    def transform(self, df: DataFrame, params: Params) -> DataFrame:
        """Add weights, ``logits`` and ``prediction`` to rows of one split, batched by their position."""
        rows = df.withColumn("_index", F.col(self.index_col).cast("long")).withColumn(
            "_batch", F.floor(F.col("_index") / F.lit(self.batch_size)))
        slim = rows.select(F.col("_index").alias("id"), F.col("_batch").alias("batch"),
                           *[F.col(c).alias(f"x{m}") for m, c in enumerate(self.cols)])
        weights = self.weights(slim, params).select(F.col("id").alias("_index"), F.col("w0").alias("image_weight"), F.col("w1").alias("text_weight"))
        joined = rows.join(weights, "_index")
        parts = [PF.project(F.col(c), params["out"][lo:hi].T, None, batches=True) for c, lo, hi in (
            (self.cols[0], 0, self.widths[0]), (self.cols[1], self.widths[0], sum(self.widths)))]
        joined = joined.withColumn("_a", parts[0]).withColumn("_b", parts[1])
        both = F.zip_with("_a", "_b", lambda a, b: a * F.col("image_weight") + b * F.col("text_weight"))
        logits = F.zip_with(both, PF.array_literal(params["out_bias"]), lambda a, b: a + b)
        scored = joined.withColumn("logits", logits).drop("_a", "_b", "_index", "_batch")
        return scored.withColumn("prediction", PF.argmax(F.col("logits")))


@dataclass(frozen=True)
class CrossAttention:
    """Texts that attend to their images: ``softmax(q . k)`` over the images of a post weighs their values, the text's
    own vector is added, the mean image vector appended, and a linear layer follows.

    ``images`` has ``on`` and ``image_col``, any number of rows per post. With one image the weight is 1. A text without images
    keeps its own vector, and its image part is 0. As the layers are linear, a post's images enter through two sums of vectors
    only: with its weights, and with the slopes of its scores. Both are formed per task and
    post, so a post with very many images does not gather; what goes the other way are vectors per post.
    """

    classes: int
    images: DataFrame
    text_width: int
    image_width: int
    attention: int = 512
    on: str = "post_id"
    text_col: str = "text_features"
    image_col: str = "features"
    seed: int = 50

    def initial(self) -> Params:
        inputs = self.text_width + self.image_width
        return {
            "q": uniform_layer(self.text_width, self.attention, self.seed + 1), "q_bias": np.zeros(self.attention),
            "k": uniform_layer(self.image_width, self.attention, self.seed + 2), "k_bias": np.zeros(self.attention),
            "v": uniform_layer(self.image_width, self.text_width, self.seed + 3), "v_bias": np.zeros(self.text_width),
            "out": uniform_layer(inputs, self.classes, self.seed), "out_bias": np.zeros(self.classes),
        }

    def _images(self) -> DataFrame:
        known = self.images.filter(F.col(self.image_col).isNotNull() & F.col(self.on).isNotNull())
        return known.select(F.col(self.on).cast("long").alias("id"), F.col(self.image_col).cast("array<double>").alias("x"))

    def _with_means(self, posts: DataFrame) -> DataFrame:
        """Posts with the mean of their image vectors as ``x``, zeros without images."""
        means = self._images().groupBy("id").agg(Summarizer.mean(array_to_vector("x")).alias("x"))
        return posts.join(means.select("id", vector_to_array("x").alias("x")), "id", "left").withColumn(
            "x", F.coalesce("x", PF.array_literal(np.zeros(self.image_width))))

    def rows(self, data: DataFrame, label: str, is_train: Column, weight: Column) -> DataFrame:
        known = F.col(label).between(0, self.classes - 1) & F.col(self.text_col).isNotNull() & F.col(self.on).isNotNull()
        posts = data.filter(known).select(
            F.col(self.on).cast("long").alias("id"), F.col(label).cast("int").alias("y"), is_train.alias("is_train"),
            weight.cast("double").alias("weight"), F.col(self.text_col).cast("array<double>").alias("t"))
        return spread_by_id(self._with_means(posts))

    def _asked(self, posts: DataFrame, params: Params) -> DataFrame:
        """id and a: a score is a . x, up to a constant of the post."""
        width = self.text_width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                asked = (_vectors(b, "t", width) @ params["q"] + params["q_bias"]) @ params["k"].T
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(asked)], names=["id", "a"])

        return posts.select("id", "t").mapInArrow(run, "id long, a array<double>")

    def attended(self, posts: DataFrame, params: Params) -> DataFrame:
        """id, a, z (the weighted sum of the image vectors), top and mass (the softmax constants); posts with images only."""
        pairs = self._images().join(self._asked(posts, params), "id").withColumn("_s", PF.dot(F.col("x"), F.col("a")))
        level = F.floor(F.col("_s") / LEVEL_WIDTH) * LEVEL_WIDTH
        power = F.exp(F.col("_s") - level)
        parts = pairs.select("id", "a", level.cast("double").alias("_level"), power.alias("_p"), array_to_vector(
            PF.bind(power, lambda p: F.transform("x", lambda v: v * p))).alias("_px"))
        parts = parts.groupBy("id", "_level").agg(F.sum("_p").alias("_p"), Summarizer.sum(F.col("_px")).alias("_px"))
        tops = parts.groupBy("id").agg(F.max("_level").alias("top"))  # nearly always one level
        scaled = parts.join(tops, "id").withColumn("_f", F.exp(F.col("_level") - F.col("top")))
        summed = scaled.groupBy("id").agg(
            F.max("top").alias("top"), F.sum(F.col("_p") * F.col("_f")).alias("mass"),
            Summarizer.sum(array_to_vector(F.transform(vector_to_array("_px"), lambda v: v * F.col("_f")))).alias("_z"))
        return summed.select("id", "top", "mass", F.transform(vector_to_array("_z"), lambda v: v / F.col("mass")).alias("z"))

    def data_pass(self, rows: DataFrame, params: Params, epoch: int) -> tuple[Params, np.ndarray]:
        dt, di = self.text_width, self.image_width
        constants = stored(self.attended(rows, params), "attended")
        results = ["id", "a", "u", "c", "top", "mass"]
        lists = pa.list_(pa.float64())
        schema = pa.schema([("chunk", pa.int32()), ("part", lists), ("id", pa.int64()), ("a", lists), ("u", lists),
                            ("c", pa.float64()), ("top", pa.float64()), ("mass", pa.float64())])
        own = ["v", "v_bias", "out", "out_bias"]

        def linear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grad, totals, seen = {k: np.zeros_like(params[k]) for k in own}, np.zeros(TOTALS), False
            for b in batches:
                if not b.num_rows:
                    continue
                seen = True
                t, x, z = _vectors(b, "t", dt), _vectors(b, "x", di), _vectors(b, "z", di)
                has, train = _numpy(b, "has").astype(bool), _numpy(b, "is_train").astype(bool)
                enhanced = t + (z @ params["v"] + params["v_bias"]) * has[:, None]
                fused = np.concatenate([enhanced, x], axis=1)
                error = softmax_errors(fused @ params["out"] + params["out_bias"], _numpy(b, "y"), train, _numpy(b, "weight"), totals)
                grad["out"] += fused.T @ error
                grad["out_bias"] += error.sum(axis=0)
                back = (error @ params["out"][:dt].T) * has[:, None]
                grad["v"] += z.T @ back
                grad["v_bias"] += back.sum(axis=0)
                u = back @ params["v"].T
                asked = (t @ params["q"] + params["q_bias"]) @ params["k"].T
                go = np.flatnonzero(has & train)
                if len(go):
                    yield _result_rows([pa.array(_numpy(b, "id")[go]), _lists(asked[go]), _lists(u[go]), pa.array((u[go] * z[go]).sum(axis=1)),
                                        pa.array(_numpy(b, "top")[go]), pa.array(_numpy(b, "mass")[go])], schema)
            if seen:
                yield from _sum_rows(np.concatenate([flat_of(grad), totals]), schema)

        empty = PF.array_literal(np.zeros(di))
        joined = rows.join(constants, "id", "left").select(
            "id", "y", "is_train", "weight", "t", "x", F.coalesce("z", empty).alias("z"), F.col("mass").isNotNull().alias("has"),
            F.coalesce("top", F.lit(0.0)).alias("top"), F.coalesce("mass", F.lit(1.0)).alias("mass"))
        kinds = "id long, a array<double>, u array<double>, c double, top double, mass double"
        total, slopes = _split(stored(joined.mapInArrow(linear, _with_sums(results, kinds)), "linear"), results)
        if total is None:
            raise ValueError("no rows with inputs and a label of the classes")
        # Through the softmax: each image's vector with the slope of its score.
        pairs = self._images().join(slopes, "id")
        slope = F.exp(PF.dot(F.col("x"), F.col("a")) - F.col("top")) / F.col("mass") * (PF.dot(F.col("x"), F.col("u")) - F.col("c"))
        sloped = pairs.select("id", array_to_vector(PF.bind(slope, lambda s: F.transform("x", lambda v: v * s))).alias("_r"))
        summed = sloped.groupBy("id").agg(Summarizer.sum(F.col("_r")).alias("_r")).select("id", vector_to_array("_r").alias("r"))
        attention = [k for k in params if k not in own]

        def layers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grad, seen = {k: np.zeros_like(params[k]) for k in attention}, False
            for b in batches:
                if not b.num_rows:
                    continue
                seen = True
                t, r = _vectors(b, "t", dt), _vectors(b, "r", di)
                through = r @ params["k"]
                grad["k"] += r.T @ (t @ params["q"] + params["q_bias"])
                grad["q"] += t.T @ through
                grad["q_bias"] += through.sum(axis=0)  # the key's offset shifts all scores of a post alike: no gradient
            if seen:
                yield from chunk_rows(flat_of(grad))

        found = sum_chunks(rows.join(summed, "id").select("t", "r").mapInArrow(layers, "chunk int, part array<double>"))
        grads = shaped_like(total[:-TOTALS], {k: params[k] for k in own})
        like = {k: params[k] for k in attention}
        grads |= shaped_like(found, like) if found is not None else {k: np.zeros_like(v) for k, v in like.items()}
        return {k: grads[k] for k in params}, total[-TOTALS:]

    def transform(self, df: DataFrame, params: Params) -> DataFrame:
        """Add ``logits`` and ``prediction``."""
        posts = df.withColumn("id", F.col(self.on).cast("long")).withColumn("t", F.col(self.text_col).cast("array<double>"))
        constants = self.attended(posts.select("id", "t").filter("id is not null and t is not null"), params).select("id", "z")
        slim = self._with_means(posts.select("id", "t").distinct()).join(constants, "id", "left")
        value = PF.project(F.col("z"), params["v"].T, params["v_bias"], batches=True)
        enhanced = F.coalesce(F.zip_with(value, F.col("t"), lambda a, b: a + b), F.col("t"))
        logits = PF.project(F.concat(enhanced, F.col("x")), params["out"].T, params["out_bias"], batches=True)
        found = slim.select(F.col("id").alias("_id"), logits.alias("logits"))
        scored = posts.drop("t").join(found, F.col("id").eqNullSafe(F.col("_id")), "left").drop("id", "_id")
        return scored.withColumn("prediction", PF.argmax(F.col("logits")))
