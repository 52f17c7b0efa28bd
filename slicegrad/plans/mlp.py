"""Multilayer perceptron with one hidden sigmoid layer and a softmax output.

Weights are stored in blocks of hidden neurons: ``(layer, i, block, w0..)``. In layer 0, ``i`` is an
input feature; in layer 1, ``i`` is a class. Column ``w<p>`` belongs to hidden neuron
``block * width + p`` in both layers, so a join row carries a whole block and every sum runs over plain
columns in generated code. The long table ``(layer, i, j, w)`` is a projection of it.
"""

from __future__ import annotations

from contextlib import closing
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slicegrad.functions import scalars as S
from slicegrad.functions.hashing import gaussian
from slicegrad.operators import statistics as st
from slicegrad.operators.sampling import draw_slots
from slicegrad.plans.batches import BatchReader, Profile, gather, profile_points
from slicegrad.session import bounded_broadcast, cut_lineage, loop_settings

#: Wider blocks make generated methods too long for the just-in-time compiler.
MAX_BLOCK = 16
#: Hidden activations of a batch that one task should hold.
NUMBERS_PER_TASK = 10_000_000


@dataclass(frozen=True)
class Shape:
    """Layer sizes and the block width: at most 16, with blocks of equal width.

    Where they hold more neurons than ``hidden``, the last positions are padding: weights and activations of zero, which
    stay zero and are no part of the long table.
    """

    features: int
    hidden: int
    classes: int

    @property
    def width(self) -> int:
        return -(-self.hidden // self.blocks)

    @property
    def blocks(self) -> int:
        return -(-self.hidden // MAX_BLOCK)

    def real(self, position: int, value: Column) -> Column:
        """``value`` at a position of a block, zero where that is padding."""
        if (self.blocks - 1) * self.width + position < self.hidden:
            return value
        return F.when(F.col("block") * self.width + position < self.hidden, value).otherwise(F.lit(0.0))

    def names(self, prefix: str) -> list[str]:
        return [f"{prefix}{p}" for p in range(self.width)]


def mlp_init(spark: SparkSession, shape: Shape, seed: int = 42, partitions: int = 1) -> DataFrame:
    """Initial weights: normal with deviation 0.01, keyed by (seed, layer, input, output)."""
    def layer(number: int, size: int) -> DataFrame:
        ids = spark.range(0, size * shape.blocks, 1, partitions)
        rows = ids.select(
            F.lit(number).alias("layer"),
            F.expr(f"cast(id div {shape.blocks} as int)").alias("i"),
            (F.col("id") % shape.blocks).cast("int").alias("block"),
        )
        neurons = [F.col("block") * shape.width + p for p in range(shape.width)]
        ends = [(F.col("i"), j) if number == 0 else (j, F.col("i")) for j in neurons]
        draws = [shape.real(p, gaussian(seed, number, *pair)) for p, pair in enumerate(ends)]
        weights = [draw.alias(name) for draw, name in zip(draws, shape.names("w"))]
        return rows.select("layer", "i", "block", *weights)

    both = layer(0, shape.features).unionByName(layer(1, shape.classes))
    return both.repartition(partitions, "i")


def mlp_weights(state: DataFrame, shape: Shape) -> DataFrame:
    """Long weights ``(layer, i, j, w)``: input or hidden neuron ``i`` to hidden neuron or class ``j``."""
    cells = F.array(
        *[
            F.struct((F.col("block") * shape.width + p).alias("neuron"), F.col(name).alias("w"))
            for p, name in enumerate(shape.names("w"))
        ]
    )
    rows = state.select("layer", F.col("i").alias("unit"), F.inline(cells)).where(F.col("neuron") < shape.hidden)
    first = F.col("layer") == 0
    return rows.select(
        "layer",
        F.when(first, F.col("unit")).otherwise(F.col("neuron")).alias("i"),
        F.when(first, F.col("neuron")).otherwise(F.col("unit")).alias("j"),
        "w",
    )


class Network:
    """The plans of the forward and backward pass; column expressions are built once."""

    def __init__(
        self, shape: Shape, placement: st.Placement, batch_size: int, step: float = 0.0, reg: float = 0.0
    ):
        self.shape, self.placement, self.batch_size = shape, placement, batch_size
        w, z, h, d, e = (shape.names(prefix) for prefix in "wzhde")
        outputs = [f"o{k}" for k in range(shape.classes)]
        positions = range(shape.width)
        scores = [F.col(name) for name in outputs]
        label = F.col("label")

        blocks = F.explode(F.array(*[F.lit(b) for b in range(shape.blocks)])).alias("block")
        self._own = ["slot", "label", blocks, *[F.lit(0.0).alias(name) for name in z]]
        products = [(F.col(w[p]) * F.col("value")).alias(z[p]) for p in positions]
        self._terms = ["slot", F.lit(None).cast("double").alias("label"), "block", *products]
        self._cells = ["slot", "label", F.inline_outer("features")]
        self._blocks = ["slot", "label", "feature", "value", blocks]
        self._filled = ["slot", "label", "block"] + [
            F.coalesce(F.col(w[p]) * F.col("value"), F.lit(0.0)).alias(z[p]) for p in positions
        ]
        self._z = [F.max("label").alias("label")] + [F.sum(name).alias(name) for name in z]
        self._h = ["slot", "label", "block"] + [
            shape.real(p, S.sigmoid(F.col(z[p]))).alias(h[p]) for p in positions
        ]
        self._first = ["i", "block", *w]

        dot = S.total([F.col(h[p]) * F.col(w[p]) for p in positions])
        self._dot = ["slot", "label", "i", dot.alias("dot")]
        self._outputs = [F.max("label").alias("label")] + [
            F.sum(F.when(F.col("i") == k, F.col("dot")).otherwise(0.0)).alias(name)
            for k, name in enumerate(outputs)
        ]
        self.stages = S.softmax_stages(outputs)
        self.loss = S.log_sum_exp() - S.pick(scores, label)
        self.correct = F.when(S.pick(scores, label) >= F.col("_top"), 1.0).otherwise(0.0)
        self.metrics = [F.avg(self.loss).alias("loss"), F.avg(self.correct).alias("accuracy")]

        deltas = [
            (share - F.when(label == k, 1.0).otherwise(0.0)).alias(f"d{k}_out")
            for k, share in enumerate(S.softmax(shape.classes))
        ]
        self._out_delta = ["slot", *deltas]
        own_delta = S.pick([F.col(f"d{k}_out") for k in range(shape.classes)], F.col("i"))
        self._backward = ["slot", "block", "i", *h, *w, own_delta.alias("delta")]
        self._hidden_sums = [F.sum(F.col(w[p]) * F.col("delta")).alias(e[p]) for p in positions] + [
            F.max(name).alias(name) for name in h
        ]
        self._hidden_delta = ["slot", "block"] + [
            (F.col(e[p]) * S.dsigmoid(F.col(h[p]))).alias(d[p]) for p in positions
        ]
        self._second_sums = [F.sum(F.col(h[p]) * F.col("delta")).alias(f"g{p}") for p in positions]
        self._first_terms = ["feature", "block"] + [
            (F.col("value") * F.col(d[p])).alias(f"g{p}") for p in positions
        ]
        self._first_sums = [F.sum(f"g{p}").alias(f"g{p}") for p in positions]
        grads = [f"g{p}" for p in positions]
        self._as_first = [F.lit(0).alias("layer"), F.col("feature").alias("i"), "block", *grads]
        self._as_second = [F.lit(1).alias("layer"), "i", "block", *grads]
        rate = step / batch_size
        self._changed = ["layer", "i", "block"] + [
            (F.col(w[p]) * (1.0 - reg) - rate * F.coalesce(F.col(f"g{p}"), F.lit(0.0))).alias(w[p])
            for p in positions
        ]

    def _second_layer(self, state: DataFrame) -> DataFrame:
        """Weights from hidden to output, small unless both are huge."""
        rows = state.where("layer = 1").drop("layer")
        return bounded_broadcast(rows, self.shape.classes * self.shape.blocks, self.shape.width)

    def hidden(self, batch: DataFrame, state: DataFrame) -> DataFrame:
        """Hidden activations of the batch: ``(slot, label, block, h0..)``."""
        weights = state.where("layer = 0").select(F.col("i").alias("feature"), "block", *self.shape.names("w"))
        if self.placement.small:
            cells = batch.select(*self._cells).select(*self._blocks)
            met = cells.join(F.broadcast(weights), ["feature", "block"], "left")
            return met.select(*self._filled).groupBy("slot", "block").agg(*self._z).select(*self._h)
        cold, hot = st.split_cells(batch, self.placement)
        cold = cold.hint("shuffle_hash")
        near = st.hot_weights(weights, self.placement)
        parts = batch.select(*self._own)
        parts = parts.unionByName(cold.join(weights, "feature").select(*self._terms))
        parts = parts.unionByName(hot.join(near, "feature").select(*self._terms))
        return parts.groupBy("slot", "block").agg(*self._z).select(*self._h)

    def outputs(self, hidden: DataFrame, state: DataFrame) -> DataFrame:
        """Output scores before the softmax: ``(slot, label, o0..)``."""
        dots = hidden.join(self._second_layer(state), "block").select(*self._dot)
        return dots.groupBy("slot").agg(*self._outputs)

    def step(self, batch: DataFrame, hidden: DataFrame, outputs: DataFrame, state: DataFrame) -> DataFrame:
        """Weights of both layers after one step; all gradients use the weights of before the step."""
        shape = self.shape
        delta = bounded_broadcast(S.staged(outputs, self.stages).select(*self._out_delta), self.batch_size, shape.classes + 1)
        back = hidden.join(delta, "slot").join(self._second_layer(state), "block").select(*self._backward)
        second = back.groupBy("i", "block").agg(*self._second_sums).select(*self._as_second)
        inner = back.groupBy("slot", "block").agg(*self._hidden_sums).select(*self._hidden_delta)
        if not self.placement.small:
            inner = cut_lineage(inner)  # read by both kinds of cells
        inner = bounded_broadcast(inner, self.batch_size * shape.blocks, shape.width + 1)
        grads = second
        for cells in st.split_cells(batch, self.placement):
            if cells is not None:
                met = cells.join(inner, "slot").select(*self._first_terms)
                sums = met.groupBy("feature", "block").agg(*self._first_sums)
                grads = grads.unionByName(sums.select(*self._as_first))
        grads = grads.repartition(self.placement.partitions, "i").hint("shuffle_hash")
        return state.join(grads, ["layer", "i", "block"], "left").select(*self._changed)


def mlp_forward(
    batch: DataFrame, state: DataFrame, shape: Shape, placement: st.Placement | None = None
) -> DataFrame:
    """Class shares of every slot of a batch: ``(slot, label, p0..)``."""
    if placement is None:
        tasks = batch.sparkSession.sparkContext.defaultParallelism
        placement = st.plan_placement(shape.features, shape.hidden + 3 * shape.blocks, tasks, batch)
    network = Network(shape, placement, 1)
    out = network.outputs(network.hidden(batch, state), state)
    shares = S.softmax(shape.classes)
    return S.staged(out, network.stages).select("slot", "label", *[share.alias(f"p{k}") for k, share in enumerate(shares)])


def mlp_metrics(shares: DataFrame, classes: int) -> DataFrame:
    """Mean cross-entropy and accuracy of class shares; a tie for the largest share counts as correct."""
    columns = [F.col(f"p{k}") for k in range(classes)]
    own = S.pick(columns, F.col("label"))
    return shares.agg(
        F.avg(-F.log(own)).alias("loss"),
        F.avg(F.when(own >= S.largest(columns), 1.0).otherwise(0.0)).alias("accuracy"),
    )


@dataclass
class MlpModel:
    shape: Shape
    state: DataFrame
    history: DataFrame
    placement: st.Placement
    records: list = field(default_factory=list)

    def weights(self) -> DataFrame:
        return mlp_weights(self.state, self.shape)

    def score(self, points: DataFrame) -> DataFrame:
        """Class shares of every row: ``(row_id, label, p0..)``."""
        batch = points.select(F.col("row_id").alias("slot"), "label", "features")
        network = Network(self.shape, self.placement, 1)
        out = network.outputs(network.hidden(batch, self.state), self.state)
        shares = S.softmax(self.shape.classes)
        named = [share.alias(f"p{k}") for k, share in enumerate(shares)]
        return S.staged(out, network.stages).select(F.col("slot").alias("row_id"), "label", *named)

    def evaluate(self, points: DataFrame, n_rows: int, valid_ratio: float = 0.01, seed: int = 100_000) -> DataFrame:
        """Loss and accuracy over rows sampled with replacement."""
        size = max(1, int(valid_ratio * n_rows))
        return _sampled(Network(self.shape, self.placement, 1), self.state, points, n_rows, size, seed)


def _sampled(network: Network, state: DataFrame, points: DataFrame, n_rows: int, size: int, seed: int) -> DataFrame:
    """One row ``(loss, accuracy)`` over rows drawn with replacement."""
    slots = draw_slots(points.sparkSession, n_rows, size, 1, seed)
    out = network.outputs(network.hidden(gather(points, slots, size, n_rows), state), state)
    return S.staged(out, network.stages).agg(*network.metrics)


def train_mlp(
    points: DataFrame, *, step: float, batch_size: int, iterations: int, classes: int, hidden: int = 500,
    reg: float = 0.0, num_features: int | None = None, seed: int = 42, history: bool = True,
    profile: Profile | None = None, partitions: int | None = None, placement: st.Placement | None = None,
    valid_ratio: float = 0.01, valid_every: int = 1000,
) -> MlpModel:
    """Train by mini-batch steps; see :func:`slicegrad.plans.train.train` for the shared settings."""
    from slicegrad.plans.train import EVALUATION_SEED, HISTORY_SCHEMA, model_partitions, sample_size

    spark = points.sparkSession
    profile = profile or profile_points(points, classes, num_features)
    shape = Shape(profile.num_features, hidden, classes)
    partitions = partitions or model_partitions(spark, profile.num_features * shape.blocks, shape.width + 3)
    if placement is None:
        placement = st.plan_placement(profile.num_features, hidden + 3 * shape.blocks, partitions, points)
    if not placement.small:  # cells and first layer are split by feature there
        from slicegrad.plans.layers import train_layers

        return train_layers(
            points, step=step, batch_size=batch_size, iterations=iterations, classes=classes, hidden=hidden, reg=reg,
            seed=seed, history=history, profile=profile, partitions=partitions, placement=placement,
            valid_ratio=valid_ratio, valid_every=valid_every,
        )
    network = Network(shape, placement, batch_size, step, reg)
    # Every cell meets all hidden neurons, so even a short batch is worth several tasks; a long one is cut by its size.
    cores = spark.sparkContext.defaultParallelism
    by_size = batch_size * hidden // NUMBERS_PER_TASK + 1
    tasks = max(partitions, min(cores, batch_size * hidden // 20_000 + 1), by_size)
    valid_size = sample_size(valid_ratio, profile.n_rows)
    rows_per_file = max(1, -(-batch_size // tasks))
    reader = BatchReader(points, profile.n_rows, batch_size, iterations, seed, rows_per_file)
    records = []
    with closing(reader), loop_settings(spark, tasks):
        state = cut_lineage(mlp_init(spark, shape, seed, partitions))
        for t in range(iterations):
            valid_loss = None
            if history and t % valid_every == 0 and valid_size:
                valid_loss = _sampled(network, state, points, profile.n_rows, valid_size, EVALUATION_SEED).first()["loss"]
            batch = reader.batch(t)
            # Written out rather than cached: both passes read them, and a plan that starts from plain
            # rows stays small enough for its compiled code to be reused in the next iteration.
            activations = cut_lineage(network.hidden(batch, state))
            out = cut_lineage(network.outputs(activations, state))
            if history:
                seen = S.staged(out, network.stages).agg(*network.metrics).first()
                records.append((t, seen["loss"], valid_loss, seen["accuracy"]))
            state = cut_lineage(network.step(batch, activations, out, state))
    return MlpModel(shape, state, spark.createDataFrame(records, HISTORY_SCHEMA), placement, records)


