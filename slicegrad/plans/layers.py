"""Perceptrons of any number of hidden layers, as a list of passes over block-partitioned activations.

Activations are rows ``(slot, label, block, h0..)`` of up to 16 neurons each. A layer's output blocks are the input
blocks of the next layer, so every dense pass has the same plan, whatever the depth, and each pass starts from the
written rows of the one before. Weights lie as

* first layer: ``(feature, block, w0..)``, where ``w<p>`` leads from the feature to neuron ``block * width + p``. For a model
  too large to broadcast they are partitioned by feature, as are the batch's cells (:class:`SplitBatch`): both passes of the
  first layer join them where they lie, and only sums per (slot, block) move;
* later layers: ``(j, block, w0..)``, where ``w<p>`` leads from input neuron ``block * width + p`` to neuron ``j``.

All gradients use the weights of before the step. Optimizer state lies beside the weights, as for the other models, and a
row counts its own iterations in ``t``, so the plans of all iterations are equal.
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
from slicegrad.plans.batches import BatchReader, Profile, SplitReader, gather, profile_points
from slicegrad.plans.objectives import Optimizer, Sgd
from slicegrad.plans.store import ColumnStore
from slicegrad.session import bounded_broadcast, cut_lineage, loop_settings

#: Wider blocks make generated methods too long for the just-in-time compiler.
MAX_BLOCK = 16
#: Activations of a batch that one task should hold.
NUMBERS_PER_TASK = 10_000_000


@dataclass(frozen=True)
class Layer:
    """``inputs`` by ``outputs`` weights; the outputs lie in blocks of equal ``width``, the last one padded with zeros.

    The last layer's outputs, one per class, are a single block.
    """

    number: int
    inputs: int
    outputs: int
    width: int

    @property
    def blocks(self) -> int:
        return -(-self.outputs // self.width)

    def real(self, position: int, value: Column, block: str = "block") -> Column:
        """``value`` of an output at a position of a block, zero where that is padding."""
        if (self.blocks - 1) * self.width + position < self.outputs:
            return value
        return F.when(F.col(block) * self.width + position < self.outputs, value).otherwise(F.lit(0.0))


def stack(features: int, hidden: list[int], classes: int) -> list[Layer]:
    """The layers from ``features`` inputs over the ``hidden`` sizes to ``classes`` outputs."""
    sizes = [features, *hidden, classes]
    if len(sizes) < 3 or min(sizes) < 1:
        raise ValueError("a perceptron needs at least one hidden layer, and no empty one")
    layers = []
    for number, (inputs, outputs) in enumerate(zip(sizes, sizes[1:])):
        blocks = -(-outputs // MAX_BLOCK)
        width = outputs if number == len(hidden) else -(-outputs // blocks)
        layers.append(Layer(number, inputs, outputs, width))
    return layers


def numbered(prefix: str, width: int) -> list[str]:
    return [f"{prefix}{p}" for p in range(width)]


# -- weights -------------------------------------------------------------------------------------------------------


def initial_weights(
    spark: SparkSession, layers: list[Layer], optimizer: Optimizer, seed: int, partitions: int
) -> list[DataFrame]:
    """One table per layer: normal weights with deviation 0.01, keyed by (seed, layer, input, output), and zero state."""
    first, tables = layers[0], []
    for layer, below in zip(layers, [None, *layers]):
        inner = first if below is None else below  # the layer whose blocks a row holds
        outer = layer.inputs if below is None else layer.outputs
        key = "feature" if below is None else "j"
        rows = spark.range(0, outer * inner.blocks, 1, partitions if below is None else 1).select(
            F.expr(f"cast(id div {inner.blocks} as int)").alias(key), (F.col("id") % inner.blocks).cast("int").alias("block")
        )
        neurons = [F.col("block") * inner.width + p for p in range(inner.width)]
        ends = [(F.col(key), n) if below is None else (n, F.col(key)) for n in neurons]
        names = numbered("w", inner.width)
        draws = [inner.real(p, gaussian(seed, layer.number, *pair)).alias(names[p]) for p, pair in enumerate(ends)]
        rest = [F.lit(0.0).alias(name) for name in optimizer.state(names)]
        rows = rows.repartition(partitions, key) if below is None else rows
        tables.append(rows.select(key, "block", F.lit(0).alias("t"), *draws, *rest))
    return tables


def long_weights(layers: list[Layer], tables: list[DataFrame], moments: bool = False) -> DataFrame:
    """``(layer, i, j, w[, m, v])``: input ``i`` to output ``j``, one row per weight."""
    every = None
    for layer, below, table in zip(layers, [None, *layers], tables):
        inner = layer if below is None else below
        cells = []
        for p, name in enumerate(numbered("w", inner.width)):
            fields = [(F.col("block") * inner.width + p).alias("neuron"), F.col(name).alias("w")]
            if moments:
                fields += [F.col(f"m_{name}").alias("m"), F.col(f"v_{name}").alias("v")]
            cells.append(F.struct(*fields))
        key = "feature" if below is None else "j"
        rows = table.select(F.col(key).alias("other"), F.inline(F.array(*cells))).where(F.col("neuron") < inner.outputs)
        ends = ("other", "neuron") if below is None else ("neuron", "other")
        rest = ["w", "m", "v"] if moments else ["w"]
        rows = rows.select(F.lit(layer.number).alias("layer"), F.col(ends[0]).alias("i"), F.col(ends[1]).alias("j"), *rest)
        every = rows if every is None else every.unionByName(rows)
    return every


# -- passes --------------------------------------------------------------------------------------------------------


class Update:
    """New weights from the gradient sums ``g0..``; rows without a sum only shrink."""

    def __init__(self, keys: list[str], width: int, optimizer: Optimizer, batch_size: int, step: float, reg: float):
        self.keys, names, grads = keys, numbered("w", width), numbered("g", width)
        state = [*names, *optimizer.state(names)]
        changed: dict = {}
        for name, grad in zip(names, grads):
            changed.update(optimizer.update(name, F.col(grad), step, batch_size, 1.0 - reg))
        self._filled = [*keys, "t", *state, *[F.coalesce(F.col(g), F.lit(0.0)).alias(g) for g in grads]]
        self._either = [*keys, "t", *state, *[F.coalesce(g, f"hot_{g}", F.lit(0.0)).alias(g) for g in grads]]
        self._hot = [*keys, *[F.col(g).alias(f"hot_{g}") for g in grads]]
        self._changed = [*keys, (F.col("t") + 1).alias("t"), *[changed[name].alias(name) for name in state]]

    def __call__(self, table: DataFrame, sums: DataFrame, hot: DataFrame | None = None) -> DataFrame:
        """``sums`` lie in the weights' partitions; those of hot features are few and are sent there."""
        met = table.join(sums.hint("shuffle_hash"), self.keys, "left")
        if hot is None:
            return met.select(*self._filled).select(*self._changed)
        return met.join(F.broadcast(hot.select(*self._hot)), self.keys, "left").select(*self._either).select(*self._changed)


class FirstPass:
    """The sparse layer: cells to sums per (slot, block), and deltas to sums per (feature, block)."""

    def __init__(self, layer: Layer, placement: st.Placement, batch_size: int, update: Update | None = None):
        self.layer, self.placement, self.batch_size, self.update = layer, placement, batch_size, update
        self._weights = ["feature", "block", *numbered("w", layer.width)]
        w, z, h, d, g = (numbered(prefix, layer.width) for prefix in "wzhdg")
        positions = range(layer.width)
        blocks = F.explode(F.array(*[F.lit(b) for b in range(layer.blocks)])).alias("block")
        products = [F.col(w[p]) * F.col("value") for p in positions]
        self._own = ["slot", "label", blocks, *[F.lit(0.0).alias(name) for name in z]]
        self._met = ["slot", F.lit(None).cast("double").alias("label"), "block", *[x.alias(n) for x, n in zip(products, z)]]
        self._cells = ["slot", "label", F.inline_outer("features")]
        self._spread = ["slot", "label", "feature", "value", blocks]
        self._filled = ["slot", "label", "block", *[F.coalesce(x, F.lit(0.0)).alias(n) for x, n in zip(products, z)]]
        self._z = [F.max("label").alias("label"), *[F.sum(name).alias(name) for name in z]]
        self._h = ["slot", "label", "block", *[layer.real(p, S.sigmoid(F.col(z[p]))).alias(h[p]) for p in positions]]
        self._addends = ["feature", "block", *[(F.col("value") * F.col(d[p])).alias(g[p]) for p in positions]]
        self._sums = [F.sum(name).alias(name) for name in g]

    def forward(self, batch: DataFrame | st.SplitBatch, table: DataFrame) -> DataFrame:
        """``(slot, label, block, h0..)``"""
        weights, placement = table.select(*self._weights), self.placement
        if isinstance(batch, st.SplitBatch):
            samples, cold, hot = batch.samples, batch.cold.hint("shuffle_hash"), batch.hot
        elif placement.small:
            met = batch.select(*self._cells).select(*self._spread).join(F.broadcast(weights), ["feature", "block"], "left")
            return met.select(*self._filled).groupBy("slot", "block").agg(*self._z).select(*self._h)
        else:  # rows of any number: the cells come to the model's partitions, whose size is known
            (cold, hot), samples, weights = st.split_cells(batch, placement), batch, weights.hint("shuffle_hash")
        parts = samples.select(*self._own)
        for cells, model in ((cold, weights), (hot, st.hot_weights(table.select(*self._weights), placement))):
            parts = parts.unionByName(cells.join(model, "feature").select(*self._met))
        return parts.groupBy("slot", "block").agg(*self._z).select(*self._h)

    def _summed(self, cells: DataFrame, delta: DataFrame) -> DataFrame:
        return cells.select("slot", "feature", "value").join(delta, "slot").select(*self._addends).groupBy("feature", "block").agg(*self._sums)

    def backward(self, batch: DataFrame | st.SplitBatch, delta: DataFrame, table: DataFrame) -> DataFrame:
        """The new weights."""
        delta = bounded_broadcast(delta, self.batch_size * self.layer.blocks, self.layer.width + 2)
        if isinstance(batch, st.SplitBatch):
            return self.update(table, self._summed(batch.cold, delta), self._summed(batch.hot, delta))
        return self.update(table, self._summed(batch.select("slot", F.inline("features")), delta))


class DensePass:
    """A later layer: input blocks to output blocks, and output deltas back to input deltas and weight gradients."""

    def __init__(self, layer: Layer, below: Layer, batch_size: int, update: Update | None = None):
        self.layer, self.below, self.batch_size, self.update = layer, below, batch_size, update
        inner, outer = range(below.width), range(layer.width)
        w, h, g, e = (numbered(prefix, below.width) for prefix in "whge")
        z, out, d = (numbered(prefix, layer.width) for prefix in ("z", "h", "d"))
        self._weights = ["j", "block", *w]
        place = F.col("j") % layer.width
        dot = S.total([F.col(h[p]) * F.col(w[p]) for p in inner])
        self._dot = ["slot", "label", F.expr(f"j div {layer.width}").cast("int").alias("up"), place.alias("at"), dot.alias("dot")]
        self._z = [F.max("label").alias("label")]
        self._z += [F.sum(F.when(F.col("at") == p, F.col("dot")).otherwise(0.0)).alias(z[p]) for p in outer]
        named = ["slot", "label", F.col("up").alias("block")]
        self._linear = [*named, *[F.col(z[p]).alias(out[p]) for p in outer]]
        self._sigmoid = [*named, *[layer.real(p, S.sigmoid(F.col(z[p])), "up").alias(out[p]) for p in outer]]
        own = S.pick([F.col(d[p]) for p in outer], place)
        self._delta = ["slot", F.col("block").alias("up"), *d]
        self._back = ["slot", "block", "j", *h, *w, own.alias("delta")]
        self._grads = [F.sum(F.col(h[p]) * F.col("delta")).alias(g[p]) for p in inner]
        self._signals = [F.sum(F.col(w[p]) * F.col("delta")).alias(e[p]) for p in inner] + [F.max(name).alias(name) for name in h]
        self._inner = ["slot", "block", *[(F.col(e[p]) * S.dsigmoid(F.col(h[p]))).alias(f"d{p}") for p in inner]]

    def _model(self, table: DataFrame) -> DataFrame:
        return bounded_broadcast(table.select(*self._weights), self.layer.outputs * self.below.blocks, self.below.width + 2)

    def forward(self, acts: DataFrame, table: DataFrame, linear: bool) -> DataFrame:
        """``(slot, label, block, h0..)`` of this layer; scores instead of activations if ``linear``."""
        sums = acts.join(self._model(table), "block").select(*self._dot).groupBy("slot", "up").agg(*self._z)
        return sums.select(*(self._linear if linear else self._sigmoid))

    def _meeting(self, acts: DataFrame, delta: DataFrame, table: DataFrame) -> DataFrame:
        delta = bounded_broadcast(delta.select(*self._delta), self.batch_size * self.layer.blocks, self.layer.width + 2)
        model = self._model(table).withColumn("up", F.expr(f"j div {self.layer.width}").cast("int"))
        return acts.drop("label").join(delta, "slot").join(model, ["block", "up"]).select(*self._back)

    def signals(self, acts: DataFrame, delta: DataFrame, table: DataFrame) -> DataFrame:
        """Deltas of the layer below, ``(slot, block, d0..)``, from the weights of before the step."""
        return self._meeting(acts, delta, table).groupBy("slot", "block").agg(*self._signals).select(*self._inner)

    def backward(self, acts: DataFrame, delta: DataFrame, table: DataFrame) -> DataFrame:
        """The new weights."""
        return self.update(table, self._meeting(acts, delta, table).groupBy("j", "block").agg(*self._grads))


class Passes:
    """Forward and backward passes of a stack of layers, with their column expressions built once."""

    def __init__(
        self, layers: list[Layer], placement: st.Placement, batch_size: int = 1, optimizer: Optimizer | None = None,
        step: float = 0.0, reg: float = 0.0,
    ):
        self.layers, self.placement = layers, placement
        update = lambda key, width: Update([key, "block"], width, optimizer, batch_size, step, reg) if optimizer else None
        self.first = FirstPass(layers[0], placement, batch_size, update("feature", layers[0].width))
        self.dense = [
            DensePass(layer, below, batch_size, update("j", below.width)) for below, layer in zip(layers, layers[1:])
        ]
        classes = layers[-1].outputs
        outputs = numbered("h", classes)
        scores, label = [F.col(name) for name in outputs], F.col("label")
        self.stages = S.softmax_stages(outputs)
        self.shares = S.softmax(classes)
        loss = S.log_sum_exp() - S.pick(scores, label)
        correct = F.when(S.pick(scores, label) >= F.col("_top"), 1.0).otherwise(0.0)
        self.metrics = [F.avg(loss).alias("loss"), F.avg(correct).alias("accuracy")]
        deltas = [(share - F.when(label == k, 1.0).otherwise(0.0)).alias(f"d{k}") for k, share in enumerate(self.shares)]
        self._delta = ["slot", "block", *deltas]

    def forward(self, batch: DataFrame | st.SplitBatch, tables: list[DataFrame], keep=lambda df: df) -> list[DataFrame]:
        """Activations of every layer; ``keep`` is applied to each before the next pass reads it."""
        acts = [keep(self.first.forward(batch, tables[0]))]
        for number, one in enumerate(self.dense, start=1):
            acts.append(keep(one.forward(acts[-1], tables[number], number == len(self.dense))))
        return acts

    def measured(self, scores: DataFrame) -> DataFrame:
        """One row ``(loss, accuracy)``."""
        return S.staged(scores, self.stages).agg(*self.metrics)

    def backward(self, batch: DataFrame | st.SplitBatch, acts: list[DataFrame], tables: list[DataFrame]) -> list[DataFrame]:
        """The new weights of every layer."""
        delta = cut_lineage(S.staged(acts[-1], self.stages).select(*self._delta))
        fresh = []
        for number in range(len(self.dense), 0, -1):
            one, below = self.dense[number - 1], acts[number - 1]
            fresh.append(cut_lineage(one.backward(below, delta, tables[number])))
            delta = cut_lineage(one.signals(below, delta, tables[number]))
        fresh.append(cut_lineage(self.first.backward(batch, delta, tables[0])))
        return fresh[::-1]


# -- training ------------------------------------------------------------------------------------------------------


@dataclass
class LayeredModel:
    layers: list[Layer]
    tables: list[DataFrame]
    history: DataFrame
    placement: st.Placement
    records: list = field(default_factory=list)

    def weights(self, with_moments: bool = False) -> DataFrame:
        """``(layer, i, j, w)``, and the moments ``m, v`` for a model trained with Adam."""
        return long_weights(self.layers, self.tables, with_moments)

    def _scores(self, batch: DataFrame) -> tuple[Passes, DataFrame]:
        """Output scores of a row-wise batch of any size, placed by the hot features of its own rows."""
        placement = self.placement
        if not placement.small:
            first = self.layers[0]
            placement = st.split_placement(batch, first.blocks * (first.width + 3), placement.partitions)
        passes = Passes(self.layers, placement)
        return passes, passes.forward(batch, self.tables)[-1]

    def score(self, points: DataFrame) -> DataFrame:
        """Class shares of every row: ``(row_id, label, p0..)``."""
        passes, scores = self._scores(points.select(F.col("row_id").alias("slot"), "label", "features"))
        named = [share.alias(f"p{k}") for k, share in enumerate(passes.shares)]
        return S.staged(scores, passes.stages).select(F.col("slot").alias("row_id"), "label", *named)

    def evaluate(self, points: DataFrame, n_rows: int, valid_ratio: float = 0.01, seed: int = 100_000) -> DataFrame:
        """Loss and accuracy over rows sampled with replacement."""
        size = max(1, int(valid_ratio * n_rows))
        slots = draw_slots(points.sparkSession, n_rows, size, 1, seed)
        passes, scores = self._scores(cut_lineage(gather(points, slots, size, n_rows)))
        return passes.measured(scores)


def train_layers(
    points: DataFrame | ColumnStore, *, step: float, batch_size: int, iterations: int, classes: int, hidden: list[int] | int = 500,
    reg: float = 0.0, num_features: int | None = None, seed: int = 42, history: bool = True, optimizer: Optimizer | None = None,
    profile: Profile | None = None, partitions: int | None = None, placement: st.Placement | None = None,
    valid_ratio: float = 0.01, valid_every: int = 1000,
) -> LayeredModel:
    """Train by mini-batch steps; see :func:`slicegrad.plans.train.train` for the shared settings."""
    from slicegrad.plans.train import EVALUATION_SEED, HISTORY_SCHEMA, model_partitions, sample_size

    spark, optimizer = points.sparkSession, optimizer or Sgd()
    stored = isinstance(points, ColumnStore)
    if stored:
        profile, placement, partitions = points.profile, points.placement, points.placement.partitions
    profile = profile or profile_points(points, classes, num_features)
    layers = stack(profile.num_features, [hidden] if isinstance(hidden, int) else list(hidden), classes)
    first = layers[0]
    width = 3 + first.width + len(optimizer.state(numbered("w", first.width)))
    partitions = partitions or model_partitions(spark, profile.num_features * first.blocks, width)
    if placement is None:
        placement = st.plan_placement(profile.num_features, first.blocks * width, partitions, points)
    passes = Passes(layers, placement, batch_size, optimizer, step, reg)
    tasks = partitions
    if placement.small:
        # every cell meets all neurons, so even a short batch is worth several tasks; a long one is cut by its size
        cores, numbers = spark.sparkContext.defaultParallelism, batch_size * max(layer.outputs for layer in layers)
        tasks = max(partitions, min(cores, numbers // 20_000 + 1), numbers // NUMBERS_PER_TASK + 1)
    facts = (points, profile.n_rows, batch_size, iterations, seed)
    if stored:
        reader = points.reader(batch_size, iterations, seed)
    else:
        reader = BatchReader(*facts, max(1, -(-batch_size // tasks))) if placement.small else SplitReader(*facts, placement)
    valid_size, records = sample_size(valid_ratio, profile.n_rows), []
    with closing(reader), loop_settings(spark, tasks):
        tables = [cut_lineage(table) for table in initial_weights(spark, layers, optimizer, seed, partitions)]
        for t in range(iterations):
            valid_loss = None
            if history and t % valid_every == 0 and valid_size:
                if stored:
                    drawn = points.sampled(valid_size, EVALUATION_SEED)
                else:
                    drawn = gather(points, draw_slots(spark, profile.n_rows, valid_size, 1, EVALUATION_SEED), valid_size, profile.n_rows)
                valid_loss = passes.measured(passes.forward(drawn, tables)[-1]).first()["loss"]
            batch = reader.batch(t)
            # written out: both directions read them, and every pass starts from plain rows
            acts = passes.forward(batch, tables, cut_lineage)
            if history:
                seen = passes.measured(acts[-1]).first()
                records.append((t, seen["loss"], valid_loss, seen["accuracy"]))
            tables = passes.backward(batch, acts, tables)
    return LayeredModel(layers, tables, spark.createDataFrame(records, HISTORY_SCHEMA), placement, records)
