"""Mini-batch training as a sequence of relational plans."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicegrad.functions.scalars import staged
from slicegrad.operators import statistics as st
from slicegrad.operators.sampling import draw_slots
from slicegrad.plans.batches import SLOTS_PER_TASK, BatchReader, Profile, SplitReader, gather, profile_points
from slicegrad.plans.objectives import Adam, Objective, Optimizer, Sgd, make_objective
from slicegrad.plans.store import ColumnStore
from slicegrad.session import cut_lineage, loop_settings

MODEL_ROWS_PER_PARTITION = 500_000
#: Iterations of a large model between two merges of what they touched.
MERGE_EVERY = 8
EVALUATION_SEED = 100_000
HISTORY_SCHEMA = "iter int, batch_loss double, valid_loss double, accuracy double"


@dataclass
class Model:
    """A trained model: ``state`` has one wide row per feature, ``history`` one row per iteration."""

    objective: Objective
    state: DataFrame
    history: DataFrame
    num_features: int
    placement: st.Placement
    records: list = field(default_factory=list)

    def weights(self, with_moments: bool = False) -> DataFrame:
        """``(feature, k, w)``, and the moments ``m, v`` for a model trained with Adam."""
        return st.long_weights(self.state, self.objective.weights(), with_moments)

    def score(self, points: DataFrame) -> DataFrame:
        """Score every row of ``points``: ``(row_id, label, <scores>)``."""
        return score(self, points)


def model_partitions(spark: SparkSession, rows: int, columns: int) -> int:
    """Partitions of a model: few for a small one, otherwise by its size."""
    if st.fits_broadcast(rows, columns):
        return 1
    by_size = -(-rows * columns // MODEL_ROWS_PER_PARTITION)
    return max(spark.sparkContext.defaultParallelism, by_size)


def initial_state(
    spark: SparkSession, objective: Objective, optimizer: Optimizer, num_features: int, partitions: int, seed: int
) -> DataFrame:
    """One row per feature with initial weights and optimizer state, partitioned by feature."""
    ids = spark.range(0, num_features, 1, partitions).select(F.col("id").cast("int").alias("feature"))
    ids = ids.repartition(partitions, "feature")
    names = objective.weights()
    start = objective.initial(F.col("feature"), seed)
    return ids.select(
        "feature",
        *[start[name].alias(name) for name in names],
        *[F.lit(0.0).alias(name) for name in optimizer.state(names)],
    )


class Plan:
    """The relational plan of one iteration of one model, with its column expressions built once."""

    def __init__(
        self, objective: Objective, optimizer: Optimizer, placement: st.Placement,
        batch_size: int = 1, step: float = 0.0, reg: float = 0.0,
    ):
        self.objective, self.placement = objective, placement
        weights = objective.weights()
        self._weights = ["feature", *weights]
        known = batch_size if batch_size > 1 else None  # one: rows of any number
        self.forward = [st.SampleStats(terms, placement, known) for terms in objective.passes()]
        self.back = [st.SampleStats(terms, placement, known) for terms in objective.returns()]
        self.reads_once = not (self.back or objective.sums_see_weights())  # the weights, in an update
        self.stages = objective.stages()
        self.sums_of = st.FeatureSums(objective.coefs(), objective.sums(), placement, batch_size, objective.sums_see_weights())
        self.mean_loss = F.avg(objective.loss())
        state = [*weights, *optimizer.state(weights)]
        sums = list(objective.sums())
        self._filled = [
            "feature",
            *state,
            F.coalesce("t", F.lit(0)).alias("t"),
            *[F.coalesce(F.col(name), F.lit(0.0)).alias(name) for name in sums],
        ]
        self._hot = ["feature", *[F.col(name).alias(f"hot_{name}") for name in ["t", *sums]]]
        self._either = [
            "feature",
            *state,
            F.coalesce("t", "hot_t", F.lit(0)).alias("t"),
            *[F.coalesce(name, f"hot_{name}", F.lit(0.0)).alias(name) for name in sums],
        ]
        changed: dict = {}
        for weight, gradient in objective.gradient().items():
            changed.update(optimizer.update(weight, gradient, step, batch_size, 1.0 - reg))
        self._changed = ["feature", *[changed[name].alias(name) for name in state]]
        self._state, self._idle = state, lambda rounds: {
            name: column for weight in weights for name, column in optimizer.idle(weight, 1.0 - reg, rounds).items()
        }

    def stats(self, batch: DataFrame | st.SplitBatch, state: DataFrame) -> DataFrame:
        weights, stats = state.select(*self._weights), None
        for sums in self.forward:
            if stats is not None:
                stats = cut_lineage(stats)  # sent to the cells, and returned with the next ones
            stats = sums(batch, weights, stats)
        return stats

    def loss(self, stats: DataFrame) -> float:
        return self.mean(stats).first()["loss"]

    def mean(self, stats: DataFrame) -> DataFrame:
        """One row ``(n, loss)``."""
        return staged(stats, self.stages).agg(F.count("*").alias("n"), self.mean_loss.alias("loss"))

    def step(self, batch: DataFrame | st.SplitBatch, stats: DataFrame, state: DataFrame) -> DataFrame:
        """Weights after one step: shrink all features, move those the batch touches.

        The model is never shuffled. Sums of a split batch are in its partitions already, but for those of the hot
        features, of which there are no more than a broadcast takes.
        """
        stats, weights = staged(stats, self.stages), state.select(*self._weights)
        split = isinstance(batch, st.SplitBatch)  # its statistics are written
        for number, sums in enumerate(self.back):
            stats = sums(batch, weights, stats if split and not number else cut_lineage(stats))
        if split:
            if self.back:
                stats = cut_lineage(stats)  # read by hot cells and cold cells
            cold, hot = self.sums_of.split(batch, stats, weights)
            met = state.join(cold.hint("shuffle_hash"), "feature", "left")
            return met.join(F.broadcast(hot.select(*self._hot)), "feature", "left").select(*self._either).select(*self._changed)
        sums = self.sums_of(batch, stats, weights).hint("shuffle_hash")
        return state.join(sums, "feature", "left").select(*self._filled).select(*self._changed)


    def part(self, state: DataFrame, touched: DataFrame) -> DataFrame:
        """The rows of the ``touched`` and of the hot features, where they lie."""
        marks = [touched.withColumn("is_touched", F.lit(True)).hint("shuffle_hash"), F.broadcast(self.placement.hot.withColumn("is_hot", F.lit(True)))]
        marked = state.join(marks[0], "feature", "left").join(marks[1], "feature", "left")
        return marked.where("is_touched or is_hot").select(state.columns)

    def merged(self, state: DataFrame, part: DataFrame, rounds: int) -> DataFrame:
        """``state`` after ``rounds`` iterations: rows of ``part`` replace their own, the others have only shrunk."""
        idle = self._idle(rounds)
        new = part.select("feature", F.lit(True).alias("is_new"), *[F.col(name).alias(f"new_{name}") for name in self._state])
        met = state.join(new.hint("shuffle_hash"), "feature", "left")
        return met.select("feature", *[F.when(F.col("is_new"), F.col(f"new_{n}")).otherwise(idle.get(n, F.col(n))).alias(n) for n in self._state])


def train(
    points: DataFrame | ColumnStore,
    model: str | Objective,
    *,
    step: float,
    batch_size: int,
    iterations: int,
    reg: float = 0.0,
    num_features: int | None = None,
    k: int | None = None,
    seed: int = 42,
    valid_ratio: float = 0.01,
    valid_every: int = 1000,
    optimizer: Optimizer | None = None,
    partitions: int | None = None,
    history: bool = True,
    hidden: int | list[int] = 500,
    profile: Profile | None = None,
    placement: st.Placement | None = None,
):
    """Train on ``points(row_id, label, features)``, or on their stored column split, and return the model with its history.

    ``model`` is ``lr``, ``svm``, ``mlr``, ``fm``, ``adamlr``, ``adamsvm``, ``mlp``, ``adammlp`` or an
    :class:`Objective`. ``k`` is the number of classes (mlr, mlp) or factors (fm), ``hidden`` the size of a perceptron's
    hidden layer or a list of such sizes. Every iteration draws
    ``batch_size`` rows with replacement, shrinks the weights by ``1 - reg`` and steps by
    ``step / batch_size`` times the batch gradient. The sampled loss over ``valid_ratio`` of the rows is
    taken every ``valid_every`` iterations and is null in between.
    """
    if isinstance(model, str) and model.lower() in ("mlp", "adammlp"):
        from slicegrad.plans.layers import train_layers
        from slicegrad.plans.mlp import train_mlp

        if optimizer is None and model.lower() == "adammlp":
            optimizer = Adam()
        settings = {
            "step": step, "batch_size": batch_size, "iterations": iterations, "reg": reg, "num_features": num_features,
            "classes": k or 2, "hidden": hidden, "seed": seed, "history": history, "profile": profile, "partitions": partitions,
            "placement": placement, "valid_ratio": valid_ratio, "valid_every": valid_every,
        }
        if optimizer is None and isinstance(hidden, int) and not isinstance(points, ColumnStore):
            return train_mlp(points, **settings)
        return train_layers(points, optimizer=optimizer, **settings)
    run = Run(
        points, model, step=step, batch_size=batch_size, reg=reg, num_features=num_features, k=k, seed=seed,
        valid_ratio=valid_ratio, valid_every=valid_every, optimizer=optimizer, partitions=partitions, history=history,
        profile=profile, placement=placement,
    )
    return _train_together([run], iterations, seed)[0]


class Run:
    """One model in training: plan, state and history. Settings as in :func:`train`."""

    def __init__(
        self, points: DataFrame | ColumnStore, model: str | Objective, *, step: float, batch_size: int, reg: float = 0.0,
        num_features: int | None = None, k: int | None = None, seed: int = 42, valid_ratio: float = 0.01,
        valid_every: int = 1000, optimizer: Optimizer | None = None, partitions: int | None = None,
        history: bool = True, profile: Profile | None = None, placement: st.Placement | None = None,
    ):
        objective = make_objective(model, k) if isinstance(model, str) else model
        if optimizer is None:
            optimizer = Adam() if isinstance(model, str) and model.lower().startswith("adam") else Sgd()
        self.points, self.spark = points, points.sparkSession
        if isinstance(points, ColumnStore):
            profile, placement, partitions = points.profile, points.placement, points.placement.partitions
        self.profile = profile or profile_points(points, objective.classes, num_features)
        names = objective.weights()
        width = 1 + len(names) + len(optimizer.state(names))
        partitions = partitions or model_partitions(self.spark, self.profile.num_features, width)
        if placement is None:
            placement = st.plan_placement(self.profile.num_features, width, partitions, points)
        self.placement, self.batch_size, self.history = placement, batch_size, history
        self.valid_every, self.valid_size = valid_every, sample_size(valid_ratio, self.profile.n_rows)
        self.plan = Plan(objective, optimizer, placement, batch_size, step, reg)
        self.tasks = max(partitions, batch_size // SLOTS_PER_TASK + 1) if placement.small else partitions
        self.records: list = []
        self._part = self._last = None  # of a large model: the rows in work, and the last batch with its statistics
        with loop_settings(self.spark, self.tasks):
            self.state = cut_lineage(initial_state(self.spark, objective, optimizer, self.profile.num_features, partitions, seed))

    def reader(self, iterations: int, seed: int) -> BatchReader:
        if isinstance(self.points, ColumnStore):
            return self.points.reader(self.batch_size, iterations, seed)
        facts = (self.points, self.profile.n_rows, self.batch_size, iterations, seed)
        return BatchReader(*facts) if self.placement.small else SplitReader(*facts, self.placement)

    def iterate(self, t: int, reader: BatchReader) -> None:
        with loop_settings(self.spark, self.tasks):
            plan, small = self.plan, self.placement.small
            valid_loss = None
            if self.history and t % self.valid_every == 0 and self.valid_size:
                valid_loss = plan.loss(_sampled_stats(plan, self.state, self.points, self.profile.n_rows, self.valid_size))
            if not small and plan.objective.touched_only():
                stats = self._advance(t, reader)
                if self.history:
                    self.records.append((t, plan.loss(stats), valid_loss, None))
                return
            batch = reader.batch(t)
            stats = plan.stats(batch, self.state)
            if not small:
                stats = cut_lineage(stats)  # read by hot cells, cold cells and the loss
            elif self.history:
                stats = stats.persist()
            if self.history:
                self.records.append((t, plan.loss(stats), valid_loss, None))
            self.state = cut_lineage(plan.step(batch, stats, self.state))
            if self.history and small:
                stats.unpersist()

    def _advance(self, t: int, reader: SplitReader) -> DataFrame:
        """Statistics of iteration ``t`` of a large model; its update belongs to the next job.

        A stretch of up to ``MERGE_EVERY`` iterations works on the rows it will touch. One job per iteration applies the update
        of the iteration before and sums the new statistics, which are all it writes; the updated rows are kept in memory, and
        follow again from the stretch's first rows and the written statistics if an executor is lost. The stretch's end
        merges them into the model. So what is written follows the batches, but for the merge.

        A plan over kept rows holds the plan that made them, once for every reading. An update that reads the weights several
        times would make it grow by a power per iteration, so its rows are written as well.
        """
        if self._part is None:
            self._first = t
            self._end = min(t + MERGE_EVERY, reader.group_end(t))
            if self.history and self.valid_size:  # a sampled loss needs the whole model
                self._end = min(self._end, t - t % self.valid_every + self.valid_every)
            self._part = cut_lineage(self.plan.part(self.state, reader.touched(t, self._end)))
        batch, held = reader.batch(t), None
        if self._last:
            held, self._part = self._part, self.plan.step(*self._last, self._part)
            self._part = self._part.persist() if self.plan.reads_once else cut_lineage(self._part)
        stats = cut_lineage(self.plan.stats(batch, self._part))
        if held is not None and t - self._first > 1:
            held.unpersist()
        self._last = (batch, stats)
        if t + 1 == self._end:
            done = self.plan.step(*self._last, self._part)
            self.state = cut_lineage(self.plan.merged(self.state, done, self._end - self._first))
            if t > self._first:
                self._part.unpersist()
            self._part = self._last = None
        return stats

    def model(self) -> Model:
        table = self.spark.createDataFrame(self.records, HISTORY_SCHEMA)
        return Model(self.plan.objective, self.state, table, self.profile.num_features, self.placement, self.records)


def _train_together(runs: list[Run], iterations: int, seed: int) -> list[Model]:
    """Advance all runs side by side, so that a group of batches is drawn, split and written once for all of them.

    Models of the same placement share a reader: all small ones, and large ones that were given one placement.
    """
    readers: dict = {}
    try:
        for t in range(iterations):
            for run in runs:
                key = None if run.placement.small else id(run.placement)
                if key not in readers:
                    readers[key] = run.reader(iterations, seed)
                run.iterate(t, readers[key])
    finally:
        for reader in readers.values():
            reader.close()
    return [run.model() for run in runs]


def sample_size(ratio: float, n_rows: int) -> int:
    """Rows of a sampled loss: the share of all rows, but at least one; none for a share of zero."""
    return max(1, int(ratio * n_rows)) if ratio else 0


def _sampled_stats(
    plan: Plan, state: DataFrame, points: DataFrame | ColumnStore, n_rows: int, size: int, seed: int = EVALUATION_SEED
) -> DataFrame:
    if isinstance(points, ColumnStore):
        return plan.stats(points.sampled(size, seed), state)
    slots = draw_slots(points.sparkSession, n_rows, size, 1, seed)
    return plan.stats(gather(points, slots, size, n_rows), state)


def evaluate(
    model: Model, points: DataFrame, valid_ratio: float = 0.01, seed: int = EVALUATION_SEED,
    n_rows: int | None = None,
) -> DataFrame:
    """Mean loss over rows sampled with replacement from ``points``: one row ``(n, loss)``."""
    n_rows = n_rows or points.count()
    size = sample_size(valid_ratio, n_rows)
    if not size:
        raise ValueError("a loss needs a share of the rows above zero")
    placement = model.placement
    if placement.small:
        return (plan := Plan(model.objective, Sgd(), placement)).mean(_sampled_stats(plan, model.state, points, n_rows, size, seed))
    # hot features are those of the drawn rows, which need not be the training points
    drawn = cut_lineage(gather(points, draw_slots(points.sparkSession, n_rows, size, 1, seed), size, n_rows))
    placement = st.split_placement(drawn, 1 + len(model.objective.weights()), placement.partitions)
    plan = Plan(model.objective, Sgd(), placement)
    return plan.mean(plan.stats(drawn, model.state))


def score(model: Model, points: DataFrame) -> DataFrame:
    """Statistics over all rows instead of a batch; for a large model with the hot features of these rows."""
    batch = points.select(F.col("row_id").alias("slot"), "label", "features")
    placement = model.placement
    if not placement.small:
        placement = st.split_placement(points, 1 + len(model.objective.weights()), placement.partitions)
    stats = Plan(model.objective, Sgd(), placement).stats(batch, model.state)
    scores = [column.alias(name) for name, column in model.objective.scores().items()]
    return staged(stats, model.objective.stages()).select(F.col("slot").alias("row_id"), "label", *scores)


def train_all(points: DataFrame | ColumnStore, chain: str, **settings) -> dict[str, Model]:
    """Train several models, named as in ``"LR-SVM-FM"``, over the same points.

    The pass that counts and checks the rows is shared, and so are the batches, since the models advance side by side; a
    perceptron trains by itself. Points that are dear to compute should be written first
    (:func:`slicegrad.session.written`): drawing reads them once per group of batches.
    """
    profiles: dict[int, Profile] = {}
    runs, trained = {}, {}
    names, perceptrons = chain.lower().split("-"), ("mlp", "adammlp")
    for name in names:
        k = settings.get("k")
        classes = (k or 2) if name in perceptrons else make_objective(name, k).classes
        if classes not in profiles and isinstance(points, ColumnStore):
            profiles[classes] = points.profile
        elif classes not in profiles:
            profiles[classes] = profile_points(points, classes, settings.get("num_features"))
        own = {**settings, "profile": profiles[classes]}
        if name in perceptrons:
            trained[name] = train(points, name, **own)
            continue
        own.pop("hidden", None)
        own.pop("iterations")
        runs[name] = Run(points, name, **own)
    together = _train_together(list(runs.values()), settings["iterations"], settings.get("seed", 42))
    trained |= dict(zip(runs, together))
    return {name: trained[name] for name in names}
