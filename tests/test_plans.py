"""Shape of the physical plans: what is read, what is shuffled, what is broadcast."""

import math
import re
import shutil

import pytest
from conftest import make_points, random_rows
from pyspark.sql import functions as F

from slicegrad.functions import scalars as S
from slicegrad.operators import statistics as st
from slicegrad.operators.pagerank import count_pairs, weigh_pairs
from slicegrad.operators.sampling import draw_slots
from slicegrad.plans import layers, mlp
from slicegrad.plans import store as store_module
from slicegrad.plans import train as train_module
from slicegrad.plans.batches import BatchReader, SplitReader, gather
from slicegrad.plans.objectives import Adam, Logistic, Sgd, Softmax
from slicegrad.plans.store import store_columns
from slicegrad.plans.train import Plan, evaluate, initial_state, train
from slicegrad.session import BROADCAST_BYTES, cut_lineage, fits_broadcast, loop_settings
from slicegrad.sources.clicklog import category_tokens, hash_features


@pytest.fixture(autouse=True)
def no_automatic_broadcast(spark):
    """Tables here are tiny; without this Spark would broadcast the model by itself."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def skewed_rows(n=400):
    rows = random_rows(n=n, features=200, density=0.02)
    return [(y, {**cells, 0: 1.0}) for y, cells in rows]


def split_setup(spark, partitions=4):
    points = make_points(spark, skewed_rows())
    placement = st.split_placement(points, 1, partitions)
    objective = Logistic()
    plan = Plan(objective, Sgd(), placement, 50, 0.1, 0.0)
    with loop_settings(spark, partitions):
        state = cut_lineage(initial_state(spark, objective, Sgd(), 200, partitions, 42))
        batch = SplitReader(points, 400, 50, 2, 42, placement).batch(1)
    return points, placement, plan, state, batch


def test_hot_features_are_few_and_found(spark):
    points = make_points(spark, skewed_rows())
    placement = st.split_placement(points, 1, 4)
    hot = {r.feature for r in placement.hot.collect()}
    assert 0 in hot and len(hot) <= 16
    assert fits_broadcast(10_000, 4) and not fits_broadcast(BROADCAST_BYTES, 1)
    assert st.plan_placement(100, 3, 4, points).small
    assert not st.plan_placement(10**8, 3, 4, points).small


def test_statistics_shuffle_neither_the_model_nor_the_cells(spark):
    _, _, plan, state, batch = split_setup(spark)
    with loop_settings(spark, 4):
        text = executed(plan.stats(batch, state))
    # The statistics go to their slots; nothing else moves.
    exchanges = re.findall(r"Exchange hashpartitioning\(([a-z_]+)", text)
    assert exchanges == ["slot"]
    assert "ShuffledHashJoin" in text and "SortMergeJoin" not in text


def test_scoring_hashes_the_model_not_the_cells(spark):
    points, placement, plan, state, _ = split_setup(spark)
    with loop_settings(spark, 4):
        text = executed(plan.stats(points.withColumnRenamed("row_id", "slot"), state))
    exchanges = re.findall(r"Exchange hashpartitioning\(([a-z_]+)", text)
    assert sorted(exchanges) == ["feature", "slot"]
    assert re.search(r"ShuffledHashJoin \[feature#\d+\], \[feature#\d+\], Inner, BuildRight", text)


def test_an_update_shuffles_neither_the_model_nor_the_cells(spark):
    _, _, plan, state, batch = split_setup(spark)
    with loop_settings(spark, 4):
        stats = cut_lineage(plan.stats(batch, state))
        text = executed(plan.step(batch, stats, state))
    scan = text.index("Scan ExistingRDD[feature")
    before = text[:scan].splitlines()
    assert not any("Exchange" in line for line in before), "the model side of the join must stay in place"
    assert "BroadcastHashJoin" in text
    # The one exchange by feature carries a task's sums of the hot features.
    assert re.findall(r"Exchange hashpartitioning\(([a-z_]+)", text) == ["feature"]
    below = text[text.index("Exchange hashpartitioning(feature") :].splitlines()[1]
    assert "HashAggregate" in below


def test_an_iteration_reads_only_its_own_cells(spark):
    _, _, plan, state, batch = split_setup(spark)
    assert re.search(r"PushedFilters: \[IsNotNull\(t\), EqualTo\(t,1\)\]", executed(batch.cold))
    assert re.search(r"PartitionFilters: \[isnotnull\(t#\d+\), \(t#\d+ = 1\)\]", executed(batch.hot))


def test_an_iteration_reads_only_its_own_batch(spark):
    points = make_points(spark, skewed_rows())
    batch = BatchReader(points, 400, 50, 2, 42).batch(1)
    text = executed(batch.select("slot", F.inline("features")))
    assert re.search(r"PartitionFilters: \[isnotnull\(t#\d+\), \(t#\d+ = 1\)\]", text)
    assert "label" not in re.search(r"ReadSchema: (.*)", text).group(1)


def test_small_models_shuffle_statistics_only(spark):
    points = make_points(spark, skewed_rows())
    objective = Logistic()
    plan = Plan(objective, Adam(), st.Placement(1), 50, 0.1, 0.0)
    state = cut_lineage(initial_state(spark, objective, Adam(), 200, 1, 42))
    batch = BatchReader(points, 400, 50, 1, 42).batch(0)
    with loop_settings(spark, 2):
        text = executed(plan.stats(batch, state))
        assert re.findall(r"Exchange hashpartitioning\(([a-z_]+)", text) == ["slot"]
        assert "partial_sum" in text


def test_the_perceptron_does_not_shuffle_its_weights(spark):
    points = make_points(spark, skewed_rows())
    placement, shape = st.split_placement(points, 8, 4), mlp.Shape(200, 8, 2)
    network = mlp.Network(shape, placement, 50, 0.1, 0.0)
    batch = BatchReader(points, 400, 50, 1, 42).batch(0)
    with loop_settings(spark, 4):
        state = cut_lineage(mlp.mlp_init(spark, shape, 42, 4))
        hidden = network.hidden(batch, state)
        plans = [hidden]
        hidden = cut_lineage(hidden)
        out = cut_lineage(network.outputs(hidden, state))
        plans.append(network.step(batch, hidden, out, state))
        for plan in plans:
            lines = executed(plan).splitlines()
            for above, line in zip(lines, lines[1:]):
                if "Scan ExistingRDD[layer" in line:
                    assert "Exchange hashpartitioning" not in above
            assert not any("Exchange hashpartitioning(layer" in line for line in lines)


def split_passes(spark, batch_size=50):
    points = make_points(spark, skewed_rows())
    stack = layers.stack(200, [20, 6], 2)
    placement = st.split_placement(points, 20, 4)
    passes = layers.Passes(stack, placement, batch_size, Adam(), 0.1, 0.0)
    tables = [cut_lineage(table) for table in layers.initial_weights(spark, stack, Adam(), 42, 4)]
    return passes, tables, SplitReader(points, 400, batch_size, 1, 42, placement)


def test_split_cells_of_a_perceptron_stay_in_place(spark):
    """In neither pass of the first layer are cells or weights shuffled; what moves is summed per (slot, block) or per hot feature."""
    with loop_settings(spark, 4):
        passes, tables, reader = split_passes(spark)
        batch = reader.batch(0)
        forward = passes.first.forward(batch, tables[0])
        keys = re.findall(r"Exchange hashpartitioning\(([a-z_]+)#", executed(forward))
        assert set(keys) == {"slot"} and "partial_sum" in executed(forward)
        delta = cut_lineage(forward.select("slot", "block", *[F.col(f"h{p}").alias(f"d{p}") for p in range(10)]))
        backward = passes.first.backward(batch, delta, tables[0])
        lines = executed(backward).splitlines()
        exchanged = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
        assert len(exchanged) == 1 and "BroadcastExchange" in "".join(lines[: exchanged[0]])  # the hot features' sums, then broadcast
        below = "".join(lines[exchanged[0] + 1 : exchanged[0] + 3])
        assert "partial_sum" in below
        reader.close()


def test_passes_have_one_plan_whatever_the_depth(spark):
    """Every pass starts from written rows, so its plan is as long for the third layer as for the second."""
    points = make_points(spark, skewed_rows())
    sizes = {}
    for hidden in ([8, 8], [8, 8, 8, 8]):
        passes = layers.Passes(layers.stack(200, hidden, 2), st.Placement(1), 50, Sgd(), 0.1, 0.0)
        tables = [cut_lineage(table) for table in layers.initial_weights(spark, passes.layers, Sgd(), 42, 1)]
        batch, plans = BatchReader(points, 400, 50, 1, 42).batch(0), []

        def kept(df):
            plans.append(len(executed(df).splitlines()))
            return cut_lineage(df)

        acts = passes.forward(batch, tables, kept)
        delta = cut_lineage(S.staged(acts[-1], passes.stages).select(*passes._delta))
        plans.append(len(executed(passes.dense[-1].signals(acts[-2], delta, tables[-1])).splitlines()))
        sizes[len(hidden)] = plans
    assert sizes[4][0] == sizes[2][0] and max(sizes[4][1:]) <= max(sizes[2][1:]) + 1


def test_every_token_is_hashed_once(spark):
    df = spark.createDataFrame([(1, "a", None, "c")], "row_id long, x string, y string, z string")
    tokens = category_tokens(["x", "y", "z"], hash_missing=False)
    plan = hash_features(df, "row_id", tokens, 64)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 3


def test_evaluation_is_placed_by_its_own_rows(spark):
    """Feature 9 is hot only in the evaluated points; its cells are not sent to one task."""
    model = train(
        make_points(spark, skewed_rows()), "lr", step=0.1, batch_size=50, iterations=1, num_features=200, history=False, partitions=4,
        placement=st.split_placement(make_points(spark, skewed_rows()), 2, 4),
    )
    other = make_points(spark, [(i % 2, {9: 1.0, 10 + i % 150: 1.0}) for i in range(300)])
    assert 9 not in {r.feature for r in model.placement.hot.collect()}
    seen = []
    original = st.split_placement
    st.split_placement = lambda *a: seen.append(original(*a)) or seen[-1]
    try:
        assert evaluate(model, other, valid_ratio=0.5, n_rows=300).first().n == 150
    finally:
        st.split_placement = original
    assert {r.feature for r in seen[0].hot.collect()} == {9}


def test_a_large_model_writes_statistics_and_merges_now_and_then(spark, monkeypatch):
    points = make_points(spark, skewed_rows())
    written, original = [], train_module.cut_lineage

    def kept(df):
        done = original(df)
        written.append((done.columns, done.count()))
        return done

    monkeypatch.setattr(train_module, "cut_lineage", kept)
    settings = {"step": 0.1, "num_features": 200, "partitions": 4, "placement": st.split_placement(points, 1, 4), "history": False}
    train(points, "lr", batch_size=2, iterations=20, **settings)
    stats = [columns for columns, _ in written if "slot" in columns]
    assert len(stats) == 20 and len(written) == 1 + 20 + 2 * 3  # the start, and of each stretch of 8 its rows and a merge
    sizes = [n for columns, n in written if "slot" not in columns]
    assert sizes[0] == 200 and set(sizes[2::2]) == {200} and max(sizes[1::2]) < 120
    with loop_settings(spark, 4):  # the rows of a stretch are found, and merged, where they lie
        _, placement, plan, state, batch = split_setup(spark)
        touched = batch.cold.select("feature").dropDuplicates()
        part = plan.part(state, touched)
        assert "Exchange hashpartitioning" not in executed(part)
        assert "Exchange hashpartitioning" not in executed(plan.merged(state, cut_lineage(part), 3))


def test_the_plan_of_a_large_model_does_not_grow_with_its_iterations(spark, monkeypatch):
    """What an iteration plans over is written: no plan holds those of the iterations before."""
    from slicegrad.registry.jobs import Gated

    seen = []
    stats = Plan.stats

    def watched(self, batch, state):
        seen.append(len(state._jdf.queryExecution().optimizedPlan().toString()))
        assert "InMemory" not in executed(state) and len(seen) <= 5
        return stats(self, batch, state)

    monkeypatch.setattr(Plan, "stats", watched)
    points = make_points(spark, skewed_rows(60))
    settings = {"step": 0.1, "batch_size": 8, "iterations": 5, "num_features": 200, "partitions": 2, "history": False}
    train(points, Gated(), placement=st.split_placement(points, 3, 2), **settings)
    assert len(seen) == 5 and max(seen) < 1000


def test_the_sums_of_a_way_back_are_taken_once(spark, monkeypatch):
    """Hot and cold cells read the written sums, and the given statistics, written before, are not written again."""
    from slicegrad.registry.jobs import Gated

    points, placement, _, _, batch = split_setup(spark)
    plan, written = Plan(Gated(), Sgd(), placement, 50, 0.1, 0.0), []
    with loop_settings(spark, 4):
        state = cut_lineage(initial_state(spark, Gated(), Sgd(), 200, 4, 42))
        stats = cut_lineage(plan.stats(batch, state))
        monkeypatch.setattr(train_module, "cut_lineage", lambda df: written.append(df) or cut_lineage(df))
        text = executed(plan.step(batch, stats, state))
    assert len(written) == 1 and "pull" in written[0].columns
    assert "keys=[feature" in text and "keys=[slot" not in text


def test_a_second_run_draws_from_the_store_without_the_points(spark, tmp_path, monkeypatch):
    make_points(spark, skewed_rows()).write.parquet(str(tmp_path / "points"))
    points = spark.read.parquet(str(tmp_path / "points"))
    store = store_columns(points, num_features=200, columns=1, partitions=4, max_cells=300)
    assert store.rows.select("chunk").distinct().count() > 3
    settings = {"step": 0.1, "reg": 0.01, "batch_size": 20, "iterations": 3, "valid_ratio": 0.1, "valid_every": 1}
    first = train(store, "lr", seed=7, **settings)
    shutil.rmtree(tmp_path / "points")
    again = train(store, "lr", seed=7, **settings)
    assert {tuple(r) for r in first.weights().collect()} == {tuple(r) for r in again.weights().collect()}
    direct = train(make_points(spark, skewed_rows()), "lr", seed=7, num_features=200, partitions=4, placement=store.placement, **settings)
    got, want = ({r.feature: r.w for r in m.weights().collect()} for m in (again, direct))
    assert got == pytest.approx(want)
    for mine, other in zip(again.records, direct.records):
        assert mine[1] == pytest.approx(other[1]) and mine[2] == pytest.approx(other[2])
    perceptron = train(store, "mlp", hidden=[3], seed=7, **settings)
    assert len(perceptron.records) == 3
    with loop_settings(spark, 4):  # the drawn cells stay in their buckets, and only hit chunks are read
        slots = spark.createDataFrame([(0, 0, 5), (0, 1, 6)], "t int, slot int, row_id long")
        cold = store.drawn(slots, 2)[1]
        text = executed(cold)
        assert "Exchange hashpartitioning" not in text and "Bucketed: true" in text
        assert re.search(r"PushedFilters: \[[^]]*(In|EqualTo)\(chunk", text)
    store.close()


def test_a_large_draw_is_not_broadcast(spark):
    """A slot takes some 90 bytes of a broadcast: 1,350,000 of them took 134 MB."""
    points = make_points(spark, skewed_rows())
    for n_slots, near in ((100_000, True), (400_000, False)):
        text = executed(gather(points, draw_slots(spark, 400, n_slots), n_slots, 400))
        assert ("BroadcastHashJoin" in text) == near and ("ShuffledHashJoin" in text) != near
    with loop_settings(spark, 4):  # nor does Spark's own estimate decide
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"


def test_a_store_is_drawn_from_in_pieces(spark, monkeypatch):
    points = make_points(spark, skewed_rows())
    store = store_columns(points, num_features=200, columns=1, partitions=4, max_cells=300)
    settings = {"step": 0.1, "reg": 0.01, "batch_size": 20, "iterations": 3, "valid_ratio": 0.1, "valid_every": 1}
    assert store_module.pieces_of(100_000) == 1 and store_module.pieces_of(1_350_000) > 8
    models = []
    for pieces in (1, 3):
        monkeypatch.setattr(store_module, "pieces_of", lambda n, pieces=pieces: pieces)
        models.append(train(store, "lr", **settings))
    got, want = ({r.feature: r.w for r in m.weights().collect()} for m in models)
    assert got == pytest.approx(want)
    for mine, other in zip(models[1].records, models[0].records):
        assert mine[1] == pytest.approx(other[1]) and mine[2] == pytest.approx(other[2])
    store.close()


def test_no_python_in_the_loop(spark):
    _, _, plan, state, batch = split_setup(spark)
    with loop_settings(spark, 4):
        stats = plan.stats(batch, state)
        text = executed(stats) + executed(plan.step(batch, cut_lineage(stats), state))
    assert "Python" not in text and "Pandas" not in text and "CartesianProduct" not in text


@pytest.mark.parametrize("size", [400, 0])
def test_hot_features_need_no_python_where_they_are_read(spark, size):
    placement = st.split_placement(make_points(spark, skewed_rows(size) or [(0, {})]), 1, 4)
    assert "LocalTableScan" in executed(placement.hot) and "ExistingRDD" not in executed(placement.hot)
    assert placement.hot.dtypes == [("feature", "int")] and placement.hot.isEmpty() == (size == 0)


def test_plans_grow_with_the_classes_only(spark):
    """The softmax is staged: its plan for four times the classes is about four times as long."""
    def factors(classes):
        objective = Softmax(classes)
        plan = Plan(objective, Sgd(), st.Placement(1), 50, 0.1, 0.0)
        stats = spark.createDataFrame(
            [(0, 3.0, *[0.5] * classes)], ", ".join(["slot int", "label double", *[f"{n} double" for n in objective.stats()]])
        )
        staged = S.staged(stats, plan.stages).select("slot", *[c.alias(n) for n, c in objective.coefs().items()])
        return plan, stats, staged

    spark.conf.set("spark.sql.debug.maxToStringFields", "1000000")
    try:
        sizes = [len(factors(classes)[2]._jdf.queryExecution().optimizedPlan().toString()) for classes in (20, 80)]
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert sizes[1] < 6 * sizes[0]
    plan, stats, staged = factors(200)
    row = staged.first()
    assert row.c3 == pytest.approx(1 / 200 - 1) and row.c4 == pytest.approx(1 / 200)
    assert plan.loss(stats) == pytest.approx(math.log(200))


def test_hubs_are_set_apart_before_the_degree_join(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1, 100)], "src long, dst long")
    pairs, degrees, n_pairs = count_pairs(edges)
    with loop_settings(spark, 4):
        cold, (hot, hubs) = weigh_pairs(pairs, degrees, n_pairs, 4)
        assert [r.src for r in hubs.collect()] == [0]
        assert {r.src for r in hot.collect()} == {0} and cold.where("src = 0").isEmpty()
        assert cold.rdd.getNumPartitions() == 4


def test_pairs_are_written_once_and_as_columns(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1, 100)], "src long, dst long")
    pairs, degrees, n_pairs = count_pairs(edges)
    assert pairs.inputFiles() and n_pairs == pairs.count() == 398
    with loop_settings(spark, 4):
        cold, (hot, hubs) = weigh_pairs(pairs, degrees, n_pairs, 4)
        assert set(cold.inputFiles()) == set(hot.inputFiles()) == set(pairs.inputFiles())  # no copies of them
        shares = cold.union(hot).groupBy("src").agg(F.sum("share").alias("s"))
        assert shares.count() == 100 and shares.where("abs(s - 1) > 1e-12").isEmpty()
