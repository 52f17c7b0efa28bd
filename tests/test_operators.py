"""Single operators: splits, ids, draws, scalars, PageRank."""

import math

import brute
import pytest
from conftest import make_points, random_rows
from pyspark.sql import functions as F

from slicegrad.functions import scalars as S
from slicegrad.functions.hashing import draw_index, gaussian
from slicegrad.operators import columns as co
from slicegrad.operators import sampling as sa
from slicegrad.operators.pagerank import pagerank, top_ranks, weigh_edges


@pytest.mark.parametrize("x", [-800.0, -1.0, 0.0, 1.0, 800.0])
def test_log1pexp(spark, x):
    got = spark.range(1).select(S.log1pexp(F.lit(x))).first()[0]
    assert got == pytest.approx(max(x, 0) + math.log1p(math.exp(-abs(x))))


def test_softmax_of_large_scores(spark):
    scores = [F.lit(800.0), F.lit(-800.0), F.lit(799.0)]
    names = ["s0", "s1", "s2"]
    rows = S.staged(spark.range(1).select(*[s.alias(n) for s, n in zip(scores, names)]), S.softmax_stages(names))
    row = rows.select(*S.softmax(3), S.log_sum_exp(), S.pick(scores, F.lit(2))).first()
    assert sum(row[:3]) == pytest.approx(1.0) and row[1] == 0.0
    assert row[3] == pytest.approx(800 + math.log1p(math.exp(-1))) and row[4] == 799.0


def test_hinge_is_inactive_at_margin_one(spark):
    row = spark.range(1).select(
        S.hinge_coef(F.lit(1.0), F.lit(1.0)), S.hinge_coef(F.lit(0.999), F.lit(1.0)), S.hinge_coef(F.lit(-1.0), F.lit(0.0))
    ).first()
    assert tuple(row) == (0.0, -1.0, 0.0)


def test_draws_follow_the_digest(spark):
    got = [r.row_id for r in sa.minibatch_slots(spark, 37, 100, t=3).orderBy("slot").collect()]
    assert got == brute.draws(37, 100, 3)
    groups = sa.draw_slots(spark, 37, 100, iterations=2, first=3)
    assert [r.row_id for r in groups.where("t = 3").orderBy("slot").collect()] == got


def test_draws_reach_all_of_a_huge_table(spark):
    n = 10**12
    ids = spark.range(2000).select(draw_index(n, 42, F.col("id")).alias("r")).agg(F.min("r"), F.max("r"), F.avg("r"))
    low, high, mean = ids.first()
    assert 0 <= low < n // 100 and n - n // 100 < high < n and abs(mean / n - 0.5) < 0.05


def test_duplicate_draws_fill_two_slots(spark):
    points = make_points(spark, [(1, {0: 1.0}), (0, {1: 2.0})])
    slots = spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "slot int, row_id long")
    assert sa.batch_cells(co.to_feats(points), slots).count() == 3
    assert {(r.slot, r.label) for r in sa.batch_labels(co.labels_of(points), slots).collect()} == {(0, 0.0), (1, 0.0), (2, 1.0)}


def test_gaussian(spark):
    rows = spark.range(4000).select("id", gaussian(7, F.col("id")).alias("g")).collect()
    assert rows[5].g == pytest.approx(brute.gauss(7, rows[5].id))
    mean = sum(r.g for r in rows) / len(rows)
    deviation = math.sqrt(sum((r.g - mean) ** 2 for r in rows) / len(rows))
    assert abs(mean) < 0.001 and abs(deviation - 0.01) < 0.001


def test_dense_ids(spark):
    df = spark.range(0, 5000, 1, 7).where("id % 3 <> 0").withColumn("x", F.col("id") * 2)
    numbered = co.with_dense_ids(df, "n").collect()
    assert sorted(r.n for r in numbered) == list(range(len(numbered)))
    assert sorted(r.id for r in numbered) == [i for i in range(5000) if i % 3]
    assert all(r.x == 2 * r.id for r in numbered)
    assert co.with_dense_ids(df.where("id < 0")).count() == 0


def test_columns_and_blocks(spark):
    rows = random_rows(n=50)
    points = make_points(spark, rows)
    cells = co.to_columns(points, 3, chunk_rows=8).collect()
    want = {(i, f, v) for i, (_, c) in enumerate(rows) for f, v in c.items()}
    assert {(r.row_id, r.feature, r.value) for r in cells} == want
    assert all((r.part, r.local, r.chunk) == (r.feature % 3, r.feature // 3, r.row_id // 8) for r in cells)
    back = set()
    for block in co.to_blocks(points, 3, chunk_rows=8).collect():
        assert len(block.row_ids) <= 8 and list(block.row_ids) == sorted(block.row_ids)
        start = 0
        for row, label, end in zip(block.row_ids, block.labels, block.offsets):
            assert label == rows[row][0]
            locals_ = block.local[start:end]
            assert locals_ == sorted(locals_)
            back |= {(row, f * 3 + block.part, v) for f, v in zip(locals_, block.value[start:end])}
            start = end
        assert start == len(block.value)
    assert back == want


def test_blocks_need_one_shuffle(spark):
    points = make_points(spark, random_rows(n=50))
    plan = co.to_blocks(points, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_resample(spark):
    df = spark.range(1000)
    assert sa.resample(df, 1.0).count() == 1000
    over = sa.resample(df, 2.0)
    assert 1700 < over.count() < 2300 and over.distinct().count() < 1000
    for rate in (0.3, 2.0):
        one, other = (sa.resample(df.repartition(n), rate, key=["id"]).collect() for n in (2, 5))
        assert sorted(one) == sorted(other) and abs(len(one) - 1000 * rate) < 200
    some = {r.id for r in sa.sample_rows(df, 0.3, key=["id"]).collect()}
    assert some == {r.id for r in sa.sample_rows(df.repartition(3), 0.3, key=["id"]).collect()} and 230 < len(some) < 370
    assert sa.resample(df, 0.0).count() == 0
    assert sa.round_robin(df, 5).rdd.getNumPartitions() == 5
    assert sa.merge_partitions(df.repartition(6), 2).rdd.getNumPartitions() == 2


GRAPHS = {
    "cycle": [(1, 2), (2, 3), (3, 1)],
    "dangling, parallel, loop": [(1, 2), (1, 2), (1, 3), (2, 2), (4, 1), (3, 5)],
    "hub": [(0, i) for i in range(1, 40)] + [(i, 0) for i in range(1, 40, 3)] + [(5, 6), (6, 7)],
}


@pytest.mark.parametrize("name", GRAPHS)
@pytest.mark.parametrize("partitions", [1, 4])
def test_pagerank(spark, name, partitions):
    edges = GRAPHS[name]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.id: r["rank"] for r in pagerank(df, partitions=partitions).collect()}
    want = brute.pagerank(edges)
    assert got.keys() == want.keys()
    assert all(got[v] == pytest.approx(want[v], abs=1e-9) for v in want)
    assert sum(got.values()) == pytest.approx(len(want))


def test_pagerank_options(spark):
    df = spark.createDataFrame(GRAPHS["hub"], "src long, dst long")
    raw = pagerank(df, normalize=False, max_rounds=1)
    assert raw.where("id = 8").first()["rank"] == pytest.approx(0.15 + 0.85 * 0.15 / 39)
    best = [r.id for r in top_ranks(pagerank(df), 3).collect()]
    assert best[0] == 0 and len(best) == 3
    shares = weigh_edges(df).groupBy("src").agg(F.sum("share").alias("s")).where("abs(s - 1) > 1e-12")
    assert shares.count() == 0


def test_blocks_are_bounded_by_their_cells(spark, monkeypatch):
    monkeypatch.setattr(co, "RANGE_ROWS", 8)
    rows = [(0, {f: 1.0 for f in range(n)}) for n in [3, 0, 40, 7, 7, 7, 0, 300, 5, 5, 1, 60] * 9]
    points = make_points(spark, rows)
    chunks = {r.row_id: r.chunk for r in co.cell_chunks(points, 400).collect()}
    assert len(chunks) == len(rows) and [chunks[i] for i in range(len(rows))] == sorted(chunks.values())
    sizes = {}
    for row, chunk in chunks.items():
        sizes[chunk] = sizes.get(chunk, 0) + len(rows[row][1])
    assert max(sizes.values()) <= 400 and len(sizes) < 60
    blocks = co.to_blocks(points, 3, max_cells=400).collect()
    assert sum(len(b.local) for b in blocks) == sum(len(c) for _, c in rows) and max(len(b.local) for b in blocks) <= 400
    wide = make_points(spark, [(0, {f: 1.0 for f in range(100_000)}) for _ in range(3)])
    blocks = co.to_blocks(wide, 4, max_cells=50_000).collect()
    assert len(blocks) == 12 and {len(b.local) for b in blocks} == {25_000}
