"""Text formats: libsvm, click logs, edge lists, plain text."""

import brute
import pytest
from conftest import make_points, random_rows
from pyspark.sql import functions as F

from slicegrad.operators.columns import to_feats
from slicegrad.sources import clicklog, libsvm, texts


def lines_to_path(tmp_path, name, lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_libsvm_edge_cases(spark, tmp_path):
    path = lines_to_path(
        tmp_path, "a.txt",
        ["# a comment", "", "1 1:0.5   3:-2", "   0 2:4 ", "1", "-1.5 10:1e-3", "  # indented"],
    )
    got = libsvm.read_libsvm(spark, path).orderBy("row_id").collect()
    assert [r.row_id for r in got] == [0, 1, 2, 3]
    cells = [(r.label, [(c.feature, c.value) for c in r.features]) for r in got]
    assert cells == [
        (1.0, [(0, 0.5), (2, -2.0)]), (0.0, [(1, 4.0)]), (1.0, []), (-1.5, [(9, 0.001)]),
    ]


@pytest.mark.parametrize("line", ["1 3:1 2:1", "1 0:1 2:1", "1 2:1 2:3"])
def test_libsvm_bad_indices_raise(spark, tmp_path, line):
    path = lines_to_path(tmp_path, "bad.txt", ["0 1:1", line])
    with pytest.raises(Exception, match="one-based and in ascending order"):
        libsvm.scan_libsvm(spark, path).collect()


def test_libsvm_round_trip(spark, tmp_path):
    rows = random_rows(n=40)
    rows[7] = (1, {})
    points = make_points(spark, rows)
    path = str(tmp_path / "out")
    libsvm.write_libsvm(points.repartition(3), path)
    back = libsvm.read_libsvm(spark, path)
    assert sorted(r[0] for r in back.select("row_id").collect()) == list(range(40))
    plain = lambda df: sorted((r.label, [tuple(c) for c in r.features]) for r in df.collect())
    assert plain(back) == plain(points)


def test_libsvm_keeps_cells_of_value_zero(spark, tmp_path):
    points = make_points(spark, [(1, {0: 0.0, 3: 2.5}), (0, {2: 0.0})])
    path = str(tmp_path / "out")
    libsvm.write_libsvm(points, path)
    back = sorted((r.label, [tuple(c) for c in r.features]) for r in libsvm.scan_libsvm(spark, path).collect())
    assert back == [(0.0, [(2, 0.0)]), (1.0, [(0, 0.0), (3, 2.5)])]


def test_libsvm_agrees_with_the_native_reader(spark, tmp_path):
    path = str(tmp_path / "out")
    libsvm.write_libsvm(make_points(spark, random_rows(n=20)), path)
    rows = texts.load_vectors(spark, path, 12, 2)
    assert rows.rdd.getNumPartitions() == 2
    native = sorted((r.label, sorted(zip(r.features.indices, r.features.values))) for r in rows.collect())
    ours = sorted(
        (r.label, [(c.feature, c.value) for c in r.features]) for r in libsvm.scan_libsvm(spark, path).collect()
    )
    assert [(y, [(int(f), float(v)) for f, v in cells]) for y, cells in native] == ours
    merged = texts.load_vectors(spark, path, partitions=1, shuffle=False)
    assert merged.rdd.getNumPartitions() == 1


def test_vector_partitions_grow_with_the_text(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    libsvm.write_libsvm(make_points(spark, random_rows(n=60)).repartition(3), path)
    size = sum(f.stat().st_size for f in (tmp_path / "out").glob("part-*"))
    monkeypatch.setattr(texts, "VECTOR_TEXT_BYTES", size // 6)
    for name in (path, path + "/part-*"):
        rows = texts.load_vectors(spark, name, 12, 2)
        assert rows.rdd.getNumPartitions() in (6, 7) and rows.count() == 60
        assert texts.load_vectors(spark, name, 12, 9).rdd.getNumPartitions() == 9


def click_line(label, integers, categories):
    integers = [integers.get(i, "") for i in range(1, 14)]
    categories = [categories.get(i, "") for i in range(1, 27)]
    return "\t".join(str(v) for v in [label, *integers, *categories])


def expected_cells(categories, n):
    sums = {}
    for i in range(26):
        h = brute.word(f"{i}:{categories.get(i + 1, '')}")
        h = h - 2**32 if h >= 2**31 else h
        bucket = 13 + abs(h) % n
        sums[bucket] = sums.get(bucket, 0) + (1 if h >= 0 else -1)
    return {b: float(s) for b, s in sums.items() if s}


def test_click_log(spark, tmp_path):
    logs = [(1, {1: 3, 2: -4}, {1: "abc", 26: "z"}), (0, {}, {}), (-1, {13: 7}, {2: '"quoted"'})]
    path = lines_to_path(tmp_path, "clicks.tsv", [click_line(*log) for log in logs])
    clicks = clicklog.read_criteo(spark, path)
    assert clicks.where("c26 is null or i5 is null").count() == 0
    for n in (7, 1000):
        got = clicklog.criteo_features(clicks, n).collect()
        want = []
        for label, integers, categories in logs:
            cells = {i - 1: float(integers.get(i, 0)) for i in range(1, 14)}
            want.append((1.0 if label > 0 else 0.0, sorted({**cells, **expected_cells(categories, n)}.items())))
        assert sorted((r.label, [(c.feature, c.value) for c in r.features]) for r in got) == sorted(want)


def test_missing_categories_can_be_left_out(spark, tmp_path):
    path = lines_to_path(tmp_path, "clicks.tsv", [click_line(1, {}, {})])
    points = clicklog.criteo_features(clicklog.read_criteo(spark, path), 50, hash_missing=False)
    assert [c.feature for c in points.first().features] == list(range(13))


def test_click_log_to_libsvm(spark, tmp_path):
    path = lines_to_path(tmp_path, "clicks.tsv", [click_line(i % 2, {1: i}, {1: str(i)}) for i in range(50)])
    target = str(tmp_path / "hashed")
    clicklog.clicks_to_libsvm(spark, path, target, 100)
    assert libsvm.scan_libsvm(spark, target).count() == 50
    bigger = str(tmp_path / "resampled")
    clicklog.clicks_to_libsvm(spark, path, bigger, 100, fraction=3.0)
    assert libsvm.scan_libsvm(spark, bigger).count() > 80


@pytest.mark.parametrize("method", ["md5", "xxhash64"])
def test_long_and_row_hashing_agree(spark, method):
    df = spark.createDataFrame([(i, f"a{i % 5}", None if i % 3 else "b", f"c{i}") for i in range(60)], "id long, x string, y string, z string")
    for missing in (True, False):
        tokens = clicklog.category_tokens(["x", "y", "z"], missing)
        long = clicklog.hash_features(df, "id", tokens, 4, method)
        keep = [F.col("id").alias("row_id"), F.lit(0.0).alias("label")]
        wide = clicklog.hash_in_row(df, keep, "features", tokens, 4, method)
        left = {(r.row_id, r.bucket, float(r.value)) for r in long.collect()}
        right = {(r.row_id, r.feature, r.value) for r in to_feats(wide).collect()}
        assert left == right and left


def test_hash_of_the_smallest_word(spark):
    from slicegrad.functions.hashing import hash_bucket, hash_sign

    row = spark.range(1).select(
        hash_bucket(F.lit(-(2**31)).cast("bigint"), 10).alias("b"), hash_sign(F.lit(-(2**31))).alias("s")
    ).first()
    assert (row.b, row.s) == (8, -1)


def test_edges_and_text(spark, tmp_path):
    path = lines_to_path(tmp_path, "edges.txt", ["# src dst", "1 2", "", "  2\t3", "3    1", "1 2"])
    edges = sorted(tuple(r) for r in texts.read_edges(spark, path).collect())
    assert edges == [(1, 2), (1, 2), (2, 3), (3, 1)]
    source = lines_to_path(tmp_path, "text.txt", [str(i) for i in range(1000)])
    texts.rewrite_files(spark, source, str(tmp_path / "eight"), 8)
    assert len(list((tmp_path / "eight").glob("part-*"))) == 8
    assert sorted(int(r[0]) for r in spark.read.text(str(tmp_path / "eight")).collect()) == list(range(1000))
    texts.sample_text(spark, source, str(tmp_path / "some"), 0.3, seed=1)
    kept = [r[0] for r in spark.read.text(str(tmp_path / "some")).collect()]
    assert 200 < len(kept) < 400 and len(set(kept)) == len(kept)


def test_cells_of_unshared_buckets_come_from_generated_code(spark):
    tokens = [F.concat(F.lit(f"{i}:"), F.col("id").cast("string")) for i in range(5)]
    hashed = clicklog.hash_in_row(spark.range(300), [F.col("id")], "cells", tokens, 64)
    plan = hashed._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "aggregate(" in plan  # the lambda is left to rows that share a bucket
    assert hashed.where("size(cells) = 5").count() > 100 and hashed.where("size(cells) < 5").count() > 10
