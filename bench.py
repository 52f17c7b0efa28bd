"""Headline timings; prints one JSON line.

Every query is timed once after one warm-up of the session, from the tables to a fully consumed result.
``$BENCH_SF_DIR`` names the tables, ``$BENCH_CPUS`` the number of cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from slicegrad.functions import scalars as S  # noqa: E402
from slicegrad.plans.baselines import baseline, coefficients  # noqa: E402
from slicegrad.plans.batches import profile_points  # noqa: E402
from slicegrad.plans.train import train  # noqa: E402
from slicegrad.registry import datasets as ds  # noqa: E402
from slicegrad.registry import jobs  # noqa: E402
from slicegrad.session import build_session, written  # noqa: E402

ITERATIONS = 20
QUERIES = [
    "read_libsvm", "to_columns", "to_blocks", "criteo_features", "hash_features", "batch_dot", "batch_grad",
    "train_lr", "train_svm", "train_mlr", "train_fm", "train_adamlr", "train_adamsvm", "train_lr_clicks",
    "train_lr_partitioned", "train_fm_partitioned", "train_lr_stored", "train_gated", "train_mlp", "train_mlp_deep",
    "train_mlp_partitioned", "evaluate", "score", "score_partitioned", "train_all",
    "hash_present", "load_vectors", "resample", "pagerank",
    "baseline_svm", "baseline_lr", "baseline_mlr", "baseline_svm_sgd", "baseline_lr_sgd", "baseline_mlp",
]


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def per_iteration(spark, sf_dir: str) -> dict[str, float]:
    """Seconds per iteration over 20 iterations, drawing included; batch of a twentieth of the rows."""
    points = ds.event_points(spark, sf_dir)
    profile = profile_points(points, 2, ds.EVENT_FEATURES)
    seconds = {}
    for model in ("lr", "fm"):
        started = time.time()
        train(
            points, model, step=0.5, reg=0.01, batch_size=profile.n_rows // 20, iterations=ITERATIONS,
            profile=profile, history=False,
        )
        seconds[f"iteration_{model}"] = (time.time() - started) / ITERATIONS
    dense = ds.embedding_points(spark, sf_dir)
    profile = profile_points(dense, ds.EMBEDDING_CLASSES, ds.EMBEDDING_SIZE)
    started = time.time()
    train(
        dense, "mlp", k=ds.EMBEDDING_CLASSES, step=0.05, batch_size=256, iterations=5, hidden=500, profile=profile,
        history=False,
    )
    seconds["iteration_mlp_500"] = (time.time() - started) / 5
    return seconds


def mean_loss(points, weights: list[tuple], model: str) -> float:
    """Mean loss of a linear model over all points."""
    table = points.sparkSession.createDataFrame([(f, w) for f, _, w in weights], "feature int, w double")
    cells = points.select("row_id", "label", F.inline("features")).join(F.broadcast(table), "feature")
    scores = cells.groupBy("row_id", "label").agg(F.sum(F.col("w") * F.col("value")).alias("s"))
    margin = S.signed_label(F.col("label")) * F.col("s")
    loss = S.log1pexp(-margin) if model == "lr" else F.greatest(F.lit(0.0), 1 - margin)
    return scores.agg(F.avg(loss)).first()[0]


def comparison(spark, sf_dir: str) -> dict:
    """Ours next to the row-partitioned trainers at equal batches and iterations: seconds per iteration and final loss."""
    started = time.time()
    points = written(ds.event_points(spark, sf_dir), "points").persist()
    profile = profile_points(points, 2, ds.EVENT_FEATURES)
    found = {"load_seconds": round(time.time() - started, 3)}
    vectors = jobs._event_vectors(spark, sf_dir, False).persist()
    vectors.count()
    for model in ("lr", "svm"):
        started = time.time()
        trained = train(points, model, step=1.0, batch_size=profile.n_rows // 10, iterations=ITERATIONS, profile=profile, history=False)
        ours = [(r.feature, r.k, r.w) for r in trained.weights().collect()]
        seconds = time.time() - started
        started = time.time()
        theirs = coefficients(baseline(vectors, f"{model}_sgd", num_features=ds.EVENT_FEATURES, iterations=ITERATIONS, step=1.0, fraction=0.1))
        other = time.time() - started
        found[model] = {
            "seconds_per_iteration": round(seconds / ITERATIONS, 3), "loss": round(mean_loss(points, ours, model), 5),
            "rows_seconds_per_iteration": round(other / ITERATIONS, 3), "rows_loss": round(mean_loss(points, theirs, model), 5),
        }
    return found


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", master=f"local[{cpus}]", spark__driver__memory="12g", spark__sql__shuffle__partitions=cpus
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = jobs.all_queries()
    names = sys.argv[1:] or QUERIES
    consume(queries["train_lr"](spark, sf_dir))
    timings = {}
    for name in names:
        started = time.time()
        consume(queries[name](spark, sf_dir))
        timings[name] = round(time.time() - started, 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    if not sys.argv[1:]:
        for name, seconds in per_iteration(spark, sf_dir).items():
            timings[name] = round(seconds, 3)
            print(name, timings[name], file=sys.stderr, flush=True)
    against = {} if sys.argv[1:] else comparison(spark, sf_dir)
    result = {
        "metric": "total_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "comparison": against,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
