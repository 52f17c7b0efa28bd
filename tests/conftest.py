import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from slicegrad.session import build_session  # noqa: E402

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", master="local[8]", spark__driver__memory="6g", spark__sql__shuffle__partitions=4
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


def make_points(spark, rows):
    """Points from ``[(label, {feature: value}), ...]``; the position is the row id."""
    data = [(i, float(y), [(f, float(x)) for f, x in sorted(cells.items())]) for i, (y, cells) in enumerate(rows)]
    return spark.createDataFrame(
        data, "row_id long, label double, features array<struct<feature:int,value:double>>"
    )


def random_rows(n=60, features=12, classes=2, seed=3, density=0.4, dense_feature=True):
    """Sparse rows; feature 0 occurs in every row, so it is hot, and some rows have nothing else."""
    import random

    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        cells = {f: rng.uniform(-1, 1) for f in range(1, features) if rng.random() < density}
        if dense_feature:
            cells[0] = rng.uniform(-1, 1)
        rows.append((rng.randrange(classes), cells))
    return rows
