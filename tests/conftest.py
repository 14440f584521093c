import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pipegrid.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", 4, "pipegrid-tests")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def separable(spark):
    """Six columns, two of them shifted by the label."""
    import numpy as np

    from pipegrid.frame import from_columns
    from pipegrid.operators.split import holdout_fraction

    draw = np.random.default_rng(7)
    n = 400
    label = np.arange(n) % 2
    x = draw.normal(size=(n, 6))
    x[:, 0] += 2.5 * label
    x[:, 3] -= 2.5 * label
    names = [f"f_{j}" for j in range(6)]
    rows = [(int(i), int(label[i]), *map(float, x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id bigint, label int, " + ", ".join(f"{c} double" for c in names))
    return from_columns(holdout_fraction(df, 0.33, 1), names)


def matrix(features):
    """(row ids, labels, splits, block) in row order."""
    import numpy as np

    rows = sorted(features.with_array().collect(), key=lambda r: r["row_id"])
    return (
        np.array([r["row_id"] for r in rows]),
        np.array([r["label"] for r in rows]),
        np.array([r["split"] for r in rows]),
        np.array([r["features"] for r in rows]),
    )
