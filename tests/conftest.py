import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from barweave.session import build_session
    s = build_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
                                              "spark.python.sql.dataFrameDebugging.enabled": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def walk(spark):
    """Random walk of two symbols; one owns nine tenths of the rows."""
    import numpy as np
    import pandas as pd
    from barweave.session import stage
    rng = np.random.default_rng(5)
    parts = []
    for sym, n in (("HOT", 2700), ("COLD", 300)):
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        o = c * (1 + rng.normal(0, 0.003, n))
        parts.append(pd.DataFrame({"symbol": sym, "ts": pd.date_range("2020-01-01", periods=n, freq="h"), "open": o, "high": np.maximum(o, c) * (1 + rng.random(n) * 0.01),
                                   "low": np.minimum(o, c) * (1 - rng.random(n) * 0.01), "close": c, "volume": rng.integers(1, 100, n).astype(float), "rn": np.arange(1, n + 1), "n": n}))
    pdf = pd.concat(parts, ignore_index=True)
    return pdf, stage(spark.createDataFrame(pdf))
