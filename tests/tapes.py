"""Random tapes, and a plain row-by-row reading of the averages."""

import numpy as np
import pandas as pd


def tape(n=9000, t0=1_700_000_000, seed=0):
    rng = np.random.default_rng(seed)
    step = rng.normal(0, 2e-4, n)
    step[n // 2 : n // 2 + 50] += 3e-3
    close = 30_000 * np.exp(np.cumsum(step))
    vol = np.where(rng.random(n) < 0.1, 0.0, rng.exponential(2, n))
    return pd.DataFrame({
        "symbol": "X", "t": t0 + np.arange(n), "open": close, "high": close * (1 + np.abs(rng.normal(0, 1e-4, n))), "low": close * (1 - np.abs(rng.normal(0, 1e-4, n))), "close": close, "vol": vol,
        "qvol": vol * close, "ntrades": rng.poisson(8, n).astype("int64"), "takerfrac": rng.random(n), "valid": rng.random(n) > 0.01,
    })


def plain_average(x, halflife, first=None):
    b, y, out = 0.5 ** (1 / halflife), x[0] if first is None else first, []
    for v in x:
        y = b * y + (1 - b) * v
        out.append(y)
    return np.array(out)
