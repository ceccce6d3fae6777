"""Order-insensitive comparison of two result frames."""

import numpy as np
import pandas as pd


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    out = {}
    for c in sorted(df.columns):
        col = df[c]
        if str(col.dtype) in ("Int64", "Int32", "Float64"):
            col = pd.Series(col.to_numpy(dtype=float, na_value=np.nan))
        if col.dtype.kind in "iufb":
            out[c] = col.astype(float).round(6)
        else:
            out[c] = col.map(lambda v: "" if v is None or (isinstance(v, float) and np.isnan(v)) else str(v))
    frame = pd.DataFrame(out)
    return frame.sort_values(list(frame.columns), na_position="first").reset_index(drop=True)


def assert_same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    assert len(a) == len(b)
    x, y = tidy(a), tidy(b)
    for c in x.columns:
        if x[c].dtype.kind == "f" and y[c].dtype.kind == "f":
            np.testing.assert_allclose(x[c], y[c], rtol=1e-9, atol=1e-9, err_msg=c)
        else:
            assert (x[c].astype(str) == y[c].astype(str)).all(), c
