"""What several tests use."""

from __future__ import annotations

import os

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(df) -> list[tuple]:
    """Rows of a pandas frame, columns by name, values as text of nine digits, sorted."""
    import numpy as np
    import pandas as pd

    def one(v):
        if isinstance(v, (list, np.ndarray)):
            return str([int(x) for x in v])
        if v is None or pd.isna(v):
            return ""
        if isinstance(v, float):
            return f"{v + 0.0:.9g}"
        return str(v.date()) if isinstance(v, pd.Timestamp) else str(v)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))
