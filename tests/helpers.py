"""What several tests share."""

import os

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def same_rows(left, right, digits=6):
    """Whether two pandas frames hold the same rows, in any order."""
    import numpy as np
    import pandas as pd

    assert sorted(left.columns) == sorted(right.columns)
    cols = sorted(left.columns)

    def text(x):
        if isinstance(x, (float, np.floating)):
            return "null" if np.isnan(x) else repr(round(float(x), digits) + 0.0)
        if x is None or x is pd.NA:
            return "null"
        if isinstance(x, (int, np.integer)) and not isinstance(x, bool):
            return repr(float(x))
        return str(x)

    norm = lambda d: sorted(tuple(text(v) for v in row) for row in d[cols].itertuples(index=False))
    a, b = norm(left), norm(right)
    assert len(a) == len(b), (len(a), len(b))
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    assert not wrong, wrong[:3]
    return True
