"""Functions that need NumPy, over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.FloatType())
def half(x: pd.Series) -> pd.Series:
    """The nearest half-precision number; NaN is 0, what is beyond half precision is its limit of 65500."""
    v = np.nan_to_num(x.to_numpy(np.float64, na_value=np.nan), nan=0.0, posinf=65_500.0, neginf=-65_500.0)
    return pd.Series(np.clip(v, -65_500.0, 65_500.0).astype(np.float16).astype(np.float32))
