"""Correlation between factors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame

from factorloom.guards import require_columns
from factorloom.operators.factors import as_doubles


def factor_correlation(df: DataFrame, x: str, names: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of factors, long: factor_a, factor_b, r.

    Second moments are summed per partition and merged; only the factors x factors matrix
    reaches the driver. r is clipped to [-1, 1] and NULL for a constant factor. Fewer than
    two rows raise.
    """
    require_columns(df, [x])
    if len(df.limit(2).select(x).collect()) < 2:
        raise ValueError("need at least 2 rows to correlate")
    vectors = df.select(array_to_vector(as_doubles(x)).alias("v"))
    spread = vectors.select(Summarizer.variance(vectors.v)).first()[0].toArray()
    r = Correlation.corr(vectors, "v", "pearson").first()[0].toArray()
    rows = []
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            known = spread[i] > 0 and spread[j] > 0 and not np.isnan(r[i, j])
            rows.append((str(a), str(b), float(np.clip(r[i, j], -1.0, 1.0)) if known else None))
    return df.sparkSession.createDataFrame(rows, "factor_a string, factor_b string, r double")
