import numpy as np
import pandas as pd

from quirework.operators import models


def test_axes_come_from_all_rows(spark):
    """More rows than any sample of 20,000, and some partitions empty: mean and axes are those of the whole."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((20_500, 4)) * [3, 2, 1, 0.5] + [5, -2, 0, 1]
    df = spark.createDataFrame(pd.DataFrame({"v": [None, *x.tolist()]})).repartition(7).unionByName(spark.createDataFrame([], "v array<double>"))
    mean, axes = models.principal_axes(df, "v")
    whole = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:2]
    assert np.allclose(mean, x.mean(axis=0), atol=1e-9)
    assert np.allclose(np.abs((axes * whole).sum(axis=1)), 1, atol=1e-12) and (axes[np.arange(2), np.abs(axes).argmax(axis=1)] > 0).all()
