"""Quality without negatives: the prior, what is read, and held-out figures on the larger tables."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from folium.llm.quality import QualityModel, fit_quality, quality
from tests.llm.test_models import SF, here

LARGE = "/root/testdata/sf0.1"


def test_prior_is_estimated_from_positives_and_unlabelled():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.7, 0.9):
        good, bad = rng.normal(0, 1, (3000, 6)), rng.normal(3, 1, (3000, 6))
        unlabelled = np.concatenate([good[: int(2000 * share)], bad[: int(2000 * (1 - share))]])
        model = QualityModel(rng.normal(0, 1, (1500, 6)), unlabelled)
        assert abs(model.prior - share) < 0.08


@here
def test_negatives_are_never_read(spark):
    read = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    one = fit_quality(read("documents"), read("labels"))
    other = fit_quality(read("documents"), read("labels").filter("quality = 1 OR doc_id % 2 = 0"))
    assert one.prior == other.prior and all(np.array_equal(a[k], b[k]) for a, b in zip(one.trained, other.trained) for k in a)


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="test tables are not here")
def test_held_out_at_scale(spark):
    """Held-out labelled rows of sf0.1: always answering 1 gives 0.85."""
    read = lambda n: spark.read.parquet(f"{LARGE}/{n}.parquet")
    labels = read("labels").select("doc_id", "quality")
    rows = quality(read("documents"), read("labels")).filter("held_out").join(labels, "doc_id").select("predicted", F.col("quality")).collect()
    p, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    assert (p == y).mean() > 0.97 and (p[y == 0] == 0).mean() > 0.85 and (p[y == 1] == 1).mean() > 0.98
