import numpy as np
import pytest

from vecpress.operators import codecs, kmeans
from vecpress.plans import registry
from vecpress.sources import datasets


@pytest.mark.parametrize("method", ["exact", "lloyd", "histogram"])
def test_registered_levels_are_those_of_all_rows(spark, monkeypatch, method):
    rows = np.random.default_rng(3).normal(size=(6000, 3))
    rows[::2500] *= 40  # outliers that a sample would lose
    monkeypatch.setattr(registry, "_tapered", lambda spark, sf_dir: datasets.from_matrix(spark, rows))
    got = {}
    for r in registry.queries()[f"kmeans1d_{method}"](spark, "").collect():
        got.setdefault(r["d"], []).append(r["centroid"])
    for d in range(3):
        want = kmeans.lloyd_1d(rows[:, d], 8)[0] if method == "lloyd" else (kmeans.exact_1d if method == "exact" else kmeans.histogram_1d)(rows[:, d], [8])[8]
        assert np.allclose(got[d], np.sort(want))


def test_rank_aware_levels_are_those_of_all_rows_up_to_its_sample(spark):
    rows = np.random.default_rng(5).normal(size=(5000, 3)) * [3, 2, 1]
    x = datasets.from_matrix(spark, rows)
    codec = codecs.RankAware(2, codebook="exact").fit(x)
    turned = (rows - codec.mean) @ codec.axes
    for d, b in enumerate(codec.bits):
        want = kmeans.exact_1d(turned[:, d], [1 << int(b)])[1 << int(b)] if b else np.zeros(1)
        assert np.allclose(codec.levels[d], want)
    few = codecs.RankAware(2, codebook="exact", sample=500).fit(x)
    assert not all(np.allclose(a, b) for a, b in zip(codec.levels, few.levels, strict=True))
