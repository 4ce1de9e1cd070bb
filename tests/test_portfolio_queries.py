"""Portfolio queries without a SQL twin over all components of the embeddings."""

import numpy as np
import pytest

from tidemark.operators import portfolio as pf
from tidemark.plans import registry


def embeddings(spark, folder, n, width=20):
    x = np.random.default_rng(3).standard_normal((n, width)).astype(np.float32)
    x[:, 1:6] += x[:, :1]
    rows = [(k, [float(v) for v in r], k % 10) for k, r in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return np.cov(x.astype(float).T)


@pytest.mark.parametrize("name", ["cov_rmt", "cov_detone", "pf_hrp", "pf_nco", "pf_clusters"])
def test_every_component_is_an_asset(spark, tmp_path, name):
    embeddings(spark, tmp_path, 60)
    got = registry.queries()[name](spark, str(tmp_path)).collect()
    assert {r["i"] for r in got} == set(range(20))
    assert len(got) == (400 if name.startswith("cov") else 20)


def test_hrp_weights_of_all_components(spark, tmp_path):
    cov = embeddings(spark, tmp_path, 60)
    got = {r["i"]: r["weight"] for r in registry.queries()["pf_hrp"](spark, str(tmp_path)).collect()}
    assert np.allclose([got[i] for i in range(20)], pf.hrp_weights(cov), atol=1e-5)


@pytest.mark.parametrize("n", [40, 700])
def test_rmt_takes_the_observations_of_its_table(spark, tmp_path, n):
    cov = embeddings(spark, tmp_path, n)
    corr, sd = pf.correlation(cov)
    values, vectors = np.linalg.eigh(corr)
    q = 20 / n
    noise = values <= pf.mp_edge(q, pf.fit_sigma2(values, q))
    values[noise] = values[noise].mean()
    want = pf._rebuilt(values, vectors, sd)
    got = np.zeros((20, 20))
    for r in registry.queries()["cov_rmt"](spark, str(tmp_path)).collect():
        got[r["i"], r["j"]] = r["value"]
    assert np.allclose(got, want, atol=1e-5)
