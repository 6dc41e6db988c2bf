"""What the driver has in memory: small plans, and the latent index in single precision only."""

import tracemalloc

import numpy as np

from tests.llm.cases import documents
from veclens.llm import components, decontam, mixing


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_a_round_of_components_is_no_plan_of_both_stars(spark, monkeypatch):
    found, staged = [], components.staged
    monkeypatch.setattr(components, "staged", lambda df, name: (found.append(joins(df)), staged(df, name))[1])
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {tuple(r) for r in components.components(links).collect()}
    assert got == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    assert max(found) <= 2


def test_the_texts_of_the_mix_are_joined_apart_from_what_places_them(spark):
    plan = mixing.mixed(documents(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join ") == 1


def peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_the_latent_index_is_made_without_a_copy_in_doubles():
    n, rank = 20_000, 96
    basis = decontam._start(n, rank)
    assert basis.dtype == np.float32 and np.abs(basis.T.astype(float) @ basis - np.eye(rank)).max() < 1e-6
    plain = np.linalg.qr(np.random.default_rng(decontam._SEED).standard_normal((n, rank)))[0]
    assert np.abs(np.abs(plain) - np.abs(basis)).max() < 1e-6
    product = basis * np.linspace(9, 1, rank, dtype=np.float32)
    left, scale = decontam._orthonormal(product.copy())
    assert np.allclose(scale, np.linspace(9, 1, rank), rtol=1e-5) and np.abs(np.abs(left) - np.abs(basis)).max() < 1e-5
    single = 4 * n * rank
    assert peak(lambda: decontam._start(n, rank)) < 2 * single and peak(lambda: decontam._orthonormal(product)) < single
