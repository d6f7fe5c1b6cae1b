import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.llm.mixing import Mixture, sainte_lague


def by_hand(weights, seats, most):
    got = [0] * len(weights)
    for _ in range(seats):
        live = [i for i, w in enumerate(weights) if w > 0 and got[i] < most[i]]
        if not live:
            break
        got[max(live, key=lambda i: (weights[i] / (2 * got[i] + 1), -i))] += 1
    return got


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 30)), min_size=1, max_size=8), st.integers(0, 120))
def test_apportionment(rows, seats):
    w, most = [float(a) for a, _ in rows], [float(b) for _, b in rows]
    got = sainte_lague(w, seats, most)
    want = by_hand(w, seats, most)
    assert sum(got) == sum(want) and all(g <= m for g, m in zip(got, most))
    for i, g in enumerate(got):  # no seat could go to a higher quotient
        for j, h in enumerate(got):
            if g and w[j] > 0 and h < most[j]:
                assert w[i] / (2 * g - 1) >= w[j] / (2 * h + 1) - 1e-9
    assert sainte_lague([1, 3], 10**12) == [250_000_000_000, 750_000_000_000] and sainte_lague([], 5) == [] and sainte_lague([math.nan, 0.0], 5) == [0, 0]


DOCS = "doc_id long, source string, text string, copies int"


@pytest.fixture
def docs(spark):
    rows = [(i, "big", "alpha beta gamma delta epsilon zeta " * 20, 0) for i in range(60)] + [(100 + i, "small", "one two three four five six " * 20, 0) for i in range(8)] + [(200, None, "text", 0), (201, "big", None, 0), (202, "big", "", 0), (203, "other", "never", 0)]
    return spark.createDataFrame(rows, DOCS)


TARGETS = "source string, target_weight double, max_repeats int"


def test_shares(spark, docs):
    t = spark.createDataFrame([("big", 3.0, 1), ("small", 1.0, 3), ("small", 1.0, 3), ("gone", 5.0, 2), ("zero", 0.0, None), (None, 1.0, 1)], TARGETS)
    m = Mixture(docs, t, block_tokens=64)
    s = {r.source: r for r in m.shares().collect()}
    assert set(s) == {"big", "small", "gone", "zero"} and s["gone"].n_taken == s["zero"].n_taken == 0
    assert abs(s["big"].actual_share - 0.75) < 0.05 and abs(s["small"].actual_share - 0.25) < 0.05 and s["big"].most_copies == 1 and s["small"].most_copies <= 3
    assert s["big"].n_taken + s["small"].n_taken > 0.9 * min(s["big"].n_available / 0.75, 3 * s["small"].n_available / 0.25)
    again = Mixture(docs.orderBy(F.rand(1)), t, block_tokens=64)
    assert sorted(map(tuple, m.rows.collect())) == sorted(map(tuple, again.rows.collect()))
    assert m.copied().count() == m.rows.agg(F.sum("copies")).first()[0]


def test_given_total_and_empty(spark, docs):
    t = spark.createDataFrame([("big", 1.0, 1), ("small", 9.0, 2)], TARGETS)
    s = {r.source: r for r in Mixture(docs, t, total_tokens=5_000, block_tokens=64).shares().collect()}
    assert s["small"].n_taken <= 2 * s["small"].n_available and s["big"].n_taken >= 5_000 - 2 * s["small"].n_available - 200
    assert Mixture(docs, t.limit(0)).rows.isEmpty() and Mixture(docs.limit(0), t).rows.isEmpty()
    free = Mixture(docs, spark.createDataFrame([("small", 1.0, None), ("big", 1.0, None)], TARGETS), block_tokens=64).shares().collect()
    assert all(abs(r.actual_share - 0.5) < 0.05 for r in free)
