import random

import pytest
from pyspark.sql import functions as F

from wayfind.operators import metrics


def summary(spark, rows, **more):
    df = spark.createDataFrame(rows, "kind string, ms double, good boolean")
    out = metrics.latency_summary(df.repartition(3), ["kind"], "ms", F.col("good"), **more)
    return {r["kind"]: tuple(r[c] for c in ("total", "ok", "failed", "p50", "p90", "p99", "least", "most")) for r in out.collect()}


def by_hand(rows):
    out = {}
    for kind in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == kind]
        v = sorted(r[1] for r in own if r[2] and r[1] is not None)
        at = lambda p: v[(len(v) - 1) * p // 100] if v else None
        good = sum(bool(r[2]) for r in own)
        out[kind] = (len(own), good, len(own) - good, at(50), at(90), at(99), v[0] if v else None, v[-1] if v else None)
    return out


@pytest.mark.parametrize(("bins", "few"), [(4096, 50_000), (2, 1), (7, 5)])
def test_exact_places(spark, monkeypatch, bins, few):
    """Whatever the parts and the rest that is numbered: outliers, ties, one value, negative and tiny values."""
    monkeypatch.setattr(metrics, "BINS", bins)
    monkeypatch.setattr(metrics, "FEW", few)
    rng = random.Random(bins)
    rows = [("normal", rng.gauss(50, 10), rng.random() < 0.9) for _ in range(400)] + [("outlier", float(i % 9), True) for i in range(200)] + [("outlier", 1e300, True), ("outlier", -1e300, True)]
    rows += [("one", 5.0, True), ("same", 7.0, True), ("same", 7.0, True), ("none", 3.0, False), ("null", None, True), (None, 1e-300, True), (None, 2e-300, True), (None, -0.0, None)]
    assert summary(spark, rows) == by_hand(rows)


def test_no_rows(spark):
    assert summary(spark, []) == {}


def test_no_group_is_sorted_whole(spark):
    """Rows of a group meet only in bounded numbers: the one window over rows follows a filter of at most FEW of them."""
    df = spark.range(20_000).select(F.lit("a").alias("kind"), (F.col("id") * 7919 % 20_011).cast("double").alias("ms"), F.lit(True).alias("good"))
    seen = []
    cut = metrics.cut
    metrics.FEW, before = 10, metrics.FEW
    metrics.cut = lambda x: seen.append(1) or cut(x)
    try:
        r = metrics.latency_summary(df, ["kind"], "ms", F.col("good")).first()
    finally:
        metrics.FEW, metrics.cut = before, cut
    v = sorted(i * 7919 % 20_011 for i in range(20_000))
    assert (r["p50"], r["p90"], r["p99"]) == (v[9999], v[17999], v[19799])
    assert len(seen) <= 4
