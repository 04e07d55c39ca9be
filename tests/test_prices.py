"""Benchmarks, fits and price contexts on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.functions import money
from lotwise.operators import economics, peers, stats
from lotwise.plans import market

NOW = "2026-10-07 12:00:00"


def as_of():
    return F.lit(NOW).cast("timestamp")


BASE = dict(
    source="s", source_id="t", url="https://x.example/1", make="fiat", model="panda 319", generation="iii", trim="easy", fuel="petrol", transmission="manual", year=2020, mileage_km=50_000,
    price_eur=10_000, province="milano", seller_type="private", condition="undamaged", active=True, price_kind="total", days=1,
)


def listings(spark, rows):
    full = [dict(BASE, **r) for r in rows]
    df = spark.createDataFrame(full)
    return df.withColumn("observed_at", as_of() - F.make_interval(days=F.col("days").cast("int"))).drop("days")


def test_screening_rules(spark):
    """Every case is its own source, so one screen judges them all."""
    peers_of = lambda s, n, step=100, **kw: [dict(source=s, source_id=f"p{i}", price_eur=10_000 + step * i, **kw) for i in range(n)]
    cases = {s: dict(source=s) for s in ("eight", "seven", "wide", "removed")}
    rows = list(cases.values()) + [dict(source="nation", province="roma", price_eur=8_000)]
    rows += peers_of("eight", 8) + peers_of("seven", 7) + peers_of("nation", 9, 10)
    rows += [dict(source="wide", source_id=f"p{i}", price_eur=5_000 if i < 4 else 20_000) for i in range(8)]
    rows += peers_of("removed", 8, days=2) + [dict(source="removed", source_id="p3", active=False, days=1)]
    out = market.market_screen(listings(spark, rows), as_of()).filter("source_id = 't'").collect()
    got = {r["source"]: r for r in out}
    assert got["eight"]["p50"] == 10_300
    assert (got["seven"]["benchmark_issue"], got["seven"]["reason"]) == ("too_few_comparables", "insufficient_comparables")
    assert got["wide"]["benchmark_issue"] == "too_dispersed"
    assert got["removed"]["comparable_count"] == 7
    assert got["nation"]["scope"] == "national" and got["nation"]["selected"] and got["nation"]["route"] == "verification"


def test_required_margin_tiers(spark):
    df = spark.createDataFrame([(p,) for p in (1, 4999, 5000, 9999, 10_000, 15_000, 20_000, 20_001, 25_001)], "p int")
    got = [r[0] for r in df.select(money.required_margin("p")).collect()]
    assert got == [2000, 2000, 3000, 3000, 4000, 5000, 5000, 6000, 7000]


def test_band_join_equals_plain_band_join(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{i % 2}", str(i), f"m{rng.integers(3)}", int(2000 + rng.integers(8)), int(rng.integers(0, 200_000))) for i in range(300)]
    df = spark.createDataFrame(rows, "source string, source_id string, make string, year long, mileage_km long")
    pairs = peers.band_join(df, df, ["make"], {"year": 3, "mileage_km": 60_000}, peers.not_self())
    got = sorted((r["source_id"], r["p_source_id"]) for r in pairs.select("source_id", "p_source_id").collect())
    want = sorted((a[1], b[1]) for a in rows for b in rows if a[1] != b[1] and a[2] == b[2] and abs(a[3] - b[3]) <= 3 and abs(a[4] - b[4]) <= 60_000)
    assert got == want


def huber(points):
    x = np.array([[1.0, a, b] for a, b, _ in points])
    y = np.array([p for _, _, p in points])
    w = np.ones(len(y))
    for _ in range(4):
        beta = np.linalg.solve((x * w[:, None]).T @ x, (x * w[:, None]).T @ y)
        r = y - x @ beta
        off = np.abs(r - np.median(r))
        s = np.median(off) * 1.4826
        if s < 1e-8:
            break
        w = np.minimum(1.0, 1.5 * s / np.maximum(off, 1e-8))
    return beta


def test_window_fit_matches_least_squares(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(6):
        for _ in range(40):
            dy, dkm = int(rng.integers(-4, 5)), float(rng.integers(-8, 9))
            rows.append((g, float(dy), dkm, float(10_000 + 800 * dy - 250 * dkm + rng.normal(0, 300) + (3000 if rng.random() < 0.1 else 0))))
    df = spark.createDataFrame(rows, "g int, dy double, dkm double, price double")
    got = {r["g"]: r for r in stats.with_robust_fit(df, ["g"], F.lit(True)).select("g", "b0", "b1", "b2").distinct().collect()}
    for g in range(6):
        want = huber([r[1:] for r in rows if r[0] == g])
        assert np.allclose([got[g]["b0"], got[g]["b1"], got[g]["b2"]], want, rtol=1e-6)


def price_rows():
    return [
        ("s", f"{y}-{k}", y, k, 10_000 + 800 * (y - 2018) - (k - 100_000) // 40) for y in range(2015, 2022) for k in range(60_000, 150_000, 10_000)
    ]


def context(spark, rows, year=2018, km=100_000):
    p = spark.createDataFrame(rows, "p_source string, p_source_id string, p_year long, p_mileage_km long, p_price_eur long")
    p = p.withColumns({"p_city": F.lit("milano"), "p_version": F.lit("v"), "source": F.lit("s"), "source_id": F.lit("t"), "year": F.lit(year).cast("long"), "mileage_km": F.lit(km).cast("long")})
    near = (F.abs(F.col("p_year") - F.col("year")) <= 1) & (F.abs(F.col("p_mileage_km") - F.col("mileage_km")) <= 20_000)
    return stats.price_context(p, near).collect()[0]


def test_learned_slopes_adjust_prices(spark):
    c = context(spark, price_rows())
    assert c["method"] == "archive_trained_year_mileage"
    assert (c["euro_per_newer_year"], c["euro_per_extra_10000_km"], c["validation_error_eur"]) == (800, -250, 0)
    assert c["asking_typical_eur"] == 10_000


@pytest.mark.parametrize("rows,year,km", [(price_rows()[27:42], 2018, 100_000), (price_rows(), 2021, 160_000)])
def test_no_adjustment_without_enough_or_outside(spark, rows, year, km):
    assert context(spark, rows, year, km)["method"] == "unadjusted_comparables"


def test_maximum_offer_equals_search(spark):
    rng = np.random.default_rng(11)
    rows = [(int(rng.integers(0, 4_000_000)), int(rng.integers(0, 900_000)), int(rng.choice([2500, 3000]))) for _ in range(300)]
    df = spark.createDataFrame(rows, "e long, c long, r long")
    got = [x[0] for x in df.select(economics.maximum_offer_cents(F.col("e"), F.col("c"), F.col("r"))).collect()]

    def margin(p):
        return 2000 if p < 5000 else 3000 if p < 10_000 else 4000 if p < 15_000 else 5000

    def search(e, c, r):
        fit = lambda o: (e - o * 100 - c) >= margin(o) * 100 and (e - o * 100 - c) * 10_000 >= (o * 100 + c) * r
        lo, hi = 0, 20_000
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if fit(mid) else (lo, mid - 1)
        return lo * 100

    assert got == [search(*row) for row in rows]
