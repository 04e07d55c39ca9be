"""Selections: the recursive SQL in the catalog is the check of the result; these are the rules that always hold."""

import random
from collections import Counter

import pytest

from lotwise.operators import selection as sel

SCHEMA = (
    "source string, source_id string, make string, model string, year long, mileage_km long, price_eur long, version_text string, city string, price_band int, "
    "comparable_count long, score double, priority_score double, price_priority_passed boolean, damage_category string"
)


@pytest.fixture(scope="module")
def leads(spark):
    rng = random.Random(5)
    rows = [
        ("s", f"{i:04d}", f"m{rng.randrange(4)}", "x", 2000 + rng.randrange(2), rng.randrange(3), rng.randrange(3), None, "c", rng.choice([0, 0, 0, 1, 2, 3]), rng.randrange(3), float(rng.randrange(8)), float(rng.randrange(8)), rng.random() < 0.05, rng.choice(["clean", "clean", "minimal", "non_severe"]))
        for i in range(160)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_round_robin_caps_families_and_turns(leads):
    got = sel.round_robin_bands(leads, "score", 8).orderBy("selection_rank").collect()
    assert [r["selection_rank"] for r in got] == list(range(1, 9))
    assert [r["price_band"] for r in got[:4]] == [0, 1, 2, 3]
    assert max(Counter((r["make"], r["model"]) for r in got).values()) <= 2


def test_damage_mix_fills_its_seats(leads):
    got = sel.damage_mix_selection(leads, 20).collect()
    assert Counter(r["damage_category"] for r in got) == {"clean": 6, "minimal": 4, "non_severe": 10}
    assert len({tuple(r[c] for c in sel.TARGET_IDENTITY) for r in got}) == len(got)


def test_balanced_keeps_priorities_and_shares(leads):
    got = sel.evidence_balanced_select(leads, 20).orderBy("selection_rank").collect()
    passed = leads.where("price_priority_passed").count()
    assert sum(r["price_priority_passed"] for r in got) == min(20, passed)
    assert len(got) == 20 and all(n >= 5 for n in Counter(r["price_band"] for r in got).values())
    summary = sel.selection_summary(leads, sel.evidence_balanced_select(leads, 20), 20).collect()
    assert sum(r["selected"] for r in summary) == 20 and {r["family_cap_relaxed"] for r in summary} == {True}


def test_seats_and_limits(spark, leads):
    assert {r["category"]: r["seats"] for r in sel.mix_targets(spark, 7).collect()} == {"clean": 2, "minimal": 1, "non_severe": 4}
    for limit in (0, 501):
        with pytest.raises(ValueError):
            sel.evidence_balanced_select(leads, limit)


def _first(rows, chosen, allowed):
    """The least row, in order, that isn't chosen and is allowed given those that are."""
    return next((i for i, r in enumerate(rows) if i not in chosen and allowed(r, [rows[c] for c in chosen])), None)


def _by_turns(rows, limit, groups, family_cap, fall_back, offer):
    """Every turn searches all rows: groups of (filter, seats), a round of bands for each seat."""
    chosen = []
    for mine, seats in groups:
        taken = 0
        for turn in range(4 * seats):
            def open_(r, before, band=turn % 4, mine=mine):
                return mine(r) and r["price_band"] == band and offer(r) not in {offer(b) for b in before}

            def fresh(r, before, open_=open_):
                return open_(r, before) and sum((b["make"], b["model"]) == (r["make"], r["model"]) for b in before) < family_cap

            if taken < seats and len(chosen) < limit:
                pick = _first(rows, chosen, fresh)
                pick = _first(rows, chosen, open_) if pick is None and fall_back else pick
                if pick is not None:
                    chosen.append(pick)
                    taken += 1
    return [rows[c]["source_id"] for c in chosen]


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(11)
    rows = [
        ("s", f"{i:04d}", rng.choice(["a", "b", "C", "c", None]) if i % 3 else f"m{rng.randrange(30)}", rng.choice("xyz"), 2000 + rng.randrange(2), rng.randrange(4), rng.randrange(4), rng.choice([None, "v"]), "c", rng.choice([0, 0, 0, 0, 1, 2, 3]), rng.randrange(3), float(rng.randrange(9)), float(rng.randrange(9)), rng.random() < 0.03, rng.choice(["clean", "clean", "minimal", "non_severe"]))
        for i in range(600)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def _ordered(df, *columns):
    rows = [r.asDict() for r in df.collect()]
    return sorted(rows, key=lambda r: (*(-float(r[c]) for c in columns), -r["comparable_count"], r["source"], r["source_id"]))


def _ids(df):
    return [r["source_id"] for r in df.orderBy("selection_rank").collect()]


@pytest.mark.parametrize("limit", [3, 40, 300])
def test_turns_against_a_search_for_each(many, limit):
    rows = _ordered(many, "score")
    assert _ids(sel.round_robin_bands(many, "score", limit)) == _by_turns(rows, limit, [(lambda r: True, limit)], 2, False, lambda r: r["source_id"])


@pytest.mark.parametrize("limit", [3, 40, 300])
def test_damage_mix_against_a_search_for_each(spark, many, limit):
    seats = [(lambda r, c=s["category"]: r["damage_category"] == c, s["seats"]) for s in sel.mix_targets(spark, limit).orderBy("place").collect()]
    expected = _by_turns(_ordered(many, "priority_score"), limit, seats, 2, True, lambda r: tuple(r[c] for c in sel.TARGET_IDENTITY))
    assert _ids(sel.damage_mix_selection(many, limit)) == expected


@pytest.mark.parametrize("limit", [3, 40, 300])
def test_balanced_against_a_search_for_each(many, limit):
    rows = _ordered(many, "price_priority_passed", "score")
    family = lambda r: tuple((r[c] or "").lower() for c in ("make", "model"))
    chosen, cap = [], max(1, -(-limit // 10))
    for priority, share, capped in ((1, 0, 0), (0, 1, 1), (0, 1, 0), (0, 0, 1), (0, 0, 0)):
        def open_(r, before, priority=priority, share=share, capped=capped):
            quota = limit // 4 + (r["price_band"] < limit % 4)
            return (
                (not priority or r["price_priority_passed"])
                and (not share or sum(b["price_band"] == r["price_band"] for b in before) < quota)
                and (not capped or sum(family(b) == family(r) for b in before) < cap)
            )

        while len(chosen) < limit and (pick := _first(rows, chosen, open_)) is not None:
            chosen.append(pick)
    assert _ids(sel.evidence_balanced_select(many, limit)) == [rows[c]["source_id"] for c in sorted(chosen)]


def test_nothing_to_choose_from(many):
    for chosen in (sel.round_robin_bands(many.limit(0), "score", 5), sel.damage_mix_selection(many.limit(0), 5), sel.evidence_balanced_select(many.limit(0), 5)):
        assert chosen.count() == 0



def test_largest_limit(many):
    """As many as the largest limit, each once."""
    chosen = sel.evidence_balanced_select(many, 500)
    assert chosen.select("source_id").distinct().count() == 500 and [r["selection_rank"] for r in chosen.orderBy("selection_rank").collect()] == list(range(1, 501))
