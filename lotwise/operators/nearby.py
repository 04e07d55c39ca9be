"""Statistics over the peers of every target without a row for each pair.

Targets at one position (cohort, year, mileage) have the same peers but for themselves, and pool rows
that agree on position and price count as one cell. Cells twice as wide as the band give every position a
home; pool rows visit the homes they may be near to, so all peers of a position lie in one task and only
visits are shuffled: some four rows for a pool cell, one for a target, whatever the number of pairs.
Counts and sums are aggregated as positions meet cells. Order statistics run over the home's prices in
order within the task. A target's own listing is taken out by arithmetic: below its own price the running
weight stands, from there on it is less by the target's weight, so every order statistic is the better of
two searches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import peer_weight_nano, peer_weights_nano
from ..session import cut_lineage
from .peers import all_equal_or_null

Needs = Callable[[Column], Mapping[str, Column]]
#: Pool rows of a home that come in price order before its questions.
_POOL, _QUESTION = 0, 1
#: Stands for no price and no value within a task.
_NONE = -(1 << 63)


def _positions(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that can have peers: an unknown key, year or mileage matches nothing."""
    known = F.lit(True)
    for c in (*keys, "year", "mileage_km"):
        known = known & F.col(c).isNotNull()
    return rows.filter(known)


def _homes(years: int, km: int) -> tuple[tuple[str, str, int], ...]:
    return ("_home_year", "year", years), ("_home_km", "mileage_km", km)


def _at_home(rows: DataFrame, years: int, km: int) -> DataFrame:
    return rows.withColumns({name: F.floor(F.col(value) / (2 * band)) for name, value, band in _homes(years, km)})


def _visiting(rows: DataFrame, years: int, km: int) -> DataFrame:
    """Rows once for each home that has positions they may be near to."""
    for name, value, band in _homes(years, km):
        rows = rows.withColumn(name, F.explode(F.sequence(F.floor((F.col(value) - band) / (2 * band)), F.floor((F.col(value) + band) / (2 * band)))))
    return rows


def _answers(tolerant: Sequence[str], names: Sequence[str], out: Sequence[str], years: int, km: int, aged: bool):
    """Least prices at which the running weight of a position reaches the values asked for.

    Batches come by home, its pool rows by price before its questions. A home's pool is kept as arrays while
    its questions pass.
    """

    def positions(pool: dict, asked: pd.DataFrame) -> pd.DataFrame:
        found = {name: np.full(len(asked), _NONE, "int64") for name in names}
        own_price = asked["_own_price"].to_numpy("int64")
        for place, index in asked.groupby(["year", "mileage_km", *tolerant], sort=False, dropna=False).indices.items():
            years_off, km_off = np.abs(pool["year"] - place[0]), np.abs(pool["mileage_km"] - place[1])
            near = (years_off <= years) & (km_off <= km)
            for c, value in zip(tolerant, place[2:]):
                if not pd.isna(value):
                    near &= pool["_unknown_" + c] | (pool[c] == value)
            near = np.flatnonzero(near)
            weight = peer_weights_nano(years_off[near], km_off[near], pool["_age"][near]) if aged else 1
            run, prices = np.cumsum(pool["_n"][near] * weight), np.append(pool["_price"][near], _NONE)
            for name in names:
                below, above = (prices[np.searchsorted(run, asked[f"_ask_{name}_{part}"].to_numpy("int64")[index])] for part in (0, 1))
                found[name][index] = np.where((below != _NONE) & (below < own_price[index]), below, above)
        held = asked[list(out)].copy()
        for name in names:
            held[name] = pd.array(found[name], dtype="Int64")
            held.loc[(found[name] == _NONE) | (asked[f"_ask_{name}_0"].to_numpy("int64") == _NONE), name] = pd.NA
        return held

    def answered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        home, parts, pool = None, [], None
        for batch in batches:
            one, two, kind = (batch[c].to_numpy("int64") for c in ("_h1", "_h2", "_kind"))
            edges = np.flatnonzero((one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (kind[1:] != kind[:-1])) + 1
            done = []
            for start, stop in zip(np.r_[0, edges], np.r_[edges, len(batch)]):
                if start == stop:
                    continue
                if (one[start], two[start]) != home:
                    home, parts, pool = (one[start], two[start]), [], None
                rows = batch.iloc[start:stop]
                if kind[start] == _POOL:
                    parts.append(rows)
                elif parts or pool is not None:
                    if pool is None:
                        whole, parts = pd.concat(parts), []
                        pool = {c: whole[c].to_numpy("int64") for c in ("year", "mileage_km", "_price", "_n")}
                        pool["_age"] = whole["_age"].to_numpy("float64")
                        for c in tolerant:
                            pool[c], pool["_unknown_" + c] = whole[c].to_numpy(), whole[c].isna().to_numpy()
                    done.append(positions(pool, rows))
            if done:
                yield pd.concat(done)

    return answered


def near_statistics(
    targets: DataFrame, pool: DataFrame, *, keys: Sequence[str], own: Column, needs: Needs, own_price: Column | None = None,
    group: Sequence[str] = ("source", "source_id"), years: int = 1, km: int = 20_000, price: str = "price_eur",
    tolerant: Sequence[str] = (), age: Column | None = None, flags: Mapping[str, Column] = {}, minimum: int = 1,
) -> DataFrame:
    """``group``, comparable_count, total_price, sum_weight, sum_square and order statistics of each target's peers.

    Peers are pool rows with equal ``keys``, equal or unknown ``tolerant`` columns, a year within
    ``years`` and a mileage within ``km``, less the target itself. A pair weighs one, or, where ``age`` gives the
    age in days of a pool row, its ``peer_weight_nano``. ``own`` is the weight that the target's own row has in
    the pool, null or 0 where it isn't there; ``own_price`` is its price there.

    ``needs`` maps the peers' whole weight to thresholds; each becomes the least price at which the running
    weight reaches it, null for targets with fewer than ``minimum`` peers. ``flags`` are conditions on pool
    columns; each becomes the number of peers that meet it. Targets without a peer have no row.
    """
    own = F.coalesce(own, F.lit(0)).cast("bigint")
    mine = F.when(own > 0, F.lit(1)).otherwise(0)
    position = [*keys, *tolerant, "year", "mileage_km"]
    home = [*keys, "_home_year", "_home_km"]
    placed = _positions(targets, keys).select(
        *dict.fromkeys((*group, *position)), F.coalesce(own_price if own_price is not None else F.col(price), F.lit(0)).cast("bigint").alias("_own_price"), own.alias("_own"), mine.cast("bigint").alias("_mine"),
        *(F.when(own > 0, condition.cast("bigint")).otherwise(0).alias(f"_own_{name}") for name, condition in flags.items()),
    )
    placed = _at_home(placed, years, km)
    days = (F.lit(0.0) if age is None else age).alias("_age")
    counted = [F.count(F.lit(1)).alias("_n"), *(F.count_if(condition).alias(name) for name, condition in flags.items())]
    cells = _positions(pool, keys).withColumn("_price", F.col(price).cast("bigint")).withColumn("_age", days).groupBy(*position, "_price", "_age").agg(*counted)
    # Read as what positions meet and as what answers them.
    visits = cut_lineage(_visiting(cells, years, km), "visits")

    met = visits.select(*[F.col(c).alias("p_" + c) for c in visits.columns])
    on = [F.col(c) == F.col("p_" + c) for c in home] + [F.abs(F.col("year") - F.col("p_year")) <= years, F.abs(F.col("mileage_km") - F.col("p_mileage_km")) <= km, all_equal_or_null(tolerant)]
    w = F.lit(1).cast("bigint") if age is None else peer_weight_nano(F.abs(F.col("year") - F.col("p_year")), F.abs(F.col("mileage_km") - F.col("p_mileage_km")), F.col("p__age"))
    n, wide = F.col("p__n"), "decimal(19,0)"
    # Grouped by the home as well: pairs are summed up in the task in which they meet.
    places = [*home, *tolerant, "year", "mileage_km"]
    sums = placed.select(*places).distinct().join(met.hint("merge"), on).groupBy(*places).agg(
        F.sum(w * n).alias("_w"), F.sum(w.cast(wide) * w.cast(wide) * n).cast("decimal(38,0)").alias("_w2"), F.sum(n).alias("_n"), F.sum(F.col("p__price") * n).alias("_total"), *(F.sum(f"p_{name}").alias(f"_{name}") for name in flags)
    )
    sums = sums.select(*[F.col(c).alias("_s_" + c) if c in places else F.col(c) for c in sums.columns])
    same = F.lit(True)
    for c in places:
        same = same & (F.col(c).eqNullSafe(F.col("_s_" + c)) if c in tolerant else F.col(c) == F.col("_s_" + c))
    less = {"comparable_count": F.col("_n") - F.col("_mine"), "total_price": F.col("_total") - F.col("_mine") * F.col("_own_price"), "sum_weight": F.col("_w") - F.col("_own"), "sum_square": F.col("_w2") - F.col("_own").cast(wide) * F.col("_own").cast(wide), **{name: F.col(f"_{name}") - F.col(f"_own_{name}") for name in flags}}
    rows = placed.join(sums.hint("merge"), same).withColumns(less).filter("comparable_count > 0")
    thresholds = needs(F.col("sum_weight"))
    ask = {f"_ask_{name}_{part}": F.coalesce(F.when(F.col("comparable_count") >= minimum, need.cast("bigint") + F.col("_own") * part), F.lit(_NONE)) for name, need in thresholds.items() for part in (0, 1)}
    facts = ("comparable_count", "total_price", "sum_weight", "sum_square", *flags)
    whole = F.col("sum_square").cast("string").alias("sum_square")
    digests = (F.xxhash64(*home).alias("_h1"), F.xxhash64(F.lit(1), *home).alias("_h2"))
    asked = rows.withColumns(ask).select(
        *digests, F.lit(_QUESTION).alias("_kind"), "year", "mileage_km", *tolerant, F.lit(0).cast("bigint").alias("_price"), F.lit(0).cast("bigint").alias("_n"), F.lit(0.0).alias("_age"), "_own_price",
        *ask, *(F.col(c).alias("_g_" + c) for c in group), *(whole if c == "sum_square" else c for c in facts),
    )
    held = {f.name: F.lit(None).cast(f.dataType) if f.name.startswith("_g_") or f.name == "sum_square" else F.lit(0).cast(f.dataType) for f in asked.schema.fields if f.name in (*facts, *ask, "_own_price") or f.name.startswith("_g_")}
    stock = visits.filter(F.col("_price").isNotNull()).select(*digests, F.lit(_POOL).alias("_kind"), "year", "mileage_km", *tolerant, "_price", "_n", "_age").withColumns(held)
    dealt = stock.unionByName(asked).repartition("_h1", "_h2").sortWithinPartitions("_h1", "_h2", "_kind", "_price")
    out = ["_g_" + c for c in group] + list(facts)
    schema = ", ".join([*(f"{c} {asked.schema[c].dataType.simpleString()}" for c in out), *(f"{name} bigint" for name in thresholds)])
    found = dealt.mapInPandas(_answers(tolerant, list(thresholds), out, years, km, age is not None), schema)
    return found.select(*(F.col("_g_" + c).alias(c) for c in group), *(F.col(c).cast("decimal(38,0)").alias(c) if c == "sum_square" else c for c in facts), *thresholds)


def envelope_needs(total: Column) -> dict[str, Column]:
    """Least and greatest price."""
    return {"low_eur": F.lit(1), "high_eur": total}


def median_needs(total: Column) -> dict[str, Column]:
    """Least, greatest and the two middle prices of peers that weigh one each."""
    return {**envelope_needs(total), "middle_low": F.floor((total + 1) / 2), "middle_high": F.floor(total / 2) + 1}


def share_needs(shares: Sequence[float]) -> Needs:
    """Prices at which the running weight reaches shares of the whole."""
    return lambda total: {f"p{round(q * 100)}": F.ceil(total.cast("double") * F.lit(float(q))) for q in shares}
