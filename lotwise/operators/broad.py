"""Broad peers of every offer cell without a row for each pair of cells.

A home of year and mileage holds all cells its targets may be near to, so a target meets its peers within a
task and only visits are shuffled: some four rows for a cell, whatever the number of pairs. Cells that agree on
power and displacement, then on every tolerant detail, share their candidates; years and mileages decide among
those. A home with many targets is dealt to blocks, each with the home's cells.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .nearby import _at_home, _homes, _positions, _visiting
from .peers import BROAD_CELL, BROAD_TEXT, cell_key
from .temporal import pick_first

#: Targets of a block; figures of (target, candidate) a step holds at once; pairs that are summed up at once.
BLOCK_TARGETS = 16_384
STEP_FIGURES = 1 << 20
STEP_PAIRS = 1 << 18
#: Peers of a signal that are kept as evidence.
SAMPLE = 50

FAMILY = ("make", "model", "damage_group")
FACTS = "cell string, price_eur long, fuel string, transmission string, damage_group string, comparable_count long, _sum long, asking_low_eur long, close_count long, lowest_close_eur long, _no_fuel long, _no_gear long"
EVIDENCE = FACTS + ", lead string, is_lead boolean, evidence_count long, evidence string"
_TYPES = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64()}
#: Stands for no value, and for no price among those compared.
_NONE, _MOST = -(1 << 63), (1 << 63) - 1


def _whole(column: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(column, pa.scalar(_NONE, "int64")).to_numpy()


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Whole numbers for texts, -1 for null."""
    return pc.fill_null(column.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)


def _groups(rows: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """``rows`` by equal values of the columns, ascending within a group."""
    order = rows[np.lexsort([rows, *(c[rows] for c in columns)])]
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    return np.split(order, np.flatnonzero(new))


class _Home:
    """Cells of a home in the order of peers: year, ten thousand kilometres, first listing."""

    def __init__(self, table: pa.Table, years: int, km: int):
        bucket = pa.array(table["mileage_km"].to_numpy() // 10_000)
        order = [("year", "ascending"), ("_bucket", "ascending"), ("source", "ascending"), ("source_id", "ascending")]
        self.table = table = table.append_column("_bucket", bucket).sort_by(order)
        self.years, self.km = years, km
        self.year, self.mileage, self.price, self.copies, self.cc, self.hp = (_whole(table[c]) for c in ("year", "mileage_km", "price_eur", "copies", "displacement_cc", "power_hp"))
        self.text = {c: _codes(table[c]) for c in BROAD_TEXT}
        offers = _groups(np.arange(len(table)), self.year, self.mileage, self.price, _codes(table["city"]))
        self.offer, self.shared = np.zeros(len(table), "int64"), np.zeros(len(table), bool)
        sizes = np.array([len(o) for o in offers])
        self.offer[np.concatenate(offers)] = np.repeat(np.arange(len(offers)), sizes)
        self.shared[np.concatenate(offers)] = np.repeat(sizes > 1, sizes)

    def pairs(self, targets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Targets and their compatible cells near them, all of a target at once, cells ascending."""
        held, size = [], 0
        for numbers in _groups(targets, self.cc, self.hp):
            cc, hp = self.cc[numbers[0]], self.hp[numbers[0]]
            fits = np.ones(len(self.cc), bool)
            if cc != _NONE:
                fits &= (self.cc == _NONE) | (np.abs(self.cc - cc) <= 50)
            if hp != _NONE:
                fits &= (self.hp == _NONE) | (np.abs(self.hp - hp) <= np.maximum(3.0, np.minimum(self.hp, hp) * 0.1))
            some = np.flatnonzero(fits)
            stated = {c: codes[some] for c, codes in self.text.items()}
            for alike in _groups(numbers, *self.text.values()):
                fits = np.ones(len(some), bool)
                for c, codes in stated.items():
                    value = self.text[c][alike[0]]
                    if value >= 0:
                        fits &= (codes < 0) | (codes == value)
                candidates = some[fits]
                year, mileage = self.year[candidates], self.mileage[candidates]
                step = max(1, STEP_FIGURES // len(candidates))
                for at in range(0, len(alike), step):
                    t = alike[at : at + step]
                    near = (np.abs(year - self.year[t][:, None]) <= self.years) & (np.abs(mileage - self.mileage[t][:, None]) <= self.km)
                    # A target's own cell counts when it holds another copy.
                    alone = np.flatnonzero(self.copies[t] == 1)
                    near[alone, np.searchsorted(candidates, t[alone])] = False
                    left, right = near.nonzero()
                    held.append((t[left], candidates[right]))
                    size += len(left)
                    if size >= STEP_PAIRS:
                        yield tuple(np.concatenate(side) for side in zip(*held))
                        held, size = [], 0
        if size:
            yield tuple(np.concatenate(side) for side in zip(*held))

    def distinct(self, t: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offers once for each target, by the first of their cells."""
        shared = np.flatnonzero(self.shared[p])
        if not len(shared):
            return t, p
        keep = np.ones(len(t), bool)
        keep[shared] = False
        keep[shared[np.unique(t[shared] * len(self.offer) + self.offer[p[shared]], return_index=True)[1]]] = True
        return t[keep], p[keep]

    def facts(self, t: np.ndarray, p: np.ndarray, evidence: bool) -> pa.Table:
        starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        price, one = self.price[p], t[starts]
        known = price != _NONE
        close = (np.abs(self.year[p] - self.year[t]) <= 1) & (np.abs(self.mileage[p] - self.mileage[t]) <= 20_000)
        total = lambda v: np.add.reduceat(v.astype("int64"), starts)
        least = lambda mask: np.minimum.reduceat(np.where(mask, price, _MOST), starts)
        or_null = lambda v: pa.array(v, mask=v == _MOST)
        count = np.diff(np.r_[starts, len(t)])
        mine = self.table.select(["cell", "price_eur", "fuel", "transmission", "damage_group", *(["lead", "is_lead"] if evidence else [])]).take(pa.array(one))
        columns = {
            "comparable_count": pa.array(count), "_sum": pa.array(total(np.where(known, price, 0))), "asking_low_eur": or_null(least(known)), "close_count": pa.array(total(close)),
            "lowest_close_eur": or_null(least(known & close)), "_no_fuel": pa.array(total(close & (self.text["fuel"][p] < 0))), "_no_gear": pa.array(total(close & (self.text["transmission"][p] < 0))),
        }
        if evidence:
            chosen, sizes = _sampled(price, starts, count)
            keys = pc.binary_join_element_wise(self.table["source"], self.table["source_id"], "/").take(pa.array(p[chosen])).combine_chunks()
            columns["evidence_count"] = pa.array(sizes)
            columns["evidence"] = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], "int32"), keys), ",")
        for name, values in columns.items():
            mine = mine.append_column(name, values)
        return mine


def _sampled(price: np.ndarray, starts: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs kept as evidence, one target after the other, and their number by target.

    All of up to ``SAMPLE`` pairs stay in their order. Of more stay the cheapest, pairs at even steps and the
    dearest, in the order of their prices; those of equal price as they were taken.
    """
    at = np.arange(len(price)) - np.repeat(starts, count)
    first = lambda found: np.minimum.reduceat(np.where(price == np.repeat(found, count), at, len(price)), starts)
    many = np.flatnonzero(count > SAMPLE)
    low, high = (first(f.reduceat(price, starts))[many] for f in (np.minimum, np.maximum))
    steps = np.rint(np.arange(1, SAMPLE - 1) * (count[many] - 1)[:, None] / (SAMPLE - 1)).astype("int64")
    taken = np.column_stack([low, steps, high])
    again = np.zeros(taken.shape, bool)
    again[:, 1:-1] = steps == low[:, None]
    again[:, -1] = (high == low) | (steps == high[:, None]).any(1)
    taken += starts[many][:, None]
    order = np.lexsort((np.where(again, _MOST, price[taken]), again), axis=1) if len(many) else np.zeros(taken.shape, "int64")
    taken, again = np.take_along_axis(taken, order, 1), np.take_along_axis(again, order, 1)
    sizes = count.copy()
    sizes[many] = (~again).sum(1)
    whole = np.ones(len(starts), bool)
    whole[many] = False
    target = np.repeat(np.arange(len(starts)), count)
    rest = np.flatnonzero(whole[target])
    chosen, of = np.r_[rest, taken[~again]], np.r_[target[rest], np.repeat(many, sizes[many])]
    return chosen[np.argsort(of, kind="stable")], sizes


def _judge(years: int, km: int, evidence: bool):
    schema = pa.schema([(name, _TYPES[kind]) for name, kind in (column.split() for column in (EVIDENCE if evidence else FACTS).split(", "))])

    def judged(key: tuple, table: pa.Table) -> pa.Table:
        done = [schema.empty_table()]
        if pc.any(table["target"]).as_py():
            home = _Home(table, years, km)
            for t, p in home.pairs(np.flatnonzero(home.table["target"].to_numpy())):
                if len(t):
                    done.append(home.facts(*home.distinct(t, p), evidence).select(schema.names).cast(schema))
        return pa.concat_tables(done)

    return judged


def dealt_to_homes(held: DataFrame, family: Sequence[str], years: int, km: int, serves: Column | None = None, for_targets: Sequence[str] = ("cell",)) -> GroupedData:
    """Cells once for each home and block of their family that has targets they may be near to; ``target`` tells their own.

    Cells that don't serve as peers come to their own only. ``for_targets`` are columns read of targets alone.
    """
    names = [name for name, _, _ in _homes(years, km)]
    home = [*family, *names]
    # Homes of more than a block: at most one for each BLOCK_TARGETS cells, whatever the table's size.
    crowded = _at_home(held, years, km).groupBy(*home).agg(F.ceil(F.count(F.lit(1)) / BLOCK_TARGETS).cast("int").alias("_blocks")).filter("_blocks > 1")
    visits = _visiting(held, years, km).join(F.broadcast(crowded), home, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    visits = visits.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    target = F.col("_block") == F.pmod(F.xxhash64("cell"), F.col("_blocks").cast("bigint"))
    for name, value, band in _homes(years, km):
        target = target & (F.col(name) == F.floor(F.col(value) / (2 * band)))
    visits = visits.withColumn("target", target)
    if serves is not None:
        visits = visits.filter(serves | F.col("target"))
    return visits.withColumns({c: F.when(F.col("target"), F.col(c)) for c in for_targets}).drop("_blocks").groupBy(*home, "_block")


def _met(cells: DataFrame, years: int, km: int, evidence: bool) -> DataFrame:
    extra = ["lead", "is_lead"] if evidence else []
    held = _positions(cells, FAMILY).select(*BROAD_CELL, "copies", F.col("first.source").alias("source"), F.col("first.source_id").alias("source_id"), *extra)
    held = cut_lineage(held.withColumn("cell", cell_key(BROAD_CELL)), "cells")
    return dealt_to_homes(held, FAMILY, years, km, for_targets=("cell", *extra)).applyInArrow(_judge(years, km, evidence), EVIDENCE if evidence else FACTS)


def broad_facts(cells: DataFrame, years: int = 3, km: int = 60_000) -> DataFrame:
    """Counts, sums and least prices of the distinct offers near each cell that has one.

    ``cells`` is the output of ``peers.advert_cells``. Offers are those of ``peers.broad_peer_cells``: distinct in
    year, mileage, price and city, each by its first compatible listing; a cell's own listing is none.
    """
    return _met(cells, years, km, False)


def broad_evidence(rows: DataFrame, years: int = 3, km: int = 60_000) -> DataFrame:
    """``broad_facts`` of each listing, with the keys of at most ``SAMPLE`` of its offers' listings.

    The first listing of a cell has the second as its peer, all others the first; so two listings stand for a
    cell, however many it has.
    """
    key, order = F.concat_ws("/", "source", "source_id"), Window.partitionBy(*BROAD_CELL).orderBy("source", "source_id")
    two = pick_first(rows.select(*BROAD_CELL, "source", "source_id"), BROAD_CELL, [F.col("source"), F.col("source_id")], keep=2).withColumn("lead", F.first(key).over(order))
    two = two.withColumns({"is_lead": key == F.col("lead"), "copies": F.lit(1).cast("bigint"), "first": F.struct("source", "source_id")})
    keyed = rows.select("source", "source_id", cell_key(BROAD_CELL).alias("cell"))
    facts = _met(two, years, km, True).withColumnRenamed("cell", "_cell")
    same = (F.col("cell") == F.col("_cell")) & ((key == F.col("lead")) == F.col("is_lead"))
    return keyed.join(facts.hint("merge"), same).drop("_cell", "lead", "is_lead")
