"""Peers of the same strict variant, counted within a task without a row for each pair of listings.

Listings that agree on all a peer search reads are one cell. Two listings of a variant agree on their headline,
on its signature's label, or, without headlines, on their trim; so a target looks its candidates up by these and
compares the other fields with them alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import broad
from .broad import _MOST, _NONE, _codes, _groups, _whole, dealt_to_homes
from .nearby import _positions
from .peers import cell_key

FAMILY = ("make", "transmission")
FIELDS = ("generation", "trim", "power_hp", "displacement_cc", "body_type")
CELL = (*FAMILY, *FIELDS, "version", "label", "roman", "year", "mileage_km", "price_eur", "serves")
FACTS = "cell string, peer_count long, low_eur long, sum_eur long"
_SCHEMA = pa.schema([("cell", pa.string()), *((c, pa.int64()) for c in ("peer_count", "low_eur", "sum_eur"))])


class _Rows:
    """Serving cells by the value of a column."""

    def __init__(self, codes: np.ndarray, rows: np.ndarray):
        self.rows = rows[np.argsort(codes[rows], kind="stable")]
        self.codes = codes[self.rows]

    def of(self, value: int) -> np.ndarray:
        return self.rows[np.searchsorted(self.codes, value) : np.searchsorted(self.codes, value, "right")]


class _Home:
    def __init__(self, table: pa.Table, years: int, km: int):
        self.table, self.years, self.km = table, years, km
        self.year, self.mileage, self.price, self.copies = (_whole(table[c]) for c in ("year", "mileage_km", "price_eur", "copies"))
        self.serves = table["serves"].to_numpy()
        self.version, self.label, self.roman = (_codes(table[c]) for c in ("version", "label", "roman"))
        self.fields = {c: _codes(table[c]) for c in FIELDS}
        serving, bare = np.flatnonzero(self.serves), np.flatnonzero(self.serves & (self.version < 0))
        self.by_version, self.by_label, self.bare_by_trim = _Rows(self.version, serving), _Rows(self.label, serving), _Rows(self.fields["trim"], bare)

    def candidates(self, one: int) -> np.ndarray:
        """Serving cells of the variant of a target, wherever they are, ascending."""
        fields, known = self.fields, lambda c: self.fields[c][one]
        if self.version[one] < 0:
            if known("trim") < 0 or known("generation") < 0:
                return np.zeros(0, "int64")
            some = self.bare_by_trim.of(known("trim"))
            some = some[fields["generation"][some] == known("generation")]
        else:
            some = self.by_version.of(self.version[one])
            engine = known("power_hp") >= 0 and known("displacement_cc") >= 0
            if engine and self.label[one] >= 0:
                other = self.by_label.of(self.label[one])
                fits = (self.version[other] >= 0) & (fields["power_hp"][other] == known("power_hp")) & (fields["displacement_cc"][other] == known("displacement_cc"))
                if self.roman[one] >= 0:
                    fits &= (self.roman[other] < 0) | (self.roman[other] == self.roman[one])
                some = np.union1d(some, other[fits])
        for c, codes in fields.items():
            if known(c) >= 0:
                some = some[(codes[some] < 0) | (codes[some] == known(c))]
        return np.sort(some)

    def facts(self, targets: np.ndarray) -> pa.Table:
        held = [(targets[:0],) * 4]
        for alike in _groups(targets, *self.fields.values(), self.version, self.label, self.roman):
            some = self.candidates(alike[0])
            if not len(some):
                continue
            year, mileage, price, copies = (v[some] for v in (self.year, self.mileage, self.price, self.copies))
            known = price != _NONE
            step = max(1, broad.STEP_FIGURES // len(some))
            for at in range(0, len(alike), step):
                t = alike[at : at + step]
                near = (np.abs(year - self.year[t][:, None]) <= self.years) & (np.abs(mileage - self.mileage[t][:, None]) <= self.km)
                # A target is no peer of its own, its copies are.
                own = self.serves[t].astype("int64")
                alone = np.flatnonzero((own == 1) & (self.copies[t] == 1))
                mine = np.where(own == 1, self.price[t], 0)
                near[alone, np.searchsorted(some, t[alone])] = False
                own[alone] = 0
                count = near @ copies - own
                total = near @ np.where(known, price * copies, 0) - np.where((own == 1) & (mine != _NONE), mine, 0)
                low = np.where(near & known, price, _MOST).min(1)
                found = np.flatnonzero(count > 0)
                held.append((t[found], count[found], low[found], total[found]))
        t, count, low, total = (np.concatenate(side) for side in zip(*held))
        none = low == _MOST
        return pa.table([self.table["cell"].take(pa.array(t)), pa.array(count), pa.array(low, mask=none), pa.array(total, mask=none)], schema=_SCHEMA)


def _judge(years: int, km: int):
    def judged(key: tuple, table: pa.Table) -> pa.Table:
        if not pc.any(table["target"]).as_py():
            return _SCHEMA.empty_table()
        return _Home(table, years, km).facts(np.flatnonzero(table["target"].to_numpy()))

    return judged


def variant_summary(rows: DataFrame, serves: Column, years: int = 2, km: int = 40_000) -> DataFrame:
    """source, source_id, peer_count, low_eur and sum_eur of each listing that has a peer.

    Peers are other ``rows`` that serve, of equal make and gearbox, within the band and of the same variant
    (``peers.same_variant`` over ``FIELDS``, on columns ``version`` and ``signature``).
    """
    flat = rows.withColumns({"label": F.col("signature.label"), "roman": F.col("signature.roman"), "serves": F.coalesce(serves, F.lit(False))})
    cells = _positions(flat, FAMILY).groupBy(*CELL).agg(F.count(F.lit(1)).alias("copies")).withColumn("cell", cell_key(CELL))
    facts = dealt_to_homes(cut_lineage(cells, "cells"), FAMILY, years, km, F.col("serves")).applyInArrow(_judge(years, km), FACTS)
    keyed = flat.select("source", "source_id", cell_key(CELL).alias("cell"))
    return keyed.join(facts.hint("merge"), "cell").drop("cell")
