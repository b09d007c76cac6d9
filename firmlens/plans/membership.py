"""Regressions of outcomes on top-share classes for all spaces, scores and outcomes, from one row per firm.

A firm's row holds its years with outcomes, controls and the bits of :func:`~firmlens.operators.compare.packed_membership`. The rows of every key (space, score,
outcome) and specification are cut out of it inside the tasks, so a firm's rows are shuffled once, not once for each key, and clusters and effects of firms need no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmlens.operators import lsq
from firmlens.operators.arrays import Stats, array_quantiles, array_stats, slices
from firmlens.plans.scoring import SPECIFICATIONS
from firmlens.session import materialise, scratch


def packed_rows(base: DataFrame, marks: DataFrame, firm: str = "company", year: str = "year") -> DataFrame:
    """(firm, rows): the firm-years of ``base`` that have marks, as structs with their ``bits``."""
    cols = [c for c in base.columns if c != firm]
    lists = base.repartition(firm).groupBy(firm).agg(F.collect_list(F.struct(*cols)).alias("rows"))
    j = lists.join(marks, firm)
    here = F.filter("rows", lambda r: F.map_contains_key("marks", r[year]))
    with_bits = F.transform(here, lambda r: F.struct(*[r[c].alias(c) for c in cols], F.element_at("marks", r[year]).alias("bits")))
    return j.select(firm, with_bits.alias("rows")).where("size(rows) > 0")


@dataclass
class Block:
    """Firm-years of a batch: firm of each, bits, design row (class columns zero), controls that are missing, outcomes and year."""

    firm: np.ndarray
    bits: np.ndarray
    x: np.ndarray
    gone: np.ndarray
    y: np.ndarray
    year: np.ndarray


@dataclass
class Layout:
    """What the bits and structs stand for. A key is a slot and an outcome; the design is the superset of all specifications."""

    slots: list[tuple]
    outcomes: list[str]
    terms: list[str]
    controls: list[str]
    levels: dict[str, list]

    @property
    def design(self) -> lsq.Design:
        return lsq.Design(["y"], self.terms + self.controls, self.levels)

    @property
    def keys(self) -> list[tuple]:
        return [(*s, o) for s in self.slots for o in self.outcomes]

    def block(self, batch: pa.RecordBatch) -> Block:
        col = batch.column("rows")
        sizes = pc.list_value_length(col).to_numpy(zero_copy_only=False).astype(int)
        flat = col.flatten()
        number = lambda c: pc.struct_field(flat, c).cast(pa.float64()).to_numpy(zero_copy_only=False)
        raw = {f: pc.struct_field(flat, f) for f in self.levels}
        controls = np.column_stack([number(c) for c in self.controls])
        ones = [np.ones(len(flat)), *[np.zeros(len(flat))] * len(self.terms), *np.where(np.isnan(controls), 0.0, controls).T]
        dummies = [pc.fill_null(pc.equal(raw[f], pa.scalar(v, raw[f].type)), False).to_numpy(zero_copy_only=False).astype(float) for _, f, v in self.design.dummies]
        year = pc.index_in(raw["year"], pa.array(self.levels["year"], raw["year"].type)).to_numpy(zero_copy_only=False)
        return Block(np.repeat(np.arange(len(sizes)), sizes), pc.struct_field(flat, "bits").to_numpy(zero_copy_only=False), np.column_stack(ones + dummies), np.isnan(controls),
                     np.column_stack([number(o) for o in self.outcomes]), year)

    def present(self, b: Block) -> np.ndarray:
        """(rows, slots): whether the firm-year is ranked there."""
        return (b.bits[:, None] >> 3 * np.arange(len(self.slots)) & 1).astype(bool)

    def cases(self, b: Block, key: int, controls: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rows of the block, design rows, outcomes, start of every firm) of the complete cases of a key."""
        slot, o = divmod(key, len(self.outcomes))
        code = b.bits >> 3 * slot & 7
        lost = b.gone[:, [self.controls.index(c) for c in controls]].any(axis=1)
        rows = np.flatnonzero((code & 1).astype(bool) & ~np.isnan(b.y[:, o]) & ~lost)
        x, in_a, in_b = b.x[rows], (code[rows] & 2) > 0, (code[rows] & 4) > 0
        for i, flag in enumerate((in_a & ~in_b, in_b & ~in_a, in_a & in_b)):  # the order of ``terms``
            x[:, 1 + i] = flag
        firm = b.firm[rows]
        starts = np.flatnonzero(np.append(True, firm[1:] != firm[:-1])) if len(rows) else np.zeros(0, dtype=int)
        return rows, x, b.y[rows, o], starts

    def outcome_matrix(self, keys: list[int]) -> Callable[[pa.RecordBatch], Iterator[np.ndarray]]:
        """Outcomes by key, missing where the firm-year is not ranked in the key's slot."""

        def read(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            b = self.block(batch)
            slot, o = np.divmod(np.array(keys), len(self.outcomes))
            here = self.present(b)
            for part in slices(len(b.y), len(keys)):
                yield np.where(here[part][:, slot], b.y[part][:, o], np.nan)

        return read


def layout(firms: DataFrame, slots: list[tuple], outcomes: list[str], terms: list[str], controls: list[str]) -> Layout:
    used = firms.select(F.inline("rows")).where(F.coalesce(*outcomes).isNotNull())
    return Layout(slots, outcomes, terms, controls, lsq.factor_levels(used, ["industry", "year"]))


def _sums(firms: DataFrame, cells: list, sizes: list[int], add: Callable[[pa.RecordBatch, list[np.ndarray]], None]) -> list[np.ndarray]:
    """One vector per cell, added up over all batches by ``add``: the design's size, as a task sends it and as it is collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = [np.zeros(n) for n in sizes]
        for batch in batches:
            if batch.num_rows:
                add(batch, acc)
        some = [i for i, a in enumerate(acc) if a.any()]
        if some:
            at = [np.flatnonzero(acc[i]) for i in some]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(some, [len(a) for a in at]).astype("int32")), pa.array(np.concatenate(at).astype("int32")), pa.array(np.concatenate([acc[i][a] for i, a in zip(some, at)]))], ["cell", "at", "v"])

    out = [np.zeros(n) for n in sizes]
    for r in firms.mapInArrow(run, "cell int, at int, v double").groupBy("cell", "at").agg(F.sum("v").alias("v")).collect():
        out[r.cell][r.at] = r.v
    return out


def sizes_of_keys(firms: DataFrame, lay: Layout, min_rows: int = 30) -> tuple[list[int], list[bool]]:
    """(rows, thin) of every key: the counts of :func:`~firmlens.plans.scoring.variation`."""
    years = len(lay.levels["year"])

    def add(batch: pa.RecordBatch, acc: list[np.ndarray]) -> None:
        b = lay.block(batch)
        here = lay.present(b)
        for key, a in enumerate(acc):
            slot, o = divmod(key, len(lay.outcomes))
            rows = np.flatnonzero(here[:, slot] & ~np.isnan(b.y[:, o]))
            year = b.year[rows]
            a[0] += len(rows)
            a[1] += len(np.unique(b.firm[rows]))
            a[2:] += np.bincount(year[~np.isnan(year)].astype(int), minlength=years)

    found = _sums(firms, lay.keys, [2 + years] * len(lay.keys), add)
    return [int(a[0]) for a in found], [bool(a[0] < min_rows or np.count_nonzero(a[2:]) < 2 or a[1] < 2) for a in found]


def _triangle(z: np.ndarray, iu: np.ndarray, ju: np.ndarray) -> np.ndarray:
    return (z.T @ z)[iu, ju]


def _square(v: np.ndarray, q: int) -> np.ndarray:
    g = np.zeros((q, q))
    iu, ju = np.triu_indices(q)
    g[iu, ju] = g[ju, iu] = v
    return g


def _within(a: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``a`` less the means of its firms."""
    sizes = np.diff(np.append(starts, len(a)))
    return a - np.repeat(np.add.reduceat(a, starts, axis=0) / sizes.reshape(-1, *[1] * (a.ndim - 1)), sizes, axis=0)


def leave_one_firm_out(firms: DataFrame, slots: list[tuple], outcomes: list[str], terms: list[str], controls: list[str], key_names: list[str]) -> DataFrame:
    """:func:`~firmlens.operators.lsq.influence_summary` of the coefficients without each firm, for every key with enough variation.

    The coefficients are written once as one array a firm (keys x terms, NaN where the firm has no rows of the key, infinite where the term has no estimate without it).
    """
    lay = layout(firms, slots, outcomes, terms, controls)
    design = lay.design
    p, t = design.width, len(terms)
    iu, ju = np.triu_indices(p + 1)
    keys = [k for k, thin in enumerate(sizes_of_keys(firms, lay)[1]) if not thin]

    def products(batch: pa.RecordBatch, acc: list[np.ndarray]) -> None:
        b = lay.block(batch)
        for key, a in zip(keys, acc):
            _, x, y, _ = lay.cases(b, key, controls)
            a += _triangle(np.column_stack([x, y]), iu, ju)

    grams = _sums(firms, keys, [len(iu)] * len(keys), products)
    xs, pos = design.index(terms + controls, ["industry", "year"]), [design.names.index(n) for n in terms]
    filled = [(k, g) for k, g in zip(keys, grams) if g.any()]
    keys = [k for k, _ in filled]
    solved = [lsq.WithoutGroups(_square(g, p + 1), xs, p, pos) for _, g in filled]
    width = len(keys) * t

    def dropped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            b = lay.block(batch)
            out = np.full((batch.num_rows, len(keys), t), np.nan)
            for i, key in enumerate(keys):
                rows, x, y, starts = lay.cases(b, key, controls)
                if len(rows):
                    est = solved[i].coefficients(x, y, starts)
                    out[b.firm[rows[starts]], i] = np.where(np.isnan(est), np.inf, est)
            at = pa.array(np.arange(batch.num_rows + 1, dtype="int32") * width)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(at, pa.array(out.ravel()))], ["v"])

    full = np.concatenate([s.full for s in solved]) if solved else np.zeros(0)

    def read(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        m = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, width)
        for part in slices(len(m), width):
            yield m[part]

    def count(m: np.ndarray) -> np.ndarray:
        lost, some = np.isinf(m), np.isfinite(m) & np.isfinite(full)
        return np.concatenate([lost.sum(axis=0), (some & (np.sign(m) != np.sign(full))).sum(axis=0)])

    with scratch(firms.sparkSession):  # the written coefficients go once they are summed up
        each = materialise(firms.mapInArrow(dropped, "v array<double>"), "dropone")
        st = array_stats(each, read, width, count, 2 * width)
        median = array_quantiles(each, read, st, [0.5])[:, 0]
    lost, flips = st.counts[:width].astype(int), st.counts[width:].astype(int)
    far = np.fmax(np.abs(st.lo - full), np.abs(st.hi - full))
    known = lambda v: None if np.isnan(v) else float(v)
    out = [
        (*lay.keys[key], term, known(full[c]), known(st.lo[c]), known(st.hi[c]), known(far[c]), int(flips[c]), int(st.n[c]), int(lost[c]), known(median[c]))
        for i, key in enumerate(keys) for j, term in enumerate(terms) for c in [i * t + j]]
    fields = "term string, full_coefficient double, drop_one_min double, drop_one_max double, max_abs_change double, sign_flip_n long, firms_dropped_n long, not_estimable_n long, drop_one_median double"
    return firms.sparkSession.createDataFrame(out, T._parse_datatype_string(", ".join(f"{k} string" for k in key_names) + ", " + fields))


def specification_grid(firms: DataFrame, slots: list[tuple], outcomes: list[str], terms: list[str], key_names: list[str], specs: dict = SPECIFICATIONS, min_rows: int = 30, outcome_sets: dict[str, list[str]] | None = None) -> DataFrame:
    """:func:`~firmlens.plans.scoring.specification_grid` of packed rows: one pass for the matrices of all specifications and keys, one for the sums of their clusters.

    Only a winsorized outcome needs further passes, for its cut-offs. Effects of firms go out with the firm's own means, which its row holds.
    """
    controls = list(dict.fromkeys(c for s in specs.values() for c in s[0]))
    lay = layout(firms, slots, outcomes, terms, controls)
    design = lay.design
    p, years = design.width, len(lay.levels["year"])
    iu, ju = np.triu_indices(p + 1)
    tri, pos = len(iu), [design.names.index(n) for n in terms]
    n_rows, thin = sizes_of_keys(firms, lay, min_rows)
    wanted = [(name, key) for name in specs for key, k in enumerate(lay.keys) if not outcome_sets or k[-1] in outcome_sets[name]]
    cells = [(name, key) for name, key in wanted if not thin[key]]
    cut_keys = sorted({key for name, key in cells if specs[name][3]})
    cuts: dict[int, np.ndarray] = {}
    if cut_keys:  # cut-offs of all rows with an outcome, before missing controls take rows away
        read = lay.outcome_matrix(cut_keys)
        st: Stats = array_stats(firms, read, len(cut_keys))
        cuts = dict(zip(cut_keys, array_quantiles(firms, read, st, [0.01, 0.99])))

    def cut_out(b: Block, name: str, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rows, x, y, starts, y before the firms' means went out)."""
        own, fe, _, winsor = specs[name]
        rows, x, y, starts = lay.cases(b, key, own)
        if winsor:
            y = np.minimum(np.maximum(y, cuts[key][0]), cuts[key][1])
        raw = y
        if "company" in fe and len(rows):
            x[:, 1:], y = _within(x[:, 1:], starts), _within(y, starts)
        return rows, x, y, starts, raw

    def products(batch: pa.RecordBatch, acc: list[np.ndarray]) -> None:
        b = lay.block(batch)
        for (name, key), a in zip(cells, acc):
            _, x, y, starts, raw = cut_out(b, name, key)
            a[:tri] += _triangle(np.column_stack([x, y]), iu, ju)
            a[tri:] += len(starts), raw.sum(), raw @ raw

    solved = []
    for (name, _), v in zip(cells, _sums(firms, cells, [tri + 3] * len(cells), products)):
        fe = specs[name][1]
        absorb = "company" in fe
        g, (n_firms, s, ss) = _square(v[:tri], p + 1), v[tri:]
        xs = design.index(terms + specs[name][0], [f for f in fe if f != "company"])
        beta, inv, rank, rss = lsq.solve(g, xs[1:] if absorb else xs, p)
        n = g[0, 0]
        tss = (ss - s * s / n if absorb else g[p, p] - g[0, p] ** 2 / n) if n > 0 else 0.0
        solved.append((beta[:p], inv[:p, :p], n, rank + int(n_firms) if absorb else rank, rss, tss))
    cells, solved = [c for c, f in zip(cells, solved) if f[2] > 0], [f for f in solved if f[2] > 0]
    two_way = [specs[name][2] == "two_way" for name, _ in cells]

    def meats(batch: pa.RecordBatch, acc: list[np.ndarray]) -> None:
        b = lay.block(batch)
        for (name, key), f, two, a in zip(cells, solved, two_way, acc):
            rows, x, y, starts, _ = cut_out(b, name, key)
            if not len(rows):
                continue
            scores = x * (y - x @ f[0])[:, None]
            a[:tri] += _triangle(np.column_stack([np.add.reduceat(scores, starts, axis=0), np.ones(len(starts))]), iu, ju)
            if two:  # a firm has one row a year
                a[tri:2 * tri] += _triangle(np.column_stack([scores, np.ones(len(rows))]), iu, ju)
                by_year = a[2 * tri:].reshape(years, p + 1)
                np.add.at(by_year, b.year[rows].astype(int), np.column_stack([scores, np.ones(len(rows))]))

    table = []
    for (name, key), f, two, v in zip(cells, solved, two_way, _sums(firms, cells, [2 * tri + years * (p + 1) if two else tri for two in two_way], meats)):
        parts, signs = [_square(v[:tri], p + 1)], [1.0]
        if two:
            by_year = v[2 * tri:].reshape(years, p + 1)
            by_year[:, p] = by_year[:, p] > 0
            parts, signs = [parts[0], by_year.T @ by_year, _square(v[tri:2 * tri], p + 1)], [1.0, 1.0, -1.0]
        got = lsq.clustered_errors(*f, parts, signs, pos)
        known = lambda c, i: None if np.isnan(v := np.broadcast_to(got[c], len(terms))[i]) else float(v)
        table += [(*lay.keys[key], name, term, *[known(c, i) for c in ("estimate", "std_error", "t_value", "p_value")], got["n"], known("r2", i), known("adj_r2", i), got["se_status"]) for i, term in enumerate(terms)]
    table += [(*lay.keys[key], name, term, None, None, None, None, n_rows[key], None, None, "insufficient_variation") for name, key in wanted if thin[key] and n_rows[key] for term in terms]
    fields = "spec string, term string, estimate double, std_error double, t_value double, p_value double, n long, r2 double, adj_r2 double, se_status string"
    return firms.sparkSession.createDataFrame(table, T._parse_datatype_string(", ".join(f"{k} string" for k in key_names) + ", " + fields))
