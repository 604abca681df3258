"""Sparse feature vectors: one-hot groups of any number of categories.

A vector is ``array<struct<slot int, category string, value double>>``, zeros
left out, ordered by slot.  A *slot* is a number (category '') or a one-hot group
with one entry per category; the pair (slot, category) is the feature's index,
in the order of the wide frame (slot by slot, categories sorted).  So there is no
dictionary to build, collect or join: a new category is just a new index, and a
million users cost a row no more than one.

Only what a forest's bounded sample holds ever becomes columns: a tree is grown
on the indices of its own rows (others are zero throughout and cannot split),
and scoring fills a matrix of the indices the forest splits on, some rows at a
time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VECTOR = "array<struct<slot:int,category:string,value:double>>"
MATRIX_CELLS = 4_000_000


@dataclass(frozen=True)
class Layout:
    """The slots in feature order: (name, is a one-hot group)."""

    slots: tuple[tuple[str, bool], ...]

    def name(self, slot: int, category: str) -> str:
        name, group = self.slots[slot]
        return f"{name}_{category}" if group else name

    def vector(self, numbers: dict[str, Column], groups: dict[str, Column]) -> Column:
        """The vector of a row from its numbers and categorical values; a NULL
        or NaN is 0."""
        entries = []
        for i, (name, group) in enumerate(self.slots):
            if group:
                c = groups[name].cast("string")
                cat, value = F.coalesce(c, F.lit("")), F.when(c.isNotNull(), 1.0).otherwise(0.0)
            else:
                cat, value = F.lit(""), F.coalesce(F.nanvl(numbers[name].cast("double"), F.lit(0.0)), F.lit(0.0))
            entries.append(F.struct(F.lit(i).alias("slot"), cat.alias("category"), value.alias("value")))
        return F.filter(F.array(*entries), lambda e: e["value"] != 0).cast(VECTOR)


def long_form(df: DataFrame, layout: Layout, column: str = "features",
              id_cols: tuple[str, ...] = ("seq",)) -> DataFrame:
    """One row (id columns, feature, value) per non-zero entry."""
    name = F.element_at(F.array(*[F.lit(n) for n, _ in layout.slots]), F.col("_e.slot") + 1)
    group = F.element_at(F.array(*[F.lit(g) for _, g in layout.slots]), F.col("_e.slot") + 1)
    return df.select(*id_cols, F.explode(column).alias("_e")).select(
        *id_cols, F.when(group, F.concat(name, F.lit("_"), F.col("_e.category"))).otherwise(name)
        .alias("feature"), F.col("_e.value").alias("value"))


# ------------------------------------------------------------- matrices
def entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(row, slot, category, value) of all entries of a vector column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()  # leaves out what null rows would hold
    rows = pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
    slot, category, value = (flat.field(i) for i in range(3))
    return (rows, slot.to_numpy(zero_copy_only=False).astype(np.int64), category,
            value.to_numpy(zero_copy_only=False).astype(np.float64))


def _codes(slot: np.ndarray, category: pa.Array) -> tuple[np.ndarray, list[tuple[int, str]]]:
    """(number of each entry's index, the indices)."""
    enc = category.dictionary_encode()
    cats, code = enc.dictionary.to_pylist(), enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    both, number = np.unique(slot * max(len(cats), 1) + code, return_inverse=True)
    return number, [(int(b) // max(len(cats), 1), cats[int(b) % max(len(cats), 1)]) for b in both]


def local_matrix(column: pa.Array) -> tuple[np.ndarray, list[tuple[int, str]]]:
    """(rows x indices matrix, its indices in feature order) of a bounded sample."""
    rows, slot, category, value = entries(column)
    number, indices = _codes(slot, category)
    order = sorted(range(len(indices)), key=lambda i: indices[i])
    place = np.empty(len(indices), np.int64)
    place[order] = np.arange(len(order))
    m = np.zeros((len(column), max(len(indices), 1)))
    if len(rows):
        m[rows, place[number]] = value
    return m, [indices[i] for i in order]


def filled(column: pa.Array, used: dict[tuple[int, str], int]):
    """(first row, matrix of the indices in ``used``) blocks of a batch."""
    rows, slot, category, value = entries(column)
    number, indices = _codes(slot, category)
    at = np.array([used.get(i, -1) for i in indices], np.int64)
    col = at[number] if len(number) else np.zeros(0, np.int64)
    rows, col, value = rows[col >= 0], col[col >= 0], value[col >= 0]
    step = max(1, MATRIX_CELLS // max(len(used), 1))
    for a in range(0, len(column), step):
        b = min(a + step, len(column))
        i, j = np.searchsorted(rows, [a, b])
        m = np.zeros((b - a, max(len(used), 1)))
        m[rows[i:j] - a, col[i:j]] = value[i:j]
        yield a, m


def vectors_of(series: pd.Series) -> pa.Array:
    """A vector column that came as a pandas series of lists of rows."""
    kind = pa.list_(pa.struct([("slot", pa.int32()), ("category", pa.string()), ("value", pa.float64())]))
    return pa.array([[dict(e) if isinstance(e, dict) else dict(zip(("slot", "category", "value"), e))
                      for e in (v if v is not None else [])] for v in series], kind)
