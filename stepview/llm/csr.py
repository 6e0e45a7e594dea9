"""Sparse matrices of zeros and ones, or of counts, by rows; products row by row after Gustavson."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np

#: Products formed at a time.
BLOCK = 1 << 20


@dataclasses.dataclass(frozen=True)
class Csr:
    """Row ``i`` has its columns at ``indices[indptr[i]:indptr[i + 1]]``, its values there in ``data`` (None: all one)."""

    indptr: np.ndarray
    indices: np.ndarray
    columns: int
    data: np.ndarray | None = None

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    def lengths(self) -> np.ndarray:
        return np.diff(self.indptr)


def spans(ends: np.ndarray) -> Csr:
    """Incidence of parts and places: part ``i`` covers the places from the end of the part before to ``ends[i]``."""
    places = int(ends[-1]) if len(ends) else 0
    return Csr(np.concatenate([[0], ends]), np.arange(places), places)


def members(group: np.ndarray, groups: int) -> Csr:
    """Incidence of things and the one group each of them is in."""
    return Csr(np.arange(len(group) + 1), group, groups)


def transposed(m: Csr) -> Csr:
    order = np.argsort(m.indices, kind="stable")
    row = np.repeat(np.arange(m.rows), m.lengths())[order]
    indptr = np.concatenate([[0], np.cumsum(np.bincount(m.indices, minlength=m.columns))])
    return Csr(indptr, row, m.rows, None if m.data is None else m.data[order])


def sizes(a: Csr, b: Csr) -> np.ndarray:
    """For each row of ``a`` how many products its row of ``a b`` is the sum of."""
    each = np.concatenate([[0], np.cumsum(b.lengths()[a.indices])])
    return each[a.indptr[1:]] - each[a.indptr[:-1]]


def blocks(a: Csr, b: Csr, most: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, columns and values of ``a b`` by row and column, some whole rows of ``a`` at a time.

    Row ``i`` of the product is the sum of the rows of ``b`` that row ``i`` of ``a`` names. A block has ``most`` such
    products or a single row with more."""
    ends = np.cumsum(sizes(a, b))
    begin = 0
    while begin < a.rows:
        before = int(ends[begin - 1]) if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield _rows(a, b, begin, stop)
        begin = stop


def _rows(a: Csr, b: Csr, begin: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inner = slice(int(a.indptr[begin]), int(a.indptr[stop]))
    named = a.indices[inner]
    many = b.lengths()[named]
    total = int(many.sum())
    first = np.cumsum(many) - many
    at = np.repeat(b.indptr[named] - first, many) + np.arange(total)
    row = np.repeat(np.repeat(np.arange(begin, stop), np.diff(a.indptr[begin : stop + 1])), many)
    column = b.indices[at]
    value = np.ones(total, np.int64) if b.data is None else b.data[at]
    if a.data is not None:
        value = value * np.repeat(a.data[inner], many)
    key = row * b.columns + column
    if total and (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        key, row, column, value = key[order], row[order], column[order], value[order]
    new = np.ones(total, bool)
    new[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(new)
    return row[starts], column[starts], np.add.reduceat(value, starts) if total else value


def product(a: Csr, b: Csr, most: int = BLOCK) -> Csr:
    """``a b``, all of it."""
    parts = list(blocks(a, b, most))
    row, column, value = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]) for k in range(3))
    indptr = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=a.rows))])
    return Csr(indptr, column, b.columns, value)
