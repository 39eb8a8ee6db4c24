"""Sparse matrices in compressed rows, and their product row by row.

A matrix of ``len(starts) - 1`` rows holds the columns of row i, ascending, in
``columns[starts[i]:starts[i + 1]]`` and their values beside them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

PRODUCT_NONZEROS = 1 << 20


@dataclass
class Csr:
    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @property
    def height(self) -> int:
        return len(self.starts) - 1

    @classmethod
    def of_runs(cls, lengths: np.ndarray, width: int) -> Csr:
        """Row i has ones in the ``lengths[i]`` columns after those of row i - 1."""
        starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        return cls(starts, np.arange(starts[-1], dtype=np.int64), np.ones(starts[-1], np.int64), width)

    @classmethod
    def of_labels(cls, labels: np.ndarray, width: int) -> Csr:
        """Row i has a one in column ``labels[i]``."""
        rows = len(labels)
        return cls(np.arange(rows + 1, dtype=np.int64), labels.astype(np.int64), np.ones(rows, np.int64), width)

    def transposed(self) -> Csr:
        order = np.argsort(self.columns, kind="stable")
        counts = np.bincount(self.columns, minlength=self.width)
        rows = np.repeat(np.arange(self.height), np.diff(self.starts))
        return Csr(np.concatenate([[0], np.cumsum(counts)]), rows[order], self.values[order], self.height)

    def times_vector(self, vector: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0], np.cumsum(self.values * vector[self.columns])])
        return running[self.starts[1:]] - running[self.starts[:-1]]

    def product(self, other: Csr, most: int = PRODUCT_NONZEROS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Nonzeros (row, column, value) of self @ other, in order, a block of rows at a time.

        Gustavson's way: row i of the product is the sum of the other matrix'
        rows at row i's columns, each times its value.  Blocks hold at most
        ``most`` summands; a single row with more is a block of its own.
        """
        sizes = np.diff(other.starts)
        summands = np.concatenate([[0], np.cumsum(sizes[self.columns])])[self.starts]
        first = 0
        while first < self.height:
            last = int(np.searchsorted(summands, summands[first] + most, side="right")) - 1
            last = min(max(last, first + 1), self.height)
            part = slice(self.starts[first], self.starts[last])
            met, counts = self.columns[part], sizes[self.columns[part]]
            rows = np.repeat(np.repeat(np.arange(first, last), np.diff(self.starts[first : last + 1])), counts)
            ends = np.cumsum(counts)
            places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(other.starts[met] - ends + counts, counts)
            columns = other.columns[places]
            values = np.repeat(self.values[part], counts) * other.values[places]
            yield _summed(rows, columns, values, other.width)
            first = last


def _summed(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of one place added up; entries come by row."""
    keys = rows * width + columns
    if len(keys) > 1 and (keys[1:] < keys[:-1]).any():
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new] // max(width, 1), keys[new] % max(width, 1), np.add.reduceat(values, new) if len(new) else values
