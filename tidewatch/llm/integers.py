"""Vectors of floating-point components as exact integers, batch by batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Squared lengths stay below this, so inner products and squared distances of two vectors fit in a long.
ROOM = float(1 << 60)


def floored(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(components, lengths, sound): floor(scale * x) of all components in one flat array, each row's length, and
    whether the row takes part.

    A row is sound if it is neither null nor empty, all its components are finite numbers, and the sum of their squares
    leaves room in a long. ``scale`` is a power of two, so the product is exact. Unsound rows' components are zeros.
    """
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column).cast(pa.float64())
    x = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(x * scale)
        row = np.repeat(np.arange(len(lengths)), lengths)
        energy = np.bincount(row, x * x, len(lengths))
        sound = (lengths > 0) & (energy < ROOM)  # false for nan, too
    return np.where(sound[row], x, 0.0).astype(np.int64), lengths, sound


def matrix(values: np.ndarray, lengths: np.ndarray, chosen: np.ndarray, d: int) -> np.ndarray:
    """The chosen rows, all of length ``d``, as a matrix."""
    return values[np.repeat(chosen, lengths)].reshape(-1, d)


def lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A list array of these lengths over flat integers."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values))
