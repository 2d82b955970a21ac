"""Boosted regression trees of a fixed depth on binned columns: squared error, row and column sampling by a fixed seed."""

from __future__ import annotations

import numpy as np

#: Rounds, depth, step, shares of rows and columns of a round, penalty of a leaf, rows that a fit needs, bins of a column.
ROUNDS, DEPTH, STEP, ROWS, COLUMNS, LEAF_PENALTY, LEAST, BINS = 250, 3, 0.05, 0.8, 0.8, 1.0, 80, 64


def edges_of(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Each column's thresholds: between its values while these are few, else at its quantiles."""
    out = []
    for column in x.T:
        known = np.unique(column)
        if len(known) > bins:
            known = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="nearest"))
        out.append((known[1:] + known[:-1]) / 2)
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bin of each value: how many of its column's thresholds lie below it."""
    return np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)]) if x.shape[1] else np.empty(x.shape, np.int64)


def best_splits(place: np.ndarray, slope: np.ndarray, cells: int, nodes: int, width: int, penalty: float = LEAF_PENALTY):
    """Of each node the (column, bin) after which a split gains most, and what it gains.

    ``place`` (rows x columns) are cells of a histogram over node, column and bin; sums over a node's bins from the left
    are what a split after each bin sends left.
    """
    flat = place.ravel()
    sums = np.bincount(flat, np.repeat(slope, place.shape[1]), cells).reshape(nodes, -1, width).cumsum(axis=2)
    counts = np.bincount(flat, minlength=cells).reshape(nodes, -1, width).cumsum(axis=2)
    total, rows = sums[:, :, -1:], counts[:, :, -1:]
    right, rows_right = total - sums, rows - counts
    gain = sums**2 / (counts + penalty) + right**2 / (rows_right + penalty) - total**2 / (rows + penalty)
    gain[(counts < 1) | (rows_right < 1)] = -np.inf
    flat_gain = gain.reshape(nodes, -1)
    best = flat_gain.argmax(axis=1)
    return best // width, best % width, flat_gain[np.arange(nodes), best]


def boosted(x: np.ndarray, y: np.ndarray, asked: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, seed: int = 0) -> np.ndarray:
    """Predictions for the rows ``asked`` of an ensemble that is fitted to ``x`` and ``y``; zeros where rows are too few."""
    n, k = x.shape
    if n < LEAST or not k:
        return np.zeros(len(asked))
    edges = edges_of(x)
    width = max(map(len, edges)) + 1
    code, new = binned(x, edges), binned(asked, edges)
    rng = np.random.default_rng(seed)
    fitted, out = np.full(n, y.mean()), np.full(len(asked), y.mean())
    n_columns = max(1, int(COLUMNS * k))
    for _ in range(rounds):
        rows = np.flatnonzero(rng.random(n) < ROWS)
        columns = np.sort(rng.choice(k, n_columns, replace=False))
        own = code[np.ix_(rows, columns)] + np.arange(n_columns) * width
        slope = y[rows] - fitted[rows]
        node, leaf, leaf_new = np.zeros(len(rows), np.int64), np.zeros(n, np.int64), np.zeros(len(asked), np.int64)
        for level in range(depth):
            nodes = 1 << level
            cells = nodes * n_columns * width
            column, bin_, gain = best_splits(own + node[:, None] * (n_columns * width), slope, cells, nodes, width)
            bin_ = np.where(gain > 1e-6, bin_, width)  # a node that gains nothing sends all rows left
            column = columns[column]
            leaf = 2 * leaf + (code[np.arange(n), column[leaf]] > bin_[leaf])
            leaf_new = 2 * leaf_new + (new[np.arange(len(asked)), column[leaf_new]] > bin_[leaf_new])
            node = leaf[rows]
        leaves = 1 << depth
        value = STEP * np.bincount(node, slope, leaves) / (np.bincount(node, minlength=leaves) + LEAF_PENALTY)
        fitted += value[leaf]
        out += value[leaf_new]
    return out
