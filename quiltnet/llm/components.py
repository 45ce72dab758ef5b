"""Components of edge lists: of a bucket in numpy, of a whole table in Spark."""

from __future__ import annotations

import numpy as np

from ..operators.components import connected_components

__all__ = ["connected_components", "local_roots"]


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component) of an edge list, in numpy."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        rx, ry = root[x], root[y]
        differ = rx != ry
        if not differ.any():
            break
        x, y, rx, ry = x[differ], y[differ], rx[differ], ry[differ]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return nodes, nodes[root]
