"""Two blocks of prints against each other as matrix products; assign.py deals the blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Pairs compared at once.
STRIP = 1 << 20


def close_prints(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of a key's left and right prints that may lie closer than ``threshold``, with their distance.

    A key marked ``_same`` holds one block, which meets itself. Products only sort out what is certainly too far
    (the margin covers their rounding); the distance is then summed component by component, as ``feature_distance`` does.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        prints = table.column("print").combine_chunks()
        lengths = prints.value_lengths().to_numpy(zero_copy_only=False)
        left = table.column("_left").to_numpy(zero_copy_only=False).astype(bool)
        same = table.column("_same").to_numpy(zero_copy_only=False).astype(bool)
        ids, project = table.column("asset_id").combine_chunks(), table.column("project_id").combine_chunks()
        starts = np.cumsum(lengths, dtype=np.int64) - lengths
        values = prints.flatten().to_numpy(zero_copy_only=False)
        for n in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == n)
            a, b = rows[left[rows]], rows[~left[rows] | same[rows]]
            whole = lambda at: values[starts[at][:, None] + np.arange(n)]
            x, y = whole(a), whole(b)
            for one, two, distance in _near(x, y, threshold):
                one, two = a[one], b[two]
                keep = ~same[one] | (one < two)
                one, two = pa.array(one[keep]), pa.array(two[keep])
                if len(one):
                    yield pa.RecordBatch.from_arrays([project.take(one), ids.take(one), ids.take(two), pa.array(distance[keep])], ["project_id", "a", "b", "distance"])

    return compare


def _near(x: np.ndarray, y: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in ``x`` and ``y`` of pairs closer than ``threshold``, and their distance."""
    with np.errstate(all="ignore"):
        xd, yd = x.astype(np.float64), y.astype(np.float64)
        xx, yy = (xd * xd).sum(1), (yd * yd).sum(1)
        # also of differences taken in single precision
        rounding = 4 * np.finfo(np.float32 if x.dtype == np.float32 else np.float64).eps * (x.shape[1] + 8)
        step = max(1, STRIP // max(1, len(y)))
        for at in range(0, len(x), step):
            norms = xx[at : at + step, None] + yy
            squares = norms - 2 * (xd[at : at + step] @ yd.T)
            one, two = np.nonzero(~(squares > threshold * threshold * (1 + 1e-9) + rounding * norms))
            one += at
            for k in range(0, len(one), STRIP):
                p, q = one[k : k + STRIP], two[k : k + STRIP]
                total = np.zeros(len(p))
                for c in range(x.shape[1]):
                    apart = (x[p, c] - y[q, c]).astype(np.float64)
                    total += apart * apart
                distance = np.sqrt(total)
                close = distance < threshold
                if close.any():
                    yield p[close], q[close], distance[close]
