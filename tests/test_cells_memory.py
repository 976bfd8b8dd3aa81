"""What a worker holds of distances is bounded, however many cells there are and however long batches are."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from corvine.plans import cells


def test_bounded_distances():
    rng, n = np.random.default_rng(1), 5000
    x = rng.normal(size=(n, 8)).astype(np.float32)
    centres = rng.normal(size=(cells.CELLS, 8))
    columns = [pa.array(np.arange(n)), pa.array(list(x), pa.list_(pa.float32())), pa.array(np.zeros(n))]
    batch = pa.RecordBatch.from_arrays(columns, names=["id", "vector", "reach"])
    tracemalloc.start()
    coded = [b.column("cell") for b in cells._coded(SimpleNamespace(value=centres))(iter([batch]))]
    visits = sum(len(b) for b in cells._visits(SimpleNamespace(value=(centres, np.zeros(len(centres)))), 3)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert visits == 3 * n and peak < 60
    some = rng.integers(0, n, 50)
    assert np.array_equal(coded[0].to_numpy()[some], cells.squared(x[some].astype(np.float64), centres).argmin(1))
