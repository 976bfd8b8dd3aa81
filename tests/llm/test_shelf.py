"""A model's arrays are read with a bounded number of open files, however many ranges it has."""

import os
import resource

import numpy as np

from corvine.llm import ngram_lm


def test_more_ranges_than_descriptors(tmp_path):
    shelf, n = ngram_lm.Shelf(f"file://{tmp_path}/shelf", 400), 400
    for name in ("a", "b", "c"):
        for i in range(n):
            key = np.array([(i << 64) // n + 7], dtype=np.uint64) if name == "a" else np.array([i], dtype=np.uint64)
            shelf.write(name, i, key=key, many=np.array([i + 1]))
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    opened = len(os.listdir("/proc/self/fd"))
    resource.setrlimit(resource.RLIMIT_NOFILE, (opened + ngram_lm.MAPS + 40, hard))
    try:
        for _ in range(2):
            for i in range(n):
                assert all(shelf.read(name, i)["many"][0] == i + 1 for name in ("a", "b", "c"))
        keys = np.array([(i << 64) // n + 7 for i in range(n)], dtype=np.uint64)
        place = ngram_lm.range_of(keys, n)
        assert len(np.unique(place)) > 300 and len(os.listdir("/proc/self/fd")) <= opened + ngram_lm.MAPS + 10
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))
