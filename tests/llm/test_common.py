import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tendrel.llm import common


def test_filter_is_collected_in_little_more_than_its_size(spark, monkeypatch):
    """Every word of a filter may reach the driver: they must not become Python objects there, which take some 60 times its size."""
    monkeypatch.setattr(common, "LEAST_BITS", 1 << 24)
    hashes = spark.range(200_000).select(F.xxhash64("id").alias("u")).repartition(3)
    tracemalloc.start()
    try:
        found = common.sieve(hashes, 200_000).value
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    u = np.array([r["u"] for r in hashes.collect()], np.int64).view(np.uint64)
    want = np.zeros((1 << 24) // 64, np.uint64)
    for n in common._PLACES:
        at = (u >> np.uint64(n)) & np.uint64((1 << 24) - 1)
        np.bitwise_or.at(want, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
    assert np.array_equal(found, want)
    assert common.passes(found, u).all() and common.passes(found, common.mix(u)).mean() < 0.01
    assert most < 5 * found.nbytes


def test_empty_filter_lets_nothing_through(spark):
    found = common.sieve(spark.range(0).select(F.xxhash64("id").alias("u"))).value
    assert not found.any() and not common.passes(found, np.arange(1000, dtype=np.uint64)).any()
