"""A blocked Bloom filter of 64-bit keys with a size limit, so that it can go to every executor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_WORDS = 8
#: The filter's size limit, and with it what is sent to each executor; beyond it only false hits grow, which the join removes.
MAX_FILTER_BYTES = 32 << 20
BITS_PER_KEY, PROBES = 16, 6


def _bits(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash and its bit positions (n, PROBES) within 512 bits."""
    u = h.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        mixed = (u ^ (u >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    at = np.stack([(mixed >> np.uint64(64 - 9 * (i + 1))) & np.uint64(511) for i in range(PROBES)], axis=1)
    return (u % np.uint64(blocks)).astype(np.int64), at.astype(np.int64)


def build_filter(keys: DataFrame) -> np.ndarray:
    """Blocked Bloom filter of ``keys(h)`` as an array (blocks, 8) of 64-bit words, merged by OR across partitions."""
    n = keys.count()
    blocks = 1
    while blocks * 512 < n * BITS_PER_KEY and blocks * 128 <= MAX_FILTER_BYTES:
        blocks *= 2

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = np.zeros((blocks, BLOCK_WORDS), dtype=np.uint64)
        for b in batches:
            block, bits = _bits(b["h"].to_numpy(), blocks)
            for i in range(PROBES):
                np.bitwise_or.at(words, (block, bits[:, i] >> 6), np.uint64(1) << (bits[:, i] & 63).astype(np.uint64))
        used = np.flatnonzero(words.any(axis=1))
        yield pd.DataFrame({"block": used} | {f"x{i}": words[used, i].view(np.int64) for i in range(BLOCK_WORDS)})

    schema = "block long, " + ", ".join(f"x{i} long" for i in range(BLOCK_WORDS))
    merged = keys.select("h").mapInPandas(partial, schema).groupBy("block").agg(*[F.bit_or(f"x{i}").alias(f"x{i}") for i in range(BLOCK_WORDS)])
    out = np.zeros((blocks, BLOCK_WORDS), dtype=np.int64)
    for r in merged.toLocalIterator():  # at most MAX_FILTER_BYTES
        out[r["block"]] = r[1:]
    return out.view(np.uint64)


def probe(filter_words: np.ndarray):
    @F.pandas_udf("boolean")
    def may_be_listed(h: pd.Series) -> pd.Series:
        block, bits = _bits(h.to_numpy(), len(filter_words))
        hit = np.ones(len(block), dtype=bool)
        for i in range(PROBES):
            hit &= (filter_words[block, bits[:, i] >> 6] >> (bits[:, i] & 63).astype(np.uint64)) & np.uint64(1) == 1
        return pd.Series(hit)

    return may_be_listed
