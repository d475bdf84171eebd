"""A table function and a mergeable aggregate for SQL text.

``hop_levels(samples, size, hop)`` gives the levels of hopping blocks of an array.
A gated level is the mean of the levels over a gate that hangs on all of them; as a
histogram (``level_bin`` to a count) it is a small map that merges by addition:

    SELECT series, gated_level(level_bins(collect_list(struct(bin, n)))) FROM (
      SELECT series, level_bin(level) AS bin, count(*) AS n FROM levels GROUP BY ALL) GROUP BY series

Counts of bins combine before the shuffle; a series has at most a few thousand bins.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tidemark.functions.scalars import ABSOLUTE_GATE, RELATIVE_GATE

#: Bins of a decibel.
FINE = 10


@udtf(returnType="block_idx bigint, level double")
class HopLevels:
    """Level of each whole block; null or short arrays and blocks without a size or hop have none."""

    def eval(self, samples, size: int, hop: int):
        if samples is None or not size or not hop or size < 1 or hop < 1:
            return
        sums = np.concatenate([[0.0], np.cumsum(np.asarray(samples, float) ** 2)])
        for k in range(max(0, (len(samples) - size) // hop + 1)):
            power = max(0.0, sums[k * hop + size] - sums[k * hop]) / size
            yield k, float(-0.691 + 10 * np.log10(max(power, 1e-30)))


_CENTRE = f"((e.bin + 0.5D) / {FINE} + {ABSOLUTE_GATE})"
_MAP, _PAIRS = "MAP<INT, BIGINT>", "ARRAY<STRUCT<bin: INT, n: BIGINT>>"
#: Functions by their heads: bodies that Spark plans as expressions.
FUNCTIONS = {
    "level_bin(level DOUBLE) RETURNS INT": f"CASE WHEN level > {ABSOLUTE_GATE} THEN CAST(floor((level - {ABSOLUTE_GATE}) * {FINE}) AS INT) END",
    f"level_bins(pairs {_PAIRS}) RETURNS {_MAP}": "map_from_entries(filter(pairs, e -> e.bin IS NOT NULL))",
    f"merged_bins(a {_MAP}, b {_MAP}) RETURNS {_MAP}": "map_zip_with(a, b, (k, x, y) -> coalesce(x, 0L) + coalesce(y, 0L))",
    f"level_above(bins {_MAP}, bar DOUBLE) RETURNS DOUBLE": f"""
      aggregate(transform(map_entries(bins), x -> named_struct('bin', x.key, 'n', x.value)), named_struct('p', 0D, 'n', 0L),
        (s, e) -> CASE WHEN bar IS NULL OR {_CENTRE} > bar THEN named_struct('p', s.p + e.n * pow(10D, ({_CENTRE} + 0.691D) / 10), 'n', s.n + e.n) ELSE s END,
        s -> CASE WHEN s.n > 0 THEN -0.691D + 10 * log10(s.p / s.n) END)""",
    f"gated_level(bins {_MAP}) RETURNS DOUBLE": f"level_above(bins, level_above(bins, CAST(NULL AS DOUBLE)) + {RELATIVE_GATE})",
}


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL. A gated level without a loud block is null."""
    spark.udtf.register("hop_levels", HopLevels)
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
