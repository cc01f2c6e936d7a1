"""Mergeable sketches: distinct counts and quantiles of any span of stored parts, without reading the rows again.

A part, such as a day, keeps a HyperLogLog sketch and a quantile sketch for each column; merged, they give what one sketch
over all rows would, within the same error. They stand beside the exact counts, which expand rows for every column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of a distinct count: bits of the sketch's size, and its relative error (three standard errors).
LOG_SIZE = 14
DISTINCT_ERROR = 3 * 1.04 / (1 << LOG_SIZE // 2)
#: Of a quantile: size of the sketch, and how far its rank may be off.
QUANTILE_SIZE, RANK_ERROR = 800, 0.01


def build_sketches(rows: DataFrame, part: Column, distinct: Sequence[str] = (), quantiles: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """part, ``by``, rows, and a sketch for each column: hll_<column> and kll_<column>. Nulls aren't counted."""
    hll = [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(LOG_SIZE)).alias(f"hll_{c}") for c in distinct]
    kll = [F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(QUANTILE_SIZE)).alias(f"kll_{c}") for c in quantiles]
    return rows.groupBy(part.alias("part"), *by).agg(F.count(F.lit(1)).alias("rows"), *hll, *kll)


def merge_sketches(parts: DataFrame, by: Sequence[str] = (), shares: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """``by``, rows, distinct_<column> and <column>_p<share>, of all the parts given."""
    hll, kll = ([c for c in parts.columns if c.startswith(p)] for p in ("hll_", "kll_"))
    merged = parts.groupBy(*by).agg(F.sum("rows").alias("rows"), *(F.hll_union_agg(c).alias(c) for c in hll), *(F.kll_merge_agg_double(c).alias(c) for c in kll))
    counts = [F.hll_sketch_estimate(c).alias("distinct_" + c.removeprefix("hll_")) for c in hll]
    points = [F.kll_sketch_get_quantile_double(c, F.lit(float(s))).alias(f"{c.removeprefix('kll_')}_p{round(100 * s)}") for c in kll for s in shares]
    return merged.select(*by, "rows", *counts, *points)


def distinct_is_within(estimate: Column, exact: Column, error: float = DISTINCT_ERROR) -> Column:
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), error * exact)
