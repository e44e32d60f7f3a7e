"""Exact linear-interpolated percentiles that survive a hot group.

A sorted list keeps all values of a group in one row, which is fine for a series
known to be short (its length ``n`` is on the rows).  For longer ones values are
pre-aggregated to (group, value) counts and ranks are sought in bounded histograms: first over logarithmic buckets, then over PARTS equal parts
between the least and greatest value of each bucket that holds a requested
rank, as often as such parts still hold many values.  Both ways interpolate by
the same formula and keep a row of NULLs for a group without values, so the
choice never shows in a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.core.session import materialise

SHORT = 100_000  # series up to this length are sorted in one row
PARTS = 4096  # parts of an opened bucket
WIDE = 50_000  # values of a bucket that one task may rank
_PER_OCTAVE = 512
_TINY = 1e-12


def value_bucket(v: Column) -> Column:
    """Monotone bucket of a double, about 0.14 % wide."""
    size = F.floor(F.log2(F.abs(v)) * _PER_OCTAVE) + F.lit(64 * _PER_OCTAVE)
    return F.when(F.abs(v) < _TINY, F.lit(0)).when(v > 0, size).otherwise(-size).cast("long")


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    specs: dict[str, tuple[str | Column, float]],
    short: int = SHORT,
) -> DataFrame:
    """One row per group with a column per spec ``name -> (value, p)``; nulls and
    NaN are ignored.  With a series length ``n`` on the rows, groups inside short
    series are sorted as one list."""
    if "n" not in df.columns:
        return ranked_quantiles(df, keys, specs)
    keys = list(keys)
    lists: list[Column] = []
    ids: dict[str, int] = {}
    places = []
    for spec, (value, p) in enumerate(specs.values()):
        known = ids.get(value) if isinstance(value, str) else None
        if known is None:
            known = len(lists)
            lists.append(F.sort_array(F.collect_list(_usable(value))).alias(f"_s{known}"))
            if isinstance(value, str):
                ids[value] = known
        held = F.col(f"_s{known}")
        pos = (F.size(held) - 1) * F.lit(float(p))
        places += [
            F.when(F.size(held) > 0, pos).alias(f"_p{spec}"), F.get(held, F.floor(pos).cast("int")).alias(f"_l{spec}"),
            F.get(held, F.ceil(pos).cast("int")).alias(f"_h{spec}")]
    direct = _interpolated(df.where(F.col("n") <= short).groupBy(*keys).agg(*lists).select(*keys, *places), keys, specs)
    return direct.unionByName(ranked_quantiles(df.where(F.col("n") > short), keys, specs))


def _usable(value: str | Column) -> Column:
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.when(~F.isnan(v), v)


def _between(pos: Column, lo: Column, hi: Column) -> Column:
    """``lo * (ceil - pos) + hi * (pos - floor)`` with the first product fused
    into the sum, as the SQL twins round it: thresholds built on a percentile are
    compared with samples of the same grid, where one last bit moves a crossing.
    The product's and the sum's errors are exact (Dekker, Knuth)."""
    a, b, c = lo, F.ceil(pos) - pos, hi * (pos - F.floor(pos))

    def halves(x: Column) -> tuple[Column, Column]:
        top = x * F.lit(134217729.0) - (x * F.lit(134217729.0) - x)
        return top, x - top

    (a1, a2), (b1, b2) = halves(a), halves(b)
    product = a * b
    lost = a2 * b2 - (product - a1 * b1 - a2 * b1 - a1 * b2)
    total = product + c
    other = total - product
    rest = (product - (total - other)) + (c - other)
    fused = F.when(F.greatest(F.abs(lo), F.abs(hi)) < 1e290, total + (rest + lost)).otherwise(total)
    return F.when((F.floor(pos) == F.ceil(pos)) | (lo == hi), lo).otherwise(fused)


def _interpolated(places: DataFrame, keys: Sequence[str], specs: dict[str, tuple[str | Column, float]]) -> DataFrame:
    """Percentiles from the position and the two neighbouring values of each spec."""
    return places.select(*keys, *[
        _between(*[F.col(f"_{c}{spec}") for c in "plh"]).alias(name) for spec, name in enumerate(specs)])


def ranked_quantiles(
    df: DataFrame, keys: Sequence[str], specs: dict[str, tuple[str | Column, float]]
) -> DataFrame:
    """``quantiles`` for groups of any size."""
    keys = list(keys)
    measures: list[Column] = []
    ids: dict[str, int] = {}
    wanted: list[tuple[int, int, float]] = []
    for spec, (value, p) in enumerate(specs.values()):
        known = ids.get(value) if isinstance(value, str) else None
        if known is None:
            known = len(measures)
            measures.append(F.col(value) if isinstance(value, str) else value)
            if isinstance(value, str):
                ids[value] = known
        wanted.append((spec, known, p))

    if len(measures) == 1:
        long = df.select(*keys, F.lit(0).alias("_m"), measures[0].cast("double").alias("_v"))
    else:
        pairs = [F.struct(F.lit(i).alias("m"), c.cast("double").alias("v")) for i, c in enumerate(measures)]
        long = df.select(*keys, F.explode(F.array(*pairs)).alias("_p")).select(*keys, F.col("_p.m").alias("_m"), F.col("_p.v").alias("_v"))
    long = long.withColumn("_v", F.when(~F.isnan("_v"), F.col("_v") + 0.0))
    cells = long.groupBy(*keys, "_m", "_v").agg(F.count(F.lit(1)).alias("_c"))
    # a NULL value marks that its group exists
    exists = cells.where(F.col("_v").isNull()).select(*keys).distinct()
    cells = cells.where(F.col("_v").isNotNull()).withColumn("_b", value_bucket(F.col("_v")))
    group = [*keys, "_m"]
    hist = _counted(cells, group)
    whole = Window.partitionBy(*group)
    hist = hist.withColumn("_total", F.sum("_hc").over(whole))
    ranks = F.array(
        *[
            F.struct(
                F.lit(spec).alias("spec"), F.lit(m).alias("m"), F.lit(side).alias("side"),
                (F.floor if side == 0 else F.ceil)((F.col("_total") - 1) * F.lit(float(p))).cast("long").alias("rank"),
                ((F.col("_total") - 1) * F.lit(float(p))).alias("pos"),
            )
            for spec, m, p in wanted
            for side in (0, 1)
        ]
    )
    open_buckets = _holding(hist.withColumn("_t", F.filter(ranks, lambda r: r["m"] == F.col("_m"))))
    group = [*group, "_b"]
    opened = cells.join(open_buckets.select(*group, "_lo", "_least", "_most", "_t"), group)
    while open_buckets.where(F.col("_values") > WIDE).limit(1).count():
        opened = materialise(opened)
        width = F.col("_most") - F.col("_least")
        part = F.least(F.lit(PARTS - 1), F.floor((F.col("_v") - F.col("_least")) / width * PARTS)).cast("long")
        level = f"_b{len(group)}"
        inner = opened.withColumn(level, F.when(width > 0, part).otherwise(0))
        base = inner.groupBy(*group).agg(F.first("_lo").alias("_from"), F.first("_t").alias("_t"))
        fine = _counted(inner.select(*group, F.col(level).alias("_part"), "_v", "_c"), group, "_part").join(base, group)
        open_buckets = _holding(fine.withColumn("_lo", F.col("_lo") + F.col("_from"))).withColumnRenamed("_part", level)
        group = [*group, level]
        opened = inner.drop("_lo", "_least", "_most", "_t").join(open_buckets.select(*group, "_lo", "_least", "_most", "_t"), group)
    within = Window.partitionBy(*group).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    opened = opened.withColumn("_at", F.col("_lo") + F.coalesce(F.sum("_c").over(within), F.lit(0)))
    hits = opened.select(
        *keys, "_v",
        F.explode(
            F.filter("_t", lambda r: (r["rank"] >= F.col("_at")) & (r["rank"] < F.col("_at") + F.col("_c")))
        ).alias("_r"),
    )
    hits = hits.unionByName(exists, allowMissingColumns=True)

    def pick(spec: int, side: int) -> Column:
        return F.max(F.when((F.col("_r.spec") == spec) & (F.col("_r.side") == side), F.col("_v")))

    aggs = []
    for spec in range(len(specs)):
        pos = F.max(F.when(F.col("_r.spec") == spec, F.col("_r.pos")))
        aggs += [pos.alias(f"_p{spec}"), pick(spec, 0).alias(f"_l{spec}"), pick(spec, 1).alias(f"_h{spec}")]
    return _interpolated(hits.groupBy(*keys).agg(*aggs), keys, specs)


def _counted(cells: DataFrame, group: list[str], bucket: str = "_b") -> DataFrame:
    """Histogram of the buckets of a group: count, first rank, number of values and range."""
    hist = cells.groupBy(*group, bucket).agg(
        F.sum("_c").alias("_hc"), F.count(F.lit(1)).alias("_values"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return hist.withColumn("_lo", F.coalesce(F.sum("_hc").over(before), F.lit(0)))


def _holding(hist: DataFrame) -> DataFrame:
    """Buckets that hold a requested rank, with those ranks."""
    inside = F.filter("_t", lambda r: (r["rank"] >= F.col("_lo")) & (r["rank"] < F.col("_lo") + F.col("_hc")))
    return hist.withColumn("_t", inside).where(F.size("_t") > 0)
