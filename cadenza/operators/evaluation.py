"""Offline evaluation of judgments against labelled intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.core.fold import chunked_fold
from cadenza.core.layout import CHUNK, chunk_index, with_ordinal
from cadenza.core.rangejoin import time_slot
from cadenza.core.session import materialise
from cadenza.core.sweep import flag_covered

SLOT_MS = 1000


def normalize_ranges(ranges: Column) -> Column:
    """Starts at least 0, ends at least the start, sorted."""
    fixed = F.transform(
        ranges,
        lambda r: F.struct(
            F.greatest(F.lit(0), r["start_ms"]).alias("start_ms"),
            F.greatest(F.greatest(F.lit(0), r["start_ms"]), r["end_ms"]).alias("end_ms"),
        ),
    )
    return F.array_sort(fixed)


def in_ranges(ms: Column, ranges: Column) -> Column:
    """Half-open membership in an array of ranges."""
    return F.coalesce(F.exists(ranges, lambda r: (r["start_ms"] <= ms) & (ms < r["end_ms"])), F.lit(False))


def flag_ranges(points: DataFrame, intervals: DataFrame, keys: Sequence[str], out: str, at: str = "time_ms") -> DataFrame:
    """Half-open membership of each point in an interval table."""
    return flag_covered(points, intervals, keys, out, at)


def ratio(a: Column, b: Column) -> Column:
    return F.bround(F.round(F.try_divide(a, b), 10), 4)


def confusion(df: DataFrame, keys: Sequence[str], actual: Column, predicted: Column, usable: Column) -> DataFrame:
    """Counts and rates per key; rates are NULL on an empty denominator."""
    c = lambda cond: F.count_if(usable & cond)
    counts = df.groupBy(*keys).agg(
        c(actual & predicted).alias("tp"), c(~actual & predicted).alias("fp"),
        c(~actual & ~predicted).alias("tn"), c(actual & ~predicted).alias("fn"),
        F.count_if(usable).alias("evaluated"), F.count_if(~usable).alias("ignored"),
    )
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return counts.select(
        "*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(tn, tn + fp).alias("specificity"),
        ratio(fp, fp + tn).alias("false_positive_rate"), ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
    )


def cohens_kappa(df: DataFrame, keys: Sequence[str], a: Column, b: Column) -> DataFrame:
    """Chance-corrected agreement; with full expected agreement 1 or NULL."""
    one = lambda c: F.avg(c.cast("int"))
    s = df.groupBy(*keys).agg(one(a == b).alias("_o"), one(a).alias("_l"), one(b).alias("_r"))
    expected = F.col("_l") * F.col("_r") + (1.0 - F.col("_l")) * (1.0 - F.col("_r"))
    close = lambda x: F.abs(x - 1.0) <= 1e-9
    kappa = F.when(close(expected), F.when(close(F.col("_o")), F.lit(1.0))).otherwise(
        F.bround(F.round((F.col("_o") - expected) / (1.0 - expected), 10), 4)
    )
    return s.select(*keys, kappa.alias("kappa"))


MATCH = "struct<iou:double,es:bigint,ee:bigint,ps:bigint,pe:bigint>"


def overlap_pairs(expected: DataFrame, predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs of ranges (key, no, start_ms, end_ms) that share time: one row
    (keys, e, es, ee, p, ps, pe) per pair.

    A range lives on the level whose slots are at least as long as itself, where
    it touches two slots at most, and visits the longer levels that occur (63 at
    most).  Rows grow with ranges and pairs, never with the length of a range.
    Empty ranges pair with nothing."""
    keys = list(keys)

    def levelled(df: DataFrame, n: str, side: str) -> DataFrame:
        d = df.where("end_ms > start_ms").select(*keys, F.col(n).alias(side), F.col("start_ms").alias(f"{side}s"), F.col("end_ms").alias(f"{side}e"))
        return materialise(d.withColumn("own", F.length(F.bin(F.col(f"{side}e") - F.col(f"{side}s") - 1)).cast("int")))

    exp, pred = levelled(expected, "no", "e"), levelled(predicted, "no", "p")
    levels = sorted(r["own"] for r in exp.select("own").union(pred.select("own")).distinct().collect())
    known = F.array(*[F.lit(k) for k in levels]).cast("array<int>")

    def slots(df: DataFrame, side: str, level: Column) -> DataFrame:
        d = df.select(*[c for c in df.columns if c != "own"], level.alias("level"))
        return d.withColumn("slot", F.explode(F.expr(f"sequence(shiftright({side}s, level), shiftright({side}e - 1, level))")))

    home = lambda df, side: slots(df, side, F.col("own"))
    visit = lambda df, side, reach: slots(df, side, F.explode(F.filter(known, reach)))
    once = F.expr("slot = shiftright(greatest(es, ps), level)") & (F.least("ee", "pe") > F.greatest("es", "ps"))
    cols = [*keys, "e", "es", "ee", "p", "ps", "pe"]
    on = [*keys, "level", "slot"]
    up = visit(exp, "e", lambda k: k >= F.col("own")).join(home(pred, "p"), on).where(once).select(*cols)
    down = home(exp, "e").join(visit(pred, "p", lambda k: k > F.col("own")), on).where(once).select(*cols)
    return up.unionByName(down)


def boundary_match(expected: DataFrame, predicted: DataFrame, keys: Sequence[str], size: int = CHUNK) -> DataFrame:
    """Greedy one-to-one matching per case: expected ranges in order take the
    unused predicted range with the largest overlap ratio (the later one on ties).

    The overlapping pairs, in the order of the expected range and falling ratio,
    are one series cut into chunks of ``size`` pairs.  What a chunk hands on is
    the expected range it ends in, whether that is served, and the taken
    predicted ranges that still reach beyond its start, so chunks far apart do
    not wait for each other and a cluster of any size is many tasks.  Returns
    one row per match.  Ranges without length match nothing.
    """
    keys = list(keys)
    long = lambda d: d.select(*keys, *[F.col(c).cast("long").alias(c) for c in ("start_ms", "end_ms")])
    numbered = lambda d: with_ordinal(long(d), keys, ["start_ms", "end_ms"], time_slot(F.col("start_ms"), 60_000), "no", "cnt")
    pairs = overlap_pairs(numbered(expected), numbered(predicted), keys)
    shared = F.least("ee", "pe") - F.greatest("es", "ps")
    pairs = materialise(pairs.withColumn("iou", shared / (F.greatest("ee", "pe") - F.least("es", "ps"))).withColumn("worse", -F.col("iou")).withColumn("sooner", -F.col("p")))
    rows = with_ordinal(pairs, keys, ["e", "worse", "sooner"], chunk_index("e", 256))

    def step(arrays, first, lo, hi, n, params, state):
        e, p, es, ee, ps, pe, iou = (arrays[c] for c in ("e", "p", "es", "ee", "ps", "pe", "iou"))
        now, served = (int(state[0]), state[1] == 1) if state else (-1, False)
        taken = dict(zip(map(int, state[2::2]), map(int, state[3::2])))
        events = []
        for i in range(lo - first, hi - first):
            if e[i] != now:
                now, served = int(e[i]), False
            if not served and int(p[i]) not in taken:
                served = True
                taken[int(p[i])] = int(pe[i])
                events.append({"iou": float(iou[i]), "es": int(es[i]), "ee": int(ee[i]), "ps": int(ps[i]), "pe": int(pe[i])})
        reach = int(es[hi - first - 1])
        left = sorted((no, end) for no, end in taken.items() if end > reach)
        return events, [now, int(served), *[x for pair in left for x in pair]]

    hits = chunked_fold(rows, keys, ["e", "p", "es", "ee", "ps", "pe", "iou"], step, MATCH, size=size)
    return hits.select(
        *keys, F.col("es").alias("expected_start"), F.col("ee").alias("expected_end"), F.col("ps").alias("predicted_start"),
        F.col("pe").alias("predicted_end"), F.bround(F.round("iou", 10), 4).alias("iou"),
        F.abs(F.col("ps") - F.col("es")).alias("onset_error_ms"), F.abs(F.col("pe") - F.col("ee")).alias("offset_error_ms"),
    )


def boundary_metrics(expected: DataFrame, predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matched, missed and extra segments with mean errors per case."""
    keys = list(keys)
    count = lambda d, n: d.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    m = boundary_match(expected, predicted, keys)
    mean = lambda c, digits: F.bround(F.round(F.avg(c), digits + 6), digits)
    s = m.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("matched"), mean("iou", 4).alias("mean_iou"), mean("onset_error_ms", 1).alias("mean_onset_error_ms"),
        mean("offset_error_ms", 1).alias("mean_offset_error_ms"),
    )
    d = count(expected, "expected_segments").join(count(predicted, "predicted_segments"), keys, "full").join(s, keys, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return d.select(
        *keys, z("expected_segments").alias("expected_segments"), z("predicted_segments").alias("predicted_segments"),
        z("matched").alias("matched_segments"), (z("expected_segments") - z("matched")).alias("missed_segments"),
        (z("predicted_segments") - z("matched")).alias("extra_segments"), "mean_iou", "mean_onset_error_ms", "mean_offset_error_ms",
    )


def aggregate_reports(cases: DataFrame) -> DataFrame:
    """Overall and per action: counts re-summed, means of the case means."""
    mean = lambda c, digits: F.bround(F.round(F.avg(c), digits + 6), digits)
    counts = cases.groupingSets([["action_type"], []], "action_type").agg(
        F.count(F.lit(1)).alias("videos"), *[F.sum(x).alias(x) for x in ("tp", "fp", "tn", "fn")],
        mean("kappa", 4).alias("mean_kappa"), mean("mean_onset_error_ms", 1).alias("mean_onset_error_ms"),
        mean("mean_offset_error_ms", 1).alias("mean_offset_error_ms"), F.grouping("action_type").alias("_all"),
    )
    named = counts.withColumn("action_type", F.when(F.col("_all") == 1, "overall").otherwise(F.col("action_type"))).drop("_all")
    return with_rates(named)
