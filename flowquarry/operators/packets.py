"""Packet rows to flow rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowquarry.functions.numeric import ratio
from flowquarry.plans.joins import join_dimension
from flowquarry.plans.storage import materialize

SLICE_ROWS, CUTS = 1_000_000, 255
FLAGS = ["FIN", "SYN", "RST", "PSH", "ACK", "URG", "CWE", "ECE"]


def _stats(prefix: str, v: Column, names=("Max", "Min", "Mean", "Std")) -> list[Column]:
    agg = {"Max": F.max(v), "Min": F.min(v), "Mean": F.avg(v), "Std": F.stddev_samp(v)}
    return [F.coalesce(agg[n], F.lit(0.0)).alias(f"{prefix} {n}") for n in names]


def _volume_aggs() -> list[Column]:
    fwd, bwd = F.col("direction") == "fwd", F.col("direction") == "bwd"
    length, header = F.col("length"), F.col("header_len")
    f_len, b_len = F.when(fwd, length), F.when(bwd, length)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("packets"),
        F.count_if(fwd).alias("Total Fwd Packets"), F.count_if(bwd).alias("Total Backward Packets"),
        zero(F.sum(f_len)).alias("Total Length of Fwd Packets"),
        zero(F.sum(b_len)).alias("Total Length of Bwd Packets"),
        *_stats("Fwd Packet Length", f_len), *_stats("Bwd Packet Length", b_len),
        zero(F.min(length)).alias("Min Packet Length"), zero(F.max(length)).alias("Max Packet Length"),
        *_stats("Packet Length", length, ("Mean", "Std")),
        zero(F.var_samp(length)).alias("Packet Length Variance"),
        zero(F.sum(F.when(fwd, header))).alias("Fwd Header Length"),
        zero(F.sum(F.when(bwd, header))).alias("Bwd Header Length"),
        *[F.count_if(F.col("flag") == f).alias(f"{f} Flag Count") for f in FLAGS],
    ]


def _derived(flows: DataFrame) -> DataFrame:
    us = F.unix_micros("end") - F.unix_micros("start")
    sec = us / 1e6
    fwd, bwd = F.col("Total Fwd Packets"), F.col("Total Backward Packets")
    size = F.col("Total Length of Fwd Packets") + F.col("Total Length of Bwd Packets")
    return flows.withColumns({
        "Flow Duration": us, "Flow Bytes/s": ratio(size, sec),
        "Flow Packets/s": ratio(F.col("packets"), sec), "Fwd Packets/s": ratio(fwd, sec),
        "Bwd Packets/s": ratio(bwd, sec), "Down/Up Ratio": ratio(bwd, fwd),
        "Average Packet Size": ratio(size, F.col("packets"))})


def _slices(packets: DataFrame, key: str, slice_rows: int) -> DataFrame:
    """Add ``__slice``: consecutive spans of time of a key, each with about ``slice_rows`` packets.

    Keys with fewer have one slice. The others, at most one for every ``slice_rows`` packets, are cut at quantiles of a
    mergeable sketch; where the cuts lie never changes a result. At most ``CUTS`` cuts a key.
    """
    sizes = packets.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > slice_rows)
    busy = materialize(sizes)
    if busy.isEmpty():
        return packets.withColumn("__slice", F.lit(0))
    at = F.unix_micros("ts")
    wanted = F.least(F.ceil(F.col("__n") / slice_rows), F.lit(CUTS + 1))
    every = F.kll_sketch_get_quantile_bigint("k", F.array(*[F.lit(i / (CUTS + 1)) for i in range(1, CUTS + 1)]))
    some = F.transform(F.sequence(F.lit(1).cast("long"), wanted - 1), lambda i: F.element_at("__every", F.floor(i * (CUTS + 1) / wanted).cast("int")))
    cuts = (join_dimension(packets.select(key, "ts"), busy, [key], "inner", null_safe=True).groupBy(key, "__n")
            .agg(F.kll_sketch_agg_bigint(at).alias("k"))
            .select(key, "__n", every.alias("__every")).select(key, F.array_distinct(some).alias("__cuts")))
    cut = join_dimension(packets, materialize(cuts), [key], null_safe=True, width=CUTS)
    return cut.withColumn("__slice", F.coalesce(F.size(F.filter("__cuts", lambda c: c <= at)), F.lit(0))).drop("__cuts")


def _moments(name: str, v: Column) -> list[Column]:
    """Count, sum, mean, sum of squared deviations and ends: what two parts need to be merged."""
    return [F.count(v).alias(f"{name}_n"), F.sum(v).alias(f"{name}_sum"), F.avg(v).alias(f"{name}_mean"),
            (F.var_pop(v) * F.count(v)).alias(f"{name}_m2"), F.min(v).alias(f"{name}_lo"), F.max(v).alias(f"{name}_hi")]


def fragments(packets: DataFrame, gap: str, key: str = "flow_key", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Flows as far as one slice shows them: one row per (key, slice, fragment) with mergeable sums.

    A fragment ends at a pause of at least ``gap``. Only the first and the last one of a slice can go on in another.
    """
    order = ["ts", *[c for c in ("packet_id",) if c in packets.columns]]
    inside = W.partitionBy(key, "__slice").orderBy(*order)
    so_far, before = inside.rowsBetween(W.unboundedPreceding, W.currentRow), inside.rowsBetween(W.unboundedPreceding, -1)
    fwd, bwd = F.col("direction") == "fwd", F.col("direction") == "bwd"
    ts_of = lambda side: F.when(side, F.col("ts"))
    rows = _slices(packets, key, slice_rows).withColumn("__prev", F.lag("ts").over(inside))
    fresh = F.col("__prev").isNull() | (F.col("ts") >= F.col("__prev") + F.expr(f"interval {gap}"))
    rows = rows.withColumn("__fresh", fresh).withColumns({
        "__fragment": F.sum(F.col("__fresh").cast("int")).over(so_far), "__since": F.last(F.when(F.col("__fresh"), F.col("ts")), True).over(so_far),
        "__fwd": F.last(ts_of(fwd), True).over(before), "__bwd": F.last(ts_of(bwd), True).over(before)})
    length, header = F.col("length"), F.col("header_len")
    iat = F.when(~F.col("__fresh"), _micros("__prev", "ts"))
    same = lambda side, last: F.when(side & (F.col(last) >= F.col("__since")), _micros(last, "ts"))
    return rows.groupBy(key, "__slice", "__fragment").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("packets"),
        F.count_if(fwd).alias("fwd"), F.count_if(bwd).alias("bwd"),
        *[f(ts_of(side)).alias(f"{n}_{name}") for name, side in (("fwd", fwd), ("bwd", bwd)) for n, f in (("first", F.min), ("last", F.max))],
        *[F.sum(F.when(side, header)).alias(f"{name}_header") for name, side in (("fwd", fwd), ("bwd", bwd))],
        *[F.count_if(F.col("flag") == f).alias(f) for f in FLAGS],
        *_moments("len", length), *_moments("fwd_len", F.when(fwd, length)), *_moments("bwd_len", F.when(bwd, length)),
        *_moments("iat", iat), *_moments("fwd_iat", same(fwd, "__fwd")), *_moments("bwd_iat", same(bwd, "__bwd")))


def _micros(a: str, b: str) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)).cast("double")


PARTS = ["len", "fwd_len", "bwd_len", "iat", "fwd_iat", "bwd_iat"]


def merge_fragments(parts: DataFrame, gap: str, key: str = "flow_key") -> DataFrame:
    """Flows of fragments. Inner fragments of a slice are flows as they are; only the outer ones of a key meet in one place."""
    outer = (F.col("__fragment") == 1) | (F.col("__fragment") == F.max("__fragment").over(W.partitionBy(key, "__slice")))
    own = F.when(~outer, F.xxhash64("__slice", "__fragment"))
    rows = parts.withColumn("__outer", outer).withColumn("__own", own)
    along = W.partitionBy(key, "__own").orderBy("__slice", "__fragment")
    goes_on = F.col("start") < F.lag("end").over(along) + F.expr(f"interval {gap}")
    rows = rows.withColumn("__fresh", (~F.coalesce(F.col("__outer") & goes_on, F.lit(False))).cast("int"))
    rows = rows.withColumn("__flow", F.sum("__fresh").over(along.rowsBetween(W.unboundedPreceding, W.currentRow)))
    flow = W.partitionBy(key, "__own", "__flow")
    ordered = flow.orderBy("__slice", "__fragment")
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({"__end": F.lag("end").over(ordered), **{f"__{d}": F.last(f"last_{d}", True).over(before) for d in ("fwd", "bwd")}})
    bridges = {"iat": _micros("__end", "start"), "fwd_iat": _micros("__fwd", "first_fwd"), "bwd_iat": _micros("__bwd", "first_bwd")}
    rows = rows.withColumns({f"__b_{k}": bridges.get(k, F.lit(None).cast("double")) for k in PARTS})
    n = lambda k: F.col(f"{k}_n") + F.col(f"__b_{k}").isNotNull().cast("long")
    total = lambda k: F.coalesce(f"{k}_sum", F.lit(0.0)) + F.coalesce(f"__b_{k}", F.lit(0.0))
    rows = rows.withColumns({f"__m_{k}": F.try_divide(F.sum(total(k)).over(flow), F.sum(n(k)).over(flow)) for k in PARTS})

    def merged(k: str) -> list[Column]:
        away = lambda c: F.pow(F.col(c) - F.col(f"__m_{k}"), 2)
        spread = (F.coalesce(f"{k}_m2", F.lit(0.0)) + F.coalesce(F.col(f"{k}_n") * away(f"{k}_mean"), F.lit(0.0))
                  + F.coalesce(away(f"__b_{k}"), F.lit(0.0)))
        return [F.sum(n(k)).alias(f"{k}_n"), F.sum(total(k)).alias(f"{k}_sum"), F.first(f"__m_{k}").alias(f"{k}_mean"), F.sum(spread).alias(f"{k}_m2"),
                F.min(F.least(f"{k}_lo", f"__b_{k}")).alias(f"{k}_lo"), F.max(F.greatest(f"{k}_hi", f"__b_{k}")).alias(f"{k}_hi")]
    sums = ["packets", "fwd", "bwd", "fwd_header", "bwd_header", *FLAGS]
    return rows.groupBy(key, "__own", "__flow").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), *[F.sum(c).alias(c) for c in sums], *[c for k in PARTS for c in merged(k)])


def flow_features(packets: DataFrame, gap: str, key: str = "flow_key",
                  slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Packets to flows with volumes, flags, rates and inter-arrival times (microseconds).

    Packets are shuffled once, by (key, slice of time); what a slice shows of a flow is merged with its
    neighbours, so that no busy key is sorted in one task.
    """
    rows = merge_fragments(fragments(packets, gap, key, slice_rows), gap, key)
    zero = lambda c: F.coalesce(c, F.lit(0.0))

    def stats(prefix: str, k: str, names=("Max", "Min", "Mean", "Std")) -> list[Column]:
        varied = F.try_divide(F.col(f"{k}_m2"), F.col(f"{k}_n") - 1)
        value = {"Max": F.col(f"{k}_hi"), "Min": F.col(f"{k}_lo"), "Mean": F.col(f"{k}_mean"), "Std": F.sqrt(varied), "Variance": varied}
        return [zero(value[n]).alias(f"{prefix} {n}") for n in names]
    sized = rows.select(
        key, "start", "end", "packets", F.col("fwd").alias("Total Fwd Packets"), F.col("bwd").alias("Total Backward Packets"),
        zero(F.col("fwd_len_sum")).alias("Total Length of Fwd Packets"), zero(F.col("bwd_len_sum")).alias("Total Length of Bwd Packets"),
        *stats("Fwd Packet Length", "fwd_len"), *stats("Bwd Packet Length", "bwd_len"),
        zero(F.col("len_lo")).alias("Min Packet Length"), zero(F.col("len_hi")).alias("Max Packet Length"),
        *stats("Packet Length", "len", ("Mean", "Std", "Variance")),
        zero(F.col("fwd_header")).alias("Fwd Header Length"), zero(F.col("bwd_header")).alias("Bwd Header Length"),
        *[F.col(f).alias(f"{f} Flag Count") for f in FLAGS], *stats("Flow IAT", "iat"),
        *[c for side, k in (("Fwd", "fwd_iat"), ("Bwd", "bwd_iat")) for c in (zero(F.col(f"{k}_sum")).alias(f"{side} IAT Total"), *stats(f"{side} IAT", k))])
    return _derived(sized)


def flow_features_windowed(packets: DataFrame, gap: str, key: str = "flow_key") -> DataFrame:
    """The order-free part of the features with ``session_window``; batch and streaming alike."""
    g = packets.groupBy(key, F.session_window("ts", gap).alias("session")).agg(*_volume_aggs())
    return _derived(g).drop("session")
