"""Exact whole-number arithmetic on columns: an unknown value is NULL, overflow is NULL with a flag, nothing is rounded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.policy import PROBES, probe

_WIDE = "decimal(38,0)"


def wide_sum(value: Column) -> Column:
    """Sum that cannot overflow for up to 10 ** 18 rows."""
    return F.sum(value.cast("decimal(20,0)"))


def fits(total: Column) -> Column:
    """A wide total as BIGINT, NULL where it doesn't fit."""
    return total.try_cast("bigint")


def floor_div(a: Column, b: Column) -> Column:
    """a / b rounded towards minus infinity, for b above 0; NULL where b is 0. Exact for wide numbers."""
    n, d = a.cast(_WIDE), F.nullif(b.cast(_WIDE), F.lit(0).cast(_WIDE))
    return F.call_function("div", n - F.pmod(n, d), d)


def remainder(a: Column, b: Column) -> Column:
    return F.pmod(a.cast("decimal(20,0)"), F.nullif(b.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))).cast("bigint")


def isqrt(value: Column) -> Column:
    """Floor of the square root of a BIGINT; NULL below 0. A double's root is off by one at most, which two looks settle."""
    root = F.floor(F.sqrt(value.cast("double")))
    square = lambda r: r.cast("decimal(19,0)") * r.cast("decimal(19,0)")
    return F.when(value < 0, None).when(square(root) > value, root - 1).when(square(root + 1) <= value, root + 1).otherwise(root)


def ppm(part: Column, whole: Column) -> Column:
    """Parts per million, floored and at most one million; 0 where the whole is 0, NULL where either is unknown."""
    return F.when(part.isNull() | whole.isNull(), None).when(whole == 0, F.lit(0).cast("bigint")).otherwise(F.least(F.lit(1_000_000).cast("bigint"), floor_div(part.cast(_WIDE) * 1_000_000, whole)))


def parse_i64(text: Column) -> Column:
    """A whole text of digits with or without a sign as a BIGINT, else NULL."""
    return F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("bigint"))


def parse_u64(text: Column) -> Column:
    """A whole text of digits as an unsigned number of 64 bits, else NULL."""
    wide = F.when(text.rlike(r"\A[0-9]+\z"), text.try_cast("decimal(38,0)"))
    return F.when(wide < F.lit(str(2**64)).cast("decimal(38,0)"), wide.cast("decimal(20,0)"))


def successor(value: Column, most: int) -> Column:
    """The next of a sequence, revision or position; NULL after the last."""
    return F.when(value < most, value + 1)


def coverage_text(observed: Column, total: Column) -> Column:
    """``observed/total``, and how many are unknown where any are."""
    rest = F.when(observed < total, F.concat(F.lit(" (unknown="), total - observed, F.lit(")"))).otherwise("")
    return F.concat(observed, F.lit("/"), total, rest)


def bucket_of(value: Column, bounds: list[int]) -> Column:
    """Histogram bucket: how many bounds the value reaches; -1 is underflow (a value below 0), NULL stays NULL."""
    # Halving on literals: log2(bounds) comparisons, all in generated code.
    def halve(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < bounds[mid], halve(lo, mid)).otherwise(halve(mid + 1, hi))

    return F.when(value.isNull(), None).when(value < 0, -1).otherwise(halve(0, len(bounds)))


def _coarse(value: Column) -> Column:
    """A coarse place of a BIGINT that never falls as the value rises: 64 steps to each doubling, some 8000 places in all."""
    v = F.when(value < 0, F.bitwise_not(value)).otherwise(value)
    e = F.greatest(F.floor(F.log2(F.greatest(v, F.lit(1)))).cast("int") - 6, F.lit(0))
    place = e * 64 + F.call_function("shiftright", v, e)
    return F.when(value < 0, -1 - place).otherwise(place)


def rank_of(n: Column, num: int, den: int) -> Column:
    """Nearest rank of a fraction, 1 to n."""
    return F.greatest(F.lit(1).cast("bigint"), F.least(n, floor_div(n.cast(_WIDE) * num + (den - 1), F.lit(den))))


def _ranked(df: DataFrame, keys: list[str], value: str, probes, more: dict[str, Column]) -> DataFrame:
    """keys, the group's sums, num, den, value: a row for each fraction, or one without any where no value is known.

    ``df`` is read twice, whatever is asked. First its values are counted and summed in coarse places (combined before the
    shuffle); running counts over a group's places, some 8000 at most, give the group's sums and tell where each rank falls.
    Then the values of those places alone are counted one by one. No group is ever sorted whole.
    """
    v = F.col(value).cast("bigint")
    d = df.select(*keys, F.lit(0).alias("_all"), v.alias("_v"), _coarse(v).alias("_p"), *[c.cast("bigint").alias(f"_c_{k}") for k, c in more.items()])
    group = [*keys, "_all"]
    counters = [F.sum(f"_c_{k}").alias(f"_c_{k}") for k in more]
    places = d.groupBy(*group, "_p").agg(F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), wide_sum(F.col("_v")).alias("_s"), *counters)
    upto, whole = W.partitionBy(*group).orderBy("_p"), W.partitionBy(*group)
    totals = {"n": F.sum("_n"), "min": F.min("_min"), "max": F.max("_max"), "s": F.sum("_s")} | {f"c_{k}": F.sum(f"_c_{k}") for k in more}
    places = places.select(*group, "_p", "_n", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), *[c.over(whole).alias(f"_t_{k}") for k, c in totals.items()])
    ranks = F.array(*[F.struct(F.lit(n).alias("num"), F.lit(m).alias("den"), (rank_of(F.col("_t_n"), n, m) - F.col("_before")).alias("rank")) for n, m in probes])
    hot = places.select(*group, "_p", *[f"_t_{k}" for k in totals], F.filter(ranks, lambda r: (r["rank"] > 0) & (r["rank"] <= F.col("_n"))).alias("_ranks"))
    hot = hot.where((F.size("_ranks") > 0) | (F.col("_t_n") == 0))
    place = [*group, "_p"]
    again = d.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(place)], "_v")  # names of their own: it meets what is made from it
    agree = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(place)])
    met = again.join(hot, agree).select(*hot.columns, "_v")
    values = met.groupBy(*hot.columns, "_v").agg(F.count("*").alias("_n"))
    values = values.withColumn("_to", F.sum("_n").over(W.partitionBy(*group, "_p").orderBy("_v")))
    here = F.filter("_ranks", lambda r: (r["rank"] <= F.col("_to")) & (r["rank"] > F.col("_to") - F.col("_n")))
    told = values.where((F.col("_t_n") == 0) | (F.size(here) > 0))
    return told.select(*keys, *[f"_t_{k}" for k in totals], F.col("_v").alias("value"), F.explode_outer(here).alias("_r")).select("*", "_r.num", "_r.den").drop("_r")


def nearest_rank(df: DataFrame, keys: list[str], value: str, probes=PROBES) -> DataFrame:
    """keys, num, den, value: the exact value at the nearest rank of each fraction, for each group that has values."""
    found = _ranked(df, keys, value, [probe(*p) for p in probes], {})
    return found.where("num IS NOT NULL").select(*keys, "num", "den", "value")


def quantile_columns(probes=PROBES) -> list[str]:
    return [f"p{n * 100 // d}" if n * 100 % d == 0 else f"p{n}_{d}" for n, d in probes]


def distribution(df: DataFrame, keys: list[str], value: str, probes=PROBES, more: dict[str, Column] | None = None) -> DataFrame:
    """keys, n, min_ns, max_ns, sum_ns, sum_overflow, mean_ns, remainder_ns, one column for each fraction, and those of ``more``.

    n counts known values. Groups without any have n 0 and NULL elsewhere. ``more`` are whole numbers to be summed beside the
    values, so that a group's counters need no scan of their own. One scan of ``df`` without fractions, two with any.
    """
    more, v = more or {}, F.col(value).cast("bigint")
    names, picks = quantile_columns(probes), []
    if probes:
        pairs = [probe(*p) for p in probes]
        picks = [F.max(F.when((F.col("num") == n) & (F.col("den") == d), F.col("value"))).alias(c) for (n, d), c in zip(pairs, names, strict=True)]
        df = _ranked(df, keys, value, pairs, more)
        sums = {"n": F.coalesce(F.first("_t_n"), F.lit(0).cast("bigint")), "min_ns": F.first("_t_min"), "max_ns": F.first("_t_max"), "_s": F.first("_t_s")}
        counts = {k: F.first(f"_t_c_{k}") for k in more}
    else:
        sums, counts = {"n": F.count(v), "min_ns": F.min(v), "max_ns": F.max(v), "_s": wide_sum(v)}, {k: F.sum(c.cast("bigint")) for k, c in more.items()}
    sums = df.groupBy(*keys).agg(*[c.alias(k) for k, c in (sums | counts).items()], *picks)
    total = fits(F.col("_s"))
    overflow = F.col("_s").isNotNull() & total.isNull()
    none = F.lit(0).cast("bigint")
    return sums.select(
        *keys, "n", "min_ns", "max_ns", total.alias("sum_ns"), overflow.alias("sum_overflow"),
        F.when(~overflow, floor_div(F.col("_s"), F.col("n"))).alias("mean_ns"),
        F.when(overflow | (F.col("n") == 0), none).otherwise(remainder(F.col("_s").try_cast("decimal(20,0)"), F.col("n"))).alias("remainder_ns"),
        *names, *more,
    )
