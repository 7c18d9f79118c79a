"""Storage routing of hourly inflow through a piecewise cubic storage-outflow curve.

Each step needs the clipped state before it, so a series is folded in order; series are independent of each other. The
fold is a JVM expression: hours within a day, then days, so that no long array is copied at every step.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .network import checkpointed
from .series import resample, with_previous


def curve_pieces(curve: dict) -> list[tuple[float, list[float]]]:
    """(start, coefficients in descending powers of the distance from it) of each piece of
    curve: breakpoints x, coefficients c (four rows), low, high, initial."""
    x, c = [float(v) for v in curve["x"]], [[float(v) for v in row] for row in curve["c"]]
    rising = all(a < b for a, b in zip(x, x[1:]))
    if len(x) < 2 or len(c) != 4 or any(len(row) != len(x) - 1 for row in c) or not rising or (curve["low"], curve["high"]) != (x[0], x[-1]):
        raise ValueError("the curve needs increasing breakpoints, four coefficient rows and bounds at its ends")
    if not all(math.isfinite(v) for row in [x, *c] for v in row):
        raise ValueError("the curve needs finite figures")
    return [(start, [row[k] for row in c]) for k, start in enumerate(x[:-1])]


def outflow(storage: Column, curve: dict) -> Column:
    """The curve's value; the first and the last piece hold beyond their ends."""
    out = None
    for start, powers in curve_pieces(curve):
        d = storage - start
        value = F.lit(powers[0])
        for p in powers[1:]:
            value = value * d + p
        out = value if out is None else F.when(storage >= start, value).otherwise(out)
    return out


def route(hourly: DataFrame, key: str, curve: dict) -> DataFrame:
    """key, ts, value, storage, unclipped_storage of hourly(key, ts, value), a row for each hour with inflow.

    The first outflow is the curve's value at the low bound, not at the initial storage. A series is one row of days while
    it is folded; a key with null inflow gets nulls from the next hour on. A negative or not finite outflow raises.
    """
    low, high, initial = (float(curve[k]) for k in ("low", "high", "initial"))
    sample = F.struct("ts", "value")
    days = hourly.select(key, "ts", F.col("value").cast("double").alias("value")).groupBy(key, F.date_trunc("day", "ts").alias("_d")).agg(F.array_sort(F.collect_list(sample)).alias("_h"))
    series = days.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_d", "_h"))).alias("_s"))
    hour = "struct<ts:timestamp_ntz,value:double,storage:double,unclipped_storage:double>"
    none = F.expr(f"cast(array() as array<{hour}>)")
    start = F.struct(F.lit(initial).alias("s"), F.lit(initial).alias("raw"), outflow(F.lit(low), curve).alias("q"))

    def next_hour(at, x):
        raw = at["s"] + x["value"] - at["q"]
        state = F.when(raw.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), raw)))
        return F.element_at(F.transform(F.array(F.struct(state.alias("s"), raw.alias("raw"))), lambda z: F.struct(z["s"].alias("s"), z["raw"].alias("raw"), outflow(z["s"], curve).alias("q"))), 1)

    def through_day(acc, day):
        first = F.struct(acc["at"].alias("at"), none.alias("out"))
        allowed = lambda q: F.when((q < 0) | F.isnan(q) | (F.abs(q) == float("inf")), F.raise_error(F.lit("routing gives a negative or not finite outflow"))).otherwise(q)
        row = lambda at, x: F.struct(x["ts"].alias("ts"), allowed(at["q"]).alias("value"), at["s"].alias("storage"), at["raw"].alias("unclipped_storage"))
        done = F.aggregate(day["_h"], first, lambda a, x: F.struct(next_hour(a["at"], x).alias("at"), F.concat(a["out"], F.array(row(a["at"], x))).alias("out")))
        return F.element_at(F.transform(F.array(done), lambda z: F.struct(z["at"].alias("at"), F.concat(acc["out"], F.array(z["out"])).alias("out"))), 1)

    folded = F.aggregate("_s", F.struct(start.alias("at"), F.expr(f"cast(array() as array<array<{hour}>>)").alias("out")), through_day, lambda acc: F.flatten(acc["out"]))
    return series.select(key, F.explode(folded).alias("z")).select(key, "z.*")


def inflow_problems(samples: DataFrame, key: str) -> DataFrame:
    """Counts, by key, of what bars samples(key, ts, value) from being routed, all zero when it may be: unaligned (first or
    last stamp off the hour), irregular (steps that differ, or are no whole minutes dividing the hour), bad_values
    (missing, not finite or negative) and short (fewer than two samples)."""
    step = F.timestamp_diff("MICROSECOND", F.col("_prev.ts"), F.col("ts"))
    off = lambda c: (F.date_trunc("hour", c).cast("timestamp_ntz") != c).cast("int")
    v = F.col("value")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v < 0)
    rows = with_previous(samples, [key]).withColumn("_d", step)
    out = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad_values"), F.min("ts").alias("a"), F.max("ts").alias("z"), F.min("_d").alias("lo"), F.max("_d").alias("hi"))
    minute = 60_000_000
    whole = (F.col("lo") > 0) & (F.col("lo") == F.col("hi")) & (F.col("lo") % minute == 0) & (60 * minute % F.when(F.col("lo") > 0, F.col("lo")) == 0)
    return out.select(key, (off(F.col("a")) + off(F.col("z"))).alias("unaligned"), (~F.coalesce(whole, F.lit(False))).cast("int").alias("irregular"), "bad_values", (F.col("n") < 2).cast("int").alias("short"))


FAN = 64
_MAP = "struct<a:double,b:double,lo:double,hi:double>"


def _clip(x: Column, lo, hi) -> Column:
    return F.greatest(lo, F.least(hi, x))


def _then(f, g) -> Column:
    """The map that applies f, then g; a map takes s to a * s + b, held between lo and hi."""
    ends = [g["a"] * f[k] + g["b"] for k in ("lo", "hi")]
    lo, hi = (_clip(pick(*ends), g["lo"], g["hi"]) for pick in (F.least, F.greatest))
    return F.struct((g["a"] * f["a"]).alias("a"), (g["a"] * f["b"] + g["b"]).alias("b"), lo.alias("lo"), hi.alias("hi"))


def route_linear(hourly: DataFrame, key: str, ratio: float, low: float, high: float, initial: float) -> DataFrame:
    """The same for outflow = ratio * storage: final storage and outflow, total outflow and clips of each series.

    A step is a clipped straight line of the storage before it, and such maps compose: blocks of ``FAN`` steps fold to one
    map each, wherever they lie, blocks of blocks likewise, and the storages at the blocks' starts come back down; then each
    block is routed by itself. No row holds more than about FAN steps, so a series of any length spreads over tasks. Blocks are
    stretches of time, so samples should be about evenly spaced. Nulls and figures that are not finite give null results.
    """
    if not all(math.isfinite(x) for x in (ratio, low, high, initial)) or ratio * low < 0 or ratio * high < 0 or low > high:
        raise ValueError("the outflow must be finite and not negative between the bounds")
    rows = hourly.select(F.col(key).alias("_k"), "ts", F.col("value").cast("double").alias("value"))
    ends = checkpointed(rows.groupBy("_k").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"), F.count_if(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))).alias("bad")))
    second = lambda c: F.timestamp_diff("SECOND", F.col("first"), F.col(c))
    block = F.floor(second("ts") * (F.col("n") - 1) / (F.greatest(second("last"), F.lit(1)) * FAN))
    line = F.struct(F.when(F.col("ts") == F.col("first"), 1.0).otherwise(1.0 - ratio).alias("a"), (F.col("value") - F.when(F.col("ts") == F.col("first"), ratio * low).otherwise(0.0)).alias("b"), F.lit(float(low)).alias("lo"), F.lit(float(high)).alias("hi"))
    steps = rows.join(ends.where("bad = 0 and n > 1").withColumnRenamed("_k", "_q"), F.col("_k").eqNullSafe(F.col("_q"))).where("ts < last").select("_k", block.alias("at"), F.struct("ts", line.alias("m")).alias("x"))
    leaves = checkpointed(steps.groupBy("_k", "at").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["m"]).alias("maps")))
    fold = lambda c: F.aggregate(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), F.element_at(c, 1), _then)
    levels = [leaves]
    while levels[-1].groupBy("_k").count().where("count > 1").limit(1).count():
        up = levels[-1].select("_k", F.floor(F.col("at") / FAN).alias("up"), F.struct("at", fold("maps").alias("m")).alias("x"))
        levels.append(checkpointed(up.groupBy("_k", F.col("up").alias("at")).agg(F.array_sort(F.collect_list("x")).alias("below")).withColumn("maps", F.transform("below", lambda x: x["m"]))))
    start = levels[-1].select("_k", "at", F.lit(float(initial)).alias("s"))
    for level in reversed(levels[1:]):
        at = level.join(start.withColumnsRenamed({"_k": "_q", "at": "_at"}), F.col("_k").eqNullSafe(F.col("_q")) & (F.col("at") == F.col("_at")))
        none = F.expr("cast(array() as array<struct<at:bigint,s:double>>)")
        through = F.aggregate("below", F.struct(F.col("s").alias("s"), none.alias("out")), lambda acc, x: F.struct(_clip(x["m"]["a"] * acc["s"] + x["m"]["b"], x["m"]["lo"], x["m"]["hi"]).alias("s"), F.concat(acc["out"], F.array(F.struct(x["at"].alias("at"), acc["s"].alias("s")))).alias("out")))
        start = checkpointed(at.select("_k", F.explode(through["out"]).alias("z")).select("_k", "z.at", "z.s"))

    def step(acc, m):
        raw = m["a"] * acc["s"] + m["b"]
        s = _clip(raw, m["lo"], m["hi"])
        return F.struct(s.alias("s"), (acc["out"] + ratio * s).alias("out"), (acc["clips"] + (s != raw).cast("long")).alias("clips"))

    at = leaves.join(start.withColumnsRenamed({"_k": "_q", "at": "_at"}), F.col("_k").eqNullSafe(F.col("_q")) & (F.col("at") == F.col("_at")))
    done = at.select("_k", "at", F.aggregate("maps", F.struct(F.col("s").alias("s"), F.lit(0.0).alias("out"), F.lit(0).cast("long").alias("clips")), step).alias("r"))
    per = done.groupBy("_k").agg(F.max_by("r.s", "at").alias("s"), F.sum("r.out").alias("out"), F.sum("r.clips").alias("clips")).withColumnRenamed("_k", "_q")
    out = ends.join(per, F.col("_k").eqNullSafe(F.col("_q")), "left")
    one, good = F.col("n") == 1, F.col("bad") == 0
    pick = lambda short, long: F.when(one, short).when(good, long)
    return out.select(
        F.col("_k").alias(key), pick(F.lit(float(initial)), F.col("s")).alias("final_storage"), pick(F.lit(ratio * low), ratio * F.col("s")).alias("final_outflow"),
        pick(F.lit(ratio * low), ratio * low + F.col("out")).alias("total_outflow"), pick(F.lit(0).cast("long"), F.col("clips")).alias("clips"),
    )


def route_samples(samples: DataFrame, key: str, curve: dict, check: bool = True) -> DataFrame:
    """Sub-hourly samples(key, ts, value) averaged by hour (left closed), then routed. With ``check``, series that
    inflow_problems names are refused."""
    if check:
        bad = inflow_problems(samples, key).where("unaligned + irregular + bad_values + short > 0").limit(5).collect()
        if bad:
            raise ValueError(f"series that cannot be routed: {bad}")
    return route(resample(samples, [key]).select(key, "ts", "value"), key, curve)


def diagnostics(routed: DataFrame, key: str) -> DataFrame:
    """Clipping counts and the largest adjustment by series."""
    d = F.col("storage") - F.col("unclipped_storage")
    return routed.groupBy(key).agg(F.count_if(d != 0).alias("clips"), F.count_if(d > 0).alias("lower_clips"), F.count_if(d < 0).alias("upper_clips"), F.sum(d).alias("adjustment_sum"), F.max(F.abs(d)).alias("max_adjustment"))
