"""Unit conversion, interval and date text, curve numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Conversion factors, from -> to.
FACTORS = {
    ("in", "mm"): 25.4,
    ("ft", "m"): 0.3048,
    ("sqmi", "sqkm"): 2.58999,
    ("acre", "sqkm"): 0.00404686,
    ("cfs", "cms"): 0.028316847,
    ("acft", "m3"): 1233.48,
}

# Names of regular intervals, in minutes.
INTERVALS = {f"{n} Minute{'s' * (n > 1)}": n for n in (1, 2, 3, 4, 5, 6, 10, 12, 15, 20, 30)} | {f"{n} Hour{'s' * (n > 1)}": 60 * n for n in (1, 2, 3, 4, 6, 8, 12)} | {"1 Day": 1440}

ACRE_FEET_PER_CFS_HOUR = 3600.0 / 43560.0

DATE_FORMATS = ("d MMMM yyyy", "ddMMMyyyy", "yyyy-MM-dd", "MM/dd/yyyy")


def factor(source: str, target: str) -> float:
    """Factor from source to target unit; the reverse of a known pair is known too."""
    a, b = source.lower(), target.lower()
    if a == b:
        return 1.0
    if (a, b) in FACTORS:
        return FACTORS[a, b]
    if (b, a) in FACTORS:
        return 1.0 / FACTORS[b, a]
    raise ValueError(f"no conversion from {source} to {target}")


def convert(value: Column, source: str, target: str) -> Column:
    return value * F.lit(factor(source, target))


def convert_by(value: Column, source: Column, target: Column) -> Column:
    """Conversion where the units are columns; null for a pair that is not known."""
    pairs = FACTORS | {(b, a): 1.0 / f for (a, b), f in FACTORS.items()}
    table = F.create_map(*[F.lit(v) for (a, b), f in pairs.items() for v in (f"{a}>{b}", f)])
    key = F.concat(F.lower(source), F.lit(">"), F.lower(target))
    return F.when(F.lower(source) == F.lower(target), value).otherwise(value * F.element_at(table, key))


def interval_minutes(text: Column) -> Column:
    """Minutes of '15 Minutes', '1HOUR', '1 Day' or '2WEEK'; null when it is no interval."""
    n = F.regexp_extract(text, r"^\s*(\d+)\s*([A-Za-z]+)", 1)
    unit = F.upper(F.regexp_extract(text, r"^\s*(\d+)\s*([A-Za-z]+)", 2))
    size = F.when(unit.startswith("MIN"), 1).when(unit.startswith("HOUR"), 60).when(unit.startswith("DAY"), 1440).when(unit.startswith("WEEK"), 10080)
    return F.when(n != "", n.cast("long")) * size


def interval_text(minutes: Column) -> Column:
    """The shortest name of whole minutes: days, then hours, then minutes."""
    name = lambda n, one: F.concat(n.cast("string"), F.lit(" " + one), F.when(n == 1, "").otherwise("s"))
    m = minutes.cast("long")
    return F.when(m % 1440 == 0, name((m / 1440).cast("long"), "Day")).when(m % 60 == 0, name((m / 60).cast("long"), "Hour")).otherwise(name(m, "Minute"))


def parse_datetime(date: Column, time: Column | None = None) -> Column:
    """Naive timestamp of a date in one of DATE_FORMATS and hh:mm; 24:00 is the next day's 00:00; null if none fits."""
    clock = F.trim(F.coalesce(time, F.lit("00:00"))) if time is not None else F.lit("00:00")
    late = clock == "24:00"
    shown = F.when(late, F.lit("00:00")).otherwise(clock)
    stamp = F.coalesce(*[F.try_to_timestamp(F.concat(F.trim(date), F.lit(" "), shown), F.lit(f + " HH:mm")) for f in DATE_FORMATS]).cast("timestamp_ntz")
    return F.when(late, stamp + F.expr("interval 1 day")).otherwise(stamp)


def format_date(stamp: Column) -> Column:
    return F.date_format(stamp, "d MMMM yyyy")


def initial_abstraction(curve_number: Column, ratio: float = 0.2) -> Column:
    """Ia = ratio * (1000 / CN - 10); null for CN of 0 or less."""
    return F.when(curve_number > 0, ratio * (1000.0 / curve_number - 10.0))


def curve_number(abstraction: Column, ratio: float = 0.2) -> Column:
    """Inverse of initial_abstraction, held in 0 to 100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 1000.0 / (abstraction / ratio + 10.0)))
