"""Cron expressions: one for a whole relation parsed on the driver, or one per row and zone as columns."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Macros and names of the five-field syntax.
MACROS = {"@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *"}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
DAYS = ["sun", "mon", "tue", "wed", "thu", "fri", "sat"]
LIMIT_YEARS = 5


@dataclass(frozen=True)
class Cron:
    minutes: frozenset[int]
    hours: frozenset[int]
    days: frozenset[int]
    months: frozenset[int]
    weekdays: frozenset[int]
    any_day: bool
    any_weekday: bool

    def day_fits(self, d: dt.date) -> bool:
        """Both day fields given: either may match; else both must."""
        by_day, by_weekday = d.day in self.days, (d.weekday() + 1) % 7 in self.weekdays
        return by_day and by_weekday if self.any_day or self.any_weekday else by_day or by_weekday

    def next(self, after: dt.datetime, zone: str = "UTC") -> dt.datetime | None:
        """First instant strictly after ``after`` (aware), by wall clock in the zone; None beyond five years."""
        tz = ZoneInfo(zone)
        day = after.astimezone(tz).date()
        for n in range(366 * LIMIT_YEARS):
            d = day + dt.timedelta(days=n)
            if d.month not in self.months or not self.day_fits(d):
                continue
            found = None
            for h in sorted(self.hours):
                for m in sorted(self.minutes):
                    for second in (0, 1):  # an hour repeated by the clock change occurs twice
                        wall = dt.datetime(d.year, d.month, d.day, h, m, tzinfo=tz, fold=second)
                        real = wall.astimezone(dt.UTC)
                        if real.astimezone(tz).replace(tzinfo=None) == wall.replace(tzinfo=None) and real > after:
                            found = real if found is None else min(found, real)
                    if found is not None and found <= dt.datetime(d.year, d.month, d.day, h, m, tzinfo=tz, fold=0).astimezone(dt.UTC):
                        return found  # later minutes of the day are later instants
            if found is not None:
                return found
        return None


def _field(text: str, low: int, high: int, names: list[str], base: int) -> frozenset[int]:
    def number(x: str) -> int:
        n = names.index(x.lower()) + base if x.lower() in names else int(x)
        if not low <= n <= high:
            raise ValueError(f"{x} is not within {low}-{high}")
        return n

    out: set[int] = set()
    for term in text.split(","):
        span, slash, step = term.partition("/")
        if slash and not (step.isdigit() and int(step) > 0):
            raise ValueError(f"bad step in {term}")
        if span in ("*", "?"):
            a, z = low, high
        elif "-" in span:
            a, z = map(number, span.split("-", 1))
            if a > z:
                raise ValueError(f"bad range {span}")
        else:
            a = z = number(span)  # a single value with a step is that value only
        out.update(range(a, z + 1, int(step or 1)))
    return frozenset(out)


def parse(text: str) -> Cron:
    fields = MACROS.get(text.strip().lower(), text).split()
    if len(fields) != 5:
        raise ValueError(f"five fields are needed: {text!r}")
    weekdays = frozenset(d % 7 for d in _field(fields[4], 0, 7, DAYS, 0))
    return Cron(
        _field(fields[0], 0, 59, [], 0), _field(fields[1], 0, 23, [], 0), _field(fields[2], 1, 31, [], 0), _field(fields[3], 1, 12, MONTHS, 1), weekdays,
        fields[2][0] in "*?", fields[4][0] in "*?",
    )


def fits(expr: str, ts: Column) -> Column:
    """Whether a wall-clock minute matches, as a column."""
    c = parse(expr)
    by_day, by_weekday = F.dayofmonth(ts).isin(*c.days), (F.dayofweek(ts) - 1).isin(*c.weekdays)
    day = by_day & by_weekday if c.any_day or c.any_weekday else by_day | by_weekday
    return F.minute(ts).isin(*c.minutes) & F.hour(ts).isin(*c.hours) & F.month(ts).isin(*c.months) & day


def instants(df: DataFrame, expr: str, start: Column, stop: Column) -> DataFrame:
    """Rows of ``df`` once per matching minute in start..stop (UTC wall clock), as fire_at.

    Days are expanded first and filtered, then the matching minutes of the day, so only instants
    that exist are made.
    """
    c = parse(expr)
    day = F.explode(F.sequence(F.date_trunc("day", start).cast("date"), stop.cast("date"), F.expr("interval 1 day")))
    by_day, by_weekday = F.dayofmonth("cron_day").isin(*c.days), (F.dayofweek("cron_day") - 1).isin(*c.weekdays)
    fit = F.month("cron_day").isin(*c.months) & (by_day & by_weekday if c.any_day or c.any_weekday else by_day | by_weekday)
    minutes = F.array(*[F.lit(60 * h + m) for h in sorted(c.hours) for m in sorted(c.minutes)])
    at = F.col("cron_day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("cron_minute"))
    out = df.withColumn("cron_day", day).where(fit).withColumn("cron_minute", F.explode(minutes)).withColumn("fire_at", at)
    return out.where((F.col("fire_at") >= start) & (F.col("fire_at") <= stop)).drop("cron_day", "cron_minute")


# expressions and zones as columns ------------------------------------------------------------------


def _numbers(names: list[str], base: int) -> Column | None:
    return F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i + base))]) if names else None


def _mask(text: Column, low: int, high: int, names: list[str], base: int) -> Column:
    """The values of a field as bits; null if any of its terms is none."""
    table = _numbers(names, base)

    def number(x: Column) -> Column:
        n = F.when(F.regexp_like(x, F.lit(r"^\d{1,9}$")), x.cast("int"))
        n = F.coalesce(F.try_element_at(table, x), n) if table is not None else n
        return F.when(n.between(low, high), n)

    def term(t: Column) -> Column:
        parts = F.split(t, "/", 2)
        span, given = parts[0], F.try_element_at(parts, F.lit(2))
        step = F.when(given.isNull(), 1).when(F.regexp_like(given, F.lit(r"^0*[1-9]\d{0,8}$")), given.cast("int"))
        ends = F.split(span, "-", 2)
        every, ranged = span.isin("*", "?"), F.size(ends) == 2
        first = F.when(every, low).otherwise(number(ends[0]))
        last = F.when(every, high).when(ranged, number(F.try_element_at(ends, F.lit(2)))).otherwise(first)  # a single value with a step is that value only
        return F.when(first <= last, F.when(step.isNotNull(), F.sequence(first, last, step)))

    terms = F.transform(F.split(text, ","), term)
    bits = F.aggregate(F.flatten(terms), F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), x)))
    return F.when(~F.exists(terms, lambda t: t.isNull()), bits)


def masks(expr: Column) -> Column:
    """A five-field expression or macro as a struct of bit masks; ``problem`` says what is wrong with it, if anything.

    The same as ``parse``, row by row: minutes, hours, days, months and weekdays as bits, any_day and
    any_weekday where the field is a star.
    """
    plain = F.trim(F.lower(expr))
    macros = F.create_map(*[F.lit(x) for pair in MACROS.items() for x in pair])
    fields = F.filter(F.split(F.coalesce(F.try_element_at(macros, plain), plain), r"\s+"), lambda x: x != "")
    at = lambda i: F.get(fields, F.lit(i))
    minutes, hours, days = _mask(at(0), 0, 59, [], 0), _mask(at(1), 0, 23, [], 0), _mask(at(2), 1, 31, [], 0)
    months, week = _mask(at(3), 1, 12, MONTHS, 1), _mask(at(4), 0, 7, DAYS, 0)
    week = week.bitwiseOR(F.shiftright(week, 7)).bitwiseAND(127)  # 7 is Sunday too
    problem = F.when(expr.isNull() | (F.size(fields) != 5), "five fields are needed")
    for name, m in (("minute", minutes), ("hour", hours), ("day", days), ("month", months), ("weekday", week)):
        problem = problem.when(m.isNull(), f"bad {name} field")
    star = lambda i: F.substring(at(i), 1, 1).isin("*", "?")
    return F.struct(minutes.alias("minutes"), hours.alias("hours"), days.alias("days"), months.alias("months"), week.alias("weekdays"), star(2).alias("any_day"), star(4).alias("any_weekday"), problem.alias("problem"))


def zone_known(spark: SparkSession, zone: Column) -> Column:
    """Whether a zone's name is one of the JVM's."""
    return F.coalesce(zone.isin(*sorted(str(z) for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds())), F.lit(False))


def _has(mask: Column, n: Column) -> Column:
    return F.getbit(mask, n) == 1


def day_fits(m: Column, day: Column) -> Column:
    """Both day fields given: either may match; else both must."""
    by_day, by_weekday = _has(m["days"], F.dayofmonth(day)), _has(m["weekdays"], F.dayofweek(day) - 1)
    return _has(m["months"], F.month(day)) & F.when(m["any_day"] | m["any_weekday"], by_day & by_weekday).otherwise(by_day | by_weekday)


def _minutes(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), n)


def instants_of(wall: Column, zone: Column) -> Column:
    """The UTC instants at which clocks of the zone show ``wall``: none in a gap, two where an hour is repeated.

    The second one is that of the offset that holds a day later.
    """
    utc, day = F.lit("UTC"), F.make_dt_interval(F.lit(1))
    shown = lambda t: F.convert_timezone(utc, zone, t)
    first = F.convert_timezone(zone, utc, wall)
    second = wall - (shown(first + day) - (first + day))
    return F.filter(F.array(first, F.when(second > first, second)), lambda t: t.isNotNull() & (shown(t) == wall))


#: Days looked through before all days of ``LIMIT_YEARS`` are.
NEAR_DAYS = 40


def next_after(m: Column, zone: Column, after: Column) -> Column:
    """First instant of masks ``m`` strictly after ``after`` by wall clock in the zone, both UTC without zone; null beyond five years.

    Days come first, by bits of their date, then the minutes of up to eight fitting days, so that gaps
    of clock changes cannot hide the answer.
    """
    local = F.convert_timezone(F.lit("UTC"), zone, after)
    hours = F.filter(F.sequence(F.lit(0), F.lit(23)), lambda h: _has(m["hours"], h))
    minutes = F.filter(F.sequence(F.lit(0), F.lit(59)), lambda x: _has(m["minutes"], x))
    of_day = F.flatten(F.transform(hours, lambda h: F.transform(minutes, lambda x: h * 60 + x)))

    def first_of(day: Column) -> Column:
        start = day.cast("timestamp_ntz")
        # walls of up to three hours before may come once more
        walls = F.filter(F.transform(of_day, lambda x: start + _minutes(x)), lambda w: w >= local - _minutes(F.lit(180)))
        found = F.flatten(F.transform(F.slice(walls, 1, 400), lambda w: instants_of(w, zone)))
        return F.array_min(F.filter(found, lambda t: t > after))

    def within(days: int) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.lit(days)), lambda k: F.date_add(local.cast("date"), k))
        fit = F.slice(F.filter(every, lambda d: day_fits(m, d)), 1, 8)
        return F.aggregate(fit, F.lit(None).cast("timestamp_ntz"), lambda acc, d: F.coalesce(acc, first_of(d)))

    return F.coalesce(within(NEAR_DAYS), within(366 * LIMIT_YEARS))
