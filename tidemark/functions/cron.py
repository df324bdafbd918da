"""Five-field cron expressions: in words, and as sets of numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import let

# Days in words, names of months and days that cron takes.
DAYS = ["Sundays", "Mondays", "Tuesdays", "Wednesdays", "Thursdays", "Fridays", "Saturdays"]
MONTH_NAMES = "jan feb mar apr may jun jul aug sep oct nov dec".split()
DAY_NAMES = "sun mon tue wed thu fri sat".split()
#: Field -> least and most value.
RANGES = {"minute": (0, 59), "hour": (0, 23), "dom": (1, 31), "month": (1, 12), "dow": (0, 7)}


def _words(items: Column) -> Column:
    """a, b and c."""
    n = F.size(items)
    return F.when(n <= 1, F.coalesce(F.try_element_at(items, F.lit(1)), F.lit(""))).otherwise(F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.element_at(items, -1)))


#: Parts of the shapes below: times of the day, dates, days of the week.
_TIMES, _DATES, _DAYS = r"(?<times>\d+(?:,\d+)*)", r"(?<dates>\d+(?:,\d+)*)", r"(?<days>\*|1-5|0*[0-7](?:,0*[0-7])*)"
#: Shape of an expression, and how it is said; what is in braces is said by the group of that name.
SHAPES = [
    (r"\*/(?<step>\d+) \* \* \* \*", "Every {step} minutes"),
    (r"(?<minute>\d+) \* \* \* \*", "Every hour at :{minute}"),
    (r"(?<minute>\d+) \*/(?<step>\d+) \* \* \*", "Every {step} hours at :{minute}"),
    (rf"(?<minute>\d+) {_TIMES} \* \* {_DAYS}", "{days} at {times}"),
    (rf"(?<minute>\d+) {_TIMES} {_DATES} \* \*", "On day {dates} of every month at {times}"),
]
# Days that have a name together.
TOGETHER = {"*": "Every day", "1-5": "Weekdays", "0,6": "Weekends", "6,0": "Weekends", "6,7": "Weekends"}


def describe_cron(cron: Column, timezone: Column) -> Column:
    """Expressions of the common shapes in words, others as they are; with the zone (UTC where there is none)."""
    spaced = F.regexp_replace(F.trim(cron), r"\s+", " ")
    two = lambda c: F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)

    def said(shape: str, sentence: str) -> Column:
        names = re.findall(r"\(\?<(\w+)>", shape)
        group = lambda name: F.regexp_extract(spaced, f"^{shape}(?: .*)?$", names.index(name) + 1)
        together = F.create_map(*(F.lit(x) for kv in TOGETHER.items() for x in kv))
        day = lambda d: F.element_at(F.array(*map(F.lit, DAYS)), d.try_cast("int") % 7 + 1)
        words = {
            "step": lambda: group("step"),
            "minute": lambda: two(group("minute")),
            "times": lambda: _words(F.transform(F.split(group("times"), ","), lambda h: F.concat(two(h), F.lit(":"), two(group("minute"))))),
            "dates": lambda: _words(F.split(group("dates"), ",")),
            "days": lambda: F.coalesce(F.try_element_at(together, group("days")), _words(F.transform(F.split(group("days"), ","), day))),
        }
        parts = [words[p[1:-1]]() if p[:1] == "{" else F.lit(p) for p in re.split(r"(\{\w+\})", sentence) if p]
        return F.when(spaced.rlike(f"^{shape}(?: .*)?$"), F.concat(*parts))

    told = F.coalesce(*(said(shape, sentence) for shape, sentence in SHAPES))
    return F.concat(F.coalesce(told, F.concat(F.lit("Custom schedule ("), cron, F.lit(")"))), F.lit(" "), F.coalesce(timezone, F.lit("UTC")))


def _number(text: Column, field: str) -> Column:
    names = {"month": {n: i for i, n in enumerate(MONTH_NAMES, 1)}, "dow": {n: i for i, n in enumerate(DAY_NAMES)}}.get(field, {})
    own = text.try_cast("int")
    return F.coalesce(own, *(F.when(F.lower(text) == n, i) for n, i in names.items())) if names else own


def field_numbers(text: Column, field: str) -> Column:
    """Sorted numbers that a field allows; null if it isn't valid."""
    least, most = RANGES[field]

    def one(item: Column) -> Column:
        span = F.substring_index(item, "/", 1)
        ends = F.split(span, "-")
        stepped = item.contains("/")
        numbers = F.struct(
            F.when(stepped, F.substring_index(item, "/", -1).try_cast("int")).otherwise(1).alias("step"),
            F.when(span == "*", least).otherwise(let(F.try_element_at(ends, F.lit(1)), lambda t: _number(t, field))).alias("low"),
            F.when((span == "*") | ((F.size(ends) == 1) & stepped), most).otherwise(let(F.element_at(ends, -1), lambda t: _number(t, field))).alias("high"),
            ((F.size(ends) <= 2) & item.rlike(r"^(?:\*|\w+(?:-\w+)?)(?:/\d+)?$")).alias("shaped"),
        )

        def spread(x: Column) -> Column:
            valid = x["shaped"] & (x["step"] >= 1) & (x["low"] >= least) & (x["high"] <= most) & (x["low"] <= x["high"])
            return F.when(F.coalesce(valid, F.lit(False)), F.sequence(x["low"], x["high"], x["step"]))

        return let(numbers, spread)

    lists = F.transform(F.split(text, ","), one)

    def joined(lists: Column) -> Column:
        numbers = F.flatten(lists)
        if field == "dow":
            numbers = F.transform(numbers, lambda n: n % 7)
        return F.when(F.forall(lists, lambda x: x.isNotNull()), F.array_sort(F.array_distinct(numbers)))

    return let(lists, joined)
