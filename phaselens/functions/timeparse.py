"""Mixed-format timestamp parsing (pandas ``format='mixed', dayfirst=True``).

A text's *shape* is what is left of it when digits and letters are replaced by
one sign each and their runs by one more; it is looked up in a literal table
of known shapes, which says in what order the fields stand. So a text is cut
into its numbers and names once and read by one form, however many shapes are
known, and text of no known shape is never parsed."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_letters, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date shapes (y four digits, n one or two digits, m a name of
# three letters or more) and the order of their fields. ISO stays year-first
# under dayfirst; where a second order is listed it is used if the first gives
# no date (13/06 vs 06/13).
DATE_SHAPES = {"y-n-n": ("ymd", "ydm"), "n-n-y": ("dmy", "mdy"), "n/n/y": ("dmy", "mdy"), "n.n.y": ("dmy",),
               "y/n/n": ("ymd",), "n m y": ("dmy",), "m n y": ("mdy",)}
# Time shapes (f a fraction of a second, aa two letters) and
# their fields: hour, minute, second, fraction, half of the day.
TIME_SHAPES = {"": "", " n:n": "hm", " n:n:n": "hms", " n:n:n.f": "hmsf", " n:n aa": "hma", " n:n:n aa": "hmsa"}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_LETTERS = ascii_letters.replace("T", "")  # a T may stand between date and time


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body``
    names it (an expression used twice would be written out twice)."""
    return F.get(F.transform(F.array(value), body), 0)


def shape(text: Column) -> Column:
    """The shape of a trimmed text: ``13/06/2025 9:05`` -> ``n/n/y n:n``."""
    s = F.translate(text, _LETTERS + digits, "a" * len(_LETTERS) + "9" * len(digits))
    s = F.regexp_replace(F.regexp_replace(s, "[aT]{3,}", "m"), r"(:99)\.9+$", "$1.f")
    for run, sign in (("9999", "y"), ("99", "n"), ("9", "n")):
        s = F.replace(s, F.lit(run), F.lit(sign))
    # one spelling: a blank for the T of ISO, and before AM and PM
    s = F.regexp_replace(F.regexp_replace(s, r"^(y-n-n)T", "$1 "), r"n\s*aa$", "n aa")
    return let(s, lambda k: F.when(F.contains(k, F.lit("m")), F.replace(k, F.lit(","), F.lit(""))).otherwise(k))


def _forms(date_shapes: dict, time_shapes: dict) -> Column:
    entries = []
    for date, orders in date_shapes.items():
        for time, fields in time_shapes.items():
            entries += [F.lit(date + time), F.struct(F.lit(orders[0]).alias("first"), F.lit(orders[-1]).alias("second"),
                                                     F.lit(fields).alias("time"))]
    return F.create_map(*entries)


def _read(x: Column) -> Column:
    """Timestamp of ``x``: its form and its parts (numbers and names in order
    of the text); null where they are no date and time."""
    part, time = x["part"], x["form"]["time"]

    def time_field(letter: str) -> Column:
        at = F.instr(time, letter)
        return F.when(at > 0, F.get(part, at + 2))

    def two(letter: str) -> Column:  # minutes and seconds have two digits
        p = time_field(letter)
        return F.when(F.length(p) == 2, p.try_cast("int"))

    hour, half = time_field("h").try_cast("int"), F.lower(time_field("a"))
    hour = (F.when(~F.contains(time, F.lit("a")), hour)
            .when(hour.between(1, 12) & half.isin("am", "pm"), hour % 12 + F.when(half == "pm", 12).otherwise(0)))
    second = two("s")
    second = F.when(second < 60, second + F.coalesce(
        F.rpad(F.substring(time_field("f"), 1, 6), 6, "0").try_cast("decimal(6,0)") / F.lit(1_000_000), F.lit(0)))
    clock = [F.when(time == "", F.lit(0)).otherwise(hour), F.when(time == "", F.lit(0)).otherwise(two("m")),
             F.when(~F.contains(time, F.lit("s")), F.lit(0)).otherwise(second).cast("decimal(16,6)")]
    names = F.create_map(*[F.lit(v) for i, n in enumerate(MONTHS, 1) for v in (n, i)])

    def date(order: Column) -> Column:
        year, month, day = (F.get(part, F.instr(order, c) - 1) for c in "ymd")
        month = F.coalesce(month.try_cast("int"), F.try_element_at(names, F.lower(F.substring(month, 1, 3))))
        year = year.try_cast("int")
        return F.try_make_timestamp_ntz(F.when(year > 0, year), month, day.try_cast("int"), *clock)

    return F.coalesce(date(x["form"]["first"]), date(x["form"]["second"]))


def parse_mixed_ts(col, date_shapes: dict = DATE_SHAPES, time_shapes: dict = TIME_SHAPES,
                   on_error: str = "null") -> Column:
    """TIMESTAMP_NTZ from text in several shapes.

    ``on_error='null'`` leaves unparseable text NULL (count it with
    ``count_if(parsed IS NULL AND text IS NOT NULL)``); ``'raise'`` fails
    the task like pandas does."""
    forms = _forms(date_shapes, time_shapes)

    def read(t: Column) -> Column:
        pieces = F.regexp_extract_all(t, F.lit("([0-9]+|[A-Za-z]{2,})"), F.lit(1))
        parsed = let(F.struct(F.try_element_at(forms, shape(t)).alias("form"), pieces.alias("part")), _read)
        if on_error != "raise":
            return parsed
        return let(parsed, lambda p: F.when(t.isNotNull() & p.isNull(), F.raise_error(
            F.concat(F.lit("unparseable timestamp: "), t))).otherwise(p).cast("timestamp_ntz"))

    return let(F.trim(F.col(col) if isinstance(col, str) else col), read)
