"""Does a text look like a number or a date?"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# What counts as a number; names of months and week days; the accepted
# layouts of a day as patterns with the places of year, month and day in them.
NUMBER_PATTERN = (
    r"^[ \t\n\r]*[+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"
    r"|[iI][nN][fF]([iI][nN][iI][tT][yY])?)[ \t\n\r]*$"
)
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_MONTH = (
    "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?"
    "|nov(?:ember)?|dec(?:ember)?)[.]?"
)
_WEEKDAY = "(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,? )?"
DAYS = {
    r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})": "$1-$3-$4",
    r"(\d{4})(\d{2})(\d{2})": "$1-$2-$3",
    rf"{_WEEKDAY}{_MONTH} (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})": "$3-$1-$2",
    rf"{_WEEKDAY}(\d{{1,2}})(?:st|nd|rd|th)?[ -]{_MONTH}(?:,? |-)(\d{{4}})": "$3-$2-$1",
    # The month comes first, unless it can only be a day.
    r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4})": "$4-$1-$3",
}
CLOCK = r"[ T](\d{1,2})(?::(\d{2})(?::(\d{2}(?:\.\d{1,9})?))?)? ?([AaPp][Mm])?"
ZONE = r" ?(Z|UTC|GMT|([+-])(\d{2}):?(\d{2})?)"
# Most texts are no dates: one look at the beginning decides that.
_BEGINNING = r"^(?:\d{1,4}[-/. a-z]|\d{8}|[a-z]{3,9}[., ])"

_PLAIN = r"^\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)?$"


def looks_numeric(text: Column) -> Column:
    return text.rlike(NUMBER_PATTERN)


def parse_datetime(text: Column) -> Column:
    """The text as timestamp without zone, or NULL if it is in no accepted layout.

    A day is year, month and day, also in one number of eight digits; month, day and year,
    or day, month and year where the first number is above 12; or has the month's name.
    One or two digits stand for day and month. A clock of 24 or, with AM or PM, 12 hours
    may follow, with a fraction, and then a zone: the time is moved to UTC. No session
    setting takes part.
    """
    text = F.trim(text)
    # A clock has minutes, or AM or PM.
    clocked = f"(?:{CLOCK}(?<=:[0-9.]{{2,12}}|[AaPp][Mm])(?:{ZONE})?)$"

    def read(own: Column) -> Column:
        return _let(F.regexp_extract(own, clocked, 0), lambda tail: _let(
            F.lower(F.substring(own, F.lit(1), F.char_length(own) - F.char_length(tail))),
            lambda day: _let(F.split(_written(day), "-"), lambda parts: _moment(day, parts, tail)),
        ))

    # Spark's own parser reads the plainest layout, at a fraction of the work.
    return F.when(text.rlike(_PLAIN), text.try_cast("timestamp_ntz")).when(F.lower(text).rlike(_BEGINNING), _let(text, read))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a column used twice would be written out
    twice, and so on in what is made of it."""
    return F.transform(F.array(value), body)[0]


def _written(day: Column) -> Column:
    """Year, month or its name, and day with dashes between them, or NULL."""
    written = F.lit(None).cast("string")
    for pattern, parts in reversed(DAYS.items()):
        written = F.when(day.rlike(f"^{pattern}$"), F.regexp_replace(day, f"^{pattern}$", parts)).otherwise(written)
    return written


def _moment(day: Column, parts: Column, tail: Column) -> Column:
    year, second, third = (F.get(parts, F.lit(i)) for i in range(3))
    named = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(second, 1, 3)).cast("string")
    month = F.when(second.rlike("^[a-z]"), named).otherwise(second)
    first_is_day = day.rlike(r"^(?:1[3-9]|[23]\d)[-/.]\d{1,2}[-/.]\d{4}$")
    date = F.when(first_is_day, F.concat(year, F.lit("-"), third, F.lit("-"), second)).otherwise(
        F.concat(year, F.lit("-"), month, F.lit("-"), third)
    )
    at_day = date.try_cast("timestamp_ntz")

    def part(i: int) -> Column:
        return F.regexp_extract(tail, f"^{CLOCK}(?:{ZONE})?$", i)

    def number(i: int) -> Column:
        return F.coalesce(part(i).try_cast("int"), F.lit(0))

    half = F.lower(part(4))
    # No branch fits an hour 13 PM, which is missing then.
    hour = F.when(half == "", number(1)).when(number(1).between(1, 12), number(1) % 12 + F.when(half == "pm", 12).otherwise(0))
    seconds = F.when(part(3) == "", "00").otherwise(part(3))
    clock = F.concat(hour.cast("string"), F.lit(":"), F.lpad(number(2).cast("string"), 2, "0"), F.lit(":"), seconds)
    moment = F.concat(date, F.lit(" "), clock).try_cast("timestamp_ntz")
    ahead = F.when(part(6) == "-", -1).otherwise(1)
    offset = F.make_dt_interval(F.lit(0), ahead * number(7), ahead * number(8))
    return F.when(tail == "", at_day).when(tail.rlike(r":.*[+-]\d{2}:?(\d{2})?$"), moment - offset).otherwise(moment)


def stripped(text: Column) -> Column:
    """Text without surrounding white space of any kind."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")
