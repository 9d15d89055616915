"""Free-form timestamps read by a token-class automaton, as one Column expression.

The text is cut into tokens (runs of digits, runs of letters, blanks, single
signs) and each token gets a class of one character, so the classes of a text are a string as
long as its list of tokens. Patterns over that string find the time and its zone; the date is what remains, and a
table of rules by the classes of its numbers and month names says which is which.

=====  =====================================================
class  token
=====  =====================================================
d      1 or 2 digits
n      3, 5 or 7 digits, or more than 8
y      4 digits
s      6 digits
e      8 digits
l      14 digits
M      a month's name, whole or its first three letters (and "sept")
W      a weekday's name, likewise
A      am, pm
Z      z, utc, gmt
T      t
o      st, nd, rd, th
f      of, at, on, and
x      other letters, `?` other signs; blanks and - / . , : + are themselves
=====  =====================================================

Rules of three numbers read a four-digit number as the year, then month before day; a first
number over 12 is the day, over 31 a year. Two-digit years lie within 50
years of ``pivot``. A missing day or month is the first. What the table does not know is null, as are a time without
a date (whose day would be that of the run) and zone names other than those of class Z.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logsight.functions.text import let

MONTHS = ("january february march april may june july august september october november december").split()
DAYS = "monday tuesday wednesday thursday friday saturday sunday".split()

_CLASSES = (
    ("y", r"\d{4}"), ("d", r"\d{1,2}"), ("s", r"\d{6}"), ("e", r"\d{8}"), ("l", r"\d{14}"), ("n", r"\d+"), (" ", r"\s+"),
    ("M", "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in MONTHS) + "|sept"), ("W", "|".join(f"{d[:3]}(?:{d[3:]})?" for d in DAYS) + "|tues|thur|thurs"),
    ("A", "[ap]m"), ("Z", "z|utc|gmt"), ("T", "t"), ("o", "st|nd|rd|th"), ("f", "of|at|on|and"), ("x", "[a-z]+"),
)
#: A time of day: clock, optionally with a fraction and am or pm; or an hour with am or pm; or digits after a T.
_TIME = r"(?:d:d(?::d(?:[.,][dnysel])?)?(?: ?A)?|d ?A|(?<=eT)[sy](?:[.,][dnysel])?)"
_ZONE = r"(?: ?(?:Z|[+-](?:d:d|y|d)))?"
#: Classes of the date's numbers and names -> positions of year, month, day among them (0: none), by rule name.
RULES = {
    "ydd": (1, 2, 3), "dMy": (3, 2, 1), "Mdy": (3, 1, 2), "yMd": (1, 2, 3), "ydM": (1, 3, 2), "dMd": (3, 2, 1), "Mdd": (3, 1, 2),
    "My": (2, 1, 0), "yM": (1, 2, 0), "yd": (1, 2, 0), "dy": (2, 1, 0), "y": (1, 0, 0),
}


def classify(token: Column) -> Column:
    out = F.when(token.rlike(r"^[-/.,:+]\z"), token)
    for name, pattern in _CLASSES:
        out = out.when(token.rlike(rf"^(?:{pattern})\z"), F.lit(name))
    return out.otherwise(F.lit("?"))


def _month(token: Column) -> Column:
    """The number of a month token: a name or digits."""
    names = F.array(*[F.lit(m[:3]) for m in MONTHS])
    return F.when(token.rlike("^[a-z]"), F.array_position(names, F.substring(token, 1, 3)).cast("int")).otherwise(token.try_cast("int"))


def _date(kinds: Column, at: Column, pivot: int) -> Column:
    """Days since the epoch from the classes and tokens of a date's numbers and names."""
    def days(year: Column, month: Column, day: Column) -> Column:
        near = year + pivot // 100 * 100
        near = F.when(near >= pivot + 50, near - 100).when(near < pivot - 50, near + 100).otherwise(near)
        full = F.when(year < 100, near).otherwise(year)
        text = F.concat_ws("-", F.lpad(full.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
        return F.when((month <= 12) & (day <= 31), F.unix_date(text.try_cast("date")).cast("bigint"))

    def token(k: int) -> Column:
        return F.get(at, F.lit(k - 1)) if k else F.lit("1")

    # six digits are three numbers
    number = [F.when(kinds == "s", F.substring(token(1), 2 * k - 1, 2)).otherwise(token(k)).try_cast("int") for k in (1, 2, 3)]
    out = F.lit(None).cast("bigint")
    for rule, (y, m, d) in RULES.items():
        out = F.when(kinds == rule, days(token(y).try_cast("int"), _month(token(m)), token(d).try_cast("int"))).otherwise(out)
    # numbers alone: month first, unless the first cannot be a month
    by_day = F.when(number[0] > 12, days(number[2], number[1], number[0])).otherwise(days(number[2], number[0], number[1]))
    out = F.when(kinds == "ddy", by_day).when(kinds.isin("ddd", "s"), F.when(number[0] > 31, days(number[0], number[1], number[2])).otherwise(by_day)).otherwise(out)
    whole = token(1)

    def part(k: int, n: int) -> Column:
        return F.substring(whole, k, n).try_cast("int")

    out = F.when(kinds.isin("e", "l"), days(part(1, 4), part(5, 2), part(7, 2))).otherwise(out)
    return out


def _clock(kinds: Column, at: Column) -> Column:
    """Seconds of the day from the classes and tokens of a time (empty: midnight)."""
    digits = F.get(at, F.lit(0))
    packed = kinds.rlike("^[sy]")
    numbers = F.filter(at, lambda t: t.rlike(r"^\d+\z"))
    hour = F.when(packed, F.substring(digits, 1, 2)).otherwise(F.get(numbers, F.lit(0))).try_cast("int")
    minute = F.when(packed, F.substring(digits, 3, 2)).when(kinds.contains(":"), F.get(numbers, F.lit(1))).otherwise(F.lit("0")).try_cast("int")
    second = F.when(kinds.startswith("s"), F.substring(digits, 5, 2)).when(kinds.rlike("^d:d:d"), F.get(numbers, F.lit(2))).otherwise(F.lit("0")).try_cast("int")
    half = F.element_at(at, -1)
    on_clock = F.when(kinds.endswith("A"), F.when(hour <= 12, hour % 12 + F.when(half == "pm", 12).otherwise(0))).otherwise(hour)
    return F.when(kinds == "", F.lit(0).cast("bigint")).when(
        (on_clock < 24) & (minute < 60) & (second < 60), (on_clock * 3600 + minute * 60 + second).cast("bigint"))


def _offset(kinds: Column, at: Column) -> Column:
    """Seconds east of UTC from the classes and tokens of a zone (empty, Z: none)."""
    numbers = F.filter(at, lambda t: t.rlike(r"^\d+\z"))
    first = F.get(numbers, F.lit(0))
    hours = F.when(kinds.endswith("y"), F.substring(first, 1, 2)).otherwise(first).try_cast("int")
    minutes = F.when(kinds.endswith("y"), F.substring(first, 3, 2)).when(kinds.contains(":"), F.get(numbers, F.lit(1))).otherwise(F.lit("0")).try_cast("int")
    east = F.when((hours < 24) & (minutes < 60), (hours * 3600 + minutes * 60).cast("bigint"))
    return F.when(kinds.rlike("^ ?Z?\\z"), F.lit(0).cast("bigint")).when(kinds.contains("-"), -east).otherwise(east)


def free_form_seconds(text: Column, pivot: int) -> Column:
    """Free-form timestamp text -> BIGINT seconds (UTC; text without a zone is read as
    UTC), floored; null if it is none. Null and empty texts are null; letter case does not matter."""
    def tokens(t: Column) -> Column:
        return F.regexp_extract_all(F.lower(F.trim(t)), F.lit(r"\d+|[a-z]+|\s+|[^\da-z\s]"), 0)

    def span(of: Column, start: Column, size: Column) -> Column:
        return F.slice(of, start, size)

    def read(b: Column) -> Column:
        kinds, at = b["kinds"], b["tokens"]
        time = F.regexp_extract(kinds, f"({_TIME}){_ZONE}", 1)
        zone = F.regexp_extract(kinds, f"{_TIME}({_ZONE})", 1)
        place = F.when(time == "", F.length(kinds) + 1).otherwise(F.regexp_instr(kinds, F.lit(f"{_TIME}")))
        return let(F.struct(kinds.alias("kinds"), at.alias("at"), time.alias("time"), zone.alias("zone"), place.cast("int").alias("place")), assemble)

    def assemble(b: Column) -> Column:
        kinds, at, place = b["kinds"], b["at"], b["place"]
        n_time, n_zone = F.length(b["time"]), F.length(b["zone"])
        after = place + n_time + n_zone
        before_kinds = F.when(n_time > 0, F.regexp_replace(F.substring(kinds, F.lit(1), place - 1), r"(?:T|(?<=[ydM]):)\z", " ")).otherwise(kinds)
        # the tokens of the date keep their classes; all others must be fillers
        date_kinds = F.concat(F.rpad(before_kinds, place - 1, " "), F.repeat(F.lit(" "), n_time + n_zone), F.substring(kinds, after, F.length(kinds)))
        keep = F.filter(F.sequence(F.lit(1), F.length(kinds)), lambda k: F.substring(date_kinds, k, F.lit(1)).rlike("[dysel M]") & (F.substring(date_kinds, k, F.lit(1)) != " "))
        fillers = F.regexp_replace(date_kinds, "[dyselM /.,fo-]", "")
        seconds = let(
            F.struct(F.concat_ws("", F.transform(keep, lambda k: F.substring(date_kinds, k, F.lit(1)))).alias("kinds"), F.transform(keep, lambda k: F.element_at(at, k)).alias("at")),
            lambda d: _date(d["kinds"], d["at"], pivot) * 86400
            + F.when((d["kinds"] == "l") & (n_time == 0), _clock(F.lit("s"), F.array(F.substring(F.get(d["at"], F.lit(0)), 9, 6))))
            .otherwise(_clock(b["time"], span(at, place, n_time)))
            - _offset(b["zone"], span(at, place + n_time, n_zone)))
        return F.when(fillers.isin("", "W"), seconds)

    wanted = F.length(text).between(4, 64) & text.rlike(r"\d")
    return F.when(wanted, let(
        let(tokens(text), lambda t: F.struct(t.alias("tokens"), F.concat_ws("", F.transform(t, classify)).alias("kinds"))), read))
