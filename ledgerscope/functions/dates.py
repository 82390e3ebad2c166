"""Date and time expressions. Unparseable input gives null, never an error, also under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerscope.functions.text import trimmed
from ledgerscope.schemas import DAYPARTS, WEEKDAYS

DEFAULT_REFERENCE_DATE = "2016-12-31"
DAYS_PER_YEAR = 365.2425
# Last day a nanosecond timestamp can hold; later birth dates count as missing.
_LAST_REPRESENTABLE_DAY = "2262-04-11"


# Text of any other shape leaves no digits and fails the cast.
_SHORT_DATE = r"^(?:(\d{1,2})/(\d{1,2})/(\d\d)|(?s:.*))$"
_SHORT_BIRTH_YEAR = r"^(?<day>\d{1,2}/\d{1,2}/)(?:00)?(?<year>\d\d)$"
_BIRTH_DATE = r"^(?:(\d{1,2})/(\d{1,2})/([1-9]\d{3})|(?s:.*))$"


def parse_transaction_date(c: Column) -> Column:
    """``d/m/yy`` with the pivot 00-68 -> 20xx, 69-99 -> 19xx."""
    iso = F.regexp_replace(trimmed(c), _SHORT_DATE, "$3-$2-$1")
    return F.concat(F.when(iso < "69", "20").otherwise("19"), iso).try_cast("date")


def dob_candidate(c: Column) -> Column:
    """``d/m/yy`` or ``d/m/yyyy`` as a date; years below 100 belong to the 1900s."""
    full_year = F.regexp_replace(trimmed(c), _SHORT_BIRTH_YEAR, "${day}19${year}")
    return F.regexp_replace(full_year, _BIRTH_DATE, "$3-$2-$1").try_cast("date")


def resolve_dob(born: Column, reference_date: Column) -> Column:
    """Dates after the reference date move back a century; years up to 1900 are placeholders."""
    moved = F.when(born > reference_date, F.add_months(born, -1200)).otherwise(born)
    return F.when((born <= F.lit(_LAST_REPRESENTABLE_DAY).cast("date")) & (F.year(moved) > 1900), moved)


def parse_customer_dob(c: Column, reference_date: Column) -> Column:
    return resolve_dob(dob_candidate(c), reference_date)


def time_digits(c: Column) -> Column:
    """HHMMSS number; more than six digits are cut to the first six, negatives are missing."""
    return F.when(c < 0, F.lit(None)).when(c < 1_000_000, c).otherwise(
        F.substring(c.cast("string"), 1, 6).try_cast("bigint")).cast("int")


def clock_parts(digits: Column) -> Column:
    """Struct (hour, minute, second, text, valid) of an HHMMSS number."""
    hour = F.floor(digits / 10000).cast("int")
    minute = F.floor(digits / 100).cast("int") % 100
    second = digits % 100
    valid = F.coalesce((hour <= 23) & (minute <= 59) & (second <= 59), F.lit(False))
    # A function over the three keeps this step out of the code that Spark generates for the steps around it, which
    # would otherwise outgrow what the JVM compiles (8,000 bytes) and be interpreted.
    two = F.transform(F.array(hour, minute, second), lambda x: F.lpad(x.cast("string"), 2, "0"))
    return F.struct(
        F.when(valid, hour).alias("hour"),
        F.when(valid, minute).alias("minute"),
        F.when(valid, second).alias("second"),
        F.when(valid, F.concat_ws(":", two)).alias("text"),
        valid.alias("valid"),
    )


def parse_transaction_time(c: Column) -> Column:
    """Time components of an HHMMSS number without leading zeros."""
    return clock_parts(time_digits(c))


def combine_date_time(date: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Zone-free timestamp; null when the date or the time is missing."""
    clock = F.make_dt_interval(F.lit(0), hour, minute, second.cast("decimal(18,6)"))
    return date.cast("timestamp_ntz") + clock


def age_in_years(on: Column, born: Column) -> Column:
    """Whole years, kept only within 18..100."""
    age = F.floor(F.datediff(on, born) / F.lit(DAYS_PER_YEAR)).cast("double")
    return F.when(age.between(18, 100), age)


def day_name(date: Column) -> Column:
    return F.get(F.array(*[F.lit(d) for d in WEEKDAYS]), F.weekday(date))


def is_weekend(date: Column) -> Column:
    """Saturday or Sunday; false, not null, without a date."""
    return F.coalesce(F.weekday(date) >= 5, F.lit(False))


def year_month(date: Column) -> Column:
    return F.substring(date.cast("string"), 1, 7)


def span_days(first: Column, last: Column) -> Column:
    return (F.datediff(last, first) + 1).cast("bigint")


def daypart(hour: Column) -> Column:
    """Right-closed clock bins."""
    band = F
    for name, last_hour in DAYPARTS.items():
        band = band.when(hour <= last_hour, name)
    return F.when(hour >= 0, band)
