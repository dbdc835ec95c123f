"""Loose date strings to UTC timestamps with a confidence, and the freshness window.

A text is translated once to its classes (digits to 9, letters to a).  The head of that string names
the one shape the text can have, one pattern takes the fields out, and the timestamp is built natively; only what no
shape covers goes to ``dateutil`` in an Arrow batch.  Fields a string leaves out are taken from the
reference time, so a bare date inherits its time of day.  Sessions must run in UTC.

``normalize_date`` is a column expression; ``with_dates`` adds the same value to a table step by step,
so that every step is compiled once.
"""

from __future__ import annotations

import sys
import unicodedata
import warnings
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from .patterns import SPACE, WORD_END, WORD_START, let, strip

EXACT, RELATIVE_EXACT, HEURISTIC, UNKNOWN = "exact", "relative_exact", "heuristic", "unknown"
DEFAULT_WINDOW_HOURS = 24

# Units of "<n> <unit>s ago" in seconds.
UNIT_SECONDS = {
    "second": 1, "minute": 60, "min": 60, "hour": 3600, "hr": 3600, "day": 86400, "week": 604800,
}
# English month names.
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)

_MONTH_WORD = "(" + "|".join(["sept"] + [w for m in MONTHS for w in (m, m[:3])]) + r")\.?"
# Years below 1000 have readings of their own and are left to the general parser.
_YEAR = r"([1-9]\d{3})"
_DAY = r"(0?[1-9]|[12]\d|3[01])"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"( ?utc| ?gmt|z| ?[+-](?:[01]\d|2[0-3]):?[0-5]\d)?"
_WEEKDAY = "(?:mon|tue|wed|thu|fri|sat|sun), "
_TIME = rf"(?:,? (?:at )?{_CLOCK}{_ZONE})?"

# Heads of class strings, and the shape of the lower-case text with its fields put in the order
# year, month, day, hour, minute, second, fraction, zone ("~" parts them).
_SHAPES = (
    (("9999-", "9999/"), rf"^{_YEAR}[-/](\d{{1,2}})[-/](\d{{1,2}})(?:[t ]{_CLOCK}{_ZONE})?$", "$1~$2~$3~$4~$5~$6~$7~$8"),
    (("99999999",), rf"^{_YEAR}(\d{{2}})(\d{{2}})$", "$1~$2~$3~~~~~"),
    (("9:", "99:"), rf"^{_CLOCK}{_ZONE}$", "~~~$1~$2~$3~$4~$5"),
    (("aaa, ",), rf"^{_WEEKDAY}{_DAY} {_MONTH_WORD} {_YEAR} (\d{{2}}):(\d{{2}}):(\d{{2}}){_ZONE}$", "$3~$2~$1~$4~$5~$6~~$7"),
    (("a",), rf"^{_MONTH_WORD} {_DAY}(?:,? {_YEAR}{_TIME})?$", "$3~$1~$2~$4~$5~$6~$7~$8"),
    (("9 a", "99 a"), rf"^{_DAY} {_MONTH_WORD}(?:,? {_YEAR}{_TIME})?$", "$3~$2~$1~$4~$5~$6~$7~$8"),
    # The first number is the month where it can be one.
    (("9/", "99/"), rf"^(?:(0?[1-9]|1[0-2])/{_DAY}|(1[3-9]|2\d|3[01])/{_DAY})/{_YEAR}$", "$5~$1$4~$2$3~~~~~"),
)
_CLASSES = ("0123456789abcdefghijklmnopqrstuvwxyz", "9" * 10 + "a" * 26)
_COMPACT = "99999999"
# The shape of an age; blanks and digits of any script count.
_UNITS = "(second|minute|min|hour|hr|day|week)"
_AGE = rf"^([0-9]+)[{SPACE}]*{_UNITS}s?[{SPACE}]+ago$"
_ANY_AGE = rf"(?U)^(\p{{Nd}}+)[{SPACE}]*{_UNITS}s?[{SPACE}]+ago$"
# Decimal digits of every script, with their values.
_DIGITS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Nd")
_DIGIT_VALUES = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)

_PARSED = T.StructType(
    [T.StructField("value", T.TimestampType()), T.StructField("shown", T.StringType())]
)


def _fields(lowered: Column) -> Column:
    """The fields of the one shape that the head of the class string allows, parted by ``~``; without ``~`` none fits."""
    classes = F.translate(F.substring(lowered, 1, 8), *_CLASSES)
    found = F.when(F.contains(lowered, F.lit("~")), F.lit(None).cast("string"))
    plain = F.octet_length(lowered) == F.char_length(lowered)
    age = F.when(plain, F.regexp_replace(lowered, _AGE, "$1~$2")).otherwise(F.regexp_replace(lowered, _ANY_AGE, "$1~$2"))
    found = found.when(lowered.endswith("ago"), age)
    for heads, pattern, fields in _SHAPES:
        head = classes == heads[0] if heads[0] == _COMPACT else classes.startswith(heads[0])
        for other in heads[1:]:
            head |= classes.startswith(other)
        found = found.when(head, F.regexp_replace(lowered, pattern, fields))
    return found


def _number(field: Column) -> Column:
    """A field of digits; null when left out (a failing cast would cost far more than the test)."""
    return F.when(field != "", field.cast("int"))


def _month_number(field: Column, ref: Column) -> Column:
    abbreviations = "".join(m[:3] for m in MONTHS)
    word = F.floor((F.position(F.substring(field, 1, 3), F.lit(abbreviations)) + 2) / 3).cast("int")
    return F.when(field == "", F.month(ref)).when(field < "a", field.cast("int")).otherwise(word)


def _wall(fields: Column, ref: Column) -> Column:
    """struct<moment, zone>: the timestamp that shape fields name, before its zone is applied; null when out of range."""
    seconds = F.concat(fields[5], F.lit("."), F.rpad(F.substring(fields[6], 1, 6), 6, "0"))
    second = F.coalesce(
        F.when(fields[5] != "", seconds.cast("decimal(16,6)")), F.extract(F.lit("SECOND"), ref).cast("decimal(16,6)")
    )
    moment = F.try_make_timestamp(
        F.coalesce(_number(fields[0]), F.year(ref)),
        _month_number(fields[1], ref),
        F.coalesce(_number(fields[2]), F.day(ref)),
        F.coalesce(_number(fields[3]), F.hour(ref)),
        F.coalesce(_number(fields[4]), F.minute(ref)),
        second,
    )
    valid = ~F.coalesce(fields[5] >= "60", F.lit(False)) & (F.coalesce(_number(fields[0]), F.lit(1)) >= 1)
    return F.struct(F.when(valid, moment).alias("moment"), F.translate(fields[7], " :", "").alias("zone"))


def _zoned(wall: Column) -> Column:
    """The moment of a wall time in UTC; null beyond the years 1 to 9999."""
    zone = wall["zone"]
    minutes = F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, 4, 2).cast("int")
    offset = F.when(F.length(zone) == 5, F.when(zone.startswith("-"), -minutes).otherwise(minutes)).otherwise(0)
    micros = F.unix_micros(wall["moment"]) - offset.cast("bigint") * 60_000_000
    first, last = (F.unix_micros(F.lit(x).cast("timestamp")) for x in ("0001-01-01 00:00:00", "9999-12-31 23:59:59.999999"))
    return F.when(micros.between(first, last), F.timestamp_micros(micros))


@F.pandas_udf(_PARSED)
def _general_parse(text: pd.Series, ref: pd.Series) -> pd.DataFrame:
    """``dateutil`` for the residue; rows already solved arrive as nulls."""
    from dateutil import parser

    values = pd.Series(pd.NaT, index=text.index, dtype="datetime64[us, UTC]")
    shown = pd.Series(None, index=text.index, dtype="object")
    asked = text.notna() & ref.notna()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for spot, item, base in zip(text.index[asked], text[asked], ref[asked], strict=True):
            default = base.to_pydatetime().replace(tzinfo=timezone.utc)
            try:
                moment = parser.parse(item, default=default)
                if moment.tzinfo is None:
                    moment = moment.replace(tzinfo=timezone.utc)
                values[spot] = moment.astimezone(timezone.utc)
            except (ValueError, OverflowError):
                shown[spot] = repr(item)
    return pd.DataFrame({"value": values, "shown": shown})


def utc_moment(reference_time: Column | datetime) -> Column:
    """A reference time as a column; a naive one is UTC, whatever zone the driver runs in."""
    if isinstance(reference_time, Column):
        return reference_time
    if reference_time.tzinfo is None:
        reference_time = reference_time.replace(tzinfo=timezone.utc)
    return F.lit(reference_time)


def _read(text: Column, lowered: Column) -> Column:
    """struct<age, fields, word>: what a stripped text looks like; fields is null where no shape fits."""
    return F.struct(
        lowered.endswith("ago").alias("age"),
        F.when(lowered.isin("today", "yesterday"), lowered).alias("word"),
        _fields(lowered).alias("shape"),
    )


def _seen(read: Column) -> Column:
    """struct<age, word, fields>."""
    shaped = F.contains(read["shape"], F.lit("~"))
    return F.struct(
        read["age"].alias("age"), read["word"].alias("word"), F.when(shaped, F.split(read["shape"], "~", -1)).alias("fields")
    )


def _residue(text: Column, lowered: Column, word: Column, solved: Column) -> Column:
    """The text where only the general parser can tell; null where the row is solved.

    A last word "ago" in lower case, or one that begins a sentence of plain characters, is never a date.
    """
    return F.when(~solved & (text != "") & word.isNull() & ~_never(text), text)


def _never(text: Column) -> Column:
    """Texts that no parser reads, and whose quoted form is the text itself."""
    return text.endswith(" ago") & text.rlike(r"^[ -&(-\[\]-~]*$")


def _found(seen: Column, ref: Column, zoned: Column) -> Column:
    """The moment of a word, an age or a shape."""
    units = F.create_map(*[F.lit(x) for item in UNIT_SECONDS.items() for x in item])
    # Amounts that lead before year 1 have no value.
    amount = seen["fields"][0]
    digits = F.when(F.octet_length(amount) == F.char_length(amount), amount).otherwise(F.translate(amount, _DIGITS, _DIGIT_VALUES))
    number = F.when(F.length(F.ltrim(digits, F.lit("0"))) <= 11, digits.cast("bigint"))
    micros = F.unix_micros(ref) - number * F.try_element_at(units, seen["fields"][1]) * 1_000_000
    first = F.unix_micros(F.lit("0001-01-01 00:00:00").cast("timestamp"))
    return (
        F.when(seen["word"] == "today", ref)
        .when(seen["word"] == "yesterday", ref - F.make_dt_interval(F.lit(1)))
        .when(seen["age"], F.when(micros >= first, F.timestamp_micros(micros)))
        .otherwise(zoned)
    )


def _label(text: Column, seen: Column, moment: Column, shown: Column, has_year: Column) -> Column:
    missing = text.isNull() | (text == "")
    word, age = seen["word"], seen["age"] & seen["fields"].isNotNull()
    confidence = (
        F.when(moment.isNull(), UNKNOWN)
        .when(word.isNotNull() | age, RELATIVE_EXACT)
        .when(has_year, EXACT)
        .otherwise(HEURISTIC)
    )
    quoted = F.coalesce(shown, F.concat(F.lit("'"), text, F.lit("'")))
    reason = (
        F.when(missing, "missing_date_string")
        .when(moment.isNull(), F.concat(F.lit("unparseable:"), quoted))
        .when(word.isNotNull(), F.concat(F.lit("relative:"), word))
        .when(age, F.concat(F.lit("relative:"), seen["fields"][0], F.lit("_"), seen["fields"][1], F.lit("_ago")))
        .when(has_year, "absolute_parsed")
        .otherwise("absolute_parsed_year_inferred_from_reference_time")
    )
    return F.struct(moment.alias("value"), confidence.alias("confidence"), reason.alias("reason"))


def _has_year(text: Column, seen: Column) -> Column:
    """Four digits on their own; the shapes that part a year from its neighbours need no search."""
    parted = ~seen["age"] & (seen["fields"][0] != "") & ~text.rlike(r"^\d{8}$")
    return F.coalesce(parted, F.lit(False)) | text.rlike(rf"{WORD_START}\p{{Nd}}{{4}}{WORD_END}")


def _shape_wall(seen: Column, ref: Column) -> Column:
    return F.when(~seen["age"] & seen["fields"].isNotNull(), _wall(seen["fields"], ref))


def normalize_date(raw: Column, reference_time: Column | datetime, general: bool = True) -> Column:
    """``struct<value, confidence, reason>`` of a loose date string.

    ``reference_time`` may be a literal or a per-row column (for instance the time a
    response was received).  ``general=False`` leaves out the Python parser for inputs
    known to hold the common shapes only.
    """
    ref = utc_moment(reference_time).cast("timestamp")
    text = strip(raw.cast("string"))
    lowered = F.lower(text)
    # Arguments of a Python function must not hold lambdas, so the shape is looked up once more for it.
    word = F.when(lowered.isin("today", "yesterday"), lowered)
    rest = _residue(text, lowered, word, F.coalesce(F.contains(_fields(lowered), F.lit("~")), F.lit(False)))
    parsed = _general_parse(rest, ref) if general else F.lit(None).cast(_PARSED)
    row = F.struct(text.alias("text"), ref.alias("ref"), parsed.alias("parsed"), _read(text, lowered).alias("read"))

    def with_seen(row: Column) -> Column:
        return F.struct(row.alias("row"), _seen(row["read"]).alias("seen"))

    def with_wall(x: Column) -> Column:
        return F.struct(x.alias("x"), _shape_wall(x["seen"], x["row"]["ref"]).alias("wall"))

    def with_moment(y: Column) -> Column:
        seen, row = y["x"]["seen"], y["x"]["row"]
        zoned = F.when(seen["fields"].isNotNull(), _zoned(y["wall"])).otherwise(row["parsed"]["value"])
        moment = F.when(row["text"] != "", _found(seen, row["ref"], zoned))
        return F.struct(y["x"].alias("x"), moment.alias("moment"))

    def last(z: Column) -> Column:
        row, seen = z["x"]["row"], z["x"]["seen"]
        return _label(row["text"], seen, z["moment"], row["parsed"]["shown"], _has_year(row["text"], seen))

    return let(let(let(let(row, with_seen), with_wall), with_moment), last)


def with_dates(df: DataFrame, out: str, raw: Column, reference_time: Column | datetime) -> DataFrame:
    """The table with ``normalize_date(raw, reference_time)`` as column ``out``, one compiled projection a step.

    Names that start with ``__date_`` are reserved.
    """
    text, lowered, read, seen, parsed, wall, ref, moment = (
        F.col(f"__date_{n}") for n in ("text", "lowered", "read", "seen", "parsed", "wall", "ref", "moment")
    )
    df = df.withColumns({"__date_text": strip(raw.cast("string")), "__date_ref": utc_moment(reference_time).cast("timestamp")})
    df = df.withColumn("__date_lowered", F.lower(text))
    df = df.withColumn("__date_read", _read(text, lowered))
    df = df.withColumn("__date_seen", _seen(read))
    rest = _residue(text, lowered, seen["word"], seen["fields"].isNotNull())
    df = df.withColumn("__date_rest", rest)
    base = F.when(F.col("__date_rest").isNotNull(), ref)
    df = df.withColumn("__date_parsed", _general_parse(F.col("__date_rest"), base))
    df = df.withColumn("__date_wall", _shape_wall(seen, ref))
    zoned = F.when(seen["fields"].isNotNull(), _zoned(wall)).otherwise(parsed["value"])
    df = df.withColumn("__date_moment", F.when(text != "", _found(seen, ref, zoned)))
    df = df.withColumn(out, _label(text, seen, moment, parsed["shown"], _has_year(text, seen)))
    return df.drop(*[f"__date_{n}" for n in ("text", "lowered", "read", "seen", "parsed", "wall", "ref", "moment", "rest")])


def in_window(value: Column, reference_time: Column | datetime, window_hours: int = DEFAULT_WINDOW_HOURS) -> Column:
    """The bare range predicate: both bounds reach a Parquet scan when used as a filter."""
    ref = utc_moment(reference_time)
    return value.between(ref - F.make_dt_interval(F.lit(0), F.lit(window_hours)), ref)


def is_fresh(value: Column, reference_time: Column | datetime, window_hours: int = DEFAULT_WINDOW_HOURS) -> Column:
    """Freshness as a value: false, never null, for a missing date."""
    return F.coalesce(in_window(value, reference_time, window_hours), F.lit(False))
