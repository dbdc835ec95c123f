"""Validation of provider replies against a record type, on VARIANT values.

Accepts what a lax validator accepts (numbers in strings, yes/no booleans, epoch dates)
and nothing more: each value's own JSON type is looked at before it is cast, because a
plain VARIANT cast would round ``10.5`` or turn any number into a boolean.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schemas import CONTENT_FIELDS, SCHEMA_VERSION, Field, content_struct, struct_of
from .patterns import let
from .text import strip_code_fences

INVALID_JSON, NO_ENTITY = "invalid_json", "no_entity"
SKIP_MARKER = "__skip__"

_INT_TEXT = r"^\s*[+-]?(?:[0-9]+(?:_[0-9]+)*|[0-9]+\.0+)\s*$"
_TRUE_WORDS, _FALSE_WORDS = ("1", "t", "true", "y", "yes", "on"), ("0", "f", "false", "n", "no", "off")
_DATE_TEXT = r"^(\d{4}-\d{2}-\d{2})(?:[Tt _](\d{2}:\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?([Zz]|[+-]\d{2}:?\d{2})?)?$"
_NUMBER_TEXT = r"^[+-]?\d+(?:\.\d+)?$"
# Fixed value: larger epoch numbers are milliseconds.
_SECONDS_LIMIT = 20_000_000_000


def parse_reply(reply: Column) -> Column:
    """VARIANT of the JSON object in a reply, null for anything else."""
    parsed = F.try_parse_json(strip_code_fences(reply))
    return let(parsed, lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v))


def _member(obj: Column, name: str) -> Column:
    return F.try_variant_get(obj, f"$.{name}", "variant")


def is_skip(payload: Column) -> Column:
    """Truthiness of the skip marker as Python sees it: empty, zero, false and null are not."""

    def truthy(m: Column) -> Column:
        marker, kind = m["marker"], m["kind"]
        return (
            F.when(kind == "BOOLEAN", F.try_variant_get(marker, "$", "boolean"))
            .when(kind == "STRING", F.try_variant_get(marker, "$", "string") != "")
            .when(kind.startswith("ARRAY"), F.to_json(marker) != "[]")
            .when(kind.startswith("OBJECT"), F.to_json(marker) != "{}")
            .otherwise(F.try_variant_get(marker, "$", "double") != 0)
        )

    def judge(marker: Column) -> Column:
        kind = F.coalesce(F.schema_of_variant(marker), F.lit("VOID"))
        return F.when(kind == "VOID", False).otherwise(let(F.struct(marker.alias("marker"), kind.alias("kind")), truthy))

    return let(_member(payload, SKIP_MARKER), judge)


def _int(kind: Column, value: Column) -> Column:
    text = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    exact = F.try_variant_get(value, "$", "bigint")
    digits = F.regexp_replace(F.translate(F.trim(text), "_", ""), r"\.0+$", "")
    whole = (number == F.floor(number)) & (F.abs(number) < 9.2e18)
    return (
        F.when(kind == "STRING", F.when(text.rlike(_INT_TEXT), digits.try_cast("bigint")))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("bigint"))
        .when(kind == "BIGINT", exact)
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), F.when(whole, exact))
    )


def _bool(kind: Column, value: Column) -> Column:
    word = F.lower(F.try_variant_get(value, "$", "string"))
    number = F.try_variant_get(value, "$", "double")
    return (
        F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind == "STRING", F.when(word.isin(*_TRUE_WORDS), True).when(word.isin(*_FALSE_WORDS), False))
        .when(_is_number(kind), F.when(number == 1, True).when(number == 0, False))
    )


def _is_number(kind: Column) -> Column:
    return kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE", "FLOAT")


def _iso_text(text: Column) -> Column:
    """ISO text with seconds and at most six fraction digits; null if no valid moment."""

    def compose(p: Column) -> Column:
        day, clock, second, micros, zone = (p[x] for x in ("day", "clock", "second", "micros", "zone"))
        valid = (
            day.try_cast("date").isNotNull()
            & (F.substring(day, 1, 4) >= "0001")
            & (F.substring(clock, 1, 2) < "24")
            & (F.substring(clock, 4, 2) < "60")
            & (second < "60")
            & ((F.length(zone) < 6) | ((F.substring(zone, 2, 2) < "24") & (F.substring(zone, 5, 2) < "60")))
        )
        fraction = F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros))
        zulu = F.when(zone.isin("+00:00", "-00:00"), "Z").otherwise(zone)
        return F.when(valid, F.concat(day, F.lit("T"), clock, F.lit(":"), second, fraction, zulu))

    def parts(fields: Column) -> Column:
        zone = F.upper(fields[4])
        return F.struct(
            fields[0].alias("day"),
            F.when(fields[1] == "", "00:00").otherwise(fields[1]).alias("clock"),
            F.when(fields[2] == "", "00").otherwise(fields[2]).alias("second"),
            F.rpad(F.substring(fields[3], 1, 6), 6, "0").alias("micros"),
            F.when(F.length(zone) == 5, F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2)))
            .otherwise(zone)
            .alias("zone"),
        )

    fields = F.split(F.regexp_replace(text, _DATE_TEXT, "$1~$2~$3~$4~$5"), "~", -1)
    return F.when(text.rlike(_DATE_TEXT), let(let(fields, parts), compose))


def _epoch_text(number: Column) -> Column:
    seconds = F.when(F.abs(number) > _SECONDS_LIMIT, number / 1000).otherwise(number)
    in_range = seconds.between(-62_135_596_800, 253_402_300_799)
    moment = F.timestamp_micros(F.round(seconds * 1_000_000).cast("bigint"))
    text = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(in_range, F.concat(F.regexp_replace(text, r"\.000000$", ""), F.lit("Z")))


def _datetime(kind: Column, value: Column) -> Column:
    text = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")

    def of_text(t: Column) -> Column:
        return F.when(t.rlike(_NUMBER_TEXT), let(t.cast("double"), _epoch_text)).otherwise(_iso_text(t))

    return F.when(kind == "STRING", let(text, of_text)).when(_is_number(kind), let(number, _epoch_text))


def _strings(kind: Column, value: Column) -> Column:
    items = F.try_variant_get(value, "$", "array<variant>")
    plain = F.forall(items, lambda v: F.schema_of_variant(v) == "STRING")
    texts = F.transform(items, lambda v: F.try_variant_get(v, "$", "string"))
    return F.when(kind.startswith("ARRAY") & plain, texts)


def _string(kind: Column, value: Column) -> Column:
    return F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))


_READERS = {"int": _int, "bool": _bool, "datetime": _datetime, "strings": _strings, "string": _string, "enum": _string}


def _check(obj: Column, f: Field, prefix: str) -> Column:
    """``struct<error, value>`` of one field; null is fine for an optional scalar."""
    path = f"{prefix}{f.name}"
    no_error = F.array().cast("array<string>")

    def fail(problem: str) -> Column:
        return F.array(F.lit(f"{path}:{problem}"))

    def outcome(error: Column, value: Column) -> Column:
        return F.struct(error.alias("error"), value.alias("value"))

    def typed(m: Column) -> Column:
        member, kind = m["member"], m["kind"]
        if f.kind == "object":
            empty = F.struct(*[F.lit(None).cast(t.dataType).alias(t.name) for t in struct_of(f.fields)])
            error = F.when(kind == "MISSING", no_error).otherwise(fail("type"))
            return F.when(kind.startswith("OBJECT"), _check_all(member, f.fields, f"{path}.")).otherwise(outcome(error, empty))

        value = _READERS[f.kind](kind, member)
        if f.kind == "enum":
            value = F.when(value.isin(*f.values), value)
        bad = fail("value" if f.kind == "enum" else "type")
        if f.kind == "strings":
            value = F.when(kind == "MISSING", no_error).otherwise(value)
            return let(value, lambda v: outcome(F.when(v.isNull(), bad).otherwise(no_error), v))
        missing = fail("missing") if f.required else no_error
        null = bad if f.required else no_error
        return let(
            value,
            lambda v: outcome(
                F.when(kind == "MISSING", missing).when(kind == "VOID", null).when(v.isNull(), bad).otherwise(no_error), v
            ),
        )

    def kinds(member: Column) -> Column:
        kind = F.coalesce(F.schema_of_variant(member), F.lit("MISSING"))
        return let(F.struct(member.alias("member"), kind.alias("kind")), typed)

    return let(_member(obj, f.name), kinds)


def _check_all(obj: Column, fields: tuple[Field, ...], prefix: str) -> Column:
    """``struct<error, value>`` of an object: all errors, and a struct of the values."""
    checked = F.struct(*[_check(obj, f, prefix).alias(f.name) for f in fields])
    return let(
        checked,
        lambda c: F.struct(
            F.concat(*[c[f.name]["error"] for f in fields]).alias("error"),
            F.struct(*[c[f.name]["value"].alias(f.name) for f in fields]).alias("value"),
        ),
    )


def validate_content(payload: Column, record_type: str) -> Column:
    """``struct<errors array<string>, content struct>``; unknown members are dropped."""
    checked = let(payload, lambda obj: _check_all(obj, CONTENT_FIELDS[record_type], ""))
    return let(checked, lambda c: F.struct(c["error"].alias("errors"), c["value"].alias("content")))


def validate_reply(reply: Column, record_type: Column, types: tuple[str, ...] = tuple(CONTENT_FIELDS)) -> Column:
    """``struct<reject, errors, content>`` of a raw reply, content as JSON text.

    ``reject`` is null for an entity, else ``invalid_json``, ``no_entity`` or ``schema``.
    """
    def judge(payload: Column) -> Column:
        # A branch per type: only the branch of a row's own type is evaluated.
        result = F.lit(None).cast("struct<errors:array<string>,content:string>")
        for name in types:
            checked = let(
                validate_content(payload, name),
                lambda c: F.struct(
                    c["errors"].alias("errors"),
                    F.to_json(c["content"], {"ignoreNullFields": "false"}).alias("content"),
                ),
            )
            result = F.when(record_type == name, checked).otherwise(result)

        def verdict(r: Column) -> Column:
            reject = (
                F.when(payload.isNull(), INVALID_JSON)
                .when(is_skip(payload), NO_ENTITY)
                .when(r["errors"].isNull() | (F.size(r["errors"]) > 0), "schema")
            )
            return let(
                reject,
                lambda j: F.struct(
                    j.alias("reject"),
                    F.when(j == "schema", r["errors"]).alias("errors"),
                    F.when(j.isNull(), r["content"]).alias("content"),
                ),
            )

        return let(result, verdict)

    return let(parse_reply(reply), judge)


def envelope(record_type: str, source_name: Column, source_url: Column, collected_at: Column, content: Column) -> Column:
    """The full entity: metadata comes from the scrape, never from the reply."""
    return F.struct(
        F.lit(SCHEMA_VERSION).alias("schemaVersion"),
        F.lit(record_type).alias("recordType"),
        F.struct(source_name.alias("name"), source_url.alias("url")).alias("source"),
        collected_at.alias("collectedAt"),
        content.alias("content"),
    )


def typed_content(content_json: Column, record_type: str) -> Column:
    return F.from_json(content_json, content_struct(record_type))


def member_as_int(payload: Column, name: str) -> Column:
    """One integral member of an object; null when absent or of another type."""
    return let(_member(payload, name), lambda v: _int(F.schema_of_variant(v), v))
