"""Record types: content fields, envelope and output column order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Schema version, record types and pricing models.
SCHEMA_VERSION = "1.0"
RECORD_TYPES = ("STARTUP", "PRODUCT", "RESEARCH_PAPER", "JOB", "NEWS")
PRICING_MODELS = ("FREE", "FREEMIUM", "PAID", "ENTERPRISE")


@dataclass(frozen=True)
class Field:
    """One content field. Kinds: string, int, bool, datetime, enum, strings, object."""

    name: str
    kind: str
    required: bool = False
    values: tuple[str, ...] = ()
    fields: tuple["Field", ...] = field(default=())


# Content fields per record type.
CONTENT_FIELDS: dict[str, tuple[Field, ...]] = {
    "STARTUP": (
        Field("entityName", "string", required=True),
        Field("data", "object", fields=(Field("employeeCount", "int"),)),
    ),
    "PRODUCT": (
        Field("startupName", "string", required=True),
        Field("pricingModel", "enum", values=PRICING_MODELS),
    ),
    "RESEARCH_PAPER": (
        Field("title", "string", required=True),
        Field("authors", "strings"),
        Field("paper_url", "string", required=True),
        Field("github_url", "string"),
        Field("github_stars", "int"),
        Field("published_date", "datetime"),
    ),
    "JOB": (
        Field("company", "string", required=True),
        Field("date", "datetime"),
        Field("is_remote", "bool"),
        Field("role_family", "string"),
    ),
    "NEWS": (
        Field("title", "string", required=True),
        Field("published_date", "datetime"),
        Field("excerpt", "string"),
    ),
}

_SPARK_TYPES = {
    "string": T.StringType(),
    "enum": T.StringType(),
    "int": T.LongType(),
    "bool": T.BooleanType(),
    # ISO text: a naive date stays naive, an aware one keeps its zone.
    "datetime": T.StringType(),
    "strings": T.ArrayType(T.StringType()),
}


def struct_of(fields: tuple[Field, ...]) -> T.StructType:
    return T.StructType(
        [
            T.StructField(f.name, struct_of(f.fields) if f.kind == "object" else _SPARK_TYPES[f.kind])
            for f in fields
        ]
    )


def content_struct(record_type: str) -> T.StructType:
    return struct_of(CONTENT_FIELDS[record_type])


SOURCE_STRUCT = T.StructType(
    [T.StructField("name", T.StringType(), False), T.StructField("url", T.StringType(), False)]
)


def entity_struct(record_type: str) -> T.StructType:
    """The envelope around a content struct."""
    return T.StructType(
        [
            T.StructField("schemaVersion", T.StringType()),
            T.StructField("recordType", T.StringType()),
            T.StructField("source", SOURCE_STRUCT),
            T.StructField("collectedAt", T.TimestampType()),
            T.StructField("content", content_struct(record_type)),
        ]
    )


def json_schema(record_type: str) -> dict:
    """JSON Schema of the content a provider is asked for."""
    return _object_schema(CONTENT_FIELDS[record_type], f"{record_type.title().replace('_', '')}Content")


def _object_schema(fields: tuple[Field, ...], title: str) -> dict:
    required = [f.name for f in fields if f.required]
    schema = {
        "title": title,
        "type": "object",
        "properties": {f.name: _field_schema(f) for f in fields},
    }
    return {**schema, "required": required} if required else schema


def _field_schema(f: Field) -> dict:
    if f.kind == "object":
        return _object_schema(f.fields, f.name)
    if f.kind == "strings":
        return {"type": "array", "items": {"type": "string"}}
    plain = {
        "string": {"type": "string"},
        "enum": {"type": "string", "enum": list(f.values)},
        "int": {"type": "integer"},
        "bool": {"type": "boolean"},
        "datetime": {"type": "string", "format": "date-time"},
    }[f.kind]
    return plain if f.required else {"anyOf": [plain, {"type": "null"}], "default": None}


# The columns of the six output tables, in order.
_ENVELOPE = ("schemaVersion", "recordType", "source.name", "source.url")
OUTPUT_COLUMNS: dict[str, tuple[str, ...]] = {
    "startups": (*_ENVELOPE, "content.entityName", "content.data.employeeCount", "collectedAt"),
    "products": (*_ENVELOPE, "content.startupName", "content.pricingModel", "content.description", "collectedAt"),
    "research_papers": (
        *_ENVELOPE, "content.title", "content.authors", "content.paper_url", "content.github_url",
        "content.github_stars", "content.published_date", "collectedAt",
    ),
    "jobs": (
        *_ENVELOPE, "content.company", "content.title", "content.date", "content.is_remote",
        "content.role_family", "collectedAt",
    ),
    "news": (*_ENVELOPE, "content.title", "content.published_date", "content.excerpt", "collectedAt"),
    "entity_mapping_log": ("raw_name", "canonical_name", "method", "confidence"),
}
