"""The request text for a provider: content fields only, the envelope is never asked for."""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F

from ..schemas import RECORD_TYPES, json_schema

TEXT_OPEN, TEXT_CLOSE = "<<<TEXT\n", "\nTEXT>>>"

INSTRUCTIONS = (
    "Read the text below and fill in one record of the given type.\n"
    "Answer with a single JSON object that follows the schema, and with nothing around it.\n"
    "Use only what the text states: leave out a field, or set it to null, when the text is silent.\n"
    "Write dates as ISO 8601; work out relative dates from the reference time.\n"
    'If the text holds no such record, answer {"__skip__": true}.\n'
)


def extraction_prompt(record_type: Column, text: Column, reference_time: Column, source_hint: Column) -> Column:
    schema = F.lit("{}")
    for name in RECORD_TYPES:
        schema = F.when(record_type == name, json.dumps(json_schema(name))).otherwise(schema)
    hint = F.when(F.coalesce(source_hint, F.lit("")) == "", "unknown").otherwise(source_hint)
    when = F.date_format(reference_time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return F.concat(
        F.lit(INSTRUCTIONS + "\nRecord type: "), record_type,
        F.lit("\nReference time: "), when,
        F.lit("\nSource: "), hint,
        F.lit("\nSchema: "), schema,
        F.lit("\n" + TEXT_OPEN), text, F.lit(TEXT_CLOSE),
    )
