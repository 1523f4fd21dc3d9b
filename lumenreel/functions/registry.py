"""What the field registry generates: column lists, response schemas, prompts; and the indexing options."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenreel.schema import FIELDS

#: Defaults of the indexing options (fixed values).
OPTIONS = {"skip_stt": ("boolean", False), "skip_vision": ("boolean", False), "skip_embedding": ("boolean", False), "performance_mode": ("string", "balanced"), "orphaned_retention_days": ("int", 30)}


def columns() -> list[str]:
    return [f.name for f in FIELDS]


def record_type() -> str:
    """The type of a descriptive record, as from_json takes it."""
    return ", ".join(f"{f.name} {'array<string>' if f.is_array else 'string'}" for f in FIELDS)


def response_schema() -> dict:
    """A JSON schema of a descriptive record."""
    kind = {True: {"type": "ARRAY", "items": {"type": "STRING"}}, False: {"type": "STRING"}}
    return {"type": "OBJECT", "properties": {f.name: kind[f.is_array] for f in FIELDS}, "required": columns()}


def prompt(language: str = "en") -> str:
    """Instructions that name each field and its kind."""
    fields = "; ".join(f"{f.name} ({'list' if f.is_array else 'text'})" for f in FIELDS)
    return f"Describe the frames as JSON with these fields: {fields}. Answer in {language}."


def update_sql(table: str, key: str) -> str:
    """An UPDATE with a place for each field."""
    return f"UPDATE {table} SET {', '.join(f'{c} = ?' for c in columns())}, tags = ? WHERE {key} = ?"


def options(config: Column) -> Column:
    """struct of the indexing options in a JSON text; what is missing takes its default."""
    read = F.from_json(F.coalesce(config, F.lit("{}")), ", ".join(f"{k} {t}" for k, (t, _) in OPTIONS.items()))
    return F.struct(*[F.coalesce(read[k], F.lit(d)).alias(k) for k, (_, d) in OPTIONS.items()])
