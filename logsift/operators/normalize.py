"""Mapping arbitrary source columns onto the unified events schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from logsift.constants import EVENT_COLUMNS, EVENT_TYPES, FIELD_ALIASES
from logsift.functions.casts import event_time, status_number

Aliases = Mapping[str, Sequence[str]]


def find_matches(columns: Sequence[str], target: str, aliases: Aliases = FIELD_ALIASES) -> list[str]:
    """Source columns for ``target`` in alias order, ignoring case (the last of two equal names wins)."""
    by_lower = {c.lower(): c for c in columns}
    return [by_lower[a] for a in aliases.get(target, []) if a in by_lower]


def all_aliases(aliases: Aliases = FIELD_ALIASES) -> set[str]:
    return {t.lower() for t in aliases} | {a.lower() for names in aliases.values() for a in names}


def is_analyzable(columns: Sequence[str], aliases: Aliases = FIELD_ALIASES) -> bool:
    known = all_aliases(aliases)
    return any(c.lower() in known for c in columns)


def is_unstructured(df: DataFrame) -> bool:
    return df.columns == ["line"]


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def as_text(df: DataFrame, name: str) -> Column:
    """A column as text; nested values become JSON."""
    nested = isinstance(df.schema[name].dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType))
    return F.to_json(_column(name)) if nested else _column(name).cast("string")


def missing(target: str, dtype: str | None = None) -> Column:
    return F.lit(None).cast(dtype or EVENT_TYPES[target])


def normalize(df: DataFrame, aliases: Aliases = FIELD_ALIASES) -> tuple[DataFrame, dict[str, str | None]]:
    """One source in the unified schema, and which column each target came from.

    The timestamp uses the first matching column only; every other target takes the
    first non-NULL of all matching columns. Absent targets are typed NULLs.
    """
    selected, mapping = _selected(df, aliases)
    return df.select(*selected), mapping


def _selected(df: DataFrame, aliases: Aliases) -> tuple[list[Column], dict[str, str | None]]:
    selected, mapping = [], {}
    for target, dtype in EVENT_TYPES.items():
        matches = find_matches(df.columns, target, aliases)
        mapping[target] = matches[0] if matches else None
        if not matches:
            value = missing(target)
        elif target == "event_timestamp":
            value = event_time(_column(matches[0]), df.schema[matches[0]].dataType)
        elif target == "status_code":
            value = F.coalesce(*[status_number(_column(m), df.schema[m].dataType, dtype) for m in matches])
        else:
            value = F.coalesce(*[as_text(df, m) for m in matches])
        selected.append(value.alias(target))
    return selected, mapping


def normalize_all(sources: Mapping[str, DataFrame], include_unstructured: bool = False, aliases: Aliases = FIELD_ALIASES) -> DataFrame:
    """All sources in the unified schema, one UNION ALL, tagged with their name in ``source``."""
    parts = [
        normalize(df, aliases)[0].withColumn("source", F.lit(name))
        for name, df in sources.items()
        if include_unstructured or not is_unstructured(df)
    ]
    if not parts:
        raise ValueError("no structured source to normalize")
    return reduce(DataFrame.unionByName, parts)


def normalize_layouts(layouts: Sequence[DataFrame], include_unstructured: bool = False, aliases: Aliases = FIELD_ALIASES) -> DataFrame | None:
    """Tables of many sources each, named in ``source``, in the unified schema; None if none is structured.

    Every table is one branch of the plan, however many sources it holds.
    """
    parts = []
    for df in layouts:
        raw = df.drop("source")
        if include_unstructured or not is_unstructured(raw):
            parts.append(df.select(*_selected(raw, aliases)[0], "source"))
    return reduce(DataFrame.unionByName, parts) if parts else None


def alias_view(df: DataFrame, aliases: Aliases = FIELD_ALIASES) -> DataFrame:
    """A raw table seen through the unified schema at query time.

    Differs from :func:`normalize`: a column with the exact target name wins, else
    the single first alias is used, and status codes are BIGINT. Lazy, so Catalyst
    drops the casts of columns a query does not read.
    """
    selected = []
    for target in EVENT_COLUMNS:
        exact = {c.lower(): c for c in df.columns}.get(target)
        source = exact or next(iter(find_matches(df.columns, target, aliases)), None)
        if source is None:
            value = missing(target, "bigint" if target == "status_code" else None)
        elif target == "event_timestamp":
            value = event_time(_column(source), df.schema[source].dataType)
        elif target == "status_code":
            value = status_number(_column(source), df.schema[source].dataType, "bigint")
        else:
            value = as_text(df, source)
        selected.append(value.alias(target))
    return df.select(*selected)
