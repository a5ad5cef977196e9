"""Exported Windows-event records: nested JSON to flat rows.

Input is one row per record: ``event_record_id, timestamp, data`` (and optionally
``identifier``), where ``data`` is the JSON text of the record.

Payloads are opened in Arrow batches by a small Python function. The variant type sorts keys and rewrites numbers, so it can tell neither
which of two keys that flatten to one name comes last in the document, nor ``1.0`` from ``1``; the same on JSON text with higher-order
functions was right and eight times slower.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logsift import constants as C
from logsift.plans.shapes import computed_once, spread_nulls
from logsift.session import materialize

# The flat entries of a payload, and all of them as one JSON object with sorted keys.
_FLAT = "struct<keys:array<string>,texts:array<string>,jsons:array<string>,message:string>"


def _flattener(element: str | None, alone: bool):
    """A function on batches of (JSON text, key of the parent); it names nothing of this package, so workers need not have it."""

    def child(parent, name):
        return f"{parent}_{name}" if parent else str(name)

    def collapsed(items):
        """(name, text) pairs of a list of named items; None for any other list."""
        try:
            return [(item["#attributes"]["Name"], item.get("#text")) for item in items]
        except (KeyError, TypeError, AttributeError):
            return None

    def leaves(value, parent):
        """Keys and values in the order of the document, of any depth; of equal keys the last value."""
        found, waiting = {}, [(parent, value)]
        while waiting:
            key, value = waiting.pop()
            if isinstance(value, dict):
                if "#text" in value:
                    found[key or "#text"] = value["#text"]
                attributes = value.get("#attributes")
                if isinstance(attributes, dict):
                    for name, inner in attributes.items():
                        found[child(key, name.removeprefix("@"))] = inner
                waiting += [(child(key, name), inner) for name, inner in reversed(value.items()) if name not in ("#text", "#attributes")]
            elif isinstance(value, list) and (pairs := collapsed(value)):
                for name, inner in pairs:
                    found[child(key, name)] = inner
            elif key:
                found[key] = value
        return found

    def sound(text):
        # Halves of surrogate pairs have no UTF-8.
        return text if text.isascii() else text.encode("utf-8", "replace").decode()

    encode = json.JSONEncoder(ensure_ascii=False, sort_keys=True).encode
    heads: dict[str, str] = {}

    def quoted(key):
        """A key as it stands in an object; names repeat from record to record."""
        head = heads.get(key)
        if head is None:
            if len(heads) >= 4096:
                heads.clear()
            head = heads[key] = encode(key) + ": "
        return head

    def flat(text, parent):
        try:
            payload = json.loads(text)
            if element is not None and isinstance(payload, dict) and element in payload and not (alone and (len(payload) > 1 or not isinstance(payload[element], dict))):
                payload = payload[element]
            elif element is not None and not alone:
                return None
            found = leaves(payload, parent or "")
            values = list(found.values())
            # Most leaves are whole numbers, which need no encoder.
            shown = [str(v) if type(v) is int else encode(v) for v in values]
            message = "{" + ", ".join([quoted(key) + shown_text for key, shown_text in sorted(zip(found, shown))]) + "}"
            texts = [v if isinstance(v, str) else None if v is None else shown_text for v, shown_text in zip(values, shown)]
            if "\\" not in text:  # without escapes there is no half of a pair
                return list(found), texts, shown, message
            return [sound(key) for key in found], [v if v is None else sound(v) for v in texts], [sound(v) for v in shown], sound(message)
        except (ValueError, TypeError, RecursionError):
            return None

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, parents in batches:
            # Items of all rows one after the other: no lists are kept that the garbage collector would walk through.
            keys, values, shown, messages, ends, at = [], [], [], [], [], 0
            for text, parent in zip(texts.to_pylist(), parents.to_pylist()):
                row = None if text is None else flat(text, parent)
                if row is None:
                    ends.append(None)
                    messages.append(None)
                else:
                    ends.append(at)
                    at += len(row[0])
                    keys += row[0]
                    values += row[1]
                    shown += row[2]
                    messages.append(row[3])
            ends = pa.array([*ends, at], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(items, pa.string())) for items in (keys, values, shown)]
            yield pa.StructArray.from_arrays([*lists, pa.array(messages, pa.string())], ["keys", "texts", "jsons", "message"])

    return run


def flattened(payload: Column, element: str | None = None, alone: bool = False, parent: Column | str = "") -> Column:
    """The flat form of JSON text, or of its member ``element``: ``keys, texts, jsons`` and ``message``, all NULL if the text is broken or lacks it.

    Objects are opened in the order of the document, to any depth; scalars, attributes, texts and plain lists are leaves, and lists of named items become
    ``parent_Name`` keys. Of equal keys the last one counts. A leaf has the ``text`` of a string or the JSON text of anything else (NULL for null), and its
    ``json``. With ``alone`` the member is taken only if it is an object and the only member; else the whole text is.
    """
    parent = F.lit(parent) if isinstance(parent, str) else parent
    return F.arrow_udf(_flattener(element, alone), _FLAT)(payload, parent)


def flatten_payload(df: DataFrame, payload: str, result: str, **options) -> DataFrame:
    """Add ``result``: a map from underscore-joined keys to the leaves of a column of JSON text."""
    opened = df.withColumn(result, flattened(F.col(payload), **options))
    flat = F.col(result)
    return opened.withColumn(result, F.map_from_arrays(flat["keys"], F.arrays_zip(flat["texts"].alias("text"), flat["jsons"].alias("json"))))


def first_of(leaves: Column, keys: Sequence[str]) -> Column:
    """Text of the first key with a value that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(text_of(leaves, k), F.lit("")) for k in keys])


def text_of(leaves: Column, key: str) -> Column:
    return F.try_element_at(leaves, F.lit(key))["text"]


def _record_id(df: DataFrame) -> Column:
    if "event_record_id" in df.columns and "identifier" in df.columns:
        return F.coalesce(F.col("event_record_id"), F.col("identifier")).cast("string")
    return F.col("event_record_id" if "event_record_id" in df.columns else "identifier").cast("string")


def _present(records: DataFrame) -> DataFrame:
    """Records with data, and lines of the export that could not be read at all."""
    unread = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in records.columns else F.lit(False)
    return records.filter(F.col("data").isNotNull() | unread)


def record_rows(records: DataFrame) -> DataFrame:
    """The 11 flat columns of every record, of any depth, all text.

    Missing records are skipped; a record whose JSON or ``Event`` element is broken
    fails the job (see :func:`split_records` to set such records aside instead).
    """
    broken = F.raise_error(F.concat(F.lit("Unable to parse event record "), F.coalesce("_id", F.lit("None"))))
    df = (
        _present(records)
        .withColumn("_id", _record_id(records))
        .withColumn("_event", flattened(F.col("data"), "Event"))
    )
    df = df.withColumn("_leaves", F.map_from_arrays("_event.keys", F.arrays_zip(F.col("_event.texts").alias("text"))))
    leaves = F.col("_leaves")
    plain = {name: text_of(leaves, key) for name, key in C.RECORD_PLAIN_KEYS.items()}
    values = {
        "timestamp": F.coalesce(first_of(leaves, C.RECORD_TIME_KEYS), F.col("timestamp").cast("string")),
        "event": first_of(leaves, C.RECORD_EVENT_KEYS),
        "message": F.coalesce(F.col("_event.message"), broken.cast("string")),
        "record_id": F.col("_id"),
        "source_ip": first_of(leaves, C.RECORD_ADDRESS_KEYS),
        "status_code": first_of(leaves, C.RECORD_STATUS_KEYS),
        **plain,
    }
    return computed_once(df, *[values[c].alias(c) for c in C.RECORD_COLUMNS])


def split_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, broken)`` records by whether their JSON holds an ``Event``; each is opened once, and the judged records are stored."""
    present = _present(records)
    judged = materialize(present.withColumn("_ok", flattened(F.col("data"), "Event")["message"].isNotNull()), "judged")
    return judged.filter("_ok").select(*present.columns), judged.filter("not _ok").select(*present.columns)


def record_preview(records: DataFrame, max_records: int = 50) -> DataFrame:
    """Display line and key fields of the first records; a broken one has empty fields."""
    keys = [c for c in ("event_record_id", "identifier") if c in records.columns]
    first = records.orderBy(F.coalesce(*keys)).limit(max_records).filter(F.col("data").isNotNull())
    first = first.withColumn("_id", _record_id(records))
    df = flatten_payload(first, "data", "_flat", element="Event", alone=True)
    flat = F.col("_flat")
    out = df.select(
        F.col("_id").alias("record_id"),
        first_of(flat, C.RECORD_TIME_KEYS).alias("timestamp"),
        first_of(flat, C.RECORD_EVENT_KEYS).alias("event_id"),
        text_of(flat, "System_Provider_Name").alias("provider"),
        text_of(flat, "System_Channel").alias("channel"),
    )

    def shown(name: str) -> Column:
        return F.coalesce(name, F.lit("None"))

    line = F.concat_ws(
        " | ",
        F.concat(F.lit("#"), shown("record_id")), shown("timestamp"), F.concat(F.lit("EventID="), shown("event_id")),
        shown("provider"), shown("channel"),
    )
    return out.withColumn("line", line)


CORRELATED = {
    "raw_message": "message",
    "raw_source_ip": "source_ip",
    "raw_status_code": "status_code",
    "raw_provider": "provider",
    "raw_level": "level",
    "raw_task": "task",
}


def correlate_alerts(alerts: DataFrame, raw: DataFrame) -> DataFrame:
    """Every alert with the raw event of the same record, channel, computer and time.

    Keys are compared as text. Alerts with a missing key can match nothing; they are
    spread over the partitions instead of meeting in the NULL one.
    """
    keys = {"_record": "RecordID", "_channel": "Channel", "_computer": "Computer", "_time": "Timestamp"}
    left = alerts.withColumns({k: F.col(c).cast("string") for k, c in keys.items()})
    left = left.withColumn("_spread", spread_nulls(left, list(keys)))
    right = raw.select(
        F.col("record_id").cast("string").alias("_record"),
        F.col("channel").alias("_channel"),
        F.col("computer").alias("_computer"),
        F.col("timestamp").cast("string").alias("_time"),
        F.lit(0).alias("_spread"),
        *[F.col(source).alias(name) for name, source in CORRELATED.items()],
    )
    return left.join(right, [*keys, "_spread"], "left").select(*alerts.columns, *CORRELATED)
