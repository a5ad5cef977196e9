"""Incident reports: context text, response parsing, tolerant normalization, storage."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logsift import constants as C
from logsift.functions.text import date_label, truncate_within
from logsift.plans.shapes import computed_once, head_per_group
from logsift.session import materialize
from logsift.sources import listing

CONTEXT_HEADER = (
    "Analyze the suspicious indicators below and produce a structured incident report.",
    "Answer with one JSON object holding the keys " + ", ".join((*C.REPORT_FIELDS, "indicators", "metadata")) + ".",
)
STORE_SCHEMA = "report_id string, created_at timestamp_ntz, report_json string, source_table string"

_TIMELINE_IN = (
    "struct<timestamp:string, time:string, description:string, source_ip:string, event_type:string, "
    "status_code:int, raw_message:string>"
)
_MITRE_IN = (
    "struct<technique_id:string, technique:string, technique_name:string, name:string, tactic:string, "
    "description:string>"
)
_INDICATOR_IN = "struct<type:string, severity:string, description:string, evidence:variant, threat_lists:array<string>>"
_MITIGATION = "struct<format:string, title:string, content:string>"
REPORT_TYPE = (
    "struct<title:string, summary:string, severity:string, "
    "timeline:array<struct<timestamp:string, description:string, source_ip:string, event_type:string, "
    "status_code:int, raw_message:string>>, "
    "mitre_mappings:array<struct<technique_id:string, technique_name:string, tactic:string, description:string>>, "
    f"mitigation:{_MITIGATION}, "
    "indicators:array<struct<type:string, severity:string, description:string, evidence:string, "
    "threat_lists:array<string>>>, metadata:string>"
)


# --- context -----------------------------------------------------------------


def _joined(df: DataFrame, keys: Sequence[str], text: Column, order: Sequence[str], name: str) -> DataFrame:
    """One text per incident: the rows in order, a blank line between them."""
    ordered = ", ".join((*order, "_text"))
    texts = F.expr(rf"listagg(_text, '\n\n') within group (order by {ordered})")
    return df.withColumn("_text", text).groupBy(*keys).agg(texts.alias(name))


def report_context(
    indicators: DataFrame,
    reputation: DataFrame | None = None,
    samples: DataFrame | None = None,
    keys: Sequence[str] = ("incident",),
    header: Sequence[str] = CONTEXT_HEADER,
) -> DataFrame:
    """One context document per incident: indicators, reputation lines, sample events.

    ``indicators`` and ``samples`` carry the incident keys and a column ``position``
    that orders them; ``samples`` holds one JSON text per row in ``event``. Every
    input is read and grouped once, then the sections are joined per incident.
    """
    keys = list(keys)
    def said(value: Column) -> Column:
        """A missing part does not take its line with it."""
        return F.coalesce(value.cast("string"), F.lit("None"))

    shown = F.concat(
        F.lit("- ["), said(F.col("severity")), F.lit("] "), said(F.col("type")), F.lit(": "), said(F.col("description")),
        F.lit("\n\n  Evidence: "), said(truncate_within(F.col("evidence"), C.EVIDENCE_CHARS)),
    )
    out = _joined(indicators, keys, shown, ["position"], "indicators")
    sections = [F.lit(text) for text in (*header, "Indicators:")] + [F.col("indicators")]
    if reputation is not None:
        line = F.concat(
            F.lit("- "), said(F.col("ip")), F.lit(": abuse confidence "), said(F.col("abuse_confidence_score")),
            F.lit(", reports "), said(F.col("total_reports")),
        )
        out = out.join(_joined(reputation, keys, line, ["ip"], "reputation"), keys, "left")
        sections.append(F.concat(F.lit("Threat intelligence:\n\n"), F.col("reputation")))
    if samples is not None:
        kept = head_per_group(samples, keys, [F.asc("position"), F.asc("event")], C.SAMPLE_EVENTS)
        cut = truncate_within(F.col("event"), C.SAMPLE_CHARS)
        out = out.join(_joined(kept, keys, cut, ["rn"], "samples"), keys, "left")
        sections.append(F.concat(F.lit("Sample raw events:\n\n"), F.col("samples")))
    return out.select(*keys, F.concat_ws("\n\n", *sections).alias("context"))


# --- responses ---------------------------------------------------------------


def parse_responses(responses: DataFrame, column: str = "text") -> DataFrame:
    """Responses with ``report_json`` and ``status``: ``ok``, ``invalid_json`` or ``missing: …``.

    A fenced block wins over the whole text.
    """
    fenced = r"(?s)```(?:json)?\s*(.*?)\s*```"
    text = F.col(column)
    candidate = F.trim(F.when(text.rlike(fenced), F.regexp_extract(text, fenced, 1)).otherwise(text))
    members = F.try_parse_json("_candidate").try_cast("map<string,variant>")
    absent = F.array_join(
        F.array_except(F.array(*[F.lit(f) for f in sorted(C.REPORT_FIELDS)]), F.map_keys("_members")), ", "
    )
    return (
        responses.withColumn("_candidate", candidate)
        .withColumn("_members", members)
        .withColumn("_absent", absent)
        .withColumn(
            "status",
            F.when(F.col("_members").isNull(), "invalid_json")
            .when(F.col("_absent") != "", F.concat(F.lit("missing: "), F.col("_absent")))
            .otherwise("ok"),
        )
        .withColumn("report_json", F.when(F.col("status") == "ok", F.col("_candidate")))
        .drop("_candidate", "_members", "_absent")
    )


def _is_object(value: Column) -> Column:
    return value.try_cast("map<string,variant>").isNotNull()


def _object_items(value: Column, item_type: str) -> Column:
    """The items of a JSON list that are objects, as structs; an empty array otherwise."""
    objects = F.filter(value.try_cast("array<variant>"), _is_object)
    items = F.transform(objects, lambda v: F.from_json(F.to_json(v), item_type))
    return F.coalesce(items, F.array().cast(f"array<{item_type}>"))


def _or(col: Column, default: str) -> Column:
    return F.coalesce(col, F.lit(default))


def normalize_reports(reports: DataFrame, column: str = "report_json") -> DataFrame:
    """Add ``report``, the tolerant normal form of the JSON in ``column``, and ``readable``.

    Known alternative key names are mapped, defaults filled in, unknown keys and
    non-object items dropped. A report without title, summary or valid severity is
    not readable, and neither is one with an indicator of unknown severity; its
    ``report`` is NULL.
    """
    root = F.col("_root")

    def member(name: str, dtype: str = "variant") -> Column:
        return F.try_variant_get(root, f"$.{name}", dtype)

    timeline = F.transform(
        _object_items(member("timeline"), _TIMELINE_IN),
        lambda t: F.struct(
            F.coalesce(t["timestamp"], t["time"], F.lit("")).alias("timestamp"),
            _or(t["description"], "").alias("description"),
            t["source_ip"].alias("source_ip"), t["event_type"].alias("event_type"),
            t["status_code"].alias("status_code"), t["raw_message"].alias("raw_message"),
        ),
    )
    mitre = F.transform(
        _object_items(member("mitre_mappings"), _MITRE_IN),
        lambda m: F.struct(
            F.coalesce(m["technique_id"], m["technique"], F.lit("unknown")).alias("technique_id"),
            F.coalesce(m["technique_name"], m["name"], F.lit("")).alias("technique_name"),
            _or(m["tactic"], "").alias("tactic"),
            F.coalesce(m["description"], m["technique_name"], m["name"], F.lit("")).alias("description"),
        ),
    )
    indicators = F.transform(
        _object_items(member("indicators"), _INDICATOR_IN),
        lambda i: F.struct(
            _or(i["type"], "unknown").alias("type"),
            _or(i["severity"], "Medium").alias("severity"),
            _or(i["description"], "").alias("description"),
            F.coalesce(F.to_json(i["evidence"]), F.lit("{}")).alias("evidence"),
            F.coalesce(i["threat_lists"], F.array().cast("array<string>")).alias("threat_lists"),
        ),
    )
    mitigation = F.struct(
        *[_or(member(f"mitigation.{f}", "string"), "").alias(f) for f in ("format", "title", "content")]
    )
    report = F.struct(
        member("title", "string").alias("title"),
        member("summary", "string").alias("summary"),
        member("severity", "string").alias("severity"),
        timeline.alias("timeline"),
        mitre.alias("mitre_mappings"),
        mitigation.alias("mitigation"),
        indicators.alias("indicators"),
        F.coalesce(F.to_json(member("metadata")), F.lit("{}")).alias("metadata"),
    ).cast(REPORT_TYPE)
    listed = F.filter(member("indicators").try_cast("array<variant>"), _is_object)
    rated = F.forall(listed, lambda i: _or(F.try_variant_get(i, "$.severity", "string"), "Medium").isin(*C.SEVERITIES))
    named = root.try_cast("map<string,variant>")
    readable = (
        F.map_contains_key(named, F.lit("title"))
        & F.map_contains_key(named, F.lit("summary"))
        & member("severity", "string").isin(*C.SEVERITIES)
        & F.coalesce(rated, F.lit(True))
    )
    judged = reports.withColumn("_root", F.try_parse_json(column)).withColumn(
        "readable", F.coalesce(readable, F.lit(False))
    )
    kept = [F.col(f"`{c}`") for c in (*reports.columns, "readable")]
    return computed_once(judged, *kept, F.when(F.col("readable"), report).alias("report"))


def report_json(column: str = "report") -> Column:
    """A normalized report as JSON with every field present; evidence and metadata stay JSON text."""
    return F.to_json(column, {"ignoreNullFields": "false"})


def mitre_table(reports: DataFrame) -> DataFrame:
    """One row per technique of each normalized report."""
    kept = [c for c in reports.columns if c not in ("report", "report_json", "readable")]
    return reports.select(*kept, F.explode("report.mitre_mappings").alias("m")).select(
        *kept, "m.technique_id", "m.technique_name", "m.tactic"
    )


# --- store -------------------------------------------------------------------


def new_reports(reports: DataFrame, now: Column, source_table: str | None = None) -> DataFrame:
    """Store rows for report JSON texts; the id is a digest of payload, scope and time of saving.

    The same payload saved later is another report; saved again at the same time, as by a repeated job, it is the same one.
    """
    scope = F.lit(source_table).cast("string")
    if source_table is None and "source_table" in reports.columns:
        scope = F.col("source_table")
    return reports.select(
        F.sha2(F.concat_ws("|", F.coalesce(scope, F.lit("")), now.cast("timestamp_ntz").cast("string"), F.col("report_json")), 256).alias("report_id"),
        now.cast("timestamp_ntz").alias("created_at"),
        "report_json",
        scope.alias("source_table"),
    )


def save_reports(spark: SparkSession, path: str, new: DataFrame) -> DataFrame:
    """Add the reports that the table at ``path`` does not hold, one row per id; returns the whole table.

    Repeated saving adds nothing. One writer at a time.
    """
    once = new.groupBy("report_id").agg(F.min(F.struct(*[c for c in new.columns if c != "report_id"])).alias("row")).select("report_id", "row.*")
    rows = once.select(*new.columns)
    try:
        rows = rows.join(spark.read.schema(new.schema).parquet(path).select("report_id"), "report_id", "left_anti").select(*new.columns)
    except AnalysisException:
        pass  # nothing saved yet
    materialize(rows, "reports").write.mode("append").parquet(path)
    return spark.read.schema(new.schema).parquet(path)


def get_report(store: DataFrame, report_id: str) -> DataFrame:
    """The one report with this id, normalized; fails if there is none."""
    found = normalize_reports(store.filter(F.col("report_id") == report_id)).select("report_id", "report")
    missing = F.raise_error(F.lit(f"Report not found: {report_id}"))
    # A filter fails whichever columns are read.
    one = found.agg(F.count(F.lit(1)).alias("n"), F.first("report").alias("report"))
    return one.filter(F.when(F.col("n") == 0, missing.cast("boolean")).otherwise(True)).select(F.lit(report_id).alias("report_id"), "report")


def stored_reports(store: DataFrame, source_table: str | None = None) -> DataFrame:
    """Reports of one table plus those without a scope, or all; corrupt ones are not ``readable``."""
    scoped = store
    if source_table is not None:
        scoped = store.filter((F.col("source_table") == source_table) | F.col("source_table").isNull())
    return normalize_reports(scoped)


def list_reports(store: DataFrame, source_table: str | None = None) -> DataFrame:
    """Readable reports, newest first."""
    return (
        stored_reports(store, source_table)
        .filter("readable")
        .select("report_id", "created_at", date_label(F.col("created_at")).alias("date_label"), "report")
        .orderBy(F.desc("created_at"), F.asc("report_id"))
    )


def corrupt_count(store: DataFrame, source_table: str | None = None) -> DataFrame:
    return stored_reports(store, source_table).agg(F.count_if(~F.col("readable")).alias("corrupt"))


def migrate_store(legacy: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Old report rows, possibly without ``source_table``, in the current schema."""
    merged = legacy if current is None else legacy.unionByName(current, allowMissingColumns=True)
    names = {c.lower(): c for c in merged.columns}
    scope = F.col(names["source_table"]) if "source_table" in names else F.lit(None)
    return merged.select("report_id", "created_at", "report_json", scope.cast("string").alias("source_table"))


# --- export ------------------------------------------------------------------


def rule_exports(reports: DataFrame, rule_format: str) -> DataFrame:
    """Mitigation rules in the wanted format, any case; other formats are named in ``error``."""
    found = F.lower("report.mitigation.format")
    extension = F.lit(None).cast("string")
    for name, ext in C.RULE_EXTENSIONS.items():
        extension = F.when(found == name, ext).otherwise(extension)
    matches = found == rule_format.lower()
    error = F.concat(
        F.lit(C.RULE_FORMAT_MISMATCH.format(wanted=rule_format)),
        F.col("report.mitigation.format"), F.lit("'"),
    )
    return reports.select(
        "report_id",
        F.coalesce(extension, F.lit("txt")).alias("extension"),
        F.when(matches, F.col("report.mitigation.content")).alias("content"),
        F.when(~matches, error).alias("error"),
    )


def _rule_stager(staged: str, job: str):
    """Rules as files of their own, in a folder per task; where each belongs is passed on."""
    find = listing.opener()

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        def named(value):
            """The name of a partition as Spark writes it."""
            odd = "\"#%'*/:=?\\{[]^\x7f"
            return "".join(f"%{ord(c):02X}" if c in odd or 0 < ord(c) < 32 else c for c in value) if value else "__HIVE_DEFAULT_PARTITION__"

        task = TaskContext.get().partitionId()
        folder = f"{staged}/{task:05d}-{uuid.uuid4().hex}"
        system, inside = find(folder)
        system.create_dir(inside, recursive=True)
        at, stream, n = None, None, 0
        try:
            for batch in batches:
                targets = []
                for extension, report_id, value in zip(*[c.to_pylist() for c in batch.columns]):
                    if (extension, report_id) != at:  # rows of one report follow one another
                        if stream:
                            stream.close()
                        at, n = (extension, report_id), n + 1
                        stream = system.open_output_stream(f"{inside}/{n}.txt")
                        targets.append((f"{folder}/{n}.txt", f"extension={named(extension)}/report_id={named(report_id)}", f"part-{task:05d}-{n}-{job}.txt"))
                    stream.write((value or b"") + b"\n")
                if targets:
                    columns = [pa.array(c, t) for c, t in zip(zip(*targets), (pa.string(),) * 3)]
                    yield pa.RecordBatch.from_arrays(columns, ["staged", "folder", "name"])
        finally:
            if stream:
                stream.close()

    return run


def _rule_publisher(root: str, job: str):
    """Moves staged files to their folders, then takes away what the folders held before; a repeated task finds its files moved."""
    find = listing.opener()

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for staged, folder, name in zip(*[c.to_pylist() for c in batch.columns]):
                system, source = find(staged)
                _, target = find(f"{root}/{folder}")
                system.create_dir(target, recursive=True)
                try:
                    system.move(source, f"{target}/{name}")
                except OSError:
                    if not system.get_file_info(f"{target}/{name}").is_file:
                        raise
                for info in system.get_file_info(fs.FileSelector(target)):
                    if job not in info.base_name:
                        system.delete_dir(info.path) if info.type == fs.FileType.Directory else system.delete_file(info.path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return run


def write_rules(exports: DataFrame, path: str) -> None:
    """Rule texts under ``path/extension=…/report_id=…``; rules of other reports stay. One writer at a time.

    Making a file costs more than what is in it, so the reports are dealt to all tasks, however few bytes they have. Tasks write all
    files to a hidden folder first, a flat one each, and only when all are written others move them to their places: the driver
    touches no report's folder, and a job that fails while writing leaves the old rules as they were.
    """
    spark = exports.sparkSession
    rules = exports.filter(F.col("error").isNull()).select("extension", "report_id", F.col("content").alias("value"))
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt, root = rules.repartition(n, "extension", "report_id"), listing.reach(spark, path)
    if root is None:  # a store that only Spark's writers open; the driver renames each folder
        writer = dealt.write.partitionBy("extension", "report_id").mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
        return
    job = uuid.uuid4().hex
    hidden = spark._jvm.org.apache.hadoop.fs.Path(path, f".rules-{job}")
    system = hidden.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(hidden)
    try:
        in_order = dealt.sortWithinPartitions("extension", "report_id").withColumn("value", F.col("value").cast("binary"))
        staged = materialize(in_order.mapInArrow(_rule_stager(f"{root}/{hidden.getName()}", job), "staged string, folder string, name string"), "staged")
        staged.repartition(n, "folder").mapInArrow(_rule_publisher(root, job), "n long").agg(F.sum("n")).collect()
    finally:
        system.delete(hidden, True)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """``(value, extension, report_id)``: the rules that ``write_rules`` left under ``path``, each as one text; tasks list and read them."""
    listed = listing.files_below(spark, path)
    if listed is None:
        return spark.read.schema("value string, extension string, report_id string").text(path, wholetext=True)

    def part(name: str) -> Column:
        value = F.regexp_extract("path", rf".*/{name}=([^/]*)/", 1)
        plain = F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)
        return F.when(value != "__HIVE_DEFAULT_PARTITION__", plain).alias(name)

    return listing.read_texts(listed).select("value", part("extension"), part("report_id"))


def export_rule(store: DataFrame, report_id: str, rule_format: str, path: str) -> None:
    """The rule of one report as a text file in the new folder ``path``; fails if there is no such report or its rule has another format."""
    row = rule_exports(get_report(store, report_id), rule_format).select("content", "error").first()  # one report's rule
    if row["content"] is None:
        raise ValueError(row["error"] or f"Report {report_id} has no rule")
    store.sparkSession.createDataFrame([(row["content"],)], "value string").coalesce(1).write.text(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """Normalized reports as JSON lines."""
    reports.select(report_json().alias("value")).write.mode("overwrite").text(path)
