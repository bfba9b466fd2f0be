"""Schema drift: contracts against observed columns and values, the event store and the fatal gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.model import EVENT_COLUMNS
from parlance.operators.ordered import number_rows
from parlance.sources.contracts import STORAGE_CLASSES, UNTYPED

KEY = ["source", "kind", "table_name", "column_name", "observed"]


def storage_class_of(declared: Column) -> Column:
    """Coarse class of a column of declared types."""
    bare = F.upper(F.trim(F.element_at(F.split(F.coalesce(declared, F.lit("")), r"\("), 1)))
    known = F.create_map(*[F.lit(x) for pair in STORAGE_CLASSES.items() for x in pair])
    return F.coalesce(known[bare], F.when(bare == "", UNTYPED).otherwise(bare))


def observed_columns(df: DataFrame, source: str, table: str) -> DataFrame:
    """Column names and types of a DataFrame in the layout the probe reads."""
    spark = df.sparkSession
    rows = [(source, table, f.name, f.dataType.simpleString()) for f in df.schema]
    return spark.createDataFrame(rows, "source string, table_name string, column_name string, declared_type string")


def probe(contract: DataFrame, observed: DataFrame, seen_at: int) -> DataFrame:
    """Every difference between a contract and the observed columns, as drift events.

    ``contract``: source, schema_version, table_name, column_name, storage, required, flag_new.
    ``observed``: source, table_name, column_name, declared_type.

    Both sides may be unfolded from few wide rows, whose size Spark takes for theirs; so the joins ask for sorted sides,
    which spill, and never for a broadcast.
    """
    have = observed.select("source", "table_name", "column_name",
                           storage_class_of(F.col("declared_type")).alias("found"))
    tables = have.select("source", "table_name").distinct().withColumn("_present", F.lit(True))
    wanted = contract.join(tables.hint("merge"), ["source", "table_name"], "left")
    gone = wanted.filter(F.col("_present").isNull()).select("source", "schema_version", "table_name").distinct()
    missing_table = _event(gone, "fatal", "missing_table", None, None, F.lit("present"),
                           F.concat(F.lit("table "), "table_name", F.lit(" not found")), seen_at)

    columns = (
        wanted.filter("_present").filter(F.col("column_name").isNotNull())
        .withColumn("expected", storage_class_of(F.col("storage")))
        .join(have.hint("merge"), ["source", "table_name", "column_name"], "left")
    )
    absent = columns.filter(F.col("found").isNull())
    where = F.concat_ws(".", "table_name", "column_name")
    missing_required = _event(
        absent.filter("required"), "fatal", "missing_required_column", F.col("column_name"), None, F.col("storage"),
        F.concat(F.lit("required column "), where, F.lit(" is missing")), seen_at)
    missing_optional = _event(
        absent.filter(~F.col("required")), "warn", "missing_optional_column", F.col("column_name"), None,
        F.lit("present (optional)"), F.concat(F.lit("optional column "), where, F.lit(" is missing")), seen_at)
    changed = _event(
        columns.filter(F.col("required") & (F.col("found") != F.col("expected"))), "fatal", "type_changed",
        F.col("column_name"), F.col("found"), F.col("expected"),
        F.concat(F.lit("storage class of "), where, F.lit(" changed to "), "found"), seen_at)

    watched = contract.filter("flag_new").select("source", "schema_version", "table_name").distinct()
    fresh = have.join(watched.hint("merge"), ["source", "table_name"]).join(
        contract.select("source", "table_name", "column_name").hint("merge"), ["source", "table_name", "column_name"], "left_anti")
    new_column = _event(fresh, "warn", "new_column", F.col("column_name"), F.col("found"), None,
                        F.concat(F.lit("column "), where, F.lit(" is not in the contract")), seen_at)
    return (missing_table.unionByName(missing_required).unionByName(changed)
            .unionByName(missing_optional).unionByName(new_column))


def _event(rows: DataFrame, severity: str, kind: str, column: Column | None, observed: Column | None,
           expected: Column | None, detail: Column, seen_at: int | Column, *more: str) -> DataFrame:
    def text(c: Column | None) -> Column:
        return F.lit(None).cast("string") if c is None else c.cast("string")

    return rows.select(
        "source", F.col("schema_version").cast("int").alias("schema_version"), F.lit(severity).alias("severity"),
        F.lit(kind).alias("kind"), "table_name", text(column).alias("column_name"), text(observed).alias("observed"),
        text(expected).alias("expected"), detail.alias("detail"),
        (F.lit(seen_at) if isinstance(seen_at, int) else seen_at).cast("bigint").alias("seen_at"), *more)


def unknown_values(df: DataFrame, source: str | Column, version: int, table: str, column: str, allowed: list[int],
                   seen_at: int, ignore_zero: bool = False) -> DataFrame:
    """One event per value outside an allow-list, with the number of rows as ``occurrences``."""
    value = F.col(column)
    named = (F.lit(source) if isinstance(source, str) else source).alias("source")
    counts = df.filter(value.isNotNull()).groupBy(named, value.alias("_value")).agg(F.count(F.lit(1)).alias("occurrences"))
    strange = counts.filter(~F.col("_value").isin(allowed))
    if ignore_zero:
        strange = strange.filter(F.col("_value") != 0)
    rows = strange.select("source", F.lit(version).alias("schema_version"),
                          F.lit(table).alias("table_name"), "_value", "occurrences")
    expected = "one of [" + ", ".join(str(v) for v in sorted(allowed)) + "]"
    return _event(
        rows.withColumn("_value", F.col("_value").cast("string")), "warn", "unknown_enum_value", F.lit(column),
        F.col("_value"), F.lit(expected), F.concat(F.lit(f"unknown {table}.{column} value "), "_value"), seen_at, "occurrences")


def parse_failures(rows: DataFrame, version: int, table: str, error: Column, detail: Column,
                   seen_at: int | Column, column: str | None = None) -> DataFrame:
    """Events for rows that could not be turned into messages; ``rows`` carries ``source``."""
    bad = rows.filter(error.isNotNull()).withColumns(
        {"schema_version": F.lit(version), "table_name": F.lit(table), "_error": error, "_detail": detail})
    return _event(bad, "warn", "row_parse_failed", None if column is None else F.lit(column), F.col("_error"),
                  None, F.col("_detail"), seen_at)


# --- the event store ------------------------------------------------------------------------------


def upsert(store: DataFrame | None, events: DataFrame) -> DataFrame:
    """Merge observations into the store, one row per (source, kind, table, column, observed).

    NULL parts of the key count as ''. The first time stays, the last time and the counter advance, and
    the newest observation's severity, version, detail and expectation win. An acknowledgement stays.
    """
    fresh = events.select(
        F.lit(None).cast("bigint").alias("id"), *[c for c in EVENT_COLUMNS if c != "seen_at"],
        F.col("seen_at").alias("first_seen"), F.col("seen_at").alias("last_seen"),
        (F.col("occurrences") if "occurrences" in events.columns else F.lit(1)).cast("bigint").alias("occurrence_count"),
        F.lit(None).cast("bigint").alias("acknowledged_at"))
    rows = fresh if store is None else store.unionByName(fresh)
    keyed = [F.coalesce(c, F.lit("")).alias(f"_k_{c}") for c in KEY]
    newest = F.max_by(F.struct("severity", "schema_version", "expected", "detail"),
                      F.struct("last_seen", "detail", "severity", "schema_version"))
    merged = rows.groupBy(*keyed).agg(
        F.max("id").alias("id"), newest.alias("_newest"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"), F.sum("occurrence_count").alias("occurrence_count"),
        F.max("acknowledged_at").alias("acknowledged_at"))
    return merged.select(
        "id", *[F.nullif(F.col(f"_k_{c}"), F.lit("")).alias(c) for c in KEY],
        *[F.col(f"_newest.{c}").alias(c) for c in ("severity", "schema_version", "expected", "detail")],
        "first_seen", "last_seen", "occurrence_count", "acknowledged_at")


def number_events(store: DataFrame, start: int | Column = 0) -> DataFrame:
    """Give events without an id the next numbers, in order of first sight."""
    key = F.concat_ws("\u001f", *[F.coalesce(c, F.lit("")) for c in KEY])
    fresh = number_rows(store.filter(F.col("id").isNull()).drop("id"), key, "id", start,
                        F.floor(F.col("first_seen") / 86400))
    return store.filter(F.col("id").isNotNull()).unionByName(fresh)


def acknowledge(store: DataFrame, at: int, source: str | None = None, event_id: int | None = None) -> DataFrame:
    """Set the acknowledgement time of one, all or one source's pending events, once."""
    chosen = F.col("acknowledged_at").isNull()
    if source is not None:
        chosen = chosen & (F.col("source") == source)
    if event_id is not None:
        chosen = chosen & (F.col("id") == event_id)
    return store.withColumn("acknowledged_at", F.when(chosen, F.lit(at).cast("bigint")).otherwise(F.col("acknowledged_at")))


def list_events(store: DataFrame, include_acknowledged: bool = False, source: str | None = None) -> DataFrame:
    """Pending (or all) events, the most recently seen first."""
    rows = store if include_acknowledged else store.filter(F.col("acknowledged_at").isNull())
    rows = rows if source is None else rows.filter(F.col("source") == source)
    return rows.orderBy(F.desc("last_seen"), F.desc("id"))


def roll_up(store: DataFrame) -> DataFrame:
    """Per source: occurrences, severities, pending events and whether ingestion is blocked."""
    pending = F.col("acknowledged_at").isNull()
    return store.groupBy("source").agg(
        F.sum("occurrence_count").alias("occurrences"), F.count_if(F.col("severity") == "fatal").alias("fatal"),
        F.count_if(F.col("severity") == "warn").alias("warn"), F.count_if(F.col("severity") == "info").alias("info"),
        F.count_if(pending).alias("pending"),
        F.coalesce(F.bool_or(pending & (F.col("severity") == "fatal")), F.lit(False)).alias("is_fatal"))


def fatal_sources(events: DataFrame) -> DataFrame:
    return events.filter(F.col("severity") == "fatal").select("source").distinct()


def gate(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Rows of sources without a fatal event; nothing of a half-understood source passes."""
    return rows.join(fatal_sources(events), "source", "left_anti")


def contract_frame(spark: SparkSession, source: str, version: int, tables: dict) -> DataFrame:
    """Contract rows from {table: (required {column: storage}, optional [column], flag_new)}."""
    rows = []
    for table, (required, optional, flag_new) in tables.items():
        rows += [(source, version, table, c, s, True, flag_new) for c, s in required.items()]
        rows += [(source, version, table, c, None, False, flag_new) for c in optional]
    return spark.createDataFrame(
        rows, "source string, schema_version int, table_name string, column_name string, storage string, "
              "required boolean, flag_new boolean")
