from conftest import dicts
from pyspark.sql import functions as F

from parlance.model import EVENT_COLUMNS
from parlance.operators import drift, integrity

TYPES = "source string, schema_version int, severity string, kind string, table_name string, column_name string, observed string, expected string, detail string, seen_at long"


def events(spark, *rows):
    base = dict(source="s", schema_version=1, severity="warn", kind="new_column", table_name="t", column_name="c", observed="o", expected=None, detail="d", seen_at=1)
    return spark.createDataFrame([tuple({**base, **r}[c] for c in EVENT_COLUMNS) for r in rows], TYPES)


def test_three_runs_bump_one_row(spark):
    store = None
    for at, severity in ((10, "warn"), (20, "warn"), (30, "fatal")):
        store = drift.upsert(store, events(spark, {"seen_at": at, "severity": severity, "detail": f"at {at}"}))
    (row,) = dicts(store)
    assert (row["occurrence_count"], row["first_seen"], row["last_seen"], row["severity"], row["detail"]) == (3, 10, 30, "fatal", "at 30")


def test_null_parts_of_the_key_are_one_row(spark):
    store = drift.upsert(None, events(spark, {"column_name": None, "observed": None}, {"column_name": None, "observed": None, "seen_at": 2}))
    (row,) = dicts(store)
    assert row["occurrence_count"] == 2 and row["column_name"] is None


def test_acknowledging_is_done_once_and_survives_new_sightings(spark):
    store = drift.number_events(drift.upsert(None, events(spark, {}, {"source": "other"})))
    acked = drift.acknowledge(drift.acknowledge(store, 5, source="s"), 9)
    assert {r.source: r.acknowledged_at for r in acked.collect()} == {"s": 5, "other": 9}
    again = drift.upsert(acked, events(spark, {"seen_at": 50}))
    assert {r.source: (r.acknowledged_at, r.occurrence_count) for r in again.collect()} == {"s": (5, 2), "other": (9, 1)}
    assert drift.list_events(again).isEmpty() and drift.list_events(again, include_acknowledged=True).count() == 2


def test_ids_stay_and_new_ones_follow(spark):
    store = drift.number_events(drift.upsert(None, events(spark, {}, {"kind": "type_changed"})))
    ids = {r.kind: r.id for r in store.collect()}
    more = drift.number_events(drift.upsert(store, events(spark, {"kind": "missing_table"}, {})), F.lit(2))
    assert {r.kind: r.id for r in more.collect()} == {**ids, "missing_table": 3}


def test_roll_up_and_gate(spark):
    store = drift.upsert(None, events(spark, {"severity": "fatal"}, {"source": "ok"}, {"source": "ok", "kind": "x", "severity": "info"}))
    got = {r.source: (r.fatal, r.warn, r.info, r.pending, r.is_fatal) for r in drift.roll_up(store).collect()}
    assert got == {"s": (1, 0, 0, 1, True), "ok": (0, 1, 1, 2, False)}
    rows = spark.createDataFrame([("s", 1), ("ok", 2)], "source string, x int")
    assert [r.source for r in drift.gate(rows, store).collect()] == ["ok"]


def test_declared_types(spark):
    names = ["int", "INTEGER", "VARCHAR(255)", "decimal(8, 2)", "", None, "TIMESTAMP", "Double", "json"]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string")
    got = [r[0] for r in df.orderBy("k").select(drift.storage_class_of(F.col("n"))).collect()]
    from parlance.sources.contracts import storage_class
    assert got == [storage_class(n) for n in names] == ["INTEGER", "INTEGER", "TEXT", "NUMERIC", "BLOB", "BLOB", "NUMERIC", "REAL", "JSON"]


def test_observed_columns_of_a_dataframe(spark):
    contract = drift.contract_frame(spark, "s", 2, {"t": ({"a": "INTEGER", "b": "TEXT"}, ["c"], True)})
    df = spark.createDataFrame([(1, 2.0, "x")], "a bigint, b double, d string")
    found = dicts(drift.probe(contract, drift.observed_columns(df, "s", "t"), 1), "kind")
    assert [(e["kind"], e["column_name"], e["observed"]) for e in found] == [
        ("missing_optional_column", "c", None), ("new_column", "d", "STRING"), ("type_changed", "b", "REAL")]


def test_orphans(spark):
    tables = {
        "person": spark.createDataFrame([(1,)], "id long"), "chat": spark.createDataFrame([(1, 1)], "id long, device_id long"),
        "message": spark.createDataFrame([(1, 1, 1), (2, 9, None), (3, 9, 2)], "id long, chat_id long, sender_person_id long"),
    }
    assert [tuple(r.values()) for r in dicts(integrity.orphans(tables), "column_name")] == [
        ("message", "chat_id", 9, 2), ("message", "sender_person_id", 2, 1)]


def test_probe_never_broadcasts_unfolded_sides(spark):
    """A few wide rows unfold to many: their size is no measure for a broadcast (F16, F17, F18, F20)."""
    contract = spark.createDataFrame([("s", 1, "t", "a", "TEXT", True, True)], "source string, schema_version int, table_name string, column_name string, storage string, required boolean, flag_new boolean")
    seen = spark.createDataFrame([("s", "t", "b", "TEXT")], "source string, table_name string, column_name string, declared_type string")
    rows = drift.probe(contract, seen, 1)
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted((e["kind"], e["column_name"]) for e in rows.collect()) == [("missing_required_column", "a"), ("new_column", "b")]
