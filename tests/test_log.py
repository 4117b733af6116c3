"""Hand-made logs: the edge cases of detectors, repairs, samples and sources."""

from __future__ import annotations

import sqlite3

import pytest
from pyspark.sql import functions as F

from logwright.functions import values
from logwright.log import Log, TypeTable
from logwright.operators import batch, detectors, evaluate, inject, profile, repair, sampling
from logwright.sources import files, sqlite
from logwright.streaming import relations

OBJECT_TYPES = {"orders": ("Orders", "price REAL"), "items": ("Items", "weight REAL"), "products": ("Products", "weight REAL, price REAL"), "customers": ("Customers", ""), "employees": ("Employees", "role TEXT"), "packages": ("Packages", "weight REAL")}
EVENT_TYPES = {"place order": "PlaceOrder", "pick item": "PickItem", "confirm order": "ConfirmOrder", "pay order": "PayOrder", "item out of stock": "ItemOutOfStock", "create package": "CreatePackage", "send package": "SendPackage"}


def make(path) -> str:
    """A small clean log in a SQLite file."""
    db = sqlite3.connect(path)
    run = db.execute
    run("CREATE TABLE object (ocel_id TEXT, ocel_type TEXT)")
    run("CREATE TABLE event (ocel_id TEXT, ocel_type TEXT)")
    run("CREATE TABLE event_object (ocel_event_id TEXT, ocel_object_id TEXT, ocel_qualifier TEXT)")
    run("CREATE TABLE object_object (ocel_source_id TEXT, ocel_target_id TEXT, ocel_qualifier TEXT)")
    run("CREATE TABLE object_map_type (ocel_type TEXT, ocel_type_map TEXT)")
    run("CREATE TABLE event_map_type (ocel_type TEXT, ocel_type_map TEXT)")
    for name, (table, columns) in OBJECT_TYPES.items():
        run("INSERT INTO object_map_type VALUES (?, ?)", (name, table))
        run(f"CREATE TABLE object_{table} (ocel_id TEXT, ocel_time TEXT, ocel_changed_field TEXT{', ' + columns if columns else ''})")
        for i in range(12):
            run("INSERT INTO object VALUES (?, ?)", (f"{name[0]}{name[1]}-{i}", name))
            own = [f"r{i}"] if "TEXT" in columns else [i + 0.5 + k for k in range(columns.count("REAL"))]
            run(f"INSERT INTO object_{table} VALUES ({', '.join('?' * (3 + len(own)))})", (f"{name[0]}{name[1]}-{i}", "2024-01-01 00:00:00", None, *own))
    for k, (name, table) in enumerate(EVENT_TYPES.items()):
        run("INSERT INTO event_map_type VALUES (?, ?)", (name, table))
        run(f"CREATE TABLE event_{table} (ocel_id TEXT, ocel_time TEXT, resource TEXT, lifecycle TEXT)")
        for i in range(12):
            run("INSERT INTO event VALUES (?, ?)", (f"{table}_{i}", name))
            run(f"INSERT INTO event_{table} VALUES (?, ?, ?, ?)", (f"{table}_{i}", f"2024-0{k + 1}-{i + 10} 00:00:00", f"{table}{i}", f"l{table}{i}"))
            for q, o in (("order", f"or-{i}"), ("item", f"it-{i}"), ("product", f"pr-{i}"), ("packer", f"em-{i}"), ("shipper", f"em-{(i + 1) % 12}"), ("sales person", f"em-{(i + 2) % 12}")):
                run("INSERT INTO event_object VALUES (?, ?, ?)", (f"{table}_{i}", o, q))
    for i in range(12):
        for row in ((f"or-{i}", f"it-{i}", "comprises"), (f"cu-{i}", f"or-{i}", "places"), (f"cu-{i}", f"em-{i}", "primarySalesRep")):
            run("INSERT INTO object_object VALUES (?, ?, ?)", row)
    db.commit()
    db.close()
    return str(path)


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("log")
    files.write_log(sqlite.open_log(spark, make(folder / "log.sqlite"), 3), f"{folder}/parquet")
    return files.read_log(spark, f"{folder}/parquet")


def counts(log) -> dict:
    return {r["issue"]: r["n"] for r in detectors.issue_counts(log).collect()}


@pytest.fixture(scope="module")
def clean(log):
    return counts(log)


def test_a_clean_log_has_no_issues(clean):
    assert set(clean) == set(detectors.DETECTORS) and not any(clean.values())


def test_sqlite_round_trip(spark, log, tmp_path):
    path = make(tmp_path / "x.sqlite")
    db = sqlite3.connect(path)
    db.execute("UPDATE object_Products SET weight = 'heavy' WHERE ocel_id = 'pr-1'")
    db.execute("UPDATE object_Products SET weight = 3 WHERE ocel_id = 'pr-2'")
    db.execute("UPDATE object_Employees SET role = x'00ff' WHERE ocel_id = 'em-1'")
    db.execute("UPDATE object_Employees SET role = 'it''s' WHERE ocel_id = 'em-2'")
    db.commit()
    db.close()
    read = sqlite.open_log(spark, path)
    assert [t.ocel_type for t in read.object_tables] == list(OBJECT_TYPES)
    found = {(r["ocel_id"], r["actual_value"], r["actual_python_type"]) for r in detectors.incorrect_attribute_datatype(read).collect()}
    assert found == {("pr-1", "'heavy'", "str"), ("em-1", "b'\\x00\\xff'", "bytes")}
    assert read.e2o.count() == log.e2o.count() == 7 * 12 * 6


#: Injections of the clean log and what each must add to its detector.
SEEN = [(k, i) for k, i in enumerate(inject.INJECTIONS) if i.issue in detectors.DETECTORS]


def test_there_are_as_many_injections_as_planned():
    levels = [i.level for i in inject.INJECTIONS]
    assert len(levels) == 78 and [levels.count(x) for x in ("easy", "medium", "hard")] == [15, 15, 15]


@pytest.mark.parametrize("level", ["easy", "medium", "hard"])
def test_corruption_is_detected(log, clean, level):
    bad, truth = inject.corrupt(log, level)
    after = counts(bad)
    assert all(rows for _, _, rows in truth)
    for issue, _, _ in truth:
        if issue in after:
            assert after[issue] > clean[issue], issue


def test_extra_injections_that_rules_see(log):
    for injection in inject.INJECTIONS:
        if injection.level == "extra" and injection.issue in detectors.DETECTORS:
            bad, rows = inject.inject(log, injection)
            if rows:
                assert detectors.DETECTORS[injection.issue](bad).count() >= 1, injection


def test_fixed_repairs_restore_the_log(log):
    bad = log
    for injection in inject.INJECTIONS:
        if injection.issue in ("duplicate_o2o_relations", "duplicate_e2o_relations", "o2o_self_loop") and injection.level == "easy":
            bad, _ = inject.inject(bad, injection)
    good = repair.drop_self_loops(repair.dedupe_relations(repair.dedupe_relations(bad, "e2o"), "o2o"))
    for name in ("e2o", "o2o"):
        assert sorted(map(tuple, getattr(good, name).collect())) == sorted(map(tuple, getattr(log, name).select(*getattr(good, name).columns).collect()))


def tiny(spark, **parts) -> Log:
    base = {
        "object": ([], "row_id long, ocel_id string, ocel_type string"),
        "event": ([], "row_id long, ocel_id string, ocel_type string"),
        "e2o": ([], "row_id long, ocel_event_id string, ocel_object_id string, ocel_qualifier string"),
        "o2o": ([], "row_id long, ocel_source_id string, ocel_target_id string, ocel_qualifier string"),
    }
    tables = {k: parts.pop(k, ()) for k in ("object_tables", "event_tables")}
    frames = {k: spark.createDataFrame(parts.get(k, rows), schema) for k, (rows, schema) in base.items()}
    return Log(spark, **frames, **tables)


def test_blank_types(spark):
    blanks = [None, "", "  ", "\t", "\xa0", "\x1c", " "]
    log = tiny(spark, object=[(i, f"o{i}", t) for i, t in enumerate([*blanks, "x", "​"])])
    assert detectors.missing_object_type(log).count() == len(blanks)


def test_dangling(spark):
    log = tiny(
        spark,
        object=[(1, "a", "t"), (2, "a", "s"), (3, "n", None)],
        event=[(1, "e", "x")],
        o2o=[(1, "a", "n", "q"), (2, "a", "zz", "q"), (3, "zz", "a", "q"), (4, None, "a", "q"), (5, None, None, None)],
        e2o=[(1, "e", "a", "q"), (2, "zz", "a", "q"), (3, "e", None, "q"), (4, "zz", "zz", "q")],
    )
    found = sorted((r["ocel_source_id"] or "", r["source_type"] or "", r["missing_side"]) for r in detectors.dangling_o2o_relationship(log).collect())
    assert found == [("", "", "both"), ("", "", "source"), ("a", "s", "target"), ("zz", "", "source")]
    assert sorted(r["missing_side"] for r in detectors.dangling_e2o_relationship(log).collect()) == ["both", "event", "object"]
    assert detectors.missing_event(log).count() == 2


def test_repeats_with_nulls(spark):
    log = tiny(spark, object=[(1, "a", None), (2, "a", None), (3, None, "t"), (4, None, "s"), (5, "b", "t"), (6, "b", "t")], o2o=[(1, "a", "b", None), (2, "a", "b", None)])
    found = {r["ocel_id"]: (r["ocel_types"], r["count"]) for r in detectors.duplicate_objects_on_ids(log).collect()}
    assert found == {"a": ("", "2"), None: ("s, t", "2"), "b": ("t", "2")}
    assert detectors.duplicate_o2o_relations(log).count() == 1
    kept = repair.dedupe_ids(log, "object").object
    assert sorted(r["row_id"] for r in kept.collect()) == [1, 2, 3, 4, 5]


def test_same_attributes_count_rows(spark):
    df = spark.createDataFrame([(1, "a", "t", None, "x"), (2, "a", "t", "c", "x"), (3, "b", "t", None, None), (4, "c", "t", None, None), (5, "d", "t", None, "y")], "row_id long, ocel_id string, ocel_time string, ocel_changed_field string, v string")
    log = tiny(spark, object_tables=(TypeTable("t", "object_T", df, {"v": "TEXT"}),))
    assert sorted(r["ocel_ids"] for r in detectors.duplicate_objects_on_attributes(log).collect()) == ["a, a", "b, c"]
    assert [r["ocel_ids"] for r in detectors.duplicate_objects_on_attributes(log, distinct_ids=True).collect()] == ["b, c"]


def test_missing_object_by_prefix_and_qualifier(spark):
    none = spark.createDataFrame([], "row_id long, ocel_id string")
    tables = tuple(TypeTable(t, f"object_{t}", none, {}) for t in ("orders", "ord", "items"))
    ids = [("orders:1", "q"), ("ord:2", "q"), ("zz", "item"), ("zy", "items"), ("opaque", "q"), (None, "item")]
    log = tiny(spark, object_tables=tables, e2o=[(i, "e", o, q) for i, (o, q) in enumerate(ids)])
    found = {r["ocel_object_id"]: r["inferred_type_from_prefix"] for r in detectors.missing_object(log).collect()}
    assert found == {"orders:1": "orders", "ord:2": "ord", "zz": "items", "zy": "items"}


def test_declared_types(spark):
    rows = [("INTEGER", "integer", True), ("INTEGER", "real", False), ("REAL", "integer", True), ("REAL", "text", False), ("VARCHAR", "text", True), ("TEXT", "blob", False), ("BLOB", "blob", True), ("DATE", "blob", True), ("", "text", True)]
    df = spark.createDataFrame(rows, "d string, s string, want boolean")
    assert df.where(values.matches_declared(F.col("s"), F.col("d")) != F.col("want")).count() == 0


def test_id_shapes(spark):
    rows = [("a@b.de", "email_like"), ("o-99x", "prefixed_id_like"), (" \t12\n", "numeric_id_like"), ("\u0661\u0662", "numeric_id_like"), ("Ada Nowak", "human_name_like"), ("echo show 5", "natural_language_like"), ("ab\tcd", "opaque_token_like"), ("q7f", "opaque_token_like")]
    df = spark.createDataFrame(rows, "i string, want string")
    assert df.where(values.classify_id(F.col("i")) != F.col("want")).count() == 0


def test_coercion(spark):
    df = spark.createDataFrame([("42.0",), ("3.14",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(values.to_affinity(F.col("v"), "INTEGER")).collect()] == [42, None, None, None]
    assert [r[0] for r in df.select(values.to_affinity(F.col("v"), "REAL")).collect()] == [42.0, 3.14, None, None]


def test_apply(log):
    changed = repair.apply(log, repair.Action("update", "OBJECT_products", {"ocel_id": "pr-1"}, "weight", "9.5"))
    assert repair.frame(changed, "object_Products").where("ocel_id = 'pr-1'").first()["weight"]["d"] == 9.5
    assert repair.frame(log, "object_Products").where("ocel_id = 'pr-1'").first()["weight"]["d"] == 1.5
    made = repair.apply(log, repair.act_on("missing_object", {"ocel_object_id": "new", "inferred_type_from_prefix": "Orders"}))
    assert made.object.where("ocel_id = 'new'").count() == 1 and repair.frame(made, "object_Orders").where("ocel_id = 'new'").count() == 1
    wide = repair.apply(log, repair.act_on("missing_object_attribute", {"table": "object_Products"}, {"value": "colour", "affinity": "TEXT", "confidence": 0.9}))
    assert "colour" in repair.frame(wide, "object_Products").columns
    assert repair.apply(log, repair.Action("delete_all", "object", {"ocel_type": "items"}), dry_run=True).count() == 12
    for bad in (
        repair.Action("update", "nowhere", {}, "x", 1),
        repair.Action("update", "object", {"ocel_id": "or-1"}, "colour", 1),
        repair.Action("alter_add_column", "object", column="x"),
        repair.Action("alter_add_column", "object_Products", column="ocel_x"),
        repair.Action("alter_add_column", "object_Products", column="weight"),
        repair.Action("noop", reason="no"),
        repair.act_on("incorrect_object_type", {"ocel_id": "or-1", "ocel_type": "orders"}, {"value": "items", "confidence": 0.1}),
    ):
        with pytest.raises(repair.Refused):
            repair.apply(log, bad)
    retyped = repair.apply(log, repair.act_on("incorrect_object_type", {"ocel_id": "or-1", "ocel_type": "orders"}, {"value": "items", "confidence": 0.1}), override="items")
    assert retyped.object.where("ocel_id = 'or-1'").first()["ocel_type"] == "items"


def test_bulk_repairs_agree_with_single_ones(log):
    damaged, _ = inject.corrupt(log, "easy")
    said = {"value": "items", "confidence": 0.9}
    for issue, part in (("missing_object_type", "object"), ("duplicate_objects_on_ids", "object"), ("duplicate_o2o_relations", "o2o"), ("o2o_self_loop", "o2o")):
        found = detectors.DETECTORS[issue](damaged)
        rows = found.collect()
        assert rows
        one = damaged
        for row in rows:
            one = repair.apply(one, repair.act_on(issue, row.asDict(), said))
        all_ = batch.apply_actions(damaged, batch.plan_actions(damaged, issue, found.withColumn("value", F.lit("items"))))
        a, b = (sorted(map(str, getattr(x, part).collect())) for x in (one, all_))
        assert a == b


def test_bulk_repairs_of_awkward_rows(spark, log):
    loops = spark.createDataFrame([(None, "x", None), (None, "x", None)], "ocel_event_id string, ocel_object_id string, ocel_qualifier string")
    nulls = log.with_(e2o=log.e2o.limit(0).unionByName(loops.withColumn("row_id", F.monotonically_increasing_id())))
    done = batch.apply_actions(nulls, batch.plan_actions(nulls, "duplicate_e2o_relations", detectors.duplicate_e2o_relations(nulls)))
    assert done.e2o.count() == 1
    judged = spark.createDataFrame([("or-1", "orders", None, None), ("or-2", "orders", "orders", 0.9), ("or-3", "orders", "items", 0.2), ("or-4", "orders", "items", None), ("or-4", "orders", "customers", 0.5)], "ocel_id string, ocel_type string, value string, confidence double")
    actions = batch.plan_actions(log, "incorrect_object_type", judged)
    assert [r["reason"] for r in actions.collect()] == ["no other type", "no other type", "confidence under 0.4", None, None]
    types = {r["ocel_id"]: r["ocel_type"] for r in batch.apply_actions(log, actions).object.where("ocel_id like 'or-%'").collect()}
    assert types["or-3"] == "orders" and types["or-4"] == "customers"
    assert batch.plan_actions(log, "missing_object", detectors.missing_object(log)).count() == 0
    with pytest.raises(repair.Refused):
        batch.plan_actions(log, "unknown", judged)


def test_all_tasks_are_there():
    assert len(repair.TASKS) == 25


def test_peers_follow_the_rotation(log):
    pool = log.object.where("ocel_type in ('orders', 'items')")
    rows = [(r["ocel_id"], r["row_id"]) for r in pool.collect()]
    got = {}
    for r in sampling.sample_peers(pool.limit(4), pool, F.when(F.col("row_id") % 5 == 0, "x"), 5).collect():
        got.setdefault(r["anchor"], {})[r["place"]] = r["peer_id"]
    for anchor, places in got.items():
        seed = 0
        for c in anchor:
            seed = (seed * 131 + ord(c)) & 2147483647
        order = sorted((x for x in rows if x[0] != anchor), key=lambda x: (x[1] * 2654435761 + seed) % 2147483647)
        first = [x for x in order if x[1] % 5 == 0][:2]
        want = first + [x for x in order if x not in first]
        assert [places[k] for k in sorted(places)] == [x[0] for x in want[:5]]


def test_hints_and_fingerprint(log):
    found = profile.profile(log)
    assert not profile.hints_are_stale(found, log)
    assert profile.hints_are_stale(found, repair.add_column(log, "object_Products", "colour"))
    assert profile.select_hints(found, "products", "weight")["columns"]["object/products/weight"]["null_rate"] == 0
    assert files.load_json("/nowhere/x.json") is None


def test_evaluation(log):
    hidden, truth = evaluate.plant(log, "object_Employees", "role", 4)
    assert detectors.missing_attribute_value(hidden).count() == truth.count() == 4
    proposals = log.spark.createDataFrame([("100", "105"), ("x", " X "), ("1", "0"), (None, "5")], "proposed string, true_value string")
    got = [(r["exact"], r["within_tol"]) for r in evaluate.score(proposals).collect()]
    assert got == [(False, True), (True, True), (False, False), (False, False)]


def test_resolver_runs_in_batches(log):
    def resolver(pdf):
        return pdf.assign(value="guess", confidence=0.5)

    said = repair.resolve_with(log.object.limit(5).select("ocel_id"), resolver, "ocel_id string, value string, confidence double")
    assert {r["value"] for r in said.collect()} == {"guess"}


def test_streams(spark, log, tmp_path):
    extra = spark.createDataFrame([(10**6, "nope", "or-1", "order"), (10**6 + 1, "nope", "nope", "order")], log.e2o.schema)
    log.e2o.limit(50).unionByName(extra).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(log.e2o.schema).parquet(f"{tmp_path}/in")
    query = relations.dangling(stream, log).writeStream.format("memory").queryName("dangling").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["missing_side"] for r in spark.sql("SELECT * FROM dangling").collect()) == ["both", "event"]


def test_repeats_meet_across_window_boundaries(spark, tmp_path):
    rows = [("e", "o", "q", "00:09:30"), ("e", "o", "q", "00:10:30"), ("e", "o", None, "00:10:30"), ("e", "p", "q", "00:01:00"), ("e", "p", "q", "00:19:00"), ("f", "o", "q", "02:00:00")]
    frame = spark.createDataFrame(rows, "ocel_event_id string, ocel_object_id string, ocel_qualifier string, at string").selectExpr("* except (at)", "to_timestamp('2024-01-01 ' || at) as at")
    frame.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    query = relations.repeated(stream, "at").writeStream.format("memory").queryName("repeated").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    for got in (spark.table("repeated"), relations.repeated(frame, "at")):
        assert [(r["ocel_event_id"], r["ocel_object_id"], r["count"]) for r in got.collect()] == [("e", "o", 2)]


def test_whole_numbers_keep_their_digits(spark):
    rows = spark.createDataFrame([("9007199254740993",), ("12.0",), ("12.5",), (" 7 ",), ("9e30",)], "t string")
    assert [r[0] for r in rows.select(values.to_affinity(F.col("t"), "INTEGER")).collect()] == [9007199254740993, 12, None, 7, None]


def test_cells_with_large_integers_are_not_alike(spark):
    from logwright.log import Log, TypeTable

    row = lambda i, n, d: (i, f"a{i}", None, None, ("real" if n is None else "integer", n, d, None, None))
    cells = spark.createDataFrame([row(1, 2**53, None), row(2, 2**53 + 1, None), row(3, 5, None), row(4, None, 5.0)], f"row_id long, ocel_id string, ocel_time string, ocel_changed_field string, v {values.CELL}")
    none = spark.createDataFrame([], "row_id long, ocel_id string, ocel_type string")
    log = Log(spark, none, none, none, none, (TypeTable("a", "object_A", cells, {"v": "INTEGER"}),))
    assert [r["ocel_ids"] for r in detectors.duplicate_objects_on_attributes(log).collect()] == ["a3, a4"]


def test_reprs_are_those_of_python(spark):
    cells = [("integer", 5, None, None, None), ("real", None, 1e22, None, None), ("real", None, 0.1, None, None), ("text", None, None, "it's", None), ("text", None, None, "a\\b\n", None), ("text", None, None, "plain", None), ("text", None, None, "\u00e9", None), ("blob", None, None, None, bytearray(b"\x00x")), (None, None, None, None, None)]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], f"c {values.CELL}").select(values.python_repr(F.col("c"))).collect()]
    assert got == ["5", "1e+22", "0.1", '"it\'s"', "'a\\\\b\\n'", "'plain'", "'\u00e9'", "b'\\x00x'", "None"]


def test_an_error_of_a_resolver_stays_in_its_row(spark):
    def resolver(pdf):
        if (pdf["ocel_id"] == "b").any():
            raise ValueError("no")
        return pdf.assign(value="x")

    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "ocel_id string").coalesce(1)
    said = {r["ocel_id"]: (r["value"], r["error"]) for r in repair.resolve_with(rows, resolver, "ocel_id string, value string").collect()}
    assert said == {"a": ("x", None), "b": (None, "ValueError: no"), "c": ("x", None)}


def test_groups_of_equal_rows_need_one_to_be_named():
    row = {"object_type": "a", "ocel_ids": "a3, a4", "duplicate_count": "2", "attribute_values": "{}"}
    assert repair.act_on("duplicate_objects_on_attributes", row, {"value": "x", "confidence": 1.0}).kind == "noop"
    done = repair.act_on("duplicate_objects_on_attributes", row, {"value": "x", "confidence": 1.0, "ocel_id": "a3", "attribute": "v"})
    assert (done.kind, done.key, done.column) == ("update", {"ocel_id": "a3"}, "v")


def test_a_guide_is_checked_and_never_lost(spark, tmp_path):
    from logwright.operators import guide
    from logwright.plans.bridge import load

    found = {"fingerprint": "f", "types": {"object": {"a": 1, "b": 2}, "event": {}}, "columns": {"object/a/v": {}}, "qualifiers": [{"qualifier": "q"}]}
    said = {"domain": {"process": " sales "}, "qualifiers": {"q": "has", "z": "invented"}, "type a": {"represents": "x", "attributes": {"v": {"meaning": 3, "value_source": "events"}, "w": {}}}}
    made = guide.build_guide(found, lambda name, facts: said.get(name, {}))
    assert made["domain"] == {"process": "sales"} and made["qualifiers"] == {"q": "has"} and len(made["warnings"]) == 2
    assert made["types"]["a"]["attributes"]["v"] == {"meaning": "", "value_source": "events", "null_expected": False, "repair_hint": ""}
    assert guide.all_types(found, {"types": {"c": {}}}) == ["a", "b", "c"]

    def broken(name, facts):
        raise OSError("down")

    failed = guide.build_guide(found, broken)
    assert not guide.has_content(failed) and len(failed["warnings"]) == 3 and "stopped" in failed["warnings"][-1]
    log = load(spark, "/root/testdata/sf0.001")
    guide.explore(log, str(tmp_path), lambda name, facts: {"process": "p"} if name == "domain" else {})
    with pytest.raises(RuntimeError):
        guide.explore(log, str(tmp_path), broken)
    assert guide.load(str(tmp_path))["domain"] == {"process": "p"} and "columns" in guide.fresh_hints(log, str(tmp_path), "customers")
