import sqlite3

import pytest
from pyspark.sql import functions as F

from ferrolith.operators import audit, splits, validation as V, weak_labels as W
from ferrolith.schemas import LOOKUP_COLUMNS, canonical
from ferrolith.sources import metadata, sqlite as S, tables

SAMPLE = "sample_id long, label string, anneal_time double, anneal_time_unit string, anneal_temperature double, anneal_temp_unit string, cool_method string"
GOOD = dict(alloy_grade="grade/ferrous/aisi_1045", condition="condition/anneal", property_name="hardness_hv", value="170", unit="HV", scatter="8", scatter_kind="sd", n_measurements="4", join_confidence="high", source_citation="paper", source_url="", note="")


def samples(spark, rows):
    return spark.createDataFrame(rows, SAMPLE)


def test_audit_status_and_flags(spark):
    rows = [
        (1, "AC1 800C 90M WQ", 90.0, "M", 800.0, "C", "WQ"), (2, "AC1 800C 90M Q", 90.0, "M", 800.0, "C", "Q"), (3, "AC1 800C 90M 700C 5M", 90.0, "M", 800.0, "C", "AR"),
        (4, "AC1 970C 3H AR", 3.0, "H", 970.0, "C", "AR"), (5, "AC1 700C WQ", 5.0, "M", 700.0, "C", None), (6, "nothing", None, None, None, None, "650-1H"), (7, "AC1 970C 3H AR", 3.0, "H", 970.0, "C", "AR"),
    ]
    images = spark.createDataFrame([(i, s) for i, s in enumerate([1, 1, 2, 3, 4, 5, 7, None, 99])], "micrograph_id long, sample_key long")
    got = {r.sample_id: r for r in audit.audit_samples(samples(spark, rows), images).collect()}
    assert [got[i].status for i in range(1, 8)] == ["candidate", "blocked", "blocked", "provisional", "provisional", "blocked", "provisional"]
    assert got[2].flags == ["unspecified_quench_medium"] and got[3].flags == ["multi_step_label"] and got[4].flags == ["duplicate_sample_label"]
    assert got[6].flags == ["missing_grade", "unknown_condition", "missing_thermal_metadata", "special_cooling_code", "no_micrographs"]
    assert got[5].thermal_signature == "t700c_5m_unknown" and got[1].thermal_signature == "t800c_90m_wq"
    audited = audit.audit_samples(samples(spark, rows), images)
    total = audit.audit_summary(audited, images).first()
    assert (total.micrographs, total.linked_micrographs, total.orphan_micrographs, total.incomplete_key_micrographs) == (9, 7, 2, 2)
    exact = {r.thermal_signature: r for r in audit.exact_groups(audited).collect()}
    assert exact["t970c_3h_ar"].sample_ids == [4, 7] and exact["t970c_3h_ar"].flags == ["duplicate_sample_label"]
    assert {r.condition: r.samples for r in audit.coarse_groups(audited).collect()}["condition/austenitize/air_cool"] == 3
    assert set(audit.report_sections(audited, images)) == {"summary", "coarse", "exact"}


def test_split_groups_of_blank_labels(spark):
    meta = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (None, "b")], "sample_key long, sample_label string")
    got = {r.sample_key: r.group_id for r in audit.split_groups(meta).collect()}
    assert got == {1: "uhcs-samples-1-2", 2: "uhcs-samples-1-2", 3: "uhcs-sample-3", 4: "uhcs-sample-3", 5: "uhcs-sample-5"}


@pytest.mark.parametrize("change, rule", [
    (dict(source_citation=" "), "source_citation"), (dict(unit="HB"), "unit"), (dict(property_name="fatigue_life"), "property_name"), (dict(join_confidence="pretty sure"), "join_confidence"),
    (dict(value="nan"), "value"), (dict(value="inf"), "value"), (dict(value="0"), "value_positive"), (dict(scatter="-1"), "scatter_negative"), (dict(scatter_kind="unreported"), "scatter_reported"),
    (dict(n_measurements="2.5"), "n_measurements"), (dict(scatter="", scatter_kind="", n_measurements=""), "evidence"), ({}, None), (dict(scatter="", scatter_kind="unreported"), None),
])
def test_lookup_rules(spark, change, rule):
    row = GOOD | change
    df = spark.createDataFrame([(2, *(row[c] for c in LOOKUP_COLUMNS))], "row long, " + ", ".join(f"{c} string" for c in LOOKUP_COLUMNS))
    found = V.violations(df, V.lookup_rules()).orderBy("rule_ord").collect()
    assert (found[0].rule if found else None) == rule


def test_lookup_file(spark, tmp_path):
    path = tmp_path / "lookup.csv"
    assert tables.load_property_lookup(spark, str(path)).count() == 0
    path.write_text(",".join(LOOKUP_COLUMNS) + "\n" + ",".join(GOOD[c] for c in LOOKUP_COLUMNS) + "\n")
    row = tables.load_property_lookup(spark, str(path)).first()
    assert (row.value, row.scatter, row.n_measurements, row.row) == (170.0, 8.0, 4, 2)
    path.write_text(path.read_text() + ",".join(GOOD[c] for c in LOOKUP_COLUMNS) + "\n")
    with pytest.raises(V.ValidationError, match="rows 2 and 3"):
        tables.load_property_lookup(spark, str(path))
    path.write_text("alloy_grade\nx\n")
    with pytest.raises(V.ValidationError, match="missing columns"):
        tables.load_property_lookup(spark, str(path))


def test_join_keeps_own_values_and_floor(spark):
    entries = spark.createDataFrame([("g", "c", "hardness_hv", 170.0, "high"), ("g", "d", "hardness_hv", 90.0, "low")], "alloy_grade string, condition string, property_name string, value double, join_confidence string")
    rows = [("1", "g", "c", None), ("2", "g", "d", None), ("3", "g", None, None), ("4", "g", "c", {"hardness_hv": 1.0})]
    records = canonical(spark.createDataFrame(rows, "record_id string, alloy_grade string, condition string, properties map<string,double>").withColumns({"image_path": F.lit("-"), "modality": F.lit("SEM"), "group_id": F.lit("")}))
    low = {r.record_id: (r.properties, r.property_sources) for r in W.join_properties(records, entries).collect()}
    assert low == {"1": ({"hardness_hv": 170.0}, {"hardness_hv": "distant"}), "2": ({"hardness_hv": 90.0}, {"hardness_hv": "distant"}), "3": ({}, {}), "4": ({"hardness_hv": 1.0}, {})}
    medium = {r.record_id: r.properties for r in W.join_properties(records, entries, "medium").collect()}
    assert medium["2"] == {} and {r.group_id for r in records.collect()} == {"1", "2", "3", "4"}
    with pytest.raises(ValueError):
        W.lookup_index(entries, "certain")


def test_duplicates_and_dependencies(spark):
    df = spark.createDataFrame([(2, "a", "x"), (3, "a", "y"), (4, "b", None), (5, "b", None)], "row int, k string, v string")
    assert [(r.row, r.first_row) for r in V.duplicates(df, ["k"]).orderBy("row").collect()] == [(3, 2), (5, 4)]
    assert [r.row for r in V.dependency_violations(df, ["k"], ["v"]).collect()] == [3]


def test_previous_rows_of_a_hot_key(spark):
    """Nine of ten rows have one key; its rows lie in several ranges, and the first of each takes its predecessor from the range before."""
    rows = [(i, None if i % 30 == 7 else "hot" if i % 10 else f"k{i % 3}", None if i % 7 == 0 else f"v{i // 97}", f"w{i % 2}") for i in range(4000)]
    df = spark.createDataFrame(rows, "row long, k string, v string, w string").repartition(5)
    expected, last = set(), {}
    for i, k, v, w in rows:
        expected.add((k, i, (v, w), last.get(k)))
        last[k] = (v, w)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = V.with_previous(df, ["k"], "row", F.struct("v", "w"))
        got = [(r.k, r.row, tuple(r.value), r.before and tuple(r.before)) for r in found.collect()]
        violations = {r.row for r in V.dependency_violations(df, ["k"], ["v"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows) and set(got) == expected
    assert violations == {i for k, i, (v, _), before in expected if before and before[0] != v}
    assert V.dependency_violations(df.limit(0), ["k"], ["v"]).count() == 0


def test_sqlite_and_records(spark, tmp_path):
    path = tmp_path / "m.sqlite"
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE sample (sample_id INTEGER PRIMARY KEY, label TEXT, anneal_time REAL, anneal_time_unit TEXT, anneal_temperature REAL, anneal_temp_unit TEXT, cool_method TEXT)")
        db.execute("CREATE TABLE micrograph (micrograph_id INTEGER PRIMARY KEY, path TEXT, micron_bar REAL, micron_bar_units TEXT, micron_bar_px INTEGER, magnification REAL, detector TEXT, sample_key INTEGER, primary_microconstituent TEXT)")
        db.executemany("INSERT INTO sample VALUES (?,?,?,?,?,?,?)", [(1, "AC1 800C 90M WQ", 90.0, "M", 800.0, "C", "WQ"), (2, None, None, None, None, None, None)])
        db.executemany("INSERT INTO micrograph VALUES (?,?,?,?,?,?,?,?,?)", [(1, "micrograph1.png", 10.0, "um", 100, 500.0, "SE", 1, "pearlite+spheroidite"), (2, "micrograph2.png", 10.0, "um", 0, 500.0, "SE", 2, "odd"), (3, "micrograph3.png", None, None, None, None, "SE", None, None)])
    meta = S.load_metadata(spark, str(path))
    assert meta.count() == 3 and S.image_paths(spark, str(path)).first().path == "micrograph1.png"
    measured = spark.createDataFrame([("AC1 800C 90M WQ", 400.0, 2), ("AC1 800C 90M WQ", 410.0, 3)], "sample_label string, hardness_hv double, row int")
    masks = spark.createDataFrame([("/m/micrograph1.tif", "micrograph1")], "path string, stem string")
    got = {r.record_id: r for r in metadata.metadata_records(meta, measured, masks).collect()}
    first = got["uhcs-1"]
    assert first.properties == {"hardness_hv": 410.0} and first.property_sources == {"hardness_hv": "measured"} and first.scale_um_per_px == 0.1
    assert first.taxonomy_labels == ["ferrous/pearlite", "ferrous/spheroidite"] and first.condition.endswith("t800c_90m") and first.mask_path
    assert got["uhcs-2"].scale_um_per_px is None and got["uhcs-2"].taxonomy_labels is None and got["uhcs-3"].group_id == "uhcs-orphan-3"
    with pytest.raises(Exception, match="no such database"):
        S.read_table(spark, str(tmp_path / "none.sqlite"), "sample").count()


def test_image_folder(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text("path,taxonomy_labels,group_id,scale_um_per_px\na.png,b|a,g0,0.5\nb.png,c,,\n")
    a, b = tables.image_folder(spark, str(path), "fold", "aluminum").orderBy("record_ord").collect()
    assert (a.record_id, a.taxonomy_labels, a.group_id, a.scale_um_per_px) == ("fold-0", ["a", "b"], "fold-g0", 0.5)
    assert (b.record_id, b.group_id, b.scale_um_per_px) == ("fold-1", "fold-1", None)
    with pytest.raises(FileNotFoundError):
        tables.image_folder(spark, str(tmp_path / "no.csv"), "fold", "aluminum")


def test_splits(spark):
    records = spark.range(200).select(F.col("id"), (F.col("id") % 20).cast("string").alias("g"))
    for split in (splits.hashed_group_split(records, "g", 0.25, 0.2, 3), splits.permuted_group_split(records, "g", 0.25, 0.2, 3)):
        assert splits.straddling_groups(split, "g").count() == 0
        assert {r.split: r.n for r in split.groupBy("split").agg(F.countDistinct("g").alias("n")).collect()} == {"test": 4, "val": 5, "train": 11}
    with pytest.raises(ValueError):
        splits.check_fractions(0.5, 0.5)
