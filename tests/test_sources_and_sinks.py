import hashlib

import pytest
from pyspark.sql import functions as F

from ferrolith import cli, sinks
from ferrolith.operators import masks, validation as V
from ferrolith.operators.vocabulary import Vocabulary
from ferrolith.schemas import MANIFEST_COLUMNS
from ferrolith.sources import registry, tables

ROW = {c: "x" for c in MANIFEST_COLUMNS} | dict(
    record_id="r1", image_path="a.png", specimen_id="s1", source_id="p1", source_page="3", property_table_page="4", scale_bar_um="5", property_value="410", hardness_load_kgf="1", hardness_dwell_s="10", property_scatter="", scatter_kind="unreported",
    n_measurements="5", match_relation="same_study_batch_condition", match_confidence="high", exact_physical_specimen_confirmed="false", source_annotations_present="true", modality="SEM", property_name="hardness_hv", property_unit="HV", property_source="distant",
    alloy_grade="grade/ferrous/gb_35crmo", condition="condition/quench_temper", image_sha256=hashlib.sha256(b"a").hexdigest().upper(),
)


def write_manifest(path, *rows):
    path.write_text("\n".join([",".join(MANIFEST_COLUMNS), *(",".join(r[c] for c in MANIFEST_COLUMNS) for r in rows)]) + "\n")
    return str(path)


def test_manifest(spark, tmp_path):
    assert tables.load_manifest(spark, str(tmp_path / "none.csv")).count() == 0
    other = ROW | dict(record_id="r2", image_path="b.png")
    path = write_manifest(tmp_path / "m.csv", ROW, other)
    manifest = tables.load_manifest(spark, path)
    records = tables.manifest_records(manifest).orderBy("record_ord").collect()
    assert [r.group_id for r in records] == ["literature-p1-s1"] * 2 and records[0].properties == {"hardness_hv": 410.0} and records[0].scale_um_per_px is None
    (tmp_path / "img").mkdir()
    (tmp_path / "img/a.png").write_bytes(b"a")
    (tmp_path / "img/b.png").write_bytes(b"b")
    files = tables.manifest_files(spark, str(tmp_path / "img"), manifest)
    assert [r.image_path for r in V.hash_violations(manifest, files).collect()] == ["b.png"]


@pytest.mark.parametrize("change, message", [
    (dict(exact_physical_specimen_confirmed="true"), "exact physical specimen"), (dict(source_annotations_present="yes"), "source_annotations_present"), (dict(property_value="-1"), "property_value"), (dict(n_measurements="2.5"), "n_measurements"),
    (dict(property_scatter="3"), "unreported"), (dict(image_path="../a.png"), "leaves the data folder"), (dict(image_sha256="zz"), "64 hex"), (dict(modality="TEM"), "modality"),
])
def test_bad_manifests(spark, tmp_path, change, message):
    with pytest.raises(V.ValidationError, match=message):
        tables.load_manifest(spark, write_manifest(tmp_path / "m.csv", ROW | change))


def test_panels_must_agree(spark, tmp_path):
    with pytest.raises(V.ValidationError, match="disagree"):
        tables.load_manifest(spark, write_manifest(tmp_path / "m.csv", ROW, ROW | dict(record_id="r2", image_path="b.png", property_value="9")))
    with pytest.raises(V.ValidationError, match="duplicate record_id"):
        tables.load_manifest(spark, write_manifest(tmp_path / "m.csv", ROW, ROW))


def test_adapters_and_vocabulary(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("path,taxonomy_labels\na.png,ferrous/pearlite\nb.png,grade/ferrous|nowhere\n")

    @registry.register_adapter("folder", "ferrous")
    def folder(session, config, order):
        return tables.image_folder(session, str(config.data_dir / "labels.csv"), "folder", "ferrous", order)

    config_file = tmp_path / "c.toml"
    config_file.write_text(f'data_dir = "{tmp_path}"\nadapters = ["folder", "folder"]\n')
    records = registry.all_records(spark, registry.Config.load(config_file))
    assert records.count() == 4 and {r.adapter_ord for r in records.collect()} == {0, 1}
    found = {(r.node, r.problem) for r in registry.record_violations(spark, records, Vocabulary.load()).collect()}
    assert found == {("nowhere", "taxonomy_labels: unknown"), ("grade/ferrous", "taxonomy_labels: not on microconstituent")}
    with pytest.raises(KeyError, match="folder"):
        registry.get_adapter("none")
    with pytest.raises(ValueError):
        registry.register_adapter("", "x")
    config_file.write_text("colour = 1\n")
    with pytest.raises(ValueError, match="colour"):
        registry.Config.load(config_file)


def test_listings_and_pixels(spark, tmp_path):
    assert tables.benchmark_masks(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(FileNotFoundError):
        tables.benchmark_masks(spark, str(tmp_path))
    (tmp_path / "masks").mkdir()
    for name in ("m1.png", "m2.tif", "x.txt"):
        (tmp_path / "masks" / name).write_bytes(b"-")
    assert sorted(r.stem for r in tables.benchmark_masks(spark, str(tmp_path)).collect()) == ["m1", "m2"]
    df = spark.createDataFrame([(bytearray([1, 2, 3, 4, 5, 6]), list(range(12)))], "data binary, px array<int>")
    row = df.select(masks.rgb_pixels(F.col("data")).alias("rgb"), masks.crop(F.col("px"), F.lit(4), F.lit(1), F.lit(1), F.lit(2), F.lit(2)).alias("part")).first()
    assert row.rgb == [3, 2, 1, 6, 5, 4] and row.part == [5, 6, 9, 10]


def test_heads_and_measured_labels(spark, tmp_path):
    assert sinks.load_head(str(tmp_path), "ferrous/uhcs", "hv") is None
    sinks.save_head({"weights": [1.0]}, str(tmp_path), "ferrous/uhcs", "hv")
    assert (tmp_path / "ferrous__uhcs--hv.json").exists() and sinks.load_head(str(tmp_path), "ferrous/uhcs", "hv") == {"weights": [1.0]}
    (tmp_path / "hv.csv").write_text("sample_label,hardness_hv,source_note\na,410,x\nb,n/a,\nc,nan,\n")
    assert [r.hardness_hv for r in tables.load_measured_labels(spark, str(tmp_path / "hv.csv")).collect()] == [410.0]
    assert tables.load_measured_labels(spark, str(tmp_path / "no.csv")).count() == 0


def test_cli(tmp_path, capsys, spark):
    assert cli.main(["check", str(tmp_path)]) == 0 and cli.main(["check", str(tmp_path / "none")]) == 1
    assert cli.main(["vocabulary"]) == 0 and "  ferrous/pearlite" in capsys.readouterr().out
