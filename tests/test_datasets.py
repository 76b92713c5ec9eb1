"""Data sets, settings, registries and the command line, on small files."""

import json
import os
import random

import pytest

from fathomline.__main__ import arguments, main
from fathomline.operators import datasets as D
from fathomline.operators import manifest as M
from fathomline.operators import settings as G


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("set")
    files = {
        "Detection/images/test/ai4_DM_Wilson_03.jpg": "a", "Detection/labels/train/ai4_DM_Wilson_03.txt": "0 0.5 0.5 0.1 0.1\n4 0.1 0.1 0.1 0.1\n",
        "Detection/images/val/sctd_000006.jpg": "b", "Detection/labels/val/sctd_000006.txt": "1 0.5 0.5 0.1 0.1", "Detection/images/test/odd_1.jpg": "c", "Detection/images/other/sctd_7.jpg": "x",
        "Segmentation/images/train/synth_net_1.jpg": "d", "Segmentation/labels/train/synth_net_1.txt": "1 0.1 0.1 0.2 0.2", "AnomalyScreen/normal_seabed/normal_1.jpg": "e",
    }
    for name, text in files.items():
        os.makedirs(os.path.dirname(root / name), exist_ok=True)
        (root / name).write_text(text)
    return root


def test_manifests_from_files(spark, root):
    images, labels = D.listed(spark, str(root), "*.jpg"), D.label_files(spark, str(root))
    paths = [x.path for x in images.collect()]
    assert paths == sorted(paths) and len(paths) == 6
    rows = {x.image_path.rsplit("/", 1)[1]: x for x in D.manifests(images, labels, f"file:{root}").collect()}
    assert len(rows) == 5
    one = rows["ai4_DM_Wilson_03.jpg"]
    assert (one.component, one.source_group_id, one.provider_split, one.origin, one.classes) == ("detection", "ai4_DM_Wilson", "train", "real", "shipwreck|ghost_net")
    assert rows["odd_1.jpg"].origin == "unknown" and rows["odd_1.jpg"].classes == "" and rows["synth_net_1.jpg"].classes == "ghost_net"
    assert (rows["normal_1.jpg"].label_path, rows["normal_1.jpg"].provider_split) == ("", "unsplit")
    digests = D.with_digests(D.manifests(images, labels, f"file:{root}"), spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root)))
    assert {len(x.sha256) for x in digests.collect()} == {64}


def test_split_tree(spark, root, tmp_path):
    images, labels = D.listed(spark, str(root), "*.jpg"), D.label_files(spark, str(root))
    rows = M.hash_split(D.detection_rows(images, labels, f"file:{root}"))
    for _ in range(2):  # links that there are get replaced
        counts = D.materialized_split(rows, str(tmp_path / "tree"), M.CLASSES, "a note")
    assert sum(counts.values()) == 3
    found = [os.path.join(d, x) for d, _, files in os.walk(tmp_path / "tree") for x in files]
    assert sum("/images/" in x for x in found) == 3 and sum("/labels/" in x for x in found) == 2 and all(os.path.exists(x) for x in found)
    text = (tmp_path / "tree/data.yaml").read_text()
    assert text.startswith("# a note\n") and G.load_yaml(str(tmp_path / "tree/data.yaml"))["nc"] == 5
    assert "nc" not in D.data_file("t", None)


def test_seeded_split_by_definition():
    names = [f"g{i}" for i in range(40)]
    shuffled = sorted(names)
    random.Random(7).shuffle(shuffled)
    assert M.seeded_split(names * 2, 7) == {x: "train" if i < 28 else "val" if i < 34 else "test" for i, x in enumerate(shuffled)}


def test_settings(tmp_path):
    path = tmp_path / "c.yaml"
    with pytest.raises(FileNotFoundError):
        G.load_yaml(str(path))
    path.write_text("")
    assert G.load_yaml(str(path)) == {}
    path.write_text("- 1")
    with pytest.raises(ValueError):
        G.load_yaml(str(path))
    path.write_text("a: 1\nb:\n  threshold: 0.1  # old\nc:\n  threshold: 5\n")
    G.write_threshold(str(path), "threshold", 0.4567)
    assert path.read_text() == "a: 1\nb:\n  threshold: 0.457\nc:\n  threshold: 5\n"
    assert G.config_hash({"a": 1, "b": [2]}) == G.config_hash({"b": [2], "a": 1}) != G.config_hash({"a": 2, "b": [2]})
    made = G.provenance("m", "1", None)
    assert made == {"model_name": "m", "model_version": "1", "config_hash": "none"} and "extra" in G.provenance("m", "1", {}, x=1)
    pydantic = pytest.importorskip("pydantic")
    model = pydantic.create_model("C", a=(int, ...), b=(dict, ...), c=(dict, ...))
    assert G.load_config(str(path), model).a == 1
    assert len(G.logger().handlers) == len(G.logger().handlers) == 1


def test_registry(tmp_path):
    registry = str(tmp_path / "models/registry.json")
    with pytest.raises(FileNotFoundError):
        G.registered(registry, "m", "1", str(tmp_path / "none.onnx"))
    bad = tmp_path / "bad.onnx"
    bad.write_bytes(b"no model")
    with pytest.raises(ValueError, match="failed to load"):
        G.registered(registry, "m", "1", str(bad))
    os.makedirs(os.path.dirname(registry))
    with open(registry, "w") as f:
        json.dump({"m": {"onnx_path": "x.onnx"}}, f)
    assert G.model_path(registry, "m") == "x.onnx"
    with pytest.raises(KeyError):
        G.model_path(registry, "other")


def test_registry_entry_of_a_model_that_loads(tmp_path, monkeypatch):
    model = tmp_path / "m.onnx"
    model.write_bytes(b"weights")
    monkeypatch.setattr(G, "validated_model", lambda path: (["in"], ["out"]))
    registry = str(tmp_path / "r.json")
    G.registered(registry, "b", "1", str(model))
    entry = G.registered(registry, "a", "2", str(model), "set", "m.json", date="2024-01-01")
    assert entry == G.read_registry(registry)["a"] and len(entry["sha256"]) == 64 and entry["inputs"] == ["in"] and list(G.read_registry(registry)) == ["a", "b"]
    assert set(entry) == {"version", "onnx_path", "sha256", "trained_on", "metrics_file", "date", "inputs", "outputs"}


def test_command_line(spark, root, tmp_path):
    assert arguments(["preprocess", "x.xtf", "--save-steps", "s"]).save_steps == "s"
    assert main(["manifest", str(root), str(tmp_path / "out")]) == 0
    rows = M.read_manifest(spark, str(tmp_path / "out/detection"))
    assert rows.count() == 3 and {x.split for x in rows.collect()} <= {"train", "val", "test"}


def test_detector_boxes_reach_the_square_at_any_height(spark):
    sizes = [(77, 64), (64, 77), (154, 303), (581, 616), (100, 100), (1, 1)]
    images = spark.createDataFrame([(f"{h}x{w}", h, w, bytes(h * w)) for h, w in sizes], "tile string, height int, width int, data binary")
    found = D.detector_boxes(images, lambda x: [(0, x.shape[0] // 2, x.shape[1], x.shape[0], "all", 1.0)]).collect()
    assert sorted((x.tile, x.x1, x.y1, x.x2, x.y2) for x in found) == sorted((f"{h}x{w}", 0, h // 2 * 640 // h, 640, 640) for h, w in sizes)
