"""Readers, headers, writers and the incremental index."""

import io
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaitloom.sinks import publish as K
from gaitloom.sources import files, jsonl
from gaitloom.streaming import incremental


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n\n", encoding="utf-8")
    return str(path)


def test_jsonl(spark, tmp_path):
    path = lines(tmp_path / "index.jsonl", [{"dataset": "interx", "motion_id": "a", "captions": ["走 "], "object_id": "o1", "extra": 1}, {"dataset": "", "motion_id": "b"}, {"dataset": "interx", "motion_id": "c", "captions": [" "], "object_id": " "}])
    assert [r.motion_id for r in jsonl.asset_index(spark, path).orderBy("record_id").collect()] == ["a", "c"]
    assert [r.captions for r in jsonl.classification_entries(spark, path).collect()] == [["走"]]
    (tmp_path / "bad.jsonl").write_text('{"dataset": "x", "motion_id": \n')
    (tmp_path / "bad.jsonl").write_text('{"dataset": "x", "motion_id": "a"}\n{"dataset": "x", "motion_id": \n')
    with pytest.raises(ValueError, match=r"bad.jsonl:2: "):
        jsonl.asset_index(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "parts").mkdir()
    for name, size in (("c", 3), ("a", 4000), ("b", 40)):
        lines(tmp_path / f"parts/{name}.jsonl", [{"object_id": f"o{k % 3}", "classification": {"taxonomy_version": f"{name}{k}"}} for k in range(size)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        held = {r.object_id: r.classification.taxonomy_version for r in jsonl.assignments(spark, str(tmp_path / "parts")).collect()}
        order = [(r._file[-7:], r.classification.taxonomy_version) for r in jsonl.numbered(spark, str(tmp_path / "parts"), "object_id string, classification struct<taxonomy_version: string>", "n").orderBy("n").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert held == {"o0": "c0", "o1": "c1", "o2": "c2"}
    assert [v for f, v in order] == [f"{n}{k}" for n, size in (("a", 4000), ("b", 40), ("c", 3)) for k in range(size)]
    with pytest.raises(ValueError):
        jsonl.asset_index(spark, lines(tmp_path / "none.jsonl", [{"dataset": ""}]))
    a = lines(tmp_path / "a.jsonl", [{"object_id": "o", "classification": {"taxonomy_version": v}} for v in ("1", "2")])
    assert [r.classification.taxonomy_version for r in jsonl.assignments(spark, a).collect()] == ["2"]
    c = lines(tmp_path / "c.jsonl", [{"id": "q1", "query": "x", "split": "dev"}, {"id": "q2", "query": "y", "split": "holdout"}])
    assert [r.id for r in jsonl.cases(spark, c, "dev").collect()] == ["q1"] and jsonl.cases(spark, c).count() == 2
    (tmp_path / "cat.json").write_text(json.dumps({"schema_version": 2, "nodes": [{"id": "n", "priority": 3}]}, indent=1))
    assert jsonl.catalog(spark, str(tmp_path / "cat.json")).first().priority == 3
    (tmp_path / "src.json").write_text(json.dumps({"sources": [{"id": "s", "title": "t"}]}, indent=1))
    assert jsonl.sources(spark, str(tmp_path / "src.json")).first().title == "t"
    (tmp_path / "tree.json").write_text(json.dumps({"taxonomy": [{"major": "m", "groups": [{"name": "g", "tags": ["t"]}]}]}, indent=1))
    assert jsonl.source_tree(spark, str(tmp_path / "tree.json")).first().groups[0].tags == ["t"]


def glb(counts):
    scene = json.dumps({"accessors": [{"count": c} for c in counts], "animations": [{"samplers": [{"input": k} for k in range(len(counts))]}]}).encode()
    scene += b" " * (-len(scene) % 4)
    return b"glTF" + struct.pack("<II", 2, 20 + len(scene)) + struct.pack("<I4s", len(scene), b"JSON") + scene


def npy(array):
    out = io.BytesIO()
    np.save(out, array)
    return out.getvalue()


def roll_of(x, y, z):
    angle = float(np.sqrt(x * x + y * y + z * z))
    if angle < 1e-8:
        return 0.0
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]]) / angle
    up = (np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k) @ np.array([0.0, 1.0, 0.0])
    roll = -np.degrees(np.arctan2(up[0], up[2]))
    return 0.0 if abs(roll) < 8 else round(float(roll), 2)


def npz(**arrays):
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def test_headers(spark):
    rng = np.random.default_rng(1)
    plain = [npy(np.zeros((7, 3), np.float32)), b"junk", None, npy(np.float32(1)), npy(np.zeros((300, 70), np.float64)), npy(np.zeros((5, 2)))[:40], b""]
    got = spark.createDataFrame([(k, bytearray(b) if b is not None else None) for k, b in enumerate(plain)], "k int, content binary").select("k", files.npy_frame_count("content").alias("n")).orderBy("k").collect()
    assert [r.n for r in got] == [7, None, None, None, 300, None, None]
    scenes = [glb([3, 9, 4]), b"glTF", glb([]), None, glb([0]), glb([200, 70_000]), glb([3])[:30], b"glTF" + struct.pack("<II", 1, 20) + glb([5])[12:]]
    got = spark.createDataFrame([(k, bytearray(b) if b is not None else None) for k, b in enumerate(scenes)], "k int, content binary").select("k", files.glb_frame_count("content").alias("n")).orderBy("k").collect()
    assert [r.n for r in got] == [9, None, None, None, None, 70_000, None, None]
    archives = [npz(root_orient=np.zeros((6, 3)), pose=np.zeros((1, 2))), npz(pose=np.zeros((1, 2))), b"no archive", None]
    got = spark.createDataFrame([(k, bytearray(b) if b is not None else None) for k, b in enumerate(archives)], "k int, content binary").select("k", files.npz_frame_count("content").alias("n")).orderBy("k").collect()
    assert [r.n for r in got] == [6, None, None, None]
    turns = [rng.normal(size=3).astype(np.float32) for _ in range(20)] + [np.zeros(3, np.float32)]
    bodies = [npy(np.array([t])) for t in turns] + [npy(np.array([turns[0]], ">f4")), npy(np.array([turns[0]], np.float64)), b"junk"]
    got = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(bodies)], "k int, content binary").select("k", files.npy_preview_roll("content").alias("r")).orderBy("k").collect()
    want = [roll_of(*map(float, t)) for t in turns]
    assert np.allclose([r.r for r in got], [*want, want[0], 0.0, 0.0], atol=0.011) and any(want)


def test_roll_column_is_the_scalar_rule(spark):
    rng = np.random.default_rng(1)
    rows = [tuple(float(np.float32(v)) for v in rng.normal(size=3)) for _ in range(50)] + [(0.0, 0.0, 0.0)]
    got = [r.r for r in spark.createDataFrame(rows, "x double, y double, z double").select(files.roll_degrees(F.col("x"), F.col("y"), F.col("z")).alias("r")).collect()]
    assert np.allclose(got, [roll_of(*r) for r in rows], atol=0.011)


def test_folders(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/2.txt").write_bytes(b"\xef\xbb\xbfa  walk\r\n\r\nb\n")
    (tmp_path / "t/10.txt").write_text("")
    (tmp_path / "m").mkdir()
    for stem in ("2", "10", "x"):
        (tmp_path / f"m/{stem}.npy").write_bytes(npy(np.zeros((4, 3), np.float32)))
    captions = files.caption_files(spark, str(tmp_path / "t"))
    assert {r.stem: r.captions for r in captions.collect()} == {"2": ["a walk", "b"]}  # an empty file is no row, as a missing one
    motions = files.motion_files(spark, str(tmp_path / "m"), "*.npy", content=True)
    assert [r.stem for r in motions.orderBy(*files.numeric_order(F.col("stem"))).collect()] == ["2", "10", "x"]
    given, bare = files.with_captions(motions, captions)
    assert {r.stem for r in bare.collect()} == {"10", "x"}
    row = files.index_records(given, "motionlab", frame_count=files.npy_frame_count("content")).first()
    assert row.frame_count == 4 and row.description == "a walk" and len(row.object_id) == 64
    assert files.index_records(given.withColumn("captions", F.array().cast("array<string>")), "motionlab").first().description is None
    for folder, names in (("p", ("P1.npz", "P2.npz")), ("q", ("P1.npz",))):
        (tmp_path / "s" / folder).mkdir(parents=True)
        for n in names:
            (tmp_path / "s" / folder / n).write_bytes(b"x")
    pairs = files.paired_folders(files.motion_files(spark, str(tmp_path / "s"), "*.npz")).collect()
    assert [r.folder.rsplit("/", 1)[1] for r in pairs] == ["p"]
    lazy = motions.select(files.lazy_frames(F.lit(None).cast("int"), F.lit("motionlab"), files.npy_frame_count("content")).alias("n"), files.lazy_frames(F.lit(None).cast("int"), F.lit("interx"), F.lit(3)).alias("o")).first()
    assert lazy.n == 4 and lazy.o is None


def test_publish(spark, tmp_path):
    root = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        K.current(spark, root)
    first = K.publish(spark.range(3), root, {"fingerprint": "a"})
    K.amend_manifest(spark, root, thresholds={"high": 0.5})
    df, manifest = K.current(spark, root)
    assert df.count() == 3 and manifest["version"] == first and manifest["thresholds"] == {"high": 0.5}
    assert K.ensure(lambda: spark.range(9), spark, root, "a").count() == 3 and K.ensure(lambda: spark.range(9), spark, root, "b").count() == 9
    assert K.fingerprint(spark, root) == K.fingerprint(spark, root) != K.fingerprint(spark, root, "rules 2")
    for k in range(5):  # a reader always finds a manifest
        K.write_text(spark, f"{root}/manifest.json", json.dumps({"version": first, "k": k}))
        assert K.current(spark, root)[1]["k"] == k
    K.write_jsonl(spark.createDataFrame([("走", None)], "a string, b string"), str(tmp_path / "out"))
    assert json.loads("".join(f.read_text(encoding="utf-8") for f in (tmp_path / "out").glob("*.json"))) == {"a": "走", "b": None}
    assert K.report(spark.range(2)) == [{"id": 0}, {"id": 1}]
    with pytest.raises(ValueError):
        K.report(spark.range(5), limit=3)


def test_incremental_index_equals_the_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [{"dataset": "motionlab", "motion_id": f"m{k}", "captions": [f"a dancer walks {k}"], "object_id": f"o{k}"} for k in range(6)]
    for part in (rows[:3], rows[3:]):
        lines(source / f"{part[0]['object_id']}.jsonl", part)
        incremental.maintain(incremental.index_stream(spark, str(source)), str(tmp_path / "ix"), str(tmp_path / "ck")).awaitTermination()
    got = {(r.object_id, r.token, r.tf) for r in spark.read.parquet(str(tmp_path / "ix/postings")).collect()}
    from gaitloom.operators import entries as E, postings as P

    batch = {(r.object_id, r.token, r.tf) for r in P.postings(E.entries(jsonl.asset_index(spark, str(source)))).collect()}
    assert got == batch and len(got) > 20
    lines(source / "again.jsonl", [{"dataset": "motionlab", "motion_id": "m2", "captions": ["now it jumps"], "object_id": "o2"}])
    incremental.maintain(incremental.index_stream(spark, str(source)), str(tmp_path / "ix"), str(tmp_path / "ck")).awaitTermination()
    postings, lengths = incremental.current(spark, str(tmp_path / "ix"))
    assert lengths.count() == 6 and "jump" in {r.token for r in postings.where("object_id = 'o2'").collect()} and "2" not in {r.token for r in postings.where("object_id = 'o2'").collect()}
