import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskframe.functions import names, poly
from maskframe.operators import ingest, split, training, validate
from maskframe.operators.raster import tiles
from maskframe.sources import images, layout, submission, synthetic
from maskframe.streaming import frames

BOX, TRIANGLE = [[10, 10, 30, 10, 30, 30, 10, 30]], [[40, 40, 50, 40, 50, 50]]


def load(spark, tmp_path, doc, files):
    (tmp_path / "ann.json").write_text(json.dumps(doc))
    listed = spark.createDataFrame([(f,) for f in files], "path string")
    return ingest.load_records(ingest.read_document(spark, str(tmp_path / "ann.json")), images.index_images(listed))


def test_annotator_before_the_frame_id(spark, tmp_path):
    doc = {"images": [{"id": i, "file_name": f"A{i}-20150125172714Mh.jpg", "height": 64, "width": 64} for i in (1, 2)],
           "annotations": [{"id": 1, "image_id": 1, "segmentation": BOX}, {"id": 2, "image_id": 2, "segmentation": BOX}, {"id": 3, "image_id": 2, "segmentation": TRIANGLE}]}
    got = sorted(load(spark, tmp_path, doc, ["x/20150125172714Mh.jpg"]).collect(), key=lambda r: r["annotator"])
    assert [(r["stem"], r["annotator"], len(r["segmentations"]), r["height"]) for r in got] == [("20150125172714Mh", "A1", 1, 64), ("20150125172714Mh", "A2", 2, 64)]


def test_annotator_inside_the_id(spark, tmp_path):
    ids = ["040301-20140609195854Bh", "040302-20140609195854Bh"]
    doc = {"images": [{"id": i, "file_name": "20140609195854Bh.jpeg", "height": 0} for i in ids], "annotations": [{"image_id": i, "segmentation": BOX[0]} for i in ids]}
    got = sorted(load(spark, tmp_path, doc, ["20140609195854Bh.jpeg"]).collect(), key=lambda r: r["annotator"])
    assert [(r["annotator"], len(r["segmentations"]), r["height"], r["width"]) for r in got] == [("040301", 1, 2048, 2048), ("040302", 1, 2048, 2048)]


def test_types_nulls_and_empty_records(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a-1.png"}, {"id": "1", "file_name": "a-2.png"}, {"id": 3, "filename": "a-3.png", "rater": 0}, {"id": 4, "file_name": "gone-9.png"}, {"file_name": "a-5.png"}],
           "annotations": [{"image_id": 1.0, "segmentation": BOX}, {"image_id": "1", "segmentation": BOX, "labeler": "Z"}, {"image_id": 3, "segmentation": []}, {"image_id": 9, "segmentation": BOX}, {"segmentation": BOX}]}
    got = {(r["stem"], r["annotator"]): len(r["segmentations"]) for r in load(spark, tmp_path, doc, [f"a-{k}.png" for k in range(1, 6)]).collect()}
    # a missing id matches missing ids; an image without an annotator but with a usable prefix has that
    assert got == {("1", "a"): 1, ("2", "Z"): 1, ("3", "0"): 0, ("5", "a"): 1}


def test_segmentation_layouts(spark):
    cases = ["[[0,0,10,0,10,10]]", "[0,0,10,0,10,10]", "[[0,0],[10,0],[10,10]]", '{"size":[8,8],"counts":[10,5,49]}', '{"size":[8,8],"counts":"abc"}', "[]", "[[1,2,3]]", "{}"]
    got = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, c string").select("k", poly.variant_segmentation(F.parse_json("c")).alias("s")).orderBy("k").collect()
    ring = [[0.0, 0.0, 10.0, 0.0, 10.0, 10.0]]
    assert [r["s"] and r["s"]["polys"] for r in got[:3]] == [ring] * 3
    assert got[3]["s"]["counts"] == [10, 5, 49] and got[4]["s"]["text"] == "abc" and all(r["s"] is None for r in got[5:])
    runs = spark.createDataFrame([(json.dumps(BOX),)], "c string").select(poly.to_runs(poly.variant_segmentation(F.parse_json("c")), F.lit(64), F.lit(64)).alias("r")).first()["r"]
    assert sum(x["e"] - x["s"] for x in runs) == 400


def test_names(spark):
    rows = [("d/A1-20150125172714Mh.jpg",), ("20150125172714Mh.tar.gz",), ("x-y-z.png",), ("plain",), ("abc-.jpg",), (".hidden",)]
    got = [r[0] for r in spark.createDataFrame(rows, "p string").select(names.image_stem(F.col("p"))).collect()]
    assert got == ["20150125172714Mh", "20150125172714Mh", "z", "plain", None, ".hidden"]
    one = spark.range(1).select(names.instance_stem(F.lit("a_b_12")).alias("s"), names.instance_number(F.lit("a_b_12")).alias("n"), names.instance_stem(F.lit("a_b")).alias("x"), names.number_list(F.lit("0.3, ,1,")).alias("l"), names.shortened(F.struct(F.lit("y" * 500).alias("k"))).alias("j")).first()
    assert (one["s"], one["n"], one["x"], one["l"]) == ("a_b", 12, None, [0.3, 1.0]) and len(one["j"]) == 404
    times = spark.range(1).select(names.frame_time(F.lit("20150125172714Mh")).cast("string").alias("t"), names.frame_name(F.timestamp_seconds(F.lit(0)), F.lit("B")).alias("f")).first()
    assert times["t"] == "2015-01-25 17:27:14" and times["f"] == "19700101000000Bh"


def test_submission_round_trip_and_checks(spark, tmp_path):
    rows = spark.createDataFrame([("a_2", "0\\`5"), ("a_1", "T2"), ("b-c_10", "x"), ("b-c_9", "y")], "filament_id string, segmentation_rle string")
    assert submission.write_submission(rows, f"{tmp_path}/s") == 4
    back = [tuple(r) for r in submission.read_submission(spark, f"{tmp_path}/s/part-*.txt").collect()]
    assert back == [("a_1", "T2"), ("a_2", "0\\`5"), ("b-c_9", "y"), ("b-c_10", "x")]
    assert {r["image"]: r["counts"] for r in submission.by_image(rows).collect()} == {"a": ["T2", "0\\`5"], "b-c": ["y", "x"]}
    with pytest.raises(Exception, match="illegal character"):
        submission.write_submission(spark.createDataFrame([("a_1", 'q"')], rows.schema), f"{tmp_path}/t")
    (tmp_path / "bad.csv").write_text("id,rle\na_1,x\n")
    with pytest.raises(Exception, match="unexpected header"):
        submission.read_submission(spark, f"{tmp_path}/bad.csv").collect()
    (tmp_path / "good.csv").write_text("filament_id,segmentation_rle\n\na_1,x,y\n\n")
    assert [tuple(r) for r in submission.read_submission(spark, f"{tmp_path}/good.csv").collect()] == [("a_1", "x,y")]
    known = spark.createDataFrame([("a",), ("z",)], "image string")
    assert [r["image"] for r in validate.undetected(rows, known).collect()] == ["z"]
    assert submission.summary(known, rows, model="m").first().asDict() == {"images": 2, "rows": 2, "undetected": ["z"], "model": "m"}
    with pytest.raises(Exception, match="no instance"):
        submission.summary(known, rows.limit(0)).collect()
    submission.write_json(submission.summary(known, rows), f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 1


def test_valid_submission_has_no_violation(spark):
    made = synthetic.frames(spark, 3, 64).where("annotator = 'A1'")
    rows = made.select(names.instance_id(F.col("stem"), F.col("n")).alias("filament_id"), F.col("counts").alias("segmentation_rle"))
    assert rows.count() > 3 and validate.violations(rows, made.select(F.col("stem").alias("image")).distinct(), 64, 64).count() == 0


def test_split_keeps_months_whole(spark):
    stems = [(f"2015{m:02d}{d:02d}000000Bh",) for m in range(1, 11) for d in range(1, 4)]
    got = split.split_stems(spark.createDataFrame(stems, "stem string"), "stem").collect()
    months = {s: {r["stem"][:6] for r in got if r["split"] == s} for s in ("train", "val")}
    assert len(got) == 30 and not months["train"] & months["val"] and 4 <= sum(r["split"] == "val" for r in got) <= 6
    alone = split.split_stems(spark.createDataFrame(stems[:3], "stem string"), "stem").collect()
    assert sorted(r["split"] for r in alone) == ["train", "val", "val"]


def test_layout(tmp_path, monkeypatch):
    monkeypatch.delenv(layout.VARIABLE, raising=False)
    base = tmp_path / "in" / "set" / "sub"
    for d in (layout.TRAIN, layout.TEST):
        (base / d).mkdir(parents=True)
    for f in ("z.json", "test_annotations.json", "train_annotations_long.json", "train_annotations.json"):
        (base / f).write_text("{}")
    assert layout.find_root(places=(str(tmp_path / "in"),)) == tmp_path / "in" / "set"
    assert layout.find_root(str(base)) == base
    # a folder's name ranks nothing
    odd = tmp_path / "train_annotation_set"
    (odd / "sub").mkdir(parents=True)
    for f in (odd / "a.json", odd / "sub" / "train_annotations.json"):
        f.write_text("{}")
    assert layout.find_annotations(odd).name == "train_annotations.json"
    paths = layout.resolve(base)
    assert paths.annotations.name == "train_annotations.json" and paths.test_images == base / layout.TEST
    with pytest.raises(FileNotFoundError):
        layout.find_root(places=(str(tmp_path / "none"),))
    monkeypatch.setenv(layout.VARIABLE, str(base))
    assert layout.find_root() == base


def test_first_annotations_as_a_table(spark):
    paths = ["train_annotation_set/a.json", "x/b/Train_annotation.json", "x/b-/train_Annotation.json", "annotation_of_trains.json", "x/annotation.json", "t.json"]
    for k in range(len(paths)):
        own = paths[k:]
        assert layout.first_annotations(spark.createDataFrame([(p,) for p in own], "path string")).first()["path"] == min(own, key=layout.annotation_rank)


def test_violations_of_odd_rows(spark):
    good = "0" * 0 + "T2"
    rows = [("a_1", None), ("a_1", None), ("a_99999999999999999999", good), (None, good), ("plain", "1,2"), ("b_1", "")]
    known = spark.createDataFrame([("a",), ("a",)], "image string")
    got = sorted((r["rule"], r["image"] or "", r["detail"] or "") for r in validate.violations(spark.createDataFrame(rows, "filament_id string, segmentation_rle string"), known, 8, 8).collect())
    broken = [("undecodable", i, d) for i, d in (("a", "a_1"), ("a", "a_1"), ("a", "a_99999999999999999999"), ("", ""), ("", "plain"), ("b", "b_1"))]
    assert got == sorted([*broken, ("duplicate_id", "a", "a_1"), ("bad_id", "", ""), ("bad_id", "", "plain"), ("illegal_characters", "", "plain"), ("unknown_image", "b", "b_1")])
    assert spark.range(1).select(names.instance_number(F.lit("a_99999999999999999999")).alias("n"), names.instance_stem(F.lit("a_99999999999999999999")).alias("s")).first() == (None, "a")


def test_image_files_and_stream(spark, tmp_path):
    folder = tmp_path / "img"
    (folder / "deep").mkdir(parents=True)
    x = np.arange(35, dtype=np.uint8).reshape(5, 7)
    (folder / "A-20150125172714Mh.png").write_bytes(images.png(x))
    (folder / "b.PNG").write_bytes(images.png(x[:2]))
    (folder / "notes.txt").write_text("no")
    (folder / "deep" / "c.png").write_bytes(images.png(x))
    listed = images.list_images(spark, str(folder))
    assert [r["path"].rsplit("/", 1)[1] for r in listed.collect()] == ["A-20150125172714Mh.png", "b.PNG"]
    got = images.read_images(spark, f"{folder}/*.png").collect()
    assert [(r["height"], r["width"]) for r in got] == [(5, 7)] and bytes(got[0]["pixels"]) == x.tobytes()
    labels = np.pad(np.ones((3, 3), int), ((1, 1), (1, 3)))
    drawn = images.outlined(x, labels)
    assert drawn.shape == (5, 7, 3) and (drawn[2, 2] == x[2, 2]).all() and tuple(drawn[1, 1]) == images.PALETTE[0]
    (folder / "broken.png").write_bytes(b"nothing")
    with pytest.raises(Exception, match="not an image"):
        images.read_images(spark, f"{folder}/broken.png").collect()
    (folder / "broken.png").unlink()
    q = frames.run(frames.image_stream(spark, str(folder)), lambda b: b.select("stem", F.length("content").alias("n")), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(60)
    assert sorted(r["stem"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["20150125172714Mh", "b"]


def test_best_checkpoint_crops_and_tiles(spark):
    log = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.7), (4, 0.6), (5, 0.8)], "epoch int, dice double")
    assert [r["epoch"] for r in training.best_checkpoint(log, "epoch", "dice").orderBy("epoch").collect()] == [1, 3, 5]
    one = spark.createDataFrame([("f", 1024, 600)], "stem string, h int, w int")
    got = {(r["ty"], r["tx"]) for r in tiles(one, F.col("h"), F.col("w"), 512, 128).collect()}
    assert got == {(y, x) for y in (0, 384, 512) for x in (0, 88)}


def test_synthetic_rows_don_t_depend_on_partitions(spark):
    a, b = synthetic.frames(spark, 4, 64).collect(), synthetic.frames(spark, 4, 64).repartition(2).collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) and {r["annotator"] for r in a} == {"A1", "A2", "A3"}
