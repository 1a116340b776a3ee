from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from maskframe.operators import ingest
from maskframe.operators.panoptic import PostConfig, grid
from maskframe.plans import stages
from maskframe.sources import images, layout, synthetic

SIDE = 96


def test_from_files_to_a_checked_submission(spark, tmp_path):
    def dark_on_bright():
        """Logits of places that are darker than the frame's own mean; frames come normalised."""
        return lambda x: -4 * (np.asarray(x) + 0.9)

    folder = str(tmp_path / "data")
    Path(folder).mkdir()
    synthetic.write_dataset(spark, folder, 4, SIDE)
    paths = layout.resolve(layout.find_root(folder))
    frames = images.read_images(spark, f"{paths.train_images}/*.png").cache()
    files = images.index_images(frames.select("path"))
    records = ingest.load_records(ingest.read_document(spark, str(paths.annotations)), files).cache()
    seen = stages.inspect(records).first()
    assert seen["frames"] == 4 and seen["annotators"] == 3 and seen["least"] >= 1
    configs = grid((0.4, 0.6), (5, 20), (0, 1))
    scored = stages.tune(frames, records, dark_on_bright, configs, scale=1.0, tile=64, overlap=16).collect()
    assert len(scored) == len(configs) and scored[0]["pq"] > 0.1 and all(a["pq"] >= b["pq"] for a, b in zip(scored, scored[1:]))
    best = configs[scored[0]["config"]]
    summary = stages.predict(frames, dark_on_bright, best, f"{tmp_path}/sub", scale=1.0, tile=64, overlap=16).first()
    assert summary["images"] == 4 and summary["rows"] > 4
    assert stages.check(f"{tmp_path}/sub", frames, SIDE, SIDE).count() == 0
    made = stages.frame_instances(frames, dark_on_bright, [best], 1.0, tile=64, overlap=16)
    drawn = stages.drawings(frames, made).collect()
    assert len(drawn) == 4 and all(bytes(r["png"]).startswith(b"\x89PNG") for r in drawn)
    panels = stages.drawings(frames, made, records).collect()
    assert len(panels) == 4 and all(int.from_bytes(bytes(r["png"])[16:20], "big") == 3 * SIDE for r in panels)


def test_truth_scores_itself(spark):
    rows = synthetic.frames(spark, 2, 64)
    seg = F.struct(F.lit(None).cast("array<array<double>>").alias("polys"), F.lit(None).cast("array<int>").alias("counts"), F.col("counts").alias("text"))
    records = rows.groupBy("stem", "annotator").agg(F.first("h").alias("height"), F.first("w").alias("width"), F.collect_list(seg).alias("segmentations"))
    truth = stages.truth_spans(records)
    pred = truth.withColumnRenamed("truth", "pred")
    from maskframe.operators import panoptic

    keys = ["stem", "annotator"]
    total = panoptic.pooled(panoptic.statistics(panoptic.match(panoptic.iou(pred, truth, keys), keys), pred, truth, keys), []).first()
    assert total["pq"] == 1.0 and total["fp"] == total["fn"] == 0 and PostConfig().min_area == 150


def test_working_set_and_dice(spark, tmp_path):
    synthetic.write_dataset(spark, str(tmp_path), 3, 64)
    frames = images.read_images(spark, f"{tmp_path}/{layout.TRAIN}/*.png")
    files = images.index_images(frames.select("path"))
    records = ingest.load_records(ingest.read_document(spark, f"{tmp_path}/train_annotations.json"), files)
    working = stages.working_set(frames, records, 1.0)
    rows = {r["stem"]: r for r in working.collect()}
    shares = {}
    for r in stages.truth_spans(records).collect():
        shares.setdefault(r["stem"], {}).setdefault(r["annotator"], np.zeros(64 * 64))[r["s"] : r["e"]] = 1
    raters = {r["stem"]: r["n"] for r in records.groupBy("stem").agg(F.count_distinct("annotator").alias("n")).collect()}
    assert set(rows) == set(raters)
    for stem, r in rows.items():
        target = np.frombuffer(r["target"], "<f2").reshape(64, 64)
        want = sum(shares[stem].values()) / raters[stem]
        assert np.allclose(target, want.reshape(64, 64).T, atol=1e-3) and np.frombuffer(r["x"], "<f2").size == 64 * 64
    good = stages.pooled_dice(working, lambda: lambda x: -4 * (np.asarray(x) + 0.9), tile=64, overlap=16).first()["dice"]
    none = stages.pooled_dice(working, lambda: lambda x: np.full(np.shape(x), -9.0), tile=64, overlap=16).first()["dice"]
    both = total = 0
    for r in rows.values():  # a scorer that looks at one place at a time: tiles and blending change nothing
        x, target = (np.frombuffer(r[c], "<f2").astype(np.float32) for c in ("x", "target"))
        both, total = both + ((x <= -0.9) & (target >= 0.5)).sum(), total + (x <= -0.9).sum() + (target >= 0.5).sum()
    assert abs(good - 2 * both / total) < 0.01 and good > 0 and none == 0 and stages.pooled_dice(working.limit(0), lambda: lambda x: x).first()["dice"] == 1


def test_stages_as_commands(spark, tmp_path):
    from maskframe.operators.training import UNet
    from maskframe.plans import job
    from maskframe.sources import runs

    data, run = f"{tmp_path}/data", f"{tmp_path}/run"
    Path(data).mkdir()
    go = lambda *a: job.main([*map(str, a)], spark)
    assert go("synthesize", "--out", data, "--n", 3, "--size", 48) == 0
    runs.save_weights(spark, f"{run}/weights", UNet(2, 2).weights())
    tiles = ("--scale", 1, "--tile", 48, "--overlap", 8)
    assert go("inspect", "--data-root", data) == 0 and go("split", "--data-root", data, "--run", run, "--val-frac", 0.4) == 0
    assert go("tune", "--data-root", data, "--run", run, *tiles, "--thresholds", "0.3, ,0.5", "--min-areas", "5", "--merge-dists", "0,2") == 0
    config = runs.load_config(spark, f"{run}/postprocess")
    assert config.threshold in (0.3, 0.5) and config.min_area == 5 and config.merge_dist in (0, 2)
    assert go("draw", "--data-root", data, "--run", run, *tiles, "--n", 1, "--out", f"{tmp_path}/png") == 0
    assert spark.read.parquet(f"{tmp_path}/png").count() == 1
    wrong = tmp_path / "wrong"
    wrong.mkdir()
    (wrong / "part-0.txt").write_text("filament_id,segmentation_rle\nnobody_1,T2\n")
    assert go("check", "--data-root", data, "--file", wrong) == 1
