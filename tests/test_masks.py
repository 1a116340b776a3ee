import numpy as np
import pytest
from pyspark.sql import functions as F

from maskframe.functions import poly, rle
from maskframe.operators import components as c
from maskframe.operators import panoptic
from maskframe.operators import raster
from maskframe.operators import spans as sp
from maskframe.operators.panoptic import PostConfig


def spans_of(masks: dict) -> list:
    """(key, s, e) of one-dimensional masks."""
    return [(k, int(s), int(e)) for k, m in masks.items() for s, e in zip(*np.where(np.diff(np.concatenate(([0], m.astype(int), [0]))) != 0)[0].reshape(-1, 2).T, strict=True)]


def pixels_of(df, *keys):
    return {(*(r[k] for k in keys), x) for r in df.collect() for x in range(r["s"], r["e"])}


@pytest.mark.parametrize("seed", range(3))
def test_span_algebra_against_pixels(spark, seed):
    r = np.random.default_rng(seed)
    rows = [(int(k), int(s), int(s + n), int(w)) for k, s, n, w in zip(r.integers(0, 6, 80), r.integers(0, 90, 80), r.integers(0, 12, 80), r.integers(0, 3, 80))]
    a = spark.createDataFrame(rows[:40], "k long, s long, e long, w long")
    b = spark.createDataFrame(rows[40:], "k long, s long, e long, w long")
    pa, pb = pixels_of(a, "k"), pixels_of(b, "k")
    for parts in (1, 7):
        x, y = a.repartition(parts), b.repartition(parts)
        assert pixels_of(sp.union(x, ["k"]), "k") == pa
        assert pixels_of(sp.intersection(x, y, ["k"], bucket=7), "k") == pa & pb
        frames = a.select("k").distinct().withColumn("size", F.lit(110).cast("long"))
        assert pixels_of(sp.complement(x, frames, ["k"]), "k") == {(k, p) for k in {q[0] for q in rows[:40]} for p in range(110)} - pa
        assert {(r["k"], r["area"]) for r in sp.area(sp.union(x, ["k"]), ["k"]).collect()} == {(k, sum(1 for q in pa if q[0] == k)) for k, _ in pa}
    doubled = {k for k in range(6) for p in range(110) if sum(1 for q in rows[:40] if q[0] == k and q[1] <= p < q[2]) > 1}
    assert {r["k"] for r in sp.overlapping(a, ["k"]).collect()} == doubled
    raters = {}
    for k, _, _, w in rows[:40]:
        raters.setdefault(k, set()).add(w)
    share = {(r["k"], p): r["share"] for r in sp.soft_target(a, a, ["k"], "w").collect() for p in range(r["s"], r["e"])}
    want = {(k, p): len({w for q, s, e, w in rows[:40] if q == k and s <= p < e}) / len(raters[k]) for k, p in pa}
    assert share.keys() == want.keys() and all(abs(share[q] - want[q]) < 1e-12 for q in want)


def test_union_of_equal_spans(spark):
    """Which of two equal spans comes first makes no difference, however rows are dealt."""
    rows = [(k, s, e) for k in range(300) for s, e in ((1, 10), (50, 71), (50, 71), (50, 60), (71, 80), (71, 80))]
    for parts in (1, 7):
        got = sorted(tuple(r) for r in sp.union(spark.createDataFrame(rows, "k int, s long, e long").repartition(parts), ["k"]).collect())
        assert got == [(k, s, e) for k in range(300) for s, e in ((1, 10), (50, 80))]


def test_overlap_lengths_don_t_double_at_bucket_edges(spark):
    a, b = spark.createDataFrame([(1, 1, 0, 100)], "k int, p int, s long, e long"), spark.createDataFrame([(1, 9, 5, 95)], "k int, t int, s long, e long")
    assert [r["inter"] for r in sp.overlaps(a, b, ["k"], ["p"], ["t"], bucket=10).collect()] == [90]
    plan = sp.overlaps(a, b, ["k"], ["p"], ["t"])._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("seed", range(4))
def test_rle_round_trip(seed):
    r = np.random.default_rng(seed)
    for _ in range(60):
        h, w = r.integers(1, 40, 2)
        m = r.random((h, w)) < r.choice([0, 0.05, 0.5, 1])
        text = rle.encode(m)
        assert (rle.decode(text, h, w) == m).all() and all(48 <= ord(x) <= 111 for x in text)
    block = np.zeros((64, 48), bool)
    block[5:20, 10:30] = True
    assert (rle.decode(rle.encode(block), 64, 48) == block).all()


def test_rle_columns_and_broken_texts(spark):
    good = rle.text_of([10, 5, 49])
    rows = [(good,), (None,), ("",), (good[:-1] + "o",), ("é",), (rle.text_of([64]),), (rle.text_of([0, 64]),)]
    got = spark.createDataFrame(rows, "t string").select(rle.rle_decode(F.col("t"), F.lit(8), F.lit(8)).alias("r")).collect()
    assert [None if x["r"] is None else [(y["s"], y["e"]) for y in x["r"]] for x in got] == [[(10, 15)], None, None, None, None, [], [(0, 64)]]
    runs = spark.createDataFrame([([10, 5, 3, 2, 44],), ([64],), ([0, 64],)], "c array<int>").select(rle.runs_from_counts(F.col("c")).alias("r")).collect()
    assert [[tuple(y) for y in x["r"]] for x in runs] == [[(10, 15), (18, 20)], [], [(0, 64)]]


def test_polygons():
    box = [10, 10, 30, 10, 30, 30, 10, 30]
    runs = poly.ring_runs(box, 64, 64)
    m = np.zeros(64 * 64, bool)
    for s, e in runs:
        m[s:e] = True
    want = np.zeros((64, 64), bool)
    want[10:30, 10:30] = True
    assert (m.reshape(64, 64).T == want).all()
    triangle = sum(e - s for s, e in poly.ring_runs([40, 40, 50, 40, 50, 50], 64, 64))
    assert 40 <= triangle <= 60
    assert poly.segmentation_runs([box, [0, 0, 1]], None, None, 64, 64) == runs and poly.segmentation_runs([[0, 0, 1]], None, None, 64, 64) is None
    assert poly.segmentation_runs(None, [10, 5, 49], None, 8, 8) == [(10, 15)] and poly.segmentation_runs(None, [1], None, 8, 8) is None
    assert poly.segmentation_runs(None, None, rle.text_of([10, 5, 49]), 8, 8) == [(10, 15)]


def flood(mask):
    """Labels by their smallest column-major offset, by flood fill."""
    out, n = np.zeros(mask.shape, int), 0
    for x in range(mask.shape[1]):
        for y in range(mask.shape[0]):
            if mask[y, x] and not out[y, x]:
                n += 1
                todo = [(y, x)]
                out[y, x] = n
                while todo:
                    a, b = todo.pop()
                    for p in range(max(0, a - 1), min(mask.shape[0], a + 2)):
                        for q in range(max(0, b - 1), min(mask.shape[1], b + 2)):
                            if mask[p, q] and not out[p, q]:
                                out[p, q] = n
                                todo.append((p, q))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_components_against_flood_fill(seed):
    r = np.random.default_rng(seed)
    for _ in range(80):
        m = r.random(r.integers(1, 20, 2)) < r.choice([0.2, 0.5, 0.8])
        assert (c.raster_labels(m) == flood(m)).all()


def test_post_processing_facts():
    prob = np.zeros((64, 64))
    prob[5:20, 5:20], prob[40:60, 30:50], prob[30, 60] = 0.9, 0.8, 0.99
    assert c.instances(prob, None, PostConfig(0.5, 10)).max() == 2
    two = np.zeros((40, 40))
    two[5:15, 5:15], two[5:15, 19:30] = 0.9, 0.9
    assert c.instances(two, None, PostConfig(0.5, 1)).max() == 2 and c.instances(two, None, PostConfig(0.5, 1, 5)).max() == 1
    assert c.instances(two, np.zeros((40, 40), bool), PostConfig(0.5, 1)).max() == 0
    assert c.instances(two, np.zeros((40, 40), bool), PostConfig(0.5, 1, use_disk=False)).max() == 2
    kept = c.filter_components(np.array([[1, 1, 0, 2, 0, 3, 3, 3]]), 1, 2)
    assert kept.tolist() == [[1, 1, 0, 0, 0, 2, 2, 2]]
    assert PostConfig.of({"threshold": 0.3, "unknown": 1}) == PostConfig(0.3)
    assert len(panoptic.grid()) == 36


def test_span_dilation_equals_pixel_dilation(spark):
    r = np.random.default_rng(2)
    for reach in (1, 2, 3):
        m = r.random((12, 15)) < 0.1
        rows = [(0, s, e) for _, s, e in spans_of({0: m.T.ravel()})]
        got = pixels_of(sp.dilate(spark.createDataFrame(rows, "k int, s long, e long"), ["k"], 12, 15, reach), "k")
        assert {p for _, p in got} == set(np.flatnonzero(c.grown(m, reach).T.ravel()).tolist())


def test_elliptic_kernels():
    """Row by row, as OpenCV's ellipse."""
    five = ["..#..", "#####", "#####", "#####", "..#.."]
    seven = ["...#...", ".#####.", "#######", "#######", "#######", ".#####.", "...#..."]
    for reach, want in ((2, five), (3, seven)):
        dot = np.zeros((9, 9), bool)
        dot[4, 4] = True
        got = c.grown(dot, reach)[4 - reach : 5 + reach, 4 - reach : 5 + reach]
        assert ["".join(".#"[int(x)] for x in row) for row in got] == want
    # a gap of four rows closes at reach 5, as does one of four columns
    gap = np.zeros((100, 100))
    gap[40:45, 10:30] = gap[40:45, 34:60] = 0.9
    for prob in (gap, gap.T):
        assert c.instances(prob, None, PostConfig(0.5, 10)).max() == 2 and c.instances(prob, None, PostConfig(0.5, 10, 5)).max() == 1


def test_raster_instances_with_a_disk(spark):
    r = np.random.default_rng(4)
    rows, configs = [], [PostConfig(0.5, 2, 0, True, 3), PostConfig(0.5, 1, 2, True, 9), PostConfig(0.5, 1, 2, False, 9)]
    for k in range(30):
        p, d = r.random((6, 7)), r.random((6, 7)) < 0.7
        rows.append((k, p.T.ravel().tolist(), None if k % 5 == 0 else d.T.ravel().tolist()))
    rows += [(30, None, None), (31, [], []), (32, [0.9] * 41 + [None], None), (33, [0.9] * 41, None), (34, [0.9] * 42, [True] * 6), (35, [float("nan")] * 42, None)]
    df = spark.createDataFrame(rows, "k int, v array<double>, d array<boolean>").repartition(3)
    got = {}
    for x in c.raster_instances(df, ["k"], "v", 6, configs, "d").collect():
        got.setdefault((x["k"], x["config"]), {}).update({p: x["label"] for p in range(x["s"], x["e"])})
    want = {}
    for k, p, d in rows[:30]:
        prob, disk = np.array(p).reshape(7, 6).T, None if d is None else np.array(d).reshape(7, 6).T
        for n, config in enumerate(configs):
            flat = c.instances(prob, disk, config).T.ravel()
            if flat.any():
                want[(k, n)] = {int(q): int(flat[q]) for q in np.flatnonzero(flat)}
    assert got == want


def test_label_runs():
    labels = np.array([[1, 1, 0], [2, 1, 0], [2, 0, 3]])
    assert rle.label_runs(labels) == {1: [(0, 1), (3, 5)], 2: [(1, 3)], 3: [(8, 9)]}
    assert [(rle.decode(t, 3, 3) == (labels == k)).all() for k, t in enumerate(rle.label_counts(labels), 1)] == [True] * 3


def test_complement_of_odd_frames(spark):
    spans = spark.createDataFrame([(1, 5, 8), (1, 2, 3), (1, 30, 40), (2, 0, 10), (3, 7, 7), (9, 1, 2), (4, None, 3)], "k int, s long, e long")
    frames = spark.createDataFrame([(1, 10), (2, 10), (3, 4), (4, 6), (5, 0)], "k int, size int")
    got = sorted(tuple(r) for r in sp.complement(spans, frames, ["k"]).collect())
    assert got == [(1, 0, 2), (1, 3, 5), (1, 8, 10), (3, 0, 4), (4, 0, 6)]


def pq(spark, pred: list, truth: list):
    schema = "k int, {} int, s long, e long"
    rows = lambda masks: [(0, i, s, e) for i, m in enumerate(masks) for _, s, e in spans_of({0: m.T.ravel()})]
    a, b = spark.createDataFrame(rows(pred), schema.format("pred")), spark.createDataFrame(rows(truth), schema.format("truth"))
    found = panoptic.match(panoptic.iou(a, b, ["k"]), ["k"])
    return panoptic.pooled(panoptic.statistics(found, a, b, ["k"]), []).first()


def test_panoptic_facts(spark):
    box = lambda y0, y1, x0, x1: np.pad(np.ones((y1 - y0, x1 - x0), bool), ((y0, 50 - y1), (x0, 50 - x1)))
    a, b = box(0, 10, 0, 10), box(20, 40, 20, 30)
    assert pq(spark, [a, b], [a, b])["pq"] == 1.0
    r = pq(spark, [], [a])
    assert (r["tp"], r["fp"], r["fn"], r["pq"]) == (0, 0, 1, 0.0)
    r = pq(spark, [a], [])
    assert (r["tp"], r["fp"], r["fn"]) == (0, 1, 0)
    assert pq(spark, [], [])["pq"] == 0.0
    r = pq(spark, [box(0, 8, 0, 10)], [a])
    assert abs(r["pq"] - 0.8) < 1e-12 and abs(r["pq"] - r["sq"] * r["rq"]) < 1e-12
    r = pq(spark, [b], [a])
    assert (r["fp"], r["fn"]) == (1, 1)


def test_rasters_scored_in_their_own_task(spark):
    """What the spans' overlaps and matches give, broken rasters and disks included."""
    r = np.random.default_rng(8)
    rows = []
    for k in range(40):
        p, d = np.round(r.random(42), 1), r.random(42) < 0.8
        rows.append((k, None if k % 9 == 4 else (p * (k % 8 > 0)).tolist(), None if k % 5 == 0 else d.tolist()))
    rows += [(40, [], []), (41, [0.9] * 41 + [None], None), (42, [0.9] * 41, None), (43, [0.9] * 42, [True] * 6), (44, [float("nan")] * 42, None), (45, [0.9] * 600, None)]
    rows += [(46 + k, r.random(6 * (3 + k // 2)).tolist(), None) for k in range(12)]  # of other widths
    df = spark.createDataFrame(rows, "k int, v array<double>, d array<boolean>").coalesce(2)
    configs = [PostConfig(0.5, 1, 0, True, 4), PostConfig(0.6, 2, 1, True, 9), PostConfig(0.5, 2, 0, True, 9), PostConfig(0.95, 6, 0, False, 9)]
    raters = [PostConfig(0.5, 1, 0, False, 60), PostConfig(0.7, 1, 0, True, 60), PostConfig(2.0, 1, 0, True, 60)]
    keys = ["k", "rater", "config"]
    both = c.raster_instances(df, ["k"], "v", 6, [*configs, *raters], "d").cache()
    pred = both.where("config < 4").select("k", F.explode(F.array(*map(F.lit, range(3)))).alias("rater"), "config", F.col("label").alias("pred"), "s", "e")
    truth = both.where("config >= 4").select("k", (F.col("config") - 4).alias("rater"), F.explode(F.array(*map(F.lit, range(4)))).alias("config"), F.col("label").alias("truth"), "s", "e")
    want = panoptic.statistics(panoptic.match(panoptic.iou(pred, truth, keys), keys), pred, truth, keys)
    got = panoptic.raster_statistics(df, ["k"], "v", 6, configs, raters, "d")
    told = lambda rows: sorted((*(x[c] for c in (*keys, "tp", "fp", "fn")), round(x["iou_sum"], 9)) for x in rows.collect())
    assert got.dtypes[3:] == [(c, "bigint") for c in ("tp", "fp", "fn")] + [("iou_sum", "double")]
    assert told(got) == told(want) and sum(x["tp"] for x in got.collect()) > 100
    both.unpersist()
    assert not panoptic.raster_statistics(df, ["k"], "v", 6, configs, [], "d").collect()


def test_no_spans_on_the_driver(spark, tmp_path):
    """Many spans in a small file: the planner would broadcast them."""
    spark.range(200_000).selectExpr("id div 10 as k", "cast(id % 10 as int) as pred", "id % 10 * 6 as s", "id % 10 * 6 + 4 as e").write.parquet(f"{tmp_path}/a")
    a = spark.read.parquet(f"{tmp_path}/a")
    b = a.withColumnRenamed("pred", "truth")
    found = panoptic.match(panoptic.iou(a, b, ["k"]), ["k"])
    total = panoptic.pooled(panoptic.statistics(found, a, b, ["k"]), [])
    assert total.first()["tp"] == 200_000
    assert "BroadcastExchange" not in total._jdf.queryExecution().toString()


def test_greedy_equals_ranked_and_low_thresholds(spark):
    pairs = spark.createDataFrame([(0, 1, 1, 0.45), (0, 1, 2, 0.4), (0, 2, 1, 0.44), (0, 2, 2, 0.35), (0, 3, 3, 0.9)], "k int, pred int, truth int, iou double")
    got = {(r["pred"], r["truth"]) for r in panoptic.match(pairs, ["k"], 0.3).collect()}
    assert got == {(1, 1), (2, 2), (3, 3)}
    assert {(r["pred"], r["truth"]) for r in panoptic.match(pairs, ["k"]).collect()} == {(3, 3)}


def test_tiles_and_blending():
    assert raster.tile_starts(1024, 512, 384) == [0, 384, 512] and raster.tile_starts(100, 128, 96) == [0]
    r = np.random.default_rng(1)
    x = r.normal(size=(100, 76))
    got = raster.predict_prob(lambda t: t * 2, x, tile=32, overlap=8, tta=True, batch=3)
    assert np.allclose(got, 1 / (1 + np.exp(-2 * x)))
    assert np.allclose(raster.area_resize(x, 50, 38), x.reshape(50, 2, 38, 2).mean((1, 3)))
    assert np.allclose(raster.bilinear(np.full((5, 7), 3.0), 11, 4), 3.0)


def test_disk_and_normalisation():
    y, x = np.mgrid[:200, :200]
    image = np.where(np.hypot(y - 100, x - 100) < 70, 180, 5).astype(np.uint8)
    image[90:100, 80:120] = 20
    disk = raster.disk_mask(image)
    inside = np.hypot(y - 100, x - 100)
    assert disk[inside < 66].all() and not disk[inside > 76].any()
    assert raster.disk_mask(np.zeros((50, 50), np.uint8)).all()
    z = raster.normalize(image, disk)
    assert (z[~disk] == 0).all() and abs(z[disk].mean()) < 0.2 and z.min() >= -5
    prob, mask = raster.predict_image(image, lambda t: t, 0.5, tile=64, overlap=16)
    assert prob.shape == mask.shape == (200, 200) and (0 <= prob).all() and (prob <= 1).all()


def test_network_shape_and_size():
    from maskframe.operators.training import UNet

    assert UNet(8, 2)(np.zeros((2, 20, 13))).shape == (2, 20, 13)
    assert UNet().parameters() == 7_849_025


def test_network_from_a_checkpoint(spark, tmp_path):
    from maskframe.operators.training import UNet
    from maskframe.sources import runs

    r = np.random.default_rng(1)
    net = UNet(4, 2, seed=3)
    for norm in net.norms:
        for x in norm:
            x[...] = r.uniform(0.5, 1.5, x.shape)
    runs.save_weights(spark, f"{tmp_path}/w", net.weights())
    back = UNet.of(runs.load_weights(spark, f"{tmp_path}/w"))
    frames = r.normal(size=(3, 12, 9))
    assert np.array_equal(back(frames), net(frames)) and not np.allclose(UNet(4, 2, seed=4)(frames), net(frames))
    # a frame's result doesn't depend on its neighbours
    assert np.allclose(net(frames)[:1], net(frames[:1]), atol=1e-5)
