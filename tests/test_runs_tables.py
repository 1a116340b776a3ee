from maskframe.functions import rle, tables
from maskframe.operators import training
from maskframe.operators.panoptic import PostConfig
from maskframe.sources import runs


def test_configuration(spark, tmp_path):
    path = f"{tmp_path}/post"
    assert runs.load_config(spark, path) == PostConfig()
    runs.save_config(spark, path, PostConfig(0.6, 400, 10), {"pq": 0.4})
    assert runs.load_config(spark, path) == PostConfig(0.6, 400, 10)
    assert '"validation"' in "".join(r[0] for r in spark.read.text(path).collect())


def test_split_and_log(spark, tmp_path):
    rows = spark.createDataFrame([("a", "train"), ("b", "val"), ("c", "train")], "stem string, split string")
    runs.save_split(rows, f"{tmp_path}/split")
    assert sorted(r["stem"] for r in runs.load_split(spark, f"{tmp_path}/split", "train").collect()) == ["a", "c"]
    for epoch, dice in ((1, 0.5), (2, None), (3, 0.7)):
        runs.append_log(spark.createDataFrame([(epoch, 0.1, 1e-3, dice, 2.0)], "epoch int, train_loss double, lr double, val_dice double, seconds double"), f"{tmp_path}/log")
    log = runs.read_log(spark, f"{tmp_path}/log")
    assert [r["epoch"] for r in log.collect()] == [1, 2, 3]
    assert [r["epoch"] for r in training.best_checkpoint(log.where("val_dice is not null"), "epoch", "val_dice").orderBy("epoch").collect()] == [1, 3]


def test_table_functions(spark):
    tables.register(spark)
    text = rle.text_of([10, 5, 3, 2, 44])
    rows = spark.createDataFrame([(1, text), (2, None), (3, "?"), (4, rle.text_of([64]))], "k int, t string")
    rows.createOrReplaceTempView("masks_for_test")
    got = spark.sql("SELECT k, m.s, m.e FROM masks_for_test, LATERAL mask_spans(t, 8, 8) m ORDER BY k, s").collect()
    assert [tuple(r) for r in got] == [(1, 10, 15), (1, 18, 20)]
    assert [r[0] for r in spark.sql("SELECT * FROM tile_starts(1024, 512, 384)").collect()] == [0, 384, 512]
