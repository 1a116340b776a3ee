import os

import pytest

from maskframe import session


class Cluster:
    """What ``shared_dir`` looks at, of a session on a cluster without a checkpoint folder."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master = "spark://somewhere:7077"


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster())


def test_written_tables_are_deleted(spark):
    rows = session.written(spark.range(10).toDF("x"), "rows")
    path = rows._written_to.removeprefix("file://")
    assert rows.count() == 10 and spark.sparkContext.applicationId in path and os.path.isdir(path)
    session.done(rows)
    assert not os.path.exists(path)
    again = session.written(spark.range(3).toDF("x"), "rows")._written_to.removeprefix("file://")
    session.clean(spark)
    assert not os.path.exists(again)


def test_the_folder_goes_with_the_process(tmp_path):
    import subprocess
    import sys

    code = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
from maskframe import session
spark = SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", {str(tmp_path / 'shared')!r}).config("spark.ui.enabled", "false").getOrCreate()
table = session.written(spark.range(3).toDF("x"), "rows")
assert table.count() == 3
spark.stop()
"""
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0
    assert not list((tmp_path / "shared").glob("maskframe-*"))
