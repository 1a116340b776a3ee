import os
import shutil
import subprocess
import sys

import __spark_entry__ as e

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_flagship(spark):
    rows = e.entry(spark).collect()
    assert len(rows) == 1 and 0 < rows[0]["pq"] < 1


def test_every_sql_has_its_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_training_data_operators(tmp_path):
    """The entry still imports, and only the other queries are left; stale byte code doesn't count."""
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/maskframe", tmp_path / "maskframe", ignore=shutil.ignore_patterns("llm"))
    (tmp_path / "maskframe" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env).returncode == 0


def test_nothing_else_imports_them():
    for folder, _, files in os.walk(f"{ROOT}/maskframe"):
        if os.path.basename(folder) not in ("llm", "__pycache__"):
            for f in files:
                if f.endswith(".py"):
                    assert ".llm" not in open(f"{folder}/{f}").read()


def test_workers_get_the_package_without_a_path(tmp_path):
    """A driver that only has the folder on its own path: Arrow functions still find their modules."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
q = e.queries()
assert q["rle_counts_string"](spark, "/root/testdata/sf0.001").count() > 0
assert q["instances_from_prob"](spark, "/root/testdata/sf0.001").count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, timeout=300).returncode == 0
