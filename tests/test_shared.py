import os
import subprocess
import sys
from pathlib import Path

import pytest

from draftmill.functions import shared

#: A session without spark.checkpoint.dir, whatever the machine's defaults: a query that stages tables runs, and its folder goes.
UNSET = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
from draftmill.functions import shared
from draftmill.jobs.queries import QUERIES
assert QUERIES["w9_display_rank"](spark, "/root/testdata/sf0.001").count() > 0
assert shared.shared_dir(spark) == shared.shared_dir(spark)
print("FOLDER", shared.shared_dir(spark))
"""


def test_without_a_checkpoint_folder(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).parent.parent)}
    done = subprocess.run([sys.executable, "-c", UNSET], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert not Path(done.stdout.split("FOLDER ")[1].strip()).exists()


def test_a_cluster_needs_a_folder():
    class Context:
        master, applicationId = "local-cluster[2,1,1024]", "a"

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, other: other)})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())


def test_tables_go_at_the_end_of_their_scope(spark):
    with shared.cleared(spark):
        first = shared.new_path(spark, "outer")
        with shared.cleared(spark):
            spark.range(3).write.parquet(second := shared.new_path(spark, "inner"))
            assert spark.read.parquet(second).count() == 3
        fs, at = shared.file_system(spark, first)
        assert fs.exists(at(first).getParent()) and not fs.exists(at(second).getParent())
    assert not fs.exists(at(first).getParent())
    assert shared.written(spark.range(5), "kept").count() == 5
