import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as entry
for name in ("utterance_reasons", "shingle_jaccard_pairs", "budget_fill"):
    assert entry.queries()[name](spark, {DATA!r}).count() > 0
print("workers found the package")
"""


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_workers_find_the_package_from_any_folder(tmp_path):
    """Workers get the code from the session, not from the folder or the path the driver was started with."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "workers found the package" in done.stdout, done.stderr[-2000:]


def test_a_cluster_must_name_a_shared_folder():
    from textloom.session import shared_dir

    class Conf(dict):
        get = dict.get

    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        shared_dir(Session())
    Session.conf["spark.checkpoint.dir"] = "hdfs:///shared/"
    assert shared_dir(Session()) == "hdfs:///shared"
