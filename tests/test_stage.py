"""Where stage tables go."""

import importlib.util
import json
import os
import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path
from types import SimpleNamespace

import pytest

from stmtlog.plans import stage as G


def session(master, folder, made=None):
    conf = SimpleNamespace(get=lambda key: folder)
    context = SimpleNamespace(master=master, getConf=lambda: conf, getCheckpointDir=lambda: made)
    return SimpleNamespace(sparkContext=context)


@pytest.mark.parametrize("master", ["local-cluster[2,1,512]", "yarn", "spark://host:7077"])
def test_a_cluster_needs_a_folder_with_its_file_system(master):
    for folder in (None, "/tmp/here", "here"):
        with pytest.raises(RuntimeError):
            G.shared_folder(session(master, folder))
    for folder in ("hdfs://a/b", "s3a://c/d", "file:///mnt/shared", "file:/mnt/shared"):
        assert G.shared_folder(session(master, folder)) == folder


def test_local_mode_takes_any_folder():
    assert G.shared_folder(session("local[2]", "/tmp/here")) == "/tmp/here"


def test_a_bare_path_goes_where_spark_keeps_its_checkpoints():
    for master in ("local-cluster[2,1,512]", "yarn", "spark://host:7077"):
        for made in ("hdfs://a/b/1", "s3a://c/d/1"):
            assert G.shared_folder(session(master, "/tmp/here", made)) == made
    for made in ("file:/tmp/here/1", "file:///tmp/here/1"):
        assert G.shared_folder(session("local-cluster[2,1,512]", "/tmp/here", made)) == made


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077"])
def test_a_bare_path_on_the_disks_of_a_cluster_is_refused(master):
    for made in ("file:/tmp/here/1", "file:///tmp/here/1", "/tmp/here/1"):
        with pytest.raises(RuntimeError):
            G.shared_folder(session(master, "/tmp/here", made))


ON_EXECUTORS = """
import json, sys
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config(map=json.loads(sys.argv[1])).getOrCreate()
queries = __spark_entry__.queries()
for name in sys.argv[3:]:
    queries[name](spark, sys.argv[2]).write.parquet(f"{sys.argv[2]}/{name}")
spark.stop()
"""


def test_queries_on_executors_with_a_bare_path(spark, tmp_path):
    import __spark_entry__

    start = datetime(2024, 1, 1)
    events = [(i, i % 7, start + timedelta(hours=i)) for i in range(120)]
    data, home = f"{tmp_path}/data", tmp_path / "home"
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp_ntz").write.parquet(f"{data}/events.parquet")
    (home / "work").mkdir(parents=True)
    for part in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():
        if part.name != "work":  # executors run there
            (home / part.name).symlink_to(part)
    conf = {
        "spark.checkpoint.dir": f"{tmp_path}/shared", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1",
        "spark.executor.memory": "700m", "spark.sql.shuffle.partitions": "2", "spark.sql.session.timeZone": "UTC",
    }
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))}
    env |= {
        "SPARK_HOME": str(home), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": f"{tmp_path}/local",
        "PYTHONPATH": str(Path(G.__file__).parents[2]), "PYSPARK_PYTHON": sys.executable,
    }
    names = ["csv_log", "kept_date_range", "check_fix_pairs"]
    done = subprocess.run(
        [sys.executable, "-c", ON_EXECUTORS, json.dumps(conf), data, *names], env=env, cwd=tmp_path, capture_output=True, text=True,
        timeout=240,
    )
    assert done.returncode == 0, done.stderr[-2000:]
    for name in names:
        here = __spark_entry__.queries()[name](spark, data)
        assert sorted(spark.read.parquet(f"{data}/{name}").collect()) == sorted(here.collect())
        assert here.count()


ON_MACHINES = """
import json, sys
from pyspark.sql import SparkSession
from stmtlog.plans import stage
import __spark_entry__
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config(map=json.loads(sys.argv[1])).getOrCreate()
spark.sparkContext.master = "spark://host:7077"
try:
    folder = stage.shared_folder(spark)
    told = {"folder": folder, "rows": stage.stage(spark.range(0, 100, 1, 8), "rows").count(), "again": stage.shared_folder(spark)}
    for name in sys.argv[3:]:
        __spark_entry__.queries()[name](spark, sys.argv[2]).write.parquet(f"{sys.argv[2]}/{name}")
except RuntimeError as error:
    told = {"refused": str(error), "cause": type(error.__cause__).__name__}
print("TOLD" + json.dumps(told), flush=True)
spark.stop()
"""


def on_machines(tmp_path, conf, data="", *names):
    """What a session tells that takes its executors for machines; each has /proc/self/cwd for itself, as a disk of its own."""
    home, settings = tmp_path / "home", tmp_path / "conf"
    (home / "work").mkdir(parents=True)
    settings.mkdir()
    for part in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():
        if part.name != "work":  # executors run there
            (home / part.name).symlink_to(part)
    conf = {
        "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.executor.memory": "700m",
        "spark.sql.shuffle.partitions": "2", "spark.sql.session.timeZone": "UTC",
    } | conf
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))}
    env |= {
        "SPARK_HOME": str(home), "SPARK_CONF_DIR": str(settings), "SPARK_LOCAL_IP": "127.0.0.1",
        "SPARK_LOCAL_DIRS": f"{tmp_path}/local", "PYTHONPATH": str(Path(G.__file__).parents[2]), "PYSPARK_PYTHON": sys.executable,
    }
    done = subprocess.run(
        [sys.executable, "-c", ON_MACHINES, json.dumps(conf), data, *names], env=env, cwd=tmp_path, capture_output=True, text=True,
        timeout=240,
    )
    assert done.returncode == 0, done.stderr[-2000:]
    return json.loads(done.stdout.rpartition("TOLD")[2].splitlines()[0])


def test_a_bare_path_that_machines_share_is_taken(spark, tmp_path):
    import __spark_entry__

    start = datetime(2024, 1, 1)
    events = [(i, i % 7, start + timedelta(hours=i)) for i in range(120)]
    data = f"{tmp_path}/data"
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp_ntz").write.parquet(f"{data}/events.parquet")
    told = on_machines(tmp_path, {"spark.checkpoint.dir": f"{tmp_path}/shared"}, data, "kept_date_range", "check_fix_pairs")
    assert told["folder"] == told["again"] and told["folder"].startswith(f"file:{tmp_path}/shared/")
    assert told["rows"] == 100
    assert "trial" not in "".join(os.listdir(f"{told['folder'].removeprefix('file:')}/stmtlog"))
    for name in ("kept_date_range", "check_fix_pairs"):
        here = __spark_entry__.queries()[name](spark, data)
        assert sorted(spark.read.parquet(f"{data}/{name}").collect()) == sorted(here.collect())
        assert here.count()


@pytest.mark.parametrize("folder", [{}, {"spark.checkpoint.dir": "/proc/self/cwd/own"}])
def test_the_warehouse_where_no_shared_folder_is_set(tmp_path, folder):
    told = on_machines(tmp_path, folder | {"spark.sql.warehouse.dir": f"{tmp_path}/tables"})
    assert told["folder"] == told["again"] == f"file:{tmp_path}/tables/stmtlog-stages"
    assert told["rows"] == 100


def test_folders_on_the_disks_of_machines_are_refused(tmp_path):
    own = {"spark.checkpoint.dir": "/proc/self/cwd/own", "spark.sql.warehouse.dir": "/proc/self/cwd/tables"}
    told = on_machines(tmp_path, own)
    assert "/proc/self/cwd/own" in told["refused"] and told["cause"] == "FileNotFoundError"


def test_closing_removes_one_folder_only(spark):
    data = spark.range(3).toDF("x")
    outside = G.stage(data, "outside")
    one, other = G.new_folder(spark, "one"), G.new_folder(spark, "other")
    with G.staging_in(one):
        G.stage(data, "a")
        with G.staging_in(other):
            kept = G.stage(data, "b")
        G.stage(data, "c")
    assert len(os.listdir(one.path.removeprefix("file:"))) == 2
    one.close()
    assert not os.path.exists(one.path.removeprefix("file:"))
    assert kept.count() == outside.count() == 3
    other.close()
