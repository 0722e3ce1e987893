"""The driver's contract and the session helpers."""

import os
import subprocess
import sys

import pytest
from conftest import ROOT
from pyspark.sql import functions as F

import __spark_entry__ as e
from tessella import session


def test_entry_has_rows(spark):
    df = e.entry(spark)
    assert df.columns and df.count() > 0


def test_queries_and_sql_belong_together():
    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(f) for f in queries.values()) and "p5_found" in queries


def test_works_without_the_training_data_part():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('tessella.llm'): raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert not any(k.startswith(('p1_', 'p8_')) for k in e.queries()) and 'p3_found' in e.queries() and 'p5_found' in e.oracle_sql()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_training_data_part():
    for at, _, files in os.walk(os.path.join(ROOT, "tessella")):
        if os.sep + "llm" in at:
            continue
        for f in files:
            if f.endswith(".py"):
                text = open(os.path.join(at, f)).read()
                assert "tessella.llm" not in text and "from ..llm" not in text and "from .llm" not in text, f


def test_written_and_released(spark, tmp_path):
    df = session.written(spark.range(5).withColumn("x", F.lit("a")), "kept")
    assert df.count() == 5 and df.columns == ["id", "x"]
    assert session.written(spark.range(0), "empty").count() == 0
    paths = list(session._PATHS[spark.sparkContext.applicationId])
    assert all(p.startswith(session.shared_dir(spark)) for p in paths)
    assert session.release(spark) == len(paths) and not any(os.path.exists(p.removeprefix("file://")) for p in paths)


def test_spread(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(1000).repartition(8).write.parquet(str(tmp_path / "many"))
    few, many = spark.read.parquet(str(tmp_path / "one")), spark.read.parquet(str(tmp_path / "many"))
    assert session.spread(few).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and session.spread(few).count() == 1000
    assert "Exchange" not in session.spread(many)._jdf.queryExecution().toString()


def test_shared_dir_follows_the_setting(tmp_path):
    code = (
        "import sys, os\n"
        "from tessella import session\n"
        "spark = session.build_session(1, 'dir', **{'spark.checkpoint.dir': 'file://' + sys.argv[1] + '/'})\n"
        "assert session.new_path(spark, 'x').startswith('file://' + sys.argv[1] + '/x-')\n"
        "assert session.written(spark.range(3), 'y').count() == 3 and os.listdir(sys.argv[1])\n"
    )
    subprocess.run([sys.executable, "-c", code, str(tmp_path)], cwd=ROOT, check=True, timeout=240)


def test_a_cluster_needs_the_setting():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077", "applicationId": "x"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_what_is_more_than_a_table_is_settled_once(spark, tmp_path):
    spark.range(9).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    light, heavy = df.filter("id > 3"), df.groupBy("id").count()
    assert session.settled(light, "light") is light and "light" not in str(light.inputFiles())
    assert all("/heavy-" in f for f in session.settled(heavy, "heavy").inputFiles()) and session.settled(heavy, "heavy").count() == 9


def test_settings_come_back(spark):
    with session.settings(spark, {"spark.sql.shuffle.partitions": "3", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4" and spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering") == "false"
