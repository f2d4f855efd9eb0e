import subprocess
import sys
import textwrap

import pytest
from conftest import ROOT
from pyspark.errors import PySparkException

from loomline.sources.vector_store import VectorStore


def rows(spark, n, at=0):
    return spark.createDataFrame([(f"text {i}", [float(i), 1.0, 0.0]) for i in range(at, at + n)], "text string, vector array<double>")


def test_appends_reads_and_misses(spark, tmp_path):
    s = VectorStore(spark, f"file://{tmp_path}/store", "m", 3)
    assert s.read().count() == 0 and s.missing(rows(spark, 3)).count() == 3
    assert s.add(rows(spark, 5)) == 5 and s.add(rows(spark, 5, 3)) == 3 and s.add(rows(spark, 2)) == 0
    again = VectorStore(spark, f"file://{tmp_path}/store", "m", 3)
    assert [e["n"] for e in again.entries()] == [5, 3, 0] and again.read().count() == 8 and not again.orphans()
    asked = spark.createDataFrame([("text 2",), ("text 99",), ("text 2",), (None,)], "text string")
    assert [r.text for r in again.missing(asked).collect()] == ["text 99"]
    found = sorted(((r.text, r.vector and r.vector[0]) for r in again.lookup(asked).collect()), key=str)
    assert found == sorted([("text 2", 2.0), ("text 2", 2.0), ("text 99", None), (None, None)], key=str)
    for model, dim in (("other", 3), ("m", 4)):
        with pytest.raises(ValueError):
            VectorStore(spark, f"file://{tmp_path}/store", model, dim)
    with pytest.raises(PySparkException):
        again.add(spark.createDataFrame([("new", [1.0])], "text string, vector array<double>"))
    assert again.read().count() == 8


def test_a_writer_killed_before_the_manifest_leaves_nothing_to_see(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    s = VectorStore(spark, path, "m", 3)
    s.add(rows(spark, 4))
    code = f"""
        import os, sys
        sys.path.insert(0, {str(ROOT)!r})
        from pyspark.sql import SparkSession
        from loomline.sources.vector_store import VectorStore
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        VectorStore._commit = lambda self, folder, n: os._exit(9)
        VectorStore(spark, {path!r}, "m", 3).add(spark.createDataFrame([("late", [7.0, 7.0, 7.0])], "text string, vector array<double>"))
    """
    assert subprocess.run([sys.executable, "-c", textwrap.dedent(code)], timeout=120, capture_output=True).returncode == 9
    assert s.read().count() == 4 and len(s.orphans()) == 1
    assert s.missing(spark.createDataFrame([("late",)], "text string")).count() == 1
    assert s.truncate() == 1 and not s.orphans() and s.read().count() == 4
    assert s.add(rows(spark, 1, 50)) == 1 and s.read().count() == 5


def test_two_writers_take_entries_of_their_own(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    a, b = VectorStore(spark, path, "m", 3), VectorStore(spark, path, "m", 3)
    names = a._names
    a._names = lambda folder: [] if folder == "manifest" else names(folder)  # does not see what b does meanwhile
    b.add(rows(spark, 2))
    b.add(rows(spark, 2, 10))
    a._commit("nothing", 0)
    assert [e["n"] for e in b.entries()] == [2, 2, 0]
