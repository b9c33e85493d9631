import os
import pathlib
import zipfile

from pyspark import SparkFiles

import __spark_entry__ as entry
from cellarium.session import ship


def test_every_sql_has_its_query():
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries) and len(queries) > 60


def test_nothing_else_uses_the_training_data_operators():
    root = pathlib.Path(entry.__file__).parent
    for p in (root / "cellarium").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert ".llm" not in p.read_text(), p


def test_executors_get_the_package_once(spark):
    for _ in range(2):
        ship(spark.sparkContext)
    assert [os.path.basename(f) for f in spark.sparkContext._python_includes].count("cellarium.zip") == 1
    assert "cellarium/operators/graph.py" in zipfile.ZipFile(SparkFiles.get("cellarium.zip")).namelist()
