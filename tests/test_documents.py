"""Reports as documents: what executors wrote is what is read, with its types."""

from __future__ import annotations

import datetime as dt
import glob
import json
from decimal import Decimal

import pytest

from cellarium.sources import documents as D
from cellarium.sources import tables


def test_round_trip_with_types(spark, tmp_path):
    rows = [
        (1, "é \"q\" \n", dt.date(2024, 2, 29), Decimal("12.30"), [("a", 1.5), ("b", None)], dt.datetime(2024, 1, 2, 3, 4, 5), b"\x00\xff", True),
        (2, None, None, None, [], None, None, None),
        (2, None, None, None, [], None, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, `odd name.x` string, day date, price decimal(10,2), items array<struct<k:string,v:double>>, at timestamp, raw binary, ok boolean")
    path = f"file://{tmp_path}/report"
    D.write({"rows": df, "none": df.limit(0), "meta": {"scale": 3, "names": ["x", None]}, "one.number": 4}, spark, path)
    back = D.section(spark, path, "rows", df.schema)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    assert D.section(spark, path, "none", df.schema).count() == 0
    assert D.section(spark, path, "none").columns == []
    assert D.section(spark, path, "meta").first().asDict() == {"names": ["x", None], "scale": 3}
    assert D.section(spark, path, "one.number").first().body.toPython() == 4
    assert D.section(spark, path, "rows", "id int, day date").filter("day IS NULL").count() == 2


def test_order_is_kept_as_place(spark, tmp_path):
    path = f"file://{tmp_path}/report"
    D.write({"rows": spark.range(1000).repartition(7).selectExpr("id", "-id AS v").orderBy("v")}, spark, path)
    placed = D.report(spark, path).selectExpr("place", "variant_get(body, '$.v', 'int') AS v").orderBy("place").collect()
    assert [r.v for r in placed] == list(range(-999, 1))


def test_json_lines(spark, tmp_path):
    path, out = f"file://{tmp_path}/report", f"{tmp_path}/json"
    D.write({"a": spark.range(5).selectExpr("id", "date'2024-01-01' AS d"), "b": [1, 2]}, spark, path)
    D.json_lines(spark, path, f"file://{out}")
    lines = [json.loads(x) for f in glob.glob(f"{out}/section=a/*.txt") for x in open(f)]
    assert sorted(x["id"] for x in lines) == list(range(5)) and {x["d"] for x in lines} == {"2024-01-01"}
    assert [json.loads(x) for f in glob.glob(f"{out}/section=b/*.txt") for x in open(f)] == [[1, 2]]


def test_refused(spark, tmp_path):
    path = f"file://{tmp_path}/report"
    with pytest.raises(ValueError, match="no name"):
        D.write({"../x": 1}, spark, path)
    with pytest.raises(ValueError, match="occur twice"):
        D.write({"x": spark.range(2).selectExpr("id AS a", "id AS a")}, spark, path)
    with pytest.raises(ValueError, match="at least one"):
        D.write({}, spark, path)
    D.write({"x": 1}, spark, path)
    with pytest.raises(Exception, match="(?i)already exists"):
        D.write({"x": 2}, spark, path)


def test_a_page_says_what_it_leaves_out(spark):
    text = tables.page("t", {"rows": spark.range(30)}, most=10)
    assert text.count("<td>") == 10 and "10 of 30 rows" in text
    assert "of 30 rows" not in tables.page("t", {"rows": spark.range(30)}, most=30)
