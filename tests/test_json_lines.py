"""The JSON lines data source: all rows of a write, or none."""

import glob

import pytest
from pyspark.sql import functions as F

from lodestar.session import ship
from lodestar.sources.json_lines import read_lines, write_lines

SCHEMA = "id long, text string, tags array<string>"


def ids(spark, path):
    return sorted(r.id for r in read_lines(spark, path, SCHEMA).collect())


@pytest.fixture
def rows(spark):
    ship(spark)
    text = F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit('é "x"\n'), "id"))
    return spark.range(0, 5000, 1, 4).select("id", text.alias("text"), F.array(F.lit("a"), F.col("id").cast("string")).alias("tags"))


def test_round_trip_append_and_overwrite(spark, rows, tmp_path):
    path = str(tmp_path / "lines")
    assert ids(spark, path) == []
    write_lines(rows.where("id < 3000"), path)
    write_lines(rows.where("id >= 3000"), path)
    assert sorted(map(str, read_lines(spark, path, SCHEMA).collect())) == sorted(map(str, rows.collect()))
    write_lines(rows.where("id < 7"), path, "overwrite")
    assert ids(spark, path) == list(range(7))
    write_lines(rows.limit(0), path, "overwrite")
    assert ids(spark, path) == []


def test_a_failed_write_shows_nothing(spark, rows, tmp_path):
    path = str(tmp_path / "lines")
    write_lines(rows.where("id < 10"), path)
    broken = rows.withColumn("text", F.when(F.col("id") == 4999, F.raise_error(F.lit("broken row"))).otherwise(F.col("text")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception):
            write_lines(broken, path, mode)
        assert ids(spark, path) == list(range(10))
    assert len(glob.glob(f"{path}/manifest-*")) == 1
