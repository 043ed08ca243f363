"""Cases of the second review: parts of the job that the readers left out."""

from labelsense.sources import tables


def test_csv_with_line_breaks_by_default(spark, tmp_path):
    rows = [(1, "first line\nsecond line", "a"), (2, "plain", "b")]
    df = spark.createDataFrame(rows, "id long, description string, variety string")
    tables.write_reviews_csv(df, str(tmp_path / "csv"))
    assert sorted(map(tuple, tables.read_reviews_csv(spark, str(tmp_path / "csv"), df.schema).collect())) == rows
