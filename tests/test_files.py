"""One-file sinks."""

import pytest
from pyspark.sql import functions as F

from quillmart.sources import files


def test_one_file_with_mark(spark, tmp_path):
    """Rows in order of partitions, one header, one mark, fields that need quotes; an empty table is a header."""
    rows = [(i, f'say "{i}", é\nline', None if i % 2 else 0.5) for i in range(200)]
    frame = spark.createDataFrame(rows, "n long, `a, b` string, x double").repartitionByRange(5, "n").sortWithinPartitions("n")
    path = tmp_path / "one.csv"
    files.write_one_delimited(frame, str(path))
    data = path.read_bytes()
    assert data.startswith(b"\xef\xbb\xbfn,\"a, b\",x\n") and data.count(b"\xef\xbb\xbf") == 1 and data.count(b"a, b") == 1
    back = files.read_delimited(spark, str(path), multi_line=True)
    assert [tuple(r) for r in back.collect()] == [(str(a), b, None if c is None else str(c)) for a, b, c in rows]
    with pytest.raises(FileExistsError):
        files.write_one_delimited(frame, str(path))
    assert path.read_bytes() == data
    paths = files.export_tables({"empty": frame.limit(0), "some": frame.limit(3)}, str(tmp_path / "all"))
    assert (tmp_path / "all" / "empty.csv").read_text(encoding="utf-8-sig") == 'n,"a, b",x\n' and set(paths) == {"empty.csv", "some.csv"}


def test_failing_task_leaves_nothing(spark, tmp_path):
    frame = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no"):
        files.write_one_delimited(frame, str(tmp_path / "x.csv"))
    assert [f for f in tmp_path.iterdir() if not f.name.endswith(".crc")] == []
