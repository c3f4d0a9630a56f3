"""Day files by their own headers, and remarks on limitations."""

import pytest
from pyspark.sql import functions as F

from amperline.functions import names
from amperline.sources import files


def _write(folder, texts):
    for name, text in texts.items():
        (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())


def test_each_file_by_its_own_header(spark, tmp_path):
    _write(
        tmp_path,
        {
            "RTD_20240101.csv": 'T,GRID,V\n1,luzon,"2,5"\n,,\n  \nEOF\n',
            "RTD_20240102.csv": b"GRID,X,T,V\r\nvisayas,x,2,7\r\n ,only x, ,\r\ncaf\xe9,,3,8\r\n",
            "RTD_20240103.csv": "V,T\n",
            ".hidden.csv": "Q\n1\n",
        },
    )
    got = files.read_day_files(spark, str(tmp_path), ["T", "GRID", "V"])
    assert sorted(map(tuple, got.select("T", "GRID", "V", F.col("day").cast("string")).collect()), key=str) == sorted(
        [("1", "luzon", "2,5", "2024-01-01"), ("2", "visayas", "7", "2024-01-02"), (None, None, None, "2024-01-02"), ("3", "caf�", "8", "2024-01-02")], key=str
    )


def test_a_file_without_a_needed_column_is_refused(spark, tmp_path):
    _write(tmp_path, {"a_20240101.csv": "T,V\n1,2\n", "b_20240102.csv": "T,W\n1,2\n"})
    with pytest.raises(ValueError, match="b_20240102.csv lacks V"):
        files.read_day_files(spark, str(tmp_path), ["T", "V"])


def test_limitations(spark):
    remarks = ["Limitation of Leyte-Cebu", "LEYTE  CEBU hvdc limitation", "limitation: H V D C", "Limitation", "HVDC works", None]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(remarks)], "i long, r string")
    assert [x.c for x in rows.orderBy("i").select(names.limitation_cause(F.col("r")).alias("c")).collect()] == ["leyte-cebu", "leyte-cebu", "hvdc", "other", None, None]
