import csv
import io

import pytest
from pyspark.sql import functions as F

from visiontables.sources import quoted as Q
from visiontables.sources import readers as RD

NAMES = ["a", "b", "c"]


def plain(text):
    """(csv_line, file_line, cells) by the standard reader over the whole text."""
    reader = csv.reader(io.StringIO(text.removeprefix("﻿"), newline=""))
    out, at, number, head = [], 0, 0, None
    for row in reader:
        first, at = at + 1, reader.line_num
        if not row:
            continue
        number += 1
        if head is None:
            head = row
            continue
        cells = dict(zip(head, row))
        out.append((number, first, *(cells.get(n) for n in NAMES)))
    return out


def texts():
    note = lambda i: '"' + ("x\n" * (i % 5)) + f'said ""{i}"", {i}\n\nend"'
    big = "a,b,c\n" + "".join(f"{i},{note(i) if i % 3 else i},tail {i}\n" + ("\n" if i % 11 == 0 else "") for i in range(400))
    return {
        "big": big,
        "crlf": big.replace("\n", "\r\n"),
        "mark": "﻿c,a\r\n1,2\r\n3\r\n",
        "own_header": 'z,"b",a\n"1\n2",3,4\n,,\n',
        "head_of_two_lines": '"b",a,"z\nz"\n1,2,3\n',
        "only_head": "a,b,c\n",
        "no_end": 'a,b,c\n1,2,"open\nto the end',
        "empty": "",
    }


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def check(spark, folder, expected):
    got = {}
    for r in Q.read_by_header(spark, str(folder), NAMES, "*.csv").collect():
        got.setdefault(r.path.rsplit("/", 1)[-1].removesuffix(".csv"), []).append((r.csv_line, r.file_line, *(r[n] for n in NAMES)))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in expected.items() if v}


def put_all(folder):
    for name, text in texts().items():
        (folder / f"{name}.csv").write_bytes(text.encode())
    return {name: plain(text) for name, text in texts().items()}


def test_one_range_a_file(spark, tmp_path):
    check(spark, tmp_path, put_all(tmp_path))


def test_ranges_end_inside_quoted_cells(spark, tmp_path, small_ranges):
    expected = put_all(tmp_path)
    starts = spark.read.text(str(tmp_path / "big.csv"), lineSep="\n").select(F.col("_metadata.file_block_start").alias("s")).distinct().count()
    assert starts > 10
    lines = Q.quoted_lines(spark, str(tmp_path), "big.csv").orderBy("file_line").select("value", "inside").collect()
    assert "\n".join(r.value for r in lines) + "\n" == texts()["big"] and any(r.inside for r in lines)
    check(spark, tmp_path, expected)


def test_plan_lines(spark, tmp_path):
    (tmp_path / "plan.csv").write_text('technique,notes\njab,"one\ntwo"\nhook,three\n')
    out = RD.read_plan(spark, str(tmp_path / "plan.csv")).orderBy("csv_line").collect()
    assert [(r.csv_line, r.file_line, r.technique, r.notes) for r in out] == [(2, 2, "jab", "one\ntwo"), (3, 4, "hook", "three")]
