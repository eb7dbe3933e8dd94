"""Comma-separated files with a header each, read by byte ranges although a quoted cell may hold line breaks.

Spark cuts the files into ranges and the ranges into lines. Whether a line lies inside a quoted cell depends on all quotes before
it in its file, so a first pass counts the quotes of each range and how many records start in it, once for either case. A running
sum over that small table, one row a range, tells which case holds; only records of several lines are put together by a shuffle.
"""

from __future__ import annotations

import csv
import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visiontables.operators.ordered import running

MARK = "﻿"
PLACES = ["path", "range_start"]


def _measured(batches):
    """Adds to each line of a range its number and the parity of quotes and the records started before it, for either case."""
    place, carry = None, (0, 0, 0, 0)
    for batch in batches:
        value, path, start = (batch.column(k) for k in (0, 1, 2))
        n = batch.num_rows
        if not n:
            continue
        quotes = np.asarray(pc.count_substring(value, '"'), dtype=np.int64)
        some = ~np.asarray(pc.equal(pc.ascii_trim_whitespace(value), ""), dtype=bool)
        moved = np.asarray(pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(start[1:], start[:-1])), dtype=bool)
        cuts = [0, *(np.flatnonzero(moved) + 1), n]
        line, parity, closed, opened = (np.zeros(n, np.int64) for _ in range(4))
        for a, b in zip(cuts[:-1], cuts[1:]):
            here = (path[int(a)].as_py(), start[int(a)].as_py())
            if here != place:
                place, carry = here, (0, 0, 0, 0)
            total = np.cumsum(quotes[a:b]) + carry[1]
            parity[a:b] = np.r_[carry[1], total[:-1]] % 2
            line[a:b] = carry[0] + np.arange(1, b - a + 1)
            new = [some[a:b] & (parity[a:b] == case) for case in (0, 1)]
            for out, c, s in zip((closed, opened), carry[2:], new):
                out[a:b] = c + np.cumsum(s) - s
            carry = (int(line[b - 1]), int(total[-1] % 2), *(int(out[b - 1] + s[-1]) for out, s in zip((closed, opened), new)))
        yield pa.RecordBatch.from_arrays(
            [path, start, value, pa.array(line), pa.array(parity), pa.array(quotes % 2), pa.array(some), pa.array(closed), pa.array(opened)],
            names=[*PLACES, "value", "line", "parity", "odd", "some", "closed", "opened"])


MEASURED = "path string, range_start bigint, value string, line bigint, parity bigint, odd bigint, some boolean, closed bigint, opened bigint"


def quoted_lines(spark: SparkSession, root: str, glob: str | None = None, like: str | None = None) -> DataFrame:
    """Every line of the files: path, file_line (1 is the first), inside (the line begins in a quoted cell), odd, some, record.

    ``record`` counts the records that start before the line; ``some`` says that the line is not blank, ``odd`` that it has an odd
    number of quotes, so that the next one lies on the other side of a quote.
    """
    text = spark.read.text(root, lineSep="\n", recursiveFileLookup=True, pathGlobFilter=glob)
    text = text.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("range_start"))
    lines = (text.where(F.rlike("path", F.lit(like))) if like else text).mapInArrow(_measured, MEASURED)

    # one row a range: what it holds in either case, then which case holds
    last = F.max_by(F.struct(((F.col("parity") + F.col("odd")) % 2).alias("flip"), *[(F.col(c) + (F.col("some") & (F.col("parity") == case)).cast("int")).alias(c)
                                                                                    for case, c in enumerate(("closed", "opened"))]), "line").alias("last")
    ranges = lines.groupBy(*PLACES).agg(F.max("line").alias("n"), last).select(*PLACES, "n", "last.*")
    before = Window.partitionBy("path").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_open", F.coalesce(F.sum("flip").over(before), F.lit(0)) % 2)
    ranges = ranges.withColumn("_started", F.when(F.col("_open") == 0, F.col("closed")).otherwise(F.col("opened")))
    known = ranges.select(F.col("path").alias("_path"), F.col("range_start").alias("_start"), "_open",
                          F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_lines"), F.coalesce(F.sum("_started").over(before), F.lit(0)).alias("_records"))
    met = lines.join(known, (F.col("path") == F.col("_path")) & (F.col("range_start") == F.col("_start")))
    return met.select("path", "value", (F.col("_lines") + F.col("line")).alias("file_line"), ((F.col("parity") + F.col("_open")) % 2 == 1).alias("inside"), (F.col("odd") == 1).alias("odd"),
                      "some", (F.col("_records") + F.when(F.col("_open") == 0, F.col("closed")).otherwise(F.col("opened"))).alias("record"))


def quoted_records(lines: DataFrame) -> DataFrame:
    """(path, csv_line, file_line, value): whole records with their number among the file's (the header's is 1) and their first line.

    Blank lines between records are none. A record of one line stays where it was read; the lines of others meet by their first.
    A quote that is never closed makes the rest of its file one record, as the format has it.
    """
    fields = ["path", (F.col("record") + 1).alias("csv_line"), "file_line", "value"]
    single = lines.where(~F.col("inside") & ~F.col("odd") & F.col("some")).select(*fields)
    several = lines.where(F.col("inside") | F.col("odd"))
    head = F.when(~F.col("inside"), F.struct("file_line", "record"))
    led = running(several, ["path"], [F.col("file_line")], F.floor(F.col("file_line") / 65536), {"_head": ("max", head)})
    parts = F.sort_array(F.collect_list(F.struct("file_line", "value")))
    whole = led.groupBy("path", "_head").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value"))
    return single.unionByName(whole.select("path", (F.col("_head.record") + 1).alias("csv_line"), F.col("_head.file_line").alias("file_line"), "value"))


def read_by_header(spark: SparkSession, root: str, names: list[str], glob: str | None = None, like: str | None = None) -> DataFrame:
    """(path, csv_line, file_line, names...) of comma-separated files below ``root``: columns by each file's own header, as text.

    ``csv_line`` counts records (the header is 1), ``file_line`` is the line of the file on which the record begins. Lines end with a
    line feed, with or without a carriage return. Columns that a file or a record lacks are NULL, others are not read, and a
    byte-order mark is ignored. A quote inside a cell is doubled; one written bare in a cell without quotes counts as opening one.
    """
    records = quoted_records(quoted_lines(spark, root, glob, like))
    heads = records.where("csv_line = 1").select(F.col("path").alias("_path"), F.col("value").alias("_header"))
    rows = records.where("csv_line > 1").join(heads, F.col("path") == F.col("_path")).select("path", "csv_line", "file_line", "_header", "value")
    schema = "path string, csv_line bigint, file_line bigint, " + ", ".join(f"`{n}` string" for n in names)

    def cells(text):
        return next(csv.reader(io.StringIO(text.removesuffix("\r"), newline="")), [])

    def run(batches):
        places = {}
        for batch in batches:
            found = []
            for header, value in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if header not in places:
                    at = {name: i for i, name in enumerate(cells(header.removeprefix(MARK)))}
                    places[header] = [at.get(n) for n in names]
                row = cells(value)
                found.append([row[i] if i is not None and i < len(row) else None for i in places[header]])
            if found:
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *(pa.array(c, pa.string()) for c in zip(*found))],
                                                 names=["path", "csv_line", "file_line", *names])

    return rows.mapInArrow(run, schema)
