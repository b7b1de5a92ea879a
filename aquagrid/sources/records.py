"""CSV record sources and statistics tables."""

from __future__ import annotations

import csv
import re
from functools import reduce
from itertools import islice

from pyspark.sql import functions as F, types as T

FILE_YEAR = r"(?:^|_)((?:19|20)[0-9]{2})(0[1-9]|1[0-2])?(?:_|\.|$)"
FILE_MONTH = r"_([0-9]{1,2})\.[A-Za-z]+$"


def _hadoop_path(path):
    """A path as Hadoop's input formats take one: commas part lists, other signs are globs."""
    return re.sub(r"([\\\[\]{}*?,])", r"\\\1", path)


def record_lines(sc, path, length):
    """(number, bytes) of a file's records of one length, split where the file's blocks lie."""
    formats = "org.apache.spark.input.FixedLengthBinaryInputFormat"
    return sc.newAPIHadoopFile(
        _hadoop_path(path), formats, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable",
        conf={f"{formats}.recordLength": str(length)})


def _headers(spark, paths):
    """{header line: paths}. A file is one split here, of which only the first line is read."""
    listed = spark.read.format("binaryFile").load(paths).filter("length > 0").select("path")
    files = sorted(r["path"] for r in listed.collect())       # names only
    sc = spark.sparkContext
    whole = {"mapreduce.input.fileinputformat.split.minsize": str(1 << 62)}

    def first_line(number, path):
        lines = sc.newAPIHadoopFile(
            _hadoop_path(path), "org.apache.hadoop.mapreduce.lib.input.TextInputFormat",
            "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text", conf=whole)
        return lines.mapPartitions(lambda it: [(number, kv[1]) for kv in islice(it, 1)])

    groups = {}
    if files:
        for number, line in sc.union([first_line(i, p) for i, p in enumerate(files)]).collect():
            groups.setdefault(line.removeprefix("\ufeff").rstrip("\r"), []).append(files[number])
    return groups


def _as_path(path):
    """A file's path for readers, which take glob signs."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def read_record_files(spark, paths, columns, null_value="NA", header=None):
    """Many CSV files as one DataFrame, bound by column name.

    ``columns`` is a DDL string of the columns wanted. Spark binds several CSV files by
    position, so files are grouped by header and each group is read with its own header
    order; a column a group lacks is missing there. Files without a header line are skipped.
    A quoted name may hold commas; of equal names in a header the first counts.
    Finding the headers opens each file once and reads its first line; ``header`` (the common
    header line) saves that where all files are known to agree.
    """
    wanted = T._parse_datatype_string(columns) if isinstance(columns, str) else columns
    if header is not None:
        groups = [{"header": header, "paths": paths}]
    else:
        groups = [{"header": line, "paths": [*map(_as_path, found)]}
                  for line, found in _headers(spark, paths).items() if line.strip()]
    parts = []
    for group in groups:
        names = [n.strip() for n in next(csv.reader([group["header"]], skipinitialspace=True))]
        schema = T.StructType([T.StructField(n if names.index(n) == i else f"{n}#{i}", T.StringType())
                               for i, n in enumerate(names)])
        raw = spark.read.csv(group["paths"], schema=schema, header=True, nullValue=null_value)
        parts.append(raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name)
                                  for f in wanted.fields if f.name in names]))
    empty = spark.createDataFrame([], wanted)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts, empty)


def read_summary(spark, path, schema, null_value="NA"):
    """A summary table (withdrawals, deliveries) with a declared schema; the header may start
    with a byte-order mark and missing values are written ``NA``."""
    return read_record_files(spark, path, schema, null_value)


def with_file_dates(df, name="file_name"):
    """Year and month parsed out of the file name, e.g. ``ET_2005_11.bil`` or
    ``ppt_200511_bil.bil``. The month is matched as a whole number, so month 1 never matches
    10 to 12; joined to the year it has two digits and comes first."""
    year, joined = (F.regexp_extract(name, FILE_YEAR, i) for i in (1, 2))
    month = F.when(joined != "", joined).otherwise(F.regexp_extract(name, FILE_MONTH, 1))
    return df.withColumns({
        "year": F.when(year != "", year).cast("int"),
        "month": F.when(month != "", month).cast("int")})


def write_statistics(stats, path):
    stats.coalesce(1).write.mode("overwrite").parquet(path)  # one row per variable


def read_statistics(spark, path):
    return spark.read.schema("variable string, mean double, std double").parquet(path)
