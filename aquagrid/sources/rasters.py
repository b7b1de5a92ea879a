"""Raw grids to cell rows, and cell-layer storage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from aquagrid.constants import NODATA
from aquagrid.functions.numeric import decode_nodata, encode_nodata
from aquagrid.sources.records import record_lines, with_file_dates

_TYPES = {("FLOAT", 32): "f4", ("FLOAT", 64): "f8", ("SIGNEDINT", 16): "i2",
          ("SIGNEDINT", 32): "i4", ("UNSIGNEDINT", 8): "u1", ("UNSIGNEDINT", 16): "u2"}
_LINES = "grid int, row bigint, line binary"
_CELLS = "grid int, band int, row int, col int, value double"


class GridHeader:
    """What the text header of a raw grid says about its bytes."""

    def __init__(self, text):
        pairs = [line.split(None, 1) for line in text.splitlines() if len(line.split(None, 1)) == 2]
        h = {k.upper(): v.strip() for k, v in pairs}
        self.cols, self.bands = int(h["NCOLS"]), int(h.get("NBANDS", 1))
        order = ">" if h.get("BYTEORDER", "I").upper().startswith("M") else "<"
        self.kind = np.dtype(order + _TYPES[(h.get("PIXELTYPE", "FLOAT").upper(), int(h.get("NBITS", 32)))])
        self.nodata = float(h.get("NODATA", NODATA))

    @property
    def line_bytes(self):
        """Bytes of one row of cells in all bands, which lie line by line."""
        return self.cols * self.bands * self.kind.itemsize

    def cells(self, lines, columns=None):
        """(band, row, col, value) arrays of (row number, bytes) lines; NaN for nodata."""
        first, end = columns or (0, self.cols)
        data = np.frombuffer(b"".join(raw for _, raw in lines), self.kind)
        part = data.reshape(len(lines), self.bands, self.cols)[:, :, first:min(end, self.cols)]
        value = part.astype("float64")
        value[np.abs(value - self.nodata) <= 1e-8 + 1e-5 * abs(self.nodata)] = np.nan
        r, b, c = np.indices(part.shape)
        return (b.ravel() + 1, np.array([n for n, _ in lines])[r.ravel()], c.ravel() + first, value.ravel())


def grid_files(spark, folder, pattern="*.bil", header=None):
    """[(file name, path, header text)] of the grids of a folder. Only names and headers are
    read; a grid without a header beside it is left out."""
    listed = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
              .option("recursiveFileLookup", "true").load(folder).filter("length > 0")
              .select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name")))
    if header is not None:
        described = listed.withColumn("header", F.lit(header))
    else:
        stem = F.regexp_replace("_metadata.file_path", r"\.[A-Za-z]+$", "").alias("stem")
        headers = (spark.read.option("pathGlobFilter", "*.hdr").option("recursiveFileLookup", "true")
                   .text(folder, wholetext=True).select(stem, F.col("value").alias("header")))
        described = listed.withColumn("stem", F.regexp_replace(
            F.col("_metadata.file_path"), r"\.[A-Za-z]+$", "")).join(headers, "stem")
    return [(r["file_name"], r["path"], r["header"]) for r in
            described.select("file_name", "path", "header").orderBy("path").collect()]


def read_bil(spark, folder, pattern="*.bil", header=None, rows=None, columns=None):
    """Every raw grid in a folder as ``(file_name, year, month, band, row, col, value)``.

    A grid is read as records of one line each, so its splits are strips of lines that many
    tasks read from where they lie; no byte is shuffled, and a task holds a few lines at a time.
    Nodata and NaN become missing here and nowhere else. Headers lie beside the grids, or
    ``header`` is the text of one that all share. ``rows`` and ``columns`` are windows (first,
    end): lines and columns outside are not decoded.
    """
    files = grid_files(spark, folder, pattern, header)
    heads = [GridHeader(text) for _, _, text in files]
    low, high = rows or (0, 1 << 62)
    sc = spark.sparkContext

    def lines(number, path):
        found = record_lines(sc, path, heads[number].line_bytes)
        return (found.filter(lambda kv: low <= kv[0] < high)
                .map(lambda kv: (number, kv[0], bytes(kv[1]))))

    def decode(batches):
        for batch in batches:
            grids, numbers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            held = list(zip(numbers, batch.column(2).to_pylist()))
            for number in sorted(set(grids)):
                own = [x for x, g in zip(held, grids) if g == number]
                step = max(1, (1 << 22) // heads[number].line_bytes)
                for first in range(0, len(own), step):
                    band, row, col, value = heads[number].cells(own[first:first + step], columns)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), number, "int32")), pa.array(band.astype("int32")),
                         pa.array(row.astype("int32")), pa.array(col.astype("int32")), pa.array(value)],
                        ["grid", "band", "row", "col", "value"])

    parts = [lines(i, path) for i, (_, path, _) in enumerate(files)]
    strips = spark.createDataFrame(sc.union(parts) if parts else [], _LINES)
    cells = strips.mapInArrow(decode, _CELLS)
    names = F.array(*[F.lit(name) for name, _, _ in files]) if files else F.array().cast("array<string>")
    named = cells.withColumns({"file_name": F.get(names, F.col("grid")), "value": decode_nodata("value")})
    return with_file_dates(named).select(
        "file_name", "year", "month", "band", "row", "col", "value")


def write_layers(df, path, partitions=("var", "year"), order=("row", "col")):
    """Cell layers by variable and year, sorted by cell inside each file so that row and
    column filters can skip row groups. A big layer is spread over files by row block."""
    by = [*partitions, F.floor(F.col("row") / 1024)] if "row" in df.columns else partitions
    (df.repartition(*by).sortWithinPartitions(*partitions, *order)
     .write.mode("overwrite").partitionBy(*partitions).parquet(path))


def read_layers(spark, path, variables=None, years=None):
    """Cell layers; the filters prune partitions before any file is opened."""
    df = spark.read.parquet(path)
    if variables is not None:
        df = df.filter(F.col("var").isin(list(variables)))
    if years is not None:
        df = df.filter(F.col("year").between(*years))
    return df


def encode_layer(df, value="value", nodata=NODATA):
    return df.withColumn(value, encode_nodata(value, nodata))


def write_features(df, path, partitions=None, fmt="parquet"):
    """A feature table as parquet or CSV, in a given number of files if asked."""
    out = df.repartition(partitions) if partitions else df
    writer = out.write.mode("overwrite")
    writer.csv(path, header=True) if fmt == "csv" else writer.parquet(path)
