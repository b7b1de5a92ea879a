import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from aquagrid.sources import rasters as RA, records as RE, vectors as VE
from tests.test_records import rows


def test_csv_files_are_bound_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Well Id,YEAR,AF Pumped\n12345,2001,1.5\n12346,2002,NA\n")
    (tmp_path / "b.csv").write_text("﻿YEAR,AF Pumped,Well Id,Extra\n2003,2.5,99,x\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_text("Well Id,YEAR\n")
    (tmp_path / "e.csv").write_text("Well Id,YEAR\r\n7,2004\r\n")
    df = RE.read_record_files(spark, str(tmp_path / "*.csv"), "`Well Id` string, YEAR int, `AF Pumped` double")
    assert rows(df, "Well Id", "YEAR", "AF Pumped") == sorted([
        ("12345", 2001, 1.5), ("12346", 2002, None), ("99", 2003, 2.5), ("7", 2004, None)], key=repr)


def test_paths_with_blanks_and_glob_signs(spark, tmp_path):
    folder = tmp_path / "from a friend [1]"
    folder.mkdir()
    (folder / "use 50%.csv").write_text("id,v\n1,2\n")
    df = RE.read_record_files(spark, str(tmp_path / "from*" / "*.csv"), "id int, v double")
    assert rows(df, "id", "v") == [(1, 2.0)]


def test_quoted_and_repeated_header_names(spark, tmp_path):
    (tmp_path / "q.csv").write_text('Year, "Use, total",Region,Region\n2000,7,x,y\n')
    df = RE.read_record_files(spark, str(tmp_path / "q.csv"), "Year int, `Use, total` int, Region string")
    assert rows(df, "Year", "Use, total", "Region") == [(2000, 7, "x")]


def test_known_header_needs_no_header_pass(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,2\n")
    df = RE.read_record_files(spark, str(tmp_path / "a.csv"), "id int, v double", header="id,v")
    assert rows(df, "id", "v") == [(1, 2.0)]


def test_summary_table(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_bytes("﻿Year,Region,Irrigation_AF\n2001,X,10\n2000,X,NA\n".encode("utf-8"))
    df = RE.read_summary(spark, str(path), "Year int, Region string, Irrigation_AF int")
    assert rows(df, "Year", "Irrigation_AF") == [(2000, None), (2001, 10)]


def test_dates_in_file_names(spark):
    names = [("ET_2005_1.tif", 2005, 1), ("ET_2005_11.tif", 2005, 11), ("SW_2010.tif", 2010, None),
             ("static.tif", None, None), ("ppt_4kmM3_200001_bil.bil", 2000, 1),
             ("ppt_201912.bil", 2019, 12), ("ppt_200013.bil", None, None)]
    df = spark.createDataFrame(names, "file_name string, y int, m int")
    out = RE.with_file_dates(df)
    assert out.filter("not (year <=> y and month <=> m)").count() == 0


def write_bil(folder, name, array, nodata=-9999, dtype="<f4", extra=""):
    array.astype(dtype).tofile(folder / f"{name}.bil")
    rows_, bands, cols = array.shape
    (folder / f"{name}.hdr").write_text(
        f"NROWS {rows_}\nNCOLS {cols}\nNBANDS {bands}\nNBITS {int(dtype[2]) * 8}\n"
        f"PIXELTYPE {'FLOAT' if dtype[1] == 'f' else 'SIGNEDINT'}\n"
        f"BYTEORDER {'M' if dtype[0] == '>' else 'I'}\nLAYOUT BIL\nNODATA {nodata}\n{extra}")


def test_raw_grids_become_cells(spark, tmp_path):
    a = np.arange(12, dtype=float).reshape(3, 2, 2)  # rows, bands, cols
    a[0, 0, 0], a[1, 1, 1] = -9999, np.nan
    write_bil(tmp_path, "ET_2001_7", a)
    b = np.full((300, 1, 2), 5.0)
    b[299, 0, 1] = 77
    write_bil(tmp_path, "P_2002", b, nodata=5, dtype=">i2")
    df = RA.read_bil(spark, str(tmp_path)).persist()
    first = df.filter("file_name = 'ET_2001_7.bil'")
    assert first.count() == 12 and first.filter("value is null").count() == 2
    assert rows(first.filter("row = 2 and col = 1"), "year", "month", "band", "value") == [
        (2001, 7, 1, 9.0), (2001, 7, 2, 11.0)]
    shared = RA.read_bil(spark, str(tmp_path), "P_*.bil", (tmp_path / "P_2002.hdr").read_text())
    assert shared.filter("value is not null").count() == 1
    second = df.filter("year = 2002")
    assert second.count() == 600
    assert rows(second.filter("value is not null"), "row", "col", "value") == [(299, 1, 77.0)]


def test_grids_of_equal_names_keep_their_own_headers(spark, tmp_path):
    for year, nodata in ((2000, 1), (2001, 2)):
        folder = tmp_path / f"year {year}"
        folder.mkdir()
        write_bil(folder, "ppt", np.arange(4, dtype=float).reshape(2, 1, 2), nodata=nodata)
    got = rows(RA.read_bil(spark, str(tmp_path)), "value")
    assert got == sorted([(0.0,), (3.0,), (0.0,), (3.0,), (1.0,), (2.0,), (None,), (None,)], key=repr)


def test_layer_storage_prunes_partitions(spark, tmp_path):
    df = spark.range(200).select(
        F.when(F.col("id") % 2 == 0, "et").otherwise("p").alias("var"), (2000 + F.col("id") % 3).alias("year"),
        F.col("id").cast("int").alias("row"), F.lit(0).alias("col"), (F.col("id") * 1.0).alias("value"))
    RA.write_layers(df, str(tmp_path / "layers"))
    got = RA.read_layers(spark, str(tmp_path / "layers"), ["et"], (2001, 2001))
    assert got.count() == df.filter("var = 'et' and year = 2001").count()
    assert "PartitionFilters: [isnotnull" in got._jdf.queryExecution().toString()
    encoded = RA.encode_layer(got.withColumn("value", F.lit(None).cast("double")))
    assert encoded.filter("value <> -9999").count() == 0


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_feature_files(spark, tmp_path, fmt):
    path = str(tmp_path / "features")
    RA.write_features(spark.range(100), path, 3, fmt)
    back = spark.read.csv(path, header=True) if fmt == "csv" else spark.read.parquet(path)
    assert back.count() == 100
    assert len(list((tmp_path / "features").glob(f"part-*.{fmt}"))) == 3


FEATURES = [
    {"type": "Feature", "properties": {"code": "a", "area": 1.5},
     "geometry": {"type": "Polygon", "coordinates": [
         [[0, 0], [4, 0], [4, -4], [0, -4], [0, 0]], [[1, -1], [2, -1], [2, -2], [1, -2]]]}},
    {"type": "Feature", "properties": {"code": "b", "area": None},
     "geometry": {"type": "MultiPolygon", "coordinates": [
         [[[5, 0], [6, 0], [6, -1], [5, 0]]], [[[7, 0], [8, 0], [8, -1], [7, 0]]]]}},
    {"type": "Feature", "properties": {"code": "c", "area": 0.0},
     "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1], [2, 0]]}},
]


@pytest.mark.parametrize("lines", [False, True])
def test_geojson_to_edges(spark, tmp_path, lines):
    path = tmp_path / "f.json"
    if lines:
        path.write_text("\n".join(json.dumps(f) for f in FEATURES))
    else:
        path.write_text(json.dumps({"type": "FeatureCollection", "features": FEATURES}, indent=1))
    f = VE.read_features(spark, str(path), "code string, area double", lines)
    assert f.count() == 3
    edges = VE.polygon_edges(f.filter("kind like '%Polygon'"), "code").persist()
    counts = {(r.code, r.ring): r["count"] for r in edges.groupBy("code", "ring").count().collect()}
    assert counts == {("a", 0): 4, ("a", 1): 4, ("b", 0): 3, ("b", 1): 3}
    hole = rows(edges.filter("code = 'a' and ring = 1 and seq = 3"), "x1", "y1", "x2", "y2")
    assert hole == [(1.0, -2.0, 1.0, -1.0)]  # the open ring was closed
    box = VE.edge_bounds(edges, "code").filter("code = 'b'").first()
    assert (box.xmin, box.ymin, box.xmax, box.ymax) == (5.0, -1.0, 8.0, 0.0)
    segments = VE.line_segments(f.filter("kind = 'LineString'"), "code")
    assert rows(segments, "seq", "x1", "y1", "x2", "y2") == [(0, 0.0, 0.0, 1.0, 1.0), (1, 1.0, 1.0, 2.0, 0.0)]


def test_one_large_grid_is_many_tasks_and_no_shuffle(spark, tmp_path):
    rows_, cols = 21_000, 1_000
    data = (np.arange(rows_, dtype="<f4")[:, None] + np.zeros(cols, "<f4")[None, :])
    data.tofile(tmp_path / "big_2001_7.bil")
    (tmp_path / "big_2001_7.hdr").write_text(f"NROWS {rows_}\nNCOLS {cols}\nNBITS 32\nPIXELTYPE FLOAT\n")
    got = RA.read_bil(spark, str(tmp_path), rows=(10_000, 20_000), columns=(5, 8))
    assert got.rdd.getNumPartitions() >= 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    one = got.agg(F.count("*").alias("n"), F.min("row").alias("a"), F.max("row").alias("b"),
                  F.sum((F.col("value") - F.col("row")) ** 2).alias("off"), F.min("col").alias("c"),
                  F.max("col").alias("d"), F.min("year").alias("y"), F.min("month").alias("m")).first()
    assert tuple(one) == (30_000, 10_000, 19_999, 0.0, 5, 7, 2001, 7)
