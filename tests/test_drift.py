import struct

import pytest
from pulsegrid.operators import drift as D
from pulsegrid.operators.extrabytes import ExtraField
from pyspark.sql import functions as F

HEADER = "file_id long, load_id int, received_at timestamp, project_id_guid1 long, file_creation_year int, file_creation_day_of_year int, point_data_format smallint, version_minor smallint, ord int, name string"
VLR = "file_id long, is_extended boolean, idx int, user_id string, record_id int, data binary, name string"
FIELDS = {k: {n: t for n, t in D.fields_of(k)} for k in range(11)}


def desc(name, kind, text="", options=0):
    return ExtraField(name, kind, options, description=text).pack()


def files():
    d = lambda *x: b"".join(desc(*f) for f in x)
    # id: series, year, day, format, minor, descriptors, extradata length
    return {
        1: (7, 2020, 5, 1, 2, d(("A b", 9, "Height  over")), 4), 2: (7, 2020, 6, 1, 3, d(("a_b", 10, "height  over")), 8), 3: (7, 2021, 1, 6, 4, d(("hgt", 10, " HEIGHT  over"), ("m", 1)), 9),
        4: (7, 2021, 1, 6, 4, d(("hgt2", 2, "height  over"), ("m", 1)), 3), 5: (7, 2021, 2, 11, 4, b"", 0), 6: (7, 2021, 3, 6, 4, d(("m", 0, "", 3)), 3), 7: (7, 2021, 4, 6, 4, b"", 0),
        10: (8, 2019, 1, 0, 2, b"", 0), 11: (8, 2018, 9, 2, 2, b"", 0), 12: (None, 2018, 9, 2, 2, b"", 0), 13: (None, 2018, 9, 3, 2, b"", 0), 14: (9, None, None, 3, 5, b"", 0), 20: (9, 2020, 1, 3, 3, d(("x y", 3, "t")), 2),
    }


WANT = {
    (2, "a_b", "retyped"), (2, "start_of_waveform_data", "added"),
    (3, "hgt", "renamed"), (3, "m", "added"), (3, "scan_angle", "retyped"), (3, "bits2", "added"), *((3, n, "added") for n in D.VERSION_FIELDS[4]),
    (4, "hgt2", "renamed"), (4, "hgt2", "retyped"), (4, "extradata", "mismatch"), (6, "hgt2", "removed"), (6, "m", "retyped"), (7, "m", "removed"),
    (10, "red", "removed"), (10, "green", "removed"), (10, "blue", "removed"), (13, "gps_time", "added"),
}


def tables(spark):
    h, v, p, i = [], [], [], 0
    for f, (s, y, d, k, m, data, n) in files().items():
        h += [(f, 1, None, s, y, d, k, m, 0, "clash")] * (2 if f == 3 else 1)
        if data:
            v.append((f, False, 0, "LASF_Spec", 4, bytearray(data), "clash"))
        if f == 2:
            v += [v[-1], (f, True, 0, "LASF_Spec", 4, bytearray(data), "clash")]
        v += [(f, False, 1, "other", 4, bytearray(desc("zz", 1)), ""), (f, False, 2, "LASF_Spec", 3, bytearray(b"text"), ""), (f, False, 3, "LASF_Spec", 4, bytearray(b"short"), ""), (f, False, 4, "LASF_Spec", 4, None, "")]
        for k in range(3):
            p.append((i, f, k, 1, 1.0, bytearray(struct.pack("<d", 2.5)[: n]) if n <= 8 and n else (bytearray(9) if n else None)))
            i += 1
    p = [(a, f, k, l, x, None if f == 4 else e) for a, f, k, l, x, e in p]
    return (
        spark.createDataFrame(h, HEADER), spark.createDataFrame(v, VLR),
        spark.createDataFrame(p, "point_id long, file_id long, point_index long, load_id int, x double, extradata binary"),
    )


@pytest.mark.parametrize("block", [4096, 2])
def test_changes(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK", block)
    got = D.found(*tables(spark)).collect()
    assert sorted(map(tuple, got)) == sorted(WANT)


def test_empty(spark):
    h, v, p = (t.where("false") for t in tables(spark))
    assert D.found(h, v, p).count() == 0 and D.lifespans(h, v).count() == 0 and D.unified_points(p, v).count() == 0


@pytest.mark.parametrize("block", [4096, 2])
def test_lifespans(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK", block)
    h, v, _ = tables(spark)
    got = {(r.field, r.type): (r.first_file, r.last_file, r.files) for r in D.lifespans(h, v).where("series = 7").collect()}
    assert got["a_b", "float32"] == (1, 1, 1) and got["hgt", "float64"] == (3, 3, 1) and got["m", "uint8"] == (3, 4, 2) and got["scan_angle", "int16"] == (3, 7, 4)


def test_unified(spark):
    h, v, p = tables(spark)
    u = D.unified_points(p.union(p.where("file_id = 1")), v)
    assert u.count() == p.count() and {"hgt", "m"} & set(u.columns)
    name = next(c for c in u.columns if c in ("a_b", "hgt", "hgt2"))
    assert {r[0] for r in u.where("file_id = 2").select(name).collect()} == {2.5}
    assert u.where("file_id = 4").where(F.col(name).isNotNull()).count() == 0


def test_unified_scaled(spark):
    v = [
        (1, False, 0, "LASF_Spec", 4, bytearray(desc("h", 9, "height") + desc("s", 1)), ""),
        (2, False, 0, "LASF_Spec", 4, bytearray(ExtraField("h", 4, 24, scale=0.001, offset=1.0, description="height").pack() + ExtraField("s", 1, 8, scale=0.5).pack()), ""),
    ]
    h = [(1, 1, None, 7, 2020, 1, 1, 2, 0, ""), (2, 1, None, 7, 2020, 2, 6, 4, 0, ""), (2, 2, None, 7, 2020, 2, 6, 4, 0, "")]
    p = [(1, 1, 0, 1, 15, None, bytearray(struct.pack("<fB", 2.5, 3))), (2, 2, 0, 1, 2500, None, bytearray(struct.pack("<hB", 1500, 3))), (3, 3, 0, 1, 2500, 1, None), (4, 3, 1, 1, None, 1, None)]
    p = spark.createDataFrame(p, "point_id long, file_id long, point_index long, load_id int, scan_angle short, bits2 short, extradata binary")
    u = D.unified_points(p, spark.createDataFrame(v, VLR), spark.createDataFrame(h, HEADER))
    got = {r.point_id: (r.h, r.s, r.scan_angle) for r in u.collect()}
    assert dict(u.dtypes)["s"] == "double" and got == {1: (2.5, 3.0, 15.0), 2: (2.5, 1.5, 15.0), 3: (None, None, 15.0), 4: (None, None, None)}


def test_unified_version_fields(spark):
    from decimal import Decimal

    more = "start_of_waveform_data decimal(20,0), start_of_extended_variable_length_record decimal(20,0), number_of_extended_variable_length_record long, legacy_number_of_point_records long, legacy_number_of_points_by_return array<long>"
    d = Decimal
    h = [(f, 1, None, 7, 2020, f, 1, m, 0, "", d(9), d(8), 7, 6, [5, 4]) for f, m in ((1, 2), (2, 3), (3, 4))]
    h.append((3, 2, None, 7, 2020, 3, 1, 4, 0, "", d(1), d(1), 1, 1, [1]))  # delivered again
    v = spark.createDataFrame([(3, False, 0, "LASF_Spec", 4, bytearray(desc("start_of_waveform_data", 1)), "")], VLR)
    p = spark.createDataFrame([(i, i, 0, 1, bytearray(b"\x05") if i == 3 else None) for i in range(1, 5)], "point_id long, file_id long, point_index long, load_id int, extradata binary")
    u = D.unified_points(p, v, spark.createDataFrame(h, f"{HEADER}, {more}"))
    names = [n for group in D.VERSION_FIELDS.values() for n in group]
    got = {r[0]: r[1:] for r in map(tuple, u.select("point_id", *names, "start_of_waveform_data_x").collect())}
    none = (None,) * 4
    assert got == {1: (None, *none, None), 2: (d(9), *none, None), 3: (d(9), d(8), 7, 6, [5, 4], 5), 4: (None, *none, None)}


def test_unified_keeps_all(spark):
    record = lambda f, *x: (f, False, 0, "LASF_Spec", 4, bytearray(b"".join(desc(*y) for y in x)), "")
    v = spark.createDataFrame(
        [
            record(1, ("a", 1, "same"), ("b", 1, "same"), ("big", 7)), record(2, ("big", 8)), record(3, ("c", 8, "t"), ("k", 1, "many")), record(4, ("d", 8, "T"), ("k", 1, "many")),
            (5, False, 0, "LASF_Spec", 4, bytearray(ExtraField("k", 2, 8, scale=0.5).pack()), ""),
        ],
        VLR,
    )
    big = 2**53 + 1
    p = [(1, 1, 0, 1, struct.pack("<BBQ", 3, 4, 2**64 - 1)), (None, 2, 0, 1, struct.pack("<q", -big)), (None, 2, 1, 1, struct.pack("<q", big)), (3, 3, 0, 1, struct.pack("<qB", big, 7)), (4, 4, 0, 1, struct.pack("<qB", -big, 8)), (5, 5, 0, 1, b"\x01"), (5, 5, 0, 2, b"\x01")]
    p = spark.createDataFrame([(*r[:4], bytearray(r[4])) for r in p], "point_id long, file_id long, point_index long, load_id int, extradata binary")
    u = D.unified_points(p, v)
    assert "d" not in u.columns and dict(u.dtypes)["big"] == "decimal(20,0)" and dict(u.dtypes)["c"] == "bigint"
    got = sorted(((r.file_id, r.point_index, r.a, r.b, r.big, r.c, r.k) for r in u.collect()), key=lambda r: r[:2])
    n = None
    assert got == [(1, 0, 3, 4, 2**64 - 1, n, n), (2, 0, n, n, -big, n, n), (2, 1, n, n, big, n, n), (3, 0, n, n, n, big, 7.0), (4, 0, n, n, n, -big, 8.0), (5, 0, n, n, n, n, 0.5)]


def test_unified_keeps_the_first_load(spark):
    """Of copies that of the smallest load stays, whatever the order of rows."""
    p = spark.createDataFrame([(1, 1, 0, 3), (1, 1, 0, None), (1, 1, 0, 2), (2, 1, 1, None)], "point_id long, file_id long, point_index long, load_id int").withColumn("extradata", F.lit(None).cast("binary"))
    v = spark.createDataFrame([], VLR)
    assert sorted((r.point_id, r.load_id) for r in D.unified_points(p, v).collect()) == [(1, 2), (2, None)]


def test_days_in_parts(spark, monkeypatch):
    """Files of one day are numbered alike however its parts are cut."""
    h, _, _ = tables(spark)
    want = sorted(map(tuple, D.numbered_files(h).collect()), key=repr)
    monkeypatch.setattr(D, "FILE_RANGE", 1)
    assert sorted(map(tuple, D.numbered_files(h).collect()), key=repr) == want
