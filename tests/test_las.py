import os
import struct

import numpy as np
import pytest
from pulsegrid.operators import cloud as C
from pulsegrid.operators import extrabytes as X
from pulsegrid.operators import records as R
from pulsegrid.sources import formats, header, las, vlr
from pulsegrid.streaming import ingest
from pyspark.sql import functions as F

LENGTHS = [20, 28, 26, 34, 57, 63, 30, 36, 38, 59, 67]


def test_layouts():
    assert [formats.base_length(k) for k in range(11)] == LENGTHS
    d = formats.record_dtype(10, 70)
    assert (d.fields["red"][1], d.fields["nir"][1], d.fields["wave_packet_descriptor"][1], d.fields["extradata"][1], d.itemsize) == (30, 36, 38, 67, 70)
    assert formats.record_dtype(0, 20).fields["scan_angle"][1] == 16 and formats.record_dtype(6, 30).fields["scan_angle"][1] == 18
    assert [formats.optimal_format({f[0] for f in formats.layout(k)}, k >= 6) for k in range(11)] == list(range(11))
    assert formats.optimal_format({"x", "red", "nir"}) == 8 and formats.optimal_format({"x", "gps_time"}) == 1


def golden(minor=2, pdrf=0, length=20, n=2, offset=None, size=None, major=1, sig=b"LASF"):
    size = {2: 227, 3: 235, 4: 375}.get(minor, 375) if size is None else size
    offset = size if offset is None else offset
    head = struct.pack("<4sHHIHH8sBB32s32sHHHIIBHI5I12d", sig, 7, 1, 11, 12, 13, b"abcdefgh", major, minor, b"sys\0junk", b"soft", 32, 2024, size, offset, 0, pdrf, length, n, 1, 1, 0, 0, 0, 0.01, 0.01, 0.001, 100.0, 200.0, 0.0, 101.0, 99.0, 202.0, 198.0, 3.0, -3.0)
    if minor >= 3:
        head += struct.pack("<Q", 0)
    if minor >= 4:
        head += struct.pack("<QIQ15Q", 0, 0, n, *([1, 1] + [0] * 13))
    return head


def write(path, data):
    with open(path, "wb") as f:
        f.write(data)
    return str(path)


def record(x, y, z, intensity, bits, cls, angle, user, source):
    return struct.pack("<iiiHBBbBH", x, y, z, intensity, bits, cls, angle, user, source)


def test_golden_bytes(spark, tmp_path):
    las.register(spark)
    body = record(-5, 150, 2000, 65535, 0b11001010, 255, -128, 9, 65535) + record(2**31 - 1, -(2**31), 0, 0, 1, 2, 127, 0, 1)
    path = write(tmp_path / "a.las", golden() + body)
    rows = spark.read.format("las").load(path).orderBy("point_index").collect()
    assert rows[0].asDict() == {"point_index": 0, "x": -5 * 0.01 + 100.0, "y": 150 * 0.01 + 200.0, "z": 2000 * 0.001, "intensity": 65535, "bits": 202, "classification": 255, "scan_angle": -128, "user_data": 9, "point_source_id": 65535}
    assert rows[1].x == (2**31 - 1) * 0.01 + 100.0 and rows[1].y == -(2**31) * 0.01 + 200.0
    h = spark.read.format("las").option("part", "header").load(path).first()
    assert (h.system_identifier, h.project_id_guid1, h.file_creation_year, h.max_x, h.min_z, h.number_of_point_records, h.start_of_waveform_data) == ("sys", 11, 2024, 101.0, -3.0, 2, None)
    assert header.pack(header.parse(golden(4, 6, 30))) == golden(4, 6, 30).replace(b"sys\0junk", b"sys\0\0\0\0\0").replace(struct.pack("<I5I", 2, 1, 1, 0, 0, 0), bytes(24))


@pytest.mark.parametrize(
    "data,rule",
    [
        (golden(sig=b"LASX"), 1), (golden(minor=5, pdrf=6, length=30), 2), (golden(offset=100), 3), (golden(pdrf=11), 4), (golden(pdrf=128), 5), (golden(major=2), 6),
        (golden(pdrf=3), 7), (golden(pdrf=11), 8), (golden(n=1000), 9), (golden(n=0), 10), (golden(pdrf=11, length=0), 11), (golden(offset=9999), 12),
    ],
)
def test_rules(spark, tmp_path, data, rule):
    las.register(spark)
    path = write(tmp_path / "b.las", data + bytes(200))
    found = {r.rule: r.effect for r in spark.read.format("las").option("part", "check").load(path).collect()}
    assert rule in found
    if found[rule] in ("reject", "error") or set(found.values()) & {"reject", "error"}:
        with pytest.raises(Exception):
            spark.read.format("las").load(path).count()
    elif found[rule] == "degrade":
        assert spark.read.format("las").load(path).columns == ["point_index", "x", "y", "z", "intensity"]


@pytest.mark.parametrize("pdrf", range(11))
def test_round_trip(spark, tmp_path, pdrf):
    a = C.random_cloud(spark, 300, pdrf, seed=pdrf + 1)
    b = C.write_cloud(a, str(tmp_path / "c.las"), partitions=3)
    assert C.same(a.points, b.points)
    n, got = 0, b.points.agg(*[F.min(c).alias(f"min_{c}") for c in "xyz"], *[F.max(c).alias(f"max_{c}") for c in "xyz"]).first()
    assert all(abs(b.header[k] - got[k]) < 1e-9 for k in got.asDict()) and b.header["number_of_point_records"] == 300
    number = a.points.groupBy(F.col("bits").cast("int").bitwiseAND(15 if pdrf >= 6 else 7).alias("r")).count().collect()
    for r in number:
        if 1 <= r.r <= len(b.header["number_of_points_by_return"]):
            n += r["count"]
            assert b.header["number_of_points_by_return"][r.r - 1] == r["count"]
    assert n > 0


def test_slices_and_skipping(spark, tmp_path):
    a = C.write_cloud(C.random_cloud(spark, 1000, 3), str(tmp_path / "d.las"))
    for size in (34, 34 * 7, 34 * 1000, 10**9):
        p = spark.read.format("las").option("split_bytes", size).load(str(tmp_path / "d.las"))
        assert p.count() == 1000 and p.agg(F.sum("point_index")).first()[0] == 499500
        assert size > 34 * 7 or p.rdd.getNumPartitions() > 100
    reader = spark.read.format("las").option("bbox", "50,50,60,60").load(str(tmp_path / "d.las"))
    assert reader.count() == 0
    assert spark.read.format("las").option("columns", "x,gps_time").load(str(tmp_path / "d.las")).columns == ["point_index", "x", "gps_time"]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = spark.read.format("las").option("pushdown", "true").load(str(tmp_path / "d.las"))
        assert pushed.where("x > 50").count() == 0 and pushed.where("x > 0.5").count() == a.points.where("x > 0.5").count()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_mixed_folder(spark, tmp_path):
    for k in (0, 3, 8):
        C.write_cloud(C.random_cloud(spark, 50, k), str(tmp_path / f"{k}.las"))
    p = spark.read.format("las").load(str(tmp_path))
    assert p.count() == 150 and p.columns[0] == "file_name"
    assert p.where("gps_time is null").count() == 50 and p.where("nir is null").count() == 100
    assert spark.read.format("las").option("part", "header").load(str(tmp_path)).count() == 3


def test_writer_errors(spark, tmp_path):
    las.register(spark)
    base = C.random_cloud(spark, 5, 0).points.drop("point_index")
    for bad in (base.drop("bits"), base.withColumn("intensity", F.lit(70000)), base.withColumn("x", F.lit(1e9)), base.withColumn("y", F.lit(None).cast("double")), base.withColumn("z", F.lit(float("nan")))):
        with pytest.raises(Exception):
            bad.coalesce(1).write.format("las").option("pdrf", "0").mode("overwrite").save(str(tmp_path / "e.las"))
    assert not os.listdir(tmp_path)


def test_extra_bytes(spark, tmp_path):
    a = C.random_cloud(spark, 200, 1)
    a = a.with_points(a.points.withColumn("dX", F.col("x") - 0.5).withColumn("n y", F.rand(3) * 2 - 1))
    a = a.with_points(a.points.withColumnRenamed("n y", "n_y"))
    eb = X.ExtraBytes.of(["dX", "n y"]).set_type("dX", "single").set_type("n y", "int16").set_scale("n y", 1 / 32767).set_bit("n y", X.SCALE, True)
    eb.set_description("dX", "difference").set_min("dX", -0.5).set_max("dX", 0.5).set_options("dX", False, True, True, False, False)
    assert eb.names == ["dX", "n_y"] and eb.size == 6
    w = C.write_cloud(C.encode_extrabytes(a, eb), str(tmp_path / "f.las"))
    assert w.header["point_data_record_length"] == 34
    back = C.extra_fields(w)
    assert [(f.name, f.data_type, f.options, f.description) for f in back.fields] == [("dX", 9, 6, "difference"), ("n_y", 4, 8, "")]
    got = C.decode_extrabytes(w).join(a.points.select("point_index", F.col("dX").alias("d0"), F.col("n_y").alias("n0")), "point_index")
    worst = got.select(F.max(F.abs(F.col("dX") - F.col("d0"))), F.max(F.abs(F.col("n_y") - F.col("n0")))).first()
    assert worst[0] < 1e-7 and worst[1] <= 0.5 / 32767 + 1e-12
    with pytest.raises(ValueError):
        C.decode_extrabytes(C.random_cloud(spark, 5, 0))
    with pytest.raises(KeyError):
        eb.set_scale("none", 1.0)
    f = X.ExtraField("v", 4, X.SCALE, scale=0.5)
    assert X.to_raw(np.array([0.25, -0.25, 1e9, -1e9, np.nan]), f).tolist() == [1, -1, 32767, -32768, 0]


def test_records(spark, tmp_path):
    a = C.add_wkt(C.add_text_area(C.random_cloud(spark, 10, 6), "one"), "short")
    a = C.add_text_area(a, "two")
    w = C.write_cloud(a, str(tmp_path / "g.las"))
    rows = {(r.user_id, r.record_id): r for r in w.records.collect()}
    assert rows["LASF_Spec", 3].data_as_text == "two" and rows["LASF_Spec", 3].idx == 0 and rows["LASF_Projection", 2112].idx == 1
    assert w.header["global_encoding"] & 16 and w.header["number_of_variable_records"] == 2
    for n, extended in ((65535, False), (65536, True)):
        w = C.write_cloud(C.add_wkt(w, "é" * n), str(tmp_path / f"{n}.las"))
        got = w.records.where("record_id = 2112").collect()
        assert len(got) == 1 and got[0].is_extended is extended and got[0].record_length == n and got[0].data_as_text == "é" * n
    w = C.write_cloud(C.add_wkt(w, "back"), str(tmp_path / "h.las"))
    assert [r.is_extended for r in w.records.where("record_id = 2112").collect()] == [False]
    assert R.has_record(w.records, 3) and not R.has_record(w.records, 4, "LASF_Spec")
    assert vlr.parse(b"\0" * 10, 0, 3, False) == []
    one = vlr.pack({"user_id": "u\0x", "record_id": 9, "description": "d" * 40, "data": b"\xff\0"}, True)
    assert len(one) == 62 and vlr.parse(one, 0, 1, True)[0] | {"data_as_text": ""} == {"is_extended": True, "idx": 0, "reserved": 0, "user_id": "u", "record_id": 9, "record_length": 2, "description": "d" * 32, "data": b"\xff\0", "data_as_text": ""}


def test_offsets_and_scale(spark):
    a = C.allocate(spark, 3, 2, 0)
    a = a.with_points(a.points.withColumn("x", F.col("point_index") * 10.0 + 101.3))
    assert C.update_offsets(a).header["x_offset"] == 111.0 and C.update_offsets(a, 10, True).header["x_offset"] == 100.0 and C.update_offsets(a, 0).header["x_offset"] == 0.5 * (121.3 + 101.3)
    s = C.optimise_scale(C.update_offsets(a, 10, True)).header
    assert abs(s["scale_factor_x"] * (2**31 - 1) - 21.3) < 1e-9 and s["scale_factor_y"] == 0.001


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    C.write_cloud(C.random_cloud(spark, 40, 1), str(src / "a.las"))
    q = spark.readStream.format("las").load(str(src)).writeStream.format("memory").queryName("las_in").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert spark.sql("select * from las_in").count() == 40
        C.write_cloud(C.random_cloud(spark, 60, 1), str(src / "b.las"))
        q.processAllAvailable()
        assert spark.sql("select * from las_in").count() == 100
    finally:
        q.stop()
    assert ingest.present(str(tmp_path / "none")) == []


@pytest.mark.parametrize("log", [False, True])
def test_stream_reads_each_file_once(spark, tmp_path, log):
    """Late files of older time, removed files and a restart from the checkpoint."""
    src = tmp_path / "in"
    src.mkdir()

    def run(target):
        reader = spark.readStream.format("las").options(**({"log": str(tmp_path / "log")} if log else {}))
        q = reader.load(str(src)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            q.processAllAvailable()
            assert spark.read.parquet(str(tmp_path / "out")).count() == target
            if target == 110:
                return
            C.write_cloud(C.random_cloud(spark, 30, 1), str(src / "c.las"))
            os.utime(src / "c.las", (1, 1))
            q.processAllAvailable()
            assert spark.read.parquet(str(tmp_path / "out")).count() == target + 30
            os.remove(src / "a.las")
            q.processAllAvailable()
            assert spark.read.parquet(str(tmp_path / "out")).count() == target + 30
        finally:
            q.stop()

    C.write_cloud(C.random_cloud(spark, 10, 1), str(src / "a.las"))
    C.write_cloud(C.random_cloud(spark, 20, 1), str(src / "b.las"))
    run(30)
    C.write_cloud(C.random_cloud(spark, 50, 1), str(src / "aa.las"))
    run(110)


def test_extra_bytes_keep_whole_numbers(spark):
    """64-bit numbers keep their last digits, null is no data, opaque bytes come back."""
    from decimal import Decimal

    eb = X.ExtraBytes([X.ExtraField("s", 8), X.ExtraField("u", 7), X.ExtraField("b", 0, 3), X.ExtraField("n", 4, X.NO_DATA, no_data=-999)])
    big = 2**53 + 1
    rows = [(1, -big, Decimal(2**64 - 1), bytearray(b"abc"), 5), (2, big, Decimal(big), bytearray(b"\0\1\2"), None)]
    p = spark.createDataFrame(rows, "id int, s long, u decimal(20,0), b binary, n int")
    got = X.decode(X.encode(p, eb), eb).orderBy("id").collect()
    assert [(r.id, r.s, r.u, bytes(r.b), r.n) for r in got] == [(i, s, u, bytes(b), n) for i, s, u, b, n in rows]


def test_load_finds_the_schema_of_mixed_files(spark, tmp_path):
    """The schema comes from a Spark job over headers; small files share a task, large ones are cut by their size."""
    src = tmp_path / "mixed"
    src.mkdir()
    for k in (0, 3, 6):
        C.write_cloud(C.random_cloud(spark, 500, k), str(src / f"f{k}.las"))
    got, want = las.load(spark, str(src)), spark.read.format("las").load(str(src))
    assert got.columns == want.columns and {"red", "bits2", "gps_time"} <= set(got.columns)
    assert got.count() == 1500 and got.where("red is not null").count() == 500
    files = las.sized_files(str(src))
    assert len(las.slices(files, 2**30)) == 1
    cut = las.slices(files, 4096)
    assert sum(len(s.pieces) for s in cut) == sum(-(-n // 4096) for _, n in files)
    many = spark.read.format("las").option("split_bytes", "4096").load(str(src))
    assert many.rdd.getNumPartitions() == len(cut)
    assert many.groupBy("file_name", "point_index").count().where("count > 1").isEmpty() and many.count() == 1500
    assert las.load(spark, str(src), columns="x,intensity").columns == ["file_name", "point_index", "x", "intensity"]


def test_nulls_are_not_written_as_zeros(spark, tmp_path):
    a = C.random_cloud(spark, 20, 1)
    a = a.with_points(a.points.withColumn("intensity", F.when(F.col("point_index") > 3, F.col("intensity"))))
    with pytest.raises(Exception):
        C.write_cloud(a, str(tmp_path / "n.las"))
    got = C.write_cloud(a, str(tmp_path / "n.las"), fill=7).points
    assert got.where("point_index <= 3 and intensity = 7").count() == 4
