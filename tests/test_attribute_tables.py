"""Attribute tables by ranges of records: what is written is read, in several partitions, whatever the ranges."""

import struct

import pytest
from pyspark.sql import functions as F

from brindle.session import table
from brindle.sources import attribute_tables as A

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def source(spark):
    spark.dataSource.register(A.AttributeTables)


def dbf(fields, rows, encoding, claimed=None):
    head = struct.pack("<BBBBIHH20x", 3, 126, 1, 1, len(rows) if claimed is None else claimed, 33 + 32 * len(fields), 1 + sum(w for _, _, w, _ in fields))
    head += b"".join(n.encode().ljust(11, b"\0") + k.encode() + bytes(4) + bytes([w, d]) + bytes(14) for n, k, w, d in fields)
    return head + b"\r" + b"".join(flag + b"".join(v.encode(encoding).ljust(w) for v, (_, _, w, _) in zip(r, fields)) for flag, r in rows) + b"\x1a"


def read(spark, path, **options):
    return spark.read.format("attribute_tables").options(**options).load(str(path))


def test_kinds_encodings_and_deleted_records(spark, tmp_path):
    one = [("DLMC", "C", 12, 0), ("TBMJ", "N", 8, 2), ("N", "N", 4, 0), ("OK", "L", 1, 0), ("X", "N", 4, 0)]
    rows = [(b" ", ("旱地", "12.5", "7", "T", "1")), (b"*", ("gone", "1", "1", "F", "2")), (b" ", ("水田", "", "abc", "?", "3")), (b" ", ("a\0bc", "1e3", "-2", "n", ""))]
    (tmp_path / "a.dbf").write_bytes(dbf(one, rows, "gbk"))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.DBF").write_bytes(dbf([("DLMC", "C", 12, 0), ("X", "C", 3, 0)], [(b" ", ("林地", "7"))], "utf-8", claimed=9))
    (tmp_path / "c.dbf").write_bytes(dbf([("DLMC", "C", 12, 0)], [], "utf-8"))
    (tmp_path / ".hidden.dbf").write_bytes(b"x")
    for records in (0, 1, 2):
        d = read(spark, tmp_path, records=records)
        assert dict(d.dtypes) == {"path": "string", "record": "bigint", "DLMC": "string", "TBMJ": "double", "N": "bigint", "OK": "boolean", "X": "string"}
        got = sorted(((r.path[-5:], r.record, r.DLMC, r.TBMJ, r.N, r.OK, r.X) for r in d.collect()), key=str)
        assert got == [("a.dbf", 0, "旱地", 12.5, 7, True, "1"), ("a.dbf", 2, "水田", None, None, None, "3"), ("a.dbf", 3, "a", 1000.0, -2, False, None), ("b.DBF", 0, "林地", None, None, None, "7")]
    assert read(spark, tmp_path, columns="N").columns == ["path", "record", "N"]
    assert [r.N for r in read(spark, tmp_path / "a.dbf", columns="N").orderBy("record").collect()] == [7, None, -2]


def test_an_encoding_that_begins_late(spark, tmp_path):
    rows = [(b" ", ("plain",))] * 40 + [(b" ", ("地类",))] + [(b" ", ("plain",))] * 40
    (tmp_path / "a.dbf").write_bytes(dbf([("T", "C", 8, 0)], rows, "gbk"))
    assert {r.T for r in read(spark, tmp_path, records=7).collect()} == {"plain", "地类"}


def test_errors(spark, tmp_path):
    (tmp_path / "a.dbf").write_bytes(b"short")
    with pytest.raises(Exception, match="no header"):
        read(spark, tmp_path).schema  # noqa: B018
    with pytest.raises(Exception, match="ten characters"):
        spark.createDataFrame([(1,)], "a_very_long_name int").write.format("attribute_tables").mode("append").save(str(tmp_path / "w"))
    with pytest.raises(Exception, match="254 is the most"):
        spark.createDataFrame([("x" * 300,)], "a string").write.format("attribute_tables").mode("append").save(str(tmp_path / "w"))


def test_written_tables_are_read_in_ranges(spark, tmp_path):
    t = table(spark, SF, "lineitem").select("l_orderkey", "l_tax", F.col("l_extendedprice").alias("price"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"), (F.col("l_tax") > 0.04).alias("taxed"))
    t.repartition(2).write.format("attribute_tables").mode("append").save(str(tmp_path / "t"))
    d = read(spark, tmp_path / "t", records=500)
    assert d.rdd.getNumPartitions() >= t.count() // 500
    assert sorted(map(tuple, d.drop("path", "record").collect())) == sorted(map(tuple, t.collect()))
