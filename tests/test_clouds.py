"""Cloud files written here byte by byte and read back."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.sources import clouds as C

ROWS = [(1.5, -2.0, 3.0, 7.0), (0.25, 0.5, -1.0, 9.0), (4.0, 5.0, 6.0, 0.0)]
HEADER = "ply\nformat {}\ncomment made here\nelement vertex 3\nproperty float x\nproperty float y\nproperty double z\nproperty uchar intensity\nelement face 0\nproperty list uchar int vertex_indices\nend_header\n"
PCD = "# .PCD v0.7\nVERSION 0.7\nFIELDS x y z intensity\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 1 1 1 1\nWIDTH 3\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS 3\nDATA {}\n"


def as_rows(columns):
    return [tuple(float(v) for v in r) for r in zip(columns["x"], columns["y"], columns["z"], columns["intensity"], strict=True)]


def lines():
    return "".join(" ".join(map(str, r)) + "\n" for r in ROWS).encode()


def literals(data):
    """An LZF stream of literals alone."""
    return b"".join(bytes([len(data[i : i + 32]) - 1]) + data[i : i + 32] for i in range(0, len(data), 32))


def test_ply_in_text_and_both_byte_orders():
    assert as_rows(C.ply(HEADER.format("ascii 1.0").encode() + lines().replace(b".0\n", b"\n"))) == ROWS
    for name, order in (("binary_little_endian", "<"), ("binary_big_endian", ">")):
        body = b"".join(struct.pack(order + "ffdB", *r[:3], int(r[3])) for r in ROWS)
        assert as_rows(C.ply(HEADER.format(name + " 1.0").encode() + body)) == ROWS


def test_ply_passes_over_elements_before_the_vertices():
    head = b"ply\nformat binary_little_endian 1.0\nelement camera 2\nproperty int id\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nend_header\n"
    assert C.ply(head + struct.pack("<ii", 8, 9) + struct.pack("<fff", 1, 2, 3))["z"].tolist() == [3.0]


def test_pcd_text_binary_and_compressed():
    packed = np.array(ROWS, "<f4")
    assert as_rows(C.pcd(PCD.format("ascii").encode() + lines())) == ROWS
    assert as_rows(C.pcd(PCD.format("binary").encode() + packed.tobytes())) == ROWS
    stream = literals(packed.T.tobytes())
    data = struct.pack("<II", len(stream), packed.nbytes) + stream
    assert as_rows(C.pcd(PCD.format("binary_compressed").encode() + data)) == ROWS


def test_pcd_padding_and_fields_of_several_numbers():
    head = b"FIELDS x _ y z _ n\nSIZE 4 1 4 4 1 4\nTYPE F U F F U F\nCOUNT 1 2 1 1 2 2\nWIDTH 1\nHEIGHT 1\nDATA binary\n"
    out = C.pcd(head + struct.pack("<fBBffBBff", 1, 0, 0, 2, 3, 0, 0, 4, 5))
    assert [out[c].tolist() for c in ("x", "y", "z", "n_0", "n_1")] == [[1.0], [2.0], [3.0], [4.0], [5.0]]


def test_references_may_overlap_themselves():
    # "ab", then seven bytes from two back, then two more from nine back.
    assert C.unpack(bytes([1]) + b"ab" + bytes([5 << 5, 1]), 9) == b"ababababa"
    assert C.unpack(bytes([0]) + b"x" + bytes([7 << 5, 3, 0]), 13) == b"x" * 13
    with pytest.raises(ValueError):
        C.unpack(bytes([32, 0]), 3)


def test_text_formats():
    assert C.xyz(b"# c\n1 2 3\n\n4,5,6\n")["y"].tolist() == [2.0, 5.0]
    assert C.obj(b"o a\nv 1 2 3\nvn 0 0 1\nv 4 5 6 1\nf 1 2 1\n")["x"].tolist() == [1.0, 4.0]
    assert C.off(b"OFF\n2 0 0\n1 2 3\n4 5 6\n")["z"].tolist() == [3.0, 6.0]
    assert C.off(b"OFF 1 0 0\n1 2 3\n")["z"].tolist() == [3.0]


def test_all_files_below_a_path(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "scan10.ply").write_bytes(HEADER.format("ascii 1.0").encode() + lines())
    (tmp_path / "scan2.pcd").write_bytes(PCD.format("ascii").encode() + lines())
    (tmp_path / "empty.xyz").write_bytes(b"")
    (tmp_path / "one.xyz").write_bytes(b"nan 2 3\n")
    (tmp_path / "other.bin").write_bytes(b"no cloud")
    rows = C.read_clouds(spark, str(tmp_path)).collect()
    assert len(rows) == 7
    for name in ("scan10.ply", "scan2.pcd"):
        found = sorted((r.pt_id, r.x, r.y, r.z, r.intensity) for r in rows if r.path.endswith(name))
        assert found == [(k, *r) for k, r in enumerate(ROWS)]
    one = next(r for r in rows if r.path.endswith("one.xyz"))
    assert one.y == 2.0 and one.t is None and one.x is None


def test_large_files_leave_in_frames(monkeypatch):
    monkeypatch.setattr(C, "FRAME", 2)
    frames = list(C.decode("f.xyz", b"1 2 3\n4 5 6\n7 8 9\n"))
    assert [f["pt_id"].tolist() for f in frames] == [[0, 1], [2]]


def test_a_broken_file_is_named():
    with pytest.raises(ValueError, match="b.off"):
        list(C.decode("b.off", b"nothing"))


def test_natural_order_and_sweep_time(spark):
    names = spark.createDataFrame([("s10",), ("s2",), ("s1_20",), ("s1_3",)], "path string")
    assert [r.path for r in names.orderBy(C.natural_key("path")).collect()] == ["s1_3", "s1_20", "s2", "s10"]
    rows = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("a", float("nan")), ("b", 0.0)], "path string, t double")
    out = {(r.path, str(r.t)): r.rel for r in C.sweep_time(rows).collect()}
    assert out == {("a", "2.0"): 0.5, ("a", "4.0"): 1.0, ("a", "nan"): None, ("b", "0.0"): None}


def test_keys_are_columns_that_plans_can_sort(spark):
    plan = spark.createDataFrame([("f1",)], "path string").select(C.natural_key(F.col("path")).alias("k"))
    assert plan.collect()[0].k == "f" + "1".rjust(20, "0")
