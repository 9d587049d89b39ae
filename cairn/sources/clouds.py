"""Point clouds in self-describing files: PLY, PCD and the text formats XYZ, OBJ and OFF.

As with scans, a file is decoded at a time and leaves in frames of bounded size; write the points
to Parquet once, since filters don't push below a decoder. An empty file has no points, a
point with NaN coordinates stays and has null there, and a file that breaks its format fails with its path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

POINTS = "path string, pt_id long, x double, y double, z double, intensity double, t double"
#: Points of a frame that leaves the decoder.
FRAME = 1 << 20

#: Number formats by their names in PLY headers (fixed values).
PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
#: Names under which files carry intensity and time.
INTENSITY, TIME = ("intensity", "scalar_intensity", "i"), ("t", "time", "timestamp", "scalar_timestamp")

Columns = dict[str, np.ndarray]


def _text_table(lines: list[bytes], names: list[str]) -> Columns:
    rows = np.array([line.split()[: len(names)] for line in lines], dtype=np.float64).reshape(-1, len(names))
    return {n: rows[:, k] for k, n in enumerate(names)}


def ply(content: bytes) -> Columns:
    """The scalar properties of the vertices; text and both byte orders."""
    end = content.index(b"\n", content.index(b"end_header")) + 1
    kind, elements = "", []
    for line in content[:end].decode("ascii", "replace").splitlines():
        part = line.split()
        if part[:1] == ["format"]:
            kind = part[1]
        elif part[:1] == ["element"]:
            elements.append((part[1], int(part[2]), []))
        elif part[:1] == ["property"]:
            elements[-1][2].append((part[-1], None if part[1] == "list" else PLY_TYPES[part[1]]))
    lines = content[end:].splitlines() if kind == "ascii" else []
    order, skip, at = ">" if kind == "binary_big_endian" else "<", 0, end
    for name, count, fields in elements:
        lists = any(t is None for _, t in fields)
        if name == "vertex":
            if lists:
                raise ValueError("lists within vertices")
            if kind == "ascii":
                return _text_table(lines[skip : skip + count], [n for n, _ in fields])
            rows = np.frombuffer(content, np.dtype([(n, order + t) for n, t in fields]), count, at)
            return {n: rows[n] for n, _ in fields}
        if lists and kind != "ascii":
            raise ValueError("binary lists before the vertices")
        skip += count
        at += count * sum(np.dtype(t).itemsize for _, t in fields if t)
    return {}


def unpack(data: bytes, size: int) -> bytes:
    """The bytes of an LZF stream: runs of literals, and references back that may overlap themselves."""
    out, i = bytearray(), 0
    while i < len(data):
        control = data[i]
        i += 1
        if control < 32:
            out += data[i : i + control + 1]
            i += control + 1
            continue
        length = control >> 5
        if length == 7:
            length += data[i]
            i += 1
        back = ((control & 31) << 8) + data[i] + 1
        i += 1
        length += 2
        run = bytes(out[-back:][:length]) if back <= len(out) else b""
        if not run:
            raise ValueError("a reference before the start")
        out += (run * (length // len(run) + 1))[:length]
    if len(out) != size:
        raise ValueError(f"{len(out)} bytes unpacked, {size} expected")
    return bytes(out)


def pcd(content: bytes) -> Columns:
    """Fields of a PCD file; one of several numbers is name_0, name_1... Text, binary and compressed data."""
    head: dict[str, list[str]] = {}
    at = 0
    while "DATA" not in head:
        end = content.index(b"\n", at)
        part = content[at:end].decode("ascii", "replace").split()
        at = end + 1
        if part and not part[0].startswith("#"):
            head[part[0]] = part[1:]
    names = head["FIELDS"]
    counts = [int(c) for c in head.get("COUNT", ["1"] * len(names))]
    types = ["<" + t.lower() + s for t, s in zip(head["TYPE"], head["SIZE"], strict=True)]
    fields = [(n if c == 1 else f"{n}_{k}", t) for n, c, t in zip(names, counts, types, strict=True) for k in range(c)]
    n = int(head["POINTS"][0]) if "POINTS" in head else int(head["WIDTH"][0]) * int(head["HEIGHT"][0])
    how = head["DATA"][0]
    if how == "ascii":
        return _text_table(content[at:].splitlines()[:n], [f for f, _ in fields])
    if how == "binary":
        # Padding has one name however often it occurs: read by place.
        rows = np.frombuffer(content, np.dtype([(f"f{k}", t) for k, (_, t) in enumerate(fields)]), n, at)
        return {f: rows[f"f{k}"] for k, (f, _) in enumerate(fields)}
    if how != "binary_compressed":
        raise ValueError(f"data {how}")
    packed, size = (int(v) for v in np.frombuffer(content, "<u4", 2, at))
    data, out, at = unpack(content[at + 8 : at + 8 + packed], size), {}, 0
    for name, count, kind in zip(names, counts, types, strict=True):
        rows = np.frombuffer(data, kind, n * count, at).reshape(n, count)
        at += rows.nbytes
        for k in range(count):
            out[name if count == 1 else f"{name}_{k}"] = rows[:, k]
    return out


def xyz(content: bytes) -> Columns:
    """Lines of x y z and, if there is a fourth number, intensity; other lines are comments."""
    lines = [x for line in content.splitlines() if (x := line.replace(b",", b" ").strip()) and not x.startswith((b"#", b"//"))]
    width = min((len(x.split()) for x in lines), default=3)
    if width < 3:
        raise ValueError("fewer than three numbers in a line")
    return _text_table(lines, ["x", "y", "z", "intensity"][: min(width, 4)])


def obj(content: bytes) -> Columns:
    """Vertices in order; faces and all else are passed over."""
    return _text_table([x[2:] for line in content.splitlines() if (x := line.strip()).startswith((b"v ", b"v\t"))], ["x", "y", "z"])


def off(content: bytes) -> Columns:
    lines = [x for line in content.splitlines() if (x := line.split(b"#")[0].strip())]
    head = re.match(rb"[A-Za-z0-9]*OFF\b", lines[0]) if lines else None
    if not head:
        raise ValueError("no OFF header")
    rest = lines[0][head.end() :].strip()
    lines = ([rest] if rest else []) + lines[1:]
    return _text_table(lines[1 : 1 + int(lines[0].split()[0])], ["x", "y", "z"])


READERS = {"ply": ply, "pcd": pcd, "xyz": xyz, "txt": xyz, "obj": obj, "off": off}


def decode(path: str, content: bytes) -> Iterator[pd.DataFrame]:
    """Frames of a file's points, by its extension."""
    if not content:
        return
    try:
        found = {k.lower(): v for k, v in READERS[path.rsplit(".", 1)[-1].lower()](content).items()}
        n = len(found["x"]) if found else 0
        other = [next((found[c] for c in names if c in found), np.full(n, np.nan)) for names in (INTENSITY, TIME)]
        columns = dict(zip(("x", "y", "z", "intensity", "t"), [found[c] for c in "xyz"] + other, strict=True)) if n else {}
    except (ValueError, KeyError, IndexError) as error:
        raise ValueError(f"{path}: {error}") from error
    for a in range(0, n, FRAME):
        rows = {c: v[a : a + FRAME].astype(np.float64) for c, v in columns.items()}
        yield pd.DataFrame({"path": path, "pt_id": np.arange(a, min(n, a + FRAME))} | rows)


def read_clouds(spark: SparkSession, path: str, glob: str = "*.{ply,pcd,xyz,obj,off}") -> DataFrame:
    """SC8, SC10, SC11, SC19: points of all files below a path; intensity and t are null where a file has none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                yield from decode(name, content)

    return files.select("path", "content").mapInPandas(run, POINTS)


def natural_key(path: str | Column) -> Column:
    """SC19: a sort key by which file 2 comes before file 10; digits of 20 places at most compare as numbers."""
    column = F.col(path) if isinstance(path, str) else path
    parts = F.regexp_extract_all(column, F.lit(r"(\d+|\D+)"), F.lit(1))
    padded = F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$") & (F.length(p) < 20), F.lpad(p, 20, "0")).otherwise(p))
    return F.array_join(padded, "")


def sweep_time(points: DataFrame) -> DataFrame:
    """SC11: rel, the time of a point by the greatest of its file; null where that is 0 or there is none."""
    top = F.max(F.nanvl("t", F.lit(None).cast("double"))).over(Window.partitionBy("path"))
    return points.withColumn("rel", F.when(top != 0, F.nanvl("t", F.lit(None).cast("double")) / top))
