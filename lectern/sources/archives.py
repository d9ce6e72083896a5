"""Packages of any size: a listing first, then each file from the parts that hold it, and packages inside packages.

A package comes in parts of one size, so no row holds more of it than that, however long it is. Its end tells where
its directory lies, and that where its files lie; each file is put together from its own parts, so the files of one
package are read by many tasks. Packages among the files are a worklist: they are expanded in turn until none is left.
"""

from __future__ import annotations

import bz2
import io
import struct
import zipfile
import zlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.shared import settle

#: Bytes of a part; bytes at a package's end that may hold its end record, and those in front of a file's data besides its name.
PART, END, HEAD = 8 << 20, 1 << 17, 30 + (1 << 16)
_FILES = "path string, name string, seen array<binary>, entry string, place bigint, packed bigint, size bigint, method int, crc bigint, error string"


def package_parts(packages: DataFrame, size: int = PART) -> DataFrame:
    """``path, part, data, length`` of ``path, content``."""
    n = F.octet_length("content")
    numbers = F.sequence(F.lit(0), F.greatest(F.ceil(n / size).cast("int") - 1, F.lit(0)))
    rows = packages.select("path", "content", n.cast("long").alias("length"), F.explode(numbers).alias("part"))
    return rows.select("path", "part", F.substring("content", F.col("part") * size + 1, F.lit(size)).alias("data"), "length")


class _Sparse(io.RawIOBase):
    """A file of which some stretches are known; what lies between reads as zeros."""

    def __init__(self, length: int, stretches: list[tuple[int, bytes]]) -> None:
        self.length, self.stretches, self.at = length, stretches, 0

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.length)[whence]
        return self.at

    def read(self, n: int = -1) -> bytes:
        n = max(0, min(self.length - self.at, n if n is not None and n >= 0 else self.length))
        out = bytearray(n)
        for start, data in self.stretches:
            a, b = max(self.at, start), min(self.at + n, start + len(data))
            if a < b:
                out[a - self.at : b - self.at] = data[a - start : b - start]
        self.at += n
        return bytes(out)


def directory_place(tail: bytes, start: int) -> tuple[int, int]:
    """Where the directory of a package begins and ends, from its last bytes, of which the first is at ``start``."""
    at = tail.rfind(b"PK\x05\x06")
    if at < 0 or at + 22 > len(tail):
        raise zipfile.BadZipFile("no end record")
    size, place = struct.unpack("<LL", tail[at + 12 : at + 20])
    end = start + at
    if 0xFFFFFFFF in (size, place) and tail[at - 20 : at - 16] == b"PK\x06\x07":
        (wide,) = struct.unpack("<Q", tail[at - 12 : at - 4])
        end = wide
        size, place = struct.unpack("<QQ", tail[wide - start + 40 : wide - start + 56])
    # bytes in front of the package shift all places
    return end - size, end


def _within(from_: Column, to: Column, size: int) -> Column:
    """The numbers of the parts that hold bytes from a place up to another."""
    return F.sequence(F.floor(from_ / size).cast("int"), F.floor(F.greatest(to - 1, from_) / size).cast("int"))


def _listing(parts: DataFrame, size: int) -> DataFrame:
    """A row of ``_FILES`` for each file of each package, or for a package that can't be read."""
    of = ["path", "name", "seen"]
    whole = parts.groupBy(*of, "length").agg(F.count("*").alias("parts"))
    last = parts.where((F.col("part") + 1) * size > F.col("length") - END)

    def find(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        length, tail = int(group["length"].iloc[0]), b"".join(group["data"])
        begin, end, error = 0, 0, None
        try:
            begin, end = directory_place(tail, length - len(tail))
        except (zipfile.BadZipFile, struct.error) as e:
            error = str(e)
        return pd.DataFrame({"path": [group["path"].iloc[0]], "name": [group["name"].iloc[0]], "begin": [begin], "end": [length if error is None else 0], "error": [error]})

    named = last.select("path", "name", "part", "data", "length")
    found = settle(named.groupBy("path", "name").applyInPandas(find, "path string, name string, begin bigint, end bigint, error string"))
    needed = found.where("error is null").select("path", "name", F.explode(_within(F.col("begin"), F.col("end"), size)).alias("part"))
    held = parts.select("path", "name", "part", "data", "length").join(settle(needed).hint("merge"), ["path", "name", "part"])

    def read(group: pd.DataFrame) -> pd.DataFrame:
        stretches = [(int(p) * size, bytes(d)) for p, d in zip(group["part"], group["data"], strict=True)]
        rows: list[tuple] = []
        try:
            with zipfile.ZipFile(_Sparse(int(group["length"].iloc[0]), stretches)) as z:
                for i in z.infolist():
                    folders = i.filename.split("/")
                    if not (i.is_dir() or any(f.startswith(".") for f in folders) or "__MACOSX" in folders):
                        rows.append((i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC, "encrypted" if i.flag_bits & 1 else None))
        except (zipfile.BadZipFile, OSError, struct.error, ValueError, NotImplementedError) as e:
            rows = [("", 0, 0, 0, 0, 0, str(e))]
        out = pd.DataFrame(rows, columns=["entry", "place", "packed", "size", "method", "crc", "error"])
        return out.assign(path=group["path"].iloc[0], name=group["name"].iloc[0])

    listed = held.groupBy("path", "name").applyInPandas(read, "entry string, place bigint, packed bigint, size bigint, method int, crc bigint, error string, path string, name string")
    bad = found.where("error is not null").select(
        F.lit("").alias("entry"), *(F.lit(0).cast("long").alias(c) for c in ("place", "packed", "size")), F.lit(0).alias("method"), F.lit(0).cast("long").alias("crc"), "error", "path", "name"
    )
    ids = whole.select(F.col("path").alias("_path"), F.col("name").alias("_name"), "seen").hint("merge")
    every = settle(listed.unionByName(bad))
    joined = every.join(ids, (F.col("path") == F.col("_path")) & (F.col("name") == F.col("_name")))
    return settle(joined.select(*(f.split()[0] for f in _FILES.split(", "))))


def unpacked(stretch: bytes, packed: int, size: int, method: int, crc: int) -> bytes:
    """A file's bytes from those that begin with its own head."""
    if stretch[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile("no file head")
    name, extra = struct.unpack("<HH", stretch[26:30])
    data = stretch[30 + name + extra : 30 + name + extra + packed]
    if method == zipfile.ZIP_DEFLATED:
        data = zlib.decompressobj(-15).decompress(data)
    elif method == zipfile.ZIP_BZIP2:
        data = bz2.decompress(data)
    elif method != zipfile.ZIP_STORED:
        raise NotImplementedError(f"method {method}")
    if len(data) != size or zlib.crc32(data) != crc:
        raise zipfile.BadZipFile("wrong checksum")
    return data


def _expanded(parts: DataFrame, size: int) -> DataFrame:
    """``path, name, seen, entry, data, error``: the files of packages in parts (``path, name, seen, part, data, length``)."""
    files = _listing(parts, size)
    good = files.where("error is null")
    # a file's head may be followed by other bytes than the directory tells, so a little more is read
    after = F.col("place") + F.col("packed") + F.octet_length("entry") + HEAD
    wanted = settle(good.select("path", "name", "entry", "place", "packed", "size", "method", "crc", F.explode(_within(F.col("place"), after, size)).alias("part")))
    held = wanted.hint("merge").join(parts.select("path", "name", "part", "data"), ["path", "name", "part"])

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        one = group.iloc[0]
        stretch = b"".join(group["data"])[int(one["place"]) - int(one["part"]) * size :]
        data, error = None, None
        try:
            data = unpacked(stretch, int(one["packed"]), int(one["size"]), int(one["method"]), int(one["crc"]))
        except (zipfile.BadZipFile, OSError, EOFError, ValueError, struct.error, zlib.error, NotImplementedError) as e:
            error = str(e)
        return pd.DataFrame({"path": [one["path"]], "name": [one["name"]], "entry": [one["entry"]], "place": [one["place"]], "data": [data], "error": [error]})

    made = held.groupBy("path", "name", "place").applyInPandas(build, "path string, name string, entry string, place bigint, data binary, error string")
    seen = good.select("path", "name", "place", "seen").hint("merge")
    read = made.join(seen, ["path", "name", "place"]).select("path", "name", "seen", "entry", "data", "error")
    return read.unionByName(files.where("error is not null").select("path", "name", "seen", "entry", F.lit(None).cast("binary").alias("data"), "error"))


def expand(parts: DataFrame, size: int = PART) -> DataFrame:
    """``path, entry, data, error``: the files of packages ``path, part, data, length``, those of packages inside them too, to any depth.

    A package, or a file of one, that can't be read gives a row with its error, as does a package
    that lies inside itself; none stops the others.
    """
    none = F.array().cast("array<binary>")
    level = parts.select("path", F.lit("").alias("name"), none.alias("seen"), "part", "data", "length")
    done: list[DataFrame] = []
    while True:
        found = settle(_expanded(level, size)).withColumn("entry", F.concat("name", "entry"))
        inner = F.col("error").isNull() & F.endswith(F.lower("entry"), F.lit(".zip"))
        again = F.array_contains("seen", F.sha2("data", 256).cast("binary"))
        done.append(found.where(~inner).select("path", "entry", "data", "error"))
        done.append(found.where(inner & again).select("path", "entry", F.lit(None).cast("binary").alias("data"), F.lit("a package inside itself").alias("error")))
        nested = settle(found.where(inner & ~again).select("path", F.concat("entry", F.lit("/")).alias("name"), F.concat("seen", F.array(F.sha2("data", 256).cast("binary"))).alias("seen"), F.col("data").alias("content")))
        if nested.isEmpty():
            return reduce(DataFrame.unionByName, done)
        whole = nested.select(F.struct("path", "name", "seen").alias("path"), "content")
        level = package_parts(whole, size).select("path.*", "part", "data", "length")
