"""Packages in parts, inside each other, and broken ones."""

import io
import random
import zipfile

from lectern.sources import archives, packages


def packed(files, method=zipfile.ZIP_DEFLATED, **more):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in files.items():
            with z.open(name, "w", **more) as f:
                f.write(data)
    return out.getvalue()


def test_any_depth(spark):
    data = packed({"deep.txt": b"found"})
    for k in range(6):
        data = packed({f"level{k}.zip": data, f"note{k}.txt": b"note %d" % k})
    rows = packages.package_entries(spark.createDataFrame([("a", bytearray(data))], "path string, content binary")).collect()
    got = {r["entry"]: bytes(r["data"]) for r in rows}
    assert got.pop("/".join(f"level{k}.zip" for k in range(5, -1, -1)) + "/deep.txt") == b"found"
    assert len(got) == 6 and got["note5.txt"] == b"note 5" and got["level5.zip/level4.zip/level3.zip/note2.txt"] == b"note 2"


def test_parts(spark):
    """Parts far smaller than a package, its directory and its files; every method; places of eight bytes."""
    r = random.Random(4)
    size = 1000
    files = {f"f{k}.txt": r.randbytes(r.choice((0, 10, 999, 5000, 30_000))) for k in range(60)} | {f"{'n' * 200}{k}.md": b"x" for k in range(20)}
    whole = {"deflate": packed(files), "stored": packed(files, zipfile.ZIP_STORED), "bzip2": packed(files, zipfile.ZIP_BZIP2), "wide": packed(files, force_zip64=True), "lead": b"#!/bin/sh\n" * 50 + packed(files), "empty": packed({})}
    parts = [(p, k, bytearray(d[k * size : (k + 1) * size]), len(d)) for p, d in whole.items() for k in range(-(-len(d) // size))]
    r.shuffle(parts)
    rows = archives.expand(spark.createDataFrame(parts, "path string, part int, data binary, length bigint").repartition(5), size).collect()
    got = {}
    for x in rows:
        got.setdefault(x["path"], {})[x["entry"]] = x["error"] or bytes(x["data"])
    assert got == {p: files for p in whole if p != "empty"}


def test_broken(spark):
    good = packed({"a.txt": b"first words", "b.txt": b"second"}, zipfile.ZIP_STORED)
    spoiled = good.replace(b"first words", b"fir5t words")
    rows = [("good", good), ("spoiled", spoiled), ("none", b"PK no zip"), ("cut", good[: len(good) // 2]), ("empty", b""), ("lzma", packed({"a.txt": b"x"}, zipfile.ZIP_LZMA)), ("inner", packed({"bad.zip": b"nothing", "c.txt": b"c"}))]
    got = packages.package_entries(spark.createDataFrame([(p, bytearray(d)) for p, d in rows], "path string, content binary")).collect()
    told = {(r["path"], r["entry"]): (bytes(r["data"]) if r["data"] is not None else None, bool(r["error"])) for r in got}
    assert told == {
        ("good", "a.txt"): (b"first words", False), ("good", "b.txt"): (b"second", False), ("spoiled", "a.txt"): (None, True), ("spoiled", "b.txt"): (b"second", False), ("none", ""): (None, True),
        ("cut", ""): (None, True), ("empty", ""): (None, True), ("lzma", "a.txt"): (None, True), ("inner", "bad.zip/"): (None, True), ("inner", "c.txt"): (b"c", False),
    }
