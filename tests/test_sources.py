"""Picture headers, hash tables, listings of large folders and quantile sketches."""

import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmark.functions import headers
from gridmark.operators import sketches
from gridmark.plans import build as build_plan
from gridmark.sources import images, listing
from tests.conftest import rows
from tests.test_plans import png, put, solid


def shapes(spark, pictures):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pictures)], "i INT, data BINARY")
    got = df.select("i", headers.picture_header(F.col("data")).alias("h")).orderBy("i").collect()
    return [None if r["h"] is None else tuple(r["h"]) for r in got]


def encoded(spark, kind, width, height):
    """A picture as the JVM writes it."""
    jvm = spark.sparkContext._jvm
    picture = jvm.java.awt.image.BufferedImage(width, height, jvm.java.awt.image.BufferedImage.TYPE_3BYTE_BGR)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(picture, kind, out)
    return bytes(out.toByteArray())


def riff(body):
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WEBP" + body


def test_headers_of_encoded_pictures(spark):
    sizes = [(1, 1), (300, 7), (64, 513)]
    for kind in ("png", "jpeg", "bmp"):
        pictures = [encoded(spark, "jpg" if kind == "jpeg" else kind, w, h) for w, h in sizes]
        assert shapes(spark, pictures) == [(kind, w, h, 3, True) for w, h in sizes]
        assert shapes(spark, [p[:-3] for p in pictures]) == [(kind, w, h, 3, False) for w, h in sizes]


def test_headers_by_hand(spark):
    lossy = riff(b"VP8 " + struct.pack("<I", 10) + b"\x30\x01\x00\x9d\x01\x2a" + struct.pack("<HH", 640 | 0x4000, 480))
    lossless = riff(b"VP8L" + struct.pack("<I", 5) + b"\x2f" + struct.pack("<I", 99 | (49 << 14) | (1 << 28)))
    extended = riff(b"VP8X" + struct.pack("<I", 10) + b"\x10\0\0\0" + (16383).to_bytes(3, "little") + (0).to_bytes(3, "little"))
    flipped = b"BM" + struct.pack("<IHHI", 58, 0, 0, 54) + struct.pack("<IiiHH", 40, 5, -9, 1, 32) + b"\0" * 28
    app = b"\xff\xe1" + struct.pack(">H", 30_000) + b"\xff\xc0" * 14_999
    frame = b"\xff\xff\xc2" + struct.pack(">HBHHB", 17, 8, 1234, 4321, 1)
    jpeg = b"\xff\xd8" + app * 12 + frame + b"\xff\xd9"
    gray = png(np.zeros((3, 4, 3), np.uint8))
    gray = gray[:25] + b"\x00" + gray[26:]
    good = [lossy, lossless, extended, flipped, jpeg, gray]
    assert shapes(spark, good) == [("webp", 640, 480, 3, True), ("webp", 100, 50, 4, True), ("webp", 16384, 1, 4, True),
                                   ("bmp", 5, 9, 4, True), ("jpeg", 4321, 1234, 1, True), ("png", 4, 3, 1, True)]
    bad = [None, b"", b"\xff", b"\xff\xd8\xff", b"\xff\xd8\xff\xda\0\x02" + frame, lossy[:25], extended[:28], flipped[:20], gray[:20], jpeg[:40], b"BM", b"text",
           gray[:25] + b"\x09" + gray[26:], riff(b"JUNK" * 9)]
    assert shapes(spark, bad) == [None] * len(bad)


def test_webp_files_need_a_size_and_an_end(spark, tmp_path):
    body = lambda w: b"VP8 " + struct.pack("<I", 10) + b"\x30\x01\x00\x9d\x01\x2a" + struct.pack("<HH", w, 480)
    for name, data in {"good": riff(body(640)), "none": riff(body(0)), "cut": riff(body(640))[:-1], "empty": b"", "text": b"RIFF"}.items():
        put(tmp_path, f"images/{name}.webp", data)
    found = images.image_errors(spark, str(tmp_path), listing.list_files(spark, str(tmp_path)))
    assert sorted(p for (p,) in rows(found, "rel_path")) == [f"images/{n}.webp" for n in ("cut", "empty", "none", "text")]


def test_known_hashes_are_not_read_again(spark, tmp_path):
    for i in range(6):
        put(tmp_path, f"pool/p{i}.png", solid(10 + i))
        put(tmp_path, f"pool/p{i}.txt", "0 .5 .5 .1 .1\n")
    put(tmp_path, "pool/empty.png", b"")
    root = str(tmp_path / "pool")
    first = images.hash_table(spark, root)
    first.write.parquet(str(tmp_path / "hashes"))
    known = spark.read.parquet(str(tmp_path / "hashes"))
    plain = {r["rel_path"]: (r["sha256"], r["actual_md5"]) for r in images.content_hashes(spark, root).collect()}
    stored = {r["rel_path"]: (r["sha256"], r["actual_md5"]) for r in known.collect()}
    assert {k: h for k, h in stored.items() if k != "empty.png"} == plain and len(stored) == 7
    # Other bytes behind the same length and time would be noticed if the file were read.
    times = os.stat(tmp_path / "pool/p0.png")
    put(tmp_path, "pool/p0.png", solid(10)[::-1])
    os.utime(tmp_path / "pool/p0.png", ns=(times.st_atime_ns, times.st_mtime_ns))
    put(tmp_path, "pool/p1.png", solid(99))
    put(tmp_path, "pool/new.png", solid(7))
    os.unlink(tmp_path / "pool/p2.png")
    second = {r["rel_path"]: r["sha256"] for r in images.hash_table(spark, root, known).collect()}
    assert second["p0.png"] == stored["p0.png"][0] and second["p3.png"] == stored["p3.png"][0] and second["p1.png"] != stored["p1.png"][0]
    assert set(second) == {"p0.png", "p1.png", "p3.png", "p4.png", "p5.png", "empty.png", "new.png"}
    fresh = listing.list_files(spark, root, modified=True).filter("rel_path LIKE '%.png'").join(known, images.MODIFIED, "left_anti")
    assert sorted(p for (p,) in rows(fresh, "rel_path")) == ["new.png", "p1.png"]
    built = build_plan.build_dataset(build_plan.scan_pool(spark, root, "physical_3d", "x", hashes=images.hash_table(spark, root, known)))
    assert rows(built.report, "total_scanned", "unique_retained") == [(7, 7)]


def test_a_large_folder_is_shared_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "PART_FILES", 100)
    for i in range(750):
        put(tmp_path, f"images/train/deep/{i // 700}/f{i}.txt" if i % 3 == 0 else f"images/train/f{i}.txt", "" if i % 5 else "x" * i)
    reader = listing._Reader(str(tmp_path), False)
    parts = reader.partitions()
    shares = [list(reader.read(p)) for p in parts]
    found = [r for share in shares for r in share]
    assert len(found) == len({r[0] for r in found}) == 750 and sum(r[2] for r in found) == sum(i for i in range(750) if i % 5 == 0)
    assert max(map(len, shares)) < 300 and sum(len(s) > 50 for s in shares) >= 5
    assert listing.list_files(spark, str(tmp_path)).count() == 750


def test_sketches_merge_within_the_error(spark, tmp_path):
    rng = random.Random(3)
    data = [(rng.choice("ab"), i % 5, rng.expovariate(1)) for i in range(20_000)] + [("a", 0, None), ("c", 1, float("nan")), (None, 2, 1.0)]
    df = spark.createDataFrame(data, "g STRING, day INT, v DOUBLE")
    for day in (0, 1, 2, 3, 4, 4):  # a part that is stored again replaces itself
        sketches.append_sketches(df.filter(F.col("day") == day), str(tmp_path / "s"), ["g"], "v", str(day), size=200)
    wanted = {f"q{i}": i / 10 for i in range(11)}
    merged = sketches.stored_sketches(spark, str(tmp_path / "s"), ["g"], size=200)
    whole = sketches.quantile_sketches(df, ["g"], "v", size=200)
    for table in (merged, whole):
        got = {r["g"]: r for r in sketches.sketch_quantiles(table, ["g"], wanted).collect()}
        assert set(got) == {"a", "b", None} and got[None]["q5"] == 1.0
        for g in "ab":
            values = np.sort([v for k, _, v in data if k == g and v is not None])
            assert got[g]["n"] == len(values) and got[g]["q0"] == values[0] and got[g]["q10"] == values[-1]
            for name, q in wanted.items():
                rank = np.searchsorted(values, got[g][name]) / len(values)
                assert abs(rank - q) <= 1.5 * sketches.rank_error(200) + 1e-4
    everything = sketches.merge_sketches(merged, [], size=200)
    assert everything.first()["n"] == 20_001


@pytest.mark.parametrize("size", [200, 800])
def test_the_stated_error(size):
    assert 0.003 < sketches.rank_error(size) < 0.014


def test_columns_taken_whole_equal_value_by_value():
    import pyarrow as pa

    from gridmark.sources import coco

    for taker, kind, columns in (
        (coco._whole, pa.int64(), [[1, None, 2], [True, 1, None], [1.0, 2], ["1"], []]),
        (coco._text, pa.string(), [["a", None], [1, "b"]]),
        (coco._number, pa.float64(), [[1.5, None], [1, 2.5], [True, "x"]]),
        (coco._numbers, pa.list_(pa.float64()), [[[1, 2.5], []], [[1, True, "x"], None], [[None, 1]], [None]]),
    ):
        for values in columns:
            assert coco._column(values, taker, kind).equals(pa.array([taker(v) for v in values], kind))
