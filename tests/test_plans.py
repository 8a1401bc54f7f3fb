import json
import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmark import file_sink, sinks
from gridmark.config import AuditConfig, ScreenWeights
from gridmark.errors import EmptyDatasetError, GridmarkError
from gridmark.functions import pixels as px
from gridmark.operators import features, parallax, positions
from gridmark.plans import audit as audit_plan
from gridmark.plans import build as build_plan
from gridmark.plans import diagnose
from gridmark.plans.standardize import standardize_folder
from gridmark.sources import coco, images, json_ranges, labels, listing, tables, voc
from gridmark.streaming import incremental
from tests.conftest import rows


def png(pixels: np.ndarray) -> bytes:
    """Minimal encoder of an (h, w, 3) RGB byte array."""
    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def solid(value, size=16) -> bytes:
    return png(np.full((size, size, 3), value, np.uint8))


def put(root, path, content):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(content if isinstance(content, bytes) else content.encode())


# -- sources ----------------------------------------------------------------------


def test_listing_keeps_empty_files(spark, tmp_path):
    for path, content in {"a.txt": "x", "d/b.txt": "", "d/e/c.txt": "yz", "d/e/f/g/h i+1.txt": "1"}.items():
        put(tmp_path, path, content)
    got = sorted(rows(listing.list_files(spark, str(tmp_path)), "rel_path", "length"))
    assert got == [("a.txt", 1), ("d/b.txt", 0), ("d/e/c.txt", 2), ("d/e/f/g/h i+1.txt", 1)]
    text = labels.read_label_text(spark, str(tmp_path))
    assert sorted(p for (p,) in rows(text, "rel_path")) == ["a.txt", "d/e/c.txt", "d/e/f/g/h i+1.txt"]


def test_label_lines_keep_their_numbers(spark, tmp_path):
    put(tmp_path, "a.txt", "# head\r\n\r\n0 .5 .5 .1 .1\n  1 .5 .5 .1 .1 .8  \n\n")
    put(tmp_path, "classes.txt", "white_pawn")
    lines = labels.label_lines(labels.read_label_text(spark, str(tmp_path)))
    assert sorted(rows(lines, "rel_path", "line_number")) == [("a.txt", 3), ("a.txt", 4)]
    assert sorted(rows(labels.parse_labels(lines), "raw_label", "conf")) == [("0", 1.0), ("1", 0.8)]


def test_class_counts_take_any_digits(spark, tmp_path):
    put(tmp_path, "a.txt", "0 x\n0\n77 1\nwP .5\n-1 .5\n# 3\n")
    counts = labels.label_class_counts(labels.read_label_text(spark, str(tmp_path)))
    assert sorted(rows(counts, "class_id", "n")) == [(0, 2), (77, 1)]


def test_coco_documents(spark, tmp_path):
    document = {
        "images": [{"id": 7, "file_name": "a.jpg", "width": 1000, "height": 1000}],
        "categories": [{"id": 1, "name": "p"}, {"id": 12, "name": "k"}],
        "annotations": {"pieces": [
            {"image_id": 7, "category_id": 1, "bbox": [100, 200, 50, 80]},
            {"image_id": 7, "category_id": 12, "bbox": [10, 20, 5, 8], "score": 0.5},
            {"image_id": 7, "bbox": [1, 2, 3, 4]}, {"image_id": 7, "category_id": 2, "bbox": [1, 2]},
        ]},
    }
    put(tmp_path, "x.json", json.dumps(document, indent=1))
    docs = coco.read_documents(spark, str(tmp_path))
    assert rows(coco.document_counts(docs), "images", "boxes", "categories") == [(1, 4, 2)]
    got = sorted(rows(coco.annotations(docs).select("raw_label", *[F.round(c, 6) for c in ("xc", "yc", "w", "h")], "conf")))
    assert got == [("1", 0.125, 0.24, 0.05, 0.08, 1.0), ("12", 0.0125, 0.024, 0.005, 0.008, 0.5)]
    # A second document with the same image id and another size, and a box whose image is not listed.
    other = {"images": [{"id": 7, "file_name": "b.jpg", "width": 500, "height": 500}],
             "annotations": {"pieces": [{"image_id": 7, "category_id": 3, "bbox": [100, 200, 50, 80]},
                                        {"image_id": 8, "category_id": 4, "bbox": [1, 2, 3, 4]}]}}
    put(tmp_path, "y.json", json.dumps(other))
    found = coco.annotations(coco.read_documents(spark, str(tmp_path)))
    assert sorted(rows(found.filter("image_listed").select("raw_label", F.round("xc", 4)))) == [("1", 0.125), ("12", 0.0125), ("3", 0.25)]
    assert rows(coco.unlisted_images(found), "image_id", "violation_type", "xc") == [(8, "unlisted_image", None)]


def test_coco_images_listed_twice_and_equal_keys(spark):
    for n in (2, 40):  # matched within the row, and by a shuffle
        images = [(i % (n // 2), f"{i}.jpg", 100 * (1 + i), 100) for i in range(n)]
        docs = spark.createDataFrame(
            [("k", images, ([(0, 1, [10.0, 10.0, 20.0, 20.0], None), (99, 2, [1.0, 2.0, 3.0, 4.0], None)],)),
             ("k", [(0, "z.jpg", 400, 400)] * n, ([(0, 3, [10.0, 10.0, 20.0, 20.0], 0.5)],)), ("k", None, None)],
            f"path STRING, images ARRAY<{coco.IMAGE}>, annotations STRUCT<pieces: ARRAY<{coco.PIECE}>>",
        )
        got = sorted(rows(coco.annotations(docs), "path", "file_name", "raw_label", "image_listed", "w"), key=str)
        assert got == [("k", "0.jpg", "1", True, 0.2), ("k", "z.jpg", "3", True, 0.05), ("k", None, "2", False, None)]


def coco_text(seed, n, nested=True, indent=None):
    """A document with strings that look like JSON, escapes, nested values and fields of wrong types."""
    rng = random.Random(seed)
    odd = ['a.jpg', '"},{"id": 3', "\\", 'x\\"', "[{]}", "é\u2028", "", "\\\\\"{"]
    images = [{"id": rng.choice([i, i, 0, None, "7", True]), "file_name": rng.choice(odd) + str(i), "width": rng.choice([100, 200, None, 1.5]), "height": 100,
               "extra": {"id": 5, "tags": [[1], {"images": [{"id": 1}]}]}} for i in range(n)]
    pieces = [{"image_id": rng.randrange(n + 1), "category_id": rng.choice([1, 2, None]), "bbox": rng.choice([[1, 2, 3, 4.5], [1], None, [5, 6, 7, 8, 9]]),
               "segmentation": [[1, 2], {"counts": "]}"}], **rng.choice([{}, {"score": 0.25}, {"score": "high"}])} for _ in range(3 * n)]
    body = {"info": {"images": [{"id": 1}], "pieces": [{"image_id": 0}], "note": rng.choice(odd)}, "images": images,
            "annotations": {"all": [1], "pieces": pieces} if nested else pieces, "categories": [{"id": 1, "name": rng.choice(odd)}, None, 3]}
    return json.dumps(body, indent=indent, ensure_ascii=bool(seed % 2)), body


@pytest.mark.parametrize("seed", range(8))
def test_elements_of_ranges_of_any_size(tmp_path, seed):
    texts = [coco_text(100 * seed + i, 1 + seed, nested=i % 2 == 0, indent=[None, 1][i // 2 % 2]) for i in range(4)]
    data = "\n".join(t for t, _ in texts).encode()
    put(tmp_path, "d.json", data)
    path = str(tmp_path / "d.json")
    for size in (1, 7, 64, 1000, len(data), 10**6) if seed == 0 else (13, 333):
        summaries = []
        for start in range(0, len(data), size):
            for state in (json_ranges.OUTSIDE, json_ranges.STRING, json_ranges.ESCAPE):
                part = json_ranges.scan(data[start : start + size], state)
                left = part.left_open()
                summaries.append({"path": path, "start": start, "end": min(len(data), start + size), "state": state, "after": part.state, "closed": part.closed,
                                  "at": (part.at[left] + start).tolist(), "array": (part.char[left] == 91).tolist()})
        got = {}
        for where, start, end, state, opens in json_ranges._contexts(summaries):
            row = {"path": where, "start": start, "end": end, "state": state, "opens": [dict(zip(("at", "array", "key"), o)) for o in opens]}
            for part in json_ranges.elements(row, coco.ARRAYS):
                got.setdefault(part.document, {}).setdefault(part.kind, []).extend(part.values)
        offset = 0
        for text, body in texts:
            pieces = body["annotations"] if isinstance(body["annotations"], list) else body["annotations"]["pieces"]
            assert got[offset] == {"image": body["images"], "piece": pieces, "category": body["categories"][:1]}
            offset += len(text.encode()) + 1
        assert len(got) == 4


def test_one_large_document_is_read_by_many_tasks(spark, tmp_path):
    n = 200_000
    pieces = ",".join(f'{{"image_id": {i % 10_800}, "category_id": {i % 12 + 1}, "bbox": [{i % 700}, 20, 30, {i % 50 + 1}]}}' for i in range(n))
    images = ",".join(f'{{"id": {i}, "file_name": "{i}.jpg", "width": 800, "height": 600}}' for i in range(10_800) if i != 77)
    put(tmp_path, "in/x.json", '{"images": [' + images + '], "annotations": {"pieces": [' + pieces + "]}}")
    small = coco.annotations(coco.read_documents(spark, str(tmp_path / "in"))).drop("path")
    elements = coco.read_elements(spark, str(tmp_path / "in"), size=1 << 20)
    large = coco.element_annotations(elements).drop("path", "document")
    tasks = elements.filter("kind = 'piece'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) > 5 and sum(r["count"] for r in tasks) == n and max(r["count"] for r in tasks) < n // 2
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    assert digest(large.select(small.columns)) == digest(small)
    assert large.filter("NOT image_listed").count() == sum(i % 10_800 == 77 for i in range(n))


def test_broken_documents_are_refused(spark, tmp_path):
    put(tmp_path, "a/x.json", '{"images": [' + '{"id": 1},' * 50 + "]}}" + " " * 500)
    with pytest.raises(GridmarkError):
        coco.read_elements(spark, str(tmp_path / "a"), size=100).count()


def test_voc_documents(spark, tmp_path):
    obj = "<object><name> {} </name><bndbox><xmin>{}</xmin><ymin>{}</ymin><xmax>{}</xmax><ymax>{}</ymax></bndbox></object>"
    size = "<size><width>800</width><height>800</height></size>"
    put(tmp_path, "a.xml", f"<annotation>{size}{obj.format('white_rook', 80, 80, 160, 240)}{obj.format('black_bishop', 400, 400, 480, 560)}</annotation>")
    put(tmp_path, "b.xml", f"<annotation>{obj.format('x', 1, 1, 2, 2)}</annotation>")
    put(tmp_path, "c.xml", "<annotation><size><width>0</width><height>5</height></size></annotation>")
    put(tmp_path, "d.xml", f"<annotation>{size}<object><name>white_king</name></object><object><name></name><bndbox><xmin>1</xmin></bndbox></object></annotation>")
    docs = voc.read_documents(spark, str(tmp_path))
    got = sorted(rows(voc.objects(docs).select("raw_label", *[F.round(c, 6) for c in ("xc", "yc", "w", "h")])))
    assert got == [("black_bishop", 0.55, 0.6, 0.1, 0.2), ("white_rook", 0.15, 0.2, 0.1, 0.2)]
    bad = sorted((p[-5:], d) for p, d in rows(voc.invalid_documents(docs), "file_path", "description"))
    assert bad == [("b.xml", "XML lacks a size element"), ("c.xml", "Invalid image dimensions 0x5")]


def test_manifests_and_metrics(spark, tmp_path):
    put(tmp_path, "one.yaml", "a: {name: A, target_subdir: a, files: {f: {filename: f.zip, url: u, is_archive: true, expected_md5: AB}}}\nb: {name: B}\nnote: text\n")
    put(tmp_path, "two.yaml", "b: {name: B2, auth_required: true}\n")
    sources, files = tables.read_manifests(spark, [str(tmp_path / f) for f in ("one.yaml", "two.yaml", "none.yaml")])
    assert sorted(rows(sources, "key", "name", "auth_required")) == [("a", "A", False), ("b", "B2", True)]
    assert rows(files, "key", "file_key", "expected_md5", "is_archive") == [("a", "f", "AB", True)]
    log = spark.createDataFrame([(e, 0.1 * e) for e in (1, 2)], "epoch INT, val_acc DOUBLE")
    sinks.append_metrics(log, str(tmp_path / "log"))
    sinks.append_metrics(log.limit(1), str(tmp_path / "log"))
    assert tables.read_metrics(spark, str(tmp_path / "log")).count() == 3


def test_images_decode_or_report(spark, tmp_path):
    put(tmp_path, "ok.png", solid(7))
    put(tmp_path, "bad.jpg", b"not an image")
    put(tmp_path, "none.PNG", b"")
    put(tmp_path, "w.webp", b"RIFF\x10\0\0\0WEBPVP8 ")
    put(tmp_path, "v.webp", b"RIFX")
    got = dict(rows(images.image_errors(spark, str(tmp_path), listing.list_files(spark, str(tmp_path)))))
    assert got == {"bad.jpg": "Image cannot be decoded", "none.PNG": "Image file is 0 bytes (empty file)",
                   "v.webp": "Image cannot be decoded"}


# -- plans ------------------------------------------------------------------------


def test_standardise_folder_round_trip(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    put(source, "a.txt", "white-king 0.5 0.5 0.1 0.2\nunknown 0.5 0.5 0.1 0.1\nbQ 0.25 0.25 0.1 0.1\n")
    put(source, "deep/b.txt", "")
    done = standardize_folder(spark, str(source))
    assert rows(done.stats) == [(3, 2, 0, 0, 0, 1)]
    assert sorted(rows(done.class_counts)) == [(5, 1), (10, 1)]
    written = done.write(str(target))
    assert sorted(rows(written)) == [("a.txt", 77), ("deep/b.txt", 0)]
    assert (target / "a.txt").read_text() == (
        "5 0.500000 0.500000 0.100000 0.200000\n10 0.250000 0.250000 0.100000 0.100000\n")
    assert (target / "deep/b.txt").read_bytes() == b""
    again = standardize_folder(spark, str(target))
    assert rows(again.stats) == [(2, 2, 0, 0, 0, 0)]
    mapped = standardize_folder(spark, str(target), dataset="chessred")
    assert sorted(rows(mapped.class_counts)) == [(4, 1), (9, 1)]


def clean_dataset(root):
    lines = "0 .5 .5 .1 .15\n5 .2 .3 .08 .12\n6 .8 .8 .09 .14\n11 .7 .2 .08 .12\n"
    put(root, "images/train/a.png", solid(1))
    put(root, "labels/train/a.txt", lines)
    put(root, "images/val/b.png", solid(2))
    put(root, "labels/val/b.txt", "")


def test_clean_audit(spark, tmp_path):
    clean_dataset(tmp_path)
    done = audit_plan.audit_folder(spark, str(tmp_path))
    report = json.loads(done.report.toJSON().first())
    assert report["passed"] and report["error_count"] == 0 and report["warning_count"] == 0
    assert report["pairing_summary"]["negative_samples_count"] == 1
    assert report["pairing_summary"]["negative_sample_ratio_pct"] == 50.0
    assert report["annotation_summary"]["valid_boxes_count"] == 4
    assert report["class_distribution"]["white_piece_count"] == 2
    assert report["class_distribution"]["piece_type_counts"]["king"] == 2
    sinks.write_json(done.report, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1


def test_broken_audit(spark, tmp_path):
    clean_dataset(tmp_path)
    put(tmp_path, "images/train/broken.png", b"junk")
    put(tmp_path, "labels/train/broken.txt", "12 .5 .5 .1 .1\n0 .5 .5 .1 .1\n")
    put(tmp_path, "images/train/lonely.png", solid(3))
    put(tmp_path, "labels/train/orphan.txt", "99 nan\n")
    put(tmp_path, "images/train/notes.png", solid(4))
    put(tmp_path, "labels/train/notes.txt", "# nothing here\n")
    put(tmp_path, "labels/classes.txt", "x")
    done = audit_plan.audit_folder(spark, str(tmp_path))
    assert rows(done.verdict) == [(4, 0, False)]
    kinds = sorted(k for (k,) in rows(done.violations, "violation_type"))
    assert kinds == ["corrupted_image", "invalid_class_id", "orphan_image", "orphan_label"]
    # Labels of a corrupt image are audited; those of an orphan are not; comments make no negative.
    assert rows(done.boxes, "total_boxes_scanned", "corrupted_boxes_count") == [(6, 1)]
    assert rows(done.pairing, "total_images_scanned", "total_labels_scanned", "matched_pairs_count",
                "negative_samples_count", "corrupted_images_count") == [(5, 5, 4, 1, 1)]
    assert rows(done.preview(2), "n_more") == [(2,), (2,)]
    unchecked = audit_plan.audit_folder(spark, str(tmp_path), AuditConfig(validate_image_decoding=False))
    assert rows(unchecked.verdict, "error_count") == [(3,)]


def test_audit_of_several_targets(spark, tmp_path):
    clean_dataset(tmp_path)
    both = audit_plan.audit_folders(spark, [str(tmp_path), str(tmp_path / "none")])
    assert sorted(rows(both, "passed", "error_count")) == [(False, 1), (True, 0)]
    missing = audit_plan.audit_folder(spark, str(tmp_path / "none"))
    assert rows(missing.violations, "violation_type") == [("missing_file",)]


def test_build_end_to_end(spark, tmp_path):
    for i in range(10):
        put(tmp_path, f"phys/images/p{i}.png", solid(10 + i))
        put(tmp_path, f"phys/labels/p{i}.txt", "" if i == 0 else "0 .5 .5 .1 .1\n")
        put(tmp_path, f"dig/d{i}.png", solid(100 + i))
        if i:
            put(tmp_path, f"dig/d{i}.txt", "6 .5 .5 .1 .1\n")
    put(tmp_path, "dig/copy.png", solid(10 + 5))
    samples = build_plan.scan_pool(spark, str(tmp_path / "phys"), "physical_3d", "phys").unionByName(
        build_plan.scan_pool(spark, str(tmp_path / "dig"), "digital_2d", "dig"))
    dry = build_plan.build_dataset(samples)
    dry_path = dry.scanned.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert not (tmp_path / "out").exists()
    for table in (dry.report, dry.duplicates, dry.samples, dry.manifest):  # contents were read once, before
        assert "binaryFile" not in table._jdf.queryExecution().toString()
    manifest = json.loads(dry.manifest.toJSON().first())
    assert manifest["total_images"] == 21 and manifest["total_unique_images"] == 20
    assert manifest["total_duplicates_removed"] == 1
    # The copy has no label and comes first by path, so it is the one that stays.
    assert manifest["total_pieces"] == 17
    assert manifest["domain_totals"] == {"physical_3d": 9, "digital_2d": 11}
    assert sum(s["total_images"] for s in manifest["splits"].values()) == 20
    assert manifest["class_names"]["11"] == "black_king"
    assert dry.collisions.count() == 0 and dry.crosstab.count() == 12
    assert rows(dry.duplicates.select(F.element_at(F.split("removed", "/"), -1))) == [("p5.png",)]
    dry.write(str(tmp_path / "out"))
    stored = spark.read.parquet(str(tmp_path / "out/samples"))
    assert stored.count() == 20 and set(r for (r,) in rows(stored.select("split").distinct())) <= {"train", "val", "test"}
    # Files: an image and a label each, empty for negatives; a second run leaves the same, and other things stay.
    put(tmp_path, "files/labels/train/stale.txt", "x")
    put(tmp_path, "files/notes.md", "kept")
    for _ in range(2):
        files = dict(rows(dry.export(str(tmp_path / "files"))))
        names = {(split, name) for split, name in rows(dry.samples.select("split", "export_name"))}
        assert set(files) == {f"images/{s}/{n}" for s, n in names} | {f"labels/{s}/{n.removesuffix('.png')}.txt" for s, n in names} | {"notes.md"}
    assert sum(size == 0 for name, size in files.items() if name.startswith("labels/")) == 3
    one = next(f"{s}/{n}" for s, n in names if n == "phy_phys_p3.png")
    assert (tmp_path / "files/images" / one).read_bytes() == solid(13)
    assert (tmp_path / "files/labels" / one).with_suffix(".txt").read_text() == "0 .5 .5 .1 .1\n"
    with dry as built:
        assert built.samples.count() == 20
    assert not os.path.exists(dry_path)
    with pytest.raises(EmptyDatasetError):
        build_plan.build_dataset(samples.limit(0))


def test_file_sink_is_all_or_nothing(spark, tmp_path):
    target = tmp_path / "t"
    good = spark.createDataFrame([(f"labels/{i % 3}/{i}.txt", f"{i}\n" if i % 2 else None) for i in range(40)], "rel_path STRING, content STRING")
    file_sink.write_files(good.repartition(5), str(target))
    before = sorted((str(p.relative_to(target)), p.read_bytes()) for p in target.rglob("*") if p.is_file())
    assert len(before) == 40 and sum(len(b) == 0 for _, b in before) == 20
    lost = spark.range(30).select(
        F.concat(F.lit("labels/new"), "id").alias("rel_path"), F.lit("x").alias("content"),
        F.when(F.col("id") == 29, str(tmp_path / "not there")).alias("copy_from"),
    )
    with pytest.raises(Exception, match="not there"):
        file_sink.write_files(lost.repartition(4), str(target))
    for name in ("../out.txt", "/abs", "a//b", None):
        with pytest.raises(Exception, match="cannot write a file named"):
            file_sink.write_files(spark.createDataFrame([(name, "x")], "rel_path STRING, content STRING"), str(target))
    with pytest.raises(GridmarkError, match="would be named"):
        file_sink.write_files(spark.createDataFrame([("a", "x"), ("a", "y")], "rel_path STRING, content STRING"), str(target))
    assert sorted(os.listdir(target)) == ["labels"] and not (tmp_path / "out.txt").exists()
    assert sorted((str(p.relative_to(target)), p.read_bytes()) for p in target.rglob("*") if p.is_file()) == before
    assert rows(file_sink.write_files(good.limit(0), str(tmp_path / "empty"))) == []


def test_same_pool_by_any_path(spark, tmp_path, monkeypatch):
    """Absolute, relative, the pool or its images folder: the same samples."""
    for i in range(6):
        put(tmp_path, f"raw/x/images/p{i}.png", solid(10 + i))
        put(tmp_path, f"raw/x/labels/p{i}.txt", "0 .5 .5 .1 .1\n6 .5 .5 .1 .1\n")
    put(tmp_path, "raw/x/images/empty.png", b"")
    folder = str(tmp_path / "raw/x")
    relative = os.path.relpath(folder)
    seen = []
    for root in (folder, relative, f"{folder}/images", f"{relative}/images", f"file:{folder}"):
        found = build_plan.scan_pool(spark, root, "physical_3d", "x")
        seen.append(sorted(rows(found, "image_path", "label_path", "sha256", "is_negative", "n_pieces"), key=str))
    assert all(one == seen[0] for one in seen) and len(seen[0]) == 7
    assert len({sha for _, _, sha, _, _ in seen[0]}) == 7 and sum(n for *_, n in seen[0]) == 12
    built = build_plan.build_dataset(build_plan.scan_pool(spark, relative, "physical_3d", "x"))
    assert built.samples.count() == 7
    missing = build_plan.scan_pool(spark, folder, "physical_3d", "x", labels_dir=str(tmp_path / "nowhere"))
    assert sum(n for (n,) in rows(missing, "n_pieces")) == 12


def test_missing_hash_stops_the_job(spark):
    files = spark.createDataFrame([("/a.png", "a.png", 5), ("/b.png", "b.png", 0)], "path STRING, rel_path STRING, length BIGINT")
    none = spark.createDataFrame([], "rel_path STRING, sha256 STRING")
    assert len(rows(images.with_hashes(files.filter("length = 0"), none))) == 1
    with pytest.raises(Exception, match="no content hash"):
        images.with_hashes(files, none).collect()


def test_earlier_pool_wins(spark, tmp_path):
    put(tmp_path, "z/p.png", solid(1))
    put(tmp_path, "z/p.txt", "0 .5 .5 .1 .1\n")
    put(tmp_path, "a/copy.png", solid(1))
    put(tmp_path, "a/q.png", solid(2))
    pools = [build_plan.scan_pool(spark, str(tmp_path / name), domain, name, pool_order=i)
             for i, (name, domain) in enumerate((("z", "physical_3d"), ("a", "digital_2d")))]
    built = build_plan.build_dataset(pools[0].unionByName(pools[1]))
    assert sorted(rows(built.samples, "source_name", "n_pieces")) == [("a", 0), ("z", 1)]


def test_negative_pools_and_label_folder(spark, tmp_path):
    for i in range(3):
        put(tmp_path, f"i/s{i}.png", solid(i))
        put(tmp_path, f"l/s{i}.txt", "0 .5 .5 .1 .1\n6 .5 .5 .1 .1\n")
    put(tmp_path, "i/none.png", solid(9))
    found = build_plan.scan_pool(spark, str(tmp_path / "i"), "physical_3d", "x", labels_dir=str(tmp_path / "l"))
    got = sorted((neg, counts) for neg, counts in rows(found, "is_negative", "class_counts") if counts)
    assert got == [(False, {0: 1, 6: 1})] * 3
    assert found.filter("is_negative").count() == 1
    forced = build_plan.scan_pool(spark, str(tmp_path / "i"), "physical_3d", "neg", True, str(tmp_path / "l"))
    assert forced.filter("is_negative").count() == 4


# -- geometry and boards ------------------------------------------------------------


def test_parallax_case(spark):
    data = [("i", 5, .5625, .48, .08, .16), ("i", 10, .4375, .48, .08, .16), ("i", 0, .1875, .55, .06, .04)]
    df = spark.createDataFrame(data, "image_id STRING, class_id INT, xc DOUBLE, yc DOUBLE, w DOUBLE, h DOUBLE")
    got = parallax.per_image(parallax.assign_squares(df)).first().asDict()
    assert got["total_pieces"] == 3 and got["tall_pieces_count"] == 2
    assert round(got["centroid_accuracy_pct"], 2) == 33.33
    assert got["tall_piece_centroid_accuracy_pct"] == 0.0 and got["contact_accuracy_pct"] == 100.0
    assert got["max_rank_error"] == 1
    shown = rows(parallax.assign_squares(df).filter("class_id = 5"), "pixel_displacement")
    assert round(shown[0][0], 6) == 51.2


def test_sweep_straight_down_changes_nothing(spark):
    df = spark.createDataFrame([("i", 5, .5, .5, .1, .2)], "image_id STRING, class_id INT, xc DOUBLE, yc DOUBLE, w DOUBLE, h DOUBLE")
    top = parallax.tilted_boxes(df, (90.0,))
    got = rows(top.select(*[F.round(c, 6) for c in ("xc", "w")]))
    assert got == [(0.5, 0.088)]
    assert parallax.angle_sweep(df).count() == 4


def board(spark, *cells):
    return spark.createDataFrame([("b", c, f, r, 0.5 + i / 100, i) for i, (c, f, r) in enumerate(cells)],
                                 "board STRING, class_id INT, file_idx INT, rank_idx INT, conf DOUBLE, n INT")


def test_placement_round_trip(spark):
    start = [(3, 0, 0), (1, 1, 0), (2, 2, 0), (4, 3, 0), (5, 4, 0), (2, 5, 0), (1, 6, 0), (3, 7, 0)]
    start += [(c + 6, f, 7) for c, f, _ in start] + [(0, f, 1) for f in range(8)] + [(6, f, 6) for f in range(8)]
    placed = positions.placements(board(spark, *start), "board")
    assert rows(placed, "placement") == [("rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR",)]
    assert rows(positions.legality(placed), "is_legal", "error_code") == [(True, None)]
    squares = dict(rows(positions.explode_placement(placed), "square", "piece"))
    assert len(squares) == 64 and squares["e1"] == "K" and squares["d8"] == "q" and squares["e4"] == "."
    sparse = positions.placements(board(spark, (5, 4, 3), (11, 0, 7)), "board")
    assert rows(sparse, "placement") == [("k7/8/8/8/4K3/8/8/8",)]


def test_conflicts_kings_and_orientation(spark):
    df = board(spark, (0, 3, 3), (4, 3, 3), (5, 0, 7), (5, 1, 7), (11, 4, 0))
    one = positions.one_per_square(df, "board", ["n"])
    assert sorted(rows(one, "class_id")) == [(4,), (5,), (5,), (11,)]
    kings = positions.demote_extra_kings(one, "board", ["n"])
    assert sorted(rows(kings, "class_id", "was_demoted")) == [(4, False), (4, True), (5, False), (11, False)]
    turned = positions.orientation(kings, "board").first()
    assert turned["is_flipped"]
    flipped = positions.flip(kings, F.lit(True))
    assert (4, 3, 7) not in rows(flipped, "class_id", "file_idx", "rank_idx")
    assert (11, 3, 7) in rows(flipped, "class_id", "file_idx", "rank_idx")


def test_irregular_cells(spark):
    boxes = spark.createDataFrame([("b", 10.0, 20.0, 90.0, 100.0)], "board STRING, x_min DOUBLE, y_min DOUBLE, x_max DOUBLE, y_max DOUBLE")
    cells = positions.grid_squares(boxes)
    assert cells.count() == 64
    points = spark.createDataFrame([("b", 10.0, 20.0), ("b", 89.9, 99.9), ("b", 5.0, 5.0)], "board STRING, x DOUBLE, y DOUBLE")
    assert [s for (s,) in rows(positions.lookup_square(points, cells, "board").orderBy("x"), "square")] == [None, "a8", "h1"]


# -- pictures -------------------------------------------------------------------------


def brute_features(rgb_thumb):
    """Plain re-computation of the statistics on one 128x128 BGR thumbnail."""
    b, g, r = (rgb_thumb[:, :, i].astype(np.int64) for i in range(3))
    luma = (b * 3735 + g * 19235 + r * 9798 + 16384) >> 15
    patches = luma.reshape(16, 8, 16, 8).swapaxes(1, 2).reshape(256, 64)
    sd = patches.std(axis=1)
    quads = [luma[:64, :64].mean(), luma[:64, 64:].mean(), luma[64:, :64].mean(), luma[64:, 64:].mean()]
    return (sd < 1.0).mean(), float(np.median(sd)), float(np.std(quads))


def checkerboard(size=400):
    y, x = np.indices((size, size)) // (size // 8)
    light = ((x + y) % 2 == 0)[:, :, None]
    return np.where(light, [240, 240, 240], [80, 150, 120]).astype(np.uint8)


def photograph(size=400):
    rng = np.random.default_rng(7)
    ramp = np.linspace(20, 230, size)[None, :] * np.linspace(0.4, 1.0, size)[:, None]
    noise = rng.normal(0, 45, (size, size, 3))
    return np.clip(ramp[:, :, None] + noise, 0, 255).astype(np.uint8)


def image_frame(spark, **pictures):
    data = [(name, p.shape[0], p.shape[1], 3, bytes(p.tobytes())) for name, p in pictures.items()]
    return spark.createDataFrame(data, "image_id STRING, height INT, width INT, channels INT, data BINARY")


def test_bilinear_matches_plain_loops():
    rng = np.random.default_rng(1)
    source = rng.integers(0, 256, (5, 7, 3)).astype(np.uint8)
    got = features.bilinear(source, 9)
    for y in range(9):
        for x in range(9):
            sy = min(max((y + .5) * 5 / 9 - .5, 0), 4)
            sx = min(max((x + .5) * 7 / 9 - .5, 0), 6)
            y0, x0 = int(sy), int(sx)
            y1, x1 = min(y0 + 1, 4), min(x0 + 1, 6)
            fy, fx = sy - y0, sx - x0
            want = (source[y0, x0] * (1 - fx) + source[y0, x1] * fx) * (1 - fy) + (
                source[y1, x0] * (1 - fx) + source[y1, x1] * fx) * fy
            assert np.abs(got[y, x] - want).max() <= 0.5 + 1e-9
    same = rng.integers(0, 256, (128, 128, 3)).astype(np.uint8)
    assert (features.bilinear(same) == same).all()


def test_statistics_match_brute_force(spark):
    picture = photograph(128)
    thumbs = features.thumbnails(image_frame(spark, a=picture))
    assert rows(thumbs, "win") == [("global",)]
    got = features.thumbnail_features(image_frame(spark, a=picture)).first()
    flat, median, quad = brute_features(picture)
    assert got["zero_noise_ratio"] == pytest.approx(flat)
    assert got["median_patch_std"] == pytest.approx(median)
    assert got["quadrant_std"] == pytest.approx(quad)
    # Pixel rows give the same.
    by_pixel = features.image_features(features.thumbnail_pixels(thumbs), "image_id", "win").first()
    for name in ("palette_entropy", "zero_noise_ratio", "median_patch_std", "quadrant_std", "physical_score"):
        assert got[name] == pytest.approx(by_pixel[name])


def test_screen_separates_domains(spark):
    inside = np.zeros((800, 600, 3), np.uint8)
    for rows_ in (slice(0, 200), slice(600, 800)):
        inside[rows_] = np.random.default_rng(99).integers(50, 200, (200, 600, 3))
    inside[200:600, 100:500] = checkerboard(400)
    frame = image_frame(spark, board=checkerboard(), photo=photograph(), app=inside)
    done = features.decide_domain(features.fuse_windows(features.thumbnail_features(frame)))
    got = {r["image_id"]: r for r in done.collect()}
    assert got["board"]["domain"] == "digital_2d" and got["board"]["physical_score"] < 0.20
    assert got["photo"]["domain"] == "physical_3d" and got["photo"]["physical_score"] > 0.70
    assert got["app"]["domain"] == "digital_2d"


def test_centre_window_wins_when_lower_and_clear(spark):
    data = [("a", "global", 0.9), ("a", "center", 0.3), ("b", "global", 0.9), ("b", "center", 0.5),
            ("c", "global", 0.1), ("c", "center", 0.2), ("d", "global", 0.6)]
    df = spark.createDataFrame(data, "image_id STRING, win STRING, physical_score DOUBLE").withColumns({
        c: F.lit(0.0) for c in ("palette_entropy", "zero_noise_ratio", "axis_gradient_ratio", "lighting_inhomogeneity")})
    got = dict(rows(features.fuse_windows(df), "image_id", "win"))
    assert got == {"a": "center", "b": "global", "c": "global", "d": "global"}


def test_hsv_of_known_colours(spark):
    data = [(0, 0, 255), (0, 255, 0), (255, 0, 0), (0, 0, 0), (255, 255, 255), (10, 128, 200)]
    df = spark.createDataFrame(data, "b INT, g INT, r INT")
    got = rows(df.select(*px.hsv(F.col("b"), F.col("g"), F.col("r")), px.gray(F.col("b"), F.col("g"), F.col("r"))))
    assert got == [(0, 255, 255, 76), (60, 255, 255, 150), (120, 255, 255, 29), (0, 0, 0, 0), (0, 0, 255, 255), (19, 242, 200, 136)]


def test_router_uses_logits_only_when_ambiguous(spark):
    screened = spark.createDataFrame([("a", 0.1), ("b", 0.5), ("c", 0.6), ("d", 0.9)], "image_id STRING, physical_score DOUBLE")
    logits = spark.createDataFrame([("a", 0.0, 9.0), ("b", 9.0, 0.0)], "image_id STRING, z0 DOUBLE, z1 DOUBLE")
    got = {k: (d, m) for k, d, m in rows(features.route_tiers(screened, logits, "image_id", ScreenWeights()), "image_id", "domain", "method")}
    assert got == {"a": ("digital_2d", "heuristic"), "b": ("digital_2d", "neural"),
                   "c": ("physical_3d", "heuristic"), "d": ("physical_3d", "heuristic")}


def test_folder_diagnostics_and_screen(spark, tmp_path):
    put(tmp_path, "images/train/a.png", png(checkerboard()[:, :, ::-1]))
    put(tmp_path, "labels/train/a.txt", "5 .5625 .48 .08 .16\n0 .1875 .55 .06 .04\n")
    put(tmp_path, "images/train/b.png", solid(1))
    put(tmp_path, "labels/train/b.txt", "")
    annotations = diagnose.paired_annotations(spark, str(tmp_path))
    got = diagnose.contact_diagnostics(annotations)
    assert rows(got, "image_id", "total_pieces", "centroid_accuracy_pct") == [("images/train/a.png", 2, 50.0)]
    assert diagnose.contact_diagnostics(annotations, sweep=True).count() == 4
    screened = {r["image_id"]: r["domain"] for r in diagnose.screen_images(spark, str(tmp_path)).collect()}
    assert screened == {"images/train/a.png": "digital_2d", "images/train/b.png": "digital_2d"}


# -- streaming --------------------------------------------------------------------------


def test_stream_audit_equals_batch(spark, tmp_path):
    for i in range(4):
        put(tmp_path, f"in/{i}.txt", f"{i * 5} .5 .5 .1 .1\n0 .5 .5 .001 .1\n# c\n0 nan .5 .1 .1\n")
    stream = incremental.read_label_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    target = str(tmp_path / "out")
    got = incremental.run_once(incremental.audit_counts(stream), "complete", target)
    assert set(rows(got)) == {(None, None, 3), ("degenerate_box", "WARNING", 4), ("nan_or_inf_value", "ERROR", 4),
                              ("invalid_class_id", "ERROR", 1)}
    put(tmp_path, "in/more.txt", "0 .5 .5 .1 .1\n")
    again = incremental.read_label_stream(spark, str(tmp_path / "in"))
    got = incremental.run_once(incremental.audit_counts(again), "complete", target)
    assert (None, None, 4) in set(rows(got))


def test_stream_updates_merge_by_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "COMPACT_EVERY", 3)
    keys, target = ["violation_type", "severity"], str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    counts = lambda: incremental.run_once(
        incremental.audit_counts(incremental.read_label_stream(spark, str(tmp_path / "in"), files_per_trigger=1)), "update", target, keys)
    assert rows(counts()) == []
    for i in range(8):
        put(tmp_path, f"in/{i}.txt", f"{i * 5} .5 .5 .1 .1\n0 .5 .5 .001 .1\n0 nan .5 .1 .1\n")
        if i in (1, 4, 7):  # a run that ends and another one that goes on
            n = i + 1
            expected = {(None, None, min(n, 3)), ("degenerate_box", "WARNING", n), ("nan_or_inf_value", "ERROR", n)}
            expected |= {("invalid_class_id", "ERROR", n - 3)} if n > 3 else set()
            assert set(rows(counts())) == expected
    table = tmp_path / "out" / "table"
    assert sorted(p.name for p in (table / "level=1").iterdir()) == ["batch_id=5"]
    # A batch that runs again after a failure replaces what it wrote.
    batch = spark.createDataFrame([("nan_or_inf_value", "ERROR", 8)], "violation_type STRING, severity STRING, n LONG")
    before = set(rows(incremental.read_keyed(spark, str(table), batch.schema, keys)))
    for _ in range(2):
        incremental.merge_batch(batch, 7, str(table), keys)
    assert ("nan_or_inf_value", "ERROR", 8) in before
    assert [r for r in rows(incremental.read_keyed(spark, str(table), batch.schema, keys)) if r[0] == "nan_or_inf_value"] == [("nan_or_inf_value", "ERROR", 8)]


def test_frames_behind_the_watermark_are_dropped(spark, tmp_path):
    schema, target = "cam STRING, ts TIMESTAMP, n INT", str(tmp_path / "out")
    (tmp_path / "in").mkdir()

    def arrive(*frames):
        data = spark.createDataFrame([(c, t, n) for c, t, n in frames], "cam STRING, t STRING, n INT")
        data.select("cam", F.to_timestamp("t").alias("ts"), "n").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        sampled = incremental.first_frames(stream, ["cam"], interval="1 minute", delay="2 minutes", ties=("n",))
        done = incremental.run_once(sampled, "update", target, ["cam", "window_start", "window_end"])
        return {(c, t.strftime("%H:%M"), n, k) for c, t, n, k in rows(done, "cam", "window_start", "n", "frames")}

    day = "2024-01-01 "
    first = arrive(("a", day + "10:00:30", 1), ("a", day + "10:00:10", 2), ("a", day + "10:00:10", 3), ("b", day + "10:00:05", 4), ("a", None, 5))
    assert first == {("a", "10:00", 2, 3), ("b", "10:00", 4, 1)}
    second = arrive(("a", day + "10:03:10", 6))
    assert second == first | {("a", "10:03", 6, 1)}
    # The watermark is at 10:01:10: the interval of 10:00 is closed, that of 10:01 is not.
    assert arrive(("a", day + "10:00:01", 7), ("a", day + "10:01:40", 8)) == second | {("a", "10:01", 8, 1)}


def test_stream_without_input(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("sha256 STRING, ts TIMESTAMP").parquet(str(tmp_path / "in"))
    assert rows(incremental.run_once(incremental.dedup_stream(stream))) == []


def test_stream_dedup_equals_batch(spark, tmp_path):
    data = [(f"h{i % 7}", f"2024-01-01 00:{i:02d}:00") for i in range(30)]
    df = spark.createDataFrame(data, "sha256 STRING, t STRING").select("sha256", F.col("t").cast("timestamp").alias("ts"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = incremental.run_once(incremental.dedup_stream(stream))
    assert sorted(h for (h,) in rows(got, "sha256")) == sorted({h for h, _ in data})
