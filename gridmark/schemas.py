"""Explicit schemas of every table the engine reads or writes (no inference)."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructField,
    StructType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


INT, LONG, DOUBLE, STRING, BOOL = (
    IntegerType(), LongType(), DoubleType(), StringType(), BooleanType(),
)

POINT = _struct(x=DOUBLE, y=DOUBLE)
PIXEL_BOX = _struct(x_min=DOUBLE, y_min=DOUBLE, x_max=DOUBLE, y_max=DOUBLE, confidence=DOUBLE)
ANNOTATION = _struct(
    file_path=STRING, line_number=INT, class_id=INT, class_name=STRING,
    xc=DOUBLE, yc=DOUBLE, w=DOUBLE, h=DOUBLE, conf=DOUBLE,
)
SAMPLE = _struct(
    image_path=STRING, label_path=STRING, domain=STRING, sha256=STRING,
    class_counts=MapType(INT, LONG), is_negative=BOOL, source_name=STRING,
)
DETECTION = _struct(
    piece_type=STRING, color=STRING, confidence=DOUBLE, bbox=PIXEL_BOX, base_point=POINT
)
CLASSIFICATION = _struct(
    domain=STRING, confidence=DOUBLE, method=STRING, latency_ms=DOUBLE, heuristic_score=DOUBLE
)
EVALUATION = _struct(
    fen=STRING, best_move_uci=STRING, best_move_san=STRING, score_cp=INT, score_mate=INT,
    depth=INT, ponder_move_uci=STRING, pv=ArrayType(STRING),
)
EPOCH = _struct(
    epoch=INT, total_epochs=INT, train_loss=DOUBLE, val_loss=DOUBLE, train_acc=DOUBLE,
    val_acc=DOUBLE, val_digital_acc=DOUBLE, val_physical_acc=DOUBLE, learning_rate=DOUBLE,
    grad_norm=DOUBLE, vram_allocated_mb=DOUBLE, vram_reserved_mb=DOUBLE,
    throughput_samples_sec=DOUBLE, duration_sec=DOUBLE, eta_sec=DOUBLE, is_best=BOOL,
)
LISTING = "path STRING, rel_path STRING, length BIGINT"
SOURCES = (
    "key STRING, name STRING, publisher STRING, doi STRING, license STRING, target_subdir STRING, "
    "auth_required BOOLEAN, description STRING"
)
SOURCE_FILES = (
    "key STRING, file_key STRING, filename STRING, url STRING, is_archive BOOLEAN, "
    "expected_md5 STRING, extract_subdir STRING, description STRING"
)
