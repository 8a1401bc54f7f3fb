"""Chat records of any known layout as formatted text with a loss mask.

A record is JSON. Its fingerprint, a hash of the sorted nested field paths with their kinds,
selects a declarative mapping, which names where roles and texts are found. A layout without
a mapping is reported with its fingerprint and paths and is not guessed at.

Template: `<|im_start|>` role, a line end, text, `<|im_end|>` and a line end for every turn.
Inside texts and roles, `<`, any number of backslashes, `|` gets one backslash more, so that
no control string can occur there, and reading takes one away; roles escape line ends, too.

Defined results: null roles and texts are empty; a null or unreadable record, and one of an
unknown layout, has no turns and carries `problem`; repeated rows stay apart; an empty table gives no
rows. A conversation is one text, so it is put together in one task, like any one document.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmark.session import materialize

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
FORMATTED = "conv_id bigint, fingerprint string, formatted string, loss array<struct<start:bigint,length:bigint>>, problem string"

# Layouts by their field paths. A mapping lists where turns come from, in order: fixed roles
# with a field, or a list with the fields of role and text; `roles` renames roles.
LAYOUTS: list[tuple[list[str], dict[str, Any]]] = [
    (["prompt:text", "response:text"], {"turns": [("user", "prompt"), ("assistant", "response")]}),
    (
        ["instruction:text", "input:text", "output:text"],
        {"turns": [("system", "instruction"), ("user", "input"), ("assistant", "output")]},
    ),
    (["instruction:text", "output:text"], {"turns": [("user", "instruction"), ("assistant", "output")]}),
    (["messages:list", "messages[]:object", "messages[].role:text", "messages[].content:text"], {"list": ("messages", "role", "content")}),
    (["messages:list"], {"list": ("messages", "role", "content")}),
    (
        ["conversations:list", "conversations[]:object", "conversations[].from:text", "conversations[].value:text"],
        {"list": ("conversations", "from", "value"), "roles": {"human": "user", "gpt": "assistant"}},
    ),
    (
        ["dialog:object", "dialog.turns:list", "dialog.turns[]:object", "dialog.turns[].speaker:object", "dialog.turns[].speaker.role:text", "dialog.turns[].text:text"],
        {"list": ("dialog.turns", "speaker.role", "text")},
    ),
]


def field_paths(value: Any, at: str = "") -> set[str]:
    """Nested paths with their kinds; a null counts as text, elements of a list share one path."""
    if isinstance(value, dict):
        paths = {f"{at}:object"} if at else set()
        for key, inner in value.items():
            paths |= field_paths(inner, f"{at}.{key}" if at else key)
        return paths
    if isinstance(value, list):
        paths = {f"{at}:list"}
        for inner in value:
            paths |= field_paths(inner, f"{at}[]")
        return paths
    return {f"{at}:number" if isinstance(value, int | float) and not isinstance(value, bool) else f"{at}:flag" if isinstance(value, bool) else f"{at}:text"}


def fingerprint(paths: set[str] | list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


MAPPINGS = {fingerprint(paths): mapping for paths, mapping in LAYOUTS}


def _field(value: Any, path: str) -> Any:
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return value


def canonical_turns(record: Any, mapping: dict[str, Any]) -> list[tuple[str, str]]:
    """(role, text) of every turn by a mapping; missing values are empty."""
    if "list" in mapping:
        place, role, text = mapping["list"]
        turns = [(_field(item, role) or "", _field(item, text) or "") for item in _field(record, place) or []]
    else:
        turns = [(role, _field(record, place) or "") for role, place in mapping["turns"]]
    names = mapping.get("roles", {})
    return [(names.get(role, role), text) for role, text in turns]


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(n|\\)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and (start, length) in code points of the texts that count for the loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body, tail = f"{OPEN}{escape_role(role)}\n", escape(text), f"{CLOSE}\n"
        if role == "assistant":
            spans.append((at + len(head), len(body)))
        parts += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts read back from a formatted text."""
    turns, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(CLOSE, line)
        turns.append((unescape_role(formatted[at + len(OPEN) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(CLOSE) + 1
    return turns


def format_records(records: DataFrame, mappings: dict[str, dict[str, Any]] | None = None) -> DataFrame:
    """records(conv_id, record: JSON) -> conv_id, fingerprint, formatted, loss spans, problem."""
    known = MAPPINGS if mappings is None else mappings

    def one(record: str | None) -> tuple:
        try:
            value = json.loads(record) if record is not None else None
        except ValueError:
            value = None
        if not isinstance(value, dict):
            return None, "", [], "not a JSON object"
        paths = field_paths(value)
        key = fingerprint(paths)
        if key not in known:
            return key, "", [], "unknown layout: " + ", ".join(sorted(paths))[:500]
        return key, *format_turns(canonical_turns(value, known[key])), None

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            rows = [one(record) for record in batch.column("record").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"),
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.string()),
                    pa.array([[{"start": a, "length": n} for a, n in r[2]] for r in rows], spans_type),
                    pa.array([r[3] for r in rows], pa.string()),
                ],
                names=["conv_id", "fingerprint", "formatted", "loss", "problem"],
            )

    return records.select("conv_id", "record").mapInArrow(formatted, FORMATTED)


def write_formatted(output: DataFrame) -> DataFrame:
    """Write the formatted texts with their spans as Parquet and read the files."""
    return materialize(output)


def digest_formatted(output: DataFrame) -> DataFrame:
    """Read turns and loss texts back from formatted texts and their spans."""
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def one(formatted: str, loss: list[dict]) -> tuple:
        turns = parse_turns(formatted)
        whole = "".join(f"{role}\n{text}\n" for role, text in turns)
        masked = "".join(unescape(formatted[s["start"] : s["start"] + s["length"]]) for s in loss)
        return len(turns), _sha(whole), len(masked), _sha(masked), len(formatted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in batches:
            rows = [one(f or "", s or []) for f, s in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True)]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], names=names)

    return output.select("conv_id", "formatted", "loss").mapInArrow(read, schema)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def conversation_records(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as one JSON record a conversation, in the layout its turns fit.

    A user and an assistant turn become prompt and response, a system turn before them
    instruction, input and output; all others a message list. Equal turn numbers go by role and text.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    grouped = turns.groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    roles = F.transform("rows", lambda r: r["role"])

    def text(i: int):
        return F.col("rows")[i]["content"]

    messages = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["content"].alias("content")))
    pair = F.struct(text(0).alias("prompt"), text(1).alias("response"))
    three = F.struct(text(0).alias("instruction"), text(1).alias("input"), text(2).alias("output"))
    record = (
        F.when(roles == F.array(F.lit("user"), F.lit("assistant")), F.to_json(pair))
        .when(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), F.to_json(three))
        .otherwise(F.to_json(F.struct(messages.alias("messages"))))
    )
    return grouped.select("conv_id", record.alias("record"))
