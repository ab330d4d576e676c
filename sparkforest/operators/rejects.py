"""Loading text lines whose rows may fail to parse: typed rows out, the others with the reason."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from sparkforest.plans.groups import map_rows
from sparkforest.plans.joins import lookup_join

PARSED = "line_id bigint, file_id bigint, line_no int, target_table string, node1 bigint, node2 bigint, rest array<string>, reason string, raw_line string"

_DIGITS = re.compile(r"[0-9]+")
_BLANKS = re.compile(r"[ \t]+")
# Python's reader takes these for line ends; inside a line they are plain characters.
_SHIELD = {"\r": "", "\n": "", "\x00": ""}


class Malformed(ValueError):
    """A line that fails; the message is the reason."""


def assemble(line: str) -> str:
    """Walks a comma line quote-aware and gives it back as one complete record, or raises ``quoting``.

    A quote must open a field, be doubled inside a quoted field, or close a quoted field right before a comma or the end.
    """
    at, n = 0, len(line)
    while at <= n:
        if at < n and line[at] == '"':
            at += 1
            while True:
                close = line.find('"', at)
                if close < 0:
                    raise Malformed("quoting")
                if close + 1 < n and line[close + 1] == '"':
                    at = close + 2
                    continue
                break
            at = close + 1
            if at < n and line[at] != ",":
                raise Malformed("quoting")
        else:
            comma = line.find(",", at)
            end = n if comma < 0 else comma
            if line.find('"', at, end) >= 0:
                raise Malformed("quoting")
            at = end
        at += 1
    return line


def split_comma(line: str) -> list[str]:
    """The fields of a comma line by Python's strict reader; its exceptions become ``quoting``."""
    record = assemble(line) if '"' in line else line
    odd = any(c in record for c in _SHIELD)
    if odd:
        for c, s in _SHIELD.items():
            record = record.replace(c, s)
    try:
        fields = next(csv.reader([record], strict=True), [])
    except csv.Error as e:
        if "field limit" not in str(e):
            raise Malformed("quoting") from e
        csv.field_size_limit(max(len(record) + 1, csv.field_size_limit()))
        fields = next(csv.reader([record], strict=True), [])
    if odd:
        for c, s in _SHIELD.items():
            fields = [f.replace(s, c) for f in fields]
    return fields or [""]


def split_blank(line: str) -> list[str]:
    bare = line.strip(" \t")
    return _BLANKS.split(bare) if bare else []


def node(field: str, num_vertices: int) -> int:
    bare = field.strip(" \t")
    if not _DIGITS.fullmatch(bare) or (value := int(bare[-400:])) >= num_vertices or len(bare) > 400 and bare[:-400].strip("0"):
        raise Malformed("invalid_value")
    return value


def parse_line(raw: str | None, delimiter: str, n_fields: int, num_vertices: int) -> tuple[int, int, list[str]]:
    """Structure first, then the typed constructors of the fields; raises Malformed with the first reason that applies."""
    line = raw or ""
    if line.endswith("\r"):
        line = line[:-1]
    fields = split_comma(line) if delimiter == "comma" else split_blank(line)
    if len(fields) != n_fields or n_fields < 2:
        raise Malformed("column_count")
    return node(fields[0], num_vertices), node(fields[1], num_vertices), fields[2:]


def _parse(rows: Iterator[dict]) -> Iterator[dict]:
    for r in rows:
        out = {"line_id": r["line_id"], "file_id": r["file_id"], "line_no": r["line_no"], "target_table": r["target_table"], "node1": None, "node2": None, "rest": None, "reason": None, "raw_line": r["raw_line"]}
        if r["n_fields"] is None or r["num_vertices"] is None or r["delimiter"] not in ("comma", "space"):
            out["reason"] = "unknown_file"
        else:
            try:
                out["node1"], out["node2"], out["rest"] = parse_line(r["raw_line"], r["delimiter"], r["n_fields"], r["num_vertices"])
            except Malformed as e:
                out["reason"] = str(e)
        yield out


def parse_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Every line of ``lines`` once: typed (``reason`` null) or with the first reason that applies.

    Reasons: ``quoting``, ``column_count``, ``invalid_value``; and ``unknown_file`` for a line without a described file,
    which has no layout to be held against. A null line counts as an empty one. A single carriage return at the end
    belongs to the line end. A record never spans lines here: a quoted field still open at the line's end is ``quoting``.
    Other columns of either table are not read, so clashing names do no harm.
    """
    known = files.select("file_id", "target_table", "delimiter", "n_fields", "num_vertices")
    joined = lookup_join(lines.select("line_id", "file_id", "line_no", "raw_line"), known, "file_id", "left")
    return map_rows(joined, _parse, PARSED)
