"""`window.KB = {...}` files as a Spark source: one row a file, as JSON text for from_json or a variant.

Object literals may have unquoted keys, comments anywhere between tokens, and a trailing comma behind a value. Single-quoted and template strings, and any
other statement, are refused with the line and column of the fault.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\s+|//[^\n]*|/\*.*?\*/|(?P<string>"(?:[^"\\\n]|\\.)*")|(?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<word>[A-Za-z_$][\w$]*)|(?P<sign>[{}\[\],:])', re.DOTALL)
_COLON = re.compile(r"(?:\s|//[^\n]*|/\*.*?\*/)*:", re.DOTALL)
_HEAD = re.compile(r"\s*(?:(?://[^\n]*|/\*.*?\*/)\s*)*window\.KB\s*=\s*", re.DOTALL)


def to_json(text: str) -> str:
    """The assigned literal as JSON; ValueError with line and column where the text isn't one."""

    def fault(at: int, what: str) -> ValueError:
        return ValueError(f"line {text.count(chr(10), 0, at) + 1}, column {at - text.rfind(chr(10), 0, at)}: {what}")

    head = _HEAD.match(text)
    if not head:
        raise fault(0, "window.KB = expected")
    at, out, end = head.end(), [], len(text.rstrip().rstrip(";"))
    while at < end:
        found = _TOKEN.match(text, at, end)
        if not found:
            raise fault(at, f"unexpected {text[at]!r}")
        kind, value = found.lastgroup, found.group()
        if kind == "word" and value not in ("true", "false", "null"):
            if not _COLON.match(text, found.end(), end):
                raise fault(at, f"unexpected {value}")
            value = json.dumps(value)
        if kind == "sign" and value in "}]" and len(out) > 1 and out[-1] == "," and out[-2] not in ("[", "{", ",", ":"):
            out.pop()
        if kind:
            out.append(value)
        at = found.end()
    try:
        return json.dumps(json.loads("".join(out)), ensure_ascii=False)
    except json.JSONDecodeError as e:
        raise fault(head.end(), e.msg) from None


def parsed_object(text: Column) -> Column:
    """json, error: the assigned literal of a text as JSON, else what is wrong with it and where; nulls for null."""

    @F.pandas_udf("json string, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                rows.append((None if t is None else to_json(t), None))
            except ValueError as e:
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["json", "error"])

    return run(text)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """path, json, error of every file under path; a faulty file has an error and no json."""
    files = spark.read.format("binaryFile").load(path)
    parsed = files.select("path", parsed_object(F.col("content").cast("string")).alias("p"))
    return parsed.select("path", "p.json", "p.error")
