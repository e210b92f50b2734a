"""JSON Schema errors, PDF text, paths and values that must stay secret: literal cases."""

import zlib

import pytest
from pyspark.sql import functions as F

from gleanery.functions import text
from gleanery.functions.schema import messages
from gleanery.sources import pdf

CASES = [
    ({"type": "integer"}, "1.0", []),
    ({"type": "integer"}, "1.5", ["(root): type"]),
    ({"type": "integer"}, "true", ["(root): type"]),
    ({"type": ["string", "null"]}, "null", []),
    ({"enum": [1, "a"]}, "true", ["(root): enum"]),
    ({"const": False}, "0", ["(root): const"]),
    ({"type": "string", "minLength": 2, "maxLength": 3, "pattern": "^a"}, '"bcde"', ["(root): length", "(root): pattern"]),
    ({"minimum": 0, "maximum": 9}, "10", ["(root): range"]),
    ({"items": {"type": "string"}, "minItems": 3}, '["x", 1]', ["(root): items", "1: type"]),
    ({"uniqueItems": True}, '[{"a": 1}, {"a": 1}]', ["(root): unique"]),
    ({"properties": {"a": {"type": "object", "required": ["b"]}}}, '{"a": {}}', ["a: required b"]),
    ({"additionalProperties": False, "patternProperties": {"^x": {"type": "null"}}}, '{"x1": 1, "y": 2}', ["(root): unknown y", "x1: type"]),
    ({"additionalProperties": {"type": "null"}}, '{"q": 1}', ["q: type"]),
    ({"anyOf": [{"type": "null"}, {"minimum": 3}]}, "2", ["(root): anyOf"]),
    ({"oneOf": [{"type": "integer"}, {"minimum": 3}]}, "5", ["(root): oneOf"]),
    ({"allOf": [{"type": "integer"}, {"minimum": 3}]}, "2", ["(root): range"]),
    ({"not": {"type": "null"}}, "null", ["(root): not"]),
    ({"if": {"type": "string"}, "then": {"minLength": 2}, "else": {"type": "null"}}, "1", ["(root): type"]),
    ({"$defs": {"p/q": {"type": "null"}}, "properties": {"a": {"$ref": "#/$defs/p~1q"}}}, '{"a": 1}', ["a: type"]),
    ({}, "{", ["(root): not JSON"]),
    (False, "1", ["(root): never"]),
]


@pytest.mark.parametrize("schema, value, want", CASES)
def test_schema(schema, value, want):
    assert messages(value, schema) == want


def test_references_between_documents():
    roots = {"": {"$ref": "other#/$defs/n"}, "other": {"$defs": {"n": {"$ref": "#/$defs/m"}, "m": {"minimum": 1}}}}
    assert messages("0", roots[""], roots) == ["(root): range"] and messages("1", roots[""], roots) == []


def test_pdf():
    assert pdf.read(pdf.written(["A (b) \\ c", "two"]))["text"] == "A (b) \\ c\ntwo"
    assert pdf.read(pdf.written(["one", "two"]), 1) == {"text": "one", "status": "ok", "error": None, "pages": 2, "pages_read": 1}
    assert pdf.read(pdf.written([""]))["status"] == "unsupported" and pdf.read(b"<html>")["status"] == "unsupported"
    assert pdf.read(pdf.written(["x"]).replace(zlib.compress(b"BT /F1 12 Tf 72 720 Td (x) Tj ET"), b"broken"))["status"] == "unsupported"
    plain = b"%PDF-1.4\n1 0 obj\n<< /Type /Page /Contents 2 0 R >>\nendobj\n2 0 obj\n<< >>\nstream\nBT <4142> Tj T* [(C) -20 (D)] TJ ET\nendstream\nendobj\n"
    assert pdf.read(plain)["text"] == "AB\nCD"


def test_paths_and_values(spark):
    want = {".env": ".env", "a/.env.prod": ".env", "a/.env.example": None, "x/logs/y": "logs/", "logs": None, ".cache/z": ".cache/", "my.log": ".log", ".log": None, "a.logs": None, "node_modules/.env.example": None}
    df = spark.createDataFrame([(p,) for p in want], "p string")
    assert {r["p"]: r["r"] for r in df.select("p", text.forbidden_path(F.col("p")).alias("r")).collect()} == want
    assert text.secret_values({"MY_KEY": "12345678", "TOKEN": "short", "HOME": "long enough", "db_password": "abcdefghi"}) == ["12345678", "abcdefghi"]
    big = spark.createDataFrame([("a", bytearray(b"x" * 30 + b" ghp_" + b"a" * 24))], "path string, content binary")
    assert text.unsafe_files(big).count() == 1 and text.unsafe_files(big, most_bytes=10).count() == 0
