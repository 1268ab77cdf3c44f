"""JSON inside of answers, and what malformed ones give."""

from __future__ import annotations

import pytest

from verdigris.operators.evaluate import extracted_json


@pytest.mark.parametrize(
    "answer, parsed, error",
    [
        ('so: {"a": [1, 2]} done', '{"a": [1, 2]}', ""),
        ('x {"a": "}"} y {"b": 1}', '{"a": "}"}', ""),
        ('see [1, {"b": 2}]', '{"b": 2}', ""),
        ("list [1, 2] end", "[1, 2]", ""),
        ('cut {"a": {"b": 1}', None, "no_json_found"),
        ('cut {"a": "b', None, "no_json_found"),
        ('comma {"a": 1,} end', None, "json_decode_fail"),
        ("words {no json} end", None, "json_decode_fail"),
        ("nothing", None, "no_json_found"),
        ('quote \\" {"a": "\\u4f60"} end', '{"a": "你"}', ""),
        ('deep {"a": ["{", {"c": "\\\\"}]} x', '{"a": ["{", {"c": "\\\\"}]}', ""),
        ("", None, "empty_output"),
        (" '-1' ", '{"verdict":-1}', "bare_int"),
    ],
)
def test_embedded(spark, answer, parsed, error):
    r = extracted_json(spark.createDataFrame([(answer,)], "raw string"), "raw").first()
    assert (r["parsed"], r["error"]) == (parsed, error)
