import pytest

from lexivane.operators.validate import failed_lines, loaded_lines
from lexivane.sources.raw_lines import tsv_fields

J = '{"id": %s, "vector": %s}'

CASES = [
    ("jsonl", J % ("1", '{"a": 1}'), None),
    ("jsonl", " \t" + J % ("1", "{}") + " \r\n", None),
    ("jsonl", J % ('"a_b:c-1"', '{"a": 0}'), None),
    ("jsonl", J % ("9223372036854775807", '{"a": 3.4028235e38}'), None),
    ("jsonl", J % ("0", '{"a": -0.0}'), None),
    ("jsonl", '{"id": 1, "content": 5, "vector": {}}', None),
    ("jsonl", None, "syntax"),
    ("jsonl", "", "syntax"),
    ("jsonl", "[]", "syntax"),
    ("jsonl", "5", "syntax"),
    ("jsonl", '{"id": 1, "vector": {}} {}', "syntax"),
    ("jsonl", "{'id': 1}", "syntax"),
    ("jsonl", '{"id": 01, "vector": {}}', "syntax"),
    ("jsonl", J % ("1", '{"a": NaN}'), "syntax"),
    ("jsonl", J % ("1", '{"a": Infinity}'), "syntax"),
    ("jsonl", '{"id": 1, "vector": {},}', "syntax"),
    ("jsonl", '{"id": "a\tb", "vector": {}}', "syntax"),
    ("jsonl", "﻿" + J % ("1", "{}"), "syntax"),
    ("jsonl", '{"vector": {}}', "fields"),
    ("jsonl", '{"id": 1}', "fields"),
    ("jsonl", '{"ID": 1, "vector": {}}', "fields"),
    ("jsonl", '{"id": -1, "vector": {}, "x": 1}', "fields"),
    ("jsonl", J % ("-1", "{}"), "id"),
    ("jsonl", J % ("1.0", "{}"), "id"),
    ("jsonl", J % ("1e3", "{}"), "id"),
    ("jsonl", J % ("9223372036854775808", "{}"), "id"),
    ("jsonl", J % ("9" * 60, "{}"), "id"),
    ("jsonl", J % ("true", "{}"), "id"),
    ("jsonl", J % ("null", "5"), "id"),
    ("jsonl", J % ('""', "{}"), "id"),
    ("jsonl", J % ('"a b"', "{}"), "id"),
    ("jsonl", J % ('"é"', "{}"), "id"),
    ("jsonl", J % ('"a\\n"', "{}"), "id"),
    ("jsonl", J % ('"_a"', "{}"), "id"),
    ("jsonl", J % ("1", "[]"), "vector"),
    ("jsonl", J % ("1", "null"), "vector"),
    ("jsonl", J % ("1", '{"": 1}'), "vector"),
    ("jsonl", J % ("1", '{"a": -1}'), "vector"),
    ("jsonl", J % ("1", '{"a": 1e39}'), "vector"),
    ("jsonl", J % ("1", '{"a": 1e999}'), "vector"),
    ("jsonl", J % ("1", '{"a": "1"}'), "vector"),
    ("jsonl", J % ("1", '{"a": true}'), "vector"),
    ("jsonl", J % ("1", '{"a": %s}' % ("9" * 400)), "vector"),
    ("jsonl", J % ("1", '{"a": %s}' % ("9" * 38)), None),
    ("jsonl", J % ("1", '{"a": %s}' % ("9" * 39)), "vector"),
    ("tsv", 'x1\ttext "q"\t{"a": 1}', None),
    ("tsv", '"x1"\t"a\tb""c"\t"{""a"": 1}"', None),
    ("tsv", "x1\t\t{}\r", None),
    ("tsv", '"x1\ttext\t{}', "syntax"),
    ("tsv", 'x1\t"text"x\t{}', "syntax"),
    ("tsv", "x1\t{}", "fields"),
    ("tsv", "", "fields"),
    ("tsv", "x1\ta\t{}\t", "fields"),
    ("tsv", " x1\ta\t{}", "id"),
    ("tsv", "\ta\t{}", "id"),
    ("tsv", "x1\ta\t", "vector"),
    ("tsv", "x1\ta\t{'a': 1}", "vector"),
    ("tsv", 'x1\ta\t{"a": -0.5}', "vector"),
    ("csv", "x1\ta\t{}", "syntax"),
    (None, "x1\ta\t{}", "syntax"),
]


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(i, feed, f"file {i}", line, "x", "y") for i, (feed, line, _) in enumerate(CASES)]
    return spark.createDataFrame(rows, "line_no long, feed string, file_name string, raw_line string, cells string, reason string")


def test_reasons(lines):
    got = {r.line_no: r.reason for r in failed_lines(lines).collect()}
    assert {i: (c, got.get(i)) for i, c in enumerate(CASES) if got.get(i) != c[2]} == {}


def test_the_other_lines_are_loaded(lines):
    got = {r.line_no: r for r in loaded_lines(lines).collect()}
    assert set(got) == {i for i, c in enumerate(CASES) if c[2] is None}
    assert got[0].id == "1" and got[0].vector == {"a": 1.0} and got[0].content is None
    assert got[5].content == "5" and got[1].vector == {}
    quoted = got[next(i for i, c in enumerate(CASES) if c[1] and c[1].startswith('"x1"\t"a'))]
    assert (quoted.id, quoted.content, quoted.vector) == ("x1", 'a\tb"c', {"a": 1.0})


def test_repeated_keys_and_lone_surrogates(spark):
    rows = [(1, "jsonl", '{"id": -1, "id": 2, "vector": {"a": -1, "a": 3}}'), (2, "jsonl", '{"id": 1, "vector": {"\\ud800": 1, "\\ud801": 2}}')]
    df = spark.createDataFrame(rows, "line_no long, feed string, raw_line string")
    assert failed_lines(df).count() == 0
    got = {r.line_no: r.vector for r in loaded_lines(df).collect()}
    assert got == {1: {"a": 3.0}, 2: {"?": 2.0}}


def test_long_deep_and_no_lines(spark):
    long = '{"id": 1, "content": "%s", "vector": {%s}}' % ("x" * 1_000_000, ", ".join(f'"t{i}": 1' for i in range(20_000)))
    rows = [(1, "jsonl", long), (2, "jsonl", "[" * 200_000), (3, "jsonl", '{"id": 1, "vector": %s}' % ("[" * 50 + "]" * 50))]
    df = spark.createDataFrame(rows, "line_no long, feed string, raw_line string")
    assert {r.line_no: r.reason for r in failed_lines(df).collect()} == {2: "syntax", 3: "vector"}
    assert failed_lines(df.limit(0)).count() == 0 and loaded_lines(df.limit(0)).count() == 0


def test_fields_keep_round_trips():
    for fields in (["a", "b", "c"], ['"', "\t", ""], ['x"y', 'a""b\t', "{}"]):
        line = "\t".join('"' + f.replace('"', '""') + '"' for f in fields)
        assert tsv_fields(line) == fields

