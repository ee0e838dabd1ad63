"""Records of CSV files and JSON arrays that lie across byte ranges."""

import csv
import io
import json
import random

import pytest
from hypothesis import given, settings, strategies as st

from dataloom.sources import readers, record_ranges

CSV_ALPHABET = st.text(st.sampled_from('a",\n ;é'), max_size=60)


def plain_end(line, inside):
    """Character by character."""
    field_start, in_field = not inside, False
    k = 0
    while k < len(line):
        c = line[k]
        if inside:
            if c == '"':
                if line[k + 1: k + 2] == '"':
                    k += 1
                else:
                    inside, in_field, field_start = False, True, False
        elif c == ",":
            field_start, in_field = True, False
        elif field_start and c == '"':
            inside, field_start = True, False
        else:
            field_start = False
        k += 1
    return inside


@given(st.text(st.sampled_from('a",é '), max_size=30), st.booleans())
@settings(max_examples=500, deadline=None)
def test_line_ends(line, inside):
    assert record_ranges.ends_inside(line, inside) == plain_end(line, inside)


def split_by_ranges(text, cuts):
    """Records by the walk and the chain, ranges cut at the given lines."""
    import pandas as pd

    lines = text.split("\n")
    bounds = sorted({0, *(c % len(lines) for c in cuts), len(lines)})
    found, last = [], []
    names = ["before_0", "before_1", "after_0", "after_1", "record_0", "record_1", "head"]
    for a, b in zip(bounds, bounds[1:]):
        step = record_ranges._csv_walk()
        rows = [dict(zip(names, step(line, k, a)), block=a, row=k, value=line) for k, line in enumerate(lines[a:b])]
        found += rows
        last.append({"file": "f", **rows[-1]})
    begun = {r.block: r for r in record_ranges._csv_chain(pd.DataFrame(last)).itertuples()}
    records = {}
    for r in found:
        at = begun[r["block"]]
        record = r[f"record_{int(at.inside)}"]
        key = (r["block"], record) if record >= 0 else (at.owner_block, at.owner_row)
        records.setdefault(key, []).append(r["value"])
    return ["\n".join(v) for v in records.values()], any(r.unclosed for r in begun.values())


@given(CSV_ALPHABET, st.lists(st.integers(0, 60), max_size=5))
@settings(max_examples=500, deadline=None)
def test_csv_records(text, cuts):
    records, unclosed = split_by_ranges(text, cuts)
    want, state = [], False
    for line in text.split("\n"):
        if state:
            want[-1] += "\n" + line
        else:
            want.append(line)
        state = plain_end(line, state)
    assert (records, unclosed) == (want, state)


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of a few hundred bytes."""
    settings_of = {"spark.sql.files.maxPartitionBytes": "2500b", "spark.sql.files.openCostInBytes": "1b"}
    before = {k: spark.conf.get(k) for k in settings_of}
    for key, value in settings_of.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def rows_of(seed, n):
    own = random.Random(seed)
    texts = ["plain", 'say "hi", now', "two\nlines", 'a\n"b"\n,c\n\n"', "", "é漢🙂", "x" * 900 + "\n" + "y" * 900, '"', ",", "\n"]
    return [(k, own.choice(texts), own.random()) for k in range(n)]


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_one_csv_file_of_many_ranges(spark, tmp_path, small_ranges, ending):
    rows = rows_of(1, 150)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=ending)
    writer.writerow(["k", "the text", "x"])
    writer.writerows(rows)
    (tmp_path / "one.csv").write_text("﻿" + out.getvalue(), newline="")
    frame = readers.read_csv(spark, f"{tmp_path}/one.csv")
    assert [f.dataType.simpleString() for f in frame.schema] == ["int", "string", "double"]
    assert frame.columns == ["k", "the text", "x"]
    got = sorted((r[0], r[1] or "", r[2]) for r in frame.collect())
    assert got == rows
    # Many tasks read the file.
    lines = record_ranges._pieces(spark, f"{tmp_path}/one.csv", "\n")
    assert lines.rdd.getNumPartitions() >= 8
    typed = readers.read_csv(spark, f"{tmp_path}/one.csv", "k long, t string, x double")
    assert typed.count() == 150 and typed.where("k = 7").first().t == (rows[7][1] or None)


def test_unbalanced_quotes_stop_the_reading(spark, tmp_path, small_ranges):
    lines = ["a,b", *(f'{k},"one\ntwo {k}"' for k in range(100)), '7,"open', *(f"{k},x" for k in range(100))]
    (tmp_path / "t.csv").write_text("\n".join(lines))
    for malformed in ("raise", "drop", "null"):
        with pytest.raises(ValueError, match="not closed"):
            readers.read_csv(spark, f"{tmp_path}/t.csv", malformed=malformed)


def test_malformed_rows_between_line_breaks(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x\ny"\noops,z\n2,q,extra\n')
    path = f"{tmp_path}/t.csv"
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        readers.read_csv(spark, path, "a int, b string").collect()
    assert [tuple(r) for r in readers.read_csv(spark, path, "a int, b string", malformed="drop").collect()] == [(1, "x\ny")]
    assert readers.read_csv(spark, path, "a int, b string", malformed="null").count() == 3


def test_lines_without_breaks_are_spark_s_own(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x, y"\n2,"he said ""no"""\n')
    frame = readers.read_csv(spark, f"{tmp_path}/t.csv")
    assert "FileScan csv" in frame._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, frame.collect())) == [(1, "x, y"), (2, 'he said "no"')]


def test_folder_of_csv_files(spark, tmp_path, small_ranges):
    for k in range(3):
        body = "".join(f'{k},"line\n{j}"\n' for j in range(30))
        (tmp_path / f"{k}.csv").write_text(f'\n\n"n","the\ntext"\n{body}')
    frame = readers.read_csv(spark, str(tmp_path))
    assert frame.columns == ["n", "the\ntext"] and frame.count() == 90


@given(st.lists(st.text(st.sampled_from('ab{}[]",\\\n'), max_size=8), max_size=8))
@settings(max_examples=300, deadline=None)
def test_levels(values):
    text = json.dumps([{"k": v, "n": {"l": [v]}} for v in values])
    inside, level = False, 0
    pieces = text.split("}")
    for k, piece in enumerate(pieces):
        inside, deeper = record_ranges.levels(piece, inside)
        level += deeper - (not inside and k < len(pieces) - 1)
    assert (inside, level) == (False, 0)


@pytest.mark.parametrize("indent", [None, 1])
def test_one_json_array_of_many_ranges(spark, tmp_path, small_ranges, indent):
    rows = [{"k": k, "t": t + '}{"]', "n": {"l": [{"x": x}, {"x": 1.0}]}} for k, t, x in rows_of(2, 120)]
    (tmp_path / "one.json").write_text("\n [ " + json.dumps(rows, indent=indent)[1:] + "\n")
    frame = readers.read_json(spark, f"{tmp_path}/one.json")
    got = sorted((r.asDict(recursive=True) for r in frame.collect()), key=lambda r: r["k"])
    assert got == rows
    assert record_ranges._pieces(spark, f"{tmp_path}/one.json", "}").rdd.getNumPartitions() >= 8


@pytest.mark.parametrize("text, match", [
    ('[{"a": 1}, {"a": ', "not closed"), ('[{"a": 1}', "not closed"), ('[{"a": "x}]', "not closed"),
    ('[{"a": 1}, 5]', "not a record"), ('[1, {"a": 1}]', "not a record"), ('[{"a": 1}] {"b": 2}', "not closed"),
])
def test_broken_arrays_stop_the_job(spark, tmp_path, text, match):
    (tmp_path / "t.json").write_text(text)
    with pytest.raises(Exception, match=match):
        readers.read_json(spark, f"{tmp_path}/t.json", "a int").collect()


def test_small_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text("[]")
    assert readers.read_json(spark, f"{tmp_path}/a.json", "a int").collect() == []
    (tmp_path / "b.json").write_text('[{"a": 1}, {}, {"a": {"b": "}"}}]')
    assert [r.a for r in readers.read_json(spark, f"{tmp_path}/b.json", "a string").orderBy("a").collect()] == [None, "1", '{"b":"}"}']
    (tmp_path / "c.json").write_text('{"a": 4,\n"b": [{}]}')
    assert readers.read_json(spark, f"{tmp_path}/c.json", "a int").first().a == 4
