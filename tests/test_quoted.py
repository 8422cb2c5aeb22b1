"""Quoted files read by many tasks, against the reader that takes a file in one."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tagwright.sources import quoted, scan


def in_one_task(spark, path, delimiter="|"):
    reader = spark.read.option("header", True).option("sep", delimiter).option("quote", '"').option("escape", '"')
    return reader.option("multiLine", True).csv(path)


def field(rng):
    kind = rng.random()
    if kind < 0.4:
        return "".join(rng.choice("ab c") for _ in range(rng.randint(1, 6))).strip() or "z"
    if kind < 0.5:
        return "5\" x"  # a quote inside an unquoted field
    if kind < 0.6:
        return ""
    inner = "".join(rng.choice('ab|\n"é ') for _ in range(rng.randint(0, 9)))
    return '"' + inner.replace('"', '""') + '"'


@pytest.fixture
def small_ranges(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997b")
    spark.conf.set("spark.sql.files.openCostInBytes", "10b")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_rows_are_those_of_one_task(spark, tmp_path, small_ranges, seed):
    rng = random.Random(seed)
    for name in ("a.txt", "b.txt"):
        lines = ["one|two|three", *["|".join(field(rng) for _ in range(3)) for _ in range(400)]]
        (tmp_path / name).write_text("\n".join(lines) + rng.choice(["", "\n"]), newline="")
    df = quoted.scan_quoted(spark, str(tmp_path), "|")
    assert df.columns == ["one", "two", "three"]
    assert as_rows(df) == as_rows(in_one_task(spark, str(tmp_path)))
    assert quoted._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 8


def test_a_record_over_many_ranges(spark, tmp_path, small_ranges):
    long = "line |\n" * 2000 + 'with ""quotes""'
    text = f'id|text\n1|"{long}"\n2|plain\n3|"{long}"|more\n\n4|"x"\n'
    (tmp_path / "a.txt").write_text(text)
    rows = as_rows(quoted.scan_quoted(spark, str(tmp_path), "|"))
    assert rows == as_rows(in_one_task(spark, str(tmp_path)))
    assert [r[0] for r in rows] == ["1", "2", "3", "4"] and rows[0][1] == long.replace('""', '"')


def test_windows_line_breaks_headings_and_empty_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b'id,"a ""b"""\r\n1,"x\r\ny"\r\n2,z\r\n')
    df = quoted.scan_quoted(spark, str(tmp_path / "a.txt"), ",")
    assert df.columns == ["id", 'a "b"'] and as_rows(df) == [("1", "x\ny"), ("2", "z")]
    (tmp_path / "b.txt").write_text("id|x\n")
    assert quoted.scan_quoted(spark, str(tmp_path / "b.txt"), "|").count() == 0
    assert scan.scan_delimited(spark, str(tmp_path / "b.txt")).columns == ["id", "x"]


def test_states_follow_the_lines_one_by_one():
    rng = random.Random(8)
    for _ in range(300):
        effect = np.array([rng.randrange(4) for _ in range(rng.randint(0, 12))], dtype=np.int8)
        for start in (False, True):
            at, expected = start, [start]
            for e in effect:
                at = {quoted.KEEP: at, quoted.OUT: False, quoted.IN: True, quoted.TURN: not at}[int(e)]
                expected.append(at)
            assert quoted.states(effect, start).tolist() == expected


def test_effects_of_lines():
    lines = ['a|b', '"a|b', 'a"b', '"a"', '"a""', 'x|"y', 'a"|"b', '"', '""', 'a|"b"c|"d']
    from_outside = [False, True, False, False, True, True, True, True, False, True]
    effect = quoted.effects(pa.array(lines), "|")
    assert [bool(quoted.states(effect[i : i + 1], False)[1]) for i in range(len(lines))] == from_outside
    from_inside = [True, False, False, False, False, False, True, False, True, True]
    assert [bool(quoted.states(effect[i : i + 1], True)[1]) for i in range(len(lines))] == from_inside
