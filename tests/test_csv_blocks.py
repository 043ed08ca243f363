"""CSV in blocks: the same rows as one task reads, whatever lies across the ends of blocks."""

import csv
import io
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelsense.sources import csv_blocks, tables

SCHEMA = T.StructType().add("id", "long").add("a", "string").add("price", "double").add("b", "string")


@pytest.fixture
def small_blocks(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    spark.conf.set(names[0], "700")
    spark.conf.set(names[1], "1")
    yield
    for name in names[:2]:
        spark.conf.unset(name)


def field(draw):
    parts = ["x", "word", '"', '""', ",", "\n", "\n\n", " ", "é", "\r\n", "it's"]
    return "".join(draw.choice(parts) for _ in range(draw.randrange(12)))


def written(path, rows, header=True, ends="\n"):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=ends, quoting=csv.QUOTE_MINIMAL)
    writer.writerows([["id", "a", "price", "b"]] * header + rows)
    path.write_bytes(out.getvalue().encode())


def read(spark, path, **options):
    return [tuple(r) for r in csv_blocks.read_csv(spark, str(path), SCHEMA, **options).orderBy("id").collect()]


def expected(rows):
    return [(i, a or None, p, b or None) for i, a, p, b in rows]


def test_line_states(spark):
    lines = ["a,b", '"a,b', 'a,"b', 'a"b', '"a"",b', '"a","b', 'x",b', 'x","b', '"', '""', '"""', "", ',"', 'a,"b",c"d,"e']
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    closed, open_ = csv_blocks.line_states(F.col("line"))
    got = [tuple(r) for r in df.select(closed, open_).collect()]

    def plain(line, quoted):
        at_start = not quoted
        i = 0
        while i < len(line):
            c = line[i]
            if quoted:
                if c == '"' and line[i + 1 : i + 2] == '"':
                    i += 1
                elif c == '"':
                    quoted = False
            elif c == '"' and at_start:
                quoted = True
            at_start = not quoted and c == ","
            i += 1
        return quoted

    assert got == [(plain(x, False), plain(x, True)) for x in lines]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([(False, True), (False, False), (True, True), (True, False)]), min_size=1, max_size=20), st.booleans())
def test_states_after(functions, state):
    closed, open_ = (np.array(c) for c in zip(*functions, strict=True))
    out, now = csv_blocks.states_after(state, closed, open_), state
    for i, f in enumerate(functions):
        now = f[now]
        assert out[i] == now


@pytest.mark.parametrize("seed", range(4))
def test_breaks_and_doubled_quotes_across_blocks(spark, small_blocks, tmp_path, seed):
    draw = random.Random(seed)
    rows = [[i, field(draw), draw.choice([1.5, None]), field(draw).strip()] for i in range(400)]
    rows[37][1] = "long\n" * 900  # over several blocks
    rows[38][3] = '"\n' * 500
    written(tmp_path / "one.csv", rows)
    parts = spark.read.text(str(tmp_path / "one.csv")).rdd.getNumPartitions()
    assert parts > 10
    got = read(spark, tmp_path / "one.csv")
    one_task = tables.read_whole_csv(spark, str(tmp_path / "one.csv"), SCHEMA).orderBy("id").collect()
    assert got == [tuple(r) for r in one_task] and len(got) == 400
    assert [r[0] for r in got] == list(range(400)) and got[37][1] == rows[37][1] and got[38][3] == rows[38][3]


def test_several_files_line_ends_and_no_header(spark, small_blocks, tmp_path):
    rows = [[i, f"a\n{i}", float(i), 'say "x", then'] for i in range(120)]
    (tmp_path / "t").mkdir()
    written(tmp_path / "t" / "a.csv", rows[:60], ends="\r\n")
    written(tmp_path / "t" / "b.csv", rows[60:119])
    written(tmp_path / "t" / "c.csv", rows[119:])
    written(tmp_path / "t" / "d.csv", [])
    (tmp_path / "t" / "e.csv").write_text("")
    assert read(spark, tmp_path / "t") == expected(rows)
    written(tmp_path / "plain.csv", rows, header=False)
    assert read(spark, tmp_path / "plain.csv", header=False) == expected(rows)


def test_blank_lines_bad_fields_and_an_open_quote(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,a,price,b\n\n1,x,y,z\n2,5" wide,2,\n3,"open,3,\nend')
    got = read(spark, tmp_path / "x.csv")
    assert got[:2] == [(1, "x", None, "z"), (2, '5" wide', 2.0, None)] and got[2][0] == 3 and len(got) == 3


def test_reviews_reader(spark, small_blocks, tmp_path):
    docs = spark.createDataFrame([(i, f"line\n{i} \"q\"", None) for i in range(50)], "id long, text string, lang string")
    tables.write_reviews_csv(docs.coalesce(1), str(tmp_path / "r"))
    back = tables.read_reviews_csv(spark, str(tmp_path / "r"), docs.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, docs.collect()))
