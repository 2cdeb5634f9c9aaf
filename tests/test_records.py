"""Records over line ends and arrays in many tasks, file manifests."""

import csv
import gzip
import io
import json
import random
from contextlib import contextmanager

import duckdb
import pytest

from tabwright.sources import manifest, readers, records

RANDOM = random.Random(17)
CELLS = ["plain", "with, comma\tand tab", 'say "hi"', "two\nlines", "a\r\nb", "", '"\n"', "\n\n", 'end"\n', "né\n" * 40, "x" * 900]


@contextmanager
def small_splits(spark, size):
    keys = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_of(n, seed):
    rng = random.Random(seed)
    return [[str(i), rng.choice(CELLS), rng.choice(CELLS)] for i in range(n)]


def write(path, header, rows, sep=",", end="\r\n", quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO(newline="")
    writer = csv.writer(out, delimiter=sep, lineterminator=end, quoting=quoting)
    writer.writerow(header)
    writer.writerows(rows)
    path.write_bytes(out.getvalue().encode())


@pytest.mark.parametrize("size", ["300b", "3k", "1m"])
@pytest.mark.parametrize("sep, end, quoting", [(",", "\r\n", csv.QUOTE_MINIMAL), ("\t", "\n", csv.QUOTE_ALL)])
def test_line_ends_inside_quotes(spark, tmp_path, size, sep, end, quoting):
    rows = rows_of(120, 5)
    write(tmp_path / "a.csv", ["id", "b", "c\nd"], rows, sep, end, quoting)
    path = str(tmp_path / "a.csv")
    read = readers.read_csv if sep == "," else readers.read_tsv
    with small_splits(spark, size):
        tasks = records.units(spark, path, "\n").rdd.getNumPartitions()
        df = read(spark, path)
    assert tasks > 1 or size == "1m"
    assert df.columns == ["id", "b", "c\nd"] and dict(df.dtypes)["id"] == "bigint"
    # Carriage returns inside quotes stay.
    wanted = sorted((int(i), b or None, c or None) for i, b, c in rows)
    assert sorted(map(tuple, df.collect())) == wanted


def test_equals_duckdb(spark, tmp_path):
    write(tmp_path / "a.csv", ["id", "b", "c"], [[i, b.replace("\r", ""), c.replace("\r", "")] for i, b, c in rows_of(300, 8)], end="\n")
    path = str(tmp_path / "a.csv")
    with small_splits(spark, "2k"):
        found = sorted(map(tuple, readers.read_csv(spark, path).collect()), key=repr)
    wanted = duckdb.sql(f"select id, nullif(b, ''), nullif(c, '') from read_csv('{path}', quote='\"', escape='\"', header=true)").fetchall()
    assert found == sorted(wanted, key=repr)


def test_without_line_ends_spark_reads_the_file(spark, tmp_path):
    write(tmp_path / "a.csv", ["id", "b"], [["1", 'say "hi"'], ["2", "x,y"], ["3", "stray"]])
    (tmp_path / "b.csv").write_text('id,b\n4,5" disk\n5,"q" tail\n')
    assert not records.has_open_lines(spark, str(tmp_path), ",")
    df = readers.read_csv(spark, str(tmp_path))
    assert sorted(df.select("id").collect()) == [(i,) for i in range(1, 6)]
    assert df.where("id = 4").first()["b"] == '5" disk'


@pytest.mark.parametrize("line, wanted", [
    ("a,b", (False, False)), ('a,"b', (True, False)), ('"a', (True, False)), ('a"b,c', (False, False)), ('"a""', (True, False)),
    ('x"', (False, False)), ('x","y', (True, True)), ('x""', (False, True)), ("", (False, True)), ('","', (False, True)), ('a,"b",c', (False, False)),
    ('"a"x,"b', (True, True)), ('x"y,"z"', (False, False)),
])
def test_states_of_a_line(spark, line, wanted):
    import re

    from pyspark.sql import functions as F

    outside, inside = (re.compile(p) for p in records._patterns(",", r"\Z"))
    python = outside.match(line) is not None, inside.match(line) is not None
    native = tuple(spark.range(1).select(*[c.alias(n) for c, n in zip(records._open(F.lit(line), ","), "ab")]).first())
    # A line without quotes stays inside.
    expected = (wanted[0], True if '"' not in line else wanted[1])
    assert native == expected and python == expected


def test_headers_of_several_kinds_with_line_ends(spark, tmp_path):
    write(tmp_path / "a.csv", ["id", "name"], [["1", "x\ny"], ["2", "z"]])
    write(tmp_path / "b.csv", ["name", "id"], [["q\n", "9"]])
    (tmp_path / "c.csv").write_bytes("﻿\n  \nid,more\n5,z\n\n  \n6,\"w\n\"\n".encode())
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "e.csv").write_bytes(b"id,name\n7,seven")
    df = readers.read_csv(spark, str(tmp_path))
    assert df.columns == ["id", "name", "more"]
    assert sorted(map(tuple, df.collect())) == [
        (1, "x\ny", None), (2, "z", None), (5, None, "z"), (6, None, "w\n"), (7, "seven", None), (9, "q\n", None)
    ]


def test_a_quote_that_is_never_closed(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,b\n1,"x\n2,y\n3,z\n')
    with pytest.raises(ValueError, match="never closed"):
        readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert readers.read_csv(spark, str(tmp_path / "a.csv"), multiline=False).count() == 3


def test_compressed_files(spark, tmp_path):
    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(b'id,b\n1,"x\ny"\n2,z\n'))
    df = readers.read_csv(spark, str(tmp_path / "a.csv.gz"))
    assert sorted(map(tuple, df.collect())) == [(1, "x\ny"), (2, "z")]


class Counted(io.BytesIO):
    asked = 0

    def read(self, n=-1):
        data = super().read(n)
        self.asked += len(data)
        return data


def test_headers_take_a_block_of_each_file(spark, tmp_path):
    stream = Counted(b'id,"a\nb"\r\n' + b"1,2\n" * 500_000)
    assert manifest.first_record(stream, ",") == 'id,"a\nb"' and stream.asked == manifest.BLOCK
    long = Counted(b'"' + b"x\n" * 200_000 + b'",b\n1,2\n')
    assert manifest.first_record(long, ",") == '"' + "x\n" * 200_000 + '",b'
    assert manifest.first_record(Counted(b" \n\n"), ",") is None
    for i in range(5):
        (tmp_path / f"f {i}.csv").write_text(f"id,c{i % 2}\n{i},x\n")
    found = manifest.headers(spark, str(tmp_path), ",").collect()
    assert sorted(r["header"] for r in found) == ["id,c0"] * 3 + ["id,c1"] * 2 and all(r["length"] == 10 for r in found)
    df = readers.read_csv(spark, str(tmp_path))
    assert df.columns == ["id", "c0", "c1"] and df.count() == 5


TEXTS = ["}", "{", "]}", 'q"}', "\\", '\\"}', "é", "x" * 300, "[{", ""]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", ["200b", "1k", "1m"])
def test_one_array_in_many_tasks(spark, tmp_path, indent, size):
    rng = random.Random(3)
    objects = [{"i": i, "s": rng.choice(TEXTS), "n": {"a": [{"b": rng.choice(TEXTS)}], "}": 1}, "e": []} for i in range(120)]
    path = tmp_path / "a.json"
    path.write_text(json.dumps(objects, indent=indent, ensure_ascii=False))
    with small_splits(spark, size):
        assert records.units(spark, str(path), "}").rdd.getNumPartitions() > (1 if size != "1m" else 0)
        found = sorted((json.loads(r["text"]) for r in records.array_records(spark, str(path)).collect()), key=lambda r: r["i"])
        assert found == objects
        if size == "1k":
            df = readers.read_json(spark, str(path))
            assert df.columns == ["i", "s", "n", "e"]
            assert [(r["i"], r["s"], r["n"]["a"][0]["b"]) for r in df.orderBy("i").collect()] == [
                (o["i"], o["s"], o["n"]["a"][0]["b"]) for o in objects
            ]


@pytest.mark.parametrize("text", ['[{"a":1}][{"a":2}]', '[{"a":1},3]', "[1, 2]", '[{"a":1}', '[{"a":1}] {"a":2}', '[{"a":1} {"a":2}]', '{"a":1}'])
def test_what_is_no_array_of_objects(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(ValueError):
        records.array_records(spark, str(tmp_path / "a.json"))


def test_empty_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text(" [ ]\n")
    (tmp_path / "b.json").write_text('[{"a": 1}]')
    assert [r["text"] for r in records.array_records(spark, str(tmp_path)).collect()] == ['{"a": 1}']
    assert readers.read_json(spark, str(tmp_path / "a.json")).count() == 0


def test_split_sizes_of_the_queries_grow_with_the_files(spark, tmp_path):
    from tabwright.plans import queries_load

    (tmp_path / "small.csv").write_text("a\n1\n")
    (tmp_path / "large.csv").write_text("a\n" + "12345678\n" * 6_000_000)
    small, large = (queries_load._split_bytes(spark, str(tmp_path / f"{k}.csv")) for k in ("small", "large"))
    assert small == queries_load.SMALLEST_SPLIT
    assert large == 54_000_002 // (queries_load.SPLITS_PER_CORE * spark.sparkContext.defaultParallelism) > small


def test_the_array_file_is_written_as_its_lines_come():
    import pyarrow as pa

    from tabwright.plans import queries_load

    asked = []

    def lines():
        for i in range(3):
            asked.append(i)
            yield pa.RecordBatch.from_pydict({"value": [f'{{"o_orderkey": {i}}},']})

    out = queries_load._bracketed(lines())
    texts = []
    for n, batch in enumerate(out):
        assert len(asked) <= n  # no line is asked for before the ones ahead of it are out
        texts += batch.column(0).to_pylist()
    assert json.loads("".join(texts)) == [{"o_orderkey": k} for k in (0, 1, 2, None)]
