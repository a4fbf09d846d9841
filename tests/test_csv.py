import csv as reader
import io
import random
import re

import pytest

from dataward.sources import csv


def write(tmp_path, name, data: bytes):
    folder = tmp_path / "in"
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(data)
    return str(folder / name)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_bom_semicolon_and_trailing_delimiter(spark, tmp_path):
    path = write(tmp_path, "a.csv", b"\xef\xbb\xbfid;name;\n1;Ann;\n2;N/A;\n;;\n")
    df = csv.read_csv(spark, path)
    assert df.columns == ["id", "name"]
    assert rows(df) == [(1, "Ann"), (2, None)]


def test_latin_one(spark, tmp_path):
    path = write(tmp_path, "b.csv", "id|name\n1|Zoë\n2|José\n".encode("latin-1"))
    assert rows(csv.read_csv(spark, path)) == [(1, "Zoë"), (2, "José")]
    assert csv.detect_encodings(spark, path).first().encoding == "ISO-8859-1"


def test_quoted_delimiters_do_not_count(spark, tmp_path):
    path = write(tmp_path, "c.csv", b'id,text\n1,"a;b;c"\n2,"d;e;f"\n3,"g, ""h"""\n')
    assert csv.sniff_delimiters(spark, path).first().delimiter == ","
    assert rows(csv.read_csv(spark, path)) == [(1, "a;b;c"), (2, "d;e;f"), (3, 'g, "h"')]


def test_one_column_falls_back_to_comma(spark, tmp_path):
    path = write(tmp_path, "d.csv", b"id\n1\n2\n")
    assert csv.sniff_delimiters(spark, path).first().delimiter == ","
    assert rows(csv.read_csv(spark, path)) == [(1,), (2,)]


def test_unnamed_and_empty_columns(spark, tmp_path):
    path = write(tmp_path, "e.csv", b"Unnamed: 0,a,b,empty\n0,1,x,\n1,2.5,NULL,nan\n")
    df = csv.read_csv(spark, path)
    assert df.columns == ["a", "b"] and rows(df) == [(1.0, "x"), (2.5, None)]


def test_line_breaks_in_quotes(spark, tmp_path):
    path = write(tmp_path, "f.csv", b'id,text\n1,"two\nlines"\n2,one\n')
    assert rows(csv.read_csv(spark, path)) == [(1, "two\nlines"), (2, "one")]


def test_over_long_lines_are_skipped_and_counted(spark, tmp_path):
    path = write(tmp_path, "g.csv", b'a,b\n1,2\n1,2,3\n"x,y",4\n5\n')
    assert rows(csv.read_csv(spark, path)) == [("1", 2), ("x,y", 4), ("5", None)]
    assert tuple(csv.malformed_lines(spark, path).first()) == (1, 3)


def quoted_file(seed, n, delimiter):
    """Records with breaks, doubled quotes, separators, empty and long fields, in any order."""
    r = random.Random(seed)
    parts = ["a", "two\nlines", 'a "word"', f"x{delimiter}y", "\n", "", "end\n\n", '"', "é", f'"{delimiter}"', "z" * 60, "\r\n"]
    rows = [[str(i), "".join(r.choice(parts) for _ in range(r.randint(0, 4))), r.choice(parts)] for i in range(n)]
    out = io.StringIO()
    w = reader.writer(out, delimiter=delimiter, lineterminator=r.choice(["\n", "\r\n"]))
    w.writerow(["id", "text", "other"])
    w.writerows(rows)
    return out.getvalue(), rows


@pytest.mark.parametrize("seed,delimiter,encoding", [(1, ",", "utf-8"), (2, ";", "latin-1"), (3, "|", "utf-8"), (4, "\t", "utf-8")])
def test_quoted_records_over_many_splits(spark, tmp_path, seed, delimiter, encoding):
    text, want = quoted_file(seed, 400, delimiter)
    path = write(tmp_path, "q.csv", text.encode(encoding))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = csv.records(spark, [path], delimiter, "UTF-8" if encoding == "utf-8" else "ISO-8859-1")
        assert spark.read.text(path).rdd.getNumPartitions() > 10
        rows = [next(reader.reader(io.StringIO(r.record, newline=""), delimiter=delimiter))
                for r in found.where("NOT header").collect()]
        assert sorted(rows) == sorted(want)
        assert [r.record for r in found.where("header").collect()] == [delimiter.join(["id", "text", "other"])]
        table = csv.read_csv(spark, path, infer=False)
        assert table.rdd.getNumPartitions() > 1
        assert sorted(int(r.id) for r in table.collect()) == list(range(400))
        texts = {r.id: r.text for r in table.collect()}
        assert all((texts[i] or "") == t for i, t, _ in want if "\r" not in t and t not in ("", '"'))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_stray_quotes_do_not_join_lines(spark, tmp_path):
    path = write(tmp_path, "s.csv", b'id,size\n1,5" pipe\n2,"two\nlines"\n\n3,x"y\n4,"a"\n')
    assert sorted(rows(csv.read_csv(spark, path))) == [(1, '5" pipe'), (2, "two\nlines"), (3, 'x"y'), (4, "a")]
    found = csv.records(spark, [path], ",", "UTF-8")
    assert found.where("NOT header").count() == 4


def test_long_quoted_field(spark, tmp_path):
    text = "word \"\"x\"\" " * 40_000
    path = write(tmp_path, "l.csv", ('id,text\n1,"' + text + '\nend"\n2,b\n').encode())
    found = {r.id: r.text for r in csv.read_csv(spark, path).collect()}
    assert found[2] == "b" and found[1] == text.replace('""', '"') + "\nend"


def test_lines_are_counted_without_being_sorted(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("\n\nid;name\n1;x\n2;y\n")
    (tmp_path / "b.csv").write_text("id,name\n1,x\n")
    (tmp_path / "c.csv").write_text("\n\n")
    plans, write = [], csv.materialize

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(csv, "materialize", seen)
    found = {r.file[-5:]: (r.delimiter, r.header) for r in csv.file_formats(spark, str(tmp_path)).collect()}
    assert found == {"a.csv": (";", "id;name"), "b.csv": (",", "id,name")}
    assert "HashAggregate(keys=[file" in plans[0] or "HashAggregate(key=[file" in plans[0]
    assert not re.search(r"SortAggregate\(keys?=\[file#\d+, choice", plans[0])
