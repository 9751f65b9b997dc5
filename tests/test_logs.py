"""Delimited logs: both layouts, problems as rows, appending and upgrading."""

import os

from quillstone.sources import logs


def line(columns, **kw):
    return ";".join(str(kw.get(c, "")) for c in columns)


def folder(tmp_path):
    new, old = logs.COLUMNS, logs.OLD_COLUMNS
    one = ["﻿" + ";".join(new), line(new, zaman="2024-01-02", kullanici="a", soru='"x;y ""z"""', toplam_token=10), line(new, zaman="2024-01-03", kullanici="a", toplam_token="?"), ""]
    two = [";".join(old), line(old, zaman="2024-01-01", kullanici="b", istem_token=7, uretilen_token=5, toplam_token=12), line(old, zaman="2024-01-05", kullanici="b", uretilen_token="x", toplam_token=3)]
    (tmp_path / "one.csv").write_text("\r\n".join(one), encoding="utf-8")
    (tmp_path / "two.csv").write_text("\r\n".join(two) + "\r\n", encoding="utf-8")
    (tmp_path / "torn.csv").write_text(";".join(old) + "\n" + line(old, kullanici="c", uretilen_token=1) + "\n2024;c;half", encoding="utf-8")
    (tmp_path / "odd.csv").write_text("p;q\n1;2\n", encoding="utf-8")
    (tmp_path / "bytes.csv").write_bytes((";".join(new) + "\n").encode() + b"\xff\xfe" + b";" * (len(new) - 1) + b"\n")
    (tmp_path / "large.csv").write_text(";".join(new) + "\n" + line(new, kullanici="d" * 5000) + "\n", encoding="utf-8")
    (tmp_path / "notes.txt").write_text("no log")
    return str(tmp_path)


def rows_of(spark, path, **kw):
    rows, problems = logs.read(spark, path, logs.usage_layouts(), **kw)
    name = lambda f: os.path.basename(f)
    return sorted((name(r.file), r.layout, r.kullanici, r.toplam_token) for r in rows.collect()), sorted((name(r.file), r.problem, r.lines) for r in problems.collect()), rows


def test_layouts_and_problems(spark, tmp_path):
    got, problems, rows = rows_of(spark, folder(tmp_path), most=3000)
    assert got == [("one.csv", 0, "a", "10"), ("one.csv", 0, "a", "?"), ("torn.csv", 1, "c", "1"), ("two.csv", 1, "b", "3"), ("two.csv", 1, "b", "5")]
    assert problems == [("bytes.csv", "not_text", 1), ("large.csv", "too_large", 2), ("odd.csv", "unknown_layout", 2), ("torn.csv", "torn", 1)]
    assert [r.soru for r in rows.where("zaman = '2024-01-02'").collect()] == ['x;y "z"']
    users = {r.user: tuple(r)[1:] for r in logs.summary(rows).collect()}
    assert users["a"] == (2, 10, 5, "2024-01-03") and users["b"] == (2, 8, 4, "2024-01-05")


def test_append_and_upgrade(spark, tmp_path):
    path = folder(tmp_path)
    layouts = logs.usage_layouts()
    before = logs.summary(logs.read(spark, path, layouts)[0])
    want = sorted(map(tuple, before.collect()))
    (tmp_path / "two.csv.yedek").write_text("an earlier copy")
    assert logs.upgrade(spark, path, layouts) == 1, "the torn file waits for somebody to mend it"
    got, problems, rows = rows_of(spark, path)
    assert sorted(map(tuple, logs.summary(rows).collect())) == want and not (tmp_path / "two.csv").exists()
    assert (tmp_path / "two.csv.yedek").read_text() == "an earlier copy" and len(list(tmp_path.glob("two.csv.*.yedek"))) == 1
    assert [g[1] for g in got if g[2] == "b"] == [0, 0] and not list(tmp_path.glob("_upgraded*"))
    assert logs.upgrade(spark, path, layouts) == 0
    logs.append(spark.createDataFrame([("2025", "e", None, 'a;"b"', *[None] * 3, "4", None, None, None)], ", ".join(f"{c} string" for c in logs.COLUMNS)), path, layouts[0])
    again = logs.read(spark, path, layouts)[0].where("kullanici = 'e'").collect()
    assert [(r.soru, r.toplam_token) for r in again] == [('a;"b"', "4")]


def test_the_older_layout_round_trips(spark, tmp_path):
    layouts = logs.usage_layouts()
    row = dict.fromkeys(logs.OLD_COLUMNS, "v") | {"uretilen_token": "9", "toplam_token": "20"}
    logs.append(spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} string" for c in row)), str(tmp_path / "log"), layouts[1])
    (r,) = logs.read(spark, str(tmp_path / "log"), layouts)[0].collect()
    assert (r.layout, r.toplam_token, r.model) == (1, "9", "v")


def test_appended_files_stay_within_what_is_read(spark, tmp_path):
    path, layouts, most = str(tmp_path / "logs"), logs.usage_layouts(), 3000
    e = spark.range(0, 400, 1, 1).selectExpr("concat('u', id % 3) as kullanici", "string(id) as toplam_token", "concat('\"', id, '\"') as soru")
    rows = e.select(*[c if c in e.columns else spark_lit(c) for c in logs.COLUMNS])
    logs.append(rows, path, layouts[0], most)
    got, problems = logs.read(spark, path, layouts, most)
    assert problems.count() == 0 and sorted(int(r.toplam_token) for r in got.collect()) == list(range(400))


def spark_lit(name):
    from pyspark.sql import functions as F

    return F.lit("").alias(name)
