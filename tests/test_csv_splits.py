"""CSV files cut into many splits, against pandas; the report of an ingestion."""

import random

import pandas as pd
import pytest

from campaignflow.sources import csv_splits, files

SIZE = "spark.sql.files.maxPartitionBytes"
CELLS = ["a", "", "7", "one two", "x,y", "two\nlines", "three\n\nlines\n", 'say "so"', '"', '""', "\n", ',"', 'a\n"b",\n"c"', "tail\n\"", "long " * 30, "l\n" * 40, "é\n€"]


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get(SIZE)

    def use(n):
        spark.conf.set(SIZE, str(n))

    yield use
    spark.conf.set(SIZE, before)


def quoted(cell, rng):
    if any(x in cell for x in ',"\n') or rng.random() < 0.2:
        return '"' + cell.replace('"', '""') + '"'
    return cell


def as_text(rows, rng, end="\n"):
    return "".join(",".join(quoted(c, rng) for c in row) + end for row in rows)


def expected(path):
    frame = pd.read_csv(path, dtype=str, keep_default_na=False)
    return [tuple(r) for r in frame.itertuples(index=False)]


def read(spark, path, n):
    got = files.read_raw(spark, str(path)).orderBy("row_order").collect()
    assert len({r["row_order"] for r in got}) == len(got)
    return [tuple(x or "" for x in r[:n]) for r in got]


@pytest.mark.parametrize("size", [11, 300, 1 << 27])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_line_breaks_over_many_splits(spark, tmp_path, small_splits, size, end):
    rng = random.Random(size)
    rows = [("k", "first", "second")] + [(str(i), rng.choice(CELLS), rng.choice(CELLS)) for i in range(25 if size < 64 else 300)]
    (tmp_path / "a.csv").write_bytes(as_text(rows, rng, end).encode())
    want = expected(tmp_path / "a.csv")
    assert want == rows[1:]
    small_splits(size)
    assert read(spark, tmp_path / "a.csv", 3) == want


def test_one_large_file_uses_many_tasks(spark, tmp_path, small_splits):
    rng = random.Random(3)
    rows = [("k", "v")] + [(str(i), rng.choice(CELLS)) for i in range(20_000)]
    (tmp_path / "a.csv").write_text(as_text(rows, rng))
    small_splits(1 << 16)
    found = files.read_raw(spark, str(tmp_path / "a.csv"))
    assert csv_splits.lines(spark, [str(tmp_path / "a.csv")]).rdd.getNumPartitions() >= 8
    assert [(r["k"], r["v"] or "") for r in found.orderBy("row_order").collect()] == rows[1:]


def test_quotes_inside_unquoted_cells_are_text(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('k,v\n1,5" disc\n2,"a\nb"\n3,x"y"z\n\n4,"open\nto the end\n')
    for size in (4, 1000):
        small_splits(size)
        got = read(spark, tmp_path / "a.csv", 2)
        assert got[:3] == [("1", '5" disc'), ("2", "a\nb"), ("3", 'x"y"z')] and got[3][0] == "4" and len(got) == 4


@pytest.mark.parametrize("header", ['"two\nlines",b', "﻿a,b", "\n\na,b", "a,A", ",b", "row_order,source_file"])
def test_headers(spark, tmp_path, small_splits, header):
    for size in (8, 1000):
        small_splits(size)
        for body in ("1,2\n3,4\n", '1,"2\n2"\n3,4\n'):
            (tmp_path / "a.csv").write_text(header + "\n" + body, encoding="utf-8")
            if size == 8 and header[0] in '"\n':
                continue  # a header is looked for in the first split
            got = files.read_raw(spark, str(tmp_path / "a.csv"))
            names = [c for c in got.columns if c not in ("row_order", "source_file")]
            assert len(names) == (1 if header == ",b" else 2) and len({c.lower() for c in names}) == len(names)
            assert [r[names[-1]] for r in got.orderBy("row_order").collect()] == [body.split(",", 1)[1].rsplit("\n3", 1)[0].strip('"'), "4"]


def test_report_counts_what_is_wrong(spark, tmp_path):
    (tmp_path / "google_ads_a.csv").write_text(
        "campaign_id,campaign_name,date,spend,revenue,clicks,strange\n1,Brand,2024-01-01,5,1,,q\n,Brand,2024-01-03,x,2,,q\n2,thing,never,1,1,,q\n")
    (tmp_path / "undated.csv").write_text("campaign_id,date,spend,revenue\n1,soon,1,1\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "meta a+b c.csv").write_text("campaign_id,date,spend,revenue\n1,2024-02-01,1,1\n")
    data, report = files.ingest_directory(spark, str(tmp_path))
    rows = {r["source"]: r for r in report.collect()}
    one = rows["google_ads_a.csv"]
    assert (one["n_rows"], one["n_dropped"], one["n_campaigns"], one["n_blank_ids"], one["n_unclassified"]) == (2, 1, 2, 1, 0)
    assert (str(one["first_date"]), str(one["last_date"]), one["error"]) == ("2024-01-01", "2024-01-03", None)
    assert {p["field"]: (p["n_nonempty"], p["n_failed"]) for p in one["parsed"]} == {"spend": (3, 1), "revenue": (3, 0), "clicks": (0, 0)}
    assert sorted(w.split(":")[0] for w in one["warnings"]) == ["1 rows without a campaign id", "1 rows without a date dropped", "clicks", "spend"]
    assert one["ignored"] == ["strange"] and one["rejected"][0].startswith("strange ~ ")
    assert rows["undated.csv"]["error"] and rows["empty.csv"]["error"] and rows["meta a+b c.csv"]["n_rows"] == 1
    assert {r["campaign_id"].split("::")[0] for r in data.collect()} == {"google", rows["meta a+b c.csv"]["channel"]}
    assert report.count() == 4 and files.report_lines(report).where("value IS NULL").count() == 0
    assert files.run_lines(report).first().asDict() == {"n_files": 2, "n_refused": 2, "n_rows": 3, "n_dropped": 2}


def test_no_file_can_be_used(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.ingest_directory(spark, str(tmp_path))
    (tmp_path / "undated.csv").write_text("campaign_id,date,spend,revenue\n1,soon,1,1\n")
    with pytest.raises(ValueError):
        files.ingest_file(spark, str(tmp_path / "undated.csv"))
