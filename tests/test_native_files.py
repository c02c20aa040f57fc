"""Files in the native layouts, times, sentinels and column names, by hand."""

import datetime as dt

import pytest
from leadtime.functions import clean, times
from leadtime.sources import files
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_fractions_of_hours_and_days(spark):
    parts = [F.lit(x) for x in (2013.0, 6.0, 7.0, 1.5, 0.25, 3.5)]
    assert one(spark, times.from_parts(*parts)) == dt.datetime(2013, 6, 7, 1, 30, 18, 500000)
    assert one(spark, times.from_parts(*[F.lit(x) for x in (2013.0, 2.0, 30.0, 0.0, 0.0, 0.0)])) is None
    assert one(spark, times.from_parts(*[F.lit(x) for x in (2013.0, 6.0, 7.0, 24.0, 0.0, 0.0)])) is None
    assert one(spark, times.from_day_of_year(F.lit(2013.0), F.lit(2.5), F.lit(1000.0))) == dt.datetime(2013, 1, 2, 12, 0, 1)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_don_t_depend_on_the_session(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for text in ("2013-06-07T12:00:00Z", "2013-06-07T12:00:00.000Z", "2013-06-07 12:00:00", "2013-06-07T14:00:00+02:00"):
            assert one(spark, times.from_iso(F.lit(text))) == dt.datetime(2013, 6, 7, 12), text
            assert one(spark, times.micros(times.from_iso(F.lit(text)))) == 1370606400000000
        assert one(spark, times.from_iso(F.lit("2013-06-07"))) == dt.datetime(2013, 6, 7)
        assert one(spark, times.from_iso(F.lit("bad"))) is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_sentinels_of_nines(spark):
    cells = {"9.99": True, '"999.9"': True, ' "99.99" ': True, "9999": True, "999": False, "'999.9'": False, "19.2": False, "9.9": False}
    for cell, want in cells.items():
        assert one(spark, clean.repeated_nines(F.lit(cell))) is want, cell


def test_standard_names():
    aliases = {"Np": ["np", "density"], "Vp": ["vp"]}
    assert clean.standard_names(["input", "H Density [cc]", "Vp_flag", "vp moment"], aliases) == {"H Density [cc]": "Np", "vp moment": "Vp"}
    assert clean.standard_names(["Np", "density", "vp"], aliases) == {"vp": "Vp"}


def test_samples_of_text_files(spark, tmp_path):
    body = "2013 6 7 0 0 0.0 -3.2\n2013 6 7 0 0 0.5 3.2 extra\n2013 6 7 0 0 1.0 9.990\n2013 6 7 0 0 1.5 120.0\n2013 6 7 0 0 2.0 120.1\n2013 6 7 0 0 2.5 abc\n2013 2 30 0 0 0 1\n2013 6 7 24 0 0 1\n# a comment\n2013 6 7\n"
    (tmp_path / "20130607.TXT").write_text(body)
    (tmp_path / "20130608.dat").write_text(body.splitlines()[0])
    (tmp_path / "notes.md").write_text(body)
    rows = files.read_samples(spark, str(tmp_path))
    got = sorted((r.line_no, r.value) for r in rows.where("source_file like '%0607%'").collect())
    assert got == [(1, -3.2), (2, 3.2), (3, None), (4, 120.0), (5, None), (6, None)]
    audit = {r.source_file.rsplit("/")[-1]: r for r in files.file_audit(rows, "value_missing_flag").collect()}
    assert set(audit) == {"20130607.TXT", "20130608.dat"}
    a, b = audit["20130607.TXT"], audit["20130608.dat"]
    assert (a.n_rows, a.n_missing, a.n_repeated, a.date_matches, b.date_matches) == (6, 3, 0, True, False)
    assert {r.name for r in files.discover(spark, str(tmp_path)).collect()} == set(audit)


def test_samples_of_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("gic_a,second,minute,hour,day,month,year\n5,0.5,1,2,7,6,2013\n")
    (tmp_path / "b.CSV").write_text("\n2013,6,7,2,1,1.5,6\n")
    assert sorted((r.value, r.time) for r in files.read_samples_csv(spark, str(tmp_path)).collect()) == [(5.0, dt.datetime(2013, 6, 7, 2, 1, 0, 500000)), (6.0, dt.datetime(2013, 6, 7, 2, 1, 1, 500000))]
    (tmp_path / "c.csv").write_text("year,month,day,hour,minute,second\n2013,6,7,2,1,1.5\n")
    with pytest.raises(Exception, match="missing columns"):
        files.read_samples_csv(spark, str(tmp_path)).collect()


def test_ascii_files_with_a_header(spark, tmp_path):
    (tmp_path / "m.txt").write_text("notes\n\nYear DOY Millisecs B Bx\n- - - nT nT\n2013 158 1000 5.1 x\n2013 158 2000 5.2\n2013 400 0 5 5\n2013 158 0 1 2 3 4\n")
    rows = files.read_header_ascii(spark, str(tmp_path), {"B": "Btot", "bx": "Bx"}).collect()
    assert [(r.line_no, r.time, r.Btot, r.Bx) for r in rows] == [(5, dt.datetime(2013, 6, 7, 0, 0, 1), "5.1", "x"), (6, dt.datetime(2013, 6, 7, 0, 0, 2), "5.2", None)]
    assert files.read_header_ascii(spark, str(tmp_path)).first().cells == {"B": "5.1", "Bx": "x"}
    with pytest.raises(Exception, match="missing columns"):
        files.read_header_ascii(spark, str(tmp_path), {"Bz": "Bz"}).collect()


def test_files_with_a_preamble(spark, tmp_path):
    (tmp_path / "p.txt").write_text("a\nb,c\n\nEpoch,N p,V\n2013-06-07T00:00:00Z,1,2\n2013-06-07T00:01:00.500Z,3,4\n# end,,\n")
    (tmp_path / "q.txt").write_text("a\nb\tc\nV\tTime (UTC)\n7\t2013-06-08T00:00:00.000Z\n")
    rows = files.read_preamble(spark, str(tmp_path), 2, ["V"])
    assert sorted((r.time, r.V) for r in rows.collect()) == [(dt.datetime(2013, 6, 7), "2"), (dt.datetime(2013, 6, 7, 0, 1, 0, 500000), "4"), (dt.datetime(2013, 6, 8), "7")]
    assert files.read_preamble(spark, str(tmp_path), 2, ["V"], keep_bad_times=True).where("time is null").count() == 1


def test_last_file_and_finished_tables(spark, tmp_path):
    rows = spark.createDataFrame([("f1", 1, 5, "a"), ("f2", 1, 5, "b"), ("f2", 2, 5, "c"), ("f1", 3, 6, "d")], "source_file string, line_no int, k int, v string")
    assert sorted((r.k, r.v, r.n_rows) for r in files.keep_last_file(rows, ["k"]).collect()) == [(5, "c", 3), (6, "d", 1)]
    path = f"{tmp_path}/t"
    assert files.write_if_incomplete(rows.where("k = 5"), path, ["k"]).count() == 3
    assert files.write_if_incomplete(rows, path, ["k"], 3).count() == 3 and files.write_if_incomplete(rows, path, ["k"], 4).count() == 4


def test_a_header_line_is_split_once(spark, tmp_path):
    """Lines with words in any case and order, blanks and tabs; line numbers; and no work on each line to find the header."""
    body = "year doy\nxyear doy millisecs\n\n  Np MILLISECS Doy\tyear B \nunits year doy millisecs\n1 1000 2 2013 3.5\n\n\t\n1 0 3 2013\n1 0 3 2013 1 9\nyear doy millisecs\n2 0 4 2013 x"
    (tmp_path / "a.txt").write_text(body)
    (tmp_path / "b.txt").write_text(body.replace("\n", "\r\n"))
    (tmp_path / "c.txt").write_text("year\ndoy millisecs\n1 2 3\n")
    (tmp_path / "d.txt").write_text("year doy millisecs B\n-\n2013 1 0 7")
    out = files.read_header_ascii(spark, str(tmp_path), {"b": "b"})
    got = sorted((r.source_file[-5:], r.line_no, r.time, r.b) for r in out.collect())
    day = dt.datetime(2013, 1, 1)
    rows = [(6, day + dt.timedelta(days=1, seconds=1), "3.5"), (9, day + dt.timedelta(days=2), None), (12, day + dt.timedelta(days=3), "x")]
    assert got == [(f, *r) for f in ("a.txt", "b.txt") for r in rows] + [("d.txt", 3, day, "7")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and not any("split(" in x for x in plan.split("Generate")[0].splitlines())
