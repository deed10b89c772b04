"""Files of several seasons with headers of their own, and small files in Spark's store."""

from __future__ import annotations

import itertools

import pytest

from pitchline.sources import files, readers

OLD = "Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR,HS\n12/08/2017,Man Utd,Leeds,4,3,H,9\n13/08/2017,Spurs,Hull,0,0,D,5\n"
NEW = "Div,Date,Time,HomeTeam,AwayTeam,FTHG,FTAG,FTR,Referee,HS,,\nE0,17/08/2019,15:00,Leeds,Spurs,1,2,A,A Name,7,,\n"
WANT = [("2017-08-12", "Man United", "Leeds", 4, 3, "H", 9, None, 2017), ("2017-08-13", "Tottenham", "Hull", 0, 0, "D", 5, None, 2017), ("2019-08-17", "Leeds", "Tottenham", 1, 2, "A", 7, "A Name", 2019)]


def rows(df):
    return sorted((str(r["Date"]), r["HomeTeam"], r["AwayTeam"], r["FTHG"], r["FTAG"], r["FTR"], r["HS"], r["Referee"], r["SeasonStartYear"]) for r in df.collect())


def test_seasons_stand_under_their_own_headers(spark, tmp_path):
    (tmp_path / "results_2017.csv").write_text(OLD)
    (tmp_path / "results_2019.csv").write_text(NEW, encoding="utf-8-sig")
    (tmp_path / "results_2018.csv").write_text("")
    both = [str(tmp_path / f"results_{y}.csv") for y in (2017, 2019)]
    for order in itertools.permutations(both):
        assert rows(readers.results(spark, list(order))) == WANT
    assert rows(readers.results(spark, str(tmp_path / "results_*.csv"))) == WANT


def test_fixtures_with_an_inserted_column(spark, tmp_path):
    (tmp_path / "fixtures_2018.csv").write_text("Round Number,Date,Location,Home Team,Away Team,Result\n1,11/08/2018 15:00,Ground,Man Utd,Hull,1 - 0\n")
    (tmp_path / "fixtures_2019.csv").write_text("Match Number,Round Number,Date,Home Team,Away Team\n7,2,17/08/2019 12:30,Spurs,Leeds\n")
    got = sorted((r["Round Number"], str(r["Date"]), r["Home Team"], r["Away Team"], r["Location"], r["Match Number"], r["Season"]) for r in readers.fixtures(spark, str(tmp_path / "fixtures_*.csv")).collect())
    assert got == [(1, "2018-08-11 15:00:00", "Man United", "Hull", "Ground", None, "2018-19"), (2, "2019-08-17 12:30:00", "Tottenham", "Leeds", None, "7", "2019-20")]


def test_since_reads_no_earlier_file(spark, tmp_path, monkeypatch):
    for y in (2016, 2017, 2019):
        (tmp_path / f"results_{y}.csv").write_text(NEW if y == 2019 else OLD)
    (tmp_path / "results_all.csv").write_text(OLD)
    opened = []
    real = files.lines
    monkeypatch.setattr(files, "lines", lambda s, p: opened.append(p) or real(s, p))
    df = readers.results(spark, str(tmp_path / "results_*.csv"), since=2017)
    names = lambda paths: sorted(p.rsplit("/", 1)[-1] for p in paths)
    assert names(df.inputFiles()) == names(opened) == ["results_2017.csv", "results_2019.csv"]
    assert rows(df) == WANT
    with pytest.raises(readers.DataSourceError):
        readers.results(spark, str(tmp_path / "results_*.csv"), since=2030)
    with pytest.raises(readers.DataSourceError):
        readers.results(spark, str(tmp_path / "nothing_*.csv"))
    with pytest.raises(ValueError, match="FTR"):
        (tmp_path / "short_2020.csv").write_text("Date,HomeTeam,AwayTeam,FTHG,FTAG\n")
        readers.results(spark, str(tmp_path / "short_2020.csv"))


def test_names_of_a_header(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('\n"a, b", Date ,,date,c\n1,2,3,4,5\n')
    assert readers.header(spark, str(path)) == ("a, b", "Date", "_c2", "_c3", "c")
    assert [tuple(r)[:5] for r in readers.read_csv(spark, str(path)).collect()] == [("1", "2", "3", "4", "5")]


def test_small_files_by_uri(spark, tmp_path):
    root = tmp_path.as_uri()
    assert not files.exists(spark, f"{root}/d/x") and files.found(spark, f"{root}/d/*") == []
    files.write_text(spark, f"{root}/d/x", "één\nzwei")
    files.write_text(spark, f"{root}/d/x", "één\ntwee")
    assert list(files.lines(spark, str(tmp_path / "d/x"))) == ["één", "twee"]
    assert files.create(spark, f"{root}/d/y", "first") and not files.create(spark, f"{root}/d/y", "second")
    assert list(files.lines(spark, f"{root}/d/y")) == ["first"]
    assert [p.rsplit("/", 1)[-1] for p in files.found(spark, f"{root}/d/*")] == ["x", "y"]
