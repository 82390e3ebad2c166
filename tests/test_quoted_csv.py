from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from ledgerscope.schemas import RAW_COLUMNS
from ledgerscope.sources.quoted_csv import SplitStates, inside_after, read_quoted_csv
from ledgerscope.sources.scans import load_raw_transactions

VALUES = ["plain", "", 'with "quotes"', "a,b", "line one\nline two", "crlf\r\ninside", "\n\n", '"', '""\n,"', "ünï\ncode", "x" * 300,
          "many\n" * 40, " padded ", 'ends with "', "\nstarts"]


@pytest.fixture
def small_splits(spark):
    """Splits of a few hundred bytes, so that many begin inside quotes."""
    names = {"spark.sql.files.maxPartitionBytes": "157b", "spark.sql.files.openCostInBytes": "1b", "spark.sql.files.minPartitionNum": "4"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def table(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    return [(str(i), rng.choice(VALUES), rng.choice(VALUES), "end") for i in range(n)]


def written(path, rows: list[tuple], names=("k", "a", "b", "c"), ending: str = "\n") -> None:
    out = io.StringIO()
    csv.writer(out, lineterminator=ending).writerows([names, *rows])
    path.write_bytes(out.getvalue().encode())


def got(df) -> list[tuple]:
    return sorted(tuple(x or "" for x in r) for r in df.collect())


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_equals_the_rows_written_and_the_whole_file_read(spark, tmp_path, small_splits, ending):
    (tmp_path / "in").mkdir()
    written(tmp_path / "in" / "a.csv", table(1, 300), ending=ending)
    written(tmp_path / "in" / "b.csv", [(f"b{k}", *r) for k, *r in table(2, 40)], ending=ending)
    written(tmp_path / "in" / "only_header.csv", [], ending=ending)
    path = str(tmp_path / "in")
    df = read_quoted_csv(spark, path)
    assert df.columns == ["k", "a", "b", "c"] and df.rdd.getNumPartitions() > 100
    want = sorted([*table(1, 300), *[(f"b{k}", *r) for k, *r in table(2, 40)]])
    assert got(df) == want
    whole = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    assert whole.count() == len(want) == df.count()
    if ending == "\n":
        assert got(whole) == want


def test_one_value_over_many_splits_and_a_quote_never_closed(spark, tmp_path, small_splits):
    long = "\n".join(f"line {i} of a long note" for i in range(200))
    written(tmp_path / "long.csv", [("1", long, "x", "y"), ("2", "p", long, "z"), ("3", "", "", "")])
    assert got(read_quoted_csv(spark, str(tmp_path / "long.csv"))) == [("1", long, "x", "y"), ("2", "p", long, "z"), ("3", "", "", "")]
    (tmp_path / "open.csv").write_text('k,a\n1,b\n2,"never\n' + "closed\n" * 60)
    rows = got(read_quoted_csv(spark, str(tmp_path / "open.csv")))
    assert rows[0] == ("1", "b") and rows[1][0] == "2" and rows[1][1].count("closed") == 60


def test_quotes_inside_plain_values_open_nothing(spark, tmp_path, small_splits):
    lines = [f'{i},5" pipe,"a ""b"" c",7' for i in range(50)]
    (tmp_path / "plain.csv").write_text("k,a,b,c\n" + "\n".join(lines) + "\n")
    df = read_quoted_csv(spark, str(tmp_path / "plain.csv"))
    assert df.count() == 50 and "from_csv" not in df._jdf.queryExecution().toString()
    (tmp_path / "mixed.csv").write_text("k,a,b,c\n" + "\n".join(lines) + '\n99,5" pipe,"two\nlines",7\n')
    rows = got(read_quoted_csv(spark, str(tmp_path / "mixed.csv")))
    assert len(rows) == 51 and ("99", '5" pipe', "two\nlines", "7") in rows and rows[0][2] == 'a "b" c'


def test_states_of_lines():
    assert not inside_after(b'a,"b",c', False) and inside_after(b'a,"b', False) and inside_after(b'x ""', True)
    assert not inside_after(b'x",y', True) and inside_after(b'x","y', True) and not inside_after(b'a b"c', False)
    assert inside_after(b'"', False) and not inside_after(b'"', True) and inside_after(b'""', True) and not inside_after(b'""', False)
    assert inside_after(b"plain", True) and not inside_after(b"", False)


def test_scans_that_disagree_and_other_headers_raise(spark, tmp_path):
    states = SplitStates([{"file": 1, "start": 0, "end": 100, "from_outside": True, "from_inside": False, "begins": True, "spans": True}])
    assert states.at(1, 100) == (True, 0) and states.at(1, 0) == (False, 0) and states.at(2, 50) == (False, 50)
    with pytest.raises(RuntimeError):
        states.at(1, 60)
    (tmp_path / "two").mkdir()
    written(tmp_path / "two" / "a.csv", [("1", "x\ny", "", "")])
    written(tmp_path / "two" / "b.csv", [("1", "x\ny", "", "")], names=("k", "b", "a", "c"))
    with pytest.raises(Exception, match="header"):
        read_quoted_csv(spark, str(tmp_path / "two")).collect()


def test_raw_transactions_are_read_in_splits(spark, tmp_path, small_splits):
    rows = [(f"T{i}", f"C{i % 9}", "10/1/94", "F", 'Two\nlines, "quoted"' if i % 3 else "NA", "1000.5", "2/8/16", "143207", "25") for i in range(120)]
    written(tmp_path / "raw.csv", rows, names=RAW_COLUMNS)
    df = load_raw_transactions(spark, str(tmp_path / "raw.csv"))
    assert df.rdd.getNumPartitions() > 10 and df.count() == 120
    found = {r["CustLocation"]: r["count"] for r in df.groupBy("CustLocation").count().collect()}
    assert found == {'Two\nlines, "quoted"': 80, None: 40}
    assert df.agg(F.sum("TransactionAmount (INR)")).first()[0] == 3000.0
    assert load_raw_transactions(spark, str(tmp_path / "raw.csv"), nrows=7).count() == 7
