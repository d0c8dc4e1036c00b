"""The format of a text date column is elected by its rows."""
import datetime as dt

import pytest

from ledgerlens.operators.clean import clean_gl
from ledgerlens.operators.dates import CANDIDATES, choose_date_format, date_votes

DAYS = [dt.datetime(2024, 1, 5), dt.datetime(2024, 11, 30), dt.datetime(1999, 2, 13)]
TEXTS = {
    "iso": ["2024-01-05", "2024-11-30", "1999-02-13"],
    "month/day/yyyy": ["01/05/2024", "11/30/2024", "2/13/1999"], "day/month/yyyy": ["05/01/2024", "30/11/2024", "13/2/1999"],
    "month-day-yyyy": ["01-05-2024", "11-30-2024", "02-13-1999"], "day.month.yyyy": ["5.1.2024", "30.11.2024", "13.02.1999"],
    "yyyy/month/day": ["2024/01/05", "2024/11/30", "1999/2/13"], "yyyymmdd": ["20240105", "20241130", "19990213"],
    "day-name-yyyy": ["05-Jan-2024", "30-Nov-2024", "13-Feb-1999"], "name day, yyyy": ["Jan 5, 2024", "Nov 30, 2024", "Feb 13, 1999"],
}


def column(spark, texts):
    return spark.createDataFrame([(t, "1") for t in texts], "date string, amount string")


@pytest.mark.parametrize("name", TEXTS)
def test_formats(spark, name):
    df = column(spark, [*TEXTS[name], "no date", None])
    choice = choose_date_format(df)
    assert (choice.name, choice.values, choice.parsed, choice.ambiguous) == (name, 4, 3, False)
    assert choice.failed_share == 0.25
    assert [r.date for r in clean_gl(df).collect()] == [*DAYS, None, None]


def test_times_and_short_years(spark):
    got = clean_gl(column(spark, ["1/31/24 9:05", "12/1/24 23:59:58", " 1/2/24 "])).collect()
    assert [r.date for r in got] == [dt.datetime(2024, 1, 31, 9, 5), dt.datetime(2024, 12, 1, 23, 59, 58), dt.datetime(2024, 1, 2)]


def test_ambiguous_and_empty_columns(spark):
    choice = choose_date_format(column(spark, ["01/05/2024", "02/06/2024", "03/03/2024"]))
    assert choice.name == "month/day/yyyy" and choice.ambiguous
    one = choose_date_format(column(spark, ["01/05/2024", "02/06/2024", "13/03/2024"]))
    assert one.name == "day/month/yyyy" and not one.ambiguous
    none = choose_date_format(column(spark, [None, "x"]))
    assert none.name == "iso" and none.parsed == 0 and not none.ambiguous and none.failed_share == 1.0
    assert choose_date_format(column(spark, [])).failed_share == 0.0
    assert date_votes(column(spark, [])).count() == len(CANDIDATES)
    assert choose_date_format(spark.createDataFrame([(dt.date(2024, 1, 1),)], "date date")) is None


def test_majority_decides_whatever_the_order_of_rows(spark):
    texts = ["05/01/2024"] * 30 + ["01/25/2024"] * 5 + ["25/01/2024"] * 4 + ["2024-01-01"] * 9
    for some in (texts, texts[::-1]):
        assert choose_date_format(column(spark, some).repartition(5)).name == "month/day/yyyy"
