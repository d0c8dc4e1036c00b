"""CSV source and sinks."""
import pytest

from ledgerlens.operators.clean import clean_gl
from ledgerlens.sources.csv_gl import MissingColumnsError, read_gl_csv


def test_csv_na_words_and_strings(spark, tmp_path):
    p = tmp_path / "gl.csv"
    p.write_text("date,amount,account_code,account_name,vendor,description,journal_ref\n"
                 "2024-01-02,100.5,4000,Sales,NA,\"Rent, office\",J1\n"
                 "2024-01-03,N/A,,Sales,Acme,nan,J2\n"
                 "not a date,NaN,5100,Rent,None,\"He said \"\"hi\"\"\",J3\n")
    rows = {r["journal_ref"]: r for r in clean_gl(read_gl_csv(spark, str(p))).collect()}
    assert rows["J1"]["vendor"] is None and rows["J1"]["description"] == "Rent, office"
    assert rows["J1"]["account_code"] == "4000" and rows["J1"]["amount"] == 100.5
    assert rows["J2"]["amount"] is None and rows["J2"]["account_code"] is None
    assert rows["J2"]["description"] is None            # "nan" is a missing word
    assert rows["J3"]["date"] is None and rows["J3"]["amount"] is None
    assert rows["J3"]["description"] == 'He said "hi"'


def test_missing_required_column(spark, tmp_path):
    p = tmp_path / "bad.csv"
    p.write_text("date,amount,account_name\n2024-01-02,1,A\n")
    with pytest.raises(MissingColumnsError) as e:
        read_gl_csv(spark, str(p))
    assert e.value.missing == ["account_code", "vendor", "description", "journal_ref"]
