"""Scalar rules on hand-made values."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, numbers, taxid, text


@pytest.fixture
def apply(spark):
    def run(rule, values):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        return [r.x for r in rows.select("i", rule(F.col("v")).alias("x")).orderBy("i").collect()]

    return run


def decimals(*values):
    return [None if v is None else Decimal(v) for v in values]


def test_sheet_numbers(apply):
    got = apply(numbers.sheet_cell, ["1.234,56", "1234,56", "1234.56", "1,234.56", "(1.234,56)", "1.234", "x", "", None])
    assert got == decimals("1234.56", "1234.56", "1234.56", "1234.56", "-1234.56", "1234.00", "0.00", "0.00", "0.00")


def test_number_dialects_disagree(apply):
    one = ["1.234"]
    assert apply(numbers.ledger_text, one) == decimals("1234.00") and apply(numbers.sheet_cell, one) == decimals("1234.00")
    for rule in (numbers.card_amount, numbers.statement_amount, numbers.ofx_amount):
        assert apply(rule, one) == decimals("1.23")


def test_other_numbers(apply):
    assert apply(numbers.ledger_text, ["1.234,56", " -5,00 ", "abc", ""]) == decimals("1234.56", "-5.00", "0.00", "0.00")
    assert apply(numbers.card_amount, ["R$ 1.234,56", "1,234.56", "12,5", "x"]) == decimals("1234.56", "1234.56", "12.50", None)
    assert apply(numbers.statement_amount, ["-1.234,56", "(12,00)", "1,234.56", "R$ 5", "x"]) == decimals("-1234.56", "-12.00", "1234.56", "5.00", None)
    assert apply(numbers.ofx_amount, ["1500.00", "-1.500,00", "12,5", "NaN", "inf"]) == decimals("1500.00", "-1500.00", "12.50", None, None)


def test_tax_ids(apply):
    valid = ["11222333000181", "11.222.333/0001-81", "11222333000182", "11111111111111", "123", None]
    assert apply(taxid.is_valid, valid) == [True, True, False, False, False, False]
    assert apply(taxid.masked, ["11222333000181", "123"]) == ["11.222.333/0001-81", "123"]
    assert apply(taxid.in_text, ["PGTO 11.222.333/0001-81 x", "PGTO"]) == ["11.222.333/0001-81", None]


def test_texts(apply):
    assert apply(text.normal_history, ["\t Boleto ENERGIA \n"]) == ["boleto energia"]
    assert apply(text.plain_name, ["  São  José\tLtda ", None]) == ["SAO JOSE LTDA", ""]
    assert apply(text.alnum_name, ["a.b & c"]) == ["A B C"]
    assert apply(text.invoice_number, ["COMPRA NF 116722", "NF 12", "REF REF NF 5555", "12345 - x", None]) == ["116722", None, "5555", "12345", None]
    assert apply(text.invoice_series, ["NF 1 SERIE a2", "x", None]) == ["A2", "", ""]
    assert apply(text.safe_cell, ["=1", " +1", "-1", "@x", "ok", None]) == ["'=1", "' +1", "'-1", "'@x", "ok", None]
    assert apply(text.kind_by_code, ["1.2", "4", "9", "x", "06"]) == ["ativo", "receita", "despesa", "despesa", "custo"]
    assert apply(text.bank_acronym, ["001", "abc"]) == ["BB", "ABC"]


def test_dates(apply):
    utc = datetime.datetime
    got = apply(dates.ofx_timestamp, ["20240131", "202401311530", "20240131153000.5", "20240131120000[-3:BRT]", "2024", "20241399", None])
    assert got == [utc(2024, 1, 31), utc(2024, 1, 31, 15, 30), utc(2024, 1, 31, 15, 30, 0, 500000), utc(2024, 1, 31, 15), None, None, None]
    assert apply(dates.card_date, ["31/01/2024", "2024-01-31", "31-01-2024", "31/01/24", "2024/01/31", "x"]) == [utc(2024, 1, 31)] * 5 + [None]
    assert apply(lambda c: dates.statement_date(c, 2024), ["31/01/2023 x", "31-01-23", "31/01", "31/02"]) == [
        datetime.date(2023, 1, 31), datetime.date(2023, 1, 31), datetime.date(2024, 1, 31), None,
    ]
