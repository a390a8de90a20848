"""Value tables and invariants of the row-wise functions."""

import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from dqengine.functions import dates as dt
from dqengine.functions import names as nn
from dqengine.functions import numbers as nm
from dqengine.functions import text as tx


def apply(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


NAMES = {
    "Regiao - Sigla": "regiao_sigla",
    "Data da Coleta": "data_coleta",
    "Valor de Venda": "valor_venda",
    "Preço (R$)": "preço_r$",
    "a/b\\c.d,e:f": "a_b_cdef",
    "x de da y": "x_de_y",
    "--A  B--": "a_b",
    "Casa dos Pais das Ilhas": "casa_pais_ilhas",
}


def test_snake_case_both_forms(spark):
    assert apply(spark, list(NAMES), nn.snake_case) == list(NAMES.values())
    assert [nn.snake_case_name(n) for n in NAMES] == list(NAMES.values())


@pytest.mark.parametrize(
    "style, wanted",
    [
        ("kebab-case", "data-da-coleta"),
        ("camelCase", "dataDaColeta"),
        ("PascalCase", "DataDaColeta"),
        ("lower_underscore", "data_coleta"),
        ("keep_original", "Data da Coleta"),
    ],
)
def test_styles(spark, style, wanted):
    assert nn.style_name("Data da Coleta", style) == wanted
    assert apply(spark, ["Data da Coleta"], lambda c: nn.style_case(c, style)) == [wanted]


def test_numbers(spark):
    texts = ["1.234,56", "R$ 1.234,56", " 7 ", "1d", "abc", None, "-3,5", "1 234,56", "€5", "1e3", "", "--1"]
    got = apply(spark, texts, lambda c: nm.to_number(c, "comma", True, "."))
    assert got == [1234.56, 1234.56, 7.0, None, None, None, -3.5, None, 5.0, 1000.0, None, None]
    assert apply(spark, ["1 234,56"], lambda c: nm.to_number(c, "comma", False, " ")) == [1234.56]
    assert apply(spark, ["1,234.56"], lambda c: nm.to_number(c, "dot", False, ",")) == [1234.56]
    # without a thousands mark the point stays, so this is no number
    assert apply(spark, ["1.234,56"], lambda c: nm.to_number(c, "comma")) == [None]


def test_dates(spark):
    texts = ["01/02/2023", "31/02/2023", "2023-02-01", "1.2.2023", "2023/2/1 10:05", "2023-02-01T10:05:07", "13/13/2023", "x", None]
    day = datetime.datetime(2023, 2, 1)
    wanted = [day, None, day, day, day.replace(hour=10, minute=5), day.replace(hour=10, minute=5, second=7), None, None, None]
    assert apply(spark, texts, dt.parse_date) == wanted
    assert apply(spark, ["02/01/2023"], lambda c: dt.parse_date(c, "us_format")) == [day]
    assert apply(spark, ["2023-02-01", "01/02/2023"], lambda c: dt.parse_date(c, "iso_format")) == [day, None]


def test_cases(spark):
    texts = ["o'neil a1b", "JOÃO SILVA", "straße ßa", None]
    assert apply(spark, texts, tx.title_case) == ["O'Neil A1B", "João Silva", "Straße Ssa", None]
    assert apply(spark, ["hELLO World. x"], tx.sentence_case) == ["Hello world. x"]
    with pytest.raises(ValueError):
        tx.convert_case(F.lit("x"), "odd")


def test_encoding(spark):
    texts = ["SÃ£o Paulo", "São Paulo", "漢字", "Ã", "Â©", None]
    assert apply(spark, texts, tx.fix_encoding) == ["São Paulo", "São Paulo", "漢字", "Ã", "©", None]


def test_cleaning(spark):
    assert apply(spark, ["  a \t b\n"], tx.clean_minimal) == ["a b"]
    assert apply(spark, ["a★ b — c; (d)"], tx.clean_moderate) == ["a b c; (d)"]
    assert apply(spark, ["Ação, Nº 5!"], tx.clean_aggressive) == ["acao n 5"]
    assert apply(spark, ["a\u0007b\tc\nd"], tx.remove_control_chars) == ["ab\tc\nd"]


def test_clean_name(spark):
    assert apply(spark, ["Preço (R$)"], nn.clean_name) == ["PrecoR"]
    assert nn.clean_plain_name("Preço (R$)", True, True, True) == "PrecoR"


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(hs.text(hs.characters(codec="utf-8", exclude_characters="\x00"), max_size=20), min_size=1, max_size=20))
def test_cleaning_twice_is_cleaning_once(spark, values):
    for fn in (tx.trim_text, tx.clean_minimal, tx.clean_moderate, tx.clean_aggressive, tx.remove_control_chars):
        once = apply(spark, values, fn)
        assert apply(spark, once, fn) == once


def test_dates_with_fraction_zone_and_compact(spark):
    texts = ["2024-01-31T10:00:00.123", "2024-01-31T10:00:00Z", "2024-01-31 10:00:00.5 -03:00", "20240131", "31/01/2024 10:00+0530", "20241331", "31-01-2024"]
    wanted = [
        datetime.datetime(2024, 1, 31, 10, 0, 0, 123000),
        datetime.datetime(2024, 1, 31, 10),
        datetime.datetime(2024, 1, 31, 13, 0, 0, 500000),
        datetime.datetime(2024, 1, 31),
        datetime.datetime(2024, 1, 31, 4, 30),
        None,
        datetime.datetime(2024, 1, 31),
    ]
    assert apply(spark, texts, dt.parse_date) == wanted


def test_unicode_blanks_accents_and_marks(spark):
    assert apply(spark, ["\u00a0 a\u2003b\x0b", "\u3000"], tx.trim_text) == ["a\u2003b", ""]
    assert apply(spark, ["a\u2003\u00a0b\x1cc"], tx.normalize_whitespace) == ["a b c"]
    assert apply(spark, ["Škoda Łódź Őr Việt", "e\u0301te\u0301", "ßæ日"], tx.remove_accents) == ["Skoda Lodz Or Viet", "ete", "ßæ日"]
    assert apply(spark, ["a\x01 b", "o'neil\x01 x1ß"], tx.title_case) == ["A\x01 B", "O'Neil\x01 X1Ss"]


def test_dates_spelled_or_short(spark):
    day = datetime.datetime(2024, 1, 31)
    texts = ["31/01/24", "31-1-24", "31.01.24 00:00", "31 Jan 2024", "31 january 2024", "31-Jan-24", "31st of January, 2024", "Jan 31, 2024"]
    texts += ["January 31st, 2024", "JAN. 31 2024", "31Jan2024", "31/Jan/2024 00:00:00", "31 Jan 2024 01:30:00+01:30"]
    assert apply(spark, texts, dt.parse_date) == [day] * len(texts)
    others = {"31/01/69": datetime.datetime(1969, 1, 31), "01/02/68": datetime.datetime(2068, 2, 1), "4 Sept 99 05:06": datetime.datetime(1999, 9, 4, 5, 6)}
    others |= dict.fromkeys(["31 Feb 2024", "31 Xyz 2024", "32/01/24", "Jan 2024", "31 Jan 202", "marching 3 2024"])
    assert apply(spark, list(others), dt.parse_date) == list(others.values())
    assert apply(spark, ["31/01/24"], lambda c: dt.parse_date(c, "br_format")) == [None]
