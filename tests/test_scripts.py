"""Conversion by phrases against a plain scan of the table."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stackwright.functions import scripts

#: A sample of phrases whose characters convert otherwise alone.
TABLE = {"后": "後", "皇后": "皇后", "发": "發", "头发": "頭髮", "头": "頭", "理发": "理髮", "理发店": "理髮店", "干": "乾", "干部": "幹部", "里": "裡", "公里": "公里", "a]": "b["}


def scanned(text, table):
    out, at = "", 0
    while at < len(text):
        fits = [s for s in table if text.startswith(s, at)]
        best = max(fits, key=len, default=None)
        out += table[best] if best else text[at]
        at += len(best or "x")
    return out


@settings(max_examples=300, deadline=None)
@given(st.text("后皇发头理店干部里公a]x", max_size=20), st.dictionaries(st.text("后皇发头a", min_size=1, max_size=4), st.text("xy后", max_size=3), max_size=8))
def test_longest_phrases_win_as_in_a_plain_scan(text, table):
    assert scripts.Phrases(TABLE).convert(text) == scanned(text, TABLE)
    assert scripts.Phrases(table).convert(text) == scanned(text, table)


def test_columns_by_a_table_of_rows(spark):
    rows = [*TABLE.items(), ("后", "后后"), ("", "x"), (None, "y"), ("部", None)]
    convert = scripts.converter(spark.createDataFrame(rows, "source string, target string"))
    wanted = {"皇后的头发": "皇后的頭髮", "理发店后": "理髮店后后", "干部干": "幹部乾", "plain": "plain", "": "", None: None}
    texts = spark.createDataFrame([(t,) for t in wanted], "t string").select("t", convert(F.col("t")).alias("c"))
    # Of two targets of one source the least counts: U+540E before U+5F8C.
    assert {r.t: r.c for r in texts.collect()} == wanted
    nothing = scripts.converter(spark.createDataFrame([], "source string, target string"))
    assert texts.select(nothing(F.col("t")).alias("c")).first().c == "皇后的头发"


def test_tables_that_are_too_large_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(scripts, "MOST_ENTRIES", 2)
    with pytest.raises(ValueError, match="too large"):
        scripts.converter(spark.createDataFrame(list(TABLE.items()), "source string, target string"))
