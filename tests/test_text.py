import re
from pathlib import PurePosixPath

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import text

CASES = ["", " ", "a", " a b ", "\t x\x1c\n", " naïve Ünï_code x1 1x ", "_a A-b", "ß ſ İ", "a.b.c", "x" * 60, "one two " * 12, "\x85nel"]


def _values(spark, values, column):
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v string").select("n", column.alias("r")).orderBy("n").collect()
    return [r.r for r in rows]


def test_strip_and_split_agree_with_python(spark):
    assert _values(spark, CASES, text.strip("v")) == [v.strip() for v in CASES]
    assert _values(spark, CASES, text.split_words("v")) == [v.split() for v in CASES]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\x0b\x1c\x85  aZ_9é.", max_size=12), min_size=20, max_size=40))
def test_strip_agrees_on_any_text(spark, values):
    assert _values(spark, values, text.strip("v")) == [v.strip() for v in values]


def test_tokens(spark):
    expected = [re.findall(r"[a-zA-Z_]\w*", v.lower()) for v in CASES]
    assert _values(spark, CASES, text.tokens("v")) == expected
    assert _values(spark, [None], text.tokens("v")) == [[]]


@pytest.mark.parametrize("name", ["a.py", ".py", "a.", "..py", "a.b.c", "x", "A.PY", "dir.d/f", "d/.hidden", "d/x.tar.gz"])
def test_suffix_and_stem(spark, name):
    assert _values(spark, [name], text.suffix("v")) == [PurePosixPath(name).suffix if not name.endswith(".") else ""]
    if not name.endswith("."):
        assert _values(spark, [name], text.stem("v")) == [PurePosixPath(name).stem]


def test_titles(spark):
    got = _values(spark, ["short", "word " * 20, "x" * 60, None], text.auto_title("v"))
    assert got == ["short", "word " * 9 + "word...", "x" * 50 + "...", None]
    assert all(len(t) <= 53 for t in got if t)


def test_keys_and_guards(spark):
    import hashlib

    df = spark.createDataFrame([("q", None), ("q", ""), ("q", "p")], "q string, p string")
    got = [r.k for r in df.select(text.cache_key("q", "p").alias("k")).collect()]
    assert got == [hashlib.sha256(x.encode()).hexdigest()[:16] for x in ("default:q", "default:q", "p:q")]
    assert _values(spark, ["", "x", "x" * 2000, "x" * 2001, None], text.valid_query("v")) == [False, True, True, False, False]
    assert _values(spark, ["a" * 15, "a" * 16, "A-9" * 20, "a" * 65, "a" * 16 + "\n", None], text.valid_client("v")) == [False, True, True, False, False, False]
    hops = spark.createDataFrame([("1.1.1.1, 2.2.2.2", "z"), ("", "z"), (None, "z")], "f string, a string").select(text.first_hop("f", "a").alias("h")).collect()
    assert [r.h for r in hops] == ["1.1.1.1", "z", "z"]


def test_line_count(spark):
    assert _values(spark, ["", "a", "a\n", "a\nb\n\n"], text.line_count("v")) == [1, 1, 2, 4]
    assert F is not None
