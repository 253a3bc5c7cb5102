from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quizmill.functions import text as T
from quizmill.schemas import OPTION


def values(spark, rows, schema, column):
    df = spark.createDataFrame(rows, schema).repartition(1)
    return [r[0] for r in df.select(column.alias("v")).collect()]


ONE = {
    "normalize_letter": [("ａ", "A"), ("Ｚ", "Z"), ("c", "C")],
    "strip_bold": [("**a**", "a"), ("* a *", "* a *"), ("**a", "a"), ("a_b", "a_b"), (" ** x ** ", "x")],
    "letters": [("CA", "AC"), ("a、c", "AC"), ("Ａ和Ｂ", "AB"), ("答案 BD 对", "BD"), ("AA", "A"), ("无", ""), (None, "")],
    "tf_key": [("对", "A"), ("×", "B"), ("true", "A"), ("b", "B"), ("?", None), (None, None)],
    "exam_level_of": [(0, "red"), (7, "red"), (8, "orange"), (14, "orange"), (15, "green"), (-1, "red")],
    "classify_failure": [("429 insufficient balance", T.FAILURES[0][1]), ("401", T.FAILURES[1][1]), ("Too Many Requests", T.FAILURES[2][1]), ("timeout", None), (None, None)],
    "strip_to_json": [('```json\n{"a":1}\n```', '{"a":1}'), ('text {"a":1}', '{"a":1}'), ("[1]", "[1]"), ("none", "none")],
    "repair_backslashes": [(r"\frac", r"\\frac"), (r"\n", r"\n"), (r"\alpha", r"\\alpha"), (r"中", r"中"), (r"\\", r"\\"), (r"\beta", r"\\beta"), (r"\b", r"\b")],
    "normalize_type": [("单选题", "SINGLE"), ("essay", "ESSAY"), ("?", None), (None, None)],
    "type_label": [("SINGLE", "单选题"), ("LEGACY", "LEGACY"), (None, "未知题型")],
}


@pytest.mark.parametrize("name", ONE)
def test_one_argument(spark, name):
    kind = "int" if name == "exam_level_of" else "string"
    f = T.exam_level if name == "exam_level_of" else getattr(T, name)
    assert values(spark, [(a,) for a, _ in ONE[name]], f"a {kind}", f(F.col("a"))) == [b for _, b in ONE[name]]


def test_repair_is_idempotent(spark):
    raw = [(x,) for x in (r"\frac{1}{2}", r"a\\b \( \" \u12", r"\t\times")]
    once = T.repair_backslashes(F.col("a"))
    assert values(spark, raw, "a string", once) == values(spark, raw, "a string", T.repair_backslashes(once))


def test_judge(spark):
    cases = [
        ("SINGLE", "A", " a ", True), ("SINGLE", "A", "B", False), ("SINGLE", "", "Z", False), ("MULTIPLE", "A,C", "ca", True), ("MULTIPLE", "AC", "AAC", False),
        ("FILL_BLANK", "x；y", "X ; y", True), ("FILL_BLANK", "x；", "x", True), ("FILL_BLANK", "x；y", "x", False), ("ESSAY", "a", "a", None), ("LEGACY", "q", "Q", True), (None, "a", "a", None), ("TRUE_FALSE", None, "", True),
    ]
    assert values(spark, [c[:3] for c in cases], "k string, s string, m string", T.judge(F.col("k"), F.col("s"), F.col("m"))) == [c[3] for c in cases]


def test_accuracy_rounds_half_up(spark):
    cases = [(8, 1, 13), (0, 0, 0), (3, 1, 33), (3, 2, 67), (200, 1, 1)]
    assert values(spark, [c[:2] for c in cases], "a int, c int", T.accuracy(F.col("a"), F.col("c"))) == [c[2] for c in cases]


def test_types_and_answers(spark):
    ab, tf = [("A", "x"), ("B", "y")], [("A", "对"), ("B", "错")]
    cases = [
        ("单选题", [], None, "SINGLE", None), (None, tf, "A", "TRUE_FALSE", "A"), (None, tf, "错误", "TRUE_FALSE", "B"), (None, ab, "BA", "MULTIPLE", "AB"), (None, ab, "b", "SINGLE", "B"),
        (None, [], "short", "FILL_BLANK", "short"), (None, [], "x" * 21, "ESSAY", "x" * 21), (None, [], " ", None, None), ("单选题", ab, "CA", "SINGLE", "A"),
    ]
    t = T.classify_type(F.col("t"), F.col("o"), F.col("a"))
    schema = f"t string, o array<{OPTION}>, a string"
    assert values(spark, [c[:3] for c in cases], schema, t) == [c[3] for c in cases]
    assert values(spark, [c[:3] for c in cases], schema, T.normalize_answer(t, F.col("a"), F.col("o"))) == [c[4] for c in cases]


def test_model_answers(spark):
    cases = [("SINGLE", "a", "A"), ("SINGLE", "AB", None), ("MULTIPLE", "c,a,c", "A,C"), ("MULTIPLE", "AC", None), ("TRUE_FALSE", "正确", "A"), ("ESSAY", " x ", "x"), ("ESSAY", " ", None)]
    assert values(spark, [c[:2] for c in cases], "k string, a string", T.normalize_model_answer(F.col("k"), F.col("a"))) == [c[2] for c in cases]


def test_brief_and_mask(spark):
    assert values(spark, [("a \n b" + "x" * 80,)], "a string", T.brief(F.col("a"))) == [("a b" + "x" * 80)[:60] + "…"]
    assert values(spark, [("key sk-1\nfailed",), ("",)], "a string", T.mask_secret(F.col("a"), F.lit("sk-1"), F.lit("E"))) == ["key *** failed", "E"]
    assert values(spark, [("\n first \nsecond",), (None,)], "a string", T.brief_reason(F.col("a"), F.lit("E"))) == ["first", "E"]


def test_page_bounds():
    assert T.page_bounds("questions", 3, 10) == (20, 10)
    assert T.page_bounds("questions", None, None) == (0, 20)
    assert T.page_bounds("recent", 0, 99) == (0, 20)
