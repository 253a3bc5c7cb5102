"""The parser on documents composed of header, option and answer styles, on each rule once met and once missed, and the
quality checks on every combination of what they look at."""

from __future__ import annotations

import re
from itertools import product

import pytest

from quizmill.operators import bank as B
from quizmill.operators import segment as S
from quizmill.schemas import OPTION

STEM, CHOICES = "河水流向哪里", ["入海", "上山", "进沙漠"]

# styles of a question's header, of its options and of its answer; the number and texts are filled in
HEADS = ["{n}. ", "{n}、", "{n}) ", "{n}）", "第{n}题 ", "第{n}题：", "【{n}】", "[{n}] ", "【第{n}题】", "**{n}.** ", "### {n}. ", "- {n}. "]
LAYOUTS = {
    "dots": "\nA. {0}\nB. {1}\nC. {2}", "commas": "\nA、{0}\nB、{1}\nC、{2}", "colons": "\nA：{0}\nB：{1}\nC：{2}", "round": "\n(A) {0}\n(B) {1}\n(C) {2}",
    "wide round": "\n（A）{0}\n（B）{1}\n（C）{2}", "square": "\n[A] {0}\n[B] {1}\n[C] {2}", "bold": "\n**A.** {0}\n**B.** {1}\n**C.** {2}",
    "one line": "\nA. {0} B. {1} C. {2}", "behind the stem": " A. {0} B. {1} C. {2}",
}
REPLIES = {"": None, "\n答案：C": "C", "\n【答案】B": "B", "\n正确答案：A": "A", "\n【正确答案】C": "C", "\n**【答案】B**": "B", "\n我的答案：B\n答案：A": "A"}
COMPOSED = {head.format(n=k % 40 + 1) + STEM + layout.format(*CHOICES) + reply: answer for k, (head, layout, (reply, answer)) in enumerate(product(HEADS, LAYOUTS.values(), REPLIES.items()))}


def rows_by_text(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {t: [] for t in texts}
    for r in S.parse_documents(docs).orderBy("doc_id", "no").collect():
        out[texts[r.doc_id]].append(r)
    return out


def test_every_combination_of_styles(spark):
    got = rows_by_text(spark, list(COMPOSED))
    wrong = {}
    for text, answer in COMPOSED.items():
        rows = [(r.raw_stem, [(o.key, o.text) for o in r.raw_options], r.raw_answer, r.start_line) for r in got[text]]
        if rows != [(STEM, list(zip("ABC", CHOICES, strict=True)), answer, 1)]:
            wrong[text] = rows
    assert len(COMPOSED) == 756 and wrong == {}


def q(n, stem="", letters="AB", answer=""):
    """A plain question: stem, options named after it, answer line."""
    stem = stem or f"问{n}"
    return "\n".join([f"{n}. {stem}", *[f"{x}. {stem}之{x}" for x in letters], *[f"答案：{answer}"] * bool(answer)])


def shown(rows):
    return [(r.raw_stem, "".join(o.key for o in r.raw_options), r.raw_answer, r.raw_type, r.chapter_name) for r in rows]


def plain(stem, letters="AB", answer=None, kind=None, chapter=None):
    return (stem, letters, answer, kind, chapter)


#: The rule, a document, and what comes out of it.
RULES = [
    ("P1 line ends and empty documents", "", []),
    ("P2 a chapter has at most 30 characters and no full stop", "第2章 江河\n" + q(1), [plain("问1", chapter="江河")]),
    ("P2 a longer line is no chapter", "第2章 " + "长" * 40 + "\n" + q(1), [plain("问1")]),
    ("P2 nor is a sentence", "第2章 讲江河。\n" + q(1), [plain("问1")]),
    ("P2 a chapter closes the question before it", q(1) + "\n第二章 湖泊\n此行无主\n" + q(2), [plain("问1"), plain("问2", chapter="湖泊")]),
    ("P2 separators belong to no question", q(1) + "\n======\n" + q(2), [plain("问1"), plain("问2")]),
    ("P2 a bare number is no header", "12\n" + q(1), [plain("问1")]),
    ("P3 a Chinese number begins a question if an option follows", "二、湖水\nA. 淡\nB. 咸", [plain("湖水")]),
    ("P3 or if one follows behind a blank line", "二、湖水\n\nA. 淡\nB. 咸", [plain("湖水")]),
    ("P3 else it is a heading, which holds nothing", "二、湖水\n若干说明\n" + q(1), [plain("问1")]),
    ("P3 a stem word makes it a question", "三、简述湖泊的成因\n写在此处", [plain("简述湖泊的成因", "")]),
    ("P4 two rising numbers make an answer zone", q(1) + "\n" + q(2) + "\n1.【答案】B\n2.【答案】A", [plain("问1", answer="B"), plain("问2", answer="A")]),
    ("P4 up to two blank lines or rules between", q(1) + "\n" + q(2) + "\n1.【答案】B\n\n----\n2.【答案】A", [plain("问1", answer="B"), plain("问2", answer="A")]),
    ("P4, P10 numbers that no question has are passed over", q(1) + "\n1.【答案】A\n8.【答案】B", [plain("问1", answer="A")]),
    ("P5 one answer line alone counts too", q(1) + "\n" + q(2) + "\n2.【答案】A", [plain("问1"), plain("问2", answer="A")]),
    ("P10 a question's own answer wins", q(1, answer="A") + "\n" + q(2) + "\n1.【答案】B\n2.【答案】B", [plain("问1", answer="A"), plain("问2", answer="B")]),
    ("P6 the section's type is taken where the question has none", "一、判断题\n1. 雨落向下\n二、单选题\n" + q(2), [plain("雨落向下", "", kind="判断题"), plain("问2", kind="单选题")]),
    ("P6 a chapter ends the section", "一、判断题\n1. 雨落向下\n第3章 海\n" + q(2), [plain("雨落向下", "", kind="判断题"), plain("问2", chapter="海")]),
    ("P7 what stands before the first header is dropped", "序言\n另一行\n" + q(5), [plain("问5")]),
    ("P8 a labelled stem", "【第1题】\n题型：单选题\n题干：潮汐因何\n选项：\nA. 月\nB. 风\n答案：A", [plain("潮汐因何", answer="A", kind="单选题")]),
    ("P8 my own answer is no answer", q(1) + "\n我的答案：B", [plain("问1")]),
    ("P9 marks in a line begin with A and go on without a gap", "1. 对照 A. 江 C. 河", [plain("对照 A. 江 C. 河", "")]),
    ("P9 marks in a line need a text", "1. 甲选A. 乙选B.", [plain("甲选A. 乙选B.", "")]),
    ("P9 one mark is no list", "1. 单说 A. 江", [plain("单说 A. 江", "")]),
    ("P9 an answer behind the last option is taken off", "1. 对照 A. 江 B. 河 答案：B", [plain("对照", answer="B")]),
    ("P9 a line of code is left whole", "1. 看代码\nlong n = 3; // A. 江 B. 河", [plain("看代码", "")]),
]


@pytest.fixture(scope="module")
def ruled(spark):
    return rows_by_text(spark, list(dict.fromkeys(text for _, text, _ in RULES)))


@pytest.mark.parametrize("rule,text,expected", RULES, ids=[r for r, _, _ in RULES])
def test_rules(ruled, rule, text, expected):
    assert shown(ruled[text]) == expected


def test_what_is_left_over_is_noted(ruled):
    rows = {rule: ruled[text] for rule, text, _ in RULES}
    assert "不一致" in rows["P10 a question's own answer wins"][0].suspicious[0] and not rows["P10 a question's own answer wins"][1].suspicious
    assert [r.start_line for r in rows["P4 two rising numbers make an answer zone"]] == [1, 4]



STEMS = ["水往低处流", "  ", None]
KEYS = ["", "A", "AB", "ABD", "BB"]
ANSWERS = ["", " ", "A", "b", "B,D", "D；东流", "E 其余", "对", None]
KINDS = ["单选题", "多选题", "简答题", None]
ODD = [[], ["残行"]]


def issues(stem, keys, answer, kind, odd):
    out = {"有可疑行"} if odd else set()
    if not (stem or "").strip():
        return out | {"无题干"}
    answer = (answer or "").strip()
    if not answer:
        out.add("缺答案")
    elif keys:
        out |= {"选项重复"} if len(set(keys)) < len(keys) else set()
        said = re.findall("[A-Z]", re.match("[A-Za-z,，、/;；]*", answer)[0].upper())
        out |= {"答案越界"} if set(said) - set(keys) else set()
    if kind in ("单选题", "多选题") and len(keys) < 2:
        out.add("选项不足")
    return out


def test_quality_checks(spark):
    cases = list(product(STEMS, KEYS, ANSWERS, KINDS, ODD))
    kind = f"bank_id long, pos int, raw_type string, raw_stem string, raw_options array<{OPTION}>, raw_answer string, suspicious array<string>, start_line int"
    raw = spark.createDataFrame([(i % 4, i, t, s, [(x, f"选{x}") for x in keys], a, odd, 1000 + i) for i, (s, keys, a, t, odd) in enumerate(cases)], kind)
    got = {}
    for r in B.quality_issues(raw).collect():
        got.setdefault(r.seq, []).append(r.kind)
        assert r.kind != "有可疑行" or f"第 {1000 + r.seq} 行" in r.detail and "残行" in r.detail
    assert {i: set(k) for i, k in got.items()} == {i: x for i, c in enumerate(cases) if (x := issues(*c))} and all(len(k) == len(set(k)) for k in got.values())
    assert B.quality_issues(raw.where("1 = 0")).count() == 0
