from __future__ import annotations

import pytest

from quizmill.operators import segment as S

LABELLED = """【第 1 章】绪论
【第 1 题】题型：单选题
题目：下列哪项正确？
选项：
A. 甲
B. 乙
我的答案：A
正确答案：B
【第 2 题】题型：判断题
题目：地球是圆的
答案：对"""
SECTIONS = "第一章 基础\n1．单选题\n（1）1+1=？ A. 1 B. 2 C. 3 答案：B\n（2）什么是栈 A．x B．y\n2. 简答题\n（3）简述队列\n"
ZONE = "1. 题目甲\nA. x\nB. y\n2. 题目乙\nA. x\nB. y\nB\n3. 题目丙\n\n1.【答案】A\n2.【答案】A\n\n3.【答案】丙丙"
CHINESE = "一、下列说法\nA. a\nB. b\n二、普通标题\n正文\n三、术语\n\nA) x\nB) y\n答案：A\n多余"
CODE = "1. 看代码 A. {x;} B. y\n2. 空项 A. B. y\n3. 一个 A. x"

# text, and (type, stem, options, answer, chapter, first line) of each question
CASES = {
    LABELLED: [("单选题", "下列哪项正确？", "A=甲 B=乙", "B", "绪论", 2), ("判断题", "地球是圆的", "", "对", "绪论", 9)],
    SECTIONS: [("单选题", "1+1=？", "A=1 B=2 C=3", "B", "基础", 3), ("单选题", "什么是栈", "A=x B=y", None, "基础", 4), ("简答题", "简述队列", "", None, "基础", 6)],
    ZONE: [(None, "题目甲", "A=x B=y", "A", None, 1), (None, "题目乙", "A=x B=y", "B", None, 4), (None, "题目丙", "", "丙丙", None, 8)],
    CHINESE: [(None, "下列说法", "A=a B=b", None, None, 1), (None, "术语", "A=x B=y", "A", None, 6)],
    CODE: [(None, "看代码 A. {x;} B. y", "", None, None, 1), (None, "空项 A. B. y", "", None, None, 2), (None, "一个 A. x", "", None, None, 3)],
    "① 什么是树\r\n答：节点": [(None, "什么是树", "", "节点", None, 1)],
    "2020 年\n1.5 倍": [(None, "5 倍", "", None, None, 2)],
    "plain text": [],
}


def test_an_address_is_no_question(spark):
    texts = ["48.167.189.142 Oring thed", "ok\n> 20.118.157.107 Betz +1", "10.0.0.1", "1.192.168.1.1 属于哪类地址", "1. 10.0.0.1 属于哪类地址", "1.5 倍", "12．甲"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    routed = {r.doc_id: (r.questions, r.usable) for r in S.route_documents(docs, S.parse_documents(docs)).collect()}
    assert [routed[i] for i in range(len(texts))] == [(0, False)] * 3 + [(1, True)] * 4


@pytest.fixture(scope="module")
def parsed(spark):
    docs = spark.createDataFrame([*enumerate(CASES), (99, None), (98, "")], "doc_id long, text string")
    out = {}
    for r in S.parse_documents(docs).orderBy("doc_id", "no").collect():
        out.setdefault(r.doc_id, []).append(r)
    routed = {r.doc_id: (r.questions, r.usable) for r in S.route_documents(docs, S.parse_documents(docs)).collect()}
    return out, routed


@pytest.mark.parametrize("i", range(len(CASES)))
def test_golden(parsed, i):
    got = [(r.raw_type, r.raw_stem, " ".join(f"{o.key}={o.text}" for o in r.raw_options), r.raw_answer, r.chapter_name, r.start_line) for r in parsed[0].get(i, [])]
    assert got == list(CASES.values())[i]


def test_conflict_note_and_suspicious(parsed):
    assert parsed[0][2][1].suspicious == ["答案区与题内答案不一致：题内=B，答案区=A（已保留题内答案）"]
    assert parsed[0][3][1].suspicious == ["多余"]


def test_routing(parsed):
    assert parsed[1][0] == (2, True) and parsed[1][7] == (0, False) and parsed[1][99] == (0, False)


def test_chunks(spark):
    text = "\n".join([f"{i}. " + "x" * 90 for i in range(50)] + ["y" * 1500] * 4)
    rows = S.chunk_documents(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).orderBy("doc_id", "chunk_no").collect()
    assert {r.doc_id for r in rows} == {1}
    assert "".join(r.text for r in rows) == text + "\n"
    assert [r.start_line for r in rows[1:]] == [r.end_line + 1 for r in rows[:-1]]
    assert all(len(r.text) < 4000 + 1501 for r in rows)
