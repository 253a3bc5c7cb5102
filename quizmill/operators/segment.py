"""Documents to questions: one row per line, windows over a document's lines, no Python in the rows' path.

``docs`` has (doc_id, text).  All windows partition by doc_id (or by doc_id and block), so the lines are exchanged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quizmill.functions import text as T
from quizmill.schemas import OPTION

# The patterns by which lines of question banks are told apart.
PREFIX = r"(?:>\s*)?(?:#{1,6}\s*)?(?:[-*+]\s+)?(?:\*\*\s*)?"
ADDRESS = r"\d{1,3}(?:\.\d{1,3}){3}(?![.\d])"  # four numbers, as of a host: no question's number
QUESTION_HEADER = rf"^\s*{PREFIX}(?:【\s*第\s*\d+\s*题\s*】|【\s*\d+\s*】|\[\s*\d+\s*\]|第\s*\d+\s*题|[（(]\s*\d+\s*[）)]|[①-⑳]\s*[、.．]?\s*\S|(?!{ADDRESS})\d+\s*[、.．)）]\s*\S)"
NUMBERED_STEM = rf"^\s*{PREFIX}(?:[（(]\s*\d+\s*[）)]|\d+\s*[、.．)）]|第\s*\d+\s*题|【\s*第\s*\d+\s*题\s*】|【\s*\d+\s*】|\[\s*\d+\s*\]|[①-⑳]|[一二三四五六七八九十百]+\s*[、.．])\s*[、.．:：]?\s*\*{{0,2}}\s*(.+?)\s*$"
SECTION = r"^\s*(?:\d+|[一二三四五六七八九十]+)\s*[、.．]?\s*(选择题|单项选择题|多项选择题|单选题|多选题|判断题|填空题|简答题|简述题|论述题|计算题|分析题|应用题|名词解释题?|综合题|材料题|编程题|程序设计题|阅读程序题?|操作题)(?:\s*[（(][^）)]*[）)])?\s*$"
CHINESE_HEADER = r"^\s*([一二三四五六七八九十百]{1,3})\s*[、.．]\s*(\S.*)$"
STEM_START = "^(?:下列|以下|关于|针对|简述|试述|叙述|说明|什么|如何|怎样|哪|请|计算|分析|论述|比较|举例|写出|画出|判断|选择|填空|简答|名词解释|为什么|有何)"
EXERCISE = r"^\s*习\s*题\s*[0-9一二三四五六七八九十]+\s*$"
CHAPTER = r"^\s*[【\[]\s*第\s*[0-9一二三四五六七八九十百零]+\s*章\s*[】\]]\s*(.*)$"
CHAPTER_BARE = r"^\s*第\s*[0-9一二三四五六七八九十百零]+\s*章\s*[:：、.．]?\s*(\S.*)$"
TYPE = r"(?:题型\s*[:：]\s*|【\s*题型\s*】\s*)(\S+)"
STEM = r"^\s*(?:题目|题干)\s*[:：]\s*(.+)$"
OPTION_LABEL = r"^\s*选项\s*[:：]?\s*(.*)$"
OPTION_LINE = rf"^\s*{PREFIX}(?:[（(【\[]\s*)?\s*([A-Za-zＡ-Ｚａ-ｚ])\s*[.、．:：)）\]】]\s*(.+)$"
MY_ANSWER = r"^\s*我的答案\s*[:：].*$"
ANSWER_LABEL = r"^\s*(?:【\s*(?:正确答案|参考答案|答案)\s*】|(?:正确答案|参考答案|答案|答)\s*[:：])\s*(.+)$"
ANSWER_INLINE = r"(?:(?:正确答案|参考答案)\s*[:：]|【\s*(?:正确答案|参考答案|答案)\s*】)\s*(.+)$"
TRAILING_ANSWER = r"(?<!我的)(?:正确答案|参考答案|答案)\s*[:：]\s*(.+)$"
SEPARATOR = r"^\s*[-=~_*]{3,}\s*$"
BARE_LETTERS = r"^[A-Za-zＡ-Ｚａ-ｚ]+(?:\s*[、,，;；/]\s*[A-Za-zＡ-Ｚａ-ｚ]+)*$"
ANSWER_LINE = rf"^\s*{PREFIX}(\d+)\s*[、.．)）]\s*(?:【\s*(?:正确答案|参考答案|答案)\s*】|(?:正确答案|参考答案|答案)\s*[:：])\s*(.+)$"
INLINE_MARK = r"(?:^|(?<=\s))(?:[A-Za-zＡ-Ｚａ-ｚ]\s*[.、．:：)）]|[（(【\[]\s*[A-Za-zＡ-Ｚａ-ｚ]\s*[)）\]】](?=\s|$))"
CODE_LIKE = r"[{};]|//|\bdef\s|\bprintf\s*\(|\bcout\b|System\.out|\bprint\s*\("
SECTION_TYPES = {"单选题": "单选题", "多选题": "多选题", "判断题": "判断题", "填空题": "填空题"} | dict.fromkeys(["简答题", "简述题", "论述题", "计算题", "分析题", "应用题", "名词解释", "名词解释题", "编程题", "程序设计题", "操作题"], "简答题")
READING = ("阅读程序", "阅读程序题")
CHAPTER_MAX, BARE_ANSWER_MAX, ZONE_MIN, ZONE_GAP, MAX_INLINE = 30, 20, 2, 2, 8
CHUNK_CHARS, CHUNK_LIMIT = 2000, 4000


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group, null where the pattern is not found."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def explode_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line); line numbers begin at 1."""
    lines = F.split(F.coalesce("text", F.lit("")), "\r\n|\r|\n")
    return docs.select("doc_id", F.posexplode(lines).alias("pos", "line")).select("doc_id", (F.col("pos") + 1).alias("line_no"), "line")


def classify_lines(lines: DataFrame) -> DataFrame:
    """What each line could be, before its neighbours are looked at."""
    line, t = F.col("line"), T.trim(F.col("line"))
    bare_ok = (F.length(t) <= CHAPTER_MAX) & ~t.rlike("[。？！?]")
    chapter = F.when(line.rlike(CHAPTER), T.trim(F.regexp_extract(line, CHAPTER, 1))).when(t.rlike(EXERCISE), F.regexp_replace(t, r"\s+", " ")).when(bare_ok & t.rlike(CHAPTER_BARE), T.trim(F.regexp_extract(t, CHAPTER_BARE, 1)))
    number = F.coalesce(F.expr("try_cast(_no as int)"), F.lit(-1))
    return (
        lines.withColumn("_no", _found(line, ANSWER_LINE))
        .withColumn("answer_no", F.when(F.col("_no").isNotNull(), number))
        .withColumn("answer_text", T.strip_bold(_found(line, ANSWER_LINE, 2)))
        .withColumn("skip", T.is_blank(line) | line.rlike(SEPARATOR))
        .withColumn("chapter", F.when(~T.is_blank(line), chapter))
        .withColumn("section", _found(t, SECTION))
        .withColumn("chinese", F.when(t.rlike(CHINESE_HEADER), T.trim(T.strip_bold(F.regexp_extract(t, CHINESE_HEADER, 2)))))
        .withColumn("numbered", line.rlike(QUESTION_HEADER))
        .withColumn("confirms", line.rlike(OPTION_LINE) | line.rlike(ANSWER_LABEL))
        .drop("_no")
    )


def confirm_chinese_header(lines: DataFrame) -> DataFrame:
    """``chinese_question``: the header starts like a stem, or an option or answer comes within two lines."""
    w = W.Window.partitionBy("doc_id").orderBy("line_no")
    s1, s2 = F.lead("skip", 1, True).over(w), F.lead("skip", 2, True).over(w)
    c1, c2 = F.lead("confirms", 1, False).over(w), F.lead("confirms", 2, False).over(w)
    near = F.when(~s1, c1).when(~s2, c2).otherwise(False)
    return lines.withColumn("chinese_question", F.col("chinese").isNotNull() & (F.col("chinese") != "") & (F.col("chinese").rlike(STEM_START) | near)).drop("confirms")


def detect_answer_zone(lines: DataFrame) -> DataFrame:
    """``in_zone``: from the first to the last line of the first run of answer lines with rising numbers."""
    w = W.Window.partitionBy("doc_id").orderBy("line_no")
    before = w.rowsBetween(W.Window.unboundedPreceding, -1)
    answer = F.col("answer_no").isNotNull()
    lines = lines.withColumn("_solid", F.sum((~answer & ~F.col("skip")).cast("int")).over(w))
    prev = F.last(F.when(answer, F.struct("line_no", "answer_no", "_solid")), ignorenulls=True).over(before)
    lines = lines.withColumn("_prev", prev)
    joined = (F.col("answer_no") > F.col("_prev.answer_no")) & (F.col("line_no") - F.col("_prev.line_no") <= ZONE_GAP + 1) & (F.col("_solid") == F.col("_prev._solid"))
    lines = lines.withColumn("_island", F.sum(F.when(answer & ~F.coalesce(joined, F.lit(False)), 1).otherwise(0)).over(w))
    per_island = W.Window.partitionBy("doc_id", "_island")
    lines = lines.withColumn("_size", F.count_if(answer).over(per_island)).withColumn("_last", F.max(F.when(answer, F.col("line_no"))).over(per_island))
    lines = lines.withColumn("_zone", F.min(F.when(answer & (F.col("_size") >= ZONE_MIN), F.col("_island"))).over(W.Window.partitionBy("doc_id")))
    in_zone = F.coalesce((F.col("_island") == F.col("_zone")) & (F.col("line_no") <= F.col("_last")), F.lit(False))
    return lines.withColumn("in_zone", in_zone).drop("_solid", "_prev", "_island", "_size", "_last", "_zone")


def answer_lines(lines: DataFrame, zone: bool) -> DataFrame:
    """(doc_id, no, answer): the answers of the zone, or those of lone answer lines; the first of a number counts."""
    own = lines.where((F.col("in_zone") if zone else ~F.col("in_zone")) & (F.col("answer_no") > 0))
    return own.groupBy("doc_id", F.col("answer_no").alias("no")).agg(F.min_by("answer_text", "line_no").alias("answer"))


def assign_blocks(lines: DataFrame) -> DataFrame:
    """The lines of questions, with ``block``, ``chapter_name`` and ``section_label``; other lines are gone."""
    w = W.Window.partitionBy("doc_id").orderBy("line_no")
    lone = ~F.col("in_zone") & (F.col("answer_no") > 0)
    kind = (
        F.when(F.col("in_zone") | F.coalesce(lone, F.lit(False)), "out")
        .when(F.col("chapter").isNotNull(), "chapter")
        .when(F.col("section").isNotNull(), "section")
        .when(F.col("chinese").isNotNull() & ~F.col("chinese_question"), "heading")
        .when(F.col("chinese_question") | F.col("numbered"), "header")
        .otherwise("body")
    )
    lines = lines.withColumn("kind", kind)
    k = F.col("kind")
    state = F.last(F.when(k == "header", True).when(k.isin("chapter", "section", "heading"), False), ignorenulls=True).over(w)
    chapter = F.last(F.when(k == "chapter", F.col("chapter")), ignorenulls=True).over(w)
    section = F.last(F.when(k == "section", F.col("section")).when(k.isin("chapter", "heading"), ""), ignorenulls=True).over(w)
    lines = lines.select("doc_id", "line_no", "line", "skip", "kind", F.sum((k == "header").cast("int")).over(w).alias("block"), state.alias("open"), F.nullif(chapter, F.lit("")).alias("chapter_name"), F.nullif(section, F.lit("")).alias("section_label"))
    return lines.where(F.col("open") & F.col("kind").isin("header", "body")).drop("open", "kind")


def split_inline_options(c: Column) -> Column:
    """STRUCT<prefix, options, answer> if a line holds two or more options in order, else null.

    ``c`` must be a plain column: it is looked at several times.
    """
    marks = F.regexp_extract_all(c, F.lit(f"({INLINE_MARK})"), 1)
    keys = F.transform(marks, lambda m: T.normalize_letter(F.regexp_extract(m, T.LETTER, 0)))
    texts = F.transform(F.slice(F.split(c, INLINE_MARK), 2, MAX_INLINE), T.trim)
    n = F.size(marks)
    expected = F.transform(F.sequence(F.lit(0), F.lit(MAX_INLINE - 1)), lambda i: F.char(i + 65))
    last = F.element_at(texts, -1)
    before, answer = T.trim(F.regexp_extract(last, f"^(.*?){TRAILING_ANSWER}", 1)), T.strip_bold(F.regexp_extract(last, f"^(.*?){TRAILING_ANSWER}", 2))
    has_answer = last.rlike(TRAILING_ANSWER)
    final = F.when(has_answer, F.concat(F.slice(texts, 1, n - 1), F.array(before))).otherwise(texts)
    options = F.zip_with(keys, final, lambda k, x: F.struct(k.alias("key"), x.alias("text")))
    good = F.forall(texts, lambda x: x != "") & (~has_answer | (before != ""))
    split = F.when(good, F.struct(T.trim(F.get(F.split(c, INLINE_MARK), F.lit(0))).alias("prefix"), options.alias("options"), F.when(has_answer, answer).alias("answer")))
    return F.when(c.isNotNull() & ~c.rlike(CODE_LIKE) & (n >= 2) & (n <= MAX_INLINE), F.when(keys == F.slice(expected, 1, n), split))


def _letter_bits(letters: Column) -> Column:
    """The letters A-Z of an array as bits of a number."""
    return F.aggregate(letters, F.lit(0), lambda bits, c: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1), F.ascii(c) - 65)))


def extract_questions(blocks: DataFrame) -> DataFrame:
    """One raw question per block.

    In each block the first rule that fits takes a line: type, stem, option label, options in a line, one option, answer,
    own answer, bare answer; what is left is suspicious.  "First" is a minimum over line numbers, as every rule that
    depends on earlier lines only asks whether something stood before.
    """
    line, no = F.col("line"), F.col("line_no")
    block = W.Window.partitionBy("doc_id", "block")
    earlier = block.orderBy("line_no").rowsBetween(W.Window.unboundedPreceding, -1)
    rows = blocks.where("not skip").withColumn("_t", T.trim(line)).withColumn("_type", T.trim(_found(line, TYPE)))
    rows = rows.withColumn("_stem", T.strip_bold(F.coalesce(_found(line, STEM), _found(line, NUMBERED_STEM))))
    rows = rows.withColumn("_type_at", F.min(F.when(F.col("_type").isNotNull(), no)).over(block))
    rows = rows.withColumn("_stem_at", F.min(F.when(F.col("_stem").isNotNull() & ~no.eqNullSafe(F.col("_type_at")), no)).over(block))
    rows = rows.withColumn("_from_stem", F.when(no == F.col("_stem_at"), split_inline_options(F.col("_stem"))))
    rows = rows.withColumn("_from_line", F.when(no > F.col("_stem_at"), split_inline_options(F.col("_t"))))
    rule = (
        F.when(no == F.col("_type_at"), 1)
        .when(no == F.col("_stem_at"), 2)
        .when(line.rlike(OPTION_LABEL), 3)
        .when(F.col("_from_line.prefix") == "", 4)
        .when(line.rlike(OPTION_LINE), 5)
        .otherwise(8)
    )
    rows = rows.withColumn("_rule", rule)
    r = F.col("_rule")
    one = F.array(F.struct(T.normalize_letter(F.regexp_extract(line, OPTION_LINE, 1)).alias("key"), T.strip_bold(F.regexp_extract(line, OPTION_LINE, 2)).alias("text")))
    none = F.array().cast(f"array<{OPTION}>")
    rows = rows.withColumn("_options", F.coalesce(F.when(r == 2, F.col("_from_stem.options")).when(r == 4, F.col("_from_line.options")).when(r == 5, one), none))
    # the letters of earlier options as bits, so a line costs the same however many stand before it
    rows = rows.withColumn("_keys", F.coalesce(F.bit_or(_letter_bits(F.transform("_options", lambda o: o["key"]))).over(earlier), F.lit(0))).withColumn("_bare", T.strip_bold(line))
    said = F.transform(F.regexp_extract_all("_bare", F.lit(f"({T.LETTER})"), 1), T.normalize_letter)
    bare_ok = (F.col("_keys") > 0) & (F.col("_bare") != "") & (F.length("_bare") <= BARE_ANSWER_MAX) & (F.col("_bare").rlike(T.TRUE_FALSE_WORDS) | (F.col("_bare").rlike(BARE_LETTERS) & (_letter_bits(said).bitwiseAND(F.bitwise_not("_keys")) == 0)))
    labelled = T.strip_bold(F.coalesce(_found(line, ANSWER_INLINE), _found(line, ANSWER_LABEL)))
    mine = line.rlike(MY_ANSWER)
    answer = F.when(r == 2, F.col("_from_stem.answer")).when(r == 4, F.col("_from_line.answer")).when(r == 8, F.coalesce(labelled, F.when(~mine & bare_ok, F.col("_bare"))))
    rows = rows.withColumn("_answer", answer).withColumn("_answer_at", F.min(F.when(F.col("_answer").isNotNull(), no)).over(block))
    rest = F.regexp_extract(line, OPTION_LABEL, 1)
    odd = F.when((r == 3) & (T.trim(rest) != ""), F.concat(F.lit("选项标签行有异常内容："), "_t")).when((r == 8) & ~no.eqNullSafe(F.col("_answer_at")) & ~mine, line)
    rows = rows.withColumn("_odd", odd)
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.col(c).alias("v")))), lambda x: x["v"])
    out = rows.groupBy("doc_id", "block").agg(
        F.max(F.when(r == 1, F.col("_type"))).alias("_raw_type"),
        F.max(F.when(r == 2, F.coalesce(F.col("_from_stem.prefix"), F.col("_stem")))).alias("raw_stem"),
        F.flatten(ordered("_options")).alias("raw_options"),
        F.max(F.when(no == F.col("_answer_at"), F.col("_answer"))).alias("raw_answer"),
        F.first("chapter_name").alias("chapter_name"),
        F.first("section_label").alias("_section"),
        F.min("line_no").alias("start_line"),
        F.filter(ordered("_odd"), lambda x: x.isNotNull()).alias("suspicious"),
    )
    by_section = F.when(F.col("_section").isin(*READING), F.when(F.size("raw_options") == 0, "简答题")).otherwise(T.one_of(F.col("_section"), SECTION_TYPES))
    return out.select("doc_id", "block", F.coalesce("_raw_type", by_section).alias("raw_type"), "raw_stem", "raw_options", "raw_answer", "chapter_name", "start_line", "suspicious")


def backfill_answers(questions: DataFrame, zone: DataFrame, loose: DataFrame) -> DataFrame:
    """P10: answers by number for questions without one, the zone's first; a different own answer stays, with a note."""
    w = W.Window.partitionBy("doc_id").orderBy("block")
    out = questions.withColumn("no", F.row_number().over(w))
    for answers in (zone, loose):
        out = out.join(answers.withColumnRenamed("answer", "_given"), ["doc_id", "no"], "left")
        given, own = T.strip_bold(F.col("_given")), F.col("raw_answer")
        note = F.concat(F.lit("答案区与题内答案不一致：题内="), own, F.lit("，答案区="), given, F.lit("（已保留题内答案）"))
        differs = given.isNotNull() & ~T.is_blank(own) & (own != given)
        out = out.withColumn("suspicious", F.when(differs, F.array_append("suspicious", note)).otherwise(F.col("suspicious")))
        out = out.withColumn("raw_answer", F.when(T.is_blank(own) & given.isNotNull(), given).otherwise(own)).drop("_given")
    return out


def parse_documents(docs: DataFrame) -> DataFrame:
    """Raw questions (doc_id, no, raw_type, raw_stem, raw_options, raw_answer, chapter_name, start_line, suspicious)."""
    lines = detect_answer_zone(confirm_chinese_header(classify_lines(explode_lines(docs)).repartition("doc_id")))
    questions = extract_questions(assign_blocks(lines))
    return backfill_answers(questions, answer_lines(lines, True), answer_lines(lines, False)).drop("block")


def route_documents(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """Per document its number of questions and whether any has a stem (documents without questions too)."""
    n = questions.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(~T.is_blank(F.col("raw_stem"))).alias("u"))
    return docs.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("questions"), F.coalesce("u", F.lit(False)).alias("usable"))


def chunk_documents(docs: DataFrame, target: int = CHUNK_CHARS, limit: int = CHUNK_LIMIT) -> DataFrame:
    """Pieces of documents for a model: closed at a header or blank line once over ``target``, or at ``limit``.

    A document is one row (its file is at most 20 MB, S2); its lines are folded in the JVM, and only line numbers are kept
    until the pieces are cut.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\n+$", "")  # trailing empty lines are not lines
    lines = docs.select("doc_id", F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n")).alias("lines"))
    flags = F.transform("lines", lambda x, i: F.struct((i + 1).alias("no"), (F.length(x) + 1).alias("size"), T.is_blank(x).alias("blank"), x.rlike(QUESTION_HEADER).alias("header")))
    kind = "array<struct<start:int,first:int,end:int>>"
    begin = F.struct(F.lit(1).alias("start"), F.lit(1).alias("first"), F.lit(0).alias("size"), F.array().cast(kind).alias("cuts"))

    def step(at, line):
        soft = (at["size"] >= target) & (line["header"] | line["blank"])
        close, skip = soft | (at["size"] >= limit), soft & line["blank"]
        piece = F.struct(at["start"].alias("start"), at["first"].alias("first"), (line["no"] - 1).alias("end"))
        closed = F.struct(line["no"].alias("start"), (line["no"] + skip.cast("int")).alias("first"), F.when(skip, 0).otherwise(line["size"]).alias("size"), F.array_append(at["cuts"], piece).alias("cuts"))
        return F.when(close, closed).otherwise(F.struct(at["start"].alias("start"), at["first"].alias("first"), (at["size"] + line["size"]).alias("size"), at["cuts"].alias("cuts")))

    def finish(at):
        rest = F.struct(at["start"].alias("start"), at["first"].alias("first"), F.size("lines").alias("end"))
        return F.when(at["size"] > 0, F.array_append(at["cuts"], rest)).otherwise(at["cuts"])

    pieces = lines.select("doc_id", "lines", F.posexplode(F.aggregate(flags, begin, step, finish)).alias("chunk_no", "p"))
    body = F.concat(F.array_join(F.slice("lines", F.col("p.first"), F.col("p.end") - F.col("p.first") + 1), "\n"), F.lit("\n"))
    return pieces.select("doc_id", "chunk_no", F.col("p.start").alias("start_line"), F.col("p.end").alias("end_line"), body.alias("text"))
