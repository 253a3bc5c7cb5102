"""Building banks from raw questions: chapters, typed questions, ids, checks, duplicates, task status, deletion."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quizmill.functions import text as T
from quizmill.sources.ingest import work_dir

DEFAULT_CHAPTER = "默认章节"
# The kinds of issues a quality check reports, in the order in which a question is checked, and all messages.
ISSUES = ["有可疑行", "无题干", "缺答案", "选项重复", "答案越界", "选项不足"]
ADVICE = "（上传页可查看格式要求）"
NOTHING_READ = f"未识别到题目，请按标准格式整理：每道题以【第 N 题】开头，并写「题目：题干」{ADVICE}"
UNUSABLE = f"解析出 %d 题但全部无法入库（无题干 %d 题、题型无法识别 %d 题），请按标准格式整理后重新上传{ADVICE}"
ODD_LINES = "原文第 %d 行起的这道题里，有 %d 行没被识别（可能是被截断的题干或异常选项）：%s"
NO_STEM, NO_ANSWER, TWICE = "没有提取到题干，入库时会被跳过", "没提取到答案，不开 AI 时无法判分", "同一题里出现了重复的选项字母："
OUTSIDE, FEW = ("答案字母 ", " 不在选项 ", " 里（多半是切题切错了）"), ("题型判定为「", "」但只有 ", " 个选项")
LEADING_SEPARATORS = ",，、/;；"


def _chapter_name(c: Column) -> Column:
    return F.when(T.is_blank(c), DEFAULT_CHAPTER).otherwise(T.trim(c))


def build_chapters(raw: DataFrame) -> DataFrame:
    """B1: (bank_id, name, sort) of raw questions (bank_id, pos, chapter_name, ...), by first appearance."""
    first = raw.groupBy("bank_id", _chapter_name(F.col("chapter_name")).alias("name")).agg(F.min("pos").alias("first"))
    return first.select("bank_id", "name", F.row_number().over(W.Window.partitionBy("bank_id").orderBy("first")).alias("sort"))


def typed(raw: DataFrame) -> DataFrame:
    """Raw questions with their type and normalised answer (both null where nothing tells)."""
    t = raw.withColumn("type", T.classify_type(F.col("raw_type"), F.col("raw_options"), F.col("raw_answer")))
    return t.withColumn("answer", T.normalize_answer(F.col("type"), F.col("raw_answer"), F.col("raw_options")))


def build_questions(raw: DataFrame, chapters: DataFrame) -> DataFrame:
    """B2: questions that have a stem and a type, with their chapter's ``sort``, ready to be numbered."""
    kept = typed(raw).where(~T.is_blank(F.col("raw_stem")) & F.col("type").isNotNull()).withColumn("name", _chapter_name(F.col("chapter_name")))
    return kept.join(chapters, ["bank_id", "name"]).select(
        "bank_id", "pos", F.col("name").alias("chapter_name"), F.col("sort").alias("chapter_sort"), "type", T.trim(F.col("raw_stem")).alias("stem"), F.col("raw_options").alias("options"),
        F.coalesce("answer", F.lit("")).alias("answer"), F.lit("PENDING").alias("ai_status"), F.lit(0).alias("ai_retry_count"), F.lit("FILE").alias("answer_source"),
    )


def _left_out(raw: DataFrame) -> tuple[Column, Column]:
    """Whether a typed raw question lacks a stem, and whether it lacks a type only."""
    no_stem = T.is_blank(F.col("raw_stem"))
    return no_stem, ~no_stem & F.col("type").isNull()


def import_report(raw: DataFrame, banks: DataFrame | None = None) -> DataFrame:
    """Per bank how many questions were read, stored and left out, and why an import that stored none failed.

    ``banks`` (bank_id) adds the banks whose file gave no question at all.  Which ones were left out: ``skipped_numbers``.
    """
    no_stem, no_type = _left_out(raw)
    counts = ["total", "inserted", "skipped_no_stem", "skipped_no_type"]
    out = typed(raw).groupBy("bank_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(~no_stem & ~no_type).alias("inserted"), F.count_if(no_stem).alias("skipped_no_stem"), F.count_if(no_type).alias("skipped_no_type"))
    if banks is not None:
        out = banks.select("bank_id").join(out, "bank_id", "left").fillna(0, counts)
    unusable = F.format_string(UNUSABLE, "total", "skipped_no_stem", "skipped_no_type")
    return out.withColumn("failed", F.col("inserted") == 0).withColumn("message", F.when(F.col("total") == 0, NOTHING_READ).when(F.col("inserted") == 0, unusable))


def skipped_numbers(raw: DataFrame, part: int = 4096) -> DataFrame:
    """(bank_id, part, ranges): the numbers that were left out, as runs from ``first`` to ``last``.

    A row holds the runs among ``part`` neighbouring numbers, so it is bounded, a bank of any size has as many rows as it
    needs, and a run that crosses the border of two parts stands in both.
    """
    no_stem, no_type = _left_out(raw)
    out = typed(raw).where(no_stem | no_type).select("bank_id", F.expr(f"pos div {part}").cast("int").alias("part"), "pos").distinct()
    # numbers of one run keep their distance from their place
    run = F.col("pos") - F.row_number().over(W.Window.partitionBy("bank_id", "part").orderBy("pos"))
    runs = out.withColumn("_run", run).groupBy("bank_id", "part", "_run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return runs.groupBy("bank_id", "part").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("ranges"))


def assign_ids(df: DataFrame, by: str, order: list[str], first: int = 1, name: str = "id") -> DataFrame:
    """Ids in the order of ``by`` and ``order``, without a gap: a row's place in all rows.

    Rows are dealt by ranges of (``by``, ``order``), so a large group spans tasks, and written with their place in their
    part; a part's first id is the running total of the parts before it.  Ranges are sampled, which is why they are written
    down and not made twice.  Nulls come first; rows that tie in ``order`` are numbered as they come.
    """
    spark = df.sparkSession
    keys = [by, *order]
    place = F.monotonically_increasing_id()  # the part's number above 33 bits of the place in it
    path = f"{work_dir(spark)}/numbered-{uuid.uuid4().hex}"
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", place).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_part", F.shiftright("_place", 33))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each part
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + inside + F.lit(first)).select(*df.columns, name)


def _leading_letters(c: Column) -> Column:
    head = F.regexp_extract(c, f"^[A-Za-z{LEADING_SEPARATORS}]*", 0)
    return F.regexp_extract_all(F.upper(head), F.lit("([A-Z])"), 1)


def quality_issues(raw: DataFrame) -> DataFrame:
    """(bank_id, seq, kind, detail) for raw questions (bank_id, pos, ...); a question without a stem gets no more checks."""
    stem, n = ~T.is_blank(F.col("raw_stem")), F.coalesce(F.size("raw_options"), F.lit(0))
    answer = T.trim(F.coalesce("raw_answer", F.lit("")))
    keys = F.transform("raw_options", lambda o: o["key"])
    bad = F.filter(_leading_letters(answer), lambda x: ~F.array_contains(keys, x))
    listed = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    kind = F.coalesce("raw_type", F.lit(""))
    odd = F.coalesce(F.size("suspicious"), F.lit(0))
    issue = lambda ok, name, detail: F.when(ok, F.struct(F.lit(name).alias("kind"), detail.alias("detail")))
    many = F.array(
        issue(odd > 0, ISSUES[0], F.format_string(ODD_LINES, F.col("start_line"), odd, T.brief(F.get("suspicious", F.lit(0))))),
        issue(~stem, ISSUES[1], F.lit(NO_STEM)),
        issue(stem & (answer == ""), ISSUES[2], F.lit(NO_ANSWER)),
        issue(stem & (answer != "") & (n > 0) & (F.size(F.array_distinct(keys)) < n), ISSUES[3], F.concat(F.lit(TWICE), listed(F.array_sort(F.array_distinct(keys))))),
        issue(stem & (answer != "") & (n > 0) & (F.size(bad) > 0), ISSUES[4], F.concat(F.lit(OUTSIDE[0]), listed(bad), F.lit(OUTSIDE[1]), listed(F.array_sort(F.array_distinct(keys))), F.lit(OUTSIDE[2]))),
        issue(stem & kind.rlike("单选|多选") & (n < 2), ISSUES[5], F.concat(F.lit(FEW[0]), kind, F.lit(FEW[1]), n.cast("string"), F.lit(FEW[2]))),
    )
    found = raw.select("bank_id", F.col("pos").alias("seq"), F.explode(F.filter(many, lambda x: x.isNotNull())).alias("i"))
    return found.select("bank_id", "seq", "i.kind", "i.detail")


def quality_summary(issues: DataFrame) -> DataFrame:
    """Per bank the number of issues of each kind, 0 included."""
    return issues.groupBy("bank_id").pivot("kind", ISSUES).agg(F.count(F.lit(1))).fillna(0, ISSUES)


def dedup_questions(df: DataFrame, order: str = "pos") -> DataFrame:
    """The first of questions with the same fingerprint (stem, options and answer) and the same blanks of the answer;
    texts are not shuffled to find it.

    A fingerprint has no punctuation, so "1；12" and "11；2" look alike in it: the answer's blanks are compared one by one.
    """
    marked = df.withColumn("_f", F.sha2(F.concat_ws("||", T.fingerprint(F.col("stem"), F.col("options"), F.col("answer")), T.flat_blanks(F.col("answer"))), 256))
    first = marked.groupBy("_f").agg(F.min(order).alias(order))
    return marked.join(first, ["_f", order], "left_semi").drop("_f")


def merge_corpora(a: DataFrame, b: DataFrame, order: str = "pos") -> DataFrame:
    """Both corpora, ``a`` first, without the questions that ``b`` repeats."""
    both = a.withColumn("_p", F.struct(F.lit(0).alias("c"), F.col(order).alias("o"))).unionByName(b.withColumn("_p", F.struct(F.lit(1).alias("c"), F.col(order).alias("o"))))
    return dedup_questions(both, "_p").drop("_p")


def task_status(ids: DataFrame, snapshots: DataFrame, stored: DataFrame) -> DataFrame:
    """For each task id the newest snapshot (task_id, at, status, progress), else the stored row, else a failure."""
    newest = snapshots.groupBy("task_id").agg(F.max_by(F.struct("status", "progress"), "at").alias("s"))
    kept = stored.select("task_id", F.struct("status", "progress").alias("t"))
    out = ids.join(newest, "task_id", "left").join(kept, "task_id", "left")
    return out.select("task_id", F.coalesce("s.status", "t.status", F.lit("FAILED")).alias("status"), F.coalesce("s.progress", "t.progress", F.lit(0)).alias("progress"), F.when(F.col("s").isNull() & F.col("t").isNull(), "任务不存在").alias("error_message"))


def enrich_counts(question: DataFrame) -> DataFrame:
    """Enriched, failed and pending questions per bank, in one pass."""
    done, failed = F.count_if(F.col("ai_status") == "DONE"), F.count_if(F.col("ai_status") == "FAILED")
    return question.groupBy("bank_id").agg(done.alias("done"), failed.alias("failed"), F.greatest(F.lit(0), F.count(F.lit(1)) - done - failed).alias("pending"))


def delete_banks(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the banks ``ids`` (id) and all that hangs on them; import tasks stay."""
    gone = ids.select(F.col("id").alias("bank_id"))
    out = dict(tables)
    out["bank"] = tables["bank"].join(ids.select("id"), "id", "left_anti")
    for name in ("chapter", "question", "practice_session", "wrong_question", "knowledge_summary"):
        if name in tables:
            out[name] = tables[name].join(gone, "bank_id", "left_anti")
    if "practice_session" in tables:
        sessions = tables["practice_session"].join(gone, "bank_id", "left_semi").select("session_id")
        for name in ("practice_session_question", "practice_record"):
            if name in tables:
                out[name] = tables[name].join(sessions, "session_id", "left_anti")
    return out


def delete_chapters(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the chapters ``ids`` (id) and their questions; sessions stay, without the chapter."""
    gone = ids.select(F.col("id").alias("chapter_id"))
    out = dict(tables)
    out["chapter"] = tables["chapter"].join(ids.select("id"), "id", "left_anti")
    lost = tables["question"].join(gone, "chapter_id", "left_semi").select(F.col("id").alias("question_id"))
    out["question"] = tables["question"].join(gone, "chapter_id", "left_anti")
    for name in ("practice_session_question", "practice_record", "wrong_question"):
        if name in tables:
            out[name] = tables[name].join(lost, "question_id", "left_anti")
    if "practice_session" in tables:
        marked = tables["practice_session"].join(gone.withColumn("_gone", F.lit(True)), "chapter_id", "left")
        out["practice_session"] = marked.withColumn("chapter_id", F.when(F.col("_gone").isNull(), F.col("chapter_id"))).drop("_gone")
    return out
