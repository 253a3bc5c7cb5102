"""Material for a language model, and what its answers do to the tables.  The model call itself is outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quizmill.functions import text as T
from quizmill.operators.segment import QUESTION_HEADER

SUMMARY_QUESTIONS, MISTAKES = 300, 100
SUMMARY_LISTS = ("highlights", "key_points", "hot_topics", "easy_mistakes", "study_suggestions")
# What is asked of the model for each type of question.
ANSWER_RULES = {
    "SINGLE": "answer 必须是单个大写字母，例如 A。",
    "MULTIPLE": "answer 必须是多个大写字母、用英文逗号分隔并升序，例如 A,C。",
    "TRUE_FALSE": "answer 只能是 A（正确）或 B（错误）。",
    "FILL_BLANK": "answer 是各空答案，多个空用中文分号「；」分隔。",
}
ANSWER_RULE_ELSE = "answer 是参考答案文本。"
MODEL_QUESTIONS = "array<struct<chapter:string,type:string,stem:string,options:array<struct<key:string,content:string>>,answer:string>>"


def _lines_by_bank(rows: DataFrame, place: str, line: Column) -> DataFrame:
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("n"), line.alias("line")))), lambda x: x["line"]), "")
    return rows.groupBy("bank_id").agg(joined.alias("material"), F.count(F.lit(1)).alias("used"))


def summary_material(question: DataFrame) -> DataFrame:
    """M1: per bank the numbered lines of its first 300 questions, how many were used, and whether some were not."""
    per = W.Window.partitionBy("bank_id")
    rows = question.select("id", "bank_id", "type", "stem", "answer").withColumn("n", F.row_number().over(per.orderBy("id"))).where(F.col("n") <= SUMMARY_QUESTIONS)
    tail = F.when(T.is_blank(F.col("answer")), "（本题未提供答案）").otherwise(F.concat(F.lit("　答案："), "answer"))
    line = F.concat(F.col("n").cast("string"), F.lit(". ["), T.type_label(F.col("type")), F.lit("] "), "stem", tail, F.lit("\n"))
    totals = question.groupBy("bank_id").agg(F.count(F.lit(1)).alias("total"))
    return _lines_by_bank(rows, "n", line).join(totals, "bank_id").withColumn("cut", F.col("total") > F.col("used"))


def mistake_material(wrong: DataFrame, question: DataFrame) -> DataFrame:
    """M2: per bank the lines of its 100 open wrong questions with most mistakes; numbers stay dense."""
    per = W.Window.partitionBy("bank_id")
    top = wrong.where("resolved = 0").select("id", "bank_id", "question_id", "user_answer", "wrong_count").withColumn("rank", F.row_number().over(per.orderBy(F.desc("wrong_count"), "id"))).where(F.col("rank") <= MISTAKES)
    q = question.select(F.col("id").alias("question_id"), "type", "stem", "answer")
    rows = top.join(q, "question_id").withColumn("n", F.row_number().over(per.orderBy("rank")))
    dash = lambda c: T.blank_to(F.col(c), "（空）")
    line = F.concat(F.col("n").cast("string"), F.lit(". ["), T.type_label(F.col("type")), F.lit("] "), "stem", F.lit("　正确答案："), dash("answer"), F.lit("　学生答案："), dash("user_answer"), F.lit("　答错 "), F.col("wrong_count").cast("string"), F.lit(" 次\n"))
    return _lines_by_bank(rows, "n", line)


def enrich_prompts(question: DataFrame) -> DataFrame:
    """M3: (question_id, prompt) for the questions that are not enriched yet."""
    options = F.when(F.coalesce(F.size("options"), F.lit(0)) > 0, F.concat(F.lit("选项："), F.to_json("options"), F.lit("\n"))).otherwise("")
    answer = F.when(T.is_blank(F.col("answer")), "（题目文件里没有提供，请你解出来）").otherwise(F.col("answer"))
    rule = F.coalesce(T.one_of(F.col("type"), ANSWER_RULES), F.lit(ANSWER_RULE_ELSE))
    body = F.concat(F.lit("题型："), "type", F.lit("\n题干："), "stem", F.lit("\n"), options, F.lit("标准答案："), answer, F.lit("\n"), rule)
    return question.where(~F.coalesce(F.col("ai_status") == "DONE", F.lit(False))).select(F.col("id").alias("question_id"), body.alias("prompt"))


def parse_model_questions(outputs: DataFrame) -> DataFrame:
    """M4: ``outputs`` (id, raw_text) with ``questions``, the root array or the object's first array; else ``error``."""
    rows = outputs.withColumn("_json", T.repair_backslashes(T.strip_to_json(F.col("raw_text"))))
    paths = F.transform(F.json_object_keys("_json"), lambda k: F.concat(F.lit("$['"), k, F.lit("']")))
    first = F.get(F.filter(F.transform(paths, lambda p: F.call_function("get_json_object", F.col("_json"), p)), lambda v: F.json_array_length(v).isNotNull()), F.lit(0))
    array = F.when(F.json_array_length("_json").isNotNull(), F.col("_json")).otherwise(first)
    rows = rows.withColumn("questions", F.from_json(array, MODEL_QUESTIONS))
    return rows.withColumn("error", F.when(F.col("questions").isNull(), F.concat(F.lit("AI 返回的 JSON 里没有题目数组："), T.brief(F.coalesce("_json", F.lit("")), 120)))).drop("_json")


def _letters_of(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.upper(c), F.lit("([A-Z])"), 1))


def validate_model_questions(parsed: DataFrame) -> DataFrame:
    """M5: one row per usable question (id, place, raw_type, raw_stem, raw_options, raw_answer, chapter_name) and, on
    every row, what the output's other parts were dropped for: no_stem, bad_option, bad_answer."""
    rows = parsed.where("questions is not null").select("id", F.posexplode_outer("questions").alias("place", "q"))
    stem, answer = T.trim_to_null(F.col("q.stem")), T.trim_to_null(F.col("q.answer"))
    letter = lambda k: F.regexp_extract(T.normalize_letter(T.trim(F.coalesce(k, F.lit("")))), "^[A-Z]$", 0)
    given = F.filter(F.coalesce("q.options", F.array().cast("array<struct<key:string,content:string>>")), lambda o: o.isNotNull())
    cleaned = F.transform(given, lambda o: F.struct(letter(o["key"]).alias("key"), T.trim_to_null(o["content"]).alias("text")))
    rows = rows.withColumn("_given", F.when(stem.isNotNull(), cleaned)).withColumn("_ok", F.filter("_given", lambda o: (o["key"] != "") & o["text"].isNotNull()))
    first = F.filter("_ok", lambda o, i: F.array_position(F.transform("_ok", lambda x: x["key"]), o["key"]) == i + 1)
    rows = rows.withColumn("raw_options", first).withColumn("_answer", answer)
    like_letters = (F.length("_answer") <= 20) & F.col("_answer").rlike("^[A-Za-z、,，;；/ \t]*$") & (F.size(_letters_of(F.col("_answer"))) > 0)
    wrong = F.coalesce(stem.isNotNull() & (F.size("raw_options") > 0) & like_letters & (F.size(F.array_except(_letters_of(F.col("_answer")), F.transform("raw_options", lambda o: o["key"]))) > 0), F.lit(False))
    per = W.Window.partitionBy("id")
    rows = rows.withColumn("no_stem", F.count_if(F.col("q").isNotNull() & stem.isNull()).over(per)).withColumn("bad_option", F.coalesce(F.sum(F.size("_given") - F.size("raw_options")).over(per), F.lit(0))).withColumn("bad_answer", F.count_if(wrong).over(per))
    return rows.where(stem.isNotNull()).select("id", "place", T.trim_to_null(F.col("q.type")).alias("raw_type"), stem.alias("raw_stem"), "raw_options", F.when(~wrong, F.col("_answer")).alias("raw_answer"), T.trim_to_null(F.col("q.chapter")).alias("chapter_name"), "no_stem", "bad_option", "bad_answer")


def chunk_status(chunks: DataFrame, parsed: DataFrame, questions: DataFrame) -> DataFrame:
    """M6: chunks (id, doc_id, start_line, end_line, text) with the reason why they failed, or null.

    ``parsed`` has (id, error, finish_reason); ``questions`` the usable questions of each id.  ``doc_failed`` tells
    whether any chunk of the document failed.
    """
    n = questions.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    out = chunks.join(parsed.select("id", "error", "finish_reason", F.lit(True).alias("_there")), "id", "left").join(n, "id", "left")
    headed = F.exists(F.split("text", "\n"), lambda x: x.rlike(QUESTION_HEADER))
    reason = (
        F.when(F.col("_there").isNull(), "AI 返回了空内容")
        .when(F.lower("finish_reason") == "length", "AI 输出被截断")
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("n").isNull() & headed, "这一块原文里有题号，但 AI 没抽出任何题目")
    )
    message = F.concat(F.lit("AI 抽取题目失败（原文第 "), F.col("start_line").cast("string"), F.lit("~"), F.col("end_line").cast("string"), F.lit(" 行）："), "reason")
    out = out.withColumn("reason", reason).withColumn("message", message)
    return out.select("id", "doc_id", "start_line", "end_line", "reason", "message", F.bool_or(F.col("reason").isNotNull()).over(W.Window.partitionBy("doc_id")).alias("doc_failed"))


def parse_enrich_results(outputs: DataFrame, question: DataFrame) -> DataFrame:
    """M7: ``outputs`` (question_id, raw_text, error) as analysis, and an answer where the question has none.

    An output without analysis fails; an answer that does not have the form of its type is left out.
    """
    q = question.select(F.col("id").alias("question_id"), "bank_id", "type", "answer")
    j = F.from_json(T.repair_backslashes(F.col("raw_text")), "answer string, analysis string")
    rows = outputs.join(q, "question_id").withColumn("_j", j)
    analysis, ok = T.trim(F.col("_j.analysis")), F.col("error").isNull() & ~T.is_blank(F.col("_j.analysis"))
    answer = F.when(ok & T.is_blank(F.col("answer")), T.normalize_model_answer(F.col("type"), F.col("_j.answer")))
    return rows.select("question_id", "bank_id", F.when(ok, analysis).alias("analysis"), answer.alias("answer"), answer.isNotNull().alias("answer_from_ai"), F.when(~ok, F.coalesce("error", F.lit("AI 没有返回可用的解析内容"))).alias("error"))


def apply_enrichment(question: DataFrame, results: DataFrame, now: Column, secret: Column | None = None) -> DataFrame:
    """M8: the question table after the results: DONE with analysis (and answer where it was filled), or FAILED."""
    r = results.select(F.col("question_id").alias("id"), F.col("analysis").alias("_analysis"), F.col("answer").alias("_answer"), F.col("answer_from_ai").alias("_from"), F.col("error").alias("_error"), F.lit(True).alias("_hit"))
    secret = F.lit(None).cast("string") if secret is None else secret
    out = question.join(r, "id", "left")
    done, failed = F.col("_hit").isNotNull() & F.col("_error").isNull(), F.col("_error").isNotNull()
    filled = done & F.coalesce("_from", F.lit(False))
    keep = lambda c: F.col(c) if c in question.columns else F.lit(None)
    return (
        out.withColumn("analysis", F.when(done, F.col("_analysis")).otherwise(F.col("analysis")))
        .withColumn("answer", F.when(filled, F.col("_answer")).otherwise(F.col("answer")))
        .withColumn("answer_source", F.when(filled, "AI").otherwise(keep("answer_source")))
        .withColumn("ai_status", F.when(done, "DONE").when(failed, "FAILED").otherwise(F.col("ai_status")))
        .withColumn("ai_error", F.when(done, None).when(failed, T.mask_secret(F.col("_error"), secret, F.lit("Exception"))).otherwise(F.col("ai_error")))
        .withColumn("ai_retry_count", F.coalesce("ai_retry_count", F.lit(0)) + failed.cast("int"))
        .withColumn("ai_enriched_at", F.when(done, now).otherwise(keep("ai_enriched_at").cast("timestamp")))
        .drop("_analysis", "_answer", "_from", "_error", "_hit")
    )


def enrich_outcome(results: DataFrame) -> DataFrame:
    """M9: per bank the number of failures, the first account-level reason (by question id), and what to tell the user."""
    reason = T.classify_failure(F.col("error"))
    n = results.withColumn("_r", reason).groupBy("bank_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.min_by(F.when(F.col("_r").isNotNull(), F.col("_r")), F.when(F.col("_r").isNotNull(), F.col("question_id"))).alias("systemic_reason"))
    text = F.format_string("AI 解析中断：%s。已完成 %d 道题的解析（可正常使用），还有 %d 道未解析，处理后重新上传即可补齐。", "systemic_reason", F.col("total") - F.col("failed"), "failed")
    return n.withColumn("message", F.when(F.col("systemic_reason").isNotNull(), text))


def unmark_retryable(question: DataFrame, results: DataFrame, outcome: DataFrame) -> DataFrame:
    """M9: where an account-level failure stopped a bank's batch, its failed questions are pending again."""
    hit = results.join(outcome.where("systemic_reason is not null").select("bank_id"), "bank_id", "left_semi").select(F.col("question_id").alias("id"), F.lit(True).alias("_hit"))
    back = F.col("_hit").isNotNull() & (F.col("ai_status") == "FAILED")
    out = question.join(hit, "id", "left")
    return out.withColumn("ai_error", F.when(~back, F.col("ai_error"))).withColumn("ai_status", F.when(back, "PENDING").otherwise(F.col("ai_status"))).drop("_hit")


def summary_plan(requests: DataFrame, bank: DataFrame, summaries: DataFrame, question: DataFrame) -> DataFrame:
    """For requests (bank_id, force) the error code (40401, 40011), or whether the stored summary serves."""
    b = bank.select(F.col("id").alias("bank_id"), F.lit(True).alias("_b"))
    s = summaries.select("bank_id", F.lit(True).alias("_s"))
    q = question.select("bank_id").distinct().withColumn("_q", F.lit(True))
    out = requests.join(b, "bank_id", "left").join(s, "bank_id", "left").join(q, "bank_id", "left")
    cached = F.col("_b").isNotNull() & F.col("_s").isNotNull() & ~F.coalesce("force", F.lit(False))
    code = F.when(F.col("_b").isNull(), 40401).when(~cached & F.col("_q").isNull(), 40011)
    return out.select("bank_id", "force", code.alias("reject_code"), cached.alias("from_cache"), (code.isNull() & ~cached).alias("needs_model"))


def upsert_summaries(old: DataFrame, new: DataFrame, bank: DataFrame, now: Column) -> DataFrame:
    """One summary per bank; the id and first time stay, null lists are empty, the time shown is the last update."""
    n = new.select("bank_id", *[F.col(c).alias(f"_{c}") for c in SUMMARY_LISTS], F.lit(True).alias("_new"))
    out = old.join(n, "bank_id", "full").join(bank.select(F.col("id").alias("bank_id"), F.col("name").alias("bank_name")), "bank_id", "left")
    fresh = F.col("_new").isNotNull()
    lists = [F.coalesce(F.when(fresh, F.col(f"_{c}")).otherwise(F.col(c)), F.array().cast("array<string>")).alias(c) for c in SUMMARY_LISTS]
    return out.select("id", "bank_id", "bank_name", *lists, F.coalesce("created_at", now).alias("created_at"), F.when(fresh, now).otherwise(F.col("updated_at")).alias("updated_at"), F.when(fresh, now).otherwise(F.col("updated_at")).alias("generated_at"))
