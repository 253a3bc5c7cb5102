"""The registered queries of the library proper: each a function of (spark, sf_dir), with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quizmill.functions import text as T
from quizmill.operators import bank as B
from quizmill.operators import chat as C
from quizmill.operators import model_io as M
from quizmill.operators import pages as P
from quizmill.operators import practice as K
from quizmill.operators import reports as R
from quizmill.operators import search as S8
from quizmill.operators import segment as S
from quizmill.plans.fixtures import GROUP, WITH, Tables
from quizmill.sources import ingest as I
from quizmill.sources.bank_store import BankStore
from quizmill.streaming import attempts as A
from quizmill.streaming.counts import CountStore, chapter_counts, question_counts, signed, wrong_counts
from quizmill.streaming.store import KeyedTable, upsert_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` as a query; ``sql`` continues after the derived tables' WITH."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = WITH + sql
        return f

    return add


# ---- practice


@query(
    "k01_session_requests",
    """, r as (select o_orderkey as session_id, case when o_orderkey % 13 = 0 then null when o_orderkey % 13 = 1 then 99 else o_custkey % 25 end as bank_id,
       case when o_orderkey % 13 = 2 then 'SHUFFLED' when o_orderkey % 2 = 0 then 'SEQUENTIAL' else 'RANDOM' end as mode from orders)
    select session_id, case when r.bank_id is null or mode not in ('SEQUENTIAL', 'RANDOM') then 40010 when b.id is null then 40401 end as reject_code
    from r left join bank b on b.id = r.bank_id""",
)
def k01(t: Tables) -> DataFrame:
    s = F.col("session_id") % 13
    r = t.requests.withColumn("bank_id", F.when(s == 0, None).when(s == 1, 99).otherwise(F.col("bank_id")).cast("long")).withColumn("mode", F.when(s == 2, "SHUFFLED").otherwise(F.col("mode")))
    return K.validate_session_requests(r, t.bank).select("session_id", "reject_code")


_REQ = ", r as (select id as session_id, id as bank_id, case when id % 2 = 0 then 'SEQUENTIAL' else 'RANDOM' end as mode, case when id % 3 = 0 then 'SINGLE' else 'ALL' end as question_type, case when id % 5 = 0 then id * 10 + 5 end as chapter_id from bank)"


def _bank_requests(t: Tables) -> DataFrame:
    i = F.col("id")
    return t.bank.select(i.alias("session_id"), i.alias("bank_id"), F.when(i % 2 == 0, "SEQUENTIAL").otherwise("RANDOM").alias("mode"), F.when(i % 3 == 0, "SINGLE").otherwise("ALL").alias("question_type"), F.when(i % 5 == 0, i * 10 + 5).alias("chapter_id"))


_DRAWN = (
    _REQ
    + """, d as (select session_id, q.id as question_id, row_number() over (partition by session_id order by case when mode = 'RANDOM' then md5('7:' || session_id || ':' || q.id) end, q.id) as sort
    from r join question q on q.bank_id = r.bank_id where (question_type = 'ALL' or question_type = type) and (r.chapter_id is null or r.chapter_id = q.chapter_id))"""
)


@query("k02_draw_questions", _DRAWN + " select * from d")
def k02(t: Tables) -> DataFrame:
    return K.draw_questions(_bank_requests(t), t.question, seed=7)


@query(
    "k03_draw_wrong",
    _REQ + " select session_id, question_id, row_number() over (partition by session_id order by case when mode = 'RANDOM' then md5('7:' || session_id || ':' || question_id) end, w.id) as sort from r join wrong w on w.bank_id = r.bank_id where resolved = 0",
)
def k03(t: Tables) -> DataFrame:
    return K.draw_wrong_questions(_bank_requests(t), t.wrong, seed=7)


@query(
    "k04_build_sessions",
    _DRAWN + """ select session_id, bank_id, mode, question_type, chapter_id, 'IN_PROGRESS' as status, coalesce(n, 0) as total_count, 0 as answered_count, 0 as correct_count, 'NORMAL' as session_source, case when n is null then 40011 end as reject_code
    from r left join (select session_id, count(*) as n from d group by 1) using (session_id)""",
)
def k04(t: Tables) -> DataFrame:
    r = _bank_requests(t)
    return K.build_sessions(r, K.draw_questions(r, t.question, seed=7))


@query(
    "k04_order_sessions",
    """, r as (select o_orderkey as session_id, case when o_orderkey % 11 = 0 then 99 else o_custkey % 25 end as bank_id, case when o_orderkey % 2 = 0 then 'SEQUENTIAL' else 'RANDOM' end as mode,
       case o_orderkey % 4 when 0 then 'SINGLE' when 1 then 'TRUE_FALSE' else 'ALL' end as question_type, case when o_orderkey % 5 = 0 then (o_custkey % 25) * 10 + o_orderkey % 9 end as chapter_id from orders),
    n as (select session_id, count(q.id) as n from r left join question q on q.bank_id = r.bank_id and (question_type = 'ALL' or question_type = type) and (r.chapter_id is null or r.chapter_id = q.chapter_id) group by 1)
    select session_id, bank_id, mode, question_type, chapter_id, 'IN_PROGRESS' as status, n as total_count, 0 as answered_count, 0 as correct_count, 'NORMAL' as session_source, case when n = 0 then 40011 end as reject_code from r join n using (session_id)""",
)
def k04_orders(t: Tables) -> DataFrame:
    """A session for every order."""
    o, key, bank = t.read("orders"), F.col("o_orderkey"), F.col("o_custkey") % 25
    r = o.select(
        key.alias("session_id"), F.when(key % 11 == 0, 99).otherwise(bank).alias("bank_id"), F.when(key % 2 == 0, "SEQUENTIAL").otherwise("RANDOM").alias("mode"),
        F.when(key % 4 == 0, "SINGLE").when(key % 4 == 1, "TRUE_FALSE").otherwise("ALL").alias("question_type"), F.when(key % 5 == 0, bank * 10 + key % 9).alias("chapter_id"),
    )
    return K.build_sessions(r, K.count_drawable(r, t.question))


@query("k05_check_attempts", " select * from checked")
def k05(t: Tables) -> DataFrame:
    return t.checked


@query("k06_grade", " select * from graded")
def k06(t: Tables) -> DataFrame:
    return t.graded


@query("k07_records", " select * from record")
def k07(t: Tables) -> DataFrame:
    return t.record


@query("k08_session_counts", " select session_id, answered_count, correct_count from progress")
def k08(t: Tables) -> DataFrame:
    return K.refresh_counts(t.session, t.record_by_session).select("session_id", "answered_count", "correct_count")


@query("k09_completion", " select session_id, total_count, answered_count, correct_count, status, completed_at from progress")
def k09(t: Tables) -> DataFrame:
    return t.progress.select("session_id", "total_count", "answered_count", "correct_count", "status", "completed_at")


@query("k10_wrong_book", " select * from wrong")
def k10(t: Tables) -> DataFrame:
    return t.wrong


@query(
    "k11_session_detail",
    """ select s.session_id, s.bank_id, i.questions, r.records from progress s
    left join (select session_id, list({'sort': l.sort, 'question_id': question_id, 'type': type, 'stem': stem, 'options': options, 'chapter_name': c.name} order by l.sort) as questions from listed l join question q on q.id = question_id left join chapter c on c.id = chapter_id group by 1) i using (session_id)
    left join (select session_id, list({'first_seq': first_seq, 'question_id': question_id, 'user_answer': user_answer, 'is_correct': is_correct} order by first_seq) as records from record group by 1) r using (session_id)""",
)
def k11(t: Tables) -> DataFrame:
    return K.session_detail(t.session.select("session_id", "bank_id"), t.listed, t.question, t.chapter, t.record_by_session)


@query(
    "k12_submit_results",
    """, steps as (select *, (row_number() over (partition by session_id, question_id order by seq) = 1)::int as fresh, coalesce(is_correct, false)::int - coalesce(lag(coalesce(is_correct, false)::int) over (partition by session_id, question_id order by seq), 0) as change from graded),
    running as (select *, sum(fresh) over w as answered_count, sum(change) over w as correct_count from steps window w as (partition by session_id order by seq rows unbounded preceding))
    select seq, session_id, question_id, is_correct, standard_answer, answered_count, correct_count, total_count, case when answered_count >= total_count then 'COMPLETED' else 'IN_PROGRESS' end as status from running join session using (session_id)""",
)
def k12(t: Tables) -> DataFrame:
    return K.submit_results(t.graded_by_session, t.session).select("seq", "session_id", "question_id", "is_correct", "standard_answer", "answered_count", "correct_count", "total_count", "status")


_STATS = "select session_id, type, count(*) as total, count(*) filter (is_correct) as correct from listed l join question q on q.id = question_id left join record r using (session_id, question_id) group by 1, 2"
_WRONG_ITEMS = "select session_id, row_number() over (partition by session_id order by first_seq) as place, question_id, user_answer, type, stem, answer as standard_answer, analysis from record join question q on q.id = question_id where not is_correct"


@query("k13_type_stats", " " + _STATS)
def k13(t: Tables) -> DataFrame:
    return K.type_stats(t.listed, t.question, t.record)


@query("k14_wrong_items", " " + _WRONG_ITEMS)
def k14(t: Tables) -> DataFrame:
    return K.session_wrong_items(t.record_by_session, t.question)


# ---- reports


@query("r01_count_by_bank_type", " select bank_id, type, count(*) as cnt from question where bank_id in (select id from bank where file_name like '%.txt') group by 1, 2")
def r01(t: Tables) -> DataFrame:
    return R.count_by_bank_type(t.question, t.bank.where(F.col("file_name").endswith(".txt")))


@query("r02_count_chapters", " select o_custkey as bank_id, count(*) as cnt from orders join customer on c_custkey = o_custkey where c_acctbal > 0 group by 1")
def r02(t: Tables) -> DataFrame:
    """Customers as banks and their orders as chapters."""
    return R.count_chapters(t.read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("bank_id")), t.read("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id")))


_CHAPTERS = "select c.bank_id, c.id as chapter_id, name, sort, count(q.id) as question_count from chapter c left join question q on q.chapter_id = c.id group by all"


@query("r03_chapter_counts", " " + _CHAPTERS)
def r03(t: Tables) -> DataFrame:
    return R.chapters_with_counts(t.chapter, t.question)


_COUNTS = """, counts as (select b.id as bank_id, name, file_name, b.created_at, coalesce(single, 0) as single, coalesce(multiple, 0) as multiple, coalesce(true_false, 0) as true_false, coalesce(essay, 0) as essay, coalesce(fill_blank, 0) as fill_blank, coalesce(total, 0) as total, 9 as chapters
    from bank b left join (select bank_id, count(*) filter (type = 'SINGLE') as single, count(*) filter (type = 'MULTIPLE') as multiple, count(*) filter (type = 'TRUE_FALSE') as true_false, count(*) filter (type = 'ESSAY') as essay, count(*) filter (type = 'FILL_BLANK') as fill_blank, count(*) as total from question group by 1) q on q.bank_id = b.id)"""


@query("r04_bank_page", _COUNTS + ", f as (select *, count(*) over () as matches from counts where lower(name) like '%tion%' or lower(file_name) like '%tion%') select * from f order by created_at desc, bank_id desc limit 5")
def r04(t: Tables) -> DataFrame:
    return R.bank_page(t.bank, t.question, t.chapter, keyword=" TION ", size=5)


@query("r04_bank_seek", _COUNTS + ", f as (select * from counts where lower(name) like '%tion%') select * from f order by created_at desc, bank_id desc limit 4 offset 8")
def r04_seek(t: Tables) -> DataFrame:
    """The third page, from the last keys of the first two."""
    after = None
    for _ in range(2):
        after = P.last_key(P.page_after(R.banks_found(t.bank, "tion"), P.NEWEST, 4, after), P.NEWEST)
    return P.bank_page(t.bank, t.question, t.chapter, "tion", 4, after)


@query(
    "r05_bank_detail",
    _COUNTS + """, ch as (""" + _CHAPTERS + """) select counts.*, chapter_list, coalesce(open_wrong, 0) as open_wrong from counts
    left join (select bank_id, list({'sort': sort, 'chapter_id': chapter_id, 'name': name, 'question_count': question_count} order by sort) as chapter_list from ch group by 1) using (bank_id)
    left join (select bank_id, count(*) as open_wrong from wrong where resolved = 0 group by 1) using (bank_id)""",
)
def r05(t: Tables) -> DataFrame:
    return R.bank_detail(t.bank, t.question, t.chapter, t.wrong)


@query(
    "r06_question_page",
    ", f as (select q.*, count(*) over () as matches from question q where type = 'SINGLE' and lower(stem) like '%a%') select f.id, f.bank_id, stem, coalesce(c.name, '') as chapter_name, matches from f left join chapter c on c.id = chapter_id order by created_at desc, f.id desc limit 20 offset 20",
)
def r06(t: Tables) -> DataFrame:
    return R.question_page(t.question, t.chapter, kind="SINGLE", keyword="A", page=2).select("id", "bank_id", "stem", "chapter_name", "matches")


@query("r06_question_seek", ", f as (select * from question where bank_id % 2 = 1 and type = 'MULTIPLE') select f.id, f.bank_id, stem, coalesce(c.name, '') as chapter_name from f left join chapter c on c.id = chapter_id order by f.created_at desc, f.id desc limit 5 offset 15")
def r06_seek(t: Tables) -> DataFrame:
    """The fourth page of questions that were written in order."""
    rows = P.write_for_pages(t.question.where("bank_id % 2 = 1"), P.NEWEST, f"{I.work_dir(t.spark)}/pages-{uuid.uuid4().hex}")
    after = None
    for _ in range(3):
        after = P.last_key(P.page_after(R.questions_found(rows, kind="MULTIPLE"), P.NEWEST, 5, after), P.NEWEST)
    return P.question_page(rows, t.chapter, kind="MULTIPLE", size=5, after=after).select("id", "bank_id", "stem", "chapter_name")


@query("r07_list_banks", " select b.id, name, count(q.id) as question_count from bank b left join question q on q.bank_id = b.id group by all")
def r07(t: Tables) -> DataFrame:
    return R.list_banks(t.bank, t.question)


@query(
    "r08_search",
    """, s as (select c_custkey as query_id, case when c_custkey % 2 = 0 then upper(k) else k end as keyword, case c_custkey % 5 when 1 then 'tion_' || (c_custkey % 10) when 2 then ' ' end as bank_name,
      case c_custkey % 4 when 1 then 'SINGLE' when 2 then 'MULTIPLE' end as wanted, case c_custkey % 3 when 1 then 3 else 5 end as most
      from (select c_custkey, substr(stem, (1 + c_custkey % 9)::int, (2 + c_custkey % 7)::int) as k from customer join question on id = c_custkey)),
    h as (select query_id, most, row_number() over w as place, count(*) over (partition by query_id) as hits, q.id as question_id, type, stem, answer
      from s join question q on (wanted is null or wanted = type) and strip_accents(lower(stem)) like '%' || strip_accents(lower(trim(keyword))) || '%' join bank b on b.id = bank_id and (coalesce(trim(bank_name), '') = '' or contains(lower(b.name), lower(trim(bank_name))))
      where length(trim(keyword)) >= 2 window w as (partition by query_id order by q.id))
    select query_id, place, hits, question_id, case type when 'SINGLE' then '单选题' when 'MULTIPLE' then '多选题' when 'TRUE_FALSE' then '判断题' when 'ESSAY' then '简答题' when 'FILL_BLANK' then '填空题' else type end as type_name,
    case when length(stem) > 1000 then substr(stem, 1, 1000) || '…' else stem end as stem, case when trim(answer) = '' then '（本题未提供答案）' else '答案：' || answer end as answer_note from h where place <= most""",
)
def r08(t: Tables) -> DataFrame:
    """A keyword for every customer, cut from a stem; the index is written once and read."""
    i = F.col("query_id")
    stems = t.question.select(F.col("id").alias("query_id"), "stem")
    q = t.read("customer").select(F.col("c_custkey").alias("query_id")).join(stems, "query_id")
    word = F.substring(F.col("stem"), (1 + i % 9).cast("int"), (2 + i % 7).cast("int"))
    bank_name = F.when(i % 5 == 1, F.concat(F.lit("TION_"), (i % 10).cast("string"))).when(i % 5 == 2, " ")
    q = q.select("query_id", F.when(i % 2 == 0, F.upper(word)).otherwise(word).alias("keyword"), bank_name.alias("bank_name"), F.when(i % 4 == 1, " single ").when(i % 4 == 2, "多选题").when(i % 4 == 3, "no such type").alias("type"), F.when(i % 3 == 1, 3).alias("limit"))
    path = f"{I.work_dir(t.spark)}/search-index-{uuid.uuid4().hex}"
    S8.write_search_index(t.question, path)
    return S8.search_questions(q, t.question, t.bank, S8.read_search_index(t.spark, path))


_TYPE_NAME = "case {0} when 'SINGLE' then '单选题' when 'MULTIPLE' then '多选题' when 'TRUE_FALSE' then '判断题' when 'ESSAY' then '简答题' when 'FILL_BLANK' then '填空题' else {0} end"


@query(
    "r09_question_detail",
    f""" select q.id as question_id, {_TYPE_NAME.format("type")} as type_name, '《' || b.name || '》' as bank_name, coalesce(c.name, '无') as chapter_name, stem,
    coalesce(array_to_string(list_transform(options, lambda o: o.key || '．' || o.text), chr(10)), '') as option_lines, case when trim(answer) = '' then '（未提供）' else answer end as answer, coalesce(analysis, '（未提供）') as analysis,
    coalesce(array_to_string(knowledge_points, '、'), '无') as points from question q join bank b on b.id = q.bank_id left join chapter c on c.id = chapter_id""",
)
def r09(t: Tables) -> DataFrame:
    return R.question_detail(t.question, t.bank, t.chapter)


@query("r10_dashboard", " select (select count(*) from bank) as banks, (select count(*) from question) as questions")
def r10(t: Tables) -> DataFrame:
    return R.dashboard(t.bank, t.question)


_DAYS = "date_diff('day', date '1998-01-01', date)"


@query("r11_exam_countdown", f" select id, name, date, {_DAYS} as days_left, case when {_DAYS} <= 7 then 'red' when {_DAYS} <= 14 then 'orange' else 'green' end as level from exam")
def r11(t: Tables) -> DataFrame:
    return R.exam_countdown(t.exam, "1998-01-01")


@query("r11_nearest_exam", f" select date, id, name, {_DAYS} as days_left, case when {_DAYS} <= 7 then 'red' when {_DAYS} <= 14 then 'orange' else 'green' end as level from exam where {_DAYS} >= 0 order by date, id limit 1")
def r11_nearest(t: Tables) -> DataFrame:
    return R.nearest_exam(t.exam, "1998-01-01")


_ACC = "case when {a} > 0 then floor(({c}::float * 100::float / {a}::float)::float + 0.5::float)::int else 0 end"


@query(
    "r12_session_result",
    f""", st as ({_STATS}), wi as ({_WRONG_ITEMS}) select session_id, status, total_count, answered_count, correct_count, {_ACC.format(a="answered_count", c="correct_count")} as accuracy, type_stats, wrong_items from progress
    left join (select session_id, list({{'type': type, 'total': total, 'correct': correct}} order by type) as type_stats from st group by 1) using (session_id)
    left join (select session_id, list({{'place': place, 'question_id': question_id, 'user_answer': user_answer, 'standard_answer': standard_answer}} order by place) as wrong_items from wi group by 1) using (session_id)""",
)
def r12(t: Tables) -> DataFrame:
    """List and records are written once, in buckets by session: the three parts and the result join where they are."""
    types = t.question.select(F.col("id").alias("question_id"), "type")
    listed = t.bucketed(t.listed.select("session_id", "question_id").join(types, "question_id"), "listed", ["session_id"])
    record = t.bucketed(K.fold_records(t.graded_by_session, ("standard_answer",)), "record", ["session_id"])
    return R.session_result(K.complete_sessions(t.sessions(listed), record), K.type_stats(listed, t.question, record), K.session_wrong_items(record))


@query("r13_wrong_by_type", ", n as (select w.bank_id, type, count(*) as cnt from wrong w join question q on q.id = question_id where resolved = 0 group by 1, 2) select *, sum(cnt) over (partition by bank_id) as total, row_number() over (partition by bank_id order by cnt desc, type) as place from n")
def r13(t: Tables) -> DataFrame:
    return R.wrong_by_type(t.wrong, t.question)


@query("r14_wrong_by_chapter", " select chapter_id, count(*) as cnt, c.bank_id, name, sort from wrong w join question q on q.id = question_id join chapter c on c.id = chapter_id where resolved = 0 group by all")
def r14(t: Tables) -> DataFrame:
    return R.wrong_by_chapter(t.wrong, t.question, t.chapter)


@query("r15_wrong_count", " select bank_id, count(*) as open_wrong from wrong where resolved = 0 group by 1")
def r15(t: Tables) -> DataFrame:
    return R.wrong_count(t.wrong)


@query("r16_study_stats", f", n as (select bank_id, grouping(bank_id) = 1 as overall, sum(answered_count) as practiced, sum(correct_count) as correct from progress group by rollup (bank_id)) select bank_id, overall, practiced, correct, {_ACC.format(a='practiced', c='correct')} as accuracy from n")
def r16(t: Tables) -> DataFrame:
    return R.study_stats(t.progress)


@query("r17_recent_sessions", " select session_id, bank_id, status, b.name as bank_name from progress join bank b on b.id = bank_id order by session_id desc limit 20")
def r17(t: Tables) -> DataFrame:
    return R.recent_sessions(t.progress, t.bank, 50).select("session_id", "bank_id", "status", "bank_name")


# ---- scalar functions over derived columns


@query(
    "f_answer_functions",
    """ select id, upper(answer) as letters_in, array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_extract(answer, '[A-Za-z](?:[、,，;；/ 　和与及]*[A-Za-z])*'), '[A-Za-z]'))), '') as letters_raw,
    case when trim(answer) in ('A', 'B') then trim(answer) end as tf, case when length(stem) > 12 then substr(stem, 1, 12) || '…' else stem end as short, substr(stem, 1, 20) as title from question""",
)
def f_answers(t: Tables) -> DataFrame:
    q = t.question
    plain = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(T.letter_part(F.col("answer")), F.lit("([A-Za-z])"), 1))), "")
    return q.select("id", F.upper("answer").alias("letters_in"), plain.alias("letters_raw"), F.when(T.tf_key(F.col("answer")).isNotNull() & F.length(T.trim(F.col("answer"))).eqNullSafe(1), T.tf_key(F.col("answer"))).alias("tf"), T.truncate(F.col("stem"), 12).alias("short"), T.title_from(F.col("stem")).alias("title"))


@query(
    "f_failure_classes",
    f""", m as (select event_id, 'Call ' || event_id || ' of ' || upper(event_type) || ' failed: ' || case event_id % 5 when 0 then 'Unauthorized' when 1 then 'quota' when 2 then 'Rate Limit reached' when 3 then '连接超时' else '账户欠费' end as message from events)
    select event_id, case {" ".join(f"when {' or '.join(f'contains(lower(message), $${w}$$)' for w in words)} then '{told}'" for words, told in T.FAILURES)} end as reason,
    '[' || replace(message, 'failed', '***') || ']' as masked from m""",
)
def f_failures(t: Tables) -> DataFrame:
    e = F.col("event_id") % 5
    kind = F.when(e == 0, "Unauthorized").when(e == 1, "quota").when(e == 2, "Rate Limit reached").when(e == 3, "连接超时").otherwise("账户欠费")
    m = F.concat(F.lit("Call "), F.col("event_id").cast("string"), F.lit(" of "), F.upper("event_type"), F.lit(" failed: "), kind)
    rows = t.read("events").select("event_id", m.alias("m"))
    return rows.select("event_id", T.classify_failure(F.col("m")).alias("reason"), F.concat(F.lit("["), T.mask_secret(F.col("m"), F.lit("failed"), F.lit("")), F.lit("]")).alias("masked"))


@query("f_fingerprints", " select id, sha256(lower(regexp_replace(stem, '[\\s\\p{Z}\\p{P}]+', '', 'g')) || '||' || coalesce(array_to_string(list_transform(options, lambda o: o.key || '=' || lower(regexp_replace(o.text, '[\\s\\p{Z}\\p{P}]+', '', 'g'))), ';'), '') || '||' || lower(regexp_replace(answer, '[\\s\\p{Z}\\p{P}]+', '', 'g'))) as fingerprint from question")
def f_fingerprints(t: Tables) -> DataFrame:
    return t.question.select("id", T.fingerprint(F.col("stem"), F.col("options"), F.col("answer")).alias("fingerprint"))


@query(
    "f_json_repair",
    r""" select id, case id % 4 when 0 then '{"answer": "A", "analysis": "\\frac{1}{2} of ' || stem || '"}' when 1 then '{"analysis": "line \n and \" of ' || stem || '"}'
    when 2 then '{"analysis": "\u4e2d \\alpha of ' || stem || '"}' else '[{"analysis": "\\beta \b1 \/ of ' || stem || '"}]' end as repaired from question""",
)
def f_json_repair(t: Tables) -> DataFrame:
    """In a fence with an escape that JSON does not know, after some words with good escapes, a code point, an array."""
    k, n = F.col("id") % 4, F.col("stem")
    text = lambda before, after: F.concat(F.lit(before), n, F.lit(after))
    raw = (
        F.when(k == 0, text('```json\n{"answer": "A", "analysis": "\\frac{1}{2} of ', '"}\n```'))
        .when(k == 1, text('Sure:\n{"analysis": "line \\n and \\" of ', '"}'))
        .when(k == 2, text('{"analysis": "\\u4e2d \\alpha of ', '"}'))
        .otherwise(text(' [{"analysis": "\\beta \\b1 \\/ of ', '"}]'))
    )
    return t.question.select("id", T.repair_backslashes(T.strip_to_json(raw)).alias("repaired"))


# ---- sources


@query(
    "s01_bank_texts",
    """, f as (select id, id % 5 as style, '题型：单选题' || chr(10) || stem || chr(10) || '正确答案：' || answer || chr(10) as body from question)
    select id, case id % 2 when 0 then 'txt' else 'docx' end as ext, case when style = 4 then '' else body end as text, case when style = 4 then 40001 end as reject_code from f""",
)
def s01(t: Tables) -> DataFrame:
    """A file per question: UTF-8, with a byte-order mark and other line ends, GBK, with old line ends, or empty."""
    t.spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        body = F.concat(F.lit("题型：单选题\n"), "stem", F.lit("\n正确答案："), "answer", F.lit("\n"))
        style, dos = F.col("id") % 5, F.encode(F.regexp_replace(body, "\n", "\r\n"), "UTF-8")
        content = F.when(style == 0, F.encode(body, "UTF-8")).when(style == 1, F.concat(F.lit(b"\xef\xbb\xbf"), dos)).when(style == 2, F.encode(body, "GBK")).when(style == 3, F.encode(F.translate(body, "\n", "\r"), "UTF-8")).otherwise(F.lit(b""))
        files = t.question.select("id", F.concat(F.lit("/in/"), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, ".TXT").otherwise(".docx")).alias("path"), content.alias("content"))
    finally:
        t.spark.conf.set("spark.sql.legacy.javaCharsets", "false")
    gated = I.gate_uploads(I.decode_texts(files).withColumnRenamed("path", "file_name"))
    return gated.select(F.regexp_extract("file_name", "([0-9]+)", 1).cast("long").alias("id"), "ext", "text", "reject_code")


@query("s02_upload_gate", " select user_id, event_id, case when coalesce(octet_length(encode(props)), 0) = 0 then 40001 when event_id % 4 = 3 then 40002 end as reject_code from events")
def s02(t: Tables) -> DataFrame:
    e = t.read("events")
    ext = F.when(F.col("event_id") % 4 == 0, "a.TXT").when(F.col("event_id") % 4 == 1, "b.pdf").when(F.col("event_id") % 4 == 2, "c.d.docx").otherwise("e.exe")
    return I.gate_uploads(e.select("user_id", "event_id", ext.alias("file_name"), F.octet_length("props").alias("size"))).select("user_id", "event_id", "reject_code")


@query("s03_clean_text", " select doc_id, md5(replace(replace(case when doc_id % 3 = 0 then replace(replace(coalesce(text, ''), ' ', chr(9)), chr(9), chr(10)) else replace(coalesce(text, ''), ' ', chr(9)) end, chr(13) || chr(10), chr(10)), chr(13), chr(10))) as digest from documents")
def s03(t: Tables) -> DataFrame:
    ext = F.when(F.col("doc_id") % 3 == 0, "docx").otherwise("txt")
    d = t.read("documents").select("doc_id", ext.alias("ext"), F.translate(F.coalesce("text", F.lit("")), " ", "\t").alias("text"))
    return I.normalize_extracted_text(d).select("doc_id", F.md5("text").alias("digest"))


@query("s04_scanned", " select doc_id, coalesce(length(text) // (doc_id % 40 + 1) < 30, true) as scanned from documents")
def s04(t: Tables) -> DataFrame:
    d = t.read("documents").select("doc_id", "text", (F.col("doc_id") % 40 + 1).alias("pages"))
    return I.flag_scanned(d).select("doc_id", "scanned")


@query("s05_json_columns", " select id, options, case when id % 7 = 0 then [] else coalesce(knowledge_points, []) end as points from question")
def s05(t: Tables) -> DataFrame:
    q = t.question.select("id", F.to_json("options").alias("o"), F.when(F.col("id") % 7 == 0, "{broken").otherwise(F.to_json("knowledge_points")).alias("p"))
    return q.select("id", I.parse_options(F.col("o")).alias("options"), I.parse_string_list(F.col("p"), empty=True).alias("points"))


@query("s06_tables", " select id, bank_id, type, stem, options, answer, ai_status from question")
def s06(t: Tables) -> DataFrame:
    base = f"{I.work_dir(t.spark)}/tables-{uuid.uuid4().hex}"
    I.write_table(t.question, base, "question")
    return I.read_table(t.spark, base, "question").select("id", "bank_id", "type", "stem", "options", "answer", "ai_status")


@query("s07_distinct_files", " select min(doc_id) as doc_id, md5(coalesce(text, '')) as digest from documents group by 2")
def s07(t: Tables) -> DataFrame:
    d = t.read("documents").select("doc_id", F.format_string("%020d", "doc_id").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return I.dedup_files(d).select("doc_id", F.md5("content").alias("digest"))


# ---- documents to questions


def bank_documents(t: Tables) -> DataFrame:
    """Documents of up to GROUP questions of a bank, in three styles; answers at the end of the third.  Their number grows
    with the questions, their size does not."""
    known = F.when(F.col("type") == "LEGACY", "SINGLE").otherwise(F.col("type"))
    q = t.question.select(t.group.alias("doc_id"), "id", "bank_id", "chapter_id", known.alias("type"), "stem", "options", "answer")
    per = W.Window.partitionBy("doc_id")
    q = q.withColumn("n", F.row_number().over(per.orderBy("chapter_id", "id"))).withColumn("in_chapter", F.row_number().over(W.Window.partitionBy("doc_id", "chapter_id").orderBy("id")))
    name = F.concat(F.lit("章节"), F.col("chapter_id").cast("string"))
    n, style = F.col("n").cast("string"), F.col("bank_id") % 3
    option_lines = F.array_join(F.transform("options", lambda o: F.concat(o["key"], F.lit(". "), o["text"], F.lit("\n"))), "")
    inline = F.array_join(F.transform("options", lambda o: F.concat(F.lit(" "), o["key"], F.lit(". "), o["text"])), "")
    label, answer = T.type_label(F.col("type")), F.col("answer")
    head = F.when(F.col("in_chapter") == 1, F.when(style == 1, F.concat(F.lit("第一章 "), name, F.lit("\n"))).otherwise(F.concat(F.lit("【第 1 章】"), name, F.lit("\n")))).otherwise("")
    said = F.when(answer == "", "").otherwise(F.concat(F.lit("正确答案："), answer, F.lit("\n")))
    style0 = F.concat(F.lit("【第 "), n, F.lit(" 题】题型："), label, F.lit("\n题目："), "stem", F.lit("\n选项：\n"), option_lines, F.lit("我的答案：Z\n"), said)
    style1 = F.concat(F.lit("1．"), label, F.lit("\n（"), n, F.lit("）"), "stem", inline, F.lit("\n"), said)
    style2 = F.concat(n, F.lit(". "), "stem", F.lit("\n"), option_lines)
    rows = q.withColumn("part", F.concat(head, F.when(style == 0, style0).when(style == 1, style1).otherwise(style2)))
    rows = rows.withColumn("tail", F.when((style == 2) & (answer != ""), F.concat(n, F.lit(".【答案】"), answer, F.when(F.col("n") % 5 == 0, "\n\n").otherwise("\n"))).otherwise(""))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", c))), lambda x: x[c]), "")
    return rows.groupBy("doc_id").agg(F.concat(joined("part"), F.lit("\n"), joined("tail")).alias("text"))


_GROUP = f"(id // 25 // {GROUP} * 25 + bank_id)"
_PARSED = f", z as (select * replace (case when type = 'LEGACY' then 'SINGLE' else type end as type), {_GROUP} as doc_id, row_number() over (partition by {_GROUP} order by chapter_id, id) as no from question)"


@query(
    "p10_round_trip",
    _PARSED + " select doc_id, no, stem as raw_stem, options as raw_options, nullif(trim(answer), '') as raw_answer, '章节' || chapter_id as chapter_name, case when bank_id % 3 < 2 then " + _TYPE_NAME.format("type") + " end as raw_type from z",
)
def p10(t: Tables) -> DataFrame:
    return S.parse_documents(bank_documents(t)).select("doc_id", "no", "raw_stem", "raw_options", "raw_answer", "chapter_name", "raw_type")


@query("p11_no_questions", " select doc_id, 0 as questions, false as usable from documents")
def p11(t: Tables) -> DataFrame:
    d = t.read("documents").select("doc_id", "text")
    return S.route_documents(d, S.parse_documents(d))


@query("p11_routes", _PARSED + " select doc_id, count(*) as questions, true as usable from z group by 1")
def p11_routes(t: Tables) -> DataFrame:
    d = bank_documents(t)
    return S.route_documents(d, S.parse_documents(d))


@query(
    "p12_chunks",
    r""", t as (select doc_id, string_split(regexp_replace(coalesce(text, ''), '\n+$', ''), chr(10)) as lines from documents where regexp_replace(coalesce(text, ''), '\n+$', '') <> ''),
    l as (select doc_id, unnest(range(1, len(lines) + 1)) as no, unnest(lines) as line from t),
    f as (select *, length(line) + 1 as size, regexp_full_match(line, '[\s\p{Z}]*') as blank from l),
    w as (
      with recursive r as (
        select doc_id, 0::bigint as no, 0::bigint as size, 0 as chunk_no, 1::bigint as start, true as skip, '' as line from t
        union all
        select f.doc_id, f.no, case when r.size >= 2000 and f.blank then 0 when r.size >= 4000 then f.size else r.size + f.size end,
               r.chunk_no + (r.size >= 2000 and f.blank or r.size >= 4000)::int, case when r.size >= 2000 and f.blank or r.size >= 4000 then f.no else r.start end, r.size >= 2000 and f.blank, f.line
        from r join f on f.doc_id = r.doc_id and f.no = r.no + 1)
      select * from r where no > 0)
    select doc_id, chunk_no, min(start)::int as start_line, max(no)::int as end_line, string_agg(line || chr(10), '' order by no) filter (not skip) as text from w group by doc_id, chunk_no having count(*) filter (not skip) > 0""",
)
def p12(t: Tables) -> DataFrame:
    return S.chunk_documents(t.read("documents").select("doc_id", "text"))


# ---- building banks


def raw_questions(t: Tables) -> DataFrame:
    """Raw questions of each bank as the parser gives them, some without stem, answer or type, some odd."""
    k = F.expr("id div 25")
    stem = F.when(k % 17 == 0, " ").otherwise(F.concat(F.lit(" "), "stem", F.lit("\t")))
    kind = F.when(k % 13 == 0, None).otherwise(T.type_label(F.col("type")))
    odd = F.when(k % 19 == 0, F.array(F.lit("odd  line"), F.col("stem"))).otherwise(F.array().cast("array<string>"))
    chapter = F.when(k % 6 == 0, "  ").otherwise(F.concat(F.lit("章 "), (F.col("chapter_id") % 10).cast("string")))
    return t.question.select("bank_id", (k + 1).cast("int").alias("pos"), kind.alias("raw_type"), stem.alias("raw_stem"), F.col("options").alias("raw_options"), F.nullif("answer", F.lit("")).alias("raw_answer"), chapter.alias("chapter_name"), (k * 7 + 1).cast("int").alias("start_line"), odd.alias("suspicious"))


_RAW = """, raw as (select bank_id, (id // 25 + 1)::int as pos, case when id // 25 % 13 = 0 then null else type end as raw_type, case when id // 25 % 17 = 0 then '' else stem end as raw_stem, type, options, answer,
    case when id // 25 % 6 = 0 then '默认章节' else '章 ' || chapter_id % 10 end as name, id // 25 % 19 = 0 as odd, id // 25 * 7 + 1 as start_line, stem from question),
kinds as (select *, case when raw_type is not null and raw_type <> 'LEGACY' then raw_type when type = 'TRUE_FALSE' then 'TRUE_FALSE' when len(options) > 0 then case when len(list_distinct(regexp_extract_all(answer, '[A-Z]'))) > 1 then 'MULTIPLE' else 'SINGLE' end
    when answer <> '' then case when length(answer) <= 20 then 'FILL_BLANK' else 'ESSAY' end end as t from raw),
ch as (select bank_id, name, row_number() over (partition by bank_id order by min(pos)) as sort from raw group by 1, 2)"""


@query("b01_chapters", _RAW + " select * from ch")
def b01(t: Tables) -> DataFrame:
    return B.build_chapters(raw_questions(t))


@query(
    "b02_questions",
    _RAW + """ select kinds.bank_id, pos, name as chapter_name, sort as chapter_sort, t as type, raw_stem as stem, options,
    case when answer = '' then '' when t = 'SINGLE' then array_to_string(list_sort(list_distinct(regexp_extract_all(answer, '[A-Z]'))), '')[1] when t = 'MULTIPLE' then array_to_string(list_sort(list_distinct(regexp_extract_all(answer, '[A-Z]'))), '') else answer end as answer
    from kinds join ch using (bank_id, name) where raw_stem <> '' and t is not null""",
)
def b02(t: Tables) -> DataFrame:
    raw = raw_questions(t)
    return B.build_questions(raw, B.build_chapters(raw)).drop("ai_status", "ai_retry_count", "answer_source")


_FEW = "bank_id % 2 = 0 or raw_stem = '' or t is null"  # every other bank keeps nothing but what is left out


@query(
    "b03_import_report",
    _RAW + f""", few as (select *, raw_stem <> '' and t is not null as ok from kinds where {_FEW}), r as (
    select bank_id, count(*) as total, count(*) filter (ok) as inserted, count(*) filter (raw_stem = '') as skipped_no_stem, count(*) filter (raw_stem <> '' and t is null) as skipped_no_type from few group by 1),
    a as (select id as bank_id, coalesce(total, 0) as total, coalesce(inserted, 0) as inserted, coalesce(skipped_no_stem, 0) as skipped_no_stem, coalesce(skipped_no_type, 0) as skipped_no_type from (select id from bank union all select 99) left join r on bank_id = id)
    select *, inserted = 0 as failed, case when total = 0 then '{B.NOTHING_READ}' when inserted = 0 then printf('{B.UNUSABLE}', total, skipped_no_stem, skipped_no_type) end as message from a""",
)
def b03(t: Tables) -> DataFrame:
    banks = t.bank.select(F.col("id").alias("bank_id")).unionByName(t.spark.createDataFrame([(99,)], "bank_id long"))
    raw = raw_questions(t)
    kept = B.typed(raw).where((F.col("bank_id") % 2 == 0) | T.is_blank(F.col("raw_stem")) | F.col("type").isNull()).drop("type", "answer")
    return B.import_report(kept, banks)


@query(
    "b03_skipped_numbers",
    _RAW + """, s as (select distinct bank_id, pos // 4096 as part, pos from kinds where raw_stem = '' or t is null), g as (select *, pos - row_number() over (partition by bank_id, part order by pos) as run from s),
    r as (select bank_id, part, min(pos) as first, max(pos) as last from g group by bank_id, part, run)
    select bank_id, part::int as part, list({'first': first, 'last': last} order by first) as ranges from r group by all""",
)
def b03_skipped(t: Tables) -> DataFrame:
    return B.skipped_numbers(raw_questions(t))


@query("b04_ids", " select bank_id, id as question_id, row_number() over (order by bank_id, id) as new_id from question")
def b04(t: Tables) -> DataFrame:
    return B.assign_ids(t.question.select("bank_id", F.col("id").alias("question_id")), "bank_id", ["question_id"], name="new_id")


_LIST = "('[' || array_to_string({0}, ', ') || ']')"
_BAD = "list_filter(regexp_extract_all(upper(regexp_extract(answer, '^[A-Za-z,，、/;；]*')), '[A-Z]'), lambda x: not list_contains(list_transform(options, lambda o: o.key), x))"


@query(
    "b05_quality_issues",
    _RAW + f""", i as (
    select bank_id, pos as seq, '有可疑行' as kind, '原文第 ' || start_line || ' 行起的这道题里，有 2 行没被识别（可能是被截断的题干或异常选项）：odd line' as detail from raw where odd
    union all select bank_id, pos, '无题干', '没有提取到题干，入库时会被跳过' from raw where raw_stem = ''
    union all select bank_id, pos, '缺答案', '没提取到答案，不开 AI 时无法判分' from raw where raw_stem <> '' and answer = ''
    union all select bank_id, pos, '答案越界', '答案字母 ' || {_LIST.format(_BAD)} || ' 不在选项 ' || {_LIST.format("list_transform(options, lambda o: o.key)")} || ' 里（多半是切题切错了）' from raw where raw_stem <> '' and answer <> '' and len(options) > 0 and len({_BAD}) > 0
    union all select bank_id, pos, '选项不足', '题型判定为「' || case raw_type when 'SINGLE' then '单选题' else '多选题' end || '」但只有 ' || len(options) || ' 个选项' from raw where raw_stem <> '' and raw_type in ('SINGLE', 'MULTIPLE') and len(options) < 2)
    select * from i""",
)
def b05(t: Tables) -> DataFrame:
    return B.quality_issues(raw_questions(t))


@query(
    "b06_quality_summary",
    _RAW + """ select bank_id, count(*) filter (odd) as odd, count(*) filter (raw_stem = '') as no_stem, count(*) filter (raw_stem <> '' and answer = '') as no_answer from raw group by 1 having count(*) filter (odd or raw_stem = '' or answer = '') > 0""",
)
def b06(t: Tables) -> DataFrame:
    s = B.quality_summary(B.quality_issues(raw_questions(t)))
    return s.select("bank_id", F.col("有可疑行").alias("odd"), F.col("无题干").alias("no_stem"), F.col("缺答案").alias("no_answer"))


def _repeated(t: Tables) -> DataFrame:
    """Questions that repeat across banks: the stem without the bank's share of it."""
    return t.question.select("id", F.concat(F.lit("Stem, "), F.expr("cast(id % 50 as string)")).alias("stem"), "options", "answer")


_REP = ", rep as (select *, row_number() over (partition by id % 50, options, answer order by id) as copy from question)"


@query("b07_dedup_questions", _REP + " select id from rep where copy = 1")
def b07(t: Tables) -> DataFrame:
    return B.dedup_questions(_repeated(t), "id").select("id")


@query(
    "b08_merge_corpora",
    _REP + """, ab as (select 0 as c, * from rep where id % 3 <> 0 union all select 1 as c, * from rep where id % 3 <> 1)
    select id from ab qualify row_number() over (partition by id % 50, options, answer order by c, id) = 1""",
)
def b08(t: Tables) -> DataFrame:
    r = _repeated(t)
    return B.merge_corpora(r.where("id % 3 <> 0"), r.where("id % 3 <> 1"), "id").select("id")


@query(
    "b09_task_status",
    """, s as (select user_id, arg_max(event_type, event_id) as status, arg_max((event_id % 100)::int, event_id) as progress from events where event_type <> 'click' group by 1), ids as (select distinct user_id from events),
    st as (select user_id, count(*) as n from events group by 1)
    select ids.user_id::varchar as task_id, coalesce(s.status, case when ids.user_id % 2 = 0 then 'SUCCESS' end, 'FAILED') as status, coalesce(s.progress, case when ids.user_id % 2 = 0 then 100 end, 0) as progress,
    case when s.user_id is null and ids.user_id % 2 = 1 then '任务不存在' end as error_message from ids left join s using (user_id)""",
)
def b09(t: Tables) -> DataFrame:
    e = t.read("events").withColumn("task_id", F.col("user_id").cast("string"))
    snaps = e.where("event_type <> 'click'").select("task_id", F.col("event_id").alias("at"), F.col("event_type").alias("status"), (F.col("event_id") % 100).cast("int").alias("progress"))
    stored = e.where("user_id % 2 = 0").select("task_id").distinct().select("task_id", F.lit("SUCCESS").alias("status"), F.lit(100).alias("progress"))
    return B.task_status(e.select("task_id").distinct(), snaps, stored)


@query("b10_enrich_counts", " select bank_id, count(*) filter (ai_status = 'DONE') as done, count(*) filter (ai_status = 'FAILED') as failed, count(*) filter (ai_status = 'PENDING') as pending from question group by 1")
def b10(t: Tables) -> DataFrame:
    return B.enrich_counts(t.question)


_LEFT = """ select 'bank' as name, id as a, 0 as b from bank union all select 'chapter', id, bank_id from chapter union all select 'question', id, bank_id from question union all select 'practice_session', session_id, bank_id from session
    union all select 'practice_session_question', session_id, question_id from listed union all select 'practice_record', session_id, question_id from record union all select 'wrong_question', bank_id, question_id from wrong"""
_KEYS = {"bank": ("id", None), "chapter": ("id", "bank_id"), "question": ("id", "bank_id"), "practice_session": ("session_id", "bank_id"), "practice_session_question": ("session_id", "question_id"), "practice_record": ("session_id", "question_id"), "wrong_question": ("bank_id", "question_id")}


def bank_tables(t: Tables) -> dict[str, DataFrame]:
    """All tables; attempts are graded once, and records and the wrong book are folded from what was written of them."""
    t.__dict__["graded"] = t.written(t.graded.drop("type", "standard_answer"), "graded")
    return {"bank": t.bank, "chapter": t.chapter, "question": t.question, "practice_session": t.session, "practice_record": t.record, "practice_session_question": t.listed, "wrong_question": t.wrong}


def all_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """The keys of all rows of all seven tables."""
    return reduce(DataFrame.unionByName, [tables[n].select(F.lit(n).alias("name"), F.col(a).cast("long").alias("a"), (F.col(b) if b else F.lit(0)).cast("long").alias("b")) for n, (a, b) in _KEYS.items()])


_GONE = ", gone as (select id from bank where file_name like '%.pdf'), keys as (" + _LEFT + ")"
_OF_GONE = """ select * from keys where case name when 'bank' then a not in (from gone) when 'wrong_question' then a not in (from gone) when 'chapter' then b not in (from gone) when 'question' then b not in (from gone) when 'practice_session' then b not in (from gone)
    else a not in (select session_id from session where bank_id in (from gone)) end"""


@query("b11_delete_banks", _GONE + _OF_GONE)
def b11(t: Tables) -> DataFrame:
    return all_keys(B.delete_banks(bank_tables(t), t.bank.where(F.col("file_name").endswith(".pdf"))))


@query("b11_stored_banks", _GONE + _OF_GONE)
def b11_stored(t: Tables) -> DataFrame:
    """The same by dropping folders."""
    store = BankStore(t.spark, f"{I.work_dir(t.spark)}/banks-{uuid.uuid4().hex}")
    store.write(bank_tables(t))
    store.delete_banks([r[0] for r in t.bank.where(F.col("file_name").endswith(".pdf")).select("id").collect()])
    return all_keys({n: store.read(n) for n in store.names()})


@query(
    "b11_delete_chapters",
    """, gone as (select id from chapter where sort = 2) select session_id, question_id, is_correct from record join question q on q.id = question_id where chapter_id not in (from gone)""",
)
def b11_chapters(t: Tables) -> DataFrame:
    left = B.delete_chapters({"chapter": t.chapter, "question": t.question, "practice_record": t.record}, t.chapter.where("sort = 2"))
    return left["practice_record"].select("session_id", "question_id", "is_correct")


@query(
    "b11_stored_chapters",
    ", gone as (select id from chapter where id % 20 = 1), lost as (select id from question where chapter_id in (from gone)), keys as (" + _LEFT + """)
    select * from keys where case name when 'chapter' then a not in (from gone) when 'question' then a not in (from lost) when 'bank' then true when 'practice_session' then true else b not in (from lost) end""",
)
def b11_stored_chapters(t: Tables) -> DataFrame:
    """One chapter of every other bank, in the folders of these banks."""
    store = BankStore(t.spark, f"{I.work_dir(t.spark)}/banks-{uuid.uuid4().hex}")
    store.write(bank_tables(t))
    store.delete_chapters([r[0] for r in t.chapter.where("id % 20 = 1").select("id").collect()])
    return all_keys({n: store.read(n) for n in store.names()})


# ---- model material and results


@query(
    "m01_summary_material",
    f""", n as (select *, row_number() over (partition by bank_id order by id) as n, count(*) over (partition by bank_id) as total from question)
    select bank_id, string_agg(n || '. [' || {_TYPE_NAME.format("type")} || '] ' || stem || case when answer = '' then '（本题未提供答案）' else '　答案：' || answer end || chr(10), '' order by n) as material, count(*) as used, total, total > count(*) as cut from n where n <= 300 group by bank_id, total""",
)
def m01(t: Tables) -> DataFrame:
    return M.summary_material(t.question)


@query(
    "m02_mistake_material",
    f""", r as (select *, row_number() over (partition by bank_id order by wrong_count desc, id) as n from wrong where resolved = 0)
    select r.bank_id, string_agg(n || '. [' || {_TYPE_NAME.format("type")} || '] ' || stem || '　正确答案：' || case when answer = '' then '（空）' else answer end || '　学生答案：' || user_answer || '　答错 ' || wrong_count || ' 次' || chr(10), '' order by n) as material, count(*) as used
    from r join question q on q.id = question_id where n <= 100 group by 1""",
)
def m02(t: Tables) -> DataFrame:
    return M.mistake_material(t.wrong, t.question)


_RULE = "case type when 'SINGLE' then 'answer 必须是单个大写字母，例如 A。' when 'MULTIPLE' then 'answer 必须是多个大写字母、用英文逗号分隔并升序，例如 A,C。' when 'TRUE_FALSE' then 'answer 只能是 A（正确）或 B（错误）。' when 'FILL_BLANK' then 'answer 是各空答案，多个空用中文分号「；」分隔。' else 'answer 是参考答案文本。' end"


@query(
    "m03_enrich_prompts",
    f""" select id as question_id, '题型：' || type || chr(10) || '题干：' || stem || chr(10) || case when len(options) > 0 then '选项：[' || array_to_string(list_transform(options, lambda o: '{{"key":"' || o.key || '","text":"' || o.text || '"}}'), ',') || ']' || chr(10) else '' end || '标准答案：' || case when answer = '' then '（题目文件里没有提供，请你解出来）' else answer end || chr(10) || {_RULE} as prompt from question where ai_status <> 'DONE'""",
)
def m03(t: Tables) -> DataFrame:
    return M.enrich_prompts(t.question)


def model_outputs(t: Tables) -> DataFrame:
    """What a model might say about the questions that are not enriched: mostly good JSON, some broken, some errors."""
    k = F.expr("id div 25")
    good = F.concat(F.lit('{"answer": "'), F.when(F.col("type") == "TRUE_FALSE", "对").when(F.col("type") == "MULTIPLE", "c,a").otherwise("b"), F.lit('", "analysis": " about '), F.when(k % 5 == 3, F.lit("\\frac ")).otherwise(""), "stem", F.lit(' "}'))
    raw = F.when(k % 7 == 0, F.lit('{"answer": "A", "analy')).otherwise(good)
    error = F.when(k % 9 == 0, F.when(F.col("bank_id") % 4 == 0, "HTTP 401").when(F.col("bank_id") % 4 == 1, "429 insufficient quota").when(F.col("bank_id") % 4 == 2, "429 rate limit").otherwise("connection reset"))
    return t.question.where("ai_status <> 'DONE'").select(F.col("id").alias("question_id"), raw.alias("raw_text"), error.alias("error"))


_RES = """, o as (select *, id // 25 as k from question where ai_status <> 'DONE'),
res as (select id as question_id, bank_id, case when k % 9 <> 0 and k % 7 <> 0 then 'about ' || case when k % 5 = 3 then '\\frac ' else '' end || stem end as analysis,
    case when k % 9 <> 0 and k % 7 <> 0 and answer = '' then case type when 'TRUE_FALSE' then 'A' when 'MULTIPLE' then 'A,C' when 'SINGLE' then 'B' else 'b' end end as answer,
    case when k % 9 = 0 then case bank_id % 4 when 0 then 'HTTP 401' when 1 then '429 insufficient quota' when 2 then '429 rate limit' else 'connection reset' end when k % 7 = 0 then 'AI 没有返回可用的解析内容' end as error from o)"""


@query("m07_enrich_results", _RES + " select *, answer is not null as answer_from_ai from res")
def m07(t: Tables) -> DataFrame:
    return M.parse_enrich_results(model_outputs(t), t.question)


@query(
    "m08_apply_enrichment",
    _RES + """ select id, case when r.question_id is not null and error is null then r.analysis else q.analysis end as analysis, coalesce(r.answer, q.answer) as answer, case when r.answer is not null then 'AI' end as answer_source,
    case when r.question_id is null then ai_status when error is null then 'DONE' else 'FAILED' end as ai_status, case when r.question_id is null then ai_error else error end as ai_error, ai_retry_count + (error is not null)::int as ai_retry_count from question q left join res r on r.question_id = q.id""",
)
def m08(t: Tables) -> DataFrame:
    r = M.parse_enrich_results(model_outputs(t), t.question)
    return M.apply_enrichment(t.question, r, F.lit("2024-06-01").cast("timestamp")).select("id", "analysis", "answer", "answer_source", "ai_status", "ai_error", "ai_retry_count")


_OUT = _RES + """, oc as (select bank_id, count(*) as total, count(*) filter (error is not null) as failed, case when count(*) filter (error like 'HTTP%' or error like '429%') > 0 then case bank_id % 4 when 0 then 'AI 账号鉴权失败，请到「设置」页检查 API Key 是否填写正确' when 1 then 'AI 账户余额不足或配额已用完，请充值后重试' else 'AI 请求过于频繁被限流，请稍等几分钟再重试' end end as systemic_reason from res group by 1)"""


@query("m09_enrich_outcome", _OUT + " select *, 'AI 解析中断：' || systemic_reason || '。已完成 ' || (total - failed) || ' 道题的解析（可正常使用），还有 ' || failed || ' 道未解析，处理后重新上传即可补齐。' as message from oc")
def m09(t: Tables) -> DataFrame:
    return M.enrich_outcome(M.parse_enrich_results(model_outputs(t), t.question))


@query(
    "m09_back_to_pending",
    _OUT + """ select q.id, case when res.question_id is null then ai_status when error is null then 'DONE' when systemic_reason is not null then 'PENDING' else 'FAILED' end as ai_status from question q left join res on res.question_id = q.id left join oc on oc.bank_id = q.bank_id""",
)
def m09_pending(t: Tables) -> DataFrame:
    r = M.parse_enrich_results(model_outputs(t), t.question)
    return M.unmark_retryable(M.apply_enrichment(t.question, r, F.lit("2024-06-01").cast("timestamp")), r, M.enrich_outcome(r)).select("id", "ai_status")


def extracted(t: Tables) -> DataFrame:
    """Model outputs that hold up to GROUP questions of a bank each: an object with an array after other fields, in a code fence."""
    q = F.struct(F.concat(F.lit(" "), F.lit("c1")).alias("chapter"), F.lit("单选题").alias("type"), F.when(F.col("id") % 3 == 0, " ").otherwise(F.col("stem")).alias("stem"), F.transform("options", lambda o: F.struct(F.lower(o["key"]).alias("key"), o["text"].alias("content"))).alias("options"), F.when(F.col("id") % 4 == 1, "Z").otherwise(F.col("answer")).alias("answer"))
    rows = t.question.groupBy(t.group.alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("id", q.alias("q")))).alias("all"))
    return rows.select(F.col("doc_id").alias("id"), F.concat(F.lit('Here:\n{"note": "x", "n": 2, "items": '), F.to_json(F.transform("all", lambda x: x["q"])), F.lit("}\n```")).alias("raw_text"))


@query(
    "m05_model_questions",
    f""", x as (select {_GROUP} as id, row_number() over (partition by {_GROUP} order by id) - 1 as place, id as qid, stem, options, case when id % 4 = 1 then 'Z' else answer end as a from question),
    y as (select *, len(options) > 0 and length(a) <= 20 and regexp_full_match(a, '[A-Za-z、,，;；/ ]*') and len(regexp_extract_all(upper(a), '[A-Z]')) > 0 and len(list_filter(regexp_extract_all(upper(a), '[A-Z]'), lambda c: not list_contains(['A', 'B', 'C', 'D'][1:len(options)], c))) > 0 as bad from x)
    select id, place, '单选题' as raw_type, stem as raw_stem, options as raw_options, case when not bad then nullif(trim(a), '') end as raw_answer, 'c1' as chapter_name, count(*) filter (qid % 3 = 0) over (partition by id) as no_stem, 0 as bad_option, count(*) filter (bad and qid % 3 <> 0) over (partition by id) as bad_answer from y qualify qid % 3 <> 0""".replace("from y qualify", "from (select * from y) qualify"),
)
def m05(t: Tables) -> DataFrame:
    return M.validate_model_questions(M.parse_model_questions(extracted(t)))


@query("m06_chunk_status", f" select distinct {_GROUP} as id, case when {_GROUP} % 5 = 0 then 'AI 输出被截断' when {_GROUP} % 7 = 1 then 'AI 返回了空内容' end as reason from question")
def m06(t: Tables) -> DataFrame:
    i = F.col("id")
    parsed = M.parse_model_questions(extracted(t)).where((i % 7 != 1) | (i % 5 == 0)).withColumn("finish_reason", F.when(i % 5 == 0, "LENGTH").otherwise("stop"))
    chunks = bank_documents(t).select(F.col("doc_id").alias("id"), "doc_id", F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), "text")
    return M.chunk_status(chunks, parsed, M.validate_model_questions(parsed)).select("id", "reason")


#: Model outputs of eight questions of a bank each: an object, an array, none, a cut one, an object without array, an empty array.
_FORMS = ", c as (select id // 200 * 25 + bank_id as id, bank_id as doc_id, min(id // 200) as place, count(*) as n, (id // 200 + bank_id) % 6 as form from question group by 1, 2, 5)"
_NO_ARRAY = "'AI 返回的 JSON 里没有题目数组：{\"note\": \"none\", \"n\": ' || id || '}'"


def model_chunks(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Chunks of eight questions, and what a model returned for them."""
    q = F.struct(F.lit("单选题").alias("type"), "stem", F.lit("A").alias("answer"))
    rows = t.question.groupBy(F.expr("id div 200 * 25 + bank_id").alias("id"), F.col("bank_id").alias("doc_id"), F.expr("id div 200").alias("place")).agg(F.to_json(F.array_sort(F.collect_list(q))).alias("array"))
    form = (F.col("place") + F.col("doc_id")) % 6
    head = F.when(F.col("id") % 2 == 1, "1. a question\n").otherwise("no question here\n")
    chunks = rows.select("id", "doc_id", (F.col("place") * 10 + 1).cast("int").alias("start_line"), (F.col("place") * 10 + 10).cast("int").alias("end_line"), head.alias("text"))
    raw = (
        F.when(form == 0, F.concat(F.lit('```json\n{"note": "x", "items": '), "array", F.lit("}\n```")))
        .when(form == 4, F.concat(F.lit('So:\n{"note": "none", "n": '), F.col("id").cast("string"), F.lit("}")))
        .when(form == 5, " [] ")
        .otherwise(F.concat(F.lit("Here they are: "), "array"))
    )
    outputs = rows.where(form != 2).select("id", raw.alias("raw_text"), F.when(form == 3, "Length").otherwise("stop").alias("finish_reason"))
    return chunks, outputs


@query("m04_model_arrays", _FORMS + f" select id, case when form = 4 then null when form = 5 then 0 else n end as questions, case when form = 4 then {_NO_ARRAY} end as error from c where form <> 2")
def m04(t: Tables) -> DataFrame:
    return M.parse_model_questions(model_chunks(t)[1]).select("id", F.when(F.col("questions").isNotNull(), F.size("questions")).cast("long").alias("questions"), "error")


@query(
    "m06_chunk_failures",
    _FORMS + f""", r as (select *, case when form = 2 then 'AI 返回了空内容' when form = 3 then 'AI 输出被截断' when form = 4 then {_NO_ARRAY} when form = 5 and id % 2 = 1 then '这一块原文里有题号，但 AI 没抽出任何题目' end as reason from c)
    select id, doc_id, (place * 10 + 1)::int as start_line, (place * 10 + 10)::int as end_line, reason, 'AI 抽取题目失败（原文第 ' || (place * 10 + 1) || '~' || (place * 10 + 10) || ' 行）：' || reason as message, bool_or(reason is not null) over (partition by doc_id) as doc_failed from r""",
)
def m06_failures(t: Tables) -> DataFrame:
    chunks, outputs = model_chunks(t)
    parsed = M.parse_model_questions(outputs)
    return M.chunk_status(chunks, parsed, M.validate_model_questions(parsed))


@query(
    "m10_summary_plan",
    """, r as (select case when id = 3 then 99 else id end as bank_id, id % 4 = 0 as force, id from bank) select bank_id, force, case when bank_id = 99 then 40401 end as reject_code, bank_id <> 99 and bank_id % 2 = 0 and not force as from_cache, bank_id <> 99 and not (bank_id % 2 = 0 and not force) as needs_model from r""",
)
def m10(t: Tables) -> DataFrame:
    r = t.bank.select(F.when(F.col("id") == 3, 99).otherwise(F.col("id")).cast("long").alias("bank_id"), (F.col("id") % 4 == 0).alias("force"))
    return M.summary_plan(r, t.bank, t.bank.where("id % 2 = 0").select(F.col("id").alias("bank_id")), t.question)


@query(
    "m11_upsert_summaries",
    """ select case when id % 2 = 0 then id + 100 end as id, id as bank_id, name as bank_name, case when id % 3 = 0 then ['new'] when id % 2 = 0 then ['old'] end as highlights, case when id % 2 = 0 then timestamp '2024-01-01' else timestamp '2024-06-01' end as created_at, case when id % 3 = 0 then timestamp '2024-06-01' else timestamp '2024-02-01' end as generated_at from (select c_custkey as id, c_name as name from customer) where id % 2 = 0 or id % 3 = 0""",
)
def m11(t: Tables) -> DataFrame:
    """Customers as banks."""
    b = t.read("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    none = F.lit(None).cast("array<string>")
    lists = lambda v: [F.array(F.lit(v)).alias("highlights"), *[none.alias(c) for c in M.SUMMARY_LISTS[1:]]]
    old = b.where("id % 2 = 0").select((F.col("id") + 100).alias("id"), F.col("id").alias("bank_id"), *lists("old"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit("2024-02-01").cast("timestamp").alias("updated_at"))
    new = b.where("id % 3 = 0").select(F.col("id").alias("bank_id"), *lists("new"))
    return M.upsert_summaries(old, new, b, F.lit("2024-06-01").cast("timestamp")).select("id", "bank_id", "bank_name", "highlights", "created_at", "generated_at")


# ---- chat


@query(
    "c01_context",
    """, r as (select *, row_number() over w as rn, sum(length(content)) over (w rows unbounded preceding) as total from chat window w as (partition by session_id order by created_at desc, id desc))
    select session_id, id, role, content, row_number() over (partition by session_id order by created_at, id) as place from r where rn <= 5 and (rn = 1 or total <= 1500) and content <> '' and role in ('user', 'assistant')""".replace(
        "(w rows unbounded preceding)", "(partition by session_id order by created_at desc, id desc rows unbounded preceding)"
    ),
)
def c01(t: Tables) -> DataFrame:
    return C.context_messages(t.chat, max_messages=5, max_chars=1500).select("session_id", "id", "role", "content", "place")


@query("c02_message_page", ", f as (select *, count(*) over () as matches from chat where session_id = 3) select id, role, content, matches from f order by created_at, id limit 3 offset 3")
def c02(t: Tables) -> DataFrame:
    return C.message_page(t.chat, 3, page=2, size=3).select("id", "role", "content", "matches")


@query("c02_message_seek", " select id, role, content from chat where session_id = (select session_id from chat group by 1 order by count(*) desc, 1 limit 1) order by created_at, id limit 2 offset 2")
def c02_seek(t: Tables) -> DataFrame:
    """The second page of the longest session."""
    longest = t.chat.groupBy("session_id").count().orderBy(F.desc("count"), "session_id").first()
    session = longest["session_id"] if longest else -1
    after = P.last_key(P.message_page(t.chat, session, 2), P.OLDEST)
    return P.message_page(t.chat, session, 2, after).select("id", "role", "content")


_CHAT_ROLL = """, u as (select session_id, count(*) as message_count, max(created_at) as updated_at, arg_min(content, id) filter (role = 'user') as first from chat group by 1),
roll as (select session_id as id, case when session_id % 2 = 0 then 'kept ' || session_id else coalesce(substr(regexp_replace(first, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), 1, 20), ' ') end as title, message_count, updated_at from u)"""


def chat_sessions(t: Tables) -> DataFrame:
    s = F.col("session_id")
    return t.chat.select("session_id").distinct().select(s.alias("id"), F.when(s % 2 == 0, F.concat(F.lit("kept "), s.cast("string"))).otherwise(" ").alias("title"), F.lit("2020-01-01").cast("timestamp").alias("updated_at"))


@query("c03_chat_rollup", _CHAT_ROLL + " select * from roll")
def c03(t: Tables) -> DataFrame:
    return C.rollup_chat_sessions(chat_sessions(t), t.chat)


@query("c04_chat_sessions", _CHAT_ROLL + " select id, updated_at from roll")
def c04(t: Tables) -> DataFrame:
    return C.list_chat_sessions(C.rollup_chat_sessions(chat_sessions(t), t.chat)).select("id", "updated_at")


@query("c05_delete_chats", " select id from chat where session_id not in (select session_id from chat where role = 'system')")
def c05(t: Tables) -> DataFrame:
    gone = t.chat.where("role = 'system'").select(F.col("session_id").alias("id")).distinct()
    return C.delete_chat_sessions(chat_sessions(t), t.chat, gone)[1].select("id")


# ---- counts that are kept


def kept_counts(t: Tables) -> CountStore:
    """Three batches: most questions and chapters; the rest, and questions that change type or chapter; wrong-book rows of which some are resolved."""
    store = CountStore(t.spark, f"{I.work_dir(t.spark)}/counts-{uuid.uuid4().hex}", buckets=8)
    q = t.written(t.question.select("id", "bank_id", "chapter_id", "type"), "question")
    before = q.where("id % 4 <> 0").withColumn("type", F.when(F.col("id") % 5 == 1, "ESSAY").otherwise(F.col("type"))).withColumn("chapter_id", F.when(F.col("id") % 7 == 1, F.col("bank_id") * 10).otherwise(F.col("chapter_id")))
    changed = F.col("id") % 5 == 1
    moved = F.col("id") % 7 == 1
    came = lambda df: df.withColumn("sign", F.lit(1))
    store.add([question_counts(came(before)), chapter_counts(came(t.chapter))], 0)
    store.add([question_counts(signed(before.where(changed | moved), q.where((changed | moved) & (F.col("id") % 4 != 0)).unionByName(q.where("id % 4 = 0"))))], 1)
    wrong = t.written(t.wrong.join(q.select(F.col("id").alias("question_id"), "type", "chapter_id"), "question_id"), "wrong")
    store.add([wrong_counts(came(wrong.withColumn("resolved", F.lit(0))))], 2)
    store.add([wrong_counts(signed(wrong.where("resolved = 1").withColumn("resolved", F.lit(0)), wrong.where("resolved = 1")))], 3)
    return store


@query("r01_kept_counts", " select bank_id, type, count(*) as cnt from question where bank_id in (select id from bank where id % 3 <> 0) group by 1, 2")
def r01_kept(t: Tables) -> DataFrame:
    return kept_counts(t).by_bank_type(t.bank.where("id % 3 <> 0"))


@query("r05_kept_counts", _COUNTS + " select counts.*, coalesce(open_wrong, 0) as open_wrong from counts left join (select bank_id, count(*) as open_wrong from wrong where resolved = 0 group by 1) using (bank_id)")
def r05_kept(t: Tables) -> DataFrame:
    return kept_counts(t).bank_counts(t.bank)


@query("r13_kept_counts", " select w.bank_id, type, count(*) as cnt from wrong w join question q on q.id = question_id where resolved = 0 group by 1, 2")
def r13_kept(t: Tables) -> DataFrame:
    return kept_counts(t).wrong_by_type()


# ---- streams, run to the end of what is there


class StreamRun:
    """The attempts in three times as many files as a batch takes, read as a stream of three batches, and folders for its
    results.  A session's attempts are spread over all files, so later batches bring earlier attempts of known sessions."""

    def __init__(self, t: Tables):
        self.t, self.spark = t, t.spark
        self.dir = f"{I.work_dir(t.spark)}/stream-{uuid.uuid4().hex}"
        self.buckets = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
        # each task deals its attempts to three files, so they need not travel for it
        t.attempt.withColumn("part", F.pmod(F.xxhash64("seq"), F.lit(3))).write.partitionBy("part").parquet(f"{self.dir}/in")
        files = -(-len(t.spark.read.parquet(f"{self.dir}/in").inputFiles()) // 3)
        # what attempts are checked against is written once, in buckets: a batch brings its attempts there
        session, self.listed = self.put(t.requests.select("session_id"), "session", "session_id"), self.put(t.listed.select("session_id", "question_id"), "listed", "session_id")
        question = self.put(t.question.select("id", "bank_id", "type", "answer"), "question", "id")
        self.attempts = A.read_attempts(t.spark, f"{self.dir}/in", max(1, files))
        self.graded = A.graded_stream(self.attempts, session, question, self.listed)
        self.grade = lambda df: K.grade_batch(df, session, question, self.listed)

    def put(self, df: DataFrame, name: str, by: str) -> DataFrame:
        return I.write_bucketed(df, f"{self.dir}/{name}", [by], self.buckets)

    def updates(self, stream: DataFrame, mode: str = "update") -> DataFrame:
        """What the stream gave, with the number of the batch."""
        out = f"{self.dir}/out"
        write = lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)
        self.run(stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{self.dir}/cp").trigger(availableNow=True))
        return self.spark.read.parquet(out)

    def run(self, query) -> None:
        with I.settings(self.spark, I.CO_PARTITIONED):
            query.start().awaitTermination()


@query("t01_graded_stream", " select seq, session_id, question_id, is_correct from graded")
def t01(t: Tables) -> DataFrame:
    run = StreamRun(t)
    return run.updates(run.graded, "append").select("seq", "session_id", "question_id", "is_correct")


@query("t02_record_stream", " select * from record")
def t02(t: Tables) -> DataFrame:
    run = StreamRun(t)
    store = A.RecordStore(t.spark, f"{run.dir}/records", run.buckets)
    run.run(A.record_stream(run.attempts, store, f"{run.dir}/cp", run.grade))
    return store.records().drop("last_seq")


@query("t03_progress_stream", " select session_id, answered_count, correct_count, total_count, completed_at, (status = 'COMPLETED')::bigint as completions from progress where answered_count > 0")
def t03(t: Tables) -> DataFrame:
    """The current counts, and how many events say that a session is completed."""
    run = StreamRun(t)
    store = A.ProgressStore(t.spark, f"{run.dir}/progress", run.put(t.sessions(run.listed), "totals", "session_id"), run.buckets)
    run.run(A.progress_stream(run.attempts, store, f"{run.dir}/cp", run.grade))
    events = store.completions().groupBy("session_id").agg(F.count(F.lit(1)).alias("completions"))
    return store.progress.rows().drop("completed_in").join(events, "session_id", "left").withColumn("completions", F.coalesce("completions", F.lit(0)))


@query("t04_wrong_book_stream", " select * from wrong")
def t04(t: Tables) -> DataFrame:
    run = StreamRun(t)
    table = KeyedTable(t.spark, f"{run.dir}/wrong", A.WRONG, ["bank_id", "question_id"])
    run.run(upsert_stream(A.wrong_book_stream(run.graded), table, f"{run.dir}/cp"))
    return table.rows().withColumnRenamed("first_wrong_seq", "id")
