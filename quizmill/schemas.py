"""The tables of a question bank, with explicit types; times are timestamps in UTC."""

from __future__ import annotations

from pyspark.sql import types as T

OPTION = "struct<key:string,text:string>"

DDL = {
    "bank": "id long, name string, file_name string, file_type string, created_at timestamp, updated_at timestamp",
    "chapter": "id long, bank_id long, name string, sort int, created_at timestamp",
    "question": f"id long, bank_id long, chapter_id long, type string, stem string, options array<{OPTION}>, answer string, analysis string, knowledge_points array<string>, ai_status string, ai_error string, ai_retry_count int, answer_source string, ai_enriched_at timestamp, created_at timestamp",
    "practice_session": "id long, bank_id long, mode string, question_type string, chapter_id long, status string, total_count int, answered_count int, correct_count int, session_source string, completed_at timestamp, created_at timestamp",
    "practice_session_question": "session_id long, question_id long, sort int",
    "practice_record": "id long, session_id long, question_id long, user_answer string, is_correct boolean, created_at timestamp, updated_at timestamp",
    "wrong_question": "id long, bank_id long, question_id long, user_answer string, wrong_count long, resolved int",
    "import_task": "task_id string, status string, file_name string, file_size long, bank_name string, progress int, bank_id long, total_count int, error_message string",
    "knowledge_summary": "id long, bank_id long, highlights array<string>, key_points array<string>, hot_topics array<string>, easy_mistakes array<string>, study_suggestions array<string>, created_at timestamp, updated_at timestamp",
    "chat_session": "id long, title string, agent_mode string, message_count long, created_at timestamp, updated_at timestamp",
    "chat_message": "id long, session_id long, role string, content string, interrupted int, created_at timestamp",
    "exam": "id long, name string, date date",
    "attempt": "seq long, ts timestamp, session_id long, question_id long, user_answer string",
}
#: Tables that are written in partitions, and the column.
PARTITIONED = {"question": "bank_id", "chapter": "bank_id", "wrong_question": "bank_id"}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[name])
