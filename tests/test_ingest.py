from __future__ import annotations

from quizmill.plans.fixtures import Tables
from quizmill.sources import ingest as I
from tests.compare import rows_of


def test_read_texts(spark, tmp_path):
    for name, raw in {"a.txt": "中文\r\nx\ry".encode(), "b.TXT": b"\xef\xbb\xbf" + "头\n".encode(), "c.txt": "国标".encode("gbk"), "d.txt": b""}.items():
        (tmp_path / name).write_bytes(raw)
    rows = {r.path.rsplit("/", 1)[1]: r for r in I.read_bank_texts(spark, str(tmp_path)).collect()}
    assert {k: r.text for k, r in rows.items()} == {"a.txt": "中文\nx\ny", "b.TXT": "头\n", "c.txt": "国标", "d.txt": ""}
    assert rows["b.TXT"].ext == "txt"
    assert I.dedup_files(I.read_bank_texts(spark, str(tmp_path))).count() == 4
    gated = {r.file_name.rsplit("/", 1)[1]: r.reject_code for r in I.gate_uploads(I.read_bank_texts(spark, f"{tmp_path}/*.txt").withColumnRenamed("path", "file_name")).collect()}
    assert gated == {"a.txt": None, "c.txt": None, "d.txt": 40001}
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == "false"


def test_folders_inside(spark, tmp_path):
    for name in ("a.txt", "empty.txt", "in/b.txt", "in/empty.txt", "in/deep/empty.docx", "in/_hidden/empty.txt", "in/.empty.txt", "_empty.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if "empty" in name else name)
    read = lambda path, **how: {r.path.split(f"{tmp_path}/")[1]: r.text for r in I.read_bank_texts(spark, path, **how).collect()}
    assert read(str(tmp_path)) == {"a.txt": "a.txt", "empty.txt": ""}
    assert read(str(tmp_path), recursive=True) == {"a.txt": "a.txt", "empty.txt": "", "in/b.txt": "in/b.txt", "in/empty.txt": "", "in/deep/empty.docx": ""}
    assert read(f"{tmp_path}/empty.txt") == {"empty.txt": ""}


def test_gate(spark):
    files = spark.createDataFrame([("a.txt", 0), ("a.PDF", 5), ("noext", 5), (None, 5), ("a.docx", I.MAX_FILE), ("a.docx", I.MAX_FILE + 1)], "file_name string, size long")
    assert [r.reject_code for r in I.gate_uploads(files).coalesce(1).collect()] == [40001, None, 40002, 40002, None, 40003]


def test_tables_round_trip(spark, sf_dir, tmp_path):
    t = Tables(spark, sf_dir)
    I.write_table(t.question, str(tmp_path), "question")
    back = I.read_table(spark, str(tmp_path), "question")
    columns = ["id", "bank_id", "type", "stem", "options", "answer", "ai_status"]
    assert rows_of(back.select(columns)) == rows_of(t.question.select(columns))
