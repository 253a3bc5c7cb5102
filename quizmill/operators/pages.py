"""Seek paging: a page is what comes after the last key of the page before, so page 1000 costs what page 1 costs.

Totals are asked for apart from the pages (``matches``), and as often as they are needed.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizmill.functions import text as T
from quizmill.operators import reports as R

#: Orders of the lists: columns with "desc" or "asc"; the last one tells rows apart.
NEWEST, OLDEST = (("created_at", "desc"), ("id", "desc")), (("created_at", "asc"), ("id", "asc"))
Order = tuple[tuple[str, str], ...]


def _behind(column: str, way: str, value: Any) -> tuple[Column, Column]:
    """Whether a value stands behind ``value`` in an order, and whether it is the same; nulls come last in descending order
    and first in ascending order, as Spark sorts them."""
    c, same = F.col(column), F.col(column).eqNullSafe(F.lit(value))
    if value is None:
        return (F.lit(False) if way == "desc" else c.isNotNull()), same
    return ((c < F.lit(value)) | c.isNull() if way == "desc" else c > F.lit(value)), same


def behind(order: Order, key: tuple) -> Column:
    """Rows that come after ``key``.  The first column's range stands in front, where a scan can use it to pass over files."""
    out = F.lit(False)
    for (column, way), value in reversed(list(zip(order, key, strict=True))):
        after, same = _behind(column, way, value)
        out = after | (same & out)
    column, way = order[0]
    if key[0] is None:
        return out & (F.col(column).isNull() if way == "desc" else F.lit(True))
    edge = F.col(column) <= F.lit(key[0]) if way == "desc" else F.col(column) >= F.lit(key[0])
    return (edge | F.col(column).isNull() if way == "desc" else edge) & out


def page_after(rows: DataFrame, order: Order, size: int, after: tuple | None = None) -> DataFrame:
    """The first ``size`` rows in an order, of those behind ``after``."""
    found = rows if after is None else rows.where(behind(order, after))
    return found.orderBy(*[F.desc(c) if way == "desc" else F.asc(c) for c, way in order]).limit(size)


def last_key(page: DataFrame, order: Order) -> tuple | None:
    """The key with which the next page starts; None if the page is empty, so there is none."""
    turned = [F.asc_nulls_first(c) if way == "desc" else F.desc_nulls_last(c) for c, way in order]
    row = page.select(*[c for c, _ in order]).orderBy(*turned).first()
    return tuple(row) if row else None


def matches(rows: DataFrame) -> DataFrame:
    """How many rows there are on all pages together."""
    return rows.agg(F.count(F.lit(1)).alias("matches"))


def write_for_pages(rows: DataFrame, order: Order, path: str) -> DataFrame:
    """Rows in files that follow one another in an order, so a page reads the files that its key range meets."""
    keys = [F.desc(c) if way == "desc" else F.asc(c) for c, way in order]
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def bank_page(bank: DataFrame, question: DataFrame, chapter: DataFrame, keyword: str | None = None, size: int | None = None, after: tuple | None = None) -> DataFrame:
    """The banks behind ``after`` (created_at, id), newest first, with their counts."""
    _, size = T.page_bounds("banks", 1, size)
    rows = page_after(R.banks_found(bank, keyword), NEWEST, size, after)
    return R.bank_counts(rows, question, chapter)


def question_page(question: DataFrame, chapter: DataFrame, bank_id: int | None = None, chapter_id: int | None = None, kind: str | None = None, keyword: str | None = None, size: int | None = None, after: tuple | None = None) -> DataFrame:
    """The questions behind ``after`` (created_at, id), newest first, with their chapter's name ('' if there is none)."""
    _, size = T.page_bounds("questions", 1, size)
    rows = page_after(R.questions_found(question, bank_id, chapter_id, kind, keyword), NEWEST, size, after)
    return R.with_chapter_name(rows, chapter)


def message_page(msgs: DataFrame, session_id: int, size: int | None = None, after: tuple | None = None) -> DataFrame:
    """The messages of a session behind ``after`` (created_at, id), in time order."""
    _, size = T.page_bounds("messages", 1, size)
    return page_after(msgs.where(F.col("session_id") == session_id), OLDEST, size, after)
