"""Scalar functions over columns; all built-in expressions, so they stay in the JVM."""

from __future__ import annotations

from functools import reduce
from string import ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

# Question types and their Chinese names.
TYPE_LABELS = {"SINGLE": "单选题", "MULTIPLE": "多选题", "TRUE_FALSE": "判断题", "ESSAY": "简答题", "FILL_BLANK": "填空题"}
# Words for true, and for true or false.
TRUE_WORDS = r"(?i)^(?:对|正确|是|√|✓|T|TRUE)$"
TRUE_FALSE_WORDS = r"(?i)^(?:对|错|正确|错误|是|否|√|×|✓|✗|T|F|TRUE|FALSE)$"
# What may stand between the letters of an answer.
LETTER = "[A-Za-zＡ-Ｚａ-ｚ]"
LETTER_SEPARATORS = "、,，;；/ 　和与及"
# Words of account-level failures, in the order in which they are looked for.
FAILURES = [
    (("insufficient", "quota", "balance", "余额", "欠费"), "AI 账户余额不足或配额已用完，请充值后重试"),
    (("authentication", "unauthorized", "invalid api key", "invalid_api_key", "api key", "401", "403"), "AI 账号鉴权失败，请到「设置」页检查 API Key 是否填写正确"),
    (("rate limit", "too many requests", "429", "频率", "限流"), "AI 请求过于频繁被限流，请稍等几分钟再重试"),
]
FILL_BLANK_MAX = 20
#: Default and largest page sizes.
PAGE_SIZES = {"banks": (100, 200), "questions": (20, 100), "messages": (50, 200), "recent": (5, 20), "search": (5, 20)}


def trim(c: Column) -> Column:
    """Cut characters up to U+0020 at both ends (``F.trim`` cuts the space only)."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def is_blank(c: Column) -> Column:
    """Null, empty, or white space of any kind."""
    return c.isNull() | c.rlike(r"^[\s\p{Z}]*$")


def trim_to_null(c: Column) -> Column:
    t = trim(c)
    return F.when(t != "", t)


def one_of(c: Column, labels: dict[str, str]) -> Column:
    """The value of a small mapping, null for other keys."""
    return reduce(lambda w, kv: w.when(c == kv[0], kv[1]), list(labels.items())[1:], F.when(c == next(iter(labels)), next(iter(labels.values()))))


_WIDE = "".join(chr(c) for c in [*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)])


def normalize_letter(c: Column) -> Column:
    """full-width letters to half-width, then upper case."""
    return F.upper(F.translate(c, _WIDE, ascii_uppercase * 2))


def strip_bold(c: Column) -> Column:
    """one pair of asterisks off each end."""
    head = trim(F.regexp_replace(trim(c), r"^\*\*", ""))
    return trim(F.regexp_replace(head, r"\*\*$", ""))


def letter_part(c: Column) -> Column:
    """the first run of letters, separators between them included."""
    return F.coalesce(F.regexp_extract(c, f"{LETTER}(?:[{LETTER_SEPARATORS}]*{LETTER})*", 0), F.lit(""))


def letters(c: Column) -> Column:
    """the distinct letters of an answer, upper case and sorted; '' if there are none."""
    found = F.regexp_extract_all(letter_part(c), F.lit(f"({LETTER})"), 1)
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, normalize_letter))), "")


def is_tf_word(c: Column) -> Column:
    return F.coalesce(trim(c).rlike(TRUE_FALSE_WORDS), F.lit(False))


def tf_meaning(c: Column) -> Column:
    """true, false or null."""
    t = trim(c)
    return F.when(t.rlike(TRUE_WORDS), True).when(t.rlike(TRUE_FALSE_WORDS), False)


def tf_key(c: Column) -> Column:
    """A for true, B for false; the letters themselves count too."""
    v = F.upper(trim(c))
    m = tf_meaning(v)
    return F.when(v.isin("A", "B"), v).when(m, "A").when(~m, "B")


def type_of_label(c: Column) -> Column:
    return one_of(trim(c), {label: name for name, label in TYPE_LABELS.items()})


def classify_type(raw_type: Column, options: Column, answer: Column) -> Column:
    """by label, else by the options, else by the length of the answer; null if nothing tells."""
    n = F.coalesce(F.size(options), F.lit(0))
    tf = (n == 2) & F.forall(options, lambda o: is_tf_word(o["text"]))
    return (
        F.when(type_of_label(raw_type).isNotNull(), type_of_label(raw_type))
        .when(tf, "TRUE_FALSE")
        .when(n > 0, F.when(F.length(letters(answer)) > 1, "MULTIPLE").otherwise("SINGLE"))
        .when(~is_blank(answer), F.when(F.length(trim(answer)) <= FILL_BLANK_MAX, "FILL_BLANK").otherwise("ESSAY"))
    )


def normalize_answer(kind: Column, answer: Column, options: Column) -> Column:
    """the stored form of an answer; null if there is none."""
    ls = letters(answer)
    first = F.when(ls != "", F.substring(ls, 1, 1))
    chosen = F.get(F.filter(options, lambda o: o["key"] == first), F.lit(0))["text"]
    meaning = F.coalesce(tf_meaning(answer), tf_meaning(chosen))
    return F.when(
        ~is_blank(answer),
        F.when(kind == "SINGLE", first)
        .when(kind == "MULTIPLE", F.when(ls != "", ls))
        .when(kind == "TRUE_FALSE", F.when(meaning, "A").when(~meaning, "B"))
        .when(kind.isin("FILL_BLANK", "ESSAY"), trim(answer)),
    )


def _parts(c: Column) -> Column:
    """Split at either semicolon, trailing empty parts dropped: '' has one part, ';' none."""
    cut = F.regexp_replace(c, "[；;]+$", "")
    return F.when((cut == "") & (c != ""), F.array().cast("array<string>")).otherwise(F.split(cut, "[；;]"))


def fill_blank_equal(std: Column, mine: Column) -> Column:
    """F8: as many parts, and each equal but for white space at the ends."""
    a, b = _parts(std), _parts(mine)
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: trim(x).eqNullSafe(trim(y))), lambda x: x)


def _sorted_letters(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(F.regexp_replace(F.upper(c), "[^A-Z]", ""), "")), "")


def judge(kind: Column, std: Column, mine: Column) -> Column:
    """true or false, or null for what cannot be graded (essays and questions without a type)."""
    s, m = (F.upper(trim(F.coalesce(c, F.lit("")))) for c in (std, mine))
    return F.when(kind == "MULTIPLE", _sorted_letters(s) == _sorted_letters(m)).when(kind == "FILL_BLANK", fill_blank_equal(s, m)).when(kind != "ESSAY", s == m)


def accuracy(answered: Column, correct: Column) -> Column:
    """whole percent, half up in single precision; 0 if nothing was answered."""
    share = correct.cast("float") * F.lit(100).cast("float") / answered.cast("float")
    return F.when(answered > 0, F.floor(share.cast("float") + F.lit(0.5).cast("float")).cast("int")).otherwise(0)


def days_left(date: Column, as_of: Column) -> Column:
    return F.datediff(date, as_of)


def exam_level(days: Column) -> Column:
    """F10."""
    return F.when(days <= 7, "red").when(days <= 14, "orange").otherwise("green")


def type_label(c: Column) -> Column:
    """the Chinese name; unknown types stay as they are."""
    return F.coalesce(one_of(c, TYPE_LABELS), c, F.lit("未知题型"))


def normalize_type(c: Column) -> Column:
    """a Chinese name, or a type's own name in any case; null for anything else."""
    t = F.upper(trim(c))
    return F.coalesce(type_of_label(c), F.when(t.isin(*TYPE_LABELS), t))


def truncate(c: Column, n: int) -> Column:
    return F.when(c.isNull(), "").when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n), F.lit("…")))


def brief(c: Column, n: int = 60) -> Column:
    return truncate(trim(F.regexp_replace(c, r"\s+", " ")), n)


def brief_reason(message: Column, default: Column, n: int = 200) -> Column:
    """The first line that is not blank, cut at n."""
    raw = F.when(is_blank(message), default).otherwise(message)
    lines = F.filter(F.transform(F.split(raw, "\r\n|\r|\n"), trim), lambda x: x != "")
    return F.substring(F.coalesce(F.get(lines, F.lit(0)), trim(raw)), 1, n)


def mask_secret(message: Column, secret: Column, default: Column) -> Column:
    """One line of at most 200 characters, the secret replaced by stars."""
    cut = truncate(trim(F.regexp_replace(message, r"\s+", " ")), 200)
    return F.when(is_blank(message), default).when(secret.isNull() | (secret == ""), cut).otherwise(F.replace(cut, secret, F.lit("***")))


def classify_failure(message: Column) -> Column:
    """what to tell the user about an account-level failure; null for failures of one question."""
    low = F.lower(message)
    tests = [(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), text) for words, text in FAILURES]
    return reduce(lambda w, t: w.when(*t), tests[1:], F.when(*tests[0]))


def repair_backslashes(c: Column) -> Column:
    """double the backslashes that JSON does not allow; good escapes stay."""
    return F.regexp_replace(c, r'(\\(?:u[0-9A-Fa-f]{4}|["\\/nrt]|[bf](?![a-z])))|(\\)', "$1$2$2")


def strip_to_json(c: Column) -> Column:
    """F16: without a code fence, from the first bracket on."""
    t = trim(c)
    body = F.when(t.startswith("```"), trim(F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n", ""), r"(?s)```(?!.*```).*$", ""))).otherwise(t)
    start = F.regexp_extract(body, r"(?s)^[^{\[]*([{\[].*)$", 1)
    return F.when(start != "", trim(start)).otherwise(body)


def flat(c: Column) -> Column:
    """Without blanks and punctuation, in lower case; null is empty."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\p{Z}\p{P}]+", ""))


def flat_blanks(answer: Column) -> Column:
    """The blanks of an answer, each flat, joined by ``;``; separators at the end do not count, as when grading."""
    said = F.regexp_replace(F.coalesce(answer, F.lit("")), r"[\s；;]+$", "")
    return F.array_join(F.transform(F.split(said, "[；;]"), flat), ";")


def fingerprint(stem: Column, options: Column, answer: Column) -> Column:
    """SHA-256 of stem, options and answer without blanks and punctuation, in lower case."""
    opts = F.array_join(F.transform(F.coalesce(options, F.array().cast("array<struct<key:string,text:string>>")), lambda o: F.concat(F.coalesce(o["key"], F.lit("")), F.lit("="), flat(o["text"]))), ";")
    return F.sha2(F.concat_ws("||", flat(stem), opts, flat(answer)), 256)


def title_from(c: Column) -> Column:
    return F.substring(trim(c), 1, 20)


def blank_to(c: Column, default: str) -> Column:
    return F.when(is_blank(c), default).otherwise(c)


def normalize_model_answer(kind: Column, raw: Column) -> Column:
    """a model's answer in the form of the question type, else null."""
    v = F.upper(trim(raw))
    many = F.array_join(F.array_sort(F.array_distinct(F.split(v, ","))), ",")
    return F.when(
        ~is_blank(raw),
        F.when(kind == "SINGLE", F.when(v.rlike("^[A-Z]$"), v)).when(kind == "MULTIPLE", F.when(v.rlike("^[A-Z](,[A-Z])*$"), many)).when(kind == "TRUE_FALSE", tf_key(v)).otherwise(trim(raw)),
    )


def page_bounds(kind: str, page: int | None, size: int | None) -> tuple[int, int]:
    """(offset, size) of a page; pages start at 1."""
    default, most = PAGE_SIZES[kind]
    size = default if size is None or size < 1 else min(size, most)
    return (max(1, page or 1) - 1) * size, size
