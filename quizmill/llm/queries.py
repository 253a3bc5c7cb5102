"""The queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP1_SQL, op1_chat_format
from .decontaminate import OP10_SQL, op10_decontaminate
from .exact_dedup import OP9_SQL, op9_exact_dedup
from .filter_audit import OP12_SQL, op12_filter_audit
from .hmm import op5_hmm_lm
from .langid import op8_langid
from .lexical import OP13_SQL, op13_ranked_search
from .licenses import OP7_SQL, op7_licenses
from .pieces import op6_sentencepiece
from .quality import op2_quality
from .simhash import op4_simhash
from .suffix_dedup import op3_suffix_dedup
from .toxicity import op11_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_quality": op2_quality,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_simhash": op4_simhash,
        "op5_hmm_lm": op5_hmm_lm,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_licenses": op7_licenses,
        "op8_langid": op8_langid,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_decontaminate": op10_decontaminate,
        "op11_toxicity": op11_toxicity,
        "op12_filter_audit": op12_filter_audit,
        "op13_ranked_search": op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op7_licenses": OP7_SQL, "op9_exact_dedup": OP9_SQL, "op10_decontaminate": OP10_SQL, "op12_filter_audit": OP12_SQL, "op13_ranked_search": OP13_SQL}
