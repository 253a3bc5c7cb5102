from __future__ import annotations

import pytest

AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, fp long, block long, h long, s string, w array<string>, score double, kept boolean, row string, component_id long, known string, _uid string, _md5 long, _sha string, _norm string, node long, component string"
LONG = " ".join(f"word{i % 977} und{i % 31}" for i in range(30000))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names the operators use themselves."""
    texts = [None, "", " \t\n", "!!! 123", "The cat sat on the mat. MIT License, Apache License", "the cat sat on the mat. mit license, apache license", LONG, LONG + " end", "été à la forêt", "A" * 5000, "x\0y z", "日本語のテスト 😀", "le chat est sur la table et le chien dort"]
    rows = [(i, t, None if i % 4 == 0 else "fr" if i > 7 else "en", None, None) for i, t in enumerate(texts)]
    rows += [(4, texts[4], "en", "src0", 3), (None, texts[6], None, None, None), (None, None, None, None, None), (40, texts[4], "en", None, 1)]
    return spark.createDataFrame([(*r, 1, 2, 3, "s", ["w"], 0.5, True, "r", 7, "k", f"mine-{i}", 8, "h", "n", 9, "c") for i, r in enumerate(rows)], AWKWARD)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("1 = 0")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
