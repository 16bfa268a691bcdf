import sys
from os.path import abspath, dirname

import pandas as pd
import pytest

sys.path.insert(0, dirname(dirname(dirname(abspath(__file__)))))

from ebbtide.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, band long, hits int, row string"


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", cpus=8, partitions=4)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns whose names the
    operators use inside."""
    base = "the quick brown fox jumps over the lazy dog near the old stone bridge at dawn"
    rows = [(1, base, "en", "a"), (2, base + " today", "en", "a"), (3, base.upper(), "en", "b"), (4, None, "en", "a"),
            (5, "", None, None), (6, " \t\n", "de", "b"), (7, "word", "de", None), (8, "WORD", None, "c"),
            (9, "1 2 3 !!", "fr", "c"), (10, "long " * 30_000 + base, "en", "a"), (11, base, None, "a"), (11, base, None, "a"),
            (None, base, "en", "b"), (None, None, None, None), (12, "der hund lief über die straße " * 5, "de", "d"),
            (13, "漢字かな交じり文 \u001c x y", None, "d"), (14, "le chien et le chat dorment ici " * 5, "fr", "d")]
    return spark.createDataFrame([(*r, 0, 7, 7, "x") for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCS)


def frame(df):
    return pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns)
