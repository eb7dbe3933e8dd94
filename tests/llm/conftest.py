import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
SF = "/root/testdata/sf0.001"

LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))
ODD = [None, "", "  \n\t ", "a", "ab c", "É", "1 2 3", "...", "x" * 70_000, LONG, "same words here again " * 40, "same words here again " * 40, "ends\n", "\x1c \x85   x́"]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Texts at the edges, NULLs in every column, a repeated row, and columns named like what operators make."""
    rows = [(k if k != 3 else None, t, None if k % 3 else "en", None if k % 4 else "src0", None, "mine", True, 1.0) for k, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[4]], "doc_id long, text string, lang string, source string, n_chars long, reason string, kept boolean, score double")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
