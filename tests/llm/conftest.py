import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from odd_rows import DOC, ODD_TEXTS, clashing  # noqa: E402


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, None if n % 3 == 0 else "en", None if n % 4 == 0 else f"s{n % 2}", None) for n, (i, t) in enumerate(ODD_TEXTS)]
    return clashing(spark.createDataFrame(rows, DOC))


@pytest.fixture(scope="session")
def no_docs(spark):
    return clashing(spark.createDataFrame([], DOC))
