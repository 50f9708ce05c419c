import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(FOLDER):
        pytest.skip("no driver tables here")
    return FOLDER


@pytest.fixture
def documents(spark):
    """Documents as the tables have them, with columns whose names operators might use themselves."""
    def make(rows):
        full = [(i, t, l, s, None if t is None else len(t), "x", 1, "y") for i, t, l, s in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, "
                                           "row string, size int, key string")
    return make
