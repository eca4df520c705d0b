import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from markscope.session import build_session
    # the library's own settings, its driver memory among them
    s = build_session("local[*]", 8, settings={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="markscope-test-")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def pages_df(spark):
    """Build a normalised page input from (page_id, url, html) tuples."""
    from markscope.sources.pages import normalize_pages

    def make(rows):
        df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
        return normalize_pages(df)
    return make
