import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from codecensus.session import local_session
    s = local_session("*", 8, app="codecensus-tests")
    yield s
    s.stop()


@pytest.fixture
def files(spark):
    from codecensus.sources.files import files_from_rows

    def make(rows, repo="repo", snapshot="s1", project="project"):
        return files_from_rows(spark, rows, repo, snapshot, project)
    return make
