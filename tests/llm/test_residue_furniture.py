"""Recurrent lines are subtracted only where they stand beside other content."""

import pytest

from rasterloom.llm import residue as R
from tests.conftest import rows

SCHEMA = "doc_id bigint, text string, source string"


@pytest.mark.parametrize("copies", [19, 20, 60])
@pytest.mark.parametrize("page", ["Loading...", "Error 404\n\nGo back to the start.", "Please enable JavaScript.\nLoading..."])
def test_copied_pages_stay_cases(spark, page, copies):
    data = [(i, page, "a") for i in range(copies)] + [(100 + i, f"A post about {'abcdefgh'[i % 8]}.", "a") for i in range(80)]
    assert rows(R.residue(spark.createDataFrame(data, SCHEMA)).select("doc_id").distinct(), "doc_id") == sorted([(i,) for i in range(copies)], key=repr)


def test_lone_notices_beside_posts_with_them(spark):
    data = [(i, f"Text {'abc'[i % 3]} of a post.\nLoading...", "a") for i in range(60)] + [(100 + i, "Loading...", "a") for i in range(30)]
    assert rows(R.residue(spark.createDataFrame(data, SCHEMA)), "doc_id") == sorted([(100 + i,) for i in range(30)], key=repr)
