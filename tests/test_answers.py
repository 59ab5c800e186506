"""The data source of stored answers: rows, what is opened, what the plan hands over."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull, LessThanOrEqual

from stackwright.sources import answers


@pytest.fixture
def folder(tmp_path):
    for provider, key in (("musicbrainz", "releases"), ("discogs", "results")):
        for artist in ("a1", "a2", "ü"):
            for page in (1, 2, 10):
                path = tmp_path / provider / artist / f"page-{page}.json"
                path.parent.mkdir(parents=True, exist_ok=True)
                path.write_text(json.dumps({key: [{"id": page * 10 + k, "title": f"{artist} {k}", "date": "1999-05"} for k in range(page % 3 + 1)], "x": 1}))
    (tmp_path / "discogs" / "a1" / "page-3.json").write_text("{broken")
    (tmp_path / "discogs" / "a1" / "page-4.json").write_text("[1]")
    (tmp_path / "discogs" / "a1" / "notes.txt").write_text("no page")
    return str(tmp_path)


def test_rows_of_all_pages(spark, folder):
    rows = answers.answers(spark, folder, 2).collect()
    assert len(rows) == 2 * 3 * (2 + 3 + 2)
    one = next(r for r in rows if (r.provider, r.artist, r.page, r.ord) == ("discogs", "ü", 2, 1))
    assert (one.release_id, one.title, one.year, json.loads(one.json)["id"]) == ("21", "ü 1", "1999", 21)


def test_only_wanted_pages_are_opened(spark, folder):
    # A page that can't be opened ends a query that opens it.
    os.chmod(f"{folder}/discogs/a1/page-3.json", 0)
    os.remove(f"{folder}/discogs/a2/page-1.json")
    os.symlink("/nowhere", f"{folder}/discogs/a2/page-1.json")
    found = answers.answers(spark, folder).filter((F.col("provider") == "discogs") & F.col("artist").isin("a2", "ü") & (F.col("page") >= 2) & F.col("title").endswith("1"))
    plan = found._jdf.queryExecution().toString()
    assert "provider_answers" in plan and "endswith" in plan.lower()
    assert {(r.artist, r.page) for r in found.collect()} == {("a2", 2), ("a2", 10), ("ü", 2), ("ü", 10)}
    with pytest.raises(Exception, match="page-1.json"):
        answers.answers(spark, folder).filter("artist = 'a2' AND page < 2").collect()


def test_filters_that_names_decide_are_taken_over(folder):
    reader = answers.AnswerReader({"path": f"file:{folder}", "pagesPerPartition": "1"})
    left = list(reader.pushFilters([EqualTo(("provider",), "discogs"), In(("artist",), ("a1", "a2")), LessThanOrEqual(("page",), 2), EqualTo(("title",), "x"), IsNull(("page",)), GreaterThan(("page",), 1)]))
    assert [type(f).__name__ for f in left] == ["EqualTo", "IsNull"]
    assert [(f[0], f[1], f[2]) for p in reader.partitions() for f in p.files] == [("discogs", "a1", 2), ("discogs", "a2", 2)]
    assert list(answers.AnswerReader({"path": folder}).read(answers.Pages([]))) == []


def test_no_page_fits(spark, folder):
    assert answers.answers(spark, folder).filter("provider = 'other'").count() == 0
