import pytest
from pyspark.sql import functions as F

from quillspark.operators import filters as fl

ROWS = [(1, "python", "src/a.py", 5, ["x", "y"], 1.5), (2, "java", "src/b.java", 7, [], None), (3, None, None, 9, None, 2.0), (4, "Go", "lib/c.go", None, ["y"], 0.0)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id int, language string, file_path string, page int, tags array<string>, weight double")


def ids(df, column):
    return [r["id"] for r in df.filter(column).orderBy("id").collect()] if column is not None else None


@pytest.mark.parametrize(
    ("expr", "want"),
    [
        ("language=python", [1]), ("language=python,page=5", [1]), ("language=python,junk", [1]), ("", None), ("   ", None), ("language:match:java", [2]),
        ("language:in:python,java", [1, 2]), ("language:in:python,java,page:gte:6", [2]), ("page:gte:7", [2, 3]), ("page:lt:9,page:gt:5", [2]), ("page:gte:abc", None), ("file_path:contains:/", [1, 2, 4]),
        ("tags:match:y", [1, 4]), ("missing=1", []), ("page:match:7", [2]), ("language:huh:x", None),
        ('{"must": [{"key": "page", "range": {"gte": 5}}], "must_not": [{"key": "language", "match": {"value": "java"}}]}', [1, 3]),
        ('{"should": [{"key": "language", "match": {"value": "java"}}, {"must": [{"key": "page", "range": {"gt": 8}}]}]}', [2, 3]),
        ('{"min_should": {"min_count": 2, "conditions": [{"key": "page", "range": {"gte": 5}}, {"key": "tags", "match": {"any": ["x"]}}, {"key": "weight", "range": {"gt": 1}}]}}', [1, 3]),
        ('{"must": [{"is_null": {"key": "language"}}]}', [3]), ('{"must": [{"is_empty": {"key": "tags"}}]}', [2, 3]), ('{"must": [{"key": "language", "match": {"except": ["java"]}}]}', [1, 4]),
    ],
)
def test_forms(df, expr, want):
    assert ids(df, fl.parse(df, expr)) == want


def test_strictness(df):
    assert ids(df, fl.parse(df, "page=5")) == [1] and ids(df, fl.parse(df, "page=5", strict=True)) == []
    assert ids(df, fl.parse(df, "language:in:python,java", strict=True)) == [1]
    with pytest.raises(ValueError):
        fl.parse(df, "{bad")


@pytest.mark.parametrize(
    ("expr", "want"),
    [
        ("language = PYTHON", [1]), ("language != python", [2, 3, 4]), ("NOT language = python AND page EXISTS", [2, 3]), ("page 5 TO 7", [1, 2]), ("page >= 7 OR language = go", [2, 3, 4]),
        ("language IN [python, 'java']", [1, 2]), ("language NOT IN [python]", [2, 3, 4]), ("language IS NULL", [3]), ("language IS NOT NULL", [1, 2, 4]), ("tags IS EMPTY", [2]), ("tags = Y", [1, 4]),
        ("(language = python OR language = java) AND NOT page < 6", [2]), ("page NOT EXISTS", [4]),
    ],
)
def test_text_filters(df, expr, want):
    assert ids(df, fl.text_filter(df, expr)) == want


@pytest.mark.parametrize("expr", ["", "language", "language =", "page > x", "(page > 1", "page > 1 page", "nope = 1", "language IN python", "language IS"])
def test_text_filter_errors(df, expr):
    with pytest.raises(fl.FilterError):
        fl.text_filter(df, expr)


def test_filterable_attributes(df):
    with pytest.raises(fl.FilterError, match="filterable are page"):
        fl.text_filter(df, "language = python", ["page"])


def test_globs_and_words(df):
    assert ids(df, fl.globs(F.col("file_path"), ["src/*"], ["*.java"])) == [1, 3]
    assert ids(df, fl.globs(F.col("file_path"), ["*[!a].?o"])) == [3, 4]
    assert fl.describe("a=b,c:in:d") == "a=b AND c:in:d" and fl.describe("") == "No filters applied" and fl.describe("{}") == "Complex filter"
