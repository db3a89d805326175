import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docsift.operators.names import EditSynonyms, compile_query, expand_terms, fuzzy, load_synonyms, parse_synonyms, partial_ratio, route, save_synonyms

NAMES = ["UAT_Trip.pdf", "Trip_UAT.pdf", "UAT_drawing.pdf", "uat notes.TXT", "boiler.docx"]


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(NAMES)], "i int, name string")


@pytest.mark.parametrize(
    ("query", "want"),
    [("uat", [1, 2, 3, 4]), ("UAT*Trip", [1, 2]), ("UAT % drawing", [1, 2, 4]), ("*UAT*Trip*", [1, 2]), ("*UAT*Trip* % zzz", [1]), ("u*a*t", [1, 2, 3, 4]), ("UAT%", []), ("*", [1, 2, 3, 4, 5]), (".pdf", [1, 2, 3]), ("(*[", []), ("\\E*.pdf", [])],
)
def test_queries(names, query, want):
    assert sorted(r.i for r in names.where(compile_query(query, F.col("name"))).collect()) == want


def test_fuzzy(names):
    find = lambda q, **k: sorted(r.i for r in names.where(fuzzy(q, F.col("name"), **k)).collect())
    assert find("@trip") == [1, 2]
    assert find("@drawimg") == [3]
    assert find("@pdf", synonyms={"pdf": ["boiler"]}) == []
    assert find("@pdf", synonyms={"pdf": ["boiler"]}, mode="any") == [1, 2, 3, 5]
    assert find("@") == [1, 2, 3, 4, 5]


def test_synonyms():
    table = parse_synonyms("idf == fan, blower\nno line\nA==b==c")
    assert table == {"idf": ["fan", "blower"], "A": ["b==c"]}
    assert expand_terms("@IDF x", table) == ["IDF", "blower", "fan", "x"]
    assert expand_terms("a", table) == ["a"] and expand_terms("a", table, ci_keys=True) == ["a", "b==c"]


def test_ratio_cases():
    assert partial_ratio("", "") == 100 and partial_ratio("", "a") == 0
    assert partial_ratio("abc", "xxabcxx") == 100
    assert partial_ratio("abcd", "abxd") == 75


@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_ratio_bounds(a, b):
    assert 0 <= partial_ratio(a, b) <= 100 and partial_ratio(a, b) == partial_ratio(b, a)


def test_route(spark, names, tmp_path):
    find = lambda q: sorted(r.i for r in names.where(route(q, F.col("name"))).collect())
    assert find("@trip") == [1, 2] and find(" *UAT*Trip* ") == [1, 2]
    with pytest.raises(ValueError):
        route("  ", F.col("name"))
    with pytest.raises(EditSynonyms):
        route("$synonym", F.col("name"))
    save_synonyms(spark, {"é": ["x", "y"]}, str(tmp_path / "s"))
    assert load_synonyms(spark, str(tmp_path / "s")) == {"é": ["x", "y"]} and load_synonyms(spark, str(tmp_path / "none")) == {}
