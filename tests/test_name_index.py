"""The trigram index against the plain search, and its bounds against the ratio itself."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docsift.operators import name_index
from docsift.operators.names import EditSynonyms, partial_ratio, route

SF = "/root/testdata/sf0.01"
ODD = ["UAT_Trip.pdf", "Trip_UAT.pdf", "uat notes.TXT", "boiler.docx", "", "a", None, "teſt plan", "TİTLE page", "Kelvin scale", "tıtle", "same", "same"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("names"))
    rng = random.Random(3)
    made = ["".join(rng.choices("abcde ", k=rng.randrange(1, 25))) for _ in range(300)]
    rows = spark.createDataFrame([(i, n, "x") for i, n in enumerate([*ODD, *made])], "id int, label string, gram string")
    name_index.build(rows, "id", "label", at)
    return name_index.load(spark, at), rows


@pytest.mark.parametrize("query", ["uat", "UAT*Trip", "UAT % trip", "*uat*trip*", "test", "te*pl", "title", "ti*le", "kelvin", "kel*sc", "kel*sc % zzz", "ab", "abc", "*", "abc*", "a%", "abc % e*d", "zzzz", "@trip", "@abcde", "@cabbage bed", "@abc de", "@kelvin", "@", "@boiler", "@abcdeabcdeabcde"])
def test_equals_the_plain_search(index, query):
    own, rows = index
    words = {"bed": ["deb"]}
    want = sorted(r.id for r in rows.where(route(query, F.col("label"), words)).collect())
    assert sorted(r.key for r in own.search(query, words).collect()) == want


@pytest.mark.parametrize("threshold", [50.0, 70.0, 85.0, 95.0, 100.0])
def test_thresholds(index, threshold):
    own, rows = index
    for query in ("@abcdea", "@abc ab", "@decade abc"):
        want = sorted(r.id for r in rows.where(route(query, F.col("label"), {}, threshold)).collect())
        assert sorted(r.key for r in own.search(query, {}, threshold).collect()) == want


def test_refusals(index):
    with pytest.raises(ValueError):
        index[0].search("  ")
    with pytest.raises(EditSynonyms):
        index[0].search("$synonym")


def test_few_names_are_looked_at(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_name")
    name_index.build(rows, "p_partkey", "p_name", str(tmp_path / "i"))
    own, every = name_index.load(spark, str(tmp_path / "i")), rows.count()
    found = own.search("ring*small").count()
    assert own.candidates("ring*small").count() <= max(2 * found, every // 50)
    near = own.fuzzy_candidates(["smoll", "ring"], 85.0).count()
    assert near < every / 4
    plan = own.candidates("ring*small")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan


def test_tasks_of_the_build_do_not_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(name_index, "NAMES", 40)
    # one file and one scan task, repeated trigrams, and a trigram of every name
    rows = spark.range(400).coalesce(1).select("id", F.concat(F.lit("ababab pump "), "id").alias("label"))
    name_index.build(rows, "id", "label", str(tmp_path / "i"))
    own = name_index.load(spark, str(tmp_path / "i"))
    files = own.grams.groupBy(F.input_file_name()).agg(F.countDistinct("key").alias("n")).collect()
    assert len(files) == 10 and max(r["n"] for r in files) < 80
    assert {(r["gram"], r["n"]) for r in own.grams.where("key = 7").collect()} == set(name_index.grams_of("ababab pump 7").items())
    assert own.search("pump 7").count() == 11 and own.search("@pump 399", threshold=100.0).count() == 1


def test_empty_table(spark, tmp_path):
    rows = spark.createDataFrame([], "id int, label string")
    name_index.build(rows, "id", "label", str(tmp_path / "i"))
    own = name_index.load(spark, str(tmp_path / "i"))
    assert own.search("abc").count() == own.search("@abc").count() == 0


@settings(max_examples=500, deadline=None)
@given(st.text("abc", min_size=3, max_size=14), st.text("abc", min_size=1, max_size=20), st.sampled_from([60.0, 70.0, 80.0, 90.0, 97.0]))
def test_names_that_fit_share_what_is_needed(term, name, threshold):
    if partial_ratio(name, term) < threshold:
        return
    letters = sum(min(term.count(x), name.count(x)) for x in set(term))
    assert letters * (200 - threshold) >= threshold * min(len(name), len(term)) - 1e-6
    if len(name) >= len(term):
        shared = sum((name_index.grams_of(term) & name_index.grams_of(name)).values())
        assert shared >= name_index.shared_at_least(len(term), threshold)
