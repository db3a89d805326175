from pyspark.sql import functions as F

from docsift.functions import text as X


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(column(F.col("v"))).collect()]


def test_normalize(spark):
    assert one(spark, X.normalize_text, None, "", " a\t\tb \r\n\r\n\r\n\r\nc  d\x1c", "x\ry") == ["", "", "a b \n\nc d", "x\ny"]


def test_fold_and_tokens(spark):
    assert one(spark, X.fold_for_hash, " A  b\n\tC ") == ["a b c"]
    assert one(spark, X.tokens, "Été 2.1/A-b, x_y!") == [["t", "2.1/a-b", "x_y"]]


def test_headings(spark):
    yes = ["1. START UP", "6.2 Scope", "3) Open", "CHECK LIST", "ÉTATS"[:5] + " X"]
    no = ["", "Intro line", "ABC", "X" * 121, "MixedCASE LINE"]
    assert one(spark, X.is_heading, *yes, *no) == [True] * 5 + [False] * 5


def test_file_columns(spark):
    assert one(spark, X.file_type, "/a/b.PDF", ".bashrc", "/x/noext", "/x.y/noext") == ["PDF", "FILE", "FILE", "FILE"]
    assert one(spark, X.extension, "a.tar.GZ", "C:\\x\\y.TXT") == [".gz", ".txt"]
    sizes = spark.createDataFrame([(131072,), (393216,), (1048576,), (None,)], "v long").select(X.size_mb(F.col("v")))
    assert [r[0] for r in sizes.collect()] == ["0.12", "0.38", "1.00", None]


def test_natural_order(spark):
    names = ["file10", "file2", "File1", "a", "file2b", "file02"]
    keys = dict(zip(names, one(spark, X.natural_key, *names)))
    assert sorted(["file10", "file2", "File1", "a", "file2b"], key=keys.get) == ["a", "File1", "file2", "file2b", "file10"]
    assert keys["file02"] == keys["file2"]


def test_citations(spark):
    assert one(spark, lambda c: X.cited(c, F.lit(3)), "a [2] b [1][2] [4] [0] [x] [99999999999999999999]", None) == [[1, 0], []]
