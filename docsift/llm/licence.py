"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

Every line of a file, and every run of three lines, that holds an anchor word is
a passage; so is the whole file that has one.  A passage's sparse TF-IDF vector is
compared with those of the templates: declarations, and whole texts of short
licences.  The inverse document frequency of a template term counts all files.  No
term counts as rarer than one file in ``RAREST``, and terms of no template count as
that rare, so a verdict depends on the shares of words and not on the number of files.
A file's own licence is that of its most similar passage, if that is similar enough.
An SPDX tag with a known identifier says it exactly: the first such tag decides, at similarity 1.
Lines with a tag, or that say what a file is not licensed under, are no passages, nor are runs and files that hold such a line.
Files without
one inherit from the nearest ancestor directory that holds a licence file.

Everything is DataFrame functions.  Defined results: a null or empty text has no
passage; a null path has no directory and inherits nothing; ties go to the
alphabetically first licence; repeated rows each get their result; several
licence files in a directory count as its most similar one (ties: first licence);
an empty table gives no rows; very long texts are read whole; of extra columns,
whatever their names, none is carried along.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm._spark import small_or_shuffled, staged
from docsift.llm.licence_texts import IDENTIFIERS, TEMPLATES

ANCHOR = r"(?i)licen[cs]e|redistribut|permission (?:is|to)|creative commons|spdx|\bcc by\b"
#: An SPDX tag and its first identifier; and what says or names no licence of the file.
TAG = r"spdx-license-identifier:[ \t]*\(?[ \t]*([a-z0-9.+-]+)"
NO_PASSAGE = r"(?i)spdx-license-identifier|\bnot (?:licen[cs]ed|released|distributed|available) under\b"
TERM = r"[a-z0-9]+"
THRESHOLD = 0.6
RAREST = 1000.0
#: Names of files that speak for their directory.
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"


def _terms(text: F.Column) -> F.Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def _template_terms(spark) -> DataFrame:
    rows = [(name, f"{name} {i}", line) for name, lines in TEMPLATES.items() for i, line in enumerate(lines)]
    t = spark.createDataFrame(rows, "licence string, template string, line string")
    return t.select("licence", "template", F.explode(_terms(F.col("line"))).alias("term")).groupBy("licence", "template", "term").agg(F.count("*").alias("tf"))


def passages(text: F.Column) -> F.Column:
    """Lines, and runs of three lines, that hold an anchor; and the whole text, as line 0 and run 0."""
    lines = F.split(F.coalesce(text, F.lit("")), "\r?\n")
    one = F.transform(lines, lambda x, i: F.struct(i.alias("line"), F.lit(1).alias("n"), x.alias("passage")))
    three = F.transform(F.filter(one, lambda x: x["passage"].rlike(ANCHOR)), lambda x: F.struct((F.greatest(x["line"] - 1, F.lit(0))).alias("line"), F.lit(3).alias("n"), F.array_join(F.slice(lines, F.greatest(x["line"], F.lit(1)), F.lit(3)), " ").alias("passage")))
    whole = F.array(F.struct(F.lit(0).alias("line"), F.lit(0).alias("n"), F.coalesce(text, F.lit("")).alias("passage")))
    return F.filter(F.concat(F.filter(one, lambda x: x["passage"].rlike(ANCHOR)), three, whole), lambda x: ~x["passage"].rlike(NO_PASSAGE))


def _tagged(files: DataFrame, uid: str) -> DataFrame:
    """uid, licence and line of each file's first SPDX tag with a known identifier."""
    known = files.sparkSession.createDataFrame(sorted(IDENTIFIERS.items()), "id string, licence string")  # fixed
    text = F.lower("text")
    lines = files.where(text.contains("spdx-license-identifier")).select(uid, F.posexplode_outer(F.split(text, "\r?\n")).alias("line", "l"))
    tags = lines.where(F.col("l").contains("spdx-license-identifier")).select(uid, "line", F.regexp_extract("l", TAG, 1).alias("id"))
    found = tags.join(F.broadcast(known), "id").groupBy(uid).agg(F.min(F.struct("line", "licence")).alias("t"))
    return found.select(F.col(uid).alias("_tagged"), F.col("t.licence").alias("tag"), F.col("t.line").alias("tag_line"))


def _similar(files: DataFrame, uid: str) -> DataFrame:
    """uid, licence, similarity, line of each file's most similar passage."""
    spark = files.sparkSession
    templates = staged(_template_terms(spark), "templates")
    vocabulary = [r[0] for r in templates.select("term").distinct().orderBy("term").collect()]  # of fixed templates
    words = F.array(*map(F.lit, vocabulary))
    n = files.count()
    df = files.select(F.explode_outer(F.array_intersect(_terms(F.col("text")), words)).alias("term")).where("term is not null").groupBy("term").agg(F.count("*").alias("df"))
    known = templates.select("term").distinct().join(F.broadcast(df), "term", "left").select("term", (F.log(F.least(F.lit(RAREST), (1.0 + n) / (1.0 + F.coalesce("df", F.lit(0))))) + 1).alias("idf"))
    known = staged(known, "idf")  # one row for each template term
    rare = math.log(min(RAREST, 1.0 + n)) + 1
    weights = templates.join(F.broadcast(known), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weights.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    weights = staged(weights.join(F.broadcast(norms), "template").select("licence", F.col("term").alias("t"), "template", (F.col("w") / F.col("norm")).alias("w")), "weights")

    found = files.where(F.col("text").rlike(ANCHOR)).select(uid, F.explode_outer(passages(F.col("text"))).alias("p")).select(uid, "p.line", "p.n", F.explode_outer(_terms(F.col("p.passage"))).alias("term")).where("term is not null")
    tf = found.groupBy(uid, "line", "n", "term").agg(F.count("*").alias("tf")).join(F.broadcast(known), "term", "left")
    tf = staged(tf.withColumn("u", F.col("tf") * F.coalesce("idf", F.lit(rare))), "terms")
    lengths = tf.groupBy(uid, "line", "n").agg(F.sqrt(F.sum(F.col("u") * F.col("u"))).alias("length"))
    dots = tf.join(F.broadcast(weights), F.col("term") == F.col("t")).groupBy(uid, "line", "n", "licence", "template").agg(F.sum(F.col("u") * F.col("w")).alias("dot"))
    cosine = dots.join(lengths, [uid, "line", "n"]).withColumn("similarity", F.round(F.col("dot") / F.col("length"), 6))
    best = cosine.where(F.col("similarity") >= THRESHOLD).groupBy(uid).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "licence", "line")).alias("b"))
    own = best.select(F.col(uid).alias("_own"), F.col("b.licence").alias("own_licence"), (-F.col("b.s")).alias("similarity"), F.col("b.line").alias("line"))
    tagged = _tagged(files, uid)
    both = own.join(tagged, F.col("_own") == F.col("_tagged"), "full_outer")
    exact = F.col("tag").isNotNull()
    return both.select(F.coalesce("_own", "_tagged").alias("_own"), F.coalesce("tag", "own_licence").alias("own_licence"), F.when(exact, 1.0).otherwise(F.col("similarity")).alias("similarity"), F.when(exact, F.col("tag_line")).otherwise(F.col("line")).alias("line"))


def ancestors(directory: F.Column) -> F.Column:
    """A directory and those above it, with their depth."""
    parts = F.split(directory, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("above")))


def scan_licences(files: DataFrame, key: str) -> DataFrame:
    """``key``, path, own_licence, similarity, line, licence, inherited_from for each row of ``files`` (key, path, text)."""
    path = F.col("path")
    # text equal to text has equal passages: the row's hash stands for it, and repeated rows meet their result again
    rows = files.select(F.col(key), path, F.col("text").cast("string").alias("text"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(1)).alias("_file"), F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.when(path.isNotNull(), "")).alias("dir"))
    own = staged(_similar(rows.select("text", "_file"), "_file"), "own")
    narrow = rows.select(key, "path", "dir", "_file").join(small_or_shuffled(own), F.col("_file") == F.col("_own"), "left").drop("_own", "_file")
    narrow = staged(narrow, "files")

    speaking = narrow.where(F.col("own_licence").isNotNull() & F.col("dir").isNotNull() & F.col("path").rlike(LICENCE_FILE))
    holders = speaking.groupBy(F.col("dir").alias("above")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "own_licence")).alias("h")).select("above", F.col("h.own_licence").alias("held"))
    # directories, not files, look upwards: a directory's ancestors are as many as its path is deep
    up = narrow.select("dir").where("dir is not null").distinct().select("dir", F.explode(ancestors(F.col("dir"))).alias("a")).select("dir", "a.depth", "a.above")
    nearest = up.join(holders, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "held")).alias("n")).select(F.col("dir").alias("_dir"), F.col("n.held").alias("held"), F.col("n.above").alias("holder"))
    out = narrow.join(small_or_shuffled(staged(nearest, "nearest")), F.col("dir") == F.col("_dir"), "left")
    heir = F.col("own_licence").isNull()
    return out.select(key, "path", "own_licence", "similarity", "line", F.coalesce("own_licence", "held").alias("licence"), F.when(heir, F.col("holder")).alias("inherited_from"))
