import math
import random

import pytest
from pyspark.sql import functions as F

from docsift.operators import bm25, dedup, inventory, metadata, retrieval, sections


def test_sections_and_packing(spark):
    text = "Intro line\n\n1. START UP\nOpen valve:\n- V1\n- V2\nCHECK LIST\nstep a"
    rows = sections.with_blocks(spark.createDataFrame([(1, text), (2, None), (3, "\n \n")], "doc_id int, text string"))
    got = {r.doc_id: [tuple(b) for b in r.blocks] for r in rows.collect()}
    assert got[1] == [("", "", "Intro line"), ("1. START UP", "", "1. START UP"), ("1. START UP", "Open valve", "Open valve:\n- V1\n- V2"), ("CHECK LIST", "", "CHECK LIST\nstep a")]
    assert got[2] == got[3] == []
    packed = rows.where("doc_id = 1").select(sections.packed(F.col("blocks"))).first()[0]
    assert [tuple(c) for c in packed] == [("", "", "\n\n".join(b[2] for b in got[1]))]


def fold(blocks, target, most):
    out, cur = [], None
    for b in blocks:
        if cur and len(cur) + 2 + len(b) <= most:
            cur += "\n\n" + b
        else:
            out += [cur] if cur else []
            cur = b
        if len(cur) >= target:
            out, cur = [*out, cur], None
    return out + ([cur] if cur else [])


def test_packing_is_the_greedy_fold(spark):
    rng = random.Random(1)
    lists = [["x" * rng.randint(1, 60) for _ in range(rng.randint(0, 12))] for _ in range(60)]
    df = spark.createDataFrame([(i, [("", "", t) for t in x]) for i, x in enumerate(lists)], f"i int, blocks array<{sections.BLOCK}>")
    for r in df.select("i", sections.packed(F.col("blocks"), 50, 80).alias("c")).collect():
        assert [c.text for c in r.c] == fold(lists[r.i], 50, 80)


def test_windows(spark):
    text = "".join(chr(97 + i % 26) for i in range(25))
    df = spark.createDataFrame([(text,), ("",), ("abc",)], "t string")
    got = [r[0] for r in df.select(sections.fixed_windows(F.col("t"), 10, 4)).collect()]
    want, at = [], 0
    while True:
        want.append(text[at : at + 10])
        if at + 10 >= len(text):
            break
        at += 6
    assert got == [want, [], ["abc"]]
    with pytest.raises(ValueError):
        sections.fixed_windows(F.col("t"), 10, 10)


def test_bm25_by_hand(spark):
    texts = ["the cat sat", "the the dog", "", None, "cat cat cat dog"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    toks = [(t or "").split() for t in texts]
    n, avg = len(toks), sum(map(len, toks)) / len(toks)
    for query in ("cat", "the cat cat", "zebra", ""):
        want = {}
        for i, d in enumerate(toks):
            s = 0.0
            for w in query.split():
                f, df = d.count(w), sum(w in x for x in toks)
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(d) / (avg + 1e-9)) + 1e-9) if f else 0
            want[i] = s
        got = dict(bm25.scores(docs, "i", "t", query).collect())
        assert all(abs(got[i] - want[i]) < 1e-9 for i in want)
    assert bm25.scores(docs.limit(0), "i", "t", "cat").count() == 0


def test_duplicates(spark):
    files = spark.createDataFrame([("a", "xx"), ("b", "xx"), ("c", "yy"), ("d", "zzz")], "p string, c string").withColumn("n", F.length("c"))
    assert sorted((r.n, r.member) for r in dedup.duplicate_groups(files, "n", "c", "p").collect()) == [(2, "a"), (2, "b")]
    chunks = spark.createDataFrame([("f", 0, "A b"), ("f", 1, "a  B "), ("g", 0, "a b"), ("g", 1, "new"), ("g", 2, " ")], "f string, i int, t string")
    assert sorted((r.f, r.i) for r in dedup.first_seen(chunks, "t", ["f", "i"]).collect()) == [("f", 0), ("g", 1)]
    assert sorted((r.f, r.n_chunks, r.n_dup) for r in dedup.duplicate_ratio(chunks, "f", "t", ["f", "i"]).collect()) == [("f", 2, 1), ("g", 3, 1)]


def test_hybrid_and_gates(spark):
    dense = spark.createDataFrame([(1, 0.9), (2, 0.5), (3, 0.1)], "i int, score double")
    sparse = spark.createDataFrame([(2, 4.0), (4, 2.0), (5, 0.0)], "i int, score double")
    mix = {r.i: round(r.mix, 6) for r in retrieval.hybrid(dense, sparse, "i").collect()}
    assert mix == {1: 0.65, 2: 0.675, 3: 0.0, 4: 0.175}
    hits = spark.createDataFrame([(i, "f", "t", 1.0 - i / 10) for i in range(4)] + [(9, "g", "", 0.9), (8, "g", "t", 0.1), (7, "g", "t", 0.2)], "i int, f string, t string, mix double")
    assert [r.i for r in retrieval.gated(hits, "i", "f", "t").collect()] == [0, 1, 7]


def test_rerank(spark):
    df = spark.createDataFrame([(1, "aaa", 0.5), (2, "a", 0.4), (3, "", 0.3), (4, "aaaa", 0.2)], "i int, t string, mix double")
    got = {r.i: (r.rerank, round(r.final, 6)) for r in retrieval.rerank(df, "i", "t", lambda s: s.str.len().astype("float64"), top_n=3).collect()}
    assert got == {1: (1.0, 0.85), 2: (0.0, 0.12), 3: (None, 0.3), 4: (None, 0.2)}
    assert all(r.final == r.mix for r in retrieval.rerank(df, "i", "t", None).collect())


def test_context_budget_and_sources(spark):
    hits = spark.createDataFrame([(i, "x" * 90) for i in range(5)], "i int, t string")
    blocks = retrieval.with_context(hits, "i", "t", F.lit("f"), budget=220, per_chunk=50)
    assert [r.n for r in blocks.orderBy("n").collect()] == [1, 2, 3]
    assert retrieval.context(blocks).first()[0].count("\n\n\n") == 2
    answers = spark.createDataFrame([(1, "see [3] and [1]"), (2, "none [9]")], "a int, t string")
    got = sorted((r.a, r["rank"], r.i) for r in retrieval.answer_sources(answers, "a", "t", hits.withColumnRenamed("t", "u"), "i", fallback=2).collect())
    assert got == [(1, 0, 2), (1, 1, 0), (2, 0, 0), (2, 1, 1)]


def test_inventory(spark):
    files = spark.createDataFrame([("/a/X.PDF", 5 << 20), ("/a/y.pdf", 1), ("/a/z", 0)], "p string, n long")
    assert files.where(F.lit(True)).count() == 3
    assert inventory.with_extension(files, "p", ".pdf").count() == 1
    assert inventory.with_extension(files, "p", ".pdf", any_case=True).count() == 2
    assert [r.p for r in inventory.in_size_range(files, "n", 5, 5).collect()] == ["/a/X.PDF"]
    assert [r.new_path for r in inventory.rename_plan(files, "p", "n_", "_s", "X").collect()] == ["/a/n_.PDF_s", "/a/n_y.pdf_s", "/a/n_z_s"]


def test_containers(spark):
    raw = spark.createDataFrame([('{"a": [["/x/1", "p"], ["/y/1", "{\\"text\\": \\"q\\"}"]]}',)], "j string")
    rows = inventory.containers_table(raw, "j")
    assert sorted((r.pos, r.path, r.note) for r in rows.collect()) == [(0, "/x/1", "p"), (1, "/y/1", "q")]
    assert [r.path for r in inventory.delete_first(rows, "a", "1").collect()] == ["/y/1"]
    assert {r.path: r.note for r in inventory.save_note(rows, "a", "/y/1", "z").collect()} == {"/x/1": "p", "/y/1": "z"}
    more = spark.createDataFrame([("a", "/x/1", "no"), ("a", "/n", "yes")], "container string, path string, note string")
    assert sorted((r.pos, r.path) for r in inventory.add_entries(rows, more).collect()) == [(0, "/x/1"), (1, "/y/1"), (2, "/n")]


def test_like(spark):
    rows = spark.createDataFrame([("Abc", "x"), ("q", "aBcd"), ("z", None)], "name string, content string")
    assert sorted(r.name for r in inventory.like_search(rows, "a_c").collect()) == ["Abc", "q"]


def test_headings_hold_until_the_next_one(spark):
    text = "a\nFIRST PART\nb\nsub:\nc\nother:\nd\n2. Second\ne\nTHIRD PART\nlast:\nf"
    rows = sections.with_blocks(spark.createDataFrame([(text,), ("only text",)], "text string")).collect()
    assert [(b.section, b.subsection) for b in rows[0].blocks] == [("", ""), ("FIRST PART", ""), ("FIRST PART", "sub"), ("FIRST PART", "other"), ("2. Second", ""), ("THIRD PART", ""), ("THIRD PART", "last")]
    assert [tuple(b) for b in rows[1].blocks] == [("", "", "only text")]


def test_common_root(spark):
    root = lambda *p: metadata.common_root(spark.createDataFrame([(x,) for x in p], "p string"), "p").first()[0]
    assert root("/a/b/c.txt", "/a/b/d/e.txt", "/a/bc/f") == "/a"
    assert root("/a/b/c.txt", "/a/b/d/e.txt") == "/a/b"
    assert root("/a/one.txt") == "/a/one.txt"
    one = metadata.with_source(spark.createDataFrame([("/a/one.txt", 2048)], "p string, s long"), "p", "s", "/a/one.txt").first()
    assert (one.rel_path, one.source_folder, one.size_kb) == (".", "one.txt", 2)


def test_running_ids(spark, tmp_path):
    rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("k")).repartition(5)
    got = metadata.with_running_id(rows, ["k"], str(tmp_path / "ids")).collect()
    assert sorted((r.id, r.k) for r in got) == [(i, i) for i in range(500)]
    assert metadata.with_running_id(rows.limit(0), ["k"], str(tmp_path / "none")).count() == 0


def test_search_refuses_vectors_of_another_size(spark):
    chunks = spark.createDataFrame([(1, "f", "red fox", [1.0, 0.0])], "id long, file string, text string, v array<double>")
    with pytest.raises(ValueError):
        retrieval.search(chunks, "id", "file", "text", "v", "fox", [1.0], 2)
    (hit,) = retrieval.search(chunks, "id", "file", "text", "v", "fox", [1.0, 0.0], 2).collect()
    assert hit.id == 1 and abs(hit.final - 0.35) < 1e-9


def test_prompts(spark, tmp_path):
    (tmp_path / "p.json").write_bytes("\ufeff{\"sop_prompt\": \"{context} ? {question}\"}".encode())
    (tmp_path / "bad.json").write_text("{")
    template = retrieval.load_prompts(spark, str(tmp_path / "p.json"))["sop_prompt"]
    assert spark.range(1).select(retrieval.filled(template, F.lit("a {b}"), "q")).first()[0] == "a {b} ? q"
    assert retrieval.load_prompts(spark, str(tmp_path / "bad.json")) == retrieval.load_prompts(spark, str(tmp_path / "none.json")) == {}


def test_known_chunks_and_blanks_in_ratios(spark):
    rows = spark.createDataFrame([("f", 0, "A  b"), ("f", 1, "a b"), ("f", 2, " "), ("g", 0, "x"), ("g", 1, None)], "f string, i int, t string")
    known = spark.createDataFrame([("x",)], "t string").select(F.sha1(F.col("t").cast("binary")).alias("chunk_hash"))
    assert sorted((r.f, r.n_dup) for r in dedup.duplicate_ratio(rows, "f", "t", ["f", "i"], known=known).collect()) == [("f", 1), ("g", 1)]
    assert tuple(dedup.duplicate_summary(rows, "t", ["f", "i"], known).first()) == (1, 2, 0.4)


def test_first_entry_by_order(spark):
    old = spark.createDataFrame([("c", 0, "/a", "n")], "container string, pos int, path string, note string")
    new = spark.createDataFrame([("c", "/x", "two", 2), ("c", "/x", "one", 1), ("c", "/b", "z", 3), ("c", "/a", "again", 0), ("d", "/x", None, 5)], "container string, path string, note string, at int")
    got = {(r.container, r.pos): (r.path, r.note) for r in inventory.add_entries(old, new, "at").collect()}
    assert got == {("c", 0): ("/a", "n"), ("c", 1): ("/x", "one"), ("c", 2): ("/b", "z"), ("d", 0): ("/x", None)}


def test_inventory_list_is_in_natural_order(spark):
    rows = spark.createDataFrame([("/f/file10.pdf", 10), ("/f/file2.PDF", 2_000_000), ("/f/a.txt", None), ("/f/none", 5)], "path string, size long")
    assert [r.file_name for r in inventory.inventory_list(rows, "path", "size").collect()] == ["a.txt", "file2.PDF", "file10.pdf", "none"]
    got = inventory.inventory_list(rows, "path", "size", (".pdf",), 1.0).collect()
    assert [(r.file_name, r.folder, r.ext_files, r.size_mb) for r in got] == [("file2.PDF", "/f", 2, "1.91")]
    assert [r.ext for r in inventory.extension_facets(rows, "path").collect()] == ["", ".pdf", ".txt"]


def test_root_of_a_single_file_may_be_its_folder(spark):
    one = spark.createDataFrame([("/a/b/c.txt",)], "p string")
    assert metadata.common_root(one, "p").first()[0] == "/a/b/c.txt" and metadata.common_root(one, "p", True).first()[0] == "/a/b"
    two = spark.createDataFrame([("/a/b/c.txt",), ("/a/d.txt",)], "p string")
    assert metadata.common_root(two, "p", True).first()[0] == "/a"


def test_groups_of_unlike_sizes_hash_nothing(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "x" * i, i) for i in range(1, 6)] + [(9, "yy", 2)], "id int, t string, n int")
    got = dedup.largest_first(dedup.duplicate_groups(rows, "n", "t", "id")).collect()
    assert got == []
    same = rows.union(spark.createDataFrame([(7, "yy", 2), (8, "xxx", 3)], rows.schema))
    for most in (1_000_000, 0):
        monkeypatch.setattr(dedup, "SIZES", most)
        assert [(r.size, r.n, r.member) for r in dedup.largest_first(dedup.duplicate_groups(same, "n", "t", "id")).collect()] == [(2, 2, 7), (2, 2, 9), (3, 2, 3), (3, 2, 8)]
