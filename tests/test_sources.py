import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from docsift.sources import files, sqlite, store, versions
from docsift.streaming.ingest import watch


def office(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)


def test_scan_and_extract(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.TXT").write_bytes(b"caf\xc3\xa9 \xff")
    (tmp_path / "sub/b.csv").write_text('x,"y, z"\n1,2\n')
    (tmp_path / "c.json").write_text('{"k":"\u00e9"}')
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "d.html").write_text("<p>one<script>no</script><b>two</b></p>")
    (tmp_path / "e.bin").write_bytes(b"\0")
    w = "xmlns:w='u'"
    office(tmp_path / "f.docx", {"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>p</w:t><w:t>1</w:t></w:r></w:p><w:p/></w:body></w:document>"})
    office(tmp_path / "g.xlsx", {"xl/sharedStrings.xml": "<sst><si><t>Hit</t></si></sst>", "xl/worksheets/sheet1.xml": "<worksheet><sheetData><row><c r='A1' t='s'><v>0</v></c><c r='C1'><v>7</v></c></row><row><c r='A2'><v>0</v></c></row></sheetData></worksheet>"})
    office(tmp_path / "h.pptx", {"ppt/slides/slide1.xml": "<p xmlns:a='a'><sp><txBody><a:p><a:t>t1</a:t></a:p><a:p><a:t>t2</a:t></a:p></txBody></sp></p>"})
    found = files.scan(spark, str(tmp_path))
    assert "content" not in found.select("path", "size")._jdf.queryExecution().executedPlan().toString()
    text = {r.name: r.text for r in files.with_text(found).collect()}
    assert text == {"a.TXT": "café \ufffd", "b.csv": "x, y, z\n1, 2", "c.json": json.dumps({"k": "é"}, indent=2, ensure_ascii=False), "bad.json": "", "d.html": "one\ntwo", "e.bin": "", "f.docx": "p1\n", "g.xlsx": "Hit\t\t7\n0", "h.pptx": "t1\nt2"}
    assert files.scan(spark, str(tmp_path), (".txt", ".csv")).count() == 2
    hit = files.rows_with(files.sheet_rows(found), "hIt").collect()
    assert [r.display for r in hit] == ["Hit |  | 7"]


def test_references_of_pages_end_with_a_semicolon(spark, tmp_path):
    assert files.html_text("<title>a&amp;&amp</title><p>&lt;b&gt; &#233;&#xE9; &ampx; &zz; &copy=1 & &amp;lt;</p>&amp") == "a&&amp\n<b> éé &ampx; &zz; &copy=1 & &lt;\n&amp"
    assert files.html_text("<script>&amp</script><a href='?a&amp=1'>x</a>") == "x"


def test_sqlite(spark, tmp_path):
    for i in (1, 2):
        with sqlite3.connect(tmp_path / f"{i}.db") as db:
            db.execute("CREATE TABLE files (name, path, content)")
            db.executemany("INSERT INTO files VALUES (?, ?, ?)", [("BASE_PATH", f"/root{i}", None), ("n", "d/n", f"text {i}"), ("m", "/abs/m", None)])
    rows = sqlite.absolute(sqlite.read(spark, [str(tmp_path / "1.db"), str(tmp_path / "2.db")]))
    got = sorted((r.name, r.abs_path) for r in rows.where("name != 'BASE_PATH'").collect())
    assert got == [("m", "/abs/m"), ("m", "/abs/m"), ("n", "/root1/d/n"), ("n", "/root2/d/n")]


def test_sqlite_looks_for_the_keyword_itself(spark, tmp_path):
    with sqlite3.connect(tmp_path / "1.db") as db:
        db.execute("CREATE TABLE files (name, path, content)")
        db.executemany("INSERT INTO files VALUES (?, ?, ?)", [("Pump", "a", None), ("n", "b", "the PUMP"), ("m", "c", "fan")])
    got = sqlite.search(spark, [str(tmp_path / "1.db")] * 2, "pump")
    assert sorted(r.path for r in got.collect()) == ["a", "a", "b", "b"]
    assert sqlite.search(spark, [str(tmp_path / "1.db")], "").count() == 3


def test_listed_files(spark, tmp_path):
    for n in ("b.txt", "a.MD", "c.bin"):
        (tmp_path / n).write_text(n)
    at = [str(tmp_path / n) for n in ("b.txt", "a.MD", "b.txt", "c.bin")]
    assert [r.name for r in files.listed(spark, at).collect()] == ["a.MD", "b.txt"]
    with pytest.raises(ValueError):
        files.listed(spark, [str(tmp_path / "c.bin")])
    with pytest.raises(Exception):  # noqa: B017  Spark's own, for a missing path
        files.listed(spark, [str(tmp_path / "none.txt")]).collect()


LONG = "This paragraph is long enough to be kept as a chunk of its own, because it has more than eighty characters. {}"


def table(spark, *rows):
    return spark.createDataFrame([(p, 1, len(t), t) for p, t in rows], "path string, mtime long, size long, text string")


def test_store_append_adds_once(spark, tmp_path):
    at = str(tmp_path / "s")
    store.build(table(spark, ("/a", LONG.format("a"))), at)
    assert store.read(spark, at).count() == 1 and store.config_of(spark, at).dim == 384
    more = table(spark, ("/b", LONG.format("b")), ("/c", LONG.format("a")), ("/d", "short"))
    assert store.append(more, at) == 1
    assert store.append(more, at) == 0
    assert [r.path for r in store.manifest(spark, at).collect()] == ["/b"]
    norms = store.read(spark, at).select(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).collect()
    assert all(abs(r[0] - 1) < 1e-5 for r in norms)


def test_repeats_in_the_store_and_in_the_batch_count_together(spark, tmp_path):
    at = str(tmp_path / "s")
    para = lambda i: (f"Paragraph {i} has words " + f"number{i} " * 120).strip()  # noqa: E731  a chunk of its own
    text = lambda *i: "\n".join(f"PART NUMBER {k} OF THIS\n{para(k)}" for k in i)
    store.build(table(spark, ("/old", text(*range(10)))), at)
    assert store.read(spark, at).count() == 10
    # ten chunks of the store, eight of a file before it, two that are new
    batch = table(spark, ("/a", text(*range(20, 28))), ("/b", text(*range(10), *range(20, 28), 30, 31)))
    assert store.append(batch, at) == 8
    assert {r.path for r in store.read(spark, at).collect()} == {"/old", "/a"}
    assert store.config_of(spark, at).base_path == "/old"
    with pytest.raises(ValueError):
        store.read(spark, at, 64)
    assert [tuple(r) for r in store.stores_in(spark, str(tmp_path)).collect()] == [("s", True)]


def test_watched_folder(spark, tmp_path):
    at, folder = str(tmp_path / "s"), tmp_path / "in"
    folder.mkdir()
    store.build(table(spark, ("/a", LONG.format("a"))), at)
    (folder / "x.txt").write_text(LONG.format("x"))
    for want in (2, 2):
        watch(spark, str(folder), at, str(tmp_path / "c")).awaitTermination(120)
        assert store.read(spark, at).count() == want
    (folder / "y.txt").write_text(LONG.format("y"))
    watch(spark, str(folder), at, str(tmp_path / "c")).awaitTermination(120)
    assert store.read(spark, at).count() == 3


def test_store_search_and_versions(spark, tmp_path):
    at = str(tmp_path / "s")
    files_of = lambda *names: table(spark, *[(f"/lib/{n}.txt", LONG.format(f"{n} pump " * i)) for i, n in enumerate(names, 1)])
    store.build(files_of("a", "b"), at, store.StoreConfig(dim=16))
    assert store.append(files_of("c", "d", "e"), at) == 3
    got = store.read(spark, at).orderBy("id").collect()
    assert [r.id for r in got] == list(range(5)) and [r.file_name for r in got] == ["a.txt", "b.txt", "c.txt", "d.txt", "e.txt"]
    assert {(r.source_folder, r.file_type, r.size_kb, r.chunk_len == len(r.chunk), r.abs_path == f"/lib/{r.rel_path}") for r in got} == {("lib", "txt", 0, True, True)}
    # a reader may stay with an older version
    assert store.read(spark, at, version=1).count() == 2 and store.manifest(spark, at, version=1).count() == 0 and store.manifest(spark, at).count() == 3
    with pytest.raises(ValueError):
        store.read(spark, at, version=7)
    vector = got[4].embedding
    best = store.search(spark, at, "pump", list(vector), min_score=0.0).collect()
    assert best[0].file_name == "e.txt"
    old = store.search(spark, at, "pump", list(vector), min_score=0.0, version=1).collect()
    assert {r.file_name for r in old} <= {"a.txt", "b.txt"}
    with pytest.raises(ValueError):
        store.search(spark, at, "pump", [1.0])


def test_a_batch_that_ends_between_its_parts_is_not_seen(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "s")
    store.build(table(spark, ("/a", LONG.format("a"))), at)
    more = table(spark, ("/b", LONG.format("b")))
    write = store.membership.filter_of
    monkeypatch.setattr(store.membership, "filter_of", lambda *a: (_ for _ in ()).throw(OSError("ended")))
    with pytest.raises(OSError):
        store.append(more, at, batch="x1")
    assert (tmp_path / "s/chunks/batch=x1").exists() and store.read(spark, at).count() == 1 and store.manifest(spark, at).count() == 0
    monkeypatch.setattr(store.membership, "filter_of", write)
    assert store.append(more, at, batch="x1") == 1 and store.append(more, at, batch="x1") == 0
    assert store.read(spark, at).count() == 2 and store.manifest(spark, at).count() == 1


def test_two_writers_and_a_version_without_its_row(spark, tmp_path):
    at = str(tmp_path / "s")
    first = versions.snapshot(spark, at)
    one = versions.commit(spark, first, "one", ["chunks"], {"chunks": 2})
    with pytest.raises(versions.Conflict):
        versions.commit(spark, first, "two", ["chunks"], {"chunks": 3})
    (tmp_path / "s/commits/version=2/_temporary").mkdir(parents=True)
    assert versions.snapshot(spark, at).version == 1
    two = versions.commit(spark, one, "two", ["chunks"], {"chunks": 3})
    assert two.batches == ("one", "two") and two.total("chunks") == 5
    with pytest.raises(ValueError):
        versions.commit(spark, two, "a/b", [], {})


def test_store_with_lists(spark, tmp_path):
    at = str(tmp_path / "s")
    texts = [(f"/lib/f{i}.txt", LONG.format(f"word{i % 5} " * (5 + i))) for i in range(40)]
    store.build(table(spark, *texts[:30]), at, store.StoreConfig(dim=16, index_type="ivf", lists=4))
    assert store.append(table(spark, *texts[30:]), at) == 10
    assert 1 <= store.config_of(spark, at).probes <= 4
    q = list(store.read(spark, at).where("file_name = 'f33.txt'").first().embedding)
    plain = [(r.id, r.final) for r in store.search(spark, at, "word3", q, exact=True).collect()]
    near = [(r.id, r.final) for r in store.search(spark, at, "word3", q).collect()]
    assert near[0] == plain[0] and len(near) == len(plain) == 8
    centres = store.ivf.load(spark, f"{at}/centres")
    assert len(centres) == 4


def test_append_paths_takes_what_is_there_and_of_its_kinds(spark, tmp_path):
    at, folder = str(tmp_path / "s"), tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    store.build(table(spark, ("/a", LONG.format("a"))), at)
    for n in ("x.txt", "y.md", "z.csv", "sub/w.TXT"):
        (folder / n).write_text(LONG.format(n))
    assert store.append_paths(spark, [str(folder / "x.txt"), str(folder / "none.txt"), str(folder / "z.csv"), str(folder / "sub"), str(folder / "x.txt")], at) == 2
    assert store.append_paths(spark, [str(folder / "none.txt")], at) == 0
    assert store.append_paths(spark, [str(folder)], at) == 1
    assert sorted(r.file_name for r in store.read(spark, at).where("file_type is not null and path != '/a'").collect()) == ["w.TXT", "x.txt", "y.md"]


BOOK = {
    "xl/workbook.xml": "<workbook xmlns:r='r'><sheets><sheet name='B' r:id='rId2'/><sheet name='A' r:id='rId1'/></sheets></workbook>",
    "xl/_rels/workbook.xml.rels": "<Relationships><Relationship Id='rId1' Target='worksheets/sheet1.xml'/><Relationship Id='rId2' Target='/xl/worksheets/sheet2.xml'/></Relationships>",
    "xl/styles.xml": "<styleSheet><numFmts><numFmt numFmtId='164' formatCode='yyyy\\-mm\\-dd'/><numFmt numFmtId='165' formatCode='0.00\" days\"'/></numFmts><cellXfs><xf numFmtId='0'/><xf numFmtId='14'/><xf numFmtId='164'/><xf numFmtId='165'/><xf numFmtId='20'/></cellXfs></styleSheet>",
    "xl/worksheets/sheet1.xml": "<worksheet><sheetData><row><c r='A1'><v>1</v></c></row></sheetData></worksheet>",
    "xl/worksheets/sheet2.xml": "<worksheet><sheetData><row><c r='A1' t='b'><v>1</v></c><c r='B1' s='1'><v>45322</v></c><c r='C1' s='2'><v>45322.5</v></c><c r='D1' s='3'><v>2.5</v></c><c r='E1' s='4'><v>0.25</v></c><c r='F1' t='inlineStr'><is><t>in</t></is></c><c r='G1' t='b'><v>0</v></c></row></sheetData></worksheet>",
    "xl/worksheets/sheet9.xml": "<worksheet><sheetData><row><c r='A1'><v>9</v></c></row></sheetData></worksheet>",
}


def test_workbook_order_and_typed_cells(spark, tmp_path):
    office(tmp_path / "b.xlsx", BOOK)
    found = files.scan(spark, str(tmp_path))
    want = "True\t2024-01-31 00:00:00\t2024-01-31 12:00:00\t2.5\t06:00:00\tin\tFalse\n1"
    assert files.with_text(found).first().text == want
    assert [(r.unit, r.number) for r in files.parts(found).orderBy("number").collect()] == [("sheet", 0), ("sheet", 1)]
    assert files.joined_text(files.parts(found)).first().text == want


def test_files_that_cannot_be_read_are_rows_of_their_own(spark, tmp_path):
    office(tmp_path / "ok.xlsx", BOOK)
    office(tmp_path / "half.xlsx", BOOK | {"xl/worksheets/sheet1.xml": "<worksheet"})
    (tmp_path / "bad.docx").write_bytes(b"no archive")
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "e.bin").write_bytes(b"1")
    (tmp_path / "t.txt").write_text("text")
    (tmp_path / "own.bin2").write_text("x")
    p = files.parts(files.scan(spark, str(tmp_path)), {".bin2": lambda b: b.decode() * 2})
    name = lambda path: path.rsplit("/", 1)[1]
    bad = {(name(r.path), r.number, r.error.split(":")[0]) for r in files.errors(p).collect()}
    assert bad == {("half.xlsx", 1, "ParseError"), ("bad.docx", 0, "BadZipFile"), ("bad.json", 0, "JSONDecodeError"), ("e.bin", 0, "ValueError")}
    assert {name(r.path): r.text for r in files.joined_text(p).collect()}.keys() == {"ok.xlsx", "t.txt", "own.bin2"}
    # what was read before the fault is there
    assert p.where("path like '%half.xlsx' and text is not null").count() == 1


def test_configuration_from_the_session(spark):
    assert store.configured(spark) == store.StoreConfig()
    spark.conf.set("spark.docsift.store.min_chunk_len", "5")
    spark.conf.set("spark.docsift.store.normalize_embeddings", "false")
    spark.conf.set("spark.docsift.store.recall", "0.9")
    try:
        got = store.configured(spark)
        assert (got.min_chunk_len, got.normalize_embeddings, got.recall) == (5, False, 0.9)
    finally:
        for f in ("min_chunk_len", "normalize_embeddings", "recall"):
            spark.conf.unset(f"spark.docsift.store.{f}")


def test_sqlite_by_ranges_of_rows(spark, tmp_path):
    with sqlite3.connect(tmp_path / "1.db") as db:
        db.execute("CREATE TABLE files (name, path, content)")
        db.executemany("INSERT INTO files (rowid, name, path, content) VALUES (?, ?, ?, ?)", [(3 * i + 7, f"n{i}", f"p{i}", i if i % 2 else b"\xff bytes") for i in range(50)])
        db.execute("CREATE VIEW seen AS SELECT name, path, content FROM files WHERE name < 'n3'")
        db.execute("CREATE TABLE keyed (name PRIMARY KEY, path, content) WITHOUT ROWID")
        db.execute("INSERT INTO keyed VALUES ('k', 'p', NULL)")
        db.execute("CREATE TABLE none (name, path, content)")
    at = str(tmp_path / "1.db")
    spark.dataSource.register(sqlite.SqliteFiles)
    rows = spark.read.format("sqlite_files").option("paths", at).option("rows", "20").load()
    assert rows.rdd.getNumPartitions() == 8
    got = {r.name: (r.path, r.content) for r in rows.collect()}
    assert len(got) == 50 and got["n3"] == ("p3", "3") and got["n2"] == ("p2", "� bytes")
    assert sqlite.read(spark, [at], "seen").count() == sum(f"n{i}" < "n3" for i in range(50))
    assert [tuple(r) for r in sqlite.read(spark, [at], "keyed").collect()] == [("k", "p", None, at)]
    assert sqlite.read(spark, [at], "none").count() == 0
    assert spark.read.format("sqlite_files").option("paths", at).option("rows", "9").option("keyword", "N4").load().count() == 11
