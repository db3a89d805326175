"""Chat, licences, sharding, vector search and the pipeline."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.llm import licence, stages
from docsift.llm.chat import preference_pairs, preference_parts, preference_turns
from docsift.llm.sharding import jump, shard_documents
from docsift.llm.vafile import top_k
from tests.llm.helpers import docs

TURNS = "pair_id long, side string, turn long, role string, text string"


def turns(spark, pairs):
    rows = [(p, s, i, role, text) for p, (c, r) in pairs.items() for s, x in (("chosen", c), ("rejected", r)) for i, (role, text) in enumerate(x)]
    return spark.createDataFrame(rows, TURNS).repartition(3)


U, A = ("user", "hi"), ("assistant", "yes")


def test_chat_prefix_once_and_masks(spark):
    pairs = {1: ([U, A, ("user", "more"), A], [U, A, ("user", "more"), ("assistant", "no")]), 2: ([U, A], [U, A]), 3: ([U], []), 4: ([U, A, U], [U, A]), 5: ([A, U], [("user", "yes"), U])}
    got = {r.pair_id: r for r in preference_pairs(preference_turns(turns(spark, pairs))).collect()}
    assert got[1].prompt == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert [got[1].rejected[m.start : m.end] for m in got[1].rejected_mask] == ["no<|im_end|>"]
    assert [got[1].chosen[m.start : m.end] for m in got[1].chosen_mask] == ["yes<|im_end|>"]
    assert got[2].chosen == got[2].rejected == "" and got[2].prompt.count("yes") == 1
    assert got[3].prompt == "" and got[3].chosen and not got[3].rejected
    assert got[4].chosen.count("hi") == 1 and got[4].rejected == ""
    assert got[5].prompt == "" and len(got[5].chosen_mask) == 1 and not got[5].rejected_mask


def test_chat_nulls_repeats_and_empty(spark):
    rows = [(1, "chosen", None, None, None), (1, "rejected", None, None, None), (1, "chosen", 0, "user", "x"), (1, "chosen", 0, "user", "x"), (1, "rejected", 0, "user", "x"), (None, "chosen", 0, "user", "x"), (1, None, 0, "user", "x")]
    d = spark.createDataFrame(rows, TURNS).withColumns({"split_at": F.lit(1), "part": F.lit("q")})
    got = Counter((r.part, r.turn) for r in preference_turns(d).collect())
    assert got == {("chosen", 0): 2, ("rejected", 0): 1, ("chosen", None): 1, ("rejected", None): 1}
    assert preference_turns(d.limit(0)).count() == 0


def test_chat_sides_are_aligned_by_place(spark):
    rows = [(1, "chosen", 0, "user", "hi"), (1, "chosen", 7, "assistant", "yes"), (1, "rejected", 1, "user", "hi"), (1, "rejected", 2, "assistant", "no")]
    (r,) = preference_pairs(preference_turns(spark.createDataFrame(rows, TURNS))).collect()
    assert r.prompt == "<|im_start|>user\nhi<|im_end|>\n" and "yes" in r.chosen and "no" in r.rejected


def test_chat_long_conversations_come_in_parts(spark):
    n, size = 700, 16
    same = [(1, s, 9 * i - 2000, "user", f"t{i}") for s in ("chosen", "rejected") for i in range(n)]
    rest = [(1, "chosen", 9 * (n + i), "assistant", f"c{i}" + "x" * 100_000 * (i == 3)) for i in range(40)]
    d = spark.createDataFrame(same + rest, TURNS).repartition(5)
    got = preference_parts(preference_turns(d), size).orderBy("part_no").collect()
    assert [r.part_no for r in got] == list(range(-(-n // size)))
    assert "".join(r.prompt for r in got) == "".join(f"<|im_start|>user\nt{i}<|im_end|>\n" for i in range(n))
    assert [len(r.chosen_mask) for r in got[:4]] == [16, 16, 8, 0] and all(not r.rejected for r in got)
    assert [got[0].chosen[m.start : m.end] for m in got[0].chosen_mask] == [f"c{i}" + "x" * 100_000 * (i == 3) + "<|im_end|>" for i in range(16)]


def scalar_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.random.default_rng(0).integers(-(2**63), 2**63, 3000)
    for n in (1, 2, 16, 17, 1000):
        assert jump(keys, n).tolist() == [scalar_jump(int(k) % 2**64, n) for k in keys]
    a, b = jump(keys, 16), jump(keys, 17)
    assert set(b[a != b]) == {16} and 0.03 < (a != b).mean() < 0.09


def test_shards(spark):
    texts = [None, "", "é", "same", "same", *map(str, range(200))]
    d = docs(spark, texts).withColumns({"shard": F.lit("x"), "slot": F.lit(1)})
    got = shard_documents(d, 16).collect()
    slots = defaultdict(list)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key") and r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(got) == len(texts)
    again = shard_documents(d.union(d), 16).collect()
    assert len(again) == 2 * len(texts) and {r.doc_id: r.shard for r in again} == {r.doc_id: r.shard for r in got}
    assert shard_documents(d.limit(0)).count() == 0


def test_slots_are_the_same_in_any_session(spark):
    d = docs(spark, [f"t{i}" for i in range(300)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("3", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append({(r.doc_id, r.shard, r.slot) for r in shard_documents(d.repartition(int(n)), 16).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_shared_folder_without_a_setting(spark):
    from docsift.llm._spark import shared_dir

    class Session:
        conf = {"spark.sql.warehouse.dir": "hdfs://x/warehouse/"}

    assert shared_dir(Session) == "hdfs://x/warehouse"

    class Cluster:
        conf = {"spark.sql.warehouse.dir": "file:/x/warehouse"}

        class sparkContext:  # noqa: N801
            master = "yarn"

    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_dir(Cluster)
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_exact_top_k(spark, monkeypatch):
    import docsift.llm.vafile as v

    monkeypatch.setattr(v, "BLOCK", 7)
    monkeypatch.setattr(v, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 6)).astype(np.float32)
    x[10:30] = x[10]  # ties
    rows = [(i, [float(a) for a in r]) for i, r in enumerate(x)] + [(100, None), (101, [1.0] * 5 + [None]), (102, [float("nan")] * 6), (103, [float("inf")] * 6), (104, [1.0, 2.0]), (105, [3.0, 4.0]), (106, []), (0, [9.0] * 6), (107, [1e12] * 6), (108, [1e12] * 6)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).repartition(4)
    got = defaultdict(list)
    for r in top_k(d.where("vec_id % 10 = 0 or vec_id = 104"), d, 5, groups=3).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ok = [(i, [math.floor(1024 * a) for a in np.array(e, np.float32).astype(float)]) for i, e in rows if e is not None and all(a is not None and math.isfinite(a) for a in e)]
    for q, a in ok:
        if q and (q % 10 == 0 and q < 100 or q == 104):
            every = sorted((-max(-(2**63), min(2**63 - 1, sum(s * t for s, t in zip(a, b)))), i) for i, b in ok if i != q and len(b) == len(a))[:5]
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(every)]
    assert top_k(d.limit(0), d).count() == 0
    assert top_k(d, d.limit(0)).count() == 0


def brute_top(x, ids, queries, k):
    whole = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    out = set()
    for q in queries:
        s = whole @ whole[q]
        best = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out |= {(int(ids[q]), r + 1, int(ids[i]), int(s[i])) for r, i in enumerate(best)}
    return out


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)


def test_floors_are_handed_on_and_few_exact_vectors_are_read(spark, monkeypatch):
    import docsift.llm.vafile as v

    monkeypatch.setattr(v, "BLOCK", 64)
    x = np.random.default_rng(2).normal(size=(6000, 16)).astype(np.float32)
    d, k, groups = vectors(spark, x), 10, 8
    queries = d.where("vec_id % 60 = 0")
    exact, asked = v._candidates(d, k, groups), v._rows(queries).select(F.monotonically_increasing_id().alias("rid"), F.lit(0).alias("g"), "vec_id", "embedding")
    open_ = v.open_candidates(v.staged(asked, "asked"), exact, k, groups)
    read = open_.count()
    # 100 queries meet 6000 vectors in 94 blocks: k rows for each block would be 94,000
    assert 100 * k <= read <= 100 * 4 * k and not open_.where("crowd").count()
    assert {tuple(r) for r in top_k(queries, d, k, groups).collect()} == brute_top(x, np.arange(6000), range(0, 6000, 60), k)


def test_copies_and_crowds_of_vectors(spark, monkeypatch):
    import docsift.llm.vafile as v

    monkeypatch.setattr(v, "CROWD", 2)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 8)).astype(np.float32)
    x[:500] = x[0]  # a third are copies
    x[500:1000] = x[500] + rng.normal(size=(500, 8)).astype(np.float32) / 2000  # closer together than a cell is wide
    d = vectors(spark, x)
    exact = v._candidates(d, 5, 4)
    assert exact.count() == 1000 + 6
    asked = v._rows(d.where("vec_id = 700")).select(F.lit(0).cast("long").alias("rid"), F.lit(0).alias("g"), "vec_id", "embedding")
    assert v.open_candidates(asked, exact, 5, 4).where("crowd").count()
    assert {tuple(r) for r in top_k(d.where("vec_id % 50 = 0"), d, 5, 4).collect()} == brute_top(x, np.arange(1500), range(0, 1500, 50), 5)


FILES = {
    "r/a/LICENSE": "Licensed under the Apache License, Version 2.0.",
    "r/a/b/c/x.py": "print(1)",
    "r/a/own.py": "# Released under the MIT License.\nprint(1)",
    "r/z/none.py": "no words about it, though a license is mentioned somewhere in a very long sentence about many other things entirely",
    "r/a/b/COPYING": "This work is licensed under the GNU General Public License,\nversion 3.",
    "r/a/q.py": None,
    "top.py": "",
}


def files(spark):
    rows = [(i, p, t) for i, (p, t) in enumerate(FILES.items())] + [(99, None, "Released under the MIT License.")]
    return spark.createDataFrame(rows, "doc_id long, path string, text string").repartition(2)


def brute_best(texts):
    """text -> (licence, similarity) by the definition, in Python."""
    term = lambda s: re.findall(licence.TERM, s.lower())
    n = len(texts)
    df = Counter(w for t in texts for w in set(term(t or "")))
    vocabulary = {w for ts in licence.TEMPLATES.values() for t in ts for w in term(t)}
    idf = lambda w: math.log(min(licence.RAREST, (1 + n) / (1 + df[w]) if w in vocabulary else 1 + n)) + 1
    vec = lambda ws: {w: c * idf(w) for w, c in Counter(ws).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = []
    for t in texts:
        lines, found = re.split("\r?\n", t or ""), []
        for i, x in enumerate(lines):
            if re.search(licence.ANCHOR, x):
                at = max(i, 1) - 1
                for passage in (x, " ".join(lines[at : at + 3]), t):
                    u = vec(term(passage))
                    for name, ts in licence.TEMPLATES.items():
                        for k in ts:
                            w = vec(term(k))
                            found.append((-round(sum(u.get(z, 0) * w[z] for z in w) / norm(u) / norm(w), 6), name))
        s, name = min(found, default=(0, None))
        out.append((name, -s) if -s >= licence.THRESHOLD else (None, None))
    return out


def test_licences(spark):
    got = {r.path: r for r in licence.scan_licences(files(spark), "doc_id").collect()}
    want = brute_best([*FILES.values(), "Released under the MIT License."])
    for path, (name, similarity) in zip([*FILES, None], want):
        assert got[path].own_licence == name
        assert similarity is None or abs(got[path].similarity - similarity) < 2e-6
    assert (got["r/a/b/c/x.py"].licence, got["r/a/b/c/x.py"].inherited_from) == ("GPL-3.0", "r/a/b")
    assert (got["r/a/q.py"].licence, got["r/a/q.py"].inherited_from) == ("Apache-2.0", "r/a")
    assert (got["r/a/own.py"].licence, got["r/a/own.py"].inherited_from) == ("MIT", None)
    assert got["r/z/none.py"].licence is None and got["top.py"].licence is None and got[None].licence == "MIT"


def test_licences_of_repeated_rows_and_empty_table(spark):
    d = files(spark).withColumns({"dir": F.lit("x"), "holder": F.lit(1)})
    assert licence.scan_licences(d.union(d), "doc_id").count() == 2 * d.count()
    assert licence.scan_licences(d.limit(0), "doc_id").count() == 0


def test_a_licence_does_not_depend_on_the_number_of_files(spark):
    headers = ["Acme: Released under the MIT License", "Copyright 2020 Acme. Released under the MIT License"]
    rng = np.random.default_rng(2)
    for n in (5_000, 50_000):
        some = spark.range(n).select((F.col("id") + 100).alias("doc_id"), F.lit("a/b.txt").alias("path"), F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.col("id") % int(m)) for k, m in enumerate(rng.integers(3, 900, 6))]).alias("text"))
        d = some.union(spark.createDataFrame([(i, f"x/{i}.py", h) for i, h in enumerate(headers)], "doc_id long, path string, text string"))
        got = [(r.own_licence, r.similarity) for r in licence.scan_licences(d, "doc_id").where("doc_id < 100").orderBy("doc_id").collect()]
        assert got[0][0] == "MIT"
        first = got if n == 5_000 else first
        assert all(a == b and abs((x or 0) - (y or 0)) < 0.01 for (a, x), (b, y) in zip(got, first))


def test_a_whole_licence_file_is_compared(spark):
    text = licence.TEMPLATES["ISC"][1].replace(". ", ".\n").replace(", ", ",\n")
    (r,) = licence.scan_licences(spark.createDataFrame([(1, "a/LICENSE", "Copyright (c) 2019 Jane Doe\n\n" + text)], "doc_id long, path string, text string"), "doc_id").collect()
    assert r.own_licence == "ISC" and r.similarity > 0.9 and r.line == 0


@pytest.mark.parametrize("build", [lambda s: preference_turns(turns(s, {1: ([U], [A])})), lambda s: licence.scan_licences(files(s), "doc_id")])
def test_native(spark, build):
    plan = build(spark)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_stages_decide_and_keep_columns(spark, tmp_path):
    good = "the quick brown fox jumps over the lazy dog and runs into the green wood where other animals live and eat bread with honey every morning before the rain falls on the roof of our old house near the river that flows down to the sea past the mill and the bridge and a tower of grey stone"
    texts = [good + " one", good + " one", "spam " * 80, good[:240] + " call +1 (285) 555-0658 now or write to me about the many things we saw in the garden last summer", None]
    d = docs(spark, texts, ["a", "a", "b", "b", "c"]).withColumns({"kept": F.lit("x"), "node": F.lit(1)})
    spark.createDataFrame([(0, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    q = stages.quality(spark, d, str(tmp_path))
    assert q.columns == d.columns and sorted(r.doc_id for r in q.collect()) == [0, 1, 3]
    n = stages.near_dedup(spark, q.union(q), str(tmp_path))
    assert n.columns == d.columns and sorted(r.doc_id for r in n.collect()) == [0, 3]
    p = stages.pii(spark, n, str(tmp_path))
    assert p.columns == d.columns
    assert {r.doc_id: "<PHONE>" in r.text and r.n_chars == len(r.text) for r in p.collect()} == {0: False, 3: True}
    m = stages.mixing(spark, p, str(tmp_path))
    assert m.columns == d.columns and {r.doc_id for r in m.collect()} == {0, 3}
    assert {r.doc_id for r in stages.packing(spark, m, str(tmp_path)).collect()} == {0, 3}


HEADERS = {
    "// SPDX-License-Identifier: MIT": "MIT",
    "# SPDX-License-Identifier: (Apache-2.0 OR MIT)": "Apache-2.0",
    "/* SPDX-License-Identifier: GPL-2.0-only */": "GPL-2.0",
    "SPDX-License-Identifier: LGPL-2.1+": "LGPL-2.1",
    "SPDX-License-Identifier: EPL-2.0": None,
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.": "LGPL-2.1",
    "This file is not licensed under the MIT License": None,
    "This file is NOT released under the MIT License.": None,
    "Licensed under the Apache License, Version 2.0": "Apache-2.0",
    "Released under the MIT License": "MIT",
}


def test_tags_are_exact_and_denials_say_nothing(spark):
    rows = [(i, f"src{i}/a.c", f"x = 1\n{h}\ny = 2") for i, h in enumerate(HEADERS)] + [(99, "t/a.c", "Released under the MIT License\nSPDX-License-Identifier: Zlib\nSPDX-License-Identifier: ISC")]
    got = {r.doc_id: r for r in licence.scan_licences(spark.createDataFrame(rows, "doc_id long, path string, text string"), "doc_id").collect()}
    assert [got[i].own_licence for i in range(len(HEADERS))] == list(HEADERS.values())
    assert (got[0].similarity, got[0].line) == (1.0, 1) and (got[99].own_licence, got[99].line) == ("Zlib", 1)
