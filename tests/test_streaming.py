"""Streams of chunks with keyed state."""

import os

import pytest

from docsift.sources import versions
from docsift.streaming import first_seen

PARA = "This paragraph number {} is long enough to be kept, because it says what it says in more than eighty letters."


def texts():
    return {f"f{i}.txt": "\n".join(f"PART NUMBER {k} OF IT\n{PARA.format(k)}" for k in ks) for i, ks in enumerate([(1, 2, 3), (3, 4), (1, 2, 3), (5, 5), (4, 5, 6)])}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    for i, (n, t) in enumerate(texts().items()):
        (tmp_path / "in" / n).write_text(t)
        os.utime(tmp_path / "in" / n, (1_000_000 + i, 1_000_000 + i))  # in order
    return tmp_path


def run(spark, at, to, per_batch):
    first_seen.watch(spark, str(at / "in"), str(at / to), str(at / f"{to}-check"), per_batch, target=100, most=200).awaitTermination(300)
    state = versions.snapshot(spark, str(at / to))
    found = {(r.path.rsplit("/", 1)[1], r.chunk_id, r.chunk_hash) for r in state.read(spark, "chunks").collect()}
    per = {r.path.rsplit("/", 1)[1]: (r.n_chunks, r.n_dup) for r in first_seen.counters(spark, str(at / to)).collect()}
    return state, found, per


def test_small_batches_equal_one_batch_and_a_restart_adds_nothing(spark, folder):
    one, found, per = run(spark, folder, "one", 100)
    many, found_2, per_2 = run(spark, folder, "many", 2)
    assert one.version == 1 and many.version == 3
    assert found == found_2 and per == per_2
    assert len({h for _, _, h in found}) == len(found)
    assert per["f0.txt"] == (3, 0) and per["f2.txt"] == (3, 3) and per["f3.txt"] == (2, 1)
    again, found_3, per_3 = run(spark, folder, "many", 2)
    assert again.version == 3 and found_3 == found_2 and per_3 == per_2
    (folder / "in" / "g.txt").write_text(texts()["f0.txt"] + "\nPART NUMBER 77 OF IT\n" + PARA.format(77))
    more, found_4, per_4 = run(spark, folder, "many", 2)
    assert more.version == 4 and len(found_4) == len(found_2) + 1 and per_4["g.txt"] == (4, 3)


def test_a_batch_tried_again_adds_nothing(spark, folder, monkeypatch):
    commit = versions.commit
    monkeypatch.setattr(first_seen.versions, "commit", lambda *a: (_ for _ in ()).throw(OSError("ended")))
    with pytest.raises(Exception):  # noqa: B017  Spark's own, around ours
        run(spark, folder, "one", 100)
    assert versions.snapshot(spark, str(folder / "one")).version == 0
    monkeypatch.setattr(first_seen.versions, "commit", commit)
    _, found, per = run(spark, folder, "one", 100)
    assert per["f2.txt"] == (3, 3) and len(found) == 6
