import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer  # noqa: I001

from pyspark.sql import functions as F

from docsift.llm import tokens
from docsift.llm.simple8b import Block, digest, pack, read_block, read_documents, read_token_files, unpack, write_block, write_token_files
from docsift.llm.tokens import encode
from tests.llm.helpers import docs

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)
TEXTS = [
    None, "", " ", "Hello, World! it's 3.5% <|endoftext|> x", "Ñandú été ÉTÉ à la\x1cfois", "don't can't 'll", "a" * 3000, "日本語 テキスト 😀!!", "ß ẞ İ ı ſ",
    "end.\n\nnew... **bold** $$$ th***", "<|EndOfText|> <|startoftext|>x", "o'clock 'S it'S,", "x,y;z-a_b", "́ combining first", "１２３ fullwidth",
]


def ids(text, end):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [end]


@pytest.mark.parametrize("text", TEXTS)
def test_word_lookup_equals_the_tokenizer(text):
    assert np.frombuffer(encode(text, PATH, 2), "<u4").tolist() == ids(text, 2)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aAbé'.,!5 \ń<|sStT"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_word_lookup_equals_the_tokenizer_on_anything(text):
    assert np.frombuffer(encode(text, PATH, 2), "<u4").tolist() == ids(text, 2)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 49407), st.integers(0, 2**64 - 1)), max_size=300))
def test_pack_round_trip(values):
    v = np.array(values, np.uint64)
    words, places, escaped = pack(v)
    assert unpack(words, len(v), places, escaped).tolist() == values


def test_small_values_share_words():
    assert len(pack(np.ones(600, np.uint64))[0]) == 10
    assert len(pack(np.full(600, 40000, np.uint64))[0]) == 200


def test_block_round_trip():
    lists = [np.arange(5, dtype=np.uint64), np.empty(0, np.uint64), np.array([2**63, 1], np.uint64)]
    got = read_block(write_block([7, None, -3], lists))
    assert got[0] == [7, None, -3]
    assert [x.tolist() for x in got[1]] == [x.tolist() for x in lists]
    assert read_block(write_block([], [])) == ([], [])


def test_files_hold_every_document_in_order(spark, tmp_path, monkeypatch):
    texts = TEXTS * 3
    write_token_files(docs(spark, texts), str(tmp_path / "t"), 2)
    start, want = 0, []
    for i, t in enumerate(texts):
        x = ids(t, 2)
        want.append((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    assert sorted(tuple(r) for r in read_token_files(spark, str(tmp_path / "t"), "c long", digest).collect()) == want
    whole = {r.doc_id: r.ids for r in read_token_files(spark, str(tmp_path / "t")).collect()}
    assert whole == {i: ids(t, 2) for i, t in enumerate(texts)}


def test_repeated_and_null_ids(spark, tmp_path):
    d = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (0, None)], "doc_id long, text string")
    write_token_files(d, str(tmp_path / "t"), 2)
    got = [(r.doc_id, r.start, r.n_tokens) for r in read_token_files(spark, str(tmp_path / "t")).orderBy("start").collect()]
    assert got == [(None, 0, 2), (0, 2, 1), (1, 3, 2), (1, 5, 2)]


def test_empty_table(spark, tmp_path):
    write_token_files(docs(spark, ["a"]).limit(0), str(tmp_path / "t"), 2)
    assert read_token_files(spark, str(tmp_path / "t")).count() == 0


def test_values_from_any_frame():
    rng = np.random.default_rng(5)
    lists = [rng.integers(0, 50000, n).astype(np.uint64) for n in (1, 3000, 0, 20_000, 7, 4096)]
    lists[3][[0, 999, 19_999]] = 2**63 + 5
    b, every = Block(write_block([1, 2, 3, 4, 5, 6], lists)), np.concatenate(lists)
    assert len(b.frames) > 40
    for start, stop in [(0, 0), (0, 1), (0, b.n), (b.n - 1, b.n), *map(sorted, rng.integers(0, b.n + 1, (200, 2)).tolist())]:
        assert b.values(start, stop).tolist() == every[start:stop].tolist()
    assert [b.document(i).tolist() for i in range(6)] == [x.tolist() for x in lists]


def test_reader_starts_at_a_frame(spark, tmp_path, monkeypatch):
    import docsift.llm.simple8b as m

    texts = [f"number {i} " * (50 * i) for i in range(60)] + ["w " * 300_000]
    write_token_files(docs(spark, texts).withColumns({"tie": F.lit(1), "block": F.lit("x"), "part": F.lit(2)}), str(tmp_path / "t"), 2)
    got = {r.doc_id: r.ids for r in read_documents(spark, str(tmp_path / "t"), [3, 59, 60, 77]).collect()}
    assert got == {i: ids(texts[i], 2) for i in (3, 59, 60)}
    (block,) = [Block(r.block) for r in spark.read.parquet(str(tmp_path / "t")).collect() if 59 in Block(r.block).doc_ids]
    decoded, unpack_all = [], m.unpack
    monkeypatch.setattr(m, "unpack", lambda words, *rest: decoded.append(len(words)) or unpack_all(words, *rest))
    block.document(block.doc_ids.index(59))
    assert decoded[0] < len(block.words)


def test_rows_of_one_id_have_an_order(spark, tmp_path):
    d = spark.createDataFrame([(1, f"text {i}" + " x" * i) for i in range(40)], "doc_id long, text string")
    found = []
    for n in (1, 7):
        write_token_files(d.repartition(n), str(tmp_path / f"t{n}"), 2)
        found.append([(r.start, r.n_tokens) for r in read_token_files(spark, str(tmp_path / f"t{n}")).orderBy("start").collect()])
    assert found[0] == found[1] and len(found[0]) == 40


def test_words_of_latin_letters_are_looked_up_in_the_model():
    path = tokens.vocabulary(None)
    own = tokens.WordIds(path)
    letters = [chr(c) for c in [*range(0x61, 0x7B), *range(0xC0, 0x100)] if c not in (0xD7, 0xF7)]
    words = [*letters, *(a + b for a in letters[26:] for b in letters[26:]), "Été", "straße", "ÀÉÎÕÜ", "ñandúÿ", "É.", "Èé,;"]
    want = {w: own._tokenizer.encode(w, add_special_tokens=False).ids for w in words}
    assert {w: list(np.frombuffer(own[w.encode()], "<u4")) for w in words} == want
    # the whole tokenizer is not asked for any of them
    other = tokens.WordIds(path)
    other._tokenizer = None
    assert other["Étéß".encode()] == np.array(own._tokenizer.encode("Étéß", add_special_tokens=False).ids, "<u4").tobytes()
