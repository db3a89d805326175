"""op13 against plain loops over characters of the two vocabularies."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from docsift.llm import alignment
from docsift.llm.alignment import aligned, best_ids, document_alignment
from docsift.llm.q_alignment import op13_token_alignment

from .helpers import docs, rows

SF = "/root/testdata/sf0.001"
A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
ODD = ["", None, " ", "a  b\n\n c\t", "x▁y", "<s> </s> <0x0A> <|endoftext|>", "\x00a\r\n", "é ﬁ \U0001f600 中文", "same words again", "same words again", "a", "▁"]


def pieces(text):
    """Lists of (id, end) for A and B, or nothing."""
    raw = (" " + text).encode()
    chars = alignment.byte_decoder()
    a = [(i, bytes(chars[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in B.encode(text):
        p = B.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode()))
    if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
        return None
    out = []
    for side in (a, b):
        end, ends = 0, []
        for i, x in side:
            end += len(x)
            ends.append((i, end))
        out.append(ends)
    return out


def brute(texts):
    counts, kept = Counter(), []
    for t in texts:
        got = pieces(t) if t else None
        if got is None:
            kept.append(None)
            continue
        a, b = got
        links = [(i, j) for j, e in b for i, f in a if e == f] if len(a) < 300 else [(dict((f, i) for i, f in a)[e], j) for j, e in b if e in {f for _, f in a}]
        counts.update(links)
        common = sorted({e for _, e in a} & {e for _, e in b})
        said, lo = [], 0
        for e in common:
            said.append(",".join(str(i) for i, x in a if lo < x <= e) + "|" + ",".join(str(j) for j, x in b if lo < x <= e))
            lo = e
        kept.append((len(a), len(b), len(common), links, hashlib.sha256(";".join(said).encode()).hexdigest()))
    most = defaultdict(int)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    out = []
    for k in kept:
        if k is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n_groups, links, sha = k
            out.append((n_a, n_b, n_groups, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return out, counts


def test_odd_texts_equal_plain_loops(spark):
    want, _ = brute(ODD)
    got = {r["doc_id"]: tuple(r)[1:] for r in document_alignment(docs(spark, ODD)).collect()}
    assert [got[i] for i in range(len(ODD))] == want


@pytest.mark.parametrize("small", [False, True])
def test_documents_equal_plain_loops(spark, monkeypatch, small):
    """Also with parts, shares and sums so small that all are split."""
    if small:
        for name, value in (("PART_CHARS", 20_000), ("ADDED_PARTS", 2), ("LOAD", 100), ("HELD", 40)):
            monkeypatch.setattr(alignment, name, value)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("text").collect()][:60]
    texts = [t if t is None else t[:3000] for t in texts]
    want, counts = brute(texts)
    df = docs(spark, texts)
    got = {r["doc_id"]: tuple(r)[1:] for r in document_alignment(df).collect()}
    assert [got[i] for i in range(len(texts))] == want
    _, _, stripes, n = aligned(df)
    most = defaultdict(int)
    for (_, j), c in counts.items():
        most[j] = max(most[j], c)
    assert rows(best_ids(stripes, n)) == sorted([(j, i, c) for (i, j), c in counts.items() if c == most[j]], key=str)


def test_query_reads_all_documents(spark):
    df = op13_token_alignment(spark, SF)
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = df.collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["n_links"] == r["n_groups"] >= r["n_best"] for r in got) and any(r["n_best"] for r in got)


def test_odd_tables(spark):
    empty = docs(spark, [])
    assert document_alignment(empty).collect() == []
    wide = spark.createDataFrame([(None, "one two", 1, "x", 2), (None, "one two", 1, "x", 3), (5, None, 1, "x", 3)], "doc_id long, text string, part int, stripe string, place int")
    got = rows(document_alignment(wide))
    assert len(got) == 3 and got.count(got[-1]) + got.count(got[0]) >= 3 and (5, 0, 0, 0, 0, 0, 0, "") in got


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(min_codepoint=0, max_codepoint=0x300)) | st.text("ab 1'\n\t,.é\xa0s"), max_size=5))
def test_the_fast_way_equals_the_tokenizer(texts):
    v = alignment.vocabularies(*alignment.paths(None, None))
    assert v.fast is not None
    assert v.encode_a(texts) == [A.encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_settled_characters_equal_the_tokenizer():
    v = alignment.vocabularies(*alignment.paths(None, None))
    ranges = [*range(9, 14), *range(32, 127), *range(0xA1, 0x250)]
    for a in ("x", "7", " ", "!"):
        texts = [f"{a}{chr(c)}{b}" for c in ranges for b in ("x", "7", " ", "!")]
        assert all(alignment._SETTLED.fullmatch(t) for t in texts)
        assert v.encode_a(texts) == [e.ids for e in A.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_a_very_long_text(spark):
    text = "boiler feed pump 12; " * 20_000
    (got,) = document_alignment(docs(spark, [text])).collect()
    v = alignment.vocabularies(*alignment.paths(None, None))
    a, b = v.encode([text])
    assert (got["n_a"], got["n_b"]) == (len(a[0]), len(b[0])) and got["n_links"] == len(np.intersect1d(np.cumsum(v.side_a.lengths[a[0]]), np.cumsum(v.side_b.lengths[b[0]])))
