import hashlib
import random
import time
from collections import Counter
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docsift.llm.pii import KINDS, _ALIKE, base_spans, find, luhn, masked, normalised, personal_data
from tests.llm.helpers import docs

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = {k: [] for k in KINDS}
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out[kind].append(m.span())
    return out


TEXT = "mail a.b+c@x-y.co.uk, 10.0.0.255 and 256.1.1.1 or 1.2.3.4.5.6.7.8; card 4111 1111 1111 1111, +1 (285) 555-0658, a@b, @x.y, x@y.z@w.v"


def test_base_is_the_contract(spark):
    assert base_spans(TEXT) == plain(TEXT)
    assert [len(base_spans(TEXT)[k]) for k in KINDS] == [2, 3, 1, 1]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a@.-+ 0123459()é\n_[", max_size=40))
def test_base_equals_plain_patterns(text):
    assert base_spans(text) == plain(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["four", "one ", " at ", " dot ", "bob", "[at]", "(dot) ", "com", "@", ".", "plus ", "9", " ", "а", "1", "​"]), max_size=25).map("".join))
def test_added_spans_lie_in_the_text_and_spare_the_base(text):
    base, every = find(text)
    assert set(base) <= set(every)
    for kind, s, e in set(every) - set(base):
        assert 0 <= s < e <= len(text)
        assert all(k != kind or e <= bs or be <= s for k, bs, be in base)


def disguised(text):
    base, every = find(text)
    return [(k, text[s:e]) for k, s, e in every if (k, s, e) not in base]


def test_disguises():
    assert disguised("ask bob [at] mail [dot] example [dot] com now") == [("email", "bob [at] mail [dot] example [dot] com")]
    assert disguised("ask bob(at)example(dot)com now") == [("email", "bob(at)example(dot)com")]
    assert disguised("ask bob at example dot com now") == [("email", "bob at example dot com")]
    assert disguised("ask bob@example dot com now") == [("email", "bob@example dot com")]
    assert disguised("ask bоb@exаmple.com now")[0] == ("email", "bоb@exаmple.com")  # Cyrillic o and a
    assert disguised("on ０１９２.168.1.１ up")[0] == ("ip", "０１９２.168.1.１")
    assert disguised("call plus one two eight five five five five oh six five eight please") == [("phone", "plus one two eight five five five five oh six five eight")]
    assert disguised("card four one one one 1111 1111 1111 ok") == [("card", "four one one one 1111 1111 1111")]
    assert disguised("ask joe [at] " + "x" * 70 + " dot com now") == [("email", "joe [at] " + "x" * 70 + " dot com")]
    assert disguised("card four one one one one one one one one one one one one one one one ok")[0][0] == "card"


def test_fragments_do_not_hide_the_whole(spark):
    whole = ["jоhn@example.com", "bob@mail.example [dot] com", "jоhn@mail.example (dot) com"]  # Cyrillic o
    for text in whole:
        base, every = find(f"ask {text} now")
        assert len(base) == 1 and base[0][2] - base[0][1] < len(text) and set(base) < set(every)
        assert {k for k, _, _ in every} == {"email"} and sorted(i for _, s, e in every for i in range(s, e)) == list(range(4, 4 + len(text)))
    got = [r.text for r in masked(docs(spark, [f"ask {x} now" for x in whole])).orderBy("doc_id").collect()]
    assert got == ["ask <EMAIL> now"] * 3


def test_spoken_forms():
    for text in (
        *(f"jane at example dot {x}" for x in ("ca", "in", "ch", "jp", "dev", "photography")),
        "jane at example.org",
        "jane dot doe at example dot com",
        "jane dot m dot doe at mail dot example.org",
        "jane@host dot xx",
        "jane@mail dot host dot io",
        "j" * 300 + "@host dot com",
    ):
        assert disguised(f"ask {text} now") == [("email", text)]
    for text in ("10 dot 0 dot 0 dot 1", "192 dot 168.1 dot 20"):
        assert disguised(f"on {text}, up") == [("ip", text)]
    for text in ("available at example.org", "we were at home.Then it rained", "300 dot 1 dot 1 dot 1", "stopped at 10.30 sharp"):
        assert disguised(text) == []


def test_prose_stays_clean():
    for text in ("we met at noon on the dot com boom", "one two three four five", "look at example dot", "at at dot dot", "Straße für die Überprüfung", "dot com was at one two"):
        assert disguised(text) == [] and find(text)[0] == []


def test_look_alikes_are_single_characters():
    assert all(len(k) == 1 and len(v) <= 1 for k, v in _ALIKE.items())
    assert _ALIKE["а"] == "a" and _ALIKE["Ｚ"] == "Z" and _ALIKE["х"] == "x" and _ALIKE["ο"] == "o"


def test_mapping_back_is_one_to_one_without_disguise():
    assert normalised("plain text, no disguise") is None
    m = normalised("a​b [at] c")
    assert m.text == "ab@c" and m.source((2, 3)) == (3, 9)


LONG = ["a", "1", "+", "1.", "x@", "one ", "plus ", "one two plus ", "a dot ", " at ", "a at b dot ", "1 dot ", "x@y dot ", "y.", "+1 ", "1-", "[at] ", "х", "one two three four five six "]


@pytest.mark.parametrize("unit", LONG)
def test_long_texts_take_time_in_proportion(unit):
    def took(n):
        text = "x@one two " + unit * n
        return min(_timed(text) for _ in range(3))

    n = 60_000 // len(unit)
    assert took(2 * n) < 3 * took(n) + 0.05


def _timed(text):
    began = time.perf_counter()
    find(text)
    return time.perf_counter() - began


def _planted(rng):
    """Kind, disguise and text of an identifier in a sentence."""
    name, host = rng.choice(["jane", "bob.fox", "k_lee", "a.b"]), rng.choice(["example", "mail.example", "my-shop"])
    end, words = rng.choice(["com", "org", "co.uk", "ca", "dev"]), "zero one two three four five six seven eight nine".split()
    number = "".join(str(rng.randrange(10)) for _ in range(11))
    ip = ".".join(str(rng.randrange(256)) for _ in range(4))
    card = next(c for d in range(10) if luhn(c := "4" + number + "111" + str(d)))
    wide = lambda t: "".join(chr(ord(c) + 0xFEE0) if c.isdigit() else c for c in t)
    spelled = lambda t: " ".join(words[int(c)] for c in t)
    dots = lambda t, d: t.replace(".", d)
    return [
        ("email", "brackets", f"{name} [at] {dots(f'{host}.{end}', ' [dot] ')}"),
        ("email", "spoken", f"{dots(name, ' dot ')} at {dots(f'{host}.{end}', ' dot ')}"),
        ("email", "spoken ending", f"{name}@{dots(f'{host}.{end}', ' dot ')}"),
        ("email", "homoglyphs", f"{name}@{host}.{end}".replace("a", "а").replace("o", "о").replace("e", "е")),
        ("ip", "spoken", dots(ip, " dot ")),
        ("ip", "full width", wide(ip)),
        ("ip", "brackets", dots(ip, "[.]")),
        ("card", "spelled", spelled(card)),
        ("card", "full width", wide(card)),
        ("phone", "spelled", "plus " + spelled("1" + number[:10])),
        ("phone", "full width", "+" + wide("1" + number[:10])),
    ]


def test_recall_by_kind_and_disguise():
    rng, found, planted = random.Random(11), Counter(), Counter()
    for _ in range(200):
        for kind, how, text in _planted(rng):
            whole = f"so write: {text}, or wait."
            spans = [(s, e) for k, s, e in find(whole)[1] if k == kind]
            planted[kind, how] += 1
            # all of it is covered, in one span or several
            covered = set().union(*(range(s, e) for s, e in spans)) if spans else set()
            found[kind, how] += set(range(10, 10 + len(text))) <= covered
    assert {k: round(found[k] / n, 2) for k, n in planted.items()} == dict.fromkeys(planted, 1.0)


def test_operator(spark):
    texts = [TEXT, None, "", "call +1 (285) 555-0658", "bob [at] example [dot] com"]
    d = docs(spark, texts).withColumn("spans", F.lit(1))
    got = {r.doc_id: r for r in personal_data(d.union(d)).collect()}
    for i, t in enumerate(texts):
        base = sorted(((k, s, e) for k, v in plain(t or "").items() for s, e in v), key=lambda x: (x[1], KINDS.index(x[0])))
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in KINDS] == [len(plain(t or "")[k]) for k in KINDS]
    assert got[4].spans == "email:0:26" and got[4].n_email == 0
    assert personal_data(d.limit(0)).count() == 0


def test_masking(spark):
    got = {r.doc_id: r.text for r in masked(docs(spark, [None, "call +1 (285) 555-0658!", "bob [at] example [dot] com.", "clean"])).collect()}
    assert got == {0: None, 1: "call <PHONE>!", 2: "<EMAIL>.", 3: "clean"}


def test_mailboxes_before_literal_hosts():
    """Common mailboxes are found; of what leads to a place, nothing is."""
    for local in ("contact", "order", "orders", "shop", "store", "join", "sales", "info", "support", "hello", "press", "jobs"):
        for host in ("example.org", "mail.example.com", "example dot com", "example punkt de", "example punto es"):
            assert disguised(f"write {local} at {host} today") == [("email", f"{local} at {host}")]
    clean = ["see you at home dot com", "it is available at example.org", "found at example.org and read at example.com", "we meet at example.org", "posted at blog.example.org", "more at example.net", "they were at example dot com"]
    assert [disguised(t) for t in clean] == [[]] * len(clean)


def test_blanks_around_signs():
    for text in ("jane @ example . com", "jane.doe @ mail . example . org", "jane @ example.com"):
        assert disguised(f"ask {text} now") == [("email", text)]
    for text in ("5 apples @ 3 each . Then", "we @ home. Then go", "a @ b", "price @ 10 . 50 today"):
        assert disguised(text) == []


def test_spelled_addresses_of_four_numbers():
    for text in ("one nine two dot one six eight dot zero dot one", "1 0 dot zero dot 0 dot two five", "one-two dot 3 dot 4 dot 5", "ONE DOT ONE DOT ONE DOT ONE"):
        assert disguised(f"on {text}, up") == [("ip", text)]
    for text in ("nine nine nine dot one dot one dot one", "one dot two dot three", "someone dot one dot one dot ones"):
        assert disguised(f"on {text}, up") == []


def test_precision_on_prose():
    """Sentences about places, prices and numbers, in many combinations: nothing is added."""
    rng = random.Random(12)
    parts = ["we met at noon", "look at this", "the price is 3.50 at most", "one of them said no", "two dot three is five", "at the end . There", "available at example.org", "on the dot com boom", "call at ten thirty", "go to section 4 . 2", "e.g. at home", "he stood at Main St. Then", "three or four at once", "sold @ 5 each"]
    for _ in range(500):
        text = ", ".join(rng.choices(parts, k=6)) + "."
        assert disguised(text) == [], text
