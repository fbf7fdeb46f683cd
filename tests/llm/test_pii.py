import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stripewise.llm.pii import KINDS, _luhn, detect, find, find_pii, redacted


def brute(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


PARTS = st.sampled_from(["a", "1", ".", "@", "+", "-", " ", "(", ")", "%", "é", "4111 1111 1111 1111", "10.0.0.255", "b@c.de", "+49 30 1234567", " at ", " dot ", "one ", "_at_", "_dot_", "&#64;", "%40", "¹", "\t", "＠", "​"])


@settings(max_examples=1500, deadline=None)
@given(st.lists(PARTS, max_size=25).map("".join))
def test_base_spans(text):
    assert detect(text) == brute(text)
    found = find(text)
    assert [x[:3] for x in found if x[3]] == brute(text)
    assert all(0 <= s < e <= len(text) for s, _, e, _, _ in found)
    base = brute(text)
    for s, k, e, is_base, _ in found:
        assert is_base or all(e <= x or s >= y for x, kk, y in base if kk == k)


@pytest.mark.parametrize(
    "text, kind, span, plain",
    [
        ("write john [at] ex [dot] com now", "email", "john [at] ex [dot] com", "john@ex.com"),
        ("jane at mail dot example dot org", "email", "jane at mail dot example dot org", "jane@mail.example.org"),
        ("john dot doe at ex dot com", "email", "john dot doe at ex dot com", "john.doe@ex.com"),
        ("see mary.k(at)x-y(dot)de.", "email", "mary.k(at)x-y(dot)de", "mary.k@x-y.de"),
        ("ｊohn＠exаmple．com", "email", "ｊohn＠exаmple．com", "john@example.com"),
        ("call plus one five five five one two three four five six seven now", "phone", "plus one five five five one two three four five six seven", "+15551234567"),
        ("one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one", "192.168.0.1"),
        ("null vier acht", None, None, None),
        ("host 10 dot 0 dot 0 dot 1 is up", "ip", "10 dot 0 dot 0 dot 1", "10.0.0.1"),
        ("ask bob_at_example_dot_com today", "email", "bob_at_example_dot_com", "bob@example.com"),
        ("ask bob-dot-lee-at-ex-dot-org today", "email", "bob-dot-lee-at-ex-dot-org", "bob.lee@ex.org"),
        ("ask bob&#64;example.com today", "email", "bob&#64;example.com", "bob@example.com"),
        ("ask bob&#x40;example&#46;com today", "email", "bob&#x40;example&#46;com", "bob@example.com"),
        ("ask bob%40example.com today", "email", "bob%40example.com", "bob@example.com"),
        ("anna dot berg at mail dot zone", "email", "anna dot berg at mail dot zone", "anna.berg@mail.zone"),
        ("anna  AT\tmail  DOT  app", "email", "anna  AT\tmail  DOT  app", "anna@mail.app"),
        ("dial +4930¹²³4567 now", "phone", "+4930¹²³4567", "+49301234567"),
        ("one nine two dot one six eight\ndot zero  dot one", "ip", "one nine two dot one six eight\ndot zero  dot one", "192.168.0.1"),
        ("card ٤١١١ ١١١١ ١١١١ ١١١١", "card", "٤١١١ ١١١١ ١١١١ ١١١١", "4111 1111 1111 1111"),
    ],
)
def test_disguises(text, kind, span, plain):
    got = [(KINDS[k], text[s:e], p) for s, k, e, base, p in find(text) if not base]
    assert got == ([(kind, span, plain)] if kind else [])


@pytest.mark.parametrize("text", ["he works at example.com today", "look at the dot there", "one two three four", "meet at noon", "quatre ou cinq", "a look-at-me moment", "10 dot 20", "save 40%40 or so", "he sat at a point in time", "Looking at this point in detail"])
def test_clean_texts(text):
    assert find(text) == []


def test_long_texts_take_linear_time():
    find("a" * 300_000 + "1." * 50_000 + "@" * 20_000 + "9" * 100_000)
    find("one " * 30_000 + " at" * 20_000 + " dot b" * 20_000)


def test_dataframe(awkward, empty, docs_of):
    got = find_pii(awkward)
    assert got.columns == ["doc_id", "spans"] and got.count() == awkward.count()
    assert find_pii(empty).count() == 0
    docs = docs_of([(1, "é a@b.cd and x at y dot org", "s"), (2, None, "s")])
    one = find_pii(docs).where("doc_id = 1").first()
    assert [(s.kind, s.start, s.end, s.base) for s in one.spans] == [("email", 2, 8, True), ("email", 13, 27, False)]
    out = redacted(docs)
    assert out.columns == docs.columns
    assert [r.text for r in out.orderBy("doc_id").collect()] == ["é [email] and [email]", None]
