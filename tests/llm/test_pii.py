import random
import re

import pytest

from framefusion.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


def test_base_spans_equal_plain_patterns():
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice("aB1234 5.@+-%_()é") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == brute(text), text


@pytest.mark.parametrize("text,added", [
    ("mail john dot doe at example dot com now", "email:5:36"),
    ("x john.doe [at] example (dot) com!", "email:2:33"),
    ("j@еxample.com", "email:0:13"),
    ("call +４９ 171 1234567 x", "phone:5:20"),
    ("card four nine two nine three four eight three eight five one four six three zero six", "card:5:85"),
    ("ip 10。0。0。1 or", "ip:3:11"),
    ("t​e@ex.org", "email:0:10"),
    ("we met at the dot on the map", ""), ("five five five", ""), ("", ""), (None, "")])
def test_disguises_map_back_to_source(text, added):
    base, every = pii.spans(text)
    assert pii.listed([s for s in every if s not in base]) == added or pii.listed(every) == added


@pytest.mark.parametrize("text,added", [
    ("x jane@example dot com", "email:2:22"), ("x jane at mail.example dot com", "email:2:30"), ("x jane @ example.com", "email:2:20"),
    ("x 192[.]168[.]1[.]1 y", "ip:2:19"), ("x 192 dot 168 dot 1 dot 1 y", "ip:2:25"), ("x 192.168[.]1.300 y", ""),
    ("jane at firma dot pl", "email:0:20"), ("jane at firma dot app.", "email:0:21"), ("jane arroba firma punto cl", "email:0:26"),
    ("card (four nine two nine three four eight three eight five one four six three zero six)", "card:6:86"),
    ("stop at some point in time, at this point we", ""), ("take it at the dot product of", ""), ("lunch @ 12.30 there", "")])
def test_more_disguises(text, added):
    base, every = pii.spans(text)
    assert not base and pii.listed(every) == added


@pytest.mark.parametrize("text,base,every,clean", [
    ("t\u200be@ex.org", "email:2:10", "email:0:10,email:2:10", "[EMAIL]"),
    ("x j\u0430ne@example.com", "email:4:18", "email:2:18,email:4:18", "x [EMAIL]"),
    ("john dot doe@example.com", "email:9:24", "email:0:24,email:9:24", "[EMAIL]"),
    ("+49 (0)171 123\u200b4567", "phone:0:14", "phone:0:14,phone:0:19", "[PHONE]"),
    ("ip 192.168.1.1\u200b2 x", "ip:3:14", "ip:3:14,ip:3:16", "ip [IP] x"),
    ("a dot b dot c dot d dot e dot f dot g at mail dot com", "", "email:0:53", "[EMAIL]"),
    ("n" * 70 + " at mail dot com", "", "email:0:86", "[EMAIL]")])
def test_disguises_beside_base_spans(text, base, every, clean):
    found = pii.spans(text)
    assert (pii.listed(found[0]), pii.listed(found[1]), pii.redact(text)) == (base, every, clean)


def test_short_card_words_need_no_blanks():
    assert pii.rewrites("(one two three)").text == "(123)"


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000 + " @ " * 100, "1" * 300_000, "five " * 50_000, "(at)" * 5_000, "x dot " * 30_000, "x at " * 30_000, "a." * 100_000 + "@", " " * 300_000):
        pii.spans(text)


def test_operator(spark):
    rows = [(1, "a@b.de, +1 (017) 555-7713", 25, "x"), (1, "a@b.de, +1 (017) 555-7713", 25, "x"), (None, None, None, "y"), (2, "", 0, "z"),
            (3, "no data", 7, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    out = pii.find_personal_data(df, "doc_id").collect()
    assert sorted((r.n_email, r.n_phone, r.spans) for r in out) == [(0, 0, "")] * 3 + [(1, 1, "email:0:6,phone:8:25")] * 2
    clean = pii.redact_column(df)
    assert clean.columns == df.columns
    assert sorted((r.text or "", r.n_chars or 0) for r in clean.collect()) == [
        ("", 0), ("", 0), ("[EMAIL], [PHONE]", 16), ("[EMAIL], [PHONE]", 16), ("no data", 7)]
    assert pii.find_personal_data(df.limit(0), "doc_id").count() == 0
