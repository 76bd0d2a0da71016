import datetime as dt
import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrade.llm import pii

CIPHER = pii.Feistel(b"test key")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 10**24), st.integers(0, 10**24), st.text(max_size=5))
def test_any_size_goes_back(size, value, tweak):
    value %= size
    there = CIPHER.permute(value, size, tweak)
    assert 0 <= there < size
    assert CIPHER.permute(there, size, tweak, inverse=True) == value


def test_permutes_a_whole_range():
    assert sorted(CIPHER.permute(v, 1000, "t") for v in range(1000)) == list(range(1000))
    assert [CIPHER.permute(v, 1000, "t") for v in range(9)] != [pii.Feistel(b"other").permute(v, 1000, "t") for v in range(9)]


@pytest.mark.parametrize(
    ("text", "kinds", "shape"),
    [
        ("pay 4111 1111 1111 1111 now", ["card"], r"pay \d{4} \d{4} \d{4} \d{4} now"),
        ("4111111111111112", [], r"4111111111111112"),
        ("born 1980-02-29.", ["date"], r"born (19|20)\d\d-\d\d-\d\d\."),
        ("25/12/2001", ["date"], r"\d\d/\d\d/\d{4}"),
        ("1980-02-30", [], "1980-02-30"),
        ("GB82 WEST 1234 5698 7654 32", ["iban"], r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d"),
        ("123-45-6789", ["social"], r"\d{3}-\d\d-\d{4}"),
        ("+44 20 7946 0958 4111 1111 1111 1111", ["phone", "card"], r"\+44 \d\d \d{4} \d{4} \d{4} \d{4} \d{4} \d{4}"),
        ("call +1 (921) 555-8394!", ["phone"], r"call \+1 \(\d{3}\) \d{3}-\d{4}!"),
        ("a.b7@x.example.com", ["email"], r"[a-z]\.[a-z]\d@x\.example\.com"),
        ("at 10.0.200.7 and 999.1.1.1", ["ipv4"], r"at \d+\.\d+\.\d+\.\d+ and 999\.1\.1\.1"),
        ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', ["secret"], r'token = "[0-9a-f]{40}"'),
        ("version 4.0 of 2001, page 12345", [], "version 4.0 of 2001, page 12345"),
    ],
)
def test_formats(text, kinds, shape):
    new, found = pii.pseudonymise(text, CIPHER)
    assert found == kinds
    assert re.fullmatch(shape, new)
    assert (new != text) == bool(kinds)
    assert pii.pseudonymise(new, CIPHER, inverse=True) == (text, kinds)


def test_values_stay_valid_and_linked():
    cards = [m for m in range(4000000000000000, 4000000000000200) if pii.luhn(str(m)[:-1]) == m % 10]
    new = [pii.pseudonymise(f"x {c} y", CIPHER)[0].split()[1] for c in cards]
    assert len(set(new)) == len(cards)
    assert all(pii.luhn(n[:-1]) == int(n[-1]) for n in new)
    one, two = pii.pseudonymise("on 1990-05-04", CIPHER)[0], pii.pseudonymise("May 4th, 1990", CIPHER)[0]
    year, month, day = one.split()[1].split("-")
    assert re.match(rf"{pii.MONTHS[int(month) - 1]} {int(day)}(st|nd|rd|th), {year}$", two)


def test_documents_go_there_and_back(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    done = pii.protect(docs, b"k").cache()
    assert {k for r in done.collect() for k in r["kinds"]} == {"card", "email", "ipv4", "phone", "secret"}
    back = {r["doc_id"]: r["text"] for r in pii.protect(done, b"k", inverse=True).collect()}
    assert back == {r["doc_id"]: r["text"] for r in docs.collect()}
    clean = done.where("n_found = 0").select("doc_id", "text")
    assert clean.exceptAll(docs.select("doc_id", "text")).count() == 0


def test_odd_rows(spark):
    rows = [(1, None, 1), (None, "", 2), (2, "1980-02-28", 3), (2, "1980-02-28", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kinds int")
    got = pii.protect(docs, b"k").collect()
    assert [(r["doc_id"], r["n_found"]) for r in got] == [(1, 0), (None, 0), (2, 1), (2, 1)]
    assert got[0]["text"] is None and got[1]["text"] == "" and got[2] == got[3]
    assert pii.protect(docs.limit(0), b"k").count() == 0


SCRIPTS = {"Arabic-Indic": 0x660, "Persian": 0x6F0, "Devanagari": 0x966, "full-width": 0xFF10, "mathematical": 0x1D7CE}


@pytest.mark.parametrize("zero", SCRIPTS.values(), ids=SCRIPTS)
@pytest.mark.parametrize("beside", ["", "page 7, "])
@pytest.mark.parametrize(
    ("value", "kind"),
    [("555-839-1234", "phone"), ("+44 20 7946 0958", "phone"), ("4111111111111111", "card"), ("123-45-6789", "social"),
     ("1980-02-28", "date"), ("May 4th, 1990", "date"), ("10.0.200.7", "ipv4"), ("GB82 WEST 1234 5698 7654 32", "iban")],
)
def test_digits_of_every_script(zero, beside, value, kind):
    def written(text):
        return re.sub("[0-9]", lambda m: chr(zero + int(m[0])), text)

    text = f"{beside}é {written(value)}!"
    new, kinds = pii.pseudonymise(text, CIPHER)
    assert kinds == [kind]
    # The number's own pseudonym, in the number's own script.
    assert new == f"{beside}é {written(pii.pseudonymise(value, CIPHER)[0])}!"
    back = pii.pseudonymise(new, CIPHER, inverse=True)[0]
    assert back == text


def test_a_number_in_two_scripts():
    text = "call \u0661\u0662\u0663-456-789\uff10 now"
    new, kinds = pii.pseudonymise(text, CIPHER)
    assert kinds == ["phone"] and re.fullmatch(r"call [\u0660-\u0669]{3}-[0-9]{3}-[0-9]{3}[\uff10-\uff19] now", new)
    assert pii.pseudonymise(new, CIPHER, inverse=True) == (text, kinds)


def test_rows_in_other_digits(spark):
    rows = [(1, "see 7: \u0665\u0665\u0665-\u0668\u0663\u0669-\u0661\u0662\u0663\u0664"), (2, "x\u00b2 and 1980-02-28")]
    got = pii.protect(spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()
    assert [r["kinds"] for r in got] == [["phone"], ["date"]]


@pytest.mark.parametrize("length", [16, 255, 256, 257, 600, 7_000, 100_000, 1_000_000])
def test_long_secrets_there_and_back(length):
    rng, cipher = random.Random(length), pii.Feistel(b"k")
    for letters in ("0123456789", "0123456789abcdef", "abcXYZ019"):
        value = "".join(rng.choice(letters) for _ in range(length))
        text = f"token={value} end"
        hidden, kinds = pii.pseudonymise(text, cipher)
        assert kinds == ["secret"] and len(hidden) == len(text) and hidden != text
        assert pii.pseudonymise(hidden, cipher, True)[0] == text
        # A change anywhere changes the whole.
        other = value[:-1] + ("1" if value[-1] != "1" else "0")
        changed = pii.pseudonymise(f"token={other} end", cipher)[0]
        if length >= 600:
            differ = sum(a != b for a, b in zip(hidden, changed))
            assert differ > length / 3


def test_long_secret_through_spark(spark):
    rows = [(1, "password: " + "aB3" * 200_000), (2, ""), (3, None), (1, "password: " + "aB3" * 200_000), (4, "on 31/01/2020")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kinds", "2 as n_found")
    hidden = pii.protect(docs, b"k")
    got = [tuple(r) for r in hidden.select("doc_id", "text", "n_found").orderBy("doc_id").collect()]
    assert got[0] == got[1] and got[0][2] == 1 and got[2][1:] == ("", 0) and got[3][1:] == (None, 0)
    back = {r["doc_id"]: r["text"] for r in pii.protect(hidden, b"k", True).collect()}
    assert back[1] == rows[0][1]
    assert pii.protect(docs.limit(0), b"k").count() == 0


def test_equal_days_are_linked_in_all_notations():
    cipher = pii.Feistel(b"k")

    def read(text):
        m = re.search(r"(\d+)([/.-])(\d+)[/.-](\d+)", text)
        a, sep, b, c = int(m[1]), m[2], int(m[3]), int(m[4])
        if a > 31:
            return dt.date(a, b, c)
        return dt.date(c, a, b) if sep == "/" and a <= 12 else dt.date(c, b, a)

    for k in range(0, 3000, 7):
        day = dt.date(2013, 1, 1) + dt.timedelta(k)
        forms = [f"{day:%Y-%m-%d}", f"{day:%Y/%m/%d}", f"{day:%d.%m.%Y}", f"{day:%m/%d/%Y}", *([f"{day:%d/%m/%Y}"] if day.day > 12 else [])]
        hidden = [pii.pseudonymise(f"on {form} it", cipher)[0] for form in forms]
        assert len({read(h) for h in hidden}) == 1
        assert {read(pii.pseudonymise(h, cipher, True)[0]) for h in hidden} == {day}


def test_plain_feistel():
    """The network by its definition, on a range of its own."""
    cipher = pii.Feistel(b"key")
    key = hashlib.blake2b(b"key", digest_size=32).digest()
    size, a, b = 1000, 32, 32

    def step(value):
        left, right = divmod(value, b)
        for i in range(8):
            x, m = (left, b) if i % 2 else (right, a)
            draw = int.from_bytes(hashlib.blake2b(f"t|{i}|{x}|{m}".encode(), key=key, digest_size=32).digest(), "big") % m
            if i % 2:
                right = (right + draw) % b
            else:
                left = (left + draw) % a
        return left * b + right

    for value in range(size):
        want = step(value)
        while want >= size:
            want = step(want)
        assert cipher.permute(value, size, "t") == want
