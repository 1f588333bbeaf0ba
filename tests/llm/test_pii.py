import hashlib
import re
from datetime import date, timedelta

import pytest

from sparkloom.llm import pii

SCHEMA = "doc_id long, text string, n_replaced string, __other string"


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def noise(key, kind, k, other, block):
    return hashlib.sha256("|".join([key, kind, str(k), str(block), str(other)]).encode()).hexdigest()


def permute_pair(key, kind, a, b, size_a, size_b):
    for k in range(pii.ROUNDS):
        if k % 2 == 0:
            a = (a + int(noise(key, kind, k, b, 0)[:12], 16)) % size_a
        else:
            b = (b + int(noise(key, kind, k, a, 0)[:12], 16)) % size_b
    return a, b


def permute_text(key, kind, s):
    half = len(s) // 2
    l, r = s[:half], s[half:]

    def moved(x, other, k):
        stream = "".join(noise(key, kind, k, other, i) for i in range(len(x) // 16 + 1))
        out = ""
        for i, c in enumerate(x):
            first, size = ("0", 10) if c.isdigit() else ("a", 26) if c.islower() else ("A", 26)
            out += chr(ord(first) + (ord(c) - ord(first) + int(stream[4 * i : 4 * i + 4], 16)) % size)
        return out

    for k in range(pii.ROUNDS):
        if k % 2 == 0:
            l = moved(l, r, k)
        else:
            r = moved(r, l, k)
    return l + r


def run(spark, texts, key="k"):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    out = pii.pseudonymise(df, key)
    assert out.columns == df.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    return [rows[i]["text"] for i in range(len(texts))], [rows[i]["n_replaced"] for i in range(len(texts))]


def test_against_brute_force(spark):
    (card, address, day, ssn, phone, mail), counts = run(spark, ["4111111111111111", "129.38.82.176", "2024-02-29", "219-09-9999", "+1 (499) 555-6503", "und.34@mail7.example.com"])
    assert counts == [1] * 6
    body = permute_text("k", "card", "411111111111111")
    assert card[:15] == body and luhn(card)
    a, b = permute_pair("k", "address", 129 * 256 + 38, 82 * 256 + 176, 65536, 65536)
    assert address == f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"
    n = (date(2024, 2, 29) - date(1800, 1, 1)).days
    a, b = permute_pair("k", "date", n // 773, n % 773, 189, 773)
    assert day == (date(1800, 1, 1) + timedelta(a * 773 + b)).isoformat()
    a, b = permute_pair("k", "ssn", 218, 8 * 9999 + 9998, 898, 99 * 9999)
    area = a + 1 + (a >= 665)
    assert ssn == f"{area:03}-{b // 9999 + 1:02}-{b % 9999 + 1:04}"
    assert re.sub(r"\D", "", phone) == "1" + permute_text("k", "phone", "4995556503") and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phone)
    assert mail.endswith(".com") and re.sub("[^a-z0-9]", "", mail[:-4]) == permute_text("k", "email", "und34mail7example")


def test_equal_values_stay_linked_and_others_apart(spark):
    cards = [f"{400000000000000 + i * 977}" for i in range(150)]
    cards = [c + next(d for d in "0123456789" if luhn(c + d)) for c in cards]
    days = [(date(2000, 1, 1) + timedelta(i)).isoformat() for i in range(300)]
    out, _ = run(spark, [*cards, *days, f"a {cards[0]}, b {cards[0]} {days[0]}"])
    assert len(set(out[:150])) == 150 and all(luhn(x) and len(x) == 16 for x in out[:150])
    assert len(set(out[150:450])) == 300 and all(date.fromisoformat(x) for x in out[150:450])
    assert out[450] == f"a {out[0]}, b {out[0]} {out[150]}"
    assert run(spark, [cards[0]], "other")[0] != [out[0]]


def test_secrets_keep_their_alphabet(spark):
    low = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    (a, b, c, plain), counts = run(spark, [f'token = "{low}"', f"key: {low.upper()}", "secret=Ab1" + "xY9" * 9, f"commit {low}"])
    assert counts == [1, 1, 1, 0] and plain == f"commit {low}"
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', a) and re.fullmatch("key: [0-9A-F]{40}", b) and a[9:49].upper() == b[5:] and low not in a
    assert re.fullmatch(r"secret=[A-Z][a-z]\d([a-z][A-Z]\d){9}", c)


def test_two_cards_side_by_side_and_forms(spark):
    (two, dates, grouped), counts = run(spark, ["7536784127813050 4845168114407329", "31.12.1999 12/31/1999 1999-12-31", "4111 1111 1111 1111"])
    assert counts == [2, 3, 1] and re.fullmatch(r"\d{16} \d{16}", two) and all(map(luhn, two.split()))
    a, b, c = dates.split()
    assert date.fromisoformat(c) == date(int(a[6:]), int(a[3:5]), int(a[:2])) == date(int(b[6:]), int(b[:2]), int(b[3:5]))
    assert re.fullmatch(r"(\d{4} ){3}\d{4}", grouped)


@pytest.mark.parametrize("clean", ["4111111111111112", "999.1.1.1", "v1.2.3", "2023-02-29", "666-12-1234", "900-12-1234", "12345", "a@b", "+12", "", "plain words", "0x1234567890123456789012"])
def test_what_is_not_valid_stays(spark, clean):
    assert run(spark, [clean]) == ([clean], [0])


def test_nulls_long_texts_and_empty_tables(spark):
    long = "x 129.38.82.176 " * 5000
    out, counts = run(spark, [None, long])
    assert out[0] is None and counts == [0, 5000] and len(set(out[1].split())) == 2
    df = spark.createDataFrame([], SCHEMA)
    assert pii.pseudonymise(df, "k").count() == 0
