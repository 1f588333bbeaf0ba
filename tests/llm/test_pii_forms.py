import re

from sparkloom.llm import pii
from tests.llm.test_pii import luhn


def test_secrets_without_digits_national_phones_and_cards_of_three_groups(spark):
    texts = ["password = abcdefghijklmnopqrstuvwxyz", "call (555) 123-4567 or (555)123.4567", "pay 3782 822463 10005 now", "3782-822463-10005", "3782 822463 10006", "3782 822463-10005", "no password here", "1(555) 1234-567"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = [(r["text"], r["n_replaced"]) for r in pii.pseudonymise(df, "k").orderBy("doc_id").collect()]
    assert [n for _, n in got] == [1, 2, 1, 1, 0, 0, 0, 0] and [t for t, _ in got[4:]] == texts[4:]
    assert re.fullmatch("password = [a-z]{26}", got[0][0]) and got[0][0] != texts[0]
    phones = re.fullmatch(r"call (\(\d{3}\) \d{3}-\d{4}) or (\(\d{3}\)\d{3}\.\d{4})", got[1][0]).groups()
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1 and "555) 123" not in got[1][0]
    cards = [re.fullmatch(p, t).group(1) for p, (t, _) in ((r"pay (\d{4} \d{6} \d{5}) now", got[2]), (r"(\d{4}-\d{6}-\d{5})", got[3]))]
    digits = {re.sub(r"\D", "", c) for c in cards}
    assert len(digits) == 1 and all(map(luhn, digits)) and digits != {"378282246310005"}


def iban_rest(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def test_wide_letters_ibans_hyphenated_secrets_and_plain_national_phones(spark):
    texts = [
        "дмитрий@mail.com", "say дмитрий@mail.com", "GB82 WEST 1234 5698 7654 32", "to GB82WEST12345698765432.", "GB83 WEST 1234 5698 7654 32",
        "token: sk-Ab12-Cd34-Ef56-Gh78", "key = state-of-the-art-technology", "555-123-4567 or 555.123.4567", "1555-123-4567", "v 555.123.4567.8",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = [(r["text"], r["n_replaced"]) for r in pii.pseudonymise(df, "k").orderBy("doc_id").collect()]
    assert [n for _, n in got] == [1, 1, 1, 1, 0, 1, 0, 2, 0, 0]
    name, host = got[0][0].split("@")
    assert len(name) == 7 and not set(name) & set("дмитрий") or name != "дмитрий"
    assert all(ord(x) >> 4 == ord(y) >> 4 for x, y in zip(name, "дмитрий", strict=True)) and got[1][0] == "say " + got[0][0]
    assert re.fullmatch(r"GB\d\d [A-Z]{4}(?: \d{4}){3} \d\d", got[2][0]) and iban_rest(got[2][0]) == 1 and got[2][0] != texts[2]
    assert got[3][0] == "to " + got[2][0].replace(" ", "") + "."
    assert re.fullmatch(r"token: [a-z]{2}(?:-[A-Z][a-z]\d\d){4}", got[5][0]) and got[5][0] != texts[5]
    one, two = got[7][0].split(" or ")
    assert one == two.replace(".", "-") and one != "555-123-4567"


def test_every_pattern_needs_what_texts_are_looked_at_for(spark):
    """Without digits, @ and names, strings of the alphabet of all patterns have no match."""
    import random

    r = random.Random(1)
    texts = ["".join(r.choice("abXYZ éд()+.-_ =:\"'/") for _ in range(60)) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert df.filter(df["text"].rlike(pii.NEEDED)).count() == 0 and df.filter(df["text"].rlike(pii.ANY)).count() == 0
