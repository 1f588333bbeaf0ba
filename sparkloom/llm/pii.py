"""Format-preserving pseudonyms with Spark expressions only.

Personal numbers and dates are found by pattern and validated (Luhn digit, octets, calendar, area numbers, length),
then permuted within their format by a keyed Feistel network, so equal values keep equal pseudonyms in all
documents and no two values share one. Of kinds whose valid values form a range (addresses, social security
numbers, dates) the two halves are numbers; of the others (cards, phones, e-mail addresses, secrets) they are
strings in which a digit stays a digit and a letter a letter of its case, and hexadecimal secrets stay hexadecimal.
Cards get a new check digit.

Phones are those with + and a country code, (555) 123-4567 with a space, dot or hyphen before the last four, 555-123-4567
and 555.123.4567; other national forms are not found. Cards are 13 to 19 digits, or groups of 4-4-4-4 or 4-6-5. IBANs
(check number 97) are written closed or in groups of four. Secrets have one of NAMES before them; one with hyphens or
underscores needs a digit. A letter that is not ASCII stays in its block of 16 code points.

Every whole text is looked at. Each pattern needs a digit, an @ or one of NAMES (NEEDED); a text with any of these is
searched, split at its matches, and put together again with the pseudonyms between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh

ROUNDS = 10
EMAIL = r"[\p{L}\p{Nd}][\p{L}\p{Nd}._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){1,4}(?!\d)"
NATIONAL = r"(?<![\d)])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})(?![\d-]|\.\d)"
CARD = r"(?<![\d.])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?![\d])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
ADDRESS = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d]|[./-]\d)"
NAMES = "(?i:token|secret|key|password)"
SECRET = rf"""(?<={NAMES}\s{{0,3}}[=:]\s{{0,3}}["']?)(?:[A-Za-z0-9]{{20,}}+(?![_-])|(?=[A-Za-z_-]*\d)[A-Za-z0-9][A-Za-z0-9_-]{{18,}}[A-Za-z0-9])"""
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
#: CARD first: its groups are \1 and \2.
ANY = "|".join([CARD, EMAIL, IBAN, PHONE, NATIONAL, SSN, ADDRESS, DATE, SECRET])
#: What any match of ANY has in it, or, of SECRET, right before it.
NEEDED = "[0-9@]|" + NAMES
#: 400 years of days, as a product.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)


def _noise(key: str, kind: str, k: Column, other: Column, block: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), k.cast("string"), block.cast("string"), other.cast("string")), 256)


def _number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("bigint")


def permute_pair(key: str, kind: str, a: Column, b: Column, size_a: int, size_b: int) -> Column:
    """struct<a, b>: a keyed permutation of the pairs with 0 <= a < size_a and 0 <= b < size_b."""

    def turn(s: Column, k: Column) -> Column:
        def moved(x: Column, other: Column, size: int) -> Column:
            return (x + _number(F.substring(_noise(key, kind, k, other, F.lit(0)), 1, 12))) % F.lit(size)

        return F.when(k % 2 == 0, F.struct(moved(s["a"], s["b"], size_a).alias("a"), s["b"].alias("b"))).otherwise(
            F.struct(s["a"].alias("a"), moved(s["b"], s["a"], size_b).alias("b"))
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), turn)


def _shift_hex(c: Column, by: Column) -> Column:
    digits = F.lit("0123456789abcdef")
    return F.substr(digits, (F.instr(digits, c) - 1 + by) % 16 + 1, F.lit(1))


def _shift(c: Column, by: Column) -> Column:
    def within(first: str, size: int) -> Column:
        return F.chr(F.lit(ord(first)) + (F.ascii(c) - ord(first) + by) % size)

    return F.when(c.between("0", "9"), within("0", 10)).when(c.between("a", "z"), within("a", 26)).otherwise(within("A", 26))


def _shift_wide(c: Column, by: Column) -> Column:
    """Like _shift; of a character that is not ASCII the last four bits of its UTF-16 form move."""
    code = F.hex(F.encode(c, "UTF-16BE"))
    last = F.char_length(code)
    moved = F.concat(F.substr(code, F.lit(1), last - 1), F.hex((F.conv(F.substr(code, last), 16, 10).cast("int") + by) % 16))
    return F.when(c.rlike("^[A-Za-z0-9]$"), _shift(c, by)).otherwise(F.decode(F.unhex(moved), "UTF-16BE"))


def permute_text(key: str, kind: str, text: Column, shift=_shift) -> Column:
    """A keyed permutation of the strings of letters and digits that have text's pattern of digits and cases; shift moves one symbol."""
    half = F.floor(F.char_length(text) / 2).cast("int")

    def turn(s: Column, k: Column) -> Column:
        def moved(x: Column, other: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor(F.char_length(x) / 16).cast("int")), lambda i: _noise(key, kind, k, other, i))
            shifted = F.transform(
                F.filter(F.split(x, ""), lambda c: c != ""),
                lambda c, i: shift(c, _number(F.substr(F.array_join(blocks, ""), i * 4 + 1, F.lit(4))).cast("int")),
            )
            return F.array_join(shifted, "")

        return F.when(k % 2 == 0, F.struct(moved(s["l"], s["r"]).alias("l"), s["r"].alias("r"))).otherwise(
            F.struct(s["l"].alias("l"), moved(s["r"], s["l"]).alias("r"))
        )

    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _refill(shape: Column, symbols: Column) -> Column:
    """shape with its letters and digits replaced in order by those of symbols."""
    done = F.aggregate(
        F.filter(F.split(shape, ""), lambda c: c != ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(
            c.rlike(r"^[A-Za-z0-9[^\x00-\x7F]]$"), F.struct(F.concat(s["out"], F.substr(symbols, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
    )
    return done["out"]


def _symbols(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x7F&&[^A-Za-z0-9]]", "")


def luhn_sum(digits: Column, double_last: bool) -> Column:
    """The Luhn sum of digits; the last one is doubled, or the last but one."""

    def add(s: Column, c: Column) -> Column:
        d = c.cast("int") * F.when(s["double"], 2).otherwise(1)
        return F.struct((s["sum"] + d - F.when(d > 9, 9).otherwise(0)).alias("sum"), (~s["double"]).alias("double"))

    row = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(row, F.struct(F.lit(0).alias("sum"), F.lit(double_last).alias("double")), add, lambda s: s["sum"])


def _card(key: str, m: Column) -> Column:
    def changed(d: Column) -> Column:
        body = permute_text(key, "card", F.substr(d, F.lit(1), F.char_length(d) - 1))
        full = _let(body, lambda b: F.concat(b, F.pmod(-luhn_sum(b, True), F.lit(10)).cast("string")))
        return F.when(luhn_sum(d, False) % 10 == 0, _let(full, lambda f: _refill(m, f))).otherwise(m)

    return _let(F.regexp_replace(m, "[^0-9]", ""), changed)


def _phone(key: str, m: Column) -> Column:
    kept = F.when(F.startswith(m, F.lit("+1")), 2).otherwise(3)
    digits = F.char_length(F.regexp_replace(m, "[^0-9]", ""))
    rest = F.substr(m, kept + 1)
    new = F.concat(F.substr(m, F.lit(1), kept), _let(permute_text(key, "phone", _symbols(rest)), lambda s: _refill(rest, s)))
    return F.when(digits.between(8, 15), new).otherwise(m)


def _email(key: str, m: Column) -> Column:
    end = F.concat(F.lit("."), F.substring_index(m, ".", -1))
    body = F.substr(m, F.lit(1), F.char_length(m) - F.char_length(end))
    return F.concat(_let(permute_text(key, "email", _symbols(body), _shift_wide), lambda s: _refill(body, s)), end)


def mod97(text: Column) -> Column:
    """The remainder of 97 of a string of digits and capital letters, a letter standing for 10 to 35."""

    def add(r: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(c.between("0", "9"), (r * 10 + v - 48) % 97).otherwise((r * 100 + v - 55) % 97).cast("int")

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), add)


def _iban(key: str, m: Column) -> Column:
    """The account is permuted, its country kept, and the check number made anew."""

    def changed(s: Column) -> Column:
        country, body = F.substr(s, F.lit(1), F.lit(2)), F.substr(s, F.lit(5))
        valid = mod97(F.concat(body, F.substr(s, F.lit(1), F.lit(4)))) == 1

        def full(b: Column) -> Column:
            return F.concat(country, F.lpad((F.lit(98) - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b)

        new = _let(_let(permute_text(key, "iban", body), full), lambda f: _refill(m, f))
        return F.when(valid, new).otherwise(m)

    return _let(_symbols(m), changed)


def _address(key: str, m: Column) -> Column:
    def part(i: int) -> Column:
        return F.get(F.split(m, r"\."), F.lit(i)).cast("int")

    valid = (part(0) <= 255) & (part(1) <= 255) & (part(2) <= 255) & (part(3) <= 255)
    new = permute_pair(key, "address", part(0) * 256 + part(1), part(2) * 256 + part(3), 65536, 65536)
    shown = _let(new, lambda s: F.concat_ws(".", *[F.floor(s[c] / 256).cast("int").cast("string") if hi else (s[c] % 256).cast("string") for c in "ab" for hi in (1, 0)]))
    return F.when(valid, shown).otherwise(m)


def _ssn(key: str, m: Column) -> Column:
    area, group, serial = (F.get(F.split(m, "-"), F.lit(i)).cast("int") for i in range(3))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    index = area - 1 - F.when(area > 666, 1).otherwise(0)
    new = permute_pair(key, "ssn", index, (group - 1) * 9999 + serial - 1, 898, 99 * 9999)

    def shown(s: Column) -> Column:
        a = s["a"] + 1 + F.when(s["a"] >= 665, 1).otherwise(0)
        return F.concat_ws(
            "-", F.lpad(a.cast("string"), 3, "0"), F.lpad((F.floor(s["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((s["b"] % 9999 + 1).cast("string"), 4, "0")
        )

    return F.when(valid, _let(new, shown)).otherwise(m)


def _date(key: str, m: Column) -> Column:
    """ISO dates, day.month.year and month/day/year, each back in its own form."""
    iso = F.when(F.contains(m, F.lit("-")), m).when(
        F.contains(m, F.lit(".")), F.concat_ws("-", F.substr(m, F.lit(7)), F.substr(m, F.lit(4), F.lit(2)), F.substr(m, F.lit(1), F.lit(2)))
    ).otherwise(F.concat_ws("-", F.substr(m, F.lit(7)), F.substr(m, F.lit(1), F.lit(2)), F.substr(m, F.lit(4), F.lit(2))))

    def changed(text: Column) -> Column:
        n = F.datediff(text.try_cast("date"), F.lit(FIRST_DAY).cast("date"))
        new = permute_pair(key, "date", F.floor(n / DAYS[1]), n % DAYS[1], *DAYS)
        day = F.date_add(F.lit(FIRST_DAY).cast("date"), (new["a"] * DAYS[1] + new["b"]).cast("int"))
        form = lambda d: F.when(F.contains(m, F.lit("-")), F.date_format(d, "yyyy-MM-dd")).when(F.contains(m, F.lit(".")), F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy"))
        return F.when(n.between(0, DAYS[0] * DAYS[1] - 1), _let(day, form)).otherwise(m)

    return _let(iso, changed)


def _hex(key: str, m: Column) -> Column:
    new = permute_text(key, "hex", F.lower(m), _shift_hex)
    return F.when(m.rlike("[A-F]"), F.upper(new)).otherwise(new)


def pseudonym(key: str, m: Column) -> Column:
    """The pseudonym of a match of ANY; itself if it isn't valid."""
    return (
        F.when(F.contains(m, F.lit("@")), _email(key, m))
        .when(F.startswith(m, F.lit("+")), _phone(key, m))
        .when(m.rlike("^" + IBAN + "$"), _iban(key, m))
        .when(m.rlike(f"^(?:{NATIONAL})$"), _let(permute_text(key, "national", _symbols(m)), lambda s: _refill(m, s)))
        .when(m.rlike("^" + ADDRESS + "$"), _address(key, m))
        .when(m.rlike("^" + SSN + "$"), _ssn(key, m))
        .when(m.rlike("^" + DATE + "$"), _date(key, m))
        .when(m.rlike("^" + CARD + "$"), _card(key, m))
        .when(m.rlike("^([0-9a-f]{20,}|[0-9A-F]{20,})$"), _hex(key, m))
        .when(m.rlike("^[A-Za-z0-9_-]{20,}$"), _let(permute_text(key, "secret", _symbols(m)), lambda s: _refill(m, s)))
        .otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_replaced") -> DataFrame:
    """docs with pseudonyms in text_col, and the number of replaced values in count_col (in place of a column of that name).

    Null texts stay null, with 0 replaced; empty texts and texts without valid matches stay as they are. Every other
    column is kept. Equal values under one key have equal pseudonyms; the key is as secret as the values.
    """
    text, old, new = F.col(text_col), fresh(docs, "found"), fresh(docs, "new")
    found = docs.withColumn(old, F.when(text.rlike(NEEDED), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    found = found.withColumn(new, F.transform(old, lambda m: pseudonym(key, m)))
    both = F.arrays_zip(F.col(old).alias("x"), F.col(new).alias("y"))
    changed = F.coalesce(F.size(F.filter(both, lambda z: z["x"] != z["y"])), F.lit(0))
    found = found.withColumn(count_col, F.when(F.col(old).isNull(), 0).otherwise(changed))
    joined = F.array_join(F.transform(F.split(text, ANY, -1), lambda p, i: F.concat(p, F.coalesce(F.get(F.col(new), i), F.lit("")))), "")
    return found.withColumn(text_col, F.when(F.col(count_col) > 0, joined).otherwise(text)).drop(old, new)
