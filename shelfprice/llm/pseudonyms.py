"""Private data replaced by format-preserving Feistel pseudonyms.

Private strings are found by pattern and validated; each is replaced by a string of the
same format that a keyed permutation gives. The same value gets the same pseudonym in
every document, so records stay linked; another key gives unrelated pseudonyms.

* Payment numbers (13 to 19 digits, also in groups): all digits but the last are permuted,
  and the last is set so that a number passes the Luhn check if and only if it did before.
* Telephone and social security numbers: digits permuted, country code and punctuation kept. The
  country code is known from its first digits, so spelling does not matter: ``+1 555-123-4567``, ``+15551234567`` and
  ``555-123-4567`` get the same digits.
* IPv4 addresses with octets up to 255: permuted as 32-bit numbers, so octets stay valid.
* Calendar dates (``yyyy-MM-dd``, ``dd/MM/yyyy``, ``dd.MM.yyyy``) of 1700 to 2099: permuted as
  day numbers of that range, which is 27 x 5,411 days long.
* Mail addresses and secrets (long hexadecimal strings, key prefixes): letters and digits
  permuted within their class, domain ending and key prefix kept. Addresses are permuted in lower
  case and get their capitals back, so those that differ in case only stay linked.

Numbers of a private format are replaced even if they cannot be real (a failed check digit, an area never
issued): a mistyped number still points to a person. An empty key is refused.

Every permutation is a Feistel network of eight rounds over two halves with addition modulo the
size of the half; the round function is SHA-256 of key, round and other half. Only
built-in expressions are used; texts without a digit, ``@``, a key prefix or a run of 32 hexadecimal
letters, of which every private string has one, are not searched.

Defined results: a null text stays null with zero counts; an empty text stays empty;
repeated rows are treated alike; other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfprice.llm.common import let

ROUNDS = 8
_WORD = "\\p{L}\\p{N}"
_OCTET = "(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)"
#: Kinds in the order in which they are tried, as patterns of the whole string.
PATTERNS = {
    "email": f"[{_WORD}._%+-]+@[{_WORD}-]+(?:\\.[{_WORD}-]+)+",
    "secret": "(?:[0-9a-fA-F]{32,}|(?:AKIA|ASIA)[0-9A-Z]{16}|(?:sk|pk|ghp|gho|xox[bp])[-_][0-9A-Za-z_-]{16,})",
    "ip": f"(?<!\\d\\.){_OCTET}(?:\\.{_OCTET}){{3}}(?!\\.\\d)",
    "date": "(?:\\d{4}-\\d{2}-\\d{2}|\\d{2}/\\d{2}/\\d{4}|\\d{2}\\.\\d{2}\\.\\d{4})",
    "ssn": "\\d{3}-\\d{2}-\\d{4}",
    "phone": "(?:\\+\\d{1,3}[ .-]?)?(?:\\(\\d{3}\\)[ .-]?|\\d{3}[ .-])\\d{3}[ .-]\\d{4}|\\+\\d{1,3}(?:[ .-]?\\d){8,12}",
    "card": "\\d(?:[ -]?\\d){12,18}",
}
_NOT_INSIDE, _NOT_BEFORE = f"(?<![{_WORD}._%+@-])", f"(?![{_WORD}@])"
#: An address is only tried at the start of a run of its characters, and never backtracks.
SEARCH = (
    f"{_NOT_INSIDE}[{_WORD}._%+-]++@[{_WORD}-]++(?:\\.[{_WORD}-]++)+|(?<![{_WORD}])(?:"
    + "|".join(p for k, p in PATTERNS.items() if k != "email") + f"){_NOT_BEFORE}"
)
#: What a text must have for any pattern to match: secrets need neither a digit nor ``@``.
GATE = "[0-9@]|AKIA|ASIA|(?:sk|pk|ghp|gho|xox[bp])[-_]|[a-fA-F]{32}"
#: First code point and size of the runs of characters that are permuted among themselves.
RUNS = [(48, 10), (65, 26), (97, 26), (0xC0, 23), (0xD8, 7), (0xE0, 23), (0xF8, 7)]


# First digits of the telephone country codes of one and of two digits; all others have three.
ONE_DIGIT_CODES = "[17]"
TWO_DIGIT_CODES = "2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
#: Capitals of the permuted letters, and their small letters.
CAPITALS = "".join(chr(first + i) for first, size in (RUNS[1], RUNS[3], RUNS[4]) for i in range(size))
SMALL = "".join(chr(first + i) for first, size in (RUNS[2], RUNS[5], RUNS[6]) for i in range(size))


def _long(value: int | str) -> Column:
    return F.lit(value).cast("long")


def _prf(key: str, round_: Column, other: Column) -> Column:
    """Keyed 60-bit number of a half."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), round_.cast("string"), other.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def permuted_number(value: Column, high: Column, low: Column, key: str) -> Column:
    """Keyed permutation of the numbers 0 to high * low - 1; each size has a permutation of its own."""
    start = let(value, lambda v: F.struct(
        ((v - F.pmod(v, low)) / low).cast("long").alias("a"), F.pmod(v, low).alias("b")))

    def keyed(size: Column, half: Column) -> Column:
        return F.concat_ws(":", size.cast("string"), half.cast("string"))

    def turn(acc: Column, r: Column) -> Column:
        return let(F.pmod(acc["a"] + _prf(key, r * 2, keyed(high, acc["b"])), high), lambda x: F.struct(
            x.alias("a"), F.pmod(acc["b"] + _prf(key, r * 2 + 1, keyed(low, x)), low).alias("b")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS // 2 - 1)), start, turn, lambda acc: acc["a"] * low + acc["b"])


def permuted_digits(digits: Column, key: str) -> Column:
    """Keyed permutation of the digit strings of one length, 2 to 18."""
    n = F.length(digits)
    low = F.floor(n / 2).cast("int")
    number = permuted_number(digits.cast("long"), F.pow(F.lit(10.0), n - low).cast("long"),
                             F.pow(F.lit(10.0), low).cast("long"), key)
    return F.lpad(number.cast("string"), n, "0")


def _codes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: F.length(c) > 0), lambda c: F.struct(
        F.ascii(c).alias("code"), c.alias("char")))


def _by_run(code: Column, body, otherwise: Column) -> Column:
    found = None
    for first, size in RUNS:
        inside = code.between(first, first + size - 1)
        found = F.when(inside, body(first, size)) if found is None else found.when(inside, body(first, size))
    return found.otherwise(otherwise)


def permuted_text(text: Column, key: str) -> Column:
    """Keyed permutation of the strings of one shape: each letter or digit stays in its run of characters."""
    def half(text_: Column, first: bool) -> Column:
        cut = F.ceil(F.length(text_) / 2).cast("int")
        return F.substring(text_, F.lit(1), cut) if first else F.substring(text_, cut + 1, F.length(text_))

    def moved(own: Column, other: Column, r: Column) -> Column:
        def of_block(k: Column) -> Column:  # 64 hexadecimal digits serve 16 characters
            return F.sha2(F.concat_ws("|", F.lit(key), F.lit("text"), r.cast("string"), k.cast("string"), other), 256)

        blocks = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(own) / 16).cast("int")), of_block), "")
        return let(blocks, lambda stream: F.array_join(F.transform(_codes(own), lambda c, i: _by_run(
            c["code"],
            lambda first, size: F.chr(first + F.pmod(
                c["code"] - first + F.conv(F.substring(stream, i * 4 + 1, F.lit(4)), 16, 10).cast("long"), F.lit(size)))
            if first < 128 else _wide_char(first + F.pmod(
                c["code"] - first + F.conv(F.substring(stream, i * 4 + 1, F.lit(4)), 16, 10).cast("long"), F.lit(size))),
            c["char"])), ""))

    def turn(acc: Column, r: Column) -> Column:
        return let(moved(acc["a"], acc["b"], r * 2), lambda x: F.struct(
            x.alias("a"), moved(acc["b"], x, r * 2 + 1).alias("b")))

    start = F.struct(half(text, True).alias("a"), half(text, False).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS // 2 - 1)), start, turn,
                       lambda acc: F.concat(acc["a"], acc["b"]))


def _wide_char(code: Column) -> Column:
    """Character of a code point from 128 to 255, which ``chr`` cannot give in two bytes."""
    table = F.lit("".join(chr(c) for c in range(0xC0, 0x100)))
    return F.substring(table, (code - 0xC0 + 1).cast("int"), F.lit(1))


def _with_digits(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    places = F.transform(F.filter(F.split(shape, ""), lambda c: F.length(c) > 0), lambda c: F.struct(
        c.alias("c"), c.rlike("^[0-9]$").alias("d")))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))

    def add(acc: Column, p: Column) -> Column:
        return F.struct(
            F.concat(acc["out"], F.when(p["d"], F.substring(digits, acc["next"], F.lit(1))).otherwise(p["c"])).alias("out"),
            (acc["next"] + p["d"].cast("int")).alias("next"))

    return F.aggregate(places, start, add, lambda acc: acc["out"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_digit(digits: Column) -> Column:
    """Check digit that ``digits`` need behind them."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when((n - i) % 2 == 0, 2 * d).otherwise(d)
        return acc + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.pmod(-F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add), F.lit(10))


def _card(text: Column, key: str) -> Column:
    digits = _digits(text)
    body, last = F.substring(digits, F.lit(1), F.length(digits) - 1), F.right(digits, F.lit(1)).cast("int")
    off = F.pmod(last - luhn_digit(body), F.lit(10))  # 0 for valid numbers, kept for the others
    return let(F.struct(permuted_digits(body, key + "card").alias("body"), off.alias("off")), lambda p: _with_digits(
        text, F.concat(p["body"], F.pmod(luhn_digit(p["body"]) + p["off"], F.lit(10)).cast("string"))))


def _phone(text: Column, key: str) -> Column:
    digits = _digits(text)
    size = (F.when(~text.startswith("+"), 0).when(digits.rlike(f"^{ONE_DIGIT_CODES}"), 1)
            .when(digits.rlike(f"^(?:{TWO_DIGIT_CODES})"), 2).otherwise(3))
    return let(F.struct(digits.alias("digits"), size.alias("size")), lambda p: _with_digits(text, F.concat(
        F.substring(p["digits"], F.lit(1), p["size"]),
        let(F.substring(p["digits"], p["size"] + 1, F.length(p["digits"])), lambda rest: permuted_digits(rest, key + "phone")))))


def _ip(text: Column, key: str) -> Column:
    def number(parts: Column) -> Column:
        return F.aggregate(parts, _long(0), lambda acc, x: acc * 256 + x.cast("long"))

    value = permuted_number(number(F.split(text, "\\.")), _long(65536), _long(65536), key + "ip")
    return let(value, lambda v: F.concat_ws(".", *[
        F.pmod(F.shiftright(v, 8 * k), _long(256)).cast("string") for k in (3, 2, 1, 0)]))


def _date(text: Column, key: str) -> Column:
    shapes = [("^\\d{4}-", "yyyy-MM-dd"), ("/", "dd/MM/yyyy"), ("\\.", "dd.MM.yyyy")]
    first, days = F.lit("1700-01-01").cast("date"), (27, 5411)
    found = None
    for mark, shape in shapes:
        day = F.to_date(F.try_to_timestamp(text, F.lit(shape)))
        number = F.date_diff(day, first).cast("long")
        new = F.date_format(F.date_add(first, permuted_number(
            number, _long(days[0]), _long(days[1]), key + "date").cast("int")), shape)
        inside = number.between(0, days[0] * days[1] - 1)
        value = F.when(F.coalesce(inside, F.lit(False)), new).otherwise(text)
        found = F.when(text.rlike(mark), value) if found is None else found.when(text.rlike(mark), value)
    return found.otherwise(text)


def _email(text: Column, key: str) -> Column:
    end = F.regexp_extract(text, f"(\\.[{_WORD}-]+)$", 1)
    body = F.substring(text, F.lit(1), F.length(text) - F.length(end))
    small = F.translate(body, CAPITALS, SMALL)
    return F.concat(let(permuted_text(small, key + "email"), lambda new: F.when(body == small, new).otherwise(
        _with_capitals(new, body))), end)


def _with_capitals(text: Column, like: Column) -> Column:
    """``text`` with capitals where ``like``, a text of the same length, has them."""
    def char(i: Column) -> Column:
        given = F.substring(like, i, F.lit(1))
        return let(F.substring(text, i, F.lit(1)), lambda c: F.when(
            given == F.translate(given, CAPITALS, SMALL), c).otherwise(F.translate(c, SMALL, CAPITALS)))

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(like)), char), "")


def _secret(text: Column, key: str) -> Column:
    hexed = text.rlike("^[0-9a-fA-F]+$")
    prefix = F.when(hexed, "").otherwise(F.regexp_extract(text, "^(AKIA|ASIA|(?:sk|pk|ghp|gho|xox[bp])[-_])", 1))
    rest = F.substring(text, F.length(prefix) + 1, F.length(text))
    upper = text.rlike("[A-F]")
    plain = F.when(hexed, _hex(F.lower(text), key + "hex")).otherwise(permuted_text(rest, key + "secret"))
    return F.concat(prefix, F.when(hexed & upper, F.upper(plain)).otherwise(plain))


def _hex(text: Column, key: str) -> Column:
    """Keyed permutation of lower-case hexadecimal strings of one length."""
    def moved(own: Column, other: Column, r: Column) -> Column:
        def of_block(k: Column) -> Column:
            return F.sha2(F.concat_ws("|", F.lit(key), r.cast("string"), k.cast("string"), other), 256)

        stream = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(own) / 64).cast("int")), of_block), "")
        digits = "0123456789abcdef"

        return let(stream, lambda s: F.array_join(F.transform(F.sequence(F.lit(1), F.length(own)), lambda i: F.substring(
            F.lit(digits), (F.pmod(
                F.conv(F.substring(own, i, F.lit(1)), 16, 10).cast("int")
                + F.conv(F.substring(s, i, F.lit(1)), 16, 10).cast("int"), F.lit(16)) + 1), F.lit(1))), ""))

    cut = F.ceil(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), cut).alias("a"), F.substring(text, cut + 1, F.length(text)).alias("b"))

    def turn(acc: Column, r: Column) -> Column:
        return let(moved(acc["a"], acc["b"], r * 2), lambda x: F.struct(
            x.alias("a"), moved(acc["b"], x, r * 2 + 1).alias("b")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS // 2 - 1)), start, turn,
                       lambda acc: F.concat(acc["a"], acc["b"]))


def kind_of(found: Column) -> Column:
    picked = None
    for kind, pattern in PATTERNS.items():
        hit = found.rlike(f"^(?:{pattern})$")
        picked = F.when(hit, kind) if picked is None else picked.when(hit, kind)
    return picked


def pseudonym(found: Column, key: str) -> Column:
    """Pseudonym of one private string of any kind."""
    makers = {"email": _email, "secret": _secret, "ip": _ip, "date": _date, "ssn": lambda t, k: _with_digits(
        t, permuted_digits(_digits(t), k + "ssn")), "phone": _phone, "card": _card}

    def chosen(p: Column) -> Column:
        made = None
        for kind, maker in makers.items():
            value = maker(p["text"], key)
            made = F.when(p["kind"] == kind, value) if made is None else made.when(p["kind"] == kind, value)
        return made.otherwise(p["text"])

    return let(F.struct(found.alias("text"), kind_of(found).alias("kind")), chosen)


def with_pseudonyms(text: Column, key: str) -> Column:
    """Struct of the text with its private strings replaced, and the strings' kinds in order."""
    if not key:
        raise ValueError("pseudonyms need a key")
    found = F.regexp_extract_all(text, F.lit(SEARCH), F.lit(0))
    between = F.split(text, SEARCH, -1)

    def rebuilt(p: Column) -> Column:
        return F.struct(
            F.array_join(F.transform(p["between"], lambda x, i: F.concat(
                x, F.coalesce(pseudonym(F.get(p["found"], i), key), F.lit("")))), "").alias("text"),
            F.transform(p["found"], kind_of).alias("kinds"))

    untouched = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))
    replaced = let(F.struct(found.alias("found"), between.alias("between")), lambda p: F.when(
        F.size(p["found"]) > 0, rebuilt(p)).otherwise(untouched))
    return F.when(text.rlike(GATE), replaced).otherwise(untouched)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``doc_id``, the new ``text``, ``n_found`` and the number of each kind, ``n_email`` and so on."""
    rows = docs.select("doc_id", with_pseudonyms(F.col("text"), key).alias("made_"))
    kinds = F.coalesce(F.col("made_.kinds"), F.array().cast("array<string>"))

    def count(kind: str) -> Column:
        return F.size(F.filter(kinds, lambda k: k == kind)).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", F.col("made_.text").alias("text"), F.size(kinds).cast("long").alias("n_found"),
                       *[count(k) for k in PATTERNS])


def replace_in(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and ``n_chars`` of the new text; all other columns as they are."""
    changed = docs.withColumn("text", with_pseudonyms(F.col("text"), key)["text"])
    if "n_chars" not in docs.columns:
        return changed
    return changed.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
