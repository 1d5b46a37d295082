"""Format-preserving Feistel pseudonyms for personal data, with built-in expressions only.

Numbers and dates are found by one pattern, validated (check digits, ranges, calendar) and replaced by a keyed permutation of the set of
valid values of their format: a Feistel network whose halves are added modulo the sizes of the halves. Equal values get equal
pseudonyms in every document, different ones different pseudonyms, and a pseudonym is as valid as what it stands for. Values that fail
validation stay as they are.

Scale: one map without a shuffle. A text is scanned once, by a pattern without nested repetition; only the matches, which are few, pass
through the Feistel expressions.
"""

from __future__ import annotations

import hmac
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
#: The parts of the pattern, tried in this order at each place. Fixed values.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "secret": r"(?i:\b(?:token|secret|api_?key|password)\s{0,3}[=:]\s{0,3}[\"']?)[0-9a-fA-F]{32,64}\b",
    "date": r"(?<![\w.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![\w-])",
    "ip": r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "phone": r"(?<![\w])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?!\w)|(?<![\w+])\+[2-9][0-9]{0,2}(?:[ .-]?[0-9]{2,4}){2,5}(?!\w)",
    "card": r"(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])",
}
PATTERN = "|".join(KINDS.values())


def round_key(key: str, name: str, i: int) -> str:
    """The key of one round of one kind, by HMAC. Plans and event logs show these only; the key itself stays on the driver."""
    return hmac.new(key.encode(), f"{name}|{i}".encode(), "sha256").hexdigest()


def mix(key: str, name: str, i: int, half: Column) -> Column:
    """The round function: 53 bits of a keyed SHA-256 of one half."""
    digest = F.sha2(F.concat(F.lit(round_key(key, name, i) + "|"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def _size(x: int | Column) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def feistel(key: str, name: str, value: Column, left_size: int | Column, right_size: int | Column) -> Column:
    """A keyed permutation of 0 .. left_size * right_size - 1.

    Each round adds a function of one half to the other, modulo that one's size, which can be undone whatever the function;
    ``inverse`` does so.
    """
    left, right = _size(left_size), _size(right_size)
    state = _once(value, lambda v: F.struct(F.call_function("div", v, right).alias("a"), F.pmod(v, right).alias("b")))
    for i in range(ROUNDS):
        state = _round(key, name, i, state, left, right, 1)
    return _once(state, lambda s: s["a"] * right + s["b"])


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once: a lambda variable holds it, where nested expressions would grow exponentially."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _round(key: str, name: str, i: int, state: Column, left_size: Column, right_size: Column, sign: int) -> Column:
    if i % 2 == 0:
        return _once(state, lambda s: F.struct(F.pmod(s["a"] + sign * F.pmod(mix(key, name, i, s["b"]), left_size), left_size).alias("a"), s["b"].alias("b")))
    return _once(state, lambda s: F.struct(s["a"].alias("a"), F.pmod(s["b"] + sign * F.pmod(mix(key, name, i, s["a"]), right_size), right_size).alias("b")))


def inverse(key: str, name: str, value: Column, left_size: int | Column, right_size: int | Column) -> Column:
    """Undo ``feistel``."""
    left, right = _size(left_size), _size(right_size)
    state = _once(value, lambda v: F.struct(F.call_function("div", v, right).alias("a"), F.pmod(v, right).alias("b")))
    for i in reversed(range(ROUNDS)):
        state = _round(key, name, i, state, left, right, -1)
    return _once(state, lambda s: s["a"] * right + s["b"])


def _only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _pad(x: Column, n) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def fill_format(shape: Column, digits: Column) -> Column:
    """Put ``digits``, in order, where ``shape`` has digits; all else stays."""
    chars = F.transform(F.split(shape, ""), lambda c: F.struct(c.alias("c"), c.rlike("^[0-9]$").cast("int").alias("d")))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(
        chars,
        start,
        lambda acc, c: F.struct(
            F.concat(acc["out"], F.when(c["d"] == 1, F.substr(digits, acc["at"], F.lit(1))).otherwise(c["c"])).alias("out"),
            (acc["at"] + c["d"]).alias("at"),
        ),
        lambda acc: acc["out"],
    )


def permute_digits(key: str, name: str, digits: Column) -> Column:
    """Permute digit strings within those of equal length, up to 30 digits: two decimal halves, each a BIGINT."""
    n = F.length(digits)
    left = F.call_function("div", n, F.lit(2)).cast("int")
    right = n - left
    size_a, size_b = (F.rpad(F.lit("1"), x + 1, "0").cast("long") for x in (left, right))
    first = F.when(left > 0, F.substr(digits, F.lit(1), left)).otherwise("0").cast("long")
    state = F.struct(first.alias("a"), F.substr(digits, left + 1, right).cast("long").alias("b"))
    for i in range(ROUNDS):
        state = _round(key, name, i, state, size_a, size_b, 1)
    return _once(state, lambda s: F.concat(F.when(left > 0, _pad(s["a"], left)).otherwise(F.lit("")), _pad(s["b"], right)))


def luhn_sum(digits: Column, from_right: int) -> Column:
    """The Luhn sum, doubling every second digit; from_right is 1 if the last digit is a check digit, else 0."""
    n = F.length(digits)
    places = F.sequence(F.lit(1), n)

    def one(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = (n - i) % 2 == from_right
        return F.when(twice & (d >= 5), 2 * d - 9).when(twice, 2 * d).otherwise(d)

    return F.aggregate(F.transform(places, one), F.lit(0), lambda a, b: a + b)


def iban_rest(value: Column) -> Column:
    """The value, four first characters moved to the end and letters as numbers, modulo 97."""
    moved = F.concat(F.substr(value, F.lit(5)), F.substring(value, 1, 4))
    return F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda acc, c: F.when(c.rlike("^[0-9]$"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97),
    )


def _date(key: str, x: Column) -> Column:
    """Any day from 1700 to 2099 (146,097 days: 189 times 773) becomes another one in the same notation."""
    iso = F.when(x.rlike("^[0-9]{4}[-/]"), F.regexp_replace(x, "/", "-"))
    dotted = F.when(x.rlike(r"^[0-9]{2}\."), F.concat(F.substring(x, 7, 4), F.lit("-"), F.substring(x, 4, 2), F.lit("-"), F.substring(x, 1, 2)))
    us = F.when(x.rlike("^(?:0[1-9]|1[0-2])/"), F.concat(F.substring(x, 7, 4), F.lit("-"), F.substring(x, 1, 2), F.lit("-"), F.substring(x, 4, 2)))
    eu = F.concat(F.substring(x, 7, 4), F.lit("-"), F.substring(x, 4, 2), F.lit("-"), F.substring(x, 1, 2))
    day = F.coalesce(iso, dotted, us, eu)
    zero = F.lit("1700-01-01").cast("date")

    def out(d: Column) -> Column:
        moved = F.date_add(zero, feistel(key, "date", F.date_diff(d, zero).cast("long"), 189, 773).cast("int"))
        text = F.date_format(moved, "yyyy-MM-dd")
        y, m, dd = F.substring(text, 1, 4), F.substring(text, 6, 2), F.substring(text, 9, 2)
        made = (
            F.when(x.rlike("^[0-9]{4}-"), text)
            .when(x.rlike("^[0-9]{4}/"), F.concat_ws("/", y, m, dd))
            .when(x.rlike(r"^[0-9]{2}\."), F.concat_ws(".", dd, m, y))
            .when(x.rlike("^(?:0[1-9]|1[0-2])/"), F.concat_ws("/", m, dd, y))
            .otherwise(F.concat_ws("/", dd, m, y))
        )
        return F.when(d.isNull() | (d < zero) | (d > F.lit("2099-12-31").cast("date")), x).otherwise(made)

    return _once(day.try_cast("date"), out)


def _ip(key: str, x: Column) -> Column:
    """Octets of at most 255; the pseudonym is another address."""
    part = F.split(x, r"\.")
    valid = F.forall(part, lambda p: (p.cast("int") <= 255) & (p.cast("int").cast("string") == p))
    number = F.aggregate(part, F.lit(0).cast("long"), lambda a, p: a * 256 + p.cast("long"))
    moved = _once(feistel(key, "ip", number, 65536, 65536), lambda n: F.concat_ws(".", *(F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0))))
    return F.when(valid, moved).otherwise(x)


def _ssn(key: str, x: Column) -> Column:
    area, group, serial = (F.substring(x, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area >= 1) & (area != 666) & (area < 900) & (group >= 1) & (serial >= 1)
    dense = area - 1 - (area > 666).cast("long")  # 898 areas
    number = (dense * 99 + group - 1) * 9999 + serial - 1

    def out(n: Column) -> Column:
        a, g, s = F.call_function("div", n, F.lit(9999 * 99)), F.pmod(F.call_function("div", n, F.lit(9999)), F.lit(99)), F.pmod(n, F.lit(9999))
        return F.concat_ws("-", _pad(a + 1 + (a >= 665).cast("long"), 3), _pad(g + 1, 2), _pad(s + 1, 4))

    return F.when(valid, _once(feistel(key, "ssn", number, 898 * 99, 9999), out)).otherwise(x)


def _phone(key: str, x: Column) -> Column:
    """North American numbers keep whether area and exchange codes are valid ones (200 and up); of others the country code's first
    digits stay. Without +1 or brackets only numbers with valid codes count as phone numbers.
    """
    digits = _only_digits(x)
    local = F.substr(digits, F.length(digits) - 9, F.lit(10))
    area, exchange, line = (F.substring(local, a, n).cast("long") for a, n in ((1, 3), (4, 3), (7, 4)))
    american = ~x.rlike(r"^\+[2-9]")
    marked = x.startswith("+") | x.contains("(")
    valid = american & F.length(digits).isin(10, 11) & (marked | ((area >= 200) & (exchange >= 200)))
    base = lambda code: F.when(code < 200, 0).otherwise(200)
    size = lambda code: F.when(code < 200, 200).otherwise(800)
    number = ((area - base(area)) * size(exchange) + exchange - base(exchange)) * 10000 + line

    def out(n: Column) -> Column:
        made = F.concat(
            _pad(F.call_function("div", n, size(exchange).cast("long") * 10_000) + base(area), 3),
            _pad(F.pmod(F.call_function("div", n, F.lit(10_000)), size(exchange)) + base(exchange), 3),
            _pad(F.pmod(n, F.lit(10_000)), 4),
        )
        return fill_format(x, F.concat(F.substr(digits, F.lit(1), F.length(digits) - 10), made))

    foreign = ~american & (F.length(digits) >= 8) & (F.length(digits) <= 15)
    other = fill_format(x, F.concat(F.substring(digits, 1, 2), permute_digits(key, "phone", F.substr(digits, F.lit(3)))))
    return F.when(valid, _once(feistel(key, "nanp", number, size(area) * 100, size(exchange) * 100), out)).when(foreign, other).otherwise(x)


def _card(key: str, x: Column) -> Column:
    """Numbers that pass the Luhn check keep their length and punctuation; the check digit is made anew."""
    digits = _only_digits(x)

    def out(d: Column) -> Column:
        body = permute_digits(key, "card", F.substr(d, F.lit(1), F.length(d) - 1))
        made = _once(body, lambda b: F.concat(b, F.pmod(10 - F.pmod(luhn_sum(b, 0), F.lit(10)), F.lit(10)).cast("string")))
        return F.when((F.pmod(luhn_sum(d, 1), F.lit(10)) == 0) & ~d.rlike("^0+$"), fill_format(x, made)).otherwise(x)

    return _once(digits, out)


def _iban(key: str, x: Column) -> Column:
    """Country and letters stay, digits are permuted and the check digits made anew."""
    plain = F.regexp_replace(x, " ", "")

    def out(v: Column) -> Column:
        body = F.substr(v, F.lit(5))
        moved = fill_format(body, permute_digits(key, "iban", _only_digits(body)))
        checked = _once(moved, lambda b: F.concat(_pad(98 - iban_rest(F.concat(F.substring(v, 1, 2), F.lit("00"), b)), 2), _only_digits(b)))
        return F.when((iban_rest(v) == 1) & (F.length(v) >= 15) & (F.length(v) <= 34) & (F.length(_only_digits(body)) >= 2), fill_format(x, checked)).otherwise(x)

    return _once(plain, out)


def permute_text(key: str, name: str, x: Column, alphabets: list[str]) -> Column:
    """Feistel over strings: each character moves within its alphabet (letters keep their case) by a stream that the other half determines."""
    n = F.call_function("div", F.length(x) + 1, F.lit(2)).cast("int")
    state = F.struct(F.substr(x, F.lit(1), n).alias("a"), F.substr(x, n + 1).alias("b"))

    def moved(text: Column, other: Column, i: int) -> Column:
        def one(c: Column, k: Column, stream: Column) -> Column:
            step = F.conv(F.substr(stream, F.pmod(k * 2, F.lit(126)) + 1, F.lit(2)), 16, 10).cast("int")
            out = c
            for alphabet in alphabets:
                at = F.instr(F.lit(alphabet), F.lower(c))
                new = F.substr(F.lit(alphabet), F.pmod(at - 1 + step, F.lit(len(alphabet))) + 1, F.lit(1))
                out = F.when(at > 0, F.when(c.rlike("^[A-Z]$"), F.upper(new)).otherwise(new)).otherwise(out)
            return out

        stream = F.sha2(F.concat(F.lit(round_key(key, name, i) + "|"), other), 512)
        made = _once(stream, lambda s: F.array_join(F.transform(F.split(text, ""), lambda c, k: one(c, k, s)), ""))
        return F.when(F.length(text) > 0, made).otherwise("")

    def round_(i: int) -> Callable[[Column], Column]:
        if i % 2 == 0:
            return lambda s: F.struct(moved(s["a"], s["b"], i).alias("a"), s["b"].alias("b"))
        return lambda s: F.struct(s["a"].alias("a"), moved(s["b"], s["a"], i).alias("b"))

    for i in range(ROUNDS):
        state = _once(state, round_(i))
    return _once(state, lambda s: F.concat(s["a"], s["b"]))


def _email(key: str, x: Column) -> Column:
    """The local part is permuted, the domain stays."""
    local = F.regexp_extract(x, "^([^@]*)@", 1)
    return F.concat(permute_text(key, "email", local, ["abcdefghijklmnopqrstuvwxyz", "0123456789"]), F.substr(x, F.length(local) + 1))


def _secret(key: str, x: Column) -> Column:
    """The name stays, the hexadecimal digits are permuted whatever their case; digits in capitals stay such."""
    digits = F.regexp_extract(x, "([0-9a-fA-F]{32,64})$", 1)
    made = permute_text(key, "secret", F.lower(digits), ["0123456789abcdef"])
    cased = _once(made, lambda m: F.when(digits.rlike("[A-F]") & ~digits.rlike("[a-f]"), F.upper(m)).otherwise(m))
    return F.concat(F.substr(x, F.lit(1), F.length(x) - F.length(digits)), cased)


def kind_of(x: Column) -> Column:
    """Which kind of candidate a match of PATTERN is."""
    return (
        F.when(x.contains("@"), "email")
        .when(x.rlike("^[A-Z]{2}[0-9]{2}"), "iban")
        .when(x.rlike("^[A-Za-z]"), "secret")
        .when(x.rlike(r"^(?:[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})$"), "date")
        .when(x.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), "ip")
        .when(x.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(x.rlike("^[0-9](?:[ -]?[0-9]){12,18}$"), "card")
        .otherwise("phone")
    )


def pseudonym(key: str, x: Column) -> Column:
    """The pseudonym of one candidate, or the candidate itself if it is not valid."""
    makers = {"email": _email, "iban": _iban, "secret": _secret, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card}

    def chosen(kind: Column) -> Column:
        out = F.when(kind == "phone", _phone(key, x))
        for name, make in makers.items():
            out = out.when(kind == name, make(key, x))
        return out

    return _once(kind_of(x), chosen)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and __ll_found and __ll_new: candidates and what stands for them, in order.

    A null text stays null and an empty one empty, both with null or empty lists; other columns pass as they are; repeated rows and
    equal values anywhere get equal pseudonyms. Texts are scanned whole. Pseudonyms are as long as what they stand for, but for the octets
    of addresses.
    """
    text = F.col("text")
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    listed = docs.withColumn("__ll_found", found)
    made = listed.withColumn("__ll_new", F.transform("__ll_found", lambda m: pseudonym(key, m)))
    # n matches leave n + 1 pieces between them; the last piece is followed by nothing.
    pieces = F.split(text, PATTERN, -1)
    joined = F.array_join(F.zip_with(pieces, F.col("__ll_new"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return made.withColumn("text", F.when(F.size("__ll_found") > 0, joined).otherwise(text))


def protect_documents(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with pseudonyms in place of personal data and the same columns; n_chars, if there, follows the new text."""
    made = pseudonymise(docs, key)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        made = made.withColumn("n_chars", F.when(F.size("__ll_found") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return made.select(*docs.columns)


def report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text, n_candidates, n_replaced, kinds (sorted, comma-joined kinds of what was replaced), n_chars of the new text."""
    made = pseudonymise(docs.select("doc_id", F.col("text").cast("string").alias("text")), key)
    both = F.filter(F.arrays_zip(F.col("__ll_found").alias("old"), F.col("__ll_new").alias("new")), lambda p: p["old"] != p["new"])
    listed = made.withColumn("__ll_both", F.coalesce(both, F.array()))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("__ll_both", lambda p: kind_of(p["old"])))), ",")
    return listed.select(
        "doc_id",
        "text",
        F.coalesce(F.size("__ll_found"), F.lit(0)).cast("long").alias("n_candidates"),
        F.size("__ll_both").cast("long").alias("n_replaced"),
        kinds.alias("kinds"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"),
    )
