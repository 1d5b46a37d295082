import hashlib
import hmac
import ipaddress
import re
from datetime import date, timedelta

from pyspark.sql import functions as F

from logloom.llm import catalog, pii

KEY = "k"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_ok(x):
    x = x.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def replaced(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.pseudonymise(df, KEY).orderBy("doc_id").collect()]


def test_permutations_are_exact(spark):
    for left, right, n in ((189, 773, 146_097), (7, 11, 77), (1, 13, 13)):
        made = spark.range(n).select("id", pii.feistel(KEY, "t", F.col("id"), left, right).alias("x"))
        back = made.withColumn("y", pii.inverse(KEY, "t", F.col("x"), left, right))
        r = back.agg(F.countDistinct("x").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"), F.sum((F.col("y") != F.col("id")).cast("int")).alias("bad")).first()
        assert (r.n, r.a, r.b, r.bad) == (n, 0, n - 1, 0)


def test_digit_and_text_permutations(spark):
    for width in (1, 2, 3):
        df = spark.range(10**width).select(F.lpad(F.col("id").cast("string"), width, "0").alias("d"))
        assert df.select(pii.permute_digits(KEY, "t", F.col("d")).alias("x")).distinct().where(F.length("x") == width).count() == 10**width
    words = [a + b + c for a in "abcxyz" for b in "019" for c in "AZ_"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(pii.permute_text(KEY, "t", F.col("w"), ["abcdefghijklmnopqrstuvwxyz", "0123456789"])).collect()]
    assert len(set(got)) == len(words)
    assert all(re.fullmatch("[a-z][0-9][A-Z_]", g) and (g[2] == "_") == (w[2] == "_") for g, w in zip(got, words, strict=True))


def test_same_pseudonym_in_every_plan(spark):
    texts = ["ann.b1@x.org", "token = \"3dc91a32781def2fd668aa2fd071eacee1a19444\"", "+1 (275) 555-5927"]
    first = replaced(spark, texts)
    second = replaced(spark, ["before " + t + " after" for t in texts])
    assert [s.removeprefix("before ").removesuffix(" after") for s in second] == first
    assert not set(first) & set(texts)


def test_formats_stay_valid(spark):
    cards = ["4111111111111111", "5500 0000 0000 0004", "3782-822463-10005", "6011000990139424"]
    for old, new in zip(cards, replaced(spark, [f"c {x}." for x in cards]), strict=True):
        new = new[2:-1]
        assert new != old and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", old) and luhn(re.sub(r"\D", "", new))
    ibans = ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "FR1420041010050500013M02606"]
    for old, new in zip(ibans, replaced(spark, ibans), strict=True):
        assert new != old and iban_ok(new) and new[:2] == old[:2] and len(new) == len(old)
    for old, new in zip(["10.0.0.1", "192.168.1.254"], replaced(spark, ["ip 10.0.0.1", "ip 192.168.1.254"]), strict=True):
        assert new[3:] != old and ipaddress.ip_address(new[3:])
    for new in replaced(spark, ["123-45-6789", "899-99-9999", "001-01-0001", "665-01-0001", "667-01-0001"]):
        a, g, s = map(int, new.split("-"))
        assert 1 <= a < 900 and a != 666 and g >= 1 and s >= 1
    for new in replaced(spark, ["+1 (275) 555-5927", "415-555-2671", "1.212.555.0100"]):
        digits = re.sub(r"\D", "", new)[-10:]
        assert digits[0] in "23456789" and digits[3] in "23456789"
    for old, new in zip(["+1 (139) 555-2766", "(012) 034-0567"], replaced(spark, ["+1 (139) 555-2766", "(012) 034-0567"]), strict=True):
        assert new != old and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", old)


def test_dates(spark):
    days = [date(1700, 1, 1) + timedelta(days=i * 997) for i in range(146)]
    made = replaced(spark, [d.isoformat() for d in days])
    assert len({date.fromisoformat(x) for x in made}) == len(days)
    other = replaced(spark, [d.strftime("%d.%m.%Y") for d in days])
    assert [x[6:] + "-" + x[3:5] + "-" + x[:2] for x in other] == made
    assert replaced(spark, ["31.04.2020", "2023-02-29", "13/13/2020", "9999-01-01"]) == ["31.04.2020", "2023-02-29", "13/13/2020", "9999-01-01"]


def test_clean_texts_stay(spark):
    texts = ["4111111111111112", "1234567890123456", "v1.2.3", "256.1.1.1", "666-12-1234", "a@b", "room 12-34", "1.2.3.4.5", "000-00-0000", "2353820953013749", "100-200-3000"]
    assert replaced(spark, texts) == texts


def test_odd_rows(odd, empty):
    got = pii.protect_documents(odd, KEY)
    assert got.columns == odd.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, odd.collect()))
    assert pii.protect_documents(empty, KEY).collect() == []
    assert pii.report(odd, KEY).where("n_replaced != 0").isEmpty()


def test_planted_values_go(spark, documents):
    made = pii.protect_documents(documents, KEY).collect()
    assert all(r.n_chars == len(r.text) for r in made)
    new = {r.doc_id: r.text for r in made}
    pattern = re.compile(r"[\w.]+@mail\d\.example\.com|\+1 \(\d{3}\) \d{3}-\d{4}")
    n = 0
    for r in documents.collect():
        for x in pattern.findall(r.text):
            n += 1
            assert x not in new[r.doc_id]
    assert n > 0


def plain_feistel(name, value, left, right):
    """Six rounds of adding a keyed hash of one half to the other, in plain Python."""
    a, b = divmod(value, right)
    for i in range(6):
        own = hmac.new(catalog.PII_KEY.encode(), f"{name}|{i}".encode(), "sha256").hexdigest()
        other, size = (b, left) if i % 2 == 0 else (a, right)
        step = int(hashlib.sha256(f"{own}|{other}".encode()).hexdigest()[:13], 16)
        if i % 2 == 0:
            a = (a + step) % left
        else:
            b = (b + step) % right
    return a * right + b


def plain_text(name, text, alphabets):
    half = (len(text) + 1) // 2
    parts = [text[:half], text[half:]]
    for i in range(6):
        own = hmac.new(catalog.PII_KEY.encode(), f"{name}|{i}".encode(), "sha256").hexdigest()
        moved, other = parts[i % 2], parts[1 - i % 2]
        stream = hashlib.sha512(f"{own}|{other}".encode()).hexdigest()
        out = ""
        for k, c in enumerate(moved):
            step = int(stream[k * 2 % 126 :][:2], 16)
            for alphabet in alphabets:
                if c.lower() in alphabet:
                    new = alphabet[(alphabet.index(c.lower()) + step) % len(alphabet)]
                    c = new.upper() if c.isupper() else new
                    break
            out += c
        parts[i % 2] = out
    return "".join(parts)


def by_hand(x):
    """The pseudonym of a mail name, secret, ISO date, address or social security number; None for other kinds."""
    if "@" in x:
        local, at, rest = x.partition("@")
        return plain_text("email", local, ["abcdefghijklmnopqrstuvwxyz", "0123456789"]) + at + rest
    if re.fullmatch(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", x):
        try:
            number = int(ipaddress.IPv4Address(x))
        except ValueError:
            return x
        return str(ipaddress.IPv4Address(plain_feistel("ip", number, 65536, 65536)))
    if re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", x):
        a, g, s = map(int, x.split("-"))
        if not (1 <= a < 900 and a != 666 and g and s):
            return x
        n = plain_feistel("ssn", ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1, 898 * 99, 9999)
        a, g, s = n // 9999 // 99, n // 9999 % 99, n % 9999
        return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"
    if re.fullmatch("[0-9]{4}-[0-9]{2}-[0-9]{2}", x):
        try:
            days = (date.fromisoformat(x) - date(1700, 1, 1)).days
        except ValueError:
            return x
        return str(date(1700, 1, 1) + timedelta(days=plain_feistel("date", days, 189, 773))) if 0 <= days < 146_097 else x
    return None


def test_query_by_hand(spark, data):
    """Every whole text of the query: what lies between candidates is untouched, and what stands for them is what plain Python makes of
    them (mail names, dates, addresses, social security numbers) or, for the other kinds, the same everywhere, valid and of one format."""
    top = data.replace("0.001", "0.01")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{top}/documents.parquet").collect()}
    pattern = re.compile(pii.PATTERN, re.ASCII)
    known, kinds = {}, 0
    got = catalog.op1_pii(spark, top).collect()
    assert len(got) == len(texts)
    for r in got:
        old = texts[r.doc_id]
        rest, at, n, changed = r.text, 0, 0, 0
        for m in pattern.finditer(old):
            between = old[at : m.start()]
            assert rest.startswith(between)
            rest, at, n = rest[len(between) :], m.end(), n + 1
            want = by_hand(m[0])
            kinds += want is not None and want != m[0]
            new = rest[: len(want)] if want is not None else rest[: len(m[0])]
            assert want is None or new == want
            assert known.setdefault(m[0], new) == new
            if want is None:
                assert re.sub("[0-9A-Za-z]", "0", new) == re.sub("[0-9A-Za-z]", "0", m[0])
            changed += new != m[0]
            rest = rest[len(new) :]
        assert rest == old[at:]
        assert (r.n_candidates, r.n_replaced, r.n_chars) == (n, changed, len(r.text))
    assert kinds > 20 and len(set(known.values())) == len(known)


def test_plans_do_not_show_the_key(spark, documents):
    plan = pii.report(documents, "the very secret key")._jdf.queryExecution().toString()
    assert "very secret" not in plan
