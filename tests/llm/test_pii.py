import hashlib
import ipaddress
import re
from datetime import date, datetime, timedelta

import pytest

from tidelog.llm import pii


def luhn(text):
    digits = [int(c) for c in reversed(text) if c.isdigit()]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def iban(text):
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


FOUND = {
    "card": ["4111111111111111", "4111-1111-1111-1111", "3782 822463 10005", "6011000990139424"],
    "iban": ["GB82WEST12345698765432", "DE89370400440532013000"],
    "date": ["1985-03-14", "2024/02/29", "12/31/1999", "31/12/1999", "01.05.2001", "1900-01-01", "2099-12-31"],
    "ip": ["192.168.0.1", "8.8.8.8", "255.255.255.255"],
    "ssn": ["123-45-6789", "899-99-9999", "667-01-0001"],
    "phone": ["+1 (279) 555-0216", "(555) 123-4567", "415-555-2671", "+44 20 7946 0958"],
    "email": ["jane.doe+x@mail5.example.com", "Ünal.46@a.org"],
    "secret": ['token = "11acdfb36bb72224148e6160f674b4be45601bff"', 'API_KEY: "abcDEF123456"'],
}
LEFT = ["4111111111111112", "2123465659789240", "300.1.2.3", "1.2.3.4.5", "000-12-3456", "2023-02-30", "1850-01-01", "12345", "GB82WEST12345698765433", "a@b", 'token = "short"', "3.14159", "0000000000000000"]
CHECKS = {
    "card": luhn, "iban": iban, "ip": ipaddress.ip_address, "ssn": lambda s: re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", s),
    "phone": lambda s: re.fullmatch(r"[+()\d .\-]+", s), "email": lambda s: re.fullmatch(r"[^@\s]+@[^@\s]+\.[A-Za-z]+", s), "secret": lambda s: s.endswith('"'),
}


@pytest.fixture(scope="module")
def rows(spark):
    docs = [(k * 100 + i, f"Before {v}, after.", k) for k, (_, vs) in enumerate(FOUND.items()) for i, v in enumerate(vs)]
    docs += [(5000 + i, f"x {v} y", 0) for i, v in enumerate(LEFT)]
    docs += [(9000, None, 0), (9001, "", 0), (9002, "no data", 0), (9003, "twice 8.8.8.8 and 8.8.8.8 4111111111111111 4111111111111111", 0), (9004, "word " * 200_000 + "8.8.8.8", 0), (None, "8.8.8.8", 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, kind int").withColumn("pii", pii.F.lit("clash"))
    return frame, docs, {r.doc_id: r for r in pii.pseudonymize(frame, "key one").collect()}


def test_every_kind_is_found_and_keeps_its_format(rows):
    _, docs, got = rows
    at = iter(docs)
    for kind, values in FOUND.items():
        for value in values:
            row = got[next(at)[0]]
            assert [(p.kind, p.found) for p in row.pii] == [(kind, value)]
            new = row.pii[0].new
            assert row.text == f"Before {new}, after." and new != value
            if kind in ("email", "secret"):
                assert [c.isalnum() for c in new] == [c.isalnum() for c in value]
            elif kind not in ("ip", "date"):
                assert re.sub(r"\d", "9", new) == re.sub(r"\d", "9", value)
            if kind == "date":
                form = "%Y-%m-%d" if "-" in value else "%d.%m.%Y" if "." in value else "%Y/%m/%d" if value[4] == "/" else "%d/%m/%Y" if value[:2] == "31" else "%m/%d/%Y"
                assert 1900 <= datetime.strptime(new, form).year <= 2099
            else:
                assert CHECKS[kind](new)


def test_what_does_not_validate_stays(rows):
    _, docs, got = rows
    for i, value in enumerate(LEFT):
        assert (got[5000 + i].text, got[5000 + i].pii) == (f"x {value} y", []), value


def test_equal_values_stay_linked(rows):
    _, _, got = rows
    address, card = got[None].text, got[0].pii[0].new
    assert got[9003].text == f"twice {address} and {address} {card} {card}"
    assert got[9004].text == "word " * 200_000 + address
    assert (got[9000].text, got[9001].text, got[9002].text) == (None, "", "no data")


def test_the_key_undoes_the_permutation(spark, rows):
    frame, docs, _ = rows
    keep = [d[0] for d in docs if d[0] is not None]
    once = pii.pseudonymize(frame.where(frame.doc_id.isin(keep)), "key one")
    back = {r.doc_id: r.text for r in pii.pseudonymize(once, "key one", back=True).collect()}
    assert back == {d[0]: d[1] for d in docs if d[0] in keep}
    other = {r.doc_id: r.text for r in pii.pseudonymize(frame, "key two").collect()}
    assert all(other[d[0]] != got.text for d in docs[:25] for got in [rows[2][d[0]]])


def test_different_values_stay_different(spark):
    frame = spark.range(2000).select("id", pii.F.format_string("10.0.%d.%d", pii.F.expr("cast(id div 250 as int)"), pii.F.expr("cast(id % 250 as int)")).alias("text"))
    assert pii.pseudonymize(frame, "k").select("text").distinct().count() == 2000


def test_dates_in_every_notation_are_permuted(spark):
    """All dates of two centuries, in all notations: images are dates in the same notation, all different, and lead back."""
    days = [date(1900, 1, 1) + timedelta(k) for k in range(73_049)]
    forms = ("%Y-%m-%d", "%d.%m.%Y", "%Y/%m/%d", "%m/%d/%Y", "%d/%m/%Y")
    texts = sorted({d.strftime(f) for d in days for f in forms})
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    once = pii.pseudonymize(frame, "a key").selectExpr("pii[0].found as found", "text").cache()
    images = {r.found: r.text for r in once.collect()}
    assert len(images) == len(texts) and sorted(images.values()) == texts
    first = lambda t: int(t[:2]) <= 12
    for a, b in images.items():
        assert [c for c in a if not c.isdigit()] == [c for c in b if not c.isdigit()] and (a[2] != "/" or first(a) == first(b))
    back = pii.pseudonymize(once.select("found", "text"), "a key", back=True)
    assert back.where("text <> found").count() == 0


def plain_feistel(key, kind, a, b, ma, mb):
    secret = "key:" + hashlib.sha256(key.encode()).hexdigest()
    for i in range(1, pii.ROUNDS + 1):
        digest = int(hashlib.sha256(f"{secret}:{kind}:{ma}:{mb}:{i}:{b if i % 2 else a}".encode()).hexdigest()[:15], 16)
        a, b = ((a + digest) % ma, b) if i % 2 else (a, (b + digest) % mb)
    return a, b


def test_against_plain_python(spark):
    ips = [f"{i % 256}.{i * 7 % 256}.{i * 13 % 256}.{i * 31 % 256}" for i in range(300)]
    days = [date(1900, 1, 1) + timedelta(k * 37) for k in range(1000)]
    cards = ["4111111111111111", "5500005555555559", "378282246310005"]
    want = {}
    for v in ips:
        o = [int(x) for x in v.split(".")]
        a, b = plain_feistel("k", "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        want[v] = f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    for d in days:
        n = (d - date(1900, 1, 1)).days
        a, b = plain_feistel("k", "date", n // 4297, n % 4297, 17, 4297)
        want[d.isoformat()] = (date(1900, 1, 1) + timedelta(a * 4297 + b)).isoformat()
    for v in cards:
        d = v[:-1]
        h = len(d) // 2
        a, b = plain_feistel("k", "card", int(d[:h]), int(d[h:]), 10**h, 10 ** (len(d) - h))
        p = f"{a:0{h}d}{b:0{len(d) - h}d}"
        want[v] = next(p + str(c) for c in range(10) if luhn(p + str(c)))
    frame = spark.createDataFrame([(v,) for v in want], "text string")
    assert {r.pii[0].found: r.text for r in pii.pseudonymize(frame, "k").collect()} == want


def test_clashing_names_stay_and_the_key_is_not_shown(spark):
    frame = spark.createDataFrame([("8.8.8.8", "a", 1, 2)], "text string, _new string, _found int, key int")
    out = pii.pseudonymize(frame, "very secret")
    row = out.first()
    assert (row["_new"], row["_found"], row["key"]) == ("a", 1, 2) and row.text != "8.8.8.8"
    shown = out._jdf.queryExecution().toString()
    assert "very secret" not in shown and hashlib.sha256(b"very secret").hexdigest() not in shown


def test_empty_table(spark):
    assert pii.pseudonymize(spark.createDataFrame([], "doc_id long, text string"), "k").collect() == []
