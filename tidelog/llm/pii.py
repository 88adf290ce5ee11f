"""Format-preserving pseudonyms for personal data in texts, by keyed Feistel permutations.

Found and validated: payment card numbers (Luhn), IBANs (mod 97), US social security numbers (valid areas,
groups and serials), telephone numbers, IPv4 addresses (octets up to 255), calendar dates from 1900 to 2099,
e-mail addresses, and quoted secrets after a name such as token or password. What does not validate, such as
a sixteen-digit number with a wrong check digit, stays as it is.

Each value is mapped within its own format by a permutation that depends on a secret key: a card number to
another one with a right check digit, a date to another valid date in the same notation. With slashes the month
comes first if that gives a date; dates that can only have the day first are permuted among themselves, those of a
29th of February in leap years apart from the others, so that an image is read in the notation of its original.
Since it is a permutation, equal values stay equal and different values stay different, in all documents, and whoever holds
the key can undo it. Numbers are split into two parts a and b of fixed ranges (powers of ten, or the factors
of the format's range); in turn each part is shifted by a keyed digest of the other one, modulo its range.
E-mail addresses and secrets are split into two strings whose letters and digits are shifted in the same
way within a-z, A-Z and 0-9.

Everything here is DataFrame and SQL functions; a text is read once for the places, and only what was found
is permuted.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
TEXT_ROUNDS = 6
#: Days from 1900-01-01 to 2099-12-31 are 73049, which is 17 * 4297.
DAYS = (17, 4297)
#: Dates that only the order day, month, year gives: 221 days after the twelfth of their month in 200 years, and the
#: 29th of February in 49 leap years from 1904 on.
LATE, LEAP = (221, 200), (7, 7)
#: Days after the twelfth before each month of a common year.
LATE_BEFORE = [sum(d - 12 for d in (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30)[:m]) for m in range(12)]
#: Valid social security numbers: 898 areas, then 99 groups of 9999 serials.
SSN = (898, 99 * 9999)

EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
SECRET = r"(?<![A-Za-z0-9_])(?:[Aa][Pp][Ii][_\-]?[Kk][Ee][Yy]|[Aa]ccess_[Kk]ey|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])\s{0,3}[=:]\s{0,3}\"[^\"\s]{8,}+\""
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![\p{L}\p{N}])"
DATE = r"(?<![\d.\-/])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d\-/]|\.\d)"
IP = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"
SOCIAL = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
PHONE = r"(?<![\d+])\+\d{1,3}[ .\-]?\(?\d{2,4}\)?(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d.\-])\d{3}([.\-])\d{3}[.\-]\d{4}(?![\d\-])".replace(
    "([.\\-])", "[.\\-]"
)
CARD = r"(?<!\d)(?:\d{4}([ -])\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)".replace("([ -])", "[ -]")
PATTERN = "|".join((EMAIL, SECRET, IBAN, DATE, SOCIAL, PHONE, IP, CARD))

#: The kinds in the order in which a found text is tried for them.
_KIND = r"""
case when v like '%@%' then 'email'
     when v like '%"' then 'secret'
     when rlike(v, '^[A-Z]') then
       case when {mod97} = 1 then 'iban' end
     when rlike(v, '^(\\d{4}-\\d{2}-\\d{2}|\\d{4}/\\d{2}/\\d{2}|\\d{2}/\\d{2}/\\d{4}|\\d{2}\\.\\d{2}\\.\\d{4})$') then
       case when year({date}) between 1900 and 2099 then
         case when not rlike(v, '^../../') or try_to_date(v, 'MM/dd/yyyy') is not null then 'date' when v like '29/02/%' then 'leap' else 'late' end
       end
     when rlike(v, '^\\d{1,3}(\\.\\d{1,3}){3}$') then
       case when forall(split(v, '\\.'), o -> cast(o as int) <= 255) then 'ip' end
     when rlike(v, '^\\d{3}-\\d{2}-\\d{4}$') then
       case when not rlike(v, '^(000|666|9)|-00-|-0000$') then 'ssn' end
     when rlike(v, '^[+(]|^\\d{3}[.\\-]\\d{3}[.\\-]\\d{4}$') then
       case when length({digits}) between 8 and 15 then 'phone' end
     when luhn_check({digits}) and {digits} rlike '[1-9]' then 'card' end
"""
_DIGITS = "regexp_replace(v, '[^0-9]', '')"
#: The date that a notation stands for; with slashes the month comes first if that gives a date.
_DATE = """coalesce(try_to_date(v, 'yyyy-MM-dd'), try_to_date(v, 'yyyy/MM/dd'), try_to_date(v, 'MM/dd/yyyy'),
                    try_to_date(v, 'dd/MM/yyyy'), try_to_date(v, 'dd.MM.yyyy'))"""
_FORMAT = """case when v like '%-%' then 'yyyy-MM-dd' when v like '%.%' then 'dd.MM.yyyy'
                  when v like '____/%' then 'yyyy/MM/dd' when try_to_date(v, 'MM/dd/yyyy') is not null then 'MM/dd/yyyy'
                  else 'dd/MM/yyyy' end"""


def _mod97(value: str) -> str:
    """The remainder of letters and digits read as one number, letters as 10 to 35."""
    return f"""aggregate(split({value}, ''), 0L, (m, c) -> case when c = '' then m
               when c rlike '[0-9]' then (m * 10 + cast(c as bigint)) % 97
               else (m * 100 + ascii(c) - 55) % 97 end)"""


def _classified(found: str) -> str:
    kind = _KIND.replace("{mod97}", _mod97("concat(substring(v, 5), substring(v, 1, 4))")).replace("{date}", _DATE).replace("{digits}", _DIGITS)
    return f"transform({found}, v -> named_struct('v', v, 'kind', {kind}))"


def _split_up(items: str) -> str:
    """Adds the digits that may change (d), and the parts (a, b) with their ranges (ma, mb)."""
    digits = f"""case x.kind when 'card' then left({_d}, length({_d}) - 1)
                             when 'phone' then substring({_d}, case when x.v like '+1%' then 2 when x.v like '+%' then 3 else 1 end)
                             when 'iban' then regexp_replace(substring(x.v, 5), '[^0-9]', '') end"""
    step1 = f"transform({items}, x -> named_struct('v', x.v, 'kind', x.kind, 'd', {digits}))"
    days = f"datediff({_DATE.replace('(v,', '(x.v,')}, date'1900-01-01')"
    year, month, day = (f"cast(substring(x.v, {at}, {n}) as int)" for at, n in ((7, 4), (4, 2), (1, 2)))
    late = f"element_at(array({', '.join(map(str, LATE_BEFORE))}), {month}) + {day} - 13"
    octet = "cast(split(x.v, '\\\\.')[{}] as bigint)"
    area = "cast(left(x.v, 3) as bigint)"
    whole = "cast(power(10, {}) as bigint)"
    head, tail = "cast(length(x.d) div 2 as int)", "cast(length(x.d) - length(x.d) div 2 as int)"
    a = f"""case x.kind when 'date' then cast({days} as bigint) div {DAYS[1]}
                        when 'late' then cast({late} as bigint) when 'leap' then cast({year} - 1904 as bigint) div 4 div {LEAP[1]}
                        when 'ip' then {octet.format(0)} * 256 + {octet.format(1)}
                        when 'ssn' then {area} - case when {area} > 666 then 2 else 1 end
                        else try_cast(concat('0', left(x.d, {head})) as bigint) end"""
    b = f"""case x.kind when 'date' then cast({days} as bigint) % {DAYS[1]}
                        when 'late' then cast({year} - 1900 as bigint) when 'leap' then cast({year} - 1904 as bigint) div 4 % {LEAP[1]}
                        when 'ip' then {octet.format(2)} * 256 + {octet.format(3)}
                        when 'ssn' then (cast(substring(x.v, 5, 2) as bigint) - 1) * 9999 + cast(right(x.v, 4) as bigint) - 1
                        else try_cast(concat('0', right(x.d, {tail})) as bigint) end"""
    ma = f"case x.kind when 'date' then {DAYS[0]}L when 'late' then {LATE[0]}L when 'leap' then {LEAP[0]}L when 'ip' then 65536L when 'ssn' then {SSN[0]}L else {whole.format(head)} end"
    mb = f"case x.kind when 'date' then {DAYS[1]}L when 'late' then {LATE[1]}L when 'leap' then {LEAP[1]}L when 'ip' then 65536L when 'ssn' then {SSN[1]}L else {whole.format(tail)} end"
    return f"""transform({step1}, x -> named_struct('v', x.v, 'kind', x.kind, 'd', x.d, 'ma', {ma}, 'mb', {mb},
               'ab', case when x.kind not in ('email', 'secret') then named_struct('a', {a}, 'b', {b}) end))"""


_d = _DIGITS.replace("(v,", "(x.v,")


def _permuted(items: str, key: str, back: bool) -> str:
    """Runs the Feistel rounds over a and b; ``back`` runs them in reverse."""
    digest = "cast(conv(substring(sha2(concat_ws(':', {key}, x.kind, x.ma, x.mb, i, {half}), 256), 1, 15), 16, 10) as bigint)"
    sign = "-" if back else "+"
    rounds = f"reverse(sequence(1, {ROUNDS}))" if back else f"sequence(1, {ROUNDS})"
    left = f"pmod(s.a {sign} {digest.format(key=key, half='s.b')} % x.ma, x.ma)"
    right = f"pmod(s.b {sign} {digest.format(key=key, half='s.a')} % x.mb, x.mb)"
    step = f"if(i % 2 = 1, named_struct('a', {left}, 'b', s.b), named_struct('a', s.a, 'b', {right}))"
    return f"""transform({items}, x -> named_struct('v', x.v, 'kind', x.kind, 'd', x.d,
               'ab', if(x.ab.a is null or x.ab.b is null, null, aggregate({rounds}, x.ab, (s, i) -> {step}))))"""


def _shifted(text: str, by: str, key: str, back: bool) -> str:
    """Letters and digits of a string moved within their class by a keyed digest of another string."""
    sign = "-" if back else "+"
    far = f"cast(conv(substring(sha2(concat_ws(':', {key}, 'text', i, cast((j - 1) div 16 as int), {by}), 256), 1 + 4 * ((j - 1) % 16), 4), 16, 10) as int)"
    moved = " ".join(
        f"when c rlike '[{low}-{high}]' then char(ascii('{low}') + pmod(ascii(c) - ascii('{low}') {sign} {far}, {n}))"
        for low, high, n in (("a", "z", 26), ("A", "Z", 26), ("0", "9", 10))
    )
    return f"array_join(transform(filter(split({text}, ''), c -> c <> ''), (c, k) -> element_at(transform(array(k + 1), j -> case {moved} else c end), 1)), '')"


def _texts(value: str, key: str, back: bool) -> str:
    """The permuted form of an e-mail address or quoted secret, whose two parts are named by regular expressions."""
    rounds = f"reverse(sequence(1, {TEXT_ROUNDS}))" if back else f"sequence(1, {TEXT_ROUNDS})"
    inner = f"regexp_extract({value}, '\"(.*)\"$', 1)"
    a = f"if({value} like '%@%', substring_index({value}, '@', 1), left({inner}, cast(length({inner}) div 2 as int)))"
    b = f"if({value} like '%@%', substring_index({value}, '@', -1), substring({inner}, cast(length({inner}) div 2 as int) + 1))"
    step = f"if(i % 2 = 1, named_struct('a', {_shifted('s.a', 's.b', key, back)}, 'b', s.b), named_struct('a', s.a, 'b', {_shifted('s.b', 's.a', key, back)}))"
    return f"aggregate({rounds}, named_struct('a', {a}, 'b', {b}), (s, i) -> {step})"


def _rebuilt(items: str, key: str, back: bool) -> str:
    """The pseudonym in the format of the found text; the found text itself where nothing validated."""
    head = "cast(length(x.d) div 2 as int)"
    digits = f"concat(if({head} = 0, '', lpad(x.ab.a, {head}, '0')), lpad(x.ab.b, cast(length(x.d) - {head} as int), '0'))"
    first = f"""transform({items}, x -> named_struct('v', x.v, 'kind', x.kind, 'ab', x.ab,
        'st', if(x.kind in ('email', 'secret'), {_texts('x.v', key, back)}, null),
        'p', if(x.d is null or x.ab is null, null, {digits})))"""
    checked = """case y.kind when 'card' then concat(y.p, element_at(filter(transform(sequence(0, 9), z -> cast(z as string)),
                                                     z -> luhn_check(concat(y.p, z))), 1))
                             when 'phone' then concat(left(regexp_replace(y.v, '[^0-9]', ''), length(regexp_replace(y.v, '[^0-9]', '')) - length(y.p)), y.p)
                             else y.p end"""
    second = f"transform({first}, y -> named_struct('v', y.v, 'kind', y.kind, 'ab', y.ab, 'st', y.st, 'p', {checked}))"
    seen = "length(regexp_replace(left({v}, j), '[^0-9]', ''))"
    refill = "array_join(transform(sequence(1, length({v})), j -> if(substring({v}, j, 1) rlike '[0-9]', substring(w.p, {seen}, 1), substring({v}, j, 1))), '')"
    plain = refill.replace("{seen}", seen).replace("{v}", "w.v")
    account = refill.replace("{seen}", seen).replace("{v}", "substring(w.v, 5)")
    day = f"date_format(date_add(date'1900-01-01', cast(w.ab.a * {DAYS[1]} + w.ab.b as int)), {_FORMAT.replace(' v ', ' w.v ').replace('(v,', '(w.v,')})"
    month = f"size(filter(array({', '.join(map(str, LATE_BEFORE))}), t -> t <= w.ab.a))"
    late = f"concat(lpad(w.ab.a - element_at(array({', '.join(map(str, LATE_BEFORE))}), {month}) + 13, 2, '0'), '/', lpad({month}, 2, '0'), '/', w.ab.b + 1900)"
    area = "(w.ab.a + case when w.ab.a >= 665 then 2 else 1 end)"
    social = f"concat(lpad({area}, 3, '0'), '-', lpad(w.ab.b div 9999 + 1, 2, '0'), '-', lpad(w.ab.b % 9999 + 1, 4, '0'))"
    address = "concat_ws('.', w.ab.a div 256, w.ab.a % 256, w.ab.b div 256, w.ab.b % 256)"
    third = f"""transform({second}, w -> named_struct('v', w.v, 'kind', w.kind, 'r', case w.kind
        when 'email' then concat(w.st.a, '@', w.st.b)
        when 'secret' then concat(regexp_extract(w.v, '^([^\"]*\")', 1), w.st.a, w.st.b, '\"')
        when 'date' then {day} when 'late' then {late} when 'leap' then concat('29/02/', (w.ab.a * {LEAP[1]} + w.ab.b) * 4 + 1904)
        when 'ip' then {address} when 'ssn' then {social}
        when 'iban' then {account} when 'card' then {plain} when 'phone' then {plain} end))"""
    check = _mod97("concat(u.r, left(u.v, 2), '00')")
    return f"""transform({third}, u -> named_struct('kind', if(u.kind in ('late', 'leap'), 'date', u.kind), 'found', u.v, 'new', coalesce(
        if(u.kind = 'iban', concat(left(u.v, 2), lpad(98 - {check}, 2, '0'), u.r), u.r), u.v)))"""


def pseudonymize(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text", back: bool = False) -> DataFrame:
    """Returns all columns of ``docs`` with ``text`` pseudonymized, and ``pii``: what was found and replaced.

    ``pii`` is an array of (kind, found, new) in the order of the text, in place of any column of that name; all
    other columns stay, whatever their names. ``back`` undoes the permutation for the holder of the key. Null texts
    stay null and have an empty ``pii``; texts without personal data stay as they are, byte for byte. Repeated rows
    stay repeated. A very long text is read once, as a whole, by one task. An empty table gives an empty one.

    The key enters the plan as a digest that Spark's redaction keeps out of explained plans, unless the session
    has a redaction pattern of its own.
    """
    spark = docs.sparkSession
    if not spark.conf.get("spark.sql.redaction.string.regex", None):
        spark.conf.set("spark.sql.redaction.string.regex", "key:[0-9a-f]{64}")
    secret = f"'key:{hashlib.sha256(key.encode()).hexdigest()}'"
    kept = [c for c in docs.columns if c != "pii"]
    places, changed = "_found", "_new"
    while places in kept or changed in kept:
        places, changed = f"_{places}", f"_{changed}"
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0)).alias(places))
    some = F.size(places) > 0
    built = _rebuilt(_permuted(_split_up(_classified(places)), secret, back), secret, back)
    rows = rows.withColumn(changed, F.when(some, F.expr(built)))
    pieces = F.split(F.col(text), PATTERN, -1)
    joined = F.array_join(
        F.zip_with(pieces, F.transform(changed, lambda x: x["new"]), lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), ""
    )
    empty = F.array().cast("array<struct<kind:string,found:string,new:string>>")
    done = F.coalesce(F.filter(changed, lambda x: x["kind"].isNotNull()), empty)
    out = [F.when(some, joined).otherwise(F.col(text)).alias(c) if c == text else F.col(f"`{c}`") for c in kept]
    return rows.select(*out, done.alias("pii"))
