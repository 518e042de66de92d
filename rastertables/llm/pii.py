"""PII: format-preserving Feistel pseudonyms.

Numbers and dates that identify people are found by pattern and validated, and
each is replaced by a keyed permutation of its own format: a value always gets
the same pseudonym, different values get different ones, and a valid value stays
valid.  The permutation is one Feistel network over a list of digits of mixed
radix; each format says how a value becomes such a list and back:

- card and account numbers (13 to 19 digits): all digits but the last; the last
  keeps its distance to the Luhn digit, so valid numbers stay valid and others
  stay invalid;
- dates (1800 to 2199; 1985-03-12, 12.03.1985, 12.3.1985, 12/03/1985, 03/25/1985):
  the day's number in the 400-year cycle, 146097 days = 189 x 773, written back in
  the same way, so that one day has one pseudonym in all of them;
- IPv4 addresses: four digits of radix 256;
- social security numbers: area (001-899 without 666), group 01-99, serial
  0001-9999;
- telephone numbers: the digits after the country code, separators kept; the code is
  told by its first digits, however the number is spaced;
- email addresses: letters and digits of the local part, each in its class, by a
  permutation of their domain's own.

The key comes from the caller or from the session's ``rastertables.pii.key``;
without either, each call draws a new one, whose pseudonyms no one can invert.

Everything is SQL functions within a row; texts without a digit or @ skip it.

Defined cases: null text stays null and has no findings; values that fail their
validation (a date that is not one, an octet above 255) stay as they are;
repeated rows give a row each; other columns are kept, and a column of the name
of the count is an error; no rows give no rows.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_SETTING = "rastertables.pii.key"
ROUNDS = 8
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"
DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
DAY_FIRST = r"(?<![0-9.])[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?!\.?[0-9])|(?<![0-9/])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![0-9/])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9A-Za-z])|(?<![0-9A-Za-z])0[1-9](?:[ .][0-9]{2}){4}(?![0-9A-Za-z])"
CARD = r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, IPV4, DATE, DAY_FIRST, SSN, CARD, PHONE))
#: Fixed values of the international numbering plan: country codes of one and two digits; all
#: others have three.  Separators may stand between the digits.
CODES = r"[17]|2[ .-]?[07]|3[ .-]?[0-469]|4[ .-]?[013-9]|5[ .-]?[1-8]|6[ .-]?[0-6]|8[ .-]?[1246]|9[ .-]?[0-58]"
CODE = rf"^\+(?:{CODES}|[0-9](?:[ .-]?[0-9]){{2}})"
#: First day of the 400-year cycle that dates are permuted in.
FIRST_DAY = "1800-01-01"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def feistel(values: Column, radixes: Column, key: str, kind: str | Column) -> Column:
    """A keyed permutation of ``values`` (array<int>), digit i staying below
    ``radixes[i]``: each round adds to one half a keyed hash of the other."""
    half = F.floor(F.size(values) / 2).cast("int")
    kind = F.lit(kind) if isinstance(kind, str) else kind

    def turn(digits: Column, r: Column) -> Column:
        left = (r % 2) == 0
        other = F.array_join(F.when(left, F.slice(digits, half + 1, F.size(digits))).otherwise(F.slice(digits, 1, half)).cast("array<string>"), ",")
        noise = lambda i: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), kind, r.cast("string"), i.cast("string"), other).cast("binary"), 256), 1, 12), 16, 10).cast("long")
        return F.transform(digits, lambda x, i: F.when((i < half) == left, F.pmod(x + noise(i), F.element_at(radixes, i + 1))).otherwise(x).cast("int"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, turn)


def _digits(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("[0-9]"), F.lit(0)).cast("array<int>")


def _refill(template: Column, digits: Column) -> Column:
    """``template`` with its digits replaced by ``digits`` in order."""
    gaps = F.split(template, "[0-9]", -1)
    return F.array_join(F.zip_with(gaps, digits.cast("array<string>"), lambda g, d: F.concat(g, F.coalesce(d, F.lit("")))), "")


def _ten(digits: Column) -> Column:
    return F.transform(digits, lambda _: F.lit(10))


def _luhn(body: Column) -> Column:
    """The check digit that follows ``body``."""
    n = F.size(body)
    each = F.transform(body, lambda d, i: F.when((n - i) % 2 == 1, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.pmod(F.lit(10) - F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10, F.lit(10))


def _card(s: Column, key: str) -> Column:
    def made(digits: Column) -> Column:
        body = F.slice(digits, 1, F.size(digits) - 1)
        gap = F.element_at(digits, -1) - _luhn(body)
        return F.transform(F.array(feistel(body, _ten(body), key, "number")), lambda new: F.concat(new, F.array(F.pmod(_luhn(new) + gap, F.lit(10)))))[0]

    return _refill(s, F.transform(F.array(_digits(s)), made)[0])


def _moved_day(day: Column, key: str) -> Column:
    """The pseudonym of a date, null outside the cycle."""
    first = F.lit(FIRST_DAY).cast("date")
    number = F.datediff(day, first)
    new = feistel(F.array((number / 773).cast("int"), number % 773), F.array(F.lit(189), F.lit(773)), key, "date")
    return F.when(number.between(0, 146096), F.transform(F.array(new), lambda d: F.date_add(first, d[0] * 773 + d[1]))[0])


def _date(s: Column, key: str) -> Column:
    new = _moved_day(F.try_to_timestamp(s, F.lit("yyyy-MM-dd")).cast("date"), key)
    return F.coalesce(F.date_format(new, "yyyy-MM-dd"), s)


def _day_first(s: Column, key: str) -> Column:
    """Day, month and year, or month, day and year where no month is second."""
    parts = F.split(s, "[./]").cast("array<int>")
    swapped = (parts[1] > 12) & (parts[0] <= 12) & F.contains(s, F.lit("/"))
    day, month = F.when(swapped, parts[1]).otherwise(parts[0]), F.when(swapped, parts[0]).otherwise(parts[1])
    text = F.format_string("%04d-%02d-%02d", parts[2], month, day)
    # A leading zero, or none, is kept.
    sign, wide = F.when(F.contains(s, F.lit("/")), "/").otherwise("."), s.rlike("^0|[./]0[0-9][./]")

    def written(new: Column) -> Column:
        number = lambda x: F.when(wide, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
        d, m = number(F.day(new)), number(F.month(new))
        return F.concat(F.when(swapped, m).otherwise(d), sign, F.when(swapped, d).otherwise(m), sign, F.lpad(F.year(new).cast("string"), 4, "0"))

    new = _moved_day(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"), key)
    return F.coalesce(F.transform(F.array(new), lambda n: F.when(n.isNotNull(), written(n)))[0], s)


def _ipv4(s: Column, key: str) -> Column:
    parts = F.split(s, "\\.").cast("array<int>")
    new = F.array_join(feistel(parts, F.transform(parts, lambda _: F.lit(256)), key, "ipv4").cast("array<string>"), ".")
    return F.when(F.forall(parts, lambda p: p < 256), new).otherwise(s)


def _ssn(s: Column, key: str) -> Column:
    parts = F.split(s, "-").cast("array<int>")
    area, group, serial = (parts[i] for i in range(3))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    values = F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1)
    new = feistel(values, F.array(F.lit(898), F.lit(99), F.lit(9999)), key, "ssn")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    out = F.transform(F.array(new), lambda d: F.concat_ws("-", pad(d[0] + F.when(d[0] + 1 >= 666, 2).otherwise(1), 3), pad(d[1] + 1, 2), pad(d[2] + 1, 4)))[0]
    return F.when(valid, out).otherwise(s)


def _phone(s: Column, key: str) -> Column:
    code = F.regexp_extract(s, CODE, 0)
    body = F.substr(s, F.length(code) + 1)
    digits = _digits(body)
    return F.concat(code, _refill(body, feistel(digits, _ten(digits), key, "number")))


def _email(s: Column, key: str) -> Column:
    local, domain = F.substring_index(s, "@", 1), F.substring_index(s, "@", -1)
    letters = F.split(local, "")
    alphabets = [("0123456789", 10), (LOWER, 26), (UPPER, 26)]

    def number(c: Column) -> Column:
        out = F.lit(0)
        for abc, _ in alphabets:
            out = F.when(F.position(c, F.lit(abc)) > 0, F.position(c, F.lit(abc)) - 1).otherwise(out)
        return out

    def radix(c: Column) -> Column:
        out = F.lit(1)
        for abc, n in alphabets:
            out = F.when(F.position(c, F.lit(abc)) > 0, F.lit(n)).otherwise(out)
        return out

    new = feistel(F.transform(letters, number), F.transform(letters, radix), key, F.concat(F.lit("email"), F.lower(domain)))

    def back(c: Column, x: Column) -> Column:
        out = c
        for abc, _ in alphabets:
            out = F.when(F.position(c, F.lit(abc)) > 0, F.substr(F.lit(abc), x + 1, F.lit(1))).otherwise(out)
        return out

    return F.concat(F.array_join(F.zip_with(letters, new, back), ""), F.lit("@"), domain)


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(16)


def pseudonym(s: Column, key: str) -> Column:
    """The pseudonym of one found value; the value itself if it is not valid."""
    whole = lambda p: s.rlike(f"^(?:{p})$")
    return (
        F.when(F.contains(s, F.lit("@")), _email(s, key)).when(whole(IPV4), _ipv4(s, key)).when(whole(DATE), _date(s, key))
        .when(whole(DAY_FIRST), _day_first(s, key)).when(whole(SSN), _ssn(s, key)).when(whole(CARD), _card(s, key)).otherwise(_phone(s, key))
    )


def pseudonymised(docs: DataFrame, text: str = "text", key: str | None = None, found: str = "n_found") -> DataFrame:
    """``docs`` with ``text`` pseudonymised and the number of values replaced."""
    if found in docs.columns:
        raise ValueError(f"a column {found} exists: name the count otherwise")
    names = docs.columns
    docs = docs.select(*[F.col(f"`{c}`").alias("text" if c == text else f"column{i}") for i, c in enumerate(names)])
    key = key or session_key(docs.sparkSession)
    hit = F.col("text").rlike("[0-9]|@")
    steps = docs.withColumn("found", F.when(hit, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))))
    steps = steps.withColumn("gaps", F.when(F.size("found") > 0, F.split("text", ANY, -1)))
    steps = steps.withColumn("new", F.when(F.size("found") > 0, F.transform("found", lambda s: pseudonym(s, key))))
    woven = F.array_join(F.zip_with("gaps", "new", lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")
    count = F.coalesce(F.size(F.filter(F.arrays_zip("found", "new"), lambda x: x["found"] != x["new"])), F.lit(0)).cast("long")
    out = {c: F.when(F.col("new").isNotNull(), woven).otherwise(F.col("text")) if c == text else F.col(f"column{i}") for i, c in enumerate(names)}
    return steps.select(*[v.alias(c) for c, v in out.items()], count.alias(found))
