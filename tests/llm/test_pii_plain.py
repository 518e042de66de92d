"""Pseudonyms against a plain Python version: detection, validation and permutation."""

import hashlib
import random
import re
from datetime import date, timedelta

from rastertables.llm import pii

KEY = "k"
CODES1, CODES2 = {"1", "7"}, {*"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}


def permuted(values, radixes, kind):
    half, values = len(values) // 2, list(values)
    for r in range(8):
        left = r % 2 == 0
        other = ",".join(map(str, values[half:] if left else values[:half]))
        for i, n in enumerate(radixes):
            if (i < half) == left:
                noise = int(hashlib.sha256(f"{KEY}|{kind}|{r}|{i}|{other}".encode()).hexdigest()[:12], 16)
                values[i] = (values[i] + noise) % n
    return values


def refilled(text, digits):
    digits = iter(digits)
    return re.sub("[0-9]", lambda _: str(next(digits)), text)


def luhn(body):
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(body)))
    return -total % 10


def card(s):
    digits = [int(d) for d in s if d.isdigit()]
    new = permuted(digits[:-1], [10] * (len(digits) - 1), "number")
    return refilled(s, [*new, (luhn(new) + digits[-1] - luhn(digits[:-1])) % 10])


def moved(day):
    n = (day - date(1800, 1, 1)).days
    if not 0 <= n < 146097:
        return None
    high, low = permuted([n // 773, n % 773], [189, 773], "date")
    return date(1800, 1, 1) + timedelta(days=high * 773 + low)


def known_day(y, m, d):
    try:
        return moved(date(y, m, d))
    except ValueError:
        return None


def day_first(s):
    sign = "/" if "/" in s else "."
    a, b, year = s.split(sign)
    swapped = sign == "/" and int(b) > 12 and int(a) <= 12
    new = known_day(int(year), int(a) if swapped else int(b), int(b) if swapped else int(a))
    if new is None:
        return s
    wide = a[0] == "0" or b[0] == "0" and len(b) == 2
    d, m = (f"{x:02d}" if wide else str(x) for x in (new.day, new.month))
    return sign.join([m if swapped else d, d if swapped else m, f"{new.year:04d}"])


def phone(s):
    code = ""
    if s[0] == "+":
        digits = re.sub("[^0-9]", "", s)
        n = 1 if digits[0] in CODES1 else 2 if digits[:2] in CODES2 else 3
        code = re.match(r"\+(?:[ .-]?[0-9]){%d}" % n, s)[0]
    body = s[len(code) :]
    digits = [int(d) for d in body if d.isdigit()]
    return code + refilled(body, permuted(digits, [10] * len(digits), "number"))


def email(s):
    local, _, domain = s.partition("@")
    kinds = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    sets = [next((k for k in kinds if c in k), c) for c in local]
    new = permuted([k.index(c) for c, k in zip(local, sets, strict=True)], [len(k) for k in sets], "email" + domain.lower())
    return "".join(k[i] for k, i in zip(sets, new, strict=True)) + "@" + domain


def pseudonym(s):
    if "@" in s:
        return email(s)
    if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", s) and all(len(p) <= 3 for p in s.split(".")):
        parts = [int(p) for p in s.split(".")]
        return ".".join(map(str, permuted(parts, [256] * 4, "ipv4"))) if max(parts) < 256 else s
    if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", s):
        new = known_day(*map(int, s.split("-"))) if s[:4] != "0000" else None
        return s if new is None else new.isoformat()
    if re.fullmatch(r"[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4}", s):
        return day_first(s)
    if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", s):
        area, group, serial = map(int, s.split("-"))
        if not 0 < area < 900 or area == 666 or not group or not serial:
            return s
        a, g, n = permuted([area - (2 if area > 666 else 1), group - 1, serial - 1], [898, 99, 9999], "ssn")
        return f"{a + (2 if a + 1 >= 666 else 1):03d}-{g + 1:02d}-{n + 1:04d}"
    if re.fullmatch(r"[0-9](?:[ -]?[0-9]){12,18}", s):
        return card(s)
    return phone(s)


def plain(text):
    if text is None:
        return None, 0
    found = []

    def replaced(m):
        found.append((m[0], pseudonym(m[0])))
        return found[-1][1]

    return re.sub(pii.ANY, replaced, text), sum(a != b for a, b in found)


def values(rng):
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    day = date(1800, 1, 1) + timedelta(days=rng.randrange(146097))
    return [
        f"{day}", day.strftime("%d.%m.%Y"), f"{day.day}.{day.month}.{day.year}", f"{day.month}/{day.day}/{day.year}", f"{day.day:02d}/{day.month:02d}/{day.year}", "2023-02-29", "1700-01-01", "31.06.2020", "13/13/2020",
        d(16), f"{d(4)} {d(4)} {d(4)} {d(4)}", d(13), d(19), d(12), d(20), f"{d(3)}-{d(2)}-{d(4)}", "000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567", "665-01-0001", "667-99-9999",
        ".".join(str(rng.randrange(300)) for _ in range(4)), "1.2.3", "1.2.3.4.5", f"+49 {d(3)} {d(7)[:4]} {d(3)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"({d(3)}) {d(3)} {d(4)}", f"+353 {d(2)} {d(3)} {d(4)}",
        f"+44{d(2)} {d(4)} {d(4)}", f"0{rng.randrange(1, 10)} {d(2)} {d(2)} {d(2)} {d(2)}", f"Ab{d(2)}.x-y@mail{d(1)}.Example.org", "a@b.co", "@nobody", "x@y", "a1@b", f"v{d(14)}", f"{d(4)}-{d(4)}",
    ]


def test_texts_against_plain_python(spark):
    rng = random.Random(6)
    texts = [None, "", "none at all", "@", "12"]
    for _ in range(25):
        some = values(rng)
        rng.shuffle(some)
        texts.append("".join(v + rng.choice([" ", ", ", " and ", ".\n", "; ", " é ", "(", ") "]) for v in some))
        texts += [f"see {v}." for v in some]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_found) for r in pii.pseudonymised(df, key=KEY).collect()}
    wrong = [(t, got[i], plain(t)) for i, t in enumerate(texts) if got[i] != plain(t)]
    assert not wrong, wrong[:3]
    assert sum(n for _, n in got.values()) > 500
