"""op6 against a statement of its pseudonyms in Python, value by value and in whole texts."""

import datetime
import hashlib
import hmac
import random
import re

from papertrace.llm import pii

KEY = "a key"


def feistel(values, radix, tweak, key=KEY):
    half, values = len(values) // 2, list(values)
    for r in range(1, 9):
        left = r % 2 == 1
        said = ",".join(map(str, values[half:] if left else values[:half]))
        for i in range(half) if left else range(half, len(values)):
            word = hmac.new(key.encode(), f"{tweak}|{r}|{i}|{said}".encode(), hashlib.sha256).hexdigest()[:8]
            values[i] = (values[i] + int(word, 16)) % radix[i]
    return values


def refill(shape, new):
    new = iter(new)
    return "".join(next(new) if c.isascii() and c.isalnum() else c for c in shape)


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10


def by_class(s, kind):
    some = [c for c in s if re.match("[A-Za-z0-9]", c)]
    base = [48 if c.isdigit() else 65 if c.isupper() else 97 for c in some]
    shape = re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", s)))
    new = feistel([ord(c) - b for c, b in zip(some, base)], [10 if b == 48 else 26 for b in base], kind + shape)
    it = iter(chr(v + b) for v, b in zip(new, base))
    return "".join(next(it) if re.match("[A-Za-z0-9]", c) else c for c in s)


def card(s):
    d = [int(c) for c in s if c.isdigit()]
    if luhn(d):
        return s
    n = feistel(d[:-1], [10] * (len(d) - 1), f"card{len(d)}")
    return refill(s, map(str, [*n, (10 - luhn([*n, 0])) % 10]))


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def iban(s):
    flat = s.replace(" ", "")
    if mod97(flat[4:] + flat[:4]) != 1:
        return s
    new = by_class(flat[4:], "iban")
    return refill(s, flat[:2] + f"{98 - mod97(new + flat[:2] + '00'):02d}" + new)


def ipv4(s):
    o = [int(x) for x in s.split(".")]
    return s if max(o) > 255 else ".".join(map(str, feistel(o, [256] * 4, "ipv4")))


def phone(s):
    code = re.match(r"(\+[0-9]{1,3}[ .-]?)?", s)[0]
    rest = s[len(code) :]
    d = [int(c) for c in rest if c.isdigit()]
    base = [2 if i in (0, 3) and x > 1 else 0 for i, x in enumerate(d)]
    radix = [10 if i not in (0, 3) else 8 if x > 1 else 2 for i, x in enumerate(d)]
    new = feistel([x - b for x, b in zip(d, base)], radix, "phone" + code + "".join(map(str, base)))
    return code + refill(rest, (str(v + b) for v, b in zip(new, base)))


def date(s):
    p, first = [int(x) for x in re.split("[-/.]", s)], bool(re.match("[0-9]{4}", s))
    swapped = not first and "/" in s and p[1] > 12 and p[0] <= 12
    y, m, d = p if first else (p[2], p[0], p[1]) if swapped else (p[2], p[1], p[0])
    try:
        day = datetime.date(y, m, d)
    except ValueError:
        return s
    epoch, near = datetime.date(1900, 1, 1), 1900 <= y <= 2099
    x = (day - epoch).days if near else day.toordinal() - 1 if y < 1900 else day.toordinal() - 1 - 73_049
    side, days = (271, 73_049) if near else (1892, 3_579_010)
    on = lambda x: epoch + datetime.timedelta(x) if near else datetime.date.fromordinal(1 + (x if x < 693_595 else x + 73_049))
    while True:
        a, b = feistel([x // side, x % side], [side] * 2, f"date,{str(near).lower()},{str(swapped).lower()}")
        x = a * side + b
        if x < days and (not swapped or on(x).day > 12):
            break
    n = on(x)
    y, m, d = f"{n.year:04d}", f"{n.month:02d}", f"{n.day:02d}"
    return f"{y}-{m}-{d}" if "-" in s else f"{y}/{m}/{d}" if first else f"{d}.{m}.{y}" if "." in s else f"{m}/{d}/{y}" if swapped else f"{d}/{m}/{y}"


def email(s):
    a, b = s.split("@", 1)
    return by_class(a, "email") + "@" + b


KINDS = {"email": email, "ipv4": ipv4, "date": date, "phone": phone, "card": card, "iban": iban}


def one(m):
    s = m[0]
    if "@" in s:
        return email(s)
    for k in ("ipv4", "date", "phone", "card", "iban"):
        if re.fullmatch(pii.PATTERNS[k], s):
            return KINDS[k](s)
    return s


def values():
    r = random.Random(9)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    out = ["1899-12-31", "1900-01-01", "2099-12-31", "2100-01-01", "0001-01-01", "9999-12-31", "0000-01-01", "1987-02-30", "12/25/1850", "25/12/2300", "31.12.1066", "a@b.co", "x.y@" + "a." * 20 + "museum", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "999.1.1.1"]
    for _ in range(40):
        n = digits(r.choice([13, 15, 16, 19]) - 1)
        n += str((10 - luhn([*map(int, n), 0])) % 10)
        out += [n, digits(16), f"{n[:4]} {n[4:8]} {n[8:12]} {n[12:16]}", ".".join(str(r.randrange(280)) for _ in range(4)), f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{''.join(r.choices('abcXYZ09._', k=7))}@mail{digits(1)}.example.com"]
        y, m, d = r.choice([r.randrange(1900, 2100), r.randrange(1, 9999)]), r.randrange(1, 14), r.randrange(1, 32)
        out += [f"{y:04d}-{m:02d}-{d:02d}", f"{m:02d}/{d:02d}/{y:04d}", f"{d:02d}/{m:02d}/{y:04d}", f"{d:02d}.{m:02d}.{y:04d}", f"{y:04d}/{m:02d}/{d:02d}"]
    return out


def test_every_value_and_whole_texts(spark):
    v = values()
    texts = [*v, " und ".join(v), "\n".join(f"({x})," for x in v), *(f"é{a} {b}ü" for a, b in zip(v, v[7:])), "1" * 3000 + " " + "a" * 20_000 + "@", "", None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, _key string").repartition(4)
    out = pii.pseudonymise(df, KEY, count="n")
    assert out.columns == [*df.columns, "n"] and KEY not in out._jdf.queryExecution().toString()
    got = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        want = None if t is None else re.sub(pii.ANY, one, t)
        assert got[i].text == want, t[:80]
        assert got[i].n == (0 if t is None else sum(one(m) != m[0] for m in re.finditer(pii.ANY, t)))
    assert got[len(v)].text.split(" und ") == [got[i].text for i in range(len(v))]
