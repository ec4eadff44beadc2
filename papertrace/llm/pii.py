"""Format-preserving pseudonyms for personal numbers, dates and addresses, by keyed Feistel permutations.

A value found and validated (card: Luhn; account: mod 97; IPv4: octets; date: calendar) becomes a list of
symbols with radices; an alternating Feistel network over the two halves of that list, whose round function is
HMAC-SHA-256, permutes all lists of the same format. So a pseudonym has its value's format and passes the same
validation, different values never meet, and equal values stay equal in all documents under one key. Everything is JVM
expressions: regular expressions and higher-order functions, evaluated only for texts that hold a candidate.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind as _bind
from .common import unused

ROUNDS = 8
#: kind -> pattern; the first that matches at a place counts. Linear in the text: no nested unbounded repeats.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])(?!\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: All kinds but addresses with an @ begin with one of a few characters, so that most places need no more than one look.
ANY = PATTERNS["email"] + "|(?=[0-9(+A-Z])(?:" + "|".join(p for k, p in PATTERNS.items() if k != "email") + ")"
#: What every candidate holds; most texts hold none of it.
_SOME = "[0-9@]"
#: Days from 1900 to 2099, permuted among themselves, and those of all other years from 1 to 9999; each number of days
#: is just below a square, of this side.
_EPOCH, _DAYS, _SIDE = "1900-01-01", 73_049, 271
_FIRST, _BEFORE, _OTHERS, _OTHER_SIDE = "0001-01-01", 693_595, 3_579_010, 1_892
#: Steps of a walk among dates; each ends it with a chance of over one half.
_STEPS = 128


def pads(key: str) -> tuple[bytes, bytes]:
    """HMAC's inner and outer key blocks."""
    k = key.encode()
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    return bytes(x ^ 0x36 for x in k), bytes(x ^ 0x5C for x in k)


def secret(spark: SparkSession, key: str, name: str) -> DataFrame:
    """A row with the key's pads in a column: data, so that neither plans nor logs show them."""
    return spark.createDataFrame([(pads(key),)], f"`{name}` struct<inner:binary,outer:binary>")


def _word(key: Column, *parts: Column) -> Column:
    """A 32-bit number: the first of HMAC-SHA-256."""
    inner = F.unhex(F.sha2(F.concat(key["inner"], F.concat_ws("|", *parts).cast("binary")), 256))
    return F.conv(F.substring(F.sha2(F.concat(key["outer"], inner), 256), 1, 8), 16, 10).cast("long")


def feistel(values: Column, radix: Column, key: Column, tweak: Column) -> Column:
    """array<bigint> values, each below its radix, permuted among all such lists. The halves take turns: each
    symbol of one is shifted by a keyed hash of the other, modulo its radix; with the radices fixed this can
    be undone, round by round."""

    def turn(b: Column, acc: Column, r: Column) -> Column:
        left = r % 2 == 1
        other = F.when(left, F.slice(acc, b["half"] + 1, F.size(acc))).otherwise(F.slice(acc, F.lit(1), b["half"]))
        active = lambda i: F.when(left, i < b["half"]).otherwise(i >= b["half"])
        shifted = lambda said: F.transform(acc, lambda v, i: F.when(active(i), (v + _word(key, b["tweak"], r.cast("string"), i.cast("string"), said)) % F.get(b["radix"], i)).otherwise(v))
        return _bind(F.array_join(other.cast("array<string>"), ","), shifted)

    once = F.struct(values.cast("array<bigint>").alias("values"), radix.alias("radix"), tweak.alias("tweak"), F.floor(F.size(values) / 2).cast("int").alias("half"))
    return _bind(once, lambda b: F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), b["values"], lambda acc, r: turn(b, acc, r)))


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _digits(s: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(s, "[^0-9]", "")), lambda c: c.cast("bigint"))


def _refill(shape: Column, new: Column, pattern: str) -> Column:
    """shape with its characters that match `pattern` replaced by those of array `new`, in order."""
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("k"))
    put = lambda n: F.aggregate(_chars(shape), start, lambda a, c: F.when(c.rlike(pattern), F.struct(F.concat(a["s"], F.get(n, a["k"])).alias("s"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k"))))
    return _bind(new, put)["s"]


def _by_class(s: Column, key: Column, kind: str) -> Column:
    """Letters and digits of s permuted, each within its class."""
    base = lambda c: F.when(c.rlike("[0-9]"), 48).when(c.rlike("[A-Z]"), 65).otherwise(97)
    some = F.filter(_chars(s), lambda c: c.rlike("[A-Za-z0-9]"))
    radix = F.transform(some, lambda c: F.when(c.rlike("[0-9]"), 10).otherwise(26))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[0-9]", "0"), "[A-Z]", "A"), "[a-z]", "a")
    new = feistel(F.transform(some, lambda c: (F.ascii(c) - base(c)).cast("bigint")), radix, key, F.concat(F.lit(kind), shape))
    return _refill(s, F.zip_with(new, some, lambda v, c: F.char(v + base(c))), "[A-Za-z0-9]")


def _luhn(digits: Column) -> Column:
    """The sum that Luhn's rule takes modulo 10; the last digit is the check digit."""
    weighed = F.transform(F.reverse(digits), lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(weighed, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _card(s: Column, key: Column) -> Column:
    def permuted(digits: Column) -> Column:
        body = F.slice(digits, F.lit(1), F.size(digits) - 1)
        new = feistel(body, F.transform(body, lambda _: F.lit(10)), key, F.concat(F.lit("card"), F.size(digits).cast("string")))
        check = lambda n: (10 - _luhn(F.concat(n, F.array(F.lit(0).cast("bigint")))) % 10) % 10
        put = _refill(s, _bind(new, lambda n: F.concat(n, F.array(check(n)))).cast("array<string>"), "[0-9]")
        return F.when(_luhn(digits) % 10 == 0, put)

    return _bind(_digits(s), permuted)


def _mod97(s: Column) -> Column:
    """The number that stands for an account's characters, modulo 97."""
    one = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + (F.ascii(c) - 48)) % 97).otherwise((a * 100 + (F.ascii(c) - 55)) % 97)
    return F.aggregate(_chars(s), F.lit(0).cast("bigint"), lambda a, c: one(a, c).cast("bigint"))


def _iban(s: Column, key: Column) -> Column:
    flat = F.replace(s, F.lit(" "), F.lit(""))
    country, body = F.substring(flat, 1, 2), F.substring(flat, 5, 64)
    check = lambda new: F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    put = _refill(s, _chars(_bind(_by_class(body, key, "iban"), lambda new: F.concat(country, check(new), new))), "[A-Z0-9]")
    return F.when(_mod97(F.concat(body, country, F.substring(flat, 3, 2))) == 1, put)


def _ipv4(s: Column, key: Column) -> Column:
    octets = F.transform(F.split(s, r"\."), lambda o: o.cast("bigint"))
    new = feistel(octets, F.transform(octets, lambda _: F.lit(256)), key, F.lit("ipv4"))
    return F.when(F.forall(octets, lambda o: o < 256), F.array_join(new.cast("array<string>"), "."))


def _phone(s: Column, key: Column) -> Column:
    """The ten digits of the national number; the first of the area and of the exchange stay among 2 to 9, or
    0 and 1. The country code stays."""
    code = F.regexp_extract(s, r"^(\+[0-9]{1,3}[ .-]?)", 1)
    rest = F.substring(s, F.length(code) + 1, F.lit(64))
    digits = _digits(rest)
    lead = lambda i: (i == 0) | (i == 3)
    base = F.transform(digits, lambda d, i: F.when(lead(i) & (d > 1), 2).otherwise(0))
    radix = F.transform(digits, lambda d, i: F.when(lead(i), F.when(d > 1, 8).otherwise(2)).otherwise(10))
    tweak = F.concat(F.lit("phone"), code, F.array_join(base.cast("array<string>"), ""))
    new = feistel(F.zip_with(digits, base, lambda d, b: d - b), radix, key, tweak)
    return F.concat(code, _refill(rest, F.zip_with(new, base, lambda d, b: d + b).cast("array<string>"), "[0-9]"))


def _date(s: Column, key: Column) -> Column:
    """A day, in its own format: of 1900 to 2099 among those, of other years among the others. Slashes with the year
    last: day first, or where that is no date, month first; such dates are permuted among themselves."""
    p = F.transform(F.split(s, "[-/.]"), lambda x: x.cast("int"))
    a, b, c = F.get(p, 0), F.get(p, 1), F.get(p, 2)
    year_first = F.get(F.split(s, "[-/.]"), 0).rlike("^[0-9]{4}$")
    swapped = ~year_first & s.contains("/") & (b > 12) & (a <= 12)
    y, m, d = F.when(year_first, a).otherwise(c), F.when(swapped, a).otherwise(b), F.when(year_first, c).when(swapped, b).otherwise(a)
    first = F.when((y >= 1) & (m >= 1) & (m <= 12), F.make_date(y, m, F.lit(1)))
    real = F.coalesce((d >= 1) & (d <= F.dayofmonth(F.last_day(first))), F.lit(False))
    epoch, origin = F.to_date(F.lit(_EPOCH)), F.to_date(F.lit(_FIRST))
    near = (y >= 1900) & (y <= 2099)
    day = F.date_add(first, d - 1)
    far = F.datediff(day, origin)
    x = F.when(near, F.datediff(day, epoch)).otherwise(F.when(far < _BEFORE, far).otherwise(far - _DAYS)).cast("bigint")
    kind = F.struct(x.alias("x"), near.alias("near"), swapped.alias("swapped"), F.when(near, F.lit(_SIDE)).otherwise(F.lit(_OTHER_SIDE)).alias("side"), F.when(near, F.lit(_DAYS)).otherwise(F.lit(_OTHERS)).alias("days"))

    def on(k: Column, x: Column) -> Column:
        return F.when(k["near"], F.date_add(epoch, x.cast("int"))).otherwise(F.date_add(origin, F.when(x < _BEFORE, x).otherwise(x + _DAYS).cast("int")))

    def walk(k: Column) -> Column:
        # along the cycle of a permutation of side x side numbers until it comes by a day of the same class again
        mix = lambda x: feistel(F.array(F.floor(x / k["side"]), x % k["side"]), F.array(k["side"], k["side"]), key, F.concat_ws(",", F.lit("date"), k["near"].cast("string"), k["swapped"].cast("string")))
        inside = lambda x: (x < k["days"]) & (~k["swapped"] | (F.dayofmonth(on(k, F.least(x, k["days"] - 1))) > 12))

        def step(acc: Column, _: Column) -> Column:
            new = _bind(mix(acc["x"]), lambda v: F.get(v, 0) * k["side"] + F.get(v, 1))
            return F.when(acc["done"], acc).otherwise(_bind(new, lambda x: F.struct(x.cast("bigint").alias("x"), inside(x).alias("done"))))

        at = F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), F.struct(k["x"].alias("x"), F.lit(False).alias("done")), step)
        return _bind(at, lambda a: F.when(a["done"], on(k, a["x"])).otherwise(F.raise_error(F.lit("a date's walk is too long")).cast("date")))

    put = lambda new: F.when(s.contains("-"), F.date_format(new, "yyyy-MM-dd")).when(year_first, F.date_format(new, "yyyy/MM/dd")).when(s.contains("."), F.date_format(new, "dd.MM.yyyy")).when(swapped, F.date_format(new, "MM/dd/yyyy")).otherwise(F.date_format(new, "dd/MM/yyyy"))
    return F.when(real, _bind(_bind(kind, walk), put))


def pseudonym(s: Column, key: Column) -> Column:
    """The pseudonym of one candidate; what is not valid stays as it is."""
    whole = {k: f"^(?:{p})$" for k, p in PATTERNS.items()}
    at = F.instr(s, "@")
    made = (
        F.when(at > 0, F.concat(_by_class(F.substring(s, F.lit(1), at - 1), key, "email"), F.substring(s, at, F.lit(1024))))
        .when(s.rlike(whole["ipv4"]), _ipv4(s, key))
        .when(s.rlike(whole["date"]), _date(s, key))
        .when(s.rlike(whole["phone"]), _phone(s, key))
        .when(s.rlike(whole["card"]), _card(s, key))
        .when(s.rlike(whole["iban"]), _iban(s, key))
    )
    return F.coalesce(made, s)


def pseudonymise(df: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """df with every valid personal value in whole texts replaced by its pseudonym under `key`; `count` names
    a column for the number of values replaced.

    A null text stays null, with none replaced; texts without candidates, and empty ones, stay as they are; a text of
    any length is searched whole. Rows are independent, equal texts stay equal, other columns pass (one named as
    `count` is replaced); an empty table stays empty. JVM only; the key comes as a one-row table."""
    t, (pairs, own) = F.col(text), unused(df, "_pairs", "_key")
    df = df.join(F.broadcast(secret(df.sparkSession, key, own)))  # one row
    found = F.regexp_extract_all(t, F.lit(ANY), F.lit(0))
    made = F.transform(found, lambda s: F.struct(s.alias("old"), pseudonym(s, F.col(own)).alias("new")))
    df = df.withColumn(pairs, F.when(t.rlike(_SOME), made)).drop(own)
    joined = F.array_join(F.zip_with(F.split(t, ANY, -1), F.transform(pairs, lambda p: p["new"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    if count:
        df = df.withColumn(count, F.coalesce(F.size(F.filter(pairs, lambda p: p["old"] != p["new"])), F.lit(0)).cast("long"))
    return df.withColumn(text, F.when(F.col(pairs).isNotNull(), joined).otherwise(t)).drop(pairs)
