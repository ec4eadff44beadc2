"""Normal forms of extracted text and of printed values, as Column functions.

Only unicode_fold() runs in Python (Spark has no Unicode normalisation), in Arrow batches; all else is Catalyst
expressions. Regular expressions carry (?U) where the rules are Unicode-aware.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What grading by these rules means; patterns and character lists must be exactly these.
_SPACE = r"(?U)[\s\x1c-\x1f]+"
_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
BATCH_ROWS, BATCH_BYTES = 1000, 64 << 20
#: A figure that parentheses wrap wholly: the accountant's minus sign.
NEGATIVE = r"(?U)\A\(\s*\$?\s*([\d,. ]*\d[\d,. ]*)\s*\)\z"
#: What counts as numeric for regrouped digits and for the family of look-alikes.
NUMERIC = r"(?U)^-?[\d ,]+(?:\.\d+)?$"
#: A run of digit groups that is one figure: no digit or decimal part follows it.
RUN = r"(?U)\b\d{1,3}(?: \d{3})+(?![.,]?\d)"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


@F.arrow_udf(StringType())
def unicode_fold(a: pa.Array) -> pa.Array:
    """Entities resolved, compatibility forms folded, combining marks dropped."""

    def one(s: str | None) -> str | None:
        if s is None or (s.isascii() and "&" not in s):
            return s
        s = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", html.unescape(s)))
        return "".join(ch for ch in s if not unicodedata.combining(ch))

    # few texts at a time are Python's; the rest lie in Arrow's memory
    return pa.concat_arrays([pa.array([one(x.as_py()) for x in a[i : i + 64]], pa.string()) for i in range(0, max(len(a), 1), 64)])


def bounded(spark: SparkSession) -> SparkSession:
    """Let no Python worker be handed more than BATCH_ROWS rows or BATCH_BYTES at once: texts may be long."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}", None)
        if not now or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return spark


def strip(col: str | Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(_c(col), _EDGES, "")


def bind(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c evaluated once, however often f uses it."""
    return F.get(F.transform(F.array(c), f), 0)


def join_thousands(col: str | Column) -> Column:
    """"132 434 809" as one number: one to three digits and any number of groups of exactly three, one space
    apart, unless digits or a decimal part follow. Runs are taken out, joined, and put back between the rest."""

    def joined(t: Column) -> Column:
        runs = F.transform(F.regexp_extract_all(t, F.lit(RUN), F.lit(0)), lambda r: F.replace(r, F.lit(" "), F.lit("")))
        return F.array_join(F.zip_with(F.split(t, RUN, -1), runs, lambda a, r: F.concat(a, F.coalesce(r, F.lit("")))), "")

    return bind(_c(col), lambda t: F.when(t.rlike(RUN), joined(t)).otherwise(t))


def fold_layout(col: str | Column) -> Column:
    """What follows unicode_fold(): typographic characters, Markdown escapes, tags, digit groups, table marks."""
    c = F.translate(_c(col), "\u2018\u2019\u201c\u201d\u2013\u2014\u2212\u00a0\u2022\u00b7", "''\"\"---   ")
    c = F.regexp_replace(c, r"\\([!-/:-@\[-`{-~])", "$1")
    c = join_thousands(F.regexp_replace(c, "<[^>]+>", " "))
    return F.replace(F.translate(c, "|*", "  "), F.lit("#"), F.lit(" # "))


def fold(col: str | Column) -> Column:
    """Text without the marks of whoever wrote it down."""
    c = _c(col)
    # plain text is left out of what Python is handed
    return fold_layout(F.coalesce(unicode_fold(F.when(c.rlike("[^\\x00-\\x7f]|&"), c)), c))


def lines(folded: str | Column) -> Column:
    """The lines of folded text: white space collapsed, blank ones left out."""
    each = F.transform(F.split(_c(folded), _BREAKS), lambda x: F.btrim(F.regexp_replace(x, _SPACE, " ")))
    return F.filter(each, lambda x: x != "")


def tokens(line: str | Column) -> Column:
    """The tokens of a line: apart at colons and spaces, without the punctuation around them unless it wraps a
    figure or is all there is."""
    raw = F.filter(F.split(F.replace(_c(line), F.lit(":"), F.lit(" ")), _SPACE), lambda x: x != "")
    bare = lambda x: F.btrim(x, F.lit(",;()[]"))
    return F.transform(raw, lambda x: F.when(x.rlike(NEGATIVE) | (bare(x) == ""), x).otherwise(bare(x)))


def nocomma(col: str | Column) -> Column:
    return F.replace(_c(col), F.lit(","), F.lit(""))


def _plain(c: Column) -> Column:
    c = strip(F.translate(F.lower(c), "$,", ""))
    return F.ltrim(F.rtrim(F.ltrim(c, F.lit("+")), F.lit(").")), F.lit("("))


def canon(col: str | Column) -> Column:
    """A value without formatting that carries no information; its sign stays, wrapped figures get theirs."""
    inner = lambda t: F.regexp_extract(t, NEGATIVE, 1)
    return bind(strip(join_thousands(col)), lambda t: F.when(t.rlike(NEGATIVE), F.concat(F.lit("-"), _plain(strip(join_thousands(inner(t)))))).otherwise(_plain(t)))


def is_multiword(col: str | Column) -> Column:
    """Whether a value is looked for as a part of a line instead of a token."""
    return F.contains(strip(join_thousands(col)), F.lit(" "))


def is_numeric(col: str | Column) -> Column:
    return strip(col).rlike(NUMERIC)


def shape(col: str | Column) -> Column:
    """The family of values that could be taken for this one: money, date, po, sku or text."""
    c = _c(col)
    return (
        F.when(is_numeric(c), "money")
        .when(c.rlike(r"(?U)^\d{4}-\d{2}-\d{2}$"), "date")
        .when(c.rlike(r"(?iU)^PO[-\s]?\w+$"), "po")
        .when(c.rlike(r"(?iU)^[A-Z]{2}[-\s]?\d{2,4}\w*$"), "sku")
        .otherwise("text")
    )


def stays_in_alphabet(printed: str | Column, got: str | Column) -> Column:
    """Whether `got` could pass for a value of the field that printed `printed`: digits where it has digits,
    letters where it has letters, and its own punctuation; figures may have those of money."""
    p, g = _c(printed), strip(F.coalesce(_c(got), F.lit("")))
    digit, letter = p.rlike(r"(?U)\d"), p.rlike(r"(?U)\p{L}")
    marks = F.concat(F.regexp_replace(p, r"(?U)[\p{L}\p{N}]", ""), F.lit(" "), F.when(digit & ~letter, F.lit("$,.-")).otherwise(""))
    fits = lambda c: (c.rlike(r"(?U)^\d$") & digit) | (c.rlike(r"^\p{L}$") & letter) | F.contains(marks, c)
    return (g != "") & F.forall(F.filter(F.split(g, ""), lambda c: c != ""), fits)


def num(col: str | Column) -> Column:
    """A printed figure as a double, null where it is none. Parentheses that wrap a figure make it negative;
    letters make it no figure; other marks are dropped."""
    whole, c = r"(?U)\A\(\s*\$?\s*[\d,. ]*\d[\d,. ]*\s*\)\z", _c(col)

    def parse(t: Column) -> Column:
        body = F.when(t.rlike(whole), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
        v = F.regexp_replace(body, r"(?U)[^\d.\-]", "").try_cast("double")
        return F.when(body.rlike("[A-Za-z]"), None).when(t.rlike(whole), -F.abs(v)).otherwise(v)

    # most are plain already, and need none of the steps
    return F.when(c.rlike(r"\A-?[0-9]+(?:\.[0-9]+)?\z"), c.try_cast("double")).otherwise(bind(strip(c), parse))


def html_rows(col: str | Column) -> Column:
    """An HTML table as text: a line per row with cells, cells apart by " | "; without rows, the text alone."""
    cells = lambda row: F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda x: F.btrim(F.regexp_replace(x, "<[^>]+>", " ")))
    rows = F.transform(F.regexp_extract_all(_c(col), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)), lambda r: F.array_join(cells(r), " | "))
    kept = F.filter(rows, lambda r: F.btrim(r, F.lit(" |")) != "")
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n")).otherwise(F.btrim(F.regexp_replace(_c(col), "<[^>]+>", " ")))
