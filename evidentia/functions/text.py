"""Text functions. Built-ins wherever they can say it; the two Arrow functions are the exact Unicode fold and the
Ratcliff-Obershelp ratio."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Latin-1 letters with marks, their plain letters, and what digits are misread as.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
DIGIT_LOOKS, DIGIT_MEANT = "OQDILZSGTBA", "00011256784"
LETTER_LOOKS, LETTER_MEANT = "4", "A"
SHORT_LOOKS, SHORT_MEANT = "KV7T", "XYZZ"
CODE = r"[0-9]{2}[A-Z][0-9]{2}"
NUMBER = r"[0-9]+(?:[.,][0-9]+)?"


def or_empty(x: Column) -> Column:
    """Trimmed text, missing as empty."""
    return F.coalesce(F.trim(x.cast("string")), F.lit(""))


def clean_space(x: Column) -> Column:
    """Any Unicode white space, runs of it too, as one blank; none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)[\s\x{A0}\x00]+", " "))


def _plain(x: Column) -> Column:
    return F.replace(F.translate(F.lower(F.coalesce(x, F.lit(""))), MARKED, PLAIN), F.lit("ß"), F.lit("ss"))


def plain_upper(x: Column) -> Column:
    """Capitals, Latin-1 marks dropped."""
    return F.upper(_plain(x))


def fold_key(x: Column) -> Column:
    """Lower case, Latin-1 marks dropped, sharp s as ss, only a-z and 0-9 left."""
    return F.regexp_replace(_plain(x), "[^a-z0-9]+", "")


@F.pandas_udf(T.StringType())
def fold_key_exact(x: pd.Series) -> pd.Series:
    """fold_key for all of Unicode: compatibility decomposition without marks."""
    import re
    import unicodedata

    def fold(s: str | None) -> str:
        plain = "".join(c for c in unicodedata.normalize("NFKD", s or "") if not unicodedata.combining(c))
        return re.sub("[^a-z0-9]+", "", plain.casefold())

    return x.map(fold)


def label_key(x: Column) -> Column:
    """fold_key without a trailing instance number."""
    return fold_key(F.regexp_replace(or_empty(x), r"\s*\.?\s*[0-9]+\s*$", ""))


def anchors(x: Column) -> Column:
    """Distinct words of letters and digits, folded, in order."""
    return F.array_distinct(F.regexp_extract_all(_plain(x), F.lit("([a-z0-9]+)"), F.lit(1)))


def compact_code(x: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", ""))


def codes(x: Column) -> Column:
    """All codes (two digits, a letter, two digits) that stand by themselves."""
    return F.regexp_extract_all(F.upper(F.coalesce(x, F.lit(""))), F.lit(rf"(?<![A-Z0-9])({CODE})(?![A-Z0-9])"), F.lit(1))


def first_code(x: Column) -> Column:
    return F.get(codes(x), F.lit(0))


def unconfused_code(x: Column) -> Column:
    """A five-character reading with each place put right: digits where digits belong, a letter in the middle. Null where
    that gives no code."""
    s = F.upper(F.regexp_replace(F.coalesce(x, F.lit("")), "[^A-Za-z0-9]", ""))
    digits = lambda a, n: F.translate(F.substring(s, a, n), DIGIT_LOOKS, DIGIT_MEANT)
    fixed = F.concat(digits(1, 2), F.translate(F.substring(s, 3, 1), LETTER_LOOKS, LETTER_MEANT), digits(4, 2))
    return F.when((F.length(s) == 5) & fixed.rlike(f"^{CODE}$"), fixed)


def short_identifier(x: Column) -> Column:
    """A letter X, Y or Z and its number of one or two digits, after confusions are put right; null for anything else."""
    s = F.upper(F.regexp_replace(F.coalesce(x, F.lit("")), "[^A-Za-z0-9]", ""))
    fixed = F.concat(F.translate(F.substring(s, 1, 1), SHORT_LOOKS, SHORT_MEANT), F.translate(F.substring(s, 2, 99), DIGIT_LOOKS, DIGIT_MEANT))
    return F.when(fixed.rlike("^[XYZ][0-9]{1,2}$"), fixed)


def is_structured_short(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9_.-]", "").rlike("^[A-Za-z]{1,3}[0-9]+[A-Za-z0-9_.-]*$")


def is_textual(x: Column) -> Column:
    return F.coalesce(x, F.lit("")).rlike(r"[\p{L}\p{N}]")


def plausibility(x: Column) -> Column:
    """Points for letters, words and identifiers; less for bare numbers, lone letters and broken characters."""
    v = or_empty(x)
    alnum = F.length(F.regexp_replace(v, r"[^\p{L}\p{N}]", ""))
    alpha = F.length(F.regexp_replace(v, r"[^\p{L}]", ""))
    points = F.least(alnum, F.lit(24)) * F.lit(0.8)
    for condition, worth in (
        (alpha >= 3, 7.0), (v.rlike("^[A-Za-z]{1,3}[0-9]+[A-Za-z0-9.-]*$"), 12.0), (v.rlike("^[0-9.]+$"), -30.0),
        ((alnum == 1) & ~v.rlike(r"\p{Nd}"), -28.0), (v.contains("?") | v.contains("�"), -18.0), (v.rlike("^[^A-Za-z0-9]"), -12.0),
    ):
        points = points + F.when(condition, F.lit(worth)).otherwise(F.lit(0.0))
    return F.when(alnum == 0, F.lit(-70.0)).otherwise(points)


def clean_label(x: Column) -> Column:
    """Noise characters out (all white space but blanks, too), unbalanced brackets at the ends off, blanks single, and an acronym
    with one small letter in capitals."""
    v = F.translate(F.coalesce(x, F.lit("")), "\x0c‘’�", " ''")
    v = F.regexp_replace(v, r"[^\p{L}\p{N}_ .|/()'-]+", "")
    v = clean_space(F.regexp_replace(F.regexp_replace(v, r"^[\])}|]+", ""), r"[\[({|]+$", ""))

    def word(w: Column) -> Column:
        letters = F.regexp_replace(w, r"[^\p{L}]", "")
        capitals = F.length(F.regexp_replace(letters, r"[^\p{Lu}]", ""))
        return F.when((F.length(letters) >= 2) & (capitals >= F.length(letters) - 1), F.upper(w)).otherwise(w)

    return F.array_join(F.transform(F.split(v, " "), word), " ")


def multiplicity(x: Column) -> Column:
    """The n of an explicit `nX`, at least 1, else null."""
    n = F.regexp_extract(F.upper(clean_space(x)), r"(?<![A-Z0-9])([0-9]{1,3})\s*X(?![A-Z0-9])", 1)
    return F.when(n != "", F.greatest(F.lit(1), n.cast("int")))


def datum_flags(x: Column, letters: str = "ABCDE") -> Column:
    """Which reference letters stand alone once codes are taken out."""
    rest = F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), CODE, " ")
    return F.create_map(*[c for letter in letters for c in (F.lit(letter), rest.rlike(f"(?<![A-Z0-9]){letter}(?![A-Z0-9])"))])


def number(x: Column) -> Column:
    """A number with decimal point or comma, else null."""
    return F.replace(F.trim(x.cast("string")), F.lit(","), F.lit(".")).try_cast("double")


def tolerance(x: Column, code: Column) -> Column:
    """First number left once multiplicity, the row's own code and lone reference letters are out."""
    v = F.regexp_replace(F.upper(clean_space(x)), r"(?<![A-Z0-9])[0-9]{1,3}\s*X(?![A-Z0-9])", " ")
    v = F.when(F.coalesce(code, F.lit("")) != "", F.replace(v, F.upper(code), F.lit(" "))).otherwise(v)
    v = F.regexp_replace(v, "(?<![A-Z0-9])[A-E](?![A-Z0-9])", " ")
    return number(F.nullif(F.regexp_extract(v, f"({NUMBER})", 1), F.lit("")))


def plain_number(x: Column) -> Column:
    """Numerals with usual misreadings beside a decimal point put right, and no blanks around it."""
    v = F.replace(F.upper(F.coalesce(x, F.lit(""))), F.lit(","), F.lit("."))
    for wrong, right in ((r"[IL|]\s*\.\s*(?=[0-9A-Z])", "1."), (r"([0-9])\s*\.\s*(?=[0-9A-Z])", "$1."), (r"\.\s*[GS]", ".6"), (r"\.\s*B", ".8"), (r"\.\s*A", ".4")):
        v = F.regexp_replace(v, wrong, right)
    return v


def alternatives(text: Column, others: Column, separator: str = "|") -> Column:
    """The text and its other readings, distinct, in order, without empty ones."""
    many = F.transform(F.split(F.coalesce(others, F.lit("")), f"[{separator}]"), lambda v: F.trim(v))
    return F.filter(F.array_distinct(F.concat(F.array(or_empty(text)), many)), lambda a: a != "")


def with_reason(reasons: Column, reason: str, when: Column) -> Column:
    """A set of reasons with one more where the condition holds."""
    return F.when(F.coalesce(when, F.lit(False)), F.array_union(reasons, F.array(F.lit(reason)))).otherwise(reasons)


def code_display(text: Column, code: Column) -> Column:
    """The code, repeated in parentheses where the text had any."""
    return F.when(text.contains("("), F.concat(code, F.lit(" ("), code, F.lit(")"))).otherwise(code)


def natural_key(x: Column) -> Column:
    """A string whose order is that of the text with numbers by value."""
    parts = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 20, "0")).otherwise(p)), "")


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched characters over all, by longest common blocks (not symmetric)."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


#: Keywords of conditions.
KEYWORDS = ("HEIGHT", "WIDTH", "LENGTH", "THICKNESS", "GAP", "DIAMETER")


@F.pandas_udf(T.StringType())
def keyword(x: pd.Series) -> pd.Series:
    """First keyword that the letters of the text hold, or that some window of them, up to a letter longer or shorter,
    resembles by 0.78 or more; empty if none does."""
    import re
    from difflib import SequenceMatcher

    def alike(letters: str, k: str) -> bool:
        sizes = [n for n in (len(k) - 1, len(k), len(k) + 1) if n > 2]
        return k in letters or any(SequenceMatcher(None, letters[i : i + n], k).ratio() >= 0.78 for n in sizes for i in range(len(letters) - n + 1))

    def find(text: str | None) -> str:
        letters = re.sub("[^A-Z]", "", (text or "").upper())
        return next((k for k in KEYWORDS if alike(letters, k)), "")

    return x.map(find)


def condition(text: Column, key: Column) -> Column:
    """`KEYWORD < n mm` from a text with a comparison, given its keyword; sign and number are of one match. Null without one."""
    pattern = r"([<>])\s*([0-9]{1,3}(?:\.[0-9]{1,2})?)"
    v = F.replace(F.upper(text), F.lit(","), F.lit("."))
    sign, n = F.regexp_extract(v, pattern, 1), F.regexp_extract(v, pattern, 2)
    return F.when((key != "") & (n != ""), F.concat_ws(" ", key, sign, n, F.lit("mm")))


def rendered(x: Column, kind: str) -> Column:
    """A cell for a sheet: true as Oui and false as nothing, maps and arrays as JSON, missing as empty."""
    if kind == "boolean":
        return F.when(x, "Oui").otherwise("")
    if kind.startswith(("array", "map", "struct")):
        return F.coalesce(F.to_json(x), F.lit(""))
    return F.coalesce(x.cast("string"), F.lit(""))
