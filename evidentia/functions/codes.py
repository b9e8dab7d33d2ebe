"""Codes and numerals inside one row: permissive tokens, evidence by zone, guards, label repairs, suffixes.

All of it is column expressions over the row's own readings, so nothing here shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CODE, KEYWORDS, anchors, fold_key, number, or_empty, plain_upper, short_identifier, tolerance, unconfused_code

#: What a code, a strict code and a short identifier look like to a reader that confuses characters.
CODE_LIKE = r"(?<![A-Z0-9])([0-9OQDLIZSGBT]{2}[A-Z4][0-9OQDLIZSGBT]{2})(?![A-Z0-9])"
STRICT_CODE = rf"(?<![A-Z0-9])({CODE})(?![A-Z0-9])"
SHORT_LIKE = r"(?<![A-Z0-9])([XYZKVT7][0-9OQDLIZSGBTA]{1,2})(?![A-Z0-9])"
SUFFIX_LOOKS, SUFFIX_MEANT = "OQDILTPZSGB", "00011122568"
CODE_PARENTS = ("notes", "tolerancegeometrique")
MULTIPLICITY = r"(?i)(?<![A-Z0-9])([0-9]+)\s*[x×](?![A-Z0-9])"


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x worked out once."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _found(x: Column, pattern: str, read: Callable[[Column], Column]) -> Column:
    tokens = F.regexp_extract_all(plain_upper(x), F.lit(pattern), F.lit(1))
    return F.array_compact(F.transform(F.filter(tokens, lambda t: t.rlike("[0-9]")), read))


def codes_like(x: Column) -> Column:
    """Codes that a text may mean, in order: tokens of digits and what is taken for digits around a letter, with one digit at
    least, put right."""
    return _found(x, CODE_LIKE, unconfused_code)


def strict_codes(x: Column) -> Column:
    return F.regexp_extract_all(plain_upper(x), F.lit(STRICT_CODE), F.lit(1))


def short_like(x: Column) -> Column:
    """Short identifiers that a text may mean, in order."""
    tokens = F.regexp_extract_all(plain_upper(x), F.lit(SHORT_LIKE), F.lit(1))
    return F.array_compact(F.transform(tokens, short_identifier))


def head(x: Column) -> Column:
    """What stands before the first parenthesis."""
    return F.substring_index(x, "(", 1)


def inside(x: Column) -> Column:
    """What follows the first parenthesis; empty without one."""
    return F.regexp_extract(x, r"(?s)\((.*)$", 1)


def readings(text: Column, others: Column) -> Column:
    """The text and its other readings, parted by a bar between blanks: distinct, in order, none empty."""
    many = F.transform(F.split(F.coalesce(others, F.lit("")), r"\s+\|\s+"), lambda v: F.trim(v))
    return F.filter(F.array_distinct(F.concat(F.array(or_empty(text)), many)), lambda a: a != "")


def _evidence(options: Column, find: Callable[[Column], Column], weigh: Callable[[Column, Column, Column], Column]) -> Column:
    each = F.flatten(F.transform(options, lambda o, i: F.transform(F.array_distinct(find(o)), lambda c: F.struct(c.alias("code"), weigh(o, i, c).alias("score")))))

    def summed(votes: Column) -> Column:
        names = F.array_distinct(F.transform(votes, lambda v: v["code"]))
        total = lambda n: F.aggregate(F.filter(votes, lambda v: v["code"] == n), F.lit(0.0), lambda a, v: a + v["score"])
        return F.transform(names, lambda n: F.struct(n.alias("code"), total(n).alias("score")))

    return let(each, summed)


def _points(*terms: tuple[Column, float]) -> Column:
    return sum((F.when(condition, worth).otherwise(0.0) for condition, worth in terms), F.lit(0.0))


def code_evidence(options: Column) -> Column:
    """(A23) array<struct<code, score>> in order of appearance: each reading counts for its codes, by where they stand (before the
    parenthesis, inside it, in both) and whether they are printed as codes; the first reading a little more."""

    def weigh(o: Column, i: Column, c: Column) -> Column:
        lead, repeat = F.array_contains(codes_like(head(o)), c), F.array_contains(codes_like(inside(o)), c)
        strict = ((F.array_contains(strict_codes(head(o)), c), 3.0), (F.array_contains(strict_codes(inside(o)), c), 5.0))
        return 1.0 + _points((lead, 0.75), (repeat, 2.0), *strict, (lead & repeat, 3.0), (i == 0, 0.75))

    return _evidence(options, codes_like, weigh)


def short_evidence(options: Column) -> Column:
    """(A23) The same for short identifiers."""

    def weigh(o: Column, i: Column, c: Column) -> Column:
        lead, repeat = F.array_contains(short_like(head(o)), c), F.array_contains(short_like(inside(o)), c)
        return _points((lead, 1.0), (repeat, 2.0), (lead & repeat, 3.0), (i == 0, 0.5))

    return _evidence(options, lambda o: F.concat(short_like(head(o)), short_like(inside(o))), weigh)


def strict_head(x: Column) -> Column:
    """Whether the first display, before the parenthesis, is a code as printed."""
    return F.size(strict_codes(head(x))) > 0


def has_strict_code(x: Column) -> Column:
    """(F10)"""
    return F.size(strict_codes(x)) > 0


def is_code_display(x: Column) -> Column:
    """A short label with a code in it; long texts that merely hold something alike are none."""
    return (F.size(codes_like(x)) > 0) & (F.length(F.regexp_replace(plain_upper(head(x)), "[^A-Z0-9]", "")) <= 9)


def is_short_display(x: Column) -> Column:
    """(F10)"""
    return F.regexp_replace(plain_upper(head(x)), r"\s+", "").rlike("^[XYZKVT7][0-9OQDLIZSGBTA]{1,2}$")


def is_clean_short(x: Column, identifier: Column) -> Column:
    """The identifier alone, or with itself in parentheses."""
    v = F.regexp_replace(plain_upper(x), r"\s*([()])\s*", "$1")
    return (F.trim(v) == identifier) | (F.trim(v) == F.concat(identifier, F.lit("("), identifier, F.lit(")")))


def has_code_parent(parent: Column) -> Column:
    """Whether the parent's rows are named by codes."""
    return fold_key(or_empty(parent)).isin(*CODE_PARENTS)


def with_code(x: Column, code: Column) -> Column:
    """(X22) The code, and what the text has in parentheses with the code in place of its first token."""
    tail = F.regexp_replace(F.regexp_extract(x, r"(?s)(\(.*)$", 1), F.lit(r"(?is)^(?<before>.*?\()[A-Z0-9]{3,8}"), F.concat(F.lit("${before}"), code))
    return F.when(x.contains("("), F.concat(code, F.lit(" "), tail)).otherwise(code)


def capture_label(x: Column, parent: Column) -> Column:
    """(X24) A capture's label restored where its parent or its own form proves it, else unchanged."""
    v, key = or_empty(x), fold_key(or_empty(parent))
    form = r"^(?:REF\s+)?([A-Z])\s*(?:\|\s*)?([A-Z]-[A-Z])\s*(?:\|\s*)?([A-Z]-[A-Z])$"
    cut = lambda k: F.regexp_extract(plain_upper(v), form, k)
    spring = F.when(key.isin("cpc", "captures"), "CPC SPRINGBACK").when(key == "ctf", "CTF SPRINGBACK").otherwise(v)
    return F.when(fold_key(v) == "springback", spring).when(cut(1) != "", F.concat(F.lit("REF "), F.concat_ws("|", cut(1), cut(2), cut(3)))).otherwise(v)


def reference_label(x: Column, parent: Column) -> Column:
    """(X24) The number of a reference element put right by its letter, under the references only."""
    v = or_empty(x)
    letter = F.regexp_extract(plain_upper(v), r"^ELEMENT DE REFERENCE\.?\s*([0-9S]?)\s*\(([A-E])\)$", 2)
    number = F.regexp_extract(plain_upper(v), r"^ELEMENT DE REFERENCE\.?\s*([0-9S]?)\s*\(([A-E])\)$", 1)
    want = F.translate(letter, "ABCDE", "12345")
    change = (fold_key(or_empty(parent)) == "references") & (letter != "") & (number != want)
    return F.when(change, F.concat(F.lit("Elément de référence."), want, F.lit(" ("), letter, F.lit(")"))).otherwise(v)


def before_condition(line: Column) -> Column:
    """What stands before the first of the keywords (in their order) that the line holds; null without one."""
    return F.coalesce(*[F.when(F.locate(k, line) > 0, F.substring(line, F.lit(1), F.locate(k, line) - 1)) for k in KEYWORDS])


def conditional_suffix(texts: Column) -> Column:
    """(X16) Letter and number 01..09 that stand last before a condition's keyword, from the first line that has them; empty
    without one."""
    lines = F.flatten(F.transform(texts, lambda t: F.split(F.upper(F.coalesce(t, F.lit(""))), r"\r\n|[\n\r\x0B\f]")))

    def suffix(line: Column) -> Column:
        prefix = F.regexp_replace(F.coalesce(before_condition(line), F.lit("")), "[^A-Z0-9]", "")
        last = F.regexp_extract(prefix, "^.*([A-Z][0OQD][1-9ILTPZSGB])", 1)
        return F.concat(F.substring(last, 1, 1), F.translate(F.substring(last, 2, 2), SUFFIX_LOOKS, SUFFIX_MEANT))

    return F.coalesce(F.get(F.filter(F.transform(lines, suffix), lambda s: s != ""), F.lit(0)), F.lit(""))


def unique_texts(values: Column) -> Column:
    """(A17) Texts in order, trimmed, the first of those that differ in case only, none empty."""
    clean = F.filter(F.transform(values, or_empty), lambda v: v != "")
    return let(clean, lambda a: F.filter(a, lambda v, i: ~F.exists(F.slice(a, F.lit(1), i), lambda w: F.lower(w) == F.lower(v))))


def first_filled(*options: Column) -> Column:
    """The first option that is neither null nor empty; else empty."""
    return F.coalesce(*[F.nullif(o.cast("string"), F.lit("")) for o in options], F.lit(""))


def cascade(*options: tuple[str, Column, Column]) -> Column:
    """struct<value, source> of the first option (name, whether it is there, value) that is there, even if its value is none; of
    options that are all absent null and empty."""
    value, source = F.lit(None).cast("double"), F.lit("")
    for name, there, of in reversed(options):
        value, source = F.when(there, of).otherwise(value), F.when(there, F.lit(name)).otherwise(source)
    return F.struct(value.alias("value"), source.alias("source"))


def tolerance_of(limit: Column, dimension: Column, text: Column, code: Column) -> Column:
    """struct<value, source, lower, upper>: the limit's nominal value, else the dimension's, else what the text says. A member
    that is there decides, whether it holds a number or not; so do the limit's lower and upper ends over the dimension's."""
    has = lambda m, k: F.coalesce(F.map_contains_key(m, F.lit(k)), F.lit(False))
    get = lambda m, k: number(F.try_element_at(m, F.lit(k)))
    read = tolerance(text, code)
    best = cascade(("limit", has(limit, "nominal"), get(limit, "nominal")), ("dimension", has(dimension, "dimension_value"), get(dimension, "dimension_value")), ("text", read.isNotNull(), read))
    end = lambda k: F.when(has(limit, k), get(limit, k)).otherwise(get(dimension, f"tolerance_{k}"))
    return F.struct(best["value"].alias("value"), best["source"].alias("source"), end("lower").alias("lower"), end("upper").alias("upper"))


#: Members that hold a field, by priority.
FIELD_MEMBERS = {
    "display": ("ToleranceZone.Value", "ToleranceValue", "Tolerance", "Value"), "unit": ("ToleranceZone.Unit", "Unit"), "text": ("Text", "GetText"),
    "kind": ("GeometricToleranceType", "Type", "Symbol"),
}


def record_fields(values: Column) -> Column:
    """struct<display, unit, text, kind, combined>: each the first of its members that is not empty; combined is the name, the text
    and all values, those that are not empty, with bars between."""
    v = lambda name: F.coalesce(F.try_element_at(values, F.lit(name)), F.lit(""))
    fields = {n: first_filled(*[v(m) for m in members]) for n, members in FIELD_MEMBERS.items()}
    every = F.concat(F.array(v("Name"), fields["text"]), F.coalesce(F.map_values(values), F.array().cast("array<string>")))
    combined = F.array_join(F.filter(every, lambda x: F.coalesce(x, F.lit("")) != ""), " | ")
    return F.struct(*[c.alias(n) for n, c in fields.items()], combined.alias("combined"))


def label_visible(x: Column, target: str, all_of: Sequence[str] = (), any_of: Sequence[str] = ()) -> Column:
    """Whether a read text shows a label: its folded form holds the target's, or its tokens begin with all of some anchors and
    with any of others."""
    tokens = anchors(x)
    begins = lambda a: F.exists(tokens, lambda t: F.startswith(t, F.lit(a)))
    whole = F.contains(fold_key(x), F.lit(target)) if target else F.lit(False)
    part = F.lit(bool(all_of or any_of))
    for a in all_of:
        part = part & begins(a)
    if any_of:
        some = F.lit(False)
        for a in any_of:
            some = some | begins(a)
        part = part & some
    return whole | part


def quantity(values: Column, combined: Column, applied: Column) -> Column:
    """struct<display, count>: a multiplicity in the combined text, else in the fields by priority (a bare number becomes nX),
    else what kind of collection it is, else by whether it applies to many entities."""
    v = lambda name: F.coalesce(F.element_at(values, name), F.lit(""))
    counts = [v(f"SemanticGDT.NxDisplay.{n}") for n in ("Count", "Number", "Nx", "InstanceCount")]
    shown = first_filled(v("Multiplicity"), v("Quantity"), v("SemanticGDT.NxDisplay"), *counts)
    number = F.floor(first_filled(*counts).try_cast("double")).cast("string")
    bare = ~shown.rlike(MULTIPLICITY) & F.coalesce(number.cast("double") > 0, F.lit(False))
    true = lambda name: F.lower(v(name)) == "true"
    kind = F.when(true("SemanticGDT.NxDisplay.IsACollection"), "Collection").when(true("SemanticGDT.NxDisplay.IsASeparate"), "Separate").when(true("SemanticGDT.IsAppliedOnMultipleEntities"), "multiple")
    display = F.when(bare, F.concat(number, F.lit("X"))).when(shown != "", shown).otherwise(kind)
    source = F.when(combined.rlike(MULTIPLICITY), combined).when(display.rlike(MULTIPLICITY), display)
    read = F.struct(F.replace(F.regexp_extract(source, MULTIPLICITY, 0), F.lit("×"), F.lit("X")).alias("display"), F.regexp_extract(source, MULTIPLICITY, 1).alias("count"))
    pair = lambda a, b: F.struct(F.lit(a).alias("display"), F.lit(b).alias("count"))
    return F.when(source.isNotNull(), read).when(display.isNotNull(), F.struct(display.alias("display"), F.lit("").alias("count"))).when(
        applied, pair("multiple", "")
    ).when(~applied, pair("1X", "1")).otherwise(pair("", ""))


def base_axis(axes: Column, step: Column, default: float, near: float = 0.16) -> Column:
    """(A19) The axis with most others a whole number of steps further on (within `near`), the least of equal ones."""

    def support(a: Column) -> Column:
        return F.size(F.filter(axes, lambda b: (b > a) & (F.abs((b - a) / step - F.bround((b - a) / step)) < near)))

    return F.coalesce(F.array_min(F.transform(axes, lambda a: F.struct((-support(a)).alias("s"), a.alias("a"))))["a"], F.lit(default))


def overlap_correlation(a: Column, b: Column, shift: Column) -> Column:
    """(W10) Centred correlation of a from `shift` on with the begin of b (a negative shift: the other way round); -1 without
    variance or overlap."""
    n = F.least(F.size(a), F.size(b)) - F.abs(shift)
    x = F.slice(a, F.greatest(shift, F.lit(0)) + 1, F.greatest(n, F.lit(0)))
    y = F.slice(b, F.greatest(-shift, F.lit(0)) + 1, F.greatest(n, F.lit(0)))
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e) / F.size(v)
    centred = lambda v: let(F.struct(v.alias("v"), mean(v).alias("m")), lambda s: F.transform(s["v"], lambda e: e - s["m"]))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda i, j: i * j), F.lit(0.0), lambda s, e: s + e)
    value = let(F.struct(centred(x).alias("x"), centred(y).alias("y")), lambda s: F.try_divide(dot(s["x"], s["y"]), F.sqrt(dot(s["x"], s["x"]) * dot(s["y"], s["y"]))))
    return F.when(n > 0, F.coalesce(value, F.lit(-1.0))).otherwise(-1.0)
