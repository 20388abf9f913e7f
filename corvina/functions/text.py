"""Text expressions; all built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once: a bound variable, where a repeated expression inside a lambda would run per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unrolled(df: DataFrame, key: str, array: Column, index: str, value: str) -> DataFrame:
    """(key, index, value), a row per element of a computed array.

    The outer form, with empty rows dropped afterwards: the inner one makes the optimizer
    add filters that compute the array again.
    """
    return df.select(key, F.posexplode_outer(array).alias(index, value)).filter(F.col(index).isNotNull())


def trim_ws(c: Column) -> Column:
    """Trim any white space, not only blanks."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def strip_markdown(c: Column) -> Column:
    """Markup signs to blanks, white space collapsed; null stays null."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[#*`_~\[\]()!>]", " "), r"\s+", " "))


def excerpt(c: Column, n: int = 240) -> Column:
    """At most ``n`` characters, cut at the last blank, with an ellipsis where cut."""
    one = F.regexp_replace(trim_ws(c), r"\s+", " ")
    return let(one, lambda x: F.when(F.length(x) <= n, x).otherwise(F.concat(F.regexp_replace(F.substring(x, 1, n), r" [^ ]*$", ""), F.lit("…"))))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(trim_ws(c)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def contains_ci(c: Column, q: str | None) -> Column:
    """ILIKE '%q%'; a blank query keeps all, % and _ in it stay wildcards."""
    return F.lit(True) if not q or not q.strip() else c.ilike(f"%{q}%")


def lines(c: Column) -> Column:
    return F.split(c, r"\r\n|\n|\r")


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\n{2,}"), trim_ws), lambda x: x != "")


def collapse_blank(c: Column) -> Column:
    return F.regexp_replace(trim_ws(c), r"\n{3,}", "\n\n")


def running_header_key(c: Column) -> Column:
    """Line as compared for running headers: a trailing page number goes where enough title is left."""
    one = F.regexp_replace(c, " {2,}", " ")
    bare = F.regexp_replace(one, r" \d{1,4}$", "")
    return F.when((F.length(bare) >= 12) & (F.size(F.filter(F.split(bare, r"\s+"), lambda w: w != "")) >= 3), bare).otherwise(one)


def is_page_furniture(c: Column) -> Column:
    t = trim_ws(c)
    return (t != "") & (t.rlike(r"^\d{1,4}$") | t.rlike(r"(?i)\.indd|fogra") | t.rlike(r"(?i)\b(dtp|page):\d+\b") | t.rlike(r"(?i)^chapter\s+\d+\b"))


def could_be_heading(c: Column, max_title: int = 80, numbered: bool = True, excluded: tuple[str, ...] = ()) -> Column:
    """A short line without a closing sign that begins like a title and with no excluded word."""
    start = F.substring(c, 1, 1).rlike(r"^\p{Lu}")
    if numbered:
        start = start | c.rlike(r"^\d+(\.\d+)*\.?\s+[A-ZÀ-ÿ]")
    ok = F.length(c).between(3, max_title) & ~c.rlike(r"[.,;:]$") & start
    for e in excluded:
        ok = ok & ~F.lower(c).startswith(e)
    return ok


def heading_in_context(c: Column, previous: Column, **options: object) -> Column:
    """Also needs a blank line or a finished sentence of 20 characters or more before it; no line before counts as blank."""
    p = trim_ws(F.coalesce(previous, F.lit("")))
    return could_be_heading(c, **options) & ((p == "") | ((F.length(p) >= 20) & p.rlike(r"[.!?]$")))  # type: ignore[arg-type]


def is_palindrome(c: Column) -> Column:
    return (c != "") & (F.reverse(c) == c)


def file_suffix(c: Column) -> Column:
    return F.when(F.instr(c, ".") > 0, F.lower(F.substring_index(c, ".", -1))).otherwise("")


def title_or_filename(title: Column, filename: Column) -> Column:
    return F.when(trim_ws(F.coalesce(title, F.lit(""))) == "", trim_ws(filename)).otherwise(title)


def merge_short(parts: Column, min_chars: int) -> Column:
    """Fold an array of segments: one shorter than ``min_chars`` takes the next after a blank line; the last may stay short."""
    done = F.array().cast("array<string>")

    def step(s: Column, x: Column) -> Column:
        short = F.length(trim_ws(s["acc"])) < min_chars
        return F.struct(
            F.when(short, s["done"]).otherwise(F.array_append(s["done"], s["acc"])).alias("done"),
            F.when(short, F.concat(s["acc"], F.lit("\n\n"), x)).otherwise(x).alias("acc"),
        )

    def fold(p: Column) -> Column:
        start = F.struct(done.alias("done"), F.get(p, F.lit(0)).alias("acc"))
        folded = F.aggregate(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), start, step, lambda s: F.array_append(s["done"], s["acc"]))
        return F.when(F.size(p) == 0, done).otherwise(folded)

    return let(parts, fold)


def trailing_context(previous: Column, n: int) -> Column:
    """Tail of at most ``n`` characters, begun after its first sentence end where one lies inside."""
    def cut(w0: Column, tail: Column) -> Column:
        stop = F.regexp_instr(tail, F.lit("[.?!\n]"))
        return F.when(F.length(w0) <= n, w0).when((stop > 0) & (stop < F.length(tail)), trim_ws(F.substr(tail, stop + 1))).otherwise(tail)

    return let(trim_ws(previous), lambda w0: let(F.right(w0, F.lit(n)), lambda tail: cut(w0, tail)))


def rerank_order(answer: Column, candidates: int) -> Column:
    """Passage numbers in a model's free answer: in range, first mention only."""
    numbers = F.transform(F.regexp_extract_all(answer, F.lit(r"(\d+)"), 1), lambda x: x.try_cast("int"))
    return F.array_distinct(F.filter(numbers, lambda x: x.isNotNull() & (x < candidates)))
