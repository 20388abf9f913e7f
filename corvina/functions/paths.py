"""Label paths such as ``cuisine.italian``: a hierarchy in a string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def under(path: Column, root: Column) -> Column:
    """``path`` is ``root`` or below it, label by label."""
    return (path == root) | F.startswith(path, F.concat(root, F.lit(".")))


def any_under(paths: Column, roots: list[str] | None) -> Column:
    """Some path lies under some root; no roots keep all."""
    if not roots:
        return F.lit(True)
    wanted = F.array(*[F.lit(r) for r in roots])
    return F.exists(F.coalesce(paths, F.array().cast("array<string>")), lambda p: F.exists(wanted, lambda r: under(p, r)))


def parent(path: Column) -> Column:
    return F.when(F.instr(path, ".") > 0, F.regexp_replace(path, r"\.[^.]*$", ""))


def is_root(path: Column) -> Column:
    return F.instr(path, ".") == 0


def leaf(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def ancestors(path: Column) -> Column:
    """Proper prefixes, shortest first; none for a root."""
    labels = F.split(path, r"\.")
    n = F.size(labels)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, 1, i), "."))
    return F.when(n > 1, cut).otherwise(F.array().cast("array<string>"))


def display_name(path: Column) -> Column:
    x = F.regexp_replace(leaf(path), "_", " ")
    return F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, 2, 1 << 30))
