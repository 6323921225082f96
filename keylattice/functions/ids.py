"""Column expressions over hierarchical ids (``file::class::member``) and paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def file_of(unit: Column | str) -> Column:
    return F.substring_index(_c(unit), "::", 1)


def class_of(unit: Column | str) -> Column:
    """The class, for ids of exactly three parts; otherwise null."""
    parts = F.split(_c(unit), "::")
    return F.when(F.size(parts) == 3, F.element_at(parts, 2))


def symbol_of(unit: Column | str) -> Column:
    return F.element_at(F.split(_c(unit), "::"), -1)


def dir3_of(path: Column | str) -> Column:
    """The first three components; a shallow path keeps its file name."""
    return F.array_join(F.slice(F.split(_c(path), "/"), 1, 3), "/")


def package_of(path: Column | str) -> Column:
    return F.array_join(F.slice(F.split(_c(path), "/"), 1, 2), "/")


def parent_of(path: Column | str) -> Column:
    """The folder of a path, ``.`` at the top."""
    p = _c(path)
    return F.when(p.contains("/"), F.regexp_replace(p, "/[^/]*$", "")).otherwise(F.lit("."))


def normal_path(path: Column | str) -> Column:
    return F.regexp_replace(F.replace(_c(path), F.lit("\\"), F.lit("/")), "^[./]+", "")


def cluster_id(root: Column | str) -> Column:
    """Readable id of a cluster; it can collide, so ``root`` stays the key."""
    return F.concat(F.lit("cluster_"), F.regexp_replace(F.substring(_c(root), 1, 32), r"/|::|\.", "_"))


def unit_hash(unit: Column | str, tokens: Column | str) -> Column:
    return F.substring(F.sha2(F.concat(_c(unit), F.lit("|"), F.array_join(_c(tokens), ":")), 256), 1, 16)


def test_path(path: Column | str) -> Column:
    p = F.lower(_c(path))
    return p.contains("/test") | p.startswith("test") | p.endswith("_test.py") | p.endswith("test_.py") | p.contains("/spec/")


def symbol_tokens(name: Column | str) -> Column:
    """Searchable tokens of a symbol: its parts, itself, and neighbouring parts joined; sorted and distinct."""
    n = _c(name)
    spaced = F.regexp_replace(F.lower(F.regexp_replace(n, "([a-z])([A-Z])", "$1_$2")), r"[_\-#.:\s]+", " ")
    parts = F.filter(F.split(spaced, " "), lambda x: x != "")
    pairs = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.element_at(parts, i.cast("int")), F.lit("_"), F.element_at(parts, (i + 1).cast("int"))))).otherwise(F.array().cast("array<string>"))
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.concat(parts, F.array(F.lower(n)), pairs))))
