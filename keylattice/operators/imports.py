"""File-to-file import edges, resolved by joins with the list of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keylattice.functions import ids


def python_imports(files: DataFrame) -> DataFrame:
    """(src, dst) of absolute imports of files that exist, as module or package."""
    name = r"(?m)^\s*(?:from\s+([A-Za-z_][\w.]*)\s+import|import\s+([A-Za-z_][\w.]*))"
    both = F.concat(F.regexp_extract_all("text", F.lit(name), F.lit(1)), F.regexp_extract_all("text", F.lit(name), F.lit(2)))
    m = files.where(F.col("file").endswith(".py")).select(F.col("file").alias("src"), F.explode(F.array_distinct(F.filter(both, lambda x: x != ""))).alias("m"))
    base = F.replace(F.col("m"), F.lit("."), F.lit("/"))
    return _resolve(m.select("src", F.explode(F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))).alias("dst")), files)


def join_path(folder: Column, relative: Column) -> Column:
    """A relative path walked from a folder: ``.`` stays, ``..`` goes up."""
    steps = F.concat(F.filter(F.split(folder, "/"), lambda x: ~x.isin("", ".")), F.filter(F.split(relative, "/"), lambda x: ~x.isin("", ".")))
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.lit(0), F.size(a) - 1))).otherwise(F.concat(a, F.array(x))))
    return F.array_join(walked, "/")


def js_imports(files: DataFrame) -> DataFrame:
    """(src, dst) of relative imports and requires, with the usual extensions and index files tried."""
    p = r"(?:from\s+|require\s*\(\s*|import\s*\(\s*|import\s+)['\"](\.[^'\"]*)['\"]"
    m = files.where(F.col("file").rlike(r"\.(?:js|jsx|ts|tsx)$")).select(F.col("file").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(1)))).alias("m"))
    path = join_path(ids.parent_of("src"), F.col("m"))
    tried = F.array(path, *(F.concat(path, F.lit(x)) for e in ("ts", "tsx", "js", "jsx") for x in (f".{e}", f"/index.{e}")))
    return _resolve(m.select("src", F.explode(tried).alias("dst")), files)


def include_imports(files: DataFrame) -> DataFrame:
    """(src, dst) of quoted includes, beside the file or from the top."""
    m = files.select(F.col("file").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r'(?m)^\s*#\s*include\s+"([^"]+)"'), F.lit(1)))).alias("m"))
    return _resolve(m.select("src", F.explode(F.array(join_path(ids.parent_of("src"), F.col("m")), F.col("m"))).alias("dst")), files)


def _resolve(tried: DataFrame, files: DataFrame) -> DataFrame:
    return tried.where("src <> dst").distinct().join(files.select(F.col("file").alias("dst")), "dst", "left_semi").select("src", "dst")


def go_imports(files: DataFrame, module: str) -> DataFrame:
    """(src, package) of imports below a module path, from single lines and blocks."""
    quoted = F.regexp_extract_all("text", F.lit(r'(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"]+)"'), F.lit(1))
    m = files.where(F.col("file").endswith(".go")).select(F.col("file").alias("src"), F.explode(F.array_distinct(quoted)).alias("m"))
    return m.where(F.col("m").startswith(module + "/")).select("src", F.expr(f"substring(m, {len(module) + 2})").alias("package"))


def resolve_dotted(file: Column, module: Column) -> Column:
    """The path (without extension) of a dotted relative module, seen from a Python file: one dot is its folder, each further one goes up."""
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    folder = F.slice(F.split(file, "/"), F.lit(1), F.greatest(F.lit(0), F.size(F.split(file, "/")) - dots))
    rest = F.filter(F.split(F.regexp_replace(module, r"^\.+", ""), r"\."), lambda x: x != "")
    return F.array_join(F.concat(folder, rest), "/")


def longest_prefix(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(module, file): for dotted modules, the file or package of the longest prefix that there is."""
    parts = F.split("module", r"\.")
    each = wanted.select("module").distinct().select("module", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n"))
    base = F.array_join(F.slice(F.split("module", r"\."), F.lit(1), F.col("n")), "/")
    tried = each.select("module", F.posexplode(F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))).alias("way", "file"), "n")
    return tried.join(files.select("file"), "file").groupBy("module").agg(F.max_by("file", F.struct("n", -F.col("way"))).alias("file"))
