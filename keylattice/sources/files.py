"""Repositories as tables of files, and artifacts as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LANGUAGES = {
    "python": "py", "typescript": "ts tsx", "javascript": "js jsx", "java": "java", "go": "go", "rust": "rs", "ruby": "rb", "csharp": "cs", "php": "php", "kotlin": "kt kts",
    "c": "c h", "scala": "scala", "lua": "lua", "elixir": "ex exs", "swift": "swift", "r": "r", "dart": "dart", "bash": "sh bash", "nim": "nim", "zig": "zig", "haskell": "hs",
    "ocaml": "ml mli", "fsharp": "fs fsx", "clojure": "clj cljs", "erlang": "erl", "matlab": "m", "vb": "vb", "crystal": "cr", "cobol": "cob cbl", "groovy": "groovy",
}
SKIPPED = (
    ".env .eggs .git .hg .mypy_cache .next .nuxt .nyc_output .pytest_cache .ruff_cache .svelte-kit .svn .tox .turbo .venv __pycache__ bin "
    "bower_components build coverage dist eggs env node_modules obj out target vendor venv virtualenv"
).split()
MARKERS = "setup.py pyproject.toml requirements.txt package.json yarn.lock pnpm-lock.yaml go.mod go.sum Cargo.toml Gemfile pom.xml build.gradle".split()


def language_of(path: Column) -> Column:
    """Language by extension; none for type declarations and unknown ones."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    table = F.create_map(*(F.lit(x) for lang, es in LANGUAGES.items() for e in es.split() for x in (e, lang)))
    return F.when(~path.endswith(".d.ts"), F.try_element_at(table, ext))


def skipped(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda p: p.isin(*SKIPPED))


def read_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(file, text, language) of a folder's sources; files of no bytes have no unit and are not listed."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = F.regexp_replace("path", r"^file:/*", "/")
    at = len(root.removeprefix("file://").rstrip("/")) + 2
    files = raw.select(F.col("content").cast("string").alias("text"), base.alias("_p")).select("text", F.expr(f"substring(_p, {at})").alias("file"))
    return files.where(~skipped(F.col("file"))).withColumn("language", language_of(F.col("file")))


def entry_points(files: DataFrame) -> DataFrame:
    """Files (file, text, language) where a program begins."""
    name, text = F.regexp_extract("file", r"([^/]+)$", 1), F.col("text")
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    py = (F.col("language") == "python") & ((name == "__main__.py") | text.contains('if __name__ == "__main__"') | text.rlike(r"(?m)^\s*def main\s*\("))
    js = F.col("language").isin("javascript", "typescript") & (stem.isin("app", "index", "main", "server") | text.rlike(r"export\s+(?:async\s+function|default)"))
    java = (F.col("language") == "java") & text.contains("public static void main")
    go = (F.col("language") == "go") & text.rlike(r"func\s+main\s*\(")
    return files.where(py | js | java | go)


def entries_first(files: DataFrame) -> DataFrame:
    e = entry_points(files).select("file").distinct().withColumn("is_entry", F.lit(True))
    return files.join(e, "file", "left").na.fill(False, ["is_entry"]).orderBy(F.desc("is_entry"), "file")


def packages(files: DataFrame) -> DataFrame:
    """(file, package): the nearest folder above each file that has a package marker."""
    from keylattice.functions.ids import parent_of

    roots = files.where(F.regexp_extract("file", r"([^/]+)$", 1).isin(*MARKERS)).select(parent_of("file").alias("package")).distinct()
    levels = F.size(F.split("file", "/"))
    up = files.select("file", F.explode(F.sequence(F.lit(0), levels - 1)).alias("n")).withColumn("package", F.when(F.col("n") == 0, ".").otherwise(F.array_join(F.slice(F.split("file", "/"), F.lit(1), F.col("n")), "/")))
    return up.join(F.broadcast(roots), "package").groupBy("file").agg(F.max_by("package", "n").alias("package"))


UNITS = "id string, name string, file_path string, language string, line_start int, line_end int, signature string, fingerprint struct<tokens:array<string>>, is_exported boolean"
EDGES = "source string, target string, type string, fanout int, confidence double"
CLUSTERS = "id int, units array<string>, max_unit_pct double"
GRAPH = (
    "units array<struct<id:string,cluster:string,language:string,confidence:double,tokens:array<string>,class_context:array<string>,line_range:array<int>>>, "
    "edges array<struct<source:string,target:string,key:string,lock:string,confidence:double,type:string>>, "
    "clusters array<struct<id:string,size:int,probability:double,is_hard:boolean,is_cross_file:boolean,files:array<string>,dominant_tokens:array<string>,members:array<string>>>"
)
FUSE = "boundary_clusters array<struct<id:string>>, bridges array<struct<`from`:string,`to`:string,trigger_source:string,trigger_target:string,confidence:double,refused_at_size:int>>"
CACHE_VERSION = 1


def read_units(spark: SparkSession, path: str) -> DataFrame:
    u = spark.read.schema(UNITS).json(path).where("id is not null")
    none = F.array().cast("array<string>")
    return u.select("id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("file_path", F.lit("")).alias("file_path"), F.coalesce("language", F.lit("unknown")).alias("language"), "line_start", "line_end", "signature", F.coalesce("fingerprint.tokens", none).alias("tokens"), F.coalesce("is_exported", F.lit(False)).alias("is_exported"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    e = spark.read.schema(EDGES).json(path).where("source is not null and target is not null")
    return e.na.fill({"type": "call", "fanout": 1, "confidence": 1.0})


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CLUSTERS).json(path).where("id is not null")


def read_graph(spark: SparkSession, path: str, part: str) -> DataFrame:
    """units, edges or clusters of a graph artifact."""
    return spark.read.schema(GRAPH).option("multiLine", True).json(path).select(F.explode(part).alias("x")).select("x.*")


def read_bridges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FUSE).option("multiLine", True).json(path).select(F.explode("bridges").alias("x")).select("x.*")


def read_unresolved(spark: SparkSession, path: str) -> DataFrame:
    """Log of unresolved snippets; broken lines and empty snippets are dropped."""
    schema = "type string, snippet string, unit_id string, language string, scan_run string"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("snippet is not null and trim(snippet) <> ''")


TELEMETRY = "version string, os string, os_version string, event_kind string, repo_id string, repo_size_bucket string, lang_tier_count int, tool_name string, received_at timestamp"


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TELEMETRY).option("mode", "DROPMALFORMED").json(path).where("version is not null")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, parts: int = 8) -> DataFrame:
    """A table of a SQLite file that every machine can reach, read by ranges of row ids, one a task; columns are taken by the schema's names."""
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    quoted = ", ".join('"' + n.replace('"', '""') + '"' for n in names)
    source = '"' + table.replace('"', '""') + '"'

    def run(frames):
        import sqlite3

        import pandas as pd

        for pdf in frames:
            for i in pdf["id"]:
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
                    low, high = con.execute(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM {source}").fetchone()
                    step = -(-(high - low + 1) // parts)
                    cursor = con.execute(f"SELECT {quoted} FROM {source} WHERE rowid >= ? AND rowid < ?", (low + i * step, low + (i + 1) * step))
                    while got := cursor.fetchmany(10_000):
                        yield pd.DataFrame(got, columns=names)

    return spark.range(0, parts, 1, parts).mapInPandas(run, schema)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """A written scan cache; of another version, or none, it is empty."""
    schema = "version int, path string, mtime double, hash string, language string, tokens array<string>"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).where(F.col("version") == CACHE_VERSION)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
