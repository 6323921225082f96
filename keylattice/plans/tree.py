"""Queries over a source tree that is generated from ``part``: one file a part in each family of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from keylattice.functions import ids
from keylattice.operators import imports, scan
from keylattice.plans.registry import query
from keylattice.sources import files as sources
from keylattice.sources.adapters import table

#: A file of each language with rules of its own: extension, text, and its units as (class, name, tokens, class tokens, confidence).
SAMPLES: dict[str, tuple[str, str, list[tuple[str | None, str, str, str, float]]]] = {
    "go": (
        "go",
        'type Repo struct {}\n'
        'func (r *Repo) Save(x int) error {\n'
        '\tdefer r.Close()\n'
        '\tif x > 0 { go work() }\n'
        '\tdb.Exec(x)\n'
        '\tch <- x\n'
        '\treturn nil\n'
        '}\n'
        'func Handler(w http.ResponseWriter) { router.HandleFunc("/a", f); log.Println("x") }\n',
        [
            ('Repo', 'Save', 'INTAKE,DEFER,TEARDOWN,CONDITIONAL,ASYNC,PERSIST,EMIT,OUTPUT', '', 0.75),
            (None, 'Handler', 'INTAKE,ROUTE,LOG', '', 0.75),
        ],
    ),
    "java": (
        "java",
        'public class UserService extends BaseRepository implements Runnable {\n'
        '    @Transactional\n'
        '    @GetMapping("/x")\n'
        '    public User find(long id) throws IOException {\n'
        '        try { return repo.findOne(id); } catch (Exception e) { throw new X(); } finally { logger.info("a"); }\n'
        '    }\n'
        '    private void init() { for (int i = 0; i < 3; i++) { list.add(i); } }\n'
        '}\n',
        [
            ('UserService', 'find', 'SCOPE,INTAKE,OUTPUT,FETCH,RECOVER,RAISE,DEFER,LOG', 'PERSIST,ASYNC', 0.75),
            ('UserService', 'init', 'INIT,LOOP,PERSIST', 'PERSIST,ASYNC', 0.75),
        ],
    ),
    "typescript": (
        "ts",
        '@Injectable()\n'
        'export class A extends UserController {\n'
        '  ngOnInit() { this.x = 1; }\n'
        '  @Get()\n'
        '  async list(q: string): Promise<void> {\n'
        '    const r = await this.repo.find(q);\n'
        '    if (!r) { throw new Error(); }\n'
        '    return r;\n'
        '  }\n'
        '}\n'
        'export const handler = async (req) => { bus.emit("x"); };\n',
        [
            ('A', 'ngOnInit', 'INIT,MUTATE', 'ROUTE', 0.95),
            ('A', 'list', 'ROUTE,INTAKE,ASYNC,FETCH,CONDITIONAL,RAISE,OUTPUT', 'ROUTE', 0.75),
            (None, 'handler', 'ASYNC,EMIT', '', 0.75),
        ],
    ),
    "rust": (
        "rs",
        'impl From<A> for B {\n'
        '    #[test]\n'
        '    fn from(a: A) -> Self { let x = parse(a)?; x.await }\n'
        '}\n'
        'pub async fn run(n: u8) { loop { tx.send(n); } }\n',
        [
            ('B', 'from', 'TEST,INTAKE,TRANSFORM,RECOVER,ASYNC', 'TRANSFORM', 0.75),
            (None, 'run', 'INTAKE,ASYNC,LOOP,EMIT', '', 0.75),
        ],
    ),
    "ruby": (
        "rb",
        'class UserController < BaseController\n'
        '  def initialize(a)\n'
        '    @a = a\n'
        '  end\n'
        '  def show\n'
        '    return User.find(1) unless x\n'
        '  rescue Foo\n'
        '    logger.info "x"\n'
        '  end\n'
        'end\n',
        [
            ('UserController', 'initialize', 'INIT,INTAKE', 'ROUTE', 0.95),
            ('UserController', 'show', 'OUTPUT,FETCH,CONDITIONAL,RECOVER,LOG', 'ROUTE', 0.75),
        ],
    ),
    "csharp": (
        "cs",
        'public class A : ControllerBase\n'
        '{\n'
        '    [HttpGet]\n'
        '    public async Task<int> Get(int id)\n'
        '    {\n'
        '        foreach (var x in y) { await repo.Save(x); }\n'
        '        return 1;\n'
        '    }\n'
        '}\n',
        [
            ('A', 'Get', 'ROUTE,INTAKE,ASYNC,LOOP,PERSIST,OUTPUT', 'ROUTE', 0.75),
        ],
    ),
    "php": (
        "php",
        '<?php\n'
        'class A extends UserRepository {\n'
        '    public function __construct($a) { $this->a = $a; }\n'
        '    #[Route("/x")]\n'
        '    public function show() { foreach ($a as $b) { $repo->save($b); } return 1; }\n'
        '}\n',
        [
            ('A', '__construct', 'INIT,INTAKE', 'PERSIST', 0.95),
            ('A', 'show', 'ROUTE,LOOP,PERSIST,OUTPUT', 'PERSIST', 0.75),
        ],
    ),
    "kotlin": (
        "kt",
        'class A : UserListener {\n'
        '    @Test\n'
        '    fun check(x: Int): Int { when (x) { 1 -> launch { repo.save(x) } }\n'
        '        return x\n'
        '    }\n'
        '}\n',
        [
            ('A', 'check', 'TEST,INTAKE,CONDITIONAL,ASYNC,PERSIST,OUTPUT', 'SUBSCRIBE', 0.75),
        ],
    ),
    "scala": (
        "scala",
        'class A extends BaseRepository {\n'
        '  def receive = {\n'
        '    case x => repo.save(x)\n'
        '  }\n'
        '  def size(n: Int) = n match { case 1 => logger.info(n) }\n'
        '}\n',
        [
            ('A', 'receive', 'SUBSCRIBE,PERSIST', 'PERSIST', 0.75),
            ('A', 'size', 'INTAKE,CONDITIONAL,LOG', 'PERSIST', 0.75),
        ],
    ),
    "c": (
        "c",
        'int main(int argc, char **argv) {\n'
        '    char *p = malloc(3);\n'
        '    if (p) printf("x");\n'
        '    return 0;\n'
        '}\n'
        'static void list_free(struct list *l)\n'
        '{\n'
        '    while (l) { free(l); }\n'
        '}\n',
        [
            (None, 'main', 'INIT,INTAKE,FETCH,CONDITIONAL,LOG,OUTPUT', '', 0.75),
            (None, 'list_free', 'TEARDOWN,INTAKE,LOOP', '', 0.75),
        ],
    ),
    "lua": (
        "lua",
        'function M.new(a)\n'
        '  local ok = pcall(f)\n'
        '  if ok then print("x") end\n'
        '  return a\n'
        'end\n',
        [
            (None, 'new', 'INIT,INTAKE,RECOVER,CONDITIONAL,LOG,OUTPUT', '', 0.75),
        ],
    ),
    "elixir": (
        "ex",
        'defmodule A do\n'
        '  use GenServer\n'
        '  def init(x) do\n'
        '    case x do\n'
        '      1 -> Repo.insert(x)\n'
        '    end\n'
        '  end\n'
        'end\n',
        [
            ('A', 'init', 'INIT,INTAKE,CONDITIONAL,PERSIST', 'SUBSCRIBE', 0.75),
        ],
    ),
}
LANGS = list(SAMPLES)


def _key() -> Column:
    return F.col("p_partkey").cast("string")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """(file, text, language): part k has the sample of language k mod 12."""
    rows = spark.createDataFrame([(i, lang, ext, text) for i, (lang, (ext, text, _)) in enumerate(SAMPLES.items())], "i int, language string, ext string, text string")
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % len(LANGS)).cast("int").alias("i"))
    return p.join(F.broadcast(rows), "i").select(F.concat(F.lit("src/f"), _key(), F.lit("."), "ext").alias("file"), "text", "language")


def _sql(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


_UNITS = ", ".join(f"({i}, '{ext}', {_sql(cls)}, '{name}', '{tokens}', '{context}', {c}::DOUBLE)" for i, (ext, _, us) in enumerate(SAMPLES.values()) for cls, name, tokens, context, c in us)


@query(f"""SELECT concat_ws('::', 'src/f' || p_partkey || '.' || ext, cls, name) AS unit_id, tokens, context, confidence
 FROM part JOIN (VALUES {_UNITS}) v(i, ext, cls, name, tokens, context, confidence) ON p_partkey % {len(LANGS)} = i""")
def language_units(spark: SparkSession, sf: str) -> DataFrame:
    """Units of twelve languages by their own rules; what is expected was checked by hand."""
    u = scan.scan(samples(spark, sf))
    return u.select("unit_id", F.array_join("tokens", ",").alias("tokens"), F.array_join("class_context", ",").alias("context"), "confidence")


@query(f"SELECT v.lang AS language, count(*) AS files FROM part JOIN (VALUES {', '.join(f"({i}, '{lang}')" for i, lang in enumerate(LANGS))}) v(i, lang) ON p_partkey % {len(LANGS)} = i GROUP BY 1")
def languages_by_extension(spark: SparkSession, sf: str) -> DataFrame:
    return samples(spark, sf).groupBy(sources.language_of(F.col("file")).alias("language")).agg(F.count("*").alias("files"))


def modules(spark: SparkSession, sf: str) -> DataFrame:
    """Python modules: k imports k // 2 and k + 1, has a route, and every tenth one is a program."""
    k = F.col("p_partkey")
    route = F.when(k % 2 == 0, F.concat(F.lit("@app.route('/r"), _key(), F.lit("', methods=['POST'])\n"))).otherwise(F.concat(F.lit('@api.get("/g'), _key(), F.lit('")\n')))
    text = F.concat(F.lit("import m"), F.floor(k / 2).cast("string"), F.lit("\nfrom m"), (k + 1).cast("string"), F.lit(" import f\n"), route, F.lit("def f(a):\n    return load(a)\n"), F.when(k % 10 == 0, F.lit('if __name__ == "__main__":\n    f(1)\n')).otherwise(F.lit("")))
    return table(spark, sf, "part").select(F.concat(F.lit("m"), _key(), F.lit(".py")).alias("file"), text.alias("text"), F.lit("python").alias("language"))


@query("""WITH e AS (SELECT p_partkey AS s, unnest([p_partkey // 2, p_partkey + 1]) AS d FROM part)
 SELECT DISTINCT 'm' || s || '.py' AS src, 'm' || d || '.py' AS dst FROM e WHERE s <> d AND d IN (SELECT p_partkey FROM part)""")
def import_edges_python(spark: SparkSession, sf: str) -> DataFrame:
    return imports.python_imports(modules(spark, sf))


@query("SELECT 'm' || p_partkey || '.py' AS file, CASE WHEN p_partkey % 2 = 0 THEN 'POST' ELSE 'GET' END AS method, CASE WHEN p_partkey % 2 = 0 THEN '/r' ELSE '/g' END || p_partkey AS path FROM part")
def python_routes(spark: SparkSession, sf: str) -> DataFrame:
    return scan.python_routes(modules(spark, sf))


@query("SELECT 'm' || p_partkey || '.py' AS file FROM part WHERE p_partkey % 10 = 0")
def entry_points(spark: SparkSession, sf: str) -> DataFrame:
    return sources.entry_points(modules(spark, sf)).select("file")


@query("""SELECT 'm' || p_partkey || '.py::f' AS unit_id, array_to_string(['INTAKE', 'OUTPUT', 'SCOPE'], ',') AS tokens, array_to_string(['ROUTE'], ',') AS routed FROM part""")
def python_units(spark: SparkSession, sf: str) -> DataFrame:
    """Units of the modules by their syntax trees; the decorator's token is taken apart."""
    u = scan.scan(modules(spark, sf))
    keep = lambda c: F.array_join(F.filter("tokens", c), ",")
    return u.select("unit_id", keep(lambda t: ~t.isin("ROUTE", "FETCH")).alias("tokens"), keep(lambda t: t == "ROUTE").alias("routed"))


def scripts(spark: SparkSession, sf: str) -> DataFrame:
    """TypeScript files in ten folders: k imports k // 2 and k + 10, and registers routes."""
    k = F.col("p_partkey")
    half = F.floor(k / 2)
    name = lambda n: F.concat(F.lit("d"), (n % 10).cast("string"), F.lit("/c"), n.cast("string"))
    text = F.concat(
        F.lit('import x from "../'), name(half), F.lit("\"\nconst y = require('./c"), (k + 10).cast("string"), F.lit("')\nrouter.post('/w"), _key(), F.lit("', h)\nconsole.get('/no')\napp.use(guard, 1)\n"),
    )
    return table(spark, sf, "part").select(F.concat(F.lit("web/"), name(k), F.lit(".ts")).alias("file"), text.alias("text"), F.lit("typescript").alias("language"))


@query("""WITH e AS (SELECT p_partkey AS s, unnest([p_partkey // 2, p_partkey + 10]) AS d FROM part)
 SELECT DISTINCT 'web/d' || s % 10 || '/c' || s || '.ts' AS src, 'web/d' || d % 10 || '/c' || d || '.ts' AS dst FROM e WHERE s <> d AND d IN (SELECT p_partkey FROM part)""")
def import_edges_js(spark: SparkSession, sf: str) -> DataFrame:
    return imports.js_imports(scripts(spark, sf))


@query("""SELECT 'web/d' || p_partkey % 10 || '/c' || p_partkey || '.ts' AS file, unnest(['POST', 'USE']) AS method, unnest(['/w' || p_partkey, '<dynamic>']) AS path FROM part""")
def js_routes(spark: SparkSession, sf: str) -> DataFrame:
    return scan.js_routes(scripts(spark, sf))


@query("""WITH e AS (SELECT p_partkey AS s, unnest([p_partkey // 2, p_partkey + 1]) AS d FROM part)
 SELECT DISTINCT 'inc/h' || s || '.h' AS src, 'inc/h' || d || '.h' AS dst FROM e WHERE s <> d AND d IN (SELECT p_partkey FROM part)""")
def import_edges_include(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.concat(F.lit('#include "h'), F.floor(k / 2).cast("string"), F.lit('.h"\n  # include "inc/h'), (k + 1).cast("string"), F.lit('.h"\n#include <stdio.h>\n'))
    return imports.include_imports(table(spark, sf, "part").select(F.concat(F.lit("inc/h"), _key(), F.lit(".h")).alias("file"), text.alias("text")))


@query("SELECT 'cmd/g' || p_partkey || '.go' AS src, unnest(['pkg/a' || p_partkey % 7, 'pkg/b']) AS package FROM part")
def import_edges_go(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit('package x\nimport "ex.org/m/pkg/a'), (F.col("p_partkey") % 7).cast("string"), F.lit('"\nimport (\n\t"fmt"\n\tb "ex.org/m/pkg/b"\n)\n'))
    return imports.go_imports(table(spark, sf, "part").select(F.concat(F.lit("cmd/g"), _key(), F.lit(".go")).alias("file"), text.alias("text")), "ex.org/m")


@query("""SELECT 'a' || p_size || '/b/f' || p_partkey || '.py' AS file, CASE WHEN p_size % 3 = 0 THEN 'a' || p_size || '/b' WHEN p_size % 3 = 1 THEN 'a' || p_size ELSE '.' END AS package FROM part""")
def packages(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest folder above a file that has a package marker; the top has one, and two of three folders."""
    p = table(spark, sf, "part")
    own = p.select(F.concat(F.lit("a"), F.col("p_size").cast("string"), F.lit("/b/f"), _key(), F.lit(".py")).alias("file"))
    size = p.select("p_size").distinct().where("p_size % 3 < 2")
    marks = size.select(F.concat(F.lit("a"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 3 == 0, "/b/setup.py").otherwise("/go.mod")).alias("file"))
    every = own.union(marks).union(spark.createDataFrame([("package.json",)], "file string"))
    return sources.packages(every).join(own, "file", "left_semi")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a/b/x' WHEN 1 THEN 'a/x/y' WHEN 2 THEN 'x' ELSE 'a/b' END AS path FROM part""")
def resolve_dotted(spark: SparkSession, sf: str) -> DataFrame:
    """Dotted relative modules, seen from a/b/f.py."""
    m = F.element_at(F.array(*map(F.lit, (".x", "..x.y", "...x", "."))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", imports.resolve_dotted(F.lit("a/b/f.py"), m).alias("path"))


@query("""SELECT unnest(['m' || p_partkey || '/util', 'm' || p_partkey]) AS wanted, unnest(['m' || p_partkey || '/util.py', 'm' || p_partkey || '/__init__.py']) AS file FROM part""")
def longest_prefix_import(spark: SparkSession, sf: str) -> DataFrame:
    """A dotted name is the file of its longest prefix that there is."""
    p = table(spark, sf, "part")
    have = p.select(F.explode(F.array(F.concat(F.lit("m"), _key(), F.lit("/util.py")), F.concat(F.lit("m"), _key(), F.lit("/__init__.py")))).alias("file"))
    want = p.select(F.explode(F.array(F.concat(F.lit("m"), _key(), F.lit(".util.deep.name")), F.concat(F.lit("m"), _key(), F.lit(".other.thing")))).alias("module"))
    got = imports.longest_prefix(want, have)
    return got.select(F.array_join(F.slice(F.split("module", r"\."), 1, F.when(F.col("module").contains("util"), 2).otherwise(1)), "/").alias("wanted"), "file")


@query("""SELECT 'src/f' || p_partkey || '.' || ext AS file, visible FROM part JOIN (VALUES (0, 'go', 'x=1+2'), (1, 'py', 'a=b'), (2, 'sql', 'SELECTFROMt')) v(i, ext, visible) ON p_partkey % 3 = i""")
def strip_noise(spark: SparkSession, sf: str) -> DataFrame:
    """Source with comments and literals blanked, without white space."""
    text = F.element_at(F.array(F.lit("x = 1 /* y = 2 */ + 2 // z\n"), F.lit("a = 'q # r' # c\nb\n"), F.lit("SELECT 'x -- y' FROM t -- done\n")), (F.col("p_partkey") % 3 + 1).cast("int"))
    ext = F.element_at(F.array(*map(F.lit, ("go", "py", "sql"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    f = table(spark, sf, "part").select(F.concat(F.lit("src/f"), _key(), F.lit("."), ext).alias("file"), text.alias("text"))

    def run(frames):
        for x in frames:
            yield x.assign(visible=["".join((scan.strip_noise(t) or "").split()) for t in x.pop("text")])

    return f.mapInPandas(run, "file string, visible string")
