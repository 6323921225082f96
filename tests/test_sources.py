"""Scanning, imports, artifacts, index and context."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from keylattice import sinks
from keylattice.functions import ids, text
from keylattice.operators import context, delta, evaluate, graph, imports, index, scan, web
from keylattice.sources import files as src
from keylattice.streaming import pool_stream

PY = '''
import os
from pkg.store import Store

class Repo(Repository):
    def __init__(self, path):
        self.path = path

    @app.get("/items")
    async def load(self, key):
        for k in key:
            yield await self.store.fetch(k)

    def _hidden(self):
        try:
            raise ValueError()
        finally:
            logger.info("x")

def test_it():
    assert [x for x in range(3)]
'''
JS = "import a from './util'\nconst b = require('../lib/x')\nclass Api {\n  function save(user) {\n    // return\n    store.write(user)\n  }\n}\nrouter.post('/u', h)\nfs.get('/no')\n"


def test_scan_a_tree(spark, tmp_path):
    for name, body in {"pkg/app.py": PY, "pkg/store.py": "class Store: pass\n", "web/api.js": JS, "web/util.ts": "export default 1\n", "lib/x.js": "\n", "node_modules/z.js": JS, "web/t.d.ts": "x", "pkg/setup.py": "\n", "main.go": "func main() {\n return\n}\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    f = src.read_tree(spark, str(tmp_path)).cache()
    assert {r["file"] for r in f.where("language is not null").collect()} == {"pkg/app.py", "pkg/store.py", "pkg/setup.py", "web/api.js", "web/util.ts", "lib/x.js", "main.go"}
    u = {r["unit_id"]: r for r in scan.scan(f).collect()}
    load = u["pkg/app.py::Repo::load"]
    assert {"INTAKE", "ROUTE", "ASYNC", "LOOP", "EMIT", "FETCH"} <= set(load["tokens"]) and load["class_context"] == ["PERSIST"] and load["source"] == "composite"
    assert {"INIT", "MUTATE", "INTAKE"} <= set(u["pkg/app.py::Repo::__init__"]["tokens"])
    assert {"RAISE", "DEFER", "LOG"} <= set(u["pkg/app.py::Repo::_hidden"]["tokens"]) and "SCOPE" not in u["pkg/app.py::Repo::_hidden"]["tokens"]
    assert {"TEST", "GUARD", "TRANSFORM"} <= set(u["pkg/app.py::test_it"]["tokens"])
    save = u["web/api.js::Api::save"]
    assert "PERSIST" in save["tokens"] and "OUTPUT" not in save["tokens"] and "INTAKE" in save["tokens"]
    assert "main.go::main" in u
    assert {tuple(r) for r in imports.python_imports(f).collect()} == {("pkg/app.py", "pkg/store.py")}
    assert {tuple(r) for r in imports.js_imports(f).collect()} == {("web/api.js", "web/util.ts"), ("web/api.js", "lib/x.js")}
    assert {tuple(r) for r in scan.python_routes(f).collect()} == {("pkg/app.py", "GET", "/items")}
    assert {tuple(r) for r in scan.js_routes(f).collect()} == {("web/api.js", "POST", "/u")}
    assert {r["file"] for r in src.entry_points(f).collect()} == {"main.go", "web/util.ts"}
    assert src.entries_first(f).first()["is_entry"]
    assert {r["file"]: r["package"] for r in src.packages(f).collect()}["pkg/app.py"] == "pkg"
    f.unpersist()


def test_strip_noise():
    assert scan.strip_noise('a = "return" # yield\nb /* x\ny */ c // d') .split() == ["a", "=", "b", "c"]
    assert scan.strip_noise('"""a\nb"""').count("\n") == 1 and scan.strip_noise(None) is None


def test_ids(spark):
    d = spark.createDataFrame([("src/a/b/c.py::C::m",), ("x.py::f",), ("lone",)], "u string")
    r = d.select(ids.file_of("u"), ids.class_of("u"), ids.symbol_of("u"), ids.dir3_of(ids.file_of("u"))).collect()
    assert [tuple(x) for x in r] == [("src/a/b/c.py", "C", "m", "src/a/b"), ("x.py", None, "f", "x.py"), ("lone", None, "lone", "lone")]
    n = spark.createDataFrame([("fetchUser_data",), ("get",), ("",), ("_-",)], "n string").select(ids.symbol_tokens("n")).collect()
    assert [x[0] for x in n] == [["data", "fetch", "fetch_user", "fetchuser_data", "user", "user_data"], ["get"], [], ["_-"]]
    p = spark.createDataFrame([("./a/b.py",), (".github\\x",)], "p string").select(ids.normal_path("p")).collect()
    assert [x[0] for x in p] == ["a/b.py", "github/x"]
    t = spark.createDataFrame([(["CONDITIONAL", "INTAKE", "EMIT", "LOOP", "LOG", "DEFER", "OUTPUT"],), (["INTAKE"],)], "t array<string>").select(text.cap_tokens(F.col("t"))).collect()
    assert [x[0] for x in t] == [["EMIT", "DEFER", "LOG", "LOOP", "CONDITIONAL", "OUTPUT"], ["INTAKE"]]


def test_artifacts(spark, tmp_path):
    (tmp_path / "u.jsonl").write_text('{"id":"a","name":"f","fingerprint":{"tokens":["FETCH"]}}\n\n{"name":"no id"}\n{"id":"b"}\n')
    (tmp_path / "e.jsonl").write_text('{"source":"a","target":"b"}\n{"source":"a"}\n')
    (tmp_path / "g.json").write_text(json.dumps({"units": [{"id": "a", "tokens": ["COV.FETCH"], "line_range": [1, 2]}], "edges": [], "clusters": [{"id": "c", "size": 1}]}))
    (tmp_path / "x.jsonl").write_text('{"type":"call","snippet":"cache.get"}\n{broken\n{"type":"call","snippet":" "}\n')
    u = src.read_units(spark, str(tmp_path / "u.jsonl")).orderBy("id").collect()
    assert [(r["id"], r["tokens"], r["language"]) for r in u] == [("a", ["FETCH"], "unknown"), ("b", [], "unknown")]
    assert src.read_edges(spark, str(tmp_path / "e.jsonl")).first().asDict() == {"source": "a", "target": "b", "type": "call", "fanout": 1, "confidence": 1.0}
    assert src.read_graph(spark, str(tmp_path / "g.json"), "clusters").first()["size"] == 1
    assert src.read_unresolved(spark, str(tmp_path / "x.jsonl")).count() == 1
    assert src.read_cache(spark, str(tmp_path / "none")).count() == 0
    cache = spark.createDataFrame([("a.py", 1.0, "h", "python", ["LOG"])], "path string, mtime double, hash string, language string, tokens array<string>")
    sinks.save_cache(cache, str(tmp_path / "cache"))
    assert src.read_cache(spark, str(tmp_path / "cache")).count() == 1
    xml = sinks.graphml(spark.createDataFrame([("a", "x<y")], "id string, label string"), spark.createDataFrame([("a", "a", 2.0)], "source string, target string, weight double"))
    assert "x&lt;y" in xml and 'source="a"' in xml


def test_delta(spark):
    c = spark.createDataFrame([("same", 1.0, "h"), ("touched", 1.0, "h"), ("new", 1.0, "h"), ("gone", 1.0, "h")], "path string, mtime double, hash string")
    f = spark.createDataFrame([("same", 1.0, "h"), ("touched", 2.0, "h"), ("new", 2.0, "i"), ("fresh", 1.0, "h")], "path string, mtime double, hash string")
    assert dict(map(tuple, delta.partition_files(f, c).collect())) == {"same": "cached", "touched": "cached", "new": "dirty", "fresh": "dirty"}
    listed = spark.createDataFrame([("same",)], "path string")
    assert dict(map(tuple, delta.partition_files(f, c, listed).collect()))["same"] == "dirty"
    assert [r["path"] for r in delta.purge_deleted(c, f).collect()] == ["gone"]
    v = spark.createDataFrame([(0,), (1,), (50,), (600,)], "n int").select(delta.drift_verdict(F.col("n"))).collect()
    assert [x[0] for x in v] == ["Stable", "Stable", "Drifting", "Restructured"]


def test_measures(spark):
    rows = lambda p: spark.createDataFrame([(i, p(i), "A" if i < 5 else "B") for i in range(10)], "item int, pred string, truth string")
    swapped = rows(lambda i: "B" if i < 5 else "A")
    assert evaluate.pairwise_prf(swapped).first()["f1"] == 1.0 and evaluate.mojofm(swapped).first()[0] == 1.0
    same = rows(lambda i: "x")
    assert evaluate.pairwise_prf(same).first()["recall"] == 1.0 and evaluate.pairwise_prf(same).first()["precision"] < 0.5


def test_context(spark):
    t = spark.createDataFrame([(1, "Validate the input, then save and store it"), (2, "fix it"), (3, "")], "task_id int, task string")
    r = {x["task_id"]: x for x in context.task_fingerprint(t).collect()}
    assert {"INTAKE", "VALIDATE", "PERSIST"} <= set(r[1]["tokens"].split(",")) and r[1]["status"] == "ok"
    assert r[2]["status"] == r[3]["status"] == "insufficient_signal"
    p = spark.createDataFrame([(1, "look at pkg/api/server.go for the deadlock"), (2, "the whole codebase"), (3, "across packages boundary")], "prompt_id int, prompt string")
    c = {x["prompt_id"]: x for x in context.classify_prompt(p).collect()}
    assert (c[1]["scope"], c[1]["focal_file"], c[2]["scope"], c[3]["scope"]) == ("file", "pkg/api/server.go", "repository", "module")
    g = spark.createDataFrame([(3, 0.6, 0.8), (3, 0.5, 0.5), (3, 0.3, 0.4), (0, 0.9, 0.9), (3, 0.2, 0.9)], "n int, t double, b double")
    assert [x[0] for x in g.select(graph.gate_twins(F.col("n"), F.col("t"), F.col("b"))).collect()] == ["high", "medium", "low", "none", "none"]


def test_index_and_graph(spark):
    e = spark.createDataFrame([("main", "fetch"), ("main", "verify"), ("process", "helper"), ("fetch", "helper"), ("verify", "helper")], "source string, target string").withColumn("type", F.lit("call"))
    assert {r["unit_id"]: r["in_degree"] for r in index.in_degrees(e).collect()}["helper"] == 3
    s = spark.createDataFrame([(x, x) for x in ("main", "fetch", "verify", "process", "helper")], "unit_id string, name string")
    assert [r["unit_id"] for r in index.callers(e, s, "helper").collect()] == ["fetch", "process", "verify"]
    assert [r["unit_id"] for r in index.callees(e, s, "main").collect()] == ["fetch", "verify"]
    g = e.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    d = {r["unit_id"]: r["distance"] for r in graph.impact_neighbors(g, spark.createDataFrame([("main",)], "unit_id string"), 2).collect()}
    assert d == {"main": 0, "fetch": 1, "verify": 1, "helper": 2}
    m = graph.mutual_edges(spark.createDataFrame([("A", "B"), ("B", "A"), ("A", "C")], "src string, dst string")).collect()
    assert [tuple(r) for r in m] == [("A", "B")]
    clique = [(a, b, 1.0) for g in ("abc", "xyz") for a in g for b in g if a < b] + [("c", "x", 0.1)]
    from keylattice.plans.saved import save

    c = dict(map(tuple, graph.louvain(spark.createDataFrame(clique, "a string, b string, weight double"), lambda x: save(x, "t")).collect()))
    assert c["a"] == c["b"] == c["c"] != c["x"] == c["y"] == c["z"]


def test_rate_limit(spark):
    r = spark.createDataFrame([("k", i, t) for i, t in enumerate([0, 10, 20, 30, 605, 611])], "key string, id int, at long")
    assert [x["accepted"] for x in web.rate_limit(r).orderBy("id").collect()] == [True, True, True, False, True, True]


def test_streams(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    first = [(t0, "a", "FETCH", "suspend"), (t0, "b", "EMIT", "suspend"), (t0 + timedelta(minutes=1), "b", "EMIT", "resolve")]
    late = [(t0 + timedelta(days=9), "z", "LOG", "suspend")]
    schema = "ts timestamp, source_id string, token string, action string"
    src_dir = tmp_path / "in"
    for i, rows in enumerate((first, late, [(t0 + timedelta(days=10), "y", "LOG", "suspend")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src_dir))
        stream = pool_stream.pool_lifecycle(spark.readStream.schema(schema).parquet(str(src_dir)))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r["source_id"], r["state"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {("a", "pending"), ("b", "pending"), ("b", "resolved"), ("a", "boundary")} <= got and ("b", "boundary") not in got
