"""Context, reports, artifacts, streams and readers that no SQL covers."""

import json
import random
import sqlite3
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keylattice import sinks
from keylattice.operators import cluster, context, delta, graph, index, match, scan
from keylattice.sources import files as src
from keylattice.sources.adapters import complete
from keylattice.streaming import pool_stream

MEMBERS = [("a.py::f", "a.py", "A", 1, ["FETCH"]), ("a.py::g", "a.py", "A", 2, ["FETCH", "ROUTE"]), ("b.py::h", "b.py", "B", 3, ["PERSIST"]), ("c.py::i", "c.py", "C", 4, ["EMIT"])]
SEAMS = [("A", "B", 7, 0.9), ("C", "A", 3, 0.8), ("B", "C", 2, 0.7)]


@pytest.fixture(scope="module")
def tables(spark):
    m = spark.createDataFrame([(*x, 0.9) for x in MEMBERS], "unit_id string, file string, root string, seq int, tokens array<string>, confidence double")
    s = spark.createDataFrame(SEAMS, "source_cluster string, target_cluster string, edge_count bigint, max_confidence double")
    c = spark.createDataFrame([("A", 2, 0.9, True), ("B", 1, 0.5, False), ("C", 1, 0.4, False)], "root string, size int, probability double, is_hard boolean")
    return m, s, c


def test_context_views(spark, tables):
    m, s, c = tables
    assert [r["root"] for r in context.cluster_of_file(m, c, "a.py").collect()] == ["A"]
    one = context.architecture_summary(c, m, s, "a.").first()
    assert (one["clusters"], one["units"], one["seams"]) == (1, 2, 2)
    whole = context.architecture_summary(c, m, s).first()
    assert (whole["clusters"], whole["units"], whole["seams"]) == (3, 4, 3)
    hit = spark.createDataFrame([("a.py::f",), ("a.py::g",), ("c.py::i",)], "unit_id string")
    assert [(r["root"], r["n"]) for r in context.impact_top_clusters(hit, m).collect()] == [("A", 2), ("C", 1)]
    b = spark.createDataFrame([("A", "B", "a.py::f", "b.py::h", 0.9, 60), ("C", "B", "c.py::i", "b.py::h", 0.95, 55), ("C", "D", "x", "y", 0.99, 70)], "from_root string, to_root string, trigger_source string, trigger_target string, confidence double, refused_at_size int")
    got = context.boundary_edges(b, spark.createDataFrame([("B",)], "root string")).collect()
    assert [r["confidence"] for r in got] == [0.95, 0.9]
    assert {r["part"] for r in sinks.fuse_json(b).collect()} == {"boundary_cluster", "bridge"} and sinks.fuse_json(b.where("false")).count() == 0
    seam = graph.suggest_seam(m, s, "a.py::f").first()
    assert (seam["source_cluster"], seam["target_cluster"]) == ("A", "B")
    assert {r["root"] for r in index.mark_boundary(c, b).where("is_boundary").collect()} == {"A", "B", "C"}


def test_twins_of_a_task(tables):
    m, s, _ = tables
    rows = context.twin_context(m, m, s, ["FETCH", "ROUTE"], 0.6).orderBy("rank").collect()
    assert [(r["unit_id"], r["score"]) for r in rows] == [("a.py::g", 1.0), ("a.py::f", 0.5)]
    assert {(r["gate"], r["status"], r["anchor_unit"], r["related_cluster"]) for r in rows} == {("high", "ready_for_delta_generation", "a.py::g", "B")}
    assert context.twin_context(m, m, s, ["LOG"], 0.6).count() == 0


def test_source_lines(spark):
    f = spark.createDataFrame([("a.py", "1\n2\n3\n4"), ("../x.py", "1")], "file string, text string")
    u = spark.createDataFrame([("a.py::f", "a.py", 2, 3), ("a.py::g", "a.py", 4, 9), ("../x.py::h", "../x.py", 1, 1)], "unit_id string, file string, line_start int, line_end int")
    assert {r["unit_id"]: r["source"] for r in context.read_source(f, u).collect()} == {"a.py::f": "2\n3", "a.py::g": "4"}


def test_merges_by_imports(spark):
    files = spark.createDataFrame([("a.py::x", "a.py", 2), ("a.py::w", "a.py", 1), ("b.py::y", "b.py", 3), ("c.py::z", "c.py", 4)], "unit_id string, file string, seq int")
    e = spark.createDataFrame([("a.py", "b.py"), ("b.py", "a.py"), ("a.py", "c.py"), ("c.py", "gone.py")], "src string, dst string")
    got = cluster.import_merges(files, e, graph.mutual_edges(e)).collect()
    assert [(r["phase"], r["a"], r["b"]) for r in got] == [(1, "a.py::w", "c.py::z")]


def test_merge_order_is_islands_imports_edges(spark):
    m = spark.createDataFrame([("r", "r", 1), ("u", "r", 2)], "unit_id string, root string, seq int")
    e = spark.createDataFrame([("u", "x", "B", 0.9), ("a", "u", "A", 0.9)], "source_id string, target_id string, key_token string, confidence double")
    rows = sorted((r["phase"], tuple(r["ord"]), r["a"], r["b"]) for r in cluster.merge_sequence(m, e).collect())
    assert [(p, a, b) for p, _, a, b in rows] == [(0, "r", "u"), (2, "a", "u"), (2, "u", "x")]
    own = lambda d: d
    got, refused = cluster.capped_components(cluster.merge_sequence(m, e), 3, own)
    assert len({r["root"] for r in got.collect()}) == 2 and [(r["trigger_source"], r["refused_at_size"]) for r in refused.collect()] == [("u", 4)]


def test_probe_caps_against_a_sequential_model(spark):
    """One file of 300 writers and readers: each looks at so many of the others, first come first served."""
    r = random.Random(3)
    rows = [(i, f"big.py::C{r.randrange(2)}::m{i}", [r.choice(["FETCH", "PERSIST", "INTAKE", "OUTPUT"])], 0.9) for i in range(700)]
    u = complete(spark.createDataFrame(rows, "seq int, unit_id string, tokens array<string>, confidence double"))
    band = spark.createDataFrame([(t, 3) for t in ("FETCH", "PERSIST", "INTAKE", "OUTPUT")], "token string, band int")
    other = {"FETCH": "PERSIST", "PERSIST": "FETCH", "INTAKE": "OUTPUT", "OUTPUT": "INTAKE"}
    lists: dict[str, list] = {}
    for i, uid, (t,), _ in rows:
        lists.setdefault(t, [])
        if len(lists[t]) < match.BUCKET_FILE:
            lists[t].append((i, uid))
    steps = lambda n, rows, rest: next((c for least, c in rows if n >= least), rest)
    want, owner = set(), {}
    for i, uid, (t,), _ in rows:
        narrow = t in ("INTAKE", "OUTPUT")
        have = [x for x in lists[other[t]] if not narrow or x[1].split("::")[1] == uid.split("::")[1]]
        cap = steps(len(have), [(260, 120), (220, 140), (180, 160), (140, 180)] if narrow else [(260, 140), (220, 160), (180, 180), (140, 220)], 220 if narrow else 260)
        for j, vid in have[:cap]:
            if frozenset((i, j)) not in owner:
                owner[frozenset((i, j))] = i
    each: dict[int, list] = {}
    for pair, i in owner.items():
        each.setdefault(i, []).append(next(iter(pair - {i})))
    for i, near in each.items():
        want |= {frozenset((i, j)) for j in sorted(near)[: match.FAN_OUT]}
    seq = {uid: i for i, uid, _, _ in rows}
    got = [frozenset((seq[x["source_id"]], seq[x["target_id"]])) for x in match.edges(u, band).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_diff_reports(spark):
    before = spark.createDataFrame([("a::f", "a", ["FETCH"]), ("a::g", "a", ["EMIT"])], "unit_id string, file string, tokens array<string>")
    after = spark.createDataFrame([("a::f", "a", ["FETCH", "LOG"]), ("b::h", "b", ["ROUTE"])], "unit_id string, file string, tokens array<string>")
    d = delta.diff_units(before, after)
    drift, churn = delta.token_drift(d), delta.file_churn(d)
    rows = [(r["part"], json.loads(r["json"])) for r in sinks.diff_json(d, drift, churn).collect()]
    assert sorted(j["unit_id"] + j["status"] for p, j in rows if p == "unit") == ["a::fchanged", "a::gremoved", "b::hadded"]
    assert {j["token"]: (j["gained"], j["lost"]) for p, j in rows if p == "token"} == {"LOG": (1, 0), "ROUTE": (1, 0), "EMIT": (0, 1)}
    assert sinks.diff_text(d, "Stable").split("\n") == ["drift: Stable", "added: 1", "  + b::h", "removed: 1", "  - a::g", "changed: 1", "  ~ a::f"]
    md = sinks.diff_markdown(d, drift, churn, "Stable")
    assert "# Architecture drift: Stable" in md and "| LOG | 1 | 0 |" in md and "| a | 2 |" in md


def test_narration_and_index(spark, tables, tmp_path):
    _, _, c = tables
    names = spark.createDataFrame([("A", "Auth"), ("B", "Base"), ("C", "Core")], "root string, name string")
    roles = spark.createDataFrame([(r, "Router") for r in "ABC"], "root string, role string")
    text = sinks.narration(c, names, roles, 2)
    assert text.split("\n") == ["# Clusters", "- **Auth** - Router, 2 units, hard", "- **Base** - Router, 1 units, soft"]
    i = spark.createDataFrame([("b", "1"), ("a", "2"), ("a", "1")], "token string, unit_id string")
    sinks.write_index({"symbols": i, "units": names}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/symbols").count() == 3 and spark.read.parquet(f"{tmp_path}/units").count() == 3
    sinks.write_evaluation(spark.createDataFrame([("louvain", 3, 0.5)], "method string, n int, f1 double"), spark.createDataFrame([("louvain", "a.py", "1")], "method string, file string, cluster string"), f"{tmp_path}/e")
    assert spark.read.option("header", True).csv(f"{tmp_path}/e/metrics").first()["method"] == "louvain" and spark.read.json(f"{tmp_path}/e/clusterings").first()["file"] == "a.py"


def test_sqlite_tables(spark, tmp_path):
    path = str(tmp_path / "pool.db")
    with sqlite3.connect(path) as con:
        con.execute('CREATE TABLE "odd name" (token TEXT, n INTEGER, at REAL)')
        con.executemany('INSERT INTO "odd name" VALUES (?, ?, ?)', [(f"t{i}", i, i / 2) for i in range(1000)])
        con.execute("CREATE TABLE none (token TEXT)")
    got = src.read_sqlite(spark, path, "odd name", "token string, n bigint, at double", 3)
    assert sorted(tuple(r) for r in got.collect()) == sorted((f"t{i}", i, i / 2) for i in range(1000))
    assert src.read_sqlite(spark, path, "none", "token string").count() == 0


def test_logs(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"version": "1", "os": "linux", "event_kind": "tool_call"}\n{broken\n{"os": "x"}\n')
    assert [r["os"] for r in src.read_telemetry(spark, str(tmp_path / "t.jsonl")).collect()] == ["linux"]
    (tmp_path / "r.csv").write_text("repo,f1\na,0.5\n")
    assert src.read_runs(spark, str(tmp_path / "r.csv")).first()["repo"] == "a"
    sinks.append_unresolved(spark.createDataFrame([("call", "x()"), ("call", " ")], "type string, snippet string"), str(tmp_path / "u"))
    assert src.read_unresolved(spark, str(tmp_path / "u")).count() == 1


def _stream(spark, tmp_path, rows, schema, f, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}-in")
    q = f(spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}-in")).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_streams_of_islands_and_rollups(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(t, "a", 60), (t + timedelta(seconds=50), "a", 60), (t + timedelta(seconds=200), "a", 60), (t + timedelta(days=30), "z", 60)]
    got = _stream(spark, tmp_path, rows, "ts timestamp, file string, radar int", pool_stream.session_islands, "islands")
    assert sorted(r["units"] for r in got if r["file"] == "a") == [1, 2]
    got = _stream(spark, tmp_path, [(t, "x"), (t + timedelta(days=1), "x"), (t + timedelta(days=40), "y")], "ts timestamp, kind string", pool_stream.telemetry_stream, "rollup")
    assert sum(r["events"] for r in got if r["kind"] == "x") == 2


def test_incremental_stream(spark, tmp_path):
    schema = "file string, text string, language string"
    put = lambda name, *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    go = lambda: pool_stream.incremental_scan(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", scan.scan).awaitTermination()
    put("one", ("a.py", "def f(x):\n    return x\n", "python"), ("b.py", "def g():\n    return 1\n", "python"))
    go()
    put("two", ("a.py", "def h(x):\n    raise x\n", "python"))
    go()
    got = {r["unit_id"]: set(r["tokens"]) for r in pool_stream.latest_units(spark, f"{tmp_path}/out").collect()}
    assert set(got) == {"a.py::h", "b.py::g"} and "RAISE" in got["a.py::h"]
    assert F is not None
