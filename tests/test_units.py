"""Census, matching, clustering and pool on small literal tables, and against sequential models."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from keylattice.functions import vocab
from keylattice.operators import census, cluster, match, pool
from keylattice.plans.saved import save
from keylattice.sources.adapters import complete


def units(spark, rows):
    """Rows: unit_id, tokens, and optionally line, confidence."""
    full = [(i, u, t.split(), (x[0] if x else i * 10), (x[0] if x else i * 10) + 9, "python", x[1] if len(x) > 1 else 1.0) for i, (u, t, *x) in enumerate(rows)]
    return complete(spark.createDataFrame(full, "seq bigint, unit_id string, tokens array<string>, line_start bigint, line_end bigint, language string, confidence double"))


def edges_of(spark, rows, band=None):
    return [tuple(r)[:4] + (r["edge_type"],) for r in match.edges(units(spark, rows), band).collect()]


def test_vocabulary():
    assert len(vocab.TOKENS) == 29 == len(set(vocab.TOKENS)) and len(vocab.PAIRS) == 14 and len(vocab.PLAIN) == 9
    assert sum(p[3] for p in vocab.PAIRS) == 3 and sum(p[4] for p in vocab.PAIRS) == 4
    assert set(vocab.PRIOR) == set(vocab.TOKENS)


def test_basic_pair_and_confidence(spark):
    assert edges_of(spark, [("s.py::R::save", "PERSIST"), ("s.py::R::load", "FETCH")]) == [("s.py::R::load", "s.py::R::save", "FETCH", "PERSIST", 1.0)[:4] + ("HARD",)]
    assert edges_of(spark, [("a::f", "FETCH PERSIST")]) == []
    low = edges_of(spark, [("a.py::f", "FETCH", 0, 0.4), ("b.py::g", "PERSIST", 0, 0.9)])
    assert low[0][4] == "GHOST"


@pytest.mark.parametrize(("a", "b", "found"), [("a.py::C::x", "a.py::C::y", 1), ("a.py::C::x", "a.py::D::y", 0), ("a.py::C::x", "b.py::C::y", 0), ("a.py::C::x", "a.py::y", 1)])
def test_scope_gate(spark, a, b, found):
    assert len(edges_of(spark, [(a, "OUTPUT"), (b, "INTAKE")])) == found


def test_suspension(spark):
    u = units(spark, [("a::f", "FETCH"), ("a::g", "EMIT"), ("a::h", "RAISE"), ("a::i", "SUBSCRIBE")])
    assert {(r["source_id"], r["token"]) for r in match.suspended(u).collect()} == {("a::f", "FETCH")}


def sequential_edges(rows):
    """Pairs in processing order: the first orientation that is met stays."""
    both = [(k, lo, o, k, lo, cs) for o, k, lo, cs, _ in vocab.PAIRS] + [(lo, k, o, k, lo, cs) for o, k, lo, cs, _ in vocab.PAIRS]
    part = lambda u: u.split("::")
    cls = lambda u: part(u)[1] if len(part(u)) == 3 else None
    seen, out = set(), set()
    for i, (u, ts, *_) in enumerate(rows):
        for t in ts.split():
            for token, other, _, key, lock, scoped in both:
                if token != t:
                    continue
                for j, (v, us, *_) in enumerate(rows):
                    if i == j or other not in us.split():
                        continue
                    if scoped and not (part(u)[0] == part(v)[0] and (cls(u) is None or cls(v) is None or cls(u) == cls(v))):
                        continue
                    k = (min(i, j), max(i, j), key, lock)
                    if k not in seen:
                        seen.add(k)
                        out.add((u, v, key, lock) if t == key else (v, u, key, lock))
    return out


def test_edges_against_a_sequential_model(spark):
    r = random.Random(3)
    rows = [(f"f{r.randrange(4)}.py::{r.choice('CD')}::m{i}" if r.random() < 0.7 else f"f{r.randrange(4)}.py::m{i}", " ".join(r.sample(vocab.TOKENS, r.randint(0, 4)))) for i in range(60)]
    assert {e[:4] for e in edges_of(spark, rows)} == sequential_edges(rows)


def test_fan_out_cap_binds(spark):
    rows = [("a::k", "FETCH")] + [(f"b::m{i}", "PERSIST") for i in range(150)]
    assert len(edges_of(spark, rows)) == match.FAN_OUT


def test_census(spark):
    rows = [(f"f{i}.py::m{i}", "INTAKE" + (" ROUTE" if i == 0 else "")) for i in range(600)]
    b = {r["token"]: r for r in census.bands(units(spark, rows)).collect()}
    assert len(b) == 29 and not b["INTAKE"]["used_defaults"]
    assert b["INTAKE"]["unit_count"] == 600 and b["INTAKE"]["band"] == 3 and b["ROUTE"]["band_file"] == 1 and b["TEST"]["file_count"] == 0
    small = {r["token"]: r for r in census.bands(units(spark, rows[:50])).collect()}
    assert all(r["used_defaults"] and r["band"] == vocab.SMALL_BAND[t] for t, r in small.items())


def test_islands(spark):
    u = units(spark, [("a.py::f", "LOG", 1), ("a.py::g", "LOG", 25), ("a.py::h", "LOG", 2000), ("b.py::f", "LOG", 1)])
    assert [r["island"] for r in cluster.islands(u).orderBy("seq").collect()] == [1, 1, 2, 1]
    assert [r["radar"] for r in cluster.islands(u).collect()] == [640] * 4
    roots = {r["unit_id"]: r["root"] for r in cluster.island_clusters(u, cap=1).collect()}
    assert roots == {k: k for k in roots}


def test_cluster_build_and_roles(spark):
    u = units(spark, [("a.py::C::f", "CONTRACT", 1), ("a.py::C::g", "CONTRACT TEST", 20)])
    m = cluster.island_clusters(u)
    c = cluster.cluster_build(m, match.edges(u)).collect()
    assert len(c) == 1 and c[0]["is_hard"] and c[0]["probability"] == 1.0 and c[0]["cluster_id"] == "cluster_a_py_C_f"
    d = spark.createDataFrame([(["TEST", "ROUTE"],), (["PERSIST", "FETCH"],), (["MUTATE"],), (["LOG", "ROUTE"],)], "d array<string>")
    assert [r[0] for r in d.select(cluster.infer_role("d")).collect()] == ["Test Suite", "Data Access / Repository", "General Logic", "API Routing Layer"]
    assert cluster.cluster_names(m).first()["name"] == "C"


def test_capped_components(spark):
    unions = spark.createDataFrame([(0, i, "n0", f"n{i}", 1.0) for i in range(1, 4)] + [(2, 1, "n3", "z", 0.9), (2, 2, "z", "y", 0.9), (2, 3, "y", "n1", 0.9)], "phase int, ord bigint, a string, b string, confidence double")
    members, refused = cluster.capped_components(unions, 4, lambda d: save(d, "t"))
    roots = dict(members.toPandas().values.tolist())
    assert len({roots[f"n{i}"] for i in range(4)}) == 1 and roots["z"] == roots["y"] != roots["n0"]
    assert {(r["trigger_source"], r["trigger_target"], r["refused_at_size"]) for r in refused.collect()} == {("n3", "z", 5), ("y", "n1", 6)}


def test_replay_by_component_equals_one_replay(spark):
    r = random.Random(8)
    rows = [(2, i, f"n{r.randrange(60)}", f"n{r.randrange(60)}", 1.0) for i in range(70)]
    rows = [x for x in rows if x[2] != x[3]]
    want, refused = cluster.replay(pd.DataFrame(rows, columns=["phase", "ord", "a", "b", "confidence"]), 6)
    members, out = cluster.capped_components(spark.createDataFrame(rows, "phase int, ord bigint, a string, b string, confidence double"), 6, lambda d: save(d, "t"))
    assert dict(members.toPandas().values.tolist()) == want
    assert sorted(map(tuple, out.toPandas().values.tolist())) == sorted(refused)


def test_pool(spark):
    empty = spark.createDataFrame([], pool.STATE)
    s = spark.createDataFrame([("a::f", "FETCH", "a::f"), ("a::f", "FETCH", "a::f"), ("b::g", "EMIT", "b::g")], "source_id string, token string, raw_callee string")
    st = pool.ingest(empty, s, 100.0)
    assert st.count() == 2 and pool.ingest(st, s, 200.0).count() == 2
    u = units(spark, [("c::p", "PERSIST"), ("c::q", "PERSIST")])
    e = pool.resurrect(st, u).collect()
    assert [(x["source_id"], x["target_id"], x["edge_type"]) for x in e] == [("a::f", "c::p", "PREDICTED")]
    done = pool.resolve(st, u, 300.0)
    assert pool.stats(done).first().asDict() == {"total": 2, "pending": 1, "resolved": 1, "boundary": 0}
    old = pool.promote_boundaries(done, 100.0 + pool.AGE + 1).collect()
    assert {x["source_id"]: x["boundary"] for x in old} == {"a::f": False, "b::g": True}
    assert pool.ingest(done, s, 400.0).count() == 3  # a resolved reference can be suspended again
    g = pool.odd_groups(st, 160.0).collect()
    assert {x["token"]: x["oldest_age_s"] for x in g} == {"FETCH": 60.0, "EMIT": 60.0}
    assert {x["token"]: x["predicted_lock"] for x in pool.forecast(st).collect()} == {"FETCH": "PERSIST", "EMIT": "SUBSCRIBE"}


def spread(n):
    """Units of many files and classes (some without), with tokens of all scopes in changing orders."""
    tokens = ["FETCH", "PERSIST", "AUTHENTICATE", "ROUTE", "VALIDATE", "INTAKE", "OUTPUT", "EMIT", "SUBSCRIBE", "GUARD"]
    rows = []
    for i in range(n):
        k = (i * 7919) % 1009
        own = [tokens[(k + j * (1 + k % 3)) % len(tokens)] for j in range(2 + k % 3)]
        rows.append((f"f{k % 3}::C{k % 2}::m{i}" if k % 4 else f"f{k % 3}::m{i}", i, own, 0.4 + k % 7 / 10))
    return rows


@pytest.mark.parametrize("scoped", [False, True])
def test_shared_regions_give_the_same_edges(spark, scoped):
    """A region that is dealt out to many tasks has the edges, file pairs and open tokens of one that is not."""
    from keylattice.operators import graph

    u = complete(spark.createDataFrame([(i, unit, t, c) for unit, i, t, c in spread(900)], "seq bigint, unit_id string, tokens array<string>, confidence double"))
    band = spark.createDataFrame([(t, 1 + i % 3) for i, t in enumerate(("AUTHENTICATE", "FETCH", "INTAKE", "ROUTE", "PERSIST", "OUTPUT", "SUBSCRIBE", "X", "EMIT", "VALIDATE", "Y", "GUARD"))], "token string, band int") if scoped else None
    whole = match.edges(u, band, share=10_000)
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(match.edges(u, band, share=40)) == rows(whole) and whole.count() > 1000
    assert rows(match.file_pairs(u, band, share=40)) == rows(graph.file_graph(whole)) and (scoped or graph.file_graph(whole).count() == 3)
    assert rows(match.suspended(u, band, share=40)) == rows(match.suspended(u, band, share=10_000))


def test_matching_joins_and_sorts_no_candidates(spark):
    """One shuffle of units; what it made of them before was a join with a row a candidate, and a shuffle of those."""
    u = complete(spark.createDataFrame([(i, unit, t, c) for unit, i, t, c in spread(50)], "seq bigint, unit_id string, tokens array<string>, confidence double"))
    plan = match.edges(u)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "SortMergeJoin" not in plan and "a_seq" not in plan


def test_pieces_of_whole_components(monkeypatch):
    monkeypatch.setattr(cluster, "PIECE", 4)
    rows = [c for c, n in (("a", 2), ("b", 11), ("c", 1), ("d", 3)) for _ in range(n)]
    frames = [pd.DataFrame({"component": rows[i : i + 3]}) for i in range(0, len(rows), 3)]
    got = [list(p["component"]) for p in cluster._whole_components(iter(frames))]
    assert sum(got, []) == rows and len(got) > 1 and all(not set(x) & set(y) for x, y in zip(got, got[1:]))


def test_components_over_many_pieces_equal_one_replay(spark):
    """Unions of a component in several partitions, so that forests have to be put together."""
    rng = random.Random(3)
    rows = [(rng.choice((0, 2)), i, f"n{x}", f"n{x + rng.choice((1, 2))}", 0.9) for i, x in enumerate(rng.choices([x for x in range(120) if x % 40], k=150))]
    pdf = pd.DataFrame(rows, columns=["phase", "ord", "a", "b", "confidence"])
    roots, refused = cluster.replay(pdf, 4)
    df = spark.createDataFrame(rows, "phase int, ord bigint, a string, b string, confidence double").repartition(5, "ord")
    got, out = cluster.capped_components(df, 4, lambda d: save(d, "t"))
    assert {r["unit_id"]: r["root"] for r in got.collect()} == roots
    assert sorted(tuple(r) for r in out.collect()) == sorted(refused) and refused


def test_clusters_of_carried_roots_equal_joined_ones(spark):
    """Edges that bring their ends' roots along give the same clusters, seams and risks as joins with the members; no row is joined."""
    from keylattice.operators import evaluate

    u = complete(spark.createDataFrame([(i, unit, t, c, i * 300) for unit, i, t, c in spread(200)], "seq bigint, unit_id string, tokens array<string>, confidence double, line_start bigint"))
    m = cluster.island_clusters(u, 3)
    joined, carried = match.edges(u), match.edges(m, carry=("root", "file"))
    rows = lambda d: sorted(map(str, d.collect()))
    for f in (cluster.cluster_graph, cluster.seam_bundles, cluster.seam_units, lambda e, x: cluster.cluster_build(x, e)):
        assert rows(f(carried, m)) == rows(f(joined, m))
    assert rows(evaluate.file_risk(m, cluster.file_seams(carried), carried, m)) == rows(evaluate.file_risk(m, cluster.seam_bundles(joined, m), joined, m))
    assert "Join" not in cluster.cluster_graph(carried, m)._jdf.queryExecution().analyzed().toString().split("MapInArrow")[0]


def test_scan_is_dealt_out(spark):
    """Texts in one small input partition are parsed by as many tasks as there are."""
    from keylattice.operators import scan

    files = spark.createDataFrame([(f"m{i}.py", "def f(a):\n    return a\n", "python") for i in range(64)], "file string, text string, language string").coalesce(1)
    assert scan.scan(files).rdd.getNumPartitions() == 2


def test_units_are_dealt_out_before_they_are_made(spark):
    """The table of one row group gives units to all tasks, in every adapter that matching reads."""
    from keylattice.plans import composites, units as plans

    sf = "/root/testdata/sf0.001"
    for f in (plans.units, plans.day_units, plans.scanned, composites.capped_files):
        assert f(spark, sf).rdd.getNumPartitions() == 2


def test_tokens_are_placed_without_a_row_a_token(spark):
    """Codes by scope: plain, unknown, null and repeated tokens fall away, and so do scopes of no known region."""
    from keylattice.operators import meet

    rows = [(1, "f.py::A::a", "f.py", ["LOG", "FETCH", None, "ROUTE", "FETCH", "X", "EMIT"]), (2, None, None, ["EMIT", "FETCH"]), (3, "g.py::b", "g.py", None), (4, "g.py::c", "g.py", [])]
    u = spark.createDataFrame(rows, "seq bigint, unit_id string, file string, tokens array<string>").selectExpr("*", "'A' as cls", "file as dir3", "1.0d as confidence")
    got = lambda scopes: sorted((r["seq"], r["band"], r["region"], tuple(vocab.TOKENS[c] for c in r["codes"])) for r in match._scoped(u, scopes, []).collect())
    assert got({"FETCH": 1, "ROUTE": 3, "EMIT": 3}) == [(1, 1, "", ("FETCH",)), (1, 3, "f.py", ("ROUTE", "EMIT")), (2, 1, "", ("FETCH",))]
    assert got(None) == [(1, 0, "", ("FETCH", "ROUTE", "EMIT")), (2, 0, "", ("EMIT", "FETCH"))]
    assert [tuple(r) for r in match._large(u, {"FETCH": 1, "ROUTE": 3}, 1).collect()] == [(1, "", 2)]


def small_units(spark, n=900):
    u = complete(spark.createDataFrame([(i, unit, t, c, i * 300) for unit, i, t, c in spread(n)], "seq bigint, unit_id string, tokens array<string>, confidence double, line_start bigint"))
    return u, {t: 1 + i % 3 for i, t in enumerate(("AUTHENTICATE", "FETCH", "INTAKE", "ROUTE", "PERSIST", "OUTPUT", "SUBSCRIBE", "X", "EMIT", "VALIDATE", "Y", "GUARD")) if t in vocab.TOKENS}


@pytest.mark.parametrize("share", [40, 10_000])
def test_counts_of_edges_equal_counted_edges(spark, share):
    """Types by scope and pair without a row an edge, also where a region is dealt out."""
    u, band = small_units(spark)
    rows = lambda d: sorted(map(str, d.collect()))
    for b in (band, None):
        e, n = match.edges(u, b, share=share), match.edge_counts(u, b, share)
        want = e.groupBy("mask", "key_token", "lock_token").agg(*(F.count_if(F.col("edge_type") == t.upper()).alias(t) for t in ("hard", "predicted", "ghost")))
        assert rows(n) == rows(want)
        assert rows(match.counts_summary(n)) == rows(match.edges_summary(e))
    none = match.edge_counts(u.where("false"), band)
    assert match.counts_summary(none).first().asDict() == {"total": 0, "hard": 0, "predicted": 0, "ghost": 0, "pair_kinds": 0}


@pytest.mark.parametrize("share", [40, 10_000])
def test_degrees_and_seam_units_need_no_edges(spark, share):
    """Ends by type of units and of clusters, graph totals and units at seams equal those of edges as rows."""
    from keylattice import sinks

    u, band = small_units(spark)
    m = cluster.island_clusters(u, 3)
    e = match.edges(m, band, carry=("root",), share=share)
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(match.degrees(u, band, share=share).select("unit_id", "degree")) == rows(cluster.unit_degree(e))
    c = cluster.cluster_build(m, match.degrees(m, band, "root", share))
    assert rows(c.drop("hard", "predicted", "ghost")) == rows(cluster.cluster_build(m, e))
    assert rows(sinks.clusters_stats(c)) == rows(sinks.graph_stats(m, e, c))
    assert rows(match.apart(m, band, "root", share)) == rows(cluster.seam_units(e, m))
    gone = cluster.cluster_build(m.where("false"), match.degrees(m.where("false"), band, "root"))
    assert set(sinks.clusters_stats(gone).first().asDict().values()) == {0}


def test_ends_of_unknown_clusters_are_counted(spark):
    """Null is a value of its own, and no unit at a seam."""
    u = units(spark, [("a.py::f", "FETCH"), ("a.py::g", "PERSIST"), ("a.py::h", "PERSIST")]).withColumn("root", F.expr("if(seq < 2, 'r' || seq, null)"))
    assert {(r["root"], r["degree"]) for r in match.degrees(u, None, "root").collect()} == {("r0", 2), ("r1", 1), (None, 1)}
    assert {r["unit_id"] for r in match.apart(u, None, "root").collect()} == {"a.py::f", "a.py::g"}


@pytest.mark.parametrize("share", [40, 10_000])
def test_weak_edges_make_no_rows(spark, share):
    u, band = small_units(spark)
    rows = lambda d: sorted(map(str, d.collect()))
    hard = rows(match.edges(u, band, share=share, least=match.HARD))
    assert hard == rows(match.edges(u, band, share=share).where("edge_type = 'HARD'")) and hard


def test_passes_over_scopes_are_put_together(spark):
    """As when the edges of every pass are compared; a scope that no pass names is left out."""
    u, band = small_units(spark)
    e = match.edges(u, band)
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(match.union_scopes(u, band, (1,), (2,), (3,), (1, 2, 3))) == rows(match.union_edges(*(e.where(F.col("mask") == m) for m in (1, 2, 3)), e))
    assert rows(match.union_scopes(u, band, (3,), (1, 3))) == rows(e.where("mask <> 2"))
    assert "Window" not in match.union_scopes(u, band, (1, 2, 3), (3,))._jdf.queryExecution().optimizedPlan().toString().split("shares")[0]


def test_suspension_outside_scopes_and_regions(spark):
    """Tokens of no scope, and units of no known file, have no partner; carried columns come along without a join."""
    rows = [(1, "f::a", "f", ["FETCH", "ROUTE"]), (2, "f::b", "f", ["PERSIST", "EMIT"]), (3, "x", None, ["FETCH"]), (4, "y", None, ["PERSIST"]), (5, "f::c", "f", ["FETCH", "FETCH"])]
    u = spark.createDataFrame(rows, "seq bigint, unit_id string, file string, tokens array<string>").selectExpr("*", "'A' as cls", "file as dir3", "1.0d as confidence", "seq * 10 as line_start")
    for share in (1, 100):
        s = match.suspended(u, {"FETCH": 3, "PERSIST": 3, "ROUTE": 1}, share, ("line_start",))
        assert sorted((r["source_id"], r["token"], r["line_start"]) for r in s.collect()) == [("f::a", "ROUTE", 10), ("f::b", "EMIT", 20), ("x", "FETCH", 30), ("y", "PERSIST", 40)]


def test_a_node_is_told_once_for_each_piece():
    """However many unions a node has in a piece, it is compared with other pieces once."""
    import pyarrow as pa

    t = pa.table({"a": ["x", "x", "x", "p"], "b": ["y", "z", "y", "q"]})
    rows = pa.Table.from_batches(cluster._grow(t)).to_pylist()
    told = [(r[e], r["local"]) for r in rows for e in ("a", "b") if r[f"new_{e}"]]
    assert len(told) == 5 and {n for n, _ in told} == set("xyzpq") and {dict(told)[n] for n in "xyz"} == {"x"}


def test_file_of_ids(spark):
    from keylattice.functions import ids

    d = spark.createDataFrame([("a.py::C::f",), ("a.py",), ("::f",), ("",), (None,)], "u string")
    assert [r[0] for r in d.select(ids.file_of("u")).collect()] == ["a.py", "a.py", "", "", None]
