"""Operators that compare documents with each other or with a benchmark."""

import random
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa

from keylattice.llm import debruijn, decontam, simhash


def against_sql(df, sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(f"{name}_", t.toArrow())
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_")
    want = con.execute(sql).df()
    got = df.toPandas()[list(want.columns)]
    key = lambda d: sorted(map(str, d.values.tolist()))
    assert key(got) == key(want)
    return got


def test_decontamination(spark, frame, odd, prose):
    bench = [(1, prose(500, 30)), (2, prose(501, 15)), (3, "tiny item"), (4, None), (5, ""), (None, prose(502, 20)), (6, prose(503, 25)), (6, prose(503, 25) + " tail")]
    b = spark.createDataFrame([(*x, "z") for x in bench], "item_id bigint, text string, gram string")
    w = prose(500, 30).split()
    edited = w[:]
    edited[15] = "changed"
    rows = [
        *odd, (100, prose(1, 40) + " " + prose(500, 30) + " " + prose(2, 40)), (101, prose(3, 40) + " " + " ".join(edited) + " x"), (102, " ".join(w[:14]) + " " + prose(4, 50)),
        (103, prose(501, 15).upper().replace(" ", " -- ")), (104, "a tiny, item b"), (105, prose(5, 30) + " " + prose(503, 25)), (105, prose(500, 30)), (None, prose(500, 30)),
    ]
    docs = frame(rows)
    got = against_sql(decontam.find_contamination(docs, b), decontam.SQL, documents=docs.select("doc_id", "text"), benchmark=b)
    pairs = set(zip(got.doc_id, got.item_id))
    assert {(100, 1), (101, 1), (103, 2), (104, 3), (105, 6), (105, 1)} == pairs
    # the way without a broadcast gives the same rows
    again = decontam.find_contamination(docs, b, broadcast_bytes=0).toPandas()
    assert sorted(map(str, again[list(got.columns)].values.tolist())) == sorted(map(str, got.values.tolist()))
    left = decontam.drop_contaminated(docs, b)
    assert left.columns == docs.columns
    assert left.where("doc_id >= 100").select("doc_id").distinct().toPandas().doc_id.tolist() == [102]
    assert left.count() == len(odd) + 2
    assert decontam.find_contamination(docs, b.where("false")).count() == 0
    assert decontam.find_contamination(frame([]), b).count() == 0


def test_best_window_against_brute_force():
    r = random.Random(1)
    for _ in range(300):
        n = r.randint(1, 25)
        pos = sorted(r.choices(range(40), k=n))
        gram = [r.randrange(6) for _ in pos]
        span = r.randint(0, 12)
        best = max((len({g for p, g in zip(pos, gram) if s <= p <= s + span}), -s) for s in pos)
        assert decontam.best_window(np.array(pos), np.array(gram), span) == (best[0], -best[1])


def near_copy(text, edits, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(edits):
        k = r.randrange(len(w))
        w[k] = w[k][::-1]  # as long as the word it replaces
    return " ".join(w)


def test_simhash_finds_copies(frame, odd, prose):
    rows = [*odd, *((100 + i, prose(1000 + i, 150)) for i in range(60))]
    rows += [(200 + i, near_copy(prose(1000 + i, 150), 3, i)) for i in range(30)] + [(300, prose(1000, 150)), (301, prose(1000, 150))]
    docs = frame(rows)
    got = simhash.near_duplicates(docs).toPandas()
    kept = dict(zip(got.doc_id, got.duplicate_of))
    assert sum(kept.get(200 + i) == 100 + i for i in range(30)) >= 28
    assert kept[300] == kept[301] == 100
    assert not set(kept) & {1, 3, 4, 5, 6, 7, 8, *range(100, 160)}
    left = simhash.keep_one(docs)
    assert left.columns == docs.columns
    ids = left.where("doc_id <> 1").toPandas().doc_id.dropna().astype(int).tolist()
    assert left.where("doc_id = 1").count() == 1
    assert len(ids) == len(set(ids)) and {*ids, 1} == {d for d, _ in rows if d is not None} - set(kept)
    assert left.where("doc_id is null").count() == 2
    assert simhash.near_duplicates(frame([])).count() == 0 and simhash.keep_one(frame([])).count() == 0


def test_simhash_search_against_brute_force(spark):
    """All pairs at every distance up to 20: link counts and groups, with parts whole and dealt into blocks."""
    r = np.random.default_rng(5)
    base = r.integers(0, 2, (120, 126))
    flips = [(r.random((120, 126)) < p) for p in (0.05, 0.1, 0.14)]
    exact = base.copy()
    for i in range(120):  # exactly 17 to 21 bits, spread over all segments
        exact[i, r.permutation(126)[: 17 + i % 5]] ^= 1
    even = base[:20].copy()
    even[:, [18 * s + k for s in range(7) for k in (1, 7, 12)][:20]] ^= 1  # three bits in six segments, two in the last
    bits = np.unique(np.concatenate([base, *(base ^ f for f in flips), exact, even]), axis=0)
    pad = np.zeros((len(bits), 1), int)
    halves = [np.packbits(np.hstack([pad, bits[:, a : a + 63]]).astype(np.uint8), axis=1).view(">u8").astype(np.int64)[:, 0] for a in (0, 63)]
    nodes = spark.createDataFrame([(int(a), int(b), i) for i, (a, b) in enumerate(zip(*halves))], "a bigint, b bigint, node bigint")
    near = (bits[:, None, :] != bits[None, :, :]).sum(2) <= 20
    np.fill_diagonal(near, False)
    x, y = np.nonzero(near)
    root = simhash.forest(len(bits), x, y)
    for group_rows, part_rows in ((20_000, 400_000), (10, 400_000), (20_000, 60), (40, 50)):
        got = simhash.linked(nodes, group_rows=group_rows, part_rows=part_rows).toPandas()
        links = got.groupby("node").links.sum()
        assert links.to_dict() == {i: n for i, n in enumerate(near.sum(1)) if n}
        assert simhash.forest(len(bits), got.node.to_numpy(), got.root.to_numpy()).tolist() == root.tolist()


def test_near_duplicates_against_brute_force(frame, odd, prose):
    """Groups, representatives, sizes and links from all pairs of fingerprints."""
    rows = [*odd, *((100 + i, prose(1000 + i, 60)) for i in range(30)), *((200 + i, near_copy(prose(1000 + i % 10, 60), i % 4, i)) for i in range(60)), (200, prose(5000, 60)), (300, prose(1000, 60)), (105, prose(1006, 60))]
    named = sorted({(d, t) for d, t in rows if d is not None and t is not None})
    a, b, ok = simhash.fingerprints(pa.array([t for _, t in named]))
    prints = sorted({(int(p), int(q)) for p, q, o in zip(a, b, ok) if o})
    near = [[i != j and (p[0] ^ q[0]).bit_count() + (p[1] ^ q[1]).bit_count() <= 20 for j, q in enumerate(prints)] for i, p in enumerate(prints)]
    root = simhash.forest(len(prints), *np.nonzero(np.array(near)))
    groups, links = defaultdict(set), {}
    for (d, _), p, q, o in zip(named, a, b, ok):
        if o:
            k = prints.index((int(p), int(q)))
            groups[root[k]].add(d)
            links[root[k], d] = max(links.get((root[k], d), 0), sum(near[k]))
    want = {(d, min(g), len(g), links[k, d]) for k, g in groups.items() for d in g if d != min(g)}
    got = [tuple(r) for r in simhash.near_duplicates(frame(rows)).collect()]
    assert len(got) == len(want) and set(got) == want and len(want) > 50


def test_keep_one_by_text_and_clashing_names(spark, prose):
    """An id with two texts loses neither; names of inner columns don't matter."""
    from pyspark.sql import functions as F

    rows = [(1, prose(1, 50)), (1, prose(2, 50)), (2, prose(1, 50)), (3, prose(3, 50)), (3, prose(3, 50)), (4, ""), (4, ""), (None, prose(1, 50))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for c in ("id_of_row", "MARK_of_row", "fate_of_row", "place_of_row", "__id", "__n", "root", "mark", "a", "b", "node", "n", "first"):
        docs = docs.withColumn(c, F.lit("x"))
    joined = sorted(map(str, simhash.keep_one(docs, broadcast_bytes=0).collect()))
    left = simhash.keep_one(docs)
    assert left.columns == docs.columns and sorted(map(str, left.collect())) == joined
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == sorted([(1, prose(1, 50)), (1, prose(2, 50)), (3, prose(3, 50)), (4, ""), (4, ""), (0, prose(1, 50))])
    assert [(r["doc_id"], r["duplicate_of"]) for r in simhash.near_duplicates(docs).collect()] == [(2, 1)]


def test_fingerprints_against_brute_force(prose):
    from keylattice.llm import textkit as tk

    texts = [prose(1, 40), "the the the house", "", None, "é!"]
    a, b, ok = simhash.fingerprints(pa.array(texts))
    assert ok.tolist() == [True, True, False, False, True]
    for i, t in enumerate(texts):
        w = tk.words(pa.array([t], pa.string()))
        seen = {int(h): int(z - s) for h, s, z in zip(w.hashes, w.starts, w.ends)}
        votes = np.zeros(128, int)
        for h, n in seen.items():
            x = np.array([h], np.uint64)
            both = np.stack([tk.mix(x + tk.U64(0x51ED2701)), tk.mix(x ^ tk.U64(0xA5A5F00D12345678))], axis=1)
            votes += (2 * np.unpackbits(both.view(np.uint8)).astype(int) - 1) * min(max(n - 1, 1), 6)
        want = [int("".join("1" if v > 0 else "0" for v in part), 2) for part in (votes[:63], votes[63:126])]
        assert [int(a[i]), int(b[i])] == want


def test_components(spark):
    r = random.Random(9)
    edges = [(x, y) for x, y in ((r.randrange(300), r.randrange(300)) for _ in range(200)) if x < y] + [(i, i + 1) for i in range(1000, 1080)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for x, y in edges:
        a, b = sorted((find(x), find(y)))
        parent[b] = a
    got = dict(simhash.components(spark.createDataFrame(edges, "x bigint, y bigint")).toPandas().values.tolist())
    groups, want = defaultdict(set), defaultdict(set)
    for n in {n for e in edges for n in e}:
        groups[got[n]].add(n)
        want[find(n)].add(n)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert all(min(v) == k for k, v in groups.items())


def test_repeated_spans(spark, frame, odd, prose):
    p, q = prose(700, 60), prose(701, 55)
    rows = [
        *odd, (100, prose(1001, 70) + " " + p + " " + prose(1002, 30)), (101, p + " " + prose(1003, 30)), (102, prose(1004, 10) + " " + p), (103, p),
        (104, q + " " + prose(1005, 20) + " " + q), (105, prose(1006, 40) + " " + " ".join(p.split()[5:57]) + " zz"), (106, " ".join(p.split()[:50])),
        (107, prose(1007, 300)), (108, near_copy(prose(1007, 300), 2, 1)), (109, p + " " + q), (109, q), (None, p), (110, "ab " * 200),
    ]
    docs = frame(rows)
    got = against_sql(debruijn.repeated_spans(docs), debruijn.SQL, documents=docs.select("doc_id", "text"))
    ids = set(got.doc_id)
    assert {100, 101, 102, 103, 104, 105, 107, 108, 109, 110} <= ids and not ids & {1, 3, 4, 5, 6, 7, 8, 106}
    # the way of hot anchors gives the same rows
    for hot_rows in (2, 5):
        again = debruijn.repeated_spans(docs, hot_rows=hot_rows).toPandas()
        assert sorted(map(str, again[list(got.columns)].values.tolist())) == sorted(map(str, got.values.tolist()))
    own = got[got.doc_id == 100].iloc[0]
    assert (own.start_word, own.end_word) == (70, 130)
    assert debruijn.repeated_spans(frame([])).count() == 0


def test_runs_hold_every_edge_once(prose):
    from keylattice.llm import textkit as tk

    texts = pa.array([prose(1, 200), prose(2, 51), prose(3, 50), None])
    text, start, anchor, content, off, edges = debruijn.runs_of_edges(texts)
    places = [(t, s + i) for t, s, n in zip(text, start, np.diff(off)) for i in range(n - 2)]
    assert sorted(places) == [(0, i) for i in range(150)] + [(1, 0)]
    h, _ = tk.shingles(tk.words(texts), debruijn.K)
    assert [e for a, z in zip(off, off[1:]) for e in edges[a + 1 : z - 1]] == ((h >> tk.U64(33)).astype(np.int32) + 1).tolist()
