"""Index, context, diff, evaluation and row-stream queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from keylattice.functions import ids, text, vocab
from keylattice.operators import cluster, context, delta, evaluate, graph, index, web
from keylattice.plans.registry import query
from keylattice.plans.saved import save
from keylattice.sources.adapters import event_units, event_units_sql, table

CUT = "2024-01-20"
NATION_EDGES = "SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"


# --- symbol index ---------------------------------------------------------------------------------------------------
def symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as symbols: a part's name, in a folder of its type and brand."""
    return table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("unit_id"), F.col("p_name").alias("name"), F.concat_ws("/", F.lit("src"), "p_type", "p_brand").alias("file"), (F.col("p_size") > 25).alias("exported"), F.array(F.col("p_type"), F.col("p_brand")).alias("tokens"))


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """Orders call parts."""
    return table(spark, sf, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"), F.lit("call").alias("type"))


_SYM = "sym AS (SELECT 'p' || p_partkey AS unit_id, p_name AS name, 'src/' || p_type || '/' || p_brand AS file, p_size > 25 AS exported, [p_type, p_brand] AS tokens FROM part)"
_TOKS = r"""list_sort(list_distinct(list_concat(list_concat(w, [lower(name)]), list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]))))"""
_INDEX = rf"""{_SYM}, parts AS (SELECT unit_id, name, list_filter(string_split(regexp_replace(lower(regexp_replace(name, '([a-z])([A-Z])', '\1_\2', 'g')), '[_\-#.:\s]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM sym),
 idx AS (SELECT DISTINCT unnest({_TOKS}) AS token, unit_id FROM parts)"""
_CALLS = "calls AS (SELECT 'o' || l_orderkey AS source, 'p' || l_partkey AS target FROM lineitem)"


@query(f"WITH {_INDEX} SELECT * FROM idx")
def symbol_index(spark: SparkSession, sf: str) -> DataFrame:
    return index.symbol_index(symbols(spark, sf))


@query(f"WITH {_INDEX} SELECT token, count(*) AS frequency FROM idx GROUP BY token")
def planner_caches(spark: SparkSession, sf: str) -> DataFrame:
    return index.frequencies(index.symbol_index(symbols(spark, sf)))


@query(f"WITH {_INDEX} SELECT DISTINCT unit_id FROM idx WHERE token = 'ring'")
def lookup_symbol(spark: SparkSession, sf: str) -> DataFrame:
    return index.lookup(index.symbol_index(symbols(spark, sf)), "ring")


@query(f"WITH {_INDEX} SELECT DISTINCT unit_id FROM idx WHERE token LIKE 'small_r%'")
def search_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return index.prefix(index.symbol_index(symbols(spark, sf)), "small_r")


_RANK = f"""WITH {_INDEX}, {_CALLS}, deg AS (SELECT target AS unit_id, count(*) AS d FROM calls GROUP BY 1), here AS (SELECT file AS cf, tokens AS ct FROM sym WHERE unit_id = 'p0'),
 c AS (SELECT s.*, coalesce(d, 0) AS d, cf, ct, (SELECT count(*) FROM idx WHERE token = 'ring') AS freq FROM sym s LEFT JOIN deg USING (unit_id) CROSS JOIN here WHERE unit_id IN (SELECT unit_id FROM idx WHERE token = 'ring')),
 j AS (SELECT *, len(list_intersect(tokens, ct)) / len(list_distinct(list_concat(tokens, ct))) AS jac, regexp_replace(file, '/[^/]*$', '') AS dir, regexp_replace(cf, '/[^/]*$', '') AS cdir FROM c),
 s AS (SELECT unit_id, name, 1 / (1 + log10(freq)) AS fs, least(1.0, least(d / 10, 1.0) * CASE WHEN exported THEN 1.5 ELSE 1 END) AS cs,
   CASE WHEN file = cf THEN 1.0::DOUBLE WHEN dir = cdir THEN 0.8 WHEN regexp_replace(dir, '/[^/]*$', '') = regexp_replace(cdir, '/[^/]*$', '') THEN 0.5 ELSE 0.1 END AS ls,
   CASE WHEN jac < 0.2 THEN 0.0::DOUBLE ELSE jac END AS js, CASE WHEN dir = cdir THEN 1.2::DOUBLE ELSE 0.8 END AS ps FROM j),
 r AS (SELECT unit_id, name, round(fs * 0.25 + cs * 0.2 + ls * 0.25 + js * 0.15 + ps * 0.15, 6) AS score, concat_ws(', ', CASE WHEN fs > 0.7 THEN 'rare symbol' END, CASE WHEN cs > 0.7 THEN 'popular export' END,
   CASE WHEN ls > 0.8 THEN 'nearby unit' END, CASE WHEN js > 0.5 THEN 'matching behavior' END) AS why FROM s)
 SELECT unit_id, name, score, CASE WHEN why = '' THEN 'general match' ELSE why END AS reasoning FROM r WHERE score >= 0.2 ORDER BY score DESC, unit_id LIMIT 50"""


@query(_RANK)
def planner_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 best parts for "ring", seen from part 0."""
    s, i = symbols(spark, sf), index.symbol_index(symbols(spark, sf))
    here = s.where("unit_id = 'p0'").select(F.col("file").alias("context_file"), F.col("tokens").alias("context_tokens"))
    c = index.lookup(i, "ring").join(s, "unit_id").join(index.in_degrees(calls(spark, sf)), "unit_id", "left").crossJoin(F.broadcast(here)).crossJoin(F.broadcast(index.frequencies(i).where("token = 'ring'").select("frequency")))
    return index.rank(c, 50)


@query(f"WITH {_SYM}, {_CALLS}, e AS (SELECT DISTINCT source, target FROM calls JOIN sym ON target = unit_id WHERE name = 'red widget') SELECT source AS unit_id, target FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY target ORDER BY source) <= 10) ORDER BY target, source LIMIT 10")
def callers(spark: SparkSession, sf: str) -> DataFrame:
    return index.callers(calls(spark, sf), symbols(spark, sf), "red widget")


@query("SELECT DISTINCT 'p' || l_partkey AS source, 'o' || l_orderkey AS unit_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name = 'red widget' ORDER BY 1, 2 LIMIT 10")
def callees(spark: SparkSession, sf: str) -> DataFrame:
    back = calls(spark, sf).select(F.col("target").alias("source"), F.col("source").alias("target"))
    return index.callees(back, symbols(spark, sf), "red widget")


@query(f"WITH {_SYM}, {_CALLS} SELECT target AS unit_id, count(*) AS in_degree FROM calls GROUP BY 1")
def in_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return index.in_degrees(calls(spark, sf))


@query(f"WITH {_SYM} SELECT DISTINCT file FROM sym WHERE file LIKE '%Brand#2'")
def file_match(spark: SparkSession, sf: str) -> DataFrame:
    return index.file_match(symbols(spark, sf), "Brand#2")


@query("SELECT c_mktsegment AS segment, max(c_custkey) AS c_custkey FROM customer GROUP BY 1")
def index_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Insert-or-replace: the last row of each key."""
    return index.last_wins(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"), "c_custkey"), ["segment"], "c_custkey")


@query(f"WITH {_INDEX} SELECT unit_id, min(way)::INT AS way FROM (SELECT unit_id, 0 AS way FROM idx WHERE token = 'ring' UNION ALL SELECT unit_id, 1 FROM sym WHERE contains(unit_id, 'p1')) GROUP BY 1 ORDER BY way, unit_id LIMIT 200")
def search_symbols(spark: SparkSession, sf: str) -> DataFrame:
    s = symbols(spark, sf)
    return context.search_symbols(s, index.lookup(index.symbol_index(s), "ring"), "p1", 200)


@query("SELECT count(*) AS units, count(DISTINCT p_type) AS languages, (SELECT count(*) FROM lineitem) AS edges FROM part")
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "part").agg(F.count("*").alias("units"), F.countDistinct("p_type").alias("languages"))
    return u.crossJoin(table(spark, sf, "lineitem").agg(F.count("*").alias("edges")))


@query("""SELECT p_partkey, 'src/' || p_type AS package, CASE WHEN contains('src/' || p_type || '/' || p_brand, '/') THEN regexp_replace('src/' || p_type || '/' || p_brand, '/[^/]*$', '') ELSE '.' END AS parent,
 'src/' || p_type || '/' || p_brand AS dir3, regexp_replace('../src/' || p_type, '^[./]+', '') AS normal FROM part""")
def package_layout(spark: SparkSession, sf: str) -> DataFrame:
    f = F.concat_ws("/", F.lit("src"), "p_type", "p_brand")
    return table(spark, sf, "part").select("p_partkey", ids.package_of(f).alias("package"), ids.parent_of(f).alias("parent"), ids.dir3_of(f).alias("dir3"), ids.normal_path(F.concat(F.lit("../src/"), "p_type")).alias("normal"))


# --- graphs ---------------------------------------------------------------------------------------------------------
def nation_edges(spark: SparkSession, sf: str) -> DataFrame:
    li, o, c, s = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "supplier"))
    j = li.select("l_orderkey", "l_suppkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct()


@query(f"WITH e AS ({NATION_EDGES}) SELECT DISTINCT least(a.src, a.dst) AS a, greatest(a.src, a.dst) AS b FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst")
def mutual_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.mutual_edges(nation_edges(spark, sf))


@query("""WITH RECURSIVE e AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem),
 r AS (SELECT 's0' AS unit_id, 0 AS distance UNION SELECT dst, distance + 1 FROM r JOIN e ON src = unit_id WHERE distance < 2) SELECT unit_id, min(distance)::INT AS distance FROM r GROUP BY 1""")
def impact_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    """Parts and suppliers within two hops of supplier 0."""
    e = table(spark, sf, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    return graph.impact_neighbors(e, spark.createDataFrame([("s0",)], "unit_id string"), 2)


@query("""WITH RECURSIVE s AS (SELECT event_id AS b, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM events), e AS (SELECT a, b FROM s WHERE a IS NOT NULL UNION SELECT b, a FROM s WHERE a IS NOT NULL),
 r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY 1""")
def components(spark: SparkSession, sf: str) -> DataFrame:
    """Events linked with the user's event before."""
    from pyspark.sql import Window

    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf, "events").select(F.col("event_id").alias("b"), before.alias("a")).where("a is not null")
    return cluster.components(e, lambda d: save(d, "labels"))


@query()
def louvain(spark: SparkSession, sf: str) -> DataFrame:
    """Communities of users and event types, weighted by events."""
    e = table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("a"), F.col("event_type").alias("b"), F.lit(1.0).alias("weight"))
    return graph.louvain(e, lambda d: save(d, "labels"))


_U = f"u AS (SELECT * FROM {event_units_sql()})"


@query(f"""WITH {_U}, s AS (SELECT unit_id, confidence, len(list_intersect(tokens, ['FETCH', 'OUTPUT', 'ROUTE']))::INT AS shared, len(list_distinct(list_concat(tokens, ['FETCH', 'OUTPUT', 'ROUTE']))) AS n FROM u)
 SELECT unit_id, round(shared / n, 4) AS score, shared, confidence FROM s WHERE round(shared / n, 4) >= 0.25 ORDER BY score DESC, shared DESC, confidence DESC, unit_id DESC LIMIT 25""")
def behavioral_twins(spark: SparkSession, sf: str) -> DataFrame:
    return graph.behavioral_twins(event_units(table(spark, sf, "events")), F.array(*map(F.lit, ("FETCH", "OUTPUT", "ROUTE"))), 25)


_SEEDS = ("g3/u3::click::none", "g1/u1", "77", "view::1", "nothing")


@query(f"""WITH {_U}, q AS (SELECT unnest({list(_SEEDS)}) AS query), k AS (SELECT query, unit_id, CASE WHEN unit_id = query THEN 0 WHEN file = query THEN 1 WHEN ends_with(lower(unit_id), '::' || query) THEN 2 WHEN contains(lower(unit_id), query) THEN 3 END::INT AS kind FROM u, q)
 SELECT query, unit_id, kind FROM k WHERE kind IS NOT NULL QUALIFY kind = min(kind) OVER (PARTITION BY query)""")
def resolve_seed_units(spark: SparkSession, sf: str) -> DataFrame:
    """Seeds by file, by symbol and by substring, and two that name nothing."""
    u, out = event_units(table(spark, sf, "events")), None
    for q in _SEEDS:
        one = graph.resolve_seeds(u, q).select(F.lit(q).alias("query"), "unit_id", "kind")
        out = one if out is None else out.union(one)
    return out


# --- diff and incremental -------------------------------------------------------------------------------------------
def scans(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two scans that overlap: events up to the cut, and events from ten days before it with another routing rule."""
    e = table(spark, sf, "events")
    return event_units(e.where(F.col("ts") < F.lit(CUT).cast("timestamp"))), event_units(e.where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp")), 150)


_DIFF = f"""b AS (SELECT * FROM {event_units_sql(f"ts < TIMESTAMP '{CUT}'")}), a AS (SELECT * FROM {event_units_sql("ts >= TIMESTAMP '2024-01-10'", 150)}),
 d AS (SELECT unit_id, coalesce(b.file, a.file) AS file, CASE WHEN b.unit_id IS NULL THEN 'added' WHEN a.unit_id IS NULL THEN 'removed' WHEN list_sort(a.tokens) <> list_sort(b.tokens) THEN 'changed' END AS status,
   coalesce(b.tokens, []) AS old, coalesce(a.tokens, []) AS new FROM b FULL JOIN a USING (unit_id)), diff AS (SELECT * FROM d WHERE status IS NOT NULL)"""


@query(f"WITH {_DIFF} SELECT unit_id, file, status FROM diff")
def diff_units(spark: SparkSession, sf: str) -> DataFrame:
    return delta.diff_units(*scans(spark, sf)).select("unit_id", "file", "status")


@query(f"""WITH {_DIFF}, rb AS (SELECT unit_id FROM b WHERE list_contains(tokens, 'ROUTE')), ra AS (SELECT unit_id FROM a WHERE list_contains(tokens, 'ROUTE'))
 SELECT unit_id, 'added' AS status FROM ra ANTI JOIN rb USING (unit_id) UNION ALL SELECT unit_id, 'removed' FROM rb ANTI JOIN ra USING (unit_id)""")
def diff_routes(spark: SparkSession, sf: str) -> DataFrame:
    return delta.diff_routes(*scans(spark, sf))


@query(f"""WITH {_DIFF}, x AS (SELECT unnest(list_filter(new, lambda t: NOT list_contains(old, t))) AS token, 1 AS g, 0 AS l FROM diff UNION ALL SELECT unnest(list_filter(old, lambda t: NOT list_contains(new, t))), 0, 1 FROM diff)
 SELECT token, sum(g)::BIGINT AS gained, sum(l)::BIGINT AS lost FROM x GROUP BY 1""")
def token_drift(spark: SparkSession, sf: str) -> DataFrame:
    return delta.token_drift(delta.diff_units(*scans(spark, sf)))


@query(f"WITH {_DIFF} SELECT file, count(*) AS changes, CASE WHEN count(*) < 5 THEN 'Stable' WHEN count(*) < 200 THEN 'Drifting' ELSE 'Restructured' END AS verdict FROM diff GROUP BY 1")
def file_churn(spark: SparkSession, sf: str) -> DataFrame:
    return delta.file_churn(delta.diff_units(*scans(spark, sf))).withColumn("verdict", delta.drift_verdict(F.col("changes")))


@query("SELECT lang AS language, count(*) AS before, count(*) FILTER (n_chars > 1000) AS after FROM documents GROUP BY 1")
def language_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("lang").alias("language"), "n_chars")
    return delta.language_counts(d, d.where("n_chars > 1000"))


_FILES = "f AS (SELECT p_name || p_partkey AS path, p_size::DOUBLE AS mtime, p_brand AS hash FROM part), c AS (SELECT p_name || p_partkey AS path, p_size + (p_size > 30)::INT AS m, CASE WHEN p_size > 40 THEN 'new' ELSE p_brand END AS h FROM part WHERE p_size > 5)"


def _files(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf, "part").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("path"), "p_size", "p_brand")
    cache = p.where("p_size > 5").select("path", (F.col("p_size") + (F.col("p_size") > 30).cast("int")).cast("double").alias("mtime"), F.when(F.col("p_size") > 40, "new").otherwise(F.col("p_brand")).alias("hash"))
    return p.select("path", F.col("p_size").cast("double").alias("mtime"), F.col("p_brand").alias("hash")), cache


@query(f"WITH {_FILES} SELECT path, CASE WHEN c.path IS NULL THEN 'dirty' WHEN mtime = m OR hash = h THEN 'cached' ELSE 'dirty' END AS state FROM f LEFT JOIN c USING (path)")
def incremental_partition(spark: SparkSession, sf: str) -> DataFrame:
    return delta.partition_files(*_files(spark, sf))


@query(f"WITH {_FILES} SELECT path FROM c WHERE path NOT IN (SELECT path FROM f WHERE mtime < 20)")
def purge_deleted(spark: SparkSession, sf: str) -> DataFrame:
    f, c = _files(spark, sf)
    return delta.purge_deleted(c, f.where("mtime < 20")).select("path")


# --- evaluation -----------------------------------------------------------------------------------------------------
_CLUS = "c AS (SELECT c_custkey AS item, c_mktsegment AS pred, r_name AS truth FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), cell AS (SELECT pred, truth, count(*) AS n FROM c GROUP BY ALL)"


def _clusterings(spark: SparkSession, sf: str) -> DataFrame:
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    return c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("c_custkey").alias("item"), F.col("c_mktsegment").alias("pred"), F.col("r_name").alias("truth"))


@query(f"""WITH {_CLUS}, s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM cell) AS tp, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM cell GROUP BY pred)) AS pp, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM cell GROUP BY truth)) AS tt),
 x AS (SELECT tp / pp AS p, tp / tt AS r FROM s) SELECT round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / (p + r), 4) AS f1 FROM x""")
def pairwise_prf(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.pairwise_prf(_clusterings(spark, sf))


@query(f"""WITH {_CLUS}, t AS (SELECT pred, truth, n, sum(n) OVER (PARTITION BY pred) AS size FROM cell QUALIFY row_number() OVER (PARTITION BY pred ORDER BY n DESC, truth) = 1)
 SELECT round(1 - (sum(size - n) + count(*) - count(DISTINCT truth)) / (sum(size) - (SELECT max(n) FROM (SELECT sum(n) AS n FROM cell GROUP BY truth))), 4)::DOUBLE AS mojofm FROM t""")
def mojofm(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.mojofm(_clusterings(spark, sf))


@query("SELECT DISTINCT 'src/' || p_type || '/' || p_brand AS file, CASE WHEN p_type = 'ECONOMY' THEN 'src/' || p_type || '/' || p_brand ELSE 'src/' || p_type END AS truth FROM part")
def ground_truth_layout(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.layout_clusters(symbols(spark, sf), 2, ("src/ECONOMY",))


@query("""SELECT event_type, max(value) FILTER (i = round_even((n - 1) * 0.5, 0)) AS p50, max(value) FILTER (i = round_even((n - 1) * 0.95, 0)) AS p95, round(avg(value), 6) AS avg, max(value) AS max
 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1""")
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.nearest_rank(table(spark, sf, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


_MODES = "m AS (SELECT o_orderpriority AS repo, unnest(list_concat(['all'], CASE WHEN o_totalprice > 200000 THEN ['large'] ELSE [] END)) AS mode, o_totalprice AS value FROM orders)"


@query(f"WITH {_MODES} SELECT '*' AS repo, mode, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM m GROUP BY mode UNION ALL SELECT repo, mode, count(*), round(avg(value), 6), round(median(value), 6) FROM m GROUP BY repo, mode")
def validation_rollup(spark: SparkSession, sf: str) -> DataFrame:
    big = F.when(F.col("o_totalprice") > 200000, F.array(F.lit("large"))).otherwise(F.array().cast("array<string>"))
    return evaluate.rollup(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("repo"), F.concat(F.array(F.lit("all")), big).alias("modes"), F.col("o_totalprice").alias("value")))


@query("SELECT event_type AS name, round(sum(value) FILTER (ts < TIMESTAMP '2024-01-15') / sum(value) FILTER (ts >= TIMESTAMP '2024-01-15'), 4) AS speedup FROM events GROUP BY 1")
def compare_benchmarks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    one = lambda d: d.groupBy(F.col("event_type").alias("name")).agg(F.sum("value").alias("seconds"))
    return evaluate.compare_runs(one(e.where("ts < timestamp '2024-01-15'")), one(e.where("ts >= timestamp '2024-01-15'")))


@query(r"SELECT doc_id, least(1.0, len(regexp_extract_all(text, '(?m)^.*(?:token|@mail).*$')) * 0.25)::DOUBLE AS bonus, round(100 * (contains(text, '@')::INT + contains(text, chr(10))::INT + contains(text, 'the')::INT) / 3, 1) AS rubric FROM documents")
def rubric_score(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", evaluate.relaxed_score(F.col("text"), "token|@mail", 0.25, 1.0).alias("bonus"), evaluate.rubric(F.col("text"), {"a": "@", "b": "\n", "c": "the"}).alias("rubric"))


# --- task text ------------------------------------------------------------------------------------------------------
def _term_sql(term: str) -> str:
    # a word counts where neither a backslash nor the letter w touches it
    return f"contains(low, '{term}')" if " " in term else rf"regexp_matches(low, '(?:^|[^\\w]){term}(?:[^\\w]|$)')".replace(r"[^\\w]", r"[^\x5cw]")


def _count_sql(spec: str) -> str:
    return " + ".join(f"({_term_sql(t)})::INT" for t in vocab.terms(spec))


_TASK = f"""WITH t AS (SELECT conv_id * 100 + turn AS task_id, lower(trim(text)) || ' ' || role || ' request: validate input, save it, then update' AS low FROM conversations),
 h AS (SELECT task_id, {_count_sql(vocab.VAGUE_TERMS)} AS vague, list_filter([{', '.join(f"struct_pack(n := {_count_sql(v)}, token := '{k}')" for k, v in vocab.TASK_TERMS.items())}], lambda x: x.n > 0) AS h FROM t),
 b AS (SELECT task_id, vague, list_reverse_sort(h)[1:8] AS best, list_sum(list_transform(h, lambda x: x.n)) AS evidence FROM h),
 c AS (SELECT task_id, best, round(greatest(0.05::DOUBLE, least(0.95::DOUBLE, CASE WHEN len(best) > 0 THEN 0.28::DOUBLE + 0.08::DOUBLE * len(best) + 0.05::DOUBLE * (evidence / len(best)) ELSE 0.1::DOUBLE END - CASE WHEN vague > 0 AND len(best) <= 2 THEN 0.12::DOUBLE ELSE 0 END)), 2) AS confidence FROM b)
 SELECT task_id, array_to_string(list_transform(best, lambda x: x.token), ',') AS tokens, confidence, CASE WHEN len(best) = 0 OR confidence < 0.35 THEN 'insufficient_signal' WHEN confidence < 0.55 THEN 'ambiguous' ELSE 'ok' END AS status FROM c"""


@query(_TASK)
def task_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return context.task_fingerprint(c.select((F.col("conv_id") * 100 + F.col("turn")).alias("task_id"), F.concat(F.lower(F.trim("text")), F.lit(" "), "role", F.lit(" request: validate input, save it, then update")).alias("task")))


@query(r"""WITH p AS (SELECT doc_id AS prompt_id, lower(trim(text)) AS low FROM documents), n AS (SELECT prompt_id, regexp_matches(low, 'across packages|architecture|blast radius|boundary|cross-package|module') AS m,
 regexp_matches(low, 'contract|implements|interface|mock|satisfies|satisfy') AS i FROM p) SELECT prompt_id, m AS module, i AS interfaces FROM n""")
def prompt_signals(spark: SparkSession, sf: str) -> DataFrame:
    c = context.classify_prompt(table(spark, sf, "documents").select(F.col("doc_id").alias("prompt_id"), F.col("text").alias("prompt")))
    has = lambda x: F.array_contains(F.split("signals", ","), x)
    return c.select("prompt_id", has("module").alias("module"), has("interfaces").alias("interfaces"))


@query("""SELECT event_id, round(greatest(0, least(1, 0.4::DOUBLE * (user_id / 150) + 0.4::DOUBLE * (1 - value / 500) + 0.2::DOUBLE * (user_id / 300) + CASE WHEN event_type = 'error' THEN 0.25::DOUBLE ELSE 0 END)), 3)::DOUBLE AS gain FROM events""")
def confidence_gain(spark: SparkSession, sf: str) -> DataFrame:
    g = context.confidence_gain(F.col("user_id") / 150, F.col("value") / 500, F.col("user_id") / 300, F.col("event_type") == "error")
    return table(spark, sf, "events").select("event_id", g.alias("gain"))


@query("""WITH s AS (SELECT event_id, user_id % 5 AS n, value / 500 AS t, value / 490 AS b FROM events) SELECT event_id, CASE WHEN n = 0 OR t < 0.25 OR b < 0.25 THEN 'none' WHEN b >= 0.7 AND t >= 0.55 THEN 'high' WHEN b >= 0.5 AND t >= 0.45 THEN 'medium' WHEN b >= 0.35 THEN 'low' ELSE 'none' END AS gate FROM s""")
def gate_twin_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", graph.gate_twins(F.col("user_id") % 5, F.col("value") / 500, F.col("value") / 490).alias("gate"))


_WORDS_SQL = ", ".join(rf"CASE WHEN regexp_matches(text, '(?:^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(w.split())})(?:$|[^\p{{L}}\p{{N}}_])') THEN '{t}' END" for t, _, w in vocab.BODY_WORDS)
_CONF_SQL = ", ".join(rf"CASE WHEN regexp_matches(text, '(?:^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(w.split())})(?:$|[^\p{{L}}\p{{N}}_])') THEN {c} END" for _, c, w in vocab.BODY_WORDS)


@query(rf"""WITH b AS (SELECT doc_id, list_filter([{_WORDS_SQL}], lambda x: x IS NOT NULL) AS hits, least({_CONF_SQL})::DOUBLE AS confidence FROM documents),
 x AS (SELECT doc_id, confidence, list_filter({list(dict.fromkeys(t for t, _, _ in vocab.BODY_WORDS))}, lambda t: list_contains(hits, t)) AS kept FROM b) SELECT doc_id, array_to_string(kept, ',') AS tokens, confidence FROM x""")
def body_pattern_tokens(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text", text.rule_words(F.col("text")).alias("found"))
    body, found = F.col("text"), F.col("found")
    return d.select("doc_id", F.array_join(text.body_tokens(body, found), ",").alias("tokens"), text.body_confidence(body, found).alias("confidence"))


_EXT = " ".join(rf"WHEN regexp_matches(text, '(?i){p}') THEN '{n}'" for n, p in vocab.EXTENSIONS)


@query(rf"""WITH s AS (SELECT text, CASE {_EXT} END AS token_name FROM (SELECT role || ' cache retry ' || turn AS text FROM conversations UNION ALL SELECT 'batch ' || role FROM conversations)),
 g AS (SELECT token_name, count(*) AS evidence, array_to_string(list_sort(list_distinct(list(text)))[1:5], ' | ') AS examples FROM s WHERE token_name IS NOT NULL GROUP BY 1 HAVING count(*) >= 2)
 SELECT token_name, evidence, round(CASE WHEN token_name = 'MEMOIZE' THEN least(0.92, least(0.85, 0.5 + 0.04 * evidence) + 0.1) ELSE least(0.85, 0.5 + 0.04 * evidence) END, 3)::DOUBLE AS confidence, true AS in_zone, 'PROMOTE' AS action, examples FROM g WHERE 0.5 + 0.04 * evidence >= 0.6""")
def curator_candidates(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    s = c.select(F.concat_ws(" cache retry ", "role", F.col("turn").cast("string")).alias("snippet")).union(c.select(F.concat(F.lit("batch "), "role")))
    return context.curator_candidates(s, spark.createDataFrame([("FETCH", 5)], "token string, n int"))


# --- web and conversations ------------------------------------------------------------------------------------------
@query(r"""WITH r AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages) SELECT page_id, 'GET' AS method, path FROM r WHERE length(path) > 1""")
def route_manifest(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", text.route_segment(F.concat(F.lit("get:"), F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1))).alias("r"))
    return p.where("r.method is not null").select("page_id", "r.method", "r.path")


@query("SELECT event_type AS path, count(*) AS views FROM events GROUP BY 1 ORDER BY 2 DESC, 1")
def pageview_summary(spark: SparkSession, sf: str) -> DataFrame:
    return web.pageviews(table(spark, sf, "events").select(F.col("event_type").alias("path")))


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def newest_views(spark: SparkSession, sf: str) -> DataFrame:
    return web.newest(table(spark, sf, "events").select("event_id", "ts"), "ts", "event_id")


@query("SELECT user_id AS key, event_id AS id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts))::BIGINT RANGE BETWEEN 599 PRECEDING AND CURRENT ROW) AS n FROM events")
def trailing_requests(spark: SparkSession, sf: str) -> DataFrame:
    return web.trailing_count(table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.unix_timestamp(F.date_trunc("second", "ts")).alias("at")))


@query("""WITH RECURSIVE o AS (SELECT user_id AS key, event_id AS id, sec, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS rn FROM (SELECT user_id, event_id, epoch(date_trunc('second', ts))::BIGINT AS sec FROM events)),
 r AS (SELECT key, id, rn, true AS accepted, [sec] AS kept FROM o WHERE rn = 1
   UNION ALL SELECT key, id, rn, len(f) < 3, CASE WHEN len(f) < 3 THEN list_append(f, sec) ELSE f END FROM (SELECT o.key, o.id, o.rn, o.sec, list_filter(r.kept, lambda x: o.sec - x < 86400) AS f FROM r JOIN o ON o.key = r.key AND o.rn = r.rn + 1))
 SELECT key, id, accepted FROM r""")
def sliding_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Three accepted events a user in any day."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.unix_timestamp(F.date_trunc("second", "ts")).alias("at"))
    return web.rate_limit(e, window_s=86400)


@query("SELECT conv_id, lower(string_agg(text, chr(10) ORDER BY turn, text)) AS text FROM conversations WHERE role = 'assistant' GROUP BY 1")
def assistant_text(spark: SparkSession, sf: str) -> DataFrame:
    return web.assistant_text(table(spark, sf, "conversations"))


@query("SELECT role AS run, bool_or(turn > 3) AS used FROM conversations GROUP BY 1")
def detect_tool_use(spark: SparkSession, sf: str) -> DataFrame:
    line = F.to_json(F.struct(F.when(F.col("turn") > 3, "tool_use").otherwise("text").alias("type"), F.lit("scan_units").alias("name")))
    return web.tool_use(table(spark, sf, "conversations").select(F.col("role").alias("run"), line.alias("line")), "scan_")


@query("""WITH e AS (SELECT event_id, 'v' || user_id AS version, CASE WHEN user_id < 100 THEN 'linux' WHEN user_id < 140 THEN 'plan9' ELSE '' END AS os, CASE WHEN event_type = 'view' THEN 'tool_call' ELSE event_type END AS kind, substr(md5(user_id::VARCHAR), 1, CASE WHEN value > 50 THEN 12 ELSE 11 END) AS repo FROM events)
 SELECT event_id, CASE WHEN os = '' THEN 'missing os' WHEN os = 'plan9' THEN 'invalid os' WHEN kind NOT IN ('mcp_start', 'tool_call') THEN 'invalid event_kind' WHEN NOT regexp_full_match(repo, '[a-f0-9]{12}') THEN 'invalid repo_id' END AS reason FROM e""")
def schema_validate(spark: SparkSession, sf: str) -> DataFrame:
    u, none = F.col("user_id"), F.lit(None)
    repo = F.md5(u.cast("string"))
    reason = text.telemetry_error(F.concat(F.lit("v"), u.cast("string")), F.when(u < 100, "linux").when(u < 140, "plan9").otherwise(""), F.when(F.col("event_type") == "view", "tool_call").otherwise(F.col("event_type")), F.when(F.col("value") > 50, F.substring(repo, 1, 12)).otherwise(F.substring(repo, 1, 11)), none.cast("string"), none.cast("int"), none.cast("string"))
    return table(spark, sf, "events").select("event_id", reason.alias("reason"))


@query(r"""WITH t AS (SELECT doc_id, text, trim(text, ' ') AS t, n_chars FROM documents) SELECT doc_id, CASE WHEN n_chars < 100 THEN 'too fast' WHEN t = '' THEN 'empty' WHEN length(t) > 2000 THEN 'too long'
 WHEN regexp_matches(text, '(?m)^\s*```') OR regexp_matches(text, '(?m)^[ \t]{4,}\S') OR length(text) - length(regexp_replace(text, '[{};=<>]', '', 'g')) > 12 THEN 'code'
 WHEN regexp_matches(t, '(?i)https?://|www\.|<\s*script|\b(?:bitcoin|casino|crypto|escort|loan|porn|viagra|xxx)\b') THEN 'promotion' END AS reason FROM t""")
def text_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.comment_error(F.col("text"), F.lit("n"), F.col("n_chars"), F.lit(""), 100).alias("reason"))


@query("SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders")
def insert_unique(spark: SparkSession, sf: str) -> DataFrame:
    return web.insert_unique(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS v FROM customer")
def upsert_runs(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return web.upsert(c, c.where("v < 0").withColumn("v", F.lit(0.0)), "k")


@query("""SELECT TIMESTAMP '1970-01-01' + to_days((epoch(ts)::BIGINT // 604800 * 7)::INT) AS start, event_type AS kind, count(*) AS events, count(DISTINCT user_id) AS senders FROM (SELECT event_type, user_id, date_trunc('second', ts) AS ts FROM events) GROUP BY ALL""")
def telemetry_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return web.telemetry_rollup(table(spark, sf, "events").select("ts", F.col("event_type").alias("kind"), F.col("user_id").alias("sender")))


@query("SELECT p_partkey, CASE WHEN n < 200 THEN 'S' WHEN n < 2000 THEN 'M' WHEN n < 20000 THEN 'L' ELSE 'XL' END AS bucket FROM (SELECT p_partkey, p_retailprice * p_size AS n FROM part)")
def repo_size_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", text.size_bucket(F.col("p_retailprice") * F.col("p_size")).alias("bucket"))
