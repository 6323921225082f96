"""Page views, rate limits, conversations and other row streams around the engine."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

LIMIT, WINDOW_S = 3, 600


def pageviews(views: DataFrame) -> DataFrame:
    """Views by path, most first."""
    return views.groupBy("path").agg(F.count("*").alias("views")).orderBy(F.desc("views"), "path")


def newest(rows: DataFrame, at: str, key: str, k: int = 50) -> DataFrame:
    return rows.orderBy(F.desc(at), F.desc(key)).limit(k)


def rate_limit(requests: DataFrame, most: int = LIMIT, window_s: int = WINDOW_S) -> DataFrame:
    """accepted or not, for requests (key, at in seconds, id): a request is refused while ``most`` accepted ones lie in the trailing window.

    Refused requests aren't counted, so each key is replayed in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "id"])
        kept: list[float] = []
        ok = []
        for t in pdf["at"]:
            kept = [x for x in kept if t - x < window_s]
            ok.append(len(kept) < most)
            if ok[-1]:
                kept.append(t)
        return pd.DataFrame({"key": pdf["key"], "id": pdf["id"], "accepted": ok})

    t = requests.schema
    return requests.groupBy("key").applyInPandas(run, f"key {t['key'].dataType.simpleString()}, id {t['id'].dataType.simpleString()}, accepted boolean")


def trailing_count(requests: DataFrame, window_s: int = WINDOW_S) -> DataFrame:
    """Requests of the same key in the trailing window, this one included: the set-based form of the limiter."""
    w = Window.partitionBy("key").orderBy(F.col("at").cast("long")).rangeBetween(-window_s + 1, 0)
    return requests.select("key", "id", F.count("*").over(w).alias("n"))


def insert_unique(have: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return have.unionByName(new.dropDuplicates([key]).join(have.select(key), key, "left_anti").select(*have.columns))


def upsert(have: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of the same key."""
    return have.join(new.select(key).distinct(), key, "left_anti").select(*have.columns).unionByName(new)


def assistant_text(turns: DataFrame) -> DataFrame:
    """All assistant messages of a conversation in order, lower-cased."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return turns.where("role = 'assistant'").groupBy("conv_id").agg(F.lower(F.array_join(parts, "\n")).alias("text"))


def tool_use(lines: DataFrame, prefix: str) -> DataFrame:
    """Whether any JSON line of a run (run, line) uses a tool whose name begins so."""
    j = F.from_json("line", "type string, name string")
    return lines.groupBy("run").agg(F.bool_or(F.coalesce((j["type"] == "tool_use") & j["name"].startswith(prefix), F.lit(False))).alias("used"))


def telemetry_rollup(events: DataFrame, days: int = 7) -> DataFrame:
    """Events, distinct senders and kinds by window."""
    w = F.window("ts", f"{days} days")
    return events.groupBy(w.alias("w"), "kind").agg(F.count("*").alias("events"), F.countDistinct("sender").alias("senders")).select(F.col("w.start").alias("start"), "kind", "events", "senders")


def histograms(events: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Counts of the values of several columns (by the histogram's name) in one pass; a missing value counts as ``?``, except for tools."""
    each = F.explode(F.array(*(F.struct(F.lit(h).alias("histogram"), F.col(c).cast("string").alias("value")) for h, c in columns.items())))
    rows = events.select(each.alias("x")).select("x.histogram", F.when((F.col("x.value") == "") | F.col("x.value").isNull(), F.when(F.col("x.histogram") != "tool", "?")).otherwise(F.col("x.value")).alias("value"))
    return rows.where("value is not null").groupBy("histogram", "value").agg(F.count("*").alias("n"))


def adoption_rollup(traffic: DataFrame, top: int = 10) -> DataFrame:
    """Views and unique visitors by repository, and the ``top`` referrers and paths over all, as rows (section, name, views, uniques)."""
    sums = lambda key, section: traffic.groupBy(F.col(key).alias("name")).agg(F.count("*").alias("views"), F.countDistinct("visitor").alias("uniques")).select(F.lit(section).alias("section"), "name", "views", "uniques")
    best = lambda d: d.orderBy(F.desc("views"), "name").limit(top)
    return sums("repo", "repository").union(best(sums("referrer", "referrer"))).union(best(sums("path", "path")))


def page_totals(views: DataFrame, interactions: DataFrame) -> DataFrame:
    """Views, distinct paths and interactions, as one row."""
    return views.agg(F.count("*").alias("views"), F.countDistinct("path").alias("paths")).crossJoin(interactions.agg(F.count("*").alias("interactions")))
