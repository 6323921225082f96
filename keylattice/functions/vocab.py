"""The behaviour vocabulary as data: tokens, key-lock pairs, bands, priors, rules.

Everything is a small literal table; ``*_df`` makes a DataFrame of it (fixed
size, so it is safe to broadcast) and ``*_values`` the same rows for SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TOKENS = (
    "INTAKE OUTPUT TRANSFORM MUTATE SANITIZE CONDITIONAL LOOP GUARD ROUTE SCOPE FETCH PERSIST EMIT SUBSCRIBE DELEGATE "
    "CONTRACT COMPOSE INIT TEARDOWN RAISE RECOVER DEFER AUTHENTICATE AUTHORIZE VALIDATE LOG MEASURE ASYNC TEST"
).split()
PLAIN = frozenset("TRANSFORM MUTATE SCOPE CONDITIONAL LOOP ASYNC COMPOSE LOG MEASURE".split())
OUTWARD = ("DELEGATE", "EMIT", "FETCH", "PERSIST", "ROUTE")
#: key>lock; * needs a common class scope, + may merge clusters of different files
PAIRS = [
    (i, p.strip("*+").split(">")[0], p.strip("*+").split(">")[1], "*" in p, "+" in p)
    for i, p in enumerate(
        "INTAKE>OUTPUT* FETCH>PERSIST EMIT>SUBSCRIBE+ RAISE>RECOVER INIT>TEARDOWN INIT>DEFER TEST>CONTRACT VALIDATE>INTAKE "
        "SANITIZE>INTAKE GUARD>CONTRACT* GUARD>INTAKE* AUTHENTICATE>ROUTE+ AUTHORIZE>ROUTE+ DELEGATE>CONTRACT+".split()
    )
]
_PRIORS = {
    1.0: "CONTRACT ROUTE AUTHENTICATE AUTHORIZE", 0.9: "PERSIST", 0.8: "FETCH EMIT SUBSCRIBE", 0.7: "INIT TEARDOWN VALIDATE TEST", 0.6: "RAISE RECOVER",
    0.5: "INTAKE OUTPUT GUARD DELEGATE SANITIZE DEFER", 0.4: "TRANSFORM MUTATE SCOPE ASYNC COMPOSE", 0.3: "CONDITIONAL LOOP LOG MEASURE",
}
PRIOR = {t: p for p, ts in _PRIORS.items() for t in ts.split()}
DEFAULT_PRIOR = 0.3
_BANDS = {1: "AUTHENTICATE AUTHORIZE ROUTE CONTRACT TEST VALIDATE", 3: "INTAKE OUTPUT GUARD EMIT SUBSCRIBE"}
SMALL_BAND = {t: next((b for b, ts in _BANDS.items() if t in ts.split()), 2) for t in TOKENS}
_SPECIFIC = {10: "EMIT MEASURE", 9: "DEFER SCOPE", 8: "PERSIST FETCH VALIDATE TRANSFORM", 7: "RAISE RECOVER ASYNC", 6: "MUTATE SUBSCRIBE", 5: "LOG", 4: "LOOP TEST INIT TEARDOWN", 3: "CONDITIONAL", 2: "OUTPUT", 1: "INTAKE"}
SPECIFICITY = {t: next((s for s, ts in _SPECIFIC.items() if t in ts.split()), 0) for t in TOKENS}
#: token, confidence, words that tell it (matched whole, case kept)
BODY_WORDS = [
    ("OUTPUT", 0.9, "return"), ("EMIT", 0.9, "yield"), ("EMIT", 0.75, "broadcast dispatch emit publish send"), ("RAISE", 0.85, "error fail panic raise throw"),
    ("RECOVER", 0.9, "catch except pcall recover rescue xpcall"), ("DEFER", 0.9, "after defer ensure finally"), ("ASYNC", 0.85, "async await goroutine launch spawn thread"),
    ("CONDITIONAL", 0.8, "case cond if match switch unless when"), ("LOOP", 0.75, "each for forEach loop map repeat until while"),
    ("MUTATE", 0.7, "append delete insert patch pop push remove update"), ("PERSIST", 0.7, "commit flush persist save store write"),
    ("FETCH", 0.7, "fetch find get load query read search select"), ("TRANSFORM", 0.7, "convert decode deserialize encode format parse serialize transform"),
    ("VALIDATE", 0.7, "assert check ensure validate verify"), ("SUBSCRIBE", 0.7, "addEventListener handle listen on receive subscribe"),
    ("LOG", 0.7, "debug error_log info log print printf println puts warn"), ("SCOPE", 0.7, "begin transaction using with withTransaction"),
    ("MEASURE", 0.7, "counter gauge histogram metrics statsd telemetry timer"),
]
ROLES = [
    ("AUTHENTICATE AUTHORIZE", "Authentication & Authorization"), ("AUTHENTICATE", "Authentication"), ("AUTHORIZE", "Authorization"), ("ROUTE", "API Routing Layer"),
    ("FETCH PERSIST", "Data Access / Repository"), ("PERSIST", "Data Writer"), ("FETCH", "Data Reader"), ("EMIT SUBSCRIBE", "Event Bus / Pub-Sub"), ("EMIT", "Event Publisher"),
    ("SUBSCRIBE", "Event Consumer"), ("CONTRACT", "Interface / Contract Definition"), ("TEST", "Test Suite"), ("INIT TEARDOWN", "Lifecycle Manager"),
    ("INTAKE VALIDATE", "Input Validation Layer"), ("VALIDATE", "Validator"), ("TRANSFORM", "Data Transformer"), ("DELEGATE", "Orchestrator / Service Delegate"),
    ("RECOVER", "Error Recovery"), ("LOG", "Observability / Logging"), ("MEASURE", "Metrics / Instrumentation"), ("INTAKE OUTPUT", "Request Handler"), ("INTAKE", "Input Handler"),
    ("OUTPUT", "Output Producer"),
]
#: words and, after a bar, phrases that name each token in a task description
TASK_TERMS = {
    "INTAKE": "args ingest input param parameter payload receive request", "OUTPUT": "output render reply response return", "TRANSFORM": "convert format map normalize transform",
    "MUTATE": "modify mutate update|change state", "SANITIZE": "clean escape sanitize scrub", "CONDITIONAL": "branch condition if switch", "LOOP": "batch iterate loop|for each",
    "GUARD": "check guard prevent reject", "ROUTE": "api controller endpoint handler route", "SCOPE": "global local nested scope", "FETCH": "fetch get load query read",
    "PERSIST": "commit insert persist save store write", "EMIT": "dispatch emit notify publish|send event", "SUBSCRIBE": "consumer listener subscribe watch",
    "DELEGATE": "delegate forward handoff proxy", "CONTRACT": "contract interface protocol schema", "COMPOSE": "aggregate assemble combine compose", "INIT": "boot init initialize setup",
    "TEARDOWN": "cleanup close shutdown teardown", "RAISE": "error fail raise throw", "RECOVER": "fallback recover retry|handle error", "DEFER": "after defer ensure finally",
    "AUTHENTICATE": "authenticate identity login|sign in", "AUTHORIZE": "authorize permission policy|access control", "VALIDATE": "assert validate verify|check input",
    "LOG": "audit log trace", "MEASURE": "latency measure metric telemetry timing", "ASYNC": "async await background concurrent goroutine", "TEST": "assertion test|integration test|unit test",
}
VAGUE_TERMS = "bug fix improve issue optimize problem refactor|clean up"
EXTENSIONS = [
    ("MEMOIZE", r"\b(?:cache|lru_cache|memoize)\b"), ("ORCHESTRATE", r"\b(?:orchestr|pipeline|workflow)"), ("INTERCEPT", r"\bhook\b|\b(?:intercept|middleware)"),
    ("RETRY", r"\b(?:backoff|exponential|retry)"), ("PAGINATE", r"\b(?:cursor|offset|paginat)"), ("BATCH", r"\b(?:batch|bulk)"), ("ENRICH", r"\b(?:annot|decorate|enrich)"),
    ("CHECKPOINT", r"\b(?:checkpoint|snapshot)"), ("PATTERN_MATCH", r"\bpattern|\bmatch\b.*\bcase\b"),
]
EXTENSION_ZONE = "MEMOIZE ORCHESTRATE INTERCEPT RETRY CHECKPOINT PAGINATE BATCH ENRICH".split()
LIKELY_LOCK = {"FETCH": "PERSIST", "EMIT": "SUBSCRIBE", "PERSIST": "FETCH", "DELEGATE": "CONTRACT", "ROUTE": "AUTHENTICATE"}
BOUNDARY_HINT = r"(?i)\b(?:api|client)\b|(?:external|sdk|vendor)\.|third.party|\.io\b"


def terms(spec: str) -> list[str]:
    words, *phrases = spec.split("|")
    return words.split() + phrases


def tokens_rows() -> list[tuple]:
    return [(t, i, t not in PLAIN, PRIOR.get(t, DEFAULT_PRIOR), SMALL_BAND[t], SPECIFICITY[t]) for i, t in enumerate(TOKENS)]


def tokens_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(tokens_rows(), "token string, ord int, edge_forming boolean, prior double, small_band int, specificity int")


def pairs_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAIRS, "pair_ord int, key string, lock string, class_scoped boolean, cross_file boolean")


def values(rows: list[tuple], names: str) -> str:
    """Rows as a SQL table expression."""
    lit = lambda v: "true" if v is True else "false" if v is False else repr(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({names})"


TOKENS_SQL = f"(SELECT * FROM {values(tokens_rows(), 'token, ord, edge_forming, prior, small_band, specificity')})"
PAIRS_SQL = f"(SELECT * FROM {values(PAIRS, 'pair_ord, key, lock, class_scoped, cross_file')})"
