"""Token rules over source text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from keylattice.functions import vocab

MOST_TOKENS = 6
_INIT = "__init__ before beforeAll beforeEach constructor create init initialize main new open setUp setup start".split()
_TEARDOWN = "__del__ after afterAll afterEach cleanup close destroy dispose free shutdown stop tearDown teardown".split()


_RULE_WORDS = sorted({w for _, _, words in vocab.BODY_WORDS for w in words.split()})


def rule_words(body: Column) -> Column:
    """The words of a text that some rule knows; the text is split once, whatever the number of rules."""
    return F.array_intersect(F.split(body, r"[^\p{L}\p{N}_]+"), F.array(*map(F.lit, _RULE_WORDS)))


def _rule(found: Column, words: str) -> Column:
    return F.arrays_overlap(found, F.array(*map(F.lit, words.split())))


def body_tokens(body: Column, found: Column | None = None) -> Column:
    """Tokens that the words of a body tell, in rule order, each once; ``found`` is ``rule_words`` of it, where it is there."""
    found = rule_words(body) if found is None else found
    hits = F.array(*(F.when(_rule(found, w), t) for t, _, w in vocab.BODY_WORDS))
    return F.array_distinct(F.filter(hits, lambda x: x.isNotNull()))


def body_confidence(body: Column, found: Column | None = None) -> Column:
    """The smallest confidence of the rules that hold; null where none does."""
    found = rule_words(body) if found is None else found
    return F.least(*(F.when(_rule(found, w), c) for _, c, w in vocab.BODY_WORDS))


def name_tokens(name: Column) -> Column:
    hits = F.array(
        F.when(name.rlike(f"(?i)^(?:{'|'.join(_INIT)})$"), "INIT"), F.when(name.rlike(f"(?i)^(?:{'|'.join(_TEARDOWN)})$"), "TEARDOWN"),
        F.when(name.rlike(r"(?i)^test[_A-Z]|^test$|^spec_|_(?:test|spec)$"), "TEST"), F.when(name.rlike("(?i)async|goroutine|spawn"), "ASYNC"),
    )
    return F.filter(hits, lambda x: x.isNotNull())


def has_params(header: Column) -> Column:
    """Whether the first pair of brackets holds more than self, this or void."""
    inner = F.regexp_extract(header, r"\(([^)]*)\)", 1)
    return F.trim(F.regexp_replace(inner, r"\b(?:self|this|void)\b|[,&*\s]", "")) != ""


def cap_tokens(tokens: Column, most: int = MOST_TOKENS) -> Column:
    """At most so many tokens: the most specific ones, earlier ones first among equals, in that order only when there are too many."""
    table = F.create_map(*(F.lit(x) for kv in vocab.SPECIFICITY.items() for x in kv))
    order = F.array_sort(F.transform(tokens, lambda t, i: F.struct((-F.coalesce(table[t], F.lit(0))).alias("s"), i.alias("i"), t.alias("t"))))
    return F.when(F.size(tokens) <= most, tokens).otherwise(F.transform(F.slice(order, 1, most), lambda x: x["t"]))


def source_kind(confidences: Column) -> Column:
    """deterministic when all are at least 0.9, ai_classified when none is, else composite."""
    return F.when(F.forall(confidences, lambda c: c >= 0.9), "deterministic").when(F.forall(confidences, lambda c: c < 0.9), "ai_classified").otherwise("composite")


def route_segment(token: Column) -> Column:
    """(method, path) of ``METHOD:/path``; nulls for anything else."""
    p = r"(?i)^(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|ALL|USE):(/.+|<dynamic>)$"
    m = F.regexp_extract(token, p, 1)
    return F.struct(F.when(m != "", F.upper(m)).alias("method"), F.when(m != "", F.regexp_extract(token, p, 2)).alias("path"))


def viz_token(tokens: Column) -> Column:
    """The token that colours a node: the first that isn't ASYNC or INTAKE."""
    return F.coalesce(F.try_element_at(F.filter(tokens, lambda t: ~t.isin("ASYNC", "INTAKE")), F.lit(1)), F.try_element_at(tokens, F.lit(1)))


def size_bucket(n: Column) -> Column:
    return F.when(n < 200, "S").when(n < 2000, "M").when(n < 20000, "L").otherwise("XL")


def telemetry_error(version: Column, os: Column, kind: Column, repo: Column, bucket: Column, tiers: Column, tool: Column) -> Column:
    """The first reason to reject an event, null when there is none."""
    return F.coalesce(
        *(F.when(F.coalesce(c, F.lit("")) == "", f"missing {n}") for n, c in (("version", version), ("os", os), ("event_kind", kind), ("repo_id", repo))),
        F.when(F.length(version) > 32, "version too long"), F.when(~os.isin("linux", "darwin", "windows", "other"), "invalid os"),
        F.when(~kind.isin("mcp_start", "tool_call"), "invalid event_kind"), F.when(~repo.rlike("^[a-f0-9]{12}$"), "invalid repo_id"),
        F.when(~bucket.isin("S", "M", "L", "XL"), "invalid repo_size_bucket"), F.when((tiers < 0) | (tiers > 100), "invalid lang_tier_count"), F.when(F.length(tool) > 64, "invalid tool_name"),
    )


def comment_error(text: Column, name: Column, dwell_ms: Column, honeypot: Column, least_ms: int = 3000) -> Column:
    """The first reason to reject a comment, null when there is none."""
    t = F.trim(text)
    code = text.rlike(r"(?m)^\s*```") | text.rlike(r"(?m)^[ \t]{4,}\S") | (F.length(text) - F.length(F.regexp_replace(text, "[{};=<>]", "")) > 12)
    banned = r"(?i)https?://|www\.|<\s*script|\b(?:bitcoin|casino|crypto|escort|loan|porn|viagra|xxx)\b"
    return F.coalesce(
        F.when(F.coalesce(honeypot, F.lit("")) != "", "spam"), F.when(dwell_ms.isNull() | (dwell_ms < least_ms), "too fast"), F.when(F.coalesce(t, F.lit("")) == "", "empty"),
        F.when(F.length(t) > 2000, "too long"), F.when(F.length(F.trim(name)) > 60, "name too long"), F.when(code, "code"), F.when(t.rlike(banned) | F.coalesce(name.rlike(banned), F.lit(False)), "promotion"),
    )
