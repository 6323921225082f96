"""Secret scan by multipart credential linking.

A text is searched for parts of credentials:

* ``strong``   complete by itself: private key block, provider token with its
  prefix, a quoted random value assigned to a telling name, a URL with a
  password in it;
* ``access``   an access identifier: key id, client or account id, user name
  assignment;
* ``secret``   a secret without proof: an unassigned random string or a short
  password assignment;
* ``endpoint`` a service address: URL of an API or a database, host with port.

Every part is an interval of the text.  Its scope is the interval widened by
``REACH`` characters on both sides, cut at the nearest blank lines.  An interval
join within the document links parts whose intervals meet each other's scope.
Strong parts are always reported.  Weak candidates are reported only when
complementary parts co-occur: an access identifier and a secret linked with
each other, either of them linked with an endpoint in addition, and an endpoint
only when it is linked with both.

Scopes never leave a document, so the join is a sweep over the sorted
intervals of one text inside a narrow pass: no shuffle, and no skew beyond a
text itself.

Defined cases: a null or empty text has no parts; a row with a null ``doc_id``
is scanned and reported with a null id; repeated rows are scanned each on its
own; a text of any length is scanned whole, and no value, name or key block has
a longest length; overlapping parts of several rules are one part, the
strongest, longest and first rule winning, the earlier one in a tie; other
columns are neither read nor changed, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from keylattice.llm.textkit import slices

#: Characters around a part within which it can be linked.
REACH = 300
#: Bits a character that a random string has at least.
LEAST_ENTROPY = 3.0
SCHEMA = "doc_id bigint, kind string, rule string, start int, end int, linked string, confidence double"

#: A name of any length that holds one of these words, read once from its start.
_NAME = r"(?<![a-z0-9_.\-])(?=[a-z0-9_.\-]*?(?:secret|token|passwd|password|pwd|api[_\-]?key|access[_\-]?key|private[_\-]?key|credential|auth))[a-z0-9_.\-]++"
#: A key block to its END line; without one, to the end of its base64 lines.
_KEY_BLOCK = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:(?:(?!-----).)*+-----END [A-Z ]{0,30}PRIVATE KEY-----"
    r"|(?:[ \t\r\\n]*\n?(?:Proc-Type|DEK-Info):[^\n]*)*+(?:(?:\s|\\[rn])*[A-Za-z0-9+/]{40,}+={0,2})*+(?:(?:\r?\n|\\n)[A-Za-z0-9+/]+={0,2}(?=[\s\"'\\]|$))?)"
)
RULES: list[tuple[str, str, re.Pattern, bool]] = [
    ("strong", "private_key", re.compile(_KEY_BLOCK, re.S), False),
    ("strong", "provider_token", re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{60,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk-[A-Za-z0-9_-]{20,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20,}|npm_[A-Za-z0-9]{36})(?![A-Za-z0-9])"), False),
    ("strong", "web_token", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"), False),
    ("strong", "url_password", re.compile(r"[a-z][a-z0-9+.\-]{1,20}://[^\s/:@\"']+:[^\s/:@\"']{3,}@[A-Za-z0-9.\-]+(?::\d+)?[^\s\"'<>]*"), False),
    ("strong", "assigned_secret", re.compile(rf"(?i:{_NAME})[\"']?\s{{0,4}}(?::=|=>|[:=])\s{{0,4}}[\"'`]?([A-Za-z0-9+/_\-.~]{{16,}}={{0,2}})[\"'`]?"), True),
    ("access", "key_id", re.compile(r"(?<![A-Z0-9])(?:AKIA|ASIA|AIDA|AROA)[A-Z2-7]{16}(?![A-Z0-9])"), False),
    ("access", "account_id", re.compile(r"(?<![A-Za-z0-9])(?:AC|SK)[0-9a-f]{32}(?![A-Za-z0-9])"), False),
    ("access", "named_id", re.compile(r"(?i:client[_\-]?id|app[_\-]?id|account[_\-]?id|access[_\-]?key[_\-]?id|user(?:name)?|login)[\"']?\s{0,4}(?::=|=>|[:=])\s{0,4}[\"'`]?([A-Za-z0-9._@\-]{3,})[\"'`]?"), False),
    ("endpoint", "service_url", re.compile(r"(?:https?|wss?|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp|ftp|s3)://[A-Za-z0-9.\-]+(?::\d+)?[^\s\"'<>]*"), False),
    ("endpoint", "named_host", re.compile(r"(?i:endpoint|host(?:name)?|server|base[_\-]?url)[\"']?\s{0,4}(?::=|=>|[:=])\s{0,4}[\"'`]?([A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+(?::\d+)?[^\s\"'<>`]*)[\"'`]?"), False),
    ("secret", "short_password", re.compile(r"(?i:secret|passwd|password|pwd|passphrase|token)[\"']?\s{0,4}(?::=|=>|[:=])\s{0,4}[\"'`]?([^\s\"'`,;]{4,})[\"'`]?"), False),
    ("secret", "random_string", re.compile(r"(?<![A-Za-z0-9+/_\-])([A-Za-z0-9+/_\-]{20,}={0,2})(?![A-Za-z0-9+/_\-=])"), True),
]
_RANK = {"strong": 0, "access": 1, "endpoint": 2, "secret": 3}
_GAP = r"[\s\pZ\x0b\x1c-\x1f\x{85}]{0,4}"  # what Python's \s matches
#: A text that this RE2 pattern doesn't match has no part that could be reported.
PREFILTER = (
    r"PRIVATE KEY|gh[pousr]_|github_pat_|xox[abprs]-|sk[-_]|AIza|glpat-|npm_|eyJ|://"
    rf"|(?i:secret|token|passw|pwd|passphrase|ap[iİı][_-]?key|access[_-]?key|pr[iİı]vate[_-]?key|credent[iİı]al|auth)[A-Za-z0-9_.\-İıſK]*[\"']?{_GAP}(?::=|=>|[:=])"
    r"|(?:AKIA|ASIA|AIDA|AROA)[A-Z2-7]{16}|(?:AC|SK)[0-9a-f]{32}"
    rf"|(?i:cl[iİı]ent[_-]?[iİı]d|app[_-]?[iİı]d|account[_-]?[iİı]d|key[_-]?[iİı]d|user|username|log[iİı]n)[\"']?{_GAP}(?::=|=>|[:=])"
)


class Part(NamedTuple):
    start: int
    end: int
    kind: str
    rule: str


class Finding(NamedTuple):
    start: int
    end: int
    kind: str
    rule: str
    linked: str
    confidence: float


def entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) if s else 0.0


def _random(s: str) -> bool:
    return entropy(s) >= LEAST_ENTROPY and any(c.isdigit() for c in s) and any(c.isalpha() for c in s)


def parts(text: str) -> list[Part]:
    """The parts of a text, none overlapping another, in order."""
    found = []
    for kind, rule, pattern, random in RULES:
        for m in pattern.finditer(text):
            g = 1 if pattern.groups and m.group(1) is not None else 0
            if m.end(g) > m.start(g) and (not random or _random(m.group(g))):
                found.append((_RANK[kind], m.start(g) - m.end(g), m.start(g), len(found), Part(m.start(g), m.end(g), kind, rule)))
    taken: list[Part] = []
    for *_, p in sorted(found):
        at = bisect_left(taken, p)
        if not (at and taken[at - 1].end > p.start) and not (at < len(taken) and taken[at].start < p.end):
            taken.insert(at, p)
    return taken


def scopes(text: str, found: list[Part], reach: int = REACH) -> list[tuple[int, int]]:
    """The stretch of the text in which each part can be linked."""
    blanks = [m.span() for m in re.finditer(r"\n[ \t]*\n", text)]
    begins, out = [a for a, _ in blanks], []
    for p in found:
        k = bisect_left(begins, p.start)
        j = bisect_left(begins, p.end)
        left = blanks[k - 1][1] if k else 0
        right = blanks[j][0] if j < len(blanks) else len(text)
        out.append((max(left, p.start - reach), min(right, p.end + reach)))
    return out


def link(found: list[Part], around: list[tuple[int, int]]) -> list[set[str]]:
    """Kinds that each part is linked with: an interval join by a sweep over sorted, disjoint intervals."""
    linked: list[set[str]] = [set() for _ in found]
    starts = [p.start for p in found]
    for i, (_, right) in enumerate(around):
        # parts are disjoint and sorted: those that begin within the scope follow each other
        for j in range(i + 1, bisect_left(starts, right)):
            linked[i].add(found[j].kind)
            linked[j].add(found[i].kind)
    return linked


def scan(text: str | None, reach: int = REACH) -> list[Finding]:
    """What is reported for a text."""
    if not text:
        return []
    found = parts(text)
    out = []
    for p, kinds in zip(found, link(found, scopes(text, found, reach))):
        weak = {"access": {"secret"}, "secret": {"access"}, "endpoint": {"access", "secret"}}
        if p.kind == "strong" or weak[p.kind] <= kinds or ("strong" in kinds and p.kind == "access"):
            more = len(kinds & {"access", "secret", "endpoint", "strong"} - {p.kind})
            sure = 0.9 if p.kind == "strong" else 0.5
            out.append(Finding(p.start, p.end, p.kind, p.rule, ",".join(sorted(kinds - {p.kind})), round(min(0.99, sure + 0.1 * more), 4)))
    return out


def _candidates(batch: pa.RecordBatch) -> list[int]:
    hit = pc.fill_null(pc.match_substring_regex(batch.column("text"), PREFILTER), False)
    return pc.indices_nonzero(hit).to_pylist()


def find_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """A row for every reported part of every document; offsets count characters."""

    def run(batches):
        for b in slices(batches):
            rows = [(i, f) for i in _candidates(b) for f in scan(b.column("text")[i].as_py(), reach)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").take(pa.array([i for i, _ in rows])),
                        pa.array([f.kind for _, f in rows]), pa.array([f.rule for _, f in rows]),
                        pa.array([f.start for _, f in rows], pa.int32()), pa.array([f.end for _, f in rows], pa.int32()),
                        pa.array([f.linked for _, f in rows]), pa.array([f.confidence for _, f in rows]),
                    ],
                    names=["doc_id", "kind", "rule", "start", "end", "linked", "confidence"],
                )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SCHEMA)


def redacted(text: str, reach: int = REACH) -> str:
    out, at = [], 0
    for f in scan(text, reach):
        out += [text[at : f.start], f"[{f.kind.upper()}]"]
        at = f.end
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """All rows and columns, with every reported part replaced by its kind and ``n_chars``, where there is one, counted again."""
    names = docs.columns

    def run(batches):
        for b in slices(batches):
            rows = _candidates(b)
            if rows:
                texts = b.column("text").to_pylist()
                before = [texts[i] for i in rows]
                for i in rows:
                    texts[i] = redacted(texts[i], reach)
                columns = list(b.columns)
                columns[names.index("text")] = pa.array(texts, b.schema.field("text").type)
                if "n_chars" in names and pa.types.is_integer(b.schema.field("n_chars").type):
                    counts = b.column("n_chars").to_pylist()
                    for i, t in zip(rows, before):
                        if texts[i] != t:
                            counts[i] = len(texts[i])
                    columns[names.index("n_chars")] = pa.array(counts, b.schema.field("n_chars").type)
                b = pa.RecordBatch.from_arrays(columns, schema=b.schema)
            yield b

    return docs.mapInArrow(run, docs.schema)
