"""Code units and their tokens from source files.

Finding where functions begin and end is a scan with state, so it is a
``mapInPandas`` over whole files; everything that can be a column expression
(word rules, caps, hashes) is one.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from keylattice.functions import ids, text
from keylattice.functions.languages import LANGUAGES
from keylattice.operators import tiers

# how a body ends: b braces, i indentation, e the word end, p round brackets
_HEADERS = [
    (re.compile(p), how)
    for how, p in (
        ("b", r"\s*(?:(?:public|private|internal|open|fileprivate|static|class|override|mutating|async|@\w+)\s+)*func\s+(\w+)\s*[(<]"),
        ("b", r"\s*(?:Future<\S+>|Stream<\S+>|\w+(?:<[^>]+>)?)\s+(\w+)\s*\(.*\)\s*(?:async\s*)?\{"),
        ("b", r"\s*(\w+)\s*(?:=|<-)\s*function\s*\("),
        ("b", r"\s*(?:function\s+)?(\w+)\s*\(\s*\)\s*\{"),
        ("i", r"\s*let\s+(?:rec\s+)?(\w+)\s+[^=]*="),
        ("i", r"\s*(?:converter|iterator|method|func|proc)\s+(\w+)\s*[*(]"),
        ("b", r"\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)\s*[(<]"),
        ("e", r"\s*function\s+(?:\[?[\w,\s]*\]?\s*=\s*)?(\w+)\s*\((?!.*\{)"),
        ("e", r"(?i)\s*(?:(?:public|private|protected|friend|shared|static|async)\s+)?(?:function|sub)\s+(\w+)\s*\((?!.*\{)"),
        ("i", r"\s*(?:async\s+)?def\s+(\w+)\s*\(.*:\s*$"),
        ("e", r"\s*(?:abstract\s+)?def\s+(\w+)[\s(]?"),
        ("b", r"(\w+)\s*\([^)]*\)\s*->"),
        ("p", r"\s*\((?:defn|defun|defmethod|defmulti)-?\s+(\w[\w\-?!]*)"),
        ("b", r"\s*(?:export\s+)?(?:async\s+)?(?:function|func|fn|sub|method|procedure)\s+(\w+)\s*[(\[]?"),
    )
]
_CLASS = re.compile(r"(\s*)(?:(?:pub|public|export|abstract|final)\s+)*(?:class|enum|impl|interface|module|namespace|object|struct|trait)\s+(\w+)")
_NOT_NAMES = frozenset("if for while switch catch return else elif new case do try with and or not".split())
_NOISE = re.compile(
    r'"""(?:.|\n)*?(?:"""|\Z)|\'\'\'(?:.|\n)*?(?:\'\'\'|\Z)|--\[\[(?:.|\n)*?(?:\]\]|\Z)|/\*(?:.|\n)*?(?:\*/|\Z)|//[^\n]*|--(?!>)[^\n]*|\#[^\n]*'
    r'|"(?:\\.|[^"\\\n])*(?:"|$)|\'(?:\\.|[^\'\\\n])*(?:\'|$)|`(?:\\(?:.|\n)|[^`\\])*(?:`|\Z)',
    re.M,
)
SCHEMA = "file string, cls string, name string, line_start int, line_end int, header string, body string, tokens array<string>, class_context array<string>, confidence double, source string"


def strip_noise(code: str | None) -> str | None:
    """Comments and literals blanked out, line feeds kept."""
    return None if code is None else _NOISE.sub(lambda m: "\n" * m[0].count("\n") or " ", code)


def _end(lines: list[str], at: int, how: str) -> int:
    """The last line (index) of the body that begins at this header."""
    if how == "i":
        own = len(lines[at]) - len(lines[at].lstrip())
        last = at
        for i in range(at + 1, len(lines)):
            if lines[i].strip():
                if len(lines[i]) - len(lines[i].lstrip()) <= own:
                    break
                last = i
        return last
    if how == "e":
        depth = 0
        for i in range(at, len(lines)):
            s = lines[i].strip()
            depth += bool(re.match(r"(?i)(?:\w+\s+)*(?:def|function|sub|if|unless|while|for|case|begin|do|class|module)\b", s)) and not re.search(r"\bend\b", s)
            depth -= bool(re.match(r"(?i)end\b", s))
            if depth <= 0 and i > at:
                return i
        return len(lines) - 1
    opens, closes = ("{", "}") if how == "b" else ("(", ")")
    depth, seen = 0, False
    for i in range(at, len(lines)):
        for c in lines[i]:
            depth += (c == opens) - (c == closes)
            seen |= c == opens
        if seen and depth <= 0:
            return i
        if not seen and i > at + 4:
            return at
    return len(lines) - 1 if seen else at


def functions(code: str) -> list[tuple[str | None, str, int, int, str, str]]:
    """(class, name, first line, last line, header, body) of every function, in order; lines from 1."""
    raw, clean = code.split("\n"), (strip_noise(code) or "").split("\n")
    classes = [(len(m[1]), i, m[2]) for i, line in enumerate(clean) if (m := _CLASS.match(line))]
    used: set[int] = set()
    found = []
    for pattern, how in _HEADERS:
        for i, line in enumerate(clean):
            m = None if i in used else pattern.match(line)
            if not m or len(m[1]) < 2 or m[1].lower() in _NOT_NAMES:
                continue
            end = _end(clean, i, how)
            used.update(range(i, min(end, i + 4) + 1))
            indent = len(line) - len(line.lstrip())
            own = [c for c in classes if c[1] < i and c[0] < indent]
            found.append((own[-1][2] if own else None, m[1], i + 1, end + 1, raw[i], "\n".join(clean[i + 1 : end + 1]) if end > i else clean[i]))
    return sorted(found, key=lambda f: f[2])


_METHODS = {
    m: t for t, ms in {
        "PERSIST": "add create dump export insert persist put save store write", "FETCH": "all fetch filter find first get last load query read retrieve select",
        "EMIT": "broadcast dispatch emit publish send trigger", "SUBSCRIBE": "attach connect listen on register subscribe", "TRANSFORM": "convert decode deserialize encode map project serialize transform",
        "MUTATE": "append clear delete extend pop remove setdefault update", "VALIDATE": "assert_valid check ensure validate verify",
    }.items() for m in ms.split()
}
_OBJECTS = {o: t for t, os in {"LOG": "LOG log logger logging", "MEASURE": "counter gauge histogram metrics statsd telemetry timer"}.items() for o in os.split()}
_NAMES = {n: t for t, ns in {"INIT": "__init__ __new__ __post_init__ on_startup setUp setup setup_method startup", "TEARDOWN": "__aexit__ __del__ __exit__ on_shutdown shutdown tearDown teardown teardown_method"}.items() for n in ns.split()}
_DECORATORS = [
    (re.compile(p), t, c) for p, t, c in (
        (r"on_event\s*\(\s*['\"]startup", "INIT", 0.9), (r"on_event\s*\(\s*['\"]shutdown", "TEARDOWN", 0.9), (r"receiver|signal", "SUBSCRIBE", 0.9),
        (r"\b(?:api|app|blueprint|router)\.(?:delete|get|head|options|patch|post|put|route)\b", "ROUTE", 0.9), (r"auth_required|login_required|requires_auth", "AUTHENTICATE", 0.9),
        (r"permission_required|requires_permission|roles_required", "AUTHORIZE", 0.9), (r"contextmanager|transaction\.atomic", "SCOPE", 0.9), (r"backoff\.|retry", "RECOVER", 0.9),
        (r"\b(?:cache|cached|lru_cache)\b", "FETCH", 0.8), (r"validate|validator\b", "VALIDATE", 0.9), (r"\b(?:shared_)?task\b", "ASYNC", 0.9),
    )
]
_BASES = {
    b: t for t, bs in {
        "CONTRACT": "ABC BaseModel Enum IntEnum NamedTuple Protocol Schema TypedDict", "RAISE": "BaseException Exception RuntimeError TypeError ValueError", "TEST": "AsyncTestCase TestCase TransactionTestCase",
        "TRANSFORM": "BaseSerializer ModelSerializer Serializer", "PERSIST": "BaseRepository Repository", "SUBSCRIBE": "BaseConsumer Consumer Subscriber", "ROUTE": "APIView ModelViewSet View ViewSet",
    }.items() for b in bs.split()
}
_NODES = [
    ((ast.Return,), "OUTPUT"), ((ast.Yield, ast.YieldFrom), "EMIT"), ((ast.Raise,), "RAISE"), ((ast.Assert,), "GUARD"), ((ast.ExceptHandler,), "RECOVER"), ((ast.For, ast.While, ast.AsyncFor), "LOOP"),
    ((ast.If, ast.Match), "CONDITIONAL"), ((ast.With, ast.AsyncWith), "SCOPE"), ((ast.Await,), "ASYNC"), ((ast.AugAssign,), "MUTATE"), ((ast.ListComp, ast.DictComp, ast.SetComp, ast.GeneratorExp), "TRANSFORM"),
]


def _python_tokens(f: ast.FunctionDef | ast.AsyncFunctionDef, depth: int) -> list[tuple[str, float]]:
    out = [(_NAMES[f.name], 0.95)] if f.name in _NAMES else []
    out += [("TEST", 0.95)] if f.name.startswith(("test_", "Test")) else []
    a = f.args
    if any(x.arg not in ("self", "cls") for x in (*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg)))):
        out.append(("INTAKE", 1.0))
    for d in f.decorator_list:
        out += [(t, c) for p, t, c in _DECORATORS if p.search(ast.unparse(d))]
    if isinstance(f, ast.AsyncFunctionDef):
        out.append(("ASYNC", 1.0))

    def walk(n: ast.AST) -> None:
        for c in ast.iter_child_nodes(n):
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue  # a nested unit has its own tokens
            out.extend((t, 1.0) for kinds, t in _NODES if isinstance(c, kinds))
            if isinstance(c, ast.Try) and c.finalbody:
                out.append(("DEFER", 1.0))
            if isinstance(c, ast.Assign) and any(isinstance(t, (ast.Attribute, ast.Subscript)) for t in c.targets):
                out.append(("MUTATE", 1.0))
            if isinstance(c, ast.Call) and isinstance(c.func, ast.Attribute):
                if c.func.attr in _METHODS:
                    out.append((_METHODS[c.func.attr], 0.75))
                if isinstance(c.func.value, ast.Name) and c.func.value.id in _OBJECTS:
                    out.append((_OBJECTS[c.func.value.id], 0.75))
            walk(c)

    for s in f.body:
        walk(ast.Module([s], []))
    dunder = f.name.startswith("__") and f.name.endswith("__")
    if depth or dunder or not f.name.startswith("_"):
        out.append(("SCOPE", 0.98 if dunder else 0.95 if depth else 0.9))
    return out


def python_units(code: str) -> list[tuple]:
    """(class, name, first, last, header, tokens with confidences, class tokens) of Python source; empty if it doesn't parse."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines, out = code.split("\n"), []

    def visit(node: ast.AST, cls: ast.ClassDef | None, depth: int) -> None:
        for c in ast.iter_child_nodes(node):
            if isinstance(c, ast.ClassDef):
                visit(c, c, depth)
            elif isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef)):
                bases = [ast.unparse(b).split(".")[-1] for b in cls.bases] if cls else []
                out.append((cls.name if cls else None, c.name, c.lineno, c.end_lineno, lines[c.lineno - 1], _python_tokens(c, depth), [_BASES[b] for b in bases if b in _BASES]))
                if depth < 1:
                    visit(c, cls, depth + 1)
            else:
                visit(c, cls, depth)

    visit(tree, None, 0)
    return out


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = []
        for file, code, language in zip(pdf["file"], pdf["text"], pdf["language"]):
            if not isinstance(code, str):
                continue
            if language == "python" and (units := python_units(code)):
                for cls, name, a, z, header, found, context in units:
                    tokens, conf = list(dict.fromkeys(t for t, _ in found)), [c for _, c in found] or [0.5]
                    kind = "deterministic" if min(conf) >= 0.9 else "ai_classified" if max(conf) < 0.9 else "composite"
                    rows.append((file, cls, name, a, z, header, "", tokens, list(dict.fromkeys(context)), min(conf), kind))
            elif language in LANGUAGES:
                for cls, name, a, z, header, found, context in tiers.units(code, strip_noise(code) or "", language, _end):
                    tokens, conf = list(dict.fromkeys(t for t, _ in found)), [c for _, c in found] or [0.5]
                    kind = "deterministic" if min(conf) >= 0.9 else "ai_classified" if max(conf) < 0.9 else "composite"
                    rows.append((file, cls, name, a, z, header, "", tokens, context, min(conf), kind))
            elif language != "python":
                rows += [(file, *f, None, [], None, None) for f in functions(code)]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def scan(files: DataFrame) -> DataFrame:
    """Units of files (file, text, language): Python by its syntax tree, languages with rules of their own by those, others by header patterns and word rules."""
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a file of small rows is one task's to read, however long the texts made of them are to parse
    dealt = files.where("language is not null").select("file", "text", "language").repartition(tasks)
    raw = dealt.mapInPandas(_scan, SCHEMA).withColumn("found", text.rule_words(F.col("body")))
    body, name, found = F.col("body"), F.col("name"), F.col("found")
    none = F.array().cast("array<string>")
    words = F.array_distinct(F.concat(text.name_tokens(name), F.when(text.has_params(F.col("header")), F.array(F.lit("INTAKE"))).otherwise(none), text.body_tokens(body, found)))
    tokens = F.coalesce("tokens", text.cap_tokens(words))
    sure = F.coalesce("confidence", F.round(F.least(F.coalesce(text.body_confidence(body, found), F.lit(0.9)), F.when(F.size(text.name_tokens(name)) > 0, 0.85).otherwise(1.0)), 2))
    unit = F.concat_ws("::", "file", "cls", "name")
    return raw.select(
        unit.alias("unit_id"), "file", "cls", "name", "line_start", "line_end", tokens.alias("tokens"), "class_context", sure.alias("confidence"),
        F.coalesce("source", F.when(sure >= 0.9, "deterministic").otherwise("ai_classified")).alias("source"), ids.unit_hash(unit, tokens).alias("fingerprint_hash"),
    ).withColumn("dir3", ids.dir3_of("file"))


def python_routes(files: DataFrame) -> DataFrame:
    """(file, method, path) of route decorators; ``route`` takes the first of ``methods``, else GET."""
    found = F.regexp_extract_all("text", F.lit(r"(@\w+\.(?:route|get|post|put|delete|patch|head|options)\s*\([^\n]*)"), F.lit(1))
    r = files.where(F.col("file").endswith(".py")).select("file", F.explode(found).alias("d"))
    verb = F.regexp_extract("d", r"@\w+\.(\w+)", 1)
    listed = F.regexp_extract("d", r"methods\s*=\s*[\[(]\s*['\"](\w+)", 1)
    return r.select("file", F.upper(F.when(verb != "route", verb).when(listed != "", listed).otherwise("GET")).alias("method"), F.regexp_extract("d", r"\(\s*['\"]([^'\"]*)", 1).alias("path"))


def js_routes(files: DataFrame) -> DataFrame:
    """(file, method, path) of ``object.verb(path, ...)`` calls; a path that isn't a literal is ``<dynamic>``."""
    blocked = "array boolean buffer console crypto date error events fs json map math number object os path process promise set stream string symbol url util".split()
    pattern = r"(\b[A-Za-z_$][\w$.]*\.(?:get|post|put|delete|patch|head|options|all|use)\s*\(\s*[^\s,)]*)"
    r = files.where(F.col("file").rlike(r"\.(?:js|jsx|ts|tsx)$")).select("file", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("c"))
    obj = F.lower(F.regexp_extract("c", r"^([\w$.]*)\.\w+\s*\(", 1))
    path = F.regexp_extract("c", r"\(\s*['\"`]([^'\"`]*)", 1)
    head = F.element_at(F.split(obj, r"\."), 1)
    return r.where(~head.isin(*blocked)).select("file", F.upper(F.regexp_extract("c", r"\.(\w+)\s*\(", 1)).alias("method"), F.when(path != "", path).otherwise("<dynamic>").alias("path"))
