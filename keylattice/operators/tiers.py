"""Tokens of one source file in a language that has rules of its own.

Statements, names, marks, calls and descent are read from the text with comments
and literals blanked: no syntax tree is needed, so no parser has to be shipped.
Tokens come in the order name, marks, parameters, body.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from keylattice.functions.languages import C_PARTS, LANGUAGES, Language

_TYPE = re.compile(r"(\s*)(?:[\w@()\[\]]+\s+)*?(?:class|interface|trait|object|struct|enum|module|defmodule|protocol|record|impl(?:<[^>]*>)?)\s+([\w.:]+)(.*)")
_USED = re.compile(r"\s*use\s+([\w.]+)")
_GO_OWNER = re.compile(r"func\s+\(\s*\w*\s*\*?\s*(\w+)")
_WORD = re.compile(r"(?:([\w$]+(?:\.[\w$]+)*)\s*(?:\.|->|::|:)\s*)?([A-Za-z_$][\w$]*)([!?]?\s*\()?")
_CONTROL = frozenset("if for while switch catch return else elif case do try with function foreach match unless until when synchronized lock using fixed sizeof".split())
Unit = tuple[str | None, str, int, int, str, list[tuple[str, float]], list[str]]


def name_tokens(rules: Language, name: str, language: str) -> list[tuple[str, float]]:
    low = name.lower()
    known = {k.lower(): v for k, v in rules.names.items()} if rules.fold else rules.names
    out = [known[k]] if (k := low if rules.fold else name) in known else []
    if language == "c" and not out:
        out += [(t, c) for t, c, parts in C_PARTS if any(p in low for p in parts.split())]
    prefix, sure = rules.test
    return out + [("TEST", sure)] * (low if rules.fold and prefix.islower() else name).startswith(prefix)


def mark_tokens(rules: Language, marks: str) -> list[tuple[str, float]]:
    return [(t, c) for p, t, c in rules.marks if p.search(marks)]


def call_tokens(rules: Language, obj: str, method: str) -> list[tuple[str, float]]:
    m, o = (method.lower(), obj.lower()) if rules.fold else (method, obj)
    out = [(t, c) for pm, po, t, c in rules.pairs if (not pm or pm == m) and (not po or po == o)]
    out += [(rules.calls[m], 0.75)] if m in rules.calls else []
    return out + ([(rules.objects[o], 0.75)] if o in rules.objects else [])


def body_tokens(rules: Language, body: str) -> list[tuple[str, float]]:
    """Tokens of statements, symbols and calls, by place."""
    blocks = {m for m, *_ in rules.pairs}  # these take a block in place of arguments
    found = [(m.start(), t, 1.0) for p, t in rules.symbols for m in p.finditer(body)]
    for m in _WORD.finditer(body):
        obj, word, called = m[1] or "", m[2], bool(m[3]) or (m[2] in blocks and body[m.end(2) :].lstrip().startswith("{"))
        if word in rules.words and (not obj or word == "await"):
            found.append((m.start(2), rules.words[word], 1.0))
        elif (called and word not in _CONTROL) or (rules.bare and obj):
            found += [(m.start(2), t, c) for t, c in call_tokens(rules, obj, word)]
    return [(t, c) for _, t, c in sorted(found, key=lambda f: f[0])]


def base_tokens(rules: Language, bases: list[str]) -> list[str]:
    return list(dict.fromkeys(t for b in bases for p, t, _ in rules.bases if p.search(b)))


def _bases(rest: str, name: str) -> tuple[str, list[str]]:
    """A type's own name and those that it descends from, out of the rest of its header."""
    if m := re.match(r"\s*(?:<[^>]*>)?\s*for\s+([\w.:]+)", rest):  # an implementation of a trait
        return m[1], [name.split("::")[-1]]
    rest = re.sub(r"\{.*|\([^)]*\)|<[^<>]*>", " ", rest)
    return name, [w.split(".")[-1] for w in re.findall(r"[\w.]+", rest) if w not in ("extends", "implements", "with", "where", "do")]


def _first(line: str, name: str) -> str:
    """What a header's own line has of the body: what follows the parameters and an equals sign or a brace."""
    at, depth = line.find(name) + len(name), 0
    if line[at : at + 1] in ("(", "<", "["):
        for at in range(at, len(line)):
            depth += (line[at] in "([") - (line[at] in ")]")
            if not depth and line[at] in ")]":
                break
    m = re.search(r"=>|=|\{|\bdo\b", line[at + 1 :])
    return line[at + 1 + m.end() :] if m else ""


def _has_params(header: str, name: str) -> bool:
    m = re.search(rf"\b{re.escape(name)}[!?]?\s*(?:<[^>]*>|\[[^\]]*\])?\s*\(([^)]*)", header)
    return bool(m) and re.sub(r"\b(?:self|this|void|mut)\b|[,&*\s]", "", m[1]) != ""


def units(code: str, clean: str, language: str, end: Callable[[list[str], int, str], int]) -> Iterator[Unit]:
    """(class, name, first line, last line, header, tokens with confidences, class tokens) of every function."""
    rules, raw, lines = LANGUAGES[language], code.split("\n"), clean.split("\n")
    types = [(len(m[1]), i, *_bases(m[3], m[2])) for i, line in enumerate(lines) if (m := _TYPE.match(line))]
    used = [m[1] for line in lines if (m := _USED.match(line))] if language == "elixir" else []
    taken: set[int] = set()
    found = []
    for pattern, how in rules.headers:
        for i, line in enumerate(lines):
            m = None if i in taken else pattern.match(line)
            if not m or m[1] in _CONTROL or (line.rstrip().endswith((";", ",")) and "{" not in line and "=>" not in line):
                continue
            last = end(lines, i, how)
            taken.add(i)
            found.append((i, last, m[1]))
    for i, last, name in sorted(found):
        indent = len(lines[i]) - len(lines[i].lstrip())
        own = [t for t in types if t[1] < i and t[0] < indent]
        if language == "go":
            owner = _GO_OWNER.match(lines[i])
            own = [(0, 0, owner[1], [])] if owner else []
        above = []
        for k in range(i - 1, -1, -1):
            if not raw[k].lstrip().startswith(("@", "#[", "[")):
                break
            above.append(raw[k])
        same = raw[i][: raw[i].find(name)]
        inner = [(a, z) for a, z, _ in found if i < a <= last]
        body = "\n".join([_first(lines[i], name), *(s for k, s in enumerate(lines[i + 1 : last + 1], i + 1) if not any(a <= k <= z for a, z in inner))])
        tokens = name_tokens(rules, name, language) + mark_tokens(rules, "\n".join([*above[::-1], same]))
        tokens += [("INTAKE", 1.0)] if _has_params(lines[i], name) else []
        tokens += [("ASYNC", 1.0)] if re.search(r"\b(?:async|suspend)\b", lines[i][: lines[i].find("(")]) else []
        yield own[-1][2] if own else None, name, i + 1, last + 1, raw[i], tokens + body_tokens(rules, body), base_tokens(rules, [*(own[-1][3] if own else []), *used])
