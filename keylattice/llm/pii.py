"""Personal data by a skip-chain conditional random field.

A token is a run of visible characters.  The nodes of a document are

* all tokens that hold a digit or an ``@``;
* capitalised tokens (ASCII or Latin-1) where a name can be: a run of them behind
  a title or a word for a name, and every other occurrence of those tokens;
* the words of a street: a street word with the capitalised words and particles
  beside it;
* capital letters inside an account number that is written in groups.

Every other token has the label O with certainty, so it cuts the chain exactly.
There are

* a unary potential from features of the token and those around it,
* a chain potential between nodes that are neighbouring tokens,
* a skip potential that all occurrences of the same or a similar token (equal
  after case, edge punctuation and digit separators are taken off) share: each
  is linked with one latent label of the document's entity, with a weight of at
  least ``PULL``, so the pull is the same at any distance and for any number of
  repeats.

Loopy sum-product message passing over both kinds of edges goes on until no
message changes by more than ``SETTLED``.  An occurrence with telling context so
settles all others.  Documents are independent: one narrow pass, no shuffle, and
all documents of a batch pass messages at once.

The weights are trained here, by pseudo-likelihood, on ``TRAINING`` sequences
that ``generate`` makes from templates with a fixed seed; no labelled rows are
needed.

A row of the result is a token, or a maximal run of neighbouring tokens of one
telephone number, name, address, or grouped card or account number: character
offsets, label and the smallest belief.

Defined cases: null and empty texts have no token; a text of any length is read
whole; a row with a null ``doc_id`` is scanned and reported with a null id;
repeated rows are scanned each on its own and don't inform each other; ties
between labels go to the first label in ``LABELS``; other columns, whatever
their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keylattice.llm.textkit import slices, utf8

LABELS = ("O", "EMAIL", "PHONE", "IP", "CARD", "NATIONAL_ID", "IBAN", "NAME", "ADDRESS", "BIRTH_DATE")
L = len(LABELS)
#: Labels whose entities may have several tokens; cards and accounts only in groups.
RUNS = tuple(LABELS.index(x) for x in ("PHONE", "NAME", "ADDRESS"))
GROUPED = tuple(LABELS.index(x) for x in ("CARD", "IBAN"))
#: Sequences that the field is trained on.
TRAINING = 2000
#: Least weight with which an occurrence follows its entity.
PULL = 4.0
SETTLED, MOST_SWEEPS, DAMPING = 1e-4, 1000, 0.3
SCHEMA = "doc_id bigint, label string, start int, end int, score double"

TITLES = frozenset("mr mrs ms miss dr prof sir madam herr frau monsieur madame mme señor señora sr sra".split())
NAMES = frozenset("name named dear surname forename nachname vorname nom prénom nombre apellido signed".split())
STREETS = frozenset("street st road rd avenue ave lane ln drive boulevard blvd court square terrace strasse straße gasse weg platz allee".split())
WAYS = frozenset("rue calle avenida plaza via chemin".split())
PARTICLES = frozenset("de la le du des del los las van von der den el".split())
_LINK = frozenset("is ist est es was of".split())
_EMAIL = re.compile(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}")
_QUAD = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}")
_IBAN = re.compile(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}")
_IBAN_HEAD = re.compile(r"[A-Z]{2}\d{2}[A-Z0-9]{0,4}")
_IBAN_PART = re.compile(r"[A-Z0-9]{1,4}")
_SSN = re.compile(r"\d{3}-\d{2}-\d{4}")
_LOCAL = re.compile(r"\d{3}[-.]\d{4}")
_FULL = re.compile(r"(?:\+?\d{1,3}[-.])?\(?\d{3}\)?[-.]?\d{3}[-.]\d{4}|\+\d{9,15}")
_AREA = re.compile(r"\(\d{2,4}\)")
_COUNTRY = re.compile(r"\+\d{1,3}")
_DATE = re.compile(r"(?:19|20)\d\d[-/.](?:0?[1-9]|1[0-2])[-/.](?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/.](?:0?[1-9]|[12]\d|3[01])[-/.](?:(?:19|20)\d\d|\d\d)")
_BRAND = re.compile(r"4(?:\d{12}|\d{15}|\d{18})|3[47]\d{13}|(?:5[1-5]\d\d|222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)\d{12}|3(?:0[0-5]|[689]\d)\d{11}|(?:35\d\d|6011|62\d\d|64[4-9]\d|65\d\d)\d{12,15}|(?:50|5[6-9]|6\d)\d{10,17}")
_RIM = re.compile(r"^\W+|\W+$")
_EDGE = re.compile(r"^[^\w+(@]+|[^\w)]+$")
_CONTEXT = (
    ("email", re.compile(r"e-?mail|contact|write", re.I)), ("phone", re.compile(r"phone|tel|call|fax|mobile|cell", re.I)),
    ("ip", re.compile(r"\bip\b|address|host|server|login", re.I)), ("card", re.compile(r"card|visa|credit|payment|master|amex|karte|carte|tarjeta", re.I)),
    ("id", re.compile(r"ssn|social|passport|national", re.I)), ("iban", re.compile(r"iban|account|bank|konto|compte|cuenta", re.I)),
    ("version", re.compile(r"version|license|licence|\bv$|release|section|chapter|BY-", re.I)), ("token", re.compile(r"token|hash|sha|key|id|order|invoice", re.I)),
)
_BIRTH = re.compile(r"born|birth|\bdob\b|geboren|geburt|naissance|\bnée?\b|nacid|nacimiento", re.I)
FEATURES = (
    "bias", "email", "at", "quad", "quad_bad", "card_brand", "card_other", "card_luhn", "card_good", "ssn", "iban", "local", "full", "area", "country",
    "digits_only", "mixed", "short", "long", "after_country", "after_area", "before_area", "before_local", "group_card", "group_iban", "date", "birth", "date_birth",
    "letters", "after_title", "after_name_word", "after_capital", "before_capital", "street", "way", "before_street", "after_way", "house_before", "house_after", "particle", *(f"near_{n}" for n, _ in _CONTEXT),
)
_AT = {f: i for i, f in enumerate(FEATURES)}
Get = Callable[[int], str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def core(token: str) -> str:
    return _EDGE.sub("", token)


def word(token: str) -> str:
    return _RIM.sub("", token).lower()


def key(token: str) -> str:
    """Equal for tokens that are the same or similar."""
    c = core(token).lower()
    if "@" in c or re.search(r"[^\W\d_]", c) or c.count(".") == 3:
        return c
    return re.sub(r"\D", "", c) or c


def capital(token: str) -> bool:
    t = token.lstrip("(\"'")
    return bool(t) and ("A" <= t[0] <= "Z" or "À" <= t[0] <= "Þ")


def _stops(token: str) -> bool:
    """Whether a name cannot go on behind this token; an initial's full stop doesn't end it."""
    return token[-1:] in ",;:!?)" or (token.endswith(".") and len(word(token)) > 2)


def _street(token: str) -> bool:
    w = word(token)
    return w in STREETS or (len(w) > 6 and w.endswith(("straße", "strasse", "gasse", "allee", "platz")))


def _house(token: str) -> bool:
    return re.fullmatch(r"\d{1,5}[A-Za-z]?", core(token)) is not None


def _group(get: Get, i: int) -> list[str]:
    """Whether a card or account number in groups covers this token: every stretch of tokens that could be one is tried."""
    found, c = [], core(get(i))
    if re.fullmatch(r"\d{3,7}", c):
        left = i
        while re.fullmatch(r"\d{3,7}", get(left - 1)) and i - left < 6:
            left -= 1
        for a in range(left, i + 1):
            digits, k = "", a
            while re.fullmatch(r"\d{3,7}", core(get(k))) and len(digits) <= 19:
                digits += core(get(k))
                if k >= i and k > a and 13 <= len(digits) <= 19 and _BRAND.fullmatch(digits) and luhn(digits):
                    found.append("group_card")
                if core(get(k)) != get(k):
                    break
                k += 1
    if _IBAN_PART.fullmatch(c) or _IBAN_HEAD.fullmatch(c):
        for a in range(i, i - 10, -1):
            t = core(get(a))
            if _IBAN_HEAD.fullmatch(t):
                joined, k = t, a
                while len(joined) < 34 and (k < i or get(k) == core(get(k))):
                    k += 1
                    t = core(get(k))
                    if not _IBAN_PART.fullmatch(t):
                        break
                    joined += t
                    if k >= i and len(joined) >= 15 and iban(joined):
                        found.append("group_iban")
            if not _IBAN_PART.fullmatch(core(get(a - 1))) and not _IBAN_HEAD.fullmatch(core(get(a - 1))):
                break
    return sorted(set(found))


def features(get: Get, i: int) -> list[int]:
    """Features of token i; ``get`` gives the tokens around, empty beyond the text."""
    token, before, after = get(i), get(i - 1), get(i + 1)
    c = core(token)
    digits = re.sub(r"\D", "", c)
    f = ["bias"]
    if _EMAIL.fullmatch(c):
        f.append("email")
    elif "@" in c:
        f.append("at")
    if _QUAD.fullmatch(c):
        f.append("quad" if all(int(x) < 256 for x in c.split(".")) else "quad_bad")
    if 13 <= len(digits) <= 19 and re.fullmatch(r"\d+(?:-\d+)*", c):
        brand, good = _BRAND.fullmatch(digits) is not None, luhn(digits)
        f += ["card_brand" if brand else "card_other"] + ["card_luhn"] * good + ["card_good"] * (brand and good)
    if _SSN.fullmatch(c):
        f.append("ssn")
    if _IBAN.fullmatch(c) and iban(c):
        f.append("iban")
    f += [n for n, p in (("local", _LOCAL), ("full", _FULL), ("area", _AREA), ("country", _COUNTRY)) if p.fullmatch(c)]
    f += _group(get, i)
    if _DATE.fullmatch(c):
        born = any(_BIRTH.search(get(k)) for k in (i - 1, i - 2, i - 3))
        f += ["date", *["birth", "date_birth"] * born]
    if digits or "@" in c:
        f.append("digits_only" if c.isdigit() else "mixed")
        f += ["short"] if len(digits) < 7 else ["long"] if len(digits) > 19 else []
        if _house(c):
            k = i + 1
            while capital(get(k)) and not _street(get(k)) and not _stops(get(k)) or word(get(k)) in PARTICLES:
                k += 1
            f += ["house_before"] * (_street(get(k)) and k > i + 1 or word(after) in WAYS)
            f += ["house_after"] * (_street(before) and capital(before))
    else:
        f.append("letters")
        k = i
        while k > 0 and capital(get(k - 1)) and not _stops(get(k - 1)) and word(get(k - 1)) not in TITLES and word(get(k - 1)) not in NAMES:
            k -= 1
        lead = word(get(k - 1))
        if lead in _LINK:
            lead = word(get(k - 2))
        f += ["after_title"] * (lead in TITLES) + ["after_name_word"] * (lead in NAMES)
        f += ["after_capital"] * (k < i) + ["before_capital"] * (capital(after) and not _stops(token))
        f += ["street"] * _street(token) + ["way"] * (word(token) in WAYS) + ["particle"] * (word(token) in PARTICLES)
        f += ["before_street"] * _street(after) + ["after_way"] * (word(before) in WAYS or word(before) in PARTICLES)
    b, a = core(before), core(after)
    f += ["after_country"] if _COUNTRY.fullmatch(b) else ["after_area"] if _AREA.fullmatch(b) else []
    f += ["before_area"] if _AREA.fullmatch(a) else ["before_local"] if _LOCAL.fullmatch(a) else []
    f += [f"near_{n}" for n, p in _CONTEXT if p.search(b)]
    return [_AT[x] for x in f]


class Field:
    """The weights, and message passing over the nodes and edges of many documents."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    def scores(self, rows: list[list[int]], hubs: int = 0) -> np.ndarray:
        """Unary potentials of the nodes, and flat ones of the latent labels behind them."""
        size = np.array([len(r) for r in rows])
        flat = np.array([i for r in rows for i in r], np.int64)
        own = np.add.reduceat(self.unary[flat], np.cumsum(size) - size) if len(rows) else np.zeros((0, L))
        return np.concatenate([own, np.zeros((hubs, L))])

    def beliefs(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Marginals by loopy message passing; chain and skip are arrays of (left, right) node pairs.

        A tree of edges is solved exactly.  Messages that don't settle are damped more and more."""
        edges = np.concatenate([chain, skip]).astype(np.int64)
        tables = np.concatenate([np.broadcast_to(self.chain, (len(chain), L, L)), np.broadcast_to(self.skip, (len(skip), L, L))])
        src = np.concatenate([edges[:, 0], edges[:, 1]])
        dst = np.concatenate([edges[:, 1], edges[:, 0]])
        pot = np.concatenate([tables, tables.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        m = np.zeros((len(src), L))

        def total() -> np.ndarray:
            t = unary.copy()
            np.add.at(t, dst, m)
            return t

        for sweep in range(MOST_SWEEPS if len(src) else 0):
            z = (total()[src] - m[back])[:, :, None] + pot
            top = z.max(1)
            new = top + np.log(np.exp(z - top[:, None, :]).sum(1))
            new -= new.max(1, keepdims=True)
            keep = 1 - (1 - DAMPING) / (1 + sweep // 100)
            moved = np.abs(new - m).max()
            m = keep * m + (1 - keep) * new
            if moved < SETTLED:
                break
        t = total()
        p = np.exp(t - t.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def links(place: list[int], doc: list[int], keys: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Chain edges (neighbouring tokens), skip edges (an occurrence and its entity's latent label, numbered behind the nodes), and the number of latent labels."""
    chain = [(i - 1, i) for i in range(1, len(place)) if doc[i] == doc[i - 1] and place[i] == place[i - 1] + 1]
    members: dict[tuple[int, str], list[int]] = {}
    for i, k in enumerate(zip(doc, keys)):
        members.setdefault(k, []).append(i)
    several = [v for v in members.values() if len(v) > 1]
    skip = [(i, len(place) + h) for h, v in enumerate(several) for i in v]
    return np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2), len(several)


def generate(n: int = TRAINING, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """Token and label sequences from templates."""
    r = np.random.default_rng(seed)
    pick = lambda *x: x[r.integers(len(x))]
    num = lambda k: "".join(map(str, r.integers(0, 10, k)))
    plain = lambda: "".join(r.choice(list("abdeghilmnorstu"), r.integers(2, 9)))
    proper = lambda: plain().capitalize()

    def card() -> str:
        head, size = pick(("4", 16), ("4", 16), ("4", 13), ("4", 19), ("37", 15), ("34", 15), ("5" + str(r.integers(1, 6)), 16), (str(r.integers(2221, 2721)), 16), ("6011", 16), ("65", 16), ("35", 16), ("36", 14), ("62", 18))
        body = head + num(size - 1 - len(head))
        while not _BRAND.fullmatch(body + "0"):
            body = head + num(size - 1 - len(head))
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))

    def grouped(s: str, sizes: tuple[int, ...]) -> list[str]:
        out, at = [], 0
        for k in sizes:
            out.append(s[at : at + k])
            at += k
        return [*(x for x in out if x), *([s[at:]] if s[at:] else [])]

    def order() -> str:
        if r.random() < 0.5:
            return pick("0", "1", "7", "8", "9") + num(15) if r.random() < 0.5 else next(b for b in iter(lambda: pick("1", "7", "8", "9") + num(15), "") if luhn(b))
        body = num(15)
        return body + str(next(d for d in r.permutation(10) if not luhn(body + str(d))))

    def account() -> str:
        body = pick(num(18), num(18), num(14), "ABNA" + num(10))
        country = pick("DE", "FR", "ES", "NL", "AT")
        return f"{country}{98 - int(''.join(str(int(c, 36)) for c in body + country) + '00') % 97:02d}{body}"

    def entity() -> tuple[list[str], list[str], str]:
        k = r.integers(10)
        if k == 0:
            return [f"{plain()}.{num(2)}@{plain()}{pick('', num(1))}.{pick('example', plain())}.{pick('com', 'org', 'net', 'de')}"], "EMAIL", [pick("email", "contact", plain())]
        if k == 1:
            t = pick([f"+{pick('1', num(2))}", f"({num(3)})", f"{num(3)}-{num(4)}"], [f"({num(3)})", f"{num(3)}-{num(4)}"], [f"{num(3)}-{num(3)}-{num(4)}"], [f"+{num(2)}{num(9)}"])
            return t, "PHONE", [pick("phone", "call", plain())]
        if k == 2:
            return [".".join(str(x) for x in r.integers(1, 255, 4))], "IP", [pick("ip", "server", plain())]
        if k == 3:
            c = card()
            t = pick([c], [c], grouped(c, (4, 6, 5) if len(c) == 15 else (4, 6, 4) if len(c) == 14 else (4, 4, 4, 4)), ["-".join(grouped(c, (4, 4, 4, 4)))])
            if len(t) > 1 and any(not 3 <= len(x) <= 7 for x in t):
                t = [c]
            return t, "CARD", [pick("card", "visa", plain())]
        if k == 4:
            return [f"{num(3)}-{num(2)}-{num(4)}"], "NATIONAL_ID", [pick("ssn", plain())]
        if k == 5:
            a = account()
            return pick([a], grouped(a, (4,) * 8)), "IBAN", [pick("iban", "account", plain())]
        if k in (6, 7):
            lead = pick([pick("Mr.", "Mrs", "Dr.", "Herr", "Frau", "Señora", "Mme")], ["name:"], ["name", "is"], ["Dear"], ["Name"])
            return pick([proper()], [proper(), proper()], [proper(), pick("J.", "M."), proper()]), "NAME", lead
        if k == 8:
            way, house = pick("Street", "St.", "Road", "Avenue", "Lane"), str(r.integers(1, 999))
            t = pick([house, proper(), way], [house, proper(), proper(), way], [proper() + pick("straße", "strasse"), house], [house, "rue", pick("de", "du"), proper()], [house, "rue", proper()])
            return t, "ADDRESS", [pick("at", "in", plain())]
        date = pick(f"19{num(2)}-0{r.integers(1, 10)}-1{num(1)}", f"{r.integers(1, 29)}/{r.integers(1, 13)}/19{num(2)}", f"{r.integers(1, 29)}.{r.integers(1, 13)}.20{num(2)}")
        return [date], "BIRTH_DATE", pick(["born"], ["born", "on"], ["date", "of", "birth:"], ["geboren", "am"], ["née", "le"])

    def other() -> list[str]:
        return pick(
            [num(r.integers(1, 7))], [pick("version", "license", plain()), f"{num(1)}.{num(1)}"], ["version", f"{num(1)}.{num(1)}.{num(2)}.{num(1)}"], [f"20{num(2)}-0{r.integers(1, 10)}-1{num(1)}"], [f"{r.integers(1, 29)}/{r.integers(1, 13)}/20{num(2)}"],
            [f"{num(3)}.{num(3)}"], [f"{plain()}{num(2)}"], ["token", "=", '"' + "".join(r.choice(list("0123456789abcdef"), 40)) + '"'], [f"{num(2)}:{num(2)}"], [f"${num(3)}"], ["2019", "2020", "2021", "2022"],
            [f"({num(r.integers(1, 5))})"], [f"@{plain()}"], [f"300.{num(3)}.{num(3)}.999"], ["id", order()], [order()], [f"+{num(2)}%"], [f"{num(3)}-{num(3)}"], ["1" + num(3), num(4), num(4), num(4)],
            [str(r.integers(1, 99)), proper()], ["the", "street", str(r.integers(1, 99))], [proper() + ".", "Street"],
        )

    out = []
    for _ in range(n):
        tokens, tags, said = [], [], []
        for _ in range(r.integers(2, 8)):
            tokens += [plain() for _ in range(r.integers(1, 3))]
            tags += ["O"] * (len(tokens) - len(tags))
            u = r.random()
            if u < 0.4:
                t = other()
                tokens, tags = tokens + t, tags + ["O"] * len(t)
            else:
                if u < 0.6 and said:
                    t, tag, lead = said[r.integers(len(said))]
                    lead = [plain()]
                else:
                    t, tag, lead = entity()
                    said.append((t, tag, lead))
                end = pick("", ",", ".", "!!", "%%%")
                tokens, tags = [*tokens, *lead, *t[:-1], t[-1] + end], [*tags, *["O"] * len(lead), *[tag] * len(t)]
        out.append((tokens, tags))
    return out


def is_marked(token: str) -> bool:
    return any(c in "0123456789@" for c in token)


def worded(get: Get, first: int, last: int, cues: list[int]) -> set[int]:
    """Tokens of letters that are nodes, given where the cue words of tokens ``first`` to ``last`` are."""
    out = set()
    for i in cues:
        w = word(get(i))
        if w in TITLES or w in NAMES:
            k = i + 1 + (word(get(i + 1)) in _LINK)
            while k < last and capital(get(k)) and not is_marked(get(k)):
                out.add(k)
                if _stops(get(k)):
                    break
                k += 1
        if _street(get(i)) and capital(get(i)):
            k = i - 1
            near = {i}
            while k >= first and (capital(get(k)) or word(get(k)) in PARTICLES) and not is_marked(get(k)) and not _stops(get(k)):
                near.add(k)
                k -= 1
            if k >= first and _house(get(k)) or i + 1 < last and _house(get(i + 1)):
                out |= near
        if w in WAYS:
            k, near = i + 1, {i}
            while k < last and (capital(get(k)) or word(get(k)) in PARTICLES) and not is_marked(get(k)):
                near.add(k)
                if _stops(get(k)):
                    break
                k += 1
            if i > first and _house(get(i - 1)) or k < last and _house(get(k)):
                out |= near
        if _IBAN_HEAD.fullmatch(core(get(i))):
            k = i + 1
            while k < last and _IBAN_PART.fullmatch(core(get(k))):
                if not is_marked(get(k)):
                    out.add(k)
                k += 1
    return out


_CUE = re.compile(rb"(?<![^\s(\"'])(?:(?i:" + b"|".join(sorted((w.encode() for w in TITLES | NAMES | WAYS | STREETS), key=len, reverse=True)) + rb")(?=[!-/:-@\[-`{-~]*(?:\s|\Z))|[A-Z\xc3][^\s]{2,}?(?:stra\xc3\x9fe|strasse|gasse|allee|platz)(?=[!-/:-@\[-`{-~]*(?:\s|\Z))|[A-Z]{2}\d{2}[A-Z0-9]{0,4}(?=\s[A-Z0-9]))")


def repeats(get: Get, first: int, last: int, nodes: set[int]) -> set[int]:
    """Other capitalised tokens of the text that are the same as one of these."""
    names = {key(get(i)) for i in nodes if capital(get(i))}
    return {i for i in range(first, last) if i not in nodes and capital(get(i)) and not is_marked(get(i)) and key(get(i)) in names} if names else set()


def graph(sequences: list[list[str]]) -> tuple[list[list[int]], np.ndarray, np.ndarray, int, list[tuple[int, int]]]:
    """Features, chain, skip, latent labels, and (sequence, place) of the nodes of token sequences."""
    where, rows = [], []
    for s, t in enumerate(sequences):
        get = lambda i, t=t: t[i] if 0 <= i < len(t) else ""
        cues = [i for i, x in enumerate(t) if _CUE.match(f"{x} A".encode()) and len(x.split()) == 1]
        own = worded(get, 0, len(t), cues)
        own |= repeats(get, 0, len(t), own) | {i for i, x in enumerate(t) if is_marked(x)}
        where += [(s, i) for i in sorted(own)]
        rows += [features(get, i) for i in sorted(own)]
    return rows, *links([i for _, i in where], [s for s, _ in where], [key(sequences[s][i]) for s, i in where]), where


@functools.lru_cache(1)
def trained(n: int = TRAINING, seed: int = 11) -> Field:
    """Fit all weights at once: each node's label given its features and the true labels of those it is linked with."""
    data = generate(n, seed)
    rows, chain, skip, hubs, where = graph([t for t, _ in data])
    y = np.array([LABELS.index(data[s][1][i]) for s, i in where])
    x = np.zeros((len(rows), len(FEATURES)))
    for i, r in enumerate(rows):
        x[i, r] = 1
    hot = np.eye(L)[y]
    left, right = np.zeros((len(y), L)), np.zeros((len(y), L))
    np.add.at(left, chain[:, 1], hot[chain[:, 0]])
    np.add.at(right, chain[:, 0], hot[chain[:, 1]])
    entity = np.zeros((hubs, L))
    np.add.at(entity, skip[:, 1] - len(y), hot[skip[:, 0]])
    similar = np.zeros((len(y), L))  # the other occurrences' labels, as shares
    similar[skip[:, 0]] = entity[skip[:, 1] - len(y)] - hot[skip[:, 0]]
    similar /= np.maximum(similar.sum(1, keepdims=True), 1)
    w, c, s = np.zeros((len(FEATURES), L)), np.zeros((L, L)), np.zeros((L, L))
    state = [np.full_like(a, 1e-6) for a in (w, c, s)]
    for _ in range(150):
        z = x @ w + left @ c + right @ c.T + similar @ s
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (p - hot) / len(y)
        both = similar.T @ d
        for a, g, v in zip((w, c, s), (x.T @ d + 1e-4 * w, left.T @ d + d.T @ right + 1e-3 * c, both + both.T + 1e-3 * s), state):
            v += g * g
            a -= 0.5 * g / np.sqrt(v)
    return Field(w, c, np.diag(np.maximum(np.diag(s), PULL)))


def decode(sequences: list[list[str]], field: Field) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """(sequence, place), label and belief of the nodes."""
    rows, chain, skip, hubs, where = graph(sequences)
    b = field.beliefs(field.scores(rows, hubs), chain, skip)[: len(rows)]
    return where, b.argmax(1), b.max(1) if len(b) else np.zeros(0)


_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(48, 58), 64]] = True


def spans(texts: pa.Array, field: Field) -> list[tuple[int, str, int, int, float]]:
    """(row, label, start, end, score) of all personal data in these texts."""
    data, off = utf8(texts, lower=False)
    if not len(data):
        return []
    raw = data.tobytes()
    apart = b"\n".join(raw[a:z] for a, z in zip(off[:-1].tolist(), off[1:].tolist()))  # so that no cue looks into the next text
    cue_at = np.array([m.start() for m in _CUE.finditer(apart)], np.int64)
    cue_at -= np.searchsorted(off[:-1] + np.arange(len(off) - 1), cue_at, "right") - 1
    if not len(cue_at) and not _MARK[data].any():
        return []
    solid = ~_GAP[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    edges = off[:-1][off[:-1] < len(data)]
    begin[edges] = solid[edges]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    tails = off[1:][off[1:] > 0] - 1
    last[tails] = solid[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    bounds = np.searchsorted(starts, off)  # each text's tokens
    node = np.unique(np.searchsorted(starts, np.flatnonzero(_MARK[data]), "right") - 1)
    text = lambda i: raw[starts[i] : ends[i]].decode("utf-8", "replace")

    def within(d: int) -> Get:
        a, z = bounds[d], bounds[d + 1]
        return lambda i: text(i) if a <= i < z else ""

    cues: dict[int, list[int]] = {}
    for i in np.unique(np.searchsorted(starts, cue_at, "right") - 1).tolist():
        cues.setdefault(int(np.searchsorted(bounds, i, "right") - 1), []).append(i)
    for d, own in cues.items():
        extra = worded(within(d), bounds[d], bounds[d + 1], own)
        if extra:
            extra |= repeats(within(d), bounds[d], bounds[d + 1], extra)
            node = np.union1d(node, np.array(sorted(extra), np.int64))
    if not len(node):
        return []
    doc = np.searchsorted(bounds, node, "right") - 1
    own = [text(i) for i in node]
    rows = [features(within(d), int(i)) for i, d in zip(node, doc)]
    chain, skip, hubs = links(node.tolist(), doc.tolist(), [key(t) for t in own])
    b = field.beliefs(field.scores(rows, hubs), chain, skip)[: len(rows)]
    label, sure = b.argmax(1), b.max(1)
    out: list[list] = []
    parted = {_AT["group_card"], _AT["group_iban"]}
    for k in np.flatnonzero(label):
        t, c = own[k], core(own[k])
        head = t.find(c) if c else 0
        begin_at = int(starts[node[k]]) + len(t[:head].encode())
        end_at = begin_at + len((c or t).encode())
        runs = label[k] in RUNS or (label[k] in GROUPED and not parted.isdisjoint(rows[k]))
        if runs and out and out[-1][6] and out[-1][5] == node[k] - 1 and out[-1][0] == doc[k] and out[-1][1] == label[k]:
            out[-1][3:6] = [end_at, min(out[-1][4], sure[k]), node[k]]
        else:
            out.append([doc[k], label[k], begin_at, end_at, sure[k], node[k], runs])
    first = np.append(0, np.cumsum((data & 0xC0) != 0x80))  # characters before each byte
    return [(int(d), LABELS[l], int(first[a] - first[off[d]]), int(first[z] - first[off[d]]), float(s)) for d, l, a, z, s, *_ in out]


def find_pii(docs: DataFrame) -> DataFrame:
    """A row for every stretch of personal data of every document; offsets count characters."""
    given = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches):
        for b in slices(batches):
            found = spans(b.column("text"), given.value)
            if found:
                r, label, start, end, score = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(r)), pa.array(label), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(score)],
                    names=["doc_id", "label", "start", "end", "score"],
                )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SCHEMA)
