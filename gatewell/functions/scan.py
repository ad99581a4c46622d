"""The screens over whole records, in Arrow functions: names, facts, and the parts of a request side by side.

The patterns are those of functions/screens.py. A record has many short texts and many ways in which they meet, so one
Python call a record takes the place of a plan with a regular expression for each of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache, lru_cache
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewell.functions import contacts, fragments, lexicons, screens
from gatewell.functions.lexicons import joined
from gatewell.functions.views import id_form, views_of

KINDS = ("identifier", "contact", "instruction", "policy_control", "solicitation", "money", "giving_history")  # in order of precedence
# Characters on either side of a seam, by kind, and at most; what a closed seam leaves out.
WINDOW = {"contact": 128, "instruction": 128, "policy_control": 64, "giving_history": 128, "solicitation": 64, "money": 128}
MOST, TRIMMED = 192, " \t\r\n.,;:!?"
REMEMBERED = 4_096  # texts whose screens a worker remembers: a campaign's own come back with every record

_patterns = {name: re.compile(joined([p for p in patterns if p != screens.ODD_MONEY]), re.I) for name, patterns in screens.PATTERNS.items()}
_mark = re.compile(screens._MARK, re.I)
_id_signs = re.compile(r"[._:-]+")
_address_cue = re.compile(contacts.ADDRESS_CUE, re.I)
_naming = re.compile(rf"{screens.NAMED_GIVING}(?:{screens.DIGITS}|{screens.WORDS})(?!\w)", re.I)


@cache
def words_of(kind: str) -> re.Pattern[str]:
    """The words that texts of a kind are made of, but the commonest; a seam of that kind has some on both sides."""
    found = {w for p in screens.PATTERNS[kind] for w in re.findall(r"(?<![\\a-z])[a-z]{3,}", re.sub(r"\\[a-zA-Z]", " ", p))}
    return re.compile(r"\b(?:" + "|".join(sorted(found - {"the", "and", "all", "our", "are", "not", "with", "who", "was", "has"})) + r")\w{0,3}\b", re.I)


@dataclass
class Person:
    """What is known of a record's person."""

    donor_id: str
    names: list[str]
    literals: list[str]
    _id: re.Pattern[str] = field(init=False)
    _names: re.Pattern[str] | None = field(init=False)
    _literals: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self._id = re.compile("(?<![A-Za-z0-9])(?:" + "|".join(map(re.escape, views_of(self.donor_id))) + ")(?![A-Za-z0-9])", re.I)
        known = sorted({v for n in self.names for v in views_of(n) if len(v) >= 2})
        self._names = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, known)) + r")(?!\w)", re.I) if known else None
        self._literals = [v for x in self.literals for v in views_of(x) if v]

    def identified(self, views: Sequence[str]) -> bool:
        return any(map(self._id.search, views))

    def reached(self, views: Sequence[str]) -> bool:
        """Whether a view is a contact literal, or holds one that is long enough or beside a word for addresses."""
        cued = any(map(_address_cue.search, views))
        folded = {v.casefold() for v in views}
        for x in self._literals:
            low = x.casefold()
            if low in folded:
                return True
            if (len(x) >= 4 or len(x) >= 3 and x.isdecimal() or cued) and any(low in v for v in folded) and any(re.search(rf"(?<!\w){re.escape(x)}(?!\w)", v, re.I) for v in views):
                return True
        return False

    def gave(self, views: Sequence[str]) -> bool:
        return self._names is not None and any(_naming.match(v, m.end()) for v in views for m in self._names.finditer(v))


@lru_cache(REMEMBERED)
def views(text: str) -> tuple[str, ...]:
    return tuple(views_of(text))


@lru_cache(REMEMBERED)
def hit(text: str, name: str) -> bool:
    find = _patterns[name].search
    if name == "policy_control":
        return any(find(v) or find(_id_signs.sub(" ", v)) for v in views(text))
    if name == "money":
        return any(find(v) or _odd_money(v) for v in views(text))
    return any(map(find, views(text)))


@lru_cache(REMEMBERED)
def contact(text: str) -> bool:
    return any(map(contacts.found, views(text)))


def _odd_money(view: str) -> bool:
    """A marker of money with a numeral beyond ASCII within 32 characters."""
    return not view.isascii() and any(c.isnumeric() and not c.isascii() for m in _mark.finditer(view) for c in view[max(0, m.start() - 32) : m.end() + 32])


def giving(text: str, who: Person) -> bool:
    return hit(text, "giving_field") or hit(text, "giving_context") or who.gave(views(text))


def is_kind(kind: str, text: str, who: Person, in_context: bool = True) -> bool:
    match kind:
        case "identifier":
            return who.identified(views(text))
        case "contact":
            return contact(text) or who.reached(views(text))
        case "giving_history":
            return giving(text, who) if in_context else hit(text, "giving_field")
    return hit(text, kind)


def kinds(text: str, who: Person, in_context: bool = True) -> list[str]:
    """The kinds that a text is of. in_context: whether told giving counts beside named fields."""
    return [k for k in KINDS if is_kind(k, text, who, in_context)]


def fact_kinds(fact_id: str, text: str, crm: bool, who: Person) -> tuple[list[str], list[str], list[str]]:
    """Kinds of a fact's id, of its text, and of both together that neither is alone."""
    slug = fact_id.partition(".")[2]
    of_id = {*kinds(id_form(fact_id), who, False)}
    if who.identified(views(fact_id)):
        of_id.add("identifier")
    if contact(slug):
        of_id.add("contact")
    of_text = {*kinds(text, who, crm)}
    joined = {k for sign, lead in ((" ", slug), (" ", id_form(slug)), ("", slug), ("-", slug)) for k in kinds(f"{lead}{sign}{text}", who, crm)}
    return tuple([k for k in KINDS if k in found] for found in (of_id, of_text, joined - of_id - of_text))


def seam(first: str, second: str, window: int = MOST) -> tuple[str, str]:
    """The end of one text and the beginning of another, open (with a space) and closed (without punctuation between)."""
    tail, head = first[-window:], second[:window]
    return f"{tail} {head}", tail.rstrip(TRIMMED) + head.lstrip(TRIMMED)


def _seams(texts: list[str], others: list[str] | None) -> Iterator[tuple[str, str]]:
    """Ends and beginnings of all ordered pairs of different texts; with others, of those that have one of these."""
    held = [t for t in texts if t]
    old = 0 if others is None else len(held)
    held += [t for t in others or () if t]
    seen = set()
    for i, a in enumerate(held):
        for j, b in enumerate(held):
            if i != j and (i >= old or j >= old) and (edge := (a[-MOST:], b[:MOST])) not in seen:
                seen.add(edge)
                yield edge


_contact_signs = re.compile(rf"[@:/+\d]|\.\S|[^\x00-\x7F]|\b(?:at|dot|point|period|colon|oh|{contacts._NUMBER[3:-1]})\b", re.I)
_amounts = re.compile(rf"\d|\b(?:{'|'.join(screens.NUMBERS)}|an?)\b", re.I)


@lru_cache(REMEMBERED)
def _possible(kind: str, tail: str, head: str, closed: str) -> bool:
    """Whether a seam can be of a kind at all: each side has a part of it, or both make up one where they touch."""
    if kind == "contact":
        return _contact_signs.search(tail[-40:] + " " + head[:40]) is not None or _contact_signs.search(closed[max(0, len(tail) - 40) : len(tail) + 40]) is not None
    if not (tail + head).isascii() or {*"%&\\"} & {*tail, *head}:
        return True
    if kind == "money":
        return _mark.search(tail) is not None and _amounts.search(head) is not None or _amounts.search(tail) is not None and (_mark.search(head) is not None or re.search(screens.AFTER_AMOUNT, head, re.I) is not None) or _mark.search(closed) is not None and _amounts.search(closed) is not None
    names = ("giving_field", "giving_context") if kind == "giving_history" else (kind,)
    touch = closed[max(0, len(tail) - 24) : len(tail) + 24]
    for name in names:
        words = words_of(name)
        if (words.search(tail) or kind == "giving_history") and words.search(head) or words.search(tail) and words.search(head) or words.search(touch):
            return True
    return kind == "giving_history" and _amounts.search(head) is not None


def seam_kind(texts: list[str], who: Person, asked: Iterable[str], others: list[str] | None = None) -> str | None:
    """The first kind that the seams of texts are of; giving counts only where neither side tells of it alone."""
    for a, b in _seams(texts, others):
        for kind in asked:
            window = WINDOW[kind]
            tail, head = a[-window:], b[:window]
            open_, closed = seam(a, b, window)
            if kind == "contact" and tail.strip().isdecimal() and head.strip().isdecimal() or not _possible(kind, tail, head, closed):
                continue
            ways = [open_] if kind == "contact" and tail.rstrip().endswith((".", "!", "?", ";")) else [open_, closed]
            for way in dict.fromkeys(ways):
                if is_kind(kind, way, who) and not (kind == "giving_history" and (giving(a, who) or giving(b, who))):
                    return kind
    return None


CONTROL = ("instruction", "policy_control", "giving_field", "solicitation", "money")


@dataclass
class Request:
    """What a campaign gives to every request."""

    fixed: list[str]
    label: str
    url: str

    @classmethod
    def of(cls, campaign: dict) -> Request:
        sender, action = campaign["sender"], campaign["call_to_action"]
        return cls([campaign["organization_name"], campaign["campaign_name"], campaign["purpose"], sender["name"], sender["role"]], action["label"], action["url"])

    @property
    def path(self) -> str:
        """The words of the web address's path."""
        return unquote(urlsplit(self.url).path).strip("/")

    def unsafe(self, greeting: str, facts: list[tuple[str, str]], who: Person) -> str | None:
        """What makes a request unsafe, or None: its texts one by one and joined, what distinct fields make up, seams."""
        ids, texts = [f for f, _ in facts], [t for _, t in facts]
        slugs = [f.partition(".")[2] for f in ids]
        shown = [id_form(s) for s in slugs]
        own = [greeting, *self.fixed]
        listed = [*slugs, *shown, *[sign.join(x) for x in (slugs, shown) for sign in (" ", "-", "")]]
        visible = [*own, *[v for f in facts for v in f]]
        for text in dict.fromkeys([*own, *texts, *listed, self.label, self.path]):
            if is_kind("contact", text, who) or is_kind("identifier", text, who):
                return "contact"
        for text in dict.fromkeys([*visible, *listed, " ".join(visible), " ".join(ids), " ".join(texts)]):
            for kind in CONTROL:
                if hit(text, kind):
                    return kind
        parts = [*own, *[v for s, t in zip(shown, texts, strict=True) for v in (s, t)]]
        if made := fragments.unsafe(parts, [who.donor_id, *who.literals], [self.label, self.path]):
            return f"made_up_{made}"
        for asked, others in ((tuple(WINDOW), None), (("contact", "instruction", "policy_control", "giving_history"), [self.label, self.path]), (("money",), [self.label, self.url])):
            if kind := seam_kind(parts, who, asked, others):
                return f"seam_{kind}"
        return None


def _people(ids: pa.Array, firsts: pa.Array, lasts: pa.Array, literals: pa.Array) -> Iterator[Person | None]:
    for donor_id, first, last, known in zip(*(x.to_pylist() for x in (ids, firsts, lasts, literals)), strict=True):
        names = [n for n in (first, last, f"{first} {last}" if first and last else None) if n]
        yield None if donor_id is None else Person(donor_id, names, [x for x in known or () if x])


_FOUND = T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in ("of_id", "of_text", "of_both")])


@F.arrow_udf(T.ArrayType(_FOUND))
def facts_kinds(facts: pa.Array, ids: pa.Array, firsts: pa.Array, lasts: pa.Array, literals: pa.Array) -> pa.Array:
    """fact_kinds() of an array<struct<fact_id, text, source>>; null for null."""
    out = []
    for own, who in zip(facts.to_pylist(), _people(ids, firsts, lasts, literals), strict=True):
        if own is None or who is None:
            out.append(None)
            continue
        found = [fact_kinds(f["fact_id"] or "", f["text"] or "", f["source"] == "crm", who) for f in own]
        out.append([dict(zip(_FOUND.names, x, strict=True)) for x in found])
    return pa.array(out, pa.list_(pa.struct([(n, pa.list_(pa.string())) for n in _FOUND.names])))


@F.arrow_udf(T.ArrayType(T.StringType()))
def texts_kinds(texts: pa.Array, ids: pa.Array, firsts: pa.Array, lasts: pa.Array, literals: pa.Array) -> pa.Array:
    """The kinds that some text of an array<string> is of; null for null."""
    out = []
    for own, who in zip(texts.to_pylist(), _people(ids, firsts, lasts, literals), strict=True):
        found = None if own is None or who is None else {k for t in own if t for k in kinds(t, who)}
        out.append(None if found is None else [k for k in KINDS if k in found])
    return pa.array(out, pa.list_(pa.string()))


def request_reason(campaign: dict):
    """A column function (greeting, array<struct<fact_id, text>>, donor_id, first, last, literals) -> Request.unsafe(); null greetings have no request."""
    request = Request.of(campaign)

    @F.arrow_udf(T.StringType())
    def reason(greetings: pa.Array, facts: pa.Array, ids: pa.Array, firsts: pa.Array, lasts: pa.Array, literals: pa.Array) -> pa.Array:
        out = []
        for greeting, own, who in zip(greetings.to_pylist(), facts.to_pylist(), _people(ids, firsts, lasts, literals), strict=True):
            out.append(None if greeting is None or who is None else request.unsafe(greeting, [(f["fact_id"] or "", f["text"] or "") for f in own or ()], who))
        return pa.array(out, pa.string())

    return reason


_url = re.compile(lexicons.URL, re.I)
_pressure, _claims = re.compile(joined(lexicons.PRESSURE), re.I), {code: re.compile(p, re.I) for code, p in lexicons.CLAIMS.items()}
_html = re.compile(lexicons.HTML)


def urls(text: str) -> set[str]:
    """The web addresses in the views of a text, without punctuation at their end."""
    return {m[0].rstrip(".,;:!?") for v in views(text) for m in _url.finditer(v)}


def holds(text: str, literal: str) -> bool:
    """Whether a view of a text holds a view of a literal whole, not as a part of longer words."""
    for x in views(literal):
        if x and any(x.casefold() in v.casefold() for v in views(text)):
            edged = (r"(?<!\w)" if re.match(r"\w", x) else "") + re.escape(x) + (r"(?!\w)" if re.search(r"\w\Z", x) else "")
            if any(re.search(edged, v, re.I) for v in views(text)):
                return True
    return False


def draft_hits(rest: str, whole: str, allowed: str | None, copies: list[str | None], offered: list[str], prohibited: list[str]) -> list[str]:
    """What the screens find in a draft: rest is its text beyond the anchors, whole all of it.

    Codes of the guard; copy:0, copy:1 and so on for the anchors that rest repeats. allowed: text whose addresses may occur.
    """
    found = [code for code, name in (("instruction_like_output", "instruction"), ("unauthorized_ask_amount", "money"), ("unauthorized_ask_language", "provider_solicitation")) if hit(rest, name)]
    if hit(rest, "policy_control") or hit(rest, "giving_field"):
        found.append("unauthorized_policy_control")
    if contact(rest):
        found.append("unapproved_contact_detail")
    if any(c.isnumeric() for v in (rest, *views(rest)) for c in v) or hit(rest, "word_numbers"):
        found.append("ungrounded_number")
    if allowed is not None and urls(whole) - urls(allowed):
        found.append("unapproved_url")
    if _html.search(views(whole)[0] if whole else ""):
        found.append("html_not_allowed")
    if any(x and holds(rest, x) for x in offered):
        found.append("undeclared_fact_usage")
    found += [f"copy:{k}" for k, x in enumerate(copies) if x and holds(rest, x)]
    folded = [v.casefold() for v in views(whole)]
    if any(x.casefold() in v for p in prohibited if p for x in views(p) if x for v in folded):
        found.append("campaign_prohibited_phrase")
    if any(map(_pressure.search, views(whole))):
        found.append("manipulative_pressure")
    return found + [code for code, p in _claims.items() if any(map(p.search, views(rest)))]


@F.arrow_udf(T.ArrayType(T.StringType()))
def drafts_hits(rest: pa.Array, whole: pa.Array, allowed: pa.Array, copies: pa.Array, offered: pa.Array, prohibited: pa.Array) -> pa.Array:
    """draft_hits() of each draft; null for null."""
    rows = zip(*(x.to_pylist() for x in (rest, whole, allowed, copies, offered, prohibited)), strict=True)
    return pa.array([None if r is None or w is None else draft_hits(r, w, a, c or [], [x for x in o or () if x], [x for x in p or () if x]) for r, w, a, c, o, p in rows], pa.list_(pa.string()))
