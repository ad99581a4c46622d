"""The campaign of a run: one strict JSON object, read on the driver, checked before any record is."""

from __future__ import annotations

import json
import re
import unicodedata
from datetime import date
from pathlib import Path
from urllib.parse import urlsplit

from gatewell.functions import scan
from gatewell.functions.screens import ISO_4217
from gatewell.sources import jsonl, schemas

# Limits, fields and forms of a campaign.
MOST_BYTES, MOST_NODES, MOST_ITEMS = 1_048_576, 10_000, 1_000
MOST_FACTS, MOST_PHRASES, MOST_SEGMENTS = 50, 50, 5
TONES = ("warm", "warm-professional", "formal")
TEXTS = {"campaign_id": (1, 64), "organization_name": (1, 160), "campaign_name": (1, 160), "purpose": (20, 600)}
FIELDS = (*TEXTS, "tone", "sender", "call_to_action", "as_of_date", "minimum_days_between_contacts", "ask_policy", "review_policy", "facts", "prohibited_phrases")
ASK = ("strategy", "currency", "multiplier", "rounding_increment", "minimum", "maximum")
FACT = ("fact_id", "text", "source", "category", "approved_for_outreach")
_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._:-]{0,63}")
_FACT_ID = re.compile(r"(campaign|organization|donor|crm)\.[a-z0-9][a-z0-9-]*")
_MONEY, _MULTIPLIER = re.compile(r"(?:0|[1-9][0-9]{0,9})\.[0-9]{2}"), re.compile(r"[0-5]\.[0-9]{2}")
_HOST_LABEL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?")
_PATH = re.compile(r"(?:/[A-Za-z0-9._~!$&'()*+,;=:@/-]*)?")
_UNSAFE = {"Cc", "Cf", "Cs", "Co", "Cn", "Zl", "Zp"}


class CampaignError(ValueError):
    """A campaign that may not be used; issues: (place, code) pairs. No record is judged by it."""

    def __init__(self, issues: list[tuple[str, str]]):
        super().__init__("; ".join(f"{place}: {code}" for place, code in issues))
        self.issues = issues


def over_caps(value: object) -> bool:
    """Whether a campaign has too many facts, phrases or segments, or is too large a structure."""
    if not isinstance(value, dict):
        return False
    review = value.get("review_policy")
    lists = ((value.get("facts"), MOST_FACTS), (value.get("prohibited_phrases"), MOST_PHRASES), (review.get("segments") if isinstance(review, dict) else None, MOST_SEGMENTS))
    if any(isinstance(x, list) and len(x) > most for x, most in lists):
        return True
    nodes, level = 0, [value]
    while level:
        nodes += len(level)
        if nodes > MOST_NODES or any(len(x) > MOST_ITEMS for x in level if isinstance(x, dict | list)):
            return True
        level = [y for x in level if isinstance(x, dict | list) for y in (x.values() if isinstance(x, dict) else x)]
    return False


def _line(value: object, least: int = 1, most: int = 160) -> bool:
    return isinstance(value, str) and least <= len(value) <= most and value == value.strip() and not any(unicodedata.category(c) in _UNSAFE for c in value)


def _cents(value: object) -> int | None:
    return int(value.replace(".", "")) if isinstance(value, str) and value.isascii() and _MONEY.fullmatch(value) and value != "0.00" else None


def _day(value: object) -> bool:
    try:
        return isinstance(value, str) and bool(re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", value)) and date.fromisoformat(value) is not None
    except ValueError:
        return False


def action_url(value: object) -> bool:
    """An https address in its plain form: a DNS host of two labels or more, a path of safe characters, nothing else."""
    if not isinstance(value, str) or not value.startswith("https://") or not value.isascii() or len(value) > 2048 or re.search(r"[\s\\%\x00-\x1f\x7f]", value):
        return False
    try:
        parts = urlsplit(value)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return False
    labels = host.split(".")
    plain = port is None and not (parts.username or parts.password or parts.query or parts.fragment) and parts.netloc.lower() == host and not value.endswith(("?", "#"))
    return plain and len(host) <= 253 and len(labels) > 1 and any(map(str.isalpha, labels[-1])) and all(map(_HOST_LABEL.fullmatch, labels)) and bool(_PATH.fullmatch(parts.path))


def _keys(value: object, names: tuple[str, ...], place: str) -> list[tuple[str, str]]:
    """What is wrong with an object's keys; names are asked for, others are forbidden."""
    if not isinstance(value, dict):
        return [(place or "$", "model_type")]
    at = f"{place}." if place else ""
    return [(f"{at}{n}", "missing") for n in names if n not in value] + [(f"{at}$extra", "extra_forbidden") for n in value if n not in names]


def fact_issues(facts: object, sources: tuple[str, ...], most: int) -> list[tuple[str, str]]:
    if not isinstance(facts, list):
        return [("facts", "list_type")]
    found = [("facts", "too_long")] if len(facts) > most else []
    for k, f in enumerate(facts):
        if bad := _keys(f, FACT, f"facts.{k}"):
            found += bad
            continue
        named = isinstance(f["fact_id"], str) and 5 <= len(f["fact_id"]) <= 64 and _FACT_ID.fullmatch(f["fact_id"])
        found += [] if named else [(f"facts.{k}.fact_id", "string_pattern_mismatch")]
        found += [] if _line(f["text"], 1, 320) else [(f"facts.{k}.text", "string_invalid")]
        found += [] if f["source"] in schemas.SOURCES else [(f"facts.{k}.source", "enum")]
        found += [] if f["category"] in schemas.CATEGORIES else [(f"facts.{k}.category", "enum")]
        found += [] if isinstance(f["approved_for_outreach"], bool) else [(f"facts.{k}.approved_for_outreach", "bool_type")]
        if named and f["source"] in schemas.SOURCES and (named[1] not in (("crm", "donor") if f["source"] == "crm" else (f["source"],)) or f["source"] not in sources):
            found.append((f"facts.{k}", "value_error"))
    ids = [f["fact_id"] for f in facts if isinstance(f, dict) and isinstance(f.get("fact_id"), str)]
    return found + ([("facts", "value_error")] if len(set(ids)) < len(ids) else [])


def _ask_issues(ask: object) -> list[tuple[str, str]]:
    strategy = ask.get("strategy") if isinstance(ask, dict) else None
    if strategy not in ("none", "last_gift_multiplier"):
        return [("ask_policy", "union_tag_invalid")]
    found = _keys(ask, ASK[:2] if strategy == "none" else ASK, "ask_policy")
    if found:
        return found
    found += [] if ask["currency"] in ISO_4217 else [("ask_policy.currency", "value_error")]
    if strategy == "none":
        return found
    multiplier = ask["multiplier"]
    if not (isinstance(multiplier, str) and _MULTIPLIER.fullmatch(multiplier) and 1 <= int(multiplier.replace(".", "")) <= 500):
        found.append(("ask_policy.multiplier", "value_error"))
    amounts = {n: _cents(ask[n]) for n in ASK[3:]}
    found += [(f"ask_policy.{n}", "value_error") for n, v in amounts.items() if v is None]
    if None not in (amounts["minimum"], amounts["maximum"]) and amounts["minimum"] > amounts["maximum"]:
        found.append(("ask_policy", "value_error"))
    return found


def issues(campaign: object) -> list[tuple[str, str]]:
    """(place, code) of everything that is wrong with a campaign's form."""
    found = _keys(campaign, FIELDS, "")
    if found:
        return found
    found += [(n, "string_invalid") for n, (least, most) in TEXTS.items() if n != "campaign_id" and not _line(campaign[n], least, most)]
    found += [] if isinstance(campaign["campaign_id"], str) and _ID.fullmatch(campaign["campaign_id"]) else [("campaign_id", "string_pattern_mismatch")]
    found += [] if campaign["tone"] in TONES else [("tone", "enum")]
    for name, parts in (("sender", ("name", "role")), ("call_to_action", ("label", "url"))):
        found += _keys(campaign[name], parts, name) or [(f"{name}.{p}", "string_invalid") for p in parts if p != "url" and not _line(campaign[name][p])]
    if isinstance(campaign["call_to_action"], dict) and not action_url(campaign["call_to_action"].get("url")):
        found.append(("call_to_action.url", "value_error"))
    found += [] if _day(campaign["as_of_date"]) else [("as_of_date", "value_error")]
    days = campaign["minimum_days_between_contacts"]
    found += [] if type(days) is int and 0 <= days <= 365 else [("minimum_days_between_contacts", "int_invalid")]
    found += _ask_issues(campaign["ask_policy"])
    review = campaign["review_policy"]
    if bad := _keys(review, ("segments", "ask_amount_at_or_above"), "review_policy"):
        found += bad
    else:
        segments = review["segments"]
        if not isinstance(segments, list) or len(segments) > MOST_SEGMENTS or not all(s in schemas.SEGMENTS for s in segments if isinstance(s, str)) or not all(isinstance(s, str) for s in segments) or len(set(segments)) < len(segments):
            found.append(("review_policy.segments", "value_error"))
        found += [] if _cents(review["ask_amount_at_or_above"]) else [("review_policy.ask_amount_at_or_above", "value_error")]
    found += fact_issues(campaign["facts"], ("campaign", "organization"), MOST_FACTS)
    phrases = campaign["prohibited_phrases"]
    return found + ([] if isinstance(phrases, list) and len(phrases) <= MOST_PHRASES and all(map(_line, phrases)) else [("prohibited_phrases", "value_error")])


def boundary_issue(campaign: dict) -> str | None:
    """The first kind of text that a campaign's own words may not be, alone, joined, or side by side; None for none.

    The label and address of the call to action may ask, and its address may be one.
    """
    request = scan.Request.of(campaign)

    def ways(texts: list[str]) -> list[str]:
        pairs = [s for i, a in enumerate(texts) for j, b in enumerate(texts) if i != j and a and b for s in scan.seam(a, b)]
        return list(dict.fromkeys([*texts, " ".join(texts), *pairs]))

    everything = ways([*request.fixed, request.label, request.url])
    for kind in ("instruction", "policy_control", "giving_field"):
        if any(scan.hit(t, kind) for t in everything):
            return kind
    if any(map(scan.contact, ways([*request.fixed, request.label]))):
        return "contact"
    if any(scan.hit(t, "money") for t in everything):
        return "money"
    return "solicitation" if any(scan.hit(t, "solicitation") for t in ways(request.fixed)) else None


def checked(campaign: object) -> dict:
    """The campaign itself, or a CampaignError."""
    if over_caps(campaign):
        raise CampaignError([("$", "campaign_structure_too_large")])
    if found := issues(campaign):
        raise CampaignError(found)
    if kind := boundary_issue(campaign):
        raise CampaignError([("$", f"{kind}_like_campaign_text")])
    return campaign


def load(path: str) -> dict:
    """Read and check a campaign file of at most MOST_BYTES."""
    with Path(path).open("rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise CampaignError([("$", "input_too_large")])
    if code := jsonl.refusal(data):
        raise CampaignError([("$", code)])
    return checked(json.loads(data))
