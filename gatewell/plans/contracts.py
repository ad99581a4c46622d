"""JSON Schemas (draft 2020-12) of campaigns, records and results, made from the same constants as the checks."""

from __future__ import annotations

import json
from pathlib import Path

from gatewell.functions.screens import ISO_4217
from gatewell.sources import campaign, schemas
from gatewell.sources.jsonl import STATUSES

_MONEY = {"type": "string", "pattern": "^(0|[1-9][0-9]{0,9})\\.[0-9]{2}$"}
_DAY = {"type": "string", "format": "date", "pattern": "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"}


def _text(most: int = 160, least: int = 1) -> dict:
    return {"type": "string", "minLength": least, "maxLength": most}


def _or_null(schema: dict) -> dict:
    return {"anyOf": [schema, {"type": "null"}]}


def _object(properties: dict[str, dict], optional: tuple[str, ...] = ()) -> dict:
    return {"type": "object", "additionalProperties": False, "properties": properties, "required": [n for n in properties if n not in optional]}


def _fact(sources: tuple[str, ...]) -> dict:
    spaces = {"campaign": "campaign", "organization": "organization", "crm": "(crm|donor)"}
    base = _object({"fact_id": _text(64, 5) | {"pattern": "^(campaign|organization|donor|crm)\\.[a-z0-9][a-z0-9-]*$"}, "text": _text(320), "source": {"enum": list(sources)}, "category": {"enum": list(schemas.CATEGORIES)}, "approved_for_outreach": {"type": "boolean"}})
    return base | {"allOf": [{"if": {"properties": {"source": {"const": s}}, "required": ["source"]}, "then": {"properties": {"fact_id": {"pattern": f"^{spaces[s]}\\.[a-z0-9][a-z0-9-]*$"}}}} for s in sources]}


def _donor() -> dict:
    address = _object({n: _text() for n in ("line_1", "line_2", "city", "region", "postal_code")} | {"country_code": {"type": "string", "pattern": "^[A-Z]{2}$"}}, ("line_2",))
    address["properties"]["line_2"] = _or_null(_text())
    giving = _object({"currency": {"enum": ISO_4217}} | {n: _or_null(_MONEY) for n in ("last_gift_amount", "largest_gift_amount", "lifetime_value")} | {"last_gift_date": _or_null(_DAY)})
    return _object({
        "donor_id": {"type": "string", "pattern": "^[A-Za-z0-9][A-Za-z0-9._:-]{2,63}$"}, "first_name": _text(), "last_name": _or_null(_text()), "title": _or_null(_text()),
        "preferred_channel": {"enum": list(schemas.CHANNELS)}, "channel_consent": {"enum": list(schemas.CONSENTS)}, "do_not_contact": {"type": "boolean"}, "email": _or_null(_text(254, 3)),
        "postal_address": _or_null(address), "segment": {"enum": list(schemas.SEGMENTS)}, "giving": giving, "last_contact_date": _or_null(_DAY), "facts": {"type": "array", "maxItems": 25, "items": _fact(("crm",))},
    })


def _campaign() -> dict:
    no_ask = _object({"strategy": {"const": "none"}, "currency": {"enum": ISO_4217}})
    ask = _object({"strategy": {"const": "last_gift_multiplier"}, "currency": {"enum": ISO_4217}, "multiplier": {"type": "string", "pattern": "^[0-5]\\.[0-9]{2}$"}} | {n: _MONEY for n in campaign.ASK[3:]})
    return _object({n: _text(most, least) for n, (least, most) in campaign.TEXTS.items()} | {
        "tone": {"enum": list(campaign.TONES)}, "sender": _object({"name": _text(), "role": _text()}), "call_to_action": _object({"label": _text(), "url": {"type": "string", "maxLength": 2048, "pattern": "^https://"}}),
        "as_of_date": _DAY, "minimum_days_between_contacts": {"type": "integer", "minimum": 0, "maximum": 365}, "ask_policy": {"oneOf": [no_ask, ask]},
        "review_policy": _object({"segments": {"type": "array", "maxItems": campaign.MOST_SEGMENTS, "uniqueItems": True, "items": {"enum": list(schemas.SEGMENTS)}}, "ask_amount_at_or_above": _MONEY}),
        "facts": {"type": "array", "maxItems": campaign.MOST_FACTS, "items": _fact(("campaign", "organization"))}, "prohibited_phrases": {"type": "array", "maxItems": campaign.MOST_PHRASES, "items": _text()},
    })


def _result() -> dict:
    codes, issue = {"type": "array", "items": {"type": "string"}}, _object({"field": {"type": "string"}, "code": {"type": "string"}})
    audit = _object({"policy_version": {"type": "string"}, "evaluated_on": _DAY, "input_fingerprint": {"type": "string", "pattern": "^[0-9a-f]{64}$"}, "provider_name": _or_null({"type": "string"}), "provider_called": {"type": "boolean"}})
    base = _object({
        "record_index": {"type": "integer", "minimum": 1}, "donor_id": _or_null({"type": "string"}), "campaign_id": {"type": "string"}, "channel": _or_null({"enum": list(schemas.CHANNELS)}), "status": {"enum": list(STATUSES)}, "review_required": {"type": "boolean"},
        "reason_codes": codes | {"maxItems": 25}, "validation_issues": {"type": "array", "maxItems": 25, "items": issue}, "quality_issues": codes, "subject_line": _or_null(_text(200)), "body": _or_null(_text(6_000)), "ask_cents": _or_null({"type": "integer"}),
        "fact_ids_used": _or_null(codes), "excluded_fact_ids": codes, "audit": audit,
    })
    when = lambda status, then: {"if": {"properties": {"status": {"const": status}}}, "then": {"properties": then}}
    some, none, null = {"minItems": 1}, {"maxItems": 0}, {"type": "null"}
    return base | {"allOf": [when("invalid", {"validation_issues": some, "channel": null, "body": null}), when("draft_ready", {"reason_codes": none, "body": {"type": "string"}}), when("review_required", {"reason_codes": some, "body": {"type": "string"}}), *[when(s, {"reason_codes": some, "body": null}) for s in ("blocked", "suppressed", "provider_error")], when("quality_rejected", {"quality_issues": some, "body": null})]}


def documents() -> dict[str, dict]:
    """File name -> schema."""
    head = {"$schema": "https://json-schema.org/draft/2020-12/schema", "$comment": "Comparisons between fields, text safety and policy are checked when records are judged."}
    return {f"{name}.schema.json": head | {"title": name} | schema for name, schema in (("campaign-brief", _campaign()), ("donor-record", _donor()), ("outreach-result", _result()))}


def write(folder: str) -> None:
    Path(folder).mkdir(parents=True, exist_ok=True)
    for name, schema in documents().items():
        (Path(folder) / name).write_text(json.dumps(schema, indent=2, sort_keys=True) + "\n", encoding="utf-8")
