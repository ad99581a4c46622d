"""The eligibility decision as columns: ordered reason codes and a disposition."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewell.functions import money, scan, shipping

#: fixed values: what is told of a fact -> the reason, in order
FACT_REASONS = {
    "instruction": "instruction_like_fact_excluded",
    "solicitation": "solicitation_like_fact_excluded",
    "money": "monetary_fact_excluded",
    "contact": "contact_like_fact_excluded",
    "identifier": "donor_identifier_fact_excluded",
    "policy_control": "policy_control_like_fact_excluded",
    "giving_history": "giving_history_fact_excluded",
}


@dataclass(frozen=True)
class Policy:
    """A campaign's rules; amounts in cents, the multiplier in hundredths. multiplier None: no ask."""

    as_of: str
    least_days: int = 30
    currency: str = "USD"
    multiplier: int | None = 125
    increment: int = 500
    least: int = 2_500
    most: int = 500_000
    review_from: int = 100_000
    review_segments: tuple[str, ...] = ("major", "principal")
    gifts_as_of: str | None = None
    campaign_name: str = ""
    extra: dict = field(default_factory=dict)


def collect(*rules: tuple[Column, str]) -> Column:
    """The codes of the rules that hold, in this order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.lit(code)) for when, code in rules]))


def identity_views(first: Column, last: Column, title: Column) -> Column:
    """The name parts that are there, all of them joined, and how the person is addressed."""
    parts = F.array_compact(F.array(first, last, title))
    addressed = F.when(last.isNotNull() & title.isNotNull(), F.concat_ws(" ", title, last)).otherwise(first)
    return F.array_compact(F.array(first, last, title, F.array_join(parts, " "), addressed))


def salutation(first: Column, last: Column, title: Column) -> Column:
    named = (F.coalesce(title, F.lit("")) != "") & (F.coalesce(last, F.lit("")) != "")
    return F.when(named, F.concat(F.lit("Dear "), title, F.lit(" "), last, F.lit(","))).otherwise(F.concat(F.lit("Hi "), first, F.lit(",")))


def decide(donors: DataFrame, policy: Policy, fact_flags: dict[str, Column] | None = None) -> DataFrame:
    """donors with ask_cents, n_days, reason_codes and disposition.

    Reads donor_id, first_name, last_name, title, channel, consent, do_not_contact, email, has_address, segment,
    currency, last_gift_cents, last_gift_date and last_contact_date. The first stage with a reason decides: suppressed
    by flag or consent, blocked, suppressed by cadence, review, else allowed. fact_flags adds review reasons of facts.
    A column `literals` (array<string>), where there is one, holds the person's contact details; else the e-mail is it.
    """

    asks = policy.multiplier is not None
    ask = money.ask_cents(F.col("last_gift_cents"), policy.multiplier, policy.increment, policy.least, policy.most) if asks else F.lit(None).cast("bigint")
    days = F.datediff(F.lit(policy.as_of).cast("date"), F.col("last_contact_date"))
    rows = donors.withColumns({"ask_cents": ask, "n_days": days.cast("bigint")})
    literals = F.col("literals") if "literals" in donors.columns else F.array_compact(F.array("email"))
    named = identity_views(F.col("first_name"), F.col("last_name"), F.col("title"))
    rows = rows.withColumn("__kinds", scan.texts_kinds(named, F.col("donor_id"), F.col("first_name"), F.col("last_name"), literals))
    is_kind = lambda name: F.array_contains("__kinds", name)
    # the codes are fixed values, as is their order
    stopped = collect((F.col("do_not_contact"), "do_not_contact"), (F.col("consent") == "denied", "consent_denied"))
    blocked = collect(
        (F.col("consent") == "unknown", "consent_unknown"),
        ((F.col("channel") == "email") & F.col("email").isNull(), "missing_email"),
        ((F.col("channel") == "letter") & ~F.col("has_address"), "missing_postal_address"),
        *([(fact_flags["duplicate_id"], "duplicate_fact_id_across_inputs")] if fact_flags and "duplicate_id" in fact_flags else []),
        (is_kind("instruction"), "instruction_like_identity_field"),
        (is_kind("policy_control"), "policy_control_like_identity_field"),
        (is_kind("giving_history"), "giving_history_like_identity_field"),
        (is_kind("solicitation") | is_kind("money"), "solicitation_like_identity_field"),
        (is_kind("contact"), "contact_like_identity_field"),
        (is_kind("identifier"), "donor_identifier_in_identity_field"),
        (F.col("n_days") < 0, "last_contact_date_in_future"),
        (F.col("last_gift_date") > F.lit(policy.gifts_as_of or policy.as_of).cast("date"), "last_gift_date_in_future"),
        (F.lit(asks) & (F.col("currency") != policy.currency), "giving_currency_mismatch"),
        (F.lit(asks) & F.col("ask_cents").isNull(), "missing_ask_basis"),
    )
    paced = collect((F.col("n_days").between(0, policy.least_days - 1), "contact_frequency_limit"))
    review = collect(
        (F.col("segment").isin(*policy.review_segments), "relationship_managed_segment"),
        (F.col("ask_cents") >= policy.review_from, "high_value_ask"),
        *[(fact_flags[k], code) for k, code in FACT_REASONS.items() if fact_flags and k in fact_flags],
    )
    rows = rows.withColumns({"__s": stopped, "__b": blocked, "__p": paced, "__r": review})
    stages = (("__s", "suppress"), ("__b", "block"), ("__p", "suppress"), ("__r", "review"))
    codes, disposition = F.array().cast("array<string>"), F.lit("allow")
    for name, outcome in reversed(stages):
        codes, disposition = F.when(F.size(name) > 0, F.col(name)).otherwise(codes), F.when(F.size(name) > 0, F.lit(outcome)).otherwise(disposition)
    return rows.withColumns({"reason_codes": codes, "disposition": disposition}).drop("__kinds", *[n for n, _ in stages])


def status(disposition: Column) -> Column:
    """The status of a row whose draft passes the output guard with the built-in template."""
    return F.create_map(*map(F.lit, ("suppress", "suppressed", "block", "blocked", "review", "review_required", "allow", "draft_ready")))[disposition]
