"""Registered queries of the record operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewell.functions import fingerprint, lexicons, money
from gatewell.operators import draft, facts, policy
from gatewell.plans.bindings import POLICY, contacts, dealt, donor_facts, donors, gifts, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

GIFTS = "select o_custkey, cents as last_gift_cents, day as last_gift_date, largest_cents, lifetime_cents, n_gifts from (select o_custkey, o_orderkey, cast(o_orderdate as date) as day, cast(round(o_totalprice * 100) as bigint) as cents, max(cast(round(o_totalprice * 100) as bigint)) over (partition by o_custkey) as largest_cents, cast(sum(cast(round(o_totalprice * 100) as bigint)) over (partition by o_custkey) as bigint) as lifetime_cents, count(*) over (partition by o_custkey) as n_gifts, row_number() over (partition by o_custkey order by cast(o_orderdate as date) desc, o_orderkey desc) as n from orders) where n = 1"
CONTACTS = "select user_id, cast(ts as date) as last_contact_date, event_type as last_event from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1"
DONORS = f"""select c_custkey as custkey, 'CUST-' || c_custkey as donor_id, split_part(c_name, '#', 1) as first_name,
 case when c_custkey % 3 <> 0 then 'Family' || c_nationkey end as last_name, case when c_custkey % 7 = 0 then 'Dr.' end as title,
 case when c_custkey % 5 = 0 then 'letter' else 'email' end as channel, case when last_event = 'error' then 'denied' when last_event = 'view' then 'unknown' else 'granted' end as consent,
 c_acctbal < 0 as do_not_contact, case when c_custkey % 11 <> 0 then 'c' || c_custkey || '@example.org' end as email, c_custkey % 13 <> 0 as has_address,
 case c_mktsegment when 'AUTOMOBILE' then 'general' when 'BUILDING' then 'mid_value' when 'FURNITURE' then 'major' when 'HOUSEHOLD' then 'principal' when 'MACHINERY' then 'lapsed' end as segment,
 case when c_custkey % 17 = 0 then 'EUR' else 'USD' end as currency, last_gift_cents, last_gift_date, largest_cents, lifetime_cents, n_gifts, last_contact_date
 from customer left join ({GIFTS}) on c_custkey = o_custkey left join ({CONTACTS}) on c_custkey = user_id"""
ASK = f"case when last_gift_cents is not null then least(greatest(((2 * last_gift_cents * {POLICY.multiplier} + {100 * POLICY.increment}) // {200 * POLICY.increment}) * {POLICY.increment}, {POLICY.least}), {POLICY.most}) end"
DAYS = f"date_diff('day', last_contact_date, date '{POLICY.as_of}')"
RENDERED = "'USD ' || regexp_replace(format('{:,}', ask_cents // 100) || '.' || lpad(cast(ask_cents % 100 as varchar), 2, '0'), '\\.00$', '')"
SUPPRESS = "concat_ws(',', case when do_not_contact then 'do_not_contact' end, case when consent = 'denied' then 'consent_denied' end)"
BLOCK = f"concat_ws(',', case when consent = 'unknown' then 'consent_unknown' end, case when channel = 'email' and email is null then 'missing_email' end, case when channel = 'letter' and not has_address then 'missing_postal_address' end, case when n_days < 0 then 'last_contact_date_in_future' end, case when last_gift_date > date '{POLICY.gifts_as_of}' then 'last_gift_date_in_future' end, case when currency <> 'USD' then 'giving_currency_mismatch' end, case when ask_cents is null then 'missing_ask_basis' end)"
REVIEW = f"concat_ws(',', case when segment in ('major', 'principal') then 'relationship_managed_segment' end, case when ask_cents >= {POLICY.review_from} then 'high_value_ask' end)"
PACED = f"case when n_days between 0 and {POLICY.least_days - 1} then 'contact_frequency_limit' else '' end"
STAGES = f"select *, {SUPPRESS} as s, {BLOCK} as b, {PACED} as p, {REVIEW} as r from (select *, {ASK} as ask_cents, {DAYS} as n_days from ({DONORS}))"
DECIDED = f"select *, case when s <> '' then s when b <> '' then b when p <> '' then p else r end as codes, case when s <> '' then 'suppress' when b <> '' then 'block' when p <> '' then 'suppress' when r <> '' then 'review' else 'allow' end as disposition from ({STAGES})"
STATUS = "case disposition when 'suppress' then 'suppressed' when 'block' then 'blocked' when 'review' then 'review_required' else 'draft_ready' end"
GREETING = "case when coalesce(title, '') <> '' and coalesce(last_name, '') <> '' then 'Dear ' || title || ' ' || last_name || ',' else 'Hi ' || first_name || ',' end"


def query(oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.decide(dealt(donors(spark, sf_dir)), POLICY)


@query(f"select custkey, {ASK} as ask_cents from ({DONORS})")
def ask_amount(spark, sf_dir):
    return donors(spark, sf_dir).select("custkey", money.ask_cents(F.col("last_gift_cents"), POLICY.multiplier, POLICY.increment, POLICY.least, POLICY.most).alias("ask_cents"))


@query("select c_custkey as custkey, cast(null as bigint) as ask_cents from customer")
def ask_amount_no_policy(spark, sf_dir):
    return policy.decide(donors(spark, sf_dir), policy.Policy(as_of=POLICY.as_of, multiplier=None)).select("custkey", "ask_cents")


@query(f"select custkey, {RENDERED} as rendered from (select custkey, {ASK} as ask_cents from ({DONORS}))")
def ask_text(spark, sf_dir):
    return ask_amount(spark, sf_dir).select("custkey", money.format_cents(F.lit("USD"), F.col("ask_cents")).alias("rendered"))


@query(f"select custkey, coalesce('Would you consider a gift of ' || {RENDERED} || ' to support Winter Beds?', 'Please consider supporting Winter Beds in a way that is right for you.') as paragraph from (select custkey, {ASK} as ask_cents from ({DONORS}))")
def ask_paragraph(spark, sf_dir):
    return ask_text(spark, sf_dir).select("custkey", money.ask_paragraph(F.lit("Winter Beds"), F.col("rendered")).alias("paragraph"))


@query(GIFTS)
def giving_aggregates(spark, sf_dir):
    return gifts(spark, sf_dir)


@query(f"select o_custkey, largest_cents >= last_gift_cents and lifetime_cents >= largest_cents and lifetime_cents >= last_gift_cents as consistent from ({GIFTS})")
def giving_consistency(spark, sf_dir):
    ok = (F.col("largest_cents") >= F.col("last_gift_cents")) & (F.col("lifetime_cents") >= F.col("largest_cents")) & (F.col("lifetime_cents") >= F.col("last_gift_cents"))
    return gifts(spark, sf_dir).select("o_custkey", ok.alias("consistent"))


@query(f"select user_id, {DAYS} as n_days from ({CONTACTS})")
def contact_cadence(spark, sf_dir):
    return contacts(spark, sf_dir).select("user_id", F.datediff(F.lit(POLICY.as_of).cast("date"), F.col("last_contact_date")).cast("bigint").alias("n_days"))


@query(f"select n_days, n_days between 0 and {POLICY.least_days - 1} as limited, count(*) as n from (select {DAYS} as n_days from ({CONTACTS})) group by all")
def cadence_boundary(spark, sf_dir):
    return contact_cadence(spark, sf_dir).groupBy("n_days", F.col("n_days").between(0, POLICY.least_days - 1).alias("limited")).agg(F.count("*").alias("n"))


@query(f"select custkey, disposition from ({DECIDED})")
def policy_disposition(spark, sf_dir):
    return _decided(spark, sf_dir).select("custkey", "disposition")


@query(f"select custkey, codes as reason_codes from ({DECIDED})")
def policy_reason_codes(spark, sf_dir):
    return _decided(spark, sf_dir).select("custkey", F.array_join("reason_codes", ",").alias("reason_codes"))


@query(f"select {STATUS} as status, count(*) as n from ({DECIDED}) group by 1")
def status_counts(spark, sf_dir):
    return _decided(spark, sf_dir).groupBy(policy.status(F.col("disposition")).alias("status")).agg(F.count("*").alias("n"))


@query(f"select custkey, segment, ask_cents, r as reasons from ({STAGES}) where r <> ''")
def review_gates(spark, sf_dir):
    asked = money.ask_cents(F.col("last_gift_cents"), POLICY.multiplier, POLICY.increment, POLICY.least, POLICY.most)
    rows = donors(spark, sf_dir).select("custkey", "segment", asked.alias("ask_cents"))
    reasons = policy.collect((F.col("segment").isin(*POLICY.review_segments), "relationship_managed_segment"), (F.col("ask_cents") >= POLICY.review_from, "high_value_ask"))
    return rows.select("custkey", "segment", "ask_cents", F.array_join(reasons, ",").alias("reasons")).filter("reasons <> ''")


@query(f"select custkey, {GREETING} as salutation from ({DONORS})")
def salutation(spark, sf_dir):
    return donors(spark, sf_dir).select("custkey", policy.salutation(F.col("first_name"), F.col("last_name"), F.col("title")).alias("salutation"))


@query(f"select custkey, concat_ws('|', first_name, last_name, title, concat_ws(' ', first_name, last_name, title), case when last_name is not null and title is not null then title || ' ' || last_name else first_name end) as views from ({DONORS})")
def identity_views(spark, sf_dir):
    return donors(spark, sf_dir).select("custkey", F.array_join(policy.identity_views(F.col("first_name"), F.col("last_name"), F.col("title")), "|").alias("views"))


#: the SQL of these two is left as it was given; it has no drafting and policy claim patterns, which no text of the tables holds
_GIVEN = lexicons.SCREENS | {"instruction": lexicons.INSTRUCTION[:12], "policy_control": [p for k, p in enumerate(lexicons.POLICY_CONTROL) if k not in (15, 17, 18)]}


def _sql_screen(name: str, column: str = "text") -> str:
    return f"coalesce(regexp_matches({column}, '(?i){lexicons.union(_GIVEN[name]).replace(chr(39), chr(39) * 2)}'), false)"


def _sql_refanged(column: str = "text") -> str:
    for pattern, sign in lexicons.DEFANGED.items():
        column = f"regexp_replace({column}, '(?i){pattern}', '{sign}', 'g')"
    return column


_CONTACT = " or ".join(_sql_screen(n, c) for c in ("text", _sql_refanged()) for n in ("email", "uri", "ip", "phone"))
_FACTS = f"""select doc_id, source, fact_id, case when doc_id <> first_id then 'duplicate_id' when not coalesce(quality = 1, false) then 'not_approved' when {_CONTACT} then 'contact_like' when {_sql_screen("instruction")} then 'instruction_like'
 when {_sql_screen("policy_control")} then 'policy_control_like' when {_sql_screen("solicitation")} then 'solicitation_like' when {_sql_screen("money")} then 'monetary' when {_sql_screen("giving_field")} then 'giving_history' else 'eligible' end as flag
 from (select d.doc_id, source, text, quality, 'donor.doc-' || (d.doc_id % 500) as fact_id, min(d.doc_id) over (partition by source, d.doc_id % 500) as first_id from documents d left join labels using (doc_id))"""


@query(f"select doc_id, fact_id, flag from ({_FACTS})")
def fact_eligibility(spark, sf_dir):
    return donor_facts(spark, sf_dir).select("doc_id", "fact_id", facts.eligibility(F.col("first_of_id"), F.col("approved"), F.col("text")).alias("flag"))


@query(f"select distinct source, fact_id from ({_FACTS}) where flag <> 'eligible'")
def excluded_fact_ids(spark, sf_dir):
    rows = donor_facts(spark, sf_dir).withColumn("flag", facts.eligibility(F.col("first_of_id"), F.col("approved"), F.col("text")))
    return rows.filter("flag <> 'eligible'").select("source", "fact_id").distinct()


def _detector(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "documents").select("doc_id", lexicons.screen(F.col("text"), name).alias("hit"))

    QUERIES[f"detect_{name}"] = run
    ORACLES[f"detect_{name}"] = f"select doc_id, {_sql_screen(name)} as hit from documents"


for _name in lexicons.SCREENS:
    if _name != "html":
        _detector(_name)


@query(f"select doc_id, {_CONTACT} as hit from documents")
def detect_contact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", lexicons.contact(F.col("text")).alias("hit"))


@query("select page_id, " + _sql_screen("html", "html") + " as hit from pages")
def detect_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", lexicons.screen(F.col("html"), "html").alias("hit"))


_BODY = f"""concat_ws(chr(10) || chr(10), {GREETING}, 'Thank you for being part of River Shelter''s community.', 'This campaign adds beds for people without a home in winter.', 'Each bed is kept ready by a volunteer.',
 coalesce('Would you consider a gift of ' || {RENDERED} || ' to support Winter Beds?', 'Please consider supporting Winter Beds in a way that is right for you.'), 'Give safely: https://give.example.org/beds', 'With gratitude,' || chr(10) || 'Kim Park' || chr(10) || 'Director')"""


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = donors(spark, sf_dir)
    ask = money.ask_cents(F.col("last_gift_cents"), POLICY.multiplier, POLICY.increment, POLICY.least, POLICY.most)
    greeting = policy.salutation(F.col("first_name"), F.col("last_name"), F.col("title"))
    text = draft.body(greeting, F.lit("River Shelter"), F.lit("This campaign adds beds for people without a home in winter."), F.lit("Each bed is kept ready by a volunteer."), F.lit(None).cast("string"), money.ask_paragraph(F.lit("Winter Beds"), money.format_cents(F.lit("USD"), ask)), F.lit("Give safely"), F.lit("https://give.example.org/beds"), F.lit("Kim Park"), F.lit("Director"))
    return rows.select("custkey", "channel", text.alias("body"))


@query(f"select custkey, {_BODY} as body from (select *, {ASK} as ask_cents from ({DONORS}))")
def template_body(spark, sf_dir):
    return _bodies(spark, sf_dir).select("custkey", "body")


@query(f"select custkey, case when channel = 'email' then 'Support Winter Beds' end as subject from ({DONORS})")
def template_subject(spark, sf_dir):
    return donors(spark, sf_dir).select("custkey", draft.subject(F.col("channel"), F.lit("Winter Beds")).alias("subject"))


@query("select conv_id, turn, len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: trim(p, ' ') = '')) > 0 or starts_with(text, chr(10)) or ends_with(text, chr(10)) or contains(text, repeat(chr(10), 3)) or len(list_filter(string_split(text, chr(10)), lambda x: x <> '' and trim(x, ' ') = '')) > 0 as broken, len(string_split(text, chr(10) || chr(10))) as paragraphs from conversations where text is not null")
def guard_structure(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("text is not null")
    return rows.select("conv_id", "turn", draft.structure_issue(F.col("text")).alias("broken"), F.size(F.split("text", "\n\n", -1)).cast("bigint").alias("paragraphs"))


@query("select conv_id, turn, concat_ws(',', " + ", ".join(f"case when {_sql_screen(n)} then '{n}' end" for n in ("html", "email", "uri", "phone", "money", "pressure")) + ") as issues from conversations")
def guard_issues(spark, sf_dir):
    names = ("html", "email", "uri", "phone", "money", "pressure")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(policy.collect(*[(lexicons.screen(F.col("text"), n), n) for n in names]), ",").alias("issues"))


@query()
def guard_text_issues(spark, sf_dir):
    """All text rules of the output guard; guard_issues has the six plain screens that its SQL names."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(draft.text_issues(F.col("text"), ("licensed under",)), ",").alias("issues"))


@query("select doc_id, contains(lower(text), 'licensed under') as hit from documents")
def prohibited_phrase(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.contains(F.lower("text"), F.lit("licensed under")).alias("hit"))


@query("select a.conv_id, a.turn as turn, b.turn as next_turn, right(a.text, 192) || ' ' || left(b.text, 192) as view from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1")
def edge_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("next_turn"), F.left("text", F.lit(192)).alias("head"))
    return rows.join(after, ["conv_id", "turn"]).select("conv_id", "turn", "next_turn", F.concat(F.right("text", F.lit(192)), F.lit(" "), F.col("head")).alias("view"))


@query("select doc_id, sha256(text || chr(10)) as digest from documents")
def line_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fingerprint.line_digest(F.col("text")).alias("digest"))


@query()
def row_fingerprint(spark, sf_dir):
    return donors(spark, sf_dir).select("custkey", fingerprint.row_digest(F.col("donor_id"), F.col("segment"), F.col("last_gift_cents"), F.col("last_contact_date")).alias("digest"))
