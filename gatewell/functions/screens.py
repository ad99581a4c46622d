"""The text screens: word patterns, amounts of money and contact details, over all security views of a text.

Every predicate takes an array of views (own), made once a text by views.views(), and is false for null. Patterns are
alternations that mean the same in Java and Python; functions/scan.py applies them to whole records. Contact details need parsing and are found by Arrow functions, which get only
those views that hold a sign of one; the others cost a null.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewell.functions import contacts, lexicons
from gatewell.functions.lexicons import JAVA, joined

# Words and signs of money.
ISO_4217 = """AED AFN ALL AMD AOA ARS AUD AWG AZN BAM BBD BDT BHD BIF BMD BND BOB BOV BRL BSD BTN BWP BYN BZD CAD CDF CHE CHF CHW CLF CLP CNY
 COP COU CRC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD HNL HTG HUF IDR ILS INR IQD IRR ISK
 JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU MUR MVR MWK MXN MXV MYR MZN NAD
 NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD SHP SLE SOS SRD SSP STN SVC SYP SZL THB
 TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD USN UYI UYU UYW UZS VED VES VND VUV WST XAD XAF XAG XAU XBA XBB XBC XBD XCD XCG XDR XOF XPD
 XPF XPT XSU XTS XUA XXX YER ZAR ZMW ZWG""".split()
COMMON_CODES = "AED AUD BRL CAD CHF CNY EUR GBP INR JPY KRW MXN SAR USD ZAR".split()
CURRENCIES = r"(?:ariary|baht|balboa|birr|bolivares?|cedis?|cordobas?|dalasis?|dinars?|dirhams?|dobras?|dollars?|escudos?|euros?|florins?|forints?|francs?|gourdes?|guaranis?|guilders?|hryvnias?|korunas?|kronas?|kroner|kronor|kwachas?|kwanzas?|laris?|leks?|lempiras?|lei|leus?|lilangeni|liras?|lotis?|manats?|meticais|metical|nairas?|ngultrums?|ouguiyas?|paangas?|patacas?|pesos?|pulas?|quetzales?|renminbi|rials?|riyals?|roubles?|rubles?|rufiyaas?|rupees?|rupiahs?|shekels?|shillings?|somonis?|soms?|takas?|talas?|tenges?|tugriks?|vatu|yuan|yen|zlotys?)"
COUNTRIES = r"(?:American|Australian|Brazilian|British|Canadian|Chinese|Emirati|Hong Kong|Indian|Japanese|Mexican|New Zealand|Russian|Saudi|Singapore|South African|South Korean|Swiss)"
NATIONAL = r"(?:Armenian\s+drams?|Brazilian\s+(?:real|reais)|British\s+pounds?|Costa\s+Rican\s+colones?|Deutsche\s+marks?|German\s+marks?|Lao\s+kips?|North\s+Korean\s+won|Peruvian\s+soles?|pounds?\s+sterling|Sierra\s+Leonean\s+leones?|South\s+African\s+rand|South\s+Korean\s+won|Vietnamese\s+dong)"
AFTER_AMOUNT = r"(?:colones?|dong|drams?|kips?|leones?|marks?|pounds?|rand|reals?|soles?|won)"
COLLOQUIAL = r"(?:bucks?|quid|cents?|pence|grand)"
#: the currency signs of Unicode 14, whatever tables Java and Python have
SYMBOLS = "[$\u00A2-\u00A5\u058F\u060B\u07FE\u07FF\u09F2\u09F3\u09FB\u0AF1\u0BF9\u0E3F\u17DB\u20A0-\u20C0\uA838\uFDFC\uFE69\uFF04\uFFE0\uFFE1\uFFE5\uFFE6\U00011FDD-\U00011FE0\U0001E2FF\U0001ECB0]"
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
QUANTITIES = r"(?:a\s+dozen|dozens?|hundreds|thousands|millions|billions|scores?\s+of|twice\s+as\s+many|double\s+the\s+(?:number|amount|count))"
GAP = r"[\s:;,./=+~−∼≈()\[\]{}\-‐-―]{0,32}"
ABOUT = r"(?:approximately|about|around|roughly|nearly|up\s+to|at\s+least|more\s+than|less\s+than)"
RUN = r"\d(?:[\d,_]*\d)?"
DIGITS = rf"{RUN}(?:\.\d(?:[\d_]*\d)?)?(?:e[+\-−]?{RUN})?(?:mn|mm|bn|k|m|b)?"
NAMED_GIVING = r"(?!\s*,?\s*(?:the\s+)?(?:campaign|foundation|organization|program|team|volunteers?)\b)[^.!?\n]{0,48}\b(?:gave|gift(?:ed)?|donat(?:e|ed)|contribut(?:e|ed)|pledg(?:e|ed))\b[^.!?\n]{0,48}"
#: numerals beyond ASCII
NUMERAL = r"[\p{N}〇一二三四五六七八九十百千万億兆零&&[^0-9]]"

_VALUE = f"(?:{'|'.join(NUMBERS)})"
WORDS = rf"(?:{_VALUE}(?:[ -]+(?:{'|'.join([*NUMBERS, 'and', 'a', 'an'])})){{0,9}}|(?:a|an)[ -]+(?:hundred|thousand|million|billion)(?:[ -]+(?:{'|'.join([*NUMBERS, 'and', 'a', 'an'])})){{0,8}})"
_NAMED = rf"(?:(?:{COUNTRIES}\s+)?{CURRENCIES}|{NATIONAL})"
_CODES = rf"(?i:{'|'.join(COMMON_CODES)})|(?-i:{'|'.join(ISO_4217)})"
MARKER = rf"(?:{_CODES}|{SYMBOLS}|{_NAMED}|{COLLOQUIAL})"
ELIDED = rf"(?:(?m:^)|[.!?]\s+)(?:(?:gave|gifted|donated|contributed|pledged)\b[^.!?\n]{{0,48}}(?:{DIGITS}|{WORDS})|(?:a\s+gift|donation|contribution)\s+(?:of|was|is)?\s*(?:{DIGITS}|{WORDS}))(?!\w)"


def _alone(pattern: str) -> str:
    return rf"(?<!\w){pattern}(?!\w)"


def _money() -> list[str]:
    """A marker and an amount, in digits or words, in either order, with a gap or brackets between; an article and a name."""
    amount, after = f"(?:{DIGITS}|{WORDS})", f"(?:{MARKER}|{AFTER_AMOUNT})"
    return [
        _alone(rf"{MARKER}(?:{GAP}(?:{ABOUT}{GAP})?{amount}|\s*\(\s*{amount}\s*\))"),
        _alone(rf"{amount}(?:{GAP}(?:(?:in|of){GAP})?{after}|\s*\(\s*{after}\s*\))"),
        rf"\b(?:a|an)\s+(?:{CURRENCIES}|{COLLOQUIAL})\b",
    ]


MONEY = _money()
_MARK = rf"(?:{_alone(rf'(?:{_CODES}|{_NAMED}|{COLLOQUIAL})')}|{SYMBOLS})"
#: a marker with a numeral beyond ASCII within 32 characters
ODD_MONEY = rf"{NUMERAL}[\s\S]{{0,31}}{_MARK}[\s\S]{{0,32}}|[\s\S]{{0,32}}{_MARK}[\s\S]{{0,31}}{NUMERAL}"
#: what any expression of money holds
MONEY_HINT = rf"{SYMBOLS}|\d|{NUMERAL}|\b(?:{'|'.join(NUMBERS)}|an?)\b"
WORD_NUMBERS = [_alone(WORDS), _alone(QUANTITIES)]

PATTERNS: dict[str, list[str]] = {
    "instruction": lexicons.INSTRUCTION,
    "policy_control": lexicons.POLICY_CONTROL,
    "giving_field": [lexicons.GIVING_FIELD],
    "giving_context": [lexicons.GIVING_CONTEXT, ELIDED],
    "solicitation": lexicons.ASKING + lexicons.ASKING_SOURCE,
    "provider_solicitation": lexicons.ASKING + lexicons.ASKING_SOURCE + lexicons.ASKING_PROVIDER,
    "money": [*MONEY, ODD_MONEY],
    "word_numbers": WORD_NUMBERS,
}


def hit(own: Column, name: str) -> Column:
    """Whether a screen's patterns occur in one of the views."""
    pattern = JAVA + joined(PATTERNS[name])

    def found(v: Column) -> Column:
        if name == "policy_control":
            return v.rlike(pattern) | F.regexp_replace(v, "[._:-]+", " ").rlike(pattern)
        return v.rlike(JAVA + MONEY_HINT) & v.rlike(pattern) if name == "money" else v.rlike(pattern)

    return F.coalesce(F.exists(own, found), F.lit(False))


def expressions(own: Column, name: str) -> Column:
    """array<string>: the distinct matches of a screen's patterns in the views, by view and pattern."""
    each = lambda v: F.flatten(F.array(*[F.regexp_extract_all(v, F.lit(JAVA + p), F.lit(0)) for p in PATTERNS[name]]))
    return F.array_distinct(F.transform(F.flatten(F.transform(own, each)), lambda m: F.trim(m)))


def quoted(literal: Column) -> Column:
    """A pattern that matches the literal only."""
    return F.concat(F.lit("\\Q"), F.replace(literal, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def _found(own: Column, pattern: Column) -> Column:
    return F.coalesce(F.exists(own, lambda v: F.regexp_like(v, pattern)), F.lit(False))


def giving_history(own: Column, names: Column | None = None) -> Column:
    """Giving fields, giving in context, and giving by one of the names (array<string> of their views)."""
    told = hit(own, "giving_field") | hit(own, "giving_context")
    if names is None:
        return told
    known = F.filter(names, lambda n: F.length(n) >= 2)
    pattern = F.concat(F.lit(JAVA + r"(?<!\w)(?:"), F.array_join(F.transform(known, quoted), "|"), F.lit(rf")(?!\w){NAMED_GIVING}(?:{DIGITS}|{WORDS})(?!\w)"))
    return told | (F.coalesce(F.size(known) > 0, F.lit(False)) & _found(own, pattern))


def identifier(own: Column, id_views: Column) -> Column:
    """Whether one of the views holds an identifier as a token of its own."""
    pattern = F.concat(F.lit("(?iu)(?<![A-Za-z0-9])(?:"), F.array_join(F.transform(id_views, quoted), "|"), F.lit(")(?![A-Za-z0-9])"))
    return F.coalesce(F.size(id_views) > 0, F.lit(False)) & _found(own, pattern)


def literals(own: Column, literal_views: Column) -> Column:
    """Whether a view is one of the literals, or holds one of at least four characters, or three digits, as a token.

    literal_views: array<string>. Shorter literals count inside a view where any view speaks of an address.
    """
    folded = F.transform(literal_views, lambda x: F.lower(x))
    same = F.exists(own, lambda v: F.array_contains(folded, F.lower(v)))
    cued = F.exists(own, lambda v: v.rlike(JAVA + contacts.ADDRESS_CUE))
    long = F.filter(literal_views, lambda x: (F.length(x) >= 4) | x.rlike("(?U)^\\d{3}\\z") | cued)
    pattern = F.concat(F.lit(JAVA + r"(?<!\w)(?:"), F.array_join(F.transform(long, quoted), "|"), F.lit(r")(?!\w)"))
    return F.coalesce(same | ((F.size(long) > 0) & _found(own, pattern)), F.lit(False))


def holds(own: Column, literal_views: Column) -> Column:
    """Whether a view holds one of the literals whole, not as a part of longer words."""
    edged = lambda x: F.concat(F.when(x.rlike("(?U)^\\w"), "(?<!\\w)").otherwise(""), quoted(x), F.when(x.rlike("(?U)\\w\\z"), "(?!\\w)").otherwise(""))
    some = F.filter(literal_views, lambda x: F.length(x) > 0)
    pattern = F.concat(F.lit(JAVA + "(?:"), F.array_join(F.transform(some, edged), "|"), F.lit(")"))
    return F.coalesce((F.size(some) > 0) & _found(own, pattern), F.lit(False))


@F.arrow_udf(T.BooleanType())
def _contact(lists: pa.Array) -> pa.Array:
    return pa.array([any(map(contacts.found, v or ())) for v in lists.to_pylist()], pa.bool_())


def contact(own: Column) -> Column:
    """Whether one of the views holds a contact detail of any kind."""
    signs = F.filter(own, lambda v: v.rlike(JAVA + contacts.HINT))
    return F.coalesce(_contact(F.when(F.size(signs) > 0, signs)), F.lit(False))


def contact_literals(email: Column, address: Column) -> Column:
    """array<string>: e-mail, the parts of a postal address, and the ways in which they are written together."""
    part = lambda name: address[name]
    parts = F.array(*[part(n) for n in ("line_1", "line_2", "city", "region", "postal_code", "country_code")])
    some = F.array_compact(parts)
    joined = F.array(F.array_join(some, " "), F.array_join(some, ", "), F.concat_ws(" ", part("city"), part("region"), part("postal_code")))
    return F.array_distinct(F.array_compact(F.concat(F.array(email), F.when(address.isNotNull(), F.concat(parts, joined)).otherwise(F.array().cast("array<string>")))))


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))
