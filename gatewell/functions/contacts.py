"""Contact details in a view of a text: e-mail and web addresses, phones, IP addresses, places, written out or defanged.

found() judges one view. HINT occurs in every text in which it can be true; texts without it never reach Python.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import regex

from gatewell.functions.views import BREAK, contact_form, phone_form

# The words and forms of contact details.
_STREET = r"(?:avenue|ave|boulevard|blvd|circle|cir|court|ct|drive|dr|highway|hwy|lane|ln|parkway|pkwy|place|pl|plaza|plz|road|rd|square|sq|street|st|terrace|ter|trail|trl|way)"
_WRITTEN_STREET = r"(?:avenue|boulevard|court|drive|highway|lane|parkway|road|street|terrace)"
_NUMBER = r"(?:zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion)"
_MORE_NUMBER = _NUMBER.replace("billion", "billion|and|a|an")
CERTAIN_TLDS = "app au biz ca charity cloud co com de dev edu foundation fr gov in info io jp me mil museum net ngo online org site store tech uk us xyz".split()
_LOCAL, _LABEL = r"[A-Z0-9][A-Z0-9._+-]{0,63}", r"[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?"
_CUE_PHONE = r"(?:call(?:\s+(?:me|us|him|her|them))?|telephone|phone|tel|mobile|text(?:\s+(?:me|us|him|her|them))?|(?:our|my|the|your)\s+(?:phone\s+)?number\s+is|(?:phone\s+)?number\s+is|(?:reach|contact)(?:\s+[A-Z][A-Z.'-]*){0,2}\s+at)"
_CUE_CODE = r"\b(?:call|dial|extension|ext\.?|phone|sms|tel|telephone|text)\b(?:\s+(?:at|code|is|me|us))?[\s:#-]{0,8}"
_DIGIT_WORD = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_WEB_WORDS, _MAIL_WORDS = r"browse|go\s+to|url|visit|web\s+site|website", r"contact|e-mail|email|reach|write\s+to"
ADDRESS_CUE = r"\b(?:address|address\s+line|city|code|country(?:\s+code)?|mailing|mailing\s+line|post\s+code|postal|region|state|zip)\b"


def _bracketed(sign: str) -> str:
    """A sign's word or the sign itself in brackets of any kind."""
    return "(?:" + "|".join(rf"{a}\s*(?:{sign})\s*{b}" for a, b in ((r"\[", r"\]"), (r"\(", r"\)"), ("<", ">"), (r"\{", r"\}"))) + ")"


_AT, _DOT, _COLON = _bracketed("at|@"), _bracketed(r"dot|period|point|\."), _bracketed("colon|:")
_ANY_AT, _ANY_DOT = rf"(?:\bat\b|{_AT})", rf"(?:\bdot\b|{_DOT})"
_TLD = r"[A-Z]{2,63}"


def _spelt(dot: str, tld: str = _TLD) -> str:
    return rf"{_LABEL}(?:\s*{dot}\s*{_LABEL}){{0,3}}\s*{dot}\s*{tld}"


_PREFIX = rf"(?:(?:hxxps?|https?)\s*:\s*/{{1,2}}\s*|www\s*{_ANY_DOT}\s*)"
_BETWEEN = r"[\s,;:./()\-]+"
_TOKEN = rf"(?:[0-9]|{_DIGIT_WORD})"
PATTERNS = [
    r"[^\s@]{1,64}@[^\s@]{1,253}",
    rf"(?<!\w){_LOCAL}\s*@\s*{_LABEL}(?:\s*\.\s*{_LABEL}){{0,3}}\s*\.\s*{_TLD}(?!\w)",
    r"(?:https?://|mailto:|www\.)[^\s<>()]+",
    r"(?<![A-Z0-9+.-])[A-Z][A-Z0-9+.-]{0,31}:[^\s<>()]+",
    r"(?<![@\w])(?:[A-Z0-9](?:[A-Z0-9-]{0,62})\.)+[A-Z]{2,63}(?:/[^\s<>()]*)?",
    r"(?<!\w)(?:\+?[0-9]{1,3}[ .-]?)?(?:\(?[0-9]{3}\)?[ .-])[0-9]{3}[ .-][0-9]{4}(?!\w)",
    r"(?<![0-9])(?:[0-9]{3}[ .-][0-9]{4}|[0-9]{10,15})(?![0-9])",
    rf"\b[0-9]{{1,6}}(?:-?[A-Z])?[,;:]?\s+[A-Z0-9.'-]+(?:\s+[A-Z0-9.'-]+){{0,4}}\s+{_STREET}\b",
    rf"\b{_NUMBER}(?:[ -]+{_MORE_NUMBER}){{0,5}}\s+[A-Z0-9.'-]+(?:\s+[A-Z0-9.'-]+){{0,4}}\s+{_WRITTEN_STREET}\b",
    r"\bP\.?\s*O\.?\s+Box\s+[0-9]+\b",
    # defanged e-mail addresses: a bracketed 'at'; plain words before a certain end; a bracketed dot; after a cue
    rf"(?<!\w){_LOCAL}\s*{_AT}\s*{_spelt(_ANY_DOT)}(?!\w)",
    rf"(?<!\w){_LOCAL}\s+at\s+{_spelt(_ANY_DOT, '(?:' + '|'.join(CERTAIN_TLDS) + ')')}(?!\w)",
    rf"(?<!\w){_LOCAL}\s+at\s+{_spelt(_DOT)}(?!\w)",
    rf"\b(?:email|e-mail|contact|reach|write\s+to)\s+{_LOCAL}\s*{_ANY_AT}\s*{_spelt(_ANY_DOT)}(?!\w)",
    # defanged hosts
    rf"(?<!\w){_spelt(_DOT)}(?!\w)",
    rf"\b(?:visit|website|web\s+site|go\s+to|browse|url)\b\s*:?\s*(?:{_PREFIX})?{_spelt(_ANY_DOT)}(?!\w)",
    rf"(?<!\w){_PREFIX}{_spelt(_ANY_DOT)}(?!\w)",
    # phones in words, after a cue, and short codes after one
    rf"(?<!\w){_DIGIT_WORD}(?:{_BETWEEN}{_DIGIT_WORD}){{6,14}}(?!{_BETWEEN}{_DIGIT_WORD})(?!\w)",
    rf"\b{_CUE_PHONE}\b[\s:,-]{{0,16}}{_TOKEN}(?:{_BETWEEN}{_TOKEN}){{6,14}}(?!{_BETWEEN}{_TOKEN})(?!\w)",
    rf"\b{_CUE_PHONE}\b[\s:,-]{{0,16}}(?:\+?1[\s.()/-]{{1,8}})?\(?[0-9]{{3}}\)?[\s./-]{{1,8}}[A-Z][A-Z0-9-]{{3,15}}(?!\w)",
    rf"{_CUE_CODE}(?<![0-9])(?:[0-9][\s./()-]*){{3,6}}(?![\s./()-]*[0-9])",
    rf"{_CUE_CODE}{_TOKEN}(?:{_BETWEEN}{_TOKEN}){{2,5}}(?!{_BETWEEN}{_TOKEN})",
]
PHONE_PATTERNS = [r"(?<![0-9])(?:\+?[0-9]{1,3}-)?[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9])", r"(?<![0-9])(?:[0-9]{3}-[0-9]{4}|[0-9]{10,15})(?![0-9])"]
_EMAIL = r"(?<![\w@])([A-Z0-9.!#$%&'*+/=?^_`{|}~-]{1,64})@([^\s/@:;,!?<>()\[\]]{3,253})"
_CUED_IP = r"\b(?:visit|server|ip\s+address|connect\s+to|endpoint|host)\b(?:\s*:(?!:)\s*|\s+)\[?([0-9A-F:.]{2,45})\]?"
_LONE_IP = r"(?<![A-Z0-9:])(?:\[([0-9A-F:.]{2,45})\]|([0-9A-F:.]{2,45}))(?![A-Z0-9:])"
_CUED_PLACE = r"\b(address|mail\s+to|write\s+to|visit)\b\s*:?\s*([^.!?\n]{3,120})"
_MET = r"\b(?:met|saw|welcomed)\s+\Z"

#: in Java and RE2: signs, digits, number words, and the words of defanged details
HINT = rf"[@:+\d]|\.[^\s]|[.。．｡]|\b(?:at|dot|period|point|colon|oh|{_NUMBER[3:-1]})\b|[^\x00-\x7F]"

_any = re.compile("|".join(f"(?:{p})" for p in PATTERNS), re.I)
_phone = re.compile("|".join(PHONE_PATTERNS))
_email, _cued_ip, _lone_ip, _place, _met = (re.compile(p, re.I) for p in (_EMAIL, _CUED_IP, _LONE_IP, _CUED_PLACE, _MET))
_web_cue, _mail_cue = (re.compile(rf"\b(?:{w})\b", re.I) for w in (_WEB_WORDS, _MAIL_WORDS))
_brackets = [(re.compile(rf"\s*{p}\s*", re.I), sign) for p, sign in ((_AT, "@"), (_DOT, "."), (_COLON, ":"))]
_words = {word: re.compile(rf"(?<=\S)\s+(?:{word})\s+(?=\S)", re.I) for word in ("at", "dot", "dot|period|point", "colon")}
_host_run, _host_label = regex.compile(r"[\p{L}\p{M}\p{N}.\-]+"), regex.compile(r"(?![-\p{M}])[\p{L}\p{M}\p{N}-]{1,63}(?<!-)")
_after_plus = regex.compile(r"(?<!\w)\+([^\p{L}\p{Nl}\p{No}\p{C}]{1,64})")
_groups = re.compile(r"(?<![A-Za-z0-9])[0-9]+(?:-[0-9]+){2,6}(?![A-Za-z0-9])")


def _encoded(labels: list[str]) -> list[bytes] | None:
    """The labels of a host as they are sent, or None where they can't be."""
    try:
        sent = [x.encode("idna") for x in labels]
    except UnicodeError:
        return None
    return sent if all(len(x) <= 63 for x in sent) and sum(map(len, sent)) + len(sent) - 1 <= 253 else None


def host(text: str) -> bool:
    """Whether some run of letters, digits, dots and dashes is a host name of two labels or more."""
    for run in _host_run.findall(contact_form(text)):
        for name in re.split(r"\.{2,}", run.strip(".")):
            *first, last = labels = name.split(".")
            if first and 2 <= len(last) <= 63 and any(map(str.isalpha, last)) and all(map(_host_label.fullmatch, labels)) and _encoded(labels):
                return True
    return False


def valid_host(name: str, known_tld: bool, tlds: frozenset[str] = frozenset(CERTAIN_TLDS)) -> bool:
    """Whether name can be looked up; known_tld asks for an end of two letters, of tlds, or beyond ASCII."""
    name = contact_form(name).strip(".")
    labels = name.split(".")
    sent = _encoded(labels) if len(labels) > 1 and len(name) <= 253 and all(labels) else None
    if sent is None or not all(re.fullmatch(rb"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?", x.lower()) for x in sent):
        return False
    end = sent[-1].decode().lower()
    return not end.isdecimal() and (not known_tld or not name.isascii() or end.startswith("xn--") or len(end) == 2 or end in tlds)


def international_phone(text: str) -> bool:
    """A plus sign and 7 to 15 digits in the 64 characters after it, at most four of which come before the first digit."""
    for m in _after_plus.finditer(text):
        lead = re.match(r"\D*", m[1])[0]
        digits = sum(map(str.isdecimal, m[1]))
        if len(lead) <= 4 and 7 <= digits <= 15:
            return True
    return False


def grouped_phone(phone_text: str) -> bool:
    """Groups of 7 to 15 digits in all that begin with a dial prefix, or four groups after a country code."""
    for m in _groups.finditer(phone_text):
        first, *rest = m[0].split("-")
        if 7 <= len(m[0]) - len(rest) <= 15 and (first.startswith(("00", "011")) or len(rest) >= 3 and len(first) <= 3):
            return True
    return False


def _is_ip(text: str) -> bool:
    try:
        ipaddress.ip_address(text)
    except ValueError:
        return False
    return True


def ip(text: str) -> bool:
    """An IP address, with a port or not, that does not follow the word version; or one after a cue."""
    for m in _lone_ip.finditer(text):
        at = (m[1] or m[2]).rstrip(".,;!?")
        before, _, port = at.rpartition(":")
        if (_is_ip(at) or "." in at and port.isdecimal() and _is_ip(before)) and not re.search(r"\bversion\s*:?\s*\Z", text[max(0, m.start() - 16) : m.start()], re.I):
            return True
    return any(_is_ip(m[1].rstrip(".,;!?")) for m in _cued_ip.finditer(text))


def place(text: str) -> bool:
    """A cue of an address, and then a number and two words; after 'visit' the number first or before a comma."""
    for cue, rest in _place.findall(text):
        if re.search(r"\d", rest) and len(re.findall(r"[^\W\d_]{2,}", rest)) >= 2 and (cue.lower() != "visit" or re.match(r"\s*\d", rest) or re.search(r"\d[^,]{0,48},", rest)):
            return True
    return False


def refanged(text: str) -> str:
    """text with bracketed signs as they are."""
    for pattern, sign in _brackets:
        text = pattern.sub(sign, text)
    return text


def respelt(text: str, cued: bool) -> str:
    """text with bracketed signs, and the words at, dot and colon between others, as signs.

    With a cue of a contact in the text, dot, period and point count only in a clause with a web cue, or with a mail
    cue and an at sign after it.
    """

    def dot(m: re.Match[str]) -> str:
        clause = re.split(f"[.!?;\n{BREAK}]", m.string[: m.start()])[-1]
        mail = _mail_cue.search(clause)
        return "." if _web_cue.search(clause) or mail and "@" in clause[mail.end() :] else m[0]

    text = _words["at"].sub("@", refanged(text))
    text = _words["dot|period|point"].sub(dot, text) if cued else _words["dot"].sub(".", text)
    return _words["colon"].sub(":", text)


def _emails(text: str) -> Iterator[tuple[str, int]]:
    for m in _email.finditer(text):
        yield m[2].rstrip("."), m.start()


def defanged(text: str) -> bool:
    """A detail that shows once bracketed signs, or words for signs, are signs, and that is one a machine could use."""
    if any(p.search(text) for p, _ in _brackets):
        plain = refanged(text)
        if any(valid_host(h, False) for h, _ in _emails(plain)) or host(plain) or ip(plain):
            return True
    cued = bool(_web_cue.search(text) or _mail_cue.search(text))
    plain = respelt(text, cued)
    if (cued or len(re.findall(r"\b(?:colon|dot|period|point)\b", text, re.I)) >= 2) and ip(plain):
        return True
    for name, start in _emails(plain):
        foreign = not name.isascii() or name.rpartition(".")[2].lower().startswith("xn--")
        if valid_host(name, not cued) and (cued or foreign or not _met.search(plain[max(0, start - 24) : start])):
            return True
    return cued and host(plain)


def found(view: str) -> bool:
    """Whether a view of a text holds a contact detail."""
    text = contact_form(view)
    phones = phone_form(text)
    return bool(_any.search(text) or _phone.search(phones)) or grouped_phone(phones) or international_phone(text) or ip(text) or place(text) or host(text) or defanged(text)
