"""The reversible rules for one text in plain Python, for state kept by session and as a check of the column form."""

from __future__ import annotations

import re

from ..functions import patterns as P


def _py(pattern: str) -> re.Pattern:
    """Python's classes are Unicode and its $ ends before a last line feed by itself."""
    for java, python in (("(?iUd)", "(?i)"), ("(?iU:", "(?i:"), ("(?Ud)", ""), ("(?iU)", "(?i)"), ("(?U)", "")):
        pattern = pattern.replace(java, python)
    return re.compile(pattern)


EMAIL, PHONE, CPF, CPF_BARE, RG = map(_py, (P.EMAIL, P.PHONE, P.CPF, P.CPF_BARE, P.RG))
MONEY, ACT, YEARS, DATE = map(_py, (P.MONEY_BEFORE, P.ACT_BEFORE, P.YEARS, P.DATE_NEAR))


def is_phone(text: str, start: int, end: int) -> bool:
    hit = text[start:end]
    bare, digits = hit.strip(), re.sub(r"\D", "", hit)
    context, near = text[max(0, start - 25) : start], text[max(0, start - 10) : end + 10]
    if bare.startswith(P.PUBLIC_NUMBERS) or digits.startswith(P.PUBLIC_DIGITS) or MONEY.search(context) or ACT.search(context):
        return False
    if YEARS.match(bare) or DATE.search(near) or "/" in near or not 8 <= len(digits) <= 13:
        return False
    return not (len(digits) == 8 and digits.startswith(("19", "20")))


def phone_key(hit: str) -> str:
    d = re.sub(r"\D", "", hit)
    return d[2:] if d.startswith("55") and len(d) > 10 else d


class Session:
    """A scope's markers: {(type, key): (marker, first spelling)} and how many of each type there have been."""

    def __init__(self, known: dict[tuple[str, str], tuple[str, str]] | None = None, n: dict[str, int] | None = None):
        self.known = {} if known is None else known
        self.new: list[tuple[str, str]] = []
        self.n: dict[str, int] = {} if n is None else n

    def marker(self, kind: str, key: str, value: str) -> str:
        if (kind, key) not in self.known:
            self.n[kind] = self.n.get(kind, 0) + 1
            self.known[kind, key] = (f"[{kind}_{self.n[kind]}]", value)
            self.new.append((kind, key))
        return self.known[kind, key][0]

    def anonymize(self, text: str, types: tuple[str, ...] = ("email", "telefone", "cpf", "rg")) -> str:
        if not text:
            return text
        tail = lambda m, kind, key: m[0][: len(m[0]) - len(m[1])] + self.marker(kind, key, m[1])
        if "email" in types:
            text = EMAIL.sub(lambda m: self.marker("EMAIL", m[0].lower().strip(), m[0]), text)
        if "telefone" in types:
            seen = text
            text = PHONE.sub(lambda m: self.marker("TELEFONE", phone_key(m[0]), m[0]) if is_phone(seen, m.start(), m.end()) else m[0], text)
        if "cpf" in types:
            text = CPF.sub(lambda m: self.marker("CPF", re.sub(r"\D", "", m[0]), m[0]), text)
            text = CPF_BARE.sub(lambda m: tail(m, "CPF", m[1]), text)
        if "rg" in types:
            key = lambda v: re.sub(r"[^A-Za-z0-9]", "", v).upper()
            text = RG.sub(lambda m: tail(m, "RG", key(m[1])) if len(key(m[1])) >= 4 else m[0], text)
        return text
