"""Taxonomy, built-in detection rules and user rules.

Patterns are written in the ASCII dialect: ``\\b`` and ``\\d`` know ASCII only, ``\\s`` is
the full set of blanks listed in ``BLANKS``. ``re2`` spells a pattern for an SQL engine with
RE2; ``operators.scan`` for the detectors. User patterns have a dialect of their own.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, replace

from veilspan.dialect import compiled

#: The kinds of personal data, in their order.
TAXONOMY = ["account_number", "private_address", "private_date", "private_email", "private_person", "private_phone", "private_url", "secret"]

#: Blanks that ``\s`` stands for, as a character class body.
BLANKS = r"\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


@dataclass(frozen=True)
class Rule:
    """A detection rule.

    ``hint`` is a cheap necessary condition on a text, as a pattern.
    """

    prefix: str
    kind: str
    pattern: str
    ignore_case: bool = False
    validator: str | None = None
    hint: str | None = None

    @property
    def re2(self) -> str:
        return ("(?i)" if self.ignore_case else "") + blanks(self.pattern)


def blanks(pattern: str, body: str = BLANKS) -> str:
    """``\\s`` and ``\\S`` spelled out, inside and outside of character classes; [\\s\\S] stays."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if pattern.startswith(r"[\s\S]", i):
            out.append(r"[\s\S]")
            i += 6
        elif two == r"\s":
            out.append(body if inside else f"[{body}]")
            i += 2
        elif two == r"\S" and not inside:
            out.append(f"[^{body}]")
            i += 2
        elif two[0] == "\\":
            out.append(two)
            i += 2
        else:
            inside = (two[0] == "[") if not inside else two[0] != "]"
            out.append(two[0])
            i += 1
    return "".join(out)


#: The built-in rules. Kinds, prefixes and patterns define what is found.
RULES = [
    Rule("private-email", "private_email", r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", True, None, "@"),
    Rule(
        "private-phone",
        "private_phone",
        r"\b01[016789][\s.-]?\d{3,4}[\s.-]?\d{4}\b|\+82[\s.-]?10[\s.-]?\d{4}[\s.-]?\d{4}\b|\b0[789]0\d{8}\b"
        r"|(?:\+1[\s.-]?|\b1?[\s.-]?)(?:\(\d{3}\)|\d{3})[\s.-]?\d{3}[\s.-]?\d{4}\b|\b0[2-9]\d?[\s.-]\d{3,4}[\s.-]\d{4}\b",
        False,
        None,
        "[0-9]{4}",
    ),
    Rule("private-url", "private_url", r"\b(?:https?://|www\.)[A-Z0-9._~:/?#\[\]@!$&'()*+,;=%-]*[A-Z0-9/#]", True, None, "(?i)://|www[.]"),
    Rule(
        "private-date",
        "private_date",
        r"\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}|(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?"
        r"|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s+\d{1,2},?\s+\d{4})\b",
        True,
        None,
        "[0-9]{2}",
    ),
    Rule(
        "secret",
        "secret",
        r"\bsk_[A-Za-z0-9_]{12,}\b|\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\b(?:gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,255})\b"
        r"|\beyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b"
        r"|-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----",
        False,
        None,
        "sk_|AKIA|ASIA|gh[pousr]_|github_pat_|eyJ|-----BEGIN",
    ),
    Rule("credit-card", "account_number", r"\b[0-9](?:[ -]?[0-9]){12,18}\b", False, "luhn", "[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"),
    Rule("kr-registration", "account_number", r"\b[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])-?[1-8][0-9]{6}\b", False, "kr_registration", "[0-9]{7}"),
    Rule("jp-my-number", "account_number", r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b", False, "jp_my_number", "[0-9]{4}[ -]?[0-9]{4}"),
    Rule("jp-corporate", "account_number", r"\b[1-9][0-9]{12}\b", False, "jp_corporate", "[0-9]{13}"),
    Rule("jp-postal", "private_address", r"〒[ \t]*[0-9]{3}-?[0-9]{4}\b", False, None, "〒"),
]

#: The labels of a token classifier over the taxonomy: outside, then begin, inside, end, single of each kind.
BIOES_LABELS = ["O", *(f"{b}-{k}" for k in TAXONOMY for b in "BIES")]

#: Other names of the kinds, by kind.
KIND_ALIASES = {
    "private_person": ["per", "person", "name", "person_name", "person_alias", "proper_name"],
    "private_email": ["email", "email_address"],
    "private_phone": ["phone", "phone_number", "telephone"],
    "private_address": ["address", "addr", "location", "postal_address", "geo_location"],
    "private_date": ["date", "date_of_birth"],
    "private_url": ["url", "website", "identifying_link"],
    "account_number": ["iban", "account", "account_number", "account_identifier", "bank_account_identifier", "payment_card"],
    "secret": ["password", "secret", "api_key", "token", "auth_secret", "payment_card_security"],
}


@dataclass(frozen=True)
class UserRule:
    """A rule of the user: mode 'exact' (case-sensitive literal) or 'regex' (case-insensitive)."""

    id: str
    name: str
    mode: str
    pattern: str

    @property
    def kind(self) -> str:
        return self.name.strip() or "Custom"


#: The rule every new rule list starts with.
DEFAULT_USER_RULE = UserRule("default-user-id", "UserId", "regex", r"\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b")


class DuplicateRule(ValueError):
    """A rule with the same mode and pattern exists."""


class InvalidRule(ValueError):
    """The pattern is empty or does not compile."""


def valid_regex(pattern: str) -> bool:
    """Whether a user pattern is valid in its dialect."""
    return compiled(pattern) is not None


def find_duplicate(rules: list[UserRule], mode: str, pattern: str, except_id: str | None = None) -> UserRule | None:
    """The first other rule with this mode and trimmed pattern; none for an empty pattern."""
    wanted = pattern.strip()
    return next((r for r in rules if wanted and r.id != except_id and r.mode == mode and r.pattern.strip() == wanted), None)


def update_rule(rules: list[UserRule], rule_id: str, **patch: str) -> list[UserRule]:
    """The list with one rule patched in place; its id stays. Unknown ids change nothing."""
    return [replace(r, **{k: v for k, v in patch.items() if k != "id"}) if r.id == rule_id else r for r in rules]


def remove_rule(rules: list[UserRule], rule_id: str) -> list[UserRule]:
    return [r for r in rules if r.id != rule_id]


def save_rule(rules: list[UserRule], name: str, mode: str, pattern: str, now_ms: int | None = None) -> list[UserRule]:
    """Append a checked rule with a fresh id."""
    pattern = pattern.strip()
    if not pattern or (mode == "regex" and not valid_regex(pattern)):
        raise InvalidRule(pattern)
    if find_duplicate(rules, mode, pattern):
        raise DuplicateRule(pattern)
    at = int(time.time() * 1000) if now_ms is None else now_ms
    return [*rules, UserRule(f"rule-{at}-{len(rules)}", name.strip(), mode, pattern)]
