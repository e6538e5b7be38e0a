"""Secret rules, and the Boolean trigram query that each regex implies."""

from __future__ import annotations

import re._constants as C
import re._parser as P
from dataclasses import dataclass

# A key runs from BEGIN to END, or without END over the header lines and the
# base64 that follows, to its last long line and what is left after that. Line
# breaks may be written as \n. Lines are no loop: Java recurses in loops over groups.
_HEADERS = r"(?:[\r\n\\][\r\n\t\x20\\]*[A-Za-z][A-Za-z0-9-]*:[^\r\n\\]*){0,64}"
_LINES = r"[\r\n\t\x20\\]*[A-Za-z0-9+/=]{16,}(?:[A-Za-z0-9+/=\r\n\t\x20\\]*[A-Za-z0-9+/=]{16,})?[A-Za-z0-9+/=\r\n\\]*"
_END = r"[^-]*-----END [A-Z0-9\x20]*PRIVATE KEY(?: BLOCK)?-----"
PRIVATE_KEY = rf"-----BEGIN [A-Z0-9\x20]*PRIVATE KEY(?: BLOCK)?-----(?:{_HEADERS}{_END}|{_HEADERS}{_LINES})?"
#: (kind, regex, group whose length counts, least length). the
#: first three kinds and their order are those of the scan's contract.
RULES = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("private_key", PRIVATE_KEY, 0, 1),
    ("github", r"gh[opsur]_[A-Za-z0-9]{36,}", 0, 1),
    ("github_fine", r"github_pat_[A-Za-z0-9_]{22,}", 0, 1),
    ("gitlab", r"glpat-[A-Za-z0-9_-]{20,}", 0, 1),
    ("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("slack_hook", r"hooks\.slack\.com/services/[A-Za-z0-9/]{20,}", 0, 1),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 1),
    ("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", 0, 1),
    ("sendgrid", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
    ("npm", r"npm_[A-Za-z0-9]{36}", 0, 1),
    ("pypi", r"pypi-AgEIcHlwaS5vcmc[A-Za-z0-9_-]{50,}", 0, 1),
    ("hub", r"hf_[A-Za-z]{34}", 0, 1),
    ("twilio", r"SK[0-9a-f]{32}", 0, 1),
    ("square", r"sq0(?:atp|csp)-[A-Za-z0-9_-]{22,}", 0, 1),
    ("shopify", r"shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}", 0, 1),
    ("azure", r"AccountKey=[A-Za-z0-9+/=]{40,}", 0, 1),
    ("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/=-]{20,}", 0, 1),
    ("url_login", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\x00-\x20/:@]*:[^\x00-\x20/:@]+@", 0, 1),
    ("ssh_key", r"ssh-(?:rsa|dss|ed25519)\x20AAAA[A-Za-z0-9+/=]{40,}", 0, 1),
    ("age", r"AGE-SECRET-KEY-1[A-Z0-9]{58}", 0, 1),
    ("telegram", r"[0-9]{8,10}:AA[A-Za-z0-9_-]{33}", 0, 1),
]
BASE = ("assign", "access", "hex")
MAX_SET = 32       # strings followed at once before they become trigrams


@dataclass(frozen=True)
class Query:
    """'all' (every text), or 'and' / 'or' of parts, or one trigram."""

    kind: str
    parts: tuple = ()


ALL = Query("all")


def _and(parts) -> Query:
    kept = tuple(dict.fromkeys(p for p in parts if p.kind != "all"))
    return ALL if not kept else kept[0] if len(kept) == 1 else Query("and", kept)


def _or(parts) -> Query:
    parts = tuple(dict.fromkeys(parts))
    return ALL if not parts or any(p.kind == "all" for p in parts) else parts[0] if len(parts) == 1 else Query("or", parts)


def _grams(s: str) -> Query:
    return _and(Query("gram", (s[i:i + 3],)) for i in range(len(s) - 2))


def _flush(strings) -> Query:
    return _or(_grams(s) for s in sorted(strings))


def _chars(items) -> set[str] | None:
    """The lower-cased characters of a small class; None for a large one."""
    out: set[str] = set()
    for op, arg in items:
        if op == C.LITERAL:
            out.add(chr(arg).lower())
        elif op == C.RANGE and arg[1] - arg[0] < 4:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _exact(tree) -> set[str] | None:
    """All strings that a sub-pattern matches, if they are few."""
    now = {""}
    for op, arg in tree:
        if op == C.LITERAL:
            more = {chr(arg).lower()}
        elif op == C.IN:
            more = _chars(arg)
        elif op == C.SUBPATTERN:
            more = _exact(arg[3])
        elif op == C.BRANCH:
            sets = [_exact(t) for t in arg[1]]
            more = None if any(s is None for s in sets) else set().union(*sets)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] <= 3:
            one = _exact(arg[2])
            more = None
            if one is not None:
                more, power = set(), {""}
                for k in range(arg[1] + 1):
                    more |= power if k >= arg[0] else set()
                    power = {a + b for a in power for b in one}
        elif op == C.AT:
            more = {""}
        else:
            more = None
        if more is None or len(now) * len(more) > MAX_SET:
            return None
        now = {a + b for a in now for b in more}
    return now


def _walk(tree) -> Query:
    """What any match must hold: strings are followed as far as they are
    few, then turned into their trigrams."""
    need, now = [], {""}
    for op, arg in tree:
        more = _exact([(op, arg)])
        if more is not None and len(now) * len(more) <= MAX_SET:
            now = {a + b for a in now for b in more}
            continue
        need.append(_flush(now))
        now = {""}
        if more is not None:
            now = more
        elif op == C.SUBPATTERN:
            need.append(_walk(arg[3]))
        elif op == C.BRANCH:
            need.append(_or(_walk(t) for t in arg[1]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
            need.append(_walk(arg[2]))
    need.append(_flush(now))
    return _and(need)


def trigram_query(regex: str) -> Query:
    """Over the lower-cased text. ALL: the regex has no mandatory trigram."""
    return _walk(P.parse(regex))


def clauses(q: Query) -> list[frozenset[str]]:
    """The query as alternatives, each a set of trigrams that must all occur."""
    if q.kind == "all":
        return [frozenset()]
    if q.kind == "gram":
        return [frozenset(q.parts)]
    if q.kind == "or":
        own = list(dict.fromkeys(c for p in q.parts for c in clauses(p)))
        return [c for c in own if not any(d < c for d in own)]
    out = [frozenset()]
    for p in q.parts:
        new = list(dict.fromkeys(a | b for a in out for b in clauses(p)))
        # a weaker clause is still right: where alternatives multiply, drop a part
        out = new if len(new) <= 64 else out
    return [c for c in out if not any(d < c for d in out)]     # a clause that holds more than another adds nothing
