"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression.  Its literal tokens are derived from the parsed
expression: runs of letters and digits that every match holds, with something
that is no letter or digit on both sides.  So they are whole tokens of every url
the rule matches; a rule without one is refused.  Each rule is filed under the
one of its literal tokens that is rarest in the urls judged; the tokens of a url
fetch candidate rules, and only those run their expression.

Site rules (host and path prefix) go through the same index.  Of the site rules
that fit, the longest wins and decides; otherwise the url is blocked when any
pattern rule matches, and allowed when none does.

Pattern rules come as lines of the syntax of public filter lists, in code or in a
table (``rules_of``): ``/expression/``, or text with ``*`` for anything, ``^`` for
a separator, ``|`` for an end of the url and ``||`` for the start of a host label.

Token counts are taken over all urls, in one grouped aggregation over the
tokens that occur in rules, so at most that many rows reach the driver.  The
rules are configuration of bounded number and travel with the function.  Null
urls and urls without ``://`` have an empty host and path, no rule, and are
allowed.  Urls of any length are read whole; repeated rows give repeated results;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from re import _constants as op
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slim

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_TOKEN = re.compile(r"[0-9a-z]+")


@dataclass(frozen=True)
class SiteRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def tokens(self) -> list[str]:
        """Tokens that every url under the rule holds whole; the end of the path may go on in the url."""
        path = self.path.translate(ASCII_LOWER)
        whole = _TOKEN.findall(path)
        if whole and path[-1:].isalnum():
            whole.pop()
        if not _TOKEN.search(self.host):
            raise ValueError(f"rule {self.name}: the host must hold a token")
        return _TOKEN.findall(self.host) + whole

    def fits(self, host: str, path: str) -> bool:
        return (host == self.host or host.endswith("." + self.host)) and path.startswith(self.path)


_TOKEN_CHAR, _OTHER, _NOTHING = "token", "other", "nothing"


def _edge(items: list, last: bool) -> set[str]:
    """What a match of parsed items may begin (or end) with; nothing, where it may be empty."""
    out: set[str] = set()
    for kind, value in reversed(items) if last else items:
        if kind is op.LITERAL:
            found = {_TOKEN_CHAR if _TOKEN.fullmatch(chr(value)) else _OTHER}
        elif kind is op.AT and value in ((op.AT_BEGINNING, op.AT_BEGINNING_STRING) if last else (op.AT_END_STRING,)):
            found = {_OTHER}
        elif kind is op.IN and all(k is op.LITERAL for k, _ in value):
            found = set().union(*(_edge([x], last) for x in value))
        elif kind is op.SUBPATTERN:
            found = _edge(list(value[3]), last)
        elif kind is op.BRANCH:
            found = set().union(*(_edge(list(x), last) for x in value[1]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            found = _edge(list(value[2]), last) | (set() if value[0] else {_NOTHING})
        else:
            found = {_TOKEN_CHAR, _OTHER, _NOTHING}
        out |= found - {_NOTHING}
        if _NOTHING not in found:
            return out
    return out | {_NOTHING}


def literal_tokens(pattern: str) -> tuple[str, ...]:
    """The whole tokens that every text with a match of ``pattern`` holds; the pattern is of lower-case texts."""
    parsed = _parser.parse(pattern)
    if parsed.state.flags & (re.IGNORECASE | re.MULTILINE | re.VERBOSE):
        raise ValueError(f"{pattern}: patterns have no flags")
    items, found, at = list(parsed), [], 0
    while at < len(items):
        end = at
        while end < len(items) and _edge(items[end : end + 1], False) == {_TOKEN_CHAR} and items[end][0] is op.LITERAL:
            end += 1
        if end > at and _edge(items[:at], True) == {_OTHER} == _edge(items[end:], False):
            found.append("".join(chr(c) for _, c in items[at:end]))
        at = max(end, at + 1)
    return tuple(found)


@dataclass(frozen=True)
class PatternRule:
    """``pattern`` runs over ``host + path`` in lower case; a rule that allows goes before those that block."""

    name: str
    pattern: str
    verdict: str = "block"

    @cached_property
    def literals(self) -> tuple[str, ...]:
        found = literal_tokens(self.pattern)
        if not found:
            raise ValueError(f"rule {self.name}: every match must hold a whole token; write one rule for each alternative")
        return found


def pattern_of(line: str) -> str:
    """The expression of a line of a filter list, over ``host + path`` in lower case."""
    if len(line) > 1 and line[0] == line[-1] == "/":
        return line[1:-1]
    line = line.translate(ASCII_LOWER)
    start = r"^(?:[^/]*\.)?" if line.startswith("||") else "^" if line.startswith("|") else ""
    body = line.lstrip("|")
    end = r"\Z" if body.endswith("|") else ""
    parts = {"*": ".*", "^": r"(?:/|:|\Z)"}
    return start + "".join(parts.get(c) or re.escape(c) for c in body.rstrip("|")) + end


#: What may stand beside the text of a filter and changes nothing for the address of a page.
OPTIONS = frozenset(("all", "document", "doc", "important"))
_OPTIONS = re.compile(r"\$(~?[a-z0-9-]+(?:=[^,]*)?(?:,~?[a-z0-9-]+(?:=[^,]*)?)*)$", re.IGNORECASE)
#: What separates the hosts of a rule about elements inside a page from its selector.
_ELEMENTS = re.compile(r"#@?[?$%]?#")


def rule_of(name: str | None, line: str) -> PatternRule | None:
    """The rule of a line of a filter list; None for comments, headers and rules about elements of a page.

    ``@@`` makes an exception, a rule that allows.  Options other than
    ``OPTIONS`` ask for what an address does not tell and are refused.
    """
    body = line.strip()
    if not body or body[0] in "![" or _ELEMENTS.search(body):
        return None
    verdict = "allow" if body.startswith("@@") else "block"
    body = body.removeprefix("@@")
    if found := _OPTIONS.search(body):
        for option in found[1].split(","):
            if option.lower() not in OPTIONS:
                raise ValueError(f"rule {line}: option {option} is not known")
        body = body[: found.start()]
    return PatternRule(name or line, pattern_of(body), verdict)


def rules_of(table: DataFrame, most: int = 100_000) -> tuple[PatternRule, ...]:
    """The rules of ``table(name, line)`` by ``rule_of``, without null lines; more than ``most`` lines are refused."""
    rows = slim(table, "name", "line").where("line is not null").distinct().orderBy("name", "line").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return tuple(rule for r in rows if (rule := rule_of(r["name"], r["line"])))


SITE_RULES = (
    SiteRule("allow", "org", "/"),
    SiteRule("block", "example.org", "/es/"),
    SiteRule("block", "example.org", "/en/1"),
    SiteRule("allow", "com", "/fr/"),
    SiteRule("block", "com", "/de/"),
)

#: Words of host labels that name adverts, trackers, adult sites, gambling and spam; further parts of a label may follow.
HOST_TERMS = (
    "ad", "ads", "adserver", "adservers", "track", "tracker", "trackers", "tracking", "adult", "xxx", "porn", "casino", "free-bet", "free-bets",
    "cheap-pill", "cheap-pills", "payday-loan", "payday-loans", "quick-loan", "quick-loans", "spam-farm",
)
#: Words that need a further part of the label.
LEADING_TERMS = ("pills", "bets")
#: Folders of click counters.
CLICK_FOLDERS = ("ad", "ads", "adserver", "banner")
PATTERN_RULES = tuple(
    PatternRule(name, pattern_of(line))
    for name, line in [
        *((f"host-{t}", rf"/^(?:[^/]*[.-])?{t}(?:-[a-z0-9]+)*\./") for t in HOST_TERMS),
        *((f"host-{t}-", rf"/^(?:[^/]*[.-])?{t}-[a-z]+\./") for t in LEADING_TERMS),
        *((f"click-{t}", f"*/{t}/click") for t in CLICK_FOLDERS),
    ]
)


def host_and_path(url: str | None) -> tuple[str, str]:
    if url is None:
        return "", ""
    at = url.find("://")
    if at < 0:
        return "", ""
    rest = re.split(r"[?#]", url[at + 3 :], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(ASCII_LOWER), slash + path


class RuleIndex:
    """Rules by their rarest literal token; a rule without one is always a candidate."""

    def __init__(self, sites, patterns, counts: dict[str, int]):
        self.by_token: dict[str, list] = {}
        rarest = lambda tokens: min(tokens, key=lambda t: (counts.get(t, 0), t))
        for rule in sites:
            self._file(rarest(rule.tokens()), (0, rule, None))
        for rule in patterns:
            self._file(rarest(rule.literals), (1, rule, re.compile(rule.pattern)))

    def _file(self, token: str, entry: tuple) -> None:
        self.by_token.setdefault(token, []).append(entry)

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, str | None, int]:
        """host, path, rule, verdict, pattern, candidates."""
        host, path = host_and_path(url)
        lowered = (host + path).translate(ASCII_LOWER)
        found = [e for t in set(_TOKEN.findall(lowered)) for e in self.by_token.get(t, ())]
        best = max((e[1] for e in found if e[0] == 0 and e[1].fits(host, path)), key=lambda r: (len(r.name), r.name), default=None)
        if best:
            return host, path, best.name, best.verdict, None, len(found)
        hit = min(((e[1].verdict, e[1].name) for e in found if e[0] == 1 and e[2].search(lowered)), default=("allow", None))
        return host, path, None, *hit, len(found)


def token_counts(pages: DataFrame, tokens: list[str]) -> dict[str, int]:
    """In how many urls each of the given tokens occurs; at most ``len(tokens)`` rows come back."""
    found = slim(pages, "url").select(F.explode(F.array_distinct(F.split(F.lower("url"), "[^0-9a-z]+"))).alias("token"))
    return dict(map(tuple, found.where(F.col("token").isin(tokens)).groupBy("token").agg(F.count("*")).collect()))


def judge(pages: DataFrame, sites: tuple[SiteRule, ...] = SITE_RULES, patterns: tuple[PatternRule, ...] = PATTERN_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern, n_candidates of every row of ``pages(page_id, url)``."""
    pages = slim(pages, "page_id", "url")
    tokens = sorted({t for r in sites for t in r.tokens()} | {t for r in patterns for t in r.literals})
    # its size is bounded by that of the rules, of which rules_of takes a stated number
    sent = pages.sparkSession.sparkContext.broadcast(RuleIndex(sites, patterns, token_counts(pages, tokens)))
    types = [pa.string()] * 5 + [pa.int64()]
    names = ["host", "path", "rule", "verdict", "pattern", "n_candidates"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            rows = [index.judge(u) for u in batch.column("url").to_pylist()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *columns], ["page_id", *names])

    return pages.mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, host string, path string, rule string, verdict string, pattern string, n_candidates bigint")
