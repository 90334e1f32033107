"""URL filters: rules indexed by their rarest literal token.

A rule is either a host and path rule (``com/en/``: the host com and all its
subdomains, paths that start with /en/) or a pattern of the usual block-list
form, in which ``*`` stands for anything, ``^`` for a separator or an end, ``|``
for the start or end of the URL and ``||`` for the start of the host or of a
part of it; ``@@`` before a pattern allows what it fits.
Each rule is filed under the one of its whole literal tokens that is rarest
among the URLs at hand; a URL's tokens fetch candidates and only those run
their regular expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, pieces

# The rules of the contract, and the words of the default patterns.
HOST_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
BLOCKED_WORDS = ("betting", "casino", "malware", "payday", "phishing", "pills", "porn", "spam", "torrent", "viagra", "warez", "xxx")
PATTERNS = tuple(("block", f"^{w}^") for w in BLOCKED_WORDS)
DEFAULT_VERDICT = "allow"

_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    fixed: bool  # a host and path rule, which goes before patterns


def host_rule(verdict: str, rule: str) -> Rule:
    """Tokens cut off by the end of the path prefix are not whole and don't count."""
    host, slash, path = rule.partition("/")
    whole = path[: len(path) - len(re.search(r"[A-Za-z0-9]*$", path)[0])]
    return Rule(rule, verdict, rf"\A(?:[^/?#]*\.)?{re.escape(host)}{re.escape(slash + path)}", tuple(_TOKEN.findall(f"{host}/{whole}".lower())), True)


def pattern_rule(verdict: str, pattern: str) -> Rule:
    """A token counts as whole if a sign that isn't ``*``, or an anchored end, stands on both of its sides."""
    body, head, tail = pattern.lower(), "", ""
    if body.startswith("||"):
        body, head = body[2:], r"\A(?:[^/?#]*\.)?"
    elif body.startswith("|"):
        body, head = body[1:], r"\A"
    if body.endswith("|"):
        body, tail = body[:-1], r"\Z"
    regex = head + "".join({"*": ".*", "^": r"(?:[^a-z0-9]|\A|\Z)"}.get(c, re.escape(c)) for c in body) + tail
    closed = lambda at, anchored: anchored if at < 0 or at >= len(body) else body[at] != "*"
    whole = [m[0] for m in _TOKEN.finditer(body) if closed(m.start() - 1, bool(head)) and closed(m.end(), bool(tail))]
    return Rule(pattern, verdict, regex, tuple(whole), False)


def parse_rules(lines: Iterable[str]) -> list[Rule]:
    """A block list: a pattern a line, ``@@`` for exceptions; blank lines, comments (``!``), headers and cosmetic rules (``##``) and options (``$``) are left out.

    The URL is matched without its scheme and in small letters.
    """
    rules = []
    for line in map(str.strip, lines):
        if line and line[0] not in "![" and "##" not in line and "#@#" not in line and "$" not in line:
            rules.append(pattern_rule("allow", line[2:]) if line.startswith("@@") else pattern_rule("block", line))
    return rules


def production_rules() -> list[Rule]:
    return [host_rule(*r) for r in HOST_RULES] + [pattern_rule(*r) for r in PATTERNS]


def split_url(url: str | None) -> tuple[str, str, str]:
    """Host, path and all behind the scheme; empty for null or without '://'."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(ASCII_LOWER), re.match(r"[^?#]*", rest[len(host) :])[0], rest


def token_counts(pages: DataFrame, rules: list[Rule], url_col: str = "url") -> dict[str, int]:
    """How many URLs hold each token that some rule has; as many rows as the rules have tokens reach the driver."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    words = pages.sparkSession.createDataFrame([(w,) for w in wanted], "token string")
    seen = pages.select(F.explode(F.array_distinct(F.split(F.lower(F.coalesce(F.col(url_col), F.lit(""))), "[^a-z0-9]+"))).alias("token"))
    return dict(map(tuple, seen.join(F.broadcast(words), "token").groupBy("token").count().collect()))


class RuleIndex:
    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list[int]] = {}
        self.always: list[int] = []
        self.rules, self._compiled = rules, {}
        for i, r in enumerate(rules):
            if r.tokens:
                self.by_token.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)
            else:
                self.always.append(i)

    def _fits(self, i: int, text: str) -> bool:
        """Whether rule i fits; its expression is compiled when it is first a candidate."""
        if (found := self._compiled.get(i)) is None:
            found = self._compiled[i] = re.compile(self.rules[i].regex, re.S)
        return bool(found.search(text))

    def judge(self, url: str | None) -> tuple[str, str, str | None, str]:
        """host, path, the longest host and path rule that fits, verdict."""
        host, path, rest = split_url(url)
        lowered = rest.lower()
        found = [i for t in set(_TOKEN.findall(lowered)) for i in self.by_token.get(t, ())]
        best, pattern = None, None
        rank = lambda r: (r.verdict == "allow", len(r.name), r.name)  # noqa: E731  exceptions go before blocking patterns
        for i in [*found, *self.always]:
            r = self.rules[i]
            if r.fixed:
                if (best is None or len(r.name) > len(best.name)) and self._fits(i, host + path):
                    best = r
            elif (pattern is None or rank(r) > rank(pattern)) and self._fits(i, lowered):
                pattern = r
        return host, path, best and best.name, (best or pattern).verdict if best or pattern else DEFAULT_VERDICT


def filter_urls(pages: DataFrame, rules: list[Rule] | None = None, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, rule, verdict.

    Null and scheme-less URLs have an empty host and path and the default
    verdict.  Repeated rows are judged alike; an empty table stays empty; other
    columns are not carried.  The index is built once and sent to the workers:
    its size follows the list of rules, not the pages.
    """
    rules = production_rules() if rules is None else rules
    sent = pages.sparkSession.sparkContext.broadcast(RuleIndex(rules, token_counts(pages, rules, url_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for b in pieces(batches):
            got = [index.judge(u) for u in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[k] for g in got], pa.string()) for k in range(4))], names=[id_col, "host", "path", "rule", "verdict"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col).mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
