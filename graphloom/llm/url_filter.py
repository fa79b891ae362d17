"""URL filter: pattern rules indexed by their rarest literal token.

Every rule is a regular expression together with the literal tokens that any
url it fits must contain as whole tokens (maximal runs of ``[a-z0-9]``). A rule
is filed under the rarest of its tokens, rarity being counted over all urls to
be judged. A url's own tokens fetch the candidate rules and only those run
their regular expressions; rules without a usable token are always candidates.

Cases: a null url, or one without ``://``, has an empty host and path and is
judged by the default verdict; empty tables give empty results; repeated rows
are judged one by one; other columns are not read, and one that has the result's
name keeps it, the result taking the next free one. Rules of more than
``MOST_RULE_CHARS`` characters in all are an error.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Rules go to every worker: so many characters at most, whatever the table.
MOST_RULE_CHARS = 64_000_000
_TOKEN = re.compile(r"[a-z0-9]+")
_UPPER = {i: i + 32 for i in range(65, 91)}

#: Fixed host/path rules of the query's contract.
HOST_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: The method's own rules for urls that no host rule fits. ``||`` anchors at a
#: host label, ``^`` is one separator or the end, ``*`` is anything.
PATTERN_RULES = (
    ("block", "||ads-track."),
    ("block", "||spam-farm."),
    ("block", "||adserver."),
    ("block", "||doubleclick."),
    ("block", "/ads/"),
    ("block", "/banner/"),
    ("block", "/popunder/"),
    ("block", "/casino/"),
    ("block", "/wp-login.php^"),
    ("block", "/cgi-bin/*?redirect="),
    ("block", "^sessionid="),
    ("allow", "/ads/policy^"),
)


@dataclass(frozen=True)
class Rule:
    verdict: str
    name: str
    regex: str
    tokens: tuple[str, ...]
    kind: str  # "host" rules see host + path, "pattern" rules the whole url


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains where the path starts with ``path``."""
    literal = host + path
    tokens = [m for m in _TOKEN.finditer(literal.translate(_UPPER))]
    whole = tuple(m.group() for m in tokens if m.end() < len(literal))
    return Rule(verdict, literal, r"(?:[^/?#]*\.)?" + re.escape(literal), whole, "host")


def pattern_rule(verdict: str, pattern: str) -> Rule:
    body, anchored = (pattern[2:], True) if pattern.startswith("||") else (pattern, False)
    regex = r"[a-z0-9+.-]*://(?:[^/?#]*\.)?" if anchored else r"[\s\S]*?"
    regex += "".join({"*": r"[\s\S]*?", "^": r"(?:[^a-z0-9_.%-]|$)"}.get(c) or re.escape(c) for c in body.translate(_UPPER))
    text = body.translate(_UPPER)
    whole = []
    for m in _TOKEN.finditer(text):
        left = anchored if m.start() == 0 else text[m.start() - 1] != "*"
        right = m.end() < len(text) and text[m.end()] != "*"
        if left and right:
            whole.append(m.group())
    return Rule(verdict, pattern, regex, tuple(whole), "pattern")


def split_url(url: str | None) -> tuple[str, str]:
    if url is None:
        return "", ""
    _, sep, rest = url.partition("://")
    if not sep:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    return m.group(1).translate(_UPPER), m.group(2)


class RuleIndex:
    """Rules by rarest token; ``counts`` holds how many urls have a token."""

    def __init__(self, rules: Sequence[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list[int]] = {}
        self.always: list[int] = []
        self.rules = [(r, re.compile(r.regex)) for r in rules]
        for i, r in enumerate(rules):
            if r.tokens:
                rarest = min(r.tokens, key=lambda t: (counts.get(t, 0), t))
                self.by_token.setdefault(rarest, []).append(i)
            else:
                self.always.append(i)

    def candidates(self, url: str) -> set[int]:
        found = set(self.always)
        for t in set(_TOKEN.findall(url)):
            found.update(self.by_token.get(t, ()))
        return found

    def judge(self, url: str | None, default: str) -> tuple[str, str, str | None, str, str | None]:
        host, path = split_url(url)
        place, lowered = host + path, (url or "").translate(_UPPER)
        best, blocked, allowed = None, None, None
        for i in sorted(self.candidates(lowered)):
            rule, regex = self.rules[i]
            if rule.kind == "host":
                if host and regex.match(place) and (best is None or len(rule.name) > len(best.name)):
                    best = rule
            elif regex.match(lowered):
                if rule.verdict == "allow":
                    allowed = allowed or rule.name
                else:
                    blocked = blocked or rule.name
        if best is not None:
            return host, path, best.name, best.verdict, None
        if allowed:
            return host, path, None, "allow", allowed
        return host, path, None, ("block" if blocked else default), blocked


def token_counts(urls: DataFrame, url_col: str, vocabulary: set[str]) -> dict[str, int]:
    """Over all urls: in how many a token of the rules occurs. As large as the rules."""
    token = F.explode(F.array_distinct(F.split(F.lower(F.col(url_col)), "[^a-z0-9]+"))).alias("t")
    rows = urls.select(token).where(F.col("t").isin(sorted(vocabulary))).groupBy("t").count().collect()
    return {r["t"]: r["count"] for r in rows}


def filter_urls(
    pages: DataFrame,
    url_col: str = "url",
    host_rules=HOST_RULES,
    pattern_rules=PATTERN_RULES,
    default: str = "allow",
) -> DataFrame:
    """Add ``host, path, rule, verdict, pattern`` under the struct column ``url_judged``.

    The longest fitting host rule decides; else an allowing pattern, else a
    blocking one, else ``default``. ``pattern`` is the method's rule, if one decided.
    """
    rules = [host_rule(*r) for r in host_rules] + [pattern_rule(*r) for r in pattern_rules]
    if sum(len(r.regex) for r in rules) > MOST_RULE_CHARS:
        raise ValueError(f"rules of more than {MOST_RULE_CHARS} characters")
    vocabulary = {t for r in rules for t in r.tokens}
    index = RuleIndex(rules, token_counts(pages, url_col, vocabulary) if vocabulary else {})

    @F.pandas_udf("host string, path string, rule string, verdict string, pattern string")
    def judge(urls: pd.Series) -> pd.DataFrame:
        out = [index.judge(u, default) for u in urls]
        return pd.DataFrame(out, columns=["host", "path", "rule", "verdict", "pattern"], dtype=object)

    return pages.withColumn(free_name(pages, "url_judged"), judge(F.col(url_col).cast("string")))


def op1_url_filter(spark, sf_dir) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "url_judged.*")


def _sql_pattern(pattern: str) -> str:
    return "^" + pattern_rule("block", pattern).regex + "[\\s\\S]*"


def oracle() -> str:
    """The rules spelled out one by one, without an index."""
    def fits(p):
        return f"regexp_matches(u, '{_sql_pattern(p)}')"

    hosts = sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in hosts
    ) + " END"
    verdict = "CASE " + " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in hosts)
    allow = " ".join(f"WHEN {fits(p)} THEN '{p}'" for v, p in PATTERN_RULES if v == "allow")
    block = " ".join(f"WHEN {fits(p)} THEN '{p}'" for v, p in PATTERN_RULES if v == "block")
    return f"""
WITH a AS (SELECT page_id, lower(coalesce(url, '')) AS u,
                  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, u, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, {rule} AS rule FROM b),
d AS (SELECT *, CASE WHEN rule IS NULL THEN CASE {allow} END END AS okay,
                CASE WHEN rule IS NULL THEN CASE {block} END END AS bad FROM c)
SELECT page_id, host, path, rule,
       {verdict} WHEN okay IS NOT NULL THEN 'allow' WHEN bad IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       coalesce(okay, bad) AS pattern
FROM d"""
