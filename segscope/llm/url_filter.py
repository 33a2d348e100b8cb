"""URL filters (operator 10): pattern rules indexed by their rarest literal token.

A rule is a pattern over ``host + path`` of a url: ``||`` at the start anchors
it to a host or its subdomains, ``*`` stands for anything, all else is literal.
Tokens are runs of A-Z, a-z and 0-9. A rule's literal tokens are those bounded
inside the rule, so each of them must be a whole token of every url that the
rule fits. One Spark pass counts how often each such token occurs in the urls;
each rule is filed under its rarest one. A url's tokens then fetch the few
candidate rules, and only those run their regular expression. Rules without a
literal token are filed under no token and tried on every url.

Site rules (``||``) win over pattern rules; among those that fit, the longest
wins, then the first in alphabetical order. No rule fits: ``default``.

The rules are a parameter and travel to the tasks in the function's closure;
more than ``MAX_RULES`` are refused rather than shipped. No shuffle but the
token counts.

Defined results: a null url or one without ``://`` has empty host and path, and
no rule; ties and repeated rows are judged one by one; an empty table gives no
rows; columns of the input other than those asked for by ``keep`` are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

MAX_RULES = 200_000
RESULT = "host string, path string, rule string, pattern string, verdict string"


@dataclass(frozen=True)
class Rule:
    verdict: str
    pattern: str

    @property
    def is_site(self) -> bool:
        return self.pattern.startswith("||")

    @property
    def name(self) -> str:
        return self.pattern[2:] if self.is_site else self.pattern

    def regex(self) -> str:
        body = ".*".join(re.escape(x) for x in self.name.split("*"))
        return rf"\A(?:[^/]*\.)?{body}" if self.is_site else body

    def tokens(self) -> list[str]:
        """Tokens with a literal separator or the host anchor on the left and a literal separator on the right."""
        left = r"(?:\A|(?<=[^A-Za-z0-9*]))" if self.is_site else r"(?<=[^A-Za-z0-9*])"
        return re.findall(left + r"[A-Za-z0-9]+(?=[^A-Za-z0-9*])", self.name)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return (ascii_lower(F.regexp_extract(rest, r"\A([^/?#]*)", 1)),
            F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1))


def token_counts(keys: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """How many urls hold each literal token of the rules (at most one row a token comes to the driver)."""
    wanted = sorted({t for r in rules for t in r.tokens()})
    if not wanted:
        return {}
    spark = keys.sparkSession
    found = keys.select(F.explode(F.array_distinct(F.split("key", "[^A-Za-z0-9]+"))).alias("token"))
    names = spark.createDataFrame([(t,) for t in wanted], "token string")
    rows = found.join(F.broadcast(names), "token").groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in rows}


def index_rules(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Rarest literal token -> rules; the key '' has those without one."""
    index: dict[str, list[Rule]] = {}
    for r in rules:
        best = min(r.tokens(), key=lambda t: (counts.get(t, 0), t), default="")
        index.setdefault(best, []).append(r)
    return index


def filter_urls(df: DataFrame, rules: list[Rule], url: str = "url", keep: tuple[str, ...] = ("page_id",),
                default: str = "allow") -> DataFrame:
    """``keep`` columns, host, path, rule (site rule that fits, else null),
    pattern (pattern rule that decided, else null), verdict."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are shipped to the tasks")
    host, path = host_and_path(F.col(url))
    index = index_rules(rules, token_counts(df.select(F.concat(host, path).alias("key")), rules))
    compiled: dict[str, re.Pattern] = {}
    split = re.compile("[A-Za-z0-9]+")

    def judge(key: str) -> tuple[Rule | None, Rule | None]:
        best: dict[bool, Rule] = {}
        for token in {"", *split.findall(key)}:
            for r in index.get(token, ()):
                rx = compiled.get(r.pattern) or compiled.setdefault(r.pattern, re.compile(r.regex(), re.S))
                if rx.search(key):
                    at = best.get(r.is_site)
                    if at is None or (-len(r.name), r.name) < (-len(at.name), at.name):
                        best[r.is_site] = r
        return best.get(True), best.get(False)

    @F.pandas_udf(RESULT)
    def verdicts(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        out = []
        for h, p in zip(hosts, paths):
            h, p = h or "", p or ""
            site, pattern = judge(h + p) if h or p else (None, None)
            pattern = None if site else pattern
            decided = site or pattern
            out.append((h, p, site and site.name, pattern and pattern.name, decided.verdict if decided else default))
        return pd.DataFrame(out, columns=["host", "path", "rule", "pattern", "verdict"])

    return df.select(*keep, verdicts(host, path).alias("_v")).select(*keep, "_v.*")
