"""URL filters: many pattern rules, of which each URL meets only a few.

A rule is a pattern over ``host + path``: ``||`` at the start stands for the host or
any of its subdomains, ``*`` for any characters, ``^`` for one character that is not a
letter or digit, or the end.  Its literal tokens are the runs of letters and digits
that must stand in a matching URL as whole tokens.  Over all URLs of the table the
tokens that rules use are counted; a rule is filed under its rarest one.  The tokens of
a URL fetch the rules filed under them, and only those run their regular expression.
Rules without such a token are filed under the empty token, which every URL fetches.

Host and path rules (``example.com/en/``) are such patterns with an anchor at the host
and none at the end.  Among them the longest decides; where none fits, a block rule of
the other kind blocks; else the URL is allowed.

Defined results: a null URL or one without ``://`` has an empty host and path, meets no
rule and is allowed.  Equal URLs get equal verdicts, repeated rows included.  Of rules
with the same text the first given counts.  Given columns stay; those named like added
ones are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import extend

TOKEN = re.compile(r"[0-9A-Za-z]+")
JUDGED = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    text: str
    pattern: str
    place: bool  # a host and path rule, of which the longest decides


def place_rule(verdict: str, text: str) -> Rule:
    """A rule for a host, its subdomains, and a path prefix: ``host/path``."""
    return Rule(verdict, text, "||" + text, True)


def pattern_rule(verdict: str, pattern: str) -> Rule:
    return Rule(verdict, pattern, pattern, False)


# The host and path rules that decide first.
PLACE_RULES = (
    place_rule("allow", "com/"),
    place_rule("block", "example.com/en/"),
    place_rule("allow", "www.example.com/en/"),
    place_rule("block", "net/es/"),
    place_rule("block", "net/fr/"),
)

#: What blocks where no host and path rule fits: hosts of spam, advertising and betting pages, and pages for machines.
PATTERN_RULES = tuple(
    pattern_rule("block", p)
    for p in (
        "||spam-farm.",
        "||cheap-pills.",
        "||ads-track.",
        "||casino-win.",
        "||adult-x.",
        "||free-bets.",
        "*/wp-login^",
        "*/cart^",
        "*/login^",
        "*/search^",
    )
)


def regex_of(pattern: str) -> str:
    """A rule's pattern as a regular expression over host + path."""
    head = ""
    if pattern.startswith("||"):
        head, pattern = r"\A(?:[^/]*\.)?", pattern[2:]
    elif not pattern.startswith("*"):
        head = r"\A"
    body = "".join({"*": r"(?s:.*)", "^": r"(?:[^0-9A-Za-z]|\Z)"}.get(c, re.escape(c)) for c in pattern)
    return head + body


def tokens_of_rule(pattern: str) -> list[str]:
    """Literal tokens that a match contains as whole tokens: bounded on both sides inside the pattern."""
    anchored = pattern.startswith("||")
    bare = pattern[2:] if anchored else pattern
    out = []
    for m in TOKEN.finditer(bare):
        left = bare[m.start() - 1] if m.start() else ("." if anchored or not pattern.startswith("*") else "*")
        right = bare[m.end()] if m.end() < len(bare) else "*"
        if left != "*" and right != "*":
            out.append(m.group())
    return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    low = F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(low, F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class RuleIndex:
    """Rules by their rarest token, with compiled expressions."""

    def __init__(self, rules: Sequence[Rule], counts: dict[str, int]):
        self.filed: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        seen = set()
        for r in rules:
            if (r.pattern, r.place) in seen:
                continue
            seen.add((r.pattern, r.place))
            token = min(tokens_of_rule(r.pattern), key=lambda t: (counts.get(t, 0), t), default="")
            self.filed.setdefault(token, []).append((r, re.compile(regex_of(r.pattern))))

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        where = host + path
        if not where:
            return None, "allow"
        longest: Rule | None = None
        blocked = False
        for token in {"", *TOKEN.findall(where)}:
            for r, expression in self.filed.get(token, ()):
                if r.place and longest is not None and len(r.text) <= len(longest.text):
                    continue
                if not r.place and (blocked or r.verdict != "block"):
                    continue
                if expression.search(where):
                    if r.place:
                        longest = r
                    else:
                        blocked = True
        if longest is not None:
            return longest.text, longest.verdict
        return None, "block" if blocked else "allow"


def token_counts(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> dict[str, int]:
    """In how many URLs each token of a rule occurs; over the whole table, one row per rule token."""
    wanted = sorted({t for r in rules for t in tokens_of_rule(r.pattern)})
    tokens = F.array_distinct(F.regexp_extract_all(F.concat(host_of(F.col(url)), path_of(F.col(url))), F.lit("([0-9A-Za-z]+)"), F.lit(1)))
    used = pages.select(F.explode(F.filter(tokens, lambda t: t.isin(wanted))).alias("token"))
    return {r["token"]: r["n"] for r in used.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule] = PLACE_RULES + PATTERN_RULES, url: str = "url"
) -> DataFrame:
    """Append ``host``, ``path``, ``rule`` (of the host and path rules, else null) and ``verdict``."""
    index = RuleIndex(rules, token_counts(pages, rules, url))
    shared = pages.sparkSession.sparkContext.broadcast(index)  # the rules, whose number is the caller's

    def begin():
        held = shared.value

        def work(hosts, paths):
            made = [held.judge(h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist())]
            return [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.string())]

        return work

    given = pages.drop(*[c for c in pages.columns if c.lower() in ("host", "path") and c.lower() != url.lower()])
    return extend(given.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url))), JUDGED, begin, ["host", "path"])
