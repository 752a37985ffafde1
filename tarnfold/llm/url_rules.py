"""URL filters.

Rules on hosts and paths decide first: a rule fits its host, all subdomains,
and paths that start with its own; the longest that fits wins. Other URLs meet
pattern rules. Each pattern rule is indexed under its rarest literal token (by
the number of URLs in the table that hold the token); a URL's tokens fetch the
rules indexed under them, and only those run their regular expression.

Pattern syntax: ``*`` stands for any characters, ``^`` for one character that
is none of letters, digits, ``.``, ``-``, ``_``, ``%`` (or the end); a leading
``||`` ties the pattern to the start of a host's label, a leading ``~`` says
that the host holds the rest as whole tokens (runs of letters and digits),
``@@`` makes the rule an exception, which beats all blocking rules. Letters
match in either case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, map_arrow, table

#: Host and path rules of the contract: (verdict, rule).
HOST_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Pattern rules used by the registered query: advertising, tracking, session
#: and machine pages, whole families of bad hosts; exceptions for pages about such things.
PATTERN_RULES = [
    "~casino", "~casinos", "~bet", "~bets", "~betting", "~spam", "~pills", "~adult", "~porn", "~xxx", "~ad", "~ads", "~adserver",
    "||ads-track.", "||adserver.", "||ads.*.com^", "||tracker.", "||doubleclick.", "||banner.", "||popup.", "||casino.", "||xxx.",
    "/adclick^", "/ads/banner^", "/pagead/", "/track/click^", "/pixel.gif^", "/beacon.js^", "^sessionid=", "^phpsessid=", "/wp-admin/", "/wp-login.php",
    "/cgi-bin/*.pl^", "/cart/checkout^", "/user/login^", "/captcha^", "/porn/", "/casino-bonus^", "/free-download-crack^",
    "@@/about/ads^", "@@/policy/tracking^", "@@~anti-spam", "@@~adult-education",
]
_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class PatternRule:
    text: str
    allow: bool
    tokens: tuple[str, ...]
    regex: str


def parse_pattern(text: str) -> PatternRule:
    """Its literal tokens are whole tokens of any URL that matches: runs of
    letters and digits that no ``*`` and no open end of the pattern touches."""
    body = text.removeprefix("@@").lower()
    tied, held = body.startswith("||"), body.startswith("~")
    body = body.removeprefix("||").removeprefix("~")
    if held and not re.fullmatch(r"[a-z0-9]+(?:[.\-_][a-z0-9]+)*", body):
        raise ValueError(f"the rule {text!r} must name whole tokens of a host")
    tokens = []
    for m in _TOKEN.finditer(body):
        left = tied or held if m.start() == 0 else body[m.start() - 1] != "*"
        right = body[m.end()] != "*" if m.end() < len(body) else held
        if left and right:
            tokens.append(m[0])
    if not tokens:
        raise ValueError(f"the rule {text!r} has no literal token to index it by")
    parts = "".join(".*" if c == "*" else r"(?:[^a-z0-9.\-_%]|$)" if c == "^" else re.escape(c) for c in body)
    if held:  # after the user's name, between any other characters of the host
        return PatternRule(text, text.startswith("@@"), tuple(tokens), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#]*@)?(?:[^/?#@]*[^a-z0-9/?#@])?" + parts + r"(?:[^a-z0-9/?#@][^/?#@]*)?(?:[/?#]|$)")
    return PatternRule(text, text.startswith("@@"), tuple(tokens), (r"^[a-z][a-z0-9+.\-]*://(?:[^/?#]*[.@])?" if tied else "") + parts)


def index_rules(rules: list[PatternRule], frequency: dict[str, int]) -> dict[str, list[PatternRule]]:
    found: dict[str, list[PatternRule]] = {}
    for r in rules:
        found.setdefault(min(r.tokens, key=lambda t: (frequency.get(t, 0), t)), []).append(r)
    return found


def token_counts(urls: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How many URLs hold each of the rules' tokens: as many rows as tokens."""
    t = urls.select(F.explode(F.array_intersect(F.split(F.lower("url"), "[^a-z0-9]+"), F.array(*[F.lit(x) for x in tokens]))).alias("token"))
    return {r["token"]: r["count"] for r in t.groupBy("token").count().collect()}


def match(url: str, index: dict[str, list[PatternRule]], compiled: dict[str, re.Pattern]) -> tuple[str, str | None]:
    """Verdict and pattern (the first by its text of those that decide);
    without a match: allow."""
    low = url.lower()
    found = [r for token in dict.fromkeys(_TOKEN.findall(low)) for r in index.get(token, ()) if compiled[r.text].search(low)]
    allow = [r.text for r in found if r.allow]
    if allow or not found:
        return "allow", min(allow, default=None)
    return "block", min(r.text for r in found)


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = lower_ascii(F.regexp_extract(after, r"^[^/?#]*", 0))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rule(host: F.Column, path: F.Column, rules: list[tuple[str, str]]) -> tuple[F.Column, F.Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. The rules are
    few and fixed, so they are one expression."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, host_rules: list[tuple[str, str]] = HOST_RULES, patterns: list[str] = PATTERN_RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict, pattern of each row.

    Null URLs and such without ``://`` have an empty host and path, fit no host
    rule, and are allowed unless a pattern matches. Repeated rows are judged
    alike; an empty table gives no rows.
    """
    rules = [parse_pattern(p) for p in patterns]
    index = index_rules(rules, token_counts(pages, sorted({t for r in rules for t in r.tokens})))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {r.text: re.compile(r.regex) for r in rules}
        for b in batches:
            found = [match(u or "", index, compiled) if r is None else (None, None) for u, r in zip(b.column("url").to_pylist(), b.column("rule").to_pylist(), strict=True)]
            verdicts = [v if v is not None else m[0] for v, m in zip(b.column("verdict").to_pylist(), found, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("page_id", "url", "host", "path", "rule")] + [pa.array(verdicts, pa.string()), pa.array([m[1] for m in found], pa.string())], ["page_id", "url", "host", "path", "rule", "verdict", "pattern"])

    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = host_rule(F.col("host"), F.col("path"), host_rules)
    return map_arrow(rows.withColumn("rule", rule).withColumn("verdict", verdict), run, "page_id long, url string, host string, path string, rule string, verdict string, pattern string")


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all ``pages``."""
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "pattern")
