"""URL filters: many rules, few regular expressions run per URL.

Every rule is compiled to a regular expression and filed under the one of its literal tokens that
the fewest rules share. A URL's own tokens fetch the rules filed under them; only those run.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import table

#: Largest pickled index that is sent to the executors; longer lists are joined instead.
MAX_INDEX_BYTES = 32 << 20
#: Tasks that share the URLs of one token when rules are joined.
SALTS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = re.compile(r"[a-z0-9]+")


class HostRule(NamedTuple):
    """Fits a host, its subdomains, and paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


class PatternRule(NamedTuple):
    """Fits where ``pattern`` (``*``: any run, ``^``: a separator or an end) occurs in host + path."""

    pattern: str
    verdict: str


HOST_RULES = (
    HostRule("com", "/en/", "block"),
    HostRule("example.com", "/en/7", "allow"),
    HostRule("net", "/de/", "allow"),
    HostRule("example.net", "/de/8", "block"),
    HostRule("org", "/es/", "block"),
)
PATTERN_RULES = tuple(
    PatternRule(p, "block")
    for p in ("^spam-farm^", "^cheap-pills^", "^casino^", "^porn^", "^xxx^", "^viagra^", "^payday-loans^", "^warez^", "^torrents^", "^adult-dating^", "/wp-login.php", "/cgi-bin/*.exe")
)


class Compiled(NamedTuple):
    order: tuple
    text: str | None
    verdict: str
    regex: str
    tokens: tuple[str, ...]


def _compile_host(r: HostRule) -> Compiled:
    host, path = r.host.translate(str.maketrans(_UPPER, _LOWER)), r.path
    regex = rf"\A(?:[^/]*\.)?{re.escape(host)}" + (re.escape(path) if path else r"(?=/|\Z)")
    # whole tokens only: the last one of a path prefix may go on in the URL
    tokens = _TOKEN.findall(host) + [t.group() for t in _TOKEN.finditer(path.lower()) if t.end() < len(path)]
    # among rules that fit, the longest wins; then the longer host, then block, then the text
    return Compiled((1, len(r.host + r.path), len(r.host), r.verdict == "block", r.text), r.text, r.verdict, regex, tuple(tokens))


def _compile_pattern(r: PatternRule) -> Compiled:
    parts = re.split(r"([*^])", r.pattern)
    regex = "".join({"*": ".*", "^": r"(?:[^A-Za-z0-9_-]|\A|\Z)"}.get(p, re.escape(p)) for p in parts)
    tokens, text = [], r.pattern
    for t in _TOKEN.finditer(text.lower()):
        before, after = text[t.start() - 1 : t.start()], text[t.end() : t.end() + 1]
        if before and before != "*" and after and after != "*":
            tokens.append(t.group())
    return Compiled((0, len(text), 0, r.verdict == "block", text), None, r.verdict, "(?i)" + regex, tuple(tokens))


def compile_rules(hosts: Iterable[HostRule] = HOST_RULES, patterns: Iterable[PatternRule] = PATTERN_RULES) -> list[tuple[str, Compiled]]:
    """(token, rule) for each rule: the token is its rarest over all rules; '' if it has none."""
    rules = [_compile_host(r) for r in hosts] + [_compile_pattern(r) for r in patterns]
    held = Counter(t for r in rules for t in set(r.tokens))
    return [(min(r.tokens, key=lambda t: (held[t], -len(t), t)) if r.tokens else "", r) for r in rules]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path by the built-in regular expressions; both empty for null or no ``://``."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


class Index:
    """token -> rules, with the regular expressions compiled once per process."""

    def __init__(self, filed: list[tuple[str, Compiled]]) -> None:
        self.filed = filed

    def __getstate__(self):
        return self.filed

    def __setstate__(self, filed):
        self.filed = filed

    def ready(self) -> dict[str, list]:
        if not hasattr(self, "by"):
            self.by: dict[str, list] = {}
            for token, r in self.filed:
                self.by.setdefault(token, []).append((r, re.compile(r.regex, re.S)))
        return self.by

    def best(self, host: str, path: str) -> Compiled | None:
        by, at = self.ready(), host + path
        found = [r for t in {"", *_TOKEN.findall(at.lower())} if t in by for r, x in by[t] if x.search(at)]
        return max(found, key=lambda r: r.order, default=None)


def filter_urls(pages: DataFrame, hosts: Iterable[HostRule] = HOST_RULES, patterns: Iterable[PatternRule] = PATTERN_RULES, default: str = "allow", url: str = "url", max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """``pages`` with host, path, rule and verdict of each ``url``; every row is kept.

    A null or unparsable URL has empty host and path, no rule, and the default verdict. Host rules
    go before patterns; ``rule`` names a host rule or is null. Repeated rows are judged alike.
    Columns of these four names are replaced, others pass. An index of over ``max_index_bytes`` is
    not sent around but joined by token.
    """
    filed = compile_rules(list(hosts), list(patterns))
    host, path = url_parts(F.col(f"`{url}`"))
    kept = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")], host.alias("host"), path.alias("path"))
    if len(pickle.dumps(filed)) > max_index_bytes:
        return _filter_by_join(kept, filed, default)
    index = pages.sparkSession.sparkContext.broadcast(Index(filed))

    @F.pandas_udf("rule string, verdict string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        rules = index.value
        for hosts_, paths in batches:
            best = [rules.best(h, p) for h, p in zip(hosts_, paths)]
            yield pd.DataFrame({"rule": [b.text if b else None for b in best], "verdict": [b.verdict if b else default for b in best]}, dtype=object)

    return kept.withColumn("judged", judge("host", "path")).select(*kept.columns, "judged.rule", "judged.verdict")


def _filter_by_join(kept: DataFrame, filed: list[tuple[str, Compiled]], default: str) -> DataFrame:
    """The same over a rule table of any length: distinct (host, path) explode to tokens, fetch
    rules by a join that Spark lays out, and keep the best by its order. A token that many URLs hold,
    and rules without one, meet them in SALTS tasks: each rule is there as often, each URL once."""
    spark = kept.sparkSession
    rows = [(t, "\x00".join([str(r.order[0]), f"{r.order[1]:09d}", f"{r.order[2]:09d}", str(int(r.order[3])), r.order[4]]), r.text, r.verdict, r.regex.replace(r"\Z", r"\z")) for t, r in filed]
    rules = spark.createDataFrame(rows, "token string, rank string, rule string, verdict string, regex string")
    urls = kept.select("host", "path").distinct().withColumn("at", F.concat("host", "path"))
    tokens = urls.withColumn("token", F.explode(F.array_distinct(F.split(F.lower("at"), "[^a-z0-9]+", -1))))
    tokens = tokens.unionByName(urls.withColumn("token", F.lit(""))).distinct().withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(SALTS)).cast("int"))
    rules = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    fits = tokens.join(rules, ["token", "salt"]).where("at rlike concat('(?s)', regex)")
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), "rank").alias("b"))
    return kept.join(best, ["host", "path"], "left").select(*kept.columns, F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    hosts = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in HOST_RULES)
    tests = " OR ".join(f"regexp_matches(host || path, '{_compile_pattern(r).regex}', 's')" for r in PATTERN_RULES).replace(r"\Z", r"\z")
    return rf"""
WITH r(h, p, v) AS (VALUES {hosts}),
u AS (SELECT row_number() OVER () AS k, page_id,
  coalesce(translate(regexp_extract(url, '\A.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}'), '') AS host,
  coalesce(regexp_extract(url, '\A.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
f AS (SELECT k, h || p AS rule, v, row_number() OVER (PARTITION BY k ORDER BY length(h || p) DESC, length(h) DESC, v DESC, h || p DESC) AS n
  FROM u JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, f.rule AS rule, coalesce(f.v, CASE WHEN {tests} THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN f ON u.k = f.k AND f.n = 1"""


QUERIES = {"op1_url_filter": op1_url_filter}
ORACLE_SQL = {"op1_url_filter": _sql()}
