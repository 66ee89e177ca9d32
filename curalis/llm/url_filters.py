"""URL filters: a broadcast trie over reversed host labels and path segments, longest match first."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the registered query: (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
MAX_RULES = 2_000_000

_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty where ``url`` is null or has no ``://``."""
    found = _URL.search(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


class Trie:
    """Host labels from the right, then path segments; a rule's last, open segment is a prefix.

    A node is ``{"hosts": {label: node}, "paths": path node or None}``; a path node is
    ``{"next": {segment: path node}, "ends": {open segment: (rule text, verdict)}, "sizes": lengths of open segments}``.
    Where two rules have the same host and path the later one wins.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {"hosts": {}, "paths": None}
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {verdict!r}")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node["hosts"].setdefault(label, {"hosts": {}, "paths": None})
            if node["paths"] is None:
                node["paths"] = {"next": {}, "ends": {}, "sizes": set()}
            at = node["paths"]
            *closed, open_ = path.split("/")
            for segment in closed:
                at = at["next"].setdefault(segment, {"next": {}, "ends": {}, "sizes": set()})
            at["ends"][open_] = (host + path, verdict)
            at["sizes"].add(len(open_))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The rule with the most host labels that fits, among those the one with the longest path."""
        if not host:
            return None
        fits, node = [], self.root
        for label in reversed(host.split(".")):
            node = node["hosts"].get(label)
            if node is None:
                break
            if node["paths"] is not None:
                fits.append(node["paths"])
        segments = path.split("/")
        for at in reversed(fits):
            best = None
            for segment in segments:
                fitting = (segment[:n] for n in sorted(at["sizes"], reverse=True) if n <= len(segment))
                longest = next((x for x in fitting if x in at["ends"]), None)
                if longest is not None:
                    best = at["ends"][longest]
                at = at["next"].get(segment)
                if at is None:
                    break
            if best:
                return best
        return None


def url_filter(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, *, url: str = "url",
               default: str = "allow", keep: Iterable[str] = ("page_id",)) -> DataFrame:
    """Judge every row's url: ``keep`` columns, then host, path, rule (null: none fits), verdict.

    ``rules`` are (verdict, host, path). A rule fits its host and all subdomains where the url's
    path starts with the rule's path; more host labels beat fewer, then the longer path. Urls that
    no rule fits, null urls and urls without ``://`` get ``default``. Repeated rows are judged
    alike, an empty table gives an empty result; columns of the input that are not in ``keep``
    are not read, so clashing names do no harm. The trie is broadcast: over ``MAX_RULES`` rules
    are refused, so its size is bounded.
    """
    rules = list(rules)
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are broadcast")
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judge(urls: pd.Series) -> pd.DataFrame:
        rows = []
        for x in urls:
            host, path = split_url(x)
            rule, verdict = trie.value.find(host, path) or (None, default)
            rows.append((host, path, rule, verdict))
        return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    judged = pages.select(*keep, judge(F.col(url)).alias("_judged"))
    return judged.select(*keep, "_judged.*")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url under ``RULES``; default verdict allow."""
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP8_SQL = r"""
WITH cut AS (
  SELECT page_id,
         CASE WHEN url IS NOT NULL AND position('://' IN url) > 0
              THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut
), ruled AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
              WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
