"""URL filter: a trie over reversed host labels and path segments.

A rule is a host with a path, allowed or blocked. It fits its host and all
subdomains where the url's path starts with the rule's path. The trie has a
level per host label, from the last label on, then a level per path segment;
the last, unfinished segment of a rule's path fits any segment that starts
with it. Of the rules that fit, the longest wins: more host labels, then a
longer path; of two equal rules, block. Urls that no rule fits get ``default``.

Rules are cut into tries of at most ``TRIE_RULES`` rules. Each is broadcast,
so a task holds a bounded table however many rules there are; the longest fit
over all tries wins.

Cases: a null url or one without ``://`` has an empty host and path; a host
may hold a port, which then is part of its last label; empty labels and
segments are labels and segments; a rule with an empty host fits every host.
Repeated rows are judged each; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIE_RULES = 100_000
ALLOW, BLOCK = "allow", "block"

#: (host, path, verdict) of the registered query: fixed values.
RULES = (
    ("org", "/", ALLOW),
    ("example.org", "/es/", BLOCK),
    ("example.org", "/en/1", BLOCK),
    ("com", "/fr/", ALLOW),
    ("com", "/de/", BLOCK),
)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def build_trie(rules) -> dict:
    """Nodes: {"hosts": label -> node, "paths": path node}. Path nodes:
    {"next": segment -> node, "starts": segment start -> (rule, verdict)}."""
    root: dict = {}
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.split(".")) if host else ():
            node = node.setdefault("hosts", {}).setdefault(label, {})
        node = node.setdefault("paths", {})
        *whole, start = path.split("/")
        for segment in whole:
            node = node.setdefault("next", {}).setdefault(segment, {})
        found = node.setdefault("starts", {})
        if found.get(start, ("", ALLOW))[1] == ALLOW:
            found[start] = (host + path, verdict)
    return root


def _longest_path(node: dict, path: str):
    """(path length, rule, verdict) of the longest rule path that ``path`` starts with."""
    best, done = None, 0
    segments = path.split("/")
    for i, segment in enumerate(segments):
        starts = node.get("starts")
        if starts:
            for n in range(len(segment), -1, -1):
                if segment[:n] in starts:
                    best = (done + n, *starts[segment[:n]])
                    break
        if i == len(segments) - 1:
            break
        node = node.get("next", {}).get(segment)
        if node is None:
            break
        done += len(segment) + 1
    return best


def longest_match(trie: dict, host: str, path: str):
    """(host labels, path length, rule, verdict) of the longest fit, or None."""
    best, node, depth = None, trie, 0
    labels = reversed(host.split("."))
    while node is not None:
        if "paths" in node:
            fit = _longest_path(node["paths"], path)
            if fit is not None:
                best = (depth, *fit)
        label = next(labels, None)
        node = node.get("hosts", {}).get(label) if label is not None else None
        depth += 1
    return best


def judge_urls(pages: DataFrame, rules=RULES, default: str = ALLOW) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    spark = pages.sparkSession
    rules = list(rules)
    url = F.col("url").cast("string")
    judged = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"))
    best = F.lit(None).cast("struct<labels:int,length:int,rule:string,verdict:string>")
    for at in range(0, len(rules), TRIE_RULES):
        trie = spark.sparkContext.broadcast(build_trie(rules[at:at + TRIE_RULES]))

        @F.pandas_udf("struct<labels:int,length:int,rule:string,verdict:string>")
        def match(host: pd.Series, path: pd.Series) -> pd.DataFrame:
            fits = [longest_match(trie.value, h, p) or (None,) * 4 for h, p in zip(host, path)]
            out = pd.DataFrame(fits, columns=["labels", "length", "rule", "verdict"], index=host.index)
            return out.astype({"labels": "Int32", "length": "Int32"})

        fit = match("host", "path")
        best = F.greatest(best, F.when(fit["rule"].isNotNull(), fit)) if at else F.when(fit["rule"].isNotNull(), fit)
    return judged.select("page_id", "host", "path", best.alias("best")).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
