"""URL allow and block lists: a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_rows, fold_case, unused

#: Rules a broadcast trie may hold; beyond it ``judge_urls`` joins instead.
TRIE_RULES = 200_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return fold_case(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class UrlTrie:
    """Longest-match lookup of (host, path prefix) rules.

    A host node holds child labels, read from the right, and the root of a path trie.  A path node
    holds child segments (each with its slash) and rule tails that end inside a segment.  The
    deepest host wins, then the longest path; the same rule on both lists blocks.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]) -> None:
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *whole, tail = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            tails = node.setdefault(None, {})
            if tails.get(tail, ("", ""))[1] != "block":
                tails[tail] = (host + path, verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The winning rule's text and verdict, or None."""
        node, best = self.root, None
        for label in reversed(host.split(".")):
            if (node := node.get(label)) is None:
                break
            if None in node:
                best = self._deepest(node[None], path) or best
        return best

    @staticmethod
    def _deepest(node: dict, path: str) -> tuple[str, str] | None:
        best, at = None, 0
        while True:
            tails = node.get(None, {})
            fits = [t for t in tails if path.startswith(t, at)]
            if fits:
                best = tails[max(fits, key=len)]
            end = path.find("/", at)
            if end < 0 or (node := node.get(path[at:end])) is None:
                return best
            at = end + 1


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", trie_rules: int = TRIE_RULES) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` put in place of columns of those names.

    ``rules`` has ``host, path, verdict`` (``allow`` or ``block``).  Up to ``trie_rules`` rules are
    broadcast as a trie and no row is shuffled; more rules are joined on the url's own host
    suffixes and path prefixes, and the longest is taken.

    A url that is null or has no ``://`` has empty host and path and fits no rule unless a rule's
    host is empty.  Without a fitting rule ``rule`` is null and the verdict is ``default``.
    Repeated rows stay repeated; an empty table gives an empty one.
    """
    for name in ("host", "path", "rule", "verdict"):
        pages = pages.drop(name)
    parsed = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rules = rules.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("host", "path")), "verdict").where("verdict in ('allow', 'block')")
    try:
        listed = bounded_rows(rules, trie_rules, "the rule list")
    except ValueError:
        return _joined(parsed, rules, default)
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie([tuple(r) for r in listed]))

    @F.pandas_udf("rule string, verdict string")
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            found = [trie.value.find(h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(found, columns=["rule", "verdict"])

    own = unused(parsed, "_found")
    return parsed.withColumn(own, find("host", "path")).select("*", f"{own}.*").drop(own)


def _joined(parsed: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same verdicts by joins: each host suffix meets the rules of that host."""
    best = rules.groupBy("host", "path").agg(F.min(F.struct(F.when(F.col("verdict") == "block", 0).otherwise(1), "verdict"))["verdict"].alias("verdict"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = parsed.select("host", "path").distinct()
    hosts = asked.select("host").distinct().select("host", F.explode(suffixes).alias("rule_host"))
    lengths = best.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths")).withColumnRenamed("host", "rule_host")
    tried = asked.join(hosts.join(lengths, "rule_host"), "host").select("host", "path", "rule_host", F.explode("lengths").alias("n"))
    tried = tried.where(F.col("n") <= F.length("path")).withColumn("rule_path", F.substring("path", F.lit(1), F.col("n")))
    own = unused(parsed, "_best")
    won = (
        tried.join(best.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("_v")), ["rule_host", "rule_path"])
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule_host"), "n", F.concat("rule_host", "rule_path").alias("rule"), "_v")).alias(own))
    )
    return (
        parsed.join(won, ["host", "path"], "left")
        .withColumns({"rule": F.col(f"{own}.rule"), "verdict": F.coalesce(f"{own}._v", F.lit(default))})
        .drop(own)
    )
