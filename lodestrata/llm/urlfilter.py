"""URL allow and block lists: a trie over reversed host labels, then path segments; the longest match wins."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize, quoted

#: Rules in one broadcast trie, and characters of them (a longer rule stands alone). Longer lists are matched in as
#: many passes, so a broadcast stays bounded.
RULES_PER_TRIE = 200_000
CHARS_PER_TRIE = 16 << 20

_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    """`verdict` (allow or block) for a host with its subdomains, where the url's path starts with `path`."""

    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, verdict: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        if verdict not in ("allow", "block") or not host:
            raise ValueError(f"not a rule: {verdict} {text[:80]}")
        return cls(verdict, host.translate(_LOWER), slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: str | None) -> tuple[str, str]:
    """Host (between the first :// and /, ?, # or end; A-Z lower-cased) and path (up to ?, # or end)."""
    if url is None:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


class _Node:
    __slots__ = ("labels", "segments", "tails")

    def __init__(self) -> None:
        self.labels: dict[str, _Node] = {}  # next host label, from the right
        self.segments: dict[str, _Node] = {}  # next whole path segment
        self.tails: dict[str, Rule] = {}  # rules whose last, open segment is this text


class UrlTrie:
    """Rules by reversed host labels, then whole path segments, then the open last segment.

    The longest rule that fits wins, by characters of host and path; of equally long ones the longer host, and of two
    rules with equal host and path, block.
    """

    def __init__(self, rules: Sequence[Rule]):
        self.root = _Node()
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.labels.setdefault(label, _Node())
            *whole, tail = rule.path.split("/")
            for segment in whole:
                node = node.segments.setdefault(segment, _Node())
            known = node.tails.get(tail)
            if known is None or known.verdict == "allow":
                node.tails[tail] = rule

    @staticmethod
    def _by_path(node: _Node, segments: list[str]) -> Rule | None:
        best, last = None, len(segments) - 1
        for i, segment in enumerate(segments):
            if node.tails:
                # Only a rule's last segment is open; it may be any beginning of this one.
                for end in range(len(segment), -1, -1):
                    if (rule := node.tails.get(segment[:end])) is not None:
                        best = rule
                        break
            if i == last or (node := node.segments.get(segment)) is None:
                break
        return best

    def match(self, host: str, path: str) -> Rule | None:
        segments, best, node = path.split("/"), None, self.root
        for label in reversed(host.split(".")) if host else ():
            node = node.labels.get(label)
            if node is None:
                break
            found = self._by_path(node, segments) if node.tails or node.segments else None
            if found is not None and _outranks(found, best):
                best = found
        return best


def _outranks(a: Rule, b: Rule | None) -> bool:
    if b is None:
        return True
    return (len(a.host) + len(a.path), len(a.host), a.verdict == "block") > (len(b.host) + len(b.path), len(b.host), b.verdict == "block")


_tries: dict[bytes, UrlTrie] = {}


def _trie(digest: bytes, rules: Sequence[Rule]) -> UrlTrie:
    """One trie per process and set of rules."""
    if digest not in _tries:
        _tries.clear()
        _tries[digest] = UrlTrie(rules)
    return _tries[digest]


def _parts(rules: Sequence[Rule], most: int) -> list[list[Rule]]:
    """The rules in runs of at most `most` rules and CHARS_PER_TRIE characters."""
    parts, room = [[]], CHARS_PER_TRIE
    for rule in rules:
        size = len(rule.host) + len(rule.path)
        if parts[-1] and (len(parts[-1]) >= most or size > room):
            parts.append([])
            room = CHARS_PER_TRIE
        parts[-1].append(rule)
        room -= size
    return parts


def filter_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow", rules_per_trie: int = RULES_PER_TRIE) -> DataFrame:
    """Judge every url: id_col, host, path, rule (null where none fits), verdict (the rule's, else `default`).

    A null url or one without :// has empty host and path, which no rule fits. Rows are independent, so
    repeated rows and ties keep their own results; an empty table or an empty list of rules is fine; other
    columns are not read. One narrow pass; each trie holds at most `rules_per_trie` rules, and longer lists
    take further passes over the judged rows, with the better of two rules kept.
    """
    if default not in ("allow", "block"):
        raise ValueError(f"not a verdict: {default}")
    context = pages.sparkSession.sparkContext
    parts = _parts(rules, rules_per_trie)
    names = ("host", "path", "rule_verdict", "rule_host", "rule_path")
    schema = T.StructType([T.StructField("id", pages.schema[id_col].dataType)] + [T.StructField(name, T.StringType()) for name in names])

    def matcher(part: Sequence[Rule]):
        digest = hashlib.sha256(repr([(r.verdict, r.host, r.path) for r in part]).encode()).digest()
        shipped = context.broadcast(tuple(part))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie = _trie(digest, shipped.value)
            for batch in batches:
                rows = []
                for host, path, *known in zip(*(c.to_pylist() for c in batch.columns[1:])):
                    found = trie.match(host, path)
                    if found is not None and (known[0] is None or _outranks(found, Rule(*known))):
                        known = (found.verdict, found.host, found.path)
                    rows.append(known)
                new = [pa.array([r[i] for r in rows], pa.string()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *new], names=schema.names)

        return run

    url = F.col(quoted(url_col))
    rest = F.substring_index(F.substring_index(url.substr(F.locate("://", url) + 3, F.length(url)), "#", 1), "?", 1)
    known = F.coalesce(F.locate("://", url), F.lit(0)) > 0
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    slash = F.locate("/", F.col("rest"))
    path = F.when(slash > 0, F.expr("substring(rest, locate('/', rest))")).otherwise(F.lit(""))
    empty = F.lit(None).cast("string")
    judged = pages.select(F.col(quoted(id_col)).alias("id"), F.when(known, rest).otherwise(F.lit("")).alias("rest"))
    judged = judged.select("id", F.translate(F.substring_index("rest", "/", 1), upper, lower).alias("host"), path.alias("path"), *(empty.alias(name) for name in names[2:]))
    for i, part in enumerate(parts):
        if i:
            judged = materialize(judged, "url-pass")
        judged = judged.mapInArrow(matcher(part), schema)
    rule = F.when(F.col("rule_verdict").isNotNull(), F.concat("rule_host", "rule_path"))
    return judged.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))
