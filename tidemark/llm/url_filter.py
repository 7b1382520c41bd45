"""Allow and block rules for URLs, matched in a trie."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: The verdict on a URL that no rule fits.
DEFAULT = "allow"
#: Rules that are broadcast as a trie have this many characters at most in all; `judge_joined` takes longer lists.
BROADCAST_CHARS = 8_000_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def chosen(rules: Sequence[tuple[str, str, str]]) -> dict[tuple[str, str], str]:
    """The verdict for each (host, path); where lists disagree on the same entry, block wins."""
    out: dict[tuple[str, str], str] = {}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {verdict!r}")
        if out.get((host, path)) != "block":
            out[host, path] = verdict
    return out


class Trie:
    """Rules by reversed host labels, then by path segments.

    A host node has children by label and, under its own rules, a path tree by whole segments; what a rule's
    path holds after its last `/` is the beginning of a segment and hangs as a list, longest first, at its node.
    """

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.root: dict = {}
        for (host, path), verdict in chosen(rules).items():
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("labels", {}).setdefault(label, {})
            node = node.setdefault("paths", {})
            *whole, begun = path.split("/")
            for segment in whole:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            node.setdefault("begun", []).append((begun, (host + path, verdict)))
            node["begun"].sort(key=lambda x: -len(x[0]))

    @staticmethod
    def _in_path(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            for begun, rule in node.get("begun", ()):
                if segment.startswith(begun):
                    best = rule
                    break
            node = node.get("segments", {}).get(segment)
            if node is None:
                break
        return best

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits: the deepest host, then the longest path."""
        node, best, segments = self.root, None, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get("labels", {}).get(label)
            if node is None:
                break
            if "paths" in node:
                best = self._in_path(node["paths"], segments) or best
        return best


def judge(df: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url", key: str = "page_id", default: str = DEFAULT) -> DataFrame:
    """key, host, path, rule and verdict for every row of `df`.

    A rule fits its host and all subdomains if the URL's path starts with the rule's path. The deepest host wins,
    then the longest path; on the same entry in both lists block wins. Without a rule the verdict is `default`.
    Null, empty and scheme-less URLs have empty host and path. Very long URLs are matched as a whole, a step for each label and segment. Repeated rows stay; an empty table gives an
    empty result; other columns are not read. The trie is broadcast, so rules of more than BROADCAST_CHARS characters are an error.
    """
    if sum(len(h) + len(p) for _, h, p in rules) > BROADCAST_CHARS:
        raise ValueError("too many rules to broadcast; use judge_joined")
    parts = _parts(df, url, key)
    held = df.sparkSession.sparkContext.broadcast(Trie(rules))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = held.value
        for batch in batches:
            hits = [trie.match(h, p) or (None, default) for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist())]
            found = [pa.array([x[i] for x in hits], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, "rule", "verdict"])

    kind = dict(parts.dtypes)[key]
    return parts.mapInArrow(look, f"`{key}` {kind}, host string, path string, rule string, verdict string")


def _parts(df: DataFrame, url: str, key: str) -> DataFrame:
    host, path = url_parts(F.col(url))
    return df.select(F.col(key), host.alias("host"), path.alias("path"))


def judge_joined(df: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id", default: str = DEFAULT) -> DataFrame:
    """What `judge` returns, for `rules` (verdict, host, path) too many to broadcast: nothing but joins.

    Each suffix of a distinct host is looked up among the rules' hosts, which know how long their paths are, and then the beginnings of these lengths of its paths.
    Null, empty and scheme-less URLs have empty host and path; very long ones are a row for each label of their host, not for each segment. On the same entry in both lists block wins. Repeated rows stay and are looked up
    once; an empty table, or one of no rules, gives an empty result or the default. Other columns are not read.
    """
    parts = _parts(df, url, key)
    table = rules.groupBy(F.col("host").alias("r_host"), F.col("path").alias("r_path")).agg(F.max(F.col("verdict") == "block").alias("blocks"))
    lengths = table.groupBy("r_host").agg(F.collect_set(F.length("r_path")).alias("lengths"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = parts.select("host", "path").distinct().withColumn("r_host", F.explode(suffixes)).join(lengths, "r_host")
    keys = keys.withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.length("path")))).select("host", "path", "r_host", F.substr(F.col("path"), F.lit(1), F.col("n")).alias("r_path"))
    rule = F.struct(F.concat("r_host", "r_path").alias("rule"), F.when(F.col("blocks"), "block").otherwise("allow").alias("verdict"))
    found = keys.join(table, ["r_host", "r_path"]).groupBy("host", "path").agg(F.max_by(rule, F.struct(F.length("r_host").alias("a"), F.length("r_path").alias("b"))).alias("hit"))
    return parts.join(found, ["host", "path"], "left").select(key, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = r"""
WITH rules(verdict, r_host, r_path) AS (VALUES
    ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), rest AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rest
), hits AS (
    SELECT page_id, host, path, r_host || r_path AS rule, verdict,
        row_number() OVER (PARTITION BY page_id ORDER BY length(r_host) DESC NULLS LAST, length(r_path) DESC) AS n
    FROM parts LEFT JOIN rules ON (host = r_host OR host LIKE '%.' || r_host) AND starts_with(path, r_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hits WHERE n = 1"""
