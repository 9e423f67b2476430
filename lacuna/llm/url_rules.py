"""URL filters: a trie over reversed host labels and path segments.

A rule is `(action, host, path)`.  It fits the host and all its subdomains where the url's path starts with the
rule's path.  Of the rules that fit, the longest (host and path together) wins, then the longer host, then
`block`.  The host labels are walked from the last to the first; every host node carries a second trie over
whole path segments, whose nodes hold the unfinished last segments of their rules by length: a url is compared with
one of each length that occurs, however many rules end there.

The compiled trie is broadcast; `compile_rules` refuses more than MAX_RULES, and `judge` then runs the rules in
several tries of that size, one map each, and keeps the best.

Null urls and urls without `://` have an empty host and path, and no rule fits them.  Urls are judged row by row, so
repeated rows and ids, long urls and empty tables are nothing special; columns other than id and url are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.workspace import rows_of

Rule = tuple[str, str, str]
MAX_RULES = 200_000
DEFAULT = "allow"
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

RULES: list[Rule] = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def parse_rule(action: str, text: str) -> Rule:
    """`example.org/en/1` -> host and path, the path with its slash."""
    host, slash, path = text.partition("/")
    if action not in ("allow", "block") or not host or not slash:
        raise ValueError(f"not a rule: {action} {text}")
    return action, host.translate(_UPPER), slash + path


def compile_rules(rules: Iterable[Rule]) -> dict:
    """Nested dicts: host node {label: node, '': path node}; path node {'/segment': node, '': {last piece: (rule, action)}}."""
    root: dict = {}
    for n, (action, host, path) in enumerate(rules):
        if n >= MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules in one trie")
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(("host", label), {})
        node = node.setdefault("paths", {})
        *whole, last = path.split("/")
        for segment in whole:
            node = node.setdefault(("segment", segment), {})
        ends = node.setdefault("ends", {})
        if ends.get(last, ("", "allow"))[1] != "block":
            ends[last] = (host + path, action)
        lengths = node.setdefault("lengths", [])
        if len(last) not in lengths:
            lengths.append(len(last))
            lengths.sort(reverse=True)
    return root


def _best_path(node: dict, path: str) -> tuple[str, str] | None:
    """The longest rule in one host's path trie that path starts with."""
    best, parts = None, path.split("/")
    for k, part in enumerate(parts):
        for n in node.get("lengths", ()):
            if found := node["ends"].get(part[:n] if n <= len(part) else None):
                best = found
                break
        node = node.get(("segment", part))
        if node is None:
            break
    return best


def longest_match(root: dict, host: str, path: str) -> tuple[str, str] | None:
    """`(rule, action)` of the longest rule that fits, or None."""
    node, best = root, None
    for label in reversed(host.split(".")):
        node = node.get(("host", label))
        if node is None:
            break
        if "paths" in node and (found := _best_path(node["paths"], path)) and (best is None or len(found[0]) >= len(best[0])):
            best = found  # deeper hosts come later, so a tie goes to the longer host
    return best


def split_url(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.translate(_UPPER), slash + path


def judge(urls: DataFrame, rules: list[Rule] = RULES, url: str = "url", default: str = DEFAULT, id_col: str = "page_id") -> DataFrame:
    """One row per row of urls: id, host, path, rule and verdict.  No shuffle."""
    tries = [compile_rules(rules[k : k + MAX_RULES]) for k in range(0, max(1, len(rules)), MAX_RULES)]
    out = urls.select(F.col(id_col).alias("id"), F.col(url).cast("string").alias("u"))
    for k, trie in enumerate(tries):
        sent = urls.sparkSession.sparkContext.broadcast(trie)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema) + f", rule{k} string, action{k} string"

        def match(batches, sent=sent, k=k):
            for batch in batches:
                found = [longest_match(sent.value, *split_url(u)) or (None, None) for (u,) in rows_of(batch, "u")]
                for name, at in ((f"rule{k}", 0), (f"action{k}", 1)):
                    batch = batch.append_column(name, pa.array([x[at] for x in found], pa.string()))
                yield batch

        out = out.mapInArrow(match, schema)
    n = len(tries)
    host_length = lambda c: F.instr(c, "/")
    best = F.array_sort(F.array(*[
        F.struct(F.coalesce(-F.length(f"rule{k}"), F.lit(1)).alias("a"), (-host_length(F.col(f"rule{k}"))).alias("b"), F.when(F.col(f"action{k}") == "block", 0).otherwise(1).alias("c"), F.col(f"rule{k}").alias("rule"), F.col(f"action{k}").alias("action"))
        for k in range(n)
    ]))[0] if n > 1 else F.struct(F.col("rule0").alias("rule"), F.col("action0").alias("action"))
    after = F.regexp_extract("u", r"(?s)://([^/?#]*)([^?#]*)", 1), F.regexp_extract("u", r"(?s)://([^/?#]*)([^?#]*)", 2)
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce(F.translate(after[0], capitals, small), F.lit("")).alias("host"),
        F.coalesce(after[1], F.lit("")).alias("path"),
        best["rule"].alias("rule"),
        F.coalesce(best["action"], F.lit(default)).alias("verdict"),
    )


def op5_url_trie(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP5_SQL = r"""
with p as (
  select row_number() over () as rid, page_id,
         coalesce(translate(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 2), '') as path
  from pages
), r(action, h, q) as (
  values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), m as (
  select rid, h || q as rule, action, row_number() over (partition by rid order by length(h || q) desc, length(h) desc, action desc) as k
  from p join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, q)
)
select page_id, host, path, rule, coalesce(action, 'allow') as verdict
from p left join (select * from m where k = 1) using (rid)
"""
