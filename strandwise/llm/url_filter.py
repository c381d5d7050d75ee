"""URL filter rules, indexed by their rarest literal token.

A rule is a pattern over the lower-cased URL: ``*`` stands for any run of
characters, ``^`` for a separator or the end, a leading ``||`` for the start of
a host or of one of its parents, ``|`` at either end for that end of the URL.
A token is a run of ASCII letters and digits. A token of a pattern is safe if
the pattern fixes what stands on both of its sides, so that every URL that
matches has it as a token of its own. Each rule is filed under the safe token
that the fewest URLs of the corpus have (counted over all of them); a URL
looks up its tokens and runs the regular expressions of those rules only.
Rules without a safe token are tried on every URL.

All of this is joins and built-in expressions. Rules are a list or a table with
a column ``rule``; RULES stands for a list of the usual kind.

Defined cases: a null URL matches nothing, an empty one only what an empty
string matches; an empty table of pages or of rules matches nothing. Pages are
told apart by page_id, and rows without one by nothing, so of repeated rows,
and of rows without page_id, each rule is reported once. Of equally rare tokens
the longest, then the first one in the alphabet files a rule. URLs of any
length are read whole, and further columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from strandwise.llm.common import small_side, table

RULES = [
    "||ads-track.example.com^",
    "||ads-track.^",
    "||casino-win.*/de/",
    "||casino-win.example.com^",
    "||cheap-pills.example.com^",
    "||cheap-pills.*utm_source=feed",
    "/casino-",
    "*-pills.*",
    "?utm_source=feed|",
    "&ref=x|",
    "/fr/*.html|",
    "||blog.*/es/*?page=2",
    "|http://www.*#top",
    "://m.ads-track.",
    "||adserver.example.net^",
    "||tracker.example.org^",
    "/banner/*/ad_",
    "/es/1",
    ".php?sid=",
    "/track.gif?",
]

_TOKEN = re.compile(r"[a-z0-9]+")
_HOST = r"^[a-z][a-z0-9+.-]*://([^/?#]*[.])?"


def compiled(rule: str) -> str:
    """The regular expression of a rule, in the syntax that Java and RE2 share."""
    rule, out = rule.lower(), ""
    if rule.startswith("||"):
        out, rule = _HOST, rule[2:]
    elif rule.startswith("|"):
        out, rule = "^", rule[1:]
    end = rule.endswith("|")
    for c in rule[:-1] if end else rule:
        if c == "*":
            out += ".*"
        elif c == "^":
            out += "([^a-z0-9_.%-]|$)"
        elif c.isascii() and not c.isalnum() and c != "_":
            out += f"[{c}]" if c not in "^]\\[" else "\\" + c
        else:
            out += c
    return out + ("$" if end else "")


def safe_tokens(rule: str) -> list[str]:
    """Tokens that every matching URL has, bounded as in the rule."""
    rule = rule.lower()
    anchored = rule.startswith("|")
    body = rule.lstrip("|") if anchored else rule
    end = body.endswith("|")
    body = body[:-1] if end else body
    found = []
    for m in _TOKEN.finditer(body):
        before = anchored if m.start() == 0 else body[m.start() - 1] != "*"
        after = end if m.end() == len(body) else body[m.end()] != "*"
        if before and after:
            found.append(m.group())
    return sorted(set(found))


def _compiled_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rules = batch.column("rule").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array(rules, pa.string()), pa.array([compiled(r) for r in rules], pa.string()), pa.array([safe_tokens(r) for r in rules], pa.list_(pa.string()))], names=["rule", "pattern", "tokens"])


def matches(pages: DataFrame, rules: list[str] | DataFrame | None = None) -> DataFrame:
    """(page_id, rule) of every page whose URL a rule matches."""
    spark = pages.sparkSession
    rules = RULES if rules is None else rules
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(r,) for r in rules], "rule string")
    known = rules.select("rule").where("rule is not null").distinct().mapInArrow(_compiled_rules, "rule string, pattern string, tokens array<string>")
    urls = pages.where(F.col("url").isNotNull()).select(F.col("page_id").cast("long").alias("page_id"), F.lower("url").alias("url"))
    tokens = urls.withColumn("token", F.explode(F.array_distinct(F.regexp_extract_all("url", F.lit("[a-z0-9]+"), F.lit(0)))))
    by_token = known.select("rule", "pattern", F.explode("tokens").alias("token"))
    counts = tokens.join(small_side(by_token.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("rule").orderBy(F.coalesce("n", F.lit(0)), F.desc(F.length("token")), "token")
    index = by_token.join(counts, "token", "left").withColumn("place", F.row_number().over(rarest)).where("place = 1").select("token", "rule", "pattern")
    filed = tokens.join(small_side(index), "token")
    loose = urls.crossJoin(small_side(known.where(F.size("tokens") == 0).select("rule", "pattern")))
    hit = F.expr("rlike(url, pattern)")
    return filed.where(hit).select("page_id", "rule").unionByName(loose.where(hit).select("page_id", "rule")).distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that match, page by page."""
    return matches(table(spark, sf_dir, "pages"))


def oracle() -> str:
    """Every rule on every URL."""
    values = ", ".join(f"('{r}', '{compiled(r)}')" for r in RULES)
    return f"SELECT DISTINCT page_id, rule FROM pages, (VALUES {values}) AS t(rule, pattern) WHERE regexp_matches(lower(url), pattern)"
