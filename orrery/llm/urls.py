"""URL filter: host and path rules first, then a weighted vocabulary.

A rule names a host, with all its subdomains, and the start of a path; the longest that fits decides. Where none fits, an
Aho-Corasick automaton finds every term of the vocabulary in the url. A term counts where no ASCII letter or digit touches
it. One strict term, or `soft_limit` different soft terms, block the url.

Edge cases: a null url, or one without "://", has an empty host and path, fits no rule and is judged by its terms (null:
none). Repeated rows are judged each, null ids are passed through, empty tables give empty results, no other column is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms that block by themselves.
STRICT = ("casino", "casinos", "escort", "gambling", "hentai", "nude", "porn", "porno", "sportsbook", "viagra", "warez", "xxx")
#: Terms of which several different ones block.
SOFT = ("adult", "bet", "bets", "betting", "bonus", "cam", "cheap", "credit", "dating", "deal", "free", "hot", "jackpot", "live", "loan", "loans", "lottery", "pills", "poker", "promo", "replica", "sexy", "slots", "torrent", "win", "winner")
SOFT_LIMIT = 2
#: (verdict, host, start of the path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    """Finds all terms; each says its length and whether it is strict."""
    found = ahocorasick.Automaton()
    for term in soft:
        found.add_word(term, (term, False))
    for term in strict:
        found.add_word(term, (term, True))
    found.make_automaton()
    return found


def hits(url: str, terms: ahocorasick.Automaton) -> tuple[int, int]:
    """How often strict terms occur, and how many different soft terms do."""
    strict, soft = 0, set()
    alone = lambda at: not (0 <= at < len(url) and url[at].isascii() and url[at].isalnum())
    for end, (term, is_strict) in terms.iter(url):
        if alone(end + 1) and alone(end - len(term)):
            if is_strict:
                strict += 1
            else:
                soft.add(term)
    return strict, len(soft)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty if it is null or has no "://"."""
    after = F.regexp_extract(url, r"(?s)^.*?://([^?#]*)", 1)
    host = F.regexp_extract(after, r"^([^/]*)", 1)
    path = F.substr(after, F.length(host) + 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """A struct (verdict, rule) of the rule that fits and is longest; null if none does."""
    chosen = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))
        chosen = F.when(fits, value) if chosen is None else chosen.when(fits, value)
    return chosen


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, soft_limit: int = SOFT_LIMIT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """`page_id`, `host`, `path`, `rule`, `verdict`, `n_strict`, `n_soft` of every url."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = automaton(strict, soft)
        for batch in batches:
            found = [hits(url or "", terms) for url in batch.column(1).to_pylist()]
            columns = [pa.array([f[i] for f in found], pa.int32()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], *batch.columns[2:], *columns], ["page_id", "host", "path", "n_strict", "n_soft"])

    host, path = parts(F.col(url_col))
    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.translate(F.col(url_col), UPPER, LOWER).alias("url"), host.alias("host"), path.alias("path"))
    counted = picked.mapInArrow(run, "page_id long, host string, path string, n_strict int, n_soft int")
    by_terms = F.when((F.col("n_strict") > 0) | (F.col("n_soft") >= soft_limit), "block").otherwise("allow")
    chosen = rule_for(F.col("host"), F.col("path"), rules)
    return counted.withColumn("_chosen", chosen).select("page_id", "host", "path", F.col("_chosen.rule").alias("rule"), F.coalesce("_chosen.verdict", by_terms).alias("verdict"), "n_strict", "n_soft")
