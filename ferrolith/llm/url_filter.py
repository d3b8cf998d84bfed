"""URL filtering: host and path rules first, then a weighted vocabulary counted by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One of these rejects a url.
STRICT_TERMS = (
    "porn", "porno", "xxx", "escort", "escorts", "hentai", "camgirls", "sexcam", "sexcams", "milf", "bdsm", "upskirt", "casino-bonus",
    "buy-viagra", "cheap-viagra", "malware", "phishing", "ransomware", "warez", "darknet", "carding", "free-iptv",
)
#: Of these, SOFT_LIMIT different ones reject a url.
SOFT_TERMS = (
    "adult", "sex", "sexy", "erotic", "nude", "dating", "hookup", "casino", "poker", "betting", "bets", "gambling", "slots", "roulette", "blackjack",
    "jackpot", "bonus", "lottery", "viagra", "cialis", "pills", "steroids", "crack", "cracked", "keygen", "serial-key", "torrent", "torrents",
    "free-download", "loan", "payday", "forex", "get-rich",
)
SOFT_LIMIT = 2
#: (verdict, host, path); a rule fits its host and all subdomains, and paths that start with its path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


#: A vocabulary table has this many terms at most, so that every worker can hold its automaton.
MOST_TERMS = 1_000_000


def read_vocabulary(terms: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(strict, soft) terms of a table with term and weight: weight 2 and more is strict, less is soft. Terms are lower-cased; null and empty ones are left out."""
    rows = terms.select(ascii_lower(F.col("term")).alias("term"), F.col("weight").cast("double").alias("weight")).filter("term <> ''")
    rows = rows.groupBy("term").agg(F.max("weight").alias("weight")).orderBy("term").limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"a vocabulary has {MOST_TERMS} terms at most")
    return tuple(r.term for r in rows if (r.weight or 0) >= 2), tuple(r.term for r in rows if (r.weight or 0) < 2)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, in lower case; empty for null and urls without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@lru_cache(maxsize=8)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for weight, terms in ((1, soft), (2, strict)):
        for term in terms:
            found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def count_terms(url: str | None, strict: tuple[str, ...] = STRICT_TERMS, soft: tuple[str, ...] = SOFT_TERMS) -> tuple[int, int]:
    """Hits of strict terms, and different soft terms hit. A hit has no ASCII letter or digit on either side."""
    n_strict, soft_seen = 0, set()
    low = (url or "").translate(str.maketrans(UPPER, LOWER))
    alnum = lambda ch: ch.isascii() and ch.isalnum()
    for end, (term, weight) in automaton(strict, soft).iter(low):
        start = end - len(term) + 1
        if (start and alnum(low[start - 1])) or (end + 1 < len(low) and alnum(low[end + 1])):
            continue
        if weight == 2:
            n_strict += 1
        else:
            soft_seen.add(term)
    return n_strict, len(soft_seen)


def judge_urls(pages: DataFrame, rules=RULES, strict=STRICT_TERMS, soft=SOFT_TERMS, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, n_strict, n_soft.

    The longest fitting rule (by the length of host and path) decides; without one, the vocabulary does: block at one
    strict hit or soft_limit different soft hits anywhere in the url. Null urls, and urls without ://, have an empty
    host and path, so no rule fits; a null url is allowed. Repeated rows are judged each; other columns are not read.
    """
    strict, soft = tuple(strict), tuple(soft)
    host, path = F.col("host"), F.col("path")
    fit, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        fit = F.when(fits, F.lit(rule_host + rule_path)).otherwise(fit)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [count_terms(url, strict, soft) for url in batch.column("url").to_pylist()]
            n_strict, n_soft = ([h[i] for h in hits] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_strict, pa.int64()), pa.array(n_soft, pa.int64())], names=[*batch.schema.names, "n_strict", "n_soft"])

    url = F.col("url").cast("string")
    seen = pages.select("page_id", url.alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    types = {f.name: f.dataType.simpleString() for f in seen.schema}
    scored = seen.mapInArrow(counted, ", ".join(f"`{k}` {v}" for k, v in types.items()) + ", n_strict bigint, n_soft bigint")
    own = F.when((F.col("n_strict") >= 1) | (F.col("n_soft") >= soft_limit), "block").otherwise("allow")
    return scored.withColumns({"rule": fit, "ruled": verdict}).select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "n_strict", "n_soft")
