"""URL verdicts from rules and a list of canonical URLs.

Listed URLs set bits of a blocked Bloom filter: a URL's hash picks one 512-bit block and one bit in each of its eight
words, so that a lookup touches one block. A block is a row of eight longs, built by a bitwise-or aggregate, and the filter is as many rows as the
list needs. Pages that the filter passes, listed ones and a few false positives, are joined exactly with the list; all other
pages never meet it. The filter is sent to every task only while its size, known from the list's count, is under
BROADCAST_BLOCKS; beyond that, pages meet their block in a join by block number.

The longest fitting rule decides before the list does. A null or unparsable URL has empty host and path, fits no rule, is
never listed and is allowed. Repeated rows are judged one by one; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruletide.session import ensure_checkpoint_dir

#: (host, path, verdict); a rule fits its host and all subdomains.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
BITS_PER_URL = 16
BROADCAST_BLOCKS = 1 << 17  # of 72 bytes: 9 MB


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def canonical(url: Column, host: Column, path: Column) -> Column:
    """What counts as one page: the host without `www.` or `m.`, and the path without a closing slash or `.html`.

    Scheme, user, port, query and fragment are dropped. Null where the URL has no host.
    """
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":\d*$", ""), r"^(www\.|m\.)+", "")
    page = F.regexp_replace(path, r"(\.html?)?/*$", "")
    return F.when(F.length(bare) > 0, F.concat(bare, page))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as written, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _block(canon: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(canon), F.lit(n_blocks))


def _words(canon: Column) -> list[Column]:
    """The eight longs of a URL in its block: six bits of one hash choose a bit in each."""
    h, one = F.xxhash64(canon, F.lit(1)), F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(8)]


def bloom(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0 .. w7): the blocks of the filter that hold any listed URL (column canon)."""
    rows = listed.select(_block(F.col("canon"), n_blocks).alias("block"), *(w.alias(f"w{i}") for i, w in enumerate(_words(F.col("canon")))))
    return rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)))


def judge_urls(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """(id, host, path, rule, canon, bloom_hit, listed, verdict) of every row of pages.

    listed: any table with a column `url` of listed URLs; nulls and repeats in it do nothing.
    """
    ensure_checkpoint_dir(pages.sparkSession)
    lh, lp = host_path(F.col("url"))
    names = listed.select(canonical(F.col("url"), lh, lp).alias("canon")).where("canon is not null").distinct().checkpoint()
    n_blocks = max(1, -(-names.count() * BITS_PER_URL // 512))
    blocks = bloom(names, n_blocks)
    host, path = host_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.select("id", "host", "path", rule.alias("rule"), verdict.alias("rule_verdict"), canonical(F.col("url"), F.col("host"), F.col("path")).alias("canon"))
    # a page without a canonical URL meets no block; its number only spreads such rows
    at = F.coalesce(_block(F.col("canon"), n_blocks), F.pmod(F.xxhash64("id"), F.lit(n_blocks)))
    met = rows.withColumn("block", at).join(F.broadcast(blocks) if n_blocks <= broadcast_blocks else blocks, "block", "left")
    hit = reduce(lambda x, y: x & y, (F.col(f"w{i}").bitwiseAND(w) == w for i, w in enumerate(_words(F.col("canon")))))
    judged = met.select("id", "host", "path", "rule", "rule_verdict", "canon", F.coalesce(hit & F.col("canon").isNotNull(), F.lit(False)).alias("bloom_hit")).checkpoint()
    # judged once and read twice: only what the filter passes is dealt out to meet the list
    exact = judged.where("bloom_hit").join(names.withColumn("listed", F.lit(True)), "canon", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    rest = judged.where("not bloom_hit").withColumn("listed", F.lit(False))
    both = exact.select(*rest.columns).union(rest)
    return both.select("id", "host", "path", "rule", "canon", "bloom_hit", "listed", F.coalesce("rule_verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
