"""URL filter by a list and by rules: a blocked Bloom filter of listed canonical URLs, then an exact hash join on what passes it.

The filter is a table of blocks of 512 bits (eight longs); a URL picks one block and sets or tests one bit in each
long. It is built by an aggregation and probed by a join on the block number, so it is distributed like any table and
is broadcast only while ``blocks`` times the block size stays under a stated bound. False positives cost a row in the
exact join and never change a verdict.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadlight.llm.common import ascii_lower, staged

WORDS = 8
#: Query parameters that only track visits: fixed values.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|session|sid)(=|$)"


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for a null url or without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Scheme, leading www./m., default page names, trailing slash, fragment and tracking parameters dropped;
    parameters sorted. Null for a null url or one without ://."""
    name = F.regexp_replace(F.regexp_replace(host(url), r":(80|443)$", ""), r"^(www|m)\.", "")
    place = F.regexp_replace(F.regexp_replace(path(url), r"/index\.html?$", "/"), r"(\.html?|/+)$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    asked = F.array_sort(F.filter(F.split(query, "&", -1), lambda x: (x != "") & ~x.rlike(TRACKING)))
    asked = F.when(F.size(asked) > 0, F.concat(F.lit("?"), F.array_join(asked, "&"))).otherwise("")
    return F.when(F.contains(url, F.lit("://")), F.concat(name, F.when(place == "", "/").otherwise(place), asked))


def fitting_rule(name: Column, place: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, or nulls. A rule host/path fits its host and all its subdomains,
    if the url's path starts with the rule's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text in sorted(rules, key=lambda r: (len(r), r)):
        its_host, slash, its_path = text.partition("/")
        fits = ((name == its_host) | name.endswith(f".{its_host}")) & place.startswith(slash + its_path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, rules[text]).otherwise(verdict)
    return rule, verdict


def _bits(url: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a URL, and the bit in each of its longs."""
    where = F.xxhash64(url)
    marks = F.xxhash64(url, F.lit(1))
    one = F.lit(1).cast("long")
    return F.pmod(where, F.lit(blocks)).cast("long"), [F.call_function("shiftleft", one, F.shiftrightunsigned(marks, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]


def bloom_filter(listed: DataFrame, url_col: str, blocks: int) -> DataFrame:
    block, bits = _bits(F.col(url_col), blocks)
    return listed.select(block.alias("_block"), *[b.alias(f"_m{i}") for i, b in enumerate(bits)]).groupBy("_block").agg(*[F.bit_or(f"_m{i}").alias(f"_m{i}") for i in range(WORDS)])


#: Salts over which the copies of a URL are dealt where list and filter are joined by a shuffle.
SALTS = 8


def in_list(urls: DataFrame, url_col: str, listed: DataFrame, listed_col: str, bits_per_url: int = 16, most_broadcast: int = 64 << 20, owner: str = "") -> DataFrame:
    """``urls`` with ``listed``: whether the canonical URL is in the list. Null URLs are not, and take no part in any join;
    repeats are judged alike; an empty list holds nothing. ``urls`` may not have a column called listed.

    Past ``most_broadcast`` bytes of the filter both joins are shuffles, on the block or URL and a salt, so that the copies
    of a URL are never one task's work."""
    if "listed" in urls.columns:
        raise ValueError("a column of the urls may not be called listed")
    names = staged(listed.where(F.col(listed_col).isNotNull()).select(F.col(listed_col).alias("_url")).distinct(), "listed", owner)
    blocks = max(1, names.count() * bits_per_url // (64 * WORDS) + 1)
    table, known, on = bloom_filter(names, "_url", blocks), names.withColumn("_in", F.lit(True)), []
    block, bits = _bits(F.col(url_col), blocks)
    marked = urls.where(F.col(url_col).isNotNull()).select("*", block.alias("_block"))
    if blocks * 8 * (WORDS + 1) <= most_broadcast:
        table = F.broadcast(table)
    else:
        salts, on = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), ["_salt"]
        marked = marked.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        table, known = table.select("*", salts), known.select("*", salts)
    probed = marked.join(table, ["_block", *on], "left")
    hit = reduce(lambda x, y: x & y, [F.col(f"_m{i}").bitwiseAND(b) != 0 for i, b in enumerate(bits)])
    probed = probed.withColumn("_maybe", F.coalesce(hit, F.lit(False))).select(*urls.columns, *on, "_maybe")
    passed = probed.where("_maybe").join(known.withColumnRenamed("_url", url_col), [url_col, *on], "left")
    passed = passed.select(*urls.columns, F.coalesce("_in", F.lit(False)).alias("listed"))
    others = probed.where(~F.col("_maybe")).select(*urls.columns).union(urls.where(F.col(url_col).isNull()))
    return passed.union(others.withColumn("listed", F.lit(False)))


def judge(pages: DataFrame, listed: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url", listed_col: str = "url", owner: str = "") -> DataFrame:
    """(id_col, url, canonical_url, host, path, rule, listed, verdict: allow or block) for each row.

    The longest fitting rule decides; without one, a URL whose canonical form is among those of ``listed`` is blocked
    and any other allowed. Null urls and urls without :// have an empty host and path and are allowed. Repeated pages are
    judged one by one, repeats of the list count once; of two fitting rules of one length the last by name decides; empty
    pages give an empty result, an empty list blocks nothing; extra columns of both tables are ignored.
    """
    names = listed.select(canonical(F.col(listed_col)).alias("_listed"))
    urls = pages.select(F.col(id_col), F.col(url_col).alias("url"), canonical(F.col(url_col)).alias("canonical_url"))
    found = in_list(urls, "canonical_url", names, "_listed", owner=owner)
    found = found.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    return found.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")))
