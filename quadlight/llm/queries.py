"""The queries ``opN_<name>`` of the training-data operators, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlight.llm import chat, decontamination, language_model, licenses, packing, quality_classifier, quality_rules, simhash, toxicity, url_filter
from quadlight.llm.common import id_remainder, release


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str, owner: str = "") -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"), shingle=3, radius=3, seed=42, owner=owner)
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str, owner: str = "") -> DataFrame:
    digest = lambda ids: {"ids_crc32": F.crc32(ids)}
    packed = packing.pack(_table(spark, sf_dir, "documents"), vocabulary(), capacity=2048, end_id=0, carry=digest, owner=owner)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_toxicity(spark: SparkSession, sf_dir: str, owner: str = "") -> DataFrame:
    docs, remainder = _table(spark, sf_dir, "documents"), id_remainder(F.col("doc_id"), 4)
    model = toxicity.fit_sample(docs, _table(spark, sf_dir, "labels"), remainder != 2)
    return toxicity.score(docs, model).select("doc_id", (remainder == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_license_scan(spark: SparkSession, sf_dir: str, owner: str = "") -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


#: The rules of the URL query, host/path: verdict.
URL_RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
#: Names of spam sites. The list holds every page of theirs, in another spelling than the page's own.
SPAM_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def spam_list(pages: DataFrame) -> DataFrame:
    """(url): the pages of the spam sites as a list of URLs from elsewhere may spell them: with the other scheme, with or
    without www., with a port, a tracking parameter and a fragment."""
    url, site = F.col("url"), F.regexp_replace(url_filter.host(F.col("url")), r"^(www|m)\.", "")
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    asked = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    scheme = F.when(url.startswith("https"), "http").otherwise("https")
    port = F.when(url.startswith("https"), ":80").otherwise("")
    www = F.when(url_filter.host(url).startswith("www."), "").otherwise("WWW.")
    mark = F.when(asked == "", "?utm_campaign=list").otherwise("&fbclid=1")
    spelt = F.concat(scheme, F.lit("://"), www, site, port, rest, asked, mark, F.lit("#seen"))
    return pages.where(site.rlike(rf"^({'|'.join(SPAM_SITES)})\.|\.({'|'.join(SPAM_SITES)})\.")).select(spelt.alias("url"))


def op5_url_filter(spark: SparkSession, sf_dir: str, owner: str = "") -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.judge(pages, spam_list(pages), URL_RULES, owner=owner).select("page_id", "host", "path", "rule", "verdict")


def op6_co_training(spark: SparkSession, sf_dir: str, owner: str = "") -> DataFrame:
    docs, remainder = _table(spark, sf_dir, "documents"), id_remainder(F.col("doc_id"), 4)
    model = quality_classifier.fit_sample(docs, _table(spark, sf_dir, "labels"), remainder != 2)
    return quality_classifier.score(docs, model).select("doc_id", (remainder == 2).alias("held_out"), "score", "kept")


def op7_quality_rules(spark: SparkSession, sf_dir: str, owner: str = "") -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"), owner=owner)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_chat_format(spark: SparkSession, sf_dir: str, owner: str = "") -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    done = chat.format_turns(chat.struct_turns(chat.conversations_as_structs(rows.unionByName(extra)))).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    joined = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_kneser_ney(spark: SparkSession, sf_dir: str, owner: str = "") -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents"), id_remainder(F.col("doc_id"), 10) == 0
    model = language_model.fit(docs.where(~held_out), owner=owner)
    return language_model.score(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_decontamination(spark: SparkSession, sf_dir: str, owner: str = "") -> DataFrame:
    return decontamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), owner=owner)


#: How often each query has run: its scratch tables go when it begins for the second time after.
_runs: Counter = Counter()


def _owned(name: str, run: Callable) -> Callable[[SparkSession, str], DataFrame]:
    """The query with scratch tables of its own. Its result is lazy and reads them, so only those of the run before the
    last are dropped when it begins again."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        owner = f"{name} {_runs[name] % 2}"
        _runs[name] += 1
        release(spark, owner)
        return run(spark, sf_dir, owner)

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_queries = (op1_simhash_near_dedup, op2_best_fit_packing, op3_toxicity, op4_license_scan, op5_url_filter, op6_co_training, op7_quality_rules, op8_chat_format, op9_kneser_ney, op10_decontamination)
    return {f.__name__: _owned(f.__name__, f) for f in all_queries}


def _url_sql() -> str:
    place = "coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    name = "coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
    rules = ", ".join(f"('{r}', '{v}')" for r, v in URL_RULES.items())
    sites = "|".join(SPAM_SITES)

    def canonical(table: str) -> str:
        """Adds ``canon`` to a table with url, host and path."""
        kept = f"list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{url_filter.TRACKING}')))"
        site = r"regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m)\.', '')"
        page = r"regexp_replace(regexp_replace(path, '/index\.html?$', '/'), '(\.html?|/+)$', '')"
        return f"SELECT *, CASE WHEN contains(url, '://') THEN {site} || CASE WHEN {page} = '' THEN '/' ELSE {page} END || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END END AS canon FROM {table}"

    spelling = rf"""CASE WHEN starts_with(url, 'https') THEN 'http' ELSE 'https' END || '://' || CASE WHEN starts_with(host, 'www.') THEN '' ELSE 'WWW.' END || regexp_replace(host, '^(www|m)\.', '')
  || CASE WHEN starts_with(url, 'https') THEN ':80' ELSE '' END || path || regexp_extract(url, '(?s)^.*?://[^?#]*(\?[^#]*)', 1) || CASE WHEN regexp_extract(url, '(?s)^.*?://[^?#]*(\?[^#]*)', 1) = '' THEN '?utm_campaign=list' ELSE '&fbclid=1' END || '#seen'"""
    return f"""
WITH v AS (SELECT page_id, url, {name} AS host, {place} AS path FROM pages),
spelt AS (SELECT {spelling} AS url FROM v WHERE regexp_matches(host, '(^|\\.)({sites})\\.')),
parted AS (SELECT url, {name} AS host, {place} AS path FROM spelt),
listed AS (SELECT DISTINCT canon FROM ({canonical("parted")})),
u AS ({canonical("v")}),
rules(rule, verdict) AS (VALUES {rules}),
fits AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM u JOIN rules
  ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, rule[position('/' IN rule):]) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(verdict, CASE WHEN canon IN (SELECT canon FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fits ON u.page_id = fits.page_id"""


def _chat_sql() -> str:
    escaped = r"replace(replace(replace({}, '\', '\b'), '<', '\l'), '>', '\g')"
    return rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) x)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({escaped.format("role")}) + length({escaped.format("text")}) + 16) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op4_license_scan": licenses.scan_sql(), "op5_url_filter": _url_sql(), "op8_chat_format": _chat_sql()}
