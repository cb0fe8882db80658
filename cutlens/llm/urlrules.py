"""URL filtering by stated rules and by association rules mined from what those rules decide.

The project itself opens no network addresses, so this operator is general: any table of URLs will do.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutlens.session import cut_lineage

#: Token sets with a mined verdict up to which they are broadcast (some 200 bytes each).
BROADCAST_SETS = 100_000
#: Share of the labelled URLs a mined combination must have, and share of them a rule must decide alike.
SUPPORT, CONFIDENCE = 0.002, 0.8


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: the host's name suffixes, the folders of the path from its start, and path words; a run of digits is ``0``."""
    names = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(names, i, F.size(names)), ".")))
    plain = F.regexp_replace(path, r"[0-9]+", "0")
    folders = F.filter(F.split(plain, "/"), lambda x: x != "")
    words = F.transform(folders, lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), x))
    return F.array_distinct(F.concat(F.when(host == "", F.array().cast("array<string>")).otherwise(suffixes), words))


def stated_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as ``struct(rule, verdict)``, or null. A rule ``(host, path, verdict)`` fits its host and
    all subdomains if the path starts with its path."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the last that fits is the longest
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judge_urls(
    urls: DataFrame, rules: list[tuple[str, str, str]], url_id: str = "url_id", url: str = "url", support: float = SUPPORT, confidence: float = CONFIDENCE, default: str = "allow"
) -> DataFrame:
    """``url_id``, ``host``, ``path``, ``rule`` (the longest stated rule that fits, or null), ``verdict`` (``allow`` or
    ``block``) and ``mined_confidence`` (of the mined rule that decided, else null) of every row.

    Where no stated rule fits, the strongest mined rule whose tokens the URL all has decides: highest confidence,
    then support, then most tokens, then its text. Mined rules are frequent token combinations of URLs that the
    stated rules judge, with at least ``confidence`` for one verdict. Without a match the verdict is ``default``.
    Rows with null ids, null or malformed URLs and repeated rows are judged like others; no row is lost.

    FP-growth counts over all judged URLs. URLs of equal tokens are decided once, and the rules wait in an
    inverted index under their rarest token, so a URL is compared with few of them.
    """
    host, path = url_parts(F.col(url))
    parts = urls.select(F.col(url_id).alias("url_id"), host.alias("host"), path.alias("path"))
    known = stated_rule(F.col("host"), F.col("path"), rules)
    judged = parts.select("*", known.alias("known"), url_tokens(F.col("host"), F.col("path")).alias("tokens"))
    mined = mine_rules(judged.filter("known IS NOT NULL").select("tokens", F.col("known.verdict").alias("verdict")), support, confidence)

    baskets = judged.filter("known IS NULL").groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).select("tokens")
    hits = baskets.select("tokens", F.explode("tokens").alias("token")).join(mined, "token")
    hits = hits.filter(F.size(F.array_except("combination", "tokens")) == 0)
    strength = F.struct("confidence", "support", F.size("combination").alias("size"), F.array_join("combination", " ").alias("name"), "verdict")
    decided = hits.groupBy(F.col("tokens").alias("basket")).agg(F.max(strength).alias("best"))
    # one token set may be that of a third of all URLs: a small table of sets goes to the URLs instead
    decided = cut_lineage(decided.select("basket", "best.verdict", "best.confidence").select("basket", F.struct("verdict", "confidence").alias("best")))
    if decided.count() <= BROADCAST_SETS:
        decided = F.broadcast(decided)
    open_ = F.when(F.col("known").isNull(), F.col("tokens"))
    verdict = F.coalesce(F.col("known.verdict"), F.col("best.verdict"), F.lit(default))
    return judged.withColumn("open", open_).join(decided, F.col("open") == F.col("basket"), "left").select(
        "url_id", "host", "path", F.col("known.rule").alias("rule"), verdict.alias("verdict"), F.col("best.confidence").alias("mined_confidence")
    )


def mine_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``token`` (the rarest of the combination), ``combination``, ``verdict``, ``confidence``, ``support`` (count) of the kept rules."""
    baskets = cut_lineage(labelled.select(F.concat("tokens", F.array(F.concat(F.lit("v:"), F.col("verdict")))).alias("items")))
    if baskets.isEmpty():
        return baskets.sparkSession.createDataFrame([], "token string, combination array<string>, verdict string, confidence double, support bigint")
    sets = cut_lineage(FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets).freqItemsets)
    single = sets.filter(F.size("items") == 1).select(F.get("items", F.lit(0)).alias("token"), F.col("freq").alias("alone"))
    is_verdict = lambda x: F.startswith(x, F.lit("v:"))
    whole = sets.select(F.array_sort(F.filter("items", lambda x: ~is_verdict(x))).alias("combination"), F.get(F.filter("items", is_verdict), F.lit(0)).alias("label"), "freq")
    plain = whole.filter("label IS NULL").select("combination", F.col("freq").alias("total"))
    rules = whole.filter("label IS NOT NULL AND size(combination) > 0").join(plain, "combination")
    rules = rules.select("combination", F.substring("label", 3, 20).alias("verdict"), (F.col("freq") / F.col("total")).alias("confidence"), F.col("freq").alias("support")).filter(F.col("confidence") >= confidence)
    rarest = rules.select("*", F.explode("combination").alias("token")).join(single, "token")
    return rarest.groupBy("combination", "verdict", "confidence", "support").agg(F.min(F.struct("alone", "token"))["token"].alias("token")).select("token", "combination", "verdict", "confidence", "support")
