"""URL filters [native]: rules first, then boosted trees on lexical features.

Defined results: a null url, or one without "://", has an empty host and path,
fits no rule and is judged by its (zero) features; hosts compare after A-Z are
lower-cased; the longest fitting rule wins, ties going to the later rule in code
point order; repeated rows are judged alike; ids are carried as they are; other
columns of the input are not read.  One scan, no shuffle: the rules are a map
literal of at most MAX_RULES entries and the model a literal expression.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boost
from .quality import let

MAX_RULES = 10_000
#: Labelled URLs used for fitting, at most; the first by hash if there are more.
MAX_LABELLED = 50_000
MAX_SUFFIXES = 500
TREES, DEPTH = 16, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "hyphens", "host_digits", "digit_ratio", "entropy", "parameters", "suffix_odds"]

# Names from which the built-in labelled URLs are made: invented hosts of unwanted and of ordinary sites.
UNWANTED = {
    "names": [
        "lucky-slots", "poker-bonus", "casino", "meds-4u", "cheap-viagra", "fast-loan-24", "click-track", "banner-ads", "link-farm-7", "seo-spam", "xxx-cams", "hot-singles-9", "replica-bags", "bitcoin-double",
        "prize-claim", "diet-miracle", "bet-now-365", "essay-buy", "vip-tube", "free-rx", "lucky777spins", "xxx4free24", "0nlinep1lls", "win-iphone-14", "slots4u", "cash4you", "porn-hd", "escort-x", "mega-jackpot", "pills-shop",
        "debt-relief-now", "crypto-x10", "big-bonus-88", "ad-server-12", "popunder", "spin-2-win", "fake-watches", "cheap-pills-rx", "adult-zone", "loan-shark-99",
    ],
    "suffixes": ["biz", "info", "xyz", "top", "click", "ru", "loan", "com", "net", "example.com", "example.net"],
    "paths": ["/?aff={n}&cid={h}&sub={h}", "/click.php?id={n}&s={h}&r={n}", "/win/{h}", "/go/{h}?t={n}&u={h}&k={n}", "/buy-now-{n}-off?ref={h}&c={n}", "/{h}/{h}", "/promo?x={n}&y={n}&z={n}&w={h}", "/"],
}
ORDINARY = {
    "names": [
        "library", "museum", "weather", "gardening", "cityhall", "bakery", "physics", "astronomy", "cinema", "football", "recipes", "openmaps", "history", "radio", "painting", "theatre", "railway", "orchard", "schoolnews", "medicine",
        "townarchive", "botany", "localnews", "music", "town-hall", "sea-view", "new-york-weather", "choir", "chess", "parliament", "university", "geology", "harbour", "poetry", "statistics", "observatory", "st-marys-school", "lakeside", "beekeeping", "translators",
    ],
    "suffixes": ["org", "gov", "edu", "com", "net", "de", "fr", "co.uk", "example.com", "example.net"],
    "paths": ["/en/articles/{w}-of-{w}.html", "/{y}/05/{w}-and-{w}", "/about/{w}", "/wiki/{w}_{w}", "/docs/{w}/{w}/index.html", "/news/{y}/{w}?page=2", "/{w}/", "/"],
}
# Forms that say nothing of the class.
PLAIN = ["/en/{n}", "/fr/{n}/", "/de/{n}?page=2&ref=x", "/en/{n}.html", "/es/{n}#top", "/en/{n}?utm_source=feed"]
TOPICS = ["rivers", "bridges", "winter", "timetable", "members", "exhibition", "harvest", "opening", "minutes", "concert", "letters", "orbit", "garden", "council", "results", "maps"]
#: Labelled URLs made for each name.
URLS_A_NAME = 40


def parts(url: Column) -> Column:
    """struct(host, path, query)."""
    after = F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.substring_index(url, "://", 1)).otherwise(F.lit(None))
    rest = F.when(after.isNull(), F.lit("")).otherwise(F.substring(url, F.length(after) + 4, F.length(url)))
    return let(
        rest,
        lambda r: F.struct(
            F.translate(F.regexp_extract(r, r"^[^/?#]*", 0), UPPER, LOWER).alias("host"),
            F.regexp_extract(r, r"^[^/?#]*([^?#]*)", 1).alias("path"),
            F.regexp_extract(r, r"^[^?#]*\?([^#]*)", 1).alias("query"),
        ),
    )


def entropy(text: Column) -> Column:
    """Of the distribution of characters, in nats; 0 for an empty text."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.when(n > 0, F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda acc, c: acc - F.when(c == "", F.lit(0.0)).otherwise(share(c) * F.log(share(c))))).otherwise(0.0)


def lexical(rows: DataFrame, suffix_odds: dict[str, float] | None = None) -> DataFrame:
    """rows has columns url, host, path and query; the features are appended."""
    url, host = F.coalesce("url", F.lit("")), F.col("host")
    n = F.length(url)
    known = F.create_map(*[F.lit(x) for kv in suffix_odds.items() for x in kv]) if suffix_odds else None
    return rows.withColumns(
        {
            "url_length": n.cast("double"),
            "host_length": F.length(host).cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": (F.length("path") - F.length(F.translate("path", "/", ""))).cast("double"),
            "labels": (F.length(host) - F.length(F.translate(host, ".", ""))).cast("double"),
            "hyphens": (F.length(host) - F.length(F.translate(host, "-", ""))).cast("double"),
            "host_digits": (F.length(host) - F.length(F.translate(host, "0123456789", ""))).cast("double"),
            "digit_ratio": F.when(n > 0, (n - F.length(F.translate(url, "0123456789", ""))) / n).otherwise(0.0),
            "entropy": entropy(host),
            "parameters": F.when(F.col("query") == "", 0.0).otherwise((1 + F.length("query") - F.length(F.translate("query", "&", ""))).cast("double")),
            "suffix_odds": F.coalesce(F.get(F.array(known[suffix(host)]), F.lit(0)), F.lit(0.0)) if known is not None else F.lit(0.0),
        }
    )


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def made_labels(seed: int = 7) -> list[tuple[str, str, int]]:
    """(url, name, label) of the built-in set; label 1 is unwanted.  Hosts, suffixes, paths and parameters differ by class, some only in part."""
    r = random.Random(seed)
    out = []
    for label, kind in ((1, UNWANTED), (0, ORDINARY)):
        for name in kind["names"]:
            for k in range(URLS_A_NAME):
                form = r.choice(PLAIN if k % 2 else kind["paths"])
                while "{" in form:
                    form = form.replace("{n}", str(r.randrange(1, 10**r.randrange(1, 6))), 1).replace("{h}", f"{r.getrandbits(r.choice((24, 32, 64))):x}", 1)
                    form = form.replace("{w}", r.choice(TOPICS), 1).replace("{y}", str(r.randrange(2001, 2025)), 1)
                out.append((f"{r.choice(('http', 'https'))}://{r.choice(('', '', 'www.', 'm.', 'blog.'))}{name}.{r.choice(kind['suffixes'])}{form}", name, label))
    return out


def built_in_labels(spark: SparkSession) -> DataFrame:
    """(url, label) of the built-in set."""
    return spark.createDataFrame([(url, label) for url, _, label in made_labels()], "url string, label int")


def split_url(rows: DataFrame, url: str = "url") -> DataFrame:
    return rows.withColumn("_parts", parts(F.col(url))).select(*[c for c in rows.columns], "_parts.host", "_parts.path", "_parts.query")


def fit(labelled: DataFrame) -> tuple[boost.Boosted, dict[str, float]]:
    """From rows (url, label), of which at most MAX_LABELLED are used; suffix statistics come from the same rows."""
    bounded = split_url(labelled.select("url", "label").orderBy(F.xxhash64("url"), "url", "label").limit(MAX_LABELLED)).cache()
    counts = bounded.groupBy(suffix(F.col("host")).alias("suffix")).agg(F.sum("label").alias("pos"), F.count("*").alias("n")).orderBy(F.desc("n"), "suffix").limit(MAX_SUFFIXES).collect()
    odds = {r["suffix"]: math.log((r["pos"] + 1) / (r["n"] - r["pos"] + 1)) for r in counts}
    model = boost.fit(lexical(bounded, odds), FEATURES, trees=TREES, depth=DEPTH)
    bounded.unpersist()
    return model, odds


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule (verdict, host, path) that fits, or null."""
    if not rules:
        return F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, h, p in rules:
        by_host.setdefault(h, []).append((p, verdict))
    one = lambda h, p, v: F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(p).alias("p"))
    table = F.create_map(*[x for h, ps in by_host.items() for x in (F.lit(h), F.array(*[one(h, p, v) for p, v in ps]))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.flatten(F.filter(F.transform(suffixes, lambda s: table[s]), lambda x: x.isNotNull())), lambda r: path.startswith(r["p"]))
    best = F.array_max(fitting)
    return best


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], labelled: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, probability (of being unwanted)."""
    model, odds = fit(labelled)
    rows = split_url(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")))
    scored = lexical(rows, odds).select("page_id", "host", "path", matched_rule(F.col("host"), F.col("path"), rules).alias("best"), model.probability().alias("probability"))
    return scored.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.when(F.col("probability") >= 0.5, "block").otherwise("allow")).alias("verdict"), "probability",
    )
