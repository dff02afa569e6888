"""URL filter: rules on host suffixes and path prefixes, then logistic regression on hashed character n-grams.

The model is fitted on a small labelled table (labelled() below) whose size does not depend on the data.
Fitting runs in the JVM on dense count vectors made by SQL functions; judging a url is one SQL
expression: its n-grams are hashed to buckets and the weights of the buckets are summed.

Defined results: a null url or one without :// has an empty host and path, fits no rule and is judged
by the model's intercept alone over the empty string's n-grams; repeated rows are judged alike; urls of
any length are read whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: (verdict, rule); a rule is a host, then a path prefix.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: Production parameters of the model.
BUCKETS, GRAMS, REGULARISATION, ITERATIONS, THRESHOLD = 4096, (3, 4), 0.01, 60, 0.5

#: The labelled names: sites that a curator would block, and ordinary ones.
BLOCKED_NAMES = (
    "spam-depot", "spamhub", "link-spam", "spam-mill", "link-farm", "content-farm", "clickfarm", "seo-farm",
    "adult-videos", "adult-chat", "free-porn", "xxx-cams", "hot-sex", "casino-royal", "online-casino", "poker-win",
    "bets-online", "free-slots", "free-bonus", "cheap-meds", "discount-pills", "buy-viagra", "cheap-watches", "payday-loans",
    "warez-crack", "torrent-keygen", "malware-drop", "phish-login", "ads-server", "click-track", "ad-tracker", "popup-ads",
)
ALLOWED_NAMES = (
    "lakeside", "thornton", "harbour", "northern", "library", "gardening", "museum", "physics",
    "thunder", "therapy", "station", "theatre", "recipes", "weather", "history", "pythondocs",
    "nation", "thinking", "hedge", "ithaca", "tionesta", "rethink", "enther", "thebes",
    "fashion", "than", "thistle", "ethan", "method", "months", "mention", "motions",
    "other", "hundred", "handbook", "ondine", "reading", "sheet", "whether", "threshold",
    "lesson", "stone", "ashes", "truth", "bible", "entities", "erland", "ideas",
)
SUBDOMAINS, TLDS, LANGUAGES = ("", "www.", "m.", "blog."), ("com", "net", "org"), ("en", "fr", "de", "es")
BLOCKED_PATHS, ALLOWED_PATHS = ("/{}/free-bonus/0", "/{}/xxx/video-0"), ("/{}/article/0", "/{}/wiki/page-0")


def labelled() -> list[tuple[str, float]]:
    """(url, 1.0 to block): each name under each subdomain, with a plain path or, for every fourth name, a telling one."""
    rows = []
    for names, telling, y in ((BLOCKED_NAMES, BLOCKED_PATHS, 1.0), (ALLOWED_NAMES, ALLOWED_PATHS, 0.0)):
        for i, name in enumerate(names):
            for k, sub in enumerate(SUBDOMAINS):
                path = telling[k % 2] if i % 4 == 0 else ("/{}/0", "/{}/0/")[k % 2]
                rows.append((f"https://{sub}{name}.example.{TLDS[(i + k) % 3]}{path.format(LANGUAGES[(i // 4 + k) % 4])}", y))
    return rows


def host_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, k), F.lit("")) for k in (1, 2))
    return ascii_lower(host), path


def buckets(host: Column, path: Column) -> Column:
    """The buckets of all n-grams of host and path, with repeats; a digit counts as 0."""

    def grams(text: Column, n: int, seed: str) -> Column:
        marked = F.concat(F.lit("^"), F.translate(text, "123456789", "000000000"), F.lit("$"))
        last = F.char_length(marked) - n + 1
        at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.pmod(F.xxhash64(F.lit(seed), marked.substr(i, F.lit(n))), F.lit(BUCKETS)).cast("int"))

    return F.concat(*[grams(t, n, f"{kind}{n}") for t, kind in ((host, "h"), (path, "p")) for n in GRAMS])


def fit(spark: SparkSession, rows: list[tuple[str, float]]) -> tuple[list[float], float]:
    """The weights of the buckets and the intercept."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    values = ", ".join(f"('{u}', {y}D)" for u, y in rows)
    data = spark.sql(f"SELECT * FROM VALUES {values} AS t(url, label)")
    # The exchange keeps the buckets from being computed again for each of their uses.
    got = data.select("label", buckets(*host_path(F.col("url"))).alias("b")).repartition(1)
    dense = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda j: F.array_contains("b", j).cast("double"))
    model = LogisticRegression(maxIter=ITERATIONS, regParam=REGULARISATION, standardization=False).fit(got.select("label", array_to_vector(dense).alias("features")))
    return [float(x) for x in model.coefficients.toArray()], float(model.intercept)


def score(host: Column, path: Column, weights: list[float], intercept: float) -> Column:
    """The probability that a url is to be blocked; each bucket counts once."""
    w = F.array(*[F.lit(x) for x in weights])
    z = F.aggregate(F.array_distinct(buckets(host, path)), F.lit(intercept), lambda acc, b: acc + F.get(w, b))
    return 1 / (1 + F.exp(-z))


def matching(host: Column, path: Column, rules: tuple) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: len(r[1])):  # a longer rule is asked first
        at, _, start = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{start}")
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def judge(urls: DataFrame, rules: tuple = RULES, rows: list[tuple[str, float]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score for each row with a url."""
    weights, intercept = fit(urls.sparkSession, rows or labelled())
    host, path = host_path(F.col("url"))
    got = urls.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matching(F.col("host"), F.col("path"), rules)
    got = got.select("*", rule.alias("rule"), verdict.alias("by_rule"), score(F.col("host"), F.col("path"), weights, intercept).alias("score"))
    model = F.when(F.col("score") > threshold, "block").otherwise("allow")
    return got.select("page_id", "host", "path", "rule", F.coalesce("by_rule", model).alias("verdict"), F.round("score", 6).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))


SQL = None
