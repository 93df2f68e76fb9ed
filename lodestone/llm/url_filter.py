"""URL filter: host and path rules, then logistic regression on hashed character n-grams.

Everything is a DataFrame expression. The model is trained by one SQL expression
over a small labelled table; its weights are a fixed number of doubles, whatever
the size of the input.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 4096
EPOCHS = 20
RATE = 2.0
DECAY = 1e-4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (rule, verdict); a rule is a host and the start of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: What hosts to block call themselves, and others, in general examples of four languages.
BAD = """royal-casino casino-palace online-casino mega-slots poker-king free-poker win-jackpot sport-bets bets-today betting-tips
    free-spins roulette-win xxx-adult adult-videos adult-chat xxx-tube porn-clips hot-cams sex-dating x-movies escort-girls
    spam-host link-farm spam-mail mail-spam content-farm diet-pills viagra-shop pills-online cheap-watches cheap-replica
    cheap-meds pills-store payday-loans quick-loan crack-keygen warez-torrent malware-drop phishing-login ads-server
    ad-clicks ads-click click-track user-track track-ads casino-slots adult-cams get-rich click-bait""".split()
GOOD = """news.daily library garden docs.project wiki.history weather university museum recipes.kitchen school health.clinic travel
    education theatre weekly nation earth mathematics translation station brothers northern thinking fiction mother
    collection publishing another feather exhibition anthem anthology tradition southern gathering convention smith birth
    threshold science music maps.city sports.club maison cuisine jardin bibliotheque meteo voyage lecture ecole haus-garten
    bibliothek wetter zeitung schule reisen kochen wissenschaft casa biblioteca noticias cocina escuela viajes tiempo
    open-source high-school book-club city-council""".split()
BEFORE = ("", "www.", "m.", "blog.")
DOMAINS = ("test", "example.com", "example.org", "example.net", "invalid")  # those that no one has
BEHIND = ("/en/7", "/es/310.html", "/de/95/", "/fr/1204", "/archive", "", "/en/633/")


def labelled_urls(bad: list[str] = BAD, good: list[str] = GOOD) -> list[tuple[str, int]]:
    """(url, 1 to block): every host with two of the forms, domains and paths that all share, so that these say nothing."""
    return [(f"http://{BEFORE[(i + 2 * k) % 4]}{stem}.{DOMAINS[(i + 2 * k) % 5]}{BEHIND[(i + 3 * k) % 7]}", label) for label, stems in ((1, bad), (0, good)) for i, stem in enumerate(stems) for k in (0, 1)]


LABELLED = tuple(labelled_urls())  # the small table that the model learns from


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without '://'."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER)
    return host, F.regexp_extract(text, pattern, 2)


def features(host: Column, path: Column) -> tuple[Column, Column]:
    """Bucket numbers of the character n-grams (3 to 5) of host and of path, repeats kept; all digits of a path count as 0."""

    def grams(text: Column, mark: str, n: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        return F.transform(at, lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))

    host, path = F.concat(F.lit("^"), host, F.lit("$")), F.concat(F.lit("^"), F.translate(path, "123456789", "000000000"), F.lit("$"))
    bucket = lambda g: F.pmod(F.crc32(g.cast("binary")), F.lit(BUCKETS)).cast("int")
    return tuple(F.transform(F.concat(*(grams(t, m, n) for n in (3, 4, 5))), bucket) for t, m in ((host, "h"), (path, "p")))


def _scaled(x: Column, f: str) -> Column:
    """x over the length of f: host and path weigh alike, however long they are."""
    return x / F.sqrt(F.size(f).cast("double"))


def train(spark: SparkSession, labelled: DataFrame | None = None) -> list[float]:
    """Weights and, last, the bias of the regression; labelled has url and label (1 to block) and must be small.

    Stochastic gradient descent in one fold over the rows, in order of their url's
    hash, so the same table always gives the same weights. Rows with a null label
    are left out; an empty table gives zeros, and so a score of a half.
    """
    if labelled is None:
        table = json.dumps([{"url": url, "label": label} for url, label in LABELLED])
        labelled = spark.range(1).select(F.inline(F.from_json(F.lit(table), "array<struct<url: string, label: int>>")))
    rows = labelled.select("url", F.col("label").cast("double").alias("label")).where("label IS NOT NULL")
    fh, fp = features(*host_path(F.col("url")))
    feats = rows.select(F.md5("url").alias("at"), "label", fh.alias("fh"), fp.alias("fp"))
    count = lambda f, d: _scaled(F.size(F.filter(f, lambda x: x == d)), f)
    dense = feats.select("at", "label", F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda d: count("fh", d) + count("fp", d)).alias("x"))
    one = dense.agg(F.sort_array(F.collect_list(F.struct("at", "label", "x"))).alias("rows"))
    step = f"""aggregate(flatten(array_repeat(rows, {EPOCHS})), array_repeat(0D, {BUCKETS + 1}), (w, r) ->
        transform(array({RATE}D * (r.label - 1D / (1D + exp(-aggregate(zip_with(slice(w, 1, {BUCKETS}), r.x, (a, b) -> a * b), w[{BUCKETS}], (s, v) -> s + v))))),
            g -> zip_with(w, array_append(r.x, 1D), (a, b) -> a * {1 - DECAY}D + g * b))[0])"""
    return list(one.select(F.expr(step).alias("w")).first()["w"])


def classify(pages: DataFrame, weights: list[float], rules=RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of pages.

    The longest rule whose host is the url's or a parent domain of it, and whose
    path starts the url's path, decides; else the model does. score is the
    model's probability for block, given for all rows. Null and empty urls, and
    those without '://', have empty host and path and are judged by the model.
    """
    host, path = host_path(F.col("url"))
    df = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):
        its_host, _, rest = text.partition("/")
        fits = ((F.col("host") == its_host) | F.col("host").endswith("." + its_host)) & F.col("path").startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    table = F.from_json(F.lit(json.dumps(weights[:-1])), "array<double>")
    fh, fp = features(F.col("host"), F.col("path"))
    df = df.select("*", rule.alias("rule"), verdict.alias("ruled"), fh.alias("fh"), fp.alias("fp"))
    total = lambda f: _scaled(F.aggregate(f, F.lit(0.0), lambda s, i: s + F.get(table, i)), f)
    df = df.withColumn("score", 1 / (1 + F.exp(-(total("fh") + total("fp") + F.lit(float(weights[-1]))))))
    judged = F.coalesce("ruled", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return df.select("page_id", "host", "path", "rule", judged.alias("verdict"), "score")
