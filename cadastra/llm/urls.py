"""URL filter: rules, then a ratio of character Markov models, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.shared import spread_join, table, written

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Characters of context at most.
ORDER = 4
#: How much the next shorter context counts against a context's own counts.
STRENGTH = 2.0
#: Scores are cut into bins of this width to set the threshold.
BIN = 0.005
START = "\x02"
OWN = ("host", "path", "rule", "verdict", "score")


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host and path. A null url, or one without ://, has empty ones."""
    rest = F.when(F.instr(F.col(url_col), "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)", 1)
    return pages.withColumn("host", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).withColumn("path", path)


def rule_of(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(the longest fitting rule as text or null, its verdict or null)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last, longest one wins
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def spelled(url_col: str) -> Column:
    """What the models read: the url without scheme, in lower case. host and path are not enough: queries count too."""
    return F.lower(F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), "^[^:]*://", ""))


def grams(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """One row per position of _url and context length: _gram is the context and the character after it."""
    padded = F.concat(F.lit(START), F.col("_url"))
    rows = urls.where("length(_url) > 0").select("*", F.explode(F.sequence(F.lit(2), F.length("_url") + 1)).alias("_at"))
    every = F.transform(F.sequence(F.lit(1), F.least(F.lit(order + 1), F.col("_at"))), lambda n: F.substr(padded, F.col("_at") - n + 1, n))
    return rows.select("*", F.explode(every).alias("_gram"))


def ratio_model(labelled: DataFrame, order: int = ORDER, strength: float = STRENGTH) -> DataFrame:
    """(_kind, _gram, _value) from (_url, _accept): what the two models say of every n-gram and every context.

    A context's distribution is its counts plus strength times the distribution of the context one character shorter;
    the shortest one adds a uniform distribution over 128 characters. Kind g: the log of P(last character | those before)
    accepted over rejected, for each n-gram that either kind of url has. Kind c: the log of what a context leaves to the
    next shorter one, accepted over rejected, which a character weighs that neither kind has after it.
    """
    counted = grams(labelled.select("_url", "_accept"), order).groupBy("_gram").agg(F.count_if("_accept").alias("a"), F.count_if(~F.col("_accept")).alias("r"))
    every = written(counted, "url-grams")
    context = F.expr("substring(_gram, 1, length(_gram) - 1)")
    totals = written(every.groupBy(context.alias("_context")).agg(F.sum("a").alias("na"), F.sum("r").alias("nr")), "url-contexts")
    level = written(every.withColumn("_context", context).join(totals, "_context").withColumn("_n", F.length("_gram")), "url-levels")
    uniform = F.lit(1.0 / 128)
    smooth = lambda c, n, shorter: (F.col(c) + strength * shorter) / (F.col(n) + strength)
    done = level.where("_n = 1").select("_gram", smooth("a", "na", uniform).alias("pa"), smooth("r", "nr", uniform).alias("pr"))
    found = done
    for n in range(2, order + 2):  # a suffix has as many longer grams as there are characters at most
        shorter = done.select(F.col("_gram").alias("_suffix"), F.col("pa").alias("sa"), F.col("pr").alias("sr"))
        own = level.where(F.col("_n") == n).withColumn("_suffix", F.expr("substring(_gram, 2)")).join(shorter, "_suffix", "left")
        done = own.select("_gram", smooth("a", "na", F.coalesce("sa", uniform)).alias("pa"), smooth("r", "nr", F.coalesce("sr", uniform)).alias("pr"))
        found = found.unionByName(done)
    values = found.select(F.lit("g").alias("_kind"), "_gram", F.log(F.col("pa") / F.col("pr")).alias("_value"))
    left = totals.select(F.lit("c").alias("_kind"), F.col("_context").alias("_gram"), F.log((F.col("nr") + strength) / (F.col("na") + strength)).alias("_value"))
    return written(values.unionByName(left), "url-model")


def scored(urls: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """urls, which have _url, with _score: the mean over positions of the models' log ratio, 0 for no text.

    Each different url is scored once. The different windows, which are the longest grams of its positions, get their log
    ratio: that of their longest known suffix, and what each known longer context leaves to the next shorter one. Then
    windows meet positions. Both joins are dealt over parts, as a gram may be in most urls.
    """
    texts = urls.where("length(_url) > 0").select("_url").distinct()
    texts = written(texts.withColumn("_row", F.monotonically_increasing_id()), "url-texts")
    padded = F.concat(F.lit(START), F.col("_url"))
    size = F.least(F.lit(order + 1), F.col("_at"))
    places = texts.select("*", F.explode(F.sequence(F.lit(2), F.length("_url") + 1)).alias("_at"))
    places = places.select("_row", "_at", F.substr(padded, F.col("_at") - size + 1, size).alias("_window"))
    part = lambda kind, n, end: F.struct(F.lit(kind).alias("_kind"), n.alias("_n"), F.substr(F.col("_window"), F.length("_window") - n + 1 - end, n).alias("_gram"))
    sizes = F.sequence(F.lit(1), F.length("_window"))
    # the shortest context, which all windows have, is no row to be joined but a number
    parts = F.concat(F.transform(sizes, lambda n: part("g", n, F.lit(0))), F.transform(F.filter(sizes, lambda n: n < F.length("_window")), lambda n: part("c", n, F.lit(1))))
    ends = places.select("_window").distinct().select("_window", F.inline(parts))
    none = model.where("_kind = 'c' AND _gram = ''").agg(F.max("_value")).first()[0] or 0.0
    own = spread_join(ends, model, ["_kind", "_gram"], ["_window"]).groupBy("_window").agg(F.collect_list(F.struct("_kind", "_n", "_value")).alias("_parts"))  # 2 * order + 1 at most
    longest = F.coalesce(F.array_max(F.transform(F.filter("_parts", lambda p: p["_kind"] == "g"), lambda p: p["_n"])), F.lit(0))
    value = F.aggregate("_parts", F.lit(0.0), lambda s, p: s + F.when(((p["_kind"] == "g") & (p["_n"] == F.col("_longest"))) | ((p["_kind"] == "c") & (p["_n"] >= F.col("_longest"))), p["_value"]).otherwise(0.0))
    values = own.withColumn("_longest", longest).select("_window", (value + F.when(F.col("_longest") == 0, none).otherwise(0.0)).alias("_value"))
    # a window without any known part has only the shortest context
    total = spread_join(places, values, ["_window"], ["_row", "_at"], "left").groupBy("_row").agg(F.sum(F.coalesce("_value", F.lit(none))).alias("_sum"))
    scores = texts.join(total, "_row").select("_url", (F.col("_sum") / F.length("_url")).alias("_score"))
    by = [f.name for f in urls.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return spread_join(urls, scores, ["_url"], by, "left").select(*urls.columns, F.coalesce("_score", F.lit(0.0)).alias("_score"))


def threshold(scores: DataFrame) -> float:
    """The score from which on a url is accepted: most right on average over both classes, from (_score, _accept).

    Held-out labelled urls are counted by bins of the score; between equally good cuts the middle one is taken. 0
    without urls of both classes.
    """
    bins = scores.groupBy(F.floor(F.col("_score") / BIN).cast("long").alias("bin")).agg(F.count_if("_accept").alias("a"), F.count_if(~F.col("_accept")).alias("r"))
    rows = sorted(bins.collect())  # as many as bins have scores: the mean log ratio is within some 20 / BIN of 0
    accepted, rejected = sum(r["a"] for r in rows), sum(r["r"] for r in rows)
    if not accepted or not rejected:
        return 0.0
    best, cuts, below_a, below_r = -1.0, [], 0, 0
    for i, row in enumerate(rows):
        right = (accepted - below_a) / accepted + below_r / rejected
        last = rows[i - 1]["bin"] + 1 if i else row["bin"]
        if right > best + 1e-12:
            best, cuts = right, []
        if right >= best - 1e-12:
            cuts.append((last + row["bin"]) / 2)
        below_a, below_r = below_a + row["a"], below_r + row["r"]
    if 1.0 > best:
        return (rows[-1]["bin"] + 1) * BIN
    return cuts[len(cuts) // 2] * BIN


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url_col: str = "url", order: int = ORDER) -> DataFrame:
    """pages with host, path, rule and verdict (allow or block).

    A url that a rule fits has the longest such rule's verdict. The others get that of the models: those rules' urls
    are the accepted and rejected examples, four fifths of them to learn from and the rest to set the threshold, by
    the url's hash. An empty or null url has the score 0. Equal urls get equal verdicts. Columns of pages that are named as
    one of the result's own (OWN) give way to it; other names may be any.
    """
    name, verdict = rule_of(rules)
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns if c not in OWN or c == url_col)).alias("_page"), F.col(f"`{url_col}`").alias("_given"))
    judged = with_parts(rows, "_given").withColumn("rule", name).withColumn("verdict", verdict).withColumn("_url", spelled("_given"))
    labelled = judged.where("rule IS NOT NULL").select("_url", (F.col("verdict") == "allow").alias("_accept"))
    apart = F.crc32(F.col("_url")) % 5 == 0
    model = ratio_model(labelled.where(~apart), order)
    cut = threshold(scored(labelled.where(apart), model, order))
    ruled = judged.where("rule IS NOT NULL").select("_page", "host", "path", "rule", "verdict", F.lit(None).cast("double").alias("score"))
    texts = scored(judged.where("rule IS NULL").select("_page", "host", "path", "rule", "_url"), model, order)
    decided = F.when(F.col("_score") >= F.lit(cut), "allow").otherwise("block")
    both = ruled.unionByName(texts.select("_page", "host", "path", "rule", decided.alias("verdict"), F.col("_score").alias("score")))
    return both.select(*(F.col("_page")[c].alias(c) for c in pages.columns if c not in OWN), *OWN)


def op5_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url: page_id, host, path, rule and verdict; score is the model's, null where a rule decides."""
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
