"""Joins to areas, dimensions and rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadastra.functions.codes import area_code
from cadastra.functions.text import present_collapsed

#: Dimensions of at most so many rows are broadcast; each caller's dimension is counted first.
SMALL = 10_000


def small(dimension: DataFrame) -> DataFrame:
    """The dimension with a broadcast hint if it is small; else the join is left to Spark."""
    return F.broadcast(dimension) if dimension.limit(SMALL + 1).count() <= SMALL else dimension


def with_counts(sources: DataFrame, records: DataFrame, key: str, name: str = "records") -> DataFrame:
    """Every source with its number of records, 0 included."""
    counts = records.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return sources.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def with_dimensions(base: DataFrame, key: str, dimensions: Sequence[DataFrame], defaults: dict[str, object] | None = None) -> DataFrame:
    """Left joins by one key, then defaults for what is missing."""
    out = reduce(lambda df, d: df.join(d, key, "left"), dimensions, base)
    return out.fillna(defaults) if defaults else out


def by_name(records: DataFrame, areas: DataFrame, name: str, normalise=present_collapsed, area_name: str = "area_name", area_key: str = "area_code") -> DataFrame:
    """Left join by exact normalised name; of areas with equal names the last key holds."""
    lookup = areas.groupBy(normalise(area_name).alias("_name")).agg(F.max(area_key).alias(area_key))
    return records.withColumn("_name", normalise(name)).join(small(lookup), "_name", "left").drop("_name")


def resolve_area(records: DataFrame, areas: DataFrame, codes: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Adds area_code and unmapped_reason.

    The first code column that holds a code decides, even for an area that is unknown; only without any code are the names
    tried in their order. Reasons, in this order: unknown_code, unknown_name, no_area.
    """
    code = F.coalesce(*(area_code(c) for c in codes)) if codes else F.lit(None).cast("string")
    known = areas.select(F.col("area_code").alias("_known")).distinct()
    out = records.withColumn("_code", code).join(small(known), F.col("_code") == F.col("_known"), "left")
    lookup = small(areas.groupBy(present_collapsed("area_name").alias("_name")).agg(F.max("area_code").alias("_found")))
    hits = []
    for i, n in enumerate(names):
        own = lookup.select(F.col("_name").alias(f"_name{i}"), F.col("_found").alias(f"_found{i}"))
        out = out.join(own, present_collapsed(n) == F.col(f"_name{i}"), "left").drop(f"_name{i}")
        hits.append(f"_found{i}")
    by_names = F.coalesce(*hits) if hits else F.lit(None).cast("string")
    found = F.when(F.col("_code").isNotNull(), F.col("_known")).otherwise(by_names)
    named = F.coalesce(*(present_collapsed(n) for n in names)) if names else F.lit(None).cast("string")
    reason = F.when(found.isNotNull(), F.lit(None).cast("string")).when(F.col("_code").isNotNull(), "unknown_code").when(named.isNotNull(), "unknown_name").otherwise("no_area")
    return out.withColumn("area_code", found).withColumn("unmapped_reason", reason).drop("_code", "_known", *hits)


def once_per_area(records: DataFrame, record_id: str, lists: str, own: str | None = None) -> DataFrame:
    """(record, area) once for each distinct area in a record's list and its own area."""
    every = F.coalesce(F.col(lists), F.array()) if own is None else F.concat(F.coalesce(F.col(lists), F.array()), F.array(F.col(own)))
    return records.select(record_id, F.explode(F.array_distinct(every)).alias("area_code")).where("area_code IS NOT NULL")


def outer_by_key(frames: Sequence[DataFrame], key: str, measures: Sequence[str]) -> DataFrame:
    """Full outer join of one measure each; a missing measure is 0."""
    out = reduce(lambda a, b: a.join(b, key, "full"), frames)
    return out.fillna(0, list(measures))


def mandatory(records: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Inner join in which a record without its dimension row is an error."""
    joined = records.join(dimension.withColumn("_found", F.lit(True)), key, "left")
    error = F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit(f"no {key} "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)
    return joined.where(error).drop("_found")


def by_pattern(records: DataFrame, grains: DataFrame, key: str, pattern: str = "key_pattern") -> DataFrame:
    """Each record with the one grain whose anchored pattern matches its key; _matches tells how many did.

    Keys repeat a lot, so the patterns are tried on the distinct keys only.
    """
    keys = records.select(key).distinct()
    tried = keys.join(small(grains), F.rlike(F.col(key), F.concat(F.lit("^(?:"), F.col(pattern), F.lit(")$"))), "left")
    counted = tried.groupBy(key).agg(F.count(pattern).alias("_matches"), F.max(pattern).alias(pattern))
    return records.join(counted, key, "left")


def glob_pattern(selector: str) -> Column:
    """A column of shell patterns as anchored regular expressions: * is any text, ? any character, [..] and [!..] sets with ranges.

    A bracket that no later one closes stands for itself, as do * and ? in a set; one may come first in its set. A range that ends before
    it begins is empty.
    """
    plain = lambda t: F.regexp_replace(t, r"([\\.+^$(){}|\[\]*?&~#-])", r"\\$1")
    edges = lambda m: (F.substring(m, 1, 1), F.substring(m, -1, 1))
    span = lambda m: F.when(F.length(m) < 3, plain(m)).when(edges(m)[0] <= edges(m)[1], F.concat(plain(edges(m)[0]), F.lit("-"), plain(edges(m)[1]))).otherwise("")

    def chosen(token: Column) -> Column:
        negative = F.startswith(token, F.lit("[!"))
        inside = F.substring(token, F.when(negative, 3).otherwise(2), F.length(token) - F.when(negative, 3).otherwise(2))
        members = F.array_join(F.transform(F.regexp_extract_all(inside, F.lit("(?s).-.|."), F.lit(0)), span), "")
        return F.when(members == "", F.when(negative, ".").otherwise("(?!)")).otherwise(F.concat(F.when(negative, "[^").otherwise("["), members, F.lit("]")))

    tokens = F.regexp_extract_all(F.col(selector), F.lit(r"(?s)\[!?+\]?+[^\]]*\]|\*+|\?|\[|[^*?\[]+"), F.lit(0))
    one = lambda t: F.when(F.startswith(t, F.lit("*")), ".*").when(t == "?", ".").when(F.startswith(t, F.lit("[")) & (F.length(t) > 1), chosen(t)).otherwise(plain(t))
    return F.concat(F.lit("(?s)^"), F.array_join(F.transform(tokens, one), ""), F.lit("\\z"))


def bind_globs(paths: DataFrame, outputs: DataFrame) -> DataFrame:
    """(path, selector, problem) of every path of ``paths`` and every selector of ``outputs`` (selector, exact, expected_files).

    A path should fit exactly one selector. problem says what is wrong, null for a proper binding: a path without a selector
    or with several, a selector that fits no path, or another number of paths than expected_files. An exact selector is a
    path, not a pattern.
    """
    chosen = outputs.select("selector", "exact", F.col("expected_files").cast("long").alias("expected_files"), glob_pattern("selector").alias("_glob"))
    known = paths.select("path").distinct()
    fits = F.when(F.col("exact"), F.col("path") == F.col("selector")).otherwise(F.rlike(F.col("path"), F.col("_glob")))
    pairs = known.join(small(chosen), fits).select("path", "selector", "expected_files")
    claims = pairs.groupBy("path").agg(F.count(F.lit(1)).alias("_claims"))
    files = outputs.select("selector", F.col("expected_files").cast("long").alias("expected_files")).join(pairs.groupBy("selector").agg(F.count(F.lit(1)).alias("_files")), "selector", "left")
    wrong = F.when(F.col("_files").isNull(), "fits no file").when(F.col("_files") != F.col("expected_files"), "fits another number of files")
    by_path = known.join(pairs.select("path", "selector"), "path", "left").join(claims, "path", "left")
    problem = F.when(F.col("_claims").isNull(), "no contract").when(F.col("_claims") > 1, "several contracts")
    bound = by_path.select("path", "selector", problem.alias("problem"))
    return bound.unionByName(files.select(F.lit(None).cast("string").alias("path"), "selector", wrong.alias("problem")).where("problem IS NOT NULL"))


def by_prefix(urls: DataFrame, rules: DataFrame, origin: str = "origin", path: str = "path", query: str | None = None) -> DataFrame:
    """Each row of urls with its best rule (rule_path, source_id, denied) of the same origin; rows of equal urls all stay.

    A rule's path must be the url's or an ancestor of it; a root rule is for all paths. Where ``rules`` has rule_query, a rule with a query is for
    that query alone; where it has exact, an exact rule is for its path and query alone. Exact rules are best, then the longest path, the
    longest query, the smallest source. Each different url goes to its ancestors' paths, so rules are found by equality however many an
    origin has, and the best one is a partial aggregate.
    """
    given = {"rule_query": F.lit(""), "exact": F.lit(False)}
    rules = rules.withColumns({c: F.coalesce(F.col(c), v) if c in rules.columns else v for c, v in given.items()})
    rules = rules.select(F.col("rule_origin").alias("_origin"), F.rtrim("rule_path", F.lit("/")).alias("_base"), "rule_path", "rule_query", "exact", "source_id", "denied")
    asked = F.coalesce(F.col(query), F.lit("")) if query else F.lit("")
    places = urls.select(F.col(origin).alias("_origin"), F.col(path).alias("_path"), asked.alias("_query")).where("_origin IS NOT NULL AND _path IS NOT NULL").distinct()
    steps = F.split("_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    met = places.withColumn("_base", F.explode(F.array_distinct(above))).join(small(rules), ["_origin", "_base"])
    same_query = F.col("rule_query") == F.col("_query")
    below = (F.col("_path") == F.col("rule_path")) | F.startswith(F.col("_path"), F.concat("_base", F.lit("/"))) | (F.col("rule_path") == "/")
    fits = F.when(F.col("exact"), (F.col("_path") == F.col("rule_path")) & same_query).otherwise(below & ((F.col("rule_query") == "") | same_query))
    order = F.struct((~F.col("exact")).alias("e"), (-F.length("rule_path")).alias("p"), (-F.length("rule_query")).alias("q"), "source_id", "rule_path", "rule_query", "denied")
    best = met.where(fits).groupBy("_origin", "_path", "_query").agg(F.min(order).alias("_best"))
    rows = urls.withColumn("_asked", asked).join(best, (F.col(origin) == F.col("_origin")) & (F.col(path) == F.col("_path")) & (F.col("_asked") == F.col("_query")), "left")
    return rows.select(*urls.columns, "_best.rule_path", "_best.source_id", "_best.denied")


def compare_releases(base: DataFrame, head: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed, changed or unchanged."""
    joined = base.select(key, F.col(value).alias("_base"), F.lit(True).alias("_b")).join(head.select(key, F.col(value).alias("_head"), F.lit(True).alias("_h")), key, "full")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_h").isNull(), "removed").when(F.col("_base").eqNullSafe(F.col("_head")), "unchanged").otherwise("changed")
    return joined.select(key, change.alias("change"))


def churn(base: DataFrame, head: DataFrame, key: str) -> DataFrame:
    """One row: shared, union, and one minus their ratio with 6 decimals; 0 if both are empty."""
    from cadastra.functions.numbers import rounded

    joined = base.select(key).distinct().withColumn("_b", F.lit(1)).join(head.select(key).distinct().withColumn("_h", F.lit(1)), key, "full")
    both = joined.agg(F.count_if(F.col("_b").isNotNull() & F.col("_h").isNotNull()).alias("shared"), F.count(F.lit(1)).alias("either"))
    return both.withColumn("churn", rounded(F.when(F.col("either") == 0, 0.0).otherwise(1 - F.col("shared").cast("double") / F.col("either")), 6))


def partition_of(items: DataFrame, sets: Sequence[DataFrame], key: str) -> DataFrame:
    """Items that are in none or in several of the sets, with how many: no rows if the sets partition them."""
    tagged = reduce(DataFrame.unionByName, [s.select(key).distinct().withColumn("_in", F.lit(1)) for s in sets])
    counted = tagged.groupBy(key).agg(F.sum("_in").alias("sets"))
    return items.select(key).distinct().join(counted, key, "left").select(key, F.coalesce("sets", F.lit(0)).alias("sets")).where("sets <> 1")


def overlaps(features: DataFrame, box: tuple[float, float, float, float], columns: Sequence[str] = ("min_lon", "min_lat", "max_lon", "max_lat")) -> DataFrame:
    """Features whose bounding box meets (min_lon, min_lat, max_lon, max_lat), edges included."""
    min_lon, min_lat, max_lon, max_lat = box
    if min_lon > max_lon or min_lat > max_lat:
        raise ValueError("the box ends before it begins")
    a, b, c, d = (F.col(x) for x in columns)
    return features.where((c >= min_lon) & (a <= max_lon) & (d >= min_lat) & (b <= max_lat))


def where_given(df: DataFrame, **values: object) -> DataFrame:
    """Equality filters on the columns whose value is not None; a list is a set of values."""
    conditions: list[Column] = [F.col(c).isin(v) if isinstance(v, list | tuple | set) else F.col(c) == v for c, v in values.items() if v is not None]
    return reduce(DataFrame.where, conditions, df)


def search(df: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """Rows in whose joined lower-case columns the text occurs."""
    return df.where(F.contains(F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns))), F.lit(text.lower())))
