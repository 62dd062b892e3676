"""JSON documents of any depth as a table of nodes, and what is asked of them as joins and aggregates over it.

tree() takes documents apart level by level: one exploded VARIANT a level, so as many steps as the documents are deep. All else is
Catalyst expressions: there is no Python worker and no recursion in a task. A document that is no JSON, has a key twice or is nested
deeper than the parser goes (1000 levels) has no nodes but a root of the kind ``invalid``; one that is deeper than asked for has nodes with
``cut`` set. Neither touches the other documents.

Objects' keys come in alphabetical order. Whole numbers are ``integer``, of up to 38 digits; others are ``number``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadastra.functions.text import EMAIL, PHONE_RECORDS, forbidden_key, redact, snake_key
from cadastra.functions.variants import CONTAINERS, as_list, as_object, kind_of, quoted, text_of
from cadastra.scratch import stored

MAX_DEPTH = 40
FILE_ROWS = 100_000  # of a level's files: a few large documents' members are dealt over many tasks from there on
NOTHING = "_nothing"  # stands for kept columns where there are none
# Keys of which a path may show the name.
SAFE_KEY = r"^[A-Za-z_฀-๿][A-Za-z0-9_\-฀-๿]{0,79}$"
# Presentation keys that flattened readings never keep.
PRESENTATION = ("avg_color", "color", "colors", "style", "styles", "class", "className", "background", "backgroundColor")
# Keys, endings of keys and words in keys or texts that carry meaning, and keys that name what they speak of.
MEANING = (
    "aggregation_level", "calculation_method", "calculation_method_th", "candidate_not_fact", "classification", "currency", "data_grain", "data_grain_th",
    "definition", "definition_th", "denominator", "denominator_th", "geographic_level", "geographic_meaning", "geographic_scope", "geography_level",
    "geography_meaning", "geography_scope", "grain", "grain_th", "indicator_name", "indicator_name_th", "measure_name", "measure_name_th", "methodology",
    "methodology_th", "metric_label", "metric_label_th", "metric_name", "metric_name_th", "province_join_method", "quality_label", "quality_label_th",
    "record_grain", "review_state", "scope_warning", "scope_warning_th", "status", "publication_state", "unit",
    "unit_th", "verification_state",
)
MEANING_ENDS = ("_denominator", "_definition", "_definition_th", "_grain", "_method", "_method_th", "_status", "_unit", "_currency")
PLAIN_ENDS = ("_count", "_label", "_name", "_rows", "_total", "_value")
REVIEW_KEYS = ("accepted", "candidate", "classification", "review", "verification")
REVIEW_TEXTS = ("accepted", "candidate", "needs_review", "provisional", "public_candidate", "restricted", "reviewed")
REVIEW_THAI = ("ทดลอง", "ต้องตรวจ", "รับรอง")
AREA_KEYS = ("definition", "fields", "grain", "level", "meaning", "scope")
AREA_PARTS = ("geographic_semantics", "geography", "geography_semantics")
SUBJECTS = ("dataset_key", "indicator_id", "indicator_key", "measure_id", "measure_key", "metric_id", "metric_key", "section_key", "source_id")
SOURCES, GEOMETRY = ("source_id", "source_ids"), ("coordinates", "geometries")
TEMPORAL = ("as_of", "observed_as_of")
AROUND = "struct<subject: string, sources: array<string>, sourced: int, shaped: boolean>"
HIDDEN, MORE = "[hidden]", "…"
LINK_WORDS = ("link", "href", "uri", "website")


def children(value: Column, stop: Callable[[Column], Column] | None) -> Column:
    """(name, pos, value) of an object's or a list's members; members of an object whose key ``stop`` names are left out."""
    entries = F.map_entries(as_object(value))
    if stop:
        entries = F.filter(entries, lambda e: ~F.coalesce(stop(e["key"]), F.lit(False)))
    named = F.transform(entries, lambda e, i: F.struct(e["key"].alias("name"), i.alias("pos"), e["value"].alias("value")))
    listed = F.transform(as_list(value), lambda v, i: F.struct(F.lit(None).cast("string").alias("name"), i.alias("pos"), v.alias("value")))
    return F.coalesce(named, listed)


def tree(documents: DataFrame, payload: str, keep: Sequence[str] = (), stop: Callable[[Column], Column] | None = None, depth: int = MAX_DEPTH, context: bool = True, scalars: bool = True) -> DataFrame:
    """A row for each value in each document: of (the kept columns, a struct), doc, node, parent, level, names, name, pos, kind, cut, value, around.

    doc numbers the rows of ``documents``; node is the way from the root by members' numbers, parent that of the value around it (null for a root).
    names are the keys on the way, null for members of lists. Members under a key that ``stop`` names are left out. Null payloads have no
    nodes. cut: a value at ``depth`` that has members, which are not there. Extra columns of ``documents`` are not looked at.

    around is what the objects around a value say, handed down from each to its members, so that nothing has to be joined to know it:
    subject (of the nearest that names one), sources (of the nearest that names any) and sourced (its level), shaped (whether the value just
    around is a geometry). meanings() and sourced_urls() need it; without ``context`` there is none. Without ``scalars`` there are rows for
    objects and lists alone.
    """
    text = F.col(payload) if isinstance(payload, str) else payload
    own = F.struct(*(F.col(c) for c in keep)) if keep else F.struct(F.lit(0).alias(NOTHING))
    parsed = F.when(~text.startswith("﻿"), F.try_parse_json(text))
    root = documents.where(text.isNotNull()).select(own.alias("of"), F.monotonically_increasing_id().alias("doc"), F.lit("").alias("node"), F.lit(None).cast("string").alias("parent"), F.expr("cast(array() AS array<string>)").alias("names"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("pos"), parsed.alias("value"))
    root = root.withColumn("around", F.lit(None).cast(AROUND)) if context else root
    handed = ["around"] if context else []
    levels = []
    for level in range(depth + 1):
        kind = F.coalesce(kind_of(F.col("value")), F.lit("invalid"))
        now = root.withColumns({"kind": kind, "level": F.lit(level)})
        now = now if scalars else now.where(F.col("kind").isin(*CONTAINERS))
        now = stored(now.withColumn("cut", F.col("kind").isin(*CONTAINERS) & F.lit(level == depth)), f"nodes-{level}", FILE_ROWS)
        levels.append(now)
        open_ = now.where(F.col("kind").isin(*CONTAINERS))
        if level == depth or not open_.limit(1).count():
            break
        open_ = handed_down(open_) if context else open_
        below = open_.select("of", "doc", F.col("node").alias("parent"), F.col("names").alias("_names"), *handed, F.explode(children(F.col("value"), stop)).alias("m"))
        root = below.select("of", "doc", *handed, F.concat("parent", F.lit("."), F.lpad(F.col("m.pos").cast("string"), 9, "0")).alias("node"), "parent", F.concat("_names", F.array("m.name")).alias("names"), "m.name", "m.pos", "m.value")
    columns = ["of", "doc", "node", "parent", "level", "names", "name", "pos", "kind", "cut", "value", *handed]
    return reduce(DataFrame.unionByName, [x.select(*columns) for x in levels])


def kept(rows: DataFrame) -> list[Column]:
    """The kept columns."""
    return [F.col("of").getField(n).alias(n) for n in rows.schema["of"].dataType.names if n != NOTHING]


def safe(name: Column) -> Column:
    """A key as paths show it: in snake case, or <map-key>."""
    return F.when(name.rlike(SAFE_KEY), snake_key(name)).otherwise("<map-key>")


def path_of(names: Column, segment: Callable[[Column], Column] = lambda n: n, root: str = "$") -> Column:
    """The keys as one path: a slash before each, [] for members of lists."""
    return F.concat(F.lit(root), F.array_join(F.transform(names, lambda n: F.when(n.isNull(), "[]").otherwise(F.concat(F.lit("/"), segment(n)))), ""))


def leaves(nodes: DataFrame) -> DataFrame:
    """(kept columns, path, value) of each scalar."""
    return nodes.where(~F.col("kind").isin(*CONTAINERS, "invalid")).select(*kept(nodes), path_of(F.col("names")).alias("path"), text_of(F.col("value")).alias("value"))


def shapes(nodes: DataFrame) -> DataFrame:
    """(kept columns, shape, problem) of each document: the hash of all its paths and kinds. A problem (not JSON, too deep) leaves no shape."""
    line = F.concat_ws(":", path_of(F.col("names")), F.col("kind"))
    per = nodes.groupBy("doc").agg(F.first("of").alias("of"), F.array_sort(F.collect_set(line)).alias("lines"), F.max("cut").alias("cut"), F.max(F.col("kind") == "invalid").alias("invalid"))
    problem = F.when(F.col("invalid"), "not JSON").when(F.col("cut"), "too deep")
    return per.select(*kept(per), F.when(problem.isNull(), F.sha2(F.array_join("lines", "\n"), 256)).alias("shape"), problem.alias("problem"))


def records(nodes: DataFrame) -> DataFrame:
    """(kept columns, path, record): the objects of the nearest lists, and objects on the way that have neither objects nor such lists below."""
    ways = F.filter("names", lambda n: n.isNull())
    is_object = lambda v: kind_of(v) == "object"
    holds = lambda v: is_object(v) | F.coalesce(F.exists(as_list(v), is_object), F.lit(False))
    member = (F.size(ways) == 1) & F.try_element_at("names", F.lit(-1)).isNull()
    alone = (F.size(ways) == 0) & ~F.exists(F.map_values(as_object(F.col("value"))), holds)
    path = F.array_join(F.concat(F.array(F.lit("root")), F.filter("names", lambda n: n.isNotNull())), ".")
    return nodes.where((F.col("kind") == "object") & (member | alone)).select(*kept(nodes), path.alias("path"), F.to_json("value").alias("record"))


def rebuilt(nodes: DataFrame, text: Callable[[Column], Column] = lambda t: t) -> DataFrame:
    """(kept columns, json): the documents put together again from their nodes, level by level, texts through ``text``."""
    string = quoted(text(F.col("value").try_cast("string")))
    scalar = F.when(F.col("kind") == "string", string).otherwise(F.to_json("value"))
    rows = nodes.where("kind <> 'invalid'").select("of", "doc", "node", "parent", "level", "name", "pos", "kind", scalar.alias("json"))
    deepest = rows.agg(F.max("level")).head()[0] or 0
    below = None
    for level in range(deepest, -1, -1):
        own = rows.where(F.col("level") == level)
        body = F.lit("")
        if below is not None:
            member = F.when(F.col("name").isNull(), F.col("json")).otherwise(F.concat(quoted(F.col("name")), F.lit(":"), F.col("json")))
            inner = below.groupBy("doc", F.col("parent").alias("node")).agg(F.array_sort(F.collect_list(F.struct("pos", member.alias("m")))).alias("ms"))
            own = own.join(inner, ["doc", "node"], "left")
            body = F.coalesce(F.array_join(F.col("ms.m"), ","), F.lit(""))
        json = F.when(F.col("kind") == "object", F.concat(F.lit("{"), body, F.lit("}"))).when(F.col("kind") == "array", F.concat(F.lit("["), body, F.lit("]"))).otherwise(F.col("json"))
        below = own.select("of", "doc", "parent", "name", "pos", json.alias("json"))
    return below.select(*kept(below), "json")


def handed_down(containers: DataFrame) -> DataFrame:
    """around becomes what the members have around them: what the value says itself, or else what is around it."""
    named = F.transform(F.map_entries(as_object(F.col("value"))), lambda e: F.struct(snake_key(e["key"]).alias("k"), e["value"].alias("v")))
    said = containers.withColumn("_said", F.filter(named, lambda s: s["k"].isin(*SUBJECTS, *SOURCES, *GEOMETRY)))
    own = said.withColumns({"_subject": own_subject(F.col("_said")), "_sources": own_sources(F.col("_said")), "_shaped": F.coalesce(F.exists("_said", lambda s: s["k"].isin(*GEOMETRY)), F.lit(False))})
    around, names = F.col("around"), F.col("_sources").isNotNull()
    nearest = {"subject": F.coalesce("_subject", around["subject"]), "sources": F.coalesce("_sources", around["sources"]), "sourced": F.when(names, F.col("level")).otherwise(around["sourced"]), "shaped": F.col("_shaped")}
    return own.withColumn("around", F.struct(*(c.alias(n) for n, c in nearest.items())))


class Key(NamedTuple):
    """What a rule of meaning may look at: a key in snake case, with the keys around it, whether a geometry holds it, and the text under it."""

    name: Column
    around: Column
    in_geometry: Column
    text: Column


def word(text: Column, words: Sequence[str]) -> Column:
    """Whether one of the words stands in a text in snake case."""
    return F.concat(F.lit("_"), text, F.lit("_")).rlike("_(" + "|".join(words) + ")_")


def ends(text: Column, endings: Sequence[str]) -> Column:
    return text.rlike("(" + "|".join(endings) + ")$")


#: Why a key, or the text under it, carries meaning rather than an observation.
MEANING_RULES: dict[str, Callable[[Key], Column]] = {
    "text under review": lambda k: word(snake_key(k.text), REVIEW_TEXTS) | k.text.rlike("|".join(REVIEW_THAI)),
    "kind of geometry": lambda k: k.in_geometry & (k.name == "type"),
    "part of an area's description": lambda k: k.name.isin(*AREA_KEYS) & F.exists(k.around, lambda n: n.isin(*AREA_PARTS)),
    "geographic level, meaning or scope": lambda k: k.name.rlike("^geograph(ic|y)_(.*_)?(level|meaning|scope)$"),
    "key under review": lambda k: word(k.name, REVIEW_KEYS) & ~ends(k.name, PLAIN_ENDS),
    "ending": lambda k: ends(k.name, MEANING_ENDS),
    "key": lambda k: k.name.isin(*MEANING),
}


def own_subject(said: Column) -> Column:
    """The subjects that an object's members (k in snake case, v) name, as JSON pairs in order of their keys; null without any."""
    named = F.transform(said, lambda e: F.struct(e["k"].alias("k"), F.when(kind_of(e["v"]) != "null", e["v"]).alias("v")))
    named = F.filter(named, lambda s: s["k"].isin(*SUBJECTS) & ~kind_of(s["v"]).isin(*CONTAINERS) & (F.to_json(s["v"]) != '""'))
    pairs = F.array_sort(F.transform(named, lambda s: F.struct(s["k"].alias("k"), F.to_json(s["v"]).alias("v"))))
    said = F.array_join(F.transform(pairs, lambda s: F.concat(F.lit("["), quoted(s["k"]), F.lit(","), s["v"], F.lit("]"))), ",")
    return F.when(F.size(named) > 0, F.concat(F.lit("["), said, F.lit("]")))


def meanings(nodes: DataFrame) -> DataFrame:
    """(kept columns, path, context, value, rule) of the keys that carry meaning, each once however many records of a document say the same.

    context: the subjects that the nearest object around names, as JSON; empty if none does. rule: why, by MEANING_RULES.
    """
    members = nodes.where("name IS NOT NULL")
    around = F.transform(F.filter(F.slice("names", F.lit(1), F.size("names") - 1), lambda n: n.isNotNull()), snake_key)
    text = F.when(F.col("kind") == "string", F.col("value").try_cast("string")).otherwise("")
    key = Key(F.col("_name"), F.col("_around"), F.col("around.shaped"), F.col("_text"))
    rule = reduce(lambda rest, r: F.when(r[1](key), r[0]).otherwise(rest), MEANING_RULES.items(), F.lit(None).cast("string"))
    said = members.withColumns({"_name": snake_key("name"), "_around": around, "_text": text}).withColumn("rule", rule).where("rule IS NOT NULL")
    columns = [path_of(F.col("names"), safe).alias("path"), F.coalesce("around.subject", F.lit("")).alias("context"), F.to_json("value").alias("value"), "rule"]
    return said.select("doc", "of", *columns).distinct().select(*kept(nodes), "path", "context", "value", "rule")


def meaning_hashes(nodes: DataFrame) -> DataFrame:
    """(doc, meaning): one hash of all that a document's keys mean; documents without any have that of nothing."""
    said = meanings(nodes.withColumn("of", F.struct("doc"))).select("doc", F.to_json(F.array("path", "context", "value")).alias("said"))
    every = nodes.where("parent IS NULL").select("doc", F.lit(None).cast("string").alias("said"))
    per = every.unionByName(said).groupBy("doc").agg(F.array_sort(F.collect_set("said")).alias("said"))
    return per.select("doc", F.sha2(F.array_join("said", "\n"), 256).alias("meaning"))


def own_sources(said: Column) -> Column:
    """The sources that an object's members (k in snake case, v) name (source_id, source_ids); null without any."""
    pick = lambda key: F.transform(F.filter(said, lambda e: e["k"] == key), lambda e: e["v"])
    texts = lambda values: F.filter(F.transform(values, lambda v: F.when(kind_of(v) == "string", v.try_cast("string"))), lambda t: F.coalesce(t != "", F.lit(False)))
    listed = F.flatten(F.transform(pick("source_ids"), lambda v: F.coalesce(as_list(v), F.expr("cast(array() AS array<variant>)"))))
    named = F.array_sort(F.array_distinct(F.concat(texts(pick("source_id")), texts(listed))))
    return F.when(F.size(named) > 0, named)


def sourced_urls(nodes: DataFrame, declared: Sequence[str] = ()) -> DataFrame:
    """(kept columns, path, sources, url) of each text under a key for addresses, with the sources of the nearest object around that names any.

    Keys for addresses are url, urls and those of LINK_WORDS, alone or at the end of a key. A key that is a declared source names it for
    what is below. Where nothing names a source, all declared ones apply.
    """
    every = F.array(*(F.lit(d) for d in sorted(declared))) if declared else F.expr("cast(array() AS array<string>)")
    nearest, ways = F.col("around.sources"), F.slice("names", F.lit(1), F.greatest(F.size("names") - 1, F.lit(0)))
    if declared:  # a key counts from the level of the value under it on, but less than what that value names itself
        level = F.array_max(F.transform(ways, lambda n, i: F.when(n.isin(*declared), i + 1)))
        by_key = F.array(F.try_element_at("names", level))
        nearest = F.when(level.isNull() | F.coalesce(F.col("around.sourced") >= level, F.lit(False)), nearest).otherwise(by_key)
    spoken = F.coalesce("name", F.try_element_at("names", F.lit(-2)))  # members of a list are under its key
    address = snake_key(spoken).rlike("(^|_)(url|" + "|".join(LINK_WORDS) + ")s?$")
    texts = nodes.where((F.col("kind") == "string") & F.coalesce(address, F.lit(False)))
    return texts.select(*kept(nodes), path_of(F.col("names")).alias("path"), F.coalesce(nearest, every).alias("sources"), F.col("value").try_cast("string").alias("url"))


def times(nodes: DataFrame) -> DataFrame:
    """(kept columns, path, value) of each scalar that says as of when a record holds: a time of fetching is none. Members of lists go by number."""
    steps = F.split("node", r"\.")
    numbered = F.transform("names", lambda n, i: F.when(n.isNull(), F.concat(F.lit("["), F.element_at(steps, i + 2).cast("int").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("/"), snake_key(n))))
    key = snake_key("name")
    said = nodes.where(key.isin(*TEMPORAL) | key.endswith("_as_of"))
    return said.select(*kept(nodes), F.concat(F.lit("$"), F.array_join(numbered, "")).alias("path"), text_of(F.col("value")).alias("value"))


def forbidden(nodes: DataFrame) -> DataFrame:
    """(kept columns, path, reason) of each key that may not be published and each text that holds contact data."""
    steps = F.split("node", r"\.")
    numbered = F.transform("names", lambda n, i: F.concat(F.lit("/"), F.coalesce(n, F.element_at(steps, i + 2).cast("int").cast("string"))))
    text = F.when(F.col("kind") == "string", F.col("value").try_cast("string"))
    reasons = F.filter(F.array(forbidden_key("name"), F.when(text.rlike(EMAIL), "email value"), F.when(text.rlike(PHONE_RECORDS), "phone value")), lambda r: r.isNotNull())
    return nodes.select(*kept(nodes), F.concat(F.lit("$"), F.array_join(numbered, "")).alias("path"), F.explode(reasons).alias("reason"))


def sanitised(documents: DataFrame, payload: str, keep: Sequence[str] = ()) -> DataFrame:
    """(kept columns, json): without forbidden keys at any depth, and with contacts in texts redacted."""
    return rebuilt(tree(documents, payload, keep, stop=lambda k: forbidden_key(k).isNotNull(), context=False), redact)


def without_keys(documents: DataFrame, payload: str, keep: Sequence[str] = (), keys: Sequence[str] = PRESENTATION) -> DataFrame:
    """(kept columns, json): without those keys at any depth."""
    return rebuilt(tree(documents, payload, keep, stop=lambda k: k.isin(*keys), context=False))


def previews(documents: DataFrame, payload: str, keep: Sequence[str] = (), depth: int = 6, keys: int = 40, items: int = 12, chars: int = 800, nodes: int = 320) -> DataFrame:
    """(kept columns, json): bounded copies for display. Values of forbidden keys are hidden, texts, objects and lists cut to the limits; an
    ellipsis stands for what is too deep or one value too many."""
    steps = F.split("node", r"\.")
    early = F.transform("names", lambda n, i: F.element_at(steps, i + 2).cast("int") < F.when(n.isNull(), items).otherwise(keys))
    shown = tree(documents, payload, keep, depth=depth + 1, context=False).where(F.forall(early, lambda e: e) & ~F.exists(F.slice("names", F.lit(1), F.greatest(F.size("names") - 1, F.lit(0))), lambda n: F.coalesce(forbidden_key(n).isNotNull(), F.lit(False))))
    numbered = shown.withColumn("_n", F.row_number().over(Window.partitionBy("doc").orderBy("node")))  # a document's nodes, of limited depth and width
    text = F.when(forbidden_key("name").isNotNull(), HIDDEN).when((F.col("level") > depth) | (F.col("_n") > nodes), MORE).when(F.col("kind") == "string", F.substring(F.col("value").try_cast("string"), 1, chars))
    return rebuilt(numbered.withColumns({"kind": F.when(text.isNotNull(), "string").otherwise(F.col("kind")), "value": F.when(text.isNotNull(), F.try_parse_json(quoted(text))).otherwise(F.col("value"))}))


def localised(names: Column | str, languages: Sequence[str] = ("TH", "EN", "CN")) -> Column:
    """Of a map from languages to names those of the given languages that are there."""
    return F.map_filter(names, lambda k, v: F.upper(k).isin(*languages) & F.coalesce(v != "", F.lit(False)))


def miscounted(nodes: DataFrame) -> DataFrame:
    """(kept columns, path, problem) of objects at any depth whose row_count is not the size of rows, or total_records that of items.

    Empty items beside resource_groups alone may be summed up in the groups' row_counts; beside other lists items are not
    held against the total.
    """
    members = as_object(F.col("value"))
    whole = lambda v: F.when(kind_of(v) == "integer", v.try_cast("long"))
    sizes = F.transform(as_list(members["resource_groups"]), lambda g: whole(F.try_element_at(as_object(g), F.lit("row_count"))))
    summed = F.when(F.size(sizes) > 0, F.aggregate(sizes, F.lit(0).cast("long"), lambda a, n: a + n))  # null if one is no whole number
    found = []
    for listed, total in (("rows", "row_count"), ("items", "total_records")):
        others = F.map_keys(F.map_filter(members, lambda k, v: (kind_of(v) == "array") & (k != listed)))  # noqa: B023
        held = F.lit(True) if listed == "rows" else (F.size(others) == 0) | (F.array_join(others, ",") == "resource_groups")
        size, n = F.size(as_list(members[listed])), whole(members[total])
        grouped = (size == 0) & F.coalesce(summed == n, F.lit(False)) & F.lit(listed == "items")
        problem = F.when(as_list(members[listed]).isNull() | n.isNull(), f"{listed} and {total} are not a list and a whole number").when(n < 0, f"{total} is negative").when(held & (size != n) & ~grouped, f"{total} is not the size of {listed}")
        found.append(F.when(F.map_contains_key(members, listed) & F.map_contains_key(members, total), problem))
    problems = F.filter(F.array(*found), lambda p: p.isNotNull())
    given = lambda k: F.try_variant_get(F.col("value"), F.lit(f"$.{k}"), "variant").isNotNull()
    declaring = (given("rows") & given("row_count")) | (given("items") & given("total_records"))  # looked up, before all members are taken apart
    return nodes.where("kind = 'object'").where(declaring).select(*kept(nodes), path_of(F.col("names"), lambda n: F.when(n.rlike(SAFE_KEY), n).otherwise("<map-key>")).alias("path"), F.explode(problems).alias("problem"))


def keyed_records(nodes: DataFrame) -> DataFrame:
    """(kept columns, key, record) of a list's objects or a map's objects; a map's key becomes the record's $key too."""
    top = nodes.where("level = 1 AND kind = 'object'")
    inside = F.to_json("value")
    with_key = F.concat(F.lit('{"$key":'), quoted(F.col("name")), F.when(inside != "{}", F.concat(F.lit(","), F.substring(inside, F.lit(2), F.length(inside)))).otherwise("}"))
    return top.select(*kept(nodes), F.col("name").alias("key"), F.when(F.col("name").isNull(), inside).otherwise(with_key).alias("record"))


def number(value: Column) -> Column:
    return F.when(kind_of(value).isin("integer", "number"), value.try_cast("double"))


def is_position(value: Column) -> Column:
    """At least two finite numbers, a longitude and a latitude first."""
    parts = F.transform(as_list(value), number)
    inside = (F.abs(F.try_element_at(parts, F.lit(1))) <= 180) & (F.abs(F.try_element_at(parts, F.lit(2))) <= 90)
    return F.coalesce((F.size(parts) >= 2) & F.forall(parts, lambda p: p.isNotNull() & ~F.isnan(p)) & inside, F.lit(False))


def is_line(value: Column, least: int) -> Column:
    return F.coalesce((F.size(as_list(value)) >= least) & F.forall(as_list(value), is_position), F.lit(False))


def is_ring(value: Column) -> Column:
    ends_ = [F.to_json(F.try_element_at(as_list(value), F.lit(i))) for i in (1, -1)]
    return is_line(value, 4) & F.coalesce(ends_[0] == ends_[1], F.lit(False))


def each(value: Column, check: Callable[[Column], Column]) -> Column:
    """A list with a member at least, all of which pass."""
    return F.coalesce((F.size(as_list(value)) > 0) & F.forall(as_list(value), check), F.lit(False))


GEOMETRIES: dict[str, Callable[[Column], Column]] = {
    "Point": is_position,
    "MultiPoint": lambda c: each(c, is_position),
    "LineString": lambda c: is_line(c, 2),
    "MultiLineString": lambda c: each(c, lambda x: is_line(x, 2)),
    "Polygon": lambda c: each(c, is_ring),
    "MultiPolygon": lambda c: each(c, lambda x: each(x, is_ring)),
}


def wrong_geometries(features: DataFrame, geometry: str, keep: Sequence[str]) -> DataFrame:
    """(kept columns, problem) of the features whose GeoJSON geometry, as text, is not valid: of any of the seven types, collections within collections too."""
    nodes = tree(features, geometry, keep, stop=lambda k: k != "geometries", context=False)
    own = nodes.where("kind <> 'array'")  # roots, and the members of geometries
    members = as_object(F.col("value"))
    name = F.when(kind_of(members["type"]) == "string", members["type"].try_cast("string"))
    judged = F.when(F.col("kind") == "invalid", "not JSON").when(F.col("kind") != "object", "no geometry").when(F.col("cut"), "too deep")
    judged = judged.when(name == "GeometryCollection", F.when(as_list(members["geometries"]).isNull(), "no geometries"))
    for kind, check in GEOMETRIES.items():
        judged = judged.when(name == kind, F.when(~check(members["coordinates"]), f"bad {kind}"))
    collection = F.size("names") == F.size(F.filter("names", lambda n: n.isNull())) * 2
    found = own.where(collection).select("doc", "of", "node", judged.otherwise("unknown type").alias("problem")).where("problem IS NOT NULL")
    first = found.groupBy("doc").agg(F.first("of").alias("of"), F.min_by("problem", "node").alias("problem"))
    missing = features.where(F.col(geometry).isNull()).select(*keep, F.lit("no geometry").alias("problem"))
    return first.select(*kept(first), "problem").unionByName(missing)
