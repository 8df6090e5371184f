"""Results as JSON documents and files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from revtally.operators import buckets, people
from revtally.operators.history import History
from revtally.operators.lines import METRICS

_LANG = {
    "additions": "additions",
    "deletions": "deletions",
    "files": "files_changed",
    "net_modifications": "net_modifications",
    "net_additions": "net_additions",
}
_PERSON = (
    "commits",
    "co_authored_commits",
    "additions",
    "co_authored_additions",
    "deletions",
    "co_authored_deletions",
    "net_modifications",
    "co_authored_net_modifications",
    "net_additions",
    "co_authored_net_additions",
)


def _lang_struct(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(name) for c, name in _LANG.items()])


def _map_of(entry: Column, within: WindowSpec | None = None) -> Column:
    """Map from ``(key, value)`` entries; the key order of a JSON object means nothing."""
    entries = F.collect_list(entry)
    return F.map_from_entries(entries.over(within) if within else entries)


def _as_map(key: str, value: Column) -> Column:
    return _map_of(F.struct(F.col(key).alias("k"), value.alias("v")))


def _language_maps(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(_as_map("language", _lang_struct()).alias("by_language"))


_LANG_ARRAY = "array<struct<" + ",".join(f"{n}:bigint" for n in _LANG.values()) + ">>"


def _folded(keys: Sequence[str], *frames: DataFrame) -> DataFrame:
    """Frames that share ``keys`` and nothing else, one row per key: stacked and folded, not joined.

    Each column comes from one frame only, so the first value there is is the value.
    """
    stacked = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
    values = [c for c in stacked.columns if c not in keys]
    return stacked.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in values])


def _counters(*names: str) -> list[Column]:
    return [F.sum(c).alias(c) for c in names]


def to_stats_json(h: History, key: Column, few_labels: bool = False) -> DataFrame:
    """``(section, label, kind, person, json)``: of every bucket, and of all of them, one ``head``
    with totals and languages and one ``person`` row for each person. The shape is the same for
    any number of people.

    Both tables are scanned once. Commits meet their lines by block, and people's rows are dealt out
    by person; after that nothing is shuffled. ``few_labels`` says that labels don't grow with the
    history, as periods; see :func:`people.bucket_activity`.
    """
    counters = [c for m in ("commits", *METRICS) for c in (m, f"co_authored_{m}")]
    by_language = people.bucket_activity(h, key, few_labels)
    # a commit without lines has no language
    has = F.col("language").isNotNull()
    co = has & (F.col("co_authored_files") > 0)
    # one sort, by a number that tells nearly all documents apart; an aggregate would sort twice
    keys = ["head", "all_labels", "everybody", "label", "person"]
    document = Window.partitionBy(F.xxhash64(*keys), *keys)
    folded = by_language.select(
        *keys,
        F.col("language").eqNullSafe(F.min("language").over(document)).alias("one"),
        *[c.over(document).alias(name) for name, c in zip(counters, map(F.sum, counters))],
        _map_of(F.when(has, F.struct(F.col("language").alias("k"), _lang_struct().alias("v"))), document).alias("languages"),
        _map_of(F.when(co, F.struct(F.col("language").alias("k"), _lang_struct("co_authored_").alias("v"))), document).alias("co_authored_languages"),
    ).filter("one")
    label = F.when(F.col("all_labels"), F.lit(buckets.TOTAL)).otherwise(F.col("label")).alias("period_label")
    own = {m: F.col(m) - F.col(f"co_authored_{m}") for m in METRICS if m != "files"}
    totals = [c.alias(f"total_{m}") for m, c in own.items()]
    commits = F.col("commits") - F.col("co_authored_commits")
    head = F.struct(label, F.col("languages").alias("by_language"), commits.alias("total_commits"), *totals)
    parts = {"commits": commits, **own}
    person = F.struct(
        label,
        F.col("person").alias("author"),
        *[parts.get(c, F.col(c)).alias(c) for c in _PERSON],
        "languages",
        "co_authored_languages",
    )
    return folded.select(
        F.when(F.col("all_labels"), F.lit("totals")).otherwise(F.lit("periods")).alias("section"),
        label.alias("label"),
        F.when(F.col("everybody"), F.lit("head")).otherwise(F.lit("person")).alias("kind"),
        "person",
        F.when(F.col("everybody"), F.to_json(head)).otherwise(F.to_json(person)).alias("json"),
    )


def to_scan_json(repos: DataFrame) -> DataFrame:
    """``(kind, path, json)``: a ``head`` with the number of repositories, a row for each of them."""
    head = repos.agg(F.to_json(F.struct(F.count(F.lit(1)).alias("count"))).alias("json"))
    head = head.select(F.lit("head").alias("kind"), F.lit(None).cast("string").alias("path"), "json")
    return head.union(repos.select(F.lit("repository"), "path", F.to_json(F.struct("path"))))


def to_fetch_json(
    metadata: DataFrame,
    user: DataFrame,
    bucket_totals: DataFrame,
    bucket_languages: DataFrame,
    summary: DataFrame,
) -> DataFrame:
    """``(section, label, json)`` rows of a fetch document: metadata, user, summary, totals, periods."""

    def one(section: str, frame: DataFrame) -> DataFrame:
        return frame.select(
            F.lit(section).alias("section"),
            F.lit(None).cast("string").alias("label"),
            F.to_json(F.struct("*")).alias("json"),
        )

    counters = ("commits", "additions", "deletions", "net_modifications", "net_additions")
    maps = _language_maps(bucket_languages, ["label"])
    periods = bucket_totals.join(maps, "label", "left").select(
        F.lit("periods").alias("section"),
        "label",
        F.to_json(
            F.struct(
                F.col("label").alias("period_label"),
                "by_language",
                *[F.col(c).alias(f"total_{c}") for c in counters],
            )
        ).alias("json"),
    )
    langs = bucket_languages.groupBy("language").agg(*[F.sum(c).alias(c) for c in METRICS])
    grand = bucket_totals.agg(
        *[F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(f"total_{c}") for c in counters]
    )
    folded = _folded([], grand, _language_maps(langs, []))
    return (
        one("metadata", metadata)
        .unionByName(one("user", user))
        .unionByName(one("summary", summary))
        .unionByName(one("totals", folded))
        .unionByName(periods)
    )


def fetch_document(sections: DataFrame) -> DataFrame:
    """The sections as one JSON document in one row; for few periods. :func:`write_fetch_document`
    writes any number of them."""
    def part(name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("section") == name, F.col("json"))), F.lit("null"))

    periods = F.array_sort(
        F.collect_list(F.when(F.col("section") == "periods", F.struct("label", "json")))
    )
    listed = F.array_join(F.transform(periods, lambda p: p["json"]), ",")
    fields = [F.concat(F.lit(f'"{n}":'), part(n)) for n in ("metadata", "user", "totals", "summary")]
    whole = F.concat(F.lit("{"), F.concat_ws(",", *fields, F.concat(F.lit('"periods":['), listed, F.lit("]"))), F.lit("}"))
    return sections.agg(whole.alias("value"))


def document_lines(sections: DataFrame) -> DataFrame:
    """``(place, label, value)``: the lines of one JSON document in the order of place and label.

    The first line opens the document and holds everything but the list of periods (or
    repositories), each of which is a line, and the last line closes it.
    """
    def part(name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("section") == name, F.col("json"))), F.lit("null"))

    listed = sections.filter("section = 'periods'")
    first = listed.agg(F.min("label")).scalar()
    fields = [F.concat(F.lit(f'"{n}":'), part(n)) for n in ("metadata", "user", "totals", "summary")]
    head = sections.filter("section <> 'periods'").agg(F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit(',"periods":[')).alias("value"))
    none = F.lit(None).cast("string").alias("label")
    comma = F.when(F.col("label").eqNullSafe(first), F.lit("")).otherwise(F.lit(","))
    return (
        head.select(F.lit(0).alias("place"), none, "value")
        .union(listed.select(F.lit(1), "label", F.concat(comma, "json")))
        .union(sections.sparkSession.range(1).select(F.lit(2), none, F.lit("]}")))
    )


def write_fetch_document(sections: DataFrame, path: str) -> None:
    """Write one JSON document with many tasks: ranges of its lines become part files, which hold
    the document one after another. :func:`stats_json.read_document_parts` reads them."""
    order = ["place", "label"]
    document_lines(sections).repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(path)


def to_tree_json(nodes: DataFrame, languages: DataFrame) -> DataFrame:
    """One JSON line per tree node with its path; sorting by path gives the nesting."""
    per_node = languages.groupBy("depth", "path").agg(_as_map("language", _lang_struct()).alias("by_language"))
    rows = nodes.join(per_node, ["depth", "path"], "left")
    body = F.to_json(
        F.struct(
            "label",
            "depth",
            "path",
            "by_language",
            F.col("commits").alias("total_commits"),
            *[F.col(m).alias(f"total_{m}") for m in METRICS if m != "files"],
        )
    )
    return rows.select("depth", "path", body.alias("json"))


def tree_document(h: History, levels: Sequence[str], period: str = "month") -> DataFrame:
    """As :func:`to_tree_json`, from one scan of commits and of lines and one join of both."""
    levels = buckets.tree_levels(levels)
    sets = [[*levels[:n], "language"] for n in range(len(levels), -1, -1)]
    leaves = buckets.leaves(h, buckets.level_keys(*levels, period=period))
    rolled = buckets.with_path(buckets.rolled_up(leaves, levels, sets), levels, ("language", "commits", *METRICS))
    entry = F.when(F.col("language").isNotNull(), F.struct(F.col("language").alias("k"), _lang_struct().alias("v")))
    nodes = rolled.groupBy("depth", "path", "label").agg(*_counters("commits", *METRICS), _map_of(entry).alias("by_language"))
    nodes = nodes.filter((F.col("commits") > 0) | (F.col("depth") == 0))
    totals = [F.col(m).alias(f"total_{m}") for m in ("commits", *METRICS) if m != "files"]
    return nodes.select("depth", "path", F.to_json(F.struct("label", "depth", "path", "by_language", *totals)).alias("json"))


def write_report(df: DataFrame, path: str, fmt: str = "json", mode: str = "error") -> None:
    """Write a whole result to ``path``."""
    df.write.mode(mode).format(fmt).save(path)
