"""People in a history: authored and co-authored work, languages, merged identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revtally.functions.identity import me_noreply, noreply_login
from revtally.functions.text import split_person
from revtally.operators.buckets import both_grains, commits_by_block, commits_with_lines, languages_of_commits
from revtally.operators.history import History
from revtally.operators.lines import METRICS, sums
from revtally.session import small_parts

DEDUP_MODES = ("none", "name", "remote")
_LINES = METRICS[:4]


def roles() -> Column:
    """Everybody of a commit: its author, then each co-author as often as listed."""
    author = F.struct(
        F.col("author.name").alias("name"), F.col("author.email").alias("email"), F.lit(False).alias("co")
    )
    helpers = F.transform(
        F.col("co_authors"),
        lambda p: F.struct(p["name"].alias("name"), p["email"].alias("email"), F.lit(True).alias("co")),
    )
    return F.concat(F.array(author), F.coalesce(helpers, F.array().cast(_ROLE)))


_ROLE = "array<struct<name:string,email:string,co:boolean>>"


def _by_role(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.withColumn("who", F.explode(roles())).select(
        *keep,
        F.col("who.name").alias("person"),
        F.col("who.email").alias("email"),
        F.col("who.co").alias("co"),
        *[c for c in METRICS if c in rows.columns],
    )


def _split(metric: str) -> list[Column]:
    zero = F.lit(0).cast("bigint")
    return [
        F.coalesce(F.sum(F.when(~F.col("co"), F.col(metric))), zero).alias(metric),
        F.coalesce(F.sum(F.when(F.col("co"), F.col(metric))), zero).alias(f"co_authored_{metric}"),
    ]


def bucket_people(h: History, keys: dict[str, Column]) -> DataFrame:
    """People of every bucket, keyed by name. Being author and co-author counts as both."""
    rows = _by_role(commits_with_lines(h, keys, "author", "co_authors"), *keys)
    return rows.groupBy(*keys, "person").agg(
        F.count_if(~F.col("co")).alias("commits"),
        F.count_if(F.col("co")).alias("co_authored_commits"),
        *[c for m in _LINES for c in _split(m)],
    )


def bucket_activity(h: History, key: Column, few_labels: bool = False) -> DataFrame:
    """Counters by ``(everybody, person, all_labels, label, language)``: of the people of every bucket
    and of all buckets, all roles together and the co-authored part, and of ``everybody``, where each
    commit counts once. Commits stand on any of the rows of a group; see :func:`both_grains`.

    Rows are added up by block, then dealt out by person and label, so that languages are folded
    without another shuffle; the hottest person arrives as a row per block and language. With
    ``few_labels``, as periods are, people are dealt out with all their labels, in half the rows, and
    a person is in one task with a row per block, label and language at most.
    """
    small_parts(h.commits.sparkSession)  # the rows of a person meet in sorts and hash maps of one task
    no, yes, none = F.lit(False), F.lit(True), F.lit(None).cast("string")

    def entry(everybody: Column, person: Column, co: Column, all_labels: Column, label: Column) -> Column:
        return F.struct(everybody.alias("everybody"), person.alias("person"), co.alias("co"), all_labels.alias("all_labels"), label.alias("label"))

    role = F.transform(roles(), lambda r: F.struct(r["name"].alias("person"), r["co"].alias("co")))
    commits = commits_by_block(h, F.struct(key.cast("string").alias("label"), role.alias("roles")))
    label = F.col("commit.label")
    entries = [F.array(entry(yes, none, no, no, label), entry(yes, none, no, yes, none)), F.transform("commit.roles", lambda r: entry(no, r["person"], r["co"], no, label))]
    if not few_labels:
        entries.append(F.transform("commit.roles", lambda r: entry(no, r["person"], r["co"], yes, none)))
    both = ("commits", *METRICS)
    keys = ["everybody", "person", "all_labels", "label", "language"]
    rows = commits.select("block", "lines", F.explode(F.concat(*entries)).alias("who"))
    rows = rows.select("block", "who.*", F.posexplode_outer("lines").alias("place", "line"))
    rows = rows.select("*", (F.coalesce("place", F.lit(0)) == 0).cast("bigint").alias("commits"), "line.*")
    zero = F.lit(0).cast("bigint")
    co = [F.coalesce(F.sum(F.when(F.col("co"), F.col(m))), zero).alias(f"co_authored_{m}") for m in both]
    rows = rows.groupBy("block", *keys).agg(*sums(*both), *co).drop("block")
    rows = rows.withColumn("head", F.when(F.col("everybody") | F.lit(not few_labels), F.col("label"))).repartition("everybody", "person", "head")
    counters = [c for m in both for c in (m, f"co_authored_{m}")]
    if few_labels:
        at = F.array(F.struct("label", "all_labels"), F.struct(none.alias("label"), yes.alias("all_labels")))
        at = F.explode(F.when(F.col("everybody"), F.slice(at, 1, 1)).otherwise(at)).alias("at")
        rows = rows.select("everybody", "person", "head", "language", *counters, at).select("*", "at.*")
    return rows.groupBy("head", *keys).agg(*sums(*counters))


def bucket_person_languages(h: History, keys: dict[str, Column]) -> DataFrame:
    """People of every bucket by language: all roles together, and the co-authored part alone."""
    rows = _by_role(languages_of_commits(h, keys, "author", "co_authors"), *keys, "language")
    return _person_languages(rows, [*keys, "person", "language"])


def _person_languages(rows: DataFrame, keys: list[str]) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    part = [
        F.coalesce(F.sum(F.when(F.col("co"), F.col(m))), zero).alias(f"co_authored_{m}") for m in METRICS
    ]
    return rows.groupBy(*keys).agg(*sums(*METRICS), *part)


# ---- identities ---------------------------------------------------------------------


def distinct_people(commits: DataFrame) -> DataFrame:
    """Each (name, e-mail) pair once, authors and co-authors."""
    who = commits.select(F.explode(roles()).alias("who"))
    return who.select(F.col("who.name").alias("name"), F.col("who.email").alias("email")).distinct()


def distinct_emails(commits: DataFrame) -> DataFrame:
    return distinct_people(commits).select("email").distinct()


def one_login(identity: DataFrame) -> DataFrame:
    """Identity table with each e-mail once, so that a join on it never multiplies rows."""
    return identity.groupBy("email").agg(F.max("login").alias("login"))


def identity_join(people: DataFrame, identity: DataFrame) -> DataFrame:
    """People with their login: by e-mail, else from a no-reply address, else NULL.

    ``people`` holds every e-mail once per name, so no e-mail is hot; the identity table
    grows with the data and Spark chooses how to join it from its size.
    """
    known = one_login(identity).withColumnRenamed("login", "known_login")
    return people.join(known, "email", "left").withColumn(
        "login", F.coalesce(F.col("known_login"), noreply_login(F.col("email")))
    )


def _emails_of(identity: DataFrame, login: str) -> DataFrame:
    return identity.filter(F.lower("login") == login.lower()).select("email").distinct()


def mark_login(commits: DataFrame, identity: DataFrame, login: str, into: str = "is_login") -> DataFrame:
    """Add ``into``: whether the author or a co-author is ``login``.

    The identity table decides by exact e-mail; a no-reply address carrying the login counts
    as well. The flag is a column and never NULL, so it combines with the other identity
    predicates and can be negated. How the addresses are joined is Spark's choice by their size.
    """
    mine = _emails_of(identity, login)
    found = (
        commits.select("commit_id", F.explode(roles()).alias("who"))
        .select("commit_id", F.col("who.email").alias("email"))
        .join(mine, "email", "left_semi")
        .select("commit_id")
        .distinct()
        .withColumn("listed", F.lit(True))
    )
    joined = commits.join(found, "commit_id", "left")
    return joined.withColumn(into, F.coalesce(F.col("listed"), F.lit(False)) | me_noreply(login)).drop("listed")


# ---- merged people ------------------------------------------------------------------


def person_activity(h: History) -> DataFrame:
    """Counters by (person, e-mail, language), from one scan of commits and of lines.

    Commits of a person stand on any of their rows, so they are sums over languages. A person
    without lines has a row without a language.
    """
    rows = _by_role(both_grains(h, {}, "author", "co_authors"), "language", "commits")
    return rows.groupBy("person", "email", "language").agg(
        *_split("commits"),
        *_split("additions"),
        *_split("deletions"),
        F.coalesce(F.sum("files"), F.lit(0).cast("bigint")).alias("files"),
        F.coalesce(F.sum(F.when(~F.col("co"), F.col("files"))), F.lit(0).cast("bigint")).alias("authored_files"),
    )


_COUNTERS = (
    "commits",
    "co_authored_commits",
    "additions",
    "co_authored_additions",
    "deletions",
    "co_authored_deletions",
    "files",
)


def merged_activity(h: History, dedup: str = "name", identity: DataFrame | None = None) -> DataFrame:
    """:func:`person_activity` with the ``merge_key`` that says whose rows belong together.

    ``none`` keeps the recorded name, ``name`` cuts an address off it, ``remote`` takes the
    login known for the e-mail and falls back to the name.
    """
    small_parts(h.commits.sparkSession)  # lines, people and e-mails meet in sorts and hash maps of one task
    return _with_merge_key(person_activity(h), dedup, identity)


def _with_merge_key(rows: DataFrame, dedup: str, identity: DataFrame | None) -> DataFrame:
    rows = rows.withColumn("name", split_person(F.col("person"))["name"])
    if dedup == "none":
        return rows.withColumn("merge_key", F.col("person"))
    if dedup == "name":
        return rows.withColumn("merge_key", F.col("name"))
    if dedup == "remote":
        if identity is None:
            return rows.withColumn("merge_key", F.col("name"))
        return rows.join(one_login(identity), "email", "left").withColumn(
            "merge_key", F.coalesce("login", "name")
        )
    raise ValueError(f"dedup must be one of {DEDUP_MODES}, got {dedup!r}")


def merged_emails(merged: DataFrame) -> DataFrame:
    """(merge_key, email), each pair once: the flat form of the e-mail lists."""
    return merged.filter(F.col("email") != "").select("merge_key", "email").distinct()


def people_emails(h: History, dedup: str = "name", identity: DataFrame | None = None) -> DataFrame:
    """:func:`merged_emails` of a history. Addresses are those of its commits, so no line is read."""
    people = distinct_people(h.commits).filter(F.col("email") != "").withColumnRenamed("name", "person")
    return merged_emails(_with_merge_key(people, dedup, identity))


def merged_languages(merged: DataFrame) -> DataFrame:
    """Languages of merged people, all roles together."""
    return (
        merged.filter(F.col("language").isNotNull())
        .groupBy("merge_key", "language")
        .agg(
            F.sum(F.col("additions") + F.col("co_authored_additions")).alias("additions"),
            F.sum(F.col("deletions") + F.col("co_authored_deletions")).alias("deletions"),
            F.sum("files").alias("files"),
        )
    )


def language_rows(merged: DataFrame) -> DataFrame:
    """Counters of merged people by language; commits as in :func:`person_activity`."""
    return merged.groupBy("merge_key", "language").agg(F.min("name").alias("name"), *sums(*_COUNTERS))


def people_with_totals(merged: DataFrame, emails: str = "none") -> DataFrame:
    """Merged people by language, in all, and everybody together, in one aggregate.

    ``kind`` says which: ``language``, ``author`` or ``total``. The total counts what was
    authored, so every commit once, and is there even if nobody is. ``emails`` adds the addresses
    of each row as a ``list``, or as ``rows`` of their own kind, ``email``, however many there are.
    """
    listed = [F.collect_set(F.nullif(F.col("email"), F.lit(""))).alias("emails")] if emails == "list" else []
    sets = [["merge_key", "language"], ["merge_key"], [], *([["merge_key", "email"]] if emails == "rows" else [])]
    seeded = merged.unionByName(merged.sparkSession.range(1).select(F.lit(None).cast("string").alias("language")), allowMissingColumns=True)
    by = ["merge_key", "language", *(["email"] if emails == "rows" else [])]
    kind = F.when(F.grouping("language") == 0, F.lit("language"))
    kind = kind.when(F.grouping("email") == 0, F.lit("email")) if emails == "rows" else kind
    rows = seeded.groupingSets(sets, *by).agg(
        kind.when(F.grouping("merge_key") == 0, F.lit("author")).otherwise(F.lit("total")).alias("kind"),
        F.min("name").alias("name"),
        *sums(*_COUNTERS, "authored_files"),
        *listed,
    )
    somebody = F.col("commits") + F.col("co_authored_commits") > 0
    real = F.when(F.col("kind") == "language", F.col("language").isNotNull()).when(F.col("kind") == "author", somebody)
    real = real.when(F.col("kind") == "email", F.coalesce(F.col("email") != "", F.lit(False))) if emails == "rows" else real
    return rows.filter(F.coalesce(real, F.lit(True)))


def best_language() -> Column:
    """Aggregate whose ``language`` field has most lines added in any role; ties go by name."""
    lines = F.col("additions") + F.col("co_authored_additions")
    return F.min(F.when(F.col("language").isNotNull(), F.struct((-lines).alias("a"), F.col("language"))))


def merged_lists(lists: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(lists)))


def author_totals(merged: DataFrame) -> DataFrame:
    """One row per merged person with counters, top language and number of languages."""
    return language_rows(merged).groupBy("merge_key").agg(
        F.min("name").alias("name"),
        *sums(*_COUNTERS),
        F.coalesce(best_language()["language"], F.lit("")).alias("top_language"),
        F.count("language").alias("n_languages"),
    )
