"""Commit logs exported as text, one file per repository.

The export command writes one record per commit::

    git -c core.quotePath=false log --reverse --diff-merges=first-parent --no-renames \\
        --ignore-submodules --numstat --date-order \\
        --format='%x1e%H%x1f%an%x1f%ae%x1f%cn%x1f%ce%x1f%ct%x1f%B%x1d'

A record starts with \\x1e, its fields are parted by \\x1f, and \\x1d ends the message. What
follows is either ``--numstat`` lines or, with ``-p`` in its place, the patch. Records are
split by the text source itself, so one large log is read by many tasks.

A record is one row there. :func:`read_large_logs` reads logs with a record that doesn't fit into
a row line by line instead: a patch may then be cut over any number of tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revtally.functions.text import co_authors, subject
from revtally.operators.filters import with_defaults
from revtally.operators.history import History
from revtally.operators.languages import with_language
from revtally.session import materialize

_FIELDS = ("oid", "author_name", "author_email", "committer_name", "committer_email", "seconds", "message")
_RAW = "path STRING, value STRING"


def _decoded(path: Column) -> Column:
    """File paths come URL-encoded; ``+`` stands for itself there."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def repo_name(path: Column) -> Column:
    """Base name of the log file without its extension. Equal base names merge."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def read_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Raw records ``(path, value)`` of one or many logs."""
    paths = [path] if isinstance(path, str) else list(path)
    text = spark.read.option("lineSep", "\x1e").text(paths)
    return text.select(_decoded(F.col("_metadata.file_path")).alias("path"), "value").filter(~_blank())


def _blank() -> Column:
    """Whether a row is white space; what its beginning shows already needs no search of all of it."""
    filled = F.left("value", F.lit(16)).rlike(r"[^\s\u0085\u2028\u2029]")
    return ~filled & F.col("value").rlike(r"^\s*$")


def _after(text: Column, before: Column) -> Column:
    """What follows ``before``, with which ``text`` begins, and one more character."""
    return F.substr(text, F.char_length(before) + F.lit(2))


def _parsed(records: DataFrame) -> DataFrame:
    # The filter on flaws repeats these expressions, so they are plain searches for a separator.
    # Where a record has too few fields the message is NULL and the other fields mean nothing.
    head = F.substring_index("value", "\x1d", 1)
    upto = [F.substring_index(head, "\x1f", i) for i in range(1, len(_FIELDS))]
    named = {name: F.substring_index(upto[i], "\x1f", -1) for i, name in enumerate(_FIELDS[:-1])}
    named["message"] = F.when(upto[-1] != head, _after(head, upto[-1]))
    body = F.when(F.contains("value", F.lit("\x1d")), _after(F.col("value"), head))
    return (
        records.withColumns({**named, "body": body})
        .withColumn("epoch", F.expr("try_cast(seconds AS BIGINT)"))
        .withColumn("commit_id", F.md5(F.concat_ws("\x1f", "path", "oid").cast("binary")))
    )


# Most records without a flaw have this shape, which one match shows; the others are looked at part by part.
_USUAL = r"^[0-9a-f]{40}(?:[0-9a-f]{24})?\x1f(?:[^\x1f\x1d]*+\x1f){4}[0-9]{1,18}\x1f[^\x1d]*+\x1d"


def _flaw() -> Column:
    return (
        F.when(F.col("message").isNull() | F.col("body").isNull(), F.lit("incomplete record"))
        .when(~F.col("oid").rlike("^[0-9a-f]{40}([0-9a-f]{24})?$"), F.lit("bad object id"))
        .when(F.col("epoch").isNull(), F.lit("bad commit time"))
    )


def unquoted(path: Column) -> Column:
    """A path as it is on disk; one with special characters is exported in quotes with escapes."""
    safe = F.replace(F.replace(path, F.lit("%"), F.lit("%25")), F.lit("+"), F.lit("%2B"))
    inner = F.substring(safe, F.lit(2), F.char_length(safe) - 2)

    def decoded(text: Column) -> Column:
        for escape, code in _ESCAPES.items():
            text = F.replace(text, F.lit("\\" + escape), F.lit(code))
        pieces = F.split(text, r"\\(?=[0-7]{3})")
        numbers = F.transform(
            F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))),
            lambda x: F.concat(F.lit("%"), F.lpad(F.conv(F.substring(x, 1, 3), 8, 16), 2, "0"), F.substring(x, F.lit(4), F.char_length(x))),
        )
        return F.concat(pieces[0], F.array_join(numbers, ""))

    # pairs of backslashes first, so that what follows one is not taken for an escape
    plain = F.try_url_decode(F.array_join(F.transform(F.split(inner, r"\\\\"), decoded), "%5C"))
    quoted = F.startswith(path, F.lit('"')) & path.rlike('(?s)^".*"$')
    return F.when(quoted & (F.char_length(path) > 1), F.coalesce(plain, path)).otherwise(path)


# Letters of escapes in quoted paths, as URL codes.
_ESCAPES = {'"': "%22", "a": "%07", "b": "%08", "t": "%09", "n": "%0A", "v": "%0B", "f": "%0C", "r": "%0D"}


# What file changes repeat of their commit, so that windows can prune them at the scan.
_COMMIT_KEYS = ("commit_id", "repo", "ts")


def _well_formed(records: DataFrame) -> DataFrame:
    return (
        _parsed(records)
        .filter(F.col("value").rlike(_USUAL) | _flaw().isNull())
        .withColumns({"repo": repo_name(F.col("path")), "ts": F.timestamp_seconds("epoch")})
    )


def commits_of(records: DataFrame) -> DataFrame:
    """Commits of well-formed records. ``ts`` is the committer time in whole seconds."""
    parsed = _well_formed(records)
    message = F.regexp_replace("message", r"\n+$", "\n")

    def person(who: str) -> Column:
        return F.struct(
            F.nullif(F.col(f"{who}_name"), F.lit("")).alias("name"), F.col(f"{who}_email").alias("email")
        )

    rows = parsed.select(
        "commit_id",
        "repo",
        "oid",
        person("author").alias("author"),
        person("committer").alias("committer"),
        "ts",
        message.alias("message"),
    )
    return (
        with_defaults(rows)
        .withColumns({"co_authors": co_authors(F.col("message")), "message_subject": subject(F.col("message"))})
        .select(
            "commit_id", "repo", "oid", "author", "committer", "co_authors", "ts", "message", "message_subject"
        )
    )


def read_commit_log(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Commits of exported logs; an empty log gives no rows."""
    return commits_of(read_records(spark, path))


def read_numstat(records: DataFrame) -> DataFrame:
    """Per-file line counts of records with ``--numstat`` lines; binary files (``-``) have none."""
    shape = r"(?s)^(\d+)\t(\d+)\t(.+)\z"
    lines = _well_formed(records).select(*_COMMIT_KEYS, F.explode(F.split("body", "\n")).alias("line"))
    both = F.substring_index("line", "\t", 2)
    counted = lines.filter(F.col("line").rlike(shape)).withColumn("path", _after(F.col("line"), both)).select(
        *_COMMIT_KEYS,
        unquoted(F.col("path")).alias("path"),
        F.substring_index("line", "\t", 1).cast("bigint").alias("additions"),
        F.substring_index(both, "\t", -1).cast("bigint").alias("deletions"),
    )
    return with_language(counted).select(*_COMMIT_KEYS, "path", "language", "additions", "deletions")


def count_patch_lines(records: DataFrame) -> DataFrame:
    """Per-file line counts of records with patch text.

    A patch is cut at its file headers and each part is counted on its own row: lines that
    begin with ``+`` or ``-`` after the first hunk header. Nothing is shuffled or ordered.
    """
    # with a line feed before it, every header is found by a search for plain text
    parts = (
        _well_formed(records)
        .select(*_COMMIT_KEYS, F.explode(F.split(F.concat(F.lit("\n"), "body"), r"\ndiff --(?:git |cc |combined )")).alias("part"))
        .filter(F.col("part").rlike(r"(?dm)^(index |--- |new file|deleted file|old mode|similarity )"))
        .withColumn("head", F.substring_index("part", "\n@@", 1))
    )
    head = F.col("head")
    binary = F.lit(False)
    for mark in ("Binary files ", "GIT binary patch"):
        binary = binary | F.startswith(head, F.lit(mark)) | F.contains(head, F.lit("\n" + mark))

    def side(mark: str) -> Column:
        return F.regexp_extract(head, rf"(?d)\n{mark} (.*?)\t?(?:\n|\z)", 1)

    def bare(name: Column | str, prefix: str) -> Column:
        path = unquoted(F.col(name) if isinstance(name, str) else name)
        return F.when(F.startswith(path, F.lit(f"{prefix}/")), F.substr(path, F.lit(3))).otherwise(path)

    def lines(sign: str) -> Column:
        found = F.octet_length("hunks") - F.octet_length(F.replace("hunks", F.lit("\n" + sign), F.lit("")))
        return F.floor(found / 2).cast("bigint")

    # a column for each step: what is used more than once is worked out once
    stepped = (
        parts.filter(~binary)
        .withColumns({"hunks": _after(F.col("part"), head), "new": side(r"\+\+\+"), "old": side("---")})
        .withColumns({"new": bare("new", "b"), "old": bare("old", "a")})
    )
    new, old = F.col("new"), F.col("old")
    named = bare(F.regexp_extract(head, r'(?d)^(?:"a/.*" |a/.* )("b/.*"|b/.*)', 1), "b")
    path = F.when((new != "") & (new != "/dev/null"), new).when((old != "") & (old != "/dev/null"), old)
    counted = stepped.select(
        *_COMMIT_KEYS, F.coalesce(path, named).alias("path"), lines("+").alias("additions"), lines("-").alias("deletions")
    )
    return with_language(counted).select(*_COMMIT_KEYS, "path", "language", "additions", "deletions")


def load_errors(records: DataFrame) -> DataFrame:
    """``(path, error, records)``: what is wrong in each log, and with how many of its records."""
    flawed = _parsed(records).select("path", _flaw().alias("error")).filter("error IS NOT NULL")
    return flawed.groupBy("path", "error").agg(F.count(F.lit(1)).alias("records"))


def _readable(spark: SparkSession, paths: Sequence[str]) -> tuple[list[str], list[tuple[str, str, int]]]:
    """The paths that exist, and the others with their errors; looked up singly only if need be."""
    try:
        spark.read.text(list(paths))
        return list(paths), []
    except AnalysisException as e:
        if len(paths) == 1:
            return [], [(paths[0], e.getCondition() or "unreadable", 0)]
    half = len(paths) // 2
    (found, missing), (more, gone) = _readable(spark, paths[:half]), _readable(spark, paths[half:])
    return found + more, missing + gone


def read_many(
    spark: SparkSession, paths: Sequence[str], patches: bool = False, whole_logs: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(commits, file_changes, errors)`` of many logs.

    Records that cannot be read are reported and left out, the others of their log are kept;
    with ``whole_logs`` a log with such a record is left out as a whole.
    """
    found, missing = _readable(spark, paths) if paths else ([], [])
    records = read_records(spark, found) if found else spark.createDataFrame([], _RAW)
    bad = load_errors(records)
    errors = bad.unionByName(spark.createDataFrame(missing, "path STRING, error STRING, records BIGINT"))
    good = records.join(bad.select("path"), "path", "left_anti") if whole_logs else records
    changes = count_patch_lines(good) if patches else read_numstat(good)
    return commits_of(good), changes, errors


# ---- line by line -------------------------------------------------------------------
#
# What a line means depends on lines before it: the last record header, whether the message has
# ended, the last file header, the last hunk header. Within a block of a file, as the text source
# cuts it, a window looks them up; a block's last ones are carried into the blocks that follow.
# Whether a block begins within a message or within a patch is known only then, so what its lines
# mean is worked out for both.

_BLOCK = ("path", "block")
_FILE_HEADER = r"^diff --(git |cc |combined )"
_STRUCTURE = r"^(diff --|\+\+\+ |--- |@@|index |new file|deleted file|old mode|similarity |Binary files |GIT binary patch)"


#: Bytes of the longest record that is read as one row.
ROW_BYTES = 8 << 20

_SEPARATOR = "\n\x1e"
_FILE = "_metadata.file_path"


def _short_records(spark: SparkSession, paths: Sequence[str], row_bytes: int) -> DataFrame:
    """Text rows between separators; the reader doesn't hold longer ones, but may give pieces of them."""
    longest = str(row_bytes)
    return spark.read.option("lineSep", _SEPARATOR).option("mapreduce.input.linerecordreader.line.maxlength", longest).text(list(paths))


def logs_with_long_records(spark: SparkSession, paths: Sequence[str], row_bytes: int = ROW_BYTES) -> list[str]:
    """Files whose bytes are not all found in short records, by counting them: they hold a longer
    one, or are compressed. One pass, of which a row per file is left."""
    size, parted = F.col("size"), len(_SEPARATOR)
    whole = spark.read.format("binaryFile").load(list(paths)).select(F.col(_FILE).alias("file"), F.col("_metadata.file_size").alias("size"))
    rows = _short_records(spark, paths, row_bytes).select(F.col(_FILE).alias("file"), (F.octet_length("value") + F.lit(parted)).cast("bigint").alias("found"))
    found = rows.groupBy("file").agg(F.sum("found").alias("found"))
    # a separator may stand at the end
    complete = F.coalesce(F.col("found").isin(size, size + F.lit(parted)), size == 0)
    return [r["file"] for r in whole.join(found, "file", "left").filter(~complete).select("file").collect()]


def read_short_records(spark: SparkSession, paths: Sequence[str], row_bytes: int = ROW_BYTES, but: Sequence[str] = ()) -> DataFrame:
    """As :func:`read_records`, of all files ``but`` some; records begin at the beginning of a line."""
    text = _short_records(spark, paths, row_bytes)
    text = text.filter(~F.col(_FILE).isin(*but)) if but else text
    begun = F.when(F.startswith("value", F.lit("\x1e")), F.substr("value", F.lit(2))).otherwise(F.col("value"))
    return text.select(_decoded(F.col(_FILE)).alias("path"), begun.alias("value")).filter(~_blank())


def read_lines(spark: SparkSession, path: str | Sequence[str], only: Sequence[str] = ()) -> DataFrame:
    """``(path, block, line, value)`` of logs; within a block lines are in the order of ``line``."""
    paths = [path] if isinstance(path, str) else list(path)
    text = spark.read.option("lineSep", "\n").text(paths)
    text = text.filter(F.col(_FILE).isin(*only)) if only else text
    return text.select(
        _decoded(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )


def _marked(lines: DataFrame) -> DataFrame:
    """Lines with what was last seen before them, or in them, within their block.

    ``record`` is the last header, ``part`` whether it is the ``message`` or the ``patch``;
    ``if_patch`` and ``if_message`` hold the last file header and hunk header, should the block
    begin in a patch or in a message. Content of hunks keeps its sign only.
    """
    upto = Window.partitionBy(*_BLOCK).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins, ends = F.startswith("value", F.lit("\x1e")), F.contains("value", F.lit("\x1d"))
    fields = F.split(F.substr("value", F.lit(2)), "\x1f", len(_FIELDS))
    oid, epoch = fields[0], F.expr("try_cast(get(split(substr(value, 2), '\x1f', 7), 5) AS BIGINT)")
    fine = oid.rlike("^[0-9a-f]{40}([0-9a-f]{24})?$") & epoch.isNotNull()
    place = [F.col("block").alias("block"), F.col("line").alias("line")]
    header = F.struct(
        *place,
        F.md5(F.concat_ws("\x1f", "path", oid).cast("binary")).alias("commit_id"),
        F.timestamp_seconds(epoch).alias("ts"),
        F.coalesce(fine, F.lit(False)).alias("fine"),
    )
    state = F.when(ends, F.lit("patch")).when(begins, F.lit("message"))
    seen = lines.withColumns({"_begins": begins, "_ends": ends}).withColumns(
        {
            "record": F.last(F.when(F.col("_begins"), header), ignorenulls=True).over(upto),
            "part": F.last(state, ignorenulls=True).over(upto),
        }
    )

    def marks(inside: Column) -> Column:
        starts, hunk = inside & F.col("value").rlike(_FILE_HEADER), inside & F.startswith("value", F.lit("@@"))
        none = F.struct(F.lit(-1).cast("bigint").alias("block"), F.lit(-1).cast("bigint").alias("line"), F.lit("").alias("header"))
        file = F.when(F.col("_begins"), none).when(starts, F.struct(*place, F.col("value").alias("header")))
        within = F.when(F.col("_begins") | starts, F.lit(False)).when(hunk, F.lit(True))
        return F.struct(
            F.last(file, ignorenulls=True).over(upto).alias("file"), F.last(within, ignorenulls=True).over(upto).alias("hunk")
        )

    known = (F.col("part") == "patch") & ~F.col("_ends")
    sign = F.when(F.startswith("value", F.lit("+")), F.lit("+")).when(F.startswith("value", F.lit("-")), F.lit("-"))
    kept = (F.col("part").isNull() | (F.col("part") == "message") | F.col("_ends") | F.col("value").rlike(_STRUCTURE) | F.col("value").rlike(r"^(\d+\t|-\t)"))
    return seen.withColumns(
        {"if_patch": marks(F.coalesce(known, F.lit(True))), "if_message": marks(F.coalesce(known, F.lit(False)))}
    ).select(*_BLOCK, "line", "record", "part", "if_patch", "if_message", "_ends", sign.alias("sign"), F.when(kept, F.col("value")).alias("value"))


def _carries(marked: DataFrame) -> DataFrame:
    """What each block begins with: the last of everything in the blocks of its file before it.

    One row per block of a file, in the order of its blocks.
    """
    state = F.struct("record", "part", "if_patch", "if_message")
    last = marked.groupBy(*_BLOCK).agg(F.max_by(state, "line").alias("end")).select(*_BLOCK, "end.*")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def carried(value: Column) -> Column:
        return F.last(value, ignorenulls=True).over(before)

    known = last.withColumns({"in_record": carried(F.col("record")), "in_part": carried(F.col("part"))})
    chosen = known.withColumn("chosen", F.when(F.col("in_part") == "patch", F.col("if_patch")).otherwise(F.col("if_message")))
    return chosen.select(
        *_BLOCK, "in_record", "in_part", carried(F.col("chosen.file")).alias("in_file"), carried(F.col("chosen.hunk")).alias("in_hunk")
    )


def understood(spark: SparkSession, path: str | Sequence[str], only: Sequence[str] = ()) -> DataFrame:
    """Lines with their record, part, file header and whether they are in a hunk. The lines are
    shuffled by block once and written; what is joined afterwards is one row per block."""
    marked = materialize(_marked(read_lines(spark, path, only)), "log-lines")
    known = marked.join(_carries(marked), list(_BLOCK))
    own = F.when(F.col("in_part") == "patch", F.col("if_patch")).otherwise(F.col("if_message"))
    return known.select(
        *_BLOCK,
        "line",
        F.coalesce("record", "in_record").alias("record"),
        F.coalesce("part", "in_part").alias("part"),
        F.coalesce(own["file"], F.col("in_file")).alias("file"),
        F.coalesce(own["hunk"], F.col("in_hunk"), F.lit(False)).alias("hunk"),
        F.col("_ends").alias("ends"),
        "sign",
        "value",
    ).filter("record IS NOT NULL")


def _heads(lines: DataFrame) -> DataFrame:
    """Records without what follows their message, for :func:`commits_of` and :func:`load_errors`."""
    head = lines.filter((F.col("part") == "message") | F.col("ends"))
    ordered = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    joined = F.array_join(F.transform(ordered, lambda x: x["value"]), "\n")
    records = head.groupBy("path", "record.block", "record.line").agg(joined.alias("value"))
    return records.select("path", F.substr("value", F.lit(2)).alias("value"))


def _patch_files(lines: DataFrame) -> DataFrame:
    """Per-file line counts of patches: partial counts leave each task, however large a file's part."""
    in_hunk = F.col("hunk")
    keys = ("path", "record", "file")
    parts = lines.filter((F.col("file.line") >= 0)).select(
        *keys,
        F.when(~in_hunk, F.col("value")).alias("head"),
        (in_hunk & (F.col("sign") == "+")).cast("bigint").alias("additions"),
        (in_hunk & (F.col("sign") == "-")).cast("bigint").alias("deletions"),
    )
    # content of hunks has no head, so this leaves a few rows per file and task
    few = parts.groupBy(*keys, "head").agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))

    def side(mark: str, prefix: str) -> Column:
        name = F.regexp_extract("head", rf"(?d)^{mark} (.*?)\t?$", 1)
        text = F.regexp_replace(unquoted(name), f"^{prefix}/", "")
        return F.max(F.when(F.startswith("head", F.lit(mark.replace("\\", "") + " ")) & ~text.isin("", "/dev/null"), text))

    files = few.groupBy(*keys).agg(
        F.sum("additions").alias("additions"),
        F.sum("deletions").alias("deletions"),
        side(r"\+\+\+", "b").alias("new"),
        side("---", "a").alias("old"),
        F.max(F.coalesce(F.col("head").rlike("^(Binary files |GIT binary patch)"), F.lit(False))).alias("binary"),
        F.max(F.coalesce(F.col("head").rlike("^(index |--- |new file|deleted file|old mode|similarity )"), F.lit(False))).alias("real"),
    )
    bare = F.regexp_replace("file.header", _FILE_HEADER, "")
    named = F.regexp_replace(unquoted(F.regexp_extract(bare, r'(?d)^(?:"a/.*" |a/.* )("b/.*"|b/.*)', 1)), "^b/", "")
    return files.filter("real AND NOT binary").select(
        "record.commit_id", repo_name(F.col("path")).alias("repo"), "record.ts", F.coalesce("new", "old", named).alias("path"), "additions", "deletions"
    )


def _numstat_files(lines: DataFrame) -> DataFrame:
    shape = r"^(\d+)\t(\d+)\t(.+)$"
    counted = lines.filter(F.col("value").rlike(shape))
    return counted.select(
        "record.commit_id",
        repo_name(F.col("path")).alias("repo"),
        "record.ts",
        unquoted(F.regexp_extract("value", shape, 3)).alias("path"),
        F.regexp_extract("value", shape, 1).cast("bigint").alias("additions"),
        F.regexp_extract("value", shape, 2).cast("bigint").alias("deletions"),
    )


def read_large_logs(
    spark: SparkSession, paths: str | Sequence[str], patches: bool = True, row_bytes: int = ROW_BYTES
) -> History:
    """Logs as a history, whatever the size of a record: only a commit's message has to fit into a row.

    Records begin at the beginning of a line here, and lines end with a line feed. The result is
    that of :func:`read_many`. Reading by lines writes several times the size of a log, so only
    logs that hold a record of ``row_bytes`` or more are read so.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    long = logs_with_long_records(spark, paths, row_bytes)
    records = read_short_records(spark, paths, row_bytes, long)
    changes = count_patch_lines(records) if patches else read_numstat(records)
    if long:
        lines = understood(spark, paths, long)
        inside = lines.filter((F.col("part") == "patch") & ~F.col("ends") & F.col("record.fine"))
        counted = _patch_files(inside) if patches else _numstat_files(inside)
        changes = changes.unionByName(with_language(counted).select(*_COMMIT_KEYS, "path", "language", "additions", "deletions"))
        records = records.unionByName(_heads(lines))
    return History(commits_of(records), changes, owned=True, errors=load_errors(records))


def read_history(spark: SparkSession, paths: Sequence[str], patches: bool = False, whole_logs: bool = False) -> History:
    """Many logs as one history, with what was left out in ``errors``."""
    commits, changes, errors = read_many(spark, paths, patches, whole_logs)
    return History(commits, changes, owned=True, errors=errors)
