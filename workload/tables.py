"""The given tables read as a code history.

Every mapping is a projection of its table, so a query on the mapped frames scans, prunes
and shuffles as it would on real history tables of the same size.

========== ======== ==================================================================
history    table    how
========== ======== ==================================================================
commits    orders   an order is a commit of its customer to the repository of a nation
changes    lineitem a line item is a changed file: quantity added, discount removed
history    events   an event is a commit of a hosted repository
repos      part     a brand is a repository, its part types are languages
identity   customer a customer has a login
inventory  supplier a supplier owns a folder
========== ======== ==================================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revtally.functions.text import subject
from revtally.operators import refresh
from revtally.operators.history import History
from revtally.operators.remote import merge_languages
from revtally.session import scratch_path

SCHEMAS = {
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}

# Languages and extensions of the line items, by part number.
LANGUAGES = ("Rust", "Python", "JavaScript", "TypeScript", "CSS", "Markdown", "Go", None)
EXTENSIONS = ("rs", "py", "js", "ts", "css", "md", "go", "xyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table with its known schema: no inference job, and times read as UTC moments."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


# The commit mapping is written as SQL text, which Spark parses faster than Python can build it.


def padded(prefix: str, key: str) -> str:
    return f"concat('{prefix}', lpad(cast({key} AS STRING), 9, '0'))"


def email(key: str) -> str:
    """The kind of e-mail address depends on the key."""
    low = padded("customer", key)
    return (
        f"CASE {key} % 4 WHEN 0 THEN concat({low}, '@corp.example') "
        f"WHEN 1 THEN concat(cast({key} AS STRING), '+', {low}, '@users.noreply.github.com') "
        f"WHEN 2 THEN concat({low}, '@users.noreply.github.com') "
        f"ELSE concat({padded('Customer', key)}, '@Mail.example') END"
    )


def person(key: str) -> str:
    """A customer as a person."""
    return f"named_struct('name', {padded('Customer#', key)}, 'email', {email(key)})"


def helper_keys(order: str, customer: str) -> str:
    """Co-authors of an order: none, one, two, the author again, or one person twice."""
    one, two, three = (f"{customer} + {i}" for i in (1, 2, 3))
    return (
        f"CASE {order} % 6 WHEN 1 THEN array({one}) WHEN 2 THEN array({one}, {two}) "
        f"WHEN 3 THEN array({customer}) WHEN 4 THEN array({three}, {three}) ELSE cast(array() AS ARRAY<BIGINT>) END"
    )


def message(order: str, keys: str, priority: str) -> str:
    """Subject, body and one trailer per helper, in several spellings."""
    word = (
        f"CASE WHEN {order} % 6 = 3 THEN 'CO-AUTHORED-BY' WHEN {order} % 6 = 2 AND i = 1 THEN 'co-authored-by' "
        "ELSE 'Co-authored-by' END"
    )
    trailer = f"concat('\\n', {word}, ': ', {padded('Customer#', 'x')}, ' <', {email('x')}, '>')"
    return (
        f"concat('Order ', cast({order} AS STRING), ' ', {priority}, '\\n\\nbody\\n', "
        f"array_join(transform({keys}, (x, i) -> {trailer}), ''))"
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository names come from the nation table, which has 25 rows at any scale.

    ``co_authors`` is what parsing ``message`` gives, as a loaded history table would hold it.
    """
    orders = table(spark, sf_dir, "orders").withColumn("n_nationkey", F.expr("cast(o_custkey % 25 AS INT)"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    author, keys = person("o_custkey"), helper_keys("o_orderkey", "o_custkey")
    return (
        orders.join(nation, "n_nationkey")
        .selectExpr(
            "o_orderkey AS commit_id",
            "n_name AS repo",
            "lower(lpad(hex(o_orderkey), 40, '0')) AS oid",
            f"{author} AS author",
            "CASE WHEN o_orderstatus = 'F' THEN named_struct('name', 'Merge Bot', 'email', 'bot@corp.example') "
            f"ELSE {author} END AS committer",
            f"transform({keys}, x -> {person('x')}) AS co_authors",
            "o_orderdate AS ts",
            f"{message('o_orderkey', keys, 'o_orderpriority')} AS message",
        )
        .withColumn("message_subject", subject(F.col("message")))
    )


def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("l_partkey")
    kind = (part % 8).cast("int")
    path = F.when(part % 50 == 0, F.concat(F.lit("src/m"), (part % 97).cast("string"), F.lit("/Makefile"))).otherwise(
        F.concat(
            F.lit("src/m"),
            (part % 97).cast("string"),
            F.lit("/part"),
            part.cast("string"),
            F.lit("."),
            F.get(F.array(*[F.lit(x) for x in EXTENSIONS]), kind),
        )
    )
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("commit_id"),
        path.alias("path"),
        F.get(F.array(*[F.lit(x) for x in LANGUAGES]), kind).alias("language"),
        F.col("l_quantity").cast("bigint").alias("additions"),
        (F.rint(F.col("l_discount") * 100) * 4).cast("bigint").alias("deletions"),
    )


def history(spark: SparkSession, sf_dir: str) -> History:
    """A line item's order is in the table of orders, so every file change has its commit."""
    return History(commits(spark, sf_dir), file_changes(spark, sf_dir), owned=True)


def hosted_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosted(table(spark, sf_dir, "events"))


def hosted(events: DataFrame) -> DataFrame:
    """Commits of hosted repositories; one in 40 has an unreadable date."""
    brand = (F.col("user_id") % 25 + 1).cast("string")
    date = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return events.select(
        F.concat(F.lit("acme/Brand#"), brand).alias("repo"),
        F.col("event_id").cast("string").alias("oid"),
        F.when(F.col("event_id") % 40 == 0, F.lit("not a date")).otherwise(date).alias("committed_date"),
        F.floor("value").cast("bigint").alias("additions"),
        F.get_json_object("props", "$.k").cast("bigint").alias("deletions"),
    )


_STORED: dict[tuple[str, str], str] = {}


def stored_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hosted history as the library stores it, written once per application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = scratch_path(spark, "hosted-history")
        refresh.append_history(spark, path, hosted_history(spark, sf_dir))
        _STORED[key] = path
    return refresh.stored_history(spark, _STORED[key])


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository per brand. Brand 7 has no language bytes; brands 5, 10, … are forks."""
    part = table(spark, sf_dir, "part").select(
        F.lit("acme").alias("owner"),
        F.col("p_brand").alias("name"),
        F.col("p_type").alias("language"),
        F.when(F.col("p_brand") == "Brand#7", 0).otherwise(F.col("p_size")).cast("bigint").alias("bytes"),
    )
    number = F.regexp_extract("name", "([0-9]+)$", 1).cast("int")
    return merge_languages(part, ["owner", "name"]).select("owner", "name", (number % 5 == 0).alias("is_fork"), "languages")


# Market segments whose customers have a login.
KNOWN_SEGMENTS = ("MACHINERY", "FURNITURE")


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logins of all customers by e-mail, NULL where there is none; two neighbours may share one."""
    segments = ", ".join(f"'{s}'" for s in KNOWN_SEGMENTS)
    login = f"CASE WHEN c_mktsegment IN ({segments}) THEN {padded('Dev', '(c_custkey div 2)')} END"
    return table(spark, sf_dir, "customer").selectExpr(f"{email('c_custkey')} AS email", f"{login} AS login")


def supplier_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repository per supplier; those of nation 3 are forks."""
    return table(spark, sf_dir, "supplier").select(
        F.lit("acme").alias("owner"),
        F.col("s_name").alias("name"),
        (F.col("s_nationkey") == 3).alias("is_fork"),
        F.create_map(F.lit("Go"), F.col("s_suppkey")).alias("languages"),
        F.col("s_acctbal").alias("balance"),
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File paths: each supplier has a repository, every fourth has one inside it."""
    key = F.col("s_suppkey")
    base = F.concat(F.lit("/srv/n"), F.col("s_nationkey").cast("string"), F.lit("/s"), key.cast("string"))
    inner = F.concat(base, F.lit("/vendor/lib/.git/HEAD"))
    paths = F.array(
        F.concat(base, F.lit("/.git/HEAD")),
        F.concat(base, F.lit("/README.md")),
        F.when(key % 4 == 0, inner).otherwise(F.concat(base, F.lit("/src/main.rs"))),
    )
    return table(spark, sf_dir, "supplier").select(F.explode(paths).alias("path"))
