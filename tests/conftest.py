import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from revtally.operators.history import History  # noqa: E402
from revtally.session import build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": 4,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


COMMITS = (
    "commit_id INT, repo STRING, author STRUCT<name: STRING, email: STRING>, "
    "committer STRUCT<name: STRING, email: STRING>, co_authors ARRAY<STRUCT<name: STRING, email: STRING>>, "
    "ts STRING, message STRING"
)
CHANGES = "commit_id INT, path STRING, language STRING, additions BIGINT, deletions BIGINT"


def history(spark, commits, changes):
    """commits: (id, repo, author, co-author names, ts); changes: (id, path, language, +, -)."""

    def who(name):
        return (name, f"{name.lower()}@test.com")

    rows = [(i, r, who(a), who(a), [who(c) for c in co], ts, "m") for i, r, a, co, ts in commits]
    frame = spark.createDataFrame(rows, COMMITS)
    return History(
        frame.withColumn("ts", frame.ts.cast("timestamp")), spark.createDataFrame(changes, CHANGES)
    )


FIVE_COMMITS = [
    (1, "demo", "Alice", [], "2024-01-15 10:00:00"),
    (2, "demo", "Bob", [], "2024-01-16 14:00:00"),
    (3, "demo", "Alice", ["Charlie"], "2024-01-22 08:00:00"),
    (4, "demo", "Bob", [], "2024-02-01 11:00:00"),
    (5, "demo", "Alice", [], "2024-02-15 16:00:00"),
]
FIVE_CHANGES = [
    (1, "src/main.rs", "Rust", 11, 0),
    (1, "README.md", "Markdown", 5, 0),
    (2, "src/main.rs", "Rust", 5, 1),
    (2, "src/lib.py", "Python", 8, 0),
    (3, "app.js", "JavaScript", 12, 0),
    (4, "src/main.rs", "Rust", 8, 4),
    (4, "src/lib.py", "Python", 4, 0),
    (4, "style.css", "CSS", 20, 0),
    (5, "README.md", "Markdown", 1, 2),
    (5, "app.js", "JavaScript", 0, 12),
]


@pytest.fixture(scope="session")
def five(spark):
    h = history(spark, FIVE_COMMITS, FIVE_CHANGES)
    return History(h.commits.cache(), h.file_changes.cache())


@pytest.fixture()
def build(spark):
    return lambda commits, changes: history(spark, commits, changes)


def rows(df, *columns):
    """Rows as tuples, in order of their text."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
