"""Commit-message and person-text scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. (?d) makes \n the only line end; the class is Unicode white space.
_WS = r"[\s\u0085\p{Z}]"
TRAILER = rf"(?imd)^co-authored-by:{_WS}*(.+?){_WS}*<(.+?)>"

# The characters Unicode calls white space.
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def subject(message: Column) -> Column:
    """First line of a message."""
    return F.regexp_replace(F.split_part(message, F.lit("\n"), F.lit(1)), "\r$", "")


def co_authors(message: Column) -> Column:
    """People named in co-author trailers, in order, repeats kept."""
    # one search of the message, and none without the word; names and addresses are cut from what it finds
    trailers = F.when(F.contains(F.lower(message), F.lit("co-authored-by:")), F.regexp_extract_all(message, F.lit(TRAILER), F.lit(0)))
    space = F.lit(WHITE_SPACE)
    people = F.transform(
        trailers,
        lambda t: F.struct(*[F.btrim(F.regexp_extract(t, TRAILER, i), space).alias(n) for i, n in ((1, "name"), (2, "email"))]),
    )
    return F.coalesce(people, F.array().cast("array<struct<name:string,email:string>>"))


def split_person(text: Column) -> Column:
    """``Name <email>`` split at the last ``" <"``; other text is a name without e-mail."""
    shape = r"(?s)^(.*) <(.*)>$"
    hit = text.rlike(shape)
    return F.struct(
        F.when(hit, F.regexp_extract(text, shape, 1)).otherwise(text).alias("name"),
        F.when(hit, F.regexp_extract(text, shape, 2)).alias("email"),
    )


def person_text(person: Column) -> Column:
    return F.format_string("%s <%s>", person["name"], person["email"])


def change_text(path: Column, additions: Column, deletions: Column) -> Column:
    return F.format_string("%s (+%d/-%d)", path, additions, deletions)


def remote_url_parts(url: Column) -> Column:
    """(platform, owner, repo) of an http(s) or ssh remote on the two known hosts, else NULL."""
    shape = r"^(?:https?://(github|gitlab)\.com/|git@(github|gitlab)\.com:)([^/]+)/([^/]+)$"
    bare = F.regexp_replace(F.regexp_replace(url, "/+$", ""), r"\.git$", "")
    platform = F.concat(F.regexp_extract(bare, shape, 1), F.regexp_extract(bare, shape, 2))
    return F.when(
        bare.rlike(shape),
        F.struct(
            platform.alias("platform"),
            F.regexp_extract(bare, shape, 3).alias("owner"),
            F.regexp_extract(bare, shape, 4).alias("repo"),
        ),
    )


# Letters folded when only ASCII case may differ.
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def ascii_lower_str(text: str) -> str:
    return text.translate(str.maketrans(_UPPER, _LOWER))
