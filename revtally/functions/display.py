"""Numbers and people as report text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revtally.functions.text import split_person

NUMBER_FORMATS = ("plain", "separated", "short")
EMAIL_MODES = ("none", "simple", "full")


def tenths(x: Column) -> Column:
    """Whole tenths nearest to the exact value of a non-negative double, ties to even.

    Both Spark's ``round`` and ``format_string`` round the shortest decimal text of a
    double, which moves 1.15 (stored as 1.1499…) up. Splitting ``x`` into two halves makes
    ``10 * x`` exact, so the comparison with the half-way point is exact too.
    """
    big = x * F.lit(134217729.0)
    hi = big - (big - x)
    lo = x - hi
    base = F.floor(F.lit(10.0) * x)
    gap = (F.lit(10.0) * hi - base.cast("double") - F.lit(0.5)) + F.lit(10.0) * lo
    up = (gap > 0) | ((gap == 0) & (base % 2 == 1))
    return base + up.cast("bigint")


def one_decimal(x: Column) -> Column:
    t = tenths(x)
    whole = F.floor(t / F.lit(10)).cast("bigint")
    return F.concat(whole.cast("string"), F.lit("."), (t % 10).cast("string"))


def format_number(n: Column, style: str = "plain") -> Column:
    """``1234567`` as it is, as ``1,234,567`` or as ``1.2M``."""
    if style == "plain":
        return n.cast("string")
    if style == "separated":
        return F.format_number(n, 0)
    if style == "short":
        return (
            F.when(n >= 1_000_000, F.concat(one_decimal(n.cast("double") / F.lit(1e6)), F.lit("M")))
            .when(n >= 1_000, F.concat(one_decimal(n.cast("double") / F.lit(1e3)), F.lit("k")))
            .otherwise(n.cast("string"))
        )
    raise ValueError(f"number format must be one of {NUMBER_FORMATS}, got {style!r}")


def signed_net(additions: Column, deletions: Column) -> Column:
    return additions - deletions


def net_text(additions: Column, deletions: Column, style: str = "plain") -> Column:
    net = signed_net(additions, deletions)
    return F.concat(F.when(net >= 0, F.lit("+")).otherwise(F.lit("-")), format_number(F.abs(net), style))


def change_cell(additions: Column, deletions: Column, style: str = "plain") -> Column:
    return F.concat(F.lit("+"), format_number(additions, style), F.lit(" -"), format_number(deletions, style))


def percent_text(share: Column) -> Column:
    return one_decimal(share)


def _short_address(email: Column) -> Column:
    hosted = F.contains(email, F.lit("noreply.github.com"))
    tag = F.when(hosted, F.lit("[github email]")).otherwise(F.lit("[gitlab email]"))
    plus = F.instr(email, "+")
    cut = F.when(plus > 0, F.concat(F.lit("..."), F.substr(email, plus))).otherwise(email)
    cut = F.replace(cut, F.lit("users.noreply.github.com"), tag)
    return F.replace(cut, F.lit("noreply.gitlab.com"), tag)


def _is_noreply(email: Column) -> Column:
    return F.contains(email, F.lit("noreply.github.com")) | F.contains(email, F.lit("noreply.gitlab.com"))


def author_text(text: Column, mode: str = "none") -> Column:
    """``Name <email>`` text as :func:`author_display` shows a person."""
    if mode == "full":
        return text
    if mode == "none":
        shape = r"(?s)^(.*) <"
        return F.when(text.rlike(shape), F.regexp_extract(text, shape, 1)).otherwise(text)
    if mode == "simple":
        person = split_person(text)
        short = F.concat(person["name"], F.lit(" <"), _short_address(person["email"]), F.lit(">"))
        return F.when(_is_noreply(person["email"]), short).otherwise(text)
    raise ValueError(f"e-mail display must be one of {EMAIL_MODES}, got {mode!r}")


def author_display(name: Column, emails: Column, mode: str = "none") -> Column:
    """A person with the e-mail list: name only, no-reply addresses shortened, or all in full."""
    if mode == "none":
        return name
    if mode not in EMAIL_MODES:
        raise ValueError(f"e-mail display must be one of {EMAIL_MODES}, got {mode!r}")

    def shown(email: Column) -> Column:
        text = email
        if mode == "simple":
            text = F.when(_is_noreply(email), _short_address(email)).otherwise(email)
        return F.concat(F.lit("<"), text, F.lit(">"))

    listed = F.array_join(F.transform(emails, shown), ", ")
    return F.when(F.size(emails) > 0, F.concat(name, F.lit(" "), listed)).otherwise(name)
