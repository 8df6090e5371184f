"""Predicates that say whether a commit belongs to somebody.

Every predicate is a Column over ``author`` and ``co_authors``, so they combine with
``&``, ``|`` and parentheses.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mail domains of generated no-reply addresses.
NOREPLY_STRICT = "@users.noreply.github.com"
NOREPLY_LOOSE = "noreply.github.com"


def _anyone(test: Callable[[Column], Column]) -> Column:
    return test(F.col("author")) | F.coalesce(F.exists(F.col("co_authors"), test), F.lit(False))


def _sure(test: Column) -> Column:
    """A test that is false, not unknown, where a name or an address is missing."""
    return F.coalesce(test, F.lit(False))


def _holds(text: Column, pattern: str) -> Column:
    return _sure(F.contains(F.lower(text), F.lower(F.lit(pattern))))


def involves(pattern: str) -> Column:
    """Author or a co-author whose name or e-mail contains ``pattern``, in any case."""
    return _anyone(lambda p: _holds(p["name"], pattern) | _holds(p["email"], pattern))


def me_name(pattern: str) -> Column:
    return _anyone(lambda p: _holds(p["name"], pattern))


def me_email(pattern: str) -> Column:
    return _anyone(lambda p: _holds(p["email"], pattern))


def me_noreply(login: str) -> Column:
    """Author or a co-author whose no-reply address carries ``login``."""
    return _anyone(lambda p: _sure(noreply_login(p["email"]) == F.lower(F.lit(login))))


def me_login(login: str, emails: Sequence[str] = ()) -> Column:
    """As :func:`me_noreply`, or by an e-mail known to belong to ``login``."""
    by_address = me_noreply(login)
    return by_address | _anyone(lambda p: _sure(p["email"].isin(*emails))) if emails else by_address


def committed_by(pattern: str) -> Column:
    who = F.col("committer")
    return _holds(who["name"], pattern) | _holds(who["email"], pattern)


def _login_part(email: Column) -> Column:
    local = F.split_part(email, F.lit("@"), F.lit(1))
    plus = F.instr(local, "+")
    return F.when(plus > 0, F.substr(local, plus + F.lit(1))).otherwise(local)


def noreply_login(email: Column) -> Column:
    """Lower-case login of ``id+login@users.noreply…``, any case; NULL for other addresses."""
    low = F.lower(email)
    return F.when(F.endswith(low, F.lit(NOREPLY_STRICT)), _login_part(low))


def noreply_login_loose(email: Column) -> Column:
    """As :func:`noreply_login` on the shorter suffix, case kept."""
    return F.when(F.endswith(email, F.lit(NOREPLY_LOOSE)), _login_part(email))


def repo_key(owner: Column, name: Column) -> Column:
    return F.lower(F.concat_ws("/", owner, name))
