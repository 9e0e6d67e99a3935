"""Selection of references: prefix, pattern and group filters, folded in order into one condition.

A filter is a function from the column of reference names to a boolean
column, so that a whole selection becomes one expression of one scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

from grove.functions.patterns import BadPattern, translated

Filter = Callable[[Column], Column]

#: Selection flags: fixed names and what each stands for.
FLAGS = {"branches": "refs/heads", "tags": "refs/tags", "remotes": "refs/remotes", "notes": "refs/notes", "stash": "/refs/stash/"}


def everything(name: Column) -> Column:
    return F.lit(True)


def nothing(name: Column) -> Column:
    return F.lit(False)


def prefix(wanted: str) -> Filter:
    """Names that start with `wanted` at a boundary; a trailing slash is a boundary already."""
    if not wanted:
        return everything
    if wanted.endswith("/"):
        return lambda name: name.startswith(wanted)
    return lambda name: (name == wanted) | name.startswith(f"{wanted}/")


def pattern(wanted: str) -> Filter:
    """Names that match ^wanted$, with no group around it: of alternatives, the first is bound to the start and the last to the end.

    wanted is in RE2's syntax; what that refuses is an error here, and what
    the session's engine refuses (a script it doesn't know) as soon as the
    filter is used.
    """
    java = f"(?d)^{translated(wanted)}$"

    def matches(name: Column) -> Column:
        try:
            SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(java)
        except IllegalArgumentException as e:
            raise BadPattern(f"bad regular expression {wanted!r}: {e}") from None
        return name.rlike(java)

    return matches


def include(so_far: Filter | None, more: Filter) -> Filter:
    return more if so_far is None else lambda name: so_far(name) | more(name)


def exclude(so_far: Filter | None, less: Filter) -> Filter:
    """The first exclusion starts from everything."""
    return (lambda name: ~less(name)) if so_far is None else lambda name: so_far(name) & ~less(name)


def interpreted(text: str, group: Callable[[str], Filter]) -> Filter:
    """/pattern/, @group or a prefix."""
    if len(text) >= 2 and text.startswith("/") and text.endswith("/"):
        return pattern(text[1:-1])
    return group(text[1:]) if text.startswith("@") else prefix(text)


def folded(options: Iterable[tuple[str, str]], group: Callable[[str], Filter]) -> Filter | None:
    """The rules in order, so that the last one that matches decides.

    Options are (name, value): include, exclude, their -regexp forms, refgroup,
    and the flags of FLAGS with or without no- and with true or false.
    """
    so_far: Filter | None = None
    for name, value in options:
        if name in ("include", "exclude"):
            combine, part = (include if name == "include" else exclude), interpreted(value, group)
        elif name in ("include-regexp", "exclude-regexp"):
            combine, part = (include if name.startswith("include") else exclude), pattern(value)
        elif name == "refgroup":
            combine, part = include, group(value)
        elif (flag := name.removeprefix("no-")) in FLAGS:
            wanted = (flag == name) == (value.lower() not in ("false", "0", "f"))
            combine, part = (include if wanted else exclude), interpreted(FLAGS[flag], group)
        else:
            raise ValueError(f"unknown selection option {name!r}")
        so_far = combine(so_far, part)
    return so_far


def config_rest(key: Column, section: str) -> Column:
    """What follows the section in a configuration key, null unless it matches at a boundary."""
    if not section:
        return key
    if section.endswith("."):
        return F.when(key.startswith(section), F.substring(key, len(section) + 1, 1 << 30))
    return F.when(key == section, F.lit("")).when(key.startswith(f"{section}."), F.substring(key, len(section) + 2, 1 << 30))
