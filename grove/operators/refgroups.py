"""Hierarchical, overlapping groups of references.

Groups form a tree by the dots in their symbols. Which groups a reference
counts in becomes one array column; counting explodes it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grove.functions.counters import count32
from grove.functions.references import Filter, everything, exclude, folded, include, interpreted, nothing, pattern, prefix

IGNORED = "ignored"

#: Standard groups: fixed symbols, names and filters.
STANDARD = (
    ("branches", "Branches", "refs/heads/"),
    ("tags", "Tags", "refs/tags/"),
    ("remotes", "Remote-tracking refs", "refs/remotes/"),
    ("pulls", "Pull request refs", "refs/pull/"),
    ("changes", "Changeset refs", r"/refs/changes/\d{2}/\d+/\d+/"),
    ("notes", "Git notes", "refs/notes/"),
    ("stash", "Git stash", "/refs/stash/"),
)


@dataclass
class Group:
    symbol: str
    name: str = ""
    own: Filter | None = None
    children: list[Group] = field(default_factory=list)
    other: str | None = None

    def matches(self, name: Column) -> Column:
        """Its own filter, or else any child's."""
        if self.own is not None:
            return self.own(name)
        found = F.lit(False)
        for child in self.children:
            found = found | child.matches(name)
        return found


class Groups:
    """The tree of standard and configured groups, and the selection rules on top of it."""

    def __init__(self, config: list[tuple[str, str]] = ()):
        self.top = Group("", name="")
        self.by_symbol = {"": self.top}
        for symbol, name, how in STANDARD:
            group = self._at(symbol)
            group.name, group.own = name, interpreted(how, self.filter_of)
        for key, value in config:
            symbol, _, part = key.rpartition(".")
            if not symbol:
                continue
            group = self._at(symbol)
            match part.lower():
                case "name":
                    group.name = value
                case "include":
                    group.own = include(group.own, prefix(value))
                case "includeregexp":
                    group.own = include(group.own, pattern(value))
                case "exclude":
                    group.own = exclude(group.own, prefix(value))
                case "excluderegexp":
                    group.own = exclude(group.own, pattern(value))

    def _at(self, symbol: str) -> Group:
        """The group of that symbol; missing ancestors come without a filter."""
        if symbol not in self.by_symbol:
            parent = self._at(symbol.rpartition(".")[0])
            self.by_symbol[symbol] = Group(symbol)
            parent.children.append(self.by_symbol[symbol])
        return self.by_symbol[symbol]

    def filter_of(self, symbol: str) -> Filter:
        """Names that the group matches and none of its ancestors' filters turns down; the top doesn't count."""
        if not symbol or symbol not in self.by_symbol:
            raise ValueError(f"undefined reference group {symbol!r}")

        def passes(name: Column) -> Column:
            found, above = self.by_symbol[symbol].matches(name), symbol.rpartition(".")[0]
            while above:
                if self.by_symbol[above].own is not None:
                    found = found & self.by_symbol[above].own(name)
                above = above.rpartition(".")[0]
            return found

        return passes

    def finish(self, options: list[tuple[str, str]] = (), default_all: bool = True) -> Groups:
        """Sets the top filter from the selection rules, fills in names and "other" groups, and checks that every group is defined."""
        self.top.own = folded(options, self.filter_of) or (everything if default_all else nothing)
        self.order: list[tuple[str, str]] = []

        def fill(group: Group) -> None:
            if group.own is None and not group.children:
                raise ValueError(f"reference group {group.symbol!r} is used but not defined")
            group.name = group.name or group.symbol.rpartition(".")[2]
            self.order.append((group.symbol, group.name))
            for child in group.children:
                fill(child)
            if group.children:
                group.other = f"{group.symbol}.other" if group.symbol else "other"
                self.order.append((group.other, "Other"))

        fill(self.top)
        self.order.append((IGNORED, "Ignored"))
        return self

    def categorized(self, refs: DataFrame, name_col: str = "refname") -> DataFrame:
        """Adds walk and groups; a reference that isn't walked counts as ignored.

        A group counts if its own filter, or without one any child's, takes
        the name and no filter above turns it down; "other" if the group's
        filter does and no child counts. Every filter is evaluated once, into
        an array of flags, so the expression grows with the number of groups
        and not with their nesting.
        """
        flags = f"_{name_col}_flags"
        place: dict[str, int] = {}
        filters: list[Filter] = []
        symbols: list[Column] = []

        def number(group: Group) -> None:
            if group.own is not None:
                place[group.symbol] = len(filters)
                filters.append(group.own)
            for child in group.children:
                number(child)

        def owners(group: Group) -> list[str]:
            """The nearest groups with a filter of their own, from the group downwards."""
            return [group.symbol] if group.own is not None else [s for child in group.children for s in owners(child)]

        def some(found: list[str]) -> Column:
            return reduce(or_, (F.col(flags)[place[s]] for s in found), F.lit(False))

        def add(group: Group, above: list[Column]) -> None:
            counts = reduce(and_, above, some(owners(group)))
            symbols.append(F.when(counts, F.lit(group.symbol)))
            inner = [*above, F.col(flags)[place[group.symbol]]] if group.own is not None else above
            for child in group.children:
                add(child, inner)
            if group.other is not None and group.own is not None:
                symbols.append(F.when(reduce(and_, inner) & ~some([s for child in group.children for s in owners(child)]), F.lit(group.other)))

        number(self.top)
        add(self.top, [])
        flagged = refs.withColumn(flags, F.array(*[f(F.col(name_col)) for f in filters])).withColumn("walk", F.col(flags)[place[""]])
        taken = F.filter(F.array(*symbols), lambda x: x.isNotNull())
        return flagged.withColumn("groups", F.when(F.col("walk"), taken).otherwise(F.array(F.lit(IGNORED)))).drop(flags)


def group_counts(categorized: DataFrame) -> DataFrame:
    """(symbol, n): a reference counts once in each of its groups."""
    return categorized.select(F.explode("groups").alias("symbol")).groupBy("symbol").agg(count32().alias("n"))


def shown(categorized: DataFrame, name_col: str = "refname") -> DataFrame:
    """A line for each reference: "+ " if it is walked, else blanks."""
    return categorized.select(F.concat(F.when(F.col("walk"), "+ ").otherwise("  "), F.col(name_col)).alias("line"))
