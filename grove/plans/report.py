"""The report: metric catalogue, levels of concern, footnotes, table and JSON.

Everything here works on one row and a few dozen metrics.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.functions.counters import BINARY, CAP32, CAP64, METRIC, MOST_STARS, format_counter
from grove.operators.witness import Link, described, path


class Metric(NamedTuple):
    section: tuple[str, ...]
    symbol: str
    name: str
    description: str
    field: str
    system: tuple
    unit: str
    scale: float
    witness: str = ""
    kind: str = ""


#: Counters of 64 bits; all others have 32.
LONG = frozenset(("unique_commit_size", "unique_tree_size", "unique_tree_entries", "unique_blob_size", "max_expanded_blob_size"))

_ALL, _BIG, _HISTORY, _OUT = "Overall repository size", "Biggest objects", "History structure", "Biggest checkouts"

#: The metric catalogue: fixed symbols, labels, descriptions and scales.
CATALOGUE = (
    Metric((_ALL, "Commits"), "uniqueCommitCount", "Count", "The total number of distinct commit objects", "unique_commit_count", METRIC, "", 500e3),
    Metric((_ALL, "Commits"), "uniqueCommitSize", "Total size", "The total size of all commit objects", "unique_commit_size", BINARY, "B", 250e6),
    Metric((_ALL, "Trees"), "uniqueTreeCount", "Count", "The total number of distinct tree objects", "unique_tree_count", METRIC, "", 1.5e6),
    Metric((_ALL, "Trees"), "uniqueTreeSize", "Total size", "The total size of all distinct tree objects", "unique_tree_size", BINARY, "B", 2e9),
    Metric((_ALL, "Trees"), "uniqueTreeEntries", "Total tree entries", "The total number of entries in all distinct tree objects", "unique_tree_entries", METRIC, "", 50e6),
    Metric((_ALL, "Blobs"), "uniqueBlobCount", "Count", "The total number of distinct blob objects", "unique_blob_count", METRIC, "", 1.5e6),
    Metric((_ALL, "Blobs"), "uniqueBlobSize", "Total size", "The total size of all distinct blob objects", "unique_blob_size", BINARY, "B", 10e9),
    Metric((_ALL, "Annotated tags"), "uniqueTagCount", "Count", "The total number of annotated tags", "unique_tag_count", METRIC, "", 25e3),
    Metric((_ALL, "References"), "referenceCount", "Count", "The total number of references", "reference_count", METRIC, "", 25e3),
    Metric((_BIG, "Commits"), "maxCommitSize", "Maximum size", "The size of the largest single commit", "max_commit_size", BINARY, "B", 50e3, "max_commit", "commit"),
    Metric((_BIG, "Commits"), "maxCommitParentCount", "Maximum parents", "The most parents of any single commit", "max_parent_count", METRIC, "", 10, "max_parent_count_commit", "commit"),
    Metric((_BIG, "Trees"), "maxTreeEntries", "Maximum entries", "The most entries in any single tree", "max_tree_entries", METRIC, "", 1000, "max_tree_entries_tree", "tree"),
    Metric((_BIG, "Blobs"), "maxBlobSize", "Maximum size", "The size of the largest blob object", "max_blob_size", BINARY, "B", 10e6, "max_blob_size_blob", "blob"),
    Metric((_HISTORY,), "maxHistoryDepth", "Maximum history depth", "The longest chain of commits in history", "max_history_depth", METRIC, "", 500e3),
    Metric((_HISTORY,), "maxTagDepth", "Maximum tag depth", "The longest chain of annotated tags pointing at one another", "max_tag_depth", METRIC, "", 1.001, "max_tag_depth_tag", "tag"),
    Metric((_OUT,), "maxCheckoutTreeCount", "Number of directories", "The number of directories in the largest checkout", "max_expanded_tree_count", METRIC, "", 2000, "max_expanded_tree_count_tree", "tree"),
    Metric((_OUT,), "maxCheckoutPathDepth", "Maximum path depth", "The maximum path depth in any checkout", "max_path_depth", METRIC, "", 10, "max_path_depth_tree", "tree"),
    Metric((_OUT,), "maxCheckoutPathLength", "Maximum path length", "The maximum path length in any checkout", "max_path_length", BINARY, "B", 100, "max_path_length_tree", "tree"),
    Metric((_OUT,), "maxCheckoutBlobCount", "Number of files", "The maximum number of files in any checkout", "max_expanded_blob_count", METRIC, "", 50e3, "max_expanded_blob_count_tree", "tree"),
    Metric((_OUT,), "maxCheckoutBlobSize", "Total size of files", "The maximum sum of file sizes in any checkout", "max_expanded_blob_size", BINARY, "B", 1e9, "max_expanded_blob_size_tree", "tree"),
    Metric((_OUT,), "maxCheckoutLinkCount", "Number of symlinks", "The maximum number of symlinks in any checkout", "max_expanded_link_count", METRIC, "", 25e3, "max_expanded_link_count_tree", "tree"),
    Metric((_OUT,), "maxCheckoutSubmoduleCount", "Number of submodules", "The maximum number of submodules in any checkout", "max_expanded_submodule_count", METRIC, "", 100, "max_expanded_submodule_count_tree", "tree"),
)
GROUP_SCALE = 25000.0

#: The order of the fields in the first JSON format, fixed.
FIELDS = (
    "unique_commit_count unique_commit_size max_commit_size max_commit max_history_depth max_parent_count max_parent_count_commit unique_tree_count unique_tree_size unique_tree_entries "
    "max_tree_entries max_tree_entries_tree unique_blob_count unique_blob_size max_blob_size max_blob_size_blob unique_tag_count max_tag_depth max_tag_depth_tag reference_count reference_groups "
    "max_path_depth max_path_depth_tree max_path_length max_path_length_tree max_expanded_tree_count max_expanded_tree_count_tree max_expanded_blob_count max_expanded_blob_count_tree "
    "max_expanded_blob_size max_expanded_blob_size_tree max_expanded_link_count max_expanded_link_count_tree max_expanded_submodule_count max_expanded_submodule_count_tree"
).split()


def catalogue(spark: SparkSession) -> DataFrame:
    """The catalogue as a table (ord, section, symbol, name, field, system, unit, scale, cap)."""
    rows = [(i, " / ".join(m.section), m.symbol, m.name, m.field, m.system[0], m.unit, float(m.scale), str(CAP64 if m.field in LONG else CAP32)) for i, m in enumerate(CATALOGUE)]
    made = spark.createDataFrame(rows, "ord int, section string, symbol string, name string, field string, system string, unit string, scale double, cap string")
    return made.withColumn("cap", F.col("cap").cast("decimal(20,0)"))


@dataclass
class Report:
    """One row of statistics with the names of its witnesses; names is none, hash or full."""

    values: dict
    links: dict[str, Link]
    groups: list[tuple[str, str]]
    names: str = "full"

    def _items(self) -> Iterator[tuple[Metric, int, int]]:
        """(metric, value, indent) in report order."""
        for m in CATALOGUE:
            yield m, int(self.values[m.field]), 0
            if m.symbol == "referenceCount":
                counted = self.values.get("reference_groups") or {}
                for symbol, name in self.groups:
                    if symbol and symbol in counted:
                        description = f"The number of references in group '{symbol}'"
                        yield Metric(m.section, f"refgroup.{symbol}", name, description, "", METRIC, "", GROUP_SCALE), int(counted[symbol]), 1 + symbol.count(".")

    def _oid(self, m: Metric) -> str:
        oid = self.values.get(m.witness) if m.witness and self.names != "none" else None
        return bytes(oid).hex() if oid is not None else ""

    def _footnote(self, m: Metric) -> str:
        oid = self._oid(m)
        return described(oid, m.kind, self.links) if oid and self.names == "full" else oid

    def table(self, threshold: float = 1.0) -> str:
        """The metrics at or above the threshold, grouped in sections; overflow is always shown."""
        shown, notes, above = [], {}, ()
        for m, value, indent in self._items():
            cap = CAP64 if m.field in LONG else CAP32
            concern = value / m.scale
            if value < cap and concern < threshold:
                continue
            marks = "!" * MOST_STARS if value >= cap or concern > MOST_STARS else "*" * int(concern)
            text = self._footnote(m)
            cite = f"[{notes.setdefault(text, len(notes) + 1)}]" if text else ""
            if shown and m.section[0] != above[0]:
                shown.append(self._line("", "", ("", ""), ""))
            for depth, title in enumerate(m.section):
                if m.section[: depth + 1] != above[: depth + 1]:
                    shown.append(self._line(self._bullet(depth) + title, "", ("", ""), ""))
            above = m.section
            shown.append(self._line(self._bullet(len(m.section) + indent) + m.name, cite, format_counter(value, cap, m.system, m.unit), marks))
        if not shown:
            return "No problems above the current threshold were found\n"
        head = self._line("Name", "", ("Value", ""), "Level of concern"), f"| {'-' * 28} | {'-' * 9} | {'-' * 30} |\n"
        foot = "".join(f"{f'[{n}]':<4} {text}\n" for text, n in notes.items())
        return "".join((*head, *shown, "\n" if foot else "", foot))

    @staticmethod
    def _bullet(depth: int) -> str:
        return "  " * (depth - 1) + "* " if depth else ""

    @staticmethod
    def _line(name: str, cite: str, value: tuple[str, str], marks: str) -> str:
        """Names are padded by their bytes, all else by characters."""
        gap = " " * max(0, 28 - len(name.encode()) - len(cite))
        return f"| {name}{gap}{cite} | {value[0]:>5} {value[1]:<3} | {marks:<30} |\n"

    def json_fields(self) -> str:
        """The first JSON format: the row's fields; objects without a name style are left out."""
        kinds, out = {m.witness: m.kind for m in CATALOGUE if m.witness}, {}
        for f in FIELDS:
            value = self.values.get(f)
            if f in kinds:
                if value is not None and self.names != "none":
                    oid = bytes(value).hex()
                    out[f] = described(oid, kinds[f], self.links) if self.names == "full" else oid
            elif f == "reference_groups":
                out[f] = dict(sorted((value or {}).items()))
            else:
                out[f] = int(value)
        return escaped(out)

    def json_metrics(self) -> str:
        """The second JSON format: all metrics by symbol, whatever the threshold."""
        out = {}
        for m, value, _ in self._items():
            out[m.symbol] = {"description": m.description, "value": value, "unit": m.unit, "prefixes": m.system[0], "referenceValue": number(m.scale), "levelOfConcern": number(value / m.scale)}
            if oid := self._oid(m):
                out[m.symbol]["objectName"] = oid
                if self.names == "full" and (name := path(oid, m.kind, self.links)):
                    out[m.symbol]["objectDescription"] = name
        return escaped(dict(sorted(out.items())))


def number(x: float) -> float | int:
    return int(x) if x == int(x) and abs(x) < 1e21 else x


def escaped(value: dict) -> str:
    """Indented JSON with the characters <, > and & as escapes."""
    text = json.dumps(value, indent=4, ensure_ascii=False)
    return text.replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e")
