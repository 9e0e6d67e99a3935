"""The command line: python -m grove.cli [options] [ROOT ...]"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from typing import TextIO

from pyspark.sql import SparkSession

import grove
from grove.functions.references import FLAGS
from grove.operators.refgroups import shown
from grove.plans.progress import Meter
from grove.plans.scan import scan_repository
from grove.sources.git import Repository
from grove.storage import remove_intermediates

#: Names of the settings that stand in for options: fixed.
VERSION, THRESHOLD, NAMES, PROGRESS = "sizer.jsonVersion", "sizer.threshold", "sizer.names", "sizer.progress"

SHA_NAMES = {"none": "none", "hash": "hash", "sha-1": "hash", "sha1": "hash", "full": "full"}


class Rule(argparse.Action):
    """Keeps the selection options in the order in which they are given."""

    def __call__(self, parser, namespace, value, option_string=None):
        namespace.rules = [*(namespace.rules or []), (option_string.lstrip("-"), value if isinstance(value, str) else "true")]


class Level(argparse.Action):
    """--verbose, --no-verbose and --critical as thresholds; --verbose=false is the default one."""

    def __init__(self, *args, const=None, **kw):
        super().__init__(*args, nargs="?", const="true", **kw)
        self.meant = {"verbose": 0.0, "no-verbose": 1.0, "critical": 30.0}

    def __call__(self, parser, namespace, value, option_string=None):
        on = str(value).lower() not in ("false", "0", "f")
        namespace.threshold = self.meant["verbose" if option_string in ("-v", "--verbose") else option_string.lstrip("-")] if on else 1.0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="grove", description="Size statistics of a git repository.", allow_abbrev=False)
    p.add_argument("roots", nargs="*", metavar="ROOT")
    p.add_argument("-C", dest="path", default=".")
    p.add_argument("--threshold", type=float)
    p.add_argument("-v", "--verbose", "--no-verbose", "--critical", action=Level)
    p.add_argument("--names", type=lambda x: SHA_NAMES[x.lower()])
    p.add_argument("-j", "--json", action="store_true")
    p.add_argument("--json-version", type=int)
    p.add_argument("--show-refs", action="store_true")
    p.add_argument("--progress", action=argparse.BooleanOptionalAction)
    p.add_argument("--version", action="version", version=f"grove {grove.__version__}")
    for name in ("include", "exclude", "include-regexp", "exclude-regexp", "refgroup"):
        p.add_argument(f"--{name}", action=Rule, dest="rules")
    for flag in FLAGS:
        p.add_argument(f"--{flag}", f"--no-{flag}", action=Rule, dest="rules", nargs="?", const=True)
    return p


def spelled_out(argv: Sequence[str]) -> list[str]:
    """Flags that may have a value get theirs with an equals sign, so that none takes a ROOT for it."""
    flags = {f"--{no}{name}" for name in FLAGS for no in ("", "no-")} | {"--verbose", "--no-verbose", "--critical"}
    return [f"{a}=true" if a in flags else "--verbose=true" if a == "-v" else a for a in argv]


class Line:
    """Progress on a terminal: counts that rise overwrite one line, and a phase's end stands for good."""

    def __init__(self, out: TextIO):
        self.out, self.width = out, 0

    def rise(self, name: str, count: int) -> None:
        text = f"{name}: {count}"
        self.out.write(f"\r{text:<{self.width}}")
        self.out.flush()
        self.width = len(text)

    def end(self, text: str) -> None:
        self.out.write(f"\r{' ' * self.width}\r{text}\n" if self.width else f"{text}\n")
        self.out.flush()
        self.width = 0


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Settings of the repository hold for options that aren't given."""
    args = parser().parse_intermixed_args(spelled_out(sys.argv[1:] if argv is None else argv))
    repository = Repository.at(args.path)
    version = args.json_version if args.json_version is not None else int(repository.setting(VERSION, "1", "int"))
    if version not in (1, 2):
        print("the JSON version must be 1 or 2", file=sys.stderr)
        return 1
    threshold = args.threshold if args.threshold is not None else float(repository.setting(THRESHOLD, "1"))
    names = args.names or SHA_NAMES[repository.setting(NAMES, "full")]
    progress = args.progress if args.progress is not None else repository.setting(PROGRESS, str(sys.stderr.isatty()).lower(), "bool") == "true"
    given = spark
    spark = given or SparkSession.builder.config("spark.ui.showConsoleProgress", str(progress).lower()).getOrCreate()
    line = Line(sys.stderr) if progress else None
    meter = Meter(spark.sparkContext, line.rise) if line else None
    report, refs = scan_repository(spark, args.path, args.rules or (), args.roots, names, tell=line.end if line else (lambda text: None), meter=meter)
    if args.show_refs:
        print("References (included references marked with '+'):", file=sys.stderr)
        for row in shown(refs.orderBy("ord")).toLocalIterator():
            print(row["line"], file=sys.stderr)
    print((report.json_fields() if version == 1 else report.json_metrics()) if args.json else report.table(threshold), end="" if not args.json else "\n")
    if given is None:
        remove_intermediates(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
