"""License scans: exact seeds of short notices locate candidates, bounded-error matching verifies them."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, map_rows

#: Base phrases, whose every place counts, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Short notices in normal form (lower case, words joined by one blank) and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nd 4 0": "cc-by-nd",
    "creative commons attribution 4 0 international license": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    "creative commons attribution noncommercial noderivatives": "cc-by-nc-nd",
    "cc by nc sa 4 0": "cc-by-nc-sa",
    "under cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd 4 0": "cc-by-nc-nd",
    "under cc by nc nd": "cc-by-nc-nd",
    "licensed under the gnu general public license": "gpl",
    "under the terms of the gnu general public license": "gpl",
    "licensed under the gnu general public license version 2": "gpl-2",
    "licensed under the gnu general public license version 3": "gpl-3",
    "under the terms of the gnu lesser general public license": "lgpl",
    "under the terms of the gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "under the bsd license": "bsd",
    "bsd 2 clause license": "bsd",
    "bsd 3 clause license": "bsd",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "under the terms of the eclipse public license": "epl",
}


def edits(notice: str, rate: float) -> int:
    return int(len(notice) * rate)


def seeds_of(notice: str, k: int) -> list[tuple[str, int]]:
    """k + 1 pieces of the notice with their offsets: k edits leave at least one of them as it is."""
    cuts = [round(i * len(notice) / (k + 1)) for i in range(k + 2)]
    return [(notice[a:b], a) for a, b in zip(cuts, cuts[1:])]


Find = tuple[int, int, str, int]


class NoticeSearch:
    """Fuzzy search for notices in normalised text, within `rate` edits a character."""

    def __init__(self, notices: dict[str, str] = NOTICES, rate: float = 0.08):
        self.notices = [(n, label, edits(n, rate)) for n, label in notices.items()]
        self.exact = [regex.compile(r"(?b)(?<![^ ])(?:" + regex.escape(n, literal_spaces=True) + rf"){{e<={k}}}(?![^ ])") for n, _, k in self.notices]
        #: For each notice the longer ones that contain it.
        self.wider = [[i for i, (n, _, _) in enumerate(self.notices) if m in n and m != n] for m, _, _ in self.notices]
        by_seed = defaultdict(list)
        for i, (n, _, k) in enumerate(self.notices):
            for seed, at in seeds_of(n, k):
                by_seed[seed].append((i, at))
        self.seeds = ahocorasick.Automaton()
        for seed, where in by_seed.items():
            self.seeds.add_word(seed, (len(seed), where))
        self.seeds.make_automaton()

    def finds(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice's number, edits) of every verified candidate; each place that a seed points to is verified by itself, so that a better match near by hides none."""
        places = defaultdict(set)
        for end, (length, where) in self.seeds.iter(text):
            for i, at in where:
                places[i].add(end + 1 - length - at)
        found, seen = set(), {}
        for i, starts in places.items():
            n, _, k = self.notices[i]
            last = None
            for start in sorted(starts):
                if last is not None and start - last <= k // 2:
                    continue
                last = start
                a, b = max(0, start - k - 1), min(len(text), start + len(n) + 3 * k + 1)
                key = (i, text[a:b], a == 0, b == len(text))
                if key not in seen:
                    m = self.exact[i].search(text[a:b], 0 if a == 0 else 1)
                    inside = m and m.end() > m.start() and (m.end() < b - a or b == len(text))
                    seen[key] = (m.start(), m.end(), sum(m.fuzzy_counts)) if inside else None
                if hit := seen[key]:
                    found.add((a + hit[0], a + hit[1], i, hit[2]))
        return sorted(found)

    def find(self, text: str) -> list[Find]:
        """(start, end, label, edits) in the normalised text, disjoint. Of overlapping finds, a longer notice that contains another one comes first, then the one with the fewest edits, then the longest."""
        found, kept, of_notice = self.finds(text), [], defaultdict(list)
        for f in found:
            of_notice[f[2]].append(f)
        order = [f for f in found if not any(self._around(of_notice[i], f) for i in self.wider[f[2]] if i in of_notice)]
        order.sort(key=lambda f: (f[3], f[0] - f[1], f[0]))
        for f in order:
            at = bisect_left(kept, f)
            if not (at < len(kept) and kept[at][0] < f[1] or at and f[0] < kept[at - 1][1]):
                kept.insert(at, f)
        return [(a, b, self.notices[i][1], e) for a, b, i, e in kept]

    @staticmethod
    def _around(finds: list[tuple[int, int, int, int]], f: tuple[int, int, int, int]) -> list[tuple[int, int, int, int]]:
        """Those of a notice's finds, sorted, that overlap f; of one notice only neighbours do."""
        at = bisect_left(finds, f)
        return [g for g in finds[max(0, at - 2) : at + 2] if g[0] < f[1] and f[0] < g[1]]


def phrase_places(text: str) -> list[tuple[int, str]]:
    """(character, label) of every place of a base phrase in the normalised text."""
    padded, places = f" {text} ", []
    for phrase, label in PHRASES.items():
        at = padded.find(f" {phrase} ")
        while at >= 0:
            places.append((at, label))
            at = padded.find(f" {phrase} ", at + 1)
    return sorted(places)


SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "notices array<struct<first_word:int,n_words:int,label:string,edits:int>>"
)


def scan_licenses(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, the base places, and the notices found with their word spans and edits.

    One row per row, in one pass without a shuffle. score is 1 for an exact
    place, else 1 less the share of edited characters of the best notice, 0
    without any. A null or empty text has no words and no labels; repeated
    rows are scanned one by one; an empty table gives no rows.
    """

    def setup():
        search = NoticeSearch()

        def row(text):
            words = (text or "").encode().translate(ALNUM).split()
            plain = b" ".join(words).decode()
            base, fuzzy = phrase_places(plain), search.find(plain)
            at = [plain.count(" ", 0, c) for c in {base[0][0], base[-1][0]}] if base else []
            labels = {label for _, label in base}
            found, word, place = [], 0, 0
            for a, b, label, e in fuzzy:
                word, place = word + plain.count(" ", place, a), a
                found.append({"first_word": word, "n_words": plain.count(" ", a, b) + 1, "label": label, "edits": e})
            score = 1.0 if base else max((1 - e / (b - a) for a, b, _, e in fuzzy), default=0.0)
            return len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {f[2] for f in fuzzy})), score, found

        return row

    return map_rows(docs, [text_col], keep, SCHEMA, setup)


def notices_as_text(found: DataFrame) -> DataFrame:
    """notices as label:first_word:n_words:edits, comma-joined by place."""
    return found.withColumn("notices", F.array_join(F.transform("notices", lambda n: F.concat_ws(":", n["label"], n["first_word"], n["n_words"], n["edits"])), ","))
