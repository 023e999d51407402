"""License detection by ordered signature rules behind a keyword prefilter."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loadlens.llm.batches import blocks, lower_bytes, plain_words, word_spans

# Phrases whose places are counted, with the label each gives.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Families: label, keyword (part of one word) that must occur in the lower-cased text, name
# as a regex.
# A name and a rule are written over words that single spaces part.
FAMILIES = [
    ("agpl", "affero", "(?:gnu )?affero general public licen[sc]e"),
    ("lgpl", "lesser", "(?:gnu )?lesser general public licen[sc]e"),
    ("lgpl", "licen", "(?:gnu )?library general public licen[sc]e"),
    ("gpl", "licen", "(?:gnu )?general public licen[sc]e"),
    ("agpl", "agpl", "(?:gnu )?agpl(?:v?[0-9]+)?"),
    ("agpl", "affero", "(?:gnu )?affero gpl(?:v?[0-9]+)?"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl(?:v?[0-9]+)?"),
    ("lgpl", "lesser", "(?:gnu )?lesser gpl(?:v?[0-9]+)?"),
    ("gpl", "gpl", "(?:gnu )?gpl(?:v?[0-9]+)?"),
    ("gfdl", "documentation", "(?:gnu )?free documentation licen[sc]e"),
    ("apache", "apache", "apache(?: software)? licen[sc]e"),
    ("mit", "licen", "mit(?: x11| expat)? licen[sc]e"),
    ("mit", "expat", "expat licen[sc]e"),
    ("bsd", "bsd", "(?:new |modified |simplified |revised )?bsd(?: [0-9] clause)? licen[sc]e"),
    ("isc", "licen", "isc licen[sc]e"),
    ("mpl", "mozilla", "mozilla public licen[sc]e"),
    ("epl", "eclipse", "eclipse public licen[sc]e"),
    ("edl", "eclipse", "eclipse distribution licen[sc]e"),
    ("cddl", "development", "common development and distribution licen[sc]e"),
    ("cpl", "licen", "common public licen[sc]e"),
    ("eupl", "european", "european union public licen[sc]e"),
    ("artistic", "artistic", "artistic licen[sc]e"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[sc]e"),
    ("boost", "boost", "boost software licen[sc]e"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("unlicense", "unlicen", "unlicen[sc]e"),
    ("ofl", "font", "(?:sil )?open font licen[sc]e"),
    ("postgresql", "postgresql", "postgresql licen[sc]e"),
    ("python", "python", "python software foundation licen[sc]e"),
    ("openssl", "openssl", "openssl licen[sc]e"),
    ("odbl", "database", "open database licen[sc]e"),
    ("odc-by", "commons", "open data commons attribution licen[sc]e"),
    ("ms-pl", "microsoft", "microsoft public licen[sc]e"),
    ("cc0", "cc0", "cc0"),
    ("cc-by-nc-sa", "cc", "cc by nc sa"),
    ("cc-by-nc-nd", "cc", "cc by nc nd"),
    ("cc-by-nc", "cc", "cc by nc"),
    ("cc-by-sa", "cc", "cc by sa"),
    ("cc-by-nd", "cc", "cc by nd"),
    ("cc-by", "cc", "cc by"),
    ("cc-by-nc-sa", "commons", "creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "commons", "creative commons attribution non ?commercial no ?deriv[a-z]*"),
    ("cc-by-nc", "commons", "creative commons attribution non ?commercial"),
    ("cc-by-sa", "commons", "creative commons attribution share ?alike"),
    ("cc-by-nd", "commons", "creative commons attribution no ?deriv[a-z]*"),
    ("cc-by", "commons", "creative commons attribution"),
]

# Ids and short names that name a license wherever they stand.
FAMILIES += [
    ("gfdl", "gfdl", "(?:gnu )?gfdl"),
    ("apache", "apache", "apache (?:version |v ?)?2 0(?! [0-9])"),
    ("bsd", "bsd", "(?:bsd [0-4] clause|(?:[0-4]|two|three|four) clause bsd|0bsd)"),
    ("mpl", "mpl", "mpl ?(?:version |v ?)?(?:1 [01]|2(?: 0)?)"),
    ("epl", "epl", "epl ?(?:version |v ?)?[12] 0"),
    ("cddl", "cddl", "cddl"),
    ("cpl", "cpl", "cpl (?:version |v ?)?1 0"),
    ("eupl", "eupl", "eupl"),
    ("artistic", "artistic", "artistic [12] 0"),
    ("boost", "bsl", "bsl 1 0"),
    ("ofl", "ofl", "(?:sil )?ofl 1 [01]"),
    ("odbl", "odbl", "odbl"),
    ("odc-by", "odc", "odc by"),
]

# Ids that are words of other meaning: label, keyword of the id by itself, id. They count in an
# SPDX line, after `under` or `license`, before `licensed`, and beside another id in an
# expression; without a keyword in an SPDX line alone.
IDS = [
    ("mit", "mit", "mit"),
    ("isc", "isc", "isc"),
    ("bsd", "bsd", "bsd"),
    ("zlib", "zlib", "zlib"),
    ("x11", "x11", "x11"),
    ("postgresql", "", "postgresql"),
    ("openssl", "", "openssl"),
    ("python", "", "(?:psf|python) 2 0"),
    ("apache", "", "apache 1 [01]"),
    ("edl", "", "edl 1 0"),
    ("ms-pl", "", "ms pl"),
    ("ms-rl", "", "ms rl"),
    ("ncsa", "", "ncsa"),
    ("curl", "", "curl"),
    ("icu", "", "icu"),
    ("ruby", "", "ruby"),
    ("vim", "", "vim"),
    ("w3c", "", "w3c"),
    ("php", "", "php 3 0[0-9]?"),
    ("hpnd", "", "hpnd"),
    ("libpng", "", "libpng(?: 2 0)?"),
    ("unicode", "", "unicode (?:3 0|dfs 201[56])"),
    ("blueoak", "", "blueoak 1 0 0"),
    ("upl", "", "upl 1 0"),
    ("afl", "", "afl [0-9] [0-9]"),
    ("osl", "", "osl [0-9] [0-9]"),
    ("ecl", "", "ecl [0-9] 0"),
    ("sspl", "", "sspl 1 0"),
    ("busl", "", "busl 1 1"),
    ("cecill", "", "cecill [0-9bc]"),
    ("mulanpsl", "", "mulanpsl [0-9] 0"),
]
AN_ID = (
    "(?:mit|isc|bsd|0bsd|zlib|x11|unlicense|(?:a|l)?gpl(?:v?[0-9]+)?|apache 2 0|bsd [0-4] clause|"
    "mpl 2 0|epl [12] 0|cddl|cc0|bsl 1 0)(?![^ ])"
)
# Looks back only, so it adds no words to a match.
AFTER_AN_ID = "|".join(
    rf"(?<=\b{end}\s{operator}\s)"
    for end in ("[01]", "(?:mit|isc|bsd)", "(?:only|zlib)", "(?:later|gplv[23])", "clause", "(?:exception|unlicense)")
    for operator in ("or", "and")
)
# What follows `under the MIT` where it is not about a license.
NOT_OWN = "(?! (?:umbrella|roof|name|banner|logo|brand|press|professors?|deans?|president|programs?|programme|auspices|labels?|domes?|campus|tracks?))"
ID_FORMS = [
    (1, 0.95, "(?:licen[sc]ed|released|distributed|available|published|provided|covered) under (?:the |an? )?(?:terms of (?:the )?)?{name}{not_own}"),
    (2, 0.8, "under (?:the |an? )?(?:terms of (?:the )?)?{name}{not_own}"),
    (2, 0.85, "{name} licen[sc]ed"),
    (2, 0.85, "licen[sc]es?(?: is| type)? {name}"),
    (2, 0.85, "{name}(?= (?:or|and) {an_id})"),
    (2, 0.85, "{name}(?= apache 2 0)"),
    (2, 0.85, "(?:{after}){name}"),
]

# How a license is named, from most to least telling: priority, score, form around the name.
FORMS = [
    (0, 1.0, "spdx licen[sc]e identifier {name}"),
    (1, 0.95, "(?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?{name}"),
    (2, 0.9, "{name} (?:version |v ?)?[0-9]+(?: [0-9]+){{0,3}}"),
    (3, 0.85, "subject to (?:the )?(?:terms of (?:the )?)?{name}"),
    (4, 0.8, "(?:under|see) (?:the )?{name}"),
    (5, 0.6, "{name}"),
]

# Single signatures that name no license text: label, keyword, priority, score, pattern.
NOTICES = [
    ("all-rights-reserved", "reserved", 1, 0.9, "all rights reserved"),
    ("public-domain", "domain", 1, 0.9, "(?:dedicated to|released into|in) the public domain"),
    ("proprietary", "proprietary", 2, 0.7, "proprietary and confidential"),
    ("mit", "hereby", 0, 1.0, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission", 0, 0.9, "permission to use copy modify and or distribute this software"),
    ("bsd", "redistribution", 0, 1.0, "redistribution and use in source and binary forms"),
    ("copyright", "copyright", 3, 0.5, "copyright (?:c )?(?:19|20)[0-9]{{2}}"),
    # Sentences of the licenses themselves.
    ("apache", "applicable", 0, 0.95, "unless required by applicable law or agreed to in writing software distributed under the license is distributed"),
    ("apache", "contributor", 0, 1.0, "subject to the terms and conditions of this license each contributor hereby grants to you"),
    ("gpl", "freedom", 0, 0.9, "designed to take away your freedom to share and change"),
    ("lgpl", "derivative", 0, 1.0, "a program that contains no derivative of any portion of the library but is designed to work with the library"),
    ("agpl", "remotely", 0, 1.0, "users interacting with it remotely through a computer network"),
    ("mit", "permission", 0, 0.9, "the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("bsd", "endorse", 0, 0.95, "(?:names of its|its) contributors may be used to endorse or promote products"),
    ("mpl", "licen", 0, 1.0, "covered software is provided under this license on an as is basis"),
    ("zlib", "misrepresented", 0, 1.0, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("boost", "hereby", 0, 1.0, "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("unlicense", "unencumbered", 0, 1.0, "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck", 0, 0.9, "you just do what the fuck you want to"),
    ("ofl", "font", 0, 0.9, "reserved font names?"),
    ("cc0", "dedicated", 0, 0.9, "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("artistic", "package", 0, 0.95, "the intent of this document is to state the conditions under which a package may be copied"),
    ("python", "psf", 0, 1.0, "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("openssl", "openssl", 0, 0.8, "this product includes software developed by the openssl project"),
    ("postgresql", "permission", 0, 0.95, "distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("gfdl", "invariant", 0, 0.95, "with no invariant sections no front cover texts and no back cover texts"),
]

# No rule matches more words than this; rules run on this many words on each side of the words
# that hold a gating keyword, which therefore covers all they could find in the text.
REACH = 24


@dataclass(frozen=True)
class Rule:
    """One signature; rules are tried, and win, in their order."""

    label: str
    keyword: str
    priority: int
    score: float
    pattern: str

    def compiled(self) -> re.Pattern:
        return re.compile(f"(?<![^ ])(?:{self.pattern})(?![^ ])")


def signature_rules() -> list[Rule]:
    """All rules, most telling first; a longer name comes before one inside it."""
    rules = [
        Rule(label, keyword, priority, score, form.format(name=f"(?:{name})"))
        for label, keyword, name in FAMILIES
        for priority, score, form in FORMS
    ]
    rules += [
        Rule(label, "spdx", 0, 1.0, f"spdx licen[sc]e identifier {name}") for label, _, name in IDS
    ]
    told = {"not_own": NOT_OWN, "an_id": AN_ID, "after": AFTER_AN_ID}
    rules += [
        Rule(label, keyword, priority, score, form.format(name=name, **told))
        for label, keyword, name in IDS
        if keyword
        for priority, score, form in ID_FORMS
    ]
    rules += [Rule(a, b, c, d, e.format()) for a, b, c, d, e in NOTICES]
    return sorted(rules, key=lambda r: r.priority)


class Scanner:
    """Finds detections in one lower-cased text."""

    def __init__(self) -> None:
        self.rules = signature_rules()
        self.patterns: dict[int, re.Pattern] = {}
        self.by_keyword: dict[bytes, list[int]] = {}
        for i, rule in enumerate(self.rules):
            self.by_keyword.setdefault(rule.keyword.encode(), []).append(i)
        self.phrases = [
            (label, re.compile(f"(?<![^ ]){phrase}(?![^ ])")) for phrase, label in PHRASES.items()
        ]

    def gate(self, lowered: bytes, offsets: np.ndarray) -> dict[int, set[int]]:
        """Rules whose keyword occurs, for the texts (cut by `offsets`) that have any."""
        rules: dict[int, set[int]] = {}
        for keyword, own in self.by_keyword.items():
            at = lowered.find(keyword)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, side="right")) - 1
                stop = int(offsets[row + 1])
                if at + len(keyword) <= stop:  # else it reaches into the next text
                    rules.setdefault(row, set()).update(own)
                    at = lowered.find(keyword, stop)
                else:
                    at = lowered.find(keyword, at + 1)
        return rules

    def stretches(self, words: list[str], rules: set[int]) -> list[tuple[int, str, list[int]]]:
        """The words around gating keywords: position of the first, their text, starts in it."""
        keys = {self.rules[i].keyword for i in rules}
        spans: list[list[int]] = []
        for i, word in enumerate(words):
            if any(key in word for key in keys):
                if spans and i - REACH <= spans[-1][1]:
                    spans[-1][1] = min(len(words), i + REACH + 1)
                else:
                    spans.append([max(0, i - REACH), min(len(words), i + REACH + 1)])
        found = []
        for begin, end in spans:
            starts = [0, *accumulate(len(w) + 1 for w in words[begin:end])]
            found.append((begin, " ".join(words[begin:end]), starts))
        return found

    def matches(self, pattern: re.Pattern, stretches: list) -> list[tuple[int, int]]:
        """First word and end word of all matches."""
        return [
            (begin + bisect_left(starts, m.start()), begin + bisect_left(starts, m.end()))
            for begin, text, starts in stretches
            for m in pattern.finditer(text)
        ]

    def detections(self, stretches: list, rules: set[int]) -> list[tuple[int, int, Rule]]:
        """What stays of the gated rules' matches.

        Matches are taken by priority, then length, then rule; one that lies inside a match
        taken before is suppressed, and so is one around a match of the same label.
        """
        found = []
        for i in rules:
            if i not in self.patterns:
                self.patterns[i] = self.rules[i].compiled()
            for start, end in self.matches(self.patterns[i], stretches):
                found.append((self.rules[i].priority, start - end, i, start, end))
        kept: list[tuple[int, int, Rule]] = []
        over: dict[int, list[tuple[int, int, Rule]]] = {}  # kept matches by word
        for _, _, i, start, end in sorted(found):
            label = self.rules[i].label
            near = [k for word in range(start, end) for k in over.get(word, ())]
            if not any(
                (a <= start and end <= b) or (start <= a and b <= end and k.label == label)
                for a, b, k in near
            ):
                kept.append((start, end, self.rules[i]))
                for word in range(start, end):
                    over.setdefault(word, []).append(kept[-1])
        return kept


ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField(
            "detections",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("start", T.LongType()),
                        T.StructField("end", T.LongType()),
                        T.StructField("label", T.StringType()),
                        T.StructField("score", T.DoubleType()),
                    ]
                )
            ),
        ),
    ]
)


NOTHING = (0, None, None, "", "", 0.0, [])


def _row(scanner: Scanner, words: list[str], rules: set[int]) -> tuple:
    """Results of one text in whose words some keyword occurs."""
    stretches = scanner.stretches(words, rules)
    places = [
        (start, label)
        for label, pattern in scanner.phrases
        for start, _ in scanner.matches(pattern, stretches)
    ]
    kept = scanner.detections(stretches, rules)
    base = sorted({label for _, label in places})
    labels = sorted({*base, *(rule.label for *_, rule in kept)})
    score = max([rule.score for *_, rule in kept], default=0.6 if places else 0.0)
    spans = [
        {"start": a, "end": b, "label": rule.label, "score": rule.score}
        for a, b, rule in sorted(kept, key=lambda k: k[:2])
    ]
    first, last = (min(places)[0], max(places)[0]) if places else (None, None)
    return len(places), first, last, ",".join(base), ",".join(labels), score, spans


def license_labels(documents: DataFrame, keep: list[str], *, text: str = "text") -> DataFrame:
    """Add license detections of whole texts.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. Every rule has a
    keyword; only rules whose keyword occurs in the text run. Added: n_words; n_base, the
    places where the words of a phrase of `PHRASES` stand in a row, with first_word and
    last_word (smallest and largest start, null without any); base_labels; labels (these and
    the rules' own, sorted); score of the best detection, 0 to 1; and detections with the
    positions of their words (start, end) in order.

    Null and empty texts have no words, empty labels, score 0 and no detections. Each row
    stands for itself; input columns with names of results are replaced.
    """
    keep = [c for c in keep if c not in ADDED.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, word_class, lower = Scanner(), plain_words(), lower_bytes()
        for batch in batches:
            n_words: list[int] = []
            rows: list[tuple] = []
            for first, end, data, offsets in blocks(batch.column(text)):
                starts, ends, bounds = word_spans(data, offsets, word_class)
                n_words += np.diff(bounds).tolist()
                lowered = lower[data].tobytes()
                own = [NOTHING] * (end - first)
                for k, rules in scanner.gate(lowered, offsets).items():
                    cuts = range(bounds[k], bounds[k + 1])
                    words = [lowered[starts[i] : ends[i]].decode("utf-8", "replace") for i in cuts]
                    own[k] = _row(scanner, words, rules)
                rows += own
            added = [n_words, *(list(x) for x in zip(*rows))] if rows else [[] for _ in ADDED]
            arrays = [
                pa.array(values, field)
                for values, field in zip(added, _arrow_types())
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), *arrays], names=[*keep, *ADDED.names]
            )

    fields = {f.name: f for f in documents.schema}
    schema = T.StructType([*(fields[c] for c in keep), *ADDED.fields])
    return documents.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def _arrow_types() -> list[pa.DataType]:
    span = pa.struct(
        [("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("score", pa.float64())]
    )
    whole, string = pa.int64(), pa.string()
    return [whole, whole, whole, whole, string, string, pa.float64(), pa.list_(span)]
