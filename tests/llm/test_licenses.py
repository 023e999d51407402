import re
from pathlib import Path

import pytest

from loadlens.llm import licenses

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    "Released under the MIT License. Apache-License x cc-by cc  by-nc 4.0",
    "GNU General\nPublic License v3 and GNU Lesser General Public License, éMIT License mit licenses",
    "SPDX-License-Identifier: GPL",
    "mit license mit license MIT\tLICENSE. " * 30,
    "nothing to see", "", None, "cc", "license", "Copyright (c) 2020 X. All rights reserved.",
    "x " * 3000 + "gnu general public license",
]


def brute(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words, places = WORDS.findall(lowered), []
    for phrase, label in licenses.PHRASES.items():
        own = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    first, last = (min(places)[0], max(places)[0]) if places else (None, None)
    return len(words), len(places), first, last, ",".join(sorted({x for _, x in places}))


def test_base_against_brute_force(documents):
    docs = documents(TEXTS).withColumnRenamed("lang", "labels")
    rows = sorted(licenses.license_labels(docs, ["doc_id"]).collect())
    for row, text in zip(rows, TEXTS):
        assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == brute(text)
        assert set(filter(None, row.base_labels.split(","))) <= set(filter(None, row.labels.split(",")))
        assert 0 <= row.score <= 1 and (row.score > 0) == bool(row.labels)
    assert licenses.license_labels(documents([]), ["doc_id"]).count() == 0


def test_suppression_and_priority(documents):
    (row,) = licenses.license_labels(documents(["Licensed under the GNU Lesser General Public License."]), ["doc_id"]).collect()
    assert row.labels == "gpl,lgpl" or row.labels == "lgpl"
    assert [(d.label, d.start, d.end) for d in row.detections] == [("lgpl", 0, 8)]
    (row,) = licenses.license_labels(documents(["Licensed under CC BY-NC 4.0."]), ["doc_id"]).collect()
    assert (row.base_labels, row.labels) == ("cc-by", "cc-by,cc-by-nc")


def test_rules_are_many_and_short_enough():
    rules = licenses.signature_rules()
    assert len(rules) > 200
    for rule in rules:
        assert rule.pattern.count(" ") < licenses.REACH
        assert " " not in rule.keyword


@pytest.mark.parametrize("text", ["redistribution and use in source and binary forms", "dedicated to the public domain"])
def test_notices(documents, text):
    (row,) = licenses.license_labels(documents([text]), ["doc_id"]).collect()
    assert row.labels and row.n_base == 0


SHORT = {
    "SPDX-License-Identifier: MIT": "mit",
    "// SPDX-License-Identifier: Apache-2.0": "apache",
    "SPDX-License-Identifier: BSD-3-Clause": "bsd",
    "SPDX-License-Identifier: MPL-2.0": "mpl",
    "SPDX-License-Identifier: ISC": "isc",
    "SPDX-License-Identifier: GPL-2.0-only": "gpl",
    "SPDX-License-Identifier: LGPL-2.1-or-later": "lgpl",
    "SPDX-License-Identifier: AGPL-3.0": "agpl",
    "SPDX-License-Identifier: EPL-2.0": "epl",
    "SPDX-License-Identifier: EUPL-1.2": "eupl",
    "SPDX-License-Identifier: CDDL-1.0": "cddl",
    "SPDX-License-Identifier: CPL-1.0": "cpl",
    "SPDX-License-Identifier: Artistic-2.0": "artistic",
    "SPDX-License-Identifier: Zlib": "zlib",
    "SPDX-License-Identifier: BSL-1.0": "boost",
    "SPDX-License-Identifier: WTFPL": "wtfpl",
    "SPDX-License-Identifier: Unlicense": "unlicense",
    "SPDX-License-Identifier: OFL-1.1": "ofl",
    "SPDX-License-Identifier: PostgreSQL": "postgresql",
    "SPDX-License-Identifier: PSF-2.0": "python",
    "SPDX-License-Identifier: OpenSSL": "openssl",
    "SPDX-License-Identifier: ODbL-1.0": "odbl",
    "SPDX-License-Identifier: ODC-By-1.0": "odc-by",
    "SPDX-License-Identifier: MS-PL": "ms-pl",
    "SPDX-License-Identifier: GFDL-1.3-only": "gfdl",
    "SPDX-License-Identifier: CC0-1.0": "cc0",
    "SPDX-License-Identifier: CC-BY-NC-SA-4.0": "cc-by,cc-by-nc-sa",
    "SPDX-License-Identifier: (MIT OR Apache-2.0)": "apache,mit",
    "SPDX-License-Identifier: Apache-2.0 OR MIT": "apache,mit",
    "SPDX-License-Identifier: MIT OR ISC": "isc,mit",
    "licensed under the MIT": "mit",
    "It is under the MIT.": "mit",
    "Apache 2.0": "apache",
    "dual MIT/Apache-2.0": "apache,mit",
    "AGPL-3.0": "agpl",
    "LGPL-2.1": "lgpl",
    "GPLv3": "gpl",
    "3-clause BSD": "bsd",
    "license: MIT": "mit",
    "Users interacting with it remotely through a computer network": "agpl",
    "Reserved Font Name Foo": "ofl",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed": "apache",
    "wir gehen mit dem Hund und mit Apache 2.4.1, under the MIT roof, and limits": "",
}


def test_ids_short_names_and_sentences(documents):
    rows = sorted(licenses.license_labels(documents(list(SHORT)), ["doc_id"]).collect())
    assert {t: r.labels for t, r in zip(SHORT, rows)} == SHORT


def test_readme_tells_the_signatures():
    """Forms around a name find no text that the name doesn't."""
    names, sentences = len(licenses.FAMILIES), len(licenses.NOTICES)
    ids = len(licenses.IDS) + len(licenses.ID_FORMS) * sum(bool(k) for _, k, _ in licenses.IDS)
    readme = (Path(__file__).parents[2] / "README.md").read_text()
    assert f"{names + ids + sentences} signatures" in readme
