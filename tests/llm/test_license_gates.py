"""Keywords of license rules let every spelling of their patterns through."""

from corpometer.llm import licenses


def test_spellings_pass_the_keywords(spark):
    texts = {
        "Do What The Fuck You Want To Public License": "wtfpl", "The Beer Ware License": "beerware", "the beerware licence": "beerware",
        "licenced under terms": "license-mention", "see the licence": "license-mention", "BigScience OpenRAIL-M": "openrail",
        "a RAIL license": "openrail", "the train left the rail": None,
    }
    got = licenses.scanned(spark.createDataFrame([(t, t) for t in texts], "name string, text string")).collect()
    assert {r.name: next(iter({d.label for d in r.detections}), None) for r in got} == texts


def test_common_spellings(spark):
    texts = {
        "GPL-2.0": "gpl-2", "GPL 3.0": "gpl-3", "GPL-3.0-or-later": "gpl-3-or-later", "GPL-3.0-only": "gpl-3", "GPLv2": "gpl-2", "GPL v2": "gpl-2", "GPL3": "gpl-3",
        "GPLv2 or later": "gpl-2-or-later", "GNU General Public License v3 or any later version": "gpl-3-or-later", "LGPL-2.1": "lgpl-2.1", "LGPLv2.1": "lgpl-2.1",
        "AGPL-3.0": "agpl-3", "MPL v2.0": "mpl-2.0", "MPL-2.0": "mpl-2.0", "Apache License v2.0": "apache-2.0", "Apache License, Version 2.0": "apache-2.0",
        "Apache 2": "apache-2", "Apache-2.0": "apache-2.0", "version 2 of the GNU General Public License": "gpl-2", "v2 of the GNU General Public License": "gpl-2",
        "SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: GPL-2.0-only": "gpl-2", "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2-or-later",
        "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause", "SPDX-License-Identifier: 0BSD": "0bsd", "SPDX-License-Identifier: CC-BY-4.0": "cc-by-4.0",
        "tous droits réservés": "reserved", "tous droits reserves": "reserved", "GPL 23": "gpl", "EPL 2.0": "epl-2.0", "CC0-1.0": "cc0",
    }
    got = licenses.scanned(spark.createDataFrame([(t, t) for t in texts], "name string, text string")).collect()
    found = {r.name: min(((d.level, d.first, d.label) for d in r.detections), default=(0, 0, None))[2] for r in got}
    assert {k: (found[k], v) for k, v in texts.items() if found[k] != v} == {}


def test_fixed_phrases_count_for_the_score(spark):
    rows = [("see the general public license",), ("cc by",), ("nothing",), (None,), ("MIT License",)]
    got = licenses.scanned(spark.createDataFrame(rows, "text string")).collect()
    assert [r.score for r in got[:4]] == [0.7, 0.9, 0.0, 0.0] and got[4].score >= 0.7


def test_columns_of_any_name_are_passed_on(spark):
    names = "n_words base detections score __words __keys __line __found rule label".split()
    df = spark.createDataFrame([("GPLv2 " * 3,)], "text string").selectExpr("*", *[f"'{n}' AS {n}" for n in names])
    row = licenses.scanned(df).first()
    assert (row.n_words, len(row.detections), row.score) == (3, 3, 0.9)
    assert all(row[n] == n for n in names[4:])
