from __future__ import annotations

from curatrix.llm import licenses
from tests.compare import differences

from .conftest import documents


def test_rules_are_ordered():
    grant, notice, warranty = (licenses.SENTENCES[k][0] for k in ("mit-grant", "mit-notice", "mit-warranty"))
    ids = licenses.sentence_ids(f"{grant}\nUnrelated words here.\n{notice} {warranty}")
    assert licenses.match(ids) == (["MIT"], [0])
    assert licenses.match(["mit-notice", "mit-grant"]) == (["UNKNOWN"], [])
    assert licenses.match(["mit-grant", "mit-notice"]) == (["MIT"], [1])
    assert licenses.match([]) == ([], [])


def _found(text: str) -> list[str]:
    return licenses.match(" ".join(licenses.sentence_ids(text)).split())[0]


def test_all_licences_of_a_text():
    s = {k: v[0] for k, v in licenses.SENTENCES.items()}
    mit, apache = " ".join(s[k] for k in ("mit-grant", "mit-notice", "mit-warranty")), "\n".join(s[k] for k in ("apache2-grant", "apache2-copy", "apache2-warranty"))
    assert _found(f"{apache}\n\n{mit}") == _found(f"{mit}\n{apache}") == ["MIT", "Apache-2.0"]
    bsd = "\n".join(s[k] for k in ("bsd-grant", "bsd-source", "bsd-binary"))
    assert _found(f"All rights reserved.\n{bsd}") == ["BSD-2-Clause"] and _found(f"{bsd}\n{s['bsd-endorse']}\n{s['bsd-warranty']}") == ["BSD-3-Clause"]
    assert _found("All rights reserved.") == ["PROPRIETARY"] and _found("MIT License\n" + mit) == ["MIT"]


def test_names_and_expressions():
    for text, want in {
        "SPDX-License-Identifier: MIT OR Apache-2.0": ["Apache-2.0", "MIT"],
        "# SPDX-License-Identifier: LGPL-2.1-or-later": ["LGPL-2.1-or-later"],
        "Apache License 2.0": ["Apache-2.0"],
        "License: BSD": ["BSD-3-Clause"],
        "Licensed under the GNU Affero General Public License v3.0.": ["AGPL-3.0-only"],
        "Released under the Eclipse Public License 2.0. Thanks.": ["EPL-2.0"],
        "This is free and unencumbered software released into the public domain.": ["Unlicense"],
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.": ["UNKNOWN"],
        "We like the BSD and MIT.": [],
    }.items():
        assert _found(text) == want, text


def test_a_long_text_with_a_wrapped_licence(spark):
    import textwrap

    filler = "\n".join(f"line {i} of permission to fill" for i in range(40_000))
    text = filler + "\n" + textwrap.fill(licenses.SENTENCES["lgpl21-free"][0], 30) + "\n" + filler
    (got,) = licenses.scan(documents(spark, [text])).collect()
    assert (got["licenses"], got["sentences"]) == ("LGPL-2.1-or-later", "lgpl21-free")


def test_wrapped_sentences_are_found(spark):
    import textwrap

    texts = [textwrap.fill(licenses.SENTENCES[k][0], 40) for k in ("apache2-grant", "bsd-source", "gpl-warranty")]
    texts += ["Before. Licensed under CC BY 4.0. After.", "licensed   under; cc by-nc 4.0", "The word licence alone", None, ""]
    got = {r["doc_id"]: r for r in licenses.scan(documents(spark, texts)).collect()}
    assert [got[i]["sentences"] for i in range(3)] == ["apache2-grant", "bsd-source", "gpl-warranty"]
    assert got[0]["licenses"] == "Apache-2.0" and got[2]["licenses"] == "UNKNOWN" and got[3]["licenses"] == "CC-BY-4.0"
    assert got[4]["licenses"] == "CC-BY-NC-4.0"
    assert all(got[i]["licenses"] is None and got[i]["sentences"] == "" for i in (5, 6, 7))


def test_each_known_sentence_is_recognised():
    for name, variants in licenses.SENTENCES.items():
        for v in variants:
            assert name in licenses.sentence_ids(f"Some line\n{v}\nmore"), v


def test_against_sql(spark, tiny, oracle):
    assert not differences(licenses.query(spark, tiny), licenses.ORACLE, oracle)


def test_odd_rows(odd, none):
    got = licenses.scan(odd).collect()
    assert len(got) == odd.count() and all(r["licenses"] is None for r in got)
    assert licenses.scan(none).count() == 0
