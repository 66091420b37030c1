"""Operator 7: passages of license texts as they stand in files, and plain counting of the base."""

import random
import re

import pytest

PASSAGES = [
    ("Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software", {"mit"}),
    ("  * 3. Neither the name of the copyright holder nor the names of its\n  * contributors may be used to endorse or promote products", {"bsd-3-clause"}),
    ("3. All advertising materials mentioning features or use of this software\n must display the following acknowledgement:", {"bsd-4-clause"}),
    ('distributed under the License is distributed on an "AS IS" BASIS', set()),
    ('Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,', {"apache-2"}),
    ("GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", {"gpl-2-or-later"}),
    ("under the terms of the GNU Affero General Public License", {"agpl"}),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", {"mpl-2"}),
    ("The Software shall be used for Good, not Evil.", {"json"}),
    ("https://creativecommons.org/licenses/by-nc-sa/4.0/", {"cc-by-nc-sa"}),
    ("https://creativecommons.org/licenses/by/4.0/", {"cc-by"}),
    ("Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.", {"zlib"}),
    ("You may not reverse engineer, decompile, or disassemble the product", {"proprietary"}),
    ("No part may not be reproduced or distributed in any form without the prior written permission of the publisher", {"proprietary"}),
    ("Unauthorized copying of this file, via any medium is strictly prohibited", {"proprietary"}),
    ("If we meet some day, and you think this stuff is worth it, you can buy me a beer", {"beerware"}),
    ("Dual licensed under whatever you like", {"dual-license-notice"}),
    ("nothing to see here, just calm prose about rivers", set()),
]


@pytest.mark.parametrize("text, labels", PASSAGES)
def test_passages(spark, text, labels):
    from tessera.llm.licenses import scan_licenses
    r = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    found = {x for x in r["labels"].split(",") if x}
    assert labels <= found and (labels or not r["base_labels"])


def test_base_against_plain_counting(spark):
    from tessera.llm.licenses import BASE, scan_licenses
    rng = random.Random(4)
    parts = ["under the MIT License", "apache license version 2", "CC BY NC", "under", "the", "mit", "license", "cc", "by", "nc", "é", "x_y", "2", "version"]
    rows = [(i, rng.choice(["", " "]).join(rng.choice(parts) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(rng.randint(0, 14)))) for i in range(200)] + [(900, None)]
    got = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, lab) for p, lab in BASE for k in range(len(words)) if words[k:k + len(p.split())] == p.split()]
        r = got[i]
        assert r["n_words"] == len(words) and r["n_base"] == len(places)
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        base = {lab for _, lab in places}
        assert r["base_labels"] == ",".join(sorted(base)) and base <= set(r["labels"].split(","))


def test_every_signature_matches_itself_through_the_prefilter():
    """A signature without alternatives, read as a text, is found."""
    from tessera.llm.licenses import TEXTS, compiled, scan
    table = compiled()
    plain = [(p, label) for p, label, *_ in TEXTS if re.fullmatch(r"[a-z0-9 ]+", p)]
    assert len(TEXTS) > 140 and len(plain) > 70
    for pattern, label in plain:
        assert label in {x[2] for x in scan(pattern.encode(), table)} or any(label in p for p, _ in plain), pattern
