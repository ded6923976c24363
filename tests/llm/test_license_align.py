import random
import re

from fedtab.llm import license_align as la

SF = "/root/testdata/sf0.01"
KNOWN = la.known_templates()
NOTICES = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.",
           "This work is licensed under the GNU General Public License, version 3.", "All rights reserved."]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_increasing_subsequence_is_longest():
    rng = random.Random(1)
    for _ in range(300):
        ys = rng.sample(range(30), rng.randint(0, 12))
        got = la._increasing(list(enumerate(ys)))
        best = lcs(ys, sorted(ys))
        assert len(got) == best and got == sorted(got) and all(a[1] < b[1] for a, b in zip(got, got[1:], strict=False))


def test_alignment_is_a_common_subsequence_near_the_longest():
    rng = random.Random(2)
    for _ in range(200):
        a = [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 40))]
        b = [w for w in a if rng.random() < 0.85] + [rng.choice("qrst") for _ in range(3)]
        pairs = la.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) >= 0.7 * lcs(a, b)
        best = la.longest(a, b)
        assert len(best) == lcs(a, b) and all(a[i] == b[j] for i, j in best)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(best, best[1:], strict=False))


def test_exact_edited_and_foreign_texts():
    rng = random.Random(3)
    filler = " ".join(rng.choice(["the", "of", "zebra", "license", "notice", "rights"]) for _ in range(200))
    for name, texts in la.TEMPLATES.items():
        for plain in texts:
            words = la.WORD.findall(plain.lower())
            found = la.scan(f"{filler}\n// {plain}\n{filler}", KNOWN)
            assert name in [m[0] for m in found], plain
            _, cover, start, end = next(m for m in found if m[0] == name)
            assert cover == 1.0
            if len(words) > 30:
                deciding = la.Template.of(name, plain).deciding
                less = [w for w in plain.split() if rng.random() < 0.95 or deciding & set(la.WORD.findall(w.lower()))]
                less.insert(10, "foreign")
                assert name in [m[0] for m in la.scan(filler + " " + " ".join(less), KNOWN)]
                half = " ".join(plain.split()[:len(words) // 2])
                assert name not in [m[0] for m in la.scan(half, KNOWN)]
    assert la.scan(filler, KNOWN) == []


def covered(words, t):
    """Whether some stretch of a template's span covers enough of it: every stretch, by the plain table."""
    return any(lcs(words[i:i + t.span], t.words) >= t.need for i in range(len(words)))


def test_scan_finds_what_comparing_every_stretch_finds():
    """Edited copies of one wording, in short texts and in long ones full of its own words."""
    rng = random.Random(4)
    vocabulary = [f"q{i}" for i in range(14)]
    seen = [0, 0]
    for _ in range(150):
        plain = [rng.choice(vocabulary) for _ in range(20)]
        t = la.Template.of("x", " ".join(plain))
        copy = [w for w in plain if rng.random() < 0.8]
        for _ in range(rng.randint(0, 8)):
            copy.insert(rng.randrange(len(copy) + 1), rng.choice(["z1x", "z2x", rng.choice(vocabulary)]))
        noise = lambda n: [rng.choice(["z3x"] * 4 + vocabulary[:3]) for _ in range(n)]
        text = noise(rng.choice([0, 5, 60])) + copy + noise(rng.choice([0, 5, 60]))
        got = bool(la.scan(" ".join(text), [t]))
        seen[got] += 1
        assert got == covered(text, t)
    assert min(seen) > 20


def test_a_longer_text_loses_no_copy():
    """A copy with foreign words inside is found alone and within a long run of the template's own words."""
    words = la.WORD.findall(la.TEXTS["MIT"].lower())
    copy = " ".join(w + (" foreign" if i % 3 == 0 else "") for i, w in enumerate(words))
    run = " ".join(random.Random(5).choice(words) for _ in range(3000))
    for text in (copy, f"{run} {copy}", f"{copy} {run}", f"{run} {copy} {run}", f"{'x ' * 5000}{copy}"):
        found = [m for m in la.scan(text, KNOWN) if m[0] == "MIT"]
        assert [m[1] for m in found] == [1.0] or any(text[m[2]:m[3]].count("foreign") > 20 for m in found)


def test_large_gaps_without_anchors_are_aligned_whole():
    """Every word occurs twice, so nothing anchors: the longest common subsequence of 600 x 600 words is found."""
    rng = random.Random(6)
    b = [f"w{i % 300}" for i in range(600)]
    a = [w for w in b if rng.random() < 0.9]
    assert len(la.align(a, b)) == lcs(a, b) == len(a)


def test_repeats_are_found_each():
    text = "x All rights reserved. All rights reserved.\n" + "y " * 50 + la.TEXTS["MIT"] + " " + la.TEXTS["MIT"]
    assert [m[0] for m in la.scan(text, KNOWN)] == ["reserved-notice"] * 2 + ["MIT"] * 2


def test_rows(spark):
    texts = [None, "", "İ All rights reserved.", "z" * 100000, "the license " * 20000, "same All rights reserved", "same All rights reserved"]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, "none", "c")], "doc_id long, text string, matches string")
    out = {r.doc_id: r.matches for r in la.scan_licenses(docs).collect()}
    assert out[0] == out[1] == out[3] == out[4] == out[None] == []
    assert [(m.license, m.start, m.end) for m in out[2]] == [("reserved-notice", 2, 21)] and out[5] == out[6] != []
    assert la.scan_licenses(docs.limit(0)).collect() == []


def test_query_finds_the_notices(spark):
    from fedtab.llm.queries import llm_queries
    out = {r.doc_id: r for r in llm_queries()["op2_license_align"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(out) == len(docs)
    planted = 0
    for d in docs:
        want = [x.strip() for x in re.findall(r"[^\n]+", d.text) if x.strip() in NOTICES]
        planted += len(want)
        assert out[d.doc_id].n_matches >= len(want)
        assert bool(want) == (out[d.doc_id].license is not None)
    assert planted > 10


def test_near_misses_are_their_own_license():
    work = "This work is licensed under the GNU {}General Public License, version {}."
    header = la.TEXTS["GPL-3.0"]
    want = {
        work.format("", "2"): ["GPL-2.0-notice"], work.format("", "3"): ["GPL-3.0-notice"],
        work.format("Lesser ", "3"): ["LGPL-3.0-notice"], work.format("Lesser ", "2.1"): ["LGPL-2.1-notice"],
        work.format("Affero ", "3"): ["AGPL-3.0-notice"],
        "Licensed under CC BY-SA 4.0.": ["CC-BY-SA-4.0-notice"], "Licensed under CC BY-ND 4.0.": ["CC-BY-ND-4.0-notice"],
        "Licensed under CC BY 3.0.": ["CC-BY-3.0-notice"], "Licensed under CC BY 5.0.": [],
        "Licensed under CC BY-NC-SA 4.0.": ["CC-BY-NC-SA-4.0-notice"], "Licensed under CC BY-NC 4.0.": ["CC-BY-NC-4.0-notice"],
        "Licensed under the Mozilla Public License, Version 2.0.": ["MPL-2.0-notice"],
        "Licensed under the Apache License, Version 1.1.": [], "Released under the ISC License.": ["ISC-notice"],
        "Licensed under CC BY-SA 4.0. Licensed under CC BY 4.0.": ["CC-BY-SA-4.0-notice", "CC-BY-4.0-notice"],
        header.replace("GNU General", "GNU Lesser General"): ["LGPL-3.0"],
        header.replace("GNU General", "GNU Affero General"): ["AGPL-3.0"], header.replace("version 3", "version 2"): ["GPL-2.0"],
        la.TEXTS["BSD-3-Clause"]: ["BSD-3-Clause"], la.TEXTS["BSD-2-Clause"]: ["BSD-2-Clause"],
    }
    assert {k: [m[0] for m in la.scan(f"x y. {k} z", KNOWN)] for k in want} == want


def test_usual_ways_of_naming_a_license():
    want = {
        "Licensed under the MIT license": ["MIT"], "SPDX-License-Identifier: MIT": ["MIT"], "Apache-2.0": ["Apache-2.0"],
        "Licensed under GPL-3.0": ["GPL-3.0"], "Released under CC0 1.0 Universal": ["CC0-1.0"],
        "SPDX-License-Identifier: EUPL-1.2": ["EUPL-1.2"], "under the terms of the Eclipse Public License 2.0": ["EPL-2.0"],
        "Distributed under the Boost Software License, Version 1.0.": ["BSL-1.0"], "This is under GPLv3.": ["GPL-3.0"],
        "Released under the MIT and ISC License.": ["ISC", "MIT"], "License: BSD 3-Clause License": ["BSD-3-Clause"],
        "the Creative Commons Attribution-ShareAlike 4.0": ["CC-BY-SA-4.0"], "under Creative Commons Attribution-ShareAlike 4.0": ["CC-BY-SA-4.0"],
        "All rights not reserved.": [], "All your rights are reserved.": [], "All rights are reserved.": ["reserved"],
        "not under the rule of MIT, a License": [], "MIT": [], "the apache of version 2": [], "He studied under the MIT professor": [],
    }
    got = {k: sorted(m[0].removesuffix("-notice") for m in la.scan(f"x y. {k} z", KNOWN)) for k in want}
    assert got == want


def test_notices_equal_a_plain_search():
    """Random short texts of the words of notices: a notice is found where its words stand together in order."""
    rng = random.Random(7)
    wording = {"a-notice": ["under the MIT License"], "b-notice": ["All rights reserved"], "c-notice": ["under CC BY 4.0"]}
    known = la.known_templates(wording, least=1.0)
    pool = "under the mit license all rights reserved cc by 4 0 nc and isc not of are".split()
    hits = 0
    for _ in range(4000):
        words = []
        for w in rng.choice(known).words:
            words += [rng.choice(pool) for _ in range(rng.choice([0, 0, 0, 1]))] + [w] * (rng.random() < 0.95)
        words = [rng.choice(pool) for _ in range(rng.randint(0, 4))] + words + [rng.choice(pool) for _ in range(rng.randint(0, 4))]

        def there(t):
            def go(i, k):
                if k == len(t.words):
                    return True
                for j in range(i, len(words)):
                    if words[j] == t.words[k] and go(j + 1, k + 1):
                        return True
                    if words[j] not in la.CONNECTING:
                        return False
                return False
            return any(words[i] == t.words[0] and go(i + 1, 1) for i in range(len(words)))
        got = {m[0] for m in la.scan(" ".join(words), known)}
        for t in known:
            if there(t):
                hits += 1
                assert t.name in got or len(got) > 0, words
            elif not {"and", "or"} & set(words):
                assert t.name not in got, (t.name, words)
    assert hits > 50
