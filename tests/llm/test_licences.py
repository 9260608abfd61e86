import pytest

from netloom.llm.licences import SHARED, TEMPLATES, Matcher, blocks, licence_scan, scan

M = Matcher()
FILL = "Onin anther of tiontiat the of eres ansh thhe a anlyble hahaly anheon anre esheth. "


@pytest.mark.parametrize("name,kind,text", TEMPLATES)
def test_each_template_is_found(name, kind, text):
    for t in (text, FILL * 3 + "\n" + text + "\n" + FILL * 40, text.upper(), text.replace(" ", "  ")):
        found = scan(t, M)
        assert [f["licence"] for f in found] == [name], (t, found)


def test_versions_and_changes():
    names = lambda t: [f["licence"] for f in scan(t, M)]
    assert names("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0"]
    assert names("Licensed under CC BY-NC 4.0.\n" + FILL) == ["CC-BY-NC-4.0"]
    changed = TEMPLATES[2][2].replace("free of charge", "for a fee")
    (f,) = scan(changed, M)
    assert f["licence"] == "MIT" and "-free of charge+for a fee" in f["differences"]
    for t in ("", FILL * 100, "He asked for permission to go home.", "A driving licence was found.", "The copyright of words."):
        assert names(t) == []


def test_all_licences_of_a_block():
    by = lambda name, kind: next(t for n, k, t in TEMPLATES if (n, k) == (name, kind))
    names = lambda t: [f["licence"] for f in scan(t, M)]
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    assert names(f"{mit}\n{apache}") == ["MIT", "Apache-2.0"] and names(f"{apache} {mit}") == ["Apache-2.0", "MIT"]
    assert names(by("MIT", "text") + "\n" + by("ISC", "text")) == ["MIT", "ISC"]
    assert names(by("MIT", "text") + "\n" + apache) == ["MIT", "Apache-2.0"]


@pytest.mark.parametrize("before", [0, 900, 3300, 3500, 5200, 7000, 7900, 11_000, 60_000])
def test_wording_anywhere_in_a_long_block(before):
    speak = "the licence of permission and copyright words "
    for name, kind, text in (TEMPLATES[2], next(t for t in TEMPLATES if t[0] == "BSD-3-Clause" and t[1] == "text")):
        t = (speak * (before // len(speak) + 1))[:before] + " " + text + " " + speak * 300
        assert [f["licence"] for f in scan(t, M) if f["kind"] == "text"] == [name], before
        assert max(len(x) for _, _, x in TEMPLATES) * 1.5 < SHARED


def test_places():
    t = FILL + "\n" + "Released under the MIT License." + "\n" + FILL * 2
    (f,) = scan(t, M)
    assert t[f["start"] : f["start"] + f["length"]] == "Released under the MIT License."
    assert all(0 <= a < b <= len(t) for a, b in blocks(t))


def test_table(spark):
    rows = [(1, None, 3), (2, "", 3), (3, "Released under the MIT License.", 3), (3, "Released under the MIT License.", 3), (None, "All rights reserved.", 3), (4, "licence " * 200_000, 3), (5, "x" * 2_000_000, 3)]
    out = licence_scan(spark.createDataFrame(rows, "doc_id long, text string, found int")).collect()
    assert [(r["doc_id"], r["licences"]) for r in out] == [(1, []), (2, []), (3, ["MIT"]), (3, ["MIT"]), (None, ["Proprietary"]), (4, []), (5, [])]
    assert licence_scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_table_against_plain_search(spark):
    """Texts with whole wordings planted: what is found is what a search for them finds."""
    import random

    r = random.Random(3)
    texts = [t for t in TEMPLATES if t[1] == "text" and not t[0].startswith("BSD")]
    rows = []
    for i in range(80):
        parts = [FILL * r.randint(1, 4) for _ in range(r.randint(1, 3))]
        for _, _, t in r.sample(texts, r.choice([0, 1, 1, 2])):
            parts.insert(r.randrange(len(parts) + 1), t)
        rows.append((i, "\n\n".join(parts)))
    want = {i: sorted({n for n, _, w in texts if w in t}) for i, t in rows}
    out = licence_scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {x["doc_id"]: x["licences"] for x in out} == want
