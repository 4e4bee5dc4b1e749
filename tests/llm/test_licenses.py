import textwrap

import pytest

from aspectra.llm import licenses


@pytest.fixture(scope="module")
def classifier():
    return licenses.train()


def families(text, classifier):
    return [f for f, _ in classifier.classify(licenses.words_of(text))]


def test_held_out_statements(classifier):
    """Forms that are not templates."""
    cases = {
        "Licensed under CC BY-ND 4.0.": "cc",
        "Released under the MIT License, see the file COPYING.": "mit",
        "It is licensed under the Apache License, Version 2.0, as found at the site.": "apache",
        "This tool is licensed under the GNU General Public License, version 2.": "gpl",
        "This library is under the GNU Lesser General Public License version 3.": "lgpl",
    }
    for text, family in cases.items():
        got = classifier.classify(licenses.words_of(text))
        assert max(got, key=lambda x: x[1])[0] == family, (text, got)
        assert {r[1] for r in licenses.scan(text, classifier)} == {family}


def test_several_families_in_one_statement(classifier):
    text = "Licensed under the MIT License or the Apache License, Version 2.0."
    got = licenses.scan(text, classifier)
    assert {(r[1], r[4]) for r in got} == {("mit", True), ("apache", True)}


def test_no_licence_and_unknown_licence(classifier):
    others = [*licenses.LOOKALIKES, "", "plain words", "The licence of the public house ran out in version of events.", "under the general terms"]
    assert [t for t in others if families(t, classifier)] == []
    assert families("This library is distributed under the terms of the Sample Widget License.", classifier) == ["unknown"]
    got = licenses.scan("Some prose here.\n\nReleased under the Sample Widget License.\n", classifier)
    assert [(r[0], r[1], r[4]) for r in got] == [(1, "unknown", False)]


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_wrapped_notices(classifier, mark):
    """A notice wrapped at 60 columns, with comment marks, is one confirmed statement."""
    for family in ("apache", "gpl", "bsd"):
        template = max(licenses.TEMPLATES[family], key=len)
        lines = textwrap.wrap(template, 60)
        assert len(lines) > 1
        text = "import x\n\n" + "\n".join(mark + line for line in lines) + "\n\ncode"
        got = licenses.scan(text, classifier)
        assert [(r[0], r[1], r[4]) for r in got] == [(1, family, True)], (family, got)
        assert text[got[0][5] : got[0][6]].endswith(lines[-1].split()[-1].strip("."))


def test_scan_places(classifier):
    text = "Intro line.\n\nSome words. Released under the MIT License. More words.\n\nLicensed under CC BY-NC 4.0."
    got = licenses.scan(text, classifier)
    assert [(r[0], r[1], r[4]) for r in got] == [(1, "mit", True), (2, "cc", True)]
    assert [text[r[5] : r[6]] for r in got] == ["Released under the MIT License", "Licensed under CC BY-NC 4.0"]


def test_all_statements_of_a_long_paragraph(classifier):
    """No line break, five thousand words: every statement, once each."""
    notice = "Licensed under the Apache License, Version 2.0. "
    text = "word " * 50 + notice + "word " * 90 + notice + "other " * 5000 + notice
    got = licenses.scan(text, classifier)
    assert [r[1:5:3] for r in got] == [("apache", True)] * 3
    assert [text[r[5] : r[6]] for r in got] == [notice.rstrip(". ")] * 3


def test_windows_passed_over_state_nothing(classifier):
    """The bound is one: a window that is passed over has no class."""
    import random

    rng = random.Random(4)
    pool = [w for t in (*licenses.LOOKALIKES, *(x for v in licenses.TEMPLATES.values() for x in v)) for w in licenses.words_of(t)]
    for _ in range(60):
        words = [rng.choice(pool) if rng.random() < 0.6 else "zz" for _ in range(300)]
        kept = set(classifier.windows(words))
        for at in range(0, 270, licenses.STRIDE):
            if at not in kept:
                assert classifier.classify(words[at : at + licenses.WINDOW]) == []


def test_columns(spark):
    rows = [(1, "Released under the MIT License.", 1), (1, "Released under the MIT License.", 1), (2, None, 2), (None, "Licensed under CC BY-NC 4.0.", 3), (3, "", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, family int")
    got = licenses.scan_licenses(df).collect()
    assert sorted((str(r.id), r.family) for r in got) == [("1", "mit"), ("1", "mit"), ("None", "cc")]
    assert licenses.scan_licenses(df.limit(0)).count() == 0
