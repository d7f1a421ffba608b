"""Licence notices that fill no single line: wrapped, embedded and whole licences."""

import re

import pytest
from pyspark.sql import functions as F

from sparkdr.llm import license_scan, license_templates

NOTICES = dict(license_templates.TEMPLATES)
FULL = dict(license_templates.FULL_TEXTS)


def wrapped(text, width, prefix=""):
    lines, line = [], ""
    for word in text.split():
        if line and len(line) + len(word) >= width:
            lines.append(line)
            line = ""
        line = f"{line} {word}".strip()
    return "\n".join(prefix + x for x in [*lines, line])


CODE = "\nimport os\n\ndef main(argv):\n    return os.path.join(*argv)\n\nfor number in range(12):\n    total = number * number + offset\n    print(total, file=stream)\n    rows.append(read_next(handle, limit=64))\nprint(main(rows), len(rows))\n"
HEADER = wrapped(NOTICES["GPL-3.0 notice"], 76, "# ")
CASES = {
    "wrapped header": (HEADER + "\n" + CODE, 1, "GPL-3.0 notice"),
    "embedded": ("We wrote this parser last winter. Released under the MIT License. It reads many odd formats quickly.", 1, "MIT line"),
    "two notices": (HEADER + CODE + CODE + wrapped(NOTICES["MPL-2.0 notice"], 60, " * ") + CODE, 2, None),
    "full MIT": ("MIT License\n\nCopyright (c) 2020 Jane Roe and others\n\n" + FULL["MIT text"], 1, "MIT text"),
    "full Apache": ("Our project\n" + FULL["Apache-2.0 text"] + CODE, None, None),
    "line as before": ("Some prose.\nReleased under the MIT License.\nMore prose.", 1, "MIT line"),
    "none": ("The terms of the license are under discussion without any software. " * 30, 0, None),
    "empty": (None, 0, None),
}


@pytest.fixture(scope="module")
def summary(spark):
    rows = [(i, text) for i, (text, _, _) in enumerate(CASES.values())]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string")
    out = license_scan.summarize(docs).collect()
    assert len(out) == len(rows) + 1
    return {name: [r for r in out if r.doc_id == i] for i, name in enumerate(CASES)}


@pytest.mark.parametrize("name", CASES)
def test_notices_beyond_a_line(summary, name):
    _, n, licence = CASES[name]
    for row in summary[name]:
        assert row.n_matches == n if n is not None else row.n_matches > 0
        assert licence is None or row.license == licence
        assert row.dice is None if n == 0 else row.dice >= 0.8


def best_run(text, template, threshold):
    """Highest coefficient of any run of words, by trying all of them."""
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    pairs, own, best = list(zip(words, words[1:])), license_scan.normalize(template), 0.0
    b, longest = set(zip(own, own[1:])), int((len(own) - 1) * (2 - threshold) / threshold + 1e-9)
    for a in range(len(pairs)):
        seen = set()
        for z in range(a, min(len(pairs), a + longest)):
            seen.add(pairs[z])
            best = max(best, round(2 * len(seen & b) / (len(seen) + len(b)), 9))
    return best


def test_best_run_against_all_runs(spark):
    import random

    rng = random.Random(3)
    texts = []
    for name, template in license_templates.TEMPLATES:
        for rate in (0.0, 0.05, 0.12, 0.2):
            words = [w if rng.random() > rate else "other" for w in template.split()]
            texts.append("Written by hand in May\n" + wrapped(" ".join(words), 40) + " and then some more words of prose\n" + CODE)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    none = license_scan._matching_units(docs.limit(0), 0.8, license_templates.TEMPLATES, "doc_id", "text")
    runs = license_scan.scan_runs(docs, none, 0.8, license_templates.TEMPLATES)
    got = {r.doc_id: r.dice for r in runs.groupBy("doc_id").agg(F.max("dice").alias("dice")).collect()}
    for i, text in enumerate(texts):
        best = max(best_run(text, t, 0.8) for _, t in license_templates.TEMPLATES)
        assert got.get(i) == (best if best >= 0.8 else None), text
