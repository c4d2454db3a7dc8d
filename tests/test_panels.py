"""Panels from boxes of words: laid out as pages are, one line a call."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators.panels import looks_like_name, panels


def line(top, *cells):
    out = []
    for x, text in cells:
        for word in text.split():
            out.append((word, float(x), x + 7.5 * len(word), float(top)))
            x += 7.5 * len(word) + 6
    return out


SIGN = line(740, (46, "The Stewards"))
PAGES = {
    "four": (line(520, (118, "Competitors may appeal")) + line(672, (46, "Nish Shetty"), (300, "Loïc Bacquelaine")) + line(703, (46, "Vitantonio Liuzzi"), (300, "Zheng Honghai")) + SIGN, ["Nish Shetty", "Vitantonio Liuzzi", "Loïc Bacquelaine", "Zheng Honghai"]),
    "five": (line(672, (46, "A Be"), (300, "C De")) + line(703, (47, "E Fe"), (300, "G He")) + line(720, (46, "I Je")) + SIGN, ["A Be", "E Fe", "I Je", "C De", "G He"]),
    "three columns": (line(700, (46, "A Be"), (200, "C De"), (400, "E Fe")) + SIGN, ["A Be", "C De", "E Fe"]),
    "tilted line": (line(700, (46, "A Be")) + line(702.5, (200, "C De")) + line(701, (400, "E Fe")) + SIGN, ["A Be", "C De", "E Fe"]),
    "names far above a paragraph": (line(500, (46, "Jo Bauer")) + line(600, (46, "on the relevant regulations")) + line(700, (46, "A Be"), (200, "C De"), (400, "E Fe")) + SIGN, ["A Be", "C De", "E Fe"]),
    "top of a page": (line(10, (46, "A Be"), (200, "C De"), (400, "E Fe")) + line(40, (46, "the  stewards".upper())) + line(90, (46, "Ann Late"), (200, "Bo Later"), (400, "Cy Last")), ["A Be", "C De", "E Fe"]),
    "last sign-off counts": (line(10, (46, "X Ye")) + line(20, (46, "The Stewards")) + line(700, (46, "A Be"), (200, "C De"), (400, "E Fe")) + SIGN, ["A Be", "C De", "E Fe"]),
    "no sign-off": (line(600, (46, "A Be"), (200, "C De"), (400, "E Fe")), None),
    "sign-off in a sentence": (line(600, (46, "A Be"), (200, "C De"), (400, "E Fe")) + line(700, (46, "The Stewards met")), None),
    "two names": (line(600, (46, "A Be"), (200, "C De")) + SIGN, None),
    "seven names": (line(600, (46, "A Be"), (200, "C De"), (400, "E Fe")) + line(630, (46, "G He"), (200, "I Je"), (400, "K Le")) + line(660, (46, "M Ne")) + SIGN, None),
    "a name twice": (line(600, (46, "A Be"), (200, "C De"), (400, "A Be")) + SIGN, None),
    "a heading in the grid": (line(600, (46, "Operating Procedure"), (200, "C De"), (400, "E Fe")) + SIGN, None),
    "five rows": (sum((line(600 + 20 * i, (46, f"{c} Be")) for i, c in enumerate("ABCDE")), []) + SIGN, ["B Be", "C Be", "D Be", "E Be"]),
}


def test_pages(spark):
    rows = [(name, *w) for name, (words, _) in PAGES.items() for w in words] + [("four", None, 1.0, 2.0, 3.0), ("four", "Lost", None, None, 690.0)]
    got = {r.doc_id: r for r in panels(spark.createDataFrame(rows, "doc_id string, text string, x0 double, x1 double, top double")).collect()}
    assert {n: r.members for n, r in got.items()} == {n: m for n, (_, m) in PAGES.items() if m}
    assert all(r.chair == r.members[0] for r in got.values())
    assert panels(spark.createDataFrame([], "doc_id string, text string, x0 double, x1 double, top double")).count() == 0


@pytest.mark.parametrize("text,name", [("Ann Lee", True), ("Loïc van der Berg", True), ("O'Hara Dean-Fox", True), ("Ann", False), ("A B C D E", False), ("Ann lee", False), ("Ann 4", False), ("Race Director", False), ("Anne Racer", True), ("", False)])
def test_names(spark, text, name):
    assert spark.createDataFrame([(text,)], "t string").select(looks_like_name(F.col("t"))).first()[0] is name
