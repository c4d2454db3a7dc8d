"""The panel that signed a page, read from the boxes of its words.

Lines and cells are gaps-and-islands windows over a page; the sign-off and the lines of names above it
are found by window maxima, so only the few cells of the grid meet in one row. Names are read
column by column, the chair first.

Defined cases: a page without a sign-off, with fewer or more names than a panel has, or with a name twice has
no panel; words without a text or place are ignored; equal places are read in order of their texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points between columns and between lines, rows and names of a grid, particles, and words of no name.
COLUMN_GAP, LINE_GAP, GRID_ROWS, LEAST, MOST = 40.0, 3.0, 4, 3, 6
PARTICLES = ("van", "von", "de", "del", "der", "di", "da", "bin", "al", "el")
NO_NAMES = (
    "FIA", "Article", "Chapter", "Code", "Rules", "Steward", "Stewards", "Regulations", "Decision", "Reason", "Competitor", "Delegate", "Document", "Grand", "Prix", "Formula", "Sporting", "Judicial",
    "Disciplinary", "Appeal", "Penalty", "Team", "Manager", "Race", "Director", "Session", "Date", "Car", "Driver", "Time", "Limits", "Evidence", "Guidelines", "Operating", "Procedure", "Standing",
    "Classification", "Practice", "Qualifying", "Sprint", "Championship", "Technical", "Scrutineering", "Report", "Notes", "Annex", "Appendix",
)
SIGN_OFF = r"(?i)^\s*the\s+stewards\s*$"


def looks_like_name(text: Column) -> Column:
    """Two to four words, each capitalised letters or a particle, none of a document's own words."""
    parts = F.split(F.btrim(text), r"\s+")
    own = text.rlike(r"(?iu)\b(?:" + "|".join(NO_NAMES) + r")\b")
    return F.size(parts).between(2, 4) & ~own & F.forall(parts, lambda p: F.lower(p).isin(list(PARTICLES)) | p.rlike(r"^\p{Lu}[\p{L}'’-]*$"))


def _cells(words: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, line, cell, x0, name): boxes grouped to lines by their tops and to cells by wide gaps."""
    boxes = words.select(*by, "text", *[F.col(c).cast("double").alias(c) for c in ("x0", "x1", "top")]).na.drop(subset=["text", "x0", "x1", "top"])
    down = Window.partitionBy(*by).orderBy("top", "x0", "text")
    new = F.coalesce((F.col("top") - F.lag("top").over(down) > LINE_GAP).cast("int"), F.lit(1))
    boxes = boxes.withColumn("_new", new).withColumn("line", F.sum("_new").over(down))
    across = Window.partitionBy(*by, "line").orderBy("x0", "text")
    new = F.coalesce((F.col("x0") - F.lag("x1").over(across) > COLUMN_GAP).cast("int"), F.lit(1))
    boxes = boxes.withColumn("_new", new).withColumn("cell", F.sum("_new").over(across))
    name = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda s: s["text"]), " ")
    return boxes.groupBy(*by, "line", "cell").agg(F.min("x0").alias("x0"), name.alias("name"))


def panels(words: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(by, members, chair) of every page that a panel signed. words: by, text, x0, x1, top."""
    cells = _cells(words, by)
    page = Window.partitionBy(*by)
    of_line = Window.partitionBy(*by, "line")
    cells = cells.withColumn("_names", F.min(looks_like_name(F.col("name"))).over(of_line)).withColumn("_alone", F.count(F.lit(1)).over(of_line) == 1)
    signed = F.max(F.when(F.col("_alone") & F.col("name").rlike(SIGN_OFF), F.col("line"))).over(page)
    cells = cells.withColumn("_signed", signed).where(F.col("line") < F.col("_signed"))
    stop = F.coalesce(F.max(F.when(~F.col("_names"), F.col("line"))).over(page), F.lit(0))
    grid = cells.withColumn("_stop", F.greatest(stop, F.col("_signed") - GRID_ROWS - 1)).where(F.col("line") > F.col("_stop"))
    found = grid.groupBy(*by).agg(F.collect_list(F.struct("line", "x0", "name")).alias("c"))
    starts = F.array_sort(F.array_distinct(F.transform("c", lambda c: F.bround(c["x0"]))))
    # a column starts where the last one began more than a gap before
    bounds = F.aggregate(starts, F.array().cast("array<double>"), lambda b, x: F.when((F.size(b) == 0) | (x - F.element_at(b, -1) > COLUMN_GAP), F.array_append(b, x)).otherwise(b))
    found = found.withColumn("b", bounds)
    placed = F.transform("c", lambda c: F.struct(F.size(F.filter("b", lambda b: c["x0"] >= b - 1)).alias("column"), c["line"].alias("line"), c["x0"].alias("x0"), c["name"].alias("name")))
    found = found.select(*by, F.transform(F.array_sort(placed), lambda c: c["name"]).alias("members"))
    whole = F.size("members").between(LEAST, MOST) & (F.size(F.array_distinct("members")) == F.size("members"))
    return found.where(whole).withColumn("chair", F.get("members", F.lit(0)))
