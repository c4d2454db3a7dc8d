"""Fields of rulings over hand-written texts, whose truth stands beside each of them.

A table's keys deal the texts out and fill in their numbers, so SQL states the truth by key and never
by another pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import rulings
from lodestone.plans.registry import query
from lodestone.sources import load


def _deal(spark: SparkSession, sf_dir: str, texts: list[str], table: str = "part", key: str = "p_partkey") -> DataFrame:
    """(doc_id, n, raw_text): text number doc_id mod their count, with {n} as a number from 2 to 20."""
    k = F.col(key)
    text = F.get(F.array(*[F.lit(t) for t in texts]), (k % len(texts)).cast("int"))
    n = (k % 19 + 2).cast("int")
    return load(spark, sf_dir, table).select(k.alias("doc_id"), n.alias("n"), F.replace(text, F.lit("{n}"), n.cast("string")).alias("raw_text"))


def _sql(value: object) -> str:
    return "NULL" if value is None else str(value).lower() if isinstance(value, (bool, int)) else "'" + str(value).replace("'", "''") + "'"


def _truth(values: list, name: str, kind: str = "VARCHAR", table: str = "part", key: str = "p_partkey") -> str:
    """SQL for the value of each text, {n} filled in."""
    array = ", ".join(_sql(v) for v in values)
    value = f"([{array}])[{key} % {len(values)} + 1]"
    if kind == "VARCHAR":
        value = f"replace({value}, '{{n}}', ({key} % 19 + 2)::VARCHAR)"
    return f"{value}::{kind} AS {name}"


def _t(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


OFFENCES = [
    ("Causing a collision with Car {n}.", "causing a collision", "collision"),
    ("Car {n} exceeded track limits at turn 4.", "track limits", "track_limits"),
    ("Unsafe release in front of Car {n}.", "unsafe release", "unsafe_release"),
    ("Pit lane speeding by Car {n}.", "pit lane speeding", "pit_lane_speed"),
    ("Ignoring blue flags for {n} corners.", "ignoring blue flags", "blue_flag"),
    ("Car {n} was obstructed in Q1.", "impeding", "impeding"),
    ("False start of Car {n}.", "false start", "false_start"),
    ("Breach of the starting procedure.", "starting procedure", "start_procedure"),
    ("Weaving on the straight.", "weaving", "erratic_driving"),
    ("Under the safety car the driver passed Car {n}.", "safety car violation", "safety_car"),
    ("Near collision behind the safety car.", "safety car violation", "safety_car"),
    ("Speed under the Virtual Safety Car.", "VSC infringement", "vsc"),
    ("Yellow flag not respected at post {n}.", "yellow flag violation", "yellow_flag"),
    ("Driving unnecessarily slowly.", "driving unnecessarily slowly", "driving_slowly"),
    ("Leaving the track at turn {n}.", "leaving the track", "track_limits"),
    ("Missed a media commitment.", "media commitment breach", "driver_obligation"),
    ("The lap times were deleted.", "deleted lap times", "track_limits"),
    ("The driver did not use the track at turn {n}.", "deleted lap times", "track_limits"),
    ("Forcing another driver off the track.", "forcing another driver off the track", "forcing_off_track"),
    ("Gaining a lasting advantage.", "gaining an advantage off track", "track_limits"),
    ("Crossing the track on foot.", "crossing the track", "crossing_track"),
    ("Work in parc fermé.", "parc ferme breach", "parc_ferme"),
    ("Time between the Safety Car lines, lap {n}.", "safety car line time limit", "safety_car_line_time"),
    ("Failed to maintain the required 10 car lengths.", "failing to maintain distance", "safety_car"),
    ("Overtaking under the safety car.", "overtaking under safety car", "safety_car"),
    ("No lap within 107% of the best time.", "107% rule", "107_percent"),
    ("Doc {n} - Alleged Practice Start", "practice start infringement", "practice_start"),
    ("Drove to the Practice Start Area and stopped.", None, None),
    ("Car {n} was released in an unsafe condition.", "released in an unsafe condition", "unsafe_release"),
    ("Infringement at pit exit.", "pit lane infringement", "pit_lane"),
    ("A fourth PU element was used.", "power unit element infringement", "technical"),
    ("Report of the scrutineers on the floor.", "technical infringement", "technical"),
    ("Failed to stop for weighing.", "weighing procedure", "weighing"),
    ("Late for the Drivers’ Parade.", "driver obligation breach", "driver_obligation"),
    ("Failing to follow Race Director’s instructions.", "failure to follow Race Director instructions", "race_director_instructions"),
    ("The hearing of Car {n} was adjourned.", None, None),
]


@query("ruling_offences", f"""
SELECT p_partkey AS doc_id, {_truth([o for _, o, _ in OFFENCES], "offence")}, {_truth([c for _, _, c in OFFENCES], "category")} FROM part
""")  # fmt: skip
def ruling_offences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _deal(spark, sf_dir, [t for t, _, _ in OFFENCES])
    out = docs.withColumn("offence", rulings.tx.first_rule(F.col("raw_text"), rulings.OFFENCES))
    return out.select("doc_id", "offence", rulings.category_of(F.col("offence")).alias("category"))


_REASON = "\nReason A reprimand, a warning, a drive-through penalty, a {n} place grid penalty and disqualification were weighed.\n"
OUTCOMES = [
    ("Disqualified from the race.", "disqualification", "DSQ", None),
    ("Required to start the Race from the pit lane.", "pit lane start", "PIT", None),
    ("10 second Stop-and-Go penalty.", "stop-and-go penalty", "SG", None),
    ("Drive-through penalty.", "drive-through penalty", "DT", None),
    ("Pit lane drive penalty.", "pit lane penalty", "DT", None),
    ("{n} second time penalty.", "{n}s time penalty", "{n}s", None),
    ("{n} seconds penalty to the elapsed time.", "{n}s time penalty", "{n}s", None),
    ("Drop of {n} grid positions.", "grid penalty", "GRID", "{n}"),
    ("Drop of three grid positions.", "grid penalty", "GRID", "3"),
    ("A ten place grid penalty.", "grid penalty", "GRID", "10"),
    ("Reprimand (driving).", "reprimand", "REP", None),
    ("No further action.", "no further action", "NFA", None),
    ("Warning.", "warning", "WARN", None),
    ("Fined €5.000 for lap {n}.", "fine", "FINE", None),
    ("The matter is adjourned.", None, None, None),
]


@query("ruling_outcomes", f"""
SELECT p_partkey AS doc_id, {_truth([o[1] for o in OUTCOMES], "outcome")}, {_truth([o[2] for o in OUTCOMES], "code")}, {_truth([o[3] for o in OUTCOMES], "grid")} FROM part
""")  # fmt: skip
def ruling_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision counts, not the penalties that its reasons weigh and reject."""
    docs = _deal(spark, sf_dir, [f"Fact Car {{n}} did it.\nDecision {t}{_REASON}" for t, *_ in OUTCOMES])
    t = F.col("raw_text")
    return docs.select("doc_id", rulings.outcome(t).alias("outcome"), rulings.penalty_code(t).alias("code"), rulings.grid_positions(t).cast("string").alias("grid"))


SESSIONS = [
    ("Session Sprint Shootout\nText", "sprint_qualifying"), ("Session Sprint\nText", "sprint"), ("Session Qualifying\nText", "qualifying"), ("Session Free Practice 1\nText", "practice_1"),
    ("Session FP2\nText", "practice_2"), ("Session: Practice Session 3\nText", "practice_3"), ("Session Practice\nText", "practice"), ("Session Race\nText", "race"),
    ("Session Reconnaissance Laps\nText", "reconnaissance"), ("Session Formation Lap\nText", "formation lap"), ("The Race Director reported it to the Stewards.", None),
    ("The Race Director reported it during qualifying.", "qualifying"), ("In free practice 2 Car {n} stopped.", "practice_2"), ("On lap {n} of the race.", "race"), ("Nothing named.", None),
]


@query("ruling_sessions", f"SELECT p_partkey AS doc_id, {_truth([s for _, s in SESSIONS], 'session')} FROM part")
def ruling_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deal(spark, sf_dir, [t for t, _ in SESSIONS]).select("doc_id", rulings.session_type(F.col("raw_text")).alias("session"))


SUSPENSIONS = [
    ("Decision Fine of €25,000 – Suspended.\nReason x\n", "full"),
    ("Decision Fined €50,000, €25,000 of\nwhich is suspended for {n} months.\nReason x\n", "partial"),
    ("Decision Fined €5.000, suspended for 12 months.\nReason x\n", "full"),
    ("Decision Fined €350,000 with €100,000 suspended.\nReason x\n", "partial"),
    ("Decision The Super Licence of the driver of Car {n} is suspended for the next Competition.\nReason x\n", "none"),
    ("Decision Reprimand.\nReason The session was suspended.\n", "none"),
    ("A fine of €{n}000 is suspended until the end of the season.", "full"),
    ("The suspension system was examined. The session was suspended on lap {n}.", "none"),
    ("A penalty that is suspended in part.", "partial"),
]


@query("ruling_suspensions", f"SELECT p_partkey AS doc_id, {_truth([s for _, s in SUSPENSIONS], 'suspended')} FROM part")
def ruling_suspensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deal(spark, sf_dir, [t for t, _ in SUSPENSIONS]).select("doc_id", rulings.suspended(F.col("raw_text")).alias("suspended"))


HEADERS = [
    ("2024 BELGIAN GRAND PRIX\n26 - 28 July 2024\nFrom The Stewards", 2024, "BELGIAN GRAND PRIX", "2024-07-26", "2024-07-28"),
    ("2018  FORMULA 1  TESTING\n29 March – 1 April 2018\n", 2018, "FORMULA 1 TESTING", "2018-03-29", "2018-04-01"),
    ("2021 B G P\nELGIAN RAND RIX\n30 December - 2 January 2022\n", 2021, "BELGIAN GRAND PRIX", "2021-12-30", "2022-01-02"),
    ("SÃO PAULO GRAND PRIX\n1 - 3 November 2024\n", 2024, "SÃO PAULO GRAND PRIX", "2024-11-01", "2024-11-03"),
    ("2023 MONACO GRAND PRIX\nno dates at all\n", 2023, "MONACO GRAND PRIX", None, None),
    ("MONACO GRAND PRIX\nno dates at all\n", None, None, None, None),
    ("2023 MONACO GRAND PRIX\n25 - 28 Mai 2023\n", 2023, "MONACO GRAND PRIX", None, None),
]


@query("ruling_headers", f"""
SELECT p_partkey AS doc_id, {_truth([h[1] for h in HEADERS], "season", "INTEGER")}, {_truth([h[2] for h in HEADERS], "event_name")},
    {_truth([h[3] for h in HEADERS], "start_date", "DATE")}, {_truth([h[4] for h in HEADERS], "end_date", "DATE")} FROM part
""")  # fmt: skip
def ruling_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _deal(spark, sf_dir, [h[0] for h in HEADERS]).withColumn("h", rulings.event_header(F.col("raw_text")))
    return docs.select("doc_id", "h.season", "h.event_name", "h.start_date", "h.end_date")


TABLES = [
    ("No Turn Car Driver Competitor Time of Day Lap Time\n1 4 {n} Zhou Guanyu Stake F1 Team 12:56:34 1:29.677\n2 4 44 Lewis Hamilton Team 1 12:57:01 1:28.1\n3 9 {n} Zhou Guanyu Stake F1 Team 12:59:00 1:30.0\n", "{n}:Zhou Guanyu|44:Lewis Hamilton"),
    ("No  No / Driver  Competitor  Penalty\n1  55 - Carlos Sainz  Scuderia  10 second time penalty\n2  {n} – Nyck de Vries  Team  5 second time penalty\n", "55:Carlos Sainz|{n}:Nyck de Vries"),
    ("1 4 24 Zhou Guanyu Stake F1 Team 12:56:34 1:29.677\n", ""),
    ("Car Driver Competitor Time\n1. 99 Antonio Giovinazzi Alfa 9 14:01:02\n", "99:Antonio Giovinazzi"),
]


@query("ruling_tables", f"SELECT p_partkey AS doc_id, {_truth([t[1] for t in TABLES], 'subjects')} FROM part")
def ruling_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.transform(rulings.table_subjects(F.col("raw_text")), lambda r: F.concat_ws(":", r["number"].cast("string"), r["name"]))
    return _deal(spark, sf_dir, [t for t, _ in TABLES]).select("doc_id", F.array_join(rows, "|").alias("subjects"))


SHEETS = [
    ("Fact Car {n} hit the wall.\nDecision {n} second time penalty.\nReason: The driver braked late. Competitors are reminded that they may appeal.", "Car {n} hit the wall.", "time_{n}s", "The driver braked late.", "{n} second time penalty."),
    ("Fact\nCar {n} stopped.\nDecision No further action.\nReason Nobody was to blame. Decisions of the Stewards are taken independently.", "Car {n} stopped.", "no_further_action", "Nobody was to blame.", "No further action."),
    ("The Stewards determine the following: Car {n} was too slow in the pit lane.\nFined €500.", "Car {n} was too slow in the pit lane.", "fine", "", ""),
    ("Five\nDecision Drop of {n} grid places, a grid place penalty.\nReason  x", "", "grid_drop", "x", "Drop of {n} grid places, a grid place penalty."),
    ("A penalty that is suspended.", "", "suspended_penalty", "", ""),
    ("Nothing at all", "", "other", "", ""),
]


@query("ruling_worksheet", f"""
SELECT p_partkey AS doc_id, {_truth([s[1] for s in SHEETS], "fact")}, {_truth([s[2] for s in SHEETS], "slug")}, {_truth([s[3] for s in SHEETS], "why")}, {_truth([s[4] for s in SHEETS], "decision")} FROM part
""")  # fmt: skip
def ruling_worksheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("raw_text")
    return _deal(spark, sf_dir, [s[0] for s in SHEETS]).select("doc_id", rulings.fact_line(t).alias("fact"), rulings.penalty_slug(t).alias("slug"), rulings.why(t).alias("why"), rulings.decision_line(t).alias("decision"))


@query("layered_merge", """
WITH l AS (SELECT o_orderkey AS k, (o_orderkey % 8)::INTEGER AS n1, (o_orderkey % 5)::INTEGER AS n2, (o_orderkey % 3)::INTEGER AS n3, (o_orderkey % 2 * 400)::INTEGER AS chars FROM orders),
f AS (SELECT *, CASE WHEN chars < 100 OR n1 < 2 THEN n2 ELSE 0 END AS u2 FROM l), b AS (SELECT *, greatest(n1, u2) AS best FROM f),
c AS (SELECT *, CASE WHEN best < 3 AND n3 > 0 THEN greatest(best, n3) END AS n123 FROM b)
SELECT k AS doc_id, coalesce(n123, best)::INTEGER AS fields, CASE WHEN n123 IS NOT NULL THEN 3 WHEN u2 > n1 THEN 2 ELSE 1 END AS layer_used,
    round(least(CASE WHEN n123 IS NOT NULL THEN n123 / 5.0::DOUBLE + 0.1::DOUBLE ELSE greatest(u2, n1) / 5.0::DOUBLE END, 1.0::DOUBLE), 3) AS confidence,
    CASE WHEN n1 > 0 THEN 'a' WHEN u2 > 0 THEN 'b' WHEN n123 > 0 THEN 'c' END AS driver_name FROM c
""")  # fmt: skip
def layered_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three readings of a ruling that fill the first 0 to 7 fields each."""
    k = F.col("o_orderkey")

    def layer(mark: str, modulo: int) -> Column:
        filled = [F.when(k % modulo > i, mark).alias(f) for i, f in enumerate(rulings.KEY_FIELDS)]
        return F.struct(*filled)

    o = load(spark, sf_dir, "orders").select(k.alias("doc_id"), layer("a", 8).alias("first"), layer("b", 5).alias("second"), layer("c", 3).alias("third"), (k % 2 * 400).cast("int").alias("chars"))
    out = rulings.merge_layers(o, ("first", "second", "third"), "chars")
    count = sum((F.col(f).isNotNull().cast("int") for f in rulings.KEY_FIELDS), F.lit(0))
    return out.select("doc_id", count.alias("fields"), "layer_used", "confidence", "driver_name")


@query("guideline_lines", """
SELECT s_suppkey AS doc_id, 'Driving Standards' AS section, '38.' || a AS article, CASE a WHEN 1 THEN 'Causing a collision. Penalty: ' || (s_suppkey % 19 + 2) || ' seconds' ELSE 'Track limits. Sanction: reprimand' END AS text,
    CASE a WHEN 1 THEN (s_suppkey % 19 + 2) || ' seconds' ELSE 'reprimand' END AS recommended FROM supplier, (VALUES (1), (2)) v(a)
""")  # fmt: skip
def guideline_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines folded under their section and article, with the penalty that the text recommends."""
    text = "Preamble\nDRIVING STANDARDS\n38.1 Causing a collision.\nPenalty: {n} seconds\n38.2 Track limits.\nSanction: reprimand"
    lines = _deal(spark, sf_dir, [text], "supplier", "s_suppkey").select("doc_id", F.posexplode(F.split("raw_text", "\n")).alias("line_no", "text"))
    out = rulings.guideline_articles(lines)
    return out.select("doc_id", F.initcap("section").alias("section"), "article", "text", "recommended")


PARTS = [
    (
        "No / Driver {n} - Ada Example\n63 - Bo de Ray\nTime 10:00\nfrom the office\nTime 13:05\nSession Race\nFact Cars {n}, 16 and 63 made contact at turn 3 on lap 7.\nDecision 2 penalty points.\nReason The Stewards reviewed video and team radio. Car {n} was late. Competitors are reminded of their right to appeal.\nThe Stewards\nJohn Smith\nMaria de Silva\n",
        "{n}:Ada Example|63:Bo de Ray", "16,63", True, "13:05", "2", "The Stewards reviewed video and team radio. Car {n} was late.", "John Smith|Maria de Silva",
    ),
    ("Car {n} was seen.\nFact Car {n} avoided any contact with Car 99.\nReason Nobody was to blame.\n", "", "99", False, None, None, "Nobody was to blame.", ""),
    ("All teams.\nTime 25:61\nSession Race\n", "", "", None, None, None, None, ""),
]


@query("ruling_parts", f"""
SELECT p_partkey AS doc_id, {_truth([p[1] for p in PARTS], "subjects")}, {_truth([p[2] for p in PARTS], "involved")}, {_truth([p[3] for p in PARTS], "contact", "BOOLEAN")}, {_truth([p[4] for p in PARTS], "time")},
    {_truth([p[5] for p in PARTS], "points", "INTEGER")}, {_truth([p[6] for p in PARTS], "reason")}, {_truth([p[7] for p in PARTS], "signatories")} FROM part WHERE p_partkey % 19 + 2 NOT IN (16, 99)
""")  # fmt: skip
def ruling_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects, cars involved, contact, time, points, reasons and signatories of whole rulings."""
    docs = rulings.extract_fields(_deal(spark, sf_dir, [p[0] for p in PARTS]).where("n <> 16"))
    named = F.array_join(F.transform("subjects", lambda r: F.concat_ws(":", r["number"].cast("string"), r["name"])), "|")
    return docs.select("doc_id", named.alias("subjects"), F.array_join(F.transform("involved", lambda x: x.cast("string")), ",").alias("involved"), "contact", "time", "points", "reason", F.array_join("signatories", "|").alias("signatories"))


PAGES = [
    ("FIA F1 Document 12/2024\nTHE STEWARDS OF THE MEETING\nThe deci-\nsion is ﬁnal – “no” more.\nPage 1 of 3\n\n\n\nEnd.   \n", "The decision is final - \"no\" more.\n\nEnd."),
    ("Fédération Internationale de l’Automobile, Paris\nCar {n}\n-----\n7\n", "Car {n}"),
]


@query("clean_rulings", f"SELECT p_partkey AS doc_id, {_truth([p[1] for p in PAGES], 'text')} FROM part")
def clean_rulings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deal(spark, sf_dir, [p[0] for p in PAGES]).select("doc_id", rulings.tx.clean(F.col("raw_text")).alias("text"))
