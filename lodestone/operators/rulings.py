"""Fields of published rulings as column expressions: one select over the text, no row-wise Python.

Sections are found by their heading lines; numbers, names, times and outcomes by ordered rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as tx

HEADINGS = "session|fact|facts|infringement|offence|decision|reason|penalty|time|no / driver|competitor"

NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "fifteen": 15, "twenty": 20}
_COUNT = r"(?:\d{1,2}|" + "|".join(NUMBERS) + ")"
#: Outcomes in order of precedence; {n} is the number that the pattern finds.
OUTCOMES = (
    ("disqualification", r"(?i)disqualif"),
    ("pit lane start", r"(?i)(?:required|permitted)\s+to\s+start\s+(?:the\s+\w+\s+)?from\s+the\s+pit\s+lane|start\s+the\s+race\s+from\s+the\s+pit\s+lane"),
    ("stop-and-go penalty", r"(?i)stop[\s-]*(?:and)?[\s-]*go"),
    ("drive-through penalty", r"(?i)drive[- ]through"),
    ("pit lane penalty", r"(?i)pit\s*lane\s*(?:through|drive)"),
    ("{n}s time penalty", r"(?i)(\d+)\s*seconds?\s*time\s*penalty"),
    ("{n}s time penalty", r"(?i)(\d+)\s*seconds?\s*penalty"),
    ("grid penalty", rf"(?i)drops?\s+of\s+{_COUNT}\s+(?:grid\s+)?(?:position|place)|(?:grid\s+(?:position|place)|(?:position|place)\s+grid|grid)\s+penalty"),
    ("reprimand", r"(?i)reprimand"),
    ("no further action", r"(?i)no\s+further\s+action"),
    ("warning", r"(?i)warning"),
    ("fine", r"(?i)fined?\s+(?:of\s+)?(?:€|EUR|\$|USD)?\s*[\d.,]+"),
)
#: Offences in order of precedence, those that name a place or an article last.
OFFENCES = (
    ("causing a collision", r"(?i)caus(?:ing|ed)\s+a\s+collision"),
    ("track limits", r"(?i)track\s+limits?"),
    ("unsafe release", r"(?i)unsafe\s+(?:release|act)"),
    ("pit lane speeding", r"(?i)pit\s*lane\s*speed"),
    ("ignoring blue flags", r"(?i)ignor(?:e|ing)\s+blue\s+flag"),
    ("impeding", r"(?i)impeding|obstruct"),
    ("false start", r"(?i)false\s+start"),
    ("starting procedure", r"(?i)start(?:ing)?\s+procedure"),
    ("weaving", r"(?i)weav(?:ing|e)"),
    ("safety car violation", r"(?i)safety\s+car[^\n]*?(?:overtook?|pass(?:ed|ing))|(?:incident|collision)\s+behind\s+the\s+safety\s+car"),
    ("VSC infringement", r"(?i)virtual\s+safety\s+car"),
    ("yellow flag violation", r"(?i)yellow\s+flag"),
    ("driving unnecessarily slowly", r"(?i)driving\s+(?:unnecessarily\s+)?slowly"),
    ("leaving the track", r"(?i)leaving\s+the\s+track"),
    ("media commitment breach", r"(?i)(?:media|pr)\s+commitment"),
    ("deleted lap times", r"(?i)deleted\s+lap\s+time|lap\s+times?\s+(?:was|were|are|is)\s+deleted|did\s+not\s+use\s+the\s+track"),
    ("forcing another driver off the track", r"(?i)forc(?:ing|ed)\s+(?:another\s+driver\s+)?off\s+the\s+track"),
    ("gaining an advantage off track", r"(?i)gain(?:ing|ed)\s+(?:a\s+)?(?:lasting\s+)?advantage"),
    ("crossing the track", r"(?i)cross(?:ing|ed)\s+the\s+track"),
    ("parc ferme breach", r"(?i)parc\s*ferm"),
    ("safety car line time limit", r"(?i)between\s+the\s+safety\s+car\s+lines|SC\s*2\s*-\s*SC\s*1"),
    ("failing to maintain distance", r"(?i)fail(?:ing|ed|ure)?\s+to\s+maintain\s+(?:the\s+)?(?:required\s+)?(?:\d+\s+car\s+lengths?|distance)"),
    ("overtaking under safety car", r"(?i)overtak(?:ing|en?)\s+under\s+(?:the\s+)?safety\s+car"),
    ("107% rule", r"(?i)107\s*%|within\s+107"),
    ("practice start infringement", r"(?im)(?:perform|undert(?:ook|ake)|complet|carr(?:y|ied)\s+out|execut)\w*\s+(?:a\s+|the\s+)?practice\s+start|practice\s+starts?\s+(?:outside|before|in\s+the\s+wrong)|(?:considering|regarding|concerning)\s+practice\s+start|practice\s+start\s+infringement|-\s*(?:alleged\s+)?practice\s+start\s*$"),
    ("released in an unsafe condition", r"(?i)released\s+in\s+an\s+unsafe\s+condition"),
    ("pit lane infringement", r"(?i)pit\s*(?:lane|exit)\s+infringement|infringement\s+at\s+pit\s+exit"),
    ("power unit element infringement", r"(?i)PU\s+element|power\s+unit\s+element|exceed(?:ed|ing)?\s+the\s+permitted\s+number"),
    ("technical infringement", r"(?i)technical\s+(?:infringement|non[- ]compliance)|scrutineer|fuel\s+(?:sample|irregular)|tyre\s+pressure"),
    ("weighing procedure", r"(?i)weighing\s+(?:procedure|process)|weighbridge|fail(?:ing|ed|ure)?\s+to\s+(?:stop\s+for\s+)?weigh"),
    ("driver obligation breach", r"(?i)drivers?['’]?\s*parade|fan\s+engagement|(?:late\s+(?:for|attendance)|fail(?:ing|ed|ure)?\s+to\s+attend|absence\s+from|behaviour\s+in)[^.]{0,40}?drivers?['’]?\s*(?:meeting|briefing)|late\s+attendance\s+of\s+(?:the\s+)?national\s+anthem"),
    ("failure to follow Race Director instructions", r"(?i)fail(?:ing|ed|ure)?\s+to\s+follow\s+(?:the\s+)?(?:race\s+director|rd)['’]?s?\s+(?:instruction|event\s+note)"),
)
#: The category of an offence by the first key in its label.
CATEGORIES = (
    ("causing a collision", "collision"), ("forcing another driver off the track", "forcing_off_track"), ("dangerous driving", "dangerous_driving"),
    ("weaving", "erratic_driving"), ("driving unnecessarily slowly", "driving_slowly"), ("crossing the track", "crossing_track"),
    ("deleted lap times", "track_limits"), ("gaining an advantage off track", "track_limits"), ("leaving the track", "track_limits"), ("track limits", "track_limits"),
    ("pit lane speeding", "pit_lane_speed"), ("released in an unsafe condition", "unsafe_release"), ("unsafe release", "unsafe_release"), ("pit lane infringement", "pit_lane"),
    ("ignoring blue flags", "blue_flag"), ("yellow flag violation", "yellow_flag"), ("safety car line time limit", "safety_car_line_time"),
    ("failing to maintain distance", "safety_car"), ("overtaking under safety car", "safety_car"), ("safety car violation", "safety_car"), ("vsc infringement", "vsc"),
    ("false start", "false_start"), ("practice start infringement", "practice_start"), ("starting procedure", "start_procedure"), ("start procedure", "start_procedure"),
    ("formation lap", "formation_lap"), ("impeding", "impeding"), ("107% rule", "107_percent"), ("failure to follow race director instructions", "race_director_instructions"),
    ("parc ferme breach", "parc_ferme"), ("power unit element infringement", "technical"), ("technical infringement", "technical"), ("weighing procedure", "weighing"),
    ("driver obligation breach", "driver_obligation"), ("media commitment breach", "driver_obligation"), ("disqualification", "disqualification"),
    ("reprimand", "administrative"), ("fine", "administrative"),
)
#: Penalty codes by the first key in an outcome; seconds are read as a number before.
PENALTIES = (
    ("no further action", "NFA"), ("nfa", "NFA"), ("reprimand", "REP"), ("stop-and-go", "SG"), ("stop and go", "SG"), ("drive-through", "DT"), ("drive through", "DT"),
    ("pit lane penalty", "DT"), ("grid penalty", "GRID"), ("grid position", "GRID"), ("disqualif", "DSQ"), ("warning", "WARN"), ("fine", "FINE"), ("pit lane start", "PIT"),
)
#: Names of sessions, sprint qualifying before sprint, numbered practices before plain ones.
SESSIONS = (
    ("sprint_qualifying", r"(?i)shootout|sprint\W+qualif"),
    ("sprint", r"(?i)sprint"),
    ("qualifying", r"(?i)qualif"),
    ("practice_1", r"(?i)practice\W*(?:session\W*)?1|\bfp\W*1"),
    ("practice_2", r"(?i)practice\W*(?:session\W*)?2|\bfp\W*2"),
    ("practice_3", r"(?i)practice\W*(?:session\W*)?3|\bfp\W*3"),
    ("practice", r"(?i)practice"),
    ("race", r"(?i)race|grid procedure"),
    ("reconnaissance", r"(?i)reconnaissance"),
    ("formation lap", r"(?i)formation"),
)
PARTICLES = ("de", "van", "von", "da", "del", "di", "la", "le")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
EVIDENCE = (("video", "(?i)video|footage"), ("telemetry", "(?i)telemetry|data"), ("radio", "(?i)team radio|radio"), ("hearing", "(?i)heard from|hearing"), ("timing", "(?i)timing|marshalling system"), ("onboard", "(?i)on-?board|in-car"))


def part(text: Column, heading: str) -> Column:
    return tx.section(text, heading, HEADINGS)


def reason(text: Column) -> Column:
    """The reasons up to the notice on appeals that ends most rulings."""
    cut = F.get(F.split(part(text, "reason"), r"(?i)competitors are reminded|decisions of the stewards are taken"), F.lit(0))
    return F.nullif(F.btrim(cut, F.lit(" \n\t")), F.lit(""))


def car_number(text: Column) -> Column:
    return F.coalesce(tx.extract_int(text, r"(?im)^\s*no\.? ?/ ?driver\s*:?\s*(\d{1,2})\b"), tx.extract_int(text, r"(?i)\b(?:cars?|no\.|#)\s*(\d{1,2})\b"))


def driver_name(text: Column) -> Column:
    header = tx.extract(text, r"(?im)^\s*no\.? ?/ ?driver\s*:?\s*\d{1,2}\s*[-–]\s*([^\n]+?)\s*$")
    return F.coalesce(F.regexp_replace(header, r"\s+", " "), tx.extract(text, r"(?:[Dd]river|[Cc]ompetitor)\s+((?:\p{Lu}\p{L}+)\s+(?:\p{Lu}\p{L}+))"))


def involved_cars(text: Column) -> Column:
    """Numbers of cars named in the facts, without the subject's, in order."""
    facts = F.coalesce(part(text, "facts?"), F.lit(""))
    lists = F.regexp_extract_all(facts, F.lit(r"(?i)\bcars?\s+((?:\d{1,2})(?:\s*(?:,|and|&)\s*\d{1,2})*)"), F.lit(1))
    numbers = F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(x, F.lit(r"(\d{1,2})"), F.lit(1))))
    numbers = F.array_distinct(F.transform(numbers, lambda x: x.cast("int")))
    own = car_number(text)
    return F.when(own.isNull(), numbers).otherwise(F.array_except(numbers, F.array(own)))


def contact(text: Column) -> Column:
    """True, false or unknown, from the facts only."""
    facts = part(text, "facts?")
    return (
        F.when(facts.isNull(), F.lit(None).cast("boolean"))
        .when(facts.rlike(r"(?i)\b(?:no|without|avoid(?:ed|ing)?)\s+(?:any\s+)?(?:contact|collision)"), F.lit(False))
        .when(facts.rlike(r"(?i)\b(?:contact|collid|collision|hit|struck)"), F.lit(True))
        .when(facts.rlike(r"(?i)incident between"), F.lit(None).cast("boolean"))
        .otherwise(F.lit(False))
    )


def incident_time(text: Column) -> Column:
    """hh:mm of the last time line right before the session line; null out of bounds."""
    found = tx.extract(text, r"(?im)^\s*time\s*:?\s*(\d{1,2}:\d{2})\s*$(?=\s*^\s*session\b)")
    h, m = tx.extract_int(found, r"^(\d{1,2})"), tx.extract_int(found, r":(\d{2})$")
    return F.when((h <= 23) & (m <= 59), F.format_string("%02d:%02d", h, m))


def session_type(text: Column) -> Column:
    """The session of the session line; without one, the first session named in the body, offices named after sessions left out."""
    line = tx.extract(text, r"(?im)^[ \t]*session[ \t:]*(\S[^\n]{0,50})$")
    body = F.regexp_replace(text, r"(?i)\brace\s+(?:director|control|steward|number|engineer|officials?)\b", " ")
    named = tx.extract(body, r"(?i)\b(sprint\s+(?:qualifying|shootout)|race|qualifying|sprint|(?:free\s+)?practice\s*[123]?|fp\s*[123]?|formation lap|reconnaissance)\b")
    return F.when(line.isNotNull(), tx.first_rule(line, SESSIONS)).otherwise(tx.first_rule(named, SESSIONS))


def _ruling(text: Column) -> Column:
    """The decision section, or all of a text without one."""
    return F.coalesce(F.nullif(part(text, "decision"), F.lit("")), text)


def outcome(text: Column) -> Column:
    """What was imposed: reasons argue about penalties that were not, so the decision section alone counts if there is one."""

    def first(scope: Column) -> Column:
        out = F.lit(None).cast("string")
        for label, pattern in reversed(OUTCOMES):
            named = F.concat(F.regexp_extract(scope, pattern, 1), F.lit(label.removeprefix("{n}"))) if label.startswith("{n}") else F.lit(label)
            out = F.when(scope.rlike(pattern), named).otherwise(out)
        return out

    return tx.let(_ruling(text), first)


def penalty_of(outcome_text: Column) -> Column:
    """Code of an outcome: seconds as a number first (15 s is never 5 s), then the ordered keys."""

    def code(low: Column) -> Column:
        seconds = tx.extract_int(low, r"\b(\d{1,2})\s*(?:s\b|second)")
        return F.when(low.contains("penalty") & seconds.isNotNull(), F.concat(seconds.cast("string"), F.lit("s"))).otherwise(tx.first_contained(low, PENALTIES))

    return tx.let(F.lower(outcome_text), code)


def category_of(offence: Column) -> Column:
    return tx.first_contained(offence, CATEGORIES)


def penalty_code(text: Column) -> Column:
    return penalty_of(outcome(text))


def grid_positions(text: Column) -> Column:
    """1 to 20 from digits or number words in the decision."""
    count = rf"({_COUNT[3:-1]})"
    d = _ruling(text)
    ways = (rf"(?i)drops?\s+of\s+{count}\s+(?:grid\s+)?(?:position|place)", rf"(?i)\b{count}[\s-]+(?:grid\s+)?(?:position|place)s?\s+(?:grid\s+)?(?:penalty|drop)", rf"(?i)\b{count}\s+grid\s+(?:position|place)s?")
    raw = tx.let(d, lambda x: F.lower(F.coalesce(*[tx.extract(x, w) for w in ways])))
    table = F.create_map(*[F.lit(x) for kv in NUMBERS.items() for x in kv])
    n = tx.let(raw, lambda x: F.coalesce(F.try_to_number(F.when(x.rlike(r"^\d+$"), x), F.lit("99")).cast("int"), F.element_at(table, x)))
    return tx.let(n, lambda x: F.when(x.between(1, 20), x))


def suspended(text: Column) -> Column:
    """partial, full or none: whether the penalty is suspended.

    Read from the decision section; without one, only next to a fine or penalty. A suspended licence
    is the penalty itself.
    """
    decision = F.nullif(F.btrim(F.coalesce(part(text, "decision"), F.lit(""))), F.lit(""))
    said = F.when(decision.isNotNull(), decision.rlike(r"(?i)\bsuspend(?:ed|s)?\b")).otherwise(text.rlike(r"(?i)(?:\bfine\b|\bpenalty\b|[€$£][\d.,]+)[^.]{0,80}?\bsuspend"))
    scope = F.coalesce(decision, text)
    licence = scope.rlike(r"(?i)\b(?:super\s+)?licen[cs]e\b[^.]{0,80}?\bsuspend")
    share = r"(?i)[€$£][\d.,]+\s+(?:of\s+which|of\s+the\s+(?:fine|penalty))(?:\s+(?:is|was|be|would\s+be))?\s+suspend|of\s+which\s+[€$£]?[\d.,]+(?:\s+(?:is|was|be|would\s+be))?\s+suspend|with\s+[€$£][\d.,]+\s+suspend|suspended?\s+in\s+parts?|partly\s+suspend"
    return F.when(~said | licence, "none").when(scope.rlike(share), "partial").otherwise("full")


def table_subjects(text: Column) -> Column:
    """(number, name) of the rows of a table of drivers, one a car; none unless a header of one of two layouts is there."""
    rows = F.array().cast("array<struct<number:int,name:string>>")
    layouts = (
        (r"(?im)^[ \t]*(?:No\.?[ \t]+)?(?:Turn[ \t]+)?Car[ \t]+Driver\b", r"(?m)^[ \t]*\d{1,3}\.?[ \t]+(?:\d{1,3}[ \t]+)*(\d{1,3})[ \t]+(\p{Lu}.*?)[ \t]+\d{1,2}:\d{2}:\d{2}"),
        (r"(?im)^[ \t]*No\.?[ \t]+No[ \t]*/[ \t]*Driver\b", r"(?m)^[ \t]*\d{1,3}\.?[ \t]+(\d{1,3})[ \t]*[-–—][ \t]*(\p{Lu}[\p{L}'’.-]+(?:[ \t]+[\p{L}'’.-]+){1,2})"),
    )
    for header, row in layouts:
        numbers, names = (F.regexp_extract_all(text, F.lit(row), F.lit(g)) for g in (1, 2))
        found = F.zip_with(numbers, names, lambda n, c: F.struct(n.cast("int").alias("number"), _leading_name(c).alias("name")))
        rows = F.concat(rows, F.when(text.rlike(header), found).otherwise(F.array().cast("array<struct<number:int,name:string>>")))
    first = F.transform(rows, lambda r, i: F.when(~F.exists(F.slice(rows, 1, i), lambda q: q["number"] == r["number"]), r))
    return F.filter(first, lambda r: r.isNotNull())


def _leading_name(cell: Column) -> Column:
    """Two words, or three where the second is a particle; what follows is the team."""
    words = F.split(F.btrim(cell), r"\s+")
    size = F.when(F.lower(F.get(words, F.lit(1))).isin(*PARTICLES), 3).otherwise(2)
    return F.array_join(F.slice(words, 1, size), " ")


def event_header(text: Column) -> Column:
    """(season, event_name, start_date, end_date) from the first 400 characters, null without a name and a season.

    The name stands in capitals after the year, with its first letters set apart on a line of their
    own, or without a year that the dates then give. A weekend over two months names both; one from
    December to January began the year before.
    """
    head = F.left(text, F.lit(400))
    caps = r"[A-Z0-9][A-Z0-9'’À-Ž .\-]*?(?:GRAND[ \t]+PRIX|TESTING|TEST)"
    dates = r"(?m)^[ \t]*(\d{1,2})(?:[ \t]+([A-Z][a-z]+))?[ \t]*[-–—][ \t]*(\d{1,2})[ \t]+([A-Z][a-z]+)[ \t]+(20\d\d)[ \t]*$"
    dated = rf"(?m)^[ \t]*(20\d\d)[ \t]+({caps})[ \t]*$"
    apart = r"(?m)^[ \t]*(20\d\d)[ \t]+((?:[A-Z][ \t]+){1,5}[A-Z])[ \t]*\n[ \t]*([A-Z][A-Z'’À-Ž ]*)[ \t]*$"
    firsts, rests = (F.split(F.btrim(F.regexp_extract(head, apart, g)), r"\s+") for g in (2, 3))
    joined = F.when(head.rlike(apart) & (F.size(firsts) == F.size(rests)), F.array_join(F.zip_with(firsts, rests, lambda a, b: F.concat(a, b)), " "))
    year = tx.extract_int(head, dates, 5)
    bare = F.when(year.isNotNull() & ~head.rlike(apart), tx.extract(head, rf"(?m)^[ \t]*({caps})[ \t]*$"))
    name = F.regexp_replace(F.coalesce(tx.extract(head, dated, 2), joined, bare), r"\s+", " ")
    season = F.coalesce(F.when(head.rlike(dated), tx.extract_int(head, dated)), F.when(joined.isNotNull(), tx.extract_int(head, apart)), year)
    months = F.create_map(*[x for i, m in enumerate(MONTHS) for x in (F.lit(m), F.lit(i + 1))])
    last = F.element_at(months, F.lower(tx.extract(head, dates, 4)))
    first = F.element_at(months, F.lower(F.coalesce(tx.extract(head, dates, 2), tx.extract(head, dates, 4))))
    known = first.isNotNull() & last.isNotNull()
    start = F.when(known, F.make_date(F.when(first > last, year - 1).otherwise(year), first, tx.extract_int(head, dates, 1)))
    end = F.when(known, F.make_date(year, last, tx.extract_int(head, dates, 3)))
    return F.when(name.isNotNull() & season.isNotNull(), F.struct(season.alias("season"), name.alias("event_name"), start.alias("start_date"), end.alias("end_date")))


#: The fields that tell how much of a ruling was read.
KEY_FIELDS = ("driver_name", "car_number", "infraction_type", "outcome", "lap_number", "session_type", "penalty_points")


def merge_layers(df: DataFrame, layers: tuple[str, str, str], chars: str, fields: tuple[str, ...] = KEY_FIELDS) -> DataFrame:
    """``df`` with merged fields, layer_used and confidence from three struct columns of the same fields.

    An earlier layer wins field by field. The second is read where the first has under 100 characters
    or two fields, the third where both have under three.
    """
    first, second, third = (F.col(c) for c in layers)
    count = lambda x: sum((x[f].isNotNull().cast("int") for f in fields), F.lit(0))
    df = df.withColumn("_n1", count(first)).withColumn("_l2", F.when((F.col(chars) < 100) | (F.col("_n1") < 2), second))
    df = df.withColumn("_n2", F.coalesce(count(F.col("_l2")), F.lit(0)))
    best = {f: F.coalesce(first[f], F.col("_l2")[f]) for f in fields}
    df = df.withColumn("_best", F.struct(*[c.alias(f) for f, c in best.items()])).withColumn("_l3", F.when(count(F.col("_best")) < 3, third))
    df = df.withColumn("_used3", F.col("_l3").isNotNull() & (count(F.col("_l3")) > 0))
    merged = {f: F.coalesce(F.col("_best")[f], F.col("_l3")[f]) for f in fields}
    two = F.col("_n2") > F.col("_n1")
    df = df.withColumns(merged)
    share = F.when(F.col("_used3"), sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0)) / 5 + 0.1).when(two, F.col("_n2") / 5).otherwise(F.col("_n1") / 5)
    df = df.withColumn("layer_used", F.when(F.col("_used3"), 3).when(two, 2).otherwise(1)).withColumn("confidence", F.round(F.least(share, F.lit(1.0)), 3))
    return df.drop("_n1", "_n2", "_l2", "_l3", "_best", "_used3")


# ---------------------------------------------------------------- worksheets for people who label pairs

#: Slugs of penalties in the order in which they are looked for.
SLUGS = (
    ("no further action", "no_further_action"), ("disqualif", "dsq"), ("drive-through", "drive_through"), ("drive through", "drive_through"), ("stop-and-go", "stop_and_go"),
    ("stop and go", "stop_and_go"), ("time penalty", "time_penalty"), ("reprimand", "reprimand"), ("grid drop", "grid_drop"), ("grid penalty", "grid_drop"), ("grid place", "grid_drop"),
    ("pit lane start", "pit_lane_start"), ("start from the pit lane", "pit_lane_start"),
)


def penalty_slug(text: Column) -> Column:
    """time_Ns, one of ``SLUGS``, fine, suspended_penalty or other."""
    low = F.lower(text)
    seconds = F.coalesce(tx.extract(low, r"\b(\d+)\s*second\s*time penalty"), tx.extract(low, r"\b(\d+)\s*s(?:ec)?\s*time penalty"))
    late = F.when(low.rlike(r"fined?\s*[€$]"), "fine").when(low.contains("suspended") & low.contains("penalty"), "suspended_penalty").otherwise("other")
    return F.when(seconds.isNotNull(), F.concat(F.lit("time_"), seconds, F.lit("s"))).otherwise(F.coalesce(tx.first_contained(text, SLUGS), late))


def fact_line(text: Column, most: int = 200) -> Column:
    """What follows "Fact" on its line, or the line after it; else what the stewards determine."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    at = F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(F.lower(x).rlike(r"^fact(?: |$)"), i)), lambda i: i.isNotNull()))
    own = F.btrim(F.substring(F.get(lines, at), F.lit(6), F.lit(most)))
    stated = F.when(own == "", F.get(lines, at + 1)).otherwise(own)
    else_ = tx.extract(text, r"(?is)determine the following[:\s]+([^\n]{20,200})")
    return F.left(F.coalesce(F.when(at.isNotNull(), stated), F.btrim(else_), F.lit("")), F.lit(most))


def why(text: Column, most: int = 320) -> Column:
    """What follows "Reason", without the notice on appeals."""
    flat = F.regexp_replace(text, r"\s+", " ")
    body = F.regexp_extract(flat, r"(?i)\bReason\b[:\s]+(.+)", 1)
    return F.left(F.btrim(F.get(F.split(body, "Competitors are reminded|Decisions of the Stewards are taken"), F.lit(0))), F.lit(most))


def decision_line(text: Column, most: int = 140) -> Column:
    body = F.regexp_extract(F.regexp_replace(text, r"[ \t]+", " "), r"(?is)\bDecision\b[:\s]+(.+?)\n\s*Reason\b", 1)
    return F.left(F.btrim(F.regexp_replace(body, r"\s+", " ")), F.lit(most))


def evidence(text: Column) -> Column:
    """Kinds of evidence named after a verb of review, in fixed order; null for none."""
    clauses = F.array_join(F.regexp_extract_all(text, F.lit(r"(?i)(?:reviewed|examined|considered|heard|checked)([^.]{0,300})"), F.lit(0)), " ")
    kinds = F.filter(F.array(*[F.when(clauses.rlike(p), F.lit(k)) for k, p in EVIDENCE]), lambda x: x.isNotNull())
    return F.when(F.size(kinds) > 0, kinds)


def penalty_points(text: Column) -> Column:
    return tx.extract_int(text, r"(?i)(\d{1,2})\s+penalty\s+points?")


def signatories(text: Column, most: int = 5) -> Column:
    block = tx.extract(text, r"(?s)(?:The Stewards|Stewards)\s*:?\s*\n(.*)\z")
    names = F.regexp_extract_all(block, F.lit(r"(?m)^\s*((?:\p{Lu}[\p{L}'.-]+)(?: (?:de|van|von|da|di|\p{Lu}[\p{L}'.-]+)){1,3})\s*$"), F.lit(1))
    return F.slice(F.coalesce(names, F.array().cast("array<string>")), 1, most)


def subjects(text: Column) -> Column:
    """(number, name) of the header line and the bare lines right below it, one a number."""
    block = tx.extract(text, r"(?im)^\s*no\.? ?/ ?driver\s*:?\s*((?:\d{1,2}\s*[-–]\s*[^\n]+\n?)(?:\s*\d{1,2}\s*[-–]\s*[^\n]+\n?)*)")
    lines = F.regexp_extract_all(F.coalesce(block, F.lit("")), F.lit(r"(\d{1,2}\s*[-–]\s*[^\n]+)"), F.lit(1))
    rows = F.transform(lines, lambda l: F.struct(F.regexp_extract(l, r"^(\d{1,2})", 1).cast("int").alias("number"), F.btrim(F.regexp_extract(l, r"[-–]\s*(.*)$", 1)).alias("name")))
    first = F.transform(rows, lambda r, i: F.when(~F.exists(F.slice(rows, 1, i), lambda q: q["number"] == r["number"]), r))
    return F.filter(first, lambda r: r.isNotNull())


def event_of(text: Column) -> Column:
    return F.upper(tx.extract(F.left(text, F.lit(400)), r"(?i)\b(?:20\d{2}\s+)?((?:\p{L}+ ){1,3}grand prix)\b"))


FIELDS = {
    "car": car_number, "driver": driver_name, "involved": involved_cars, "contact": contact, "time": incident_time, "session": session_type,
    "outcome": outcome, "code": penalty_code, "grid": grid_positions, "suspended": suspended, "evidence": evidence, "points": penalty_points,
    "signatories": signatories, "subjects": subjects, "table": table_subjects, "event": event_of, "header": event_header,
}


def extract_fields(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """``df`` with all fields, the offence, lap, turn, citations, reason and a confidence; bad rows give nulls."""
    t = tx.clean(F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_t", t)
    t = F.col("_t")
    out = df.withColumns({name: f(t) for name, f in FIELDS.items()})
    out = out.withColumn("offence", tx.let(t, lambda x: tx.first_rule(x, OFFENCES)))
    out = out.withColumns(
        {
            "category": category_of(F.col("offence")),
            "lap": tx.extract_int(t, r"(?i)\blap\s+(\d{1,2})\b"),
            "turn": tx.extract_int(t, r"(?i)\bturn\s+(\d{1,2})\b"),
            "articles": tx.citations(t),
            "reason": reason(t),
        }
    )
    filled = sum((F.col(c).isNotNull().cast("int") for c in ("car", "driver", "session", "offence", "outcome", "time", "reason")), F.lit(0))
    return out.withColumn("confidence", F.round(F.least(filled / 5.0, F.lit(1.0)), 3)).drop("_t")


def panel_from_boxes(words: DataFrame, doc: str = "doc_id", gap: float = 40.0, line: float = 3.0) -> DataFrame:
    """(doc, line, cell, name): word boxes grouped into lines by baseline and cells by wide gaps.

    words: doc, text, x0, x1, top. Both groupings are gaps-and-islands windows over one document.
    """
    from pyspark.sql import Window

    by = Window.partitionBy(doc).orderBy("top", "x0")
    words = words.withColumn("_new", F.coalesce((F.col("top") - F.lag("top").over(by) > line).cast("int"), F.lit(1)))
    words = words.withColumn("line", F.sum("_new").over(by))
    across = Window.partitionBy(doc, "line").orderBy("x0")
    words = words.withColumn("_new", F.coalesce((F.col("x0") - F.lag("x1").over(across) > gap).cast("int"), F.lit(1)))
    words = words.withColumn("cell", F.sum("_new").over(across))
    cells = words.groupBy(doc, "line", "cell").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda s: s["text"]), " ").alias("name"))
    parts = F.split("name", " ")
    looks = F.size(parts).between(2, 4) & F.forall(parts, lambda w: w.rlike(r"^\p{Lu}[\p{L}'.-]*$") | w.isin("de", "van", "von", "da", "di"))
    return cells.where(looks)


def guideline_articles(lines: DataFrame, doc: str = "doc_id", order: str = "line_no") -> DataFrame:
    """(doc, section, article, text, recommended): lines folded under their all-capitals section and dotted article number.

    ``recommended`` is what follows "penalty", "sanction" or "decision" in the text, null if nothing does.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    number = tx.extract(F.col("text"), r"(?i)^\s*(?:art(?:icle)?\.?\s*)?(\d+(?:\.\d+)+)\b")
    head = F.when(F.col("text").rlike(r"^[^\p{Ll}]*\p{Lu}{3}[^\p{Ll}]*$") & number.isNull(), F.btrim("text"))
    rows = lines.withColumn("section", F.last(head, True).over(w)).withColumn("article", F.last(number, True).over(w)).where(head.isNull() & F.col("article").isNotNull())
    own = F.btrim(F.regexp_replace("text", r"(?i)^\s*(?:art(?:icle)?\.?\s*)?\d+(?:\.\d+)+\s*[–:-]?\s*", ""))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_own"))), lambda s: s["_own"]), " ")
    out = rows.withColumn("_own", own).groupBy(doc, "section", "article").agg(body.alias("text"))
    return out.withColumn("recommended", F.btrim(tx.extract(F.col("text"), r"(?i)(?:penalty|sanction|decision)[:\s]+([^\n.;]{5,120})")))
