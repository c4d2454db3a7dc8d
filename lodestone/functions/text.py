"""Text column functions: tokens, cleaning, rule tables, sections, citations, scores and dates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(x)`` with ``value`` computed once a row, however often ``x`` occurs."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    """Maximal runs of a-z and 0-9 in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """First match or null (not an empty string)."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def extract_int(text: Column, pattern: str, group: int = 1) -> Column:
    return F.try_to_number(extract(text, pattern, group), F.lit("999999999")).cast("int")


def first_rule(text: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """Name of the first rule whose pattern occurs; order matters."""
    out = F.lit(default).cast("string")
    for name, pattern in reversed(list(rules)):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def first_contained(text: Column, terms: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """Value of the first term contained in the lower-cased text."""

    def first(low: Column) -> Column:
        out = F.lit(default).cast("string")
        for term, value in reversed(list(terms)):
            out = F.when(low.contains(term), F.lit(value)).otherwise(out)
        return out

    return let(F.lower(text), first)


#: Characters and what stands for them in clean text.
SUBSTITUTES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("–", "-"), ("—", "-"), ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), (" ", " "))


#: Marks and headers that every page of a ruling repeats.
PAGE_MARKS = r"(?i)FIA\s+F1\s+Document\s+\d+/\d{4}|Fédération\s+Internationale\s+de\s+l'Automobile[^\n]*(?:\n|\z)|THE\s+STEWARDS\s+OF\s+THE\s+MEETING\s*\n?"


def clean(text: Column, drop_lines: str = r"(?m)^[ \t]*(?:page[ \t]+\d+(?:[ \t]+of[ \t]+\d+)?|[-_=*]{3,}|\d{1,3})[ \t]*$\n?") -> Column:
    """Substitute characters, rejoin words cut at line ends, drop page marks, page and divider lines, trim."""
    single = [(old, new) for old, new in SUBSTITUTES if len(new) == 1]
    text = F.translate(text, "".join(o for o, _ in single), "".join(n for _, n in single))
    for old, new in SUBSTITUTES:
        if len(new) > 1:
            text = F.replace(text, F.lit(old), F.lit(new))
    text = F.regexp_replace(text, r"(\p{L})-\n(\p{Ll})", "$1$2")
    text = F.regexp_replace(text, PAGE_MARKS, "")
    text = F.regexp_replace(text, "(?i)" + drop_lines, "")
    text = F.regexp_replace(text, r"[ \t]+\n", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def slug(text: Column, length: int = 80) -> Column:
    """Letters, digits, dash and underscore; white space becomes one underscore."""
    return F.left(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9 _-]", "_"), r"\s+", "_"), F.lit(length))


def content_name(title: Column, body: Column) -> Column:
    """A name that changes with the content: slug and the first 16 digits of its digest."""
    return F.concat(slug(title), F.lit("-"), F.left(F.sha2(body, 256), F.lit(16)))


def fold_accents(text: Column) -> Column:
    """Lower case without marks, letters and digits only."""
    marks = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿšžœ"
    plain = "aaaaaaceeeeiiiinoooooouuuuyyszo"
    return F.regexp_replace(F.translate(F.lower(text), marks, plain), "[^a-z0-9]", "")


def normalise_title(title: Column) -> Column:
    return F.btrim(F.regexp_replace(title, r"(?i)\s*published on \d{1,2} \w+ \d{4}\s*$", ""), F.lit(" -_"))


def escape_percent(url: Column) -> Column:
    """A percent sign that starts no escape becomes %25."""
    return F.regexp_replace(url, "%(?![0-9A-Fa-f]{2})", "%25")


def section(text: Column, heading: str, until: str, most: int = 6000) -> Column:
    """Text after a heading line up to the next heading, cut at a sentence end past the middle."""
    body = extract(text, rf"(?is)(?:^|\n)[ \t]*(?:{heading})[ \t]*:?[ \t]*\n?(.*?)(?=\n[ \t]*(?:{until})[ \t]*:?|\z)")

    def shorten(cut: Column) -> Column:
        end = F.length(cut) - F.instr(F.reverse(cut), ".") + 1
        return F.when((F.instr(cut, ".") > 0) & (end > most // 2), F.left(cut, end)).otherwise(cut)

    return let(F.btrim(body), lambda b: F.when(F.length(b) <= most, b).otherwise(let(F.left(b, F.lit(most)), shorten)))


_ONE = r"\d+(?:\.[0-9A-Za-z]+)*(?:[a-z](?![a-z]))?(?:\s*\([a-z0-9]+\))*"
_CITED = rf"(?i)\bArt(?:icle)?s?\.?\s*[A-Z]?{_ONE}(?:\s*(?:,|\band\b|&)\s*{_ONE})*|\bAppendix\s+(?:[A-Z](?![a-z])|\d+)(?:\s*,?\s*(?:Chapter|Section)\s+[IVXLCDM0-9]+\b)?"


def citations(text: Column) -> Column:
    """Distinct articles and appendices in order, case aside.

    Lists after one prefix are split; white space goes, and so does the dot before a paragraph letter
    that follows a digit; an appendix keeps its letter in capitals and its chapter after a comma.
    """

    def appendix(match: Column) -> Column:
        name = F.upper(F.regexp_extract(match, r"(?i)^appendix\s+(\w+)", 1))
        chapter = F.regexp_extract(match, r"(?i)((?:chapter|section)\s+\w+)$", 1)
        return F.array(F.concat(F.lit("Appendix "), name, F.when(chapter != "", F.concat(F.lit(", "), F.regexp_replace(chapter, r"\s+", " "))).otherwise("")))

    def articles(match: Column) -> Column:
        parts = F.split(F.regexp_replace(match, r"(?i)^art(?:icle)?s?\.?\s*", ""), r"\s*(?:,|\band\b|&)\s*")
        return F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"\s|\.+$", ""), r"(?<=\d)\.(?=[a-z]$)", ""))

    found = F.regexp_extract_all(text, F.lit(_CITED), F.lit(0))
    every = F.flatten(F.transform(found, lambda m: F.when(F.lower(m).startswith("app"), appendix(m)).otherwise(articles(m))))
    every = F.filter(every, lambda x: x != "")
    return let(every, lambda e: F.filter(F.transform(e, lambda x, i: F.when(~F.exists(F.slice(e, 1, i), lambda y: F.lower(y) == F.lower(x)), x)), lambda x: x.isNotNull()))


def normalise_article(article: Column) -> Column:
    """Without its prefix; null without a digit; an appendix keeps its name."""
    plain = F.btrim(F.regexp_replace(article, r"(?i)^\s*art(?:icle)?s?\.?\s*", ""))
    return F.when(article.rlike(r"(?i)^\s*appendix\b"), F.btrim(article)).when(plain.rlike(r"\d"), plain)


def snippet(text: Column, terms: Column, before: int = 60, after: int = 200) -> Column:
    """A window around the first term (in their order) that occurs; else the beginning."""
    low = F.lower(text)
    places = F.filter(F.transform(terms, lambda t: F.position(t, low)), lambda p: p > 0)
    at = F.coalesce(F.get(places, F.lit(0)), F.lit(0))
    start = F.greatest(at - before, F.lit(1))
    stop = F.least(at + after, F.length(text) + 1)
    window = F.concat(F.when(start > 1, F.lit("…")).otherwise(""), F.btrim(F.substring(text, start, stop - start)), F.when(stop <= F.length(text), F.lit("…")).otherwise(""))
    head = F.when(F.length(text) > after, F.concat(F.left(text, F.lit(after)), F.lit("…"))).otherwise(text)
    return F.when(at > 0, window).otherwise(head)


def headline(text: Column, terms: Column, words: int = 30, before: int = 10) -> Column:
    """One fragment of at most ``words`` words that begins ``before`` words ahead of the first term; else the first words."""

    def cut(split: Column) -> Column:
        at = F.array_min(F.filter(F.transform(split, lambda w, i: F.when(F.exists(terms, lambda t: F.array_contains(tokens(w), t)), i + 1)), lambda i: i.isNotNull()))
        return F.array_join(F.slice(split, F.greatest(F.coalesce(at, F.lit(1)) - before, F.lit(1)).cast("int"), words), " ")

    return let(F.split(F.btrim(text), r"[ \t\n]+"), cut)


#: Endings that a stem loses, and the least length of a word that loses one.
ENDINGS, LEAST_STEM = "(?:ations?|ings?|edly|ed|ly|ies|es|s)", 5


def stem(term: Column) -> Column:
    """A word without its ending: stands for an English stemmer."""
    return F.when(F.length(term) >= LEAST_STEM, F.regexp_replace(term, ENDINGS + "$", "")).otherwise(term)


def cue_count(text: Column, words: Sequence[str]) -> Column:
    """How often any of the words occurs, case aside."""
    return F.regexp_count(F.lower(text), F.lit(r"(?U)\b(" + "|".join(words) + r")\b"))


def urgency(text: Column, high: Sequence[str], low: Sequence[str]) -> Column:
    score = 0.25 * cue_count(text, high) - 0.1 * cue_count(text, low)
    return F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 3)


def sentiment(text: Column, negative: Sequence[str], calm: Sequence[str]) -> Column:
    score = -0.3 * cue_count(text, negative) + F.when(cue_count(text, calm) > 0, 0.1).otherwise(0.0)
    return F.round(F.least(F.greatest(score, F.lit(-1.0)), F.lit(1.0)), 3)


def loudness(text: Column, cues: Sequence[str]) -> Column:
    """Cues, exclamation marks and words in capitals on a scale to 1."""
    raw = (cue_count(text, cues) + 0.5 * F.regexp_count(text, F.lit("!")) + 0.3 * F.regexp_count(text, F.lit(r"(?U)\b[A-Z]{3,}\b"))) / 4.0
    return F.round(F.least(raw, F.lit(1.0)), 3)


def local_to_utc(text: Column, zone: str = "Europe/Paris", pattern: str = r"(\d{2}\.\d{2}\.\d{2} \d{2}:\d{2})") -> Column:
    """First "dd.MM.yy HH:mm" as an instant; null for dates that do not exist."""
    return F.to_utc_timestamp(F.try_to_timestamp(extract(text, pattern), F.lit("dd.MM.yy HH:mm")), zone)


def any_date(text: Column, formats: Sequence[str] = ("yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy", "d MMMM yyyy", "MMMM d, yyyy")) -> Column:
    """The first format that fits."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats])


def iso_timestamp(text: Column) -> Column:
    """ISO 8601 with Z, an offset or none (UTC); null if malformed."""
    return F.try_to_timestamp(text)


def natural_key(number: Column) -> Column:
    """Sort key of dotted numbers: 2.10 after 2.9."""
    return F.transform(F.regexp_extract_all(number, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))
