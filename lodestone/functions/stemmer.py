"""The suffix-stripping English stemmer of M. F. Porter (1980) as column expressions.

A word is consonant and vowel runs, [C](VC)^m[V]; rules strip an ending if what is left of the word has a
measure m, holds a vowel, or ends in a given shape. Each step binds the word once, so the expression
grows with the number of rules and not with their product. Stem distinct terms where you can: a corpus'
vocabulary is far smaller than its words.

Defined cases: words of up to two letters and words with anything but a-z stay as they are (in lower case); null stays null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import let

#: A leading y counts as a consonant and is written Y meanwhile; any y after a vowel is taken as a consonant by the runs.
CONSONANT, VOWEL = "[^aeiou]", "[aeiouy]"
C_RUN, V_RUN = CONSONANT + "[^aeiouy]*", VOWEL + "[aeiou]*"
#: Shapes of a stem.
SOME = f"^({C_RUN})?{V_RUN}{C_RUN}"
ONE = f"^({C_RUN})?{V_RUN}{C_RUN}({V_RUN})?$"
MORE = f"^({C_RUN})?{V_RUN}{C_RUN}{V_RUN}{C_RUN}"
HAS_VOWEL = f"^({C_RUN})?{VOWEL}"
SHORT_END = f"^{C_RUN}{VOWEL}[^aeiouwxy]$"
DOUBLE_END = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|yy)$"
#: Endings and what they become, longest first where one ends another.
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _cut(word: Column, ending: int) -> Column:
    return F.left(word, F.length(word) - ending)


def _replace(word: Column, rules: Sequence[tuple[str, str]], shape: str) -> Column:
    """The first ending that fits is the only one tried: replaced if the stem has the shape."""
    out = None
    for ending, by in rules:
        stem = _cut(word, len(ending))
        new = F.when(stem.rlike(shape), F.concat(stem, F.lit(by))).otherwise(word)
        fits = F.endswith(word, F.lit(ending))
        out = F.when(fits, new) if out is None else out.when(fits, new)
    return out.otherwise(word)


def _plural(w: Column) -> Column:
    return F.when(w.rlike("(sses|ies)$"), _cut(w, 2)).when(w.rlike("[^s]s$"), _cut(w, 1)).otherwise(w)


def _mend(w: Column) -> Column:
    """After -ed and -ing: an e again, or one of two equal letters."""
    return F.when(w.rlike("(at|bl|iz)$"), F.concat(w, F.lit("e"))).when(w.rlike(DOUBLE_END), _cut(w, 1)).when(w.rlike(SHORT_END), F.concat(w, F.lit("e"))).otherwise(w)


def _past(w: Column) -> Column:
    eed = F.when(_cut(w, 3).rlike(SOME), _cut(w, 1)).otherwise(w)
    ed = F.when(_cut(w, 2).rlike(HAS_VOWEL), let(_cut(w, 2), _mend)).otherwise(w)
    ing = F.when(_cut(w, 3).rlike(HAS_VOWEL), let(_cut(w, 3), _mend)).otherwise(w)
    return F.when(w.rlike("eed$"), eed).when(w.rlike("ed$"), ed).when(w.rlike("ing$"), ing).otherwise(w)


def _y(w: Column) -> Column:
    return F.when(w.rlike("y$") & _cut(w, 1).rlike(HAS_VOWEL), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _last(w: Column) -> Column:
    ion = F.when(_cut(w, 3).rlike("[st]$") & _cut(w, 3).rlike(MORE), _cut(w, 3)).otherwise(w)
    ordered = sorted(STEP_4, key=len, reverse=True)
    longer = _replace(w, [(e, "") for e in ordered if len(e) > 2], MORE)
    shorter = _replace(w, [(e, "") for e in ordered if len(e) == 2], MORE)
    known = "(" + "|".join(e for e in ordered if len(e) > 2) + ")$"
    return F.when(w.rlike(known), longer).when(w.rlike("ion$"), ion).otherwise(shorter)


def _e(w: Column) -> Column:
    stem = _cut(w, 1)
    return F.when(w.rlike("e$") & (stem.rlike(MORE) | (stem.rlike(ONE) & ~stem.rlike(SHORT_END))), stem).otherwise(w)


def _ll(w: Column) -> Column:
    return F.when(w.rlike("ll$") & w.rlike(MORE), _cut(w, 1)).otherwise(w)


def english_stem(term: Column) -> Column:
    """The stem of an English word."""

    def steps(w: Column) -> Column:
        out = F.when(F.startswith(w, F.lit("y")), F.concat(F.lit("Y"), F.substring(w, 2, 1 << 30))).otherwise(w)
        for step in (_plural, _past, _y, lambda x: _replace(x, STEP_2, SOME), lambda x: _replace(x, STEP_3, SOME), _last, _e, _ll):
            out = let(out, step)
        return F.lower(out)

    return let(F.lower(term), lambda w: F.when(w.rlike("^[a-z]{3,}$"), steps(w)).otherwise(w))
