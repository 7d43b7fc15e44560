"""Column functions for log text: tokens, masking, verb keys and patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WILDCARD = "<*>"
BLANKS = " \t\n\r\f\x0b"

# Token classes that count as variables.
NUMBER = r"[+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?%?|[+-]?\.[0-9]+|[0-9]+(?:st|nd|rd|th)"
DATE = (
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[t ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?:z|[+-][0-9]{2}:?[0-9]{2})?)?,?"
    r"|[0-9]{1,2}/[0-9]{1,2}/(?:[0-9]{4}|[0-9]{2})"
)
CLOCK = r"[0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]+)?)?,?"
CALENDAR = (
    r"jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?"
    r"|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
    r"|mon(?:day)?|tue(?:s|sday)?|wed(?:nesday)?|thu(?:r|rs|rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?"
)
DURATION = r"[0-9]+(?:\.[0-9]+)?[hms]"
SPELLED = "one|two|three|four|five|six|seven|eight|nine|ten"
VARIABLE = "|".join([NUMBER, DATE, CLOCK, CALENDAR, DURATION, SPELLED])

# Optional token classes, off by default.
OPTIONAL_CLASSES = {
    "ipv4": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?",
    "hex": r"0x[0-9a-f]+",
    "uuid": r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}",
}

# Base forms of verbs that are common in console logs, and auxiliary verbs.
VERB_BASES = (
    "accept access add allow append assign attempt authenticate begin bind block call cancel check clean clear "
    "close commit complete configure connect create delete deny disconnect drop exceed execute exit expire fail "
    "fetch find finish flush generate get handle ignore initialize insert install listen load lock log miss move "
    "open parse process publish pull push read receive reconnect register reject release reload remove replace "
    "request reset resolve respond restart retry return run save scan schedule send serve set shut skip start "
    "stop store submit succeed terminate update upload use validate verify wait write"
).split()
AUXILIARY_VERBS = "is are was were be been being am has have had having do does did doing".split()


def _inflect(verb: str) -> list[str]:
    stem = verb[:-1] if verb.endswith("e") else verb
    third = verb + ("es" if verb.endswith(("s", "sh", "ch", "x")) else "s")
    doubled = [verb + verb[-1] + "ed", verb + verb[-1] + "ing"] if verb[-1] in "tpgnbdl" else []
    return [verb, third, stem + "ed", stem + "ing", *doubled]


VERBS = tuple(sorted({form for base in VERB_BASES for form in _inflect(base)} | set(AUXILIARY_VERBS)))


def strip(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def tokens(line: Column) -> Column:
    """Words of a line, separated by one or more spaces."""
    return F.split(strip(line), " +")


def variable_regex(extra: tuple[str, ...] = ()) -> str:
    """One variable token; a token that already is the wildcard counts as one."""
    return "(?:" + "|".join([VARIABLE, *(OPTIONAL_CLASSES[name] for name in extra), r"<\*>"]) + ")"


def single_spaced(line: Column) -> Column:
    return F.regexp_replace(strip(line), " {2,}", " ")


def shape(line: Column, extra: tuple[str, ...] = ()) -> Column:
    """The line with every variable token masked and runs of masks collapsed.

    Each token is its own match, and a mask right behind a mask is removed: a long run of
    variables must not become one long repetition, which Java handles by recursion.
    """
    masked = F.regexp_replace(single_spaced(line), f"(?i)(^| ){variable_regex(extra)}(?= |$)", "$1<*>")
    return F.regexp_replace(masked, r"(?:(?<= <\*>)|(?<=^<\*>)) <\*>(?= |$)", "")


def verb_key(line: Column, verbs: tuple[str, ...] = VERBS) -> Column:
    """Verbs of a line with their 0-based token position, as ``array<struct<word, pos>>``."""
    placed = F.transform(tokens(line), lambda t, i: F.struct(t.alias("word"), i.cast("int").alias("pos")))
    return F.filter(placed, lambda p: F.lower(p["word"]).isin(*verbs))


def flat_key(key: Column) -> Column:
    """Printable form of a verb key: ``word@pos word@pos``."""
    return F.array_join(F.transform(key, lambda p: F.concat(p["word"], F.lit("@"), p["pos"].cast("string"))), " ")


def escape(text: Column) -> Column:
    """Put a backslash before everything that is not a letter, digit or space."""
    return F.regexp_replace(text, r"([^\p{L}\p{N} ])", r"\\$1")


def shape_to_text(masked: Column) -> Column:
    """Text form of a template: ``*`` for a wildcard, all other special characters escaped."""
    parts = F.transform(
        F.split(masked, " "), lambda t: F.when(t == WILDCARD, F.lit("*")).otherwise(escape(t))
    )
    return F.array_join(parts, " ")


def text_to_regex(pattern: Column) -> Column:
    """Regular expression of a text-form template: ``*`` is one or more characters, the match
    starts at the beginning of the line and may end before its end.

    A piece after a wildcard is matched at its first occurrence and never again (atomic
    group). For patterns of this form the first occurrence is always a sufficient choice,
    so the set of matching lines is unchanged and the work stays linear in the line.
    """
    pieces = F.transform(
        F.split(pattern, r"(?<!\\)\*", -1), lambda p: escape(F.regexp_replace(p, r"\\(.)", "$1"))
    )
    rest = F.transform(
        F.slice(pieces, 2, F.size(pieces)),
        lambda p: F.when(p == "", F.lit(".")).otherwise(F.concat(F.lit("(?>.+?"), p, F.lit(")"))),
    )
    return F.concat(F.lit("(?s)^(?:"), F.element_at(pieces, 1), F.array_join(rest, ""), F.lit(")"))


def shape_to_regex(masked: Column) -> Column:
    """Regular expression of an inferred template, for single-spaced lines: a wildcard is zero
    or more tokens and the whole line has to match. Inner pieces are atomic for the same
    reason as above."""
    words = F.transform(F.split(masked, " "), lambda t: F.when(t == WILDCARD, t).otherwise(escape(t)))
    pieces = F.split(F.array_join(words, " "), r"(?:^| )<\*>(?= |$)", -1)
    spaced = F.transform(pieces, lambda p: F.ltrim(p))
    first, last = F.element_at(spaced, 1), F.element_at(spaced, -1)
    inner = F.array_join(
        F.transform(
            F.slice(spaced, 2, F.greatest(F.size(spaced) - 2, F.lit(0))),
            lambda p: F.concat(F.lit(r"(?>.*?(?:^| )"), p, F.lit(r"(?= |\z))")),
        ),
        "",
    )
    head = F.when(first == "", F.lit("")).otherwise(F.concat(first, F.lit(r"(?= |\z)")))
    tail = F.when(last == "", F.lit(".*")).otherwise(F.concat(F.lit(".*(?:^| )"), last))
    body = F.when(F.size(spaced) == 1, first).otherwise(F.concat(head, inner, tail))
    return F.concat(F.lit("(?s)^(?:"), body, F.lit(r")\z"))


def literal_count(pattern: Column, wildcard: str) -> Column:
    """Number of words of a pattern that are not just a wildcard."""
    return F.size(F.filter(F.split(pattern, " "), lambda t: (t != wildcard) & (t != "")))
