"""Keywords of a text: the word runs between stop words and punctuation (RAKE candidate phrases)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that end a phrase.
STOP_WORDS = tuple(
    (
        "a about after all also am an and any are as at be because been before being but by can could did do does "
        "down for from had has have he her here him his how i if in into is it its just like me more most my no not "
        "now of off on only or other our out over own she should so some such than that the their them then there "
        "these they this those through to too under until up very was we were what when where which while who whom "
        "why will with would you your "
        "au aux avec ce de des du elle en et est il la le les ou par pas pour que qui sur un une "
        "das dem den der die ein eine einen im ist mit nicht sie und von zu "
        "con del el es las lo los para por se una y"
    ).split()
)


def keywords(text: Column) -> Column:
    """All phrases of ``text`` in order, repeats kept; empty array for a null text."""
    cleaned = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N} ]+", " | ")
    words = F.split(F.trim(cleaned), " +")
    marked = F.transform(words, lambda w: F.when(w.isin(*STOP_WORDS), F.lit("|")).otherwise(w))
    phrases = F.transform(F.split(F.array_join(marked, " "), r"\|"), lambda p: F.trim(p))
    return F.coalesce(F.filter(phrases, lambda p: p != ""), F.array().cast("array<string>"))
