"""Secrets in texts, told apart by corpus-wide ownership: who else holds the same value.

1. Every text is searched for three kinds of base matches (``assign``, ``access``, ``hex``) and for ``opaque`` words: long runs of letters,
   digits and ``+/_-`` with at least a digit and a letter. Matches and the texts between them give the positions; a value leaves the scan as its SHA-256 only.
2. Values are counted over the whole corpus: rows, distinct repositories and distinct owners.
3. A value with ``wide`` owners or more is an ``example`` that was copied around, one with several but fewer owners is ``shared``. A
   value of one owner is ``live`` if it looks like a credential (a digit, a letter, no placeholder, no run of one character) and ``weak`` if not.
4. Base matches always stay, with their verdict. An opaque word that overlaps no base match is added where its value is live, and it mixes upper
   case, lower case and digits or is known as the value of a base match elsewhere.

Only DataFrame functions: no Python code runs in tasks. Spans are code points, the end exclusive; matches are leftmost and do not overlap within a kind.
Hot values are counted before the shuffle; the verdicts are stored, so that adaptive execution can split a hot value when they are joined.

Defined cases: a null text counts as empty; an empty text has no spans; a null repository or owner is a repository or owner of its own; rows
that repeat an id, or are equal, are scanned each by itself; an empty table gives no rows; other columns take no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtrends.llm.common import Workspace

# The three base patterns. A run of at least the wanted length begins where any match of the run begins, so that
# the lengths of access and hex are part of their patterns; a short value of assign uses up its match and is dropped afterwards.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
SHORTEST_VALUE = 6
#: Words that are looked at beside the base kinds.
OPAQUE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "opaque": OPAQUE}
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|abcdef|(?<![0-9])0?123456|(.)\1{4}"


def _cuts(text: Column, kind: str) -> Column:
    """Per match of a kind: the length of the text since the match before, its own length, and the value's hash and looks."""
    pattern = KINDS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # one piece more than matches: what follows the last one is not needed
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))

    def cut(gap: Column, match: Column) -> Column:
        value = F.regexp_extract(match, ASSIGN, 2) if kind == "assign" else match
        # in the struct only the hash of the value is kept
        return F.struct(
            F.length(gap).alias("gap"), F.length(match).alias("n"), F.length(value).alias("n_value"), F.sha2(value, 256).alias("value"),
            (value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDER)).alias("looks"),
            (value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")).alias("mixed"))

    none = F.array().cast("array<struct<gap:int,n:int,n_value:int,value:string,looks:boolean,mixed:boolean>>")
    return F.when(text.rlike(pattern), F.zip_with(gaps, matches, cut)).otherwise(none)


def found_spans(found: DataFrame) -> DataFrame:
    """(row, repository, owner, kind, start, end, value, looks, mixed) of every match that counts; running sums per row and kind give the places."""
    cuts = found.select("row", "repository", "owner", F.inline(F.array(*[
        F.struct(F.lit(number).alias("kind"), F.col(name).alias("cuts")) for number, name in enumerate(KINDS)]))).where("size(cuts) > 0")
    one = cuts.select("row", "repository", "owner", "kind", F.posexplode("cuts").alias("at", "cut")).select(
        "row", "repository", "owner", "kind", "at", "cut.*")
    so_far = F.sum(F.col("gap").cast("long") + F.col("n")).over(Window.partitionBy("row", "kind").orderBy("at"))
    placed = one.withColumn("end", so_far).withColumn("start", F.col("end") - F.col("n"))
    counts = (F.col("kind") != 0) | (F.col("n_value") >= SHORTEST_VALUE)
    likely = (F.col("kind") != 3) | F.col("looks")
    return placed.where(counts & likely).select("row", "repository", "owner", "kind", "start", "end", "value", "looks", "mixed")


def without_overlaps(spans: DataFrame) -> DataFrame:
    """Opaque words that touch a base match of their row are left out."""
    base = F.col("kind") < 3
    by_start = Window.partitionBy("row").orderBy("start", "kind")
    before = F.max(F.when(base, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.min(F.when(base, F.col("start"))).over(by_start.rowsBetween(1, Window.unboundedFollowing))
    marked = spans.withColumns({"_before": before, "_behind": behind})
    clear = (F.coalesce("_before", F.lit(-1)) <= F.col("start")) & (F.coalesce("_behind", F.col("end")) >= F.col("end"))
    return marked.where(base | clear).drop("_before", "_behind")


def ownership(spans: DataFrame, wide: int) -> DataFrame:
    """(value, n_rows, n_repositories, n_owners, known, verdict) of every value in the corpus."""
    # null sites count as one site: distinct counts pass over nulls
    site = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")).alias(c)
    held = spans.groupBy("value", site("repository"), site("owner")).agg(
        F.count("*").alias("n"), F.max("looks").alias("looks"), F.max(F.col("kind") < 3).alias("known"))
    values = held.groupBy("value").agg(
        F.sum("n").alias("n_rows"), F.count_distinct("repository").alias("n_repositories"), F.count_distinct("owner").alias("n_owners"),
        F.max("looks").alias("looks"), F.max("known").alias("known"))
    verdict = F.when(F.col("n_owners") >= wide, "example").when(F.col("n_owners") > 1, "shared").when(F.col("looks"), "live").otherwise("weak")
    return values.withColumn("verdict", verdict).drop("looks")


def scan(docs: DataFrame, repository: Column, owner: Column, wide: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans) of each row: an array of (start, kind, end, name, value, n_repositories, n_owners, verdict) by start, then kind as listed.

    ``value`` is the SHA-256 of the value; ``wide`` is the number of owners from which on a value is an example.
    """
    work = Workspace(docs.sparkSession, "secrets")
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # stored, so that the numbers of the rows stay what they are; no text is kept
    found = work.store(docs.select(
        F.col(key).alias("key"), repository.cast("string").alias("repository"), owner.cast("string").alias("owner"),
        F.monotonically_increasing_id().alias("row"), *[_cuts(whole, kind).alias(kind) for kind in KINDS]), "found")
    spans = work.store(without_overlaps(found_spans(found)), "spans")
    values = work.store(ownership(spans, wide), "values")
    judged = spans.select("row", "kind", "start", "end", "value", "mixed").join(values, "value")
    stays = (F.col("kind") < 3) | ((F.col("verdict") == "live") & (F.col("mixed") | F.col("known")))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1).alias("name")
    span = F.struct("start", "kind", "end", name, "value", "n_repositories", "n_owners", "verdict")
    listed = judged.where(stays).groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast(listed.schema["spans"].dataType)
    return found.select("row", F.col("key").alias(key)).join(listed, "row", "left").select(key, F.coalesce("spans", none).alias("spans"))


def written(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")
