"""Templates: shape groups, inference, compilation and matching of lines."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtrends.functions import text as T
from logtrends.operators.inference import NEVER, common_template, lcs_table, left_of, match_all, run_blocks, template_matcher  # noqa: F401
from logtrends.operators.order import number_all
from logtrends.session import Scratch, scratch_path

#: Words that one task of the template inference looks at; parts of the order in one round. Neither changes a result.
WORDS_PER_TASK, PARTS = 1_000_000, 4_096
MERGED, ALONE, LEFT = "merged", "alone", "left"
INLINE_TEMPLATES = 256
#: Bytes of the lines that a task matches at once; words of the templates with wildcards that it reads at a time, about. Neither changes a result.
LINE_BYTES, TEMPLATE_WORDS = 16_000_000, 100_000
POLICIES = ("first", "last", "most_specific")


# -- shapes ---------------------------------------------------------------------------------

def shapes(lines: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Each line with its masked form and its verb key (printable)."""
    return lines.select(
        "*",
        T.flat_key(T.verb_key(F.col("line"))).alias("verb_key"),
        T.shape(F.col("line"), extra).alias("shape"),
    )


def shape_groups(lines: DataFrame) -> DataFrame:
    """Per verb key: number of distinct shapes and of lines, and the smallest shape."""
    return (
        shapes(lines).groupBy("verb_key", "shape").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("verb_key")
        .agg(
            F.count(F.lit(1)).alias("n_shapes"),
            F.sum("n").alias("n_lines"),
            F.min("shape").alias("example"),
        )
    )


# -- inference ------------------------------------------------------------------------------

_PENDING = "verb_key string, pos long, shape string, taken long, waits boolean, after long"
_COLUMNS = [field.split(" ")[0] for field in _PENDING.split(", ")]
_DECIDED = "verb_key string, pos long, shape string, taken long, kind string"


def _n_words() -> Column:
    return F.size(F.split("shape", " "))


def _words(df: DataFrame, *columns: str) -> DataFrame:
    """One row per shape and different literal word."""
    literals = F.filter(F.split("shape", " "), lambda w: w != T.WILDCARD)
    return df.select("verb_key", *columns, F.explode(F.array_distinct(literals)).alias("word"))


def infer_templates(lines: DataFrame, words_per_task: int = WORDS_PER_TASK) -> DataFrame:
    """Templates of all lines: the greedy rule of ``inference`` over the distinct shapes of each verb key, in the order (words, text).

    A shape's position is the number of words before it. In each round every key takes the shapes of its next ``words_per_task`` words, with the
    seeds that still wait for a partner; one task per key (or for many small keys) decides what these rows tell. Then the shapes behind lose, in
    parts and in parallel, what the new templates cover, which is most of them. If the seeds that wait become more than one
    task should hold, they are decided by reservations, in joins. The number does not change the result.
    """
    work = Scratch(lines.sparkSession, "infer")
    every = work.store(shapes(lines).select("verb_key", "shape").distinct().withColumn("n_words", _n_words()))
    numbered = number_all(every, [F.col("verb_key"), F.col("n_words"), F.col("shape")], "pos", "n_words")
    pending = work.store(numbered.select(
        "verb_key", F.col("pos").cast("long"), "shape", F.lit(NEVER).alias("taken"), F.lit(False).alias("waits"), F.lit(-1).cast("long").alias("after")))
    done: list[DataFrame] = []
    while True:
        plan = work.store(_plan(pending, words_per_task))
        n_words, ends = plan.agg(F.sum("n_words"), F.bool_and("last")).first()
        marked = pending.join(plan.withColumnRenamed("n_words", "n_now"), "verb_key", "left").withColumn("now", F.col("waits") | (F.col("pos") < F.col("upto")))
        decided = work.store(_decide_blocks(marked.filter("now"), n_words or 0, words_per_task))
        done.append(decided.filter(F.col("kind") != LEFT).select("shape"))
        if ends is not False:  # nothing lies behind in any key: all is decided
            break
        left = decided.filter(F.col("kind") == LEFT).select("verb_key", "pos", "shape", "taken", F.lit(True).alias("waits"), F.lit(-1).cast("long").alias("after"))
        kept = _without_covered(marked.filter("not now").select(_COLUMNS), decided, words_per_task)
        before, pending = pending, work.store(left.unionByName(kept))
        work.drop(before)
        while not (crowded := _crowded(pending, words_per_task)).isEmpty():
            found, pending_after = _reserve(pending, crowded, work, words_per_task)
            done.append(found.filter(F.col("kind") != LEFT).select("shape"))
            before, pending = pending, pending_after
            work.drop(before)
    result = number_templates(work.store(reduce(DataFrame.unionByName, done).distinct()))
    work.drop_all()
    return result


def _plan(pending: DataFrame, words: int) -> DataFrame:
    """(verb_key, upto, last, n_words): the position up to which a key's shapes take part now, whether these are all, and their words.

    Words are counted by stretches of the order, of which at most ``PARTS`` are looked at.
    """
    grain = max(1, words // 16)
    parts = pending.filter("not waits").groupBy("verb_key", F.floor(F.col("pos") / grain).alias("part")).agg(F.sum(_n_words()).alias("n"))
    number = parts.groupBy("verb_key").agg(F.count(F.lit(1)).alias("parts"))
    in_order = Window.partitionBy("verb_key").orderBy("part")
    first = parts.withColumn("rank", F.row_number().over(in_order)).filter(F.col("rank") <= PARTS)
    fits = first.withColumn("before", F.sum("n").over(in_order) - F.col("n")).filter(F.col("before") < words)
    taken = fits.groupBy("verb_key").agg(
        ((F.max("part") + 1) * grain).alias("upto"), F.count(F.lit(1)).alias("n_parts"), F.sum("n").alias("n_words"))
    return taken.join(number, "verb_key").select("verb_key", "upto", (F.col("n_parts") == F.col("parts")).alias("last"), "n_words")


def _decide_blocks(block: DataFrame, n_words: int, words: int) -> DataFrame:
    """What ``run_blocks`` says of the rows of every key. Keys with few words share a task."""
    tasks = max(1, -(-n_words // words), block.sparkSession.sparkContext.defaultParallelism)
    small = F.coalesce(F.col("n_now"), F.lit(0)) < words // 8
    rows = block.select(
        "verb_key", "pos", "shape", "taken", "waits", F.coalesce("last", F.lit(True)).alias("last"),
        F.when(small, F.pmod(F.xxhash64("verb_key"), F.lit(tasks))).alias("shared"), F.when(~small, F.col("verb_key")).alias("large"))
    return rows.groupBy("shared", "large").applyInPandas(_decide, _DECIDED)


def _rows(pdf: pd.DataFrame) -> list[tuple[int, str, int]]:
    return list(zip(pdf["pos"].tolist(), pdf["shape"].tolist(), pdf["taken"].tolist(), strict=True))


def _decide(pdf: pd.DataFrame) -> pd.DataFrame:
    keys: dict[str, tuple[list, list, bool]] = {}
    for key, waits, last, row in zip(pdf["verb_key"], pdf["waits"], pdf["last"], _rows(pdf), strict=True):
        waiting, new, _ = keys.setdefault(key, ([], [], last))
        (waiting if waits else new).append(row)
    out: list[tuple] = []
    for key, (waiting, new, last) in keys.items():
        found, left = run_blocks(waiting, new, bool(last))
        out += [(key, seed, template, NEVER, MERGED if merged else ALONE) for seed, template, merged in found]
        out += [(key, *row, LEFT) for row in left]
    return pd.DataFrame(out, columns=[field.split(" ")[0] for field in _DECIDED.split(", ")])


def _without_covered(rows: DataFrame, decided: DataFrame, words: int) -> DataFrame:
    """``rows`` that the new templates leave there, or that a waiting seed may still need. Each part of a key's order gets its templates and waiting seeds."""
    part = F.floor(F.col("pos") / words).alias("part")
    parted = rows.select(*_COLUMNS, part)
    told = decided.filter(F.col("kind") != ALONE).join(parted.select("verb_key", "part").distinct(), "verb_key")
    told = told.select(F.col("verb_key").alias("_key"), F.col("part").alias("_part"), "pos", "shape", "taken", "kind")
    return parted.groupBy("verb_key", "part").cogroup(told.groupBy("_key", "_part")).applyInPandas(_uncovered, _PENDING)


def _uncovered(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    if rows.empty:
        return rows[_COLUMNS]
    merged = told[told["kind"] == MERGED]
    rows = rows.sort_values("pos")
    kept = left_of(_rows(rows), list(zip(merged["pos"].tolist(), merged["shape"].tolist(), strict=True)), _rows(told[told["kind"] == LEFT]))
    taken = {at: t for at, _, t in kept}
    rows = rows[rows["pos"].isin(taken)]
    return rows.assign(taken=rows["pos"].map(taken).astype("int64"))[_COLUMNS]


# -- seeds that wait, by reservations ---------------------------------------------------------

def _crowded(pending: DataFrame, words: int) -> DataFrame:
    """Keys whose waiting seeds are more than one task should hold."""
    return pending.filter("waits").groupBy("verb_key").agg(F.sum(_n_words()).alias("n")).filter(F.col("n") > words).select("verb_key")


def _reserve(pending: DataFrame, keys: DataFrame, work: Scratch, words: int) -> tuple[DataFrame, DataFrame]:
    """Decide many waiting seeds of ``keys`` at once: (decided, pending rows of all keys).

    Every word is reserved by the earliest seed that holds it. A seed with reservations of all its words knows its partners: its first one is final
    if no earlier seed has reserved a word of it. The earliest seed always gets on; as waiting seeds hardly share words, so do nearly all.
    """
    mine = work.store(pending.join(keys, "verb_key", "left_semi"))
    seeds = mine.filter(F.col("waits") & (F.col("taken") == NEVER))
    held = _words(seeds, "pos")
    owner = work.store(held.groupBy("verb_key", "word").agg(F.min("pos").alias("owner")))
    sure = held.join(owner, ["verb_key", "word"]).groupBy("verb_key", "pos").agg(F.bool_and(F.col("owner") == F.col("pos")).alias("all")).filter("all")
    sure = seeds.join(sure.select("verb_key", "pos"), ["verb_key", "pos"], "left_semi").select("verb_key", F.col("pos").alias("owner"), "after")
    touched = work.store(_words(mine, "pos", "taken").join(owner, ["verb_key", "word"]).select("verb_key", "pos", "taken", "owner").distinct())
    earliest = touched.groupBy("verb_key", "pos").agg(F.min("owner").alias("earliest"))
    first = touched.join(sure, ["verb_key", "owner"]).filter("pos > owner and taken > owner and pos > after").groupBy("verb_key", "owner").agg(F.min("pos").alias("pos"))
    final = sure.select("verb_key", "owner").join(first, ["verb_key", "owner"], "left").join(earliest, ["verb_key", "pos"], "left").filter(
        "pos is null or earliest = owner").select("verb_key", F.col("owner").alias("pos"), F.col("pos").alias("partner"))
    shape = mine.select("verb_key", F.col("pos").alias("partner"), F.col("shape").alias("other"))
    pairs = final.join(mine.select("verb_key", "pos", "shape"), ["verb_key", "pos"]).join(shape, ["verb_key", "partner"], "left")
    tried = work.store(pairs.select("verb_key", "pos", "shape", "partner", "other").mapInPandas(_try_pairs, _DECIDED + ", partner long"))
    decided = tried.filter(F.col("kind") != LEFT)
    failed = tried.filter(F.col("kind") == LEFT).select("verb_key", "pos", F.col("partner").alias("_after"))
    rest = mine.join(decided.select("verb_key", "pos"), ["verb_key", "pos"], "left_anti").join(failed, ["verb_key", "pos"], "left").withColumn(
        "after", F.coalesce("_after", "after")).select(_COLUMNS)
    rest = work.store(rest)
    waiting = rest.filter(F.col("waits")).select("verb_key", "pos", "shape", "taken", F.lit(LEFT).alias("kind"))
    kept = _without_covered(rest, decided.drop("partner").unionByName(waiting), words)
    return decided, work.store(pending.join(keys, "verb_key", "left_anti").unionByName(kept))


def _try_pairs(batches):
    """Templates of seeds and their partners: MERGED, ALONE without partner, LEFT if the two have nothing in common."""
    for pdf in batches:
        out = []
        for key, pos, shape, partner, other in zip(pdf["verb_key"], pdf["pos"], pdf["shape"], pdf["partner"], pdf["other"], strict=True):
            alone = other is None
            merged = None if alone else common_template(shape, other)
            out.append((key, pos, merged or shape, NEVER, ALONE if alone else MERGED if merged else LEFT, None if alone else int(partner)))
        found = pd.DataFrame(out, columns=["verb_key", "pos", "shape", "taken", "kind", "partner"])
        yield found.astype({"partner": "Int64"})


def number_templates(found: DataFrame) -> DataFrame:
    """Template ids by falling number of literal words, so that the universal one is last."""
    counted = found.select(
        F.col("shape").alias("pattern"), T.literal_count(F.col("shape"), T.WILDCARD).alias("n_literals")
    )
    ranked = number_all(counted, [F.col("n_literals").desc(), F.col("pattern")], "template_id")
    return ranked.select(
        F.col("template_id").cast("int"), "pattern", "n_literals",
        T.shape_to_regex(F.col("pattern")).alias("regex"), F.lit(True).alias("single_spaced"),
        _anchor(F.col("pattern"), T.WILDCARD, whole_line=True).alias("anchor"),
    )


# -- compilation and matching ---------------------------------------------------------------

def _anchor(pattern: Column, wildcard: str, whole_line: bool) -> Column:
    """Key that every matching line has to contain: the longest word that is literal
    throughout, or else the beginning of the longest literal piece (up to 3 characters).

    In a text-form pattern the last word may match the beginning of a longer word, so it is
    no whole word there.
    """
    words = F.split(pattern, " ")
    plain = F.filter(words, lambda w: (w != wildcard) & (w != ""))
    if not whole_line:
        body = F.slice(words, 1, F.size(words) - 1)
        plain = F.filter(body, lambda w: (w != "") & ~w.rlike(r"(?<!\\)\*"))
        plain = F.transform(plain, lambda w: F.regexp_replace(w, r"\\(.)", "$1"))
    longest = F.array_max(F.transform(plain, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    if whole_line:
        return F.coalesce(F.concat(F.lit("w:"), longest), F.lit("g:"))
    pieces = F.transform(F.split(pattern, r"(?<!\\)\*", -1), lambda p: F.regexp_replace(p, r"\\(.)", "$1"))
    piece = F.array_max(F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    return F.coalesce(F.concat(F.lit("w:"), longest), F.concat(F.lit("g:"), F.substring(piece, 1, 3)))


def compile_templates(patterns: DataFrame) -> DataFrame:
    """Add regular expression, literal count and anchor to text-form patterns."""
    return patterns.select(
        "*",
        T.literal_count(F.col("pattern"), "*").alias("n_literals"),
        T.text_to_regex(F.col("pattern")).alias("regex"), F.lit(False).alias("single_spaced"),
        _anchor(F.col("pattern"), "*", whole_line=False).alias("anchor"),
    )


def _preference(policy: str, template_id, n_literals) -> tuple:
    return {"first": (template_id,), "last": (-template_id,), "most_specific": (-n_literals, template_id)}[policy]


def match_lines(lines: DataFrame, templates: DataFrame, policy: str = "most_specific",
                inline_limit: int = INLINE_TEMPLATES) -> DataFrame:
    """Lines with a matching template: one row per match (``all``) or the preferred one."""
    if policy == "all":
        matched = match_sets(lines, templates, inline_limit=inline_limit)
        return matched.withColumn("template_id", F.explode("template_ids")).drop("template_ids")
    lines = _with_texts(lines)
    small = _small_table(templates, inline_limit)
    if small is None:
        matched = _match_many(lines, templates, policy, one=True).withColumn("template_id", F.col("template_ids")[0])
        return matched.drop("template_ids", "_text", "_spaced")
    tests = _tests(small, policy)
    chosen = F.coalesce(*tests) if tests else F.lit(None).cast("int")
    # explode drops the lines without template; a filter would be pushed down with a second copy of all tests
    return lines.withColumn("template_id", F.explode(F.array_compact(F.array(chosen)))).drop("_text", "_spaced")


def match_sets(lines: DataFrame, templates: DataFrame, policy: str = "most_specific",
               inline_limit: int = INLINE_TEMPLATES) -> DataFrame:
    """Lines with at least one matching template and all matches in ``template_ids``, the
    preferred one first.

    A template table of at most ``inline_limit`` rows becomes part of the projection: no
    join, no shuffle, and each regular expression is compiled once. A larger table of
    inferred templates is looked up by words (``_match_by_words``). Any other is
    joined on the anchor of each template, so a line meets only templates whose anchor it
    contains; Spark broadcasts that table if it is small enough.
    """
    lines = _with_texts(lines)
    small = _small_table(templates, inline_limit)
    if small is None:
        return _match_many(lines, templates, policy).drop("_text", "_spaced")
    found = F.array_compact(F.array(*_tests(small, policy))) if small else F.array().cast("array<int>")
    kept = F.explode(F.filter(F.array(found), lambda ids: F.size(ids) > 0))  # see match_lines
    return lines.withColumn("template_ids", kept).drop("_text", "_spaced")


def _small_table(templates: DataFrame, limit: int) -> list | None:
    """The template table if it has at most ``limit`` rows."""
    head = templates.select("template_id", "n_literals", "regex", "single_spaced").limit(limit + 1).collect()
    return head if len(head) <= limit else None


def _tests(templates: list, policy: str) -> list[Column]:
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    ordered = sorted(templates, key=lambda t: _preference(policy, t["template_id"], t["n_literals"]))
    texts = {False: F.col("_text"), True: F.col("_spaced")}
    return [
        F.when(texts[t["single_spaced"]].rlike(t["regex"]), F.lit(t["template_id"]).cast("int")) for t in ordered
    ]


def _with_texts(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"_text": T.strip(F.col("line")), "_spaced": T.single_spaced(F.col("line"))})


def _grams(line: Column, n: int) -> Column:
    """Keys for all different pieces of n characters (the empty one for n = 0)."""
    if n == 0:
        return F.array(F.lit("g:"))
    letters = F.split(line, "")
    pieces = F.transform(letters, lambda c: F.concat(F.lit("g:"), c))
    for shift in range(1, n):
        # the shifted array is shorter; what has no continuation becomes null and is dropped
        shifted = F.slice(letters, shift + 1, F.size(letters))
        pieces = F.zip_with(pieces, shifted, lambda left, right: F.concat(left, right))
    return F.array_compact(F.array_distinct(pieces))


def _match_many(lines: DataFrame, templates: DataFrame, policy: str, one: bool = False) -> DataFrame:
    """``template_ids`` of lines that match; with ``one``, only the first of them is sure to be there."""
    by_words = "single_spaced" in templates.columns and "pattern" in templates.columns and templates.filter(
        ~F.col("single_spaced") | F.concat(F.lit(" "), "pattern", F.lit(" ")).contains(f" {T.WILDCARD} {T.WILDCARD} ")).isEmpty()
    return _match_by_words(lines, templates, policy, one) if by_words else _match_by_anchor(lines, templates, policy)


def _match_by_words(lines: DataFrame, templates: DataFrame, policy: str, one: bool) -> DataFrame:
    """Matches of inferred templates.

    A template without wildcard is equal to the lines it matches: a join. The others (far fewer) are written once, in the order of preference, and every task reads
    them, a few at a time, for each block of its lines. So no line moves for them, and what a task holds depends neither on the lines nor on the templates.
    """
    columns, path = lines.columns, scratch_path(lines.sparkSession, "templates")
    prefers = [c.alias(f"o{i}") for i, c in enumerate(_preference(policy, F.col("template_id"), F.col("n_literals")))]
    ranked = templates.select(F.struct(*prefers, F.col("template_id").alias("id")).alias("rank"), "pattern")
    wild = F.array_contains(F.split("pattern", " "), T.WILDCARD)
    equal = ranked.filter(~wild).groupBy("pattern").agg(F.array_sort(F.collect_list("rank")).alias("_equal"))
    known = lines.join(equal, F.col("_spaced") == F.col("pattern"), "left").drop("pattern")
    ranked.filter(wild).sort("rank").write.parquet(path)
    schema = known.select(*columns, F.col("_equal").alias("_found")).schema
    n_bytes, at_once = LINE_BYTES, max(1, TEMPLATE_WORDS // 32)

    def run(batches):
        for rows in _blocks(batches, "_spaced", n_bytes):
            number: dict[str, int] = {}
            texts, equals = rows.column("_spaced").to_pylist(), rows.column("_equal").to_pylist()
            own = [None if text is None else number.setdefault(text, len(number)) for text in texts]
            found: list[list] = [[] for _ in number]
            for i, same in zip(own, equals, strict=True):
                if i is not None and not found[i]:
                    found[i] = list(same or [])
            names = list(rows.schema.field("_equal").type.value_type)
            first = [tuple(f[0].values()) if f else None for f in found] if one else None
            for i, rank in match_all(list(number), _read_ranked(path, at_once), first):
                told = {field.name: value for field, value in zip(names, rank, strict=True)}
                found[i] = [told] if one else found[i] + [told]
            ids = pa.array([(found[i] or None) if i is not None else None for i in own], rows.schema.field("_equal").type)
            result = rows.select(columns).append_column("_found", ids)
            yield from result.filter(result.column("_found").is_valid()).to_batches(max_chunksize=10_000)

    pairs = known.mapInArrow(run, schema)
    return pairs.select(*columns, F.transform(F.array_sort("_found"), lambda f: f["id"].cast("int")).alias("template_ids"))


def _read_ranked(path: str, at_once: int) -> Iterator[tuple[tuple, str]]:
    """(rank, pattern) of a sorted table, whose part files are named in order."""
    files, root = fs.FileSystem.from_uri(path)
    found = files.get_file_info(fs.FileSelector(root))
    for part in sorted(f.path for f in found if f.base_name.startswith("part-")):
        with files.open_input_file(part) as source:
            for batch in pq.ParquetFile(source).iter_batches(at_once):
                for rank, pattern in zip(batch.column("rank").to_pylist(), batch.column("pattern").to_pylist(), strict=True):
                    yield tuple(rank.values()), pattern


def _blocks(batches: Iterator[pa.RecordBatch], column: str, n_bytes: int) -> Iterator[pa.Table]:
    """The batches, joined up to tables with about ``n_bytes`` in a column of texts."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= n_bytes:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def _match_by_anchor(lines: DataFrame, templates: DataFrame, policy: str) -> DataFrame:
    words = F.transform(F.array_distinct(F.split("_text", " +")), lambda w: F.concat(F.lit("w:"), w))
    grams = [
        r["n"] for r in templates.filter("anchor like 'g:%'")
        .select((F.length("anchor") - 2).alias("n")).distinct().orderBy("n").collect()  # at most 0..3
    ]
    keyed = lines.withColumn("anchor", F.explode(F.concat(words, *[_grams(F.col("_text"), n) for n in grams])))
    pairs = keyed.join(templates.select("anchor", "template_id", "n_literals", "regex", "single_spaced"), "anchor").filter(
        F.expr("CASE WHEN single_spaced THEN _spaced ELSE _text END rlike regex")
    )
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_preference(policy, F.col("template_id"), F.col("n_literals")))],
                     F.col("template_id").alias("id"))
    rest = [c for c in lines.columns if c not in ("log_id", "line_no")]
    return (
        pairs.groupBy("log_id", "line_no")
        .agg(F.array_sort(F.collect_list(order)).alias("_found"), *[F.first(c).alias(c) for c in rest])
        .select(*lines.columns, F.transform("_found", lambda f: f["id"].cast("int")).alias("template_ids"))
    )


def unmatched_lines(lines: DataFrame, templates: DataFrame, inline_limit: int = INLINE_TEMPLATES) -> DataFrame:
    """Lines that no template matches."""
    matched = match_lines(lines, templates, "first", inline_limit).select("log_id", "line_no")
    return lines.join(matched, ["log_id", "line_no"], "left_anti")
