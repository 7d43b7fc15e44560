"""The registered queries: every operator on the given tables.

Arrays, structs and times are shown as text so that results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtrends.functions import scores, text
from logtrends.functions.keywords import keywords
from logtrends.operators import cluster, difflog, graphs, patterns, posts as P, templates, trends, vectors
from logtrends.plans import analysis, bindings as B
from logtrends.session import cut_lineage, scratch_path
from logtrends.sources import logs, posts as S
from logtrends.streaming import live
from logtrends.streaming.store import CounterStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

THRESHOLD = 0.5
SMALL = 60  # small-cluster size of the bound queries; the library default is 4
WORD = "the"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _time(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


def _joined(column: str, separator: str = ",") -> Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), separator).alias(column)


def _latest(df: DataFrame) -> Column:
    """Time of the newest row; one value."""
    return F.lit(df.agg(F.max("ts").cast("string")).first()[0]).cast("timestamp")


# -- lines ----------------------------------------------------------------------------------

@query
def log_lines(spark, sf):
    return logs.clean_lines(B.document_lines(spark, sf))


@query
def recent_lines(spark, sf):
    lines = B.event_lines(spark, sf)
    newest = _latest(B.table(spark, sf, "events"))
    return logs.recent(lines, 7, newest).select("log_id", "line_no", "line", _time("ts"))


@query
def chunk_lines(spark, sf):
    chunked = logs.chunk_lines(B.document_lines(spark, sf), 200)
    return chunked.select("log_id", "line_no", F.col("chunk_id").cast("bigint").alias("chunk_id"))


@query
def chunk_lines_per_log(spark, sf):
    chunked = logs.chunk_lines(B.document_lines(spark, sf), 5, per_log=True)
    return chunked.select("log_id", "line_no", F.col("chunk_id").cast("bigint").alias("chunk_id"))


@query
def drop_lines_with(spark, sf):
    return logs.drop_lines_with(B.document_lines(spark, sf), WORD)


@query
def logs_with(spark, sf):
    return logs.logs_with(B.document_lines(spark, sf), WORD)


@query
def tokens(spark, sf):
    lines = logs.clean_lines(B.document_lines(spark, sf))
    return lines.select("log_id", "line_no", text.tokens(F.col("line")).alias("tokens")).select(
        "log_id", "line_no", F.size("tokens").cast("bigint").alias("n_tokens"), F.array_join("tokens", "|").alias("tokens")
    )


@query
def mask_lines(spark, sf):
    lines = logs.clean_lines(B.document_lines(spark, sf))
    return lines.select("log_id", "line_no", text.shape(F.col("line")).alias("shape"))


@query
def verb_key(spark, sf):
    lines = logs.clean_lines(B.document_lines(spark, sf))
    return lines.select("log_id", "line_no", text.flat_key(text.verb_key(F.col("line"))).alias("verb_key"))


# -- templates ------------------------------------------------------------------------------

@query
def shape_groups(spark, sf):
    return templates.shape_groups(logs.clean_lines(B.document_lines(spark, sf)))


@query
def compile_templates(spark, sf):
    lines = logs.clean_lines(B.document_lines(spark, sf))
    masked = lines.select(text.shape_to_text(text.shape(F.col("line"))).alias("pattern")).distinct()
    return templates.compile_templates(masked).select("pattern", F.col("n_literals").cast("bigint").alias("n_literals"), "regex")


@query
def infer_templates(spark, sf):
    found = templates.infer_templates(logs.clean_lines(B.document_lines(spark, sf)))
    return found.select("template_id", "pattern", "n_literals")


@query
def infer_then_match(spark, sf):
    """Lines that an inferred template matches: all of them."""
    lines = logs.clean_lines(B.document_lines(spark, sf))
    return templates.match_lines(lines, templates.infer_templates(lines), "first").select("log_id", "line_no", "line")


@query
def templates_roundtrip(spark, sf):
    path = scratch_path(spark, "templates")
    logs.save_templates(B.rich_templates(spark, sf), path)
    return logs.load_templates(spark, path).select(
        F.col("template_id").cast("bigint").alias("template_id"), "pattern", F.col("n_literals").cast("bigint").alias("n_literals")
    )


def _rich(spark, sf, policy):
    matched = templates.match_lines(B.event_lines(spark, sf), B.rich_templates(spark, sf), policy)
    return matched.select("log_id", "line_no", F.col("template_id").cast("bigint").alias("template_id"))


@query
def match_all(spark, sf):
    return _rich(spark, sf, "all")


@query
def assign_template(spark, sf):
    return _rich(spark, sf, "most_specific")


@query
def assign_first(spark, sf):
    return _rich(spark, sf, "first")


@query
def assign_last(spark, sf):
    return _rich(spark, sf, "last")


@query
def unmatched_lines(spark, sf):
    known = B.event_templates(spark, sf).filter("pattern <> 'signup *'")
    return templates.unmatched_lines(B.event_lines(spark, sf), known).select("log_id", "line_no", "line")


# -- vectors and graphs ---------------------------------------------------------------------

def _assigned(spark, sf):
    return templates.match_lines(B.event_lines(spark, sf), B.event_templates(spark, sf))


def _vectors(spark, sf):
    return vectors.mav(templates.match_lines(B.event_lines(spark, sf), B.event_templates(spark, sf), "all"))


def _days(vectors_: DataFrame) -> DataFrame:
    """A plain grouping of logs: by day, the medoid is the smallest log."""
    day = F.substring_index("log_id", "/", -1)
    named = vectors_.select("log_id", day.alias("cluster_id"))
    return named.join(named.groupBy("cluster_id").agg(F.min("log_id").alias("medoid_log_id")), "cluster_id")


@query
def mav(spark, sf):
    return _vectors(spark, sf).select("log_id", _joined("template_ids"))


@query
def mav_distance(spark, sf):
    vectors_ = _vectors(spark, sf)
    return vectors.distance_to_medoid(_days(vectors_), vectors_)


@query
def cluster_diameter(spark, sf):
    vectors_ = _vectors(spark, sf)
    return cluster.cluster_diameter(_days(vectors_), vectors_)


@query
def mfg_nodes(spark, sf):
    return graphs.mfg_nodes(_assigned(spark, sf))


@query
def mfg_edges(spark, sf):
    return graphs.mfg_edges(_assigned(spark, sf))


@query
def out_degree(spark, sf):
    return graphs.out_degree(graphs.mfg_edges(_assigned(spark, sf)))


@query
def graph_distance(spark, sf):
    assigned = _assigned(spark, sf)
    logs_ = assigned.select("log_id").distinct()
    pairs = _days(logs_).select("log_id", F.col("medoid_log_id").alias("baseline_log_id"))
    return graphs.graph_distance(pairs, cut_lineage(graphs.mfg_edges(assigned)))


# -- clusters and outliers ------------------------------------------------------------------

def _clustered(spark, sf, small=4, thresholds=(THRESHOLD,)):
    """Vectors, nodes, edges, clusters with verdict."""
    vectors_, nodes, edges = analysis.behaviour(B.event_lines(spark, sf), B.event_templates(spark, sf))
    return vectors_, nodes, edges, analysis.clusters_at(vectors_, list(thresholds), small)


def _abnormal(spark, sf, small=4):
    vectors_, nodes, edges = analysis.behaviour(B.event_lines(spark, sf), B.event_templates(spark, sf))
    clusters, abnormal = analysis.find_abnormal(vectors_, edges, [THRESHOLD], small)
    return nodes, edges, clusters, abnormal


@query
def cluster_tree(spark, sf):
    return cluster.cluster_tree(cut_lineage(_vectors(spark, sf)), [0.5, 1.0, 2.0, 3.0])


@query
def clusters_at(spark, sf):
    vectors_ = cut_lineage(_vectors(spark, sf))
    return analysis.clusters_at(vectors_, [THRESHOLD]).select("threshold", "cluster_id", "log_id", "medoid_log_id", "diameter")


@query
def cluster_verdict(spark, sf):
    vectors_ = cut_lineage(_vectors(spark, sf))
    return analysis.clusters_at(vectors_, [THRESHOLD], SMALL).select("cluster_id", "log_id", "size", "verdict")


def _nearest(spark, sf, metric):
    _, _, edges, clusters = _clustered(spark, sf)
    return graphs.nn_distance(clusters, edges, metric)


@query
def nn_distance(spark, sf):
    return _nearest(spark, sf, "edges")


@query
def nn_distance_out_degree(spark, sf):
    return _nearest(spark, sf, "out_degree")


@query
def mfg_outliers(spark, sf):
    return graphs.mfg_outliers(_nearest(spark, sf, "edges"))


# -- difflogs -------------------------------------------------------------------------------

def _missing(spark, sf):
    nodes, edges, clusters, abnormal = _abnormal(spark, sf)
    return nodes, edges, clusters, abnormal, cut_lineage(difflog.difflog_edges(abnormal, edges))


@query
def difflog_edges(spark, sf):
    return _missing(spark, sf)[-1].select("log_id", "src", "dst")


@query
def difflog_edges_all(spark, sf):
    _, edges, clusters, abnormal = _abnormal(spark, sf, SMALL)
    return difflog.difflog_edges_all(abnormal, clusters, edges).select("log_id", "src", "dst")


@query
def difflog_mav(spark, sf):
    return vectors.difflog_mav(_missing(spark, sf)[-1]).select("log_id", _joined("template_ids"))


def _paths(spark, sf):
    nodes, edges, clusters, abnormal, missing = _missing(spark, sf)
    return missing, difflog.difflog_paths(missing, edges, difflog.normal_vertices(abnormal, clusters, nodes))


@query
def difflog_paths(spark, sf):
    return _paths(spark, sf)[1].select("log_id", "path_id", _joined("path", ">"))


def _deep(spark, sf):
    """Difflogs under the rich templates and the small-cluster rule at ``SMALL``, whose paths have many vertices: (missing transitions, paths, clusters)."""
    vectors_, nodes, edges = analysis.behaviour(B.event_lines(spark, sf), B.rich_templates(spark, sf))
    clusters, abnormal = analysis.find_abnormal(vectors_, edges, [THRESHOLD], SMALL)
    missing = cut_lineage(analysis.all_difflog_edges(abnormal, clusters, edges))
    return missing, cut_lineage(difflog.difflog_paths(missing, edges, difflog.normal_vertices(abnormal, clusters, nodes)))


def _steps(paths: DataFrame, *keys: str) -> DataFrame:
    """Neighbours on paths."""
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.col("path")[i - 1].alias("src"), F.col("path")[i].alias("dst"))))
    return paths.select(*keys, pair.alias("p")).select(*keys, "p.src", "p.dst").distinct()


@query
def difflog_path_steps(spark, sf):
    """Neighbours on the paths of each difflog: its missing transitions, neither more nor less."""
    return _steps(_deep(spark, sf)[1], "log_id")


@query
def difflog_missing_rich(spark, sf):
    return _deep(spark, sf)[0].select("log_id", "src", "dst")


@query
def common_path_steps(spark, sf):
    """Neighbours on the common sequences of each difflog cluster: its common transitions, neither more nor less."""
    missing, paths = _deep(spark, sf)
    groups = cut_lineage(analysis.cluster_difflogs(missing, [THRESHOLD], [THRESHOLD]))
    return _steps(difflog.common_paths(groups, missing, paths), "cluster_id")


@query
def difflog_clusters(spark, sf):
    groups = analysis.cluster_difflogs(_missing(spark, sf)[-1], [THRESHOLD], [THRESHOLD])
    return groups.select("cluster_id", "log_id", "size")


@query
def common_edges(spark, sf):
    missing = _missing(spark, sf)[-1]
    return difflog.common_edges(analysis.cluster_difflogs(missing, [THRESHOLD], [THRESHOLD]), missing).select("cluster_id", "src", "dst", "n_logs")


@query
def common_paths(spark, sf):
    missing, paths = _paths(spark, sf)
    groups = cut_lineage(analysis.cluster_difflogs(missing, [THRESHOLD], [THRESHOLD]))
    return difflog.common_paths(groups, missing, cut_lineage(paths)).select("cluster_id", _joined("path", ">"))


@query
def pattern_matches(spark, sf):
    """Every missing transition, and the way there and back, searched in all logs."""
    found = _missing(spark, sf)[-1].select("src", "dst").distinct()
    paths = found.select(F.explode(F.array(F.array("src", "dst"), F.array("src", "dst", "src"))).alias("path"))
    named = paths.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("pattern_id"), "path")
    return patterns.pattern_matches(_assigned(spark, sf), named)


# -- evaluation -----------------------------------------------------------------------------

def _sweep(spark, sf, thresholds):
    lines = B.event_lines(spark, sf)
    return analysis.sweep(lines, B.event_templates(spark, sf), analysis.labelled_by_line(lines), thresholds, SMALL)


@query
def detection_counts(spark, sf):
    return _sweep(spark, sf, [t for t in analysis.SWEEP if t < 1])


@query
def threshold_sweep(spark, sf):
    return _sweep(spark, sf, list(analysis.SWEEP))


@query
def analyze(spark, sf):
    result = analysis.analyze(B.event_lines(spark, sf), B.event_templates(spark, sf), [THRESHOLD], [THRESHOLD])
    return result["matches"].select("cluster_id", "pattern_id", "log_id", "start_line", "end_line", "n_lines")


# -- posts ----------------------------------------------------------------------------------

@query
def posts(spark, sf):
    parsed = S.parse_json(B.post_records(B.posts_table(spark, sf)))
    return parsed.select(
        "post_id", _time("ts"), "type", "title", "score", "num_comments", "text", "retweet_count", "favorite_count",
        "reply_count", "name", "description", F.col("venue.name").alias("venue_name"), F.col("venue.state").alias("venue_state"),
        F.col("venue.address_2").alias("venue_address_2"), F.col("group.city").alias("group_city"),
        F.col("group.category.shortname").alias("category"), "is_corrupt",
    )


@query
def framed_json(spark, sf):
    """Event records of a user, cut in two at an arbitrary character and glued again."""
    record = F.to_json(F.struct(F.col("event_id").alias("post_id"), F.col("event_type").alias("kind"), "value"))
    events = B.table(spark, sf, "events").select("user_id", "event_id", record.alias("record"))
    at = F.pmod("event_id", F.length("record")).cast("int")
    halves = F.array(
        F.struct((F.col("event_id") * 2).alias("seq"), F.substr("record", F.lit(1), at).alias("data")),
        F.struct((F.col("event_id") * 2 + 1).alias("seq"), F.concat(F.substr(F.col("record"), at + 1), F.lit("\n")).alias("data")),
    )
    packets = events.select(F.col("user_id").alias("stream_id"), F.inline(halves))
    return S.parse_framed_json(packets, "post_id bigint, kind string, value double")


def _listings(spark, sf, dedupe):
    events = B.table(spark, sf, "events").select(F.col("event_id").alias("post_id"), "event_type", "value")
    conditions = {
        "new": F.lit(True), "controversial": F.col("event_type") == "error", "hot": F.col("value") > 20,
        "rising": F.col("event_type") == "signup", "top": F.col("value") > 50,
    }
    listings = [events.filter(c).select("post_id", F.lit(name).alias("listing")) for name, c in conditions.items()]
    return S.normalise_post(S.union_listings(*listings, dedupe=dedupe), "reddit")


@query
def union_listings(spark, sf):
    return _listings(spark, sf, dedupe=False)


@query
def union_listings_dedupe(spark, sf):
    return _listings(spark, sf, dedupe=True).select("post_id", "type")


@query
def invalid_posts(spark, sf):
    return S.route_posts(B.posts_table(spark, sf))["invalid"].select("post_id", "type")


@query
def classify_messages(spark, sf):
    k = F.regexp_extract("props", r'"k": ?(-?[0-9]+)', 1).cast("bigint")
    kind = F.col("event_type")
    message = F.to_json(F.struct(
        "event_id",
        F.when(kind == "view", F.concat(F.lit("seen "), k)).alias("text"),
        F.when(kind == "signup", F.struct(k.alias("track"))).alias("limit"),
        F.when(kind == "purchase", F.struct(F.concat(F.lit("reason "), k).alias("reason"))).alias("disconnect"),
        F.when(kind == "error", F.concat(F.lit("failed "), k)).alias("message"),
        F.when(kind == "error", k).alias("code"),
    ))
    records = B.table(spark, sf, "events").select(message.alias("value"))
    parsed = S.parse_json(records, "event_id bigint, " + S.MESSAGE_SCHEMA)
    return S.classify_messages(parsed).select("event_id", "kind", "detail")


@query
def meetup_fields(spark, sf):
    meetups = S.route_posts(B.posts_table(spark, sf))["meetup"]
    return S.meetup_fields(meetups).select("post_id", "city", "state", "country", "venue_text", "category")


@query
def keyword_phrases(spark, sf):
    documents = B.table(spark, sf, "documents")
    return documents.select("doc_id", F.posexplode(keywords(F.col("text"))).alias("pos", "keyword")).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "keyword"
    )


QUERIES["keywords"] = QUERIES.pop("keyword_phrases")


@query
def reddit_minute(spark, sf):
    return P.keyword_minute(B.posts_table(spark, sf), "reddit").withColumn("minute", scores.minute_key(F.col("minute")))


@query
def twitter_minute(spark, sf):
    return P.keyword_minute(B.posts_table(spark, sf), "twitter").withColumn("minute", scores.minute_key(F.col("minute")))


@query
def meetup_latest(spark, sf):
    return P.meetup_latest(B.posts_table(spark, sf)).select(
        _time("minute"), "keyword", _time("ts"), "post_id", "city", "state", "country", "category", "name", "venue"
    )


# -- trends ---------------------------------------------------------------------------------

def _minute_scores(spark, sf, merge="overwrite", width=None):
    newest = _latest(B.table(spark, sf, "events"))
    return trends.scores_of(trends.closed_before(P.both_minutes(B.posts_table(spark, sf), width), newest), merge), newest


@query
def minute_scores(spark, sf):
    return _minute_scores(spark, sf)[0].withColumn("minute", scores.minute_key(F.col("minute")))


@query
def minute_scores_sum(spark, sf):
    return _minute_scores(spark, sf, "sum")[0].withColumn("minute", scores.minute_key(F.col("minute")))


@query
def trend_5min(spark, sf):
    ranked = trends.trend_now(*_minute_scores(spark, sf))
    path = scratch_path(spark, "ranking")
    trends.replace_ranking(ranked, path)
    return spark.read.parquet(path).withColumn("period", scores.minute_key(F.col("period")))


@query
def trend_5min_tumbling(spark, sf):
    ranked = trends.trend_windows(_minute_scores(spark, sf, width="5 minutes")[0], "5 minutes")
    return ranked.withColumn("period", scores.minute_key(F.col("period")))


@query
def trend_hour(spark, sf):
    ranked = trends.trend_windows(_minute_scores(spark, sf, width="1 hour")[0], "1 hour")
    return ranked.withColumn("period", scores.hour_key(F.col("period")))


# -- streams --------------------------------------------------------------------------------

def _post_stream(spark, sf):
    documents = B.table(spark, sf, "documents")
    return B.posts_from(B.event_stream(spark, sf), documents, documents.count())


def _counts(spark, sf, kind):
    path, checkpoint = scratch_path(spark, "counts"), scratch_path(spark, "counts-state")
    live.start_counts(_post_stream(spark, sf), kind, path, checkpoint).awaitTermination()
    return live.read_counts(spark, kind, path).withColumn("minute", scores.minute_key(F.col("minute")))


@query
def stream_keyword_minute(spark, sf):
    return _counts(spark, sf, "twitter")


@query
def merge_counters(spark, sf):
    """Counters of even and of odd posts by two runs into one store: the second adds to the first; a batch delivered twice counts once."""
    store = CounterStore(spark, scratch_path(spark, "counters"), list(P.COUNTERS["twitter"].values()))
    posts_ = B.posts_table(spark, sf)
    half = F.pmod(F.floor(F.col("post_id") / 4), F.lit(2))
    for run in (0, 1):
        counts = P.keyword_minute(posts_.filter(half == run), "twitter")
        for _ in range(2):
            store.commit(counts, batch_id=0, run=f"run {run}")
    return store.read().withColumn("minute", scores.minute_key(F.col("minute")))


@query
def stream_minute_scores(spark, sf):
    """Minutes that the watermark has closed, both sources in one aggregation."""
    path, checkpoint = scratch_path(spark, "minutes"), scratch_path(spark, "minutes-state")
    live.start_minute_scores(_post_stream(spark, sf), path, checkpoint, delay="0 seconds").awaitTermination()
    return live.read_minute_scores(spark, path).withColumn("minute", scores.minute_key(F.col("minute")))


@query
def stream_trend_hour(spark, sf):
    """The ranking of every hour that the watermark has closed."""
    path, checkpoint = scratch_path(spark, "hours"), scratch_path(spark, "hours-state")
    live.start_hourly_trend(_post_stream(spark, sf), path, checkpoint, delay="0 seconds").awaitTermination()
    return live.read_hourly_trend(spark, path).withColumn("period", scores.hour_key(F.col("period")))


@query
def stream_dedup(spark, sf):
    """Every event delivered twice, kept once."""
    stream = B.event_stream(spark, sf).select(F.col("event_id").alias("post_id"), "ts", F.col("event_type").alias("type"))
    twice = stream.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    path, checkpoint = scratch_path(spark, "posts"), scratch_path(spark, "posts-state")
    live.start_dedup(twice, path, checkpoint).awaitTermination()
    return spark.read.schema("post_id bigint, ts timestamp, type string").parquet(path).select("post_id", _time("ts"), "type")
