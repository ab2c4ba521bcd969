"""One named query per operator, over the test tables.  Results are rounded for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import contracts
from ..functions import vocab
from ..functions.stem import stem_words
from ..functions.text import alpha_words, char_grams, lemmas, sentences, word_tokens
from ..operators import (
    cluster, credibility, enrich, heavyhitters, lexicon, mapping, pairs, sentiment, series, sketches, terms, unitroot,
    vectors, weightstate,
)
from ..scale import hash_fraction_sample, hash_ordered_sample, join_dimension
from ..session import materialize, scratch_path
from ..sources import colocated, ingest, standins, tables, variant
from . import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Names of the goods in the test tables, so that their sentences give pairs as well.
NOUNS = [*vocab.NOUNS, "anvil", "gear", "gizmo", "ring", "bolt", "plate", "rod", "widget"]
ADJECTIVES = [*vocab.ADJECTIVES, "red", "blue", "new", "old"]
EXTRACTED = (
    "food pizza service staff price value music decor plate rice host tea bread fish waiters portions fries rooms desserts "
    "tables"
).split()
DOMAIN = "(?i)widget|gizmo|plate"
CENTRES = [
    (0.0, 0.0, 0.0, 0.0), (0.3, 0.0, 0.0, 0.0), (-0.1, 0.1, 0.1, 0.1),
    (0.1, 0.3, 0.0, 0.0), (0.0, 0.0, 0.3, 0.1), (0.1, 0.0, 0.0, 0.3),
]
SLIDERS = (2.0, 1.0, 0.5, 1.0)
LANGS = ["en", "fr", "de", "es"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
    return fn


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six digits, integers to one width, lists to text."""
    out = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, T.DoubleType):
            c = F.round(c, 6) + F.lit(0.0)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        elif isinstance(field.dataType, T.ArrayType):
            c = F.array_join(c, "|")
        out.append(c.alias(field.name))
    return df.select(*out)


# --- sources and sinks ------------------------------------------------------------------------


def _raw_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Reviews as the raw entity has them: string ids and a date string."""
    return standins.ratings(spark, d).select(
        "review_id",
        F.col("user_id").cast("string").alias("user_id"),
        F.col("business_id").cast("string").alias("business_id"),
        "stars",
        F.date_format("review_ts", "yyyy-MM-dd HH:mm:ss").alias("date"),
    )


@query
def json_scan(spark, d):
    path = scratch_path(spark, "json")
    _raw_reviews(spark, d).write.json(path)
    back = tables.read_json(spark, path, contracts.REVIEW)
    return back.select("review_id", "user_id", "business_id", "stars", "date")


@query
def drifting_json(spark, d):
    """Whole review records, text included, in five shapes: one per number of stars."""
    rows = standins.reviews(spark, d).select("review_id", "text", "stars")
    stars, text, key = F.col("stars"), F.col("text"), F.col("review_id")
    line = (
        F.when(stars == 1, F.to_json(F.struct(key, text, stars)))
        .when(stars == 2, F.to_json(F.struct(key.alias("id"), text.alias("sentence"), stars.cast("string").alias("stars"))))
        .when(stars == 3, F.to_json(F.struct(key, F.struct(text.alias("body")).alias("text"), stars, F.lit(7).alias("votes"))))
        .when(stars == 4, F.to_json(F.struct(key, text, F.array(stars).alias("stars"))))
        .otherwise(F.concat(F.lit('["'), key, F.lit('", ')))
    )
    path = scratch_path(spark, "drift")
    rows.select(line.alias("value")).write.text(path)
    fields = (
        variant.Field("review_id", "string", ("review_id", "id")), variant.Field("text", "string", ("text", "sentence", "text.body")),
        variant.Field("stars", "double", ("stars",)),
    )
    return variant.read_drifting(spark, path, fields).withColumnRenamed(contracts.CORRUPT, "corrupt")


@query
def scan_years(spark, d):
    path = scratch_path(spark, "years")
    tables.write_partitioned(standins.ratings(spark, d), path, ["review_year"])
    chosen = tables.read_years(spark, path, [1996, 1999])
    return chosen.select("review_id", "user_id", "stars", "review_year")


@query
def load_entity(spark, d):
    source, target = scratch_path(spark, "raw"), scratch_path(spark, "entity")
    _raw_reviews(spark, d).write.json(source)
    loaded = ingest.load_entity(spark, "review", source, target)
    return loaded.select("review_id", "user_id", "stars", "date", "year")


@query
def partitioned_roundtrip(spark, d):
    path = scratch_path(spark, "parts")
    tables.write_partitioned(
        standins.ratings(spark, d), path, ["review_year", "review_month"], sort=["user_id"]
    )
    return spark.read.parquet(path).groupBy("review_year", "review_month").agg(
        F.count(F.lit(1)).alias("n"), F.sum("stars").alias("sum_stars")
    )


@query
def csv_roundtrip(spark, d):
    path = scratch_path(spark, "csv")
    labelled = _clusters(spark, d).select(contracts.CLUSTERED.fieldNames())
    tables.write_csv(labelled, path)
    return tables.read_first_present(
        spark, [f"{path}-z", path], [contracts.CLUSTERED, contracts.CLUSTERED]
    )


@query
def lexicon_table(spark, d):
    """Every lexicon row, general terms also as wildcards, with the opinion words it meets."""
    # Each distinct opinion is stemmed once.
    opinions = _pairs(spark, d).groupBy("aspect_opinion").agg(F.count(F.lit(1)).alias("times"))
    words = opinions.select(
        "times", F.explode(sentiment.stemmed(F.col("aspect_opinion"))).alias("term_to_match")
    ).groupBy("term_to_match").agg(F.sum("times").alias("n"))
    rows = vocab.polarity_table(spark).select(
        "*", F.array_join(sentiment.stemmed(F.col("term_to_match")), " ").alias("stem")
    )
    return rows.join(words.withColumnRenamed("term_to_match", "stem"), "stem", "left").select(
        F.coalesce("aspect_to_match", F.lit("*")).alias("aspect_to_match"),
        "term_to_match", "stem", "polarity", F.coalesce("n", F.lit(0)).alias("n"),
    )


@query
def profile(spark, d):
    return enrich.profile(
        standins.ratings(spark, d).select("user_id", "business_id", "stars", "review_year"),
        exact=["user_id", "business_id", "stars", "review_year"],
    )


@query
def sketch_profile(spark, d):
    """Sketches stored per year, the last year alone at the end, merged and held against exact figures."""
    path, rows = scratch_path(spark, "sketches"), standins.ratings(spark, d)
    columns = ["review_id", "user_id", "business_id", "stars"]
    sketches.refresh(rows.where(F.col("review_year") < 1998), path, "review_year", columns)
    sketches.refresh(rows.where(F.col("review_year") >= 1998), path, "review_year", columns)
    exact = enrich.profile(rows.select(columns), exact=columns).select("column_name", F.col("distinct_values").alias("exact"))
    median = rows.agg(F.median("stars").alias("m")).scalar()
    found = sketches.merged(spark, path).join(exact, "column_name").withColumn("median", median)
    return found.select(
        "column_name", "row_count", "non_null",
        (F.abs(F.col("distinct_values") - F.col("exact")) <= 0.05 * F.col("exact")).alias("distinct_near"),
        F.when(F.col("column_name") == "stars", F.abs(F.col("quantiles")[1] - F.col("median")) <= 1.0).alias("median_near"),
    )


@query
def distinct_values(spark, d):
    return enrich.distinct_values(standins.business(spark, d), "city")


@query
def colocated_weights(spark, d):
    """Weights made, joined back and summed per user on one layout, with no further shuffle."""
    reviews = colocated.store(standins.ratings(spark, d).select("review_id", "user_id", "stars"), "user_id", 8, "ratings")
    weighed = reviews.join(reviews.per_key(credibility.reviewer_weights, "weights"))
    return weighed.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("w_user").alias("w_user"), F.sum(F.col("w_user") * F.col("stars")).alias("weighted_stars")
    )


@query
def colocated_business(spark, d):
    """The spread of stars around each business's mean, on a layout by business."""
    reviews = colocated.store(standins.ratings(spark, d).select("review_id", "business_id", "stars"), "business_id", 8, "by_business")
    means = reviews.per_key(lambda rows: rows.groupBy("business_id").agg(F.avg("stars").alias("mean")), "means")
    return reviews.join(means).groupBy("business_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("mean").alias("mean"), F.sum(F.abs(F.col("stars") - F.col("mean"))).alias("spread")
    )


@query
def staged_top_cities(spark, d):
    """Two stages by one ledger, the third by another, as after a run that was killed."""
    source, root = scratch_path(spark, "raw"), scratch_path(spark, "staged")
    _raw_reviews(spark, d).write.json(f"{source}/review")
    places = standins.business(spark, d).withColumn("business_id", F.col("business_id").cast("string"))
    places.write.json(f"{source}/business")
    paths = (f"{source}/review", f"{source}/business", root)
    jobs.staged_run(spark, *paths).frame("enriched")
    return jobs.staged_run(spark, *paths, years=[1997, 1998]).frame("enriched").where("review_year in (1997, 1998)").groupBy(
        "biz_city"
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("stars").alias("sum_stars"))


# --- projections and filters ------------------------------------------------------------------


@query
def select_business(spark, d):
    return enrich.select_business(standins.business(spark, d))


@query
def derive_time(spark, d):
    timed = ingest.derive_time(_raw_reviews(spark, d), month="review_month")
    return timed.select("review_id", F.date_format("review_ts", "yyyy-MM-dd").alias("day"), "review_year", "review_month")


@query
def filter_category_like(spark, d):
    places = standins.business(spark, d)
    anywhere = enrich.filter_category(places, word="economy").withColumn("mode", F.lit("contains"))
    last = enrich.filter_category(places, word="promo", mode="suffix").withColumn("mode", F.lit("suffix"))
    return anywhere.unionByName(last).select("business_id", "categories", "mode")


@query
def filter_category_regex(spark, d):
    return enrich.filter_domain(standins.business(spark, d), regex=DOMAIN).select("business_id", "categories")


@query
def drop_null_keys(spark, d):
    holed = standins.ratings(spark, d).withColumn(
        "stars", F.when(F.col("stars") < 5, F.col("stars"))
    )
    return ingest.drop_null_keys(holed).select("review_id", "user_id", "stars")


@query
def preview_truncate(spark, d):
    return enrich.preview(standins.reviews(spark, d)).select("review_id", "user_id", "text", "stars")


@query
def nested_field(spark, d):
    events = standins.table(spark, d, "events")
    out = enrich.has_field(events, "props", "k", "has_k")
    return enrich.has_field(out, "props", "missing", "has_missing").select("event_id", "has_k", "has_missing")


@query
def sample_n(spark, d):
    return hash_ordered_sample(standins.ratings(spark, d), "review_id", 1000).select(
        "review_id", "user_id", "stars"
    )


@query
def sample_fraction(spark, d):
    return hash_fraction_sample(standins.ratings(spark, d), "review_id", 0.01).select(
        "review_id", "user_id", "stars"
    )


@query
def filter_city_min_reviews(spark, d):
    placed = materialize(
        cluster.describe_clusters(_vectors(spark, d), standins.business(spark, d)), "placed"
    )
    return enrich.select_present(
        vectors.filter_city_min_reviews(placed, "Brand#7"), ["business_id", "city", "n_reviews_sample", "food"]
    )


@query
def dedup_rows(spark, d):
    return enrich.dedup_rows(
        standins.ratings(spark, d).select("user_id", "stars", "review_year", "review_month")
    )


# --- joins ------------------------------------------------------------------------------------


@query
def enrich_reviews(spark, d):
    joined = enrich.enrich_reviews(standins.ratings(spark, d), standins.business(spark, d))
    return joined.select("review_id", "business_id", "stars", "biz_name", "biz_city", "biz_stars", "biz_review_count")


def _absa_ready(spark, d):
    places = standins.business(spark, d)
    return enrich.absa_ready(standins.reviews(spark, d), places, standins.users(spark, d), DOMAIN)


@query
def absa_ready(spark, d):
    return _absa_ready(spark, d).drop("review_ts")


@query
def absa_flat(spark, d):
    return enrich.absa_flat(_absa_ready(spark, d), standins.business(spark, d)).drop("review_ts")


@query
def join_weights(spark, d):
    rows = standins.ratings(spark, d)
    few = credibility.reviewer_weights(rows.where(F.col("review_year") >= 2001))
    return credibility.join_weights(rows.select("review_id", "user_id", "stars"), few, spread=["review_id"])


def _pairs(spark, d):
    return jobs.extract(standins.reviews(spark, d), nouns=NOUNS, adjectives=ADJECTIVES)


@query
def aspect_pairs(spark, d):
    return _pairs(spark, d).drop("review_ts")


@query
def aspect_map_apply(spark, d):
    found = materialize(_pairs(spark, d), "pairs")
    return jobs.map_aspects(found).select("review_id", "sentence", "aspect_seed", "aspect_opinion", "aspect")


def _labelled(spark, d):
    """Pairs with the aspect of their seed by vocabulary: the deterministic half of the mapping.

    Stored with the label, which all readers then share.
    """
    found = _pairs(spark, d)
    return materialize(found.withColumn("aspect", mapping.lexical_label(F.col("aspect_seed"))), "pairs")


def _labelled_distinct(spark, d):
    """The same for distinct seeds and opinions, all that the lookup of polarity asks for."""
    found = materialize(_pairs(spark, d).select("aspect_seed", "aspect_opinion").distinct(), "pairs")
    return found.withColumn("aspect", mapping.lexical_label(F.col("aspect_seed")))


@query
def polarity_hits(spark, d):
    return sentiment.polarity_hits(_labelled_distinct(spark, d), vocab.polarity_table(spark))


@query
def polarity_hits_substring(spark, d):
    return sentiment.polarity_hits(_labelled_distinct(spark, d), vocab.polarity_table(spark), "substring")


# --- aggregations -----------------------------------------------------------------------------


@query
def top_cities(spark, d):
    joined = enrich.enrich_reviews(standins.ratings(spark, d), standins.business(spark, d))
    return enrich.top_counts(enrich.recent_top_rated(joined, 2000), "biz_city", 10, "n")


@query
def reviewer_weights(spark, d):
    return credibility.reviewer_weights(standins.ratings(spark, d))


def _monthly(spark, d):
    return credibility.monthly_weights(standins.ratings(spark, d), "review_year", "review_month")


@query
def monthly_weights(spark, d):
    return _monthly(spark, d)


@query
def incremental_weights(spark, d):
    """Monthly weights from yearly batches, a tenth of whose rows arrive one batch late."""
    path = scratch_path(spark, "weights")
    rows = standins.ratings(spark, d).select(
        "review_id", "user_id", "stars", F.col("review_year").alias("year"), F.col("review_month").alias("month")
    )
    late = F.when(F.crc32(F.col("review_id").cast("binary")) % 10 == 0, 1).otherwise(0)
    arrived = materialize(rows.withColumn("batch", F.col("year") + late).repartition("batch"), "arrived")
    for batch in sorted(r.batch for r in arrived.select("batch").distinct().collect()):
        weightstate.apply_batch(spark, path, arrived.where(F.col("batch") == batch), batch)
    return weightstate.weights(spark, path)


@query
def cohort_monthly(spark, d):
    rows = standins.ratings(spark, d)
    return credibility.cohort_monthly(
        rows, credibility.top_reviewers(rows, 25), 5, "review_year", "review_month"
    )


@query
def monthly_summary(spark, d):
    return credibility.monthly_summary(_monthly(spark, d))


@query
def weight_var_corr(spark, d):
    return credibility.weight_variance_corr(credibility.monthly_summary(_monthly(spark, d)))


def _vectors(spark, d):
    return jobs.restaurant_vectors(standins.reviews(spark, d), ratings=standins.ratings(spark, d))


@query
def restaurant_vectors(spark, d):
    return _vectors(spark, d)


def _sentiment(spark, d):
    return sentiment.opinion_sentiment(_labelled(spark, d), vocab.polarity_table(spark))


@query
def opinion_sentiment(spark, d):
    return _sentiment(spark, d).select(
        "review_id", "sentence", "aspect_seed", "aspect_opinion", "aspect_negated", "aspect", "sentiment"
    )


def _scored(spark, d):
    return sentiment.review_aspect_scores(_sentiment(spark, d))


@query
def review_aspect_scores(spark, d):
    return _scored(spark, d).drop("review_ts")


@query
def weighted_scores(spark, d):
    scored = materialize(_scored(spark, d), "scored")
    places = standins.business(spark, d).select("business_id", F.col("stars").alias("biz_stars"))
    weights = materialize(credibility.reviewer_weights(scored, "review"), "weights")
    return vectors.weighted_scores(scored, weights, places).drop("review_ts")


@query
def business_aspect_scores(spark, d):
    scored = materialize(_scored(spark, d), "scored")
    weights = materialize(credibility.reviewer_weights(scored, "review"), "weights")
    return vectors.business_aspect_scores(scored, weights, 3)


@query
def zscore_vectors(spark, d):
    z = vectors.zscores(materialize(_vectors(spark, d), "vectors"))
    return z.select("business_id", "food_z", "service_z", "price_z", "amb_z")


@query
def top_words(spark, d):
    return jobs.top_words(standins.documents(spark, d), min_length=1)


@query
def heavy_words(spark, d):
    """The most frequent words by bounded counters and an exact recount."""
    words = jobs.counted_words(standins.documents(spark, d))
    return heavyhitters.top_keys(words, "word", 200, counters=500)


@query
def term_counts(spark, d):
    return mapping.term_counts(_pairs(spark, d))


@query
def top_reviewers(spark, d):
    return credibility.top_reviewers(standins.order_ratings(spark, d), 100)


# --- series -----------------------------------------------------------------------------------


def _points(spark, d):
    return series.monthly_points(_monthly(spark, d))


@query
def user_series(spark, d):
    return series.user_series(_points(spark, d))


@query
def series_cohort(spark, d):
    return series.series_cohort(_points(spark, d))


@query
def rolling_mean_12(spark, d):
    return series.rolling_mean(_points(spark, d))


@query
def acf(spark, d):
    return series.acf(_points(spark, d))


@query
def pacf(spark, d):
    return series.pacf(_points(spark, d))


@query
def df_tstat(spark, d):
    return series.dickey_fuller(_points(spark, d))


@query
def df_tstat_lag1(spark, d):
    return series.dickey_fuller(_points(spark, d), lags=1)


@query
def unit_root(spark, d):
    return unitroot.unit_root(_points(spark, d))


def _fits(spark, d):
    return series.fit_ar(_points(spark, d))


@query
def ar_fit(spark, d):
    return _fits(spark, d).select(
        "series", "first", "last", "ok", "best_order", "aic", "n_obs", "phi1", "phi2", "sigma2_resid"
    )


@query
def ar_fitted(spark, d):
    return series.ar_fitted(_fits(spark, d))


@query
def ljung_box(spark, d):
    return _fits(spark, d).select("series", "lb_stat_12", "lb_pvalue_12")


@query
def ar_summary(spark, d):
    top = vectors.top_by(series.ar_summary(_fits(spark, d)), "phi", 10, "series")
    return top.select("series", "best_order", "phi1", "phi2", "phi", "phi_sum", "aic", "n_obs")


@query
def ar_flags(spark, d):
    return series.ar_flags(series.ar_summary(materialize(_fits(spark, d), "fits")))


@query
def describe_metrics(spark, d):
    summary = series.ar_summary(materialize(_fits(spark, d), "fits"))
    return vectors.describe(summary, ["phi", "aic", "sigma2_resid"])


# --- text -------------------------------------------------------------------------------------


@query
def sentence_tokens(spark, d):
    docs = standins.documents(spark, d)
    return docs.select(
        "doc_id", F.posexplode(sentences(F.lower("text"))).alias("pos", "sentence")
    ).select("doc_id", "pos", "sentence", F.size(word_tokens(F.col("sentence"))).alias("tokens"))


QUERIES["sentences"] = QUERIES.pop("sentence_tokens")


@query
def lexicon_scores(spark, d):
    scored = lexicon.score_reviews(standins.reviews(spark, d), with_terms=False)
    return scored.select("review_id", "aspect_food", "aspect_service", "aspect_price", "aspect_amb")


@query
def lexicon_terms(spark, d):
    scored = lexicon.score_reviews(
        standins.reviews(spark, d), per_sentence=vocab.TERMS_PER_SENTENCE, per_review=vocab.TERMS_PER_REVIEW
    )
    return scored.select("review_id", *[f"{a}_{s}_terms" for a in lexicon.ASPECTS for s in ("pos", "neg")])


def _words(spark, d):
    """Distinct document words with their number of occurrences."""
    docs = standins.documents(spark, d)
    tokens = docs.select("lang", F.explode(alpha_words(F.col("text"))).alias("word"))
    return tokens.where(F.length("word") > 0).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


def _document_terms(spark, d):
    return _words(spark, d).select(F.col("word").alias("term")).distinct()


def _language_prototypes(spark, d):
    order = F.array_position(F.array(*[F.lit(x) for x in LANGS]), F.col("lang"))
    return _words(spark, d).where(F.col("lang").isin(LANGS)).select(
        F.col("lang").alias("label"), order.cast("int").alias("label_order"), F.col("word").alias("term")
    )


@query
def lemma_counts(spark, d):
    docs = standins.documents(spark, d).select(F.explode(lemmas(F.col("text"))).alias("lemma"))
    return docs.groupBy("lemma").agg(F.count(F.lit(1)).alias("n"))


QUERIES["lemmas"] = QUERIES.pop("lemma_counts")


@query
def stem_tokens(spark, d):
    words = _document_terms(spark, d)
    return words.select("term", stem_words(F.array("term"))[0].alias("stem"))


@query
def char_ngrams(spark, d):
    grams = mapping.gram_counts(_document_terms(spark, d), ["term"], "term")
    return grams.groupBy("ngram").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf")
    )


@query
def tfidf_weights(spark, d):
    terms_ = materialize(_document_terms(spark, d), "terms")
    return mapping.tfidf_weights(terms_, _language_prototypes(spark, d))


@query
def language_assign(spark, d):
    """Document words against one prototype per language: the assignment at volume."""
    terms_ = materialize(_document_terms(spark, d), "terms")
    return mapping.assign_labels(terms_, materialize(_language_prototypes(spark, d), "protos"))


def _assigned(spark, d):
    counts = mapping.term_counts(_pairs(spark, d))
    stored = materialize(counts, "terms")
    return stored, mapping.assign_labels(stored.select("term"), vocab.prototype_table(spark))


@query
def aspect_assign(spark, d):
    return _assigned(spark, d)[1]


@query
def aspect_backoff(spark, d):
    counts = mapping.term_counts(_pairs(spark, d))
    return counts.select(
        "term",
        mapping.lexical_label(F.col("term")).alias("word_label"),
        mapping.lexical_label(F.col("term"), mode="substring").alias("substring_label"),
    )


@query
def mapping_agreement(spark, d):
    counts, labels = _assigned(spark, d)
    return mapping.mapping_agreement(labels, counts)


def _extracted(spark, d):
    """What an extractor would return: the pairs of a review as two lists."""
    label = F.when(F.col("stars") >= 4, "Positive").when(F.col("stars") <= 2, "Negative").otherwise("Neutral")
    nouns = F.filter(
        word_tokens(F.col("text")), lambda w: w.isin(EXTRACTED)
    )
    rows = standins.reviews(spark, d).select("review_id", "stars", nouns.alias("aspect"))
    return rows.select("review_id", "aspect", F.transform("aspect", lambda _: label).alias("sentiment"))


@query
def term_bucket_sum(spark, d):
    return terms.bucket_scores(_extracted(spark, d), "sum")


@query
def term_bucket_mean(spark, d):
    return terms.bucket_scores(_extracted(spark, d), "mean")


@query
def batch_score(spark, d):
    rows = standins.reviews(spark, d).select("review_id", "text")
    return terms.bucket_scores(terms.batch_extract(rows).drop("text"), "mean")


# --- clusters ---------------------------------------------------------------------------------


def _clusters(spark, d):
    """Vectors labelled by the nearest of fixed centres, with metadata."""
    labelled = cluster.assign_fixed(_vectors(spark, d), CENTRES)
    return cluster.describe_clusters(labelled, standins.business(spark, d))


@query
def kmeans_clusters(spark, d):
    stored = materialize(_vectors(spark, d), "vectors")
    return cluster.kmeans_clusters(stored).select("business_id", "cluster")


@query
def kmeans_quality(spark, d):
    stored = materialize(_vectors(spark, d), "vectors")
    clustered = cluster.silhouette_values(cluster.kmeans_clusters(stored))
    per_cluster = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("silhouette").alias("s"))
    whole = per_cluster.agg((F.sum("s") / F.sum("n")).alias("x")).scalar()
    return per_cluster.select("cluster", "n", (F.col("s") / F.col("n")).alias("silhouette"), whole.alias("overall"))


@query
def cluster_profile(spark, d):
    return cluster.cluster_profile(_clusters(spark, d))


def _moved(spark, d):
    standard = materialize(
        vectors.zscores(materialize(cluster.assign_fixed(_vectors(spark, d), CENTRES), "labelled")), "z"
    )
    return cluster.weighted_assign(standard, SLIDERS)


@query
def weighted_assign(spark, d):
    return _moved(spark, d).select("business_id", "cluster", "cluster_weighted")


@query
def cluster_size_compare(spark, d):
    return cluster.cluster_size_compare(_moved(spark, d))


@query
def top_by_aspect(spark, d):
    placed = materialize(
        cluster.describe_clusters(_vectors(spark, d), standins.business(spark, d)), "placed"
    ).withColumn("food", F.round("food", 6)).withColumn("service", F.round("service", 6))
    keep = ["business_id", "name", "city", "food", "service"]
    food = vectors.top_by(placed, "food").select(F.lit("food").alias("by"), *keep)
    service = vectors.top_by(placed, "service").select(F.lit("service").alias("by"), *keep)
    return food.unionByName(service)
