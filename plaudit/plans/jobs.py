"""Composite jobs: the user-level pipelines, as functions over DataFrames.

Stages with several consumers are written once to the shared folder (``session.materialize``);
everything else stays one lazy plan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import BUSINESS, REVIEW
from ..functions import vocab
from ..functions.text import alpha_words, without_stop_words
from ..operators import cluster, credibility, lexicon, mapping, pairs, sentiment, series, unitroot, vectors
from ..operators.enrich import (
    absa_flat,
    absa_ready,
    enrich_reviews,
    filter_domain,
    preview,
    profile,
    recent_top_rated,
    top_counts,
)
from ..scale import hash_ordered_sample, join_dimension
from ..session import materialize
from ..sources import ingest
from ..sources.tables import read_json, read_years, write_csv, write_parquet, write_partitioned
from .ledger import Ledger


# --- ingest, enrich, explore ------------------------------------------------------------------


def enrich(spark: SparkSession, reviews_root: str, business_json: str, target: str) -> None:
    business = read_json(spark, business_json, BUSINESS)
    joined = enrich_reviews(spark.read.parquet(reviews_root), business)
    write_partitioned(joined, target, ["review_year"])


def explore(spark: SparkSession, root: str, years: Sequence[int] | None = None) -> dict[str, DataFrame]:
    """Profile, preview and top cities of recent five-star reviews."""
    df = read_years(spark, root, years)
    short = ("review_id", "user_id", "business_id", "stars", "review_year", "biz_city", "biz_state")
    return {
        "profile": profile(df, [c for c in short if c in df.columns]),
        "preview": preview(df),
        "top_cities": top_counts(recent_top_rated(df), "biz_city", 10),
    }


def top_words(
    texts: DataFrame, text: str = "text", min_length: int = 3, k: int = 200,
    stop_words: Sequence[str] = vocab.STOP_WORDS,
) -> DataFrame:
    """The ``k`` most frequent words, counted in each task before the shuffle."""
    return top_counts(counted_words(texts, text, min_length, stop_words), "word", k, "n")


def counted_words(
    texts: DataFrame, text: str = "text", min_length: int = 3, stop_words: Sequence[str] = vocab.STOP_WORDS
) -> DataFrame:
    """The words that count, one row per occurrence."""
    words = without_stop_words(alpha_words(F.col(text).cast("string")), stop_words)
    tokens = texts.where(F.col(text).isNotNull()).select(F.explode(words).alias("word"))
    return tokens.where(F.length("word") >= max(1, min_length))


# --- sentence-level aspect sentiment ----------------------------------------------------------

META = ("review_id", "user_id", "business_id", "stars", "review_ts")


def extract(
    reviews: DataFrame, keep: Sequence[str] = META, nouns: Sequence[str] = vocab.NOUNS,
    adjectives: Sequence[str] = vocab.ADJECTIVES,
) -> DataFrame:
    """Distinct aspect-opinion rows of the reviews.

    Pairs of a sentence are distinct, so a row repeats only where a sentence does: in one review, whose
    text then keeps it once, or in reviews that agree in all of ``keep``.  Only such reviews, usually
    none, are shuffled by their pairs; a hash of ``keep`` finds them, and equal hashes do no harm.
    """
    kept = [c for c in keep if c in reviews.columns]
    rows = reviews.select(*kept, "text")

    def found(some: DataFrame) -> DataFrame:
        return pairs.aspect_pairs(some, "text", kept, nouns, adjectives, once=True)

    keyed = rows.withColumn("__key", F.xxhash64(F.lit(0), *kept, *[F.col(c).isNull() for c in kept]))
    counts = keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("n"))
    several = materialize(counts.where("n > 1").select("__key"), "repeated-reviews")
    if several.isEmpty():
        return found(rows)
    single = keyed.join(several, "__key", "left_anti").drop("__key")
    rest = keyed.join(several, "__key", "left_semi").drop("__key")
    return found(single).unionByName(found(rest).dropDuplicates())


def map_aspects(
    found: DataFrame, prototypes: vocab.Vocabulary = vocab.PROTOTYPES, mode: str = "word"
) -> DataFrame:
    terms = materialize(mapping.term_counts(found).select("term"), "terms")
    labels = materialize(
        mapping.assign_labels(terms, vocab.prototype_table(found.sparkSession, prototypes)), "labels"
    )
    return mapping.apply_mapping(found, labels, "aspect_seed", prototypes, mode)


def score_sentences(
    labelled: DataFrame, polarity: Mapping[str, vocab.Vocabulary] = vocab.POLARITY,
    match: str = "token",
) -> DataFrame:
    lex = vocab.polarity_table(labelled.sparkSession, polarity)
    return sentiment.review_aspect_scores(sentiment.opinion_sentiment(labelled, lex, match))


def absa(
    reviews: DataFrame, business: DataFrame | None = None,
    prototypes: vocab.Vocabulary = vocab.PROTOTYPES,
    polarity: Mapping[str, vocab.Vocabulary] = vocab.POLARITY,
    nouns: Sequence[str] = vocab.NOUNS, grain: str = "review", domain: str | None = None,
) -> dict[str, DataFrame]:
    """Text to sentence scores, user weights, weighted scores and business scores.

    With ``domain``, a pattern, only reviews of businesses whose categories match it count.
    """
    if domain is not None:
        if business is None:
            raise ValueError("a domain needs the businesses")
        places = filter_domain(business, regex=domain).select("business_id").distinct()
        reviews = join_dimension(reviews, places, "business_id", "left_semi")
    found = materialize(extract(reviews, nouns=nouns), "pairs")
    scored = materialize(score_sentences(map_aspects(found, prototypes), polarity), "scored")
    weights = materialize(credibility.reviewer_weights(scored, grain), "weights")
    stars = None
    if business is not None:
        stars = business.select("business_id", F.col("stars").alias("biz_stars"))
    return {
        "pairs": found,
        "scored": scored,
        "weights": weights,
        "weighted": vectors.weighted_scores(scored, weights, stars),
        "business": vectors.business_aspect_scores(scored, weights),
    }


# --- review-level lexicon sentiment, vectors and clusters -------------------------------------


def restaurant_vectors(
    reviews: DataFrame, min_reviews: int = 10, ratings: DataFrame | None = None
) -> DataFrame:
    """Text to business vectors: lexicon scores weighted by the credibility of their authors.

    The weights are stored first: their size is then known to the join that uses them.
    ``ratings`` may give the same reviews without their text, where that is cheaper to read.
    """
    scored = lexicon.score_reviews(reviews, with_terms=False)
    weights = materialize(
        credibility.reviewer_weights(reviews if ratings is None else ratings), "weights"
    )
    return vectors.business_vectors(scored, weights, min_reviews)


def absa_lexicon(
    reviews: DataFrame, business: DataFrame, users: DataFrame, sample: int | None = None,
    min_reviews: int = 10,
) -> dict[str, DataFrame]:
    flat = absa_flat(absa_ready(reviews, business, users), business)
    chosen = hash_ordered_sample(flat, "review_id", sample) if sample else flat
    scored = materialize(lexicon.score_reviews(chosen), "absa-scored")
    weights = materialize(
        credibility.reviewer_weights(scored.withColumnRenamed("review_stars", "stars")), "weights"
    )
    return {"scored": scored, "vectors": vectors.business_vectors(scored, weights, min_reviews)}


def cluster_vectors(
    vecs: DataFrame, business: DataFrame, k: int = 6, sliders: Sequence[float] = (1, 1, 1, 1),
    export: str | None = None,
) -> dict[str, DataFrame]:
    """KMeans on stored vectors, metadata, z-scores, re-weighted labels and their comparison."""
    stored = materialize(vecs, "vectors")
    labelled = cluster.kmeans_clusters(stored, k).drop("features")
    described = materialize(cluster.describe_clusters(labelled, business), "clusters")
    standard = vectors.zscores(described)
    moved = cluster.weighted_assign(standard, sliders)
    if export:
        write_csv(standard, export)
    return {
        "clusters": described,
        "profile": cluster.cluster_profile(described),
        "zscores": standard,
        "weighted": moved,
        "sizes": cluster.cluster_size_compare(moved),
    }


# --- credibility over time --------------------------------------------------------------------


def credibility_eval(
    reviews: DataFrame, k: int = 5000, min_reviews: int | None = None, year: str = "year",
    month: str = "month",
) -> dict[str, DataFrame]:
    monthly_all = credibility.monthly_weights(reviews, year, month)
    cohort = credibility.top_reviewers(reviews, k)
    monthly = materialize(
        credibility.cohort_monthly(reviews, cohort, min_reviews, year, month), "monthly"
    )
    points = series.monthly_points(monthly)
    fits = materialize(series.fit_ar(points), "ar-fits")
    summary = series.ar_summary(fits)
    trend = credibility.monthly_summary(monthly)
    return {
        "monthly_weights": monthly_all,
        "top_users": cohort,
        "user_monthly": monthly,
        "summary": trend,
        "correlation": credibility.weight_variance_corr(trend),
        "fits": fits,
        "ar_summary": summary,
        "ar_flags": series.ar_flags(summary),
        "ar_describe": vectors.describe(summary, ["phi", "aic", "sigma2_resid"]),
        "acf": series.acf(points),
        "pacf": series.pacf(points),
        "unit_root": unitroot.unit_root(points),
    }


def write_monthly_series(monthly: DataFrame, target: str) -> None:
    """Cohort series by year: sorted by user inside, never one directory per user."""
    write_partitioned(monthly, target, ["year"], sort=["user_id", "month"])


# --- staged run -------------------------------------------------------------------------------


def run_all(
    spark: SparkSession, review_json: str, business_json: str, root: str,
    years: Sequence[int] | None = None, skip_review: bool = False, skip_join: bool = False,
    words: int = 200,
) -> dict[str, DataFrame]:
    """Ingest, enrich, explore and count words; finished stages can be skipped."""
    reviews, enriched = f"{root}/review", f"{root}/review_enriched"
    if not skip_review:
        ingest.ingest_reviews(spark, review_json, reviews)
    if not skip_join:
        enrich(spark, reviews, business_json, enriched)
    out = explore(spark, enriched, years)
    out["top_words"] = top_words(read_years(spark, enriched, years), k=words)
    return out


def staged_run(
    spark: SparkSession, review_json: str, business_json: str, root: str, years: Sequence[int] | None = None,
    words: int = 200,
) -> Ledger:
    """The stages of ``run_all`` in a ledger: review, enriched, top_cities, top_words.

    ``frame(name)`` builds what is missing up to that stage; a second run, or one after a kill, goes
    on where the first one ended.
    """
    ledger = Ledger(spark, root)
    timed = lambda: ingest.derive_time(read_json(spark, review_json, REVIEW))
    ledger.declare("review", timed, reads=[review_json])
    ledger.declare(
        "enriched", lambda: enrich_reviews(ledger.frame("review"), read_json(spark, business_json, BUSINESS)),
        after=["review"], reads=[business_json],
    )

    def chosen() -> DataFrame:
        df = ledger.frame("enriched")
        return df if years is None else df.where(F.col("review_year").isin([int(y) for y in years]))

    ledger.declare("top_cities", lambda: top_counts(recent_top_rated(chosen()), "biz_city", 10), after=["enriched"], years=years)
    ledger.declare("top_words", lambda: top_words(chosen(), k=words), after=["enriched"], years=years, words=words)
    return ledger


def write_results(results: Mapping[str, DataFrame], root: str) -> None:
    for name, df in results.items():
        write_parquet(df, f"{root}/{name}")
