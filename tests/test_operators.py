"""Hand-made rows for each operator family, and the behaviours that are easy to get wrong."""

import json
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plaudit.contracts import MissingColumns, REVIEW, id_columns, require_columns
from plaudit.functions import text, vocab
from plaudit.functions.stem import stem_words
from plaudit.operators import cluster, credibility, enrich, lexicon, mapping, pairs, sentiment, series, terms, vectors
from plaudit.plans import jobs
from plaudit.sources import ingest, tables


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


# --- contracts, sources -----------------------------------------------------------------------


def test_required_columns(spark):
    df = spark.range(1)
    assert require_columns(df, ["id"]) is df
    with pytest.raises(MissingColumns, match="stars"):
        credibility.reviewer_weights(df)
    assert id_columns({"t": df.withColumn("name", F.lit(1))}) == {"t": ["id"]}


def test_corrupt_json_is_kept(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text('{"review_id": "a", "stars": 3.0, "date": "2018-07-07 22:18:00"}\nnot json\n')
    rows = tables.read_json(spark, str(path), REVIEW, keep_corrupt=True).collect()
    assert {r["_corrupt_record"] for r in rows} == {None, "not json"}
    timed = ingest.derive_time(tables.read_json(spark, str(path), REVIEW))
    assert [r.review_year for r in timed.orderBy("review_id").collect()] == [None, 2018]


def test_bad_dates_give_null(spark):
    df = spark.createDataFrame([("x", "nonsense"), ("y", "2020-02-03 04:05:06")], "k string, date string")
    assert [r.review_year for r in ingest.derive_time(df).orderBy("k").collect()] == [None, 2020]
    assert [r.year for r in ingest.with_year(df).orderBy("k").collect()] == [None, 2020]


def test_entities_and_year_scan(spark, tmp_path):
    reviews, business, users = (str(tmp_path / f"{n}.json") for n in ("r", "b", "u"))
    with open(reviews, "w") as f:
        for i in range(6):
            f.write(json.dumps({"review_id": f"r{i}", "user_id": "u", "business_id": f"b{i % 3}", "stars": 5.0,
                                "text": "Great pizza. Bad service!", "date": f"{2017 + i % 3}-01-02 03:04:05"}) + "\n")
    with open(business, "w") as f:
        for i in range(2):
            f.write(json.dumps({"business_id": f"b{i}", "name": f"n{i}", "city": "c", "stars": 4.0,
                                "categories": "Mexican, Restaurants", "attributes": {"AcceptsInsurance": "True"}}) + "\n")
    with open(users, "w") as f:
        f.write(json.dumps({"user_id": "u", "yelping_since": "2011-05-05 00:00:00"}) + "\n")
    loaded = ingest.load_all(spark, {"business": business, "review": reviews, "user": users}, str(tmp_path / "out"))
    assert "year" in loaded["review"].columns and "year" not in loaded["business"].columns
    ingest.ingest_users(spark, users, str(tmp_path / "users"))
    assert spark.read.parquet(str(tmp_path / "users")).first().yelping_year == 2011
    ingest.ingest_for_credibility(spark, reviews, str(tmp_path / "cred"))
    assert set(spark.read.parquet(str(tmp_path / "cred")).columns) == {"user_id", "stars", "date", "review_ts", "year", "month"}
    out = jobs.run_all(spark, reviews, business, str(tmp_path / "all"), years=[2018, 2019])
    assert out["top_cities"].collect() == [(None, 2), ("c", 2)]
    assert dict(map(tuple, out["top_words"].collect())) == {"great": 4, "pizza": 4, "bad": 4, "service": 4}
    again = jobs.run_all(spark, reviews, business, str(tmp_path / "all"), skip_review=True, skip_join=True)
    assert again["preview"].count() == 6
    chosen = tables.read_years(spark, str(tmp_path / "all/review_enriched"), [2018])
    assert "review_year" in chosen.columns and chosen.count() == 2
    assert "PartitionFilters: [isnotnull" in chosen._jdf.queryExecution().executedPlan().toString()
    places = tables.read_json(spark, business, None)
    assert enrich.has_field(places, "attributes", "AcceptsInsurance", "h").first().h is True
    spread = enrich.has_field(loaded["business"], "attributes", "Other", "h")
    assert spread.first().h is False


def test_persisted_monthly_series_layout(spark, tmp_path):
    monthly = spark.createDataFrame([(u, 2020, m, 1.0) for u in range(3) for m in (2, 1)], "user_id int, year int, month int, w_user double")
    jobs.write_monthly_series(monthly, str(tmp_path / "m"))
    assert [p.name for p in (tmp_path / "m").glob("year=*")] == ["year=2020"]


def test_csv_prefers_the_first_present(spark, tmp_path):
    schema = spark.range(1).schema
    tables.write_csv(spark.range(3), str(tmp_path / "plain"), single_file=True)
    paths = [str(tmp_path / "z"), str(tmp_path / "plain")]
    assert tables.read_first_present(spark, paths, [schema, schema]).count() == 3


def test_category_modes(spark):
    df = spark.createDataFrame([("Mexican, Restaurants",), ("Restaurants, Bars",), (None,)], "categories string")
    assert enrich.filter_category(df).count() == 2
    assert [r[0] for r in enrich.filter_category(df, mode="suffix").collect()] == ["Mexican, Restaurants"]
    assert enrich.filter_domain(df).count() == 2


# --- text -------------------------------------------------------------------------------------


def test_lemmas(spark):
    got = one(spark, text.lemmas(F.col("t")), t="Berries tacos glass a")
    assert got == ["berry", "taco", "glass"]


@pytest.mark.parametrize(
    "word, grams",
    [("ab", [" ab", "ab ", " ab "]), ("a", [" a "]), ("abc", [" ab", "abc", "bc ", " abc", "abc ", " abc "])],
)
def test_char_grams(spark, word, grams):
    assert one(spark, text.char_grams(F.col("t")), t=word) == grams
    assert one(spark, text.char_grams(F.col("t")), t=f" {word}  {word}") == grams * 2


def test_opinion_is_lowered_before_cleaning(spark):
    assert one(spark, text.normal_opinion(F.col("t")), t="Very Good-ish!") == "very good-ish "


def test_stop_words_are_sparks(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert sorted(vocab.STOP_WORDS) == sorted(StopWordsRemover.loadDefaultStopWords("english"))


@pytest.mark.parametrize(
    "word, stem",
    [  # pairs printed in the description of the algorithm
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"),
        ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"),
        ("troubling", "troubl"), ("sized", "size"), ("hopping", "hop"), ("tanned", "tan"), ("falling", "fall"),
        ("hissing", "hiss"), ("failing", "fail"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"),
        ("relational", "relat"), ("conditional", "condit"), ("rational", "ration"), ("digitizer", "digit"),
        ("vietnamization", "vietnam"), ("predication", "predic"), ("operator", "oper"), ("decisiveness", "decis"),
        ("hopefulness", "hope"), ("formality", "formal"), ("sensibility", "sensibl"), ("triplicate", "triplic"),
        ("formative", "form"), ("electrical", "electr"), ("goodness", "good"), ("revival", "reviv"),
        ("allowance", "allow"), ("inference", "infer"), ("adjustable", "adjust"), ("replacement", "replac"),
        ("adoption", "adopt"), ("communism", "commun"), ("effective", "effect"), ("probate", "probat"),
        ("rate", "rate"), ("cease", "ceas"), ("controlling", "control"), ("roll", "roll"),
    ],
)
def test_stems(spark, word, stem):
    assert one(spark, stem_words(F.array("t"))[0], t=word) == stem


def test_lexicon_scores(spark):
    df = spark.createDataFrame(
        [(1, "Pizza was amazing but staff rude."), (2, None), (3, ""), (4, "..."), (5, "Good food! Great Food. The music is loud")],
        "i int, text string",
    )
    rows = {r.i: r for r in lexicon.score_reviews(df).collect()}
    for i in (1, 2, 3, 4):
        assert [rows[i][f"aspect_{a}"] for a in lexicon.ASPECTS] == [0.0] * 4
    assert rows[1].food_pos_terms == ["amazing"] and rows[1].service_neg_terms == ["rude"]
    assert rows[2].food_pos_terms == []
    assert rows[5].aspect_food == pytest.approx(2 / (2 + 1e-6)) and rows[5].aspect_amb == pytest.approx(-1, abs=1e-5)
    many = spark.createDataFrame([("food " + "good " * 9 + ". ") * 3,], "string").toDF("text")
    assert len(lexicon.score_reviews(many, per_sentence=5, per_review=10).first().food_pos_terms) == 10


def brute_lexicon(review):
    import re

    counts = {a: [0, 0] for a in lexicon.ASPECTS}
    for sentence in re.split(r"[.!?]+", (review or "").lower()):
        words = re.findall(r"[a-zA-Z']+", sentence)
        p = sum(w in vocab.LEXICON_POSITIVE for w in words)
        n = sum(w in vocab.LEXICON_NEGATIVE for w in words)
        for a in counts:
            if set(words) & set(vocab.LEXICON_ASPECTS[a]):
                counts[a][0] += p
                counts[a][1] += n
    return [0.0 if p + n == 0 else (p - n) / (p + n + 1e-6) for p, n in counts.values()]


def test_lexicon_against_brute_force(spark):
    import random

    rnd = random.Random(5)
    words = vocab.LEXICON_POSITIVE + vocab.LEXICON_NEGATIVE + sum(vocab.LEXICON_ASPECTS.values(), []) + ["the", ".", "!", "?"]
    reviews = [" ".join(rnd.choices(words, k=rnd.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(reviews)], "i int, text string")
    for row in lexicon.score_reviews(df, with_terms=False).collect():
        got = [row[f"aspect_{a}"] for a in lexicon.ASPECTS]
        assert got == pytest.approx(brute_lexicon(row.text), abs=1e-9)


# --- pairs, mapping, sentiment ----------------------------------------------------------------


@pytest.mark.parametrize(
    "sentence, want",
    [
        ("Great food", {("great food", "great", False)}),
        ("kind and helpful waiter", {("kind helpful waiter", "kind", False), ("kind helpful waiter", "helpful", False)}),
        ("The service is not very slow", {("service", "not very slow", True)}),
        ("the soup wasn't fresh", {("soup", "n't fresh", True)}),
        ("desserts were small and sweet", {("desserts", "small", False), ("desserts", "sweet", False)}),
        ("bread and fish were dry", {("bread", "dry", False), ("fish", "dry", False)}),
        ("he left the rice cold", {("rice", "cold", False)}),
        ("a host who was so kind", {("host", "so kind", False)}),
        ("the portion of cake was large", {("portion cake", "large", False)}),
        ("The fries were hot and tasted great", {("fries", "hot", False), ("fries", "great", False)}),
        ("The food was cold but did not taste bad", {("food", "cold", False), ("food", "bad", True)}),
        (
            "Bread and fish were dry and smelled very good",
            {(a, o, False) for a in ("bread", "fish") for o in ("dry", "very good")},
        ),
        ("The waiter brought menus and was friendly", {("waiter", "friendly", False)}),
        (
            "The soup was hot and the staff was rude and looked slow",
            {("soup", "hot", False), ("staff", "rude", False), ("staff", "slow", False)},
        ),
        ("The food was good and everyone was friendly", {("food", "good", False)}),
        ("The tea was good and the evening was nice", {("tea", "good", False)}),
        (
            "The pizza is hot and cheap and tastes not very fresh and looks nice",
            {("pizza", "hot", False), ("pizza", "cheap", False), ("pizza", "not very fresh", True), ("pizza", "nice", False)},
        ),
        ("nothing here", set()),
        ("", set()),
    ],
)
def test_pairs(spark, sentence, want):
    df = spark.createDataFrame([(sentence,)], "text string")
    got = pairs.aspect_pairs(df).collect()
    assert {(r.aspect_seed, r.aspect_opinion, r.aspect_negated) for r in got} == want
    assert len(got) == len(want)


def test_null_text_gives_no_pairs(spark):
    assert pairs.aspect_pairs(spark.createDataFrame([(None,)], "text string")).count() == 0


def test_tfidf_against_brute_force(spark):
    protos = {"a": ["alpha", "alphabet soup"], "b": ["beta", "betamax"]}
    words = ["alpha", "beta", "soup beta", "gamma", "alp"]

    def grams(term):
        out = []
        for w in term.split():
            p = f" {w} "
            out += [p[i : i + n] for n in (3, 4, 5) if n <= len(p) for i in range(len(p) - n + 1)]
        return pd.Series(out).value_counts().to_dict()

    docs = {w: grams(w) for w in words}
    classes = {k: grams(" ".join(v)) for k, v in protos.items()}
    everything = [*docs.values(), *classes.values()]
    df = {g: sum(g in d for d in everything) for d in everything for g in d}
    n = len(everything)

    def unit(d):
        v = {g: (1 + math.log(t)) * (math.log((1 + n) / (1 + df[g])) + 1) for g, t in d.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / size for g, x in v.items()}

    P = {k: unit(v) for k, v in classes.items()}
    got = {r.term: r for r in mapping.assign_labels(
        spark.createDataFrame([(w,) for w in words], "term string"), vocab.prototype_table(spark, protos)).collect()}
    for w in words:
        u = unit(docs[w])
        sims = {k: sum(x * p.get(g, 0) for g, x in u.items()) for k, p in P.items()}
        best = max(sims, key=sims.get)
        assert got[w].similarity == pytest.approx(sims[best], abs=1e-9)
        assert got[w].label == (best if sims[best] >= 0.04 else None)
    assert got["gamma"].label is None


def test_backoff_modes(spark):
    df = spark.createDataFrame([("staff member",), ("ice cream",), ("zzz",), ("zz yy",)], "s string")
    protos = {"food": ["pizza", "ice cream"], "service": ["staff"]}
    word = [r[0] for r in df.select(mapping.lexical_label(F.col("s"), protos)).collect()]
    assert word == ["service", "food", None, None]
    loose = [r[0] for r in df.select(mapping.lexical_label(F.col("s"), protos, "substring")).collect()]
    assert loose == ["service", "food", None, "food"]


def test_seeds_are_trimmed_before_counting(spark):
    df = spark.createDataFrame([(" Pizza ",), ("pizza",), ("",), (None,)], "aspect_seed string")
    assert mapping.term_counts(df).collect() == [("pizza", 2)]


def labelled(spark, rows):
    return spark.createDataFrame(rows, "aspect string, aspect_opinion string, aspect_negated boolean")


def test_sentiment(spark):
    lex = vocab.polarity_table(spark, {"positive": {"general": ["good"], "service": ["friendly"]},
                                       "negative": {"service": ["unfriendly"], "food": ["soggy"]}})
    rows = [("service", "unfriendly", False), ("food", "good", True), ("food", "good", None), ("food", "friendly", False),
            (None, "Good", False), ("food", "good but soggy", False), ("food", "blue", True)]

    def run(match):
        got = sentiment.opinion_sentiment(labelled(spark, rows), lex, match).collect()
        assert len(got) == len(rows)
        return {(r.aspect, r.aspect_opinion, r.aspect_negated): r.sentiment for r in got}

    token = run("token")
    assert token[rows[0]] == "negative" and run("substring")[rows[0]] == "mixed"
    assert [token[r] for r in rows[1:]] == ["negative", "positive", "neutral", "positive", "mixed", "neutral"]


def test_ratio_drops_empty_groups(spark):
    df = spark.createDataFrame([("r", "food", "positive"), ("r", "food", "negative"), ("r", "price", "neutral")],
                               "review_id string, aspect string, sentiment string")
    assert sentiment.review_aspect_scores(df).collect() == [("r", "food", 1, 1, 0.5)]


def test_term_buckets(spark):
    df = spark.createDataFrame(
        [(1, ["Pizza", "waiters", "unknown"], ["Positive", "Negative", "Positive"]), (2, [], []), (3, None, None),
         (4, ["pizza", "pizza"], ["Positive"])],
        "i int, aspect array<string>, sentiment array<string>")
    total = {r.i: r for r in terms.bucket_scores(df, "sum").collect()}
    mean = {r.i: r for r in terms.bucket_scores(df, "mean").collect()}
    assert (total[1].aspect_food, total[1].aspect_service, total[1].food_pos_terms) == (1.0, 0.0, ["Pizza"])
    assert (mean[1].aspect_service, mean[1].service_terms) == (-1.0, ["waiters"])
    assert total[2].aspect_food == 0.0 and mean[3].food_terms == [] and total[4].aspect_food == 1.0


def test_batch_scorer_gets_batches(spark):
    def load():
        return lambda texts: [{"aspect": ["food"], "sentiment": [str(len(texts))]} for _ in texts]

    df = spark.createDataFrame([(i, "t") for i in range(20)], "i int, text string").coalesce(1)
    sizes = [r.sentiment[0] for r in terms.batch_extract(df, load, batch=16).collect()]
    assert sorted(sizes) == ["16"] * 16 + ["4"] * 4


# --- credibility, vectors ---------------------------------------------------------------------


def test_weights(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 4.0), ("b", 2.0), ("c", None), ("d", 1.0), ("d", 2.0)], "user_id string, stars double")
    got = {r.user_id: (r.var_review_stars, r.w_user) for r in credibility.reviewer_weights(df).collect()}
    assert got == {"a": (0.0, 1.0), "b": (1.0, 0.5), "c": (0.0, 1.0), "d": (0.25, 0.8)}


def test_review_grain_counts_a_review_once(spark):
    df = spark.createDataFrame([("a", "r1", 5.0)] * 3 + [("a", "r2", 1.0)], "user_id string, review_id string, stars double")
    assert credibility.reviewer_weights(df, "review").first().user_review_count_in_sample == 2
    assert credibility.reviewer_weights(df).first().user_review_count_in_sample == 4


def test_vectors_weighted_mean(spark):
    cols = ", ".join(f"aspect_{a} double" for a in vectors.ASPECTS)
    df = spark.createDataFrame([("u", "b", 1.0, 0.0, 0.0, 0.0), ("v", "b", -1.0, 0.0, 0.0, 0.0)], f"user_id string, business_id string, {cols}")
    w = spark.createDataFrame([("v", 0.5)], "user_id string, w_user double")
    row = vectors.business_vectors(df, w, 2).first()
    assert row.food == pytest.approx(1 / 3) and row.cover_food_frac == 1.0 and row.n_users_sample == 2
    assert vectors.business_vectors(df, w, 3).count() == 0


def test_zscores_of_a_constant(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 3.0)], "a double, b double")
    assert {r.a_z for r in vectors.zscores(df, ["a", "b"]).collect()} == {0.0}
    assert sorted(r.b_z for r in vectors.zscores(df, ["b"], ddof=0).collect()) == [-1.0, 1.0]


# --- series -----------------------------------------------------------------------------------


def points(spark, values, name="s"):
    rows = [(name, f"{2000 + i // 12}-{i % 12 + 1:02d}-01", float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series string, date string, y double").withColumn("date", F.to_date("date"))


def test_rolling_mean(spark):
    got = [r.rolling for r in series.rolling_mean(points(spark, [1, 2, 3])).orderBy("date").collect()]
    assert got == [1.0, 1.5, 2.0]
    many = [r.rolling for r in series.rolling_mean(points(spark, range(20))).orderBy("date").collect()]
    assert many == pytest.approx(pd.Series(range(20)).rolling(12, min_periods=1).mean().tolist())


def test_ar_against_least_squares(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    y = [0.0, 0.1]
    for _ in range(118):
        y.append(0.2 + 0.4 * y[-1] + 0.3 * y[-2] + rng.normal(scale=0.1))
    y = np.array(y)
    row = series.fit_ar(points(spark, y)).first()
    X = np.column_stack([np.ones(len(y) - 2), y[1:-1], y[:-2]])
    beta, *_ = np.linalg.lstsq(X, y[2:], rcond=None)
    resid = y[2:] - X @ beta
    n = len(resid)
    aic = n * (math.log(2 * math.pi * (resid @ resid) / n) + 1) + 2 * 4
    c = resid - 0
    q = n * (n + 2) * sum((c[k:] @ c[:-k] / (c @ c)) ** 2 / (n - k) for k in range(1, 13))
    assert row.best_order == 2 and row.ok and row.n_obs == 120
    assert (row.phi1, row.phi2) == pytest.approx((beta[1], beta[2]), abs=1e-9)
    assert row.aic == pytest.approx(aic, abs=1e-7)
    assert row.sigma2_resid == pytest.approx(resid.var(ddof=1), abs=1e-9)
    assert row.lb_stat_12 == pytest.approx(q, abs=1e-6)


def test_degenerate_and_short_series(spark):
    constant = series.fit_ar(points(spark, [0.5] * 40)).first()
    assert (constant.ok, constant.reason, constant.phi1) == (False, "degenerate", None)
    short = series.fit_ar(points(spark, range(5))).first()
    assert (short.ok, short.reason) == (False, "insufficient_obs(<24)")
    assert {r.acf for r in series.acf(points(spark, [1] * 30)).collect()} == {None}
    assert series.dickey_fuller(points(spark, [1] * 30)).first().t_stat is None


@pytest.mark.parametrize("lags", [0, 1])
def test_unit_root_statistic(spark, lags):
    import numpy as np

    y = np.random.default_rng(4).normal(size=50).cumsum()
    d = np.diff(y)
    X = [np.ones(49 - lags), y[lags:-1]] + ([d[:-1]] if lags else [])
    X, t = np.column_stack(X), d[lags:]
    beta, *_ = np.linalg.lstsq(X, t, rcond=None)
    resid = t - X @ beta
    cov = np.linalg.inv(X.T @ X) * (resid @ resid) / (len(t) - X.shape[1])
    row = series.dickey_fuller(points(spark, y), lags).first()
    assert row.rho == pytest.approx(beta[1], abs=1e-9)
    assert row.t_stat == pytest.approx(beta[1] / math.sqrt(cov[1, 1]), abs=1e-7)


def test_acf_pacf(spark):
    import numpy as np

    y = np.random.default_rng(2).normal(size=60)
    c = y - y.mean()
    r = [c[: len(c) - k] @ c[k:] / (c @ c) for k in range(25)]
    got = [x.acf for x in series.acf(points(spark, y)).orderBy("lag").collect()]
    assert got == pytest.approx(r, abs=1e-9) and got[0] == 1.0
    partial = [x.pacf for x in series.pacf(points(spark, y)).orderBy("lag").collect()]
    for k in (1, 2, 5, 24):
        R = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        assert partial[k] == pytest.approx(np.linalg.solve(R, r[1 : k + 1])[-1], abs=1e-7)


def test_chi_square_tail(spark):
    got = spark.range(1).select(series._ljung_box_p(F.lit(21.0261), 12)).first()[0]
    assert got == pytest.approx(0.05, abs=1e-6)


def test_pooled_series(spark):
    monthly = spark.createDataFrame([(u, 2020, 1, float(u)) for u in range(50)], "user_id int, year int, month int, w_user double")
    pooled = series.monthly_points(monthly.withColumn("bucket", series.bucket_of("user_id", 1)), "bucket")
    assert pooled.first().y == pytest.approx(24.5) and pooled.count() == 1


# --- clusters ---------------------------------------------------------------------------------


def test_slider_ties_go_to_the_lowest_label(spark):
    rows = [(3, -1.0), (5, 1.0), (None, 0.0)]
    df = spark.createDataFrame([(c, x, 0.0, 0.0, 0.0) for c, x in rows], "cluster int, food_z double, service_z double, price_z double, amb_z double")
    assert [r.cluster_weighted for r in cluster.weighted_assign(df).orderBy("food_z").collect()] == [3, 3, 5]
    single = cluster.weighted_assign(df.where("cluster = 3 or cluster is null"))
    assert {r.cluster_weighted for r in single.collect()} == {0}


def test_cluster_sizes_align(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (3, 2)], "cluster int, cluster_weighted int")
    got = {r.label: (r.original, r.weighted) for r in cluster.cluster_size_compare(df).collect()}
    assert got == {1: (2, 1), 2: (0, 2), 3: (1, 0)}


# --- whole jobs -------------------------------------------------------------------------------


def test_jobs_end_to_end(spark, sf):
    from plaudit.plans import catalog
    from plaudit.sources import standins

    reviews, places = standins.reviews(spark, sf), standins.business(spark, sf)
    some = jobs.absa(reviews, places, domain="(?i)widget")["pairs"]
    inside = places.where("lower(categories) like '%widget%'")
    assert 0 < some.count() == jobs.extract(reviews.join(inside, "business_id", "left_semi")).count()
    out = jobs.absa(reviews, places)
    n = out["scored"].count()
    assert out["weighted"].count() == n
    assert abs(out["weighted"].agg(F.avg("sentiment_score")).first()[0]) < 1e-9
    assert out["weights"].where("w_user <= 0 or w_user > 1").count() == 0
    lex = jobs.absa_lexicon(reviews, places.withColumn("categories", F.lit("Bar")), standins.users(spark, sf), sample=3000)
    assert lex["scored"].count() == 3000
    assert lex["scored"].where("abs(aspect_food) > 1").count() == 0
    parts = jobs.cluster_vectors(catalog._vectors(spark, sf), places, k=4, sliders=(2, 1, 1, 1))
    assert parts["sizes"].agg(F.sum("original"), F.sum("weighted")).first() == (parts["clusters"].count(),) * 2
    timed = reviews.withColumnsRenamed({"review_year": "year", "review_month": "month"})
    cred = jobs.credibility_eval(timed, k=5)
    assert cred["top_users"].count() == 5 and cred["ar_summary"].count() == 5
    assert -1 <= cred["correlation"].first()[0] <= 1


def test_partition_count_does_not_matter(spark, sf):
    from plaudit.plans.catalog import QUERIES

    def run(width):
        spark.conf.set("spark.sql.shuffle.partitions", width)
        return sorted(map(tuple, QUERIES["restaurant_vectors"](spark, sf).collect()))

    try:
        assert run("1") == run("7")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


# --- nothing is capped, and no text breaks a pattern ------------------------------------------


@pytest.mark.parametrize(
    "text, want",
    [
        ("good " * 20_000, 0),
        ("food and " * 20_000 + "bread was good", 2),
        ("food " * 20_000 + "is very " + "very " * 20_000 + "good", 1),
        ("good " * 3_000 + "food", 1),
        ("left " * 20_000, 0),
        ("the food was hot" + " and tasted great but felt cold" * 8_000, 3),
        ("pizza and " * 1_000 + "bread was good and fresh " + "and hot " * 1_000, 6),
    ],
)
def test_pairs_of_endless_runs(spark, text, want):
    assert pairs.aspect_pairs(spark.createDataFrame([(text,)], "text string")).count() == want


def test_stems_of_endless_words(spark):
    words = ["b" * 100_000, "ab" * 50_000 + "ing", "y" * 100_001]
    got = spark.createDataFrame([(words,)], "w array<string>").select(stem_words(F.col("w")).alias("s")).first().s
    assert [len(s) for s in got] == [100_000, 100_000, 100_001]


def test_all_distinct_values_and_all_terms(spark):
    many = spark.range(6000).select(F.col("id").cast("string").alias("v"))
    assert enrich.distinct_values(many, "v").count() == 6000 and enrich.distinct_values(many, "v", 7).count() == 7
    text = spark.createDataFrame([("food " + "good " * 30,)], "text string")
    assert len(lexicon.score_reviews(text).first().food_pos_terms) == 30
    assert len(lexicon.score_reviews(text, per_sentence=5, per_review=10).first().food_pos_terms) == 5


def test_large_lexicon_and_many_labels(spark):
    lex = spark.range(25_000).select(
        F.lit(None).cast("string").alias("aspect_to_match"), F.concat(F.lit("w"), "id").alias("term_to_match"),
        F.when(F.col("id") % 2 == 0, "positive").otherwise("negative").alias("polarity"),
    )
    got = sentiment.opinion_sentiment(labelled(spark, [("food", "so w24998", False), ("food", "w24999", False)]), lex)
    assert {r.aspect_opinion: r.sentiment for r in got.collect()} == {"so w24998": "positive", "w24999": "negative"}
    protos = spark.range(300).select(
        F.concat(F.lit("l"), "id").alias("label"), F.col("id").cast("int").alias("label_order"),
        F.concat(F.lit("word"), F.col("id") * 7919).alias("term"),
    )
    out = mapping.assign_labels(spark.createDataFrame([(f"word{7919 * 250}",)], "term string"), protos).first()
    assert out.label == "l250" and out.similarity == pytest.approx(1)


def test_profile_in_one_pass(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "k int, t string")
    want = {("k", 3, 3, 2), ("t", 3, 2, 2)}
    assert {tuple(r) for r in enrich.profile(df).collect()} == want
    assert {tuple(r) for r in enrich.profile(df, ["k"]).collect()} == want


def test_pairs_are_found_once_per_line(spark):
    rows = spark.createDataFrame([(1, "The food was great and not cold. They left the rice cold.")], "review_id long, text string")
    found = pairs.aspect_pairs(rows, keep=["review_id"])
    plan = found._jdf.queryExecution().optimizedPlan()
    conf = "spark.sql.debug.maxToStringFields"
    spark.conf.set(conf, 10_000)
    try:
        text = plan.toString()
    finally:
        spark.conf.unset(conf)
    assert text.count("n't|[a-z]+") == 1 and text.count(f"({pairs.ATTRIBUTIVE})") == 1
    assert {(r.aspect_seed, r.aspect_opinion, r.aspect_negated) for r in found.collect()} == {
        ("food", "great", False), ("food", "not cold", True), ("rice", "cold", False),
    }


def test_top_words_of_any_length(spark, tmp_path):
    docs = spark.createDataFrame([(1, "ox ox OX cat. q", "en"), (2, None, "en")], "doc_id long, text string, lang string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    from plaudit.plans.catalog import QUERIES

    assert list(map(tuple, QUERIES["top_words"](spark, str(tmp_path)).collect())) == [("ox", 3), ("cat", 1), ("q", 1)]


def test_pairs_of_single_reviews_are_not_shuffled(spark):
    schema = "review_id long, user_id long, text string"
    texts = ["The food was great. We went.  The food was great ! The fish was dry.", "The food was great. The tea was hot.", None]
    once = spark.createDataFrame([(1, 1, texts[0]), (1, 2, texts[1]), (None, 2, texts[1]), (2, None, texts[2])], schema)
    twice = once.union(spark.createDataFrame([(1, 1, texts[1]), (1, 1, texts[0]), (None, 2, texts[0])], schema))
    assert "Aggregate" not in jobs.extract(once)._jdf.queryExecution().optimizedPlan().toString()
    first = {("food", "great"), ("fish", "dry")}
    second = {("food", "great"), ("tea", "hot")}
    want = {(1, 1): first, (1, 2): second, (None, 2): second}
    for rows, expected in ((once, want), (twice, {**want, (1, 1): first | second, (None, 2): first | second})):
        got = [(r.review_id, r.user_id, r.aspect_seed, r.aspect_opinion) for r in jobs.extract(rows).collect()]
        assert sorted(got, key=str) == sorted(((*k, *p) for k, v in expected.items() for p in v), key=str)


def test_lexicon_lower_cases_a_text_once(spark):
    rows = spark.createDataFrame([("The FOOD was great. Staff's rude! We ate",), ("",), (None,)], "text string")
    scored = lexicon.score_reviews(rows, with_terms=False)
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    got = [(r.aspect_food, r.aspect_service) for r in scored.collect()]
    assert got[0] == pytest.approx((1, -1), abs=1e-5) and got[1:] == [(0.0, 0.0)] * 2


def test_words_of_the_keyword_scorer():
    texts = ["Great PIZZA,rice2go; food_cake", "Die Pizza é café coffeeé ½food² fish", "", "K tea\x1dbread"]
    for text, found in zip(texts, (["pizza", "rice", "food", "cake"], ["pizza", "food", "fish"], [], ["tea", "bread"])):
        assert terms.keyword_scorer([text])[0]["aspect"] == found


def test_pairs_are_read_in_batches(spark, monkeypatch):
    review = "The fries were hot and tasted great. We had cozy pizza!  The fries were hot and tasted great ? They left the rice cold"
    rows = spark.createDataFrame([(1, review), (2, None), (3, ""), (4, "İs the food GOOD? no verb between them")], "id long, text string")
    found = pairs.aspect_pairs(rows, keep=["id"], once=True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "lambda" not in plan
    want = {
        (1, "The fries were hot and tasted great", "fries", "hot", False), (1, "The fries were hot and tasted great", "fries", "great", False),
        (1, "We had cozy pizza", "cozy pizza", "cozy", False), (1, "They left the rice cold", "rice", "cold", False),
    }
    got = list(map(tuple, found.collect()))
    assert sorted(got) == sorted(want)
    assert pairs.aspect_pairs(rows, keep=["id"]).count() == len(want) + 2
    reader = pairs._Reader((pairs.WORDS, pairs.ATTRIBUTIVE, pairs.PREDICATIVE, pairs.CAUSATIVE), vocab.NOUNS, vocab.ADJECTIVES, False)
    assert [len(s) for s in pairs._slices(["a" * pairs.SLICE, "b", "c", "d" * (pairs.SLICE - 2), "", "e" * 3 * pairs.SLICE])] == [1, 4, 1]
    reader.read([review, "", "The food was great"], found := pairs._Found())
    assert found.per_text == [4, 0, 1] and found.per_sentence == [2, 1, 2, 1, 1]


def test_scores_leave_out_what_counts_for_nothing_before_the_shuffle(spark):
    rows = spark.createDataFrame(
        [(1, "a", "food", "positive"), (1, "a", "food", "neutral"), (1, "a", None, "mixed"), (1, "b", "food", None), (2, "b", None, "negative")],
        "review_id long, sentence string, aspect string, sentiment string",
    )
    scored = sentiment.review_aspect_scores(rows)
    got = sorted(map(tuple, scored.collect()))
    assert got == [(1, "a", "food", 1, 0, 1.0), (2, "b", None, 0, 1, 0.0)]
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "IN (positive,negative)" in plan[plan.index("Aggregate") :]


def test_users_under_a_key_of_users_are_counted_without_a_second_shuffle(spark):
    rows = spark.createDataFrame(
        [(1, 7, "a", 0.5, 1, 0), (1, 7, "a", 0.25, 1, 0), (1, None, "a", 1.0, 2, 0)],
        "review_id long, user_id long, aspect string, positive_aspect_ratio double, positive_aspect_count long, negative_aspect_count long",
    ).withColumn("w_user", F.lit(1.0))
    per_user = vectors._weighted_measures(rows, ["review_id", "user_id", "aspect"])
    assert per_user._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted((r.user_id or 0, r.review_count, r.user_account) for r in per_user.collect()) == [(0, 1, 0), (7, 2, 1)]
    assert [r.user_account for r in vectors._weighted_measures(rows, ["aspect"]).collect()] == [1]


def test_distinct_opinions_are_stemmed_and_labelled(spark, sf):
    from plaudit.plans import catalog

    plan = catalog.lexicon_table(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [aspect_opinion" in plan[plan.index("Generate explode") :]
    few = catalog._labelled_distinct(spark, sf)
    assert few.count() == few.select("aspect_seed", "aspect_opinion").distinct().count() < catalog._labelled(spark, sf).count()


def test_mapped_terms_get_their_lexical_label_before_the_join(spark):
    rows = spark.createDataFrame([(1, " Pizza "), (2, "pizza"), (3, "piano"), (4, "anvil"), (5, "Soup"), (6, None)], "id long, aspect_seed string")
    known = spark.createDataFrame([("pizza", "service"), ("piano", None), ("anvil", None)], "term string, label string")
    labelled = mapping.apply_mapping(rows, known)
    want = [(1, "service"), (2, "service"), (3, "ambience"), (4, None), (5, "food"), (6, None)]
    assert sorted((r.id, r.aspect) for r in labelled.collect()) == want and labelled.columns == ["id", "aspect_seed", "aspect"]
    plan = labelled._jdf.queryExecution().optimizedPlan().toString()
    assert "lower(term" in plan[plan.index("Join LeftOuter") :]
