"""Vocabularies.

Small fixed sets are plain lists.  The two large ones, aspect prototypes and the polarity
lexicon, are parameters: jobs take them as mappings, ``read_vocabulary`` loads them from a table,
and the defaults below are short starter sets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

Vocabulary = Mapping[str, Sequence[str]]

# --- Fixed values: sentence-level lexicon scoring -------------------------------------------
LEXICON_ASPECTS: dict[str, list[str]] = {
    "food": (
        "food pizza burger taco sushi noodle pasta steak salad sandwich fries bread sauce soup "
        "dessert cake coffee tea pho ramen bbq seafood chicken beef pork lamb fish roll rice taste "
        "flavor fresh portion"
    ).split(),
    "service": (
        "service staff waiter waitress server host hostess manager attentive rude friendly slow "
        "fast cleanliness attitude line queue mistake order tip bartender"
    ).split(),
    "price": (
        "price priced expensive cheap value deal cost pricy affordable overpriced budget worth "
        "portion tip fees upcharge charges"
    ).split(),
    "amb": (
        "ambience atmosphere noise noisy quiet music decor crowded clean dirty lighting vibe cozy "
        "romantic view seat seating smell odour odor space"
    ).split(),
}
LEXICON_POSITIVE = (
    "amazing great good tasty delicious fresh excellent perfect friendly quick nice clean cozy "
    "quiet affordable worth fast attentive kind helpful love loved"
).split()
LEXICON_NEGATIVE = (
    "bad terrible awful cold stale bland rude slow dirty noisy loud overpriced expensive worst hate "
    "hated disgusting gross unfriendly dry burnt burned"
).split()
RATIO_EPSILON = 1e-6
TERMS_PER_SENTENCE = 5  # limits that callers may pass on
TERMS_PER_REVIEW = 10

# --- Fixed values: bucketing of extracted terms, exact variant ------------------------------
BUCKETS_EXACT: dict[str, list[str]] = {
    "food": (
        "food pizza burger taco sushi noodle pho ramen steak salad pasta sandwich fries rice sauce "
        "salsa dessert cake bread coffee tea beer wine fish chicken beef pork tofu veggie vegan "
        "vegetarian"
    ).split(),
    "service": (
        "service waiter server waitress host hostess manager staff rude friendly attentive slow "
        "fast polite ignore"
    ).split(),
    "price": (
        "price priced expensive cheap affordable value worth overpriced deal cost costly pricing"
    ).split(),
    "amb": (
        "ambience ambiance atmosphere vibe music decor noise noisy quiet patio outdoor view seating "
        "crowded romantic cozy clean dirty"
    ).split(),
}

# --- Fixed values: bucketing of extracted terms, heuristic variant --------------------------
BUCKETS_LOOSE: dict[str, list[str]] = {
    "food": (
        "food pizza burger sushi taco noodle pasta steak salad dish menu taste flavor portion "
        "dessert sandwich sauce fries meal breakfast lunch dinner"
    ).split(),
    "service": (
        "staff server waiter waitress service manager host hostess attentive rude friendly slow "
        "quick bartender"
    ).split(),
    "price": "price expensive cheap cost pricy value deal worth overpriced reasonable".split(),
    "amb": (
        "ambience ambiance noise noisy quiet vibe atmosphere music crowded decor seating clean dirty"
    ).split(),
}
BUCKET_FRAGMENTS: dict[str, list[str]] = {
    "food": ["taste", "cook", "flavor"],
    "service": ["wait", "serve"],
    "price": ["price", "cost", "value"],
    "amb": ["noise", "ambien", "vibe", "atmos", "decor", "music"],
}

# --- Fixed values: word classes of pair extraction ------------------------------------------
NEGATIONS = ["no", "not", "n't", "never", "hardly", "barely", "scarcely", "nothing"]
INTENSIFIERS = (
    "very so too extremely really quite super pretty fairly highly slightly somewhat kinda sorta"
).split()

# --- Fixed values: filters and thresholds ---------------------------------------------------
DOMAIN_REGEX = "(?i)Restaurant|Food|Cafe|Bar|Bakery|Coffee"
SIMILARITY_FLOOR = 0.04
GRAM_SIZES = (3, 5)

# --- Fixed values: Spark's English stop-word list -------------------------------------------
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split()

# --- Starter vocabularies (own choice; replace them with tables of your own) -----------------
LINKING_VERBS = (
    "is are was were be been look looks looked taste tastes tasted feel feels felt seem seems seemed smell smells smelled"
).split()
# Words between a conjunction and the verb it adds, as in "and did not taste".
AUXILIARIES = "did do does has have had also still even always then would could can will".split()
CAUSATIVE_VERBS = "make makes made find finds found leave leaves left keep keeps kept".split()
DETERMINERS = "the a an my our your their his her its this that these those".split()
RELATIVES = "that which who".split()
PREPOSITIONS = "of for at in on".split()
NOUNS = (
    "food pizza burger pasta taco soup salad bread coffee tea dessert cake sauce rice fish chicken "
    "meal dish menu drink wine beer breakfast lunch dinner fry portion flavor cup service staff "
    "server waiter waitress host manager bartender order delivery price value cost bill deal place "
    "music decor atmosphere ambience vibe noise lighting seating table room patio view experience"
).split()
ADJECTIVES = (
    "great good delicious friendly slow overpriced cozy bland bad fresh tasty cold hot warm rude "
    "quick attentive helpful kind nice excellent perfect amazing awful terrible cheap expensive "
    "reasonable fair clean dirty noisy quiet loud crowded spicy sweet salty soggy dry stale tender "
    "crispy rich small large beautiful romantic comfortable unfriendly poor best worst"
).split()
PROTOTYPES: dict[str, list[str]] = {
    "food": [
        "food", "pizza", "plate", "meal", "soup", "snack", "kitchen", "recipe", "cheese", "tomato", "onion", "egg", "potato",
        "bean", "juice", "olive oil", "main course",
    ],
    "service": [
        "service", "staff", "crew", "clerk", "cashier", "helper", "welcome", "counter", "smile", "greeting", "courtesy",
        "front desk",
    ],
    "ambience": [
        "decor", "music", "wallpaper", "carpet", "ceiling", "fireplace", "chandelier", "fountain", "piano", "skylight",
        "window seat",
    ],
    "price": [
        "price", "value", "money", "dollar", "receipt", "tariff", "invoice", "wallet", "payment", "set menu",
    ],
}
POLARITY: dict[str, dict[str, list[str]]] = {
    "positive": {
        "general": ["good", "great", "sturdy", "handy", "sharp", "polished", "as ordered"],
        "service": ["friendly", "chatty", "obliging", "punctual", "on the dot"],
        "food": ["delicious", "savoury", "succulent", "aromatic", "ripe"],
        "ambience": ["cozy", "sunlit", "leafy", "snug", "hushed"],
        "price": ["economical", "sensible", "modest", "worth every penny"],
    },
    "negative": {
        "general": ["bad", "flimsy", "crooked", "brittle", "dented", "never again"],
        "service": ["slow", "grumpy", "dismissive", "clumsy", "forgetful"],
        "food": ["bland", "watery", "limp", "charred", "curdled"],
        "ambience": ["gloomy", "cramped", "stuffy", "deafening", "shabby"],
        "price": ["overpriced", "exorbitant", "inflated", "daylight robbery"],
    },
}
GENERAL = "general"

POLARITY_SCHEMA = "aspect_to_match STRING, term_to_match STRING, polarity STRING"


def read_vocabulary(df: DataFrame, label: str, term: str) -> dict[str, list[str]]:
    """A (label, term) table as an ordered mapping, for vocabularies that become expressions.

    Prototypes and lexicons of any size stay tables: operators that join them take tables.
    """
    rows = df.select(label, term).collect()
    out: dict[str, list[str]] = {}
    for name, word in rows:
        out.setdefault(name, []).append(word)
    return out


def prototype_table(spark: SparkSession, prototypes: Vocabulary = PROTOTYPES) -> DataFrame:
    rows = [(label, i, word) for i, (label, words) in enumerate(prototypes.items()) for word in words]
    return spark.createDataFrame(rows, "label STRING, label_order INT, term STRING")


def polarity_table(
    spark: SparkSession, polarity: Mapping[str, Vocabulary] = POLARITY, general: str = GENERAL
) -> DataFrame:
    """The lexicon with its general terms repeated under a null aspect, which matches any aspect."""
    rows = [
        (aspect.lower(), term.lower(), sign)
        for sign, groups in polarity.items()
        for aspect, terms in groups.items()
        for term in terms
    ]
    own = spark.createDataFrame(rows, POLARITY_SCHEMA)
    anywhere = spark.createDataFrame(
        [(None, term, sign) for aspect, term, sign in rows if aspect == general], POLARITY_SCHEMA
    )
    return own.unionByName(anywhere)
