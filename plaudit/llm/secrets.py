"""Secret scans with built-in functions only.

Three fixed patterns give the base spans.  Besides them, two character Markov models of order one
are trained, one on labelled random strings and one on labelled ordinary identifiers; a candidate
token is a span of kind ``markov``, unless it overlaps a base span, if any stretch of it, of at
least ``shortest`` characters, has a mean log-likelihood ratio per step above ``margin``: so a
secret joined to a path, a key or a name counts.  The span is the whole token.

The labels come from the documents themselves: values caught by the base patterns are random
strings, all other runs of ``NAME`` characters are ordinary.  Training reads about
``sample_docs`` documents, chosen by a hash of their text; scanning reads every whole text.

Contract: null text is empty and has no spans.  Offsets count code points.  Repeated rows are
scanned each alone.  Without labelled samples both models are uniform and find nothing.
``redact`` keeps all columns and replaces every span; ``scan`` returns doc_id and its columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaudit.functions.bind import let

ASSIGN = (
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"""
    r"""|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
# A run shorter than the limit holds no later match, so the limit may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
NAME = r"[A-Za-z0-9+/_=-]"
KINDS = ("assign", "access", "hex", "markov")
SIZE = len(ALPHABET)
BLOCK = 64
NAMED = 32
#: A word, year, month, day, a number.
FORMS = (
    "%1$s_%2$04d-%3$02d-%4$02d_%1$s", "%1$s_%2$04d%3$02d%4$02dT%3$02d%4$02d%3$02d_%1$s", "%2$04d/%3$02d/%4$02d/%1$s",
    "%1$s-v%3$d-%4$d-%3$d", "%1$s%4$d_%1$s_%5$04d", "%1$s_%5$08d_%1$s", "%1$s-%2$04d%3$02d%4$02d-%1$s",
)


@dataclass(frozen=True)
class Markov:
    sample_docs: int = 10_000
    smoothing: float = 0.5
    margin: float = 0.7
    shortest: int = 16


# For redaction: the same keywords, the value alone replaced.
ASSIGNED = "(" + ASSIGN.replace(r"([A-Za-z0-9+/_.=-]+)", r")[A-Za-z0-9+/_.=-]{8,}")


def _sum(part: Column) -> Column:
    return F.aggregate(part, F.lit(0), lambda s, x: s + x)


def _with_offsets(df: DataFrame, name: str, lengths: Column) -> DataFrame:
    """Adds array ``name``: for each element the sum of all earlier ones (null stays null).

    Sums go by blocks, so the work stays near the number of elements.  Each step is a column of
    its own: an expression inside a lambda would be evaluated again for every element.
    """
    each, blocks, before = f"{name}_n", f"{name}_b", f"{name}_o"
    block = lambda i: F.floor(i / BLOCK).cast("int")
    return (
        df.withColumn(each, lengths)
        .withColumn(
            blocks,
            F.transform(
                F.sequence(F.lit(0), block(F.size(each) - 1)),
                lambda b: _sum(F.slice(each, b * BLOCK + 1, BLOCK)),
            ),
        )
        .withColumn(
            before,
            F.transform(
                F.sequence(F.lit(0), F.size(blocks) - 1),
                lambda b: _sum(F.slice(blocks, F.lit(1), b)),
            ),
        )
        .withColumn(
            name,
            F.transform(
                F.sequence(F.lit(0), F.size(each) - 1),
                lambda i: F.col(before)[block(i)]
                + _sum(F.slice(each, block(i) * BLOCK + 1, F.pmod(i, F.lit(BLOCK)))),
            ),
        )
        .drop(each, blocks, before)
    )


def with_matches(df: DataFrame, name: str, pattern: str, text: str) -> DataFrame:
    """Adds array ``name`` of (s, e, m): the leftmost matches, in code points, and their text.

    The pieces between the matches and the matches alternate; their lengths add up to offsets.
    """
    pieces, found, at = f"__{name}_p", f"__{name}_m", f"__{name}_l"
    hit = F.col(text).rlike(pattern)
    nothing = F.array().cast("array<struct<s:int,e:int,m:string>>")
    cut = df.withColumn(
        found, F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    ).withColumn(pieces, F.when(F.col(found).isNotNull(), F.split(text, pattern, -1)))
    both = F.zip_with(pieces, found, lambda p, m: F.length(p) + F.coalesce(F.length(m), F.lit(0)))
    return (
        _with_offsets(cut, at, F.when(F.col(found).isNotNull(), both))
        .withColumn(
            name,
            F.when(
                F.col(found).isNotNull(),
                F.transform(
                    found,
                    lambda m, i: F.struct(
                        (F.col(at)[i] + F.length(F.col(pieces)[i])).alias("s"),
                        (F.col(at)[i] + F.length(F.col(pieces)[i]) + F.length(m)).alias("e"),
                        m.alias("m"),
                    ),
                ),
            ).otherwise(nothing),
        )
        .drop(found, pieces, at)
    )


def with_base(df: DataFrame, text: str) -> DataFrame:
    """Adds the arrays __assign, __access and __hex."""
    out = with_matches(df, "__assign", ASSIGN, text)
    out = out.withColumn(
        "__assign", F.filter("__assign", lambda x: F.length(_value(x["m"])) >= 8)
    )
    return with_matches(with_matches(out, "__access", ACCESS, text), "__hex", HEX, text)


def _value(match: Column) -> Column:
    return F.regexp_extract(match, ASSIGN, 2)


def labelled(docs: DataFrame, markov: Markov) -> DataFrame:
    """(sample, random): distinct strings, random ones as the base patterns catch them.

    Prose has few digits, so every ordinary string of up to ``NAMED`` characters also comes once
    with a date, a version or a number, as files and fields are named.
    """
    total = docs.count()
    part = min(1.0, markov.sample_docs / max(total, 1))
    some = docs.select(F.coalesce("text", F.lit("")).alias("t")).where(
        F.pmod(F.xxhash64("t"), F.lit(1 << 20)) < int(part * (1 << 20))
    )
    base = with_base(some, "t")
    values = F.concat(
        F.transform("__assign", lambda x: _value(x["m"])),
        F.transform("__access", lambda x: x["m"]),
        F.transform("__hex", lambda x: x["m"]),
    )
    caught = base.select(F.explode(values).alias("sample")).distinct().withColumn("random", F.lit(True))
    names = F.regexp_extract_all("t", F.lit(NAME + "{4,}"), F.lit(0))
    plain = some.select(F.explode(names).alias("sample")).distinct().join(caught, "sample", "left_anti")
    # A value may stand inside a longer run of the same characters, such as token=abc.
    plain = plain.where(~F.col("sample").rlike(f"{ACCESS}|{HEX}") & ~F.col("sample").contains("="))
    plain = plain.unionByName(plain.where(F.length("sample") <= NAMED).select(_numbered(F.col("sample")).alias("sample")))
    return caught.unionByName(plain.withColumn("random", F.lit(False)))


def _numbered(name: Column) -> Column:
    """The name with numbers in it; the form goes by hash."""
    draw = lambda i, n: F.pmod(F.xxhash64(name, F.lit(i)), F.lit(n)).cast("int")
    form = F.array(*map(F.lit, FORMS))[draw(0, len(FORMS))]
    date = [1990 + draw(1, 45), 1 + draw(2, 12), 1 + draw(3, 28)]
    return F.call_function("format_string", form, name, *date, draw(4, 100_000_000))


def _steps(token: Column) -> Column:
    """Index of every step from one character to the next in the SIZE x SIZE table."""
    at = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1))) - 1
    return F.transform(
        F.sequence(F.lit(1), F.length(token) - 1), lambda i: at(i) * SIZE + at(i + 1)
    )


def train(samples: DataFrame, markov: Markov = Markov()) -> list[float]:
    """Log-likelihood ratio (random over ordinary) of every step, SIZE * SIZE numbers.

    ``samples``: (sample, random), of characters of ALPHABET.  Counted per step before the
    shuffle; what comes back is one row of fixed length.
    """
    fit = samples.where(F.col("sample").rlike(f"^{NAME}{{2,}}$") & F.col("random").isNotNull())
    steps = fit.select("random", F.explode(_steps(F.col("sample"))).alias("step")).groupBy("step").agg(
        F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("o")
    )
    table = samples.sparkSession.range(SIZE * SIZE).withColumnRenamed("id", "step").join(steps, "step", "left")
    cells = F.array_sort(F.collect_list(F.struct("step", F.coalesce("r", F.lit(0)), F.coalesce("o", F.lit(0)))))
    counted = table.agg(cells.alias("c")).first()[0]
    random, ordinary = (_conditional([c[i] for c in counted], markov.smoothing) for i in (1, 2))
    return [log(x) - log(y) for x, y in zip(random, ordinary)]


def _conditional(counts: list[int], smoothing: float) -> list[float]:
    """Probability of each step given its first character; characters that were seldom followed
    by anything fall back on how often each character occurs as a second one."""
    seconds = [sum(counts[i::SIZE]) + smoothing for i in range(SIZE)]
    total = sum(seconds)
    out = []
    for start in range(0, len(counts), SIZE):
        row = counts[start : start + SIZE]
        weight = smoothing * SIZE
        out += [(n + weight * s / total) / (sum(row) + weight) for n, s in zip(row, seconds)]
    return out


def looks_random(token: Column, model: list[float], margin: float, shortest: int) -> Column:
    """Some stretch of at least ``shortest`` characters has a letter in it and a mean log-likelihood
    ratio per step above ``margin``.

    ``token``: at least ``shortest`` characters of ALPHABET.  One pass keeps, of the stretches that
    end at a step, the last ``m`` steps and the best sums of at least ``m``, with any characters and
    with a letter; what each step adds is its ratio less the margin.
    """
    # One literal that is folded to an array once; an expression for each number would fill the driver.
    table = F.split(F.lit(",".join(repr(x - margin) for x in model)), ",").cast("array<double>")
    m, low, none = max(shortest - 1, 1), F.lit(float("-inf")), F.lit(-1)
    letter = lambda at: at < 52
    start = F.struct(
        F.lit(0.0).alias("last"), low.alias("any"), low.alias("lettered"), low.alias("top"), none.alias("at")
    )

    def holds(steps: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            adds = table[steps[i]]
            last = s["last"] + adds - F.when(i >= m, table[steps[i - m]]).otherwise(0.0)
            window = F.when(i >= m - 1, last).otherwise(low)
            now = letter(F.pmod(steps[i], F.lit(SIZE)))
            at = F.when(now, i + 1).when(letter(F.floor(steps[i] / SIZE)), i).otherwise(s["at"])
            longer = F.when(now, s["any"]).otherwise(s["lettered"]) + adds
            lettered = F.greatest(F.when(at > i - m, window).otherwise(low), longer)
            return F.struct(
                last.alias("last"), F.greatest(window, s["any"] + adds).alias("any"), lettered.alias("lettered"),
                F.greatest(s["top"], lettered).alias("top"), at.alias("at"),
            )

        found = F.aggregate(F.sequence(F.lit(0), F.size(steps) - 1), start, step)
        return found["top"] > 0

    return let(_steps(token), holds)


def with_spans(df: DataFrame, model: list[float], markov: Markov, text: str) -> DataFrame:
    """Adds __assign, __access, __hex and __markov, arrays of (s, e, m)."""
    out = with_base(df, text)
    out = with_matches(out, "__markov", f"{NAME}{{{markov.shortest},}}", text)
    out = out.withColumn("__base", F.concat("__assign", "__access", "__hex"))

    def random(x: Column) -> Column:
        free = ~F.exists("__base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
        return free & looks_random(x["m"], model, markov.margin, markov.shortest)

    return out.withColumn("__markov", F.filter("__markov", random)).drop("__base")


def _listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, by start and then by kind, joined by commas."""
    def ordered(name: str, place: int) -> Column:
        return F.transform(
            name, lambda x: F.struct(x["s"].alias("s"), F.lit(place).alias("k"), x["e"].alias("e"))
        )

    parts = [ordered(f"__{k}", i) for i, k in enumerate(KINDS) if k in kinds]
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            F.array_sort(F.concat(*parts)),
            lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string")),
        ),
        ",",
    )


def scan(docs: DataFrame, markov: Markov = Markov(), model: list[float] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans."""
    model = model or train(labelled(docs, markov), markov)
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text"))
    found = with_spans(text, model, markov, "__text")
    return found.select(
        "doc_id",
        *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(KINDS[:3]), 256).alias("base_sha256"),
        _listed(KINDS).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", markov: Markov = Markov(), model: list[float] | None = None) -> DataFrame:
    """The documents with every secret in ``text`` replaced by ``mark``; null stays null.

    Of an assignment the value goes and the keyword stays.  ``n_chars`` is left as it was.
    """
    model = model or train(labelled(docs, markov), markov)
    plain = F.col("text")
    for pattern, put in ((ASSIGNED, "$1" + mark), (ACCESS, mark), (HEX, mark)):
        plain = F.regexp_replace(plain, pattern, put)
    token = f"{NAME}{{{markov.shortest},}}"
    # The columns of the documents wait in one struct, whatever their names.
    out = (
        docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), plain.alias("text"))
        .withColumn("found", F.regexp_extract_all("text", F.lit(token), F.lit(0)))
        .withColumn("pieces", F.when(F.size("found") > 0, F.split("text", token, -1)))
    )
    shown = F.zip_with(
        "pieces",
        F.transform(
            "found", lambda m: F.when(looks_random(m, model, markov.margin, markov.shortest), F.lit(mark)).otherwise(m)
        ),
        lambda p, m: F.concat(p, F.coalesce(m, F.lit(""))),
    )
    rebuilt = F.when(F.col("pieces").isNotNull(), F.array_join(shown, "")).otherwise(F.col("text"))
    return out.select(
        *[rebuilt.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    )
