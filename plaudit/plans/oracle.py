"""DuckDB SQL for the named queries.

Written independently of the DataFrame plans: where those use arrays inside a row, the SQL
unnests and joins.  ``_CTES`` holds named building blocks; ``_sql`` puts the ones a query mentions
in front of it.
"""

from __future__ import annotations

import re

from ..functions import vocab
from .catalog import ADJECTIVES, CENTRES, DOMAIN, EXTRACTED, LANGS, NOUNS, SLIDERS

ASPECTS = ("food", "service", "price", "amb")


def _r(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0)"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words) -> str:
    return ", ".join(_lit(w) for w in words)


def _arr(words) -> str:
    return f"[{_list(words)}]"


def _case8(words: list[str], k: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words[:7]))
    return f"CASE ({k}) % 8 {whens} ELSE '{words[7]}' END"


_ADJ = "great delicious friendly slow overpriced cozy bland good".split()
_NOUN = "food pizza service staff price value music decor".split()

_ENDING = [
    "", " They left the rice cold.", " A host who was so kind and quick.", " The cup of tea was hot and tasted sweet.",
    " Bread and fish were dry but did not taste very bad.", " Really nice waiters, small portions, stale fries.",
    " The clean rooms of the place are quiet and not noisy.", " They make great desserts and keep the tables dirty.",
]

_CTES: dict[str, str] = {}

_CTES["ratings"] = """
SELECT concat(l_orderkey,'-',l_linenumber,'-',l_partkey,'-',l_suppkey) AS review_id,
       l_suppkey AS user_id, l_partkey AS business_id,
       CAST(1 + floor((l_quantity - 1) / 10) AS DOUBLE) AS stars, l_shipdate AS review_ts,
       CAST(year(l_shipdate) AS BIGINT) AS review_year,
       CAST(month(l_shipdate) AS BIGINT) AS review_month
FROM lineitem"""

_CTES["reviews"] = f"""
SELECT row_number() OVER () AS rid,
       concat(l_orderkey,'-',l_linenumber,'-',l_partkey,'-',l_suppkey) AS review_id,
       l_suppkey AS user_id, l_partkey AS business_id,
       CAST(1 + floor((l_quantity - 1) / 10) AS DOUBLE) AS stars, l_shipdate AS review_ts,
       concat('The ', {_case8(_NOUN, 'l_partkey')}, ' was ',
              CASE WHEN l_returnflag = 'R' THEN 'not ' ELSE '' END,
              CASE WHEN l_linestatus = 'O' THEN 'very ' ELSE '' END,
              {_case8(_ADJ, 'l_linenumber + l_suppkey')}, '. We had ',
              {_case8(_ADJ, 'l_orderkey')}, ' ', {_case8(_NOUN, 'l_orderkey + l_linenumber')},
              '! Also the ', split_part(p_name, ' ', 2), ' is ', split_part(p_name, ' ', 1), '.',
              {_case8(_ENDING, 'l_orderkey + l_suppkey')}) AS text
FROM lineitem JOIN part ON l_partkey = p_partkey"""

_CTES["business"] = """
SELECT p_partkey AS business_id, p_name AS name, p_brand AS city, p_type AS state,
       concat(p_name, ', ', p_type) AS categories,
       CAST(p_size % 9 AS DOUBLE) / 2 + 1 AS stars, CAST(p_size AS BIGINT) AS review_count
FROM part"""

_CTES["users"] = """
SELECT user_id, count(*) AS review_count, avg(stars) AS average_stars FROM ratings GROUP BY user_id"""

# --- credibility ------------------------------------------------------------------------------

_CTES["user_weights"] = """
SELECT user_id, coalesce(var_pop(stars), 0) AS v, count(*) AS n,
       1 / (1 + coalesce(var_pop(stars), 0)) AS w
FROM ratings GROUP BY user_id"""

_CTES["monthly"] = """
SELECT user_id, review_year AS year, review_month AS month, count(*) AS n_reviews,
       coalesce(var_pop(stars), 0) AS var_stars, 1 / (1 + coalesce(var_pop(stars), 0)) AS w_user
FROM ratings GROUP BY ALL"""

_CTES["month_totals"] = """
SELECT year, month, avg(w_user) AS avg_w_user, avg(var_stars) AS avg_var_stars,
       CAST(sum(n_reviews) AS BIGINT) AS total_reviews
FROM monthly GROUP BY year, month"""

# --- lexicon scoring --------------------------------------------------------------------------

_CTES["lex_sentences"] = """
SELECT rid, review_id, i, regexp_extract_all(pieces[i], '[a-zA-Z'']+') AS toks
FROM (SELECT rid, review_id, string_split_regex(lower(text), '[.!?]+') AS pieces FROM reviews) p,
     unnest(generate_series(1, len(pieces))) AS g(i)"""

_CTES["lex_facts"] = "SELECT rid, review_id, i, " + ", ".join(
    f"list_has_any(toks, {_arr(vocab.LEXICON_ASPECTS[a])}) AS has_{a}" for a in ASPECTS
) + f""",
    list_filter(toks, lambda w: list_contains({_arr(vocab.LEXICON_POSITIVE)}, w)) AS pos,
    list_filter(toks, lambda w: list_contains({_arr(vocab.LEXICON_NEGATIVE)}, w)) AS neg
FROM lex_sentences"""

_CTES["lex_counts"] = "SELECT rid, review_id, " + ", ".join(
    f"coalesce(sum(len(pos)) FILTER (has_{a}), 0) AS p_{a}, "
    f"coalesce(sum(len(neg)) FILTER (has_{a}), 0) AS n_{a}"
    for a in ASPECTS
) + " FROM lex_facts GROUP BY rid, review_id"

_CTES["lex_scores"] = "SELECT rid, review_id, " + ", ".join(
    f"CASE WHEN p_{a} + n_{a} = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(p_{a} - n_{a} AS DOUBLE) / "
    f"(CAST(p_{a} + n_{a} AS DOUBLE) + CAST(1e-6 AS DOUBLE)) END AS aspect_{a}"
    for a in ASPECTS
) + " FROM lex_counts"

_CTES["vecs"] = "SELECT business_id, count(*) AS n_reviews_sample, count(DISTINCT r.user_id) AS n_users_sample, " + ", ".join(
    f"sum(w * aspect_{a}) / sum(w) AS {a}" for a in ASPECTS
) + ", " + ", ".join(
    f"avg(CASE WHEN aspect_{a} <> 0 THEN 1.0 ELSE 0.0 END) AS cover_{a}_frac" for a in ASPECTS
) + """
FROM reviews r JOIN lex_scores USING (rid) JOIN user_weights u ON u.user_id = r.user_id
GROUP BY business_id HAVING count(*) >= 10"""

_CTES["vecs_z"] = "SELECT business_id, " + ", ".join(
    f"({a} - avg({a}) OVER ()) / nullif(stddev_samp({a}) OVER (), 0) AS {a}_z" for a in ASPECTS
) + " FROM vecs"

_CTES["centres"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, " + ", ".join(f"CAST({v} AS DOUBLE)" for v in c) + ")" for i, c in enumerate(CENTRES)
) + ") t(cluster, cf, cs, cp, ca)"

_CTES["labelled_vecs"] = """
SELECT v.*, (SELECT arg_min(cluster, [(food-cf)**2 + (service-cs)**2 + (price-cp)**2 + (amb-ca)**2, cluster])
             FROM centres) AS cluster
FROM vecs v"""

_CTES["described"] = """
SELECT l.*, b.name, b.city, b.state, b.categories, b.stars, b.review_count
FROM labelled_vecs l LEFT JOIN business b USING (business_id)"""

_CTES["centroids"] = """
SELECT cluster, avg(food_z) AS mf, avg(service_z) AS ms, avg(price_z) AS mp, avg(amb_z) AS ma
FROM labelled_vecs JOIN vecs_z USING (business_id) GROUP BY cluster"""

# k-means: seeds and rounds as recursions over the list of centres; silhouette from all pairs.
_CTES["zpoints"] = "SELECT business_id, [food_z, service_z, price_z, amb_z] AS x FROM vecs_z"
_KM_D = "list_sum(list_transform(range(1, 5), lambda j: (x[j] - {c}[j]) ** 2))"
_CTES["km_seeds"] = f"""
SELECT 1 AS n, [(SELECT arg_min(x, [{_KM_D.format(c='[0, 0, 0, 0]')}, business_id]) FROM zpoints)] AS cs
UNION ALL
SELECT n + 1, list_append(cs, (
  SELECT arg_min(x, [-list_min(list_transform(cs, lambda c: {_KM_D.format(c='c')})), business_id]) FROM zpoints))
FROM km_seeds WHERE n < 6"""
_CTES["km_steps"] = f"""
SELECT 0 AS n, cs, CAST(1 AS DOUBLE) AS step FROM km_seeds WHERE n = 6
UNION ALL
SELECT n + 1, moved, (SELECT max(list_sum(list_transform(range(1, 5), lambda j: (moved[i][j] - cs[i][j]) ** 2))) FROM range(1, 7) r(i))
FROM (SELECT n, step, cs, (
    SELECT list(m ORDER BY k) FROM (
      SELECT list_position(ds, list_min(ds)) AS k, [avg(x[1]), avg(x[2]), avg(x[3]), avg(x[4])] AS m
      FROM (SELECT x, list_transform(cs, lambda c: {_KM_D.format(c='c')}) AS ds FROM zpoints) GROUP BY 1)) AS moved
  FROM km_steps WHERE step > 1e-8 AND n < 50)"""
_CTES["km_labels"] = f"""
SELECT business_id, x, list_position(ds, list_min(ds)) - 1 AS cluster FROM (
  SELECT business_id, x, list_transform(cs, lambda c: {_KM_D.format(c='c')}) AS ds
  FROM zpoints, (SELECT arg_max(cs, n) AS cs FROM km_steps))"""
_CTES["km_pairs"] = f"""
SELECT a.business_id, a.cluster, b.cluster AS other, sum({_KM_D.format(c='b.x').replace('(x[', '(a.x[')}) AS total, count(*) AS n
FROM km_labels a JOIN km_labels b ON a.business_id <> b.business_id GROUP BY ALL"""
_CTES["km_silhouettes"] = """
SELECT cluster, CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM (
  SELECT business_id, cluster, max(total / n) FILTER (other = cluster) AS a, min(total / n) FILTER (other <> cluster) AS b
  FROM km_pairs GROUP BY ALL)"""

_S = [f"CAST({s} AS DOUBLE)" for s in SLIDERS]
_CTES["moved"] = f"""
SELECT business_id, l.cluster, (SELECT arg_min(c.cluster, [
         ({_S[0]}*(food_z-mf))**2 + ({_S[1]}*(service_z-ms))**2 + ({_S[2]}*(price_z-mp))**2 + ({_S[3]}*(amb_z-ma))**2,
         c.cluster]) FROM centroids c) AS cluster_weighted
FROM labelled_vecs l JOIN vecs_z USING (business_id)"""

# --- pairs ------------------------------------------------------------------------------------

_CLASSES = [
    ("X", vocab.NEGATIONS), ("I", vocab.INTENSIFIERS), ("B", vocab.LINKING_VERBS),
    ("M", vocab.CAUSATIVE_VERBS), ("R", vocab.RELATIVES), ("D", vocab.DETERMINERS),
    ("C", ["and"]), ("P", vocab.PREPOSITIONS), ("J", ADJECTIVES),
]
_CTES["sents"] = r"""
SELECT review_id, user_id, business_id, stars, review_ts, i,
       regexp_replace(pieces[i], '^\s+|\s+$', '', 'g') AS sentence
FROM (SELECT *, string_split_regex(text, '[.!?]+') AS pieces FROM reviews) p,
     unnest(generate_series(1, len(pieces))) AS g(i)
WHERE length(regexp_replace(pieces[i], '^\s+|\s+$', '', 'g')) > 0"""

_CTES["lines"] = f"""
SELECT *, array_to_string(list_transform(
    regexp_extract_all(regexp_replace(regexp_replace(lower(sentence), '[‘’]', '''', 'g'), 'n''t', ' n''t', 'g'),
                       'n''t|[a-z]+(?:-[a-z]+)*'),
    lambda w: CASE {" ".join(f"WHEN w IN ({_list(m)}) THEN '{c}'" for c, m in _CLASSES)}
      WHEN w IN ({_list(NOUNS)}) OR regexp_replace(regexp_replace(w, 'ies$', 'y'), 's$', '') IN ({_list(NOUNS)})
      THEN 'N' ELSE 'O' END || ':' || w || ' '), '') AS line
FROM sents"""

# The grammar once more, as plain regular expressions over the items of a line.
_OPINION = "(?:X:[^ ]+ )?(?:I:[^ ]+ )*J:[^ ]+ "
_SAID = f"{_OPINION}(?:(?:C:[^ ]+ )?{_OPINION})*"
_THING = "(?:N:[^ ]+ )+"
_OF = f"(?:P:[^ ]+ (?:D:[^ ]+ )?(?:J:[^ ]+ )*{_THING})?"
_ASPECT = f"(?:J:[^ ]+ )*{_THING}{_OF}"
_ATTRIBUTIVE = f"({_SAID})({_THING}{_OF})"
_PREDICATIVE = f"({_ASPECT}(?:C:[^ ]+ (?:D:[^ ]+ )?{_ASPECT})*)(?:R:[^ ]+ )?B:[^ ]+ ({_SAID})"
_CAUSATIVE = f"M:[^ ]+ (?:D:[^ ]+ )?({_ASPECT})({_SAID})"

_META = "review_id, user_id, business_id, stars, review_ts, i, sentence"


def _matches(pattern: str, attributive: bool) -> str:
    p = _lit(pattern)
    spans = (
        "[one || two]" if attributive else f"regexp_extract_all(one, {_lit(_ASPECT)})"
    )
    opinions = f"regexp_extract_all({'one' if attributive else 'two'}, {_lit(_OPINION)})"
    return f"""
SELECT {_META}, span, unnest(opinions) AS opinion FROM (
  SELECT {_META}, unnest({spans}) AS span, {opinions} AS opinions FROM (
    SELECT {_META}, regexp_extract(m, {p}, 1) AS one, regexp_extract(m, {p}, 2) AS two
    FROM (SELECT {_META}, unnest(regexp_extract_all(line, {p})) AS m FROM lines) a) b) c"""


# Verbs that share a subject, by token position: a linking verb whose last word before it, other than
# auxiliaries and negations, is a conjunction; the last run of nouns before that; the opinions after it.
_CTES["tokens"] = f"""
SELECT {_META}, pos, left(item, 1) AS c, substr(item, 3) AS w FROM (
  SELECT {_META}, unnest(string_split(trim(line), ' ')) AS item, generate_subscripts(string_split(trim(line), ' '), 1) AS pos
  FROM (SELECT * FROM lines WHERE regexp_matches(line, '(C:and|O:but) ([OX]:[^ ]+ )*B:'))) t"""
_CTES["placed_tokens"] = f"""
SELECT *, c = 'C' OR (c = 'O' AND w = 'but') AS joins, c = 'X' OR (c = 'O' AND w IN ({_list(vocab.AUXILIARIES)})) AS helps,
  max(CASE WHEN NOT (c = 'X' OR (c = 'O' AND w IN ({_list(vocab.AUXILIARIES)}))) THEN pos END) OVER before AS last_word,
  max(CASE WHEN c = 'X' THEN pos END) OVER before AS last_not,
  count(*) FILTER (c NOT IN ('N', 'J', 'P', 'D', 'C')) OVER upto AS island,
  count(*) FILTER (c NOT IN ('X', 'I', 'J', 'C')) OVER upto AS said,
  count(*) FILTER (c = 'C') OVER upto AS part,
  count(*) FILTER (c IN ('J', 'C')) OVER before AS spoken
FROM tokens WINDOW before AS (PARTITION BY review_id, i ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  upto AS (PARTITION BY review_id, i ORDER BY pos)"""
_CTES["added_verbs"] = f"""
SELECT v.*, q.pos AS join_pos, coalesce(v.last_not > q.pos, false) AS denied,
  (SELECT max(n.pos) FROM placed_tokens n WHERE n.review_id = v.review_id AND n.i = v.i AND n.c = 'N' AND n.pos < q.pos) AS noun_pos
FROM placed_tokens v JOIN placed_tokens q ON q.review_id = v.review_id AND q.i = v.i AND q.pos = v.last_word AND q.joins
WHERE v.c = 'B'"""
_CTES["shared_seeds"] = """
SELECT v.review_id, v.i, v.pos, s.part, string_agg(s.w, ' ' ORDER BY s.pos) AS aspect_seed
FROM added_verbs v JOIN placed_tokens n ON n.review_id = v.review_id AND n.i = v.i AND n.pos = v.noun_pos
JOIN placed_tokens s ON s.review_id = v.review_id AND s.i = v.i AND s.island = n.island AND s.pos < v.join_pos AND s.c IN ('N', 'J')
GROUP BY ALL"""
_CTES["shared_opinions"] = """
SELECT v.review_id, v.i, v.pos, v.denied OR bool_or(o.c = 'X') AS aspect_negated, string_agg(o.w, ' ' ORDER BY o.pos) AS aspect_opinion
FROM added_verbs v JOIN placed_tokens o ON o.review_id = v.review_id AND o.i = v.i AND o.pos > v.pos AND o.said = v.said AND o.c <> 'C'
GROUP BY v.review_id, v.i, v.pos, v.denied, o.spoken HAVING bool_or(o.c = 'J')"""
_CTES["shared"] = """
SELECT DISTINCT v.review_id, v.user_id, v.business_id, v.stars, v.sentence, a.aspect_seed, b.aspect_opinion, b.aspect_negated
FROM added_verbs v JOIN shared_seeds a ON a.review_id = v.review_id AND a.i = v.i AND a.pos = v.pos
JOIN shared_opinions b ON b.review_id = v.review_id AND b.i = v.i AND b.pos = v.pos"""

_CTES["found"] = (
    _matches(_ATTRIBUTIVE, True)
    + " UNION ALL "
    + _matches(_PREDICATIVE, False)
    + " UNION ALL "
    + _matches(_CAUSATIVE, False)
)
_CTES["pair_rows"] = """
SELECT DISTINCT review_id, user_id, business_id, stars, sentence,
       array_to_string(regexp_extract_all(span, '[NJ]:([^ ]+)', 1), ' ') AS aspect_seed,
       trim(regexp_replace(opinion, '[A-Z]:', '', 'g')) AS aspect_opinion,
       contains(opinion, 'X:') AS aspect_negated
FROM found UNION SELECT * FROM shared"""

# --- stems ------------------------------------------------------------------------------------

# The published suffix tables of steps 2, 3 and 4, longest suffixes first.
_STEP_2 = dict(
    x.split(":")
    for x in (
        "ational:ate ization:ize iveness:ive fulness:ful ousness:ous tional:tion biliti:ble entli:ent "
        "ousli:ous ation:ate alism:al aliti:al iviti:ive enci:ence anci:ance izer:ize abli:able "
        "alli:al ator:ate eli:e"
    ).split()
)
_STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
_STEP_4 = (
    "ement ance ence able ible ment ant ent ion ism ate iti ous ive ize al er ic ou"
).split()

_C, _V = "[^aeiouY]", "[aeiouY]"
_M1, _M2, _MJ = f"^{_C}*{_V}+{_C}", f"^{_C}*{_V}+{_C}+{_V}+{_C}", f"^{_C}*{_V}+{_C}+{_V}*$"
_SHORT = f"{_C}{_V}[^aeiouwxyY]$"


def _cut(n: int, s: str = "s") -> str:
    return f"left({s}, length({s}) - {n})"


def _has(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, '{pattern}')"


def _suffix_step(table: dict[str, str]) -> str:
    rows = []
    for suffix in sorted(table, key=len, reverse=True):
        stem = _cut(len(suffix))
        rows.append(
            f"WHEN suffix(s, '{suffix}') THEN CASE WHEN {_has(stem, _M1)} "
            f"THEN {stem} || '{table[suffix]}' ELSE s END"
        )
    return " ".join(rows)


def _drop_step() -> str:
    rows = []
    for suffix in sorted(_STEP_4, key=len, reverse=True):
        stem = _cut(len(suffix))
        extra = f" AND {_has(stem, '[st]$')}" if suffix == "ion" else ""
        rows.append(
            f"WHEN suffix(s, '{suffix}') THEN CASE WHEN {_has(stem, _M2)}{extra} THEN {stem} ELSE s END"
        )
    return " ".join(rows)


_T = _cut(1)
_STEM_STEPS = [
    f"WHEN suffix(s,'sses') OR suffix(s,'ies') THEN {_cut(2)} WHEN suffix(s,'ss') THEN s WHEN suffix(s,'s') THEN {_cut(1)}",
    f"WHEN suffix(s,'eed') THEN CASE WHEN {_has(_cut(3), _M1)} THEN {_cut(1)} ELSE s END "
    f"WHEN suffix(s,'ed') AND {_has(_cut(2), _V)} THEN {_cut(2)} || '+' "
    f"WHEN suffix(s,'ing') AND {_has(_cut(3), _V)} THEN {_cut(3)} || '+'",
    f"WHEN NOT suffix(s,'+') THEN s WHEN {_has(_T, '(at|bl|iz)$')} THEN {_T} || 'e' "
    f"WHEN right({_T}, 1) = left(right({_T}, 2), 1) AND length({_T}) > 1 AND {_has(_T, '[^aeiouyYlsz]$')} THEN {_cut(2)} "
    f"WHEN {_has(_T, _MJ)} AND {_has(_T, _SHORT)} THEN {_T} || 'e' ELSE {_T}",
    f"WHEN {_has('s', '[yY]$')} AND {_has(_T, _V)} THEN {_T} || 'i'",
    _suffix_step(_STEP_2),
    _suffix_step(_STEP_3),
    _drop_step(),
    f"WHEN suffix(s,'e') AND ({_has(_T, _M2)} OR ({_has(_T, _MJ)} AND NOT {_has(_T, _SHORT)})) THEN {_T}",
    f"WHEN suffix(s,'ll') AND {_has('s', _M2)} THEN {_T}",
]


def _stem_ctes(name: str, source: str) -> None:
    """``name`` (w, stem) for the distinct words w of ``source``."""
    _CTES[f"{name}_0"] = (
        f"SELECT w, regexp_replace(regexp_replace(w, '([^aeiou])y', '\\1Y', 'g'), '([^aeiou])y', '\\1Y', 'g') AS s "
        f"FROM (SELECT DISTINCT w FROM ({source}))"
    )
    for k, body in enumerate(_STEM_STEPS):
        tail = "" if " ELSE left(s, length(s) - 1)" in body[-40:] else " ELSE s"
        _CTES[f"{name}_{k + 1}"] = (
            f"SELECT w, CASE WHEN length(s) <= 2 AND NOT suffix(s, '+') THEN s {body}{tail} END AS s "
            f"FROM {name}_{k}"
        )
    _CTES[name] = f"SELECT w, lower(s) AS stem FROM {name}_{len(_STEM_STEPS)}"


_OPINION_WORDS = (
    r"list_filter(string_split_regex(regexp_replace(lower({x}), '[^a-z0-9\s\-]', ' ', 'g'), '\s+'), "
    "lambda z: length(z) > 0)"
)
_LEX_ROWS = [
    (aspect, term, sign)
    for sign, groups in vocab.POLARITY.items()
    for aspect, terms in groups.items()
    for term in terms
]
_CTES["lexicon"] = (
    "SELECT * FROM (VALUES "
    + ", ".join(f"({_lit(a)}, {_lit(t)}, {_lit(s)})" for a, t, s in _LEX_ROWS)
    + ", "
    + ", ".join(
        f"(CAST(NULL AS VARCHAR), {_lit(t)}, {_lit(s)})" for a, t, s in _LEX_ROWS if a == "general"
    )
    + ") t(aspect_to_match, term_to_match, polarity)"
)
_stem_ctes(
    "stems",
    f"SELECT unnest({_OPINION_WORDS.format(x='aspect_opinion')}) AS w FROM pair_rows "
    f"UNION ALL SELECT unnest({_OPINION_WORDS.format(x='term_to_match')}) AS w FROM lexicon",
)
for _name, _src, _col in (
    ("opinion_stems", "pair_rows", "aspect_opinion"),
    ("term_stems", "lexicon", "term_to_match"),
):
    _CTES[_name] = f"""
SELECT x, string_agg(stem, ' ' ORDER BY i) AS stemmed FROM (
  SELECT x, i, ws[i] AS w FROM (
    SELECT DISTINCT {_col} AS x, {_OPINION_WORDS.format(x=_col)} AS ws FROM {_src}) a,
  unnest(generate_series(1, len(ws))) AS g(i)) b JOIN stems USING (w) GROUP BY x"""

# --- labels by vocabulary, sentiment ----------------------------------------------------------

_LEMMA = (
    "CASE WHEN suffix(w,'ies') AND length(w) > 3 THEN left(w, length(w)-3) || 'y' "
    "WHEN suffix(w,'s') AND NOT suffix(w,'ss') THEN left(w, length(w)-1) ELSE w END"
)


def _lemmas(x: str) -> str:
    return f"list_transform(regexp_extract_all(lower({x}), '[a-z][a-z\\-'']+'), lambda w: {_LEMMA})"


def _word_label(lem: str) -> str:
    out = []
    for label, terms in vocab.PROTOTYPES.items():
        out.append(f"WHEN list_has_any({lem}, {_arr([t for t in terms if ' ' not in t])}) THEN '{label}'")
    for label, terms in vocab.PROTOTYPES.items():
        for phrase in (t for t in terms if " " in t):
            out.append(f"WHEN contains(array_to_string({lem}, ' '), {_lit(phrase)}) THEN '{label}'")
    return f"CASE {' '.join(out)} END"


def _substring_label(lem: str) -> str:
    out = [
        f"WHEN len(list_filter({lem}, lambda v: contains({_lit(' '.join(terms))}, v))) > 0 THEN '{label}'"
        for label, terms in vocab.PROTOTYPES.items()
    ]
    return f"CASE {' '.join(out)} WHEN len({lem}) > 1 THEN '{next(iter(vocab.PROTOTYPES))}' END"


_CTES["seed_labels"] = f"""
SELECT aspect_seed, {_word_label('lem')} AS word_label, {_substring_label('lem')} AS substring_label
FROM (SELECT DISTINCT aspect_seed, {_lemmas('aspect_seed')} AS lem FROM pair_rows) t"""

_CTES["labelled"] = """
SELECT p.*, word_label AS aspect FROM pair_rows p JOIN seed_labels USING (aspect_seed)"""


def _hits(test: str) -> str:
    return f"""
SELECT DISTINCT d.aspect, d.aspect_opinion, t.stemmed AS term_to_match, l.polarity
FROM (SELECT DISTINCT aspect, aspect_opinion FROM labelled) d
JOIN opinion_stems o ON o.x = d.aspect_opinion
JOIN lexicon l ON l.aspect_to_match IS NULL OR l.aspect_to_match = d.aspect
JOIN term_stems t ON t.x = l.term_to_match
WHERE {test}"""


_TOKEN_TEST = "contains(' ' || o.stemmed || ' ', ' ' || t.stemmed || ' ')"
_CTES["token_hits"] = _hits(_TOKEN_TEST)
_CTES["substring_hits"] = _hits("contains(o.stemmed, t.stemmed)")

_CTES["sentiments"] = """
SELECT p.*, CASE WHEN h.pos AND h.neg THEN 'mixed'
                 WHEN h.pos THEN CASE WHEN aspect_negated THEN 'negative' ELSE 'positive' END
                 WHEN h.neg THEN CASE WHEN aspect_negated THEN 'positive' ELSE 'negative' END
                 ELSE 'neutral' END AS sentiment
FROM labelled p LEFT JOIN (
  SELECT aspect, aspect_opinion, bool_or(polarity = 'positive') AS pos, bool_or(polarity = 'negative') AS neg
  FROM token_hits GROUP BY ALL) h
ON h.aspect_opinion = p.aspect_opinion AND h.aspect IS NOT DISTINCT FROM p.aspect"""

_CTES["scored"] = """
SELECT *, positive_aspect_count / CAST(positive_aspect_count + negative_aspect_count AS DOUBLE) AS positive_aspect_ratio
FROM (SELECT review_id, sentence, user_id, business_id, stars, aspect,
             count(*) FILTER (sentiment = 'positive') AS positive_aspect_count,
             count(*) FILTER (sentiment = 'negative') AS negative_aspect_count
      FROM sentiments GROUP BY ALL) c
WHERE positive_aspect_count + negative_aspect_count > 0"""

_CTES["scored_weights"] = """
SELECT user_id, 1 / (1 + coalesce(var_pop(stars), 0)) AS w
FROM (SELECT DISTINCT user_id, review_id, stars FROM scored) GROUP BY user_id"""

# --- n-grams and TF-IDF -----------------------------------------------------------------------

_CTES["doc_words"] = r"""
SELECT lang, w AS word FROM (
  SELECT lang, unnest(string_split_regex(regexp_replace(lower(text), '[^a-z]', ' ', 'g'), '\s+')) AS w
  FROM documents) WHERE length(w) > 0"""
_CTES["doc_terms"] = "SELECT DISTINCT word AS term FROM doc_words"
_CTES["lang_protos"] = (
    "SELECT DISTINCT lang AS label, CASE lang "
    + " ".join(f"WHEN '{x}' THEN {i + 1}" for i, x in enumerate(LANGS))
    + f" END AS label_order, word AS term FROM doc_words WHERE lang IN ({_list(LANGS)})"
)
_CTES["seed_terms"] = r"""
SELECT regexp_replace(lower(aspect_seed), '^\s+|\s+$', '', 'g') AS term, count(*) AS n
FROM pair_rows WHERE length(aspect_seed) > 0 GROUP BY 1"""
_CTES["aspect_protos"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{label}', {i}, {_lit(t)})"
    for i, (label, terms) in enumerate(vocab.PROTOTYPES.items())
    for t in terms
) + ") t(label, label_order, term)"


def _gram_rows(source: str, keys: str) -> str:
    return rf"""
SELECT {keys}, substr(p, o, n) AS ngram, count(*) AS tf FROM (
  SELECT {keys}, ' ' || w || ' ' AS p FROM (
    SELECT {keys}, unnest(string_split_regex(term, '\s+')) AS w FROM {source}) a WHERE w <> '') b,
  unnest([3, 4, 5]) AS s(n), unnest(generate_series(1, length(p) - n + 1)) AS g(o)
WHERE n <= length(p) GROUP BY ALL"""


def _tfidf(prefix: str, terms: str, protos: str) -> None:
    _CTES[f"{prefix}_tg"] = _gram_rows(terms, "term")
    _CTES[f"{prefix}_pg"] = _gram_rows(protos, "label, label_order").replace(
        f"FROM {protos}) a", f"FROM {protos}) a"
    )
    _CTES[f"{prefix}_idf"] = f"""
SELECT ngram, count(*) AS df,
       ln((1.0 + (SELECT count(*) FROM {terms}) + (SELECT count(DISTINCT label) FROM {protos})) / (1.0 + count(*))) + 1 AS idf
FROM (SELECT ngram FROM {prefix}_tg UNION ALL SELECT ngram FROM {prefix}_pg) GROUP BY ngram"""
    _CTES[f"{prefix}_tw"] = f"""
SELECT term, ngram, tf, df, wt / sqrt(sum(wt * wt) OVER (PARTITION BY term)) AS weight
FROM (SELECT term, ngram, tf, df, (1 + ln(tf)) * idf AS wt FROM {prefix}_tg JOIN {prefix}_idf USING (ngram))"""
    _CTES[f"{prefix}_pw"] = f"""
SELECT label, label_order, ngram, wt / sqrt(sum(wt * wt) OVER (PARTITION BY label)) AS weight
FROM (SELECT label, label_order, ngram, (1 + ln(tf)) * idf AS wt FROM {prefix}_pg JOIN {prefix}_idf USING (ngram))"""
    _CTES[f"{prefix}_assign"] = f"""
SELECT term, CASE WHEN similarity >= 0.04 THEN label END AS label, similarity FROM (
  SELECT t.term, arg_max(label, sim) AS label, coalesce(max(sim), 0) AS similarity
  FROM (SELECT DISTINCT term FROM {prefix}_tg) t LEFT JOIN (
    SELECT a.term, b.label, b.label_order, sum(a.weight * b.weight) AS sim
    FROM {prefix}_tw a JOIN {prefix}_pw b USING (ngram) GROUP BY ALL) s USING (term) GROUP BY t.term)"""


_tfidf("lang", "doc_terms", "lang_protos")
_tfidf("asp", "(SELECT term FROM seed_terms)", "aspect_protos")
_stem_ctes("term_stem", "SELECT term AS w FROM doc_terms")

# --- series -----------------------------------------------------------------------------------

_CTES["pts"] = """
SELECT series, date, y, row_number() OVER (PARTITION BY series ORDER BY date) AS t,
       count(*) OVER (PARTITION BY series) AS n
FROM (SELECT user_id AS series, make_date(year, month, 1) AS date, avg(w_user) AS y FROM monthly GROUP BY ALL)"""

# Unit root: normal equations swept one pivot at a time, so the corner holds the rest of every order;
# the normal distribution by the trapezoid rule.
_CTES["ur_vectors"] = """
SELECT series, n, y, list_transform(range(1, n), lambda i: y[i + 1] - y[i]) AS d,
  least(n // 2 - 2, CAST(ceil(12 * (n / 100.0) ** 0.25) AS BIGINT)) AS top
FROM (SELECT series, any_value(n) AS n, list(y ORDER BY t) AS y FROM pts GROUP BY series HAVING any_value(n) >= 6)"""
_UR_CENTRED = "list_transform({v}, lambda v: list_transform(v, lambda e: e - list_avg(v)))"
_UR_LAGS = "list_transform(range(1, {p} + 1), lambda j: d[{p} + 1 - j:n - 1 - j])"


def _swept(name: str, source: str, p: str, first: str) -> None:
    """``name``: (series, k, g) for k = 1, 2, ... with the first k - 1 columns swept out of the products."""
    level, lags, last = f"[y[{p} + 1:n - 1]]", _UR_LAGS.format(p=p), f"[d[{p} + 1:]]"
    columns = f"list_concat(list_concat({level}, {lags}), {last})" if first == "level" else f"list_concat(list_concat({lags}, {level}), {last})"
    _CTES[f"{name}_products"] = f"""
SELECT series, n, {p} AS p, list_transform(c, lambda a: list_transform(c, lambda b: list_dot_product(a, b))) AS g
FROM (SELECT series, n, {p}, {_UR_CENTRED.format(v=columns)} AS c FROM {source})"""
    _CTES[f"{name}_sweeps"] = f"""
SELECT series, n, p, 1 AS k, g FROM {name}_products
UNION ALL
SELECT series, n, p, k + 1, list_transform(g, lambda r, i: CASE WHEN i = k THEN r
  ELSE list_transform(r, lambda v, j: v - r[k] * g[k][j] / g[k][k]) END)
FROM {name}_sweeps WHERE k <= p + 1"""


_swept("ur_nested", "ur_vectors", "top", "level")
_CTES["ur_orders"] = """
SELECT series, arg_min(k - 2, [m * (ln(2 * pi() * g[p + 2][p + 2] / m) + 1) + 2 * k, k]) AS lag
FROM (SELECT series, k, p, g, n - 1 - p AS m FROM ur_nested_sweeps WHERE k >= 2) GROUP BY series"""
_CTES["ur_chosen"] = "SELECT v.*, lag FROM ur_vectors v JOIN ur_orders USING (series)"
_swept("ur_final", "ur_chosen", "lag", "lags")
_CTES["ur_tests"] = """
SELECT series, n, p AS lag, g[p + 1][p + 2] / g[p + 1][p + 1]
  / sqrt((g[p + 2][p + 2] - g[p + 1][p + 2] ** 2 / g[p + 1][p + 1]) / (n - 1 - p - p - 2) / g[p + 1][p + 1]) AS t_stat
FROM ur_final_sweeps WHERE k = p + 1"""
_UR_Z = "CASE WHEN t_stat <= -1.61 THEN 2.1659 + 1.4412 * t_stat + 0.038269 * t_stat ** 2 ELSE 1.7339 + 0.93202 * t_stat - 0.12745 * t_stat ** 2 - 0.010368 * t_stat ** 3 END"
_CTES["ur_p"] = f"""
SELECT *, CASE WHEN t_stat < -18.83 THEN 0 WHEN t_stat > 2.74 THEN 1 ELSE
  0.5 + z / 4000 * (list_sum(list_transform(range(1, 4000), lambda i: exp(-((z * i / 4000) ** 2) / 2))) + 0.5 + exp(-(z ** 2) / 2) / 2) / sqrt(2 * pi()) END AS p_value
FROM (SELECT *, CAST({_UR_Z} AS DOUBLE) AS z FROM ur_tests)"""

_CTES["acf_rows"] = """
SELECT series, lag, sum(c1 * c2) / any_value(g0) AS r FROM (
  SELECT a.series, k.lag, a.c AS c1, b.c AS c2, a.g0
  FROM cpts a CROSS JOIN (SELECT unnest(generate_series(0, 24)) AS lag) k
  JOIN cpts b ON b.series = a.series AND b.t = a.t + k.lag
  WHERE k.lag <= floor(a.n / 2)) GROUP BY series, lag"""
_CTES["cpts"] = """
SELECT series, t, n, y - avg(y) OVER w AS c, var_pop(y) OVER w * n AS g0 FROM pts WINDOW w AS (PARTITION BY series)"""

_CTES["pacf_rows"] = """
SELECT series, 1 AS k, [r[2]] AS phi, 1 - r[2] * r[2] AS v, r[2] AS p, r FROM
  (SELECT series, list(r ORDER BY lag) AS r FROM acf_rows GROUP BY series)
UNION ALL
SELECT series, k + 1, list_append(list_transform(phi, lambda f, j: f - q * phi[k + 1 - j]), q),
       v * (1 - q * q), q, r FROM (
  SELECT *, (r[k + 2] - list_sum(list_transform(phi, lambda f, j: f * r[k + 2 - j]))) / v AS q
  FROM pacf_rows WHERE k + 2 <= len(r))"""

_CTES["lagged"] = """
SELECT *, lag(y, 1) OVER w AS y1, lag(y, 2) OVER w AS y2 FROM pts WINDOW w AS (PARTITION BY series ORDER BY date)"""

_CTES["ar1"] = """
SELECT *, m0 - p1 * m1 AS c, n_eff * (ln(2 * pi() * rss / n_eff) + 1) + 6 AS aic FROM (
  SELECT series, count(*) AS n_eff, avg(y) AS m0, avg(y1) AS m1,
         covar_pop(y, y1) / var_pop(y1) AS p1,
         count(*) * (var_pop(y) - covar_pop(y, y1) ** 2 / var_pop(y1)) AS rss
  FROM lagged WHERE t > 1 GROUP BY series)"""

_CTES["ar2"] = """
SELECT *, m0 - p1 * m1 - p2 * m2 AS c,
       n_eff * (ln(2 * pi() * rss / n_eff) + 1) + 8 AS aic FROM (
  SELECT *, n_eff * (s00 - p1 * s01 - p2 * s02) AS rss FROM (
    SELECT *, (s01 * s22 - s02 * s12) / (s11 * s22 - s12 * s12) AS p1,
              (s02 * s11 - s01 * s12) / (s11 * s22 - s12 * s12) AS p2 FROM (
      SELECT series, count(*) AS n_eff, avg(y) AS m0, avg(y1) AS m1, avg(y2) AS m2,
             var_pop(y) AS s00, covar_pop(y, y1) AS s01, covar_pop(y, y2) AS s02,
             var_pop(y1) AS s11, covar_pop(y1, y2) AS s12, var_pop(y2) AS s22
      FROM lagged WHERE t > 2 GROUP BY series)))"""

_CTES["fits"] = """
SELECT series, CAST(CASE WHEN b.aic < a.aic THEN 2 ELSE 1 END AS BIGINT) AS best_order, least(a.aic, b.aic) AS aic,
       CASE WHEN b.aic < a.aic THEN b.p1 ELSE a.p1 END AS phi1,
       CASE WHEN b.aic < a.aic THEN b.p2 END AS phi2,
       CASE WHEN b.aic < a.aic THEN b.c ELSE a.c END AS const,
       CASE WHEN b.aic < a.aic THEN b.rss / (b.n_eff - 1) ELSE a.rss / (a.n_eff - 1) END AS sigma2_resid,
       first, last, n_obs
FROM ar1 a JOIN ar2 b USING (series)
JOIN (SELECT series, min(date) AS first, max(date) AS last, count(*) AS n_obs FROM pts GROUP BY series) e USING (series)
WHERE n_obs >= 24"""

_CTES["resids"] = """
SELECT series, date, t, y, const + phi1 * y1 + coalesce(phi2 * y2, 0) AS fitted,
       y - const - phi1 * y1 - coalesce(phi2 * y2, 0) AS e
FROM lagged JOIN fits USING (series) WHERE t > best_order"""

_CTES["lb"] = """
SELECT series, n * (n + 2) * sum(power(g / g0, 2) / (n - k)) AS q FROM (
  SELECT a.series, k.k, sum(a.e * b.e) AS g, any_value(s.g0) AS g0, any_value(s.n) AS n
  FROM resids a CROSS JOIN (SELECT unnest(generate_series(1, 12)) AS k) k
  JOIN resids b ON b.series = a.series AND b.t = a.t + k.k
  JOIN (SELECT series, sum(e * e) AS g0, count(*) AS n FROM resids GROUP BY series) s ON s.series = a.series
  GROUP BY a.series, k.k) GROUP BY series, n"""

_CTES["lb_p"] = "SELECT series, q, exp(-q / 2) * (" + " + ".join(
    f"power(q / 2, {i}) / {f}" for i, f in enumerate([1, 1, 2, 6, 24, 120])
) + ") AS p FROM lb"

_CTES["summary"] = """
SELECT f.*, p AS lb_pvalue_12, CASE WHEN best_order = 2 THEN phi2 ELSE phi1 END AS phi,
       phi1 + coalesce(phi2, 0) AS phi_sum FROM fits f JOIN lb_p USING (series)"""

# --- extracted terms --------------------------------------------------------------------------

_CTES["extracted"] = f"""
SELECT rid, i, terms[i] AS term, sign FROM (
  SELECT rid, CASE WHEN stars >= 4 THEN 1.0 WHEN stars <= 2 THEN -1.0 ELSE 0.0 END AS sign,
         list_filter(regexp_extract_all(lower(text), '[a-zA-Z'']+'),
                     lambda w: w IN ({_list(EXTRACTED)})) AS terms
  FROM reviews) r, unnest(generate_series(1, len(terms))) AS g(i)"""


# What the default scorer returns: bucket words, labelled by the balance of the opinion words.
_BUCKET_NOUNS = sorted({w for ws in vocab.BUCKETS_EXACT.values() for w in ws})
_CTES["keyword_terms"] = f"""
SELECT rid, i, terms[i] AS term, sign FROM (
  SELECT rid, CAST(sign(len(list_filter(ws, lambda w: w IN ({_list(vocab.LEXICON_POSITIVE)})))
                - len(list_filter(ws, lambda w: w IN ({_list(vocab.LEXICON_NEGATIVE)})))) AS DOUBLE) AS sign,
         list_filter(ws, lambda w: w IN ({_list(_BUCKET_NOUNS)})) AS terms
  FROM (SELECT rid, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM reviews) t) r,
  unnest(generate_series(1, len(terms))) AS g(i)"""


def _bucket(words: vocab.Vocabulary, x: str, fragments: vocab.Vocabulary | None = None) -> str:
    out = [f"WHEN {x} IN ({_list(ws)}) THEN '{b}'" for b, ws in words.items()]
    for b, parts in (fragments or {}).items():
        out.append("WHEN " + " OR ".join(f"contains({x}, '{p}')" for p in parts) + f" THEN '{b}'")
    return f"CASE {' '.join(out)} END"


def _bucket_query(mean: bool, source: str = "extracted") -> str:
    x = "regexp_replace(trim(lower(term)), 's$', '')" if mean else "lower(term)"
    b = (
        _bucket(vocab.BUCKETS_LOOSE, x, vocab.BUCKET_FRAGMENTS)
        if mean
        else _bucket(vocab.BUCKETS_EXACT, x)
    )
    agg = "avg" if mean else "sum"
    scores = ", ".join(
        f"{_r(f'coalesce(CAST({agg}(sign) FILTER (b = {_lit(a)}) AS DOUBLE), 0)')} AS aspect_{a}"
        for a in ASPECTS
    )
    name = "{}_terms" if mean else "{}_pos_terms"
    cond = "" if mean else " AND sign > 0"
    lists = ", ".join(
        f"coalesce(string_agg(term, '|' ORDER BY i) FILTER (b = '{a}'{cond}), '') AS {name.format(a)}"
        for a in ASPECTS
    )
    return f"""
SELECT r.review_id, {scores}, {lists}
FROM reviews r LEFT JOIN (SELECT *, {b} AS b FROM {source}) e USING (rid) GROUP BY rid, r.review_id"""


# --- assembly ---------------------------------------------------------------------------------


def _mentions(text: str, name: str) -> bool:
    return re.search(rf"(?:FROM|JOIN)\s+{name}\b", text) is not None


def _sql(body: str) -> str:
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _CTES:
            if _mentions(text, name) and name not in needed:
                needed.append(name)
                visit(_CTES[name])

    visit(body)
    # A building block is placed after those it mentions.
    placed: list[str] = []

    def place(name: str) -> None:
        for other in needed:
            if other != name and other not in placed and _mentions(_CTES[name], other):
                place(other)
        if name not in placed:
            placed.append(name)

    for name in needed:
        place(name)
    if not placed:
        return body.strip()
    head = "WITH RECURSIVE " if {"pacf_rows", "km_seeds", "ur_nested_sweeps"} & set(placed) else "WITH "
    return head + ",\n".join(
        f"{n} AS {'MATERIALIZED ' if n == 'reviews' else ''}({_CTES[n].strip()})" for n in placed
    ) + "\n" + body.strip()


_Z = ", ".join(f"{_r(f'{a}_z')} AS {a}_z" for a in ASPECTS)
_VEC = (
    "business_id, n_reviews_sample, n_users_sample, "
    + ", ".join(f"{_r(a)} AS {a}" for a in ASPECTS)
    + ", "
    + ", ".join(f"{_r(f'cover_{a}_frac')} AS cover_{a}_frac" for a in ASPECTS)
)
_TERMS = ", ".join(
    f"coalesce(array_to_string(list_slice(flatten(list(list_slice({s}, 1, 5) ORDER BY i) FILTER (has_{a})), 1, 10), '|'), '') AS {a}_{s}_terms"
    for a in ASPECTS
    for s in ("pos", "neg")
)
_RAW = "strftime(review_ts, '%Y-%m-%d %H:%M:%S')"

_QUERIES: dict[str, str] = {
    "json_scan": f"SELECT review_id, CAST(user_id AS VARCHAR) AS user_id, CAST(business_id AS VARCHAR) AS business_id, stars, {_RAW} AS date FROM ratings",
    "drifting_json": """
SELECT CASE WHEN stars < 5 THEN review_id END AS review_id, CASE WHEN stars < 5 THEN text END AS text,
       CASE WHEN stars < 4 THEN stars END AS stars, CASE stars WHEN 3 THEN '{"votes":7}' WHEN 4 THEN '{"stars":[4]}' END AS rescued,
       CASE WHEN stars = 5 THEN '["' || review_id || '", ' END AS corrupt
FROM reviews""",
    "scan_years": "SELECT review_id, user_id, stars, review_year FROM ratings WHERE review_year IN (1996, 1999)",
    "load_entity": f"SELECT review_id, CAST(user_id AS VARCHAR) AS user_id, stars, {_RAW} AS date, review_year AS year FROM ratings",
    "partitioned_roundtrip": "SELECT review_year, review_month, count(*) AS n, sum(stars) AS sum_stars FROM ratings GROUP BY ALL",
    "csv_roundtrip": f"SELECT {_VEC}, CAST(cluster AS BIGINT) AS cluster, name, city, state, categories, stars, review_count FROM described",
    "lexicon_table": """
SELECT coalesce(aspect_to_match, '*') AS aspect_to_match, term_to_match, t.stemmed AS stem, polarity, coalesce(c.n, 0) AS n
FROM lexicon l JOIN term_stems t ON t.x = l.term_to_match LEFT JOIN (
  SELECT stem, count(*) AS n FROM (
    SELECT unnest(string_split(o.stemmed, ' ')) AS stem FROM pair_rows p JOIN opinion_stems o ON o.x = p.aspect_opinion)
  GROUP BY stem) c ON c.stem = t.stemmed""",
    "profile": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, count({c}) AS non_null, count(DISTINCT {c}) AS distinct_values FROM ratings"
        for c in ("user_id", "business_id", "stars", "review_year")
    ),
    "sketch_profile": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, count({c}) AS non_null, true AS distinct_near, "
        f"{'true' if c == 'stars' else 'CAST(NULL AS BOOLEAN)'} AS median_near FROM ratings"
        for c in ("review_id", "user_id", "business_id", "stars")
    ),
    "distinct_values": "SELECT DISTINCT city FROM business ORDER BY city",
    "select_business": "SELECT business_id, name AS biz_name, city AS biz_city, state AS biz_state, stars AS biz_stars, review_count AS biz_review_count, categories AS biz_categories FROM business",
    "derive_time": "SELECT review_id, strftime(review_ts, '%Y-%m-%d') AS day, review_year, review_month FROM ratings",
    "filter_category_like": """
SELECT business_id, categories, 'contains' AS mode FROM business WHERE lower(categories) LIKE '%economy%'
UNION ALL SELECT business_id, categories, 'suffix' FROM business WHERE lower(categories) LIKE '%promo'""",
    "filter_category_regex": f"SELECT business_id, categories FROM business WHERE regexp_matches(categories, {_lit(DOMAIN)})",
    "drop_null_keys": "SELECT review_id, user_id, stars FROM ratings WHERE stars < 5",
    "preview_truncate": "SELECT substr(review_id, 1, 10) AS review_id, substr(CAST(user_id AS VARCHAR), 1, 10) AS user_id, substr(text, 1, 25) AS text, stars FROM reviews",
    "nested_field": "SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS has_k, json_extract_string(props, '$.missing') IS NOT NULL AS has_missing FROM events",
    "sample_n": "SELECT review_id, user_id, stars FROM ratings ORDER BY md5('42' || review_id), review_id LIMIT 1000",
    "sample_fraction": "SELECT review_id, user_id, stars FROM ratings WHERE substr(md5('3' || review_id), 1, 4) < '028f'",
    "filter_city_min_reviews": f"SELECT business_id, city, n_reviews_sample, {_r('food')} AS food FROM described WHERE city = 'Brand#7' AND n_reviews_sample >= (SELECT floor(median(n_reviews_sample)) FROM described)",
    "dedup_rows": "SELECT DISTINCT user_id, stars, review_year, review_month FROM ratings",
    "enrich_reviews": "SELECT review_id, r.business_id, r.stars, name AS biz_name, city AS biz_city, b.stars AS biz_stars, review_count AS biz_review_count FROM ratings r LEFT JOIN business b ON b.business_id = r.business_id",
    "absa_ready": f"""
SELECT review_id, r.business_id, name, city, state, r.user_id, u.review_count, {_r('average_stars')} AS average_stars, r.stars, text
FROM reviews r JOIN business b ON b.business_id = r.business_id LEFT JOIN users u ON u.user_id = r.user_id
WHERE regexp_matches(categories, {_lit(DOMAIN)})""",
    "absa_flat": f"""
SELECT review_id, r.business_id, name, city, state, categories, r.stars AS review_stars, u.review_count AS user_review_count,
       {_r('average_stars')} AS average_stars, lower(text) AS text, r.user_id, b.stars AS biz_stars, b.review_count AS biz_review_count
FROM reviews r JOIN business b ON b.business_id = r.business_id LEFT JOIN users u ON u.user_id = r.user_id
WHERE regexp_matches(categories, {_lit(DOMAIN)})""",
    "join_weights": f"""
SELECT r.user_id, review_id, stars, {_r('coalesce(w, 1)')} AS w_user FROM ratings r LEFT JOIN (
  SELECT user_id, 1 / (1 + coalesce(var_pop(stars), 0)) AS w FROM ratings WHERE review_year >= 2001 GROUP BY user_id) w
ON w.user_id = r.user_id""",
    "aspect_pairs": "SELECT review_id, user_id, business_id, stars, sentence, aspect_seed, aspect_opinion, aspect_negated FROM pair_rows",
    "aspect_map_apply": """
SELECT review_id, sentence, p.aspect_seed, aspect_opinion, coalesce(a.label, s.word_label) AS aspect
FROM pair_rows p JOIN asp_assign a ON a.term = lower(p.aspect_seed) JOIN seed_labels s ON s.aspect_seed = p.aspect_seed""",
    "polarity_hits": "SELECT * FROM token_hits",
    "polarity_hits_substring": "SELECT * FROM substring_hits",
    "top_cities": "SELECT city AS biz_city, count(*) AS n FROM ratings r JOIN business b ON b.business_id = r.business_id WHERE review_year >= 2000 AND r.stars = 5 GROUP BY city ORDER BY n DESC, city LIMIT 10",
    "reviewer_weights": f"SELECT user_id, {_r('v')} AS var_review_stars, n AS user_review_count_in_sample, {_r('w')} AS w_user FROM user_weights",
    "monthly_weights": f"SELECT user_id, year, month, n_reviews, {_r('var_stars')} AS var_stars, {_r('w_user')} AS w_user FROM monthly",
    "cohort_monthly": f"""
SELECT user_id, year, month, n_reviews, {_r('var_stars')} AS var_stars, {_r('w_user')} AS w_user FROM monthly
WHERE n_reviews >= 5 AND user_id IN (SELECT user_id FROM ratings GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 25)""",
    "monthly_summary": f"SELECT year, month, {_r('avg_w_user')} AS avg_w_user, {_r('avg_var_stars')} AS avg_var_stars, total_reviews FROM month_totals",
    "weight_var_corr": f"SELECT {_r('corr(avg_w_user, avg_var_stars)')} AS corr_w_var, count(*) AS n_months FROM month_totals",
    "restaurant_vectors": f"SELECT {_VEC} FROM vecs",
    "opinion_sentiment": "SELECT review_id, sentence, aspect_seed, aspect_opinion, aspect_negated, aspect, sentiment FROM sentiments",
    "review_aspect_scores": f"SELECT review_id, sentence, user_id, business_id, stars, aspect, positive_aspect_count, negative_aspect_count, {_r('positive_aspect_ratio')} AS positive_aspect_ratio FROM scored",
    "weighted_scores": f"""
SELECT s.business_id, s.stars AS review_stars, review_id, s.user_id, sentence AS text, CAST(1 AS BIGINT) AS review_count, aspect,
       {_r('w * positive_aspect_ratio - avg(w * positive_aspect_ratio) OVER ()')} AS sentiment_score,
       {_r('w * positive_aspect_ratio')} AS sentiment_score_before_normalization,
       positive_aspect_count AS positive_aspect_count_sum, negative_aspect_count AS negative_aspect_count_sum,
       b.stars AS business_stars
FROM scored s JOIN scored_weights w ON w.user_id = s.user_id LEFT JOIN business b ON b.business_id = s.business_id""",
    "business_aspect_scores": f"""
SELECT business_id, aspect, {_r('sum(w * positive_aspect_ratio)')} AS weighted_positive_aspect_ratio, {_r('sum(w)')} AS w_user_den,
       count(*) AS review_count, count(DISTINCT s.user_id) AS user_account,
       CAST(sum(positive_aspect_count) AS BIGINT) AS positive_aspect_count_sum,
       CAST(sum(negative_aspect_count) AS BIGINT) AS negative_aspect_count_sum,
       {_r('sum(w * positive_aspect_ratio) / sum(w)')} AS weighted_mean
FROM scored s JOIN scored_weights w ON w.user_id = s.user_id
GROUP BY business_id, aspect HAVING count(*) >= 3""",
    "zscore_vectors": f"SELECT business_id, {_Z} FROM vecs_z",
    "top_words": f"""
SELECT word, count(*) AS n FROM doc_words WHERE word NOT IN ({_list(vocab.STOP_WORDS)})
GROUP BY word ORDER BY n DESC, word LIMIT 200""",
    "heavy_words": f"""
SELECT word, count(*) AS n FROM doc_words WHERE word NOT IN ({_list(vocab.STOP_WORDS)}) AND length(word) >= 3
GROUP BY word ORDER BY n DESC, word LIMIT 200""",
    "colocated_weights": f"""
SELECT user_id, count(*) AS n, {_r('any_value(w)')} AS w_user, {_r('sum(w * stars)')} AS weighted_stars
FROM ratings JOIN user_weights USING (user_id) GROUP BY user_id""",
    "colocated_business": f"""
SELECT business_id, count(*) AS n, {_r('any_value(mean)')} AS mean, {_r('sum(abs(stars - mean))')} AS spread
FROM ratings JOIN (SELECT business_id, avg(stars) AS mean FROM ratings GROUP BY business_id) USING (business_id) GROUP BY business_id""",
    "staged_top_cities": """
SELECT city AS biz_city, count(*) AS n, sum(r.stars) AS sum_stars
FROM ratings r JOIN business USING (business_id) WHERE review_year IN (1997, 1998) GROUP BY city""",
    "incremental_weights": f"SELECT user_id, year, month, n_reviews, {_r('var_stars')} AS var_stars, {_r('w_user')} AS w_user FROM monthly",
    "term_counts": "SELECT term, n FROM seed_terms",
    "top_reviewers": "SELECT o_custkey AS user_id, count(*) AS n_reviews_total FROM orders GROUP BY o_custkey ORDER BY 2 DESC, 1 LIMIT 100",
    "describe_metrics": " UNION ALL ".join(
        f"SELECT '{m}' AS metric, count({m}) AS count, {_r(f'avg({m})')} AS mean, {_r(f'stddev_samp({m})')} AS std, {_r(f'min({m})')} AS min, "
        + ", ".join(
            f"{_r(f'quantile_cont({m}, CAST({q} AS DOUBLE))')} AS p{int(q * 100)}" for q in (0.25, 0.5, 0.75)
        )
        + f", {_r(f'max({m})')} AS max FROM summary"
        for m in ("phi", "aic", "sigma2_resid")
    ),
    "user_series": f"SELECT series, t, date, {_r('y')} AS y FROM pts",
    "series_cohort": f"""
SELECT series, count(*) AS n_months, {_r('var_pop(y)')} AS var_y, min(date) AS first, max(date) AS last
FROM pts GROUP BY series HAVING count(*) >= 24 ORDER BY 2 DESC, round(var_pop(y), 12) DESC, series LIMIT 12""",
    "rolling_mean_12": f"SELECT series, date, {_r('y')} AS y, {_r('avg(y) OVER (PARTITION BY series ORDER BY date ROWS 11 PRECEDING)')} AS rolling FROM pts",
    "acf": f"SELECT series, lag, {_r('r')} AS acf FROM acf_rows",
    "pacf": f"SELECT series, CAST(k AS BIGINT) AS lag, {_r('p')} AS pacf FROM pacf_rows UNION ALL SELECT DISTINCT series, 0, 1.0 FROM pts",
    "df_tstat": f"""
SELECT series, n, {_r('b')} AS rho, {_r('b / sqrt(rss / (k - 2) / sxx)')} AS t_stat FROM (
  SELECT series, any_value(n) AS n, count(*) AS k, regr_slope(y - y1, y1) AS b, regr_sxx(y - y1, y1) AS sxx,
         regr_syy(y - y1, y1) - regr_sxy(y - y1, y1) ** 2 / regr_sxx(y - y1, y1) AS rss
  FROM lagged WHERE t > 1 GROUP BY series)""",
    "df_tstat_lag1": f"""
SELECT series, n, {_r('b')} AS rho, {_r('b / sqrt((sdd - b * sdx - g * sdz) * m / (m - 3) * szz / (sxx * szz - sxz * sxz) / m)')} AS t_stat FROM (
  SELECT *, (sdx * szz - sdz * sxz) / (sxx * szz - sxz * sxz) AS b, (sdz * sxx - sdx * sxz) / (sxx * szz - sxz * sxz) AS g FROM (
    SELECT series, any_value(n) AS n, count(*) AS m, var_pop(y - y1) AS sdd, covar_pop(y - y1, y1) AS sdx,
           covar_pop(y - y1, y1 - y2) AS sdz, var_pop(y1) AS sxx, covar_pop(y1, y1 - y2) AS sxz, var_pop(y1 - y2) AS szz
    FROM lagged WHERE t > 2 GROUP BY series))""",
    "unit_root": f"SELECT series, n, lag, {_r('t_stat')} AS t_stat, {_r('p_value')} AS p_value FROM ur_p",
    "ar_fit": f"SELECT series, first, last, true AS ok, best_order, {_r('aic')} AS aic, n_obs, {_r('phi1')} AS phi1, {_r('phi2')} AS phi2, {_r('sigma2_resid')} AS sigma2_resid FROM fits",
    "ar_fitted": f"SELECT series, date, {_r('y')} AS y, {_r('fitted')} AS fitted FROM resids",
    "ljung_box": f"SELECT series, {_r('q')} AS lb_stat_12, {_r('p')} AS lb_pvalue_12 FROM lb_p",
    "ar_summary": f"""
SELECT series, best_order, {_r('phi1')} AS phi1, {_r('phi2')} AS phi2, {_r('phi')} AS phi, {_r('phi_sum')} AS phi_sum, {_r('aic')} AS aic, n_obs
FROM summary s ORDER BY s.phi DESC, series LIMIT 10""",
    "ar_flags": f"""
SELECT series, best_order, {_r('sigma2_resid')} AS sigma2_resid, {_r('lb_pvalue_12')} AS lb_pvalue_12, n_obs FROM summary s
WHERE s.sigma2_resid > (SELECT quantile_cont(sigma2_resid, CAST(0.9 AS DOUBLE)) FROM summary) OR s.lb_pvalue_12 < 0.05""",
    "sentences": r"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, s AS sentence,
       len(regexp_extract_all(s, '[a-zA-Z'']+')) AS tokens
FROM (SELECT doc_id, i, regexp_replace(pieces[i], '^\s+|\s+$', '', 'g') AS s
      FROM (SELECT doc_id, string_split_regex(lower(text), '[.!?]+') AS pieces FROM documents) d,
           unnest(generate_series(1, len(pieces))) AS g(i)) p WHERE length(s) > 0""",
    "lexicon_scores": "SELECT review_id, " + ", ".join(f"{_r(f'aspect_{a}')} AS aspect_{a}" for a in ASPECTS) + " FROM lex_scores",
    "lexicon_terms": f"SELECT review_id, {_TERMS} FROM lex_facts GROUP BY rid, review_id",
    "lemmas": f"SELECT lemma, count(*) AS n FROM (SELECT unnest({_lemmas('text')}) AS lemma FROM documents) GROUP BY lemma",
    "stem_tokens": "SELECT w AS term, stem FROM term_stem",
    "char_ngrams": "SELECT ngram, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM lang_tg GROUP BY ngram",
    "tfidf_weights": f"SELECT term, ngram, tf, df, {_r('weight')} AS weight FROM lang_tw",
    "language_assign": f"SELECT term, label, {_r('similarity')} AS similarity FROM lang_assign",
    "aspect_assign": f"SELECT term, label, {_r('similarity')} AS similarity FROM asp_assign",
    "aspect_backoff": "SELECT DISTINCT lower(aspect_seed) AS term, word_label, substring_label FROM seed_labels",
    "mapping_agreement": """
SELECT coalesce(a.label, 'none') AS tfidf_label, coalesce(s.word_label, 'none') AS lexical_label,
       count(*) AS terms, CAST(sum(t.n) AS BIGINT) AS row_count
FROM seed_terms t JOIN asp_assign a ON a.term = t.term JOIN seed_labels s ON lower(s.aspect_seed) = t.term GROUP BY ALL""",
    "term_bucket_sum": _bucket_query(False),
    "term_bucket_mean": _bucket_query(True),
    "batch_score": _bucket_query(True, "keyword_terms"),
    "cluster_profile": "SELECT CAST(cluster AS BIGINT) AS cluster, count(*) AS n, " + ", ".join(f"{_r(f'avg({a})')} AS avg_{a}" for a in ASPECTS) + " FROM described GROUP BY cluster",
    "kmeans_clusters": "SELECT business_id, CAST(cluster AS BIGINT) AS cluster FROM km_labels",
    "kmeans_quality": f"""
SELECT CAST(cluster AS BIGINT) AS cluster, count(*) AS n, {_r('avg(s)')} AS silhouette,
       (SELECT {_r('avg(s)')} FROM km_silhouettes) AS overall
FROM km_silhouettes GROUP BY cluster""",
    "weighted_assign": "SELECT business_id, CAST(cluster AS BIGINT) AS cluster, CAST(cluster_weighted AS BIGINT) AS cluster_weighted FROM moved",
    "cluster_size_compare": """
SELECT CAST(coalesce(a.cluster, b.cluster) AS BIGINT) AS label, coalesce(a.n, 0) AS original, coalesce(b.n, 0) AS weighted
FROM (SELECT cluster, count(*) AS n FROM moved GROUP BY cluster) a
FULL JOIN (SELECT cluster_weighted AS cluster, count(*) AS n FROM moved GROUP BY cluster_weighted) b ON a.cluster = b.cluster""",
    "top_by_aspect": f"""
SELECT * FROM (SELECT 'food' AS by, business_id, name, city, {_r('food')} AS food, {_r('service')} AS service FROM described ORDER BY 5 DESC, 2 LIMIT 20)
UNION ALL
SELECT * FROM (SELECT 'service', business_id, name, city, {_r('food')}, {_r('service')} FROM described ORDER BY 6 DESC, 2 LIMIT 20)""",
}

SQL: dict[str, str] = {name: _sql(body) for name, body in _QUERIES.items()}
