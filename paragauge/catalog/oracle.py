"""DuckDB twins of the registered queries, written independently of the Spark code.

Each statement starts from the given tables. Named parts below are common table expressions;
``sql(parts, select)`` puts the needed ones in front.
"""

from __future__ import annotations

from itertools import accumulate
from math import exp, factorial

from paragauge.catalog.fixtures import LOWER, UPPER

# Strings read as missing, and the wording of the translation task.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
INSTRUCTION = (
    "Please translate the following Chinese text into English and provide only the "
    "translated content, nothing else."
)
SYSTEM_MESSAGE = "You are an expert in translating Chinese to English."

# -- inputs -------------------------------------------------------------------------------

PAIRS = """pairs AS (
  SELECT u.conv_id * 4294967296 + u.turn AS row_id, u.text AS source, a.text AS target
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""

DIRTY = """dirty AS (
  SELECT row_id, CASE WHEN row_id % 11 = 0 THEN NULL ELSE source END AS source,
    CASE row_id % 11 WHEN 1 THEN '' WHEN 2 THEN '   ' WHEN 3 THEN 'NA' WHEN 4 THEN 'None'
      ELSE target END AS target
  FROM pairs)"""

PREDS = f"""preds AS (
  SELECT row_id, 'org/copy' AS model, target AS prediction FROM pairs
  UNION ALL SELECT row_id, 'org/half-0.7', CASE WHEN row_id % 2 = 0 THEN target
    ELSE left(target, length(target) * 7 // 10) END FROM pairs
  UNION ALL SELECT row_id, 'org/source-bnb-4bit', source FROM pairs
  UNION ALL SELECT row_id, 'org/swap', substring(target, length(target) // 2 + 1) || ' '
    || left(target, length(target) // 2) FROM pairs
  UNION ALL SELECT row_id, 'org/upper(finetuned)', translate(target, '{LOWER}', '{UPPER}')
    FROM pairs)"""


def extracted(x: str) -> str:
    marker = r"(?s).*?(assistant|\[/INST\])(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+([\p{L}\p{N}_]))"
    step1 = f"regexp_replace({x}, '{marker}', '\\2', 'g')"
    step2 = f"regexp_replace({step1}, '(?s)<.+?>.*', '', 'g')"
    return f"regexp_replace({step2}, '(?s).*?end_header_id\\|>\\n\\n', '', 'g')"


def extracted_legacy(x: str) -> str:
    marker = r"(?s).*?assistant(?:[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+([\p{L}\p{N}_]))"
    step1 = f"regexp_replace({x}, '{marker}', '\\1', 'g')"
    return f"regexp_replace({step1}, '(?s)<\\|.*?\\|>.*', '', 'g')"


ANSWERS = f"""answers AS (
  SELECT p.row_id, p.model, r.target, {extracted("p.prediction")} AS answer
  FROM preds p JOIN pairs r USING (row_id))"""

# -- tokenizers ---------------------------------------------------------------------------


def tok_13a(x: str) -> str:
    for old, new in (
        ("<skipped>", ""), ("-\n", ""), ("\n", " "),
        ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
    ):
        x = f"replace({x}, '{old}', '{new}')"
    x = f"' ' || {x} || ' '"
    for pattern, new in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 "),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda t: t <> '')"


def tok_rouge(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def tok_words(x: str) -> str:
    return (
        f"regexp_extract_all(lower({x}), "
        r"'[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s\p{Z}]')"
    )


def tokens(tokenize) -> str:
    return f"""tk AS MATERIALIZED (
  SELECT row_id, model, {tokenize("answer")} AS h, {tokenize("target")} AS r FROM answers)"""


# -- n-gram overlap, BLEU, ROUGE-N --------------------------------------------------------


def _gram_counts(side: str) -> str:
    return f"""{side}g AS (
  SELECT row_id, model, n, g, count(*) AS c FROM (
    SELECT row_id, model, n,
      unnest([array_to_string({side}[i:i + n - 1], ' ')
              for i in range(1, len({side}) - n + 2)]) AS g
    FROM tk, (SELECT unnest(range(1, 5)) AS n))
  GROUP BY ALL)"""


OVERLAP = f"""{_gram_counts("h")}, {_gram_counts("r")},
shared AS (SELECT row_id, model, n, sum(least(hg.c, rg.c))::BIGINT AS matches
  FROM hg JOIN rg USING (row_id, model, n, g) GROUP BY ALL),
ov AS (SELECT row_id, model, n, coalesce(matches, 0) AS matches,
    greatest(len(h) - n + 1, 0) AS hyp_ngrams, greatest(len(r) - n + 1, 0) AS ref_ngrams
  FROM (SELECT * FROM tk, (SELECT unnest(range(1, 5)) AS n))
  LEFT JOIN shared USING (row_id, model, n))"""

BLEU = """orders AS (SELECT model, n, sum(matches) AS m, sum(hyp_ngrams) AS t FROM ov GROUP BY ALL),
lens AS (SELECT model, sum(hyp_ngrams)::BIGINT AS hl, sum(ref_ngrams)::BIGINT AS rl
  FROM ov WHERE n = 1 GROUP BY ALL),
bleu AS (SELECT model, hl, rl,
    CASE WHEN hl = 0 THEN 0.0 WHEN hl > rl THEN 1.0 ELSE exp(1 - rl / hl) END AS bp,
    CASE WHEN min(m) = 0 THEN 0.0 ELSE exp(avg(ln(nullif(m, 0) / nullif(t, 0)))) END AS gm,
    max(CASE WHEN n = 1 THEN m / greatest(t, 1) END) AS p1,
    max(CASE WHEN n = 2 THEN m / greatest(t, 1) END) AS p2,
    max(CASE WHEN n = 3 THEN m / greatest(t, 1) END) AS p3,
    max(CASE WHEN n = 4 THEN m / greatest(t, 1) END) AS p4
  FROM orders JOIN lens USING (model) GROUP BY ALL)"""

BLEU_FIELDS = """round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3, round(p4, 6) AS p4,
  round(bp, 6) AS brevity_penalty, round(hl / rl, 6) AS length_ratio,
  hl AS translation_length, rl AS reference_length"""

ROUGE_N = """rn AS (SELECT row_id, model, n, CASE WHEN matches = 0 THEN 0.0
    ELSE 2.0 * (matches / hyp_ngrams) * (matches / ref_ngrams)
      / (matches / hyp_ngrams + matches / ref_ngrams) END AS f FROM ov WHERE n <= 2)"""

# -- ROUGE-L ------------------------------------------------------------------------------
# For each reference token in turn, the sorted ends of the shortest common subsequences by
# length: a hypothesis place moves the end of its own block down to itself.

ROUGE_L = """hw AS (SELECT row_id, model, unnest(h) AS w, generate_subscripts(h, 1) AS i FROM tk),
rw AS (SELECT row_id, model, unnest(r) AS w, generate_subscripts(r, 1) AS j FROM tk),
places AS MATERIALIZED (
  SELECT row_id, model, p, row_number() OVER (PARTITION BY row_id, model ORDER BY j) AS step
  FROM (SELECT row_id, model, j, list(i ORDER BY i) AS p
        FROM rw JOIN hw USING (row_id, model, w) GROUP BY ALL)),
ends AS (
  SELECT row_id, model, 0::BIGINT AS step, []::BIGINT[] AS e FROM tk
  UNION ALL
  SELECT x.row_id, x.model, x.step + 1,
    list_transform(e, lambda v, k: coalesce(least(v, list_min(list_filter(p,
        lambda q: q <= v AND q > coalesce(e[k - 1], 0)))), v))
    || CASE WHEN p[-1] > coalesce(e[-1], 0)
       THEN [list_min(list_filter(p, lambda q: q > coalesce(e[-1], 0)))] ELSE [] END
  FROM ends x JOIN places y ON y.row_id = x.row_id AND y.model = x.model AND y.step = x.step + 1),
rl AS (SELECT row_id, model, lcs, CASE WHEN lcs = 0 THEN 0.0
    ELSE 2.0 * (lcs / len(h)) * (lcs / len(r)) / (lcs / len(h) + lcs / len(r)) END AS f
  FROM tk JOIN (SELECT row_id, model, max(len(e)) AS lcs FROM ends GROUP BY ALL)
    USING (row_id, model))"""

# -- ROUGE-Lsum ---------------------------------------------------------------------------
# Sentence by sentence the same ends, kept for every step; a walk back over them says which reference
# tokens are in a subsequence, and tokens of the union count once on either side.

LSUM = r"""sides AS MATERIALIZED (SELECT row_id, model,
    list_filter(list_transform(string_split(regexp_replace(lower(target), '[^a-z0-9\n]+', ' ', 'g'), chr(10)),
      lambda x: list_filter(string_split(x, ' '), lambda t: t <> '')), lambda x: len(x) > 0) AS rl,
    list_filter(list_transform(string_split(regexp_replace(lower(answer), '[^a-z0-9\n]+', ' ', 'g'), chr(10)),
      lambda x: list_filter(string_split(x, ' '), lambda t: t <> '')), lambda x: len(x) > 0) AS hl
  FROM answers),
rt AS MATERIALIZED (SELECT row_id, model, si, unnest(r) AS w, generate_subscripts(r, 1) AS j
  FROM (SELECT row_id, model, unnest(rl) AS r, generate_subscripts(rl, 1) AS si FROM sides)),
ht AS MATERIALIZED (SELECT row_id, model, sj, unnest(h) AS w, generate_subscripts(h, 1) AS i, len(h) AS m
  FROM (SELECT row_id, model, unnest(hl) AS h, generate_subscripts(hl, 1) AS sj FROM sides)),
spots AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY row_id, model, si, sj ORDER BY j) AS step
  FROM (SELECT row_id, model, si, sj, j, max(m) AS m, list(i ORDER BY i) AS p
        FROM rt JOIN ht USING (row_id, model, w) GROUP BY ALL)),
grown AS (
  SELECT DISTINCT row_id, model, si, sj, 0::BIGINT AS step, []::BIGINT[] AS e FROM spots
  UNION ALL
  SELECT x.row_id, x.model, x.si, x.sj, x.step + 1,
    list_transform(e, lambda v, k: coalesce(least(v, list_min(list_filter(p,
        lambda q: q <= v AND q > coalesce(e[k - 1], 0)))), v))
    || CASE WHEN p[-1] > coalesce(e[-1], 0)
       THEN [list_min(list_filter(p, lambda q: q > coalesce(e[-1], 0)))] ELSE [] END
  FROM grown x JOIN spots y ON y.row_id = x.row_id AND y.model = x.model AND y.si = x.si AND y.sj = x.sj
    AND y.step = x.step + 1),
cells AS MATERIALIZED (SELECT s.row_id, s.model, s.si, s.sj, s.step, j, p, g.e AS e, b.e AS up
  FROM spots s JOIN grown g USING (row_id, model, si, sj, step)
  JOIN grown b ON b.row_id = s.row_id AND b.model = s.model AND b.si = s.si AND b.sj = s.sj AND b.step = s.step - 1),
walk AS (
  SELECT row_id, model, si, sj, max(step) AS step, max(m) AS c, NULL::BIGINT AS hit FROM spots GROUP BY ALL
  UNION ALL
  SELECT row_id, model, si, sj, CASE WHEN taken OR NOT lefts THEN step - 1 ELSE step END,
    CASE WHEN taken OR lefts THEN c - 1 ELSE c END, CASE WHEN taken THEN j END
  FROM (SELECT x.*, y.j, list_contains(p, c) AS taken,
          len(list_filter(e, lambda v: v <= x.c - 1)) > len(list_filter(up, lambda v: v <= x.c)) AS lefts
        FROM walk x JOIN cells y USING (row_id, model, si, sj, step) WHERE x.c > 0)),
united AS (SELECT row_id, model, w, count(*) AS n
  FROM (SELECT DISTINCT row_id, model, si, hit AS j FROM walk WHERE hit IS NOT NULL) JOIN rt USING (row_id, model, si, j)
  GROUP BY ALL),
lsum AS (SELECT row_id, model, CASE WHEN hits IS NULL THEN 0.0
    ELSE 2.0 * (hits / hn) * (hits / rn) / (hits / hn + hits / rn) END AS s
  FROM (SELECT row_id, model, len(flatten(rl)) AS rn, len(flatten(hl)) AS hn FROM sides)
  LEFT JOIN (SELECT row_id, model, sum(least(u.n, h.n)) AS hits FROM united u
    JOIN (SELECT row_id, model, w, count(*) AS n FROM ht GROUP BY ALL) h USING (row_id, model, w) GROUP BY ALL)
  USING (row_id, model))"""

# -- METEOR -------------------------------------------------------------------------------

VOWEL = "^(?:[aeiou]|[^aeiou][^aeiouy]*[aeiouy])"
M1 = VOWEL + "[aeiou]*[^aeiou]"
M2 = M1 + "[^aeiouy]*[aeiouy][aeiou]*[^aeiou]"
CVC = "(?:(?:[^aeiouy]|^y|[aeiou]y)[aeiouy][^aeiouwxy]|^[aeiou][^aeiou])$"


def _has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def _tidy(s: str) -> str:
    return f"""CASE WHEN {_has(s, "(at|bl|iz)$")} THEN {s} || 'e'
      WHEN right({s}, 1) = right(left({s}, -1), 1) AND {_has(s, "[^aeiou]$")}
        THEN CASE WHEN {_has(s, "[lsz]$")} THEN {s} ELSE left({s}, -1) END
      WHEN {_has(s, M1)} AND NOT {_has(s, M2)} AND {_has(s, CVC)} THEN {s} || 'e' ELSE {s} END"""


def _swap(rules: str) -> str:
    """Replace the longest suffix listed as ``old:new`` where the stem has measure 1 or more."""
    pairs = [r.split(":") for r in rules.split()]
    cases = " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in pairs)
    stem = "left(w, length(w) - length(x))"
    return f"""SELECT t, CASE WHEN x <> '' AND {_has(stem, M1)}
      THEN {stem} || CASE x {cases} END ELSE w END AS w
    FROM (SELECT *, regexp_extract(w, '(?:{"|".join(old for old, _ in pairs)})$') AS x
          FROM {{source}})"""


_STEP2 = (
    "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e "
    "ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous "
    "aliti:al iviti:ive biliti:ble fulli:ful"
)
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al|ance|ence|er|ic|able|ible|ant|ement|ment|ent|ion|ou|ism|ate|iti|ous|ive|ize"
_IRREGULAR = (
    "sky:sky skies:sky dying:die lying:lie tying:tie news:news innings:inning inning:inning "
    "outings:outing outing:outing cannings:canning canning:canning howe:howe proceed:proceed "
    "exceed:exceed succeed:succeed"
)
_cut = "left(w, -2)"

STEMS = f"""vocab AS (SELECT DISTINCT t, t AS w FROM (
    SELECT unnest(h) AS t FROM tk UNION ALL SELECT unnest(r) FROM tk)),
s1 AS (SELECT t, CASE WHEN {_has("w", "^.ies$")} THEN left(w, -1)
    WHEN {_has("w", "(?:ss|i)es$")} THEN left(w, -2)
    WHEN {_has("w", "[^s]s$")} THEN left(w, -1) ELSE w END AS w FROM vocab),
s2 AS (SELECT t, CASE WHEN {_has("w", "^.ied$")} THEN left(w, -1)
    WHEN w LIKE '%ied' THEN left(w, -2)
    WHEN w LIKE '%eed' THEN CASE WHEN {_has("left(w, -3)", M1)} THEN left(w, -1) ELSE w END
    WHEN w LIKE '%ed' AND {_has("left(w, -2)", VOWEL)} THEN {_tidy("left(w, -2)")}
    WHEN w LIKE '%ing' AND {_has("left(w, -3)", VOWEL)} THEN {_tidy("left(w, -3)")}
    ELSE w END AS w FROM s1),
s3 AS (SELECT t, CASE WHEN {_has("w", ".[^aeiouy]y$|[aeiou]yy$")} THEN left(w, -1) || 'i'
    ELSE w END AS w FROM s2),
s4 AS (SELECT t, CASE WHEN w LIKE '%alli' AND {_has("left(w, -4)", M1)} THEN {_cut}
    ELSE w END AS w FROM s3),
s5 AS (SELECT t, CASE WHEN w LIKE '%logi' THEN CASE WHEN {_has("left(w, -3)", M1)}
    THEN left(w, -1) ELSE w END ELSE y END AS w
  FROM s4 JOIN (SELECT t, w AS y FROM ({_swap(_STEP2).format(source="s4")})) USING (t)),
s6 AS ({_swap(_STEP3).format(source="s5")}),
s7 AS (SELECT t, CASE WHEN x <> '' AND (x <> 'ion' OR {_has("z", "[st]$")}) AND {_has("z", M2)}
    THEN z ELSE w END AS w
  FROM (SELECT *, left(w, length(w) - length(x)) AS z
        FROM (SELECT *, regexp_extract(w, '(?:{_STEP4})$') AS x FROM s6))),
s8 AS (SELECT t, CASE WHEN w LIKE '%e' AND ({_has("left(w, -1)", M2)} OR
    ({_has("left(w, -1)", M1)} AND NOT {_has("left(w, -1)", CVC)})) THEN left(w, -1)
    ELSE w END AS w FROM s7),
s9 AS (SELECT t, CASE WHEN w LIKE '%ll' AND {_has("left(w, -1)", M2)} THEN left(w, -1)
    ELSE w END AS w FROM s8),
stems AS (SELECT t AS w, CASE t {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in (r.split(":") for r in _IRREGULAR.split()))}
    ELSE CASE WHEN length(t) <= 2 THEN t ELSE w END END AS s FROM s9)"""

EXACT = """hp AS (SELECT row_id, model, unnest(h) AS w, generate_subscripts(h, 1) AS i FROM tk),
rp AS (SELECT row_id, model, unnest(r) AS w, generate_subscripts(r, 1) AS i FROM tk),
hk AS (SELECT *, row_number() OVER (PARTITION BY row_id, model, w ORDER BY i DESC) AS k FROM hp),
rk AS (SELECT *, row_number() OVER (PARTITION BY row_id, model, w ORDER BY i DESC) AS k FROM rp),
exact AS MATERIALIZED (SELECT hk.row_id, hk.model, hk.i AS hi, rk.i AS ri
  FROM hk JOIN rk USING (row_id, model, w, k))"""

STEM_STAGE = """hs AS (SELECT hp.row_id, hp.model, hp.i, s FROM hp JOIN stems USING (w)
  ANTI JOIN exact m ON m.row_id = hp.row_id AND m.model = hp.model AND m.hi = hp.i),
rs AS (SELECT rp.row_id, rp.model, rp.i, s FROM rp JOIN stems USING (w)
  ANTI JOIN exact m ON m.row_id = rp.row_id AND m.model = rp.model AND m.ri = rp.i),
hsk AS (SELECT *, row_number() OVER (PARTITION BY row_id, model, s ORDER BY i DESC) AS k FROM hs),
rsk AS (SELECT *, row_number() OVER (PARTITION BY row_id, model, s ORDER BY i DESC) AS k FROM rs),
found AS (SELECT * FROM exact UNION ALL
  SELECT hsk.row_id, hsk.model, hsk.i, rsk.i FROM hsk JOIN rsk USING (row_id, model, s, k))"""

# The words left over after two stages, from the end: each takes the last free one it may stand for.
SYNONYM_STAGE = """hl AS (SELECT hs.* FROM hs ANTI JOIN stemmed m
  ON m.row_id = hs.row_id AND m.model = hs.model AND m.hi = hs.i),
rest AS (SELECT rs.* FROM rs ANTI JOIN stemmed m
  ON m.row_id = rs.row_id AND m.model = rs.model AND m.ri = rs.i),
may AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY row_id, model ORDER BY i DESC) AS step
  FROM (SELECT hl.row_id, hl.model, hl.i, list(DISTINCT rest.i) AS p
        FROM hl JOIN syn ON syn.word = hl.s JOIN rest
          ON rest.row_id = hl.row_id AND rest.model = hl.model AND rest.s = syn.alt GROUP BY ALL)),
picks AS (
  SELECT DISTINCT row_id, model, 0::BIGINT AS step, NULL::BIGINT AS hi, NULL::BIGINT AS ri, []::BIGINT[] AS used FROM may
  UNION ALL
  SELECT row_id, model, step, hi, ri, CASE WHEN ri IS NULL THEN used ELSE used || [ri] END
  FROM (SELECT y.row_id, y.model, y.step, y.i AS hi, x.used,
          list_max(list_filter(y.p, lambda q: NOT list_contains(x.used, q))) AS ri
        FROM picks x JOIN may y ON y.row_id = x.row_id AND y.model = x.model AND y.step = x.step + 1)),
found AS (SELECT * FROM stemmed UNION ALL
  SELECT row_id, model, hi, ri FROM picks WHERE ri IS NOT NULL)"""

EXACT_ONLY = "found AS (SELECT * FROM exact)"

METEOR = """brk AS (SELECT row_id, model, CASE WHEN hi = lag(hi) OVER o + 1 AND ri = lag(ri) OVER o + 1
    THEN 0 ELSE 1 END AS b
  FROM found WINDOW o AS (PARTITION BY row_id, model ORDER BY hi)),
mc AS (SELECT row_id, model, count(*) AS matched, sum(b)::BIGINT AS chunks FROM brk GROUP BY ALL),
me AS (SELECT row_id, model, coalesce(matched, 0) AS matched, coalesce(chunks, 0) AS chunks,
    CASE WHEN matched IS NULL THEN 0.0 ELSE (1 - 0.5 * pow(chunks / matched, 3))
      * (matched / len(h)) * (matched / len(r))
      / (0.9 * (matched / len(h)) + 0.1 * (matched / len(r))) END AS meteor
  FROM tk LEFT JOIN mc USING (row_id, model))"""

METEOR_ROWS = "SELECT row_id, model, matched, chunks, round(meteor, 6) AS meteor FROM me"


# -- word translations --------------------------------------------------------------------

TOGETHER = f"""sw AS (SELECT row_id, unnest({tok_words("source")}) AS f FROM pairs),
tw AS (SELECT row_id, unnest({tok_words("target")}) AS e FROM pairs),
tog AS MATERIALIZED (SELECT row_id, f, e, cf, ce FROM (SELECT row_id, f, count(*) AS cf FROM sw GROUP BY ALL)
  JOIN (SELECT row_id, e, count(*) AS ce FROM tw GROUP BY ALL) USING (row_id))"""


def _em_round(k: int) -> str:
    known = f"(SELECT tog.*, p FROM tog JOIN t{k - 1} USING (f, e))" if k > 1 else "(SELECT *, 1.0::DOUBLE AS p FROM tog)"
    return f"""t{k} AS MATERIALIZED (SELECT f, e, n, n / sum(n) OVER (PARTITION BY f) AS p
  FROM (SELECT f, e, sum(share) AS n FROM (
    SELECT f, e, ce * cf * p / sum(cf * p) OVER (PARTITION BY row_id, e) AS share FROM {known}) GROUP BY ALL))"""


EM_ROUNDS = [_em_round(k) for k in range(1, 6)]


# -- sentences and Treebank words ---------------------------------------------------------

_CLOSING = """["'')\\]}»”’]*"""


def _pieces(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda t: t <> '')"


def _core(x: str) -> str:
    bare = f"regexp_replace(lower({x}), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}.]+$', '', 'g')"
    return f"regexp_replace({bare}, '\\.+$', '')"


ABBREVIATIONS = f"""bits AS (SELECT {_core("piece")} AS word,
    regexp_matches(piece, '(?:^|[^.])\\.{_CLOSING}$')::INT AS period
  FROM (SELECT unnest({_pieces("text")}) AS piece FROM documents)),
seen AS (SELECT word, sum(period)::BIGINT AS a, sum(1 - period)::BIGINT AS b FROM bits GROUP BY word),
short AS MATERIALIZED (SELECT word, a, b, -2 * (a * ln(q) + b * ln(1 - q) - a * ln(0.99::DOUBLE) - b * ln(1 - 0.99::DOUBLE))
    * exp(-k) * (length(word) - k + 1) * pow(k, -b) AS score
  FROM (SELECT *, length(replace(word, '.', ''))::DOUBLE AS k FROM seen
        WHERE a > 0 AND regexp_matches(word, '\\p{{L}}') AND NOT regexp_matches(word, '\\p{{N}}')),
    (SELECT sum(a) / sum(a + b)::DOUBLE AS q FROM seen))"""

_MARKED = f"""parted AS (SELECT row_id, {_pieces("target")} AS t FROM pairs),
ended AS (SELECT row_id, i, x, i = m OR regexp_matches(x, '[?!]{_CLOSING}$')
    OR regexp_matches(x, '\\.{_CLOSING}$') AND NOT regexp_matches(c, '^\\p{{L}}$')
      AND NOT regexp_matches(y, '^\\p{{Ll}}')
      AND NOT (regexp_matches(x, '(?:^|[^.])\\.{_CLOSING}$') AND c IN (SELECT word FROM short WHERE score >= 0.3)) AS stop
  FROM (SELECT row_id, i, len(t) AS m, t[i] AS x, coalesce(t[i + 1], '') AS y, {_core("t[i]")} AS c
        FROM (SELECT row_id, t, unnest(range(1, len(t) + 1)) AS i FROM parted))),
lines AS (SELECT row_id, string_agg(x || CASE WHEN i = m THEN '' WHEN stop THEN chr(10) ELSE ' ' END, '' ORDER BY i) AS marked,
    count(*) FILTER (stop)::BIGINT AS n_sentences
  FROM ended JOIN (SELECT row_id AS r, len(t) AS m FROM parted) ON r = row_id GROUP BY row_id)"""


def _treebank(x: str) -> str:
    q = "''"  # an apostrophe in SQL text
    for old, new in (
        ('(?m)^"', "``"), ("(``)", r" \1 "), (rf"""([ (\[{{<])("|{q}{{2}})""", r"\1 `` "),
        (rf"""(?m)([^.])(\.)([\])}}>"{q}»”’ ]*)$""", r"\1 \2 \3 "), ("([:,])([^0-9])", r" \1 \2"),
        ("(?m)([:,])$", r" \1 "), (r"(\.{2,})", r" \1 "), ("([;@#$%&?!])", r" \1 "),
        (f"([^{q}]){q} ", rf"\1 {q} "), (r"([\]\[(){}<>«»“”„‘’])", r" \1 "), ("(--)", r" \1 "),
        (f"({q}{q})", r" \1 "), ('(")', f" {q}{q} "),
    ):
        x = f"regexp_replace({x}, '{old}', '{new}', 'g')"
    x = f"regexp_replace(' ' || {x} || ' ', '\\s+', '  ', 'g')"
    for old in (
        f"([^{q} ])({q}[sS]|{q}[mM]|{q}[dD]|{q}) ", f"([^{q} ])({q}ll|{q}LL|{q}re|{q}RE|{q}ve|{q}VE|n{q}t|N{q}T) ",
    ):
        x = f"regexp_replace({x}, '{old}', '\\1 \\2 ', 'g')"
    for one, two in (
        ("can", "not"), ("d", f"{q}ye"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"),
        ("more", f"{q}n"), ("wan", "na"), (f"{q}t", "is"), (f"{q}t", "was"),
    ):
        x = f"regexp_replace({x}, '(?i) ({one})({two}) ', ' \\1 \\2 ', 'g')"
    return _pieces(f"lower({x})")


def sql(parts: list[str], select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


SCORED = [PAIRS, PREDS, ANSWERS]
BLEU_PARTS = [*SCORED, tokens(tok_13a), OVERLAP, BLEU]
ROUGE_PARTS = [*SCORED, tokens(tok_rouge), OVERLAP, ROUGE_N]
LEARNED = """syn AS MATERIALIZED (SELECT b.e AS word, a.e AS alt, sum(b.q * a.p) AS p
  FROM (SELECT f, e, n / sum(n) OVER (PARTITION BY e) AS q FROM t5) b
  JOIN (SELECT f, e, p FROM t5 WHERE p >= 0.02) a USING (f)
  WHERE b.q >= 0.02 AND a.e <> b.e GROUP BY ALL HAVING sum(b.q * a.p) >= 0.02)"""
METEOR_PARTS = [*SCORED, tokens(tok_words), STEMS, EXACT, STEM_STAGE, METEOR]


def nested(name: str, parts: list[str], select: str) -> str:
    """Several metrics use the same part names, so each keeps its own scope."""
    return f"{name} AS MATERIALIZED ({sql(parts, select)})"


METRICS = [
    nested("m_acc", SCORED, "SELECT model, avg((answer = target)::INT) AS accuracy FROM answers GROUP BY ALL"),
    nested("m_bleu", BLEU_PARTS, "SELECT *, gm * bp AS bleu FROM bleu"),
    nested("m_meteor", METEOR_PARTS, "SELECT model, avg(meteor) AS meteor FROM me GROUP BY ALL"),
    nested("m_rn", ROUGE_PARTS, "SELECT model, avg(f) FILTER (n = 1) AS rouge1, "
           "avg(f) FILTER (n = 2) AS rouge2 FROM rn GROUP BY ALL"),
    nested("m_rl", [*SCORED, tokens(tok_rouge), ROUGE_L],
           "SELECT model, avg(f) AS rouge_l FROM rl GROUP BY ALL"),
    """metrics AS MATERIALIZED (SELECT model, accuracy, meteor, bleu AS bleu_1, rouge_l
  FROM m_acc JOIN m_meteor USING (model) JOIN m_bleu USING (model) JOIN m_rl USING (model))""",
]

SUMMARY = nested("m_lsum", [*SCORED, LSUM], "SELECT model, avg(s) AS rouge_lsum FROM lsum GROUP BY ALL")

MELTED = """melted AS (SELECT model, variable, value FROM metrics
  UNPIVOT (value FOR variable IN (meteor, bleu_1, rouge_l)))"""

PERF = """perf AS (SELECT * FROM (VALUES
  ('org/copy', 11.5::DOUBLE, 3.25::DOUBLE, 'card A'),
  ('org/half-0.7', 24.0, 7.5, 'card A'),
  ('org/source-bnb-4bit', 0.0, 6.75, 'card B'),
  ('org/swap', 31.25, 9.0, 'card B')) v(model, train_min, eval_min, gpu)),
timed AS (SELECT model, meteor, train_min, eval_min, gpu FROM metrics LEFT JOIN perf USING (model))"""

# -- prompts ------------------------------------------------------------------------------

ASK = f"'{INSTRUCTION}' || chr(10) || source"
CHATML = f"""'<|im_start|>system' || chr(10) || '{SYSTEM_MESSAGE}<|im_end|>' || chr(10)
  || '<|im_start|>user' || chr(10) || {ASK} || '<|im_end|>' || chr(10)
  || '<|im_start|>assistant' || chr(10)"""
_L3 = "'<|start_header_id|>{}<|end_header_id|>' || chr(10) || chr(10)"
LLAMA3 = f"""'<|begin_of_text|>' || {_L3.format("system")} || '{SYSTEM_MESSAGE}<|eot_id|>'
  || {_L3.format("user")} || {ASK} || '<|eot_id|>' || {_L3.format("assistant")}"""
INST = f"'<s>[INST] ' || {ASK} || ' [/INST]'"

FAMILIES = f"""asked AS (
  SELECT row_id, target, 'chatml' AS family, {CHATML} AS prompt, '<|im_end|>' AS eos, '' AS gap FROM pairs
  UNION ALL SELECT row_id, target, 'llama3', {LLAMA3}, '<|eot_id|>', '' FROM pairs
  UNION ALL SELECT row_id, target, 'inst', {INST}, '</s>', ' ' FROM pairs)"""

WIDE = """wide AS (SELECT p.row_id, p.source, p.target,
  max(prediction) FILTER (model = 'org/copy') AS "org/copy",
  max(prediction) FILTER (model = 'org/half-0.7') AS "org/half-0.7",
  max(prediction) FILTER (model = 'org/source-bnb-4bit') AS "org/source-bnb-4bit",
  max(prediction) FILTER (model = 'org/swap') AS "org/swap",
  max(prediction) FILTER (model = 'org/upper(finetuned)') AS "org/upper(finetuned)"
  FROM pairs p JOIN preds USING (row_id) GROUP BY ALL)"""


def split_bucket(column: str, seed: int = 17) -> str:
    key = f"md5('{seed}|' || {column})"
    return f"CASE WHEN CAST('0x' || substr({key}, 1, 8) AS BIGINT) % 10000 < 2000 THEN 'test' ELSE 'train' END"


EXACT_SPLIT = """SELECT doc_id, text, CASE WHEN row_number() OVER (ORDER BY md5('17|' || doc_id), doc_id)
  <= ceil(0.2::DOUBLE * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM documents"""

SHARDED = """SELECT *, CAST('0x' || substr(k, 1, 8) AS BIGINT)
    % (SELECT greatest(1, ceil(count(*) / 128))::BIGINT FROM documents) AS shard
  FROM (SELECT epoch, doc_id, text, md5('3407|' || epoch || '|' || doc_id) AS k
        FROM documents, (SELECT unnest([0, 1]) AS epoch))"""

_na = ", ".join(f"'{t}'" for t in NA_TOKENS)
_weight = " + ".join(f"(u >= {p})::INT" for p in accumulate(exp(-1) / factorial(k) for k in range(7)))


def doc_tokens(tokenize) -> str:
    return f"""SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens
  FROM (SELECT doc_id, {tokenize("text")} AS t FROM documents)"""


ORACLE: dict[str, str] = {
    "tsv_roundtrip": sql([PAIRS, DIRTY], "SELECT * FROM dirty"),
    "csv_roundtrip": sql([PAIRS, PREDS, WIDE], "SELECT * FROM wide"),
    "csv_skip_bad_lines": sql([PAIRS], """SELECT
      CASE WHEN row_id % 3 <> 0 THEN 'good' ELSE 'rejected' END AS kind,
      CASE WHEN row_id % 3 <> 0 THEN row_id END AS row_id,
      CASE WHEN row_id % 3 <> 0 AND row_id % 5 <> 0 THEN field END AS target,
      CASE WHEN row_id % 3 <> 0 AND row_id % 5 <> 0 THEN length(source) END AS size,
      CASE WHEN row_id % 3 = 0 THEN row_id || ',"' || replace(field, '"', '""') || '",x,' END AS line
      FROM (SELECT *, CASE WHEN row_id % 7 = 0 THEN repeat(target || '", "', 120) ELSE target END AS field
            FROM pairs)"""),
    "corpus_ranges": sql([PAIRS], """SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, source, target
      FROM pairs"""),
    "results_ranges": sql([PAIRS, PREDS, WIDE], "SELECT * FROM wide"),
    "splits_scan": sql([PAIRS], f"SELECT *, {split_bucket('row_id')} AS split FROM pairs"),
    "materialize_once": sql([PAIRS], f"SELECT *, {split_bucket('row_id')} AS split FROM pairs"),
    "predictions_store": sql([PAIRS, PREDS], """SELECT row_id, model,
      CASE WHEN model = 'org/swap' THEN source ELSE prediction END AS prediction
      FROM preds JOIN pairs USING (row_id)"""),
    "abbreviations": sql([ABBREVIATIONS], """SELECT word, a AS with_period, b AS without, round(score, 6) AS score
      FROM short WHERE score >= 0.3"""),
    "treebank_words": sql([PAIRS, ABBREVIATIONS, _MARKED], f"""SELECT row_id, n_sentences, len(t) AS n_words,
      array_to_string(t, ' ') AS words FROM (SELECT row_id, n_sentences, {_treebank("marked")} AS t FROM lines)"""),
    "bucketed_upsert": sql([PAIRS, PREDS], """SELECT row_id, model,
        CASE WHEN model = 'org/swap' AND row_id % 2 = 0 THEN source ELSE prediction END AS prediction
        FROM preds JOIN pairs USING (row_id)
      UNION ALL SELECT row_id, 'org/new', target FROM pairs WHERE row_id % 2 = 0"""),
    "bucketed_scores": sql(ROUGE_PARTS, """SELECT row_id, model, round(max(f) FILTER (n = 1), 6) AS rouge1,
      round(max(f) FILTER (n = 2), 6) AS rouge2 FROM rn GROUP BY ALL"""),
    "row_numbers": sql([PAIRS], 'SELECT count(*) AS n, 0::BIGINT AS "first", count(*) - 1 AS "last", '
                       "count(*) AS ids FROM pairs"),
    "numbered_rows": sql([PAIRS], """SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, source, target
      FROM pairs"""),
    "head_rows": sql([PAIRS], "SELECT * FROM pairs ORDER BY row_id LIMIT 10"),
    "nonempty_pairs": sql([PAIRS, DIRTY], "SELECT * FROM dirty WHERE source <> '' AND target <> ''"),
    "na_normalize": sql([PAIRS, DIRTY], f"""SELECT row_id,
      CASE WHEN source NOT IN ({_na}) THEN source END AS source,
      CASE WHEN target NOT IN ({_na}) THEN target END AS target FROM dirty"""),
    "select_models": sql([PAIRS, PREDS, WIDE],
                         'SELECT row_id, source, target, "org/swap", "org/upper(finetuned)" FROM wide'),
    "drop_models_like": sql([PAIRS, PREDS], "SELECT * FROM preds WHERE model NOT LIKE '%bnb-4bit%'"),
    "drop_columns_like": sql([PAIRS, PREDS, WIDE], 'SELECT * EXCLUDE ("org/source-bnb-4bit") FROM wide'),
    "drop_columns": sql([PAIRS], "SELECT * FROM pairs"),
    "rename_column": sql([PAIRS, PREDS], "SELECT row_id, model, prediction AS hypothesis FROM preds"),
    "row_slice": "SELECT doc_id, lang, text FROM documents WHERE doc_id >= 100 AND doc_id < 150",
    "scored_pairs": sql([PAIRS, PREDS], """SELECT row_id, model, target, prediction
      FROM preds JOIN pairs USING (row_id)"""),
    "upsert_predictions": sql([PAIRS, PREDS], """SELECT row_id, model,
      CASE WHEN model = 'org/swap' AND row_id % 2 = 0 THEN source ELSE prediction END AS prediction
      FROM preds JOIN pairs USING (row_id)
      UNION ALL SELECT row_id, 'org/new', target FROM pairs WHERE row_id % 2 = 0"""),
    "coverage_check": sql([PAIRS, PREDS], """SELECT model, (SELECT count(*) FROM pairs) AS expected,
      count(DISTINCT CASE WHEN model = 'org/half-0.7' AND row_id % 5 = 1 AND row_id > 0 THEN NULL
        ELSE row_id END) AS present,
      (SELECT count(*) FROM pairs) - present AS missing,
      count(*) FILTER (model = 'org/swap' AND row_id % 3 = 0) AS duplicates,
      count(*) FILTER (model = 'org/half-0.7' AND row_id % 5 = 1 AND row_id > 0) AS orphans
      FROM preds WHERE model <> 'org/copy' OR row_id % 7 <> 3 GROUP BY model"""),
    "split_counts": f"""SELECT split, count(*) AS n
      FROM (SELECT {split_bucket('doc_id')} AS split FROM documents) GROUP BY ALL""",
    "exact_match": sql(SCORED, """SELECT model, count(*) AS n, sum((answer = target)::INT)::BIGINT AS correct,
      round(avg((answer = target)::INT), 6) AS accuracy FROM answers GROUP BY ALL"""),
    "exact_match_ids": sql(SCORED, "SELECT model, row_id FROM answers WHERE answer = target"),
    "ngram_overlap": sql([*SCORED, tokens(tok_13a), OVERLAP], "SELECT * FROM ov"),
    "bleu_corpus": sql(BLEU_PARTS, "SELECT model, round(gm * bp, 6) AS bleu FROM bleu"),
    "bleu_detail": sql(BLEU_PARTS, f"SELECT model, {BLEU_FIELDS} FROM bleu"),
    "rouge1": sql(ROUGE_PARTS, "SELECT row_id, model, round(f, 6) AS rouge1 FROM rn WHERE n = 1"),
    "rouge2": sql(ROUGE_PARTS, "SELECT row_id, model, round(f, 6) AS rouge2 FROM rn WHERE n = 2"),
    "rouge_l": sql([*SCORED, tokens(tok_rouge), ROUGE_L],
                   'SELECT row_id, model, lcs, round(f, 6) AS "rougeL" FROM rl'),
    "rouge_lsum": sql([*SCORED, tokens(tok_rouge), ROUGE_L, LSUM],
                      """SELECT row_id, model, round(f, 6) AS "rougeL", round(s, 6) AS "rougeLsum"
      FROM rl JOIN lsum USING (row_id, model)"""),
    "rouge_mean": sql(METRICS[3:5], """SELECT model, round(rouge1, 6) AS rouge1,
      round(rouge2, 6) AS rouge2, round(rouge_l, 6) AS "rougeL" FROM m_rn JOIN m_rl USING (model)"""),
    "bootstrap_ci": sql([*ROUGE_PARTS, f"""drawn AS (SELECT model, f, rep, {_weight} AS weight
        FROM (SELECT model, f, rep, CAST('0x' || substr(md5('17|' || rep // 4 || '|' || row_id),
              8 * (rep % 4) + 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
              FROM rn, (SELECT unnest(range(0, 1000)) AS rep) WHERE n = 1)),
      means AS (SELECT model, rep, sum(weight * f) / sum(weight) AS v FROM drawn GROUP BY ALL)"""],
        """SELECT model, round(mean, 6) AS mean, round(quantile_cont(v, 0.025), 6) AS low,
        round(quantile_cont(v, 0.5), 6) AS mid, round(quantile_cont(v, 0.975), 6) AS high
        FROM means JOIN (SELECT model, avg(f) AS mean FROM rn WHERE n = 1 GROUP BY ALL) USING (model)
        GROUP BY model, mean"""),
    "meteor_pairs": sql([*SCORED, tokens(tok_words), EXACT, EXACT_ONLY, METEOR], METEOR_ROWS),
    "meteor_stem": sql(METEOR_PARTS, METEOR_ROWS),
    "meteor_corpus": sql(METEOR_PARTS, "SELECT model, round(avg(meteor), 6) AS meteor FROM me GROUP BY ALL"),
    "metrics_report": sql(METRICS, """SELECT model, round(accuracy, 6) AS accuracy,
      round(meteor, 6) AS meteor, round(bleu_1, 6) AS bleu_1, round(rouge_l, 6) AS rouge_l FROM metrics"""),
    "metrics_struct": sql([*METRICS, SUMMARY], f"""SELECT model, round(accuracy, 6) AS accuracy,
      round(meteor, 6) AS meteor, round(bleu, 6) AS bleu, {BLEU_FIELDS},
      round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2, round(rouge_l, 6) AS "rougeL",
      round(rouge_lsum, 6) AS "rougeLsum"
      FROM metrics JOIN m_bleu USING (model) JOIN m_rn USING (model) JOIN m_lsum USING (model)"""),
    "metrics_merged": sql([*METRICS, SUMMARY], f"""SELECT model, round(accuracy, 6) AS accuracy,
      round(meteor, 6) AS meteor, round(bleu, 6) AS bleu, {BLEU_FIELDS},
      round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2, round(rouge_l, 6) AS "rougeL",
      round(rouge_lsum, 6) AS "rougeLsum"
      FROM metrics JOIN m_bleu USING (model) JOIN m_rn USING (model) JOIN m_lsum USING (model)"""),
    "word_translations": sql([PAIRS, TOGETHER, *EM_ROUNDS], """SELECT f, e, round(n, 6) AS n, round(p, 6) AS p
      FROM t5 WHERE n >= 0.5"""),
    "learned_synonyms": sql([PAIRS, TOGETHER, *EM_ROUNDS, LEARNED],
                            "SELECT word, alt, round(p, 6) AS p FROM syn"),
    "meteor_synonym": sql([*SCORED, TOGETHER, *EM_ROUNDS, LEARNED, tokens(tok_words), STEMS, EXACT,
                           STEM_STAGE.replace("found AS", "stemmed AS"), SYNONYM_STAGE, METEOR], METEOR_ROWS),
    "metrics_describe": sql(METRICS, "\nUNION ALL ".join(
        f"SELECT '{name}' AS statistic, " + ", ".join(
            f"round({form.format(c=c)}, 6) AS {c}" for c in ("accuracy", "meteor", "bleu_1", "rouge_l")
        ) + " FROM metrics"
        for name, form in (
            ("count", "count({c})::DOUBLE"), ("mean", "avg({c})"), ("std", "stddev_samp({c})"),
            ("min", "min({c})"), ("25%", "quantile_cont({c}, 0.25)"),
            ("50%", "quantile_cont({c}, 0.5)"), ("75%", "quantile_cont({c}, 0.75)"), ("max", "max({c})"),
        ))),
    "score_quantiles": sql(ROUGE_PARTS, """SELECT model, 'rouge' || o AS variable, count(*) AS n,
      round(avg(f), 6) AS mean, round(stddev_samp(f), 6) AS std, round(min(f), 6) AS min, round(max(f), 6) AS max,
      round(quantile_cont(f, 0.25), 6) AS q25, round(quantile_cont(f, 0.5), 6) AS q50,
      round(quantile_cont(f, 0.75), 6) AS q75
      FROM (SELECT model, n AS o, f FROM rn) GROUP BY model, o"""),
    "metrics_melt": sql([*METRICS, MELTED], "SELECT model, variable, round(value, 6) AS value FROM melted"),
    "chart_frame": sql([*METRICS, MELTED], """SELECT model, variable, round(value, 6) AS value,
      CASE variable WHEN 'meteor' THEN 'METEOR' WHEN 'bleu_1' THEN 'BLEU-1' ELSE 'ROUGE-L' END AS label,
      printf('%.2f', value) AS value_text FROM melted WHERE value <> 0"""),
    "perf_report": sql([*METRICS, PERF], """SELECT model, round(meteor, 6) AS meteor, train_min, eval_min,
      gpu, split_part(model, '/', -1) AS model_name FROM timed"""),
    "stacked_bounds": sql([*METRICS, PERF], """SELECT model, round(meteor, 6) AS meteor, series, value,
      round(bottom, 6) AS bottom, round(bottom + value, 6) AS top, printf('%.2f', value) AS value_text
      FROM (SELECT model, meteor, 'train_min' AS series, train_min AS value, 0.0::DOUBLE AS bottom FROM timed
            UNION ALL SELECT model, meteor, 'eval_min', eval_min, coalesce(train_min, 0) FROM timed)
      WHERE value <> 0"""),
    "split_exact": EXACT_SPLIT,
    "split_hash": f"SELECT doc_id, text, {split_bucket('doc_id')} AS split FROM documents",
    "split_partition_check": f"""WITH s AS ({EXACT_SPLIT}) SELECT
      (SELECT count(*) FROM (SELECT doc_id FROM s WHERE split = 'train' INTERSECT
                             SELECT doc_id FROM s WHERE split = 'test')) AS in_both,
      (SELECT count(*) FROM documents ANTI JOIN s USING (doc_id)) AS lost,
      (SELECT count(*) FROM s ANTI JOIN documents USING (doc_id)) AS invented""",
    "training_shuffle": f"""SELECT epoch, shard, doc_id, text,
      row_number() OVER (PARTITION BY epoch, shard ORDER BY k, doc_id) AS position FROM ({SHARDED})""",
    "training_shards": f"SELECT epoch, shard, doc_id, text, k AS shuffle_key FROM ({SHARDED})",
    "extract_answer": sql([PAIRS, FAMILIES], f"""SELECT row_id, family,
      {extracted("prompt || gap || target || eos")} AS answer FROM asked"""),
    "extract_answer_legacy": sql([PAIRS, FAMILIES], f"""SELECT row_id, family,
      {extracted_legacy("prompt || gap || target || eos")} AS answer FROM asked"""),
    "prompt_render": sql([PAIRS], f"SELECT row_id, {ASK} AS prompt FROM pairs"),
    "message_list": sql([PAIRS], f"""SELECT row_id, 'org/Qwen2-0.5B' AS model, 0::BIGINT AS place,
      'system' AS role, '{SYSTEM_MESSAGE}' AS content FROM pairs
      UNION ALL SELECT row_id, 'org/Qwen2-0.5B', 1, 'user', {ASK} FROM pairs
      UNION ALL SELECT row_id, 'org/Mistral-7B', 0, 'user', {ASK} FROM pairs"""),
    "chat_render": sql([PAIRS, FAMILIES], "SELECT row_id, family, prompt FROM asked"),
    "training_text": sql([PAIRS, FAMILIES], "SELECT row_id, family, prompt || target || eos AS text FROM asked"),
    "conversation_render": f"""SELECT conv_id, turn,
        CASE WHEN turn = min(turn) OVER w THEN '<|begin_of_text|>' ELSE '' END
        || {_L3.replace("{}<|end", "' || role || '<|end")} || text || '<|eot_id|>'
        || CASE WHEN turn = max(turn) OVER w THEN {_L3.format("assistant")} ELSE '' END AS text
      FROM conversations WINDOW w AS (PARTITION BY conv_id)""",
    "model_basename": sql([PAIRS, PREDS], """SELECT model, split_part(model, '/', -1) AS model_name,
      count(*) AS n FROM preds GROUP BY ALL"""),
    "tokenize_13a": doc_tokens(tok_13a),
    "tokenize_rouge": doc_tokens(tok_rouge),
    "tokenize_words": doc_tokens(tok_words),
    "ngrams": f"""WITH w AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i
        FROM (SELECT doc_id, {tok_rouge("text")} AS t FROM documents)),
      g1 AS (SELECT doc_id, i, w AS g, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4
        FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
      g AS (SELECT doc_id, i, unnest([1, 2, 3, 4]) AS n,
        unnest([g, g || ' ' || w2, g || ' ' || w2 || ' ' || w3, g || ' ' || w2 || ' ' || w3 || ' ' || w4]) AS g
        FROM g1)
      SELECT d.doc_id, o.n::BIGINT AS n, count(g.g) AS n_grams, md5(coalesce(string_agg(g.g, '|' ORDER BY g.i), '')) AS digest
      FROM documents d CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS n) o
      LEFT JOIN g ON g.doc_id = d.doc_id AND g.n = o.n GROUP BY d.doc_id, o.n""",
    "length_cap": f"""SELECT doc_id, len(t) AS n_tokens, len(t) > 512 AS truncated,
      array_to_string(t[1:512], ' ') AS capped
      FROM (SELECT doc_id, {tok_words("text")} AS t FROM documents)""",
    "unpivot_predictions": sql([PAIRS, PREDS], "SELECT row_id, model, prediction FROM preds"),
    "pivot_predictions": sql([PAIRS, PREDS, WIDE], "SELECT * FROM wide"),
    "map_batches": "SELECT doc_id, len(string_split(text, ' ')) AS n_words FROM documents",
    "batch_generate": sql([PAIRS], f"""SELECT row_id, 'org/echo' AS model,
      {extracted(CHATML + " || source || '<|im_end|>'")} AS prediction FROM pairs"""),
    "generate_resumed": sql([PAIRS], f"""SELECT row_id, 'org/echo' AS model,
      {extracted(CHATML + " || source || '<|im_end|>'")} AS prediction FROM pairs"""),
}
ORACLE["metrics_wide"] = ORACLE["metrics_report"]
