"""The same queries in SQL, for a second engine to check the results against."""

from labelsense.functions.stopwords import REVIEW_BLACKLIST, stop_words
from labelsense.functions.text import JOINED_WORDS, SENTENCE_PATTERN, TOKEN_PATTERN
from labelsense.operators.lemmas import IRREGULAR_VERBS, LEXICON_SHARE, VERB_ENDINGS
from labelsense.operators.sentences import CLOSING, FIRST_TOKEN, LAST_TOKEN, OPENING, TOKEN


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(words) -> str:
    return ", ".join(quoted(w) for w in words)


def tokens(text: str, marks: bool) -> str:
    pattern = TOKEN_PATTERN + (r"|--|\.{2,}|''|[^\s\p{Z}]" if marks else "")
    clitic = r"(?i)(n't|'(?:s|m|d|ll|re|ve))$"
    endings = f"""flatten(list_transform(regexp_extract_all(replace({text}, '--', ' -- '), {quoted(pattern)}),
        lambda t: CASE WHEN contains(t, '''') THEN list_filter(
            [regexp_replace(t, {quoted(clitic)}, ''), regexp_extract(t, {quoted(clitic)}, 1)], lambda p: p <> '')
          ELSE [t] END))"""
    return f"""flatten(list_transform({endings}, lambda t: CASE
          WHEN lower(t) IN ({in_list(JOINED_WORDS)}) THEN [substr(t, 1, 3), substr(t, 4, 3)] ELSE [t] END))"""


STOP = in_list(stop_words(REVIEW_BLACKLIST))


def described(token: str) -> str:
    """Columns type, stop, dots, capital and small of a token."""
    bare = f"regexp_replace(regexp_replace({token}, {quoted(OPENING)}, ''), {quoted(CLOSING)}, '')"
    return f"""regexp_replace(lower({bare}), '\\.+$', '') AS type, ends_with({bare}, '.') AND NOT ends_with({bare}, '..') AS stop,
      ends_with({bare}, '..') AS dots, regexp_matches({bare}, '^\\p{{Lu}}') AS capital, regexp_matches({bare}, '^\\p{{Ll}}') AS small"""


def times(x: str, p: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN ({x}) * ln({p}) ELSE 0 END)"


def association(a: str, b: str, both: str, n: str) -> str:
    p, p1, p2 = f"({b})::DOUBLE / {n}", f"({both})::DOUBLE / {a}", f"({b} - {both})::DOUBLE / nullif({n} - {a}, 0)"
    counts = [both, f"{a} - {both}", f"{b} - {both}", f"{n} - {a} - {b} + {both}"]
    found = " + ".join(times(c, q) for c, q in zip(counts, [p1, f"1 - {p1}", p2, f"1 - {p2}"], strict=True))
    chance = " + ".join(times(c, q) for c, q in zip(counts, [p, f"1 - {p}", p, f"1 - {p}"], strict=True))
    return f"round(2 * (({found}) - ({chance})), 6)"


LETTERS = "length(replace(type, '.', ''))"
SENTENCE_MODEL = f"""tokens AS (
      SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, {quoted(TOKEN)})) AS token FROM documents) GROUP BY token),
    types AS MATERIALIZED (
      SELECT type, sum(n) AS n, coalesce(sum(n) FILTER (stop), 0) AS stops, coalesce(sum(n) FILTER (dots), 0) AS dotted,
        coalesce(sum(n) FILTER (capital), 0) AS capitals, coalesce(sum(n) FILTER (small), 0) AS smalls
      FROM (SELECT n, {described("token")} FROM tokens) GROUP BY type),
    total AS (SELECT sum(n) AS n, sum(stops)::DOUBLE / sum(n) AS rate FROM types),
    abbreviations AS MATERIALIZED (
      SELECT * FROM (
        SELECT type, round(2 * (stops * ln(0.99::DOUBLE) + others * ln(1 - 0.99::DOUBLE)
            - ({times("stops", "rate")} + {times("others", "1 - rate")}))
          * exp(-{LETTERS}::DOUBLE - others * ln({LETTERS})) * (length(type) - {LETTERS} + 1), 6) AS score
        FROM (SELECT type, stops, types.n - stops - dotted AS others, rate FROM types, total WHERE stops > 0)
        WHERE regexp_matches(type, '\\p{{L}}')) WHERE score >= 0.3),
    pieces AS MATERIALIZED (SELECT doc_id, regexp_extract_all(text, {quoted(SENTENCE_PATTERN)}) AS p FROM documents),
    borders AS (
      SELECT doc_id, CASE WHEN i = 1 THEN '' ELSE regexp_extract(p[i - 1], {quoted(LAST_TOKEN)}, 1) END AS before,
        regexp_extract(p[i], {quoted(FIRST_TOKEN)}, 1) AS after
      FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM pieces)),
    pairs AS MATERIALIZED (
      SELECT before, after, n, b.*, a.type AS next, a.capital AS next_capital, a.small AS next_small FROM (
        SELECT before, after, n, (SELECT x FROM (SELECT {described("before")}) x) AS b, (SELECT y FROM (SELECT {described("after")}) y) AS a
        FROM (SELECT before, after, count(*) AS n FROM borders GROUP BY ALL))),
    judged AS MATERIALIZED (
      SELECT *, type IN (SELECT type FROM abbreviations) AS abbreviated, regexp_full_match(type, '\\p{{L}}') AS initial,
        regexp_full_match(type, '[0-9]+') AS number FROM pairs),
    firsts AS (
      SELECT next AS type,
        sum(n) FILTER (NOT dots AND before <> '' AND (NOT stop OR NOT (abbreviated OR initial OR number))) AS after_end,
        sum(n) FILTER (next_capital) AS capitals_first, sum(n) FILTER (next_small AND before <> '') AS smalls_first
      FROM judged GROUP BY next),
    joined AS MATERIALIZED (
      SELECT types.*, coalesce(after_end, 0) AS after_end, coalesce(capitals_first, 0) AS capitals_first,
        coalesce(smalls_first, 0) AS smalls_first FROM types LEFT JOIN firsts USING (type)),
    ends AS (SELECT sum(after_end) AS e FROM joined),
    starters AS MATERIALIZED (
      SELECT * FROM (
        SELECT type, {association("e", "joined.n", "after_end", "total.n")} AS score FROM joined, ends, total
        WHERE after_end > 0 AND regexp_full_match(type, '\\p{{L}}+') AND after_end * total.n > joined.n * e) WHERE score >= 30),
    collocations AS (
      SELECT * FROM (
        SELECT c.type, c.next, {association("t.stops", "u.n", "c.both_", "total.n")} AS score
        FROM (SELECT type, next, sum(n) AS both_ FROM judged
              WHERE stop AND (initial OR number) AND regexp_full_match(next, '\\p{{L}}+') GROUP BY ALL) c
        JOIN types t ON t.type = c.type JOIN types u ON u.type = c.next, total
        WHERE c.both_ * total.n > u.n * t.stops) WHERE score >= 7.88),
    inner_marks AS MATERIALIZED (
      SELECT before, after FROM (
        SELECT j.*, coalesce(k.capitals > 0, false) AS u, coalesce(k.smalls > 0, false) AS l,
          coalesce(k.capitals > k.capitals_first, false) AS u_inside, coalesce(k.smalls_first > 0, false) AS l_first,
          next_capital AND l AND NOT u_inside AS begins,
          c.type IS NOT NULL AS collocation, j.next IN (SELECT type FROM starters) AS starter
        FROM judged j LEFT JOIN joined k ON k.type = j.next LEFT JOIN collocations c ON c.type = j.type AND c.next = j.next
        WHERE before <> '' AND (stop OR dots) AND (abbreviated OR dots OR initial OR number))
      WHERE CASE WHEN collocation THEN true
        WHEN (initial OR number) AND NOT dots AND NOT abbreviated
          THEN (next_small AND (u OR NOT l_first)) OR (initial AND next_capital AND NOT l AND NOT begins)
        ELSE NOT begins AND NOT starter END),
    sentence_counts AS (
      SELECT doc_id, (len(any_value(p)) - count(before))::INT AS n_sentences
      FROM pieces LEFT JOIN (SELECT doc_id, before FROM borders JOIN inner_marks USING (before, after)) USING (doc_id)
      GROUP BY doc_id)"""


def words_cte(stop: bool = False) -> str:
    """docs(doc_id, lang, w): one row per document and word."""
    dropped = f"AND w NOT IN ({STOP})" if stop else ""
    return f"""docs AS MATERIALIZED (
      SELECT DISTINCT doc_id, lang, w
      FROM (SELECT doc_id, lang, unnest({tokens("lower(text)", False)}) AS w FROM documents)
      WHERE regexp_full_match(w, '\\p{{L}}+') {dropped}),
    df AS MATERIALIZED (SELECT w AS word, count(*) AS n FROM docs GROUP BY w),
    common AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) - 1 AS rank FROM df)"""


def words_query(select: str, stop: bool = False) -> str:
    return f"WITH {words_cte(stop)} {select}"


def coverage(source: str, label: str, threshold: float) -> str:
    return f"""c AS (SELECT {label} AS l, count(*) AS n FROM {source} WHERE {label} IS NOT NULL GROUP BY {label}),
    o AS (SELECT l, n, row_number() OVER (ORDER BY n DESC, l) - 1 AS rank,
            coalesce(sum(n) OVER (ORDER BY n DESC, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
            sum(n) OVER () AS total FROM c),
    kept AS (SELECT * FROM o WHERE rank < (SELECT count(*) FROM o WHERE before <= {threshold}::DOUBLE * total) + 1)"""


def similar_pairs(source: str, k: int) -> str:
    return f"""v AS (SELECT p_name AS v, count(*) AS n FROM {source} GROUP BY p_name)
    SELECT a.v AS value_1, b.v AS value_2, levenshtein(a.v, b.v)::INT AS distance, a.n AS count_1, b.n AS count_2
    FROM v a JOIN v b ON a.v < b.v ORDER BY distance, value_1, value_2 LIMIT {k}"""


def box(measure: str, lengths: str) -> str:
    return f"""WITH x AS ({lengths}),
    q AS (SELECT min(v)::DOUBLE AS mn, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS md,
            quantile_cont(v, 0.75) AS q3, max(v)::DOUBLE AS mx FROM x)
    SELECT '{measure}' AS measure, mn AS "min", q1, md AS median, q3, mx AS "max",
      (SELECT min(v) FROM x WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))::DOUBLE AS whisker_low,
      (SELECT max(v) FROM x WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))::DOUBLE AS whisker_high
    FROM q"""


def spearman(source: str, *names: str) -> str:
    def one(a, b):
        return f"""SELECT '{a}' AS column_1, '{b}' AS column_2, round(corr(ra, rb), 6) AS correlation, count(*) AS n_rows
        FROM (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra,
                     rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb
              FROM (SELECT {a}::DOUBLE AS a, {b}::DOUBLE AS b FROM {source}) WHERE a IS NOT NULL AND b IS NOT NULL)"""

    return " UNION ALL ".join(one(a, b) for i, a in enumerate(names) for b in names[i + 1 :])


def lemmas(lexicon: str) -> str:
    """Lemmas of the words in ``df``; those of its words that meet the condition may be base forms."""
    return (
        """cand AS (SELECT word, rule, stem FROM ("""
        + " UNION ALL ".join(
            f"SELECT word, {i} AS rule, left(word, length(word) - {len(old)}) || '{new}' AS stem FROM df "
            f"WHERE ends_with(word, '{old}') AND length(word) > {len(old)}"
            for i, (old, new) in enumerate(VERB_ENDINGS)
        )
        + f""") WHERE stem IN (SELECT word FROM df{lexicon})),
    odd(word, lemma) AS (VALUES """
        + ", ".join(f"({quoted(f)}, {quoted(b)})" for f, b in IRREGULAR_VERBS.items())
        + """),
    lemmas AS (
      SELECT word, arg_min(stem, length(stem) * 100 + rule) AS lemma FROM cand
      WHERE word NOT IN (SELECT word FROM odd) GROUP BY word
      UNION ALL SELECT word, lemma FROM odd WHERE word IN (SELECT word FROM df))"""
    )


LEMMAS = lemmas(f" WHERE n >= {LEXICON_SHARE}::DOUBLE * (SELECT count(*) FROM documents)")
ALL_LEMMAS = lemmas("")

SHARED = """ix AS (
      SELECT v, row_number() OVER (ORDER BY count(*) DESC, v) - 1 AS i
      FROM (SELECT o_orderpriority AS v FROM orders UNION ALL SELECT o_orderstatus FROM orders)
      WHERE v IS NOT NULL GROUP BY v)"""

BALANCED = """WITH b AS (SELECT doc_id, lang, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT % 4096 AS bucket FROM documents),
    r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY bucket, doc_id) AS rn,
            count(*) OVER (PARTITION BY lang) AS c FROM b),
    t AS (SELECT *, (SELECT max(c) FROM r) AS m FROM r)
    SELECT doc_id, lang, unnest(range(1, (m // c + CASE WHEN rn <= m % c THEN 1 ELSE 0 END + 1)::BIGINT))::INT AS copy FROM t"""

SIMILARITY = """cen AS (
      SELECT label, list(m ORDER BY d) AS cv
      FROM (SELECT label, d, avg(x) AS m
            FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings)
            GROUP BY label, d) GROUP BY label),
    sim AS (SELECT CASE WHEN vec_id < 10 THEN 'c' ELSE 'v' END || vec_id AS word, 'c' || cen.label AS label,
              round(list_cosine_similarity(embedding::DOUBLE[], cv), 9) AS s FROM embeddings, cen),
    ord AS (SELECT 'c' || label AS label, row_number() OVER (ORDER BY count(*) DESC, 'c' || label) - 1 AS lo
            FROM embeddings GROUP BY label)"""


def nearest(sign: str) -> str:
    return f"""WITH {SIMILARITY}, r AS (
      SELECT label, word, {sign}s AS s, row_number() OVER (PARTITION BY label ORDER BY {sign}s DESC, word) AS rank
      FROM sim{"" if sign else " WHERE word <> label"})
    SELECT label, rank::INT AS rank, word, round(s, 6) AS similarity FROM r WHERE rank <= 10"""


def interleaved(name: str, direction: str) -> str:
    return f"""{name}_place AS (
      SELECT word, min(place * 1000000 + lo) AS k
      FROM (SELECT label, word, row_number() OVER (PARTITION BY label ORDER BY s {direction}, word) - 1 AS place FROM sim)
      JOIN ord USING (label) WHERE place < 200 AND word NOT IN (SELECT label FROM ord) GROUP BY word),
    {name} AS (SELECT row_number() OVER (ORDER BY k, word) - 1 AS rank, word FROM {name}_place)"""


JUDGED = """j AS (SELECT doc_id, quality AS label, (n_chars > 1000)::INT AS prediction
      FROM documents JOIN labels USING (doc_id))"""


def scored(source: str, weight: str = "1.0") -> str:
    """accuracy, f1 over a table with label and prediction."""
    return f"""(SELECT sum(CASE WHEN label = prediction THEN {weight} END) / sum({weight}) AS accuracy FROM {source}) a,
    (SELECT sum(actual * 2 * coalesce(hit, 0) / (actual + coalesce(predicted, 0))) / sum(actual) AS f1
     FROM (SELECT label AS v, sum({weight}) AS actual, sum(CASE WHEN label = prediction THEN {weight} END) AS hit
           FROM {source} GROUP BY label)
     LEFT JOIN (SELECT prediction AS v, sum({weight}) AS predicted FROM {source} GROUP BY prediction) USING (v)) f"""


ROUNDED = "round(accuracy, 6) AS accuracy, round(f1, 6) AS f1"

def bucket(key: str, n: int, salt: str) -> str:
    return f"(('0x' || substr(md5({key}::VARCHAR || '{salt}'), 1, 15))::BIGINT % {n})"


BAYES = f"""WITH dw AS (
      SELECT DISTINCT doc_id, w
      FROM (SELECT doc_id, unnest({tokens("lower(text)", False)}) AS w
            FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
      WHERE regexp_full_match(w, '\\p{{L}}+')),
    every AS (SELECT doc_id, quality AS c, {bucket("doc_id", 1000, "split")} < 900 AS train
              FROM documents JOIN labels USING (doc_id)),
    d AS (SELECT doc_id, c FROM every WHERE train),
    vocab AS (SELECT w FROM dw JOIN d USING (doc_id) GROUP BY w ORDER BY count(*) DESC, w LIMIT 50),
    cls AS (SELECT c, count(*) AS n FROM d GROUP BY c),
    hits AS (SELECT doc_id, w FROM dw WHERE w IN (SELECT w FROM vocab)),
    p AS (SELECT cls.c, vocab.w, (count(h.doc_id) + 1.0) / (cls.n + 2.0) AS p
          FROM cls CROSS JOIN vocab
          LEFT JOIN (SELECT d.c, hits.w, hits.doc_id FROM hits JOIN d USING (doc_id)) h ON h.c = cls.c AND h.w = vocab.w
          GROUP BY cls.c, vocab.w, cls.n),
    base AS (SELECT p.c, sum(ln(1 - p)) + any_value(ln(cls.n + 1.0) - ln((SELECT count(*) FROM d) + (SELECT count(*) FROM cls))) AS s
             FROM p JOIN cls USING (c) GROUP BY p.c),
    gain AS (SELECT hits.doc_id, p.c, sum(ln(p) - ln(1 - p)) AS g FROM hits JOIN p USING (w) GROUP BY hits.doc_id, p.c),
    held AS (SELECT doc_id, c FROM every WHERE NOT train),
    total AS (SELECT held.doc_id, held.c AS label, base.c AS c, base.s + coalesce(g, 0) AS s
              FROM held CROSS JOIN base LEFT JOIN gain ON gain.doc_id = held.doc_id AND gain.c = base.c),
    best AS (SELECT doc_id, label, arg_max(c, s) AS prediction FROM total GROUP BY doc_id, label)
    SELECT label, prediction, count(*)::DOUBLE AS n FROM best GROUP BY label, prediction"""


def grid_scores(amount: str, prefix: str) -> str:
    """Columns accuracy and f1 of (l, f, label, prediction, n, w), by n or by w."""
    return f"""SELECT l, f, sum(hit) / sum(actual) AS {prefix}accuracy,
        sum(actual * 2 * hit / nullif(actual + predicted, 0)) / sum(actual) AS {prefix}f1
      FROM (SELECT l, f, v, sum(actual) AS actual, sum(predicted) AS predicted, sum(hit) AS hit FROM (
        SELECT l, f, label AS v, {amount} AS actual, 0.0 AS predicted, CASE WHEN label = prediction THEN {amount} ELSE 0 END AS hit FROM pairs
        UNION ALL SELECT l, f, prediction, 0.0, {amount}, 0 FROM pairs) GROUP BY ALL) GROUP BY l, f"""


def bayes_grid(test: str) -> str:
    """Scores (l, f, ...) of naive Bayes with the first l words, trained on the rows of every fold but f.

    ``test`` gives the fold of a row of which all scores are taken; rows of fold -1 are never trained on.
    """
    return f"""dw AS MATERIALIZED (
      SELECT DISTINCT doc_id, w
      FROM (SELECT doc_id, unnest({tokens("lower(text)", False)}) AS w
            FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
      WHERE regexp_full_match(w, '\\p{{L}}+')),
    every AS MATERIALIZED (SELECT doc_id, quality AS c, {test} AS fold,
        1.0::DOUBLE / ((SELECT count(DISTINCT quality) FROM documents JOIN labels USING (doc_id)) * count(*) OVER (PARTITION BY quality)) AS weight
      FROM documents JOIN labels USING (doc_id)),
    vocab AS MATERIALIZED (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) AS r FROM dw GROUP BY w ORDER BY r LIMIT 50),
    lengths AS (SELECT unnest(range(5, 51, 5)) AS l),
    f AS (SELECT unnest([-1, 0, 1, 2]) AS f),
    d AS (SELECT f, doc_id, c FROM f JOIN every ON fold <> f AND fold >= 0),
    cls AS MATERIALIZED (SELECT f, c, count(*) AS n FROM d GROUP BY f, c),
    hits AS MATERIALIZED (SELECT doc_id, w, r FROM dw JOIN vocab USING (w)),
    p AS MATERIALIZED (
      SELECT cls.f, cls.c, vocab.w, r, (coalesce(k, 0) + 1.0::DOUBLE) / (n + 2.0::DOUBLE) AS p
      FROM cls CROSS JOIN vocab
      LEFT JOIN (SELECT d.f, d.c, hits.w, count(*) AS k FROM hits JOIN d USING (doc_id) GROUP BY ALL) h
        ON h.f = cls.f AND h.c = cls.c AND h.w = vocab.w),
    base AS (
      SELECT p.f, p.c, l, sum(ln(1 - p)) + any_value(ln(cls.n + 1.0) - ln(t.n + t.m)) AS s
      FROM p JOIN lengths ON r <= l JOIN cls ON cls.f = p.f AND cls.c = p.c
      JOIN (SELECT f, sum(n) AS n, count(*) AS m FROM cls GROUP BY f) t ON t.f = p.f GROUP BY p.f, p.c, l),
    gain AS (SELECT doc_id, p.f, p.c, l, sum(ln(p) - ln(1 - p)) AS g
      FROM hits JOIN every USING (doc_id) JOIN p ON p.w = hits.w AND p.f = every.fold JOIN lengths ON hits.r <= l GROUP BY ALL),
    guesses AS (
      SELECT every.doc_id, every.fold AS f, every.c AS label, weight, base.l, arg_max(base.c, base.s + coalesce(g, 0)) AS prediction
      FROM every JOIN base ON base.f = every.fold
      LEFT JOIN gain ON gain.doc_id = every.doc_id AND gain.c = base.c AND gain.l = base.l GROUP BY ALL),
    pairs AS MATERIALIZED (SELECT l, f, label, prediction, count(*)::DOUBLE AS n, sum(weight) AS w FROM guesses GROUP BY ALL),
    scores AS (SELECT * FROM ({grid_scores("n", "")}) JOIN ({grid_scores("w", "weighted_")}) USING (l, f))"""


METRICS = ["accuracy", "f1", "weighted_accuracy", "weighted_f1"]
FOLD = bucket("doc_id", 3, "fold")


def oracle_sql() -> dict[str, str]:
    return {
        "label_counts": """SELECT p_name, count(*) AS count, round(count(*) / (SELECT count(*) FROM part), 6) AS fraction
            FROM part WHERE p_name IS NOT NULL GROUP BY p_name""",
        "common_labels": f"WITH {coverage('part', 'p_name', 0.9)} SELECT rank, l AS p_name, n AS count FROM kept",
        "uniqueness": " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, count(*) AS n_rows, count(DISTINCT coalesce({c}, '')) AS n_unique,
            count(*) - count(DISTINCT coalesce({c}, '')) AS n_duplicates FROM documents"""
            for c in ("text", "lang", "source")
        ),
        "missing": " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_missing
            FROM documents LEFT JOIN labels USING (doc_id)"""
            for c in ("text", "quality", "toxic")
        ),
        "label_mentions": """SELECT count(*) FILTER (contains(text, lang)) AS n_mentions, count(*) AS n_rows FROM documents""",
        "duplicate_texts": """SELECT doc_id, lang, n AS n_copies
            FROM (SELECT doc_id, lang, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1""",
        "similar_labels": f"WITH {similar_pairs('part', 40)}",
        "similar_common_labels": f"""WITH {coverage("part", "p_name", 0.9)},
            p AS (SELECT p_name FROM part WHERE p_name IN (SELECT l FROM kept)), {similar_pairs("p", 10)}""",
        "length_summary": box("n_words", f"SELECT len({tokens('text', True)}) AS v FROM documents"),
        "sentence_summary": f"""WITH w AS ({box("n_words", f"SELECT len({tokens('text', True)}) AS v FROM documents")}),
            s AS ({box("n_sentences", f"SELECT len(regexp_extract_all(text, {quoted(SENTENCE_PATTERN)})) AS v FROM documents")})
            SELECT * FROM w UNION ALL SELECT * FROM s""",
        "sentence_abbreviations": f"""WITH {SENTENCE_MODEL}
            SELECT 'abbreviation' AS kind, type, round(score, 4) AS score FROM abbreviations
            UNION ALL SELECT 'starter', type, round(score, 4) FROM starters""",
        "learned_sentences": f"WITH {SENTENCE_MODEL} SELECT doc_id, n_sentences FROM sentence_counts",
        "learned_sentence_summary": f"WITH {SENTENCE_MODEL}, z AS ({box('n_sentences', 'SELECT n_sentences AS v FROM sentence_counts')}) SELECT * FROM z",
        "spearman": spearman("lineitem", "l_extendedprice", "l_quantity", "l_discount"),
        "length_spearman": f"""WITH x AS MATERIALIZED (SELECT n_chars, quality, len({tokens("text", True)}) AS n_words
            FROM documents LEFT JOIN labels USING (doc_id)) """
        + spearman("x", "n_chars", "quality", "n_words"),
        "clean_documents": f"""WITH r AS (SELECT doc_id, lower(text) AS t, lower(lang) AS lang FROM documents WHERE lang IS NOT NULL),
            d AS (SELECT min(doc_id) AS doc_id, t, lang FROM r GROUP BY t, lang), {coverage("d", "lang", 0.6)}
            SELECT doc_id, lang, md5(replace(t, lang, 'variety')) AS text_md5 FROM d WHERE lang IN (SELECT l FROM kept)""",
        "drop_duplicates": """SELECT doc_id, lower(lang) AS lang, lower(source) AS source, n_chars
            FROM documents WHERE lang IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY lower(text), lower(lang) ORDER BY doc_id) = 1""",
        "mask_label": "SELECT doc_id, md5(replace(text, lang, 'variety')) AS text_md5 FROM documents",
        "top_words": words_query("SELECT rank, word, n AS count FROM common WHERE rank < 50"),
        "document_frequency": words_query("SELECT word, n AS count FROM df"),
        "vocabulary": words_query("SELECT word FROM df"),
        "exploded_words": words_query("SELECT doc_id, lang, w AS word FROM docs"),
        "token_counts": f"SELECT doc_id, len({tokens('text', True)})::INT AS n_tokens FROM documents",
        "stop_word_filter": f"""SELECT doc_id, len(list_filter({tokens("lower(text)", False)},
            lambda x: x NOT IN ({STOP})))::INT AS n_kept FROM documents""",
        "lemma_table": words_query(f", {LEMMAS} SELECT word, lemma FROM lemmas"),
        "lemmatised_words": words_query(
            f""", {ALL_LEMMAS} SELECT word, count(*) AS count
            FROM (SELECT DISTINCT doc_id, coalesce(lemma, w) AS word FROM docs LEFT JOIN lemmas ON lemmas.word = docs.w)
            GROUP BY word""",
            stop=True,
        ),
        "pair_sentences": words_query(
            """SELECT doc_id, md5(coalesce(replace(string_agg(w, chr(1) ORDER BY w), chr(1), ' ' || lang || ' '), '')) AS sentence_md5
            FROM documents LEFT JOIN (SELECT doc_id, w FROM docs) USING (doc_id) GROUP BY doc_id, lang"""
        ),
        "word_vector": words_query(
            "SELECT doc_id, rank::INT AS position FROM docs JOIN common ON word = w WHERE rank < 100"
        ),
        "word_list": words_query(
            """SELECT d.doc_id, coalesce(tracked, '') AS tracked FROM documents d LEFT JOIN (
              SELECT doc_id, string_agg(w, ' ' ORDER BY rank) AS tracked
              FROM docs JOIN common ON word = w WHERE rank < 100 GROUP BY doc_id) USING (doc_id)"""
        ),
        "encoded_words": words_query(
            """SELECT doc_id, string_agg(rank::VARCHAR, ',' ORDER BY rank) AS indices
            FROM docs JOIN common ON word = w WHERE rank < 100 GROUP BY doc_id"""
        ),
        "all_encoded_words": words_query(
            """SELECT documents.doc_id, coalesce(string_agg(rank::VARCHAR, ',' ORDER BY rank), '') AS indices
            FROM documents LEFT JOIN (SELECT doc_id, rank FROM docs JOIN common ON word = w) e USING (doc_id) GROUP BY documents.doc_id"""
        ),
        "stored_word_set": words_query("SELECT 'common' AS strategy, rank, word FROM common WHERE rank < 200"),
        "label_mode": """SELECT o_orderpriority AS prediction, (SELECT count(*) FROM orders) AS n FROM orders
            GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 1""",
        "majority_accuracy": f"""WITH top AS (SELECT lang FROM documents GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1),
            p AS (SELECT lang AS label, (SELECT lang FROM top) AS prediction FROM documents)
            SELECT {ROUNDED} FROM {scored("p")}""",
        "label_index": """SELECT p_name AS value, count(*) AS count, (row_number() OVER (ORDER BY count(*) DESC, p_name) - 1)::DOUBLE AS label
            FROM part GROUP BY p_name""",
        "indexed_parts": """WITH i AS (SELECT p_brand, (row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1)::DOUBLE AS label
            FROM part GROUP BY p_brand) SELECT p_partkey, p_brand, label FROM part JOIN i USING (p_brand)""",
        "shared_index": f"""WITH {SHARED} SELECT o_orderkey, p.i::DOUBLE AS priority, s.i::DOUBLE AS status
            FROM orders JOIN ix p ON p.v = o_orderpriority JOIN ix s ON s.v = o_orderstatus""",
        "table_index": f"""WITH {SHARED} SELECT o_orderkey, p.i::DOUBLE AS priority, s.i::DOUBLE AS status
            FROM orders JOIN ix p ON p.v = o_orderpriority JOIN ix s ON s.v = o_orderstatus""",
        "shared_one_hot": f"""WITH {SHARED}, n AS (SELECT count(*)::INT AS width FROM ix)
            SELECT o_orderkey, 'priority' AS column_name, width, i AS position FROM n, orders JOIN ix ON v = o_orderpriority
            UNION ALL
            SELECT o_orderkey, 'status' AS column_name, width, i AS position FROM n, orders JOIN ix ON v = o_orderstatus""",
        "balanced_labels": BALANCED,
        "class_weights": """SELECT source, round(1.0::DOUBLE / (count(*) OVER () * count(*)), 9) AS weight
            FROM documents GROUP BY source""",
        "weighted_documents": """WITH w AS (SELECT lang, round(1.0::DOUBLE / (count(*) OVER () * count(*)), 9) AS weight
            FROM documents GROUP BY lang) SELECT doc_id, lang, weight FROM documents JOIN w USING (lang)""",
        "similarity": f"WITH {SIMILARITY} SELECT word, label, round(s, 6) AS similarity FROM sim",
        "nearest_words": nearest(""),
        "opposite_words": nearest("-"),
        "similar_words": f"WITH {SIMILARITY}, {interleaved('near', 'DESC')} SELECT rank, word FROM near",
        "dissimilar_words": f"WITH {SIMILARITY}, {interleaved('far', 'ASC')} SELECT rank, word FROM far",
        "extreme_words": f"""WITH {SIMILARITY}, {interleaved("near", "DESC")}, {interleaved("far", "ASC")},
            z AS (SELECT word, min(place) AS place
                  FROM (SELECT word, rank * 2 AS place, rank FROM near UNION ALL SELECT word, rank * 2 + 1, rank FROM far)
                  WHERE rank < least((SELECT count(*) FROM near), (SELECT count(*) FROM far)) GROUP BY word)
            SELECT row_number() OVER (ORDER BY place) - 1 AS rank, word FROM z""",
        "nearest_lists": f"""WITH {SIMILARITY} SELECT side, label, word, round(s, 6) AS similarity, place FROM (
              SELECT 1 AS side, *, (row_number() OVER (PARTITION BY label ORDER BY s DESC, word) - 1)::INT AS place FROM sim
              UNION ALL
              SELECT -1, *, (row_number() OVER (PARTITION BY label ORDER BY s, word) - 1)::INT FROM sim)
            WHERE place < CASE side WHEN 1 THEN 3600 ELSE 1400 END""",
        "low_entropy_words": f"""WITH {SIMILARITY},
            p AS (SELECT word, (s + 1) / sum(s + 1) OVER (PARTITION BY word) AS p FROM sim),
            e AS (SELECT word, round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln((SELECT count(*) FROM cen)), 12) AS e
                  FROM p WHERE word NOT IN (SELECT label FROM ord) GROUP BY word)
            SELECT row_number() OVER (ORDER BY e, word) - 1 AS rank, word, round(e, 6) AS entropy FROM e""",
        "split": f"""SELECT doc_id, CASE WHEN {bucket("doc_id", 1000, "split")} < 900 THEN 'train' ELSE 'test' END AS part
            FROM documents""",
        "folds": f"SELECT doc_id, {bucket('doc_id', 3, 'fold')}::INT AS fold FROM documents",
        "sampled_lines": f"SELECT o_orderkey FROM orders WHERE {bucket('o_orderkey', 1000000, 'sample')} < 10000",
        "confusion": f"""WITH {JUDGED} SELECT label, prediction, count(*)::DOUBLE AS n FROM j GROUP BY label, prediction""",
        "f1": f"WITH {JUDGED} SELECT {ROUNDED} FROM {scored('j')}",
        "weighted_f1": f"""WITH {JUDGED}, k AS (
              SELECT j.*, 1.0::DOUBLE / ((SELECT count(DISTINCT label) FROM j) * count(*) OVER (PARTITION BY label)) AS weight FROM j)
            SELECT {ROUNDED} FROM {scored("k", "weight")}""",
        "score_report": f"""WITH {JUDGED} SELECT round(accuracy * 100, 1) AS accuracy_percent, round(f1, 4) AS f1
            FROM {scored("j")}""",
        "vs_baseline": f"""WITH {JUDGED}, b AS (SELECT label,
              (SELECT label FROM j GROUP BY label ORDER BY count(*) DESC, label LIMIT 1) AS prediction FROM j)
            SELECT 'model' AS name, {ROUNDED} FROM {scored("j")}
            UNION ALL SELECT 'majority' AS name, {ROUNDED} FROM {scored("b")}""",
        "bayes_score": BAYES,
        "bayes_grid": f"""WITH {bayes_grid(FOLD)}
            SELECT l::INT AS "limit", {", ".join(f"round(avg({m}), 6) AS {m}" for m in METRICS)} FROM scores GROUP BY l""",
        "held_out_bayes": f"""WITH {bayes_grid(f"CASE WHEN {bucket('doc_id', 1000, 'split')} < 900 THEN {FOLD} ELSE -1 END")},
            best AS (SELECT l FROM scores WHERE f >= 0 GROUP BY l ORDER BY round(avg(accuracy), 9) DESC, l LIMIT 1)
            SELECT l::INT AS "limit", {", ".join(f"round({m}, 6) AS {m}" for m in METRICS)}
            FROM scores WHERE f = -1 AND l = (SELECT l FROM best)""",
        "majority_scored_documents": f"""WITH d AS (
              SELECT doc_id, lang, {bucket("doc_id", 1000, "split")} < 900 AS train FROM documents)
            SELECT doc_id, (SELECT lang FROM d WHERE train GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1) AS predicted_lang
            FROM d WHERE NOT train""",
        "csv_documents": "SELECT doc_id, md5(text) AS text_md5, lang, n_chars FROM documents",
        "stored_metrics": f"""WITH {JUDGED}, s AS (
              SELECT lang, source, avg((label = prediction)::INT) AS a FROM j JOIN documents USING (doc_id) GROUP BY lang, source)
            SELECT lang, round(max(a), 6) AS best_accuracy, round(avg(a), 6) AS mean_accuracy FROM s GROUP BY lang""",
    }
