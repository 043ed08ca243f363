"""Quality rules: a table of thresholds compiled into one projection of counts and ratios.

Every count is a built-in expression over the whole text, row by row; nothing is shuffled and no
Python runs. A rule compares ``percent * count`` with ``bound * base`` in whole numbers, so Spark
and SQL agree to the last row.

Words are runs of characters other than space, tab, line feed, vertical tab, form feed and return.

Defined results: a null or empty text has no words and fails the base rules, a text without lines
that hold a word has no repeated lines, equal rows get equal results, an empty table gives an empty
table, and other columns of the input are left as they are. Columns of the input that bear the name
of a result are replaced.
"""

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

# The most frequent function words of the languages the corpus is made for.
STOP_WORDS = (
    "the of and to in is that it for was on are as with by at be this from or an not "
    "der die das und ist in den von zu mit sich des auf für im dem nicht ein eine als auch es an "
    "le la les de des et est un une du que qui dans pour pas sur au par plus avec il elle "
    "el los las del y que en una por con no se su para es al lo como más o"
).split()


@dataclass(frozen=True)
class Rule:
    """Keeps a text if ``low`` <= 100 * count / base <= ``high``; a bound of None is not tested.

    A base below ``least`` is too small for the ratio to say anything, and passes.
    """

    name: str
    count: str
    base: str
    low: int | None = None
    high: int | None = None
    least: int = 0


#: Thresholds in hundredths of the base, after the published rules for web text.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 200, 1500),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 10),
    Rule("exclamations_per_word", "n_exclamations", "n_words", None, 30),
    Rule("upper_case_letters", "n_upper", "n_letters", None, 50),
    Rule("words_with_letters", "n_letter_words", "n_words", 80, None, 50),
    Rule("stop_words", "n_stop_words", "n_words", 2, None, 50),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 30, 10),
)
MIN_WORDS, MAX_REPEATED = 10, 20


def _held(table: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once, whatever the number of their uses.

    A plain projection may be merged into the next one, inside its loops even; a generator is not.
    """
    return table.select("*", F.inline_outer(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, for expressions that name it inside a loop."""
    return F.get(F.transform(F.array(value), use), 0)


def _repeated_words(windows: Column) -> Column:
    """Number of words in windows that occur twice or more, from the hashes of all windows in order."""
    placed = F.array_sort(F.transform(windows, lambda hash_, i: F.struct(hash_.alias("h"), i.alias("i"))))
    equal = _with(
        placed,
        lambda p: F.filter(
            p, lambda w, i: w["h"].eqNullSafe(F.get(p, i - 1)["h"]) | w["h"].eqNullSafe(F.get(p, i + 1)["h"])
        ),
    )
    covered = F.aggregate(
        F.sort_array(F.transform(equal, lambda w: w["i"])),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda sum_, i: F.struct(
            (sum_["n"] + F.least(F.lit(WINDOW), i - sum_["last"])).alias("n"), i.alias("last")
        ),
        lambda sum_: sum_["n"],
    )
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), covered).otherwise(F.lit(0).cast("bigint"))


COUNTS = (
    "n_words word_chars n_symbols n_exclamations n_upper n_letters n_letter_words n_stop_words "
    "n_lines n_dup_lines n_repeat_words"
).split()


def measured_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the counts that the rules use, each a bigint."""
    docs = docs.drop(*[c for c in COUNTS if c != text])
    body = F.coalesce(F.col(text), F.lit(""))
    table = _held(
        docs,
        _words=F.array_remove(F.split(body, WHITE), ""),
        _lines=F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
    )
    table = _held(table, _hashes=F.transform("_words", lambda word: F.xxhash64(word)))
    last = F.size("_hashes") - WINDOW + 1
    table = _held(
        table,
        _windows=F.transform(
            F.slice("_hashes", F.lit(1), F.greatest(last, F.lit(0))),
            lambda hash_, i: F.xxhash64(hash_, *[F.get("_hashes", i + k) for k in range(1, WINDOW)]),
        ),
    )
    counts = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.array_join("_words", "")),
        "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)),
        "n_exclamations": F.regexp_count(body, F.lit("!")),
        "n_upper": F.length(F.regexp_replace(body, r"\P{Lu}+", "")),
        "n_letters": F.length(F.regexp_replace(body, r"\P{L}+", "")),
        "n_letter_words": F.size(F.filter("_words", lambda word: word.rlike(r"\p{L}"))),
        "n_stop_words": F.size(F.filter("_words", lambda word: F.lower(word).isin(STOP_WORDS))),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": _repeated_words(F.col("_windows")),
    }
    kept = [F.col(c) for c in docs.columns]
    return table.select(*kept, *[counts[name].cast("bigint").alias(name) for name in COUNTS])


def _passes(rule: Rule) -> Column:
    value, base = 100 * F.col(rule.count), F.col(rule.base)
    tests = []
    if rule.low is not None:
        tests.append(value >= rule.low * base)
    if rule.high is not None:
        tests.append(value <= rule.high * base)
    return (base < rule.least) | reduce(and_, tests)


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows with their counts, ``base_failed``, ``failed_rules`` (names) and ``kept``."""
    table = measured_texts(docs, text).drop("base_failed", "failed_rules", "kept")
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(~_passes(rule), F.lit(rule.name)) for rule in rules]))
    return (
        table.withColumns({"base_failed": base_failed, "failed_rules": failed.cast("array<string>")})
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )


def kept_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows that pass, with the columns they came with."""
    names = [f"_in{i}" for i in range(len(docs.columns))]
    held = docs.toDF(*names)
    passed = judged(held, rules, names[docs.columns.index(text)]).filter("kept")
    return passed.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("failed_rules", ",").alias("failed_rules"),
    )


def _sql_rules() -> str:
    tests = []
    for rule in RULES:
        parts = []
        if rule.low is not None:
            parts.append(f"100 * {rule.count} >= {rule.low} * {rule.base}")
        if rule.high is not None:
            parts.append(f"100 * {rule.count} <= {rule.high} * {rule.base}")
        tests.append(f"CASE WHEN {rule.base} >= {rule.least} AND NOT ({' AND '.join(parts)}) THEN '{rule.name}' END")
    return f"list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL)"


_STOP_SQL = ", ".join(f"'{word}'" for word in dict.fromkeys(STOP_WORDS))
_LEADS = " || ".join(f"chr(10) || lead(word, {k}) OVER w" for k in range(1, WINDOW))
COUNTS_SQL = rf"""
split AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS body,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT row_id, i, word || {_LEADS} AS gram
  FROM (SELECT row_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM split)
  WINDOW w AS (PARTITION BY row_id ORDER BY i)),
repeated AS (
  SELECT row_id, count(DISTINCT p) AS n FROM (
    SELECT row_id, unnest(range(i, i + {WINDOW})) AS p
    FROM (SELECT *, count(*) OVER (PARTITION BY row_id, gram) AS times FROM grams WHERE gram IS NOT NULL)
    WHERE times > 1)
  GROUP BY row_id),
counts AS (
  SELECT split.row_id, doc_id, len(words)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(body, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    len(regexp_extract_all(body, '!'))::BIGINT AS n_exclamations,
    len(regexp_extract_all(body, '\p{{Lu}}'))::BIGINT AS n_upper,
    len(regexp_extract_all(body, '\p{{L}}'))::BIGINT AS n_letters,
    len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}')))::BIGINT AS n_letter_words,
    len(list_filter(words, lambda x: lower(x) IN ({_STOP_SQL})))::BIGINT AS n_stop_words,
    len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(repeated.n, 0)::BIGINT AS n_repeat_words
  FROM split LEFT JOIN repeated USING (row_id)),
judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
    {_sql_rules()} AS failed
  FROM counts)"""

ORACLE = f"""WITH {COUNTS_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND len(failed) = 0 AS kept, coalesce(array_to_string(failed, ','), '') AS failed_rules
FROM judged"""
