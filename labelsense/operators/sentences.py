"""Sentence ends, with abbreviations, sentence starters and collocations learned from the texts.

A full stop after an abbreviation ends no sentence, unless what follows says so. What is an
abbreviation is learned without a list, by the method of Kiss and Strunk (2006), from counts alone:

* A word type is an abbreviation if its full stops are far more frequent than chance allows, by a
  likelihood ratio, scaled up for inner full stops and down for length and for every occurrence
  without one.
* A type is a sentence starter if it follows sure sentence ends far more often than chance allows.
* An initial or a number and the type after its full stop are a collocation by the same test; there is
  no sentence end between them.
* Letter case counts where the texts have it: a capital of a type that is written small elsewhere, and
  never with a capital inside a sentence, begins a sentence; a small letter of a type that also has
  capitals, or never follows a mark, begins none. In lower-case texts the other rules decide.

Tokens are counted before they are taken apart, so the patterns run once per distinct token. A model
is four tables, of which one has a row per type; all that a text is asked for is joined by token, so
no list is held by the driver or a stage.
"""

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelsense.functions.text import SENTENCE_PATTERN
from labelsense.operators.scale import lookup_join, stored

SPACE = r" \t\n\x0B\f\r"
TOKEN = f"[^{SPACE}]+"
LAST_TOKEN = f"([^{SPACE}]+)[{SPACE}]*$"
FIRST_TOKEN = f"^[{SPACE}]*([^{SPACE}]+)"
SPACES, OTHER_SPACES = " \t\n\x0b\f\r", "\t\n\x0b\f\r"
OPENING = r"""^["'“”‘’«»(\[{]+"""
CLOSING = r"""["'“”‘’«»)\]},;:?!]+$"""

# Fixed values of the published method: likelihood of a full stop after an abbreviation, and limits.
ABBREVIATION_RATE, ABBREVIATION_LIMIT, STARTER_LIMIT, COLLOCATION_LIMIT = 0.99, 0.3, 30.0, 7.88


@dataclass
class SentenceModel:
    """``abbreviations`` (type, score), ``starters`` (type, score), ``collocations`` (type, next, score),
    ``cases`` (type, capital, small, capital_inside, small_first: whether it was seen so)."""

    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame
    cases: DataFrame

    def write(self, path: str) -> None:
        for field in fields(self):
            getattr(self, field.name).write.mode("overwrite").parquet(f"{path}/{field.name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "SentenceModel":
        return cls(*[spark.read.parquet(f"{path}/{field.name}") for field in fields(cls)])


SEPARATOR = "[\u0085\u2028\u2029]"
# The characters of both patterns.
_OPENING, _CLOSING = """"'“”‘’«»([{""", """"'“”‘’«»)]},;:?!"""


def _bare(token: Column) -> Column:
    """What ``OPENING`` and ``CLOSING`` leave of a token; to a pattern a last line separator is behind the end."""
    plain = F.rtrim(F.ltrim(token, F.lit(_OPENING)), F.lit(_CLOSING))
    matched = F.regexp_replace(F.regexp_replace(token, OPENING, ""), CLOSING, "")
    return F.when(token.rlike(SEPARATOR), matched).otherwise(plain)


def _described(token: Column) -> list[Column]:
    """Type of a token, whether it ends in one full stop, in several, and whether its first letter is a capital."""
    bare = _bare(token)
    return [
        F.when(token.rlike(SEPARATOR), F.regexp_replace(F.lower(bare), r"\.+$", ""))
        .otherwise(F.rtrim(F.lower(bare), F.lit("."))).alias("type"),
        (F.endswith(bare, F.lit(".")) & ~F.endswith(bare, F.lit(".."))).alias("stop"),
        F.endswith(bare, F.lit("..")).alias("dots"),
        bare.rlike(r"^\p{Lu}").alias("capital"),
        bare.rlike(r"^\p{Ll}").alias("small"),
    ]


def _pieces(text: Column) -> Column:
    """What lies between marks that may end a sentence."""
    return F.regexp_extract_all(text, F.lit(SENTENCE_PATTERN), F.lit(0))


def _end_token(piece: Column, side: int) -> Column:
    """The first token (1) or the last (-1) of a piece without white space at that end.

    Cut at a space first; a pattern that ends in ``$`` would be tried at every character of the piece.
    """
    short = F.substring_index(piece, " ", side)
    return F.substring_index(F.translate(short, OTHER_SPACES, " " * len(OTHER_SPACES)), " ", side)


def _borders(text: Column) -> Column:
    """An array of the tokens before and after each place where a sentence may end; place 0 is the text's start."""
    pieces = _pieces(text)
    before = F.concat(F.array(F.lit("")), F.transform(pieces, lambda p: _end_token(F.rtrim(p, F.lit(SPACES)), -1)))
    after = F.transform(pieces, lambda p: _end_token(p, 1))
    both = F.arrays_zip(after.alias("after"), F.slice(before, F.lit(1), F.size(pieces)).alias("before"))
    return F.transform(both, lambda b, i: F.struct(b["before"].alias("before"), b["after"].alias("after"), i.alias("place")))


def _times(x: Column, p: Column) -> Column:
    return F.when(x > 0, x * F.ln(p)).otherwise(F.lit(0.0))


def association(a: Column, b: Column, both: Column, n: Column) -> Column:
    """Log-likelihood ratio of two events with counts ``a`` and ``b`` that came together ``both`` times of ``n``."""
    p, p1, p2 = b / n, both / a, (b - both) / F.nullif(n - a, F.lit(0))
    rest = n - a - b + both
    found = _times(both, p1) + _times(a - both, 1 - p1) + _times(b - both, p2) + _times(rest, 1 - p2)
    chance = _times(both, p) + _times(a - both, 1 - p) + _times(b - both, p) + _times(rest, 1 - p)
    return F.round(2 * (found - chance), 6)


def abbreviation_score(stops: Column, others: Column, type_: Column, rate: Column) -> Column:
    """Likelihood ratio of the full stops of a type, scaled by inner full stops, length and other uses.

    ``rate``: share of all tokens that end in a full stop.
    """
    letters = F.length(F.replace(type_, F.lit("."), F.lit("")))
    inner = F.length(type_) - letters + 1
    chance = _times(stops, rate) + _times(others, 1 - rate)
    found = stops * F.ln(F.lit(ABBREVIATION_RATE)) + others * F.ln(F.lit(1 - ABBREVIATION_RATE))
    scale = F.exp(-letters.cast("double") - others * F.ln(letters))
    return F.round(2 * (found - chance) * scale * inner, 6)


def _sure_end(token: Column, described: dict[str, Column], known: Column) -> Column:
    """A question or exclamation mark, or one full stop after what is no abbreviation, initial or number."""
    type_ = described["type"]
    return ~described["dots"] & (~described["stop"] | ~(known | _initial(type_) | _number(type_))) & (token != "")


def _initial(type_: Column) -> Column:
    return type_.rlike(r"^\p{L}$")


def _number(type_: Column) -> Column:
    return type_.rlike(r"^[0-9]+$")


def _pair_counts(borders: DataFrame) -> DataFrame:
    """Distinct pairs of tokens around possible ends, described."""
    pairs = borders.groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))
    struct = lambda c: F.struct(*_described(F.col(c)))
    return pairs.select("before", "after", "n", struct("before").alias("b"), struct("after").alias("a"))


def bordered(df: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """Rows with the key ``_row`` and ``_borders``, cut once for learning from texts and for counting in them."""
    return stored(df.select(*keep, F.monotonically_increasing_id().alias("_row"), _borders(F.col(text)).alias("_borders")))


def learn(df: DataFrame, text: str = "text", known: list[str] = (), rows: DataFrame | None = None) -> SentenceModel:
    """A model of the texts. ``known`` names further abbreviations, in lower case, without the last full stop.

    ``rows`` are the same texts ``bordered``, if they are cut already.
    """
    spark = df.sparkSession
    tokens = df.select(F.explode_outer(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))).alias("token"))
    counted = tokens.groupBy("token").agg(F.count("token").alias("n")).filter("n > 0")
    amount = lambda flag: F.sum(F.when(flag, F.col("n")).otherwise(0))
    types = stored(
        counted.select("n", *_described(F.col("token"))).groupBy("type").agg(
            F.sum("n").alias("n"), amount(F.col("stop")).alias("stops"), amount(F.col("dots")).alias("dotted"),
            amount(F.col("capital")).alias("capitals"), amount(F.col("small")).alias("smalls"),
        )
    )
    total, all_stops = types.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("stops"), F.lit(0))).first()
    score = abbreviation_score(
        F.col("stops"), F.col("n") - F.col("stops") - F.col("dotted"), F.col("type"), F.lit(all_stops / max(1, total))
    )
    abbreviations = types.filter(F.col("stops") > 0).filter(F.col("type").rlike(r"\p{L}")).select("type", score.alias("score"))
    abbreviations = abbreviations.filter(F.col("score") >= ABBREVIATION_LIMIT)
    if known:
        more = spark.createDataFrame([(name, None) for name in known], "type string, score double")
        abbreviations = abbreviations.unionByName(more).groupBy("type").agg(F.max("score").alias("score"))
    abbreviations = stored(abbreviations)

    cut = df.select(_borders(F.col(text)).alias("_borders")) if rows is None else rows
    borders = cut.select(F.explode_outer("_borders").alias("_b")).select("_b.before", "_b.after")
    pairs = stored(_pair_counts(borders.filter("after is not null")))
    flagged = _with_flag(pairs, abbreviations.select(F.col("type").alias("_type")), F.col("b.type") == F.col("_type"), "abbreviated")
    flagged = flagged.withColumn("sure", _sure_end(F.col("before"), {c: F.col(f"b.{c}") for c in ("type", "stop", "dots")}, F.col("abbreviated")))
    sure = lambda flag: F.sum(F.when(flag, F.col("n")).otherwise(0))
    firsts = stored(
        flagged.groupBy(F.col("a.type").alias("type")).agg(
            sure(F.col("sure")).alias("after_end"), sure(F.col("a.capital")).alias("capitals_first"),
            sure(F.col("a.small") & (F.col("before") != "")).alias("smalls_first"),
        )
    )
    joined = stored(types.join(firsts, "type", "left").na.fill(0, ["after_end", "capitals_first", "smalls_first"]))
    ends = joined.agg(F.coalesce(F.sum("after_end"), F.lit(0))).first()[0]
    n = F.lit(total)
    starters = joined.filter((F.col("after_end") > 0) & F.col("type").rlike(r"^\p{L}+$")).filter(
        F.col("after_end") * n > F.col("n") * F.lit(ends)
    )
    starters = starters.select("type", association(F.lit(ends), F.col("n"), F.col("after_end"), n).alias("score"))

    loose = flagged.filter(F.col("b.stop") & (_initial(F.col("b.type")) | _number(F.col("b.type"))))
    loose = loose.groupBy(F.col("b.type").alias("type"), F.col("a.type").alias("next")).agg(F.sum("n").alias("both"))
    loose = stored(loose.filter(F.col("next").rlike(r"^\p{L}+$")))
    # Only the types that are asked for are measured, not all of them.
    before, after = loose.select("type").distinct(), loose.select("next").distinct()
    stops = types.select("type", "stops").join(before, "type", "left_semi")
    amounts = types.select(F.col("type").alias("next"), F.col("n").alias("_n")).join(after, "next", "left_semi")
    loose = lookup_join(loose, stops, ["type"], salt_on=["next"])
    loose = lookup_join(loose, amounts, ["next"], salt_on=["type"])
    loose = loose.filter(F.col("both") * n > F.col("_n") * F.col("stops"))
    collocations = loose.select("type", "next", association(F.col("stops"), F.col("_n"), F.col("both"), n).alias("score"))
    return SentenceModel(
        abbreviations,
        stored(starters.filter(F.col("score") >= STARTER_LIMIT)),
        stored(collocations.filter(F.col("score") >= COLLOCATION_LIMIT)),
        stored(joined.select(
            "type", (F.col("capitals") > 0).alias("capital"), (F.col("smalls") > 0).alias("small"),
            (F.col("capitals") > F.col("capitals_first")).alias("capital_inside"), (F.col("smalls_first") > 0).alias("small_first"),
        )),
    )


def _with_flag(rows: DataFrame, table: DataFrame, on: Column, name: str) -> DataFrame:
    """The rows with a column that says whether the table, whose keys are distinct, has their key."""
    keys = [c for c in table.columns if c.startswith("_")]
    joined = rows.join(table.withColumn("_met", F.lit(True)), on, "left")
    return joined.withColumn(name, F.coalesce("_met", F.lit(False))).drop("_met", *keys)


def inner_marks(borders: DataFrame, model: SentenceModel) -> DataFrame:
    """Of all pairs (before, after) of tokens, those between which no sentence ends."""
    type_ = F.col("b.type")
    pairs = _pair_counts(borders).filter((F.col("before") != "") & (F.col("b.stop") | F.col("b.dots")))
    pairs = _with_flag(pairs, model.abbreviations.select(F.col("type").alias("_type")), type_ == F.col("_type"), "abbreviated")
    special = F.col("abbreviated") | F.col("b.dots") | _initial(type_) | _number(type_)
    pairs = stored(pairs.filter(special))
    pairs = _with_flag(pairs, model.starters.select(F.col("type").alias("_type")), F.col("a.type") == F.col("_type"), "starter")
    pairs = _with_flag(
        pairs, model.collocations.select(F.col("type").alias("_type"), F.col("next").alias("_next")),
        (type_ == F.col("_type")) & (F.col("a.type") == F.col("_next")), "collocation",
    )
    cases = model.cases.select(*[F.col(c).alias(f"_{c}") for c in model.cases.columns])
    pairs = pairs.join(cases, F.col("a.type") == F.col("_type"), "left")
    seen = lambda c: F.coalesce(f"_{c}", F.lit(False))
    begins = F.col("a.capital") & seen("small") & ~seen("capital_inside")
    goes_on = F.col("a.small") & (seen("capital") | ~seen("small_first"))
    loose = (_initial(type_) | _number(type_)) & ~F.col("b.dots")
    name = _initial(type_) & F.col("a.capital") & ~seen("small")
    inner = (
        F.when(F.col("collocation"), True)
        .when(loose & ~F.col("abbreviated"), goes_on | (name & ~begins))
        .otherwise(~begins & ~F.col("starter"))
    )
    return pairs.filter(inner).select("before", "after")


def _marked(rows: DataFrame, model: SentenceModel) -> DataFrame:
    """The places (``_row``, ``place``) of marks inside a sentence of ``bordered`` rows."""
    stops = F.filter("_borders", lambda b: b["before"].contains(".") & (b["place"] > 0))
    places = rows.select("_row", F.explode_outer(stops).alias("_b")).select("_row", "_b.before", "_b.after", "_b.place")
    places = places.filter("place is not null")
    return lookup_join(places, inner_marks(places, model), ["before", "after"], salt_on=["_row", "place"])


def _kept(keep: list[str]) -> list[Column]:
    return [F.col(c).alias(f"_in{i}") for i, c in enumerate(keep)]


def with_sentence_counts(df: DataFrame, text: str, model: SentenceModel, keep: list[str], name: str = "n_sentences") -> DataFrame:
    """The columns ``keep`` and the number of sentences; null for a null text, 0 for one without a word."""
    return _counted(bordered(df, text, _kept(keep)), model, keep, name)


def learned_counts(df: DataFrame, text: str, keep: list[str], name: str = "n_sentences") -> DataFrame:
    """``with_sentence_counts`` by the model of the texts themselves, which are cut once for both."""
    rows = bordered(df, text, _kept(keep))
    return _counted(rows, learn(df, text, rows=rows), keep, name)


def _counted(rows: DataFrame, model: SentenceModel, keep: list[str], name: str) -> DataFrame:
    inner = _marked(rows, model)
    less = inner.groupBy("_row").agg(F.count(F.lit(1)).cast("int").alias("_less"))
    counted = lookup_join(rows.withColumn("_most", F.size("_borders")).drop("_borders"), less, ["_row"], "left")
    count = F.when(F.col("_most") >= 0, F.col("_most") - F.coalesce("_less", F.lit(0)))
    return counted.select(*[F.col(f"_in{i}").alias(c) for i, c in enumerate(keep)], count.alias(name))


def split_sentences(df: DataFrame, text: str, model: SentenceModel, keep: list[str]) -> DataFrame:
    """One row per sentence: the columns ``keep``, ``sentence_no`` from 0, and the ``sentence``."""
    rows = bordered(df, text, [*_kept(keep), F.col(text).alias("_text")])
    inner = _marked(rows, model)
    pieces = rows.select(*[f"_in{i}" for i in range(len(keep))], "_row", F.posexplode(_pieces(F.col("_text"))).alias("place", "_piece"))
    inner = inner.select("_row", "place", F.lit(0).alias("_ends"))
    pieces = pieces.join(inner, ["_row", "place"], "left")
    before = Window.partitionBy("_row").orderBy("place")  # the pieces of one text
    numbered = pieces.withColumn("sentence_no", F.sum(F.coalesce("_ends", F.lit(1))).over(before) - 1)
    parts = F.array_sort(F.collect_list(F.struct("place", "_piece")))
    together = numbered.groupBy(*[f"_in{i}" for i in range(len(keep))], "_row", "sentence_no").agg(parts.alias("_parts"))
    sentence = F.trim(F.array_join(F.transform("_parts", lambda p: p["_piece"]), ""))
    return together.select(
        *[F.col(f"_in{i}").alias(c) for i, c in enumerate(keep)], F.col("sentence_no").cast("int").alias("sentence_no"),
        sentence.alias("sentence"),
    )
