"""Personal data replaced with surrogates of the same kind.

Entities are found by patterns: e-mail addresses, network addresses, phone, card, account and social
security numbers, secrets given after a keyword, and persons named after a title. Each distinct
entity gets one surrogate for the whole table, made from a keyed hash:

* e-mail: every letter and digit of the local part by another; a made-up domain, one per domain;
* numbers: other digits under the same marks and blanks; a country code stays; cards begin with
  9999, which is not issued; network addresses come from 10.0.0.0/8;
* secrets: other letters and digits at the same places, in the same case;
* names: made of syllables of the same script; given names end as the title's gender asks for;
  surname and given name each have their own surrogate, so "Mr. Jan Roe" and "Mrs. Roe" still share
  a surname, and a bare surname further on in the document is replaced too.

Collisions are checked: a surrogate that another entity of its kind has taken, or that is itself an
entity of the table, is drawn anew until all are distinct. So equal entities stay equal and unequal
ones unequal, across all documents. Everything is built-in expressions and joins; documents without
an entity are not shuffled.

Defined results: null and empty texts stay; an entity that stands in many documents is joined in
parts; equal rows get equal results; of rows with equal ids the text tells them apart; an empty
table gives an empty table; other columns are carried along, and columns that bear a result's name
are replaced. There are 10^10 phone numbers of ten digits, 10^9 cards of 13 digits, 10^8 social security numbers
and 2^24 addresses to draw from; more entities of a kind than that make the draws fail with an
error.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsense.operators.scale import lookup_join, stored

KEY = "surrogates-1"
MAX_ROUNDS = 40

# Words that announce a secret, and titles by gender.
SECRET_WORDS = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key"
MALE = "Mr|Herr|Monsieur|Señor|Sr|Mister|Господин|Κύριος"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Госпожа|Κυρία"
NEUTRAL = "Dr|Prof"

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_NAME = r"\p{Lu}\p{Ll}++(?:-\p{Lu}\p{Ll}++)?"
PATTERN = "|".join([
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,}",
    rf"""(?<![\p{{L}}])(?i:{SECRET_WORDS})["']?\s{{0,3}}[=:]\s{{0,3}}["']?[0-9A-Za-z+/_-]{{6,}}""",
    rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    r"(?<![0-9A-Za-z])\+?[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
    r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    r"(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
    r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    rf"(?<!\p{{L}})(?:{MALE}|{FEMALE}|{NEUTRAL})\.?\s(?:{_NAME}\s)?{_NAME}(?!\p{{L}})",
])

#: What a text with an entity holds at least; a cheap test before the patterns are tried everywhere.
HINT = rf"[0-9@=:]|(?<!\p{{L}})(?:{MALE}|{FEMALE}|{NEUTRAL})\.?\s\p{{Lu}}"

# Syllables for names, by script; endings of given names by gender.
SYLLABLES = {
    "latin": "ba da fe ga ho ja ka lo ma ne pi ra sa to vi zu".split(),
    "cyrillic": "ба да фе га хо я ка ло ма не пи ра са то ви зу".split(),
    "greek": "βα δα φε γα χο ια κα λο μα νε πι ρα σα το βι ζυ".split(),
}
ENDINGS = {
    "latin": {"f": "na", "m": "rd", "u": "li"},
    "cyrillic": {"f": "на", "m": "рд", "u": "ли"},
    "greek": {"f": "να", "m": "ρος", "u": "λι"},
}


def has_entity(text: Column) -> Column:
    return text.rlike(HINT) & text.rlike(PATTERN)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _secret_value(match: Column) -> Column:
    return F.regexp_extract(match, r"""[=:]\s*["']?([^=:\s"']+)$""", 1)


def _kind(match: Column) -> Column:
    return (
        F.when(match.contains("@"), "email")
        .when(match.rlike(rf"^(?i:{SECRET_WORDS})[\"']?\s*[=:]"), "secret")
        .when(match.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "address")
        .when(match.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "social")
        .when(match.rlike(r"^[0-9](?:[ -]?[0-9]){12,18}$"), "card")
        .when(match.rlike(r"^[+(0-9]"), "phone")
        .when(match.rlike(r"^[A-Z]{2}[0-9]{2}"), "account")
        .otherwise("person")
    )


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _gender(title: Column) -> Column:
    return F.when(title.rlike(rf"^(?:{MALE})\b"), "m").when(title.rlike(rf"^(?:{FEMALE})\b"), "f").otherwise("u")


def _surname_key(name: Column) -> Column:
    return F.concat(F.lit("surname:"), _script(name), F.lit("|"), F.lower(name))


def _given_key(name: Column, title: Column) -> Column:
    return F.concat(F.lit("given:"), _gender(title), F.lit(":"), _script(name), F.lit("|"), F.lower(name))


def _keys(match: Column) -> Column:
    """The entities of a match as "kind|normal form"; a person has up to two."""
    kind = _kind(match)
    normal = (
        F.when(kind == "email", F.lower(match))
        .when(kind == "secret", _secret_value(match))
        .when(kind == "address", match)
        .when(kind == "account", F.replace(match, F.lit(" "), F.lit("")))
        .when(kind == "phone", F.regexp_extract(_digits(match), "[0-9]{1,10}$", 0))  # without country code
        .otherwise(_digits(match))
    )
    words = F.split(match, r"\s+")
    surname = _surname_key(F.element_at(words, -1))
    given = _given_key(F.get(words, 1), F.get(words, 0))
    person = F.when(F.size(words) > 2, F.array(given, surname)).otherwise(F.array(surname))
    return F.when(kind == "person", person).otherwise(F.array(F.concat(kind, F.lit("|"), normal)))


def _shaped(value: Column, hash_: Column) -> Column:
    """Other letters and digits at the same places, in the same case, from a hash of 64 digits."""
    chars = F.array_remove(F.split(value, ""), "")
    letters = F.when(value.rlike("^[0-9A-Fa-f]+$"), 6).otherwise(16)  # hexadecimal stays hexadecimal

    def other(char: Column, i: Column) -> Column:
        digit = F.conv(F.substring(hash_, i % 64 + 1, F.lit(1)), 16, 10).cast("int")
        letter = F.char(digit % letters + 97)
        return (
            F.when(char.rlike("[0-9]"), (digit % 10).cast("string"))
            .when(char.rlike("[a-z]"), letter)
            .when(char.rlike("[A-Z]"), F.upper(letter))
            .otherwise(char)
        )

    return F.array_join(F.transform(chars, other), "")


def _syllables(hash_: Column, script: Column, count: Column) -> Column:
    lists = {name: F.array(*[F.lit(s) for s in syllables]) for name, syllables in SYLLABLES.items()}
    table = F.when(script == "cyrillic", lists["cyrillic"]).when(script == "greek", lists["greek"]).otherwise(lists["latin"])
    picked = F.transform(
        F.sequence(F.lit(1), count),
        lambda i: F.get(table, F.conv(F.substring(hash_, i, F.lit(1)), 16, 10).cast("int")),
    )
    return F.array_join(picked, "")


def _drawn(key: str) -> Column:
    """The surrogate of (kind, normal) at a draw, in normal form."""
    kind, normal, draw = F.col("kind"), F.col("normal"), F.col("draw")
    hash_ = F.sha2(F.concat_ws("|", F.lit(key), kind, normal, draw.cast("string")), 256)
    digits = F.translate(hash_, "abcdef", "012345")
    more = F.when(draw > 1, F.substring(digits, 50, 6)).otherwise("")
    local, domain = F.substring_index(normal, "@", 1), F.substring_index(normal, "@", -1)
    domain_hash = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain), 256)
    email = F.concat(_shaped(local, hash_), more, F.lit("@m"), F.substring(domain_hash, 1, 8), F.lit(".example.org"))
    octet = lambda at: F.conv(F.substring(hash_, at, 2), 16, 10)
    address = F.concat_ws(".", F.lit("10"), octet(1), octet(3), octet(5))
    length = F.length(normal)
    phone = F.substring(digits, F.lit(1), length)
    card = F.concat(F.lit("9999"), F.substring(digits, F.lit(1), length - 4))
    social = F.concat(F.lit("9"), F.substring(digits, 1, 8))
    account = F.concat(F.substring(normal, 1, 2), _shaped(F.substring(normal, F.lit(3), length), hash_))
    script = F.element_at(F.split(kind, ":"), -1)
    stem = _syllables(hash_, script, F.least(F.lit(8), F.lit(3) + F.floor(draw / 2).cast("int")))
    gender = F.get(F.split(kind, ":"), 1)
    ending = F.lit("")
    for name, endings in ENDINGS.items():
        for letter, end in endings.items():
            ending = F.when((script == name) & (gender == letter), end).otherwise(ending)
    return (
        F.when(kind == "email", email)
        .when(kind == "address", address)
        .when(kind == "phone", phone)
        .when(kind == "card", card)
        .when(kind == "social", social)
        .when(kind == "account", account)
        .when(kind == "secret", _shaped(normal, hash_))
        .when(F.startswith(kind, F.lit("given")), F.concat(stem, ending))
        .otherwise(stem)
    )


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, normal, surrogate) for distinct (kind, normal), no two of a kind alike and none real."""
    entities = stored(entities.select("kind", "normal").distinct())
    real = entities.select("kind", F.col("normal").alias("surrogate"))
    open_, done = entities.withColumn("draw", F.lit(0)), None
    for _ in range(MAX_ROUNDS):
        tried = open_.withColumn("surrogate", _drawn(key))
        first = F.min(F.struct("normal")).alias("first")  # of those that drew the same, one keeps it
        winners = tried.groupBy("kind", "surrogate").agg(first).select("kind", "surrogate", F.col("first.normal").alias("normal"))
        free = winners.join(real, ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done, ["kind", "surrogate"], "left_anti")
        won = stored(free.select("kind", "normal", "surrogate"))
        done = won if done is None else stored(done.unionByName(won))
        open_ = stored(open_.join(won, ["kind", "normal"], "left_anti").withColumn("draw", F.col("draw") + 1))
        if open_.isEmpty():
            return done
    raise RuntimeError("more entities of a kind than surrogates")


def _with_digits(match: Column, last: Column) -> Column:
    """The match with its last digits replaced one after the other; marks and blanks stay."""
    own = _digits(match)
    digits = F.concat(F.substring(own, F.lit(1), F.length(own) - F.length(last)), last)
    chars = F.array_remove(F.split(match, ""), "")

    def other(char: Column, i: Column) -> Column:
        place = F.length(_digits(F.substring(match, F.lit(1), i + 1)))
        return F.when(char.rlike("[0-9]"), F.substring(digits, place, F.lit(1))).otherwise(char)

    return F.array_join(F.transform(chars, other), "")


def _cased(value: Column, like: Column) -> Column:
    return F.when((F.upper(like) == like) & (F.lower(like) != like) & (F.length(like) > 1), F.upper(value)).otherwise(value)


def _rendered(match: Column, known: Column) -> Column:
    """A match with its surrogate, looked up in a map from "kind|normal form"."""
    kind = _kind(match)
    found = F.element_at(known, F.get(_keys(match), 0))
    secret = _secret_value(match)
    start = F.substring(match, F.lit(1), F.length(match) - F.length(secret))
    account = F.array_join(  # blanks after every fourth character, if the match has them
        F.transform(
            F.sequence(F.lit(0), F.floor((F.length(found) - 1) / 4).cast("int")),
            lambda i: F.substring(found, i * 4 + 1, F.lit(4)),
        ),
        " ",
    )
    words = F.split(match, r"\s+")
    title, last = F.get(words, 0), F.element_at(words, -1)
    surname = F.initcap(F.element_at(known, _surname_key(last)))
    given = F.initcap(F.element_at(known, _given_key(F.get(words, 1), title)))
    person = F.when(F.size(words) > 2, F.concat_ws(" ", title, given, surname)).otherwise(F.concat_ws(" ", title, surname))
    return (
        F.when(kind == "email", _cased(found, match))
        .when(kind == "address", found)
        .when(kind == "secret", F.concat(start, found))
        .when(kind == "account", F.when(match.contains(" "), account).otherwise(found))
        .when(kind == "person", person)
        .otherwise(_with_digits(match, found))
    )


def _renamed(piece: Column, known: Column) -> Column:
    """Text between entities, with bare surnames of the document's persons replaced."""
    tokens = F.regexp_extract_all(piece, F.lit(r"\p{L}+(?:-\p{L}+)*|[^\p{L}]+"), F.lit(0))
    other = lambda t: F.coalesce(
        F.when(t.rlike(r"^\p{Lu}\p{Ll}"), F.initcap(F.element_at(known, _surname_key(t)))), t
    )
    return F.array_join(F.transform(tokens, other), "")


def replaced(docs: DataFrame, key: str = KEY, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with surrogates in ``text``, and ``n_entities``, the number of matches replaced."""
    docs = docs.drop(*[c for c in ["n_entities"] if c not in (id_, text)])
    names = [f"_in{i}" for i in range(len(docs.columns))]
    body, own_id = names[docs.columns.index(text)], names[docs.columns.index(id_)]
    held = docs.toDF(*names)
    some = stored(held.filter(has_entity(F.col(body))))
    keyed = some.withColumns({
        "_id": F.coalesce(F.col(own_id).cast("string"), F.lit("null")),
        "_key": F.xxhash64(body),
        "_matches": F.regexp_extract_all(F.col(body), F.lit(PATTERN), F.lit(0)),
    })
    found = keyed.select("_id", "_key", F.explode("_matches").alias("match"))
    found = found.select("_id", "_key", F.explode(_keys(F.col("match"))).alias("entity")).distinct()
    found = stored(found)
    kind, normal = F.substring_index("entity", "|", 1), F.expr("substring(entity, instr(entity, '|') + 1)")
    entities = found.select("entity").distinct().select(kind.alias("kind"), normal.alias("normal"))
    table = surrogates(entities, key).select(F.concat_ws("|", "kind", "normal").alias("entity"), "surrogate")
    told = lookup_join(found, table, ["entity"], "inner", salt_on=["_id", "_key"])
    maps = told.groupBy("_id", "_key").agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias("_known"))
    joined = keyed.join(maps, ["_id", "_key"])
    # Between the matches lies the rest of the text; both lists are read in step.
    pieces = F.split(F.col(body), PATTERN)
    named = F.exists(F.map_keys("_known"), lambda k: F.startswith(k, F.lit("surname")))
    rest = F.when(named, F.transform(pieces, lambda p: _renamed(p, F.col("_known")))).otherwise(pieces)
    news = F.transform("_matches", lambda m: _rendered(m, F.col("_known")))
    both = F.zip_with(rest, news, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    renewed = joined.withColumn("_new", F.array_join(both, ""))
    columns = lambda value, count: [
        *[(value if n == body else F.col(n)).alias(c) for n, c in zip(names, docs.columns, strict=True)],
        count.cast("bigint").alias("n_entities"),
    ]
    changed = renewed.select(*columns(F.col("_new"), F.size("_matches")))
    same = held.filter(F.col(body).isNull() | ~has_entity(F.col(body))).select(*columns(F.col(body), F.lit(0)))
    return same.unionByName(changed)


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replaced(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
