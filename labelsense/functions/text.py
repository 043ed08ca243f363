"""Text to words, as column expressions that run inside the JVM on the whole text."""

import json
import zlib
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# A character that is neither white space nor punctuation that always ends a word.
_CHAR = r"""[^\s\x0B\p{Z};@#$%&?!*()\[\]{}<>"«»“”‘’„`,:.'-]"""

# A word keeps inner hyphens, apostrophes and full stops, and a comma or colon before a digit.
TOKEN_PATTERN = f"['-]?{_CHAR}+(?:(?:[,:][0-9]|[.'-]{_CHAR}){_CHAR}*)*-?"
# The group is possessive: Java would otherwise recurse once per part and overflow on long words.
_JAVA_TOKEN = f"['-]?{_CHAR}++(?:(?:[,:][0-9]|[.'-]{_CHAR}){_CHAR}*+)*+-?"
_JAVA_TOKEN_OR_MARK = _JAVA_TOKEN + r"|--|\.{2,}|''|[^\s\p{Z}]"

# The same words, of which group 1 holds those made of letters only, without their ending. The end
# of a word is tested for the usual case first: white space, or one mark and white space.
_JAVA_LETTER_TOKEN = (
    r"(?i)(\p{L}++(?!'t)|\p{L}+?(?=n't))(?:n't|'(?:s|m|d|ll|re|ve))?"
    rf"(?=[.,]?[ \n]|(?!{_CHAR}|-|[,:][0-9]|[.']{_CHAR}))|{_JAVA_TOKEN}"
)

# A sentence ends in a mark, closing quotes or brackets after it, and white space.
SENTENCE_PATTERN = r"""(?s)\S.*?(?:[.?!]["'”’»)\]}]*(?:\s|\z)|\z)"""

# Endings split off a word: it's -> it + 's, don't -> do + n't.
CLITIC_PATTERN = r"(?i)(n't|'(?:s|m|d|ll|re|ve))$"
LETTERS_PATTERN = r"^\p{L}+$"

# Joined words that are split after the third letter.
JOINED_WORDS = ["cannot", "gimme", "gonna", "gotta", "lemme", "wanna"]


def _raw_tokens(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.replace(text, F.lit("--"), F.lit(" -- ")), F.lit(pattern), F.lit(group))


def _letter_tokens(text: Column) -> Column:
    """Distinct words made of letters only."""
    words = F.array_remove(F.array_distinct(_raw_tokens(text, _JAVA_LETTER_TOKEN, 1)), "")
    lowered = F.lower(text)
    has_joined = reduce(or_, [F.contains(lowered, F.lit(word)) for word in JOINED_WORDS])
    return F.when(has_joined, F.array_distinct(_split_joined(words))).otherwise(words)


def _split_endings(tokens: Column) -> Column:
    def pieces(token: Column) -> Column:
        stem = F.regexp_replace(token, CLITIC_PATTERN, "")
        ending = F.regexp_extract(token, CLITIC_PATTERN, 1)
        return F.when(token.contains("'"), F.filter(F.array(stem, ending), lambda part: part != "")).otherwise(
            F.array(token)
        )

    return F.flatten(F.transform(tokens, pieces))


def _split_joined(tokens: Column) -> Column:
    def pieces(token: Column) -> Column:
        halves = F.array(F.substring(token, 1, 3), F.substring(token, 4, 3))
        return F.when(F.lower(token).isin(JOINED_WORDS), halves).otherwise(F.array(token))

    return F.flatten(F.transform(tokens, pieces))


def tokens(text: Column | str, marks: bool = True) -> Column:
    """Words in text order; with ``marks`` every punctuation mark is a token of its own."""
    column = F.col(text) if isinstance(text, str) else text
    return _split_joined(_split_endings(_raw_tokens(column, _JAVA_TOKEN_OR_MARK if marks else _JAVA_TOKEN)))


def word_count(text: Column | str) -> Column:
    """Number of tokens, punctuation included."""
    return F.size(tokens(text))


def sentence_count(text: Column | str) -> Column:
    """Number of sentences; letter case plays no part, as cleaned texts are lower case."""
    return F.regexp_count(text, F.lit(SENTENCE_PATTERN))


def remove_stop_words(words: Column, stop: list[str]) -> Column:
    if not stop:
        return words
    return F.filter(words, lambda word: ~word.isin(list(stop)))


def keep_letters_only(words: Column) -> Column:
    return F.filter(words, lambda word: word.rlike(LETTERS_PATTERN))


def replace_words(words: Column, mapping: dict[str, str]) -> Column:
    """Replace each word that has an entry in ``mapping``.

    The mapping travels as one constant: an array of small maps, addressed by the checksum of
    the word, so that a lookup costs the same whatever the size of the mapping.
    """
    if not mapping:
        return words
    slots = [{} for _ in range(len(mapping))]
    for form, lemma in mapping.items():
        slots[zlib.crc32(form.encode()) % len(slots)][form] = lemma
    table = F.from_json(F.lit(json.dumps(slots)), "array<map<string,string>>")

    def replaced(word: Column) -> Column:
        slot = (F.crc32(word.cast("binary")) % len(slots)).cast("int")
        return F.coalesce(F.element_at(F.get(table, slot), word), word)

    return F.transform(words, replaced)


def canonical_words(
    text: Column | str,
    stop: list[str] = (),
    only_alpha: bool = True,
    lower: bool = False,
    lemmas: dict[str, str] | None = None,
    filter_after: bool = False,
) -> Column:
    """Set of words of a text.

    Order of the steps: split, drop stop words, lemmatise, keep letters only, make a set. Stop
    words are dropped before lemmatising, so an inflected form can come back as a stop word;
    ``filter_after`` drops them once more at the end.
    """
    column = F.col(text) if isinstance(text, str) else text
    if lower:
        column = F.lower(column)
    # The set is taken first: it shrinks the list and changes nothing in the result.
    if only_alpha:
        words = _letter_tokens(column)
    else:
        words = F.array_distinct(tokens(column))
    return lemmatised(remove_stop_words(words, list(stop)), stop, only_alpha, lemmas, filter_after)


def lemmatised(
    words: Column, stop: list[str] = (), only_alpha: bool = True, lemmas: dict[str, str] | None = None, filter_after: bool = False
) -> Column:
    """The last steps of ``canonical_words``, for words that have gone through the first."""
    if lemmas:
        words = F.array_distinct(replace_words(words, lemmas))
        # The first steps left words of letters only, so a lemma alone can bring in others.
        if only_alpha and not all(lemma.isascii() and lemma.isalpha() for lemma in lemmas.values()):
            words = keep_letters_only(words)
        if filter_after:
            words = remove_stop_words(words, list(stop))
    return words


def pair_sentence(words: Column | str, label: Column | str) -> Column:
    """w1, label, w2, label, w3: a window of one then sees word and label pairs only."""
    words = F.col(words) if isinstance(words, str) else words
    label = F.col(label) if isinstance(label, str) else label
    pairs = F.flatten(F.transform(words, lambda word: F.array(word, label)))
    return F.slice(pairs, F.lit(1), F.greatest(F.size(pairs) - 1, F.lit(0)))
