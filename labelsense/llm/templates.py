"""Word templates: numbers, names and units of a text replaced with typed placeholders.

A token is a word cut down to the bytes from its first to its last letter or digit; words without
either are left out. Numbers are tokens that begin with a digit. Units are tokens that follow a
number and stand in the list of units. Names are tokens of two letters or more with one capital,
their first letter, that do not begin a sentence. All others are fixed, compared in lower case.

Loose types are for names and units that stand where these rules cannot tell them: every token with
the capital of a name is one, and a unit at the start of a run is one without a number before it.
"""

import numpy as np
import pyarrow as pa

from labelsense.llm import words

FIXED, NUMBER, NAME, UNIT = 0, 1, 2, 3

# Names and signs of units, in lower case.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons pound "
    "pounds lb lbs ounce ounces oz ml l liter liters litre litres gallon gallons second seconds sec minute minutes "
    "min hour hours h day days week weeks month months year years percent dollar dollars usd euro euros eur cent "
    "cents meter meters metre metres kilometer kilometers kilometre kilometres degree degrees celsius fahrenheit "
    "kmh mph hz khz mhz ghz kb mb gb tb watt watts kw volt volts joule joules calorie calories"
).split()

_bytes = np.arange(256)
_DIGIT = (_bytes >= 48) & (_bytes <= 57)
_UPPER = (_bytes >= 65) & (_bytes <= 90)
_WORDY = _DIGIT | _UPPER | ((_bytes >= 97) & (_bytes <= 122)) | (_bytes >= 128)
_VALUE = np.where(_WORDY, words._BYTE_LOWER, np.uint64(0))
_SENTENCE_END = np.isin(_bytes, list(b".?!:"))
_PLACEHOLDER = words.mix(np.array([0, 11, 12, 13], np.uint64))


def _unit_hashes() -> np.ndarray:
    texts = pa.array(UNITS)
    data, offsets = words.text_bytes(texts)
    return np.sort(words.span_hashes(data, offsets[:-1], offsets[1:], _VALUE))


_UNIT_HASHES = _unit_hashes()


def _runs(values: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of each run of ``size`` values, put together from runs of 1, 2, 4 and so on."""
    total = np.zeros(len(values) - size + 1, np.uint64)
    part, length, done = values, 1, 0
    while done < size:
        power = np.uint64(pow(int(words._BASE), length, 1 << 64))
        if size & length:
            total = total * power + part[done : done + len(total)]
            done += length
        if done < size:
            part = part[:-length] * power + part[length:]
            length *= 2
    return total


class Tokens:
    """Tokens of all texts of an Arrow column.

    ``value``: hash of each token; ``kind``: its type given the token before it; ``alone``: its type
    where nothing is known of the token before; ``loose_kind`` and ``loose_alone``: the loose types;
    ``first``: first token of each text, one entry more than texts.
    """

    def __init__(self, texts: pa.Array):
        data, offsets = words.text_bytes(texts)
        starts, ends = words.spans(data, offsets)
        wordy = np.flatnonzero(_WORDY[data])
        low = np.searchsorted(wordy, starts)
        high = np.searchsorted(wordy, ends)
        held = high > low
        starts, ends, low, high = starts[held], ends[held], low[held], high[held]
        begin, end = wordy[low], wordy[high - 1] + 1
        self.value = words.span_hashes(data, begin, end, _VALUE)
        self.first = np.searchsorted(starts, offsets)

        count = len(begin)
        number = _DIGIT[data[begin]] if count else np.zeros(0, bool)
        uppers = np.concatenate([[0], np.cumsum(self._capitals(data))])
        capital = (uppers[end] - uppers[begin] == 1) & (uppers[np.minimum(begin + 2, end)] > uppers[begin])
        capital &= (end - begin > 1) & ~number & self._starts_capital(data, begin)
        breaks = np.concatenate([[0], np.cumsum(data == 10)])
        opens = np.ones(count, bool)  # a sentence
        opens[1:] = _SENTENCE_END[data[ends[:-1] - 1]] | (breaks[starts[1:]] > breaks[ends[:-1]])
        opens[self.first[:-1][self.first[:-1] < count]] = True
        unit = np.zeros(count, bool)
        place = np.minimum(np.searchsorted(_UNIT_HASHES, self.value), len(_UNIT_HASHES) - 1)
        listed = _UNIT_HASHES[place] == self.value
        unit[1:] = listed[1:] & number[:-1]
        unit[self.first[:-1][self.first[:-1] < count]] = False
        self.alone = np.where(number, NUMBER, FIXED).astype(np.int8)
        self.kind = np.where(unit, UNIT, np.where(capital & ~opens, NAME, self.alone)).astype(np.int8)
        named = np.where(capital, NAME, self.alone)
        self.loose_kind = np.where(unit, UNIT, named).astype(np.int8)
        self.loose_alone = np.where(listed, UNIT, named).astype(np.int8)

    @staticmethod
    def _capitals(data: np.ndarray) -> np.ndarray:
        """Marks A-Z, and the first byte of the capitals À-Þ, А-Я, Α-Ω in UTF-8."""
        marks = _UPPER[data]
        if len(data) > 1:
            lead, next_ = data[:-1], data[1:]
            marks[:-1] |= (lead == 0xC3) & (next_ >= 0x80) & (next_ <= 0x9E) & (next_ != 0x97)
            marks[:-1] |= (lead == 0xD0) & (next_ >= 0x90) & (next_ <= 0xAF)
            marks[:-1] |= (lead == 0xCE) & (next_ >= 0x91) & (next_ <= 0xA9)
        return marks

    def _starts_capital(self, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return self._capitals(data)[begin] if len(begin) else np.zeros(0, bool)

    def _types(self, loose: bool) -> tuple[np.ndarray, np.ndarray]:
        return (self.loose_kind, self.loose_alone) if loose else (self.kind, self.alone)

    def windows(self, size: int, least_fixed: int, loose: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """First token and hash of each run of ``size`` tokens of one text with enough fixed tokens.

        The first token of a run is typed as if nothing came before it, so the hash depends on the
        run alone, wherever it stands.
        """
        count = len(self.value) - size + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        kind, alone = self._types(loose)
        text = np.searchsorted(self.first[1:], np.arange(len(self.value)), "right")
        at = np.flatnonzero(text[:count] == text[size - 1 :])
        coded = np.where(kind == FIXED, self.value, _PLACEHOLDER[kind])
        opening = np.where(alone == FIXED, self.value, _PLACEHOLDER[alone])
        fixed = np.concatenate([[0], np.cumsum(kind == FIXED)])
        held = fixed[at + size] - fixed[at + 1] + (alone[at] == FIXED) >= least_fixed
        at = at[held]
        total = opening[at]
        for k in range(1, size):
            total = total * words._BASE + coded[at + k]
        return at, words.mix(total)

    def whole(self, size: int, loose: bool | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First token, hash and number of fixed tokens of each run of ``size`` tokens of one text.

        The size is part of the hash. With ``loose`` None all tokens are fixed.
        """
        count = len(self.value) - size + 1
        if size < 1 or count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        kind, alone = (np.zeros(len(self.value), np.int8),) * 2 if loose is None else self._types(loose)
        text = np.searchsorted(self.first[1:], np.arange(len(self.value)), "right")
        at = np.flatnonzero(text[:count] == text[size - 1 :])
        coded = np.where(kind == FIXED, self.value, _PLACEHOLDER[kind])
        opening = np.where(alone == FIXED, self.value, _PLACEHOLDER[alone])
        fixed = np.concatenate([[0], np.cumsum(kind == FIXED)])
        total = opening[:count] * np.uint64(pow(int(words._BASE), size - 1, 1 << 64)) + _runs(coded[1:], size - 1)
        return at, words.mix(words.mix(total[at]) + np.uint64(size)), fixed[at + size] - fixed[at + 1] + (alone[at] == FIXED)

    def slots(self, at: int, size: int, loose: bool = False) -> np.ndarray:
        """Values under the placeholders of the window at a token, in order."""
        kind, alone = self._types(loose)
        kinds = kind[at : at + size].copy()
        kinds[0] = alone[at]
        return self.value[at : at + size][kinds != FIXED].view(np.int64)
