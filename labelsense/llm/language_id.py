"""Language identification by interpolated Kneser-Ney models of characters.

A text is read as lower-case letters; whatever stands between letters is one blank. For each
language there is a model of four characters. Its counts come from all learning texts but those set
aside for calibration: tasks count four-character runs, and Spark adds the counts up. No run is left out, so discounts and lower orders
are those of the whole corpus, and a model has an entry for each distinct run, which the driver and
the tasks hold. Lower orders count in how many contexts a run stands, and every order is interpolated
with the one below, the lowest with an even law.

For scoring, the runs of all languages are one sorted array of 64-bit hashes, with a row of
log-probabilities, one per language, computed in full. So a character costs one search; only runs
that no language has ever shown are taken to shorter arrays. The language with the lowest cross
entropy per character is chosen.

Calibration, on at most ``CALIBRATION`` texts and a tenth of all, chosen by a hash of the text, which
are not counted; a language that would be left without a text keeps its own. A temperature turns cross entropies into the
chance that the choice is right, and each language gets the cross entropy above which a text of its
length is rejected. A rejected text keeps its nearest language and gets a lower score.

Defined results: null texts and texts without a letter are "und", with score 0, and rejected; so is
every text if there was nothing to learn from. Rows without a language or text teach nothing; equal
rows get equal results; texts are read whole, in time and space that grow with their length; the
alphabetically first language wins a tie; an empty table gives an empty table. Columns that bear a
result's name are replaced.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsense.llm.words import mix

ORDER = 4
TASK_RUNS = 1 << 21  # distinct runs that a task holds before it hands them on
CALIBRATION = 8_000
BATCH_CHARS = 1 << 20
TEMPERATURES = (1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0, 1000.0)
REJECT_SIGMAS = 6.0
UNKNOWN = "und"

_FACTORS = mix(np.arange(101, 101 + ORDER, dtype=np.uint64)) | np.uint64(1)
_tables: dict[str, np.ndarray] = {}


def _alphabet() -> np.ndarray:
    """Lower-case code point of each letter, 0 for all else."""
    if "letters" not in _tables:
        table = np.zeros(0x110000, np.uint32)
        for code in range(0x110000):
            if (char := chr(code)).isalpha():
                lower = char.lower()
                table[code] = ord(lower) if len(lower) == 1 else code
        _tables["letters"] = table
    return _tables["letters"]


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and single blanks (0) of all texts, each word followed by a blank; start of each text."""
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    codes = _alphabet()[codes]
    ends = np.cumsum(lengths)
    codes = np.insert(codes, ends, 0)
    text = np.repeat(np.arange(len(texts)), lengths + 1)
    after_letter = np.zeros(len(codes), bool)
    after_letter[1:] = (codes[:-1] != 0) & (text[1:] == text[:-1])
    kept = (codes != 0) | after_letter
    starts = np.concatenate([[0], np.cumsum(np.bincount(text[kept], minlength=len(texts)))])
    return codes[kept].astype(np.uint64), starts


def histories(codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text of each character, and rows of which the k-th holds the character k places before, 0 where
    the text begins; in blocks, so a very long text takes no more room than many short ones."""
    for low in range(0, len(codes), BATCH_CHARS):
        at = np.arange(low, min(low + BATCH_CHARS, len(codes)))
        text = np.searchsorted(starts, at, "right") - 1
        place = at - starts[text]
        yield text, np.stack([np.where(place >= k, codes[np.maximum(at - k, 0)], 0) for k in range(ORDER)])


def run_hash(rows: np.ndarray, order: int, skip: int = 0) -> np.ndarray:
    """Hash of the runs of ``order`` characters that end ``skip`` places before each character."""
    total = np.full(rows.shape[1], np.uint64(order))
    for k in range(order):
        total += (rows[k + skip] + np.uint64(1)) * _FACTORS[k]
    return mix(total)


def _pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``BATCH_CHARS`` characters, a longer text alone."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        if i > at and size + len(text) > BATCH_CHARS:
            yield at, i
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield at, len(texts)


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (lang, text) to the runs of each language with their counts in this task."""
    held: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def emit(lang: str) -> pa.RecordBatch:
        _, runs, counts = held.pop(lang)
        columns = [pa.array([lang] * runs.shape[1]), *[pa.array(r.astype(np.int32)) for r in runs], pa.array(counts)]
        return pa.RecordBatch.from_arrays(columns, ["lang", *[f"c{k}" for k in range(ORDER)], "n"])

    for batch in batches:
        langs = batch.column("lang")
        for lang in pc.unique(langs).to_pylist():
            texts = batch.column("text").filter(pc.equal(langs, lang)).to_pylist()
            for rows in (rows for low, high in _pieces(texts) for _, rows in histories(*characters(texts[low:high]))):
                hashes, first, counts = np.unique(run_hash(rows, ORDER), return_index=True, return_counts=True)
                runs, counts = rows[:, first], counts.astype(np.int64)
                if lang in held:
                    before = held[lang]
                    hashes, first, inverse = np.unique(
                        np.concatenate([before[0], hashes]), return_index=True, return_inverse=True
                    )
                    counts = np.bincount(inverse, np.concatenate([before[2], counts])).astype(np.int64)
                    runs = np.concatenate([before[1], runs], axis=1)[:, first]
                held[lang] = hashes, runs, counts
                if len(hashes) > TASK_RUNS:
                    yield emit(lang)
    for lang in list(held):
        yield emit(lang)


def run_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, c0 .. c3, n): how often c0 follows c3 c2 c1 in all texts of a language."""
    labelled = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).dropna()
    places = [f"c{k}" for k in range(ORDER)]
    schema = "lang string, " + ", ".join(f"{c} int" for c in places) + ", n bigint"
    return labelled.mapInArrow(_count_runs, schema).groupBy("lang", *places).agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """``hashes[m]`` and ``logs[m]``: sorted runs of m characters and a row of log-probabilities each;
    ``contexts[m]`` and ``backoffs[m]``: contexts of m characters and the log weight of lower orders."""

    langs: list[str]
    hashes: dict[int, np.ndarray] = field(default_factory=dict)
    logs: dict[int, np.ndarray] = field(default_factory=dict)
    contexts: dict[int, np.ndarray] = field(default_factory=dict)
    backoffs: dict[int, np.ndarray] = field(default_factory=dict)
    floor: np.ndarray | None = None
    temperature: float = 1.0
    #: per language: mean cross entropy, variance between texts, variance of one character
    limits: np.ndarray | None = None


def _find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(table, values), max(0, len(table) - 1))
    return place, table[place] == values if len(table) else np.zeros(len(values), bool)


def log_probabilities(model: Model, rows: np.ndarray, order: int = ORDER) -> np.ndarray:
    """One row per character, one column per language."""
    if order == 0:
        return np.broadcast_to(model.floor, (rows.shape[1], len(model.langs)))
    place, known = _find(model.hashes[order], run_hash(rows, order))
    if not len(model.hashes[order]):
        return log_probabilities(model, rows, order - 1)
    out = model.logs[order][place]
    missed = np.flatnonzero(~known)
    if len(missed):
        rest = rows[:, missed]
        lower = log_probabilities(model, rest, order - 1)
        place, known = _find(model.contexts[order - 1], run_hash(rest, order - 1, skip=1))
        out[missed] = lower + np.where(known[:, None], model.backoffs[order - 1][place], 0)
    return out


def build(counts: dict[str, np.ndarray], langs: list[str], lang_of: np.ndarray) -> Model:
    """The model from runs (c0 .. c3, n) of all languages; ``lang_of`` is the language of each run."""
    model = Model(langs)
    grams = np.stack([counts[f"c{k}"] for k in range(ORDER)]).astype(np.uint64)
    n, lang = counts["n"].astype(float), lang_of
    letters = len(np.unique(grams[0])) + 1
    model.floor = np.full(len(langs), -np.log(letters), np.float32)
    levels = {ORDER: (grams, n, lang)}
    for order in range(ORDER - 1, 0, -1):  # in how many contexts a shorter run stands
        upper, _, lang = levels[order + 1]
        key = np.concatenate([upper[:order], lang[None].astype(np.uint64)])
        runs, times = np.unique(key, axis=1, return_counts=True)
        levels[order] = runs[:-1], times.astype(float), runs[-1].astype(int)
    for order in range(1, ORDER + 1):
        runs, n, lang = levels[order]
        padded = np.concatenate([runs, np.zeros((ORDER - order, runs.shape[1]), np.uint64)])
        once = np.bincount(lang[n == 1], minlength=len(langs))
        twice = np.bincount(lang[n == 2], minlength=len(langs))
        discount = np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5)
        context = run_hash(padded, order - 1, skip=1)
        contexts, place = np.unique(context, return_inverse=True)
        total = np.zeros((len(contexts), len(langs)))
        types = np.zeros_like(total)
        np.add.at(total, (place, lang), n)
        np.add.at(types, (place, lang), 1)
        weight = np.where(total > 0, discount * types / np.maximum(total, 1), 1.0)
        model.contexts[order - 1], model.backoffs[order - 1] = contexts, np.log(weight).astype(np.float32)
        if order == 1:
            model.floor = model.floor + model.backoffs[0][0]
            model.backoffs[0] = np.zeros_like(model.backoffs[0])
        hashes, first, spot = np.unique(run_hash(padded, order), return_index=True, return_inverse=True)
        count = np.zeros((len(hashes), len(langs)))
        np.add.at(count, (spot, lang), n)
        lower = np.exp(log_probabilities(model, padded[:, first], order - 1).astype(float))
        at = place[first]
        share = np.maximum(count - discount, 0) / np.maximum(total[at], 1)
        backed = lower if order == 1 else weight[at] * lower
        model.hashes[order], model.logs[order] = hashes, np.log(share + backed).astype(np.float32)
    return model


def cross_entropies(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean negative log-probability per character, a row per text and a column per language; lengths."""
    codes, starts = characters(texts)
    lengths = np.diff(starts)
    sums = np.zeros((len(texts), len(model.langs)))
    for text, rows in histories(codes, starts):
        first = np.flatnonzero(np.diff(text, prepend=-1))
        sums[text[first]] += np.add.reduceat(log_probabilities(model, rows), first, axis=0, dtype=np.float64)
    return -sums / np.maximum(lengths, 1)[:, None], lengths


def _chances(entropies: np.ndarray, lengths: np.ndarray, temperature: float) -> np.ndarray:
    logits = -entropies * lengths[:, None] / temperature
    logits -= logits.max(axis=1, keepdims=True)
    odds = np.exp(logits)
    return odds / odds.sum(axis=1, keepdims=True)


def calibrate(model: Model, texts: list[str], langs: list[str]) -> None:
    """Choose the temperature, and the cross entropy above which texts of a language are rejected."""
    model.limits = np.tile([np.inf, 0.0, 0.0], (len(model.langs), 1))
    known = [i for i, lang in enumerate(langs) if lang in model.langs]
    parts = [cross_entropies(model, [texts[i] for i in known[a:b]])
             for a, b in _pieces([texts[i] for i in known])]
    if not parts:
        return
    entropies, lengths = (np.concatenate(p) for p in zip(*parts, strict=True))
    truth = np.array([model.langs.index(langs[i]) for i in known])
    held = lengths > 0
    entropies, lengths, truth = entropies[held], lengths[held], truth[held]
    if not len(truth):
        return

    def loss(temperature: float) -> float:
        chance = _chances(entropies, lengths, temperature)[np.arange(len(truth)), truth]
        return float(-np.log(np.maximum(chance, 1e-9)).mean())

    model.temperature = min(TEMPERATURES, key=loss)
    for k in range(len(model.langs)):
        own, size = entropies[truth == k, k], lengths[truth == k]
        if len(own) > 1:
            mean = float(np.average(own, weights=size))
            per_text = float(np.average((own - mean) ** 2, weights=size))
            per_character = float(np.mean((own - mean) ** 2 * size))
            model.limits[k] = mean, per_text, per_character


_SLOTS = 1 << 31


def _text_slot(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(_SLOTS))


def _sample(rows: DataFrame) -> DataFrame:
    """The (text, lang) rows with the lowest hashes, copies once, ``CALIBRATION`` at most."""
    once = rows.dropna().groupBy("text").agg(F.min("lang").alias("lang"))
    return once.orderBy(F.xxhash64("text"), "text").limit(CALIBRATION)


def set_aside(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """The rows to count and the rows to calibrate with, by a hash of the text.

    About ``CALIBRATION`` rows are set aside, and no more than a tenth; copies of a text go together.
    A language that would have no row left to count keeps all of its rows.
    """
    learnable = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    share = min(_SLOTS // 10, -(-_SLOTS * CALIBRATION // max(1, learnable.count())))
    low = _text_slot(F.col(text)) < share
    per_language = learnable.groupBy(lang).agg(F.max((~low).cast("int")).alias("_left"))
    whole = [row[lang] for row in per_language.filter("_left = 0").collect()]  # a model per language is held anyway
    aside = low & ~F.col(lang).isin(whole) if whole else low
    return learnable.filter(~aside), learnable.filter(aside)


def trained(docs: DataFrame, calibration: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model from all rows of ``docs`` and at most ``CALIBRATION`` rows of ``calibration``."""
    table = run_counts(docs, text, lang).toArrow()  # one row per distinct run
    names = table.column("lang").to_pylist()
    langs = sorted(set(names))
    if not langs:
        return Model([])
    index = {name: k for k, name in enumerate(langs)}
    columns = {c: table.column(c).to_numpy() for c in [*[f"c{k}" for k in range(ORDER)], "n"]}
    model = build(columns, langs, np.array([index[name] for name in names]))
    rows = _sample(calibration.select(F.col(text).alias("text"), F.col(lang).alias("lang"))).collect()
    calibrate(model, [row["text"] for row in rows], [row["lang"] for row in rows])
    return model


def _predict(shared, kept: list[str]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            for low, high in _pieces(texts):
                part = batch.slice(low, high - low)
                langs, scores, rejected, best = _judged(model, texts[low:high])
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                     pa.array(rejected, pa.bool_()), pa.array(best, pa.float64())],
                    [*kept, "lang_pred", "score", "rejected", "cross_entropy"],
                )

    return read


def _judged(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    if not model.langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool), np.zeros(len(texts))
    entropies, lengths = cross_entropies(model, texts)
    choice = entropies.argmin(axis=1)
    own = entropies[np.arange(len(texts)), choice]
    mean, per_text, per_character = model.limits[choice].T
    limit = mean + REJECT_SIGMAS * np.sqrt(per_text + per_character / np.maximum(lengths, 1))
    rejected = (own > limit) | (lengths == 0)
    chance = _chances(entropies, lengths, model.temperature)[np.arange(len(texts)), choice]
    score = np.where(lengths == 0, 0.0, np.where(rejected, chance * limit / np.maximum(own, 1e-9), chance))
    langs = [model.langs[k] if n else UNKNOWN for k, n in zip(choice, lengths, strict=True)]
    return langs, np.clip(score, 0.0, 1.0), rejected, np.where(lengths == 0, 0.0, own)


def identified(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all if None) with lang_pred, score, rejected and cross_entropy."""
    results = ["lang_pred", "score", "rejected", "cross_entropy"]
    names = [c for c in (docs.columns if keep is None else keep) if c not in results]
    kept = [f"_in{i}" for i in range(len(names))]
    rows = docs.select(*[F.col(n).alias(k) for n, k in zip(names, kept, strict=True)], F.col(text).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    schema = f"{fields}{', ' if fields else ''}lang_pred string, score double, rejected boolean, cross_entropy double"
    found = rows.mapInArrow(_predict(shared, kept), schema)
    return found.select(*[F.col(k).alias(n) for n, k in zip(names, kept, strict=True)], *results)


def fold(id_: Column) -> Column:
    """Fold 0 to 3 of a row, from the CRC-32 of its id as text."""
    return F.crc32(id_.cast("string").cast("binary")) % 4


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds 0, 1 and 3 are learned from, fold 2 is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = trained(*set_aside(docs.filter(fold(F.col("doc_id")) != 2)))
    rows = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "text")
    return identified(rows, model, keep=["doc_id", "held_out"])
