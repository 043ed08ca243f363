"""Packing of token sequences: documents go to windows of several sizes, long gaps get short documents.

A document is its token ids and an end token. Whole windows of the largest size are cut off its
front. What is left, its remainder, belongs to the smallest tier that holds it: with tiers of 2048,
1024, 512 and 256 tokens, one of 300 tokens to 512. The tiers are packed from the longest to the
shortest. A remainder of a tier opens a window of that size, and its gap is filled with the longest
remainders of shorter tiers that fit. Only if none fits is one cut: the gap takes its beginning, the
rest is a shorter remainder. So all windows are full but the last one of all.

The plan is made for lengths, not for documents. Remainders of one length are alike, so the driver
holds how many there are of each of 2,048 lengths, and packs groups of equal windows at a time;
its work and the plan depend on the number of lengths and tiers, not on the corpus. The plan says
which places, in the order of all remainders by length, go where. Documents get their place from
ranges of that order.

Windows of a tier are dealt to steps of ``step_tokens`` tokens each in turn, so steps have equal sizes,
hold windows of one shape, and get like numbers of documents, as windows with the same plan follow
each other.

Texts are tokenised once, and the ids are written. A task cuts a text at white space, and before marks
that end a word, and keeps the ids of words it has met. That gives the ids of the whole text if the
tokenizer's rules reach neither over white space nor from a letter or digit to a mark; for others
there is ``by_word=False``.

Defined results: a null or empty text is the end token alone; texts are read whole; equal rows are
packed apiece; ties of length go by id, a null id last; an empty table gives an empty table. The
columns given as ``keep`` are carried along, unless they bear a result's name.
"""

from bisect import bisect_right
from codecs import charmap_decode
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsense.llm import words
from labelsense.llm.resampling import blocks
from labelsense.operators.scale import lookup_join, running_totals, stored
from labelsense.sources.tables import evened

TIERS = (2048, 1024, 512, 256)
END = 1
STEP_TOKENS = 1 << 17
BLOCK_BYTES = 1 << 20
CACHE_WORDS, ENCODED_AT_ONCE = 1 << 18, 1 << 12
VOCABULARY = "word_bpe_49k.json"
_MARK, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True
_ALNUM[[ord(c) for c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Byte-level vocabularies write bytes as letters: printable ones of Latin-1 as they are, others from code 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
_LETTER_OF_BYTE = "".join(chr(_BYTE_LETTERS.get(b, b)) for b in range(256))
RESULTS = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step long"


@dataclass
class Entry:
    """Tokens ``start`` to ``start + length`` of the remainders at the places from ``first`` on, ``count`` of
    them: ``per_window`` to a window from ``window`` on, or each to every ``stride``-th window."""

    first: int
    count: int
    start: int
    length: int
    window: int
    offset: int
    per_window: int = 1
    stride: int = 1


@dataclass
class Plan:
    """Where remainders go. ``tiers``: (size, first window, windows) of each tier, and of the last window of all."""

    entries: list[Entry] = field(default_factory=list)
    tiers: list[tuple[int, int, int]] = field(default_factory=list)

    def indexed(self) -> tuple[list[int], list[list[Entry]]]:
        """Sorted places at which something changes, and the entries that hold from each of them on."""
        spots = sorted({e.first for e in self.entries} | {e.first + e.count for e in self.entries})
        held = [[] for _ in spots]
        for e in self.entries:
            i = bisect_right(spots, e.first) - 1
            while i < len(spots) and spots[i] < e.first + e.count:
                held[i].append(e)
                i += 1
        for entries in held:
            entries.sort(key=lambda e: e.start)
        return spots, held


class _Stock:
    """Remainders not yet packed: by length, stretches of places with the tokens already taken."""

    def __init__(self, counts: np.ndarray):
        self.runs: dict[int, list[tuple[int, int, int]]] = {}
        self.lengths = 0  # a bit for each length in stock
        self.tokens = 0
        ends = np.cumsum(counts)
        for length in np.flatnonzero(counts).tolist():
            if length:
                self.put(length, int(ends[length] - counts[length]), int(counts[length]), 0)

    def put(self, length: int, first: int, count: int, start: int) -> None:
        if length and count:
            self.runs.setdefault(length, []).append((first, count, start))
            self.lengths |= 1 << length
            self.tokens += length * count

    def take(self, length: int, most: int) -> tuple[int, int, int]:
        """Places from one stretch of this length: first, count, start."""
        first, count, start = self.runs[length].pop()
        taken = min(count, most)
        if taken < count:
            self.runs[length].append((first + taken, count - taken, start))
        if not self.runs[length]:
            self.lengths &= ~(1 << length)
        self.tokens -= length * taken
        return first, taken, start

    def longest(self, upto: int) -> int:
        """The longest length in stock that is not above ``upto``, 0 if there is none."""
        return max(0, (self.lengths & ((1 << (upto + 1)) - 1)).bit_length() - 1)

    def shortest(self, above: int) -> int:
        bits = self.lengths >> (above + 1)
        return (bits & -bits).bit_length() + above if bits else 0


def _fill(plan: Plan, stock: _Stock, window: int, windows: int, gap: int, size: int) -> None:
    """Fill the gaps of ``windows`` equal windows from ``window`` on; the stock has enough tokens."""
    open_ = [(window, windows, gap)]
    while open_:
        window, windows, gap = open_.pop()
        length = stock.longest(gap)
        if length:  # whole remainders, the same number to each window
            first, count, start = stock.take(length, windows * (gap // length))
            each = max(1, count // windows)
            used = min(count, windows) if count < windows else each * windows
            stock.put(length, first + used, count - used, start)
            served = used // each
            plan.entries.append(Entry(first, used, start, length, window, size - gap, per_window=each))
            if gap > each * length:
                open_.append((window, served, gap - each * length))
        else:  # the beginnings of longer ones, each for several windows
            length = stock.shortest(gap)
            each = min(length // gap, windows)
            first, count, start = stock.take(length, windows // each)
            for k in range(each):
                plan.entries.append(Entry(first, count, start + k * gap, gap, window + k, size - gap, stride=each))
            stock.put(length - each * gap, first, count, start + each * gap)
            served = count * each
        if served < windows:
            open_.append((window + served, windows - served, gap))


def planned(counts: np.ndarray, tiers: tuple[int, ...] = TIERS) -> Plan:
    """A plan for remainders of which there are ``counts[length]``; places are in order of length."""
    plan, stock, window = Plan(), _Stock(counts), 0
    for size, below in zip(tiers, (*tiers[1:], 0), strict=True):
        begin = window
        while stock.tokens >= size and (length := stock.longest(size)) > below:
            windows = stock.tokens // size
            first, count, start = stock.take(length, windows)
            plan.entries.append(Entry(first, count, start, length, window, 0))
            if length < size:
                _fill(plan, stock, window, count, size - length, size)
            window += count
        plan.tiers.append((size, begin, window - begin))
    offset = 0
    while stock.tokens:  # fewer than a window of the largest size
        length = stock.longest(tiers[0])
        first, count, start = stock.take(length, stock.tokens)
        plan.entries.append(Entry(first, count, start, length, window, offset, per_window=count))
        offset += length * count
    plan.tiers.append((tiers[0], window, int(offset > 0)))
    return plan


def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words between white space, and the marks that follow a letter or digit at their end by themselves."""
    starts, ends = words.spans(data, offsets)
    if not len(starts):
        return starts, ends
    at = np.where(_MARK[data], -1, np.arange(len(data)))
    last = np.maximum.accumulate(at)[ends - 1]  # of each word, its last byte that is no mark
    cut = last[(last >= starts) & (last < ends - 1) & _ALNUM[data[last]]] + 1
    return np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))


class Words:
    """The ids of words met before, ``CACHE_WORDS`` at most; then it starts anew."""

    def __init__(self, model):
        self.model = model
        self.lower = model.normalizer is not None and model.normalizer.normalize_str("AZ") == "az"
        self.special = [t.content.encode() for t in model.get_added_tokens_decoder().values()]
        samples = ["a", "abcdefgh", "éß", "ñandú", "ёлка", "straßenbahnen", "漢字かな"]
        self.direct = self.encode(samples) == [self._pieces(name, model.model.tokenize) for name in samples]
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _pieces(name: str, tokenize) -> list[int]:
        """Ids of a word that normal form and splitting leave as it is: the model's own, over its bytes as letters."""
        return [t.id for t in tokenize(name if name.isascii() else charmap_decode(name.encode(), "strict", _LETTER_OF_BYTE)[0])]

    def _encode_words(self, names: list[str]) -> list[list[int]]:
        """As ``encode``; words of letters alone go straight to the model, if it gives the same for samples."""
        if not self.direct:
            return self.encode(names)
        out, rest = [None] * len(names), []
        tokenize, pieces = self.model.model.tokenize, self._pieces  # each look at ``model`` makes an object
        for i, name in enumerate(names):
            if name.isalpha() and (name.islower() or self.lower):
                if name.isascii():
                    out[i] = [t.id for t in tokenize(name.lower())]
                    continue
                if is_normalized("NFC", name):
                    small = name.lower() if self.lower else name
                    # One letter for one; the small letter of a capital sigma depends on its place.
                    if small == name or (len(small) == len(name) and "Σ" not in name):
                        out[i] = pieces(small, tokenize)
                        continue
            rest.append(i)
        for i, ids in zip(rest, self.encode([names[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def ids(self, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids held, and where those of each of the words begin and end."""
        if len(self.place) > CACHE_WORDS:
            self.clear()
        at = np.fromiter(map(self.place.get, names, repeat(-1)), np.int64, len(names))
        unmet = np.flatnonzero(at < 0)
        new = [names[i] for i in unmet.tolist()]
        parts, lengths = [self.flat], [self.ends]
        for low in range(0, len(new), ENCODED_AT_ONCE):
            found = self._encode_words(new[low : low + ENCODED_AT_ONCE])
            parts.append(np.array(list(chain.from_iterable(found)), np.uint32))
            lengths.append(lengths[-1][-1] + np.cumsum([*map(len, found)], dtype=np.int64))
        self.flat, self.ends = np.concatenate(parts), np.concatenate(lengths)
        at[unmet] = np.arange(len(self.ends) - 1 - len(new), len(self.ends) - 1)
        self.place.update(zip(new, at[unmet].tolist(), strict=True))
        return self.flat, self.ends[at], self.ends[at + 1]

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where those of each text begin (one entry more than texts)."""
        data, offsets = words.text_bytes(texts)
        if self.lower and not any(name in data.tobytes() for name in (s[:2] for s in self.special)):
            data = _LOWER[data]  # so that there are fewer distinct words; but special tokens are told by their case
        starts, ends = word_spans(data, offsets)
        bounds = np.concatenate([[0], np.cumsum(ends - starts)])
        spelled = pa.LargeStringArray.from_buffers(
            len(starts), pa.py_buffer(bounds), pa.py_buffer(data[~words._SEPARATOR[data]].tobytes())
        ).dictionary_encode()
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        flat, begins, finish = self.ids(spelled.dictionary.to_numpy(zero_copy_only=False).tolist())
        word = spelled.indices.to_numpy()
        sizes = (finish - begins)[word]
        ends_of = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.repeat(begins[word] - ends_of[:-1], sizes) + np.arange(ends_of[-1])]
        return ids, ends_of[np.searchsorted(starts, offsets)]

    def encoded_whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same without looking at words, for tokenizers with rules that reach over white space or marks."""
        lists = self.encode(texts.fill_null("").to_pylist())
        return np.array([i for ids in lists for i in ids], np.uint32), np.cumsum([0, *map(len, lists)])


_words: dict[str, Words] = {}  # of this Python worker


def id_type(path: str, end: int) -> str:
    """The shortest unsigned type that holds all ids."""
    return "<u2" if max(end + 1, tokenizer(path).get_vocab_size()) <= 1 << 16 else "<u4"


def _tokenising(path: str, end: int, by_word: bool, kept: list[str], kind: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _words:
            _words[path] = Words(tokenizer(path))
        known = _words[path]
        encode = known.encoded if by_word else known.encoded_whole
        for batch in batches:
            for part in blocks(batch, "_text", BLOCK_BYTES):
                ids, bounds = encode(part.column("_text"))
                ids = np.insert(ids, bounds[1:], end).astype(kind)
                bounds = bounds + np.arange(len(bounds))
                flat = pa.Array.from_buffers(
                    pa.large_binary(), part.num_rows, [None, pa.py_buffer(bounds * ids.itemsize), pa.py_buffer(ids.tobytes())]
                )
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], flat.cast(pa.binary()), pa.array(np.diff(bounds))], [*kept, "_ids", "_n"]
                )
        known.clear()  # the worker may stay for long without a task
        pa.default_memory_pool().release_unused()

    return read


def tokenised(
    docs: DataFrame, path: str, text: str, keep: list[Column], end: int = END, by_word: bool = True, kind: str = "<u4"
) -> DataFrame:
    """The columns ``keep`` under the names _in0, _in1 .. with _ids (of the type ``kind``) and _n."""
    held = [f"_in{i}" for i in range(len(keep))]
    rows = docs.select(*[c.alias(h) for c, h in zip(keep, held, strict=True)], F.col(text).alias("_text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return evened(rows).mapInArrow(_tokenising(path, end, by_word, held, kind), f"{fields}_ids binary, _n bigint")


def _cutting(shared, kept: list[str], size: int, step_tokens: int, kind: str):
    names = [*kept, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots, held, tiers, full = shared.value
        for batch in (part for whole in batches for part in blocks(whole, "_ids", BLOCK_BYTES)):
            row, pieces = [], []
            ids = batch.column("_ids")
            columns = (batch.column(c).to_pylist() for c in ("_n", "_place", "_before"))
            for i, (n, place, before) in enumerate(zip(*columns, strict=True)):
                whole = n // size
                of_doc = [(k * size, size, before + k, 0) for k in range(whole)]
                for e in held[bisect_right(spots, place) - 1] if n % size else ():
                    at = place - e.first
                    window = e.window + (at // e.per_window) * e.stride
                    of_doc.append((whole * size + e.start, e.length, full + window, e.offset + at % e.per_window * e.length))
                data = np.frombuffer(ids[i].as_buffer(), kind).astype("<u4")
                for start, length, sequence, offset in of_doc:
                    tier, first, windows = next(t for t in tiers if sequence < t[1] + t[2])
                    steps = -(-windows * tier // step_tokens)
                    row.append(i)
                    pieces.append((start, length, data[start : start + length].tobytes(), n, sequence, offset,
                                   tier, first + (sequence - first) % steps))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            made = [pa.array([p[k] for p in pieces], kind) for k, kind in enumerate(kinds)]
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in kept], *made], names)

    return read


def packed(
    docs: DataFrame, path: str, id_: str = "doc_id", text: str = "text", keep: list[str] | None = None,
    tiers: tuple[int, ...] = TIERS, end: int = END, step_tokens: int = STEP_TOKENS, by_word: bool = True,
) -> DataFrame:
    """One row per piece of a document: its tokens ``start`` to ``start + length`` stand at ``offset`` of a sequence.

    Also ``ids`` (32-bit, little-endian), the ``tier``, which is the window's size, and the ``step``, the
    number of the first sequence of the group of sequences that is trained on at once.
    """
    names = [f.split()[0] for f in RESULTS.split(", ")]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    kept = [f"_in{i}" for i in range(len(keep))]
    size = tiers[0]
    kind = id_type(path, end)
    ids = tokenised(docs, path, text, [*map(F.col, keep), F.col(id_)], end, by_word, kind)
    # The key is fixed when the table is written.
    ids = stored(ids.withColumn("_key", F.monotonically_increasing_id()))
    lengths = ids.select("_key", F.col(f"_in{len(keep)}").alias("_id"), "_n")
    order = [F.col("_n") % size, F.col("_id").asc_nulls_last(), F.col("_n"), F.col("_key")]
    full = F.floor(F.col("_n") / size).cast("bigint")
    places = running_totals(lengths, order, {"_place": None, "_before": full}, one_task_rows=0)
    counts = np.zeros(size, np.int64)
    counted = lengths.groupBy((F.col("_n") % size).alias("_rest")).agg(F.count(F.lit(1)).alias("_rows"), F.sum(full).alias("_full"))
    whole = 0
    for row in counted.collect():  # at most a row per length
        counts[row["_rest"]], whole = row["_rows"], whole + row["_full"]
    plan = planned(counts, tiers)
    shapes = [(size, 0, whole + plan.tiers[0][2]), *[(t, whole + first, n) for t, first, n in plan.tiers[1:]]]
    shared = docs.sparkSession.sparkContext.broadcast((*plan.indexed(), shapes, whole))
    places = places.select("_key", "_place", "_before", F.lit(1).alias("_rows"))
    rows = lookup_join(ids, places, ["_key"], salt_on=["_key"], key_rows="_rows")
    rows = rows.select(*kept, "_ids", "_n", "_place", "_before")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[: len(kept)])
    pieces = rows.mapInArrow(_cutting(shared, kept, size, step_tokens, kind), fields + RESULTS)
    return pieces.select(*[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)], *names)


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence: its tier, step, ids, the number of its pieces, and where they begin."""
    part = F.struct("offset", "ids")
    together = pieces.groupBy("sequence_id").agg(
        F.first("tier").alias("tier"), F.first("step").alias("step"), F.array_sort(F.collect_list(part)).alias("_parts")
    )  # a sequence has at most as many pieces as its window has tokens
    joined = F.expr("aggregate(_parts, X'', (all, p) -> concat(all, p.ids))")
    return together.select(
        "sequence_id", "tier", "step", joined.alias("ids"), F.size("_parts").alias("n_pieces"),
        F.transform("_parts", lambda p: p["offset"]).alias("offsets"),
    )


def op11_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pieces = packed(docs, public_tokenizers.path(VOCABULARY), keep=["doc_id"])
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step"
    )
