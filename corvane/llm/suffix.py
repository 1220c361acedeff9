"""Suffix-array deduplication of repeated strings by prefix-free parsing.

A symbol goes if a string of `least` symbols (L) that covers it also starts anywhere else in the corpus, the same document
included; strings never cross documents and are judged on the input. Symbols are the bytes of a text or its words.

Parsing. A rolling (polynomial) hash of a few symbols is taken at every position. The trigger of a start s is the smallest hash in
the L/2 positions from s on, so it lies inside the string that starts there and depends on that string only: equal strings
have their trigger at the same place. The starts that share a trigger j form a phrase, text[lo..j]; phrases partition all starts.

Dictionary and parse. Phrases that are equal with all that their strings cover are one entry, with the number of its occurrences. The
text that follows a trigger for the first L/2 symbols is the entry's class: strings that are equal have their triggers in one class, so entries that are alone in theirs
go (a bitmap of the classes that occur twice), and Spark deals the others by class. Each task then builds
- the suffix array of its dictionary: ranks of all suffixes text[s..j) of its distinct phrases, by prefix doubling;
- the suffix array of its parse: what follows the triggers is cut at further triggers into phrases, numbered in byte order, and the
  sequences of these numbers are ranked by prefix doubling, with the lengths that neighbours have in common.
Rank in the dictionary and then rank in the parse is the corpus order of the starts. A start repeats if it has L symbols in common with
a neighbour in that order: an equal suffix of a before the trigger and, by a range minimum, L - a after it. All repeats are
found so; entries with several occurrences stand in the order twice. What is found for an entry holds for all its occurrences (a join by its hash).

Hot classes (over HOT entries) are split by content: the starts of an entry are dealt into bands by their distance from the trigger, and the
class of a band is the longer text that all strings of the band cover. This goes on with bands an eighth as wide; at a width of one
the class is the string itself, and counting it is all there is to do. So no task holds more than CHUNK + HOT entries.

Null and empty texts have no symbols and lose none; so do texts shorter than L. Repeated rows repeat each other in full.
Ids may be null or repeated. The result has the input's columns, and n_bytes, kept (binary) and spans (removed runs of bytes, start
and end) in place of any of these names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import binary_array, give_back, maybe_among, saved, scratch, shuffle_partitions, slices, small_batches, table, text_bytes, text_of, trimmed, word_spans

#: Entries of one class from which it is split; entries that are sorted at once.
HOT, CHUNK = 2_000, 8_000
#: Bands that a hot class is split into at each step.
SPLIT = 8
#: Symbols under the rolling hash, and symbols between two triggers of the parse on average, for bytes and for words.
GRAMS, SPACING = {"byte": 16, "word": 4}, {"byte": 32, "word": 6}
KINDS = {"byte": np.uint8, "word": np.uint64}
BASE = np.uint32(0x9E3779B1)
_ENTRY = "class long, full1 long, full2 long, twice boolean, shift int, most int, last int, span binary"


def symbols(column: pa.Array, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """All symbols of the texts, one text after the other, and the offsets of the texts. A word is its 64-bit hash."""
    data, offsets = text_bytes(column)
    if unit == "byte":
        return data, offsets
    starts, ends, before = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    coded = binary_array(data, starts, ends).dictionary_encode()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return own[coded.indices.to_numpy()], before


def rolling(data: np.ndarray, gram: int) -> np.ndarray:
    """The polynomial hash of the `gram` (a power of two) symbols from every position on, made at all positions at once by
    doubling: H(2n, i) = H(n, i) BASE^n + H(n, i + n). The last positions, where fewer are left, are not given."""
    h = data.astype(np.uint32)
    h += np.uint32(1)
    step, power = 1, BASE
    while step < gram:
        h = h[:-step] * power + h[step:]
        with np.errstate(over="ignore"):
            step, power = step * 2, power * power
    h ^= h >> np.uint32(15)  # low bits of a product know little of high ones
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(16)
    return h


def _window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, from running minima inside blocks in both directions."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    np.minimum.accumulate(blocks[:, ::-1], axis=1, out=blocks[:, ::-1])
    return np.minimum(padded[: n - width + 1], ahead[width - 1 : n])


def phrases(data: np.ndarray, offsets: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, last start and trigger of every phrase (places in data), ascending."""
    width = least // 2
    sizes = np.diff(offsets)
    firsts, counts = offsets[:-1][sizes >= least], sizes[sizes >= least] - least + 1
    if not len(firsts):
        return (np.zeros(0, np.int64),) * 3
    keyed = rolling(data, gram).astype(np.uint64)
    keyed <<= np.uint64(32)
    keyed |= np.arange(len(keyed), dtype=np.uint64)
    low = _window_minima(keyed, width).astype(np.uint32)  # the low half is the place
    edge = np.zeros(len(data) + 1, np.int8)
    edge[firsts] += 1
    np.add.at(edge, firsts + counts, -1)
    starts = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8))
    trigger = low[starts]
    new = np.flatnonzero(np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    return starts[new], starts[np.append(new[1:] - 1, len(starts) - 1)], trigger[new].astype(np.int64)


def _parsed(keyed: DataFrame, least: int, unit: str) -> DataFrame:
    """(row_key, lo, hi, at, class, full1, full2) of every phrase: places in its document, hash of what follows the trigger, hash of all."""
    after = least - least // 2 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = symbols(batch.column("text"), unit)
            lo, hi, at = phrases(data, offsets, least, GRAMS[unit])
            raw, z = data.tobytes(), data.itemsize
            parts = lambda a, b: map(raw.__getitem__, map(slice, (a * z).tolist(), (b * z).tolist()))  # noqa: B023, E731
            classes = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, parts(at, at + after))), ">i8").astype(np.int64)
            full = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts(lo, hi + least), (at - lo).tolist())), np.int64).reshape(-1, 2)
            owner = np.searchsorted(offsets, lo, side="right") - 1
            base = offsets[owner]
            keys = batch.column("row_key").take(pa.array(owner))
            yield pa.RecordBatch.from_arrays(
                [keys, *(pa.array((x - base).astype(np.int32)) for x in (lo, hi, at)), pa.array(classes), pa.array(full[:, 0]), pa.array(full[:, 1])],
                ["row_key", "lo", "hi", "at", "class", "full1", "full2"],
            )

    return keyed.select("row_key", "text").mapInArrow(trimmed(run), "row_key binary, lo int, hi int, at int, class long, full1 long, full2 long")


def _with_symbols(keyed: DataFrame, entries: DataFrame, least: int, unit: str) -> DataFrame:
    """The entries with their symbols from lo to the end of the string that starts at hi, taken from one document each."""
    places = entries.groupBy("row_key").agg(F.collect_list(F.struct("class", "full1", "full2", "twice", "lo", "hi", "at")).alias("places"))
    texts = maybe_among(keyed.select("row_key", "text"), entries, "row_key").groupBy("row_key").agg(F.max("text").alias("text"))
    both = texts.join(places, "row_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.ascontiguousarray(symbols(batch.column("text").slice(i, 1), unit)[0])
                raw, z = data.tobytes(), data.itemsize
                p = batch.column("places")[i].values
                lo, hi, at = (p.field(c).to_numpy() for c in ("lo", "hi", "at"))
                spans = pa.array([raw[a * z : (b + least) * z] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())
                same = [p.field(c) for c in ("class", "full1", "full2", "twice")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.zeros(len(lo), np.int32)), pa.array(at - lo), pa.array(hi - lo), spans], ["class", "full1", "full2", "twice", "shift", "most", "last", "span"])
        give_back()

    return both.mapInArrow(trimmed(run), _ENTRY)


def _packed(x: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, int]:
    """The first symbols of every suffix in one number, as many as fit, and how many these are; the end of a string comes first."""
    if x.dtype == np.uint8:
        seen = np.flatnonzero(np.bincount(x, minlength=256))
        number = np.searchsorted(seen, np.arange(256))[x] + 1
    else:
        seen = np.unique(x)
        number = np.searchsorted(seen, x) + 1
    bits = int(len(seen)).bit_length()
    width = max(1, 62 // bits)
    key = number.copy()
    for j in range(1, width):
        key <<= bits
        key[:-j] |= number[j:] * (left[:-j] > j)
    return key, width


def suffix_ranks(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The suffix array of several strings, as the rank of each suffix (from its place to the end of its string) among all; equal
    suffixes share a rank. Prefix doubling: ranks by the first n symbols, taken in pairs, give those by 2 n. Only suffixes that share
    a rank and go on are sorted again, each among those of its rank: a rank leaves room for all that share it."""
    n = len(x)
    if not n:
        return np.zeros(0, np.int64)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    key, step = _packed(x, left)
    rank = np.zeros(n, np.int64)
    open_, longest = np.arange(n), int(np.diff(offsets).max())
    while True:
        order = np.argsort(key)
        ranked = key[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        sizes = np.diff(np.append(first, len(order)))
        # in a rank's room, those that come later stand behind all that come before
        base = rank[open_[order[first]]]
        head = np.flatnonzero(np.concatenate([[True], base[1:] != base[:-1]]))
        within = first - np.repeat(first[head], np.diff(np.append(head, len(first))))
        rank[open_[order]] = np.repeat(base + within, sizes)
        if step >= longest:
            return rank + 1
        open_ = open_[np.sort(order[np.repeat(sizes > 1, sizes)])]
        if not len(open_):
            return rank + 1
        goes_on = left[open_] > step
        key = rank[open_] * (n + 1)
        key[goes_on] += rank[open_[goes_on] + step] + 1
        step *= 2


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def parse_order(tails: np.ndarray, offsets: np.ndarray, unit: str) -> np.ndarray:
    """The order of strings by the suffix array of their parse.

    A phrase goes from one trigger to the end of the next, so no phrase begins another (the last ones may: nothing follows them, and
    nothing comes first): the order of the phrases' numbers is that of the symbols.
    """
    gram, n = GRAMS[unit], len(offsets) - 1
    cut = np.zeros(len(tails) + 1, bool)
    if len(tails) >= gram:
        found = np.flatnonzero(rolling(tails, gram) % np.uint32(SPACING[unit]) == 0)
        owner = np.searchsorted(offsets, found, side="right") - 1
        cut[found[found + gram <= offsets[owner + 1]]] = True
    cut[offsets[:-1]] = True
    cut[-1] = False
    starts = np.flatnonzero(cut)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    ends = np.minimum(np.append(starts[1:], len(tails)) + gram, offsets[owner + 1])
    told = np.ascontiguousarray(tails.astype(tails.dtype.newbyteorder(">")))  # so that bytes compare as symbols do
    sizes = ends - starts
    borders = np.concatenate([[0], np.cumsum(sizes)]) * told.itemsize
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(borders), pa.py_buffer(told[_ranges(starts, sizes)])]).dictionary_encode()
    number = np.empty(len(coded.dictionary), np.int64)
    number[pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(len(number))
    first = np.searchsorted(starts, offsets)
    ranks = suffix_ranks(number[coded.indices.to_numpy()], first)[first[:-1]]
    return np.argsort(ranks, kind="stable") if n else np.zeros(0, np.int64)


def _common(tails: np.ndarray, offsets: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """Symbols that each string has in common with the one before it in the order (the first: none)."""
    sizes = np.minimum(np.diff(offsets), width)
    out = np.zeros(len(order), np.int64)
    for at in range(0, len(order), 4096):
        part = order[max(0, at - 1) : at + 4096]
        rows = np.zeros((len(part), width), tails.dtype)
        rows[np.repeat(np.arange(len(part)), sizes[part]), _ranges(np.zeros(len(part), np.int64), sizes[part])] = tails[_ranges(offsets[part], sizes[part])]
        differ = rows[1:] != rows[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        out[at + (at == 0) : at + 4096] = np.minimum(first, np.minimum(sizes[part][1:], sizes[part][:-1]))
    return out


def _least_between(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of values[a + 1 .. b], for a < b, by a table of minima over powers of two."""
    levels = [values]
    while 2 ** len(levels) <= len(values):
        half = 2 ** (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    out = np.empty(len(a), np.int64)
    level = np.frexp(b - a)[1] - 1
    for k in np.unique(level):
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(levels[k][a[own] + 1], levels[k][b[own] - 2**k + 1])
    return out


def repeated_starts(x: np.ndarray, offsets: np.ndarray, most: np.ndarray, last: np.ndarray, twice: np.ndarray, least: int, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry, start and whether it repeats, for all starts of all entries.

    x, offsets: the symbols of the entries; most: where the trigger lies; last: the last start; twice: occurs more than once.
    """
    n = len(most)
    heads = pa.array([x[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), (offsets[:-1] + most).tolist(), strict=True)], pa.binary()).dictionary_encode()
    dictionary = np.frombuffer(b"".join(heads.dictionary.to_pylist()), x.dtype)
    places = np.concatenate([[0], np.cumsum([len(h) // x.itemsize for h in heads.dictionary.to_pylist()])])
    rank = np.append(suffix_ranks(dictionary, places), 0)
    tails, ends = x[_ranges(offsets[:-1] + most, np.diff(offsets) - most)], np.concatenate([[0], np.cumsum(np.diff(offsets) - most)])
    order = parse_order(tails, ends, unit)
    common = _common(tails, ends, order, least)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)

    entry = np.repeat(np.arange(n), last + 1)
    start = _ranges(np.zeros(n, np.int64), last + 1)
    before = most[entry] - start
    suffix = np.where(before > 0, rank[np.minimum(places[heads.indices.to_numpy()[entry]] + start, len(rank) - 1)], 0)
    row = np.repeat(np.arange(len(entry)), 1 + twice[entry])
    key = suffix[row] * n + place[entry[row]]
    corpus = np.argsort(key)
    row, key = row[corpus], key[corpus]
    near = np.flatnonzero(key[1:] // n == key[:-1] // n)
    a, b, need = key[near] % n, key[near + 1] % n, least - before[row[near]]
    same = a == b
    held = same.copy()
    held[~same] = _least_between(common, a[~same], b[~same]) >= need[~same]
    hit = np.zeros(len(entry), bool)
    hit[row[near[held]]] = True
    hit[row[near[held] + 1]] = True
    return entry, start, hit


def _solved(entries: DataFrame, least: int, unit: str) -> DataFrame:
    """(full1, full2, lo, hi): runs of starts that repeat, counted from an entry's first start."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        spans = t["span"].combine_chunks()
        data, offsets = text_bytes(spans.chunk(0) if isinstance(spans, pa.ChunkedArray) else spans)
        z = np.dtype(KINDS[unit]).itemsize
        most, last = (t[c].to_numpy().astype(np.int64) for c in ("most", "last"))
        entry, start, hit = repeated_starts(np.ascontiguousarray(data).view(KINDS[unit]), offsets // z, most, last, t["twice"].to_numpy(), least, unit)
        new = np.concatenate([[True], (entry[1:] != entry[:-1]) | (hit[1:] != hit[:-1])]) if len(hit) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        past = np.append(first[1:], len(hit)) - 1
        first, past = first[hit[first]], past[hit[first]]
        own, shift = entry[first], t["shift"].to_numpy()
        keys = [pa.array(t[c].to_numpy()[own]) for c in ("full1", "full2")]
        return pa.RecordBatch.from_arrays([*keys, pa.array((start[first] + shift[own]).astype(np.int32)), pa.array((start[past] + shift[own]).astype(np.int32))], ["full1", "full2", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK:
                t = pa.Table.from_batches(held).combine_chunks()
                classes = t["class"].to_numpy()
                cut = int(np.searchsorted(classes, classes[-1]))  # the last class may go on
                if cut:
                    yield solve(t.slice(0, cut).combine_chunks())
                    give_back()
                held = t.slice(cut).to_batches()
        if held and sum(b.num_rows for b in held):
            yield solve(pa.Table.from_batches(held).combine_chunks())
        give_back()

    parts = shuffle_partitions(entries.sparkSession)
    return entries.repartition(parts, "class").sortWithinPartitions("class").mapInArrow(trimmed(run), "full1 long, full2 long, lo int, hi int")


def _banded(entries: DataFrame, least: int, unit: str, width: int) -> DataFrame:
    """The entries cut into bands of `width` distances from the trigger; the class of a band is what all its strings cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = np.dtype(KINDS[unit]).itemsize
        for batch in batches:
            rows = []
            for full1, full2, twice, shift, most, last, span in zip(*(batch.column(c).to_pylist() for c in ("full1", "full2", "twice", "shift", "most", "last", "span")), strict=True):
                for near in range((most - last) // width * width, most + 1, width):
                    a, b = max(0, most - near - width + 1), min(last, most - near)
                    core = xxhash.xxh3_64_intdigest(span[(most - near) * z : (most - near + least - width + 1) * z], seed=near)
                    rows.append((core - (1 << 64) if core >> 63 else core, full1, full2, twice, shift + a, most - a, b - a, span[a * z : (b + least) * z]))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["class", "full1", "full2", "twice", "shift", "most", "last", "span"])

    return entries.mapInArrow(trimmed(run), _ENTRY)


def repeated(keyed: DataFrame, least: int, unit: str = "byte") -> DataFrame:
    """(row_key, lo, hi): all starts of repeated strings, as runs of symbols. keyed: row_key (binary), text."""
    with scratch(keyed.sparkSession) as save:
        parsed = save(_parsed(keyed, least, unit), "phrases")
        shared = save(parsed.groupBy("class").count().where("count > 1").select("class"), "shared-classes")
        parsed = maybe_among(parsed, shared, "class")
        entries = parsed.groupBy("class", "full1", "full2").agg(F.count("*").alias("n"), F.min(F.struct("row_key", "lo", "hi", "at")).alias("p"))
        entries = save(entries.select("class", "full1", "full2", (F.col("n") > 1).alias("twice"), "p.*"), "entries")
        hot = save(entries.groupBy("class").count().where(F.col("count") > HOT).select("class"), "hot-classes")
        told = [_solved(_with_symbols(keyed, maybe_among(entries, hot, "class", wanted=False), least, unit), least, unit)]
        width = least // 2
        rows = None if hot.isEmpty() else _with_symbols(keyed, maybe_among(entries, hot, "class"), least, unit)
        while rows is not None:
            width = -(-width // SPLIT)
            rows = save(_banded(rows, least, unit, width), "bands")
            counts = rows.groupBy("class").agg(F.count("*").alias("n"))
            if width == 1:
                string = F.col("span")  # the class of a string is compared with what it stands for
                again = rows.groupBy("class", F.xxhash64(string).alias("h")).agg(F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("n")).where("n > 1").select("class", "h")
                told.append(rows.withColumn("h", F.xxhash64(string)).join(again, ["class", "h"], "left_semi").select("full1", "full2", F.col("shift").alias("lo"), F.col("shift").alias("hi")))
                break
            hot = save(counts.where(F.col("n") > HOT).select("class"), "hot-bands")
            told.append(_solved(maybe_among(rows, hot, "class", wanted=False), least, unit))
            rows = None if hot.isEmpty() else maybe_among(rows, hot, "class")
        runs = save(reduce(DataFrame.unionByName, told).withColumnRenamed("lo", "from").withColumnRenamed("hi", "to"), "entry-runs")
        found = parsed.select("row_key", "lo", "full1", "full2").join(runs, ["full1", "full2"])
        return saved(found.select("row_key", (F.col("lo") + F.col("from")).alias("lo"), (F.col("lo") + F.col("to")).alias("hi")), "repeats")


def _spans(lo: np.ndarray, hi: np.ndarray, touching: bool) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping runs (and touching ones, if said) as one."""
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], lo[1:] > reach[:-1] - (not touching)])
    return lo[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(lo) - 1)]


def without_repeats(docs: DataFrame, least: int = 400, text: str = "text", doc_id: str = "doc_id", unit: str = "byte") -> DataFrame:
    """The input with n_bytes, kept and spans. unit "word": `least` counts words, whatever white space lies between them,
    and a removed run goes from the first byte of its first word to the last of its last."""
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("n_bytes", "kept", "spans")]
    own_id = F.coalesce(F.col(doc_id).cast("string"), F.lit("-"))
    keyed = docs.select(*names, text_of(text).alias("_text")).withColumn("row_key", F.unhex(F.md5(F.concat(own_id, F.lit(" "), "_text").cast("binary"))))
    found = repeated(keyed.select("row_key", F.col("_text").alias("text")), least, unit)
    runs = found.groupBy("row_key").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    n_bytes = F.octet_length("_text").cast("long")
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    plain = maybe_among(keyed, found, "row_key", wanted=False).select(*names, n_bytes.alias("n_bytes"), F.col("_text").cast("binary").alias("kept"), F.array().cast(spans).alias("spans"))
    cut = maybe_among(keyed, found, "row_key").join(runs, "row_key", "left").select(*names, n_bytes.alias("n_bytes"), F.col("_text").cast("binary").alias("_raw"), "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed = [], []
            for raw, own in zip(batch.column("_raw"), batch.column("runs"), strict=True):
                data = raw.as_buffer().to_pybytes()
                found = []
                if own.is_valid:
                    a, b = _spans(own.values.field("lo").to_numpy(), own.values.field("hi").to_numpy() + least, unit == "byte")
                    if unit == "word":
                        starts, ends, _ = word_spans(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
                        a, b = starts[a], ends[b - 1]
                    found = list(zip(a.tolist(), b.tolist(), strict=True))
                ends = [0, *(e for _, e in found)]
                kept.append(b"".join(data[a:b] for a, b in zip(ends, [*(s for s, _ in found), len(data)], strict=True)))
                removed.append([{"start": s, "end": e} for s, e in found])
            columns = [batch.column(n) for n in [*names, "n_bytes"]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary()), pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], [*names, "n_bytes", "kept", "spans"])

    return plain.unionByName(cut.mapInArrow(trimmed(run), plain.schema))


def op7_suffix_array(spark, sf_dir) -> DataFrame:
    """All documents without the bytes of repeated strings of 400 bytes."""
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
