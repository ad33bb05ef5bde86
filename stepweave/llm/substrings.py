"""Substring deduplication: words inside a window that an earlier place already has are cut out.

No text is shuffled unless it may lose words:

1. Count-min prefilter, in two steps. Every window of `window` words has a core, the k words in it with the smallest hash.
   Equal windows have equal cores at equal offsets, so a core's count is never below that of a window around it, and there is
   about one core for eight windows. Each task counts the cores of its texts in a sketch; the sketches are merged; one bit
   a cell says "twice or more". Then each task counts the windows themselves, those alone whose core is counted twice, in
   a second sketch, which is merged in the same way.
2. Exact grouping of the windows that both sketches count twice. They meet at their core: a row is a core's place with the hashes
   of the windows around it, so that the shuffle has a row for a core and not for a window. A window is known by its core's
   hash and its own, 128 bits. Rows come sorted by place, so the first of equal windows is the earliest; all others are cut.
   Windows around cores that are counted very often are dealt one by one, by their hash and a salt, and the
   earliest of each salt meet the others: no task gets all of a hot passage.
3. The cut windows, as runs for each document, meet the texts that the sketches have not cleared.

The sketches lose no window: they may only let through some that occur once, which pass 2 drops. Their width grows with the texts
up to a bound (sketch.width_for). Beyond it, at some gigabytes a sketch, they let more through, at the cost of a larger shuffle.

Rows with a null text have no words. A null doc_id comes after all others. Repeated rows (same doc_id and same text) are one
document: each gets the result of that document. Rows that share a doc_id and not the text are separate documents, of
which none is earlier. A text with fewer words than a window keeps all. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from stepweave.llm.shared import text_batches, work_dir, written
from stepweave.llm.sketch import HOT_WIDTH, repeated_cells, test_bits, width_for
from stepweave.llm.wordhash import Words, binary_parts, grams, words_of

WINDOW = 20
CORE = 6
#: Tasks over which the places of one hot window are dealt.
SALTS = 32
#: A place's doc_id where it is null: after all others.
LAST_ID = (1 << 63) - 1
#: Bytes of text for each core, about; only the width of the sketches depends on it.
BYTES_A_CORE = 40
#: Rows that are grouped at once.
ROWS = 1 << 15


def _leftmost(values: np.ndarray, n: int) -> np.ndarray:
    """Where the smallest (leftmost, of equals) of each n consecutive values is."""
    at = np.arange(len(values))
    done = 1
    while done < n:
        step = min(done, n - done)
        a, b = at[:-step], at[step:]
        at = np.where(values[b] < values[a], b, a)
        done += step
    return at


def _digest(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class _Filter:
    """The sketches as bits: cores counted twice, cores counted very often, windows counted twice (None while they are counted)."""

    def __init__(self, width: int, window: int, core: int, cores=None, windows=None) -> None:
        self.width, self.window, self.core, self.cores, self.windows = width, window, core, cores, windows

    def places(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word hashes, the starts of all windows, each one's core place, and the hashes of all k words."""
        h = words.hashes()
        if len(h) < self.window:
            return h, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        doc = words.per_doc()
        starts = np.flatnonzero(doc[: len(h) - self.window + 1] == doc[self.window - 1 :])
        k = grams(h, self.core)
        return h, starts, _leftmost(k, self.window - self.core + 1)[starts], k

    def left(self, words: Words) -> tuple[np.ndarray, ...]:
        """Of the windows that may be repeated: word hashes, starts, core places, core hashes, window hashes."""
        h, starts, places, k = self.places(words)
        if len(starts):
            some, back = np.unique(places, return_inverse=True)
            on = test_bits(self.cores[0], k[some], self.width)[back]
            starts, places = starts[on], places[on]
        if not len(starts):
            return h, starts, places, k[:0], k[:0]
        own = grams(h, self.window)[starts]
        if self.windows is not None:
            on = test_bits(self.windows, own, self.width)
            starts, places, own = starts[on], places[on], own[on]
        return h, starts, places, k[places], own

    def core_keys(self, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for words in words_of(*binary_parts(batch.column(1))):
            _, _, places, k = self.places(words)
            yield k[np.unique(places)]

    def often(self, keys: np.ndarray) -> np.ndarray:
        return test_bits(self.cores[1], keys, min(self.width, HOT_WIDTH))


def _window_keys(held):
    def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for words in words_of(*binary_parts(batch.column(1))):
            yield held.value.left(words)[4]

    return keys_of


_PLACES = "key long, salt int, id long, place int, digest long, mask int, hashes binary"


def _cells(numbers: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary cell for each count, of so many 8-byte numbers."""
    ends = np.concatenate([[0], 8 * np.cumsum(counts)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(numbers).tobytes())])


def _place_rows(held):
    """A row for each core's place: bit b of its mask is the window that starts b words before it. Around hot cores, a row a window."""

    def rows(batches):
        kept = held.value
        for task, batch in enumerate(batches):
            ids = batch.column(0).fill_null(LAST_ID).to_numpy(zero_copy_only=False)
            data, offsets = binary_parts(batch.column(1))
            for words in words_of(data, offsets):
                h, starts, places, cores, own = kept.left(words)
                if not len(starts):
                    continue
                doc = np.searchsorted(words.bounds, starts, side="right") - 1
                digests = np.zeros(words.last - words.first, dtype=np.int64)
                for d in np.unique(doc):
                    digests[d] = _digest(data[offsets[words.first + d] : offsets[words.first + d + 1]].tobytes())
                begin = words.bounds[doc]
                hot = kept.often(cores)
                if hot.any():
                    second = grams(h, kept.window, second=True)[starts[hot]]
                    i = ids[words.first + doc[hot]]
                    salt = 1 + ((np.uint64(task) + i.view(np.uint64)) % np.uint64(SALTS)).astype(np.int32)
                    n = len(i)
                    yield _place_batch(own[hot], salt, i, starts[hot] - begin[hot], digests[doc[hot]], np.ones(n, dtype=np.int32), second, np.ones(n, dtype=np.int64))
                cold = np.flatnonzero(~hot)
                if len(cold):
                    at = places[cold]
                    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
                    counts = np.diff(np.concatenate([first, [len(at)]]))
                    mask = np.add.reduceat(1 << (at - starts[cold]), first).astype(np.int32)
                    some = cold[first]
                    yield _place_batch(cores[some], np.zeros(len(some), dtype=np.int32), ids[words.first + doc[some]], places[some] - begin[some], digests[doc[some]], mask, own[cold], counts)

    return rows


def _place_batch(key, salt, ids, place, digest, mask, hashes, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(_long(key)), pa.array(salt), pa.array(ids.astype(np.int64)), pa.array(place.astype(np.int32)), pa.array(digest), pa.array(mask), _cells(hashes, counts)],
        names=["key", "salt", "id", "place", "digest", "mask", "hashes"],
    )


def _bits(mask: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, words before the place) of each window of the masks, by row and start."""
    before = np.arange(window, -1, -1)
    row, column = np.nonzero((mask[:, None].astype(np.int64) >> before) & 1)
    return row, before[column]


#: A cut window has a place and mask; the earliest of a salted group goes on, with its key and second hash.
_CUT = "id long, digest long, place int, mask int, key long, second long"


def _later(window: int):
    """Of rows sorted by (key, salt, id, place): of equal windows of a group, all but those at the earliest place are cut.

    What is kept of an open group is the earliest place of each of its windows."""

    def blocks(batches):
        """Columns of ROWS rows or more."""
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
                if n >= ROWS:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, n = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def rows(batches):
        known, open_hash, open_id, open_start = None, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for table in blocks(batches):
            key, salt, ids, place, digest, mask = (table.column(i).to_numpy() for i in range(6))
            data, offsets = binary_parts(table.column(6))
            hashes = np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), dtype=np.uint64)
            row, before = _bits(mask, window)
            start = place[row] - before
            group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (salt[1:] != salt[:-1]))])
            if known != (key[0], salt[0]):
                open_hash, open_id, open_start = open_hash[:0], open_id[:0], open_start[:0]
            old = len(open_hash)
            every_group = np.concatenate([np.zeros(old, dtype=np.int64), group[row]])
            every_hash = np.concatenate([open_hash, hashes])
            every_id, every_start = np.concatenate([open_id, ids[row]]), np.concatenate([open_start, start])
            order = np.lexsort((every_hash, every_group))  # stable: places stay in order
            new = np.ones(len(order), dtype=bool)
            new[1:] = (every_group[order[1:]] != every_group[order[:-1]]) | (every_hash[order[1:]] != every_hash[order[:-1]])
            first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
            later = np.zeros(len(order), dtype=bool)
            later[order] = (every_id[order] != every_id[first]) | (every_start[order] != every_start[first])
            own_later = later[old:]
            cut = np.bincount(row, weights=np.where(own_later, 1 << before, 0), minlength=len(mask)).astype(np.int32)
            some = np.flatnonzero(cut)
            if len(some):
                none = pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(digest[some]), pa.array(place[some]), pa.array(cut[some]), none, none], names=["id", "digest", "place", "mask", "key", "second"])
            on = row[(salt[row] > 0) & ~own_later]
            if len(on):
                second = _long(hashes[(salt[row] > 0) & ~own_later])
                yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(digest[on]), pa.array(place[on]), pa.array(mask[on]), pa.array(key[on]), pa.array(second)], names=["id", "digest", "place", "mask", "key", "second"])
            # the last group stays open
            known = (key[-1], salt[-1])
            keep = order[new]
            keep = keep[every_group[keep] == group[-1]]
            open_hash, open_id, open_start = every_hash[keep], every_id[keep], every_start[keep]

    return rows


def _runs(window: int):
    """Of cut windows sorted by document: one row a document, with (begin, end) of the words to cut, as 32-bit integers."""

    def row(name, starts):
        starts = np.unique(np.concatenate(starts))
        breaks = np.flatnonzero(np.diff(starts) > window)
        begin = starts[np.concatenate([[0], breaks + 1])]
        end = starts[np.concatenate([breaks, [len(starts) - 1]])] + window
        return (*name, np.stack([begin, end], 1).astype(np.uint32).tobytes())

    def rows(batches):
        open_name, held = None, []
        for batch in batches:
            ids, digest, place, mask = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if not len(ids):
                continue
            at, before = _bits(mask, window)
            starts = place[at] - before
            begins = np.concatenate([[0], np.flatnonzero((ids[1:] != ids[:-1]) | (digest[1:] != digest[:-1])) + 1, [len(ids)]])
            of_row = np.searchsorted(at, begins)
            out = []
            for a, b, c in zip(begins[:-1], of_row[:-1], of_row[1:], strict=True):
                name = (int(ids[a]), int(digest[a]))
                if name != open_name:
                    if held:
                        out.append(row(open_name, held))
                    open_name, held = name, []
                held.append(starts[b:c])
            if out:
                yield _run_batch(out)
        if held:
            yield _run_batch([row(open_name, held)])

    return rows


def _run_batch(rows):
    a, b, c = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], names=["id", "digest", "runs"])


def _texts(held, schema: pa.Schema, with_text: bool):
    """Each row with its key; the text goes along, packed, where the sketches have not cleared it (or where it is asked for)."""

    def rows(batches):
        for batch in batches:
            data, offsets = binary_parts(batch.column(1))
            suspect = np.zeros(len(offsets) - 1, dtype=bool)
            for words in words_of(data, offsets):
                starts = held.value.left(words)[1]
                suspect[words.first + np.unique(np.searchsorted(words.bounds, starts, side="right") - 1)] = True
            texts = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(len(suspect))]
            ids = batch.column(0).fill_null(LAST_ID).to_pylist()
            packed = [pa.compress(t, codec="zstd", asbytes=True) if s or with_text else None for t, s in zip(texts, suspect, strict=True)]
            done = [_finished(t, b"") if not s else (None, None, None, None) for t, s in zip(texts, suspect, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(batch.num_columns) if i != 1],
                    batch.column(1).is_null(),
                    pa.array(ids, pa.int64()),
                    pa.array([_digest(t) for t in texts], pa.int64()),
                    pa.array(packed, pa.binary()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([d[0] for d in done], pa.int64()),
                    pa.array([d[2] for d in done], pa.string()),
                ],
                schema=schema,
            )

    return rows


def _finished(text: bytes, runs: bytes) -> tuple[int, int, str, bytes | None]:
    """Words, words cut, digest of the kept ones, and the text without the cut ones (None: as it was)."""
    parts = text.split()
    if not runs:
        return len(parts), 0, hashlib.sha256(b" ".join(parts)).hexdigest(), None
    kept, at, cut = [], 0, 0
    for begin, end in np.frombuffer(runs, dtype=np.uint32).reshape(-1, 2).tolist():
        kept += parts[at:begin]
        at, cut = end, cut + end - begin
    kept += parts[at:]
    joined = b" ".join(kept)
    return len(parts), cut, hashlib.sha256(joined).hexdigest(), joined


def cut_repeats(docs: DataFrame, window: int = WINDOW, core: int = CORE, with_text: bool = True, width: int | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> its columns, text cut (with_text), n_words, n_removed, kept_sha256.

    A text that loses words becomes the kept ones, joined by one space; any other stays as it is. Without with_text only
    doc_id and the counts come back. window: up to 30 words. width: cells in each row of a sketch; set from the size of the texts by default."""
    spark = docs.sparkSession
    text_batches(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if width is None:
        n_bytes = plain.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
        width = width_for(n_bytes // BYTES_A_CORE)
    cores = repeated_cells(plain, _Filter(width, window, core).core_keys, width)
    counted = spark.sparkContext.broadcast(_Filter(width, window, core, cores))
    windows, _ = repeated_cells(plain, _window_keys(counted), width)
    counted.unpersist()
    held = spark.sparkContext.broadcast(_Filter(width, window, core, cores, windows))

    order = ["key", "salt", "id", "place"]
    places = plain.mapInArrow(_place_rows(held), _PLACES)
    once = written(places.repartition("key", "salt").sortWithinPartitions(*order).mapInArrow(_later(window), _CUT), work_dir(spark, "windows"))
    salted = once.where("key is not null")
    least = salted.groupBy("key", "second").agg(F.min(F.struct("id", "place")).alias("least"))
    hot = salted.join(least, ["key", "second"]).where("id > least.id or (id = least.id and place > least.place)")
    columns = ["id", "digest", "place", "mask"]
    cut = once.where("key is null").select(*columns).union(hot.select(*columns))
    runs = cut.repartition("id", "digest").sortWithinPartitions("id", "digest").mapInArrow(_runs(window), "id long, digest long, runs binary")
    return _applied(docs, runs, held, with_text)


def _applied(docs: DataFrame, runs: DataFrame, held, with_text: bool) -> DataFrame:
    others = [c for c in docs.columns if c not in ("doc_id", "text")] if with_text else []
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(others)])
    fields = [f for f in packed.schema if f.name != "text"]
    own = [StructField("null_text", BooleanType()), StructField("id", LongType()), StructField("digest", LongType()), StructField("packed", BinaryType()), StructField("size", LongType()), StructField("n_words", LongType()), StructField("kept_sha256", StringType())]
    sent = StructType(fields + own)
    seen = packed.mapInArrow(_texts(held, to_arrow_schema(sent), with_text), sent)
    joined = seen.join(runs, ["id", "digest"], "left")
    text = [StructField("text", StringType())] if with_text else []
    out = StructType([*fields[:1], *text, *fields[1:], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())])
    schema = to_arrow_schema(out)
    joined = joined.select(*[f.name for f in fields], "null_text", "packed", "size", "n_words", "kept_sha256", "runs")

    def rows(batches):
        for batch in batches:
            n = len(fields)
            null_text, packs, sizes, n_words, sha, cuts = (batch.column(n + i).to_pylist() for i in range(6))
            texts, words, removed, digests = [], [], [], []
            for absent, pack, size, w, d, cut in zip(null_text, packs, sizes, n_words, sha, cuts, strict=True):
                gone, text = 0, None
                if pack is not None:
                    text = pa.decompress(pack, decompressed_size=size, codec="zstd", asbytes=True)
                if w is None:
                    w, gone, d, kept = _finished(text, cut or b"")
                    text = text if kept is None else kept
                texts.append(None if absent else text)
                words.append(w)
                removed.append(gone)
                digests.append(d)
            columns = [batch.column(0), *([pa.array(texts, pa.binary()).cast(pa.string())] if with_text else []), *[batch.column(i) for i in range(1, n)]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], schema=schema)

    result = joined.mapInArrow(rows, out)
    return result.select("doc_id", *(["text"] if with_text else []), *[F.col(f"_{i}").alias(c) for i, c in enumerate(others)], "n_words", "n_removed", "kept_sha256") if with_text else result
