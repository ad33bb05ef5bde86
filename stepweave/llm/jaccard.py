"""Exact Jaccard join of documents as sets of word shingles, by set-relation skipping.

Sets are sorted by one order of all shingles, rare ones first (a sketch over all documents gives the order), so that two
sets above the threshold share shingles near their fronts. The inverted index holds those fronts alone. Two relations
keep the join from comparing all pairs of a group of near copies:

* Index level. The list of a shingle is sorted by set size and cut in blocks. Classes whose range of sizes is out of reach of a
  block are skipped for the whole block, and so are those whose positions leave too few shingles to reach the threshold.
* Answer level. Each set joins the group of one highly similar set, its leader: the smallest set of the lists that it shares most
  of (a leader that has a leader takes its members along). A group is answered as a whole, block by block, with an inverted index over
  the block's whole sets. A set's answer is its overlap with each set of the block. The first set's answer is read off the index;
  the next one's is derived from the computed answer of a highly similar set: less the lists of the shingles that only that one has,
  plus the lists of those that only the new one has. The lists of what both have, nearly all, are skipped.
  What is left is sets that meet another group. A set and a group stand once for each list that brings them together, not
  once a pair, and nothing is asked where both are of one class already. Answers come back as
  spanning forests.

Overlaps are exact, on whole sets. Each skip is a bound (sizes, places in the fronts, shared front shingles), so no link
between two classes is lost. Shingles and sets are named by 64-bit hashes.

Null texts and texts without words have no shingles: they link with nothing and are their own class (component_id is the
doc_id). Rows of one set (exact copies, repeated rows) are one class. A null doc_id never is a component_id if its class has
another; a class of nulls alone has null. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepweave.llm.components import components
from stepweave.llm.shared import join_hot, text_batches, work_dir, written
from stepweave.llm.sketch import cells_of, levels, repeated_cells, test_bits, width_for
from stepweave.llm.wordhash import binary_parts, grams, mix, words_of

SHINGLE = 5
#: Cells of the sketch that orders shingles.
ORDER_CELLS = 1 << 21
BLOCK = 64
#: Computed answers that a block keeps, to derive others from.
ANSWERS = 4
#: Sets of a group, and sets that ask for it, that meet in one task.
GROUP, ASKERS = 512, 1024
#: A set joins a leader with which it shares this part of the front shingles that a link needs: groups may hold sets that don't
#: link, as they are answered as a whole, and so sets just below the threshold are not met one by one.
LEADERS = 0.25
#: How often groups follow their leader's leader: a family of near copies has one group, not one for each leader in it.
JUMPS = 2
#: Beyond the shortest front, so many hundredths of the set are indexed: a pair must share as many more of them.
EXTRA = 5


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(document, its distinct shingle hashes, sorted)."""
    for words in words_of(data, offsets, lower=True):
        h = words.hashes()
        all_grams = grams(h, n)
        for d in range(words.last - words.first):
            a, b = words.bounds[d], words.bounds[d + 1]
            if b - a >= n:
                yield words.first + d, np.unique(all_grams[a : b - n + 1])
            elif b > a:
                yield words.first + d, mix(grams(h[a:b], int(b - a)) + np.uint64(b - a))
            else:
                yield words.first + d, np.zeros(0, dtype=np.uint64)


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Shared shingles that sets of n and m need: 100 * i >= percent * (n + m - i)."""
    return -((-percent * (n + m)) // (100 + percent))


def front(n, percent: int):
    """Shingles of a set of n that are indexed."""
    return np.minimum(n, n - (-(-percent * n // 100)) + 1 + EXTRA * n // 100)


def _own_share(own: str, n: str, m: str, percent: int) -> str:
    """SQL: shingles of the front of a set of `own` that it shares with its partner, at least, if the two (n, m) link."""
    front_of = f"least({own}, {own} - cast(ceil({percent} * {own} / 100) as long) + 1 + cast(floor({EXTRA} * {own} / 100) as long))"
    return f"({front_of} - {own} + cast(ceil({percent} * ({n} + {m}) / {100 + percent}) as long))"


def _least_shared(n: str, m: str, percent: int) -> str:
    return f"least({_own_share(n, n, m, percent)}, {_own_share(m, n, m, percent)})"


def shared_fronts(n, m, percent: int):
    """Front shingles that sets of n and m share, at least, if they link."""
    return np.minimum(front(n, percent) - n, front(m, percent) - m) + least_overlap(n, m, percent)


def shared_with_range(n, low, high, percent: int):
    """The same for a set of n and some set of low ... high shingles: the smallest partner needs least of the set's own front, and
    the largest least of its own front, up to 3 by rounding."""
    low, high = np.maximum(low, -(-percent * n // 100)), np.minimum(high, 100 * n // percent)
    some = np.minimum(front(n, percent) - n + least_overlap(n, low, percent), front(high, percent) - high + least_overlap(n, high, percent) - 3)
    return np.where(low == high, shared_fronts(n, high, percent), some)


def _keys(n: int):
    def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        data, offsets = binary_parts(batch.column(1))
        for _, found in shingle_sets(data, offsets, n):
            yield found

    return keys_of


_SETS = "doc_id long, text_id long, n int, set_id long, digest long, front binary"


def name_of(shingles: np.ndarray) -> int | None:
    """A set's name, from its shingles: equal sets have one name wherever they are met."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) >> 1 if len(shingles) else None


def _sets(order, n: int, percent: int):
    """A row a document; the digest of its text and the front only where the task first meets the set."""

    def rows(batches):
        level, seen = order.value, set()
        for batch in batches:
            data, offsets = binary_parts(batch.column(1))
            sizes, names, digests, fronts = [], [], [], []
            for d, found in shingle_sets(data, offsets, n):
                name = name_of(found)
                sizes.append(len(found))
                names.append(name)
                if name is None or name in seen:
                    digests.append(None)
                    fronts.append(None)
                    continue
                seen.add(name)
                digests.append(_digest(data[offsets[d] : offsets[d + 1]].tobytes()))
                rank = (level[cells_of(found, 0, ORDER_CELLS)].astype(np.uint64) << np.uint64(56)) | (found >> np.uint64(8))
                fronts.append(found[np.argsort(rank, kind="stable")[: front(len(found), percent)]].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int32()), pa.array(names, pa.int64()), pa.array(digests, pa.int64()), pa.array(fronts, pa.binary())],
                names=["doc_id", "text_id", "n", "set_id", "digest", "front"],
            )

    return rows


def _digest(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _front_keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    data, offsets = binary_parts(batch.column(0))
    yield np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), dtype=np.uint64)


def _postings(bits, width: int):
    """(shingle, set, size and place in the set) of each indexed shingle that another set may have."""

    def rows(batches):
        for batch in batches:
            data, offsets = binary_parts(batch.column(2))
            shingles = np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), dtype=np.uint64)
            counts = np.diff(offsets) // 8
            place = np.arange(len(shingles)) - np.repeat(np.cumsum(counts) - counts, counts)
            sets = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), counts)
            size = np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), counts)
            keep = test_bits(bits.value[0], shingles, width)
            yield pa.RecordBatch.from_arrays([pa.array(shingles[keep].view(np.int64)), pa.array(sets[keep]), pa.array((size << 32 | place)[keep])], names=["shingle", "set_id", "at"])

    return rows


def _runs(key: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])


def _whole_lists(batches, columns: int) -> Iterator[list[np.ndarray]]:
    """Batches sorted by their first column, dealt again so that no list of equal keys is cut. An open list is put together once, at its end."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        if not len(now[0]):
            continue
        last = int(np.searchsorted(now[0], now[0][-1]))
        if held and (last or now[0][0] != held[-1][0][-1]):
            held.append([x[:last] for x in now])
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
        elif last:
            yield [x[:last] for x in now]
        held.append([x[last:] for x in now])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _lists(batches):
    """Lists of two sets or more, as postings with the leader of each list, its smallest set. Tasks may have met a set each: once here."""
    for shingle, sets, at in _whole_lists(batches, 3):
        order = np.lexsort((sets, shingle))
        shingle, sets, at = shingle[order], sets[order], at[order]
        new = np.ones(len(sets), dtype=bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (sets[1:] != sets[:-1])
        shingle, sets, at = shingle[new], sets[new], at[new]
        counts = np.diff(_runs(shingle))
        keep = np.repeat(counts > 1, counts)
        if not keep.any():
            continue
        counts = counts[counts > 1]
        shingle, sets, at = shingle[keep], sets[keep], at[keep]
        begins = np.cumsum(counts) - counts
        leader, size = np.repeat(sets[begins], counts), np.repeat(at[begins] >> 32, counts)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shingle, sets, at, leader, size)], names=["shingle", "set_id", "at", "leader", "leader_n"])


def _meetings(percent: int):
    """(set, group) that a list brings together: a set, and the larger group of another, if not both of one class.

    A list is sorted by size and cut in blocks; groups whose range of sizes is out of a block's reach are skipped for the whole
    block, and so are those whose places leave too few shingles. A group stands once for each list, however many of its sets are there."""

    def of_two(sets, at, group, comp, weight):
        """Lists of two sets, side by side in the arrays."""
        a, b = slice(0, None, 2), slice(1, None, 2)
        n, m, p, q = at[a] >> 32, at[b] >> 32, at[a] & 0xFFFFFFFF, at[b] & 0xFFFFFFFF
        ok = (comp[a] != comp[b]) & (group[a] != group[b]) & (percent * n <= 100 * m) & (percent * m <= 100 * n)
        ok &= np.minimum(p, q) + 1 + np.minimum(n - p - 1, m - q - 1) >= least_overlap(n, m, percent)
        first = (weight[a] < weight[b]) | ((weight[a] == weight[b]) & (group[a] < group[b]))
        return np.where(first, sets[a], sets[b])[ok], np.where(first, group[b], group[a])[ok], shared_fronts(n, m, percent)[ok]

    def of_many(sets, at, group, comp, weight):
        n, place = at >> 32, at & 0xFFFFFFFF
        groups, back = np.unique(group, return_inverse=True)
        k = len(groups)
        least, most, furthest = np.full(k, 1 << 40), np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64)
        low_comp, high_comp, heavy = np.full(k, np.iinfo(np.int64).max), np.full(k, np.iinfo(np.int64).min), np.zeros(k, dtype=np.int64)
        np.minimum.at(least, back, n)
        np.maximum.at(most, back, n)
        np.maximum.at(furthest, back, place)
        np.minimum.at(low_comp, back, comp)
        np.maximum.at(high_comp, back, comp)
        heavy[back] = weight
        order = np.argsort(n, kind="stable")
        for i in range(0, len(n), BLOCK):
            some = order[i : i + BLOCK]
            low, high = int(n[some[0]]), int(n[some[-1]])
            near = np.flatnonzero((percent * least <= 100 * high) & (100 * most >= percent * low))
            x, p, own = n[some, None], place[some, None], back[some]
            first = np.maximum(least[near][None, :], -(-percent * x // 100))
            ok = (percent * least[near][None, :] <= 100 * x) & (100 * most[near][None, :] >= percent * x) & (own[:, None] != near[None, :])
            ok &= np.minimum(p, furthest[near][None, :]) + x - p >= least_overlap(x, first, percent)
            ok &= (low_comp[near][None, :] != comp[some, None]) | (high_comp[near][None, :] != comp[some, None])
            mine, theirs = heavy[own][:, None], heavy[near][None, :]
            ok &= (mine < theirs) | ((mine == theirs) & (own[:, None] < near[None, :]))
            i_, j_ = np.nonzero(ok)
            if len(i_):
                yield sets[some[i_]], groups[near[j_]], shared_with_range(n[some[i_]], least[near[j_]], most[near[j_]], percent)

    def rows(batches):
        for columns in _whole_lists(batches, 6):
            cuts = _runs(columns[0])
            counts = np.diff(cuts)
            columns = columns[1:]  # set, at, group, comp, weight
            begins = cuts[:-1]
            mixed = np.maximum.reduceat(columns[3], begins) != np.minimum.reduceat(columns[3], begins)
            two = np.repeat(mixed & (counts == 2), counts)
            found = [of_two(*[c[two] for c in columns])]
            for a, b in zip(begins[mixed & (counts > 2)], cuts[1:][mixed & (counts > 2)], strict=True):
                found += of_many(*[c[a:b] for c in columns])
            u, v, k = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(k)], names=["set_id", "group", "need"])

    return rows


def _arrays(wanted, width: int, n: int):
    """Whole sets of the texts whose digest is wanted (a bloom filter may let others through; the join drops them)."""

    def rows(batches):
        seen = set()
        for batch in batches:
            data, offsets = binary_parts(batch.column(0))
            digests = np.array([_digest(data[offsets[i] : offsets[i + 1]].tobytes()) for i in range(len(offsets) - 1)], dtype=np.int64)
            hit = np.flatnonzero(test_bits(wanted.value, digests.view(np.uint64), width)) if len(digests) else []
            if not len(hit):
                continue
            texts = pa.array([data[offsets[i] : offsets[i + 1]].tobytes() for i in hit], pa.binary())
            found = {name: s.tobytes() for _, s in shingle_sets(*binary_parts(texts), n) if (name := name_of(s)) is not None and name not in seen}
            seen.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], names=["set_id", "shingles"])

    return rows


class _Block:
    """Whole sets of a block with an inverted index, and the computed answers from which others are derived.

    An answer is the overlaps of one set with all sets of the block. `read` counts the postings that answers have cost."""

    def __init__(self, names: list[int], held: list[np.ndarray]) -> None:
        self.names, self.held = np.array(names, dtype=np.int64), held
        self.sizes = np.array([len(x) for x in held], dtype=np.int64)
        keys, owners = np.concatenate(held), np.repeat(np.arange(len(held)), self.sizes)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order]
        self.root = np.arange(len(held))  # sets known to be linked have one root
        self.answers: list[tuple[np.ndarray, np.ndarray]] = []  # (set, its overlaps), the last used one last
        self.read = 0

    def _postings(self, shingles: np.ndarray) -> np.ndarray:
        """How many of the shingles each set of the block has."""
        a, b = np.searchsorted(self.keys, shingles, side="left"), np.searchsorted(self.keys, shingles, side="right")
        n = b - a
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        self.read += len(at)
        return np.bincount(self.owners[at], minlength=len(self.names))

    def overlaps(self, found: np.ndarray) -> np.ndarray:
        """The answer of a set (sorted, distinct shingles): derived from that of the most similar of the ANSWERS last computed ones, if
        the two differ in fewer shingles than the set has."""
        best, own, theirs = None, found, None
        for i, (other, _) in enumerate(self.answers):
            if 2 * min(len(other), len(found)) <= max(len(other), len(found)):
                continue
            at = np.minimum(np.searchsorted(other, found), len(other) - 1)
            added = other[at] != found
            n = int(added.sum())
            gone = len(other) - (len(found) - n)
            if n + gone < (len(found) if best is None else len(own) + theirs):
                best, own, theirs = i, found[added], gone
        if best is None:
            shared = self._postings(found)
        else:
            other, had = self.answers.pop(best)
            at = np.minimum(np.searchsorted(found, other), len(found) - 1)
            shared = had + self._postings(own) - self._postings(other[found[at] != other])
            if len(self.answers) < ANSWERS - 1:
                self.answers.append((other, had))
        self.answers = [*self.answers[-(ANSWERS - 1) :], (found, shared)]
        return shared

    def linked(self, found: np.ndarray, percent: int) -> np.ndarray:
        """Places of the sets that link with one."""
        shared = self.overlaps(found)
        return np.flatnonzero((100 * shared >= percent * (self.sizes + len(found) - shared)) & (shared > 0))

    def join(self, found: np.ndarray, percent: int) -> np.ndarray:
        """Puts the sets that link with one under one root; the roots that they had."""
        tops = np.unique(self.root[self.linked(found, percent)])
        if len(tops) > 1:
            self.root[np.isin(self.root, tops)] = tops[0]
        return tops


def _block_links(percent: int):
    """Of rows sorted by group, block pair and `asks` (false first): links between the sets that ask and those that are held.

    A block that is paired with itself (`inner`) asks itself. Links come out as a spanning forest of the sets that met, never as
    all pairs of a group."""

    def forest(block: _Block):
        for found in block.held:
            block.join(found, percent)
        for i in np.flatnonzero(block.root != np.arange(len(block.root))):
            yield int(block.names[i]), int(block.names[block.root[i]])

    def rows(batches):
        name, names, held, block = None, [], [], None
        for batch in batches:
            out = []
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for group, pair, member, asks, inner, raw in zip(*columns, strict=True):
                if (group, pair) != name:
                    if name is not None and own and held:
                        out += forest(_Block(names, held))
                    name, names, held, block, own = (group, pair), [], [], None, inner
                found = np.frombuffer(raw, dtype=np.uint64)
                if not asks:
                    names.append(member)
                    held.append(found)
                elif held:
                    block = block or _Block(names, held)
                    out += [(member, int(block.names[top])) for top in block.join(found, percent)]
            if out:
                yield _links(out)
        if name is not None and own and held and (rest := list(forest(_Block(names, held)))):
            yield _links(rest)

    return rows


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _bloom(digests: DataFrame, width: int) -> np.ndarray:
    """Digests as bits of a fixed width, from the executors."""

    def keys_of(batch):
        keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        yield np.concatenate([keys, keys])  # counted twice, so that "repeated" is "present"

    return repeated_cells(digests, keys_of, width)[0]


_OWN = "cast(pmod(xxhash64(set_id), {}) as int)"


def _inside(members: DataFrame) -> DataFrame:
    """members(set_id, group) -> roles in which all pairs of a group meet: blocks of GROUP sets, each pair of blocks once."""
    blocks = members.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("blocks"))
    own = members.join(blocks, "group").withColumn("b", F.expr(_OWN.format("blocks")))
    own = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.least("b", "o") * F.lit(1 << 20).cast("long") + F.greatest("b", "o")
    return own.select("group", pair.alias("pair"), "set_id", (F.col("b") < F.col("o")).alias("asks"), (F.col("b") == F.col("o")).alias("inner"))


def _across(asked: DataFrame, members: DataFrame) -> DataFrame:
    """asked(set_id, group), members(set_id, group) -> roles in which each set that asks meets all members.

    A group is dealt as blocks of GROUP members times parts of ASKERS sets that ask: a hot group is many tasks."""
    count = lambda df, most, name: df.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    parts = count(members, GROUP, "blocks").join(count(asked, ASKERS, "parts"), "group")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    asking = asked.join(parts, "group").select("group", every("blocks").alias("b"), F.expr(_OWN.format("parts")).alias("p"), "set_id", F.lit(True).alias("asks"))
    held = members.join(parts, "group").select("group", F.expr(_OWN.format("blocks")).alias("b"), every("parts").alias("p"), "set_id", F.lit(False).alias("asks"))
    return held.union(asking).select("group", F.expr("b * 1048576L + p").alias("pair"), "set_id", "asks", F.lit(False).alias("inner"))


def _verified(docs: DataFrame, sets: DataFrame, roles: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (u, v) by whole sets, of the roles in which they meet."""
    spark = docs.sparkSession
    named = sets.where("digest is not null").groupBy("set_id").agg(F.min("digest").alias("digest"))
    roles = written(roles.join(named, "set_id"), work_dir(spark, "jaccard-roles"))
    width = width_for(roles.count(), most=1 << 27)
    bits = spark.sparkContext.broadcast(_bloom(roles.select("digest"), width))
    arrays = docs.select("text").mapInArrow(_arrays(bits, width, n), "set_id long, shingles binary")
    arrays = arrays.groupBy("set_id").agg(F.first("shingles").alias("shingles"))
    ready = roles.join(arrays, "set_id").select("group", "pair", "set_id", "asks", "inner", "shingles")
    return ready.repartition("group", "pair").sortWithinPartitions("group", "pair", "asks").mapInArrow(_block_links(percent), "u long, v long")


def text_id(text: str) -> Column:
    """A text's 64-bit hash, by which classes name it."""
    return F.xxhash64(F.col(text).cast("string"))


def jaccard_classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = 80) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_shingles, component_id), a row for each of docs.

    component_id: the smallest doc_id that links reach."""
    known, alone = _classes(docs, shingle, percent)
    known = written(known, work_dir(docs.sparkSession, "jaccard-known"))
    smallest = known.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return join_hot(known, smallest, "class").select("doc_id", "n_shingles", "component_id").union(alone)


def one_of_each_class(docs: DataFrame, shingle: int = SHINGLE, percent: int = 80) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, text_id), a row for each class of texts with words: the smallest doc_id (null after all others),
    and the smallest text_id among its rows of the class. Several classes may have one doc_id, or null."""
    known, _ = _classes(docs, shingle, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_id"))
    return known.groupBy("class").agg(first.alias("first")).select("first.doc_id", "first.text_id")


def _classes(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_id, n_shingles, class) of the rows with words, and the rows of jaccard_classes of those without."""
    spark = docs.sparkSession
    text_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    root = work_dir(spark, "jaccard")
    order = spark.sparkContext.broadcast(levels(docs, _keys(shingle), ORDER_CELLS))
    sets = written(docs.withColumn("text_id", text_id("text")).mapInArrow(_sets(order, shingle, percent), _SETS), f"{root}/sets")

    fronts = sets.where("front is not null")
    indexed = fronts.agg(F.sum(F.octet_length("front")).alias("n")).first().n or 0
    width = width_for(indexed // 8)
    bits = spark.sparkContext.broadcast(repeated_cells(fronts.select("front"), _front_keys, width))
    postings = fronts.select("set_id", "n", "front").mapInArrow(_postings(bits, width), "shingle long, set_id long, at long")
    lists = postings.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(_lists, "shingle long, set_id long, at long, leader long, leader_n long")
    lists = written(lists, f"{root}/lists")

    # each set and its leader, if they share as many indexed shingles as a link needs
    size = F.expr("shiftright(at, 32)").alias("n")
    met = lists.where("set_id <> leader").groupBy("set_id", "leader", size, "leader_n").agg(F.count(F.lit(1)).alias("k"))
    met = met.where(f"{percent} * leader_n <= 100 * n and {percent} * n <= 100 * leader_n and k >= {LEADERS} * {_least_shared('n', 'leader_n', percent)}")
    star = written(met.groupBy("set_id").agg(F.max_by("leader", F.struct(F.col("k"), -F.col("leader"))).alias("group")), f"{root}/star")
    for _ in range(JUMPS):  # a leader that has a leader takes its members along
        up = star.select(F.col("set_id").alias("group"), F.col("group").alias("up"))
        star = star.join(up, "group", "left").select("set_id", F.coalesce("up", "group").alias("group"))
    star = written(star, f"{root}/groups")
    members = star.union(star.select(F.col("group").alias("set_id"), "group").distinct().join(star, "set_id", "left_anti").select("set_id", "group"))
    members = written(members, f"{root}/members")
    links = _verified(docs, sets, _inside(members), shingle, percent)
    classes = written(components(links), f"{root}/classes")

    # sets and other groups
    weights = members.groupBy("group").agg(F.count(F.lit(1)).alias("weight"))
    placed = members.join(classes.withColumnRenamed("node", "set_id"), "set_id", "left").join(weights, "group")
    placed = placed.select("set_id", "group", F.coalesce("component", "set_id").alias("comp"), "weight")
    # always a shuffle, so that shuffled bytes grow as the input does
    placed = lists.join(placed.hint("merge"), "set_id", "left").select("shingle", "set_id", "at", F.coalesce("group", "set_id").alias("group"), F.coalesce("comp", "set_id").alias("comp"), F.coalesce("weight", F.lit(1)).alias("weight"))
    meet = placed.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(_meetings(percent), "set_id long, group long, need long")
    meet = meet.groupBy("set_id", "group").agg(F.count(F.lit(1)).alias("k"), F.min("need").alias("need"))
    meet = written(meet.where("k >= need").select("set_id", "group"), f"{root}/meetings")
    groups = meet.select("group").distinct()
    asked_for = members.join(groups, "group", "left_semi").select("set_id", "group")
    asked_for = asked_for.union(groups.join(members.select("group").distinct(), "group", "left_anti").select(F.col("group").alias("set_id"), "group"))
    more = _verified(docs, sets, _across(meet, asked_for), shingle, percent)
    final = components(classes.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))

    known = sets.where("set_id is not null").select("doc_id", "text_id", "n", F.col("set_id").alias("node")).join(final, "node", "left")
    known = known.select("doc_id", "text_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "node").alias("class"))
    return known, sets.where("set_id is null").select("doc_id", F.lit(0).cast("long"), "doc_id")
