"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Features are lower-cased words. The labelled examples are a bounded sample
(`examples` rows a class, by hash order of doc_id: a documented parameter), and all features of the examples count; those that no
example has can't bring a text nearer to any, and are left out of its norm. A feature's document frequency is counted over all documents,
labelled or not. Its weight is its inverse document frequency times the square of the log ratio of its shares of the two classes, smoothed
by PRIOR examples of either kind: the neighbours of a text then are those that share the words in which the classes differ, at any number
of examples. Plain TF-IDF weights make neighbours of texts on one topic; README has the figures of both.

The index holds the examples in blocks of BLOCK. Features that many examples have (DENSE of them) stand in the blocks, as
matrices with the largest weight of each feature; all others are inverted lists. For a document, the lists give what these others add to its
cosine to each example; with the dot product of the blocks' maxima this bounds its cosine to all examples of a block. The best block is
scored first, then only blocks whose bound is above the k-th best cosine so far: the k nearest are exact.

Neighbours vote by distance weight 1 / (0.1 + 1 - cosine). The votes become scores by a logistic curve fitted to the
examples' own votes (each left out of its own), weighted to the classes' true shares: about that share of documents with score s
is toxic. Evidence is the nearest examples and their cosines.

Texts without features (empty and null ones too) get the share of toxic ones among such examples. A doc_id that several
label rows name is toxic if one of them says so; null labels and ids are left out. With labels of one class only, or none,
each score is that class (0 for none). Repeated rows get equal scores. An empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from stepweave.llm.shared import clear_names, give_back, text_batches, work_dir, written
from stepweave.llm.wordhash import Words, binary_parts, words_of

EXAMPLES, PRIOR = 3000, 10.0
NEIGHBOURS, BLOCK, TOGETHER, DENSE = 15, 64, 64, 512
#: Features of a slice, whose document frequencies are summed in one task.
SLICE = 1 << 16

#: Letters and digits of ASCII, and all bytes of other characters.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def counted(words: Words, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place in the sorted vocabulary, occurrences) of the vocabulary's features in a chunk."""
    doc, feature = words.per_doc(), words.hashes()
    if not len(vocabulary):
        return (np.zeros(0, dtype=np.int64),) * 3
    at = np.searchsorted(vocabulary, feature)
    at[at == len(vocabulary)] = 0
    hit = vocabulary[at] == feature
    pair, n = np.unique(doc[hit].astype(np.int64) * len(vocabulary) + at[hit], return_counts=True)
    return pair // len(vocabulary), pair % len(vocabulary), n


def _example_rows(batches):
    """(example, label, feature) for each distinct feature of an example."""
    for batch in batches:
        data, offsets = binary_parts(batch.column(2))
        for words in words_of(data, offsets, lower=True, word_bytes=LETTERS):
            doc, feature = words.per_doc(), words.hashes()
            order = np.lexsort((feature, doc))
            doc, feature = doc[order], feature[order]
            first = np.ones(len(doc), dtype=bool)
            first[1:] = (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])
            rows = pa.array(words.first + doc[first])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(feature[first].view(np.int64))], names=["example", "toxic", "feature"])


def _vector_rows(held):
    """(example, toxic, places, occurrences): a row an example."""

    def rows(batches):
        for batch in batches:
            data, offsets = binary_parts(batch.column(2))
            places, counts = [], []
            for words in words_of(data, offsets, lower=True, word_bytes=LETTERS):
                doc, at, n = counted(words, held.value)
                cuts = np.searchsorted(doc, np.arange(words.last - words.first + 1))
                places += [at[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                counts += [n[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, kind), pa.array(counts, kind)], names=["example", "toxic", "places", "counts"])

    return rows


def _document_frequencies(docs: DataFrame, held) -> tuple[np.ndarray, int]:
    """In how many of docs (text) each feature stands, and how many docs there are. Tasks hand over sums in slices, merged on the executors."""

    def count(batches):
        total, n = np.zeros(len(held.value), dtype=np.int64), 0
        for batch in batches:
            n += batch.num_rows
            data, offsets = binary_parts(batch.column(0))
            for words in words_of(data, offsets, lower=True, word_bytes=LETTERS):
                at = counted(words, held.value)[1]
                np.add.at(total, at, 1)
        slices, sums = [-1], [np.array([n]).tobytes()]
        for a in range(0, len(total), SLICE):
            if total[a : a + SLICE].any():
                slices.append(a // SLICE)
                sums.append(total[a : a + SLICE].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(sums, pa.binary())], names=["slice", "sums"])

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(sums, dtype=np.int64)
                total[part] = total[part] + own if part in total else own
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "sums"])

    kind = "slice int, sums binary"
    found, n = np.zeros(len(held.value), dtype=np.int64), 0
    for part, sums in docs.mapInArrow(count, kind).repartition("slice").mapInArrow(merge, kind).collect():
        own = np.frombuffer(bytes(sums), dtype=np.int64)
        if part < 0:
            n = int(own[0])
        else:
            found[part * SLICE : part * SLICE + len(own)] = own
    return found, n


def contrast(a: np.ndarray, b: np.ndarray, n1: int, n0: int, prior: float = PRIOR) -> np.ndarray:
    """Squared log ratio of a feature's shares: a of n1 toxic examples have it, b of n0 others."""
    n1, n0 = max(1, n1), max(1, n0)
    share = n1 / (n1 + n0)
    return np.log(((a + prior * share) / n1) / ((b + prior * (1 - share)) / n0)) ** 2


@dataclass
class Index:
    vocabulary: np.ndarray  # sorted feature hashes
    weight: np.ndarray  # of each feature
    ids: np.ndarray  # of the examples that have features, in block order
    toxic: np.ndarray
    place: np.ndarray  # of each feature among those of the blocks; -1: it has an inverted list
    blocks: list[tuple[np.ndarray, np.ndarray]]  # features of a block, weights (feature, example)
    most: np.ndarray  # (feature, block): the largest weight
    begin: np.ndarray  # of each feature's list, and the end of the last
    example: np.ndarray  # lists: examples
    share: np.ndarray  # and weights
    slope: float = 1.0
    offset: float = 0.0
    none: float = 0.0  # the score of a text without features
    constant: float | None = None

    def unit(self, n_docs: int, doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Weights of a chunk's occurrences, of norm 1 in each document."""
        w = (1 + np.log(n)) * self.weight[at]
        norm = np.sqrt(np.bincount(doc, weights=w * w, minlength=n_docs))[doc]
        return w / np.where(norm > 0, norm, 1)

    def nearest(self, n: int, doc: np.ndarray, at: np.ndarray, w: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Cosines and places of the k nearest examples of n documents (place -1: fewer share a feature), and the blocks scored.

        doc, at, w: the documents' features and weights. own: places of the documents themselves, left out."""
        n_blocks, scored = len(self.blocks), 0
        close, place = np.zeros((n, k)), np.full((n, k), -1)
        if not n_blocks or not n:
            return close, place, scored
        # what the inverted lists add
        size = n_blocks * BLOCK
        long = self.place[at] < 0
        first, last = self.begin[at[long]], self.begin[at[long] + 1]
        counts = last - first
        posting = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        part = np.bincount(np.repeat(doc[long].astype(np.int64), counts) * size + self.example[posting], weights=np.repeat(w[long], counts) * self.share[posting], minlength=n * size).reshape(n, size)
        if own is not None:
            part[np.arange(n), own] = 0
        q = np.zeros((n, len(self.most)))
        q[doc[~long], self.place[at[~long]]] = w[~long]
        bound = part.reshape(n, n_blocks, BLOCK).max(axis=2) + q @ self.most
        best = np.argmax(bound, axis=1)
        # cosines are at least what the lists add
        floor = -np.partition(-part, k - 1, axis=1)[:, k - 1] if size > k else np.zeros(n)

        def score(rows: np.ndarray, b: int) -> None:
            nonlocal scored
            if not len(rows):
                return
            scored += len(rows)
            features, weights = self.blocks[b]
            here = np.arange(b * BLOCK, b * BLOCK + weights.shape[1])
            s = part[np.ix_(rows, here)] + q[np.ix_(rows, features)] @ weights
            if own is not None:
                s[own[rows, None] == here[None, :]] = 0
            all_s = np.concatenate([close[rows], s], axis=1)
            all_at = np.concatenate([place[rows], np.broadcast_to(here, s.shape)], axis=1)
            order = np.lexsort((all_at, -all_s), axis=1)[:, :k]
            close[rows], place[rows] = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_at, order, 1)

        for b in range(n_blocks):
            score(np.flatnonzero((best == b) & (bound[:, b] > 0)), b)
        for b in range(n_blocks):
            reach = bound[:, b] * (1 + 1e-9)
            score(np.flatnonzero((best != b) & (reach > close[:, -1]) & (reach >= floor)), b)
        place[close <= 0] = -1
        return close, place, scored

    def votes(self, close: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The distance-weighted share of toxic neighbours; one weak vote for each class keeps it off 0 and 1."""
        w = np.where(place >= 0, 1 / (0.1 + 1 - close), 0)
        return ((w * self.toxic[place]).sum(axis=1) + 0.25) / (w.sum(axis=1) + 0.5)

    def scores(self, n: int, doc: np.ndarray, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        close, place, _ = self.nearest(n, doc, at, self.unit(n, doc, at, count), NEIGHBOURS)
        if self.constant is not None:
            return np.full(n, self.constant), close, place
        p = self.votes(close, place)
        s = 1 / (1 + np.exp(-(self.slope * np.log(p / (1 - p)) + self.offset)))
        return np.where((place >= 0).any(axis=1), s, self.none), close, place


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope (at least 0) and offset of the weighted fit, lightly held to 1 and 0, by Newton's method with halved steps."""
    start = np.array([1.0, 0.0])
    design, hold = np.stack([x, np.ones_like(x)], 1), np.array([1e-2, 1e-3]) * w.sum() / max(1, len(w))

    def loss(a):
        z = design @ a
        return (w * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (hold * (a - start) ** 2).sum()

    a = start
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ a, -35, 35)))
        gradient = design.T @ (w * (p - y)) + hold * (a - start)
        step = np.linalg.solve((design * (w * p * (1 - p))[:, None]).T @ design + np.diag(hold), gradient)
        while loss(a - step) > loss(a) and np.abs(step).max() > 1e-9:
            step = step / 2
        a = a - step
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(a[0])), float(a[1])


def build_index(vocabulary, weight, ids, toxic, places, counts, shares: tuple[float, float]) -> Index:
    """shares: labelled rows that are not toxic, and that are."""
    filled = np.array([i for i, p in enumerate(places) if len(p) and weight[p].any()], dtype=np.int64)
    empty = np.setdiff1d(np.arange(len(places)), filled)
    of_class = np.array([shares[c] / max(1, (toxic == c).sum()) for c in (0, 1)])
    none = float((of_class[toxic[empty]] * toxic[empty]).sum() / max(1e-9, of_class[toxic[empty]].sum())) if len(empty) else float(shares[1] / max(1, sum(shares)))
    constant = None if shares[0] and shares[1] else 1.0 if shares[1] else 0.0
    nothing = np.zeros(0, dtype=np.int64)
    index = Index(vocabulary, weight, ids[filled], toxic[filled], np.full(len(vocabulary), -1), [], np.zeros((0, 0)), np.zeros(len(vocabulary) + 1, dtype=np.int64), nothing, nothing.astype(float), none=none, constant=constant)
    if not len(filled):
        return index
    doc = np.repeat(np.arange(len(filled), dtype=np.int32), [len(places[i]) for i in filled])
    at = np.concatenate([places[i] for i in filled]).astype(np.int32)
    w = index.unit(len(filled), doc, at, np.concatenate([counts[i] for i in filled]))
    # like examples next to each other: by class, then by heaviest feature
    ends = np.concatenate([[0], np.cumsum([len(places[i]) for i in filled])])
    heavy = np.array([at[a + np.argmax(w[a:b])] for a, b in zip(ends[:-1], ends[1:], strict=True)])
    new = np.lexsort((index.ids, heavy, index.toxic))
    index.ids, index.toxic = index.ids[new], index.toxic[new]
    doc = np.argsort(new).astype(np.int32)[doc]
    seen = np.bincount(at, minlength=len(vocabulary))
    dense = np.sort(np.argsort(-seen, kind="stable")[: min(DENSE, int((seen > 0).sum()))])
    index.place[dense] = np.arange(len(dense))
    short = index.place[at] < 0
    order = np.lexsort((doc[short], at[short]))
    index.example, index.share = doc[short][order], w[short][order]
    index.begin = np.concatenate([[0], np.cumsum(np.bincount(at[short], minlength=len(vocabulary)))])
    most = []
    for a in range(0, len(filled), BLOCK):
        inside = (doc >= a) & (doc < a + BLOCK) & ~short
        rows = np.zeros((len(dense), min(BLOCK, len(filled) - a)))
        rows[index.place[at[inside]], doc[inside] - a] = w[inside]
        features = np.flatnonzero(rows.any(axis=1))
        index.blocks.append((features, np.ascontiguousarray(rows[features])))
        most.append(rows.max(axis=1))
    index.most = np.stack(most, 1)
    if index.constant is None:
        order = np.argsort(doc, kind="stable")
        doc, at, w = doc[order], at[order], w[order]
        votes = []
        for a in range(0, len(filled), TOGETHER):
            b = min(len(filled), a + TOGETHER)
            inside = slice(*np.searchsorted(doc, [a, b]))
            close, place, _ = index.nearest(b - a, doc[inside] - a, at[inside], w[inside], NEIGHBOURS, own=np.arange(a, b))
            votes.append(index.votes(close, place))
        p = np.concatenate(votes)
        index.slope, index.offset = _logistic(np.log(p / (1 - p)), index.toxic.astype(float), of_class[index.toxic])
    return index


def fit(docs: DataFrame, labels: DataFrame, learn: str, examples: int = EXAMPLES) -> Index:
    """The index over a bounded sample of labelled documents. learn: SQL over doc_id, the labels that may be used."""
    spark = docs.sparkSession
    text_batches(spark)
    root = work_dir(spark, "toxicity")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(learn)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    of_class = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    shares = (of_class.get(0, 0), of_class.get(1, 0))
    picked = None
    for c in (0, 1):
        part = known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
        picked = part if picked is None else picked.union(part)
    # at most 2 * examples rows, so the broadcast has a fixed bound
    sample = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "text")
    sample = written(sample.dropDuplicates(["doc_id"]), f"{root}/examples")
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    # what comes to the driver is the features of at most 2 * examples texts
    found = sample.mapInArrow(_example_rows, "example long, toxic int, feature long").groupBy("feature")
    found = found.agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).toArrow()
    vocabulary = found.column("feature").to_numpy().view(np.uint64)
    order = np.argsort(vocabulary)
    vocabulary, a, b = vocabulary[order], found.column("a").to_numpy()[order], found.column("b").to_numpy()[order]
    held = spark.sparkContext.broadcast(vocabulary)
    df, n = _document_frequencies(docs.select("text"), held)
    weight = (np.log((1 + n) / (1 + df)) + 1e-3) * contrast(a, b, sizes.get(1, 0), sizes.get(0, 0))
    vectors = sample.mapInArrow(_vector_rows(held), "example long, toxic int, places array<int>, counts array<int>").toArrow().sort_by("example")
    ids, toxic = vectors.column("example").to_numpy(), vectors.column("toxic").to_numpy().astype(np.int64)
    places, counts = (_lists_of(vectors.column(c)) for c in ("places", "counts"))
    del vectors, found, df, a, b
    index = build_index(vocabulary, weight, ids, toxic, places, counts, shares)
    del places, counts
    give_back()
    return index


def _lists_of(column) -> list[np.ndarray]:
    column = column.combine_chunks()
    if not len(column):
        return []
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[i:j] for i, j in zip(offsets[:-1], offsets[1:], strict=True)]


def _score_rows(held, evidence: int):
    def rows(batches):
        index = held.value
        for batch in batches:
            data, offsets = binary_parts(batch.column(0))
            scores, proof = [], []
            for words in words_of(data, offsets, lower=True, word_bytes=LETTERS):
                doc, at, n = counted(words, index.vocabulary)
                for a in range(0, words.last - words.first, TOGETHER):
                    b = min(words.last - words.first, a + TOGETHER)
                    inside = slice(*np.searchsorted(doc, [a, b]))
                    s, close, place = index.scores(b - a, doc[inside] - a, at[inside], n[inside])
                    scores.append(s)
                    if evidence:
                        for c, p in zip(close[:, :evidence].tolist(), place[:, :evidence].tolist(), strict=True):
                            proof.append([{"doc_id": int(index.ids[j]), "toxic": int(index.toxic[j]), "cosine": x} for x, j in zip(c, p, strict=True) if j >= 0])
            columns = [batch.column(i) for i in range(1, batch.num_columns)] + [pa.array(np.concatenate(scores) if scores else [], pa.float64())]
            names = [batch.schema.names[i] for i in range(1, batch.num_columns)] + ["score"]
            if evidence:
                columns.append(pa.array(proof, pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))))
                names.append("evidence")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows


def score(docs: DataFrame, index: Index, evidence: int = 0, keep: list[str] | None = None) -> DataFrame:
    """docs -> its columns (those of keep, if given), score, and evidence (array of doc_id, toxic, cosine) of the nearest examples."""
    spark = docs.sparkSession
    text_batches(spark)
    held = spark.sparkContext.broadcast(index)
    give_back()
    keep = docs.columns if keep is None else keep
    packed = docs.select(F.col("text").cast("string").alias("_text"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)])
    schema = StructType([*packed.schema.fields[1:], StructField("score", DoubleType())])
    if evidence:
        schema = schema.add("evidence", ArrayType(StructType([StructField("doc_id", LongType()), StructField("toxic", IntegerType()), StructField("cosine", DoubleType())])))
    out = packed.mapInArrow(_score_rows(held, evidence), schema)
    taken = ["score", *(["evidence"] if evidence else [])]
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(clear_names(keep, taken))], *taken)
