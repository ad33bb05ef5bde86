"""Token counts through a digest cache.

A stored count is found by two digests: of the normalised content (null counts as empty; the bytes are otherwise left alone,
since any other change may change the count) and of the tokenizer version (the bytes of its file and its library's version).
The cache is Parquet in the shared folder, only ever appended to. Digests alone, without texts, tell which contents it lacks. Those go to
the executors as a filter of fixed size, so that only texts that may be missing are packed and shuffled; each distinct one that is
missing is encoded once, and its count is appended.

Exact copies cost one encoding; a group of copies meets by its digest with partial aggregation, so no task gets them all.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm.shared import join_hot, text_batches, work_dir, written
from stepweave.llm.sketch import repeated_cells, test_bits, width_for

CACHE = "content binary, tokenizer string, n_tokens long"


@lru_cache(maxsize=4)
def _counter(path: str):
    """texts -> counts, for a .json or .model file; specials are not added, texts are not cut or padded."""
    if path.endswith(".model"):
        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in processor.encode(texts, num_threads=1)]
    if path.endswith(".json"):
        own = tokenizers.Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        return lambda texts: [len(e.ids) for e in own.encode_batch(texts, add_special_tokens=False)]
    raise ValueError(f"no library for {path}")


def version_of(path: str) -> str:
    """Digest of the tokenizer's file and of the version of its library."""
    library = sentencepiece if path.endswith(".model") else tokenizers
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{library.__name__} {library.__version__}".encode()).hexdigest()


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; none where nothing is stored yet."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path)


def _packed(missing, width: int):
    """Each content that a task meets, once, with its text compressed. missing: bits of the contents without a count (others may pass), or None."""

    def rows(batches):
        seen = set()
        for batch in batches:
            digests, sizes, packs = [], [], []
            for text in batch.column(0).to_pylist():
                raw = text.encode()
                digest = hashlib.sha256(raw).digest()
                if digest in seen or (missing is not None and not test_bits(missing.value, np.frombuffer(digest[:8], dtype=np.uint64), width)[0]):
                    continue
                seen.add(digest)
                digests.append(digest)
                sizes.append(len(raw))
                packs.append(pa.compress(raw, codec="zstd", asbytes=True))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(packs, pa.binary())], names=["content", "size", "packed"])

    return rows


def _digest_keys(batch):
    keys = np.frombuffer(b"".join(d[:8] for d in batch.column(0).to_pylist()), dtype=np.uint64)
    yield np.concatenate([keys, keys])  # counted twice, so that "repeated" is "present"


def _count(path: str):
    def rows(batches):
        for batch in batches:
            counts: list[int] = []
            sizes, packs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a in range(0, len(sizes), 64):
                texts = [pa.decompress(p, decompressed_size=s, codec="zstd", asbytes=True).decode() for s, p in zip(sizes[a : a + 64], packs[a : a + 64], strict=True)]
                counts += _counter(path)(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["content", "n_tokens"])

    return rows


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    return read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def fill_cache(docs: DataFrame, tokenizer: str, cache: str) -> DataFrame:
    """Counts the contents of docs (doc_id, text) that the cache lacks, and appends them. Gives the rows' digests (doc_id, content, n_bytes)."""
    spark = docs.sparkSession
    text_batches(spark)
    version, texts = version_of(tokenizer), _texts(docs)
    sized = texts.select("doc_id", F.unhex(F.sha2("text", 256)).alias("content"), F.octet_length("text").cast("long").alias("n_bytes"))
    sized = written(sized, work_dir(spark, "token-digests"))

    # digests alone tell what is missing; texts of hits are neither packed nor shuffled
    known, missing, bits, width = _stored(spark, cache, version), None, None, 0
    if not known.isEmpty():
        missing = written(sized.select("content").distinct().join(known, "content", "left_anti"), work_dir(spark, "token-misses"))
        width = width_for(missing.count())
        bits = spark.sparkContext.broadcast(repeated_cells(missing, _digest_keys, width)[0])
    packed = texts.select("text").mapInArrow(_packed(bits, width), "content binary, size long, packed binary")
    if missing is not None:
        packed = packed.join(missing, "content", "left_semi")
    misses = packed.groupBy("content").agg(F.first(F.struct("size", "packed")).alias("text"))
    counted = misses.select("content", "text.size", "text.packed").mapInArrow(_count(tokenizer), "content binary, n_tokens long")
    counted.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    return sized


def token_counts(docs: DataFrame, tokenizer: str, cache: str, limit: int = 4096) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_bytes, n_tokens, over_limit), a row for each of docs. cache: a folder all executors share.

    Null texts count as empty. Repeated rows each give a row. An empty table gives an empty one, and stores nothing."""
    sized = fill_cache(docs, tokenizer, cache)
    found = join_hot(sized, _stored(docs.sparkSession, cache, version_of(tokenizer)), "content")
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
