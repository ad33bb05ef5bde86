"""The registered queries of the llm operators, each over its whole table, and SQL twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm import bpe, jaccard, licenses, mixing, sharding, substrings, token_counts, topk, toxicity, vector_dedup
from stepweave.llm.shared import work_dir
from stepweave.session import table

#: Labels may be learnt from these rows alone.
LEARN = "pmod(crc32(cast(doc_id as string)), 5) <> 0"

#: Domains of the mixing query and their target shares of all tokens: poor texts by their label, others by language.
MIX = {"low": 0.05, "de": 0.15, "en": 0.5, "es": 0.15, "fr": 0.15}

ARRIVALS = 8


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = mixing.labelled_rows(docs.select("doc_id", "text", "lang"), labels).select("text", F.when(F.col("quality") == 0, "low").otherwise(F.col("lang")).alias("domain"))
    return mixing.mix(docs, labelled, list(MIX), mixing.weighted(list(MIX.values())))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "id % 50 = 0")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"), LEARN)
    scored = toxicity.score(docs, index, keep=["doc_id"])
    return scored.select("doc_id", (~F.expr(LEARN)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents come in two arrivals, with a cache that is empty at first: the second finds what the first has counted, and counts the rest.

    The cache is in a new folder, so that a run never gets by on the counts of another one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokenizer, cache = public_tokenizers.path("piece_bpe_32k.model"), work_dir(spark, "token-counts")
    token_counts.fill_cache(docs.where("pmod(xxhash64(doc_id), 2) = 0"), tokenizer, cache)
    return token_counts.token_counts(docs, tokenizer, cache)


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_classes(table(spark, sf_dir, "embeddings")).drop("audit_recall")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = sharding.ShardStore(spark, work_dir(spark, "shards"))
    store.append_each(table(spark, sf_dir, "documents"), f"pmod(xxhash64(doc_id), {ARRIVALS})")
    store.compact()
    store.vacuum()
    rows = store.read()
    if rows is None:
        return spark.createDataFrame([], "doc_id long, n_bytes long, text_sha256 string")
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_license_scan": op2_license_scan,
    "op3_top_k": op3_top_k,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_vector_dedup": op7_vector_dedup,
    "op8_sharding": op8_sharding,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "pipeline": pipeline,
}

_CLASSES = """
, links as (select u, v from pairs union all select v, u from pairs),
classes as (
  select u as id, u as seen from links
  union
  select classes.id, links.v from classes join links on classes.seen = links.u
),
smallest as (select id, min(seen) as least from classes group by id)
"""

ORACLE_SQL = {
    "op3_top_k": """
with cells as (
  select vec_id, unnest(range(len(embedding))) as d, unnest(embedding) as x from embeddings
), ints as (
  select vec_id, d, cast(floor(256 * cast(x as double)) as bigint) as x from cells
), scores as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(sum(q.x * c.x) as bigint) as score
  from ints q join ints c on q.d = c.d and q.vec_id <> c.vec_id
  where q.vec_id % 50 = 0 group by q.vec_id, c.vec_id
), ranked as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from scores
)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 5
""",
    "op7_vector_dedup": """
with recursive unit as (
  select vec_id, cast(embedding as double[]) as v from embeddings
), pairs as (
  select a.vec_id as u, b.vec_id as v from unit a join unit b on a.vec_id < b.vec_id
  where list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.9
)"""
    + _CLASSES
    + """
select e.vec_id, cast(coalesce((select count(*) from links where u = e.vec_id), 0) as bigint) as n_links,
  coalesce(s.least, e.vec_id) as component_id, coalesce(s.least, e.vec_id) = e.vec_id as kept
from embeddings e left join smallest s on s.id = e.vec_id
""",
    "op8_sharding": """
select doc_id, cast(octet_length(encode(coalesce(text, ''))) as bigint) as n_bytes, sha256(coalesce(text, '')) as text_sha256 from documents
""",
    "op9_substring_dedup": r"""
with words as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), placed as (
  select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from words
), windows as (
  select doc_id, i, md5(string_agg(word, ' ') over (partition by doc_id order by i rows between current row and 19 following)) as key,
    count(*) over (partition by doc_id order by i rows between current row and 19 following) as n
  from placed
), later as (
  select doc_id, i from (
    select doc_id, i, row_number() over (partition by key order by doc_id, i) as k from windows where n = 20
  ) where k > 1
), marked as (
  select p.doc_id, p.i, p.word,
    max(case when l.i is not null then l.i end) over (partition by p.doc_id order by p.i rows between 19 preceding and current row) as cut
  from placed p left join later l on l.doc_id = p.doc_id and l.i = p.i
), kept as (
  select doc_id, count(*) as n_words, count(*) filter (where cut is not null) as n_removed,
    string_agg(case when cut is null then word end, ' ' order by i) as kept
  from marked group by doc_id
)
select d.doc_id, cast(coalesce(k.n_words, 0) as bigint) as n_words, cast(coalesce(k.n_removed, 0) as bigint) as n_removed,
  sha256(coalesce(k.kept, '')) as kept_sha256
from documents d left join kept k on k.doc_id = d.doc_id
""",
    "op10_ngram_jaccard": r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), shingles as (
  select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] end)) as s
  from words
), sizes as (
  select doc_id, count(*) as n from shingles group by doc_id
), shared as (
  select a.doc_id as u, b.doc_id as v, count(*) as i from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id
), pairs as (
  select u, v from shared join sizes x on x.doc_id = u join sizes y on y.doc_id = v where 100 * i >= 80 * (x.n + y.n - i)
)"""
    + _CLASSES
    + """
select d.doc_id, cast(coalesce(z.n, 0) as bigint) as n_shingles, coalesce(s.least, d.doc_id) as component_id
from documents d left join sizes z on z.doc_id = d.doc_id left join smallest s on s.id = d.doc_id
""",
}
