import base64
import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import functions as F

from stepweave.llm import bpe, jaccard, licenses, mixing, sharding, sketch, substrings, token_counts, topk, toxicity, vector_dedup, wordhash
from stepweave.llm.components import components
from stepweave.llm.shared import join_hot
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TRICKY = ["", None, " ", "one", "Two words", "\n\t", "é ü 漢字 漢字", "x" * 5000, "a b c d e", "A B C D E", "<|endoftext|> <s>", " nbsp wide \u0085next", "\U0001f600 \x00 nul"]


def prose(seed: int, n: int, words: int = 400) -> list[str]:
    rnd = random.Random(seed)
    return [f"w{rnd.randrange(words)}" for _ in range(n)]


def near_copies(seed: int = 1) -> list[tuple]:
    """Groups of exact and near copies, shared passages, nested edits, short and odd texts."""
    rnd, rows, i = random.Random(seed), [], 0
    passage = prose(99, 45)
    for group in range(12):
        own = prose(group, rnd.randrange(25, 160), 5000)
        for copy in range(rnd.randrange(1, 9)):
            words = list(own)
            for _ in range(rnd.randrange(0, 5)):
                words[rnd.randrange(len(words))] = f"edit{rnd.randrange(50)}"
            if rnd.random() < 0.4:
                at = rnd.randrange(len(words))
                words[at:at] = passage
            rows.append((i, rnd.choice([" ", "\n", "  "]).join(words)))
            i += 1
    chain = prose(55, 120, 5000)
    for step in range(10):  # neighbours link, ends don't
        chain = chain[:-4] + [f"c{step}_{j}" for j in range(4)] if step % 2 else [f"d{step}_{j}" for j in range(3)] + chain[3:]
        rows.append((i, " ".join(chain)))
        i += 1
    rows += [(i + j, t) for j, t in enumerate(TRICKY)]
    rows += [rows[0], rows[3], (None, rows[1][1]), (None, None), (rows[5][0], "another text under a known id")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS)


def test_word_hashes_are_those_of_the_words():
    import pyarrow as pa

    texts = [t for t in TRICKY if t is not None] * 2 + ["tail", "x" * 300 + " end"]
    seen = {}
    for lower in (False, True):
        data, offsets = wordhash.binary_parts(pa.array(texts))
        for words in wordhash.words_of(data, offsets, lower=lower):
            h, doc = words.hashes(), words.per_doc()
            at = 0
            for d in range(words.last - words.first):
                for w in brute.space_words(texts[words.first + d]):
                    w = w.translate(brute.ASCII_LOWER) if lower else w
                    assert seen.setdefault((lower, w), h[at]) == h[at] and doc[at] == d
                    at += 1
            assert at == len(h)
    assert len({v for (low, _), v in seen.items() if low}) == len({w for low, w in seen if low})


def test_sketch_never_counts_too_few(spark):
    keys = [(int(x),) for x in np.random.default_rng(0).integers(0, 400, 900)]
    rows = spark.createDataFrame(keys, "k long").repartition(5)

    def keys_of(batch):
        yield batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)

    for width in (256, 1 << 20):
        twice, hot = sketch.repeated_cells(rows, keys_of, width, hot=5)
        counts = {k: sum(x == (k,) for x in keys) for (k,) in keys}
        names = np.array(sorted(counts), dtype=np.int64)
        found = sketch.test_bits(twice, names.view(np.uint64), width)
        assert all(found[i] for i, k in enumerate(names) if counts[int(k)] >= 2)
        often = sketch.test_bits(hot, names.view(np.uint64), width)
        assert all(often[i] for i, k in enumerate(names) if counts[int(k)] >= 5)
        if width > 256:
            assert [bool(f) for f in found] == [counts[int(k)] >= 2 for k in names]


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 9)] + [(50, 51), (51, 52), (52, 50), (60, 60)]
    random.Random(3).shuffle(edges)
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(1, 21)} | {100 + i: 100 for i in range(1, 9)} | {51: 50, 52: 50}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_equals_brute_force(spark, seed):
    rows = near_copies(seed)
    got = jaccard.jaccard_classes(frame(spark, rows).repartition(4))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute.jaccard(rows)))


def test_bounds_of_shared_fronts_hold():
    """Sets that just link share what the bound says, whatever is shared stands last in their order; a range's bound is no larger."""
    for n in range(1, 140):
        for m in range(1, 140):
            need = int(jaccard.least_overlap(n, m, 80))
            if need > min(n, m):
                continue
            bound = int(jaccard.shared_fronts(n, m, 80))
            # the order that hides most: each set's own shingles first
            hidden = min(need - max(0, need - (int(jaccard.front(n, 80)) - (n - need))), need - max(0, need - (int(jaccard.front(m, 80)) - (m - need))))
            assert bound <= hidden
            for low, high in ((m, m), (max(1, m - 9), m), (m, m + 30), (1, 1000)):
                assert jaccard.shared_with_range(np.array([n]), np.array([low]), np.array([high]), 80)[0] <= bound


def test_jaccard_of_one_large_group(spark, monkeypatch):
    """Blocks smaller than the group, so that all paths between blocks are walked."""
    monkeypatch.setattr(jaccard, "GROUP", 4)
    monkeypatch.setattr(jaccard, "ASKERS", 8)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rnd, own = random.Random(5), prose(7, 90, 5000)
    rows = []
    for i in range(60):
        words = list(own)
        for _ in range(rnd.randrange(0, 4)):
            words[rnd.randrange(90)] = f"e{rnd.randrange(9)}"
        rows.append((i, " ".join(words)))
    got = jaccard.jaccard_classes(frame(spark, rows))
    assert sorted(map(tuple, got.collect())) == sorted(brute.jaccard(rows))


def test_answers_are_derived_from_similar_sets():
    """Equal to counting afresh, at a part of its postings."""
    rnd = np.random.default_rng(3)
    base = np.unique(rnd.integers(0, 2**62, 400).astype(np.uint64))
    held = []
    for i in range(80):
        own = base if i % 4 else np.unique(rnd.integers(0, 2**62, 300).astype(np.uint64))
        held.append(np.unique(np.concatenate([own[rnd.random(len(own)) > 0.03], rnd.integers(0, 2**62, 9).astype(np.uint64)])))
    held += [held[1], held[1][:3], np.array([5], dtype=np.uint64)]
    block = jaccard._Block(list(range(len(held))), held)
    afresh = 0
    for s in held:
        want = np.array([len(np.intersect1d(s, o)) for o in held])
        afresh += int(want.sum())
        assert np.array_equal(block.overlaps(s), want)
    assert block.read < 0.25 * afresh


def test_lists_are_never_cut():
    import pyarrow as pa

    key = np.repeat(np.arange(9), [1, 30, 2, 1, 25, 1, 1, 40, 3])
    for size in (1, 2, 7, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array(key[a : a + size]), pa.array(np.arange(a, min(a + size, len(key))))], names=["k", "i"]) for a in range(0, len(key), size)]
        lists = list(jaccard._whole_lists(batches, 2))
        assert np.array_equal(np.concatenate([x[0] for x in lists]), key) and np.array_equal(np.concatenate([x[1] for x in lists]), np.arange(len(key)))
        ends = [x[0][-1] for x in lists]
        assert all(a != x[0][0] for a, x in zip(ends[:-1], lists[1:], strict=True))


def test_a_hot_key_is_joined_whole(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)], "k long, i long")
    found = spark.createDataFrame([(i, f"v{i}") for i in range(299)], "k long, v string")
    got = join_hot(rows, found, "k", share=10)
    assert sorted(map(tuple, got.collect())) == sorted((k, i, f"v{k}") for k, i in map(tuple, rows.collect()))
    assert join_hot(rows.limit(0), found, "k").count() == 0


@pytest.mark.parametrize("width", [None, 256])
def test_substrings_equal_brute_force(spark, width):
    """A sketch that is far too small lets more through, and changes nothing."""
    rows = near_copies(4) + [(900, " ".join(["same"] * 50)), (901, " ".join(prose(99, 45)))]
    want = brute.substring_dedup(rows)
    got = substrings.cut_repeats(frame(spark, rows).repartition(3), width=width)
    back = substrings.cut_repeats(frame(spark, rows), with_text=False, width=width).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in back) == sorted((str(d), *want[d, t or ""]) for d, t in rows)
    for r in got.collect():
        assert r.n_removed == 0 or hashlib.sha256((r.text or "").encode()).hexdigest() == r.kept_sha256
    assert got.count() == len(rows)
    assert got.where("text is null").count() == sum(t is None for _, t in rows)


def test_hot_windows_are_salted(spark, monkeypatch):
    rows = [(i, " ".join(prose(1, 30))) for i in range(300)]
    got = substrings.cut_repeats(frame(spark, rows).repartition(6), with_text=False).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(0, 0)] + [(i, 30) for i in range(1, 300)]


def test_licenses_equal_brute_force(spark):
    texts = [*TRICKY, "MIT License mit license", "Licensed under the GNU General Public License; cc-by CC BY.", "gnu general public", "the apache  license, Apache\nLicense"] * 2
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in licenses.license_scan(frame(spark, rows).drop("n_chars")).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.license_base(t, licenses.BASE)
        assert r.score == (1.0 if r.n_base else 0.0)


def test_licenses_find_templates_with_changes(spark):
    text = dict(licenses.TEMPLATES)["bsd"].split()
    changed = ["x"] * 30 + text[:8] + ["kindly"] + text[8:14] + text[15:] + ["y"] * 30
    row = licenses.license_scan(frame(spark, [(1, " ".join(changed).upper()), (2, " ".join(text[:5]))])).orderBy("doc_id").collect()
    assert row[0].labels == "bsd" and 0.7 <= row[0].score < 1 and row[0].spans[0].first == 30
    assert row[1].labels == "" and row[1].score == 0


def test_top_k_equals_brute_force(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rnd.normal(size=20)]) for i in range(160)]
    rows += [(200, rows[3][1]), (201, None), (202, [float("nan")] * 20), (203, [None] * 20), (250, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    for block in (topk.QUERIES, 1):
        got = topk.top_k(df, "id % 50 = 0", block=block)
        assert sorted(map(tuple, got.collect())) == brute.top_k(rows)
    few = topk.top_k(df.where("vec_id in (0, 1)"), "id % 50 = 0").collect()
    assert len(few) == 1
    assert topk.top_k(df.limit(0), "id % 50 = 0").count() == 0
    assert topk.top_k(df.union(df), "id % 50 = 0").count() == len(brute.top_k(rows))


def test_an_id_with_many_vectors_holds_one_place(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rnd.normal(size=20)]) for i in range(60)]
    hot = [(7, [float(x) * (3 + j / 10) for x in rows[0][1]]) for j in range(40)] + [(8, [float(x) * (2 + j / 10) for x in rows[50][1]]) for j in range(40)]
    df = spark.createDataFrame(rows + hot, "vec_id long, embedding array<double>").repartition(1)
    got = sorted(map(tuple, topk.top_k(df, "id % 50 = 0").collect()))
    ints = [(i, np.floor(256 * np.array(v))) for i, v in rows + hot]
    want = []
    for q in (0, 50):
        best = {i: max(int(ints[q][1] @ v) for j, v in ints if j == i) for i, _ in ints if i != q}
        want += [(q, r, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5], 1)]
    assert got == want


def test_pruning_drops_candidates_and_no_answer():
    """With clear winners the bound leaves few candidates to finish."""
    rnd = np.random.default_rng(0)
    x = np.floor(rnd.normal(size=(400, 64)) * 3)
    x[:8] += 200
    best = topk._Best(1, 5)
    topk.search_block(np.array([0]), x[:1], np.arange(400), x, best)
    want = sorted(range(1, 400), key=lambda i: (-(x[0] @ x[i]), i))[:5]
    assert best.ids[0].tolist() == want


def test_bpe_equals_tiktoken(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*TRICKY, "hello world's  1234\n\n x", "a" * 3000, "  lead", "Grüße 你好 мир"]
    rows = frame(spark, list(enumerate(texts)))
    for r in bpe.encode_decode(rows, path, public_tokenizers.PATTERN, with_ids=True, with_text=True).collect():
        want = own.encode_ordinary(texts[r.doc_id] or "")
        assert r.ids == want and bytes(r.decoded).decode() == (texts[r.doc_id] or "")
        assert r.ids_sha256 == hashlib.sha256(b"".join(struct.pack("<I", x) for x in want)).hexdigest()
    codec = bpe.codec(path, public_tokenizers.PATTERN)
    assert all(codec.decode(np.uint32(r).tobytes()) == t for t, r in list(ranks.items())[:2000])


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts_and_their_cache(spark, tmp_path, name):
    path, cache = public_tokenizers.path(name), f"file://{tmp_path}/cache"
    rows = list(enumerate([*TRICKY, "same text", "same text"]))
    own = sentencepiece.SentencePieceProcessor(model_file=path) if name.endswith(".model") else tokenizers.Tokenizer.from_file(path)
    count = lambda texts: [len(own.encode(t)) if name.endswith(".model") else len(own.encode(t, add_special_tokens=False).ids) for t in texts]
    want = sorted((i, len((t or "").encode()), n) for (i, t), n in zip(rows, count([t or "" for _, t in rows]), strict=True))
    got = token_counts.token_counts(frame(spark, rows), path, cache, limit=3)
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()) == want
    assert all(r.over_limit == (r.n_tokens > 3) for r in got.collect())
    stored = token_counts.read_cache(spark, cache)
    n = stored.count()
    assert n == len({t or "" for _, t in rows}) == stored.select("content").distinct().count()
    again = token_counts.token_counts(frame(spark, [*rows, (99, "new")]), path, cache)
    assert again.count() == len(rows) + 1
    assert token_counts.read_cache(spark, cache).count() == n + 1


def test_a_hit_is_not_counted_again(spark, tmp_path):
    path, cache = public_tokenizers.path("piece_bpe_32k.model"), f"file://{tmp_path}/cache"
    key = hashlib.sha256(b"known").digest()
    spark.createDataFrame([(key, token_counts.version_of(path), 777), (key, "another version", 5)], token_counts.CACHE).write.parquet(cache)
    got = token_counts.token_counts(frame(spark, [(1, "known"), (2, "new"), (3, "known")]), path, cache)
    assert [r.n_tokens for r in got.orderBy("doc_id").collect()] == [777, len(sentencepiece.SentencePieceProcessor(model_file=path).encode("new")), 777]
    assert token_counts.read_cache(spark, cache).count() == 3
    packed = token_counts.token_counts(frame(spark, [(1, "known")]), path, cache)
    assert packed.count() == 1 and token_counts.read_cache(spark, cache).count() == 3


def vectors(seed=0):
    rnd = np.random.default_rng(seed)
    rows = [rnd.normal(size=16) for _ in range(150)]
    for c in range(4):
        rows += [rows[c] + rnd.normal(size=16) * 0.12 for _ in range(10)]
    rows += [rows[0] * 3, rows[0]]
    out = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    return out + [(900, None), (901, [0.0] * 16), (902, [float("inf")] * 16), (903, [None] * 16), (904, out[7][1]), (904, out[7][1])]


@pytest.mark.parametrize(("shard", "largest"), [(vector_dedup.SHARD, vector_dedup.LARGEST), (60, 40)])
def test_vector_classes_equal_brute_force(spark, monkeypatch, shard, largest):
    monkeypatch.setattr(vector_dedup, "LARGEST", largest)
    rows = vectors()
    got = vector_dedup.vector_classes(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), shard=shard).collect()
    want = brute.cosine_links(rows)
    assert len(got) == len(want) and all(r.kept == (r.vec_id == r.component_id) for r in got)
    found, true = sum(r.n_links for r in got), sum(n for _, n, _ in want)
    assert 0.9 * true <= found <= true
    assert got[0].audit_recall is None or got[0].audit_recall >= vector_dedup.LEAST_RECALL
    if largest > 1000:
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(want)


def test_a_shard_of_near_copies_is_bounded(spark):
    """6,000 different near copies in one shard: dense groups cost blocks of cosines and not a search."""
    import time

    import pyarrow as pa

    rnd = np.random.default_rng(6)
    middle = rnd.normal(size=(3, 64))
    x = np.concatenate([middle[i] + rnd.normal(size=(2000, 64)) * (0.2 + 0.05 * i) for i in range(3)])
    n = len(x)
    table = pa.table({"node": np.arange(n), "weight": np.ones(n, dtype=np.int64), "v": x.tolist(), "shards": [[3]] * n, "block": np.zeros(n, dtype=np.int32)})
    began = time.time()
    shard = vector_dedup.Shard(table, 0.9)
    weight, joined = shard.links(shard.search(shard.build()), 3, (0, 0))
    assert time.time() - began < 30
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.9
    truth = close.sum(axis=1) - 1
    assert (weight <= truth).all() and weight.sum() >= 0.99 * truth.sum()
    assert len(set(joined[:2000].tolist())) <= 3


def test_vectors_of_an_empty_table(spark):
    assert vector_dedup.vector_classes(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    ragged = vector_dedup.vector_classes(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [2.0, 0.1]), (4, [])], "vec_id long, embedding array<float>").withColumn("shards", F.lit(1)).withColumn("node", F.lit(2)))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in ragged.collect()) == [(1, 1, 1), (2, 0, 2), (3, 1, 1), (4, 0, 4)]
    lone = vector_dedup.vector_classes(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in lone] == [(1, 0, 1, True)]


def toxic_docs(n=400):
    rnd, rows = random.Random(8), []
    for i in range(n):
        words = prose(i, 60, 3000)
        if i % 4 == 0:
            words[rnd.randrange(60)] = rnd.choice(["blarg", "snorf", "Fnord"])
            words[rnd.randrange(60)] = rnd.choice(["blarg", "snorf", "Fnord"])
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_docs()
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(9000, None), (9001, ""), (None, "blarg snorf")])
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels, "doc_id % 5 <> 0")
    scored = toxicity.score(docs, index, evidence=3).collect()
    held = [(r.score, rows[r.doc_id][2]) for r in scored if r.doc_id is not None and r.doc_id < 9000 and r.doc_id % 5 == 0]
    assert np.mean([(s >= 0.5) == bool(y) for s, y in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in scored)
    by_id = {r.doc_id: r for r in scored}
    assert by_id[9000].score == by_id[9001].score < 0.5 and by_id[None].score > 0.5
    assert all(e.toxic == 1 and e.doc_id % 5 for e in by_id[None].evidence[:1])


def test_block_max_search_is_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "DENSE", 20)
    rnd = np.random.default_rng(4)
    places = [np.unique(rnd.integers(0, 60, rnd.integers(1, 9))) for _ in range(500)]
    counts = [rnd.integers(1, 4, len(p)) for p in places]
    toxic = rnd.integers(0, 2, 500)
    weight = rnd.uniform(1, 6, 60)
    index = toxicity.build_index(np.arange(60, dtype=np.uint64), weight, np.arange(500), toxic, places, counts, (900, 100))
    assert (index.place < 0).sum() == 40 and len(index.example)
    dense = np.zeros((500, 60))
    for i, (p, n) in enumerate(zip(places, counts, strict=True)):
        dense[i, p] = (1 + np.log(n)) * weight[p]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    asked = [np.unique(rnd.integers(0, 60, 4)) for _ in range(40)]
    doc, at = np.repeat(np.arange(40), [len(x) for x in asked]), np.concatenate(asked)
    w = index.unit(40, doc, at, np.ones(len(at)))
    close, place, scored = index.nearest(40, doc, at, w, 15)
    q = np.zeros((40, 60))
    q[doc, at] = w
    want = -np.sort(-(q @ dense.T), axis=1)[:, :15]
    assert np.allclose(close, want) and scored < 40 * len(index.blocks)
    by_id = {i: dense[i] for i in range(500)}
    assert np.allclose([[q[i] @ by_id[index.ids[j]] for j in place[i] if j >= 0] for i in range(1)][0], want[0][place[0] >= 0])


def test_rare_toxic_words_count(spark):
    """A word that few toxic examples have weighs, at any number of examples; and weights don't depend on a cut."""
    a, b = np.arange(0, 40, dtype=float), np.zeros(40)
    weights = toxicity.contrast(a, b, 3000, 3000)
    assert (np.diff(weights) >= 0).all() and weights[5] > 0.4 and weights[0] == 0
    rows = [(i, " ".join(prose(i, 30, 3000)) + (f" vile{i % 12}" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(480)]
    docs = frame(spark, [(i, t) for i, t, _ in rows])
    index = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), "doc_id % 5 <> 0")
    scored = {r.doc_id: r.score for r in toxicity.score(docs, index).collect()}
    held = [(scored[i] >= 0.5, bool(y)) for i, _, y in rows if i % 5 == 0]
    assert sum(p and y for p, y in held) >= 0.9 * sum(y for _, y in held) and sum(p and not y for p, y in held) <= 0.03 * len(held)


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "a b"), (2, None)])
    for labels, want in (([], 0.0), ([(1, 1)], 1.0), ([(1, 0)], 0.0)):
        index = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), "true")
        assert {r.score for r in toxicity.score(docs, index).collect()} == {want}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"), "true")).count() == 0


def mixing_rows(spark):
    rows = [(i, " ".join(prose(i, 40, 50)), "a") for i in range(60)] + [(100 + i, " ".join("z" + w for w in prose(i, 20, 50)), "b") for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, domain string")


def test_mixing_meets_its_targets(spark):
    rows = mixing_rows(spark)
    extra = rows.union(spark.createDataFrame([(500, None, None), (501, "", None), (0, rows.first().text, "a")], rows.schema))
    mixed = mixing.mix(extra, rows.where("doc_id % 2 = 0"), ["a", "b"], mixing.weighted([0.5, 0.5])).collect()
    total = sum(r.n_rows * r.n_tokens for r in mixed)
    for p in ("p_a", "p_b"):
        assert sum(r.rate * r.n_rows * r.n_tokens * r[p] for r in mixed) == pytest.approx(total / 2, rel=2e-3)
    assert all(r.rate >= 0 and abs(r.p_a + r.p_b - 1) < 1e-9 and r.copies in (int(r.rate), int(r.rate) + 1) for r in mixed)
    assert len(mixed) == 102


def test_mixing_of_a_rare_domain_meets_its_target(spark):
    """A domain of about 1 % of the tokens that should have half of them: rates far above 8."""
    rows = mixing_rows(spark)
    docs = rows.where("domain = 'a'").withColumn("doc_id", F.col("doc_id") * 100)
    docs = docs.union(docs.selectExpr("doc_id + 1", "text", "domain")).union(rows.where("doc_id in (100, 101)"))
    mixed = mixing.mix(docs, rows, ["a", "b"], mixing.weighted([0.5, 0.5])).collect()
    total = sum(r.n_rows * r.n_tokens for r in mixed)
    for p in ("p_a", "p_b"):
        assert sum(r.rate * r.n_rows * r.n_tokens * r[p] for r in mixed) == pytest.approx(total / 2, rel=2e-3)
    assert max(r.rate for r in mixed) > 8 and all(abs(x) < 2e-3 for x in mixed[0].off)


def test_mixing_says_how_far_off_it_is(spark):
    """No rate below 1 keeps the total, so the common domain can't shrink."""
    rows = mixing_rows(spark)
    off = mixing.mix(rows, rows, ["a", "b"], mixing.weighted([0.1, 0.9]), least=1.0).first().off
    assert off.a > 1 and max(map(abs, off)) > 1


def test_rates_are_the_least_squares(spark):
    """Where no rates meet the targets, the loss is that of a long plain projected gradient descent."""
    rows = mixing_rows(spark)
    mixed = mixing.mix(rows, rows, ["a", "b"], mixing.weighted([0.1, 0.9]), least=1.0).collect()
    tokens = np.array([r.n_rows * r.n_tokens for r in mixed], dtype=float)
    share = np.array([[r.p_a, r.p_b] for r in mixed]).T * tokens
    wanted = np.array([0.1, 0.9]) * tokens.sum()
    loss = lambda r: ((share @ r - wanted) ** 2 / wanted).sum()
    r = np.ones(len(tokens))
    step = 1 / np.linalg.eigvalsh((share / wanted[:, None]) @ share.T).max()
    for _ in range(20_000):
        r = np.maximum(1.0, r - step * (share.T @ ((share @ r - wanted) / wanted)))
    got = np.array([x.rate for x in mixed])
    assert (got >= 1).all() and loss(got) <= 1.02 * loss(r) + 1e-6


def test_mixing_without_loss_drops_nothing(spark):
    rows = mixing_rows(spark)
    mixed = mixing.mix(rows, rows, ["a", "b"], mixing.weighted_without_loss([0.5, 0.5]), least=1.0)
    assert mixed.where("rate < 1 or copies < 1").count() == 0
    again = mixing.resampled(rows, mixed)
    assert again.columns == rows.columns and again.select("doc_id").distinct().count() == 100 and again.count() > 100


def test_mixing_of_an_empty_table_and_no_labels(spark):
    rows = mixing_rows(spark)
    assert mixing.mix(rows.limit(0), rows, ["a", "b"], mixing.weighted([1, 1])).count() == 0
    assert mixing.mix(rows, rows.limit(0), ["a", "b"], mixing.weighted([1, 1])).count() == 100


def test_shards_keep_every_row_and_commit_once(spark, tmp_path):
    rows = frame(spark, near_copies(1)).withColumn("arrival", F.lit("a column of this name"))
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target=1 << 20)
    done = store.append_each(rows, "pmod(hash(doc_id), 8)")
    assert [m["version"] for m in done] == list(range(1, len(done) + 1))
    before = store.manifest()
    after = store.compact()
    assert len(after["runs"]) < len(before["runs"]) and after["version"] > before["version"]
    assert all(sum(r["tier"] == t for r in after["runs"]) < store.fan for t in range(9))
    key = lambda df: sorted(map(str, map(tuple, df.select(*rows.columns).collect())))
    assert key(store.read()) == key(store.read(before["version"])) == key(rows)
    store.append(rows.limit(0))
    store.vacuum()
    assert store.versions() == [store.manifest()["version"]] and key(store.read()) == key(rows)


def test_shards_of_differing_columns_lose_none(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", fan=4)
    store.append(spark.createDataFrame([(1, "a")], "doc_id int, text string"))
    store.append(spark.createDataFrame([(2, "b", 0.5, "s")], "doc_id long, text string, extra double, `odd name` string"))
    store.append(spark.createDataFrame([("c", 3, "t")], "text string, doc_id long, Extra string"))
    store.append(spark.createDataFrame([(4, None)], "doc_id long, text string"))
    want = [(1, "a", None, None), (2, "b", "0.5", "s"), (3, "c", "t", None), (4, None, None, None)]
    seen = lambda: sorted(map(tuple, store.read().select("doc_id", "text", "extra", "odd name").collect()))
    assert seen() == want and dict(store.read().dtypes)["doc_id"] == "bigint"
    store.compact()
    assert len(store.manifest()["runs"]) == 1 and seen() == want
    store.append(spark.createDataFrame([(5, True)], "doc_id short, late boolean"))
    store.vacuum()
    assert seen() == [*want, (5, None, None, None)] and store.read().where("late").count() == 1
    assert store.read(shard="file").select("file").distinct().count() == 2
    store.append_each(spark.createDataFrame([(6, "x")], "doc_id long, text string"), "cast(null as int)")
    assert store.read().count() == 6


def test_a_lost_race_is_tried_again(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    rival = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    rows, tried = frame(spark, [(1, "x")]), []

    def change(runs):
        if not tried:
            rival.append(rows)
        tried.append(len(runs))
        return runs

    assert store.commit(change)["version"] == 2 and tried == [0, 1]
    assert store.read().count() == 1


def test_an_empty_store(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    assert store.read() is None and store.compact()["version"] == 0
    assert store.append_each(frame(spark, []), "1") == []


@pytest.mark.parametrize("run", [lambda d: jaccard.jaccard_classes(d), lambda d: substrings.cut_repeats(d), lambda d: licenses.license_scan(d), lambda d: bpe.encode_decode(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)])
def test_empty_tables_and_clashing_names(spark, run):
    assert run(frame(spark, [])).count() == 0
    names = ["id", "digest", "n", "key", "hash", "row", "place", "n_tokens", "score", "_1", "runs", "size"]
    odd = frame(spark, [(1, "a b c d e f"), (None, None)]).withColumns({c: F.lit(None).cast("string") for c in names})
    assert run(odd).count() == 2


def test_very_long_texts(spark, tmp_path):
    words = prose(41, 60_000, 9000)
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, "y" * 300_000), (4, "mit license " + " ".join(words[:100]))]
    docs = frame(spark, rows)
    cut = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.cut_repeats(docs, with_text=False).collect()}
    assert cut == {1: (60_000, 0), 2: (60_000, 60_000), 3: (1, 0), 4: (102, 100)}
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_classes(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r.doc_id: (r.n_words, r.n_base) for r in licenses.license_scan(docs).collect()} == {1: (60_000, 0), 2: (60_000, 0), 3: (1, 0), 4: (102, 1)}
    counts = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), f"file://{tmp_path}/cache").collect()}
    assert counts[1] == counts[2] and counts[1][1] > 60_000 and counts[3][0] == 300_000
    back = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert {r.doc_id: r.decoded_sha256 for r in back} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows}


def test_clashing_columns_of_the_others(spark, tmp_path):
    names = ["id", "v", "node", "weight", "block", "shards", "content", "n_tokens", "bucket", "word", "rate", "toxic", "score", "score_", "row", "h", "fine", "least_id"]
    odd = lambda df: df.withColumns({c: F.lit("odd") for c in names if c not in df.columns})
    x = odd(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (50, [2.0, -1.0])], "vec_id long, embedding array<double>"))
    assert topk.top_k(x, "id % 50 = 0").count() == 4 and vector_dedup.vector_classes(x).where("n_links = 1").count() == 2
    docs = odd(frame(spark, [(i, f"a b c {i}") for i in range(6)]))
    assert token_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), f"file://{tmp_path}/c").count() == 6
    labels = odd(spark.createDataFrame([(i, i % 2, 1) for i in range(6)], "doc_id long, toxic int, quality int"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels, "true"))
    assert scored.count() == 6 and len(set(scored.columns)) == len(docs.columns) + 1 and scored.where("score_ = 'odd'").count() == 6
    labelled = mixing.labelled_rows(docs.select("doc_id", "text"), labels).select("text", F.lit("a").alias("domain"))
    mixed = mixing.mix(docs, labelled, ["a", "b"], mixing.weighted([1, 1]))
    assert mixed.count() == 6 and mixing.resampled(docs, mixed).columns == docs.columns


def test_recall_on_the_test_table(spark):
    import os

    path = "/root/testdata/check_s/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    assert vector_dedup.vector_classes(spark.read.parquet(path)).first().audit_recall >= vector_dedup.LEAST_RECALL


def test_sentencepiece_model_is_a_model():
    tokens = [bytes([i]) for i in range(256)] + [b"ab", b"abc"]
    model = sentencepiece.SentencePieceProcessor(model_proto=bpe.serialise(tokens))
    assert model.get_piece_size() == 259 and model.encode("abc") == [258]
