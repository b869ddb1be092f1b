"""Every operator on awkward rows and empty tables, and each pipeline stage against a brute-force version."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from medgrain.llm import (bin_packing, byte_bpe, chat_tree, exact_dedup, jaccard_join, language_id, mixing,
                          order_minhash, token_files, toxicity)
from medgrain.llm.common import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SF = "/root/testdata/sf0.001"


def lowered(text: str | None) -> str:
    return (text or "").encode().translate(LOWER).decode()


def shingles(text: str | None) -> set:
    words = WORD.findall(lowered(text))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def linked_groups(texts: list[str | None]) -> list[int]:
    """Smallest place reachable by links, for each text: all pairs that share a shingle."""
    sets, where, up = [shingles(t) for t in texts], defaultdict(list), list(range(len(texts)))

    def top(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in where[g]).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n) and top(i) != top(j):
                up[max(top(i), top(j))] = min(top(i), top(j))
        for g in s:
            where[g].append(i)
    return [top(i) for i in range(len(texts))]


def words_text(seed: int, n: int, vocabulary: int = 500) -> str:
    return " ".join(f"w{k}" for k in np.random.default_rng(seed).integers(vocabulary, size=n))


def awkward_rows() -> list[tuple]:
    long = words_text(1, 40_000)
    base = words_text(2, 60)
    texts = [None, "", " \t\n ", "!!! 123", "one", "one two three four", "ONE two THREE four", base, base + " more",
             base.upper(), "x " + base, long, long + " tail", "é ß 漢字 \U0001f600 İ", "a" * 200_000, None, ""]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "web", "books"][i % 3], len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[7], (7, "another text of the same id", "en", "web", 27), (None, base, None, None, None)]


def bare(rows: list[tuple]) -> list[tuple]:
    return [r for r in rows if r[0] is not None]


@pytest.fixture(scope="module")
def awkward(spark):
    clash = {c: F.lit(i) for i, c in enumerate(
        ("size", "n", "words", "src", "block", "component_id", "kept", "score", "lang_pred", "agreeing", "ids", "row"))}
    return spark.createDataFrame(awkward_rows(), SCHEMA).withColumns(clash)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_jaccard_join_equals_all_pairs(spark, documents, awkward):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    tops = linked_groups([t for _, t in rows])
    want = sorted((d, len(shingles(t)), min(e for (e, _), u in zip(rows, tops) if u == v))
                  for (d, t), v in zip(rows, tops))
    assert sorted(map(tuple, jaccard_join.jaccard_components(documents).collect())) == want
    assert any(d != c for d, _, c in want)
    assert jaccard_join.jaccard_components(awkward).count() == len(awkward_rows())


def test_jaccard_join_around_the_threshold(spark):
    rng, rows = np.random.default_rng(5), []
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 15, 20, 24, 30, 47, 80, 150, 400):
        base = [f"b{n}.{k}" for k in range(n)]
        for edits in range(0, 7):
            words = list(base)
            for _ in range(edits):
                words[int(rng.integers(n))] = f"e{rng.integers(10**9)}"
            rows.append((len(rows), " ".join(words)))
        rows += [(len(rows) + k, " ".join(base[:n - k])) for k in range(1, min(n, 6))]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    found = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.component_id for r in found.orderBy("doc_id").collect()] == linked_groups([t for _, t in rows])


def test_jaccard_join_on_long_lists(spark, monkeypatch):
    """Sets mixed of a few common passages, so that every list is long, with linked pairs all over them."""
    rng = np.random.default_rng(8)
    passages = [words_text(100 + k, 30) for k in range(6)]
    texts = []
    for _ in range(60):
        parts = [passages[k] for k in rng.permutation(6)[:4]] + [words_text(int(rng.integers(10**6)), int(rng.integers(60)))]
        parts = [parts[k] for k in rng.permutation(len(parts))]
        text = " ".join(parts).split()
        for _ in range(4):
            texts.append(" ".join(text))
            text[int(rng.integers(len(text)))] = f"e{rng.integers(10**9)}"
            text += [f"t{rng.integers(10**9)}" for _ in range(int(rng.integers(12)))]
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", 4)
    told: dict = {}
    found = jaccard_join.jaccard_components(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), told)
    assert [r.component_id for r in found.orderBy("doc_id").collect()] == linked_groups(texts)
    assert told["long"][2] > 0  # entries on lists that are held together block by block


def test_subset_boundary_follows_the_cost():
    assert jaccard_join.boundary({3: 1000, 5: 1000}) >= 5
    assert jaccard_join.boundary({16: 1_000_000}, list_cost=0.01) < 16
    for n in range(1, 40):
        assert all(jaccard_join.needed(n, m) <= n for m in range(jaccard_join.slack_free(n) + 1, n + 1)
                   if 100 * m >= 75 * n)


def test_near_copies_leave_one_of_each_group(spark, documents, awkward):
    for docs in (documents, awkward):
        rows = [tuple(r) for r in docs.collect()]
        left = [tuple(r) for r in jaccard_join.one_of_each_group(docs).collect()]
        groups = defaultdict(list)
        for row, top in zip(rows, linked_groups([r[1] for r in rows])):
            groups[top].append(row[0])
        want = [min((d for d in g if d is not None), default=None) for g in groups.values()]
        assert Counter(r[0] for r in left) == Counter(want)
        assert not Counter(left) - Counter(rows)


def test_exact_duplicates_stay_once(spark, documents, awkward):
    for docs in (documents, awkward):
        rows = [tuple(r) for r in docs.collect()]
        largest: dict[str, int] = {}
        for r in rows:
            key = lowered(r[1])
            largest[key] = max(largest.get(key, -1), -1 if r[0] is None else r[0])
        left = exact_dedup.drop_duplicates(docs).collect()
        assert sorted((lowered(r.text), r.doc_id) for r in left) == sorted(largest.items())
        marked = exact_dedup.exact_duplicates(docs)
        assert marked.count() == len(rows) and marked.where("kept").count() == len(largest)


def test_fingerprints_compose():
    weights = exact_dedup._weights()
    data = words_text(9, 30_000).encode()
    whole = exact_dedup.fingerprint(data, weights)
    for at in (1, 511, 512, 65_536, 99_999):
        a, b = exact_dedup.fingerprint(data[:at], weights), exact_dedup.fingerprint(data[at:], weights)
        assert whole == tuple((exact_dedup.shift(a[i], len(data) - at, i) + b[i]) % exact_dedup.PRIME for i in (0, 1))


def test_colliding_fingerprints_are_compared(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "fingerprint", lambda data, weights: (1, 1))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["aa", "bb", "AA", "bb", "cc"])], "doc_id long, text string")
    found = {r.doc_id: r.keep_id for r in exact_dedup.exact_duplicates(docs).collect()}
    assert found == {0: 2, 1: 3, 2: 2, 3: 3, 4: 4}


def test_language_stage_keeps_clean_documents(spark, documents, awkward):
    left = corpus_pipeline.identify_language(spark, documents, SF)
    assert left.columns == documents.columns
    letters = documents.where(F.col("text").rlike(r"\p{L}"))
    assert left.exceptAll(documents).count() == 0
    assert left.count() >= 0.99 * letters.count()
    kept = corpus_pipeline.identify_language(spark, awkward, SF)
    assert kept.columns == awkward.columns
    assert {0, 1, 2, 3}.isdisjoint(r.doc_id for r in kept.collect())


def test_language_stage_keeps_mixed_languages(spark, documents):
    """Texts in two, three and four languages in even shares, long and short, and every document with a letter."""
    letters = documents.where(F.col("text").rlike(r"\p{L}"))
    by_lang = defaultdict(str)
    for r in letters.where("lang is not null").orderBy("doc_id").collect():
        by_lang[r.lang] += r.text + " "
    langs, texts = sorted(by_lang), []
    assert len(langs) >= 4
    for size in (200, 5_000):
        for k in (2, 3, 4):
            texts += ["".join(by_lang[langs[(i + j) % len(langs)]][:size] for j in range(k)) for i in range(len(langs))]
    rows = [(1_000_000 + i, t, None, "web", len(t)) for i, t in enumerate(texts)]
    docs = letters.unionByName(spark.createDataFrame(rows, SCHEMA))
    left = corpus_pipeline.identify_language(spark, docs, SF)
    assert sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in docs.collect())


def test_language_accuracy_on_the_held_out_fold(spark):
    found = language_id.op8_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = found.where("held_out").join(docs, "doc_id").where("lang is not null").agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.95


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in language_id.new_weights(3, hidden=3).items()}
    steps, labels, mask = rng.integers(97, 103, size=(7, 4)), np.array([0, 1, 2, 1]), np.ones((7, 4))
    mask[5:, 1] = 0
    _, grads = language_id.gradients(w, steps, labels, mask)
    for name in ("uf", "xb", "o", "bb"):
        place = (98, 1) if name == "xb" else (0,) * w[name].ndim
        moved = [{**w, name: w[name].copy()} for _ in range(2)]
        for m, step in zip(moved, (1e-3, -1e-3)):
            m[name][place] += step
        up, down = (language_id.gradients(m, steps, labels, mask)[0] for m in moved)
        assert math.isclose((up - down) / 2e-3, grads[name][place], rel_tol=0.03, abs_tol=2e-4)


def test_mixture_meets_its_targets(spark, documents, awkward):
    for docs, block in ((documents, 128), (awkward, 16)):
        rows = docs.collect()
        sizes = defaultdict(int)
        for r in rows:
            sizes[r.source] += len(WORD.findall(r.text or ""))
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        goal = dict(zip(names, mixing.targets([sizes[n] for n in names], [1 + i % 3 for i in range(len(names))])))
        made = mixing.mixed_documents(docs, block=block)
        assert made.columns == docs.columns
        got, taken, texts = defaultdict(int), defaultdict(int), {(r.doc_id, r.source): set() for r in rows}
        for r in rows:
            texts[r.doc_id, r.source] |= set(WORD.findall(r.text or ""))
        for r in made.collect():
            words = WORD.findall(r.text)
            assert words and set(words) <= texts[r.doc_id, r.source] and r.n_chars == len(r.text)
            got[r.source] += len(words)
            taken[r.doc_id] += len(words)
        for n in names:
            assert abs(got[n] - goal[n]) <= 0.05 * goal[n] + 4 * block
        own = Counter()
        for r in rows:
            own[r.doc_id] += len(WORD.findall(r.text or ""))
        assert all(n <= 3 * own[d] for d, n in taken.items())
        assert mixing.mixed_documents(docs, block=block).exceptAll(made).count() == 0


def test_targets_and_permutations():
    assert mixing.targets([10, 10, 1000], [1, 2, 3]) == [30, 30, 960]
    assert sum(mixing.targets([5, 7, 9, 11], [1, 2, 3, 1])) == pytest.approx(32)
    for n in (1, 2, 3, 100, 1025):
        assert sorted(mixing.permuted(np.arange(n), n, [3, 5, 7, 11])) == list(range(n))


def test_byte_bpe_equals_the_library(spark, documents, awkward):
    import public_tokenizers
    import tiktoken

    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(path),
                              special_tokens={})
    for docs in (documents, awkward.where("doc_id <> 14 or doc_id is null")):
        texts = [(r.doc_id, r.text or "") for r in docs.collect()]
        want = Counter((d, np.array(plain.encode_ordinary(t), "<u4").tobytes(), t.encode()) for d, t in texts)
        found = byte_bpe.decode(byte_bpe.encode(docs, path, public_tokenizers.PATTERN), path)
        assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in found.collect()) == want


def test_token_files_equal_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    vocabulary = tokenizer_file("byte_bpe_50k.json")
    plain, start = Tokenizer.from_file(vocabulary), 0
    found = {r.doc_id: r for r in token_files.op4_token_files(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [0]
        got = found[r.doc_id]
        assert (got.start, got.n_tokens, got.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_take_awkward_rows(spark, awkward, empty, tmp_path):
    for name, docs in (("awkward", awkward), ("empty", empty)):
        path = f"file://{tmp_path}/{name}"
        token_files.write_tokens(docs, path, tokenizer_file("byte_bpe_50k.json"))
        assert token_files.checksums(token_files.read_tokens(spark, path)).count() == docs.count()


def test_fingerprints_follow_edits(spark, documents, awkward):
    found = {r.doc_id: r for r in order_minhash.fingerprints(documents).collect()}
    rows = documents.orderBy("doc_id").collect()
    for r, after in zip(rows, [*rows[1:], rows[0]]):
        n = len(r.text or "")
        cut = n // 2
        text = (r.text or "")[:n - cut] + (after.text or "")[:cut]
        assert found[r.doc_id].n_chars == n
        assert found[r.doc_id].edited_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert 0 <= found[r.doc_id].near_edited <= 1
    same = defaultdict(set)
    for r in rows:
        same[r.text].add(found[r.doc_id].fingerprint)
    assert all(len(s) == 1 for s in same.values())
    mean = lambda c: np.mean([getattr(r, c) for r in found.values()])
    assert mean("near_edited") > mean("near_next") + 0.1
    assert order_minhash.fingerprints(awkward).count() == len(awkward_rows())


def test_chat_tree_reads_back(spark):
    found = {r.conv_id: r for r in chat_tree.op2_chat_tree(spark, SF).collect()}
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append((r.role, r.text or ""))
    odd = "\\### Assistant: </turn> ok"
    turns[-7] = [("user", odd), ("assistant", odd)]
    assert found.keys() == turns.keys()
    for c, rows in turns.items():
        loss = "".join(t for role, t in rows if role == "assistant")
        whole = hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in rows).encode()).hexdigest()
        assert (found[c].n_turns, found[c].turns_sha256, found[c].loss_chars, found[c].loss_sha256) == (
            len(rows), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_toxic_passages(spark):
    found = toxicity.op6_toxicity(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = found.where("held_out").join(labels, "doc_id").select("predicted", "toxic", "score").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) >= 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_maximal_segments_by_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(200):
        scores = rng.integers(-5, 6, size=12).astype(float).tolist()
        sums = {(i, j): sum(scores[i:j]) for i in range(12) for j in range(i + 1, 13)}
        found = toxicity.maximal_segments(scores)
        best = max(sums.values())
        assert (max((s for *_, s in found), default=0) == best) if best > 0 else not found
        assert all(math.isclose(sums[a, b], s) for a, b, s in found)
        assert all(x[1] <= y[0] for x, y in zip(sorted(found), sorted(found)[1:]))


def test_maximal_segments_take_linear_time():
    class Counted(float):
        compared = 0

        def __ge__(self, other):
            Counted.compared += 1
            return float(self) >= float(other)

        def __add__(self, other):
            return Counted(float(self) + float(other))

        __radd__ = __add__

    scores = np.random.default_rng(6).normal(-0.3, 1, 8_000).tolist()
    assert toxicity.maximal_segments([Counted(s) for s in scores]) == toxicity.maximal_segments(scores)
    assert Counted.compared <= 8 * len(scores)


def test_shards_are_even_and_whole(spark, documents, awkward):
    for docs, even in ((documents, True), (awkward, False)):
        rows = [tuple(r) for r in bin_packing.pack(docs).select("doc_id", "size", "text_crc32", "shard", "slot").collect()]
        want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()))
                       for r in docs.collect())
        assert Counter(r[:3] for r in rows) == want
        slots, load = defaultdict(list), Counter()
        for _, size, _, shard, slot in rows:
            slots[shard].append(slot)
            load[shard] += size
        assert all(sorted(s) == list(range(len(s))) and 0 <= k < 8 for k, s in slots.items())
        assert not even or max(load.values()) <= 1.1 * sum(load.values()) / 8


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_an_empty_table(spark, empty, name, stage):
    left = stage(spark, empty, SF)
    assert left.count() == 0
    assert name == "byte_bpe" or left.columns == empty.columns


def test_operators_take_an_empty_table(spark, empty):
    for fn in (jaccard_join.jaccard_components, exact_dedup.exact_duplicates, bin_packing.pack, order_minhash.fingerprints):
        assert fn(empty).count() == 0


def test_pipeline_runs_whole(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(len(r.ids) == 4 * r.n_tokens for r in rows)
    known = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} <= known


def test_token_files_take_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    vocabulary = tokenizer_file("byte_bpe_50k.json")
    plain, mark = Tokenizer.from_file(vocabulary), "<|endoftext|>"
    texts = [f"one {mark} two", "one two", f"one \n {mark}", mark, f"{mark}{mark} x", f"a  b {mark} ", "<|endoftext| >", f"x{mark}y z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    token_files.write_tokens(docs, f"file://{tmp_path}/added", vocabulary)
    found = {r.doc_id: r.token_ids for r in token_files.read_tokens(spark, f"file://{tmp_path}/added").collect()}
    assert found == {i: plain.encode(t, add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    assert 50256 in found[0]
