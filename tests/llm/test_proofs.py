"""Fingerprints, trees, shards and stages against plain versions, on shared prefixes, large groups and hostile columns."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from medgrain.llm import bin_packing, chat_tree, exact_dedup, order_minhash, toxicity

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
GOLD, LOW32, LOW64 = 0x9E3779B97F4A7C15, (1 << 32) - 1, (1 << 64) - 1


def mixed(x: int) -> int:
    x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & LOW64
    return x ^ x >> 32


def plain_sketch(text: str) -> list[int]:
    if not text:
        return [0] * order_minhash.HASHES
    k, seen, items = min(order_minhash.K, len(text)), Counter(), []
    for i in range(len(text) - k + 1):
        h = k
        for ch in text[i:i + k]:
            h = (h * GOLD + ord(ch)) & LOW64
        high = mixed(h) & LOW32
        items.append(mixed(high + (seen[high] << 32)) & LOW32)
        seen[high] += 1
    out = []
    for salt, odd in zip(order_minhash._SALT[:, 0].tolist(), order_minhash._ODD[:, 0].tolist()):
        ranked = sorted(range(len(items)), key=lambda i: ((items[i] ^ salt) * odd & LOW32, i))
        value = 0
        for i in sorted(ranked[:order_minhash.PICKED]):
            value = mixed((value * GOLD + items[i] + 1) & LOW64)
        out.append(value & 0xFFFF)
    return out


def some_texts() -> list[str]:
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("ab cé漢"), int(n))) for n in [1, 2, 5, 6, 7, 30, 200, *rng.integers(1, 400, 20)]]
    return ["", *texts, "a" * 50, "abcdef" * 40, "".join(rng.choice(list("abcdefgh "), 9000))]


def test_order_minhash_equals_a_plain_version():
    for text in some_texts():
        assert order_minhash.sketch(text).tolist() == plain_sketch(text)


def test_fingerprints_of_the_next_and_the_edited_text(spark):
    texts = some_texts()[:20]
    rows = [(3 * i, t or None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(5)
    found = {r.doc_id: r for r in order_minhash.fingerprints(df).collect()}
    for i, text in enumerate(texts):
        following = texts[(i + 1) % len(texts)]  # after the last comes the first
        changed = text[:len(text) - len(text) // 2] + following[:len(text) // 2]
        mine, new, theirs = map(plain_sketch, (text, changed, following))
        r = found[3 * i]
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and r.n_chars == len(text)
        assert r.fingerprint == "".join(f"{x:04x}" for x in mine) and r.edited_fingerprint == "".join(f"{x:04x}" for x in new)
        assert r.near_edited == np.mean([a == b for a, b in zip(mine, new)])
        assert r.near_next == np.mean([a == b for a, b in zip(mine, theirs)])


def branching_turns() -> list[tuple]:
    rng, rows = np.random.default_rng(6), []
    for c in range(80):
        for t in range(int(rng.integers(1, 8))):
            role = ["user", "assistant", "a:b\\c", None][t % 4]
            rows.append((c, t, role, ["same", "### x", "</turn>\n", "\\", None][int(rng.integers(5)) if rng.random() < .4 else t % 5]))
    rows += [(200, t, "user", "again") for t in (0, 0, 1, 1)] + [(None, 1, "user", "no id"), (None, 0, "user", "same")]
    return rows + [(201, t, "user", f"{t % 2}") for t in range(300)] + [rows[3], (202, None, "assistant", "x" * 50_000)]


def test_chat_tree_by_brute_force(spark):
    rows = branching_turns()
    df = spark.createDataFrame(rows, TURNS).withColumns({n: F.lit(i) for i, n in enumerate(("node", "depth", "key", "place", "a b"))})
    tree, index = chat_tree.build_tree(df)
    convs = defaultdict(list)
    for c, t, role, text in rows:
        convs[c].append(((t is not None, t or 0), role or "", text or ""))
    convs = {c: [x[1:] for x in sorted(v)] for c, v in convs.items()}
    nodes = {bytes(r.node): r for r in tree.collect()}
    prefix_of = {}
    for r in index.collect():
        prefix = tuple(convs[r.conv_id][:r.depth + 1])
        assert prefix_of.setdefault(bytes(r.node), prefix) == prefix
    assert len(set(prefix_of.values())) == len(prefix_of) == len(nodes)  # equal prefixes are one node
    assert len(nodes) < len(rows)
    by_prefix = {p: nodes[n] for n, p in prefix_of.items()}
    at = 0
    for r in sorted(nodes.values(), key=lambda r: r.start):
        assert r.start == at and r.size == len(r.body)
        at += r.size
    for prefix, r in by_prefix.items():
        above = [by_prefix[prefix[:d]] for d in range(1, len(prefix))]
        assert r.position == sum(a.size for a in above)
        merged = []
        for a in above:
            if merged and merged[-1][1] == a.start:
                merged[-1][1] = a.start + a.size
            else:
                merged.append([a.start, a.start + a.size])
        assert [[x.low, x.high] for x in r.attends] == merged
        inside = [q for p, q in by_prefix.items() if p[:len(prefix)] == prefix]
        assert r.stop == max(q.start + q.size for q in inside)
        assert sum(q.size for q in inside) == r.stop - r.start  # nothing else lies in the subtree's stretch
    read = {r.conv_id: r for r in chat_tree.read_back(tree, index).collect()}
    assert read.keys() == convs.keys()
    for c, turns in convs.items():
        whole = "".join(f"{role}\n{text}\n" for role, text in turns)
        said = "".join(text for role, text in turns if role == "assistant")
        assert read[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (read[c].n_turns, read[c].loss_chars) == (len(turns), len(said))
        assert read[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_chat_tree_of_nothing(spark):
    tree, index = chat_tree.build_tree(spark.createDataFrame([], TURNS))
    assert tree.collect() == [] and chat_tree.read_back(tree, index).collect() == []


def plain_place(parcels: list, shards: int) -> list[list[int]]:
    weights = bin_packing.WEIGHTS.tolist()
    total = [max(1.0, sum(c[d] for p in parcels for c in p)) for d in range(3)]
    share = [[sum(c[d] for c in p) / total[d] * weights[d] for d in range(3)] for p in parcels]
    room = [[w / shards for w in weights] for _ in range(shards)]
    out: list = [None] * len(parcels)

    def best(need: list, among: list) -> int:
        return max(among, key=lambda s: (round(sum(a * b for a, b in zip(room[s], need)), 12), -s))

    def put(s: int, need: list) -> int:
        room[s] = [r - x for r, x in zip(room[s], need)]
        return s

    rest = []
    for i in sorted(range(len(parcels)), key=lambda i: tuple(-sum(c[d] for c in parcels[i]) for d in range(3))):
        fit = [s for s in range(shards) if all(r >= x - 1e-12 for r, x in zip(room[s], share[i]))]
        if len(parcels[i]) > 1 and fit:
            out[i] = [put(best(share[i], fit), share[i])] * len(parcels[i])
        else:
            out[i] = [None] * len(parcels[i])
            rest += [(i, j) for j in range(len(parcels[i]))]
    for i, j in sorted(rest, key=lambda x: tuple(-v for v in parcels[x[0]][x[1]])):
        need = [parcels[i][j][d] / total[d] * weights[d] for d in range(3)]
        out[i][j] = put(best(need, list(range(shards))), need)
    return out


def test_placing_equals_a_plain_version():
    rng = np.random.default_rng(5)
    for _ in range(40):
        parcels = [rng.integers(1, 1000, (int(rng.integers(1, 6)), 3)) for _ in range(int(rng.integers(1, 60)))]
        assert bin_packing.place([p.astype(float) for p in parcels], 5) == plain_place([p.tolist() for p in parcels], 5)


def test_groups_stay_whole_while_a_shard_has_room(spark):
    n, rng = 6000, np.random.default_rng(2)
    rows, i = [], 0
    for name, part in (("one", .01), ("four", .04), ("ten", .10), ("thirty", .30)):
        for _ in range(int(part * n)):
            rows.append((i, f"{name} words in a group of equal texts"))
            i += 1
    rows += [(k, " ".join(f"w{x}" for x in rng.integers(99, size=8))) for k in range(i, n)]
    found = bin_packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = dict(rows)
    where, filled = defaultdict(set), defaultdict(lambda: np.zeros(3))
    for r in found:
        where[text[r.doc_id].split()[0]].add(r.shard)
        filled[r.shard] += (r.size, r.words, 1)
    assert all(len(where[g]) == 1 for g in ("one", "four", "ten"))
    assert len(where["thirty"]) > 1  # no shard of eight can hold it
    sums = np.array([filled[s] for s in range(8)])
    assert (np.abs(sums / sums.mean(0) - 1) < 0.03).all()
    for s in range(8):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(int(filled[s][2])))


HOSTILE = ("a b", "_id", "_size", "_keep", "_row", "_at", "_text", "_digest", "_sha", "_own", "found", "x.y")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:4])
def test_stages_take_any_column_name(spark, name, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wide = docs.withColumns({c: F.lit(i) for i, c in enumerate(HOSTILE)})
    out = stage(spark, wide, SF)
    assert out.columns == wide.columns
    assert out.select(*[f"`{c}`" for c in HOSTILE]).distinct().collect() == [tuple(range(len(HOSTILE)))]


def test_rows_with_null_ids_are_compared(spark, monkeypatch):
    """With one fingerprint for all texts, only the comparison tells them apart."""
    monkeypatch.setattr(exact_dedup, "fingerprint", lambda data, weights: (1, 1))
    rows = [(None, "same"), (None, "SAME"), (1, "same"), (None, "othr"), (2, "fore"), (None, "othr")]
    found = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str)
    digest = {t: hashlib.sha256(t.encode()).hexdigest() for t in ("same", "othr", "fore")}
    want = [(None, 1, 3, digest["same"])] * 2 + [(1, 1, 3, digest["same"]), (2, 2, 1, digest["fore"])] + [(None, None, 2, digest["othr"])] * 2
    assert got == sorted(want, key=str)


def test_every_clear_key_is_kept(spark):
    rng = np.random.default_rng(8)
    docs = [(i, " ".join([f"w{x}" for x in rng.integers(300, size=30)] + (["vile", "rare%d" % (i % 40)] if i % 4 == 0 else []))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in docs], "doc_id long, toxic int")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(df, labels)
    ids, _ = toxicity.pick(labels, 5000)
    counts, words = defaultdict(lambda: [0, 0]), [0, 0]
    text = dict(docs)
    by_word = defaultdict(lambda: [0, 0])
    for r in ids.where("half = 0").collect():
        for w in set(toxicity.words_of(text[r.doc_id])):
            by_word[w][1 - r.toxic] += 1
    for w, (t, c) in by_word.items():
        words[0] += t
        words[1] += c
        for k in toxicity.keys_of(w):
            counts[k][0] += t
            counts[k][1] += c
    want = toxicity.learn_words(sorted((k, *v) for k, v in counts.items()), *words, 1.0, 2.0)
    kept = [k for k, v in vars(model).items() if isinstance(v, dict) and v == vars(want)[k]]
    assert kept and any(len(vars(want)[k]) > 0 for k in kept)
