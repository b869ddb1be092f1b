"""Top-k search, prefix trie and alignment against brute force, on the tables and on awkward rows."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from medgrain.llm import alignment, prefix_trie, topk_search
from medgrain.llm.common import tokenizer_file
from medgrain.llm.queries import ORACLES

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int"
TURNS = "conv_id long, turn long, role string, text string"


def rows_of(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=str)


def clashing(df, *names: str):
    return df.withColumns({n: F.lit(i) for i, n in enumerate(names)})


@pytest.mark.parametrize("name", ["op11_topk_search", "op12_prefix_trie"])
def test_query_equals_sql(spark, name):
    query = {"op11_topk_search": topk_search.op11_topk_search, "op12_prefix_trie": prefix_trie.op12_prefix_trie}[name]
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = query(spark, SF)
    cursor = con.execute(ORACLES[name])
    assert sorted(d[0] for d in cursor.description) == sorted(found.columns)
    want = sorted((tuple(r) for r in cursor.fetchall()), key=str)
    assert rows_of(found.select([d[0] for d in cursor.description])) == want


def nearest(rows: list[tuple], every: int, k: int) -> list[tuple]:
    kept = [(i, v, [int(np.floor(256 * x)) for x in e]) for i, (v, e, *_) in enumerate(rows)
            if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for i, query, q in kept:
        if query is None or query % every:
            continue
        scores = [(max(-2**63 + 1, min(2**63 - 1, sum(a * b for a, b in zip(q, p)))), v) for j, v, p in kept if j != i]
        scores.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
        out += [(query, r, v, s) for r, (s, v) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


def awkward_vectors() -> list[tuple]:
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * (1 + i % 5)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # a third repeat one vector
    rows += [(50, [1.0] * 6), (None, rows[7][1]), (None, None), (400, None), (450, [1.0, None, 0, 0, 0, 0]),
             (500, [float("nan")] * 6), (550, [1.0, float("inf"), 0, 0, 0, 0]), (600, []), (650, [2.0]), (700, [0.0] * 6),
             (750, [1e30, -1e30, 1e30, 0, 0, 0]), (751, [1e30, 1e30, 0, 0, 0, 0]), (752, [5e9, 3.5, 0, 0, 0, 0]), rows[5]]
    return [(v, e if e is None else [x if x is None else float(x) for x in e], 0) for v, e in rows]


@pytest.mark.parametrize("head, block, group", [(4096, 2048, 64 << 20), (16, 7, 20 * 8 * 6), (8, 64, 64 << 20)])
def test_search_equals_brute_force(spark, monkeypatch, head, block, group):
    for name, value in (("HEAD_ROWS", head), ("BLOCK", block), ("GROUP_BYTES", group), ("QUERIES", 3), ("CELL_PAIRS", 40)):
        monkeypatch.setattr(topk_search, name, value)
    rows = awkward_vectors()
    df = clashing(spark.createDataFrame(rows, VECTORS), "query", "size", "score", "rank", "_index", "a b")
    assert rows_of(topk_search.top_inner_products(df, F.col("vec_id") % 50 == 0)) == nearest(rows, 50, 5)


def test_search_with_few_rows(spark):
    rows = [(50, [1.0, 2.0], 0), (3, [0.5, 0.5], 0)]
    for some in (rows, rows[:1], rows[1:], []):
        df = spark.createDataFrame(some, VECTORS)
        assert rows_of(topk_search.top_inner_products(df, F.col("vec_id") % 50 == 0)) == nearest(some, 50, 5)


def test_bounds_leave_pairs_out(spark):
    """Vectors of very different lengths: groups that cannot reach a threshold get no query block."""
    rng = np.random.default_rng(4)
    whole = np.floor(rng.normal(size=(400, 8)) * np.geomspace(1000, 1, 400)[:, None])
    axes = np.linalg.qr(rng.normal(size=(8, 8)))[0]
    ids = np.arange(400)
    blocks = [topk_search.Block(topk_search.pack(whole[i:i + 50]), ids[i:i + 50].tobytes(), np.zeros(50, bool).tobytes(),
                                ids[i:i + 50].tobytes(), axes, [3]) for i in range(0, 400, 50)]
    blocks.sort(key=lambda b: -b.longest)
    met = []
    for b in blocks:
        b.column_of = lambda own, b=b: met.append(b) or topk_search.Block.column_of(b, own)
    own = np.arange(0, 400, 50)
    best = topk_search.scan(topk_search.Side(whole[own], axes, [3]), own, blocks, np.full(8, -2**62), [3], 5)
    assert len(met) < len(blocks)
    found = sorted(zip(own[best.found[0]].tolist(), (-best.found[1]).tolist(), best.found[2].tolist()))
    scores = (whole @ whole.T).astype(int)
    assert found == sorted(x for q in own for x in sorted((q, -scores[q, j], j) for j in range(400) if j != q)[:5])


def nodes_of(rows: list[tuple]) -> list[tuple]:
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append(((t is not None, t or 0), r or "", x or ""))
    convs = {c: [x[1:] for x in sorted(v)] for c, v in convs.items()}
    members, new = defaultdict(list), {}
    for c in sorted(convs):
        h = zlib.crc32(str(c).encode()) % 6
        family = c - (c % 100 if c >= 0 else -(-c % 100))
        new[c] = tuple(convs.get(family, [])[:h] + convs[c][h:])
        for d in range(len(new[c]) + 1):
            members[new[c][:d]].append(c)
    kids, leaves, saved = Counter(n[:-1] for n in members if n), Counter(), Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not kids[n]
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1]) if n else 0
    ends = {n: ",".join(str(c) for c in m if len(new[c]) == len(n)) for n, m in members.items()}
    return sorted(((m[0], len(n), members[n[:-1]][0] if n else None, len(m), kids[n], leaves[n], saved[n],
                    hashlib.sha256(ends[n].encode()).hexdigest()) for n, m in members.items()), key=str)


def awkward_turns() -> list[tuple]:
    rng, rows = np.random.default_rng(1), []
    for c in range(160):
        base = int(rng.integers(4))
        for t in range(int(rng.integers(0, 9))):
            turn = None if t == 0 and c % 9 == 0 else t // 2 * 2 if c % 7 == 0 else t
            rows.append((c, turn, [None, "user", "assistant"][t % 3], f"b{base}t{t}" if rng.random() < .8 else f"u{rng.integers(3)}"))
    rows += [(500, t, "user", f"x{t}") for t in range(120)] + [(501, t, "user", f"x{t}") for t in range(37)]
    rows += [(500 + k, t, "user", f"x{t % 3}") for k in range(2, 30) for t in range(k)]
    rows += [(1000 + k, 0, "user", "same") for k in range(150)]  # many end at one node
    return rows + [(-7, 0, "user", "x"), (-250, 1, "user", None), (None, 0, "a", "b"), rows[5], rows[5],
                   (901, 0, "user", "long " * 40_000), (902, 0, "", "")]


@pytest.mark.parametrize("unit, nodes, ids, block", [(4096, 1 << 17, 20_000, 64), (3, 20, 2, 4), (5, 1, 7, 1)])
def test_trie_equals_brute_force(spark, monkeypatch, unit, nodes, ids, block):
    for name, value in (("UNIT", unit), ("TRIE_NODES", nodes), ("PACK_IDS", ids), ("EXCESS_BLOCK", block)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = awkward_turns()
    df = clashing(spark.createDataFrame(rows, TURNS), "depth", "pos", "h1", "owner", "seg", "part", "a b")
    assert rows_of(prefix_trie.trie_nodes(df)) == nodes_of(rows)


def test_trie_without_rows(spark):
    df = spark.createDataFrame([], TURNS)
    assert prefix_trie.trie_nodes(df).collect() == []
    assert prefix_trie.trie_nodes(spark.createDataFrame([(None, 1, "a", "b")], TURNS)).collect() == []
    one = [(7, 0, "user", "alone")]
    assert rows_of(prefix_trie.trie_nodes(spark.createDataFrame(one, TURNS))) == nodes_of(one)


def test_close_of_every_parenthesis():
    rng = np.random.default_rng(2)
    for trial in range(100):
        bits, open_ = [], 0
        while len(bits) < 30 * (trial % 20) or open_:
            up = open_ == 0 or (rng.random() < .55 and len(bits) < 30 * (trial % 20))
            bits.append(int(up))
            open_ += 1 if up else -1
        stack, want = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        if bits:
            assert prefix_trie.close_of(np.array(bits, np.int8)).tolist() == [want[i] for i in sorted(want)]


def aligned(rows: list[tuple]) -> list[tuple]:
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    of_char = alignment.byte_of_char()

    def a_bytes(i):
        return bytes(of_char[c] for c in a.id_to_token(i))

    def b_bytes(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    docs, count = [], Counter()
    for doc_id, text in rows:
        first = second = []
        if text:
            first, second = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            if any(b"".join(map(f, ids)) != (" " + text).encode() for f, ids in ((a_bytes, first), (b_bytes, second))):
                first = second = []
        links, groups, mine, theirs, i, j, end_a, end_b = Counter(), [], [], [], 0, 0, 0, 0
        while i < len(first) or j < len(second):
            if end_a <= end_b:
                mine.append(first[i])
                end_a += len(a_bytes(first[i]))
                i += 1
            else:
                theirs.append(second[j])
                end_b += len(b_bytes(second[j]))
                j += 1
            if end_a == end_b:
                for x, n in Counter(mine).items():
                    for y, m in Counter(theirs).items():
                        links[x, y] += n * m
                groups.append(",".join(map(str, mine)) + "|" + ",".join(map(str, theirs)))
                mine, theirs = [], []
        count.update(links.keys())
        docs.append((doc_id, len(first), len(second), len(groups), links, ";".join(groups)))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return sorted(((d, n, m, g, sum(links.values()), sum(k for p, k in links.items() if count[p] == top[p[0]]),
                    sum(k * count[p] for p, k in links.items()), s) for d, n, m, g, links, s in docs), key=str)


def test_alignment_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[1] else "")
            for r in aligned([(r.doc_id, r.text) for r in docs.collect()])]
    assert rows_of(alignment.op13_alignment(spark, SF)) == sorted(want, key=str)


AWKWARD = [None, "", " ", "  two", "a  b", "x ", "<|endoftext|> a<|endoftext|>", "a▁b", "é ß 漢字 \U0001f600 İ", "a" * 200_000,
           "line\n\n next \tq", "\x00 z", "<0x41> <s> </s>", "é ﬁ \xa0  x", "the the the", "the the the", "漢字漢字" * 500,
           " ".join(f"w{i * i}" for i in range(3000)), "स्ते स", "the " * 30_000 + "end"]


@pytest.mark.parametrize("chars, together, pieces", [(4 << 20, 1 << 21, 400_000), (60, 8, 3)])
def test_alignment_equals_brute_force(spark, monkeypatch, chars, together, pieces):
    monkeypatch.setattr(alignment, "PAIRS_AT_ONCE", together)
    monkeypatch.setattr(alignment, "MOST_PIECES", pieces)
    rows = [*enumerate(AWKWARD), (None, "the"), (3, "again the"), (3, "again the")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "batch", "part", "pairs", "found", "a b")
    found = alignment.alignments(df, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"), chars)
    assert rows_of(found) == aligned(rows)


def test_alignment_without_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignments(df, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")).collect() == []


def test_groups_end_where_both_tokenizers_end():
    rng = np.random.default_rng(6)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a, b = (np.sort(np.append(rng.choice(n, int(rng.integers(0, n)), replace=False), n)) for _ in range(2))
        a, b = a[a > 0], b[b > 0]
        label_a, label_b = alignment.groups_of(a, b)
        both = np.intersect1d(a, b)
        for ends, label in ((a, label_a), (b, label_b)):
            assert (np.searchsorted(both, ends) == np.searchsorted(both, b[label])).all()
            assert len(np.unique(label)) == len(both)
