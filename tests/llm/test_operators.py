"""The operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from flowlens.llm import ann, bpe, chat, exact, fingerprint, graph, lines, merkle, mix, simhash, spelling, substring, toxicity, warc
from flowlens.llm.common import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, key string"


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    vocab = np.array([f"w{i}" for i in range(400)] + ["Été", "ñu", "the", "of"])
    base = [" ".join(rng.choice(vocab, n)) for n in (3, 40, 120, 600)]
    out = [*base, *base, "", None, " \t\n", "one", "a\nb\nLonger line here\n", "x\n longer LINE here \ny", "in " * 300, "é" * 50]
    out += [base[2] + " tail", base[3].replace("w1 ", "w2 ", 1), "\n".join(base), " ".join(rng.choice(vocab, 20000))]
    return [(i * 3, t) for i, t in enumerate(out)]


def frame(spark, texts):
    rows = [(i, t, "en", f"s{n % 3}" if n % 4 else None, 1, 0.5, 7, "k") for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_simhash(spark, texts):
    rows = [*texts, (None, "one"), (0, texts[0][1])]
    fps = [(i, simhash.fingerprint((t or "").encode(), 4)) for i, t in rows]
    for t in ("a b c", "A\x0bB c d e", "", "ÀB x"):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).replace("\x0b", " ").split(" ") if t else []
        hs = [xxhash.xxh64_intdigest(" ".join(words[k:k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))] if words else []
        assert simhash.fingerprint(t.encode(), 4) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    got = simhash.simhash_components(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{f:016x}") for i, f in fps)
    label = {f: f for _, f in fps}
    for _ in label:
        for a in label:
            for b in label:
                if (a ^ b).bit_count() <= 4:
                    label[a] = label[b] = min(label[a], label[b])
    low = defaultdict(list)
    for i, f in fps:
        low[label[f]] += [i] if i is not None else []
    want = {f"{f:016x}": min(low[label[f]]) for _, f in fps}
    assert all(r.component_id == want[r.fingerprint] for r in got)


def test_links_of_dense_groups(spark):
    """Any group size, also with groups that go on to the second table, gives the brute-force components."""
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 1 << 63, 12)
    fp = {int(c) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 6), replace=False)) for c in centre for _ in range(60)}
    df = spark.createDataFrame([(x,) for x in fp], "fp long")
    label = {x: x for x in fp}
    changed = True
    while changed:
        changed = False
        for a in fp:
            for b in fp:
                if label[b] < label[a] and (a ^ b).bit_count() <= 4:
                    label[a], changed = label[b], True
    for size in (4, 8192):
        got = {r.node: r.root for r in graph.connected_components(simhash.link_fingerprints(df, group_rows=size)).collect()}
        assert {x: got.get(x, x) for x in fp} == label


def test_fingerprints(spark, texts):
    rows = sorted(((i, t or "") for i, t in texts), reverse=True)
    got = {r.doc_id: r for r in fingerprint.document_fingerprints(frame(spark, texts)).collect()}
    likeness = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        edited = t[:len(t) - len(t) // 3] + nxt[:len(t) // 3]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = Counter(t.lower().split()), Counter(edited.lower().split())
        likeness.append(r.near_edited - (sum((a & b).values()) / max(1, sum((a | b).values())) if a or b else 1.0))
    assert len(got) == len(rows) and abs(np.mean(likeness)) < 0.05 and np.abs(likeness).max() < 0.3
    by_text = defaultdict(set)
    for i, t in rows:
        by_text[" ".join(t.lower().split())].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    nulls = fingerprint.document_fingerprints(frame(spark, [(None, "b c d"), (None, ""), (5, "x y z"), (5, "x y z")])).collect()
    first = hashlib.sha256(b"b c x").hexdigest()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    # the next of a null id is the first document; the two rows of id 5 follow each other
    want = [(None, 5, sha("b c x")), (None, 0, sha("")), (5, 5, sha("x y x")), (5, 5, sha("x y x"))]
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in nulls) == Counter(want)
    only = fingerprint.document_fingerprints(frame(spark, [(None, "abc"), (None, "x y z")])).collect()
    assert Counter((r.n_chars, r.edited_sha256) for r in only) == Counter([(3, sha("aba")), (5, sha("x y x"))])


def test_fingerprints_of_weighted_terms():
    """Many pairs with known generalised Jaccard similarity: the mean collision rate has no bias."""
    s, err = fingerprint.Sampler(256), []
    rng = np.random.default_rng(1)
    for k in range(60):
        a = Counter({f"t{k}_{i}": int(c) for i, c in enumerate(rng.integers(1, 6, 30))})
        b = Counter({w: int(rng.integers(1, 6)) for w in list(a)[:20]}) + Counter({f"u{k}_{i}": 2 for i in range(8)})
        x = s.signatures([" ".join(a.elements()), " ".join(b.elements())])
        err.append((x[0] == x[1]).mean() - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(err)) < 0.015 and np.std(err) < 0.05


def test_fingerprints_of_long_texts():
    """The collision rate stays that of generalised Jaccard at 100,000 distinct words: none in common, and half of them."""
    s, n = fingerprint.Sampler(256), 100_000
    text = lambda first, count=1: " ".join(f"w{i}" for i in range(first, first + n) for _ in range(count))
    x = s.signatures([text(0), text(n), text(n // 2), text(2 * n, 2), text(3 * n, 2)])
    assert (x[0] == x[1]).mean() < 0.02 and (x[3] == x[4]).mean() < 0.02 and (x[0] == x[3]).mean() < 0.02
    assert abs((x[0] == x[2]).mean() - 1 / 3) < 0.1


def test_bpe(spark, texts):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(0)
    odd = ["".join(chr(int(c)) for c in rng.choice([32, 10, 97, 98, 0x4E00, 0xE9, 0x1F600, 0x301], 40)) for _ in range(200)]
    rows = [*texts, (None, "null id"), *((1000 + i, t) for i, t in enumerate([*odd, "a" * 999, "ab" * 500, " " * 300, "#" * 999]))]
    got = bpe.encode_documents(frame(spark, rows), path, public_tokenizers.PATTERN).collect()
    want = Counter()
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want[(i, len(ids), tuple(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.ids_sha256, r.decoded_sha256) for r in got) == want


@pytest.mark.parametrize("solo", [bpe.SOLO, 0])
def test_bpe_of_long_pieces(monkeypatch, solo):
    """Two letters 500,000 times, and pieces in which merges of lower rank come in between, together and one by one."""
    monkeypatch.setattr(bpe, "SOLO", solo)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})
    rng, vocab = np.random.default_rng(6), list(ranks)
    few = [[vocab[i] for i in rng.integers(0, len(vocab), 5)] for _ in range(8)]
    pieces = [b"ab" * 500_000, b"aab" * 20_000, b" the" * 20_000, *[b"".join(w[i] for i in rng.integers(0, 5, 4000)) for w in few]]
    pieces += [b"".join(vocab[i] for i in rng.integers(0, len(vocab), rng.integers(1, 40))) for _ in range(400)]
    merges = bpe.Merges(bpe.read_ranks(path))
    ids, count = merges.replay(pieces)
    for piece, own in zip(pieces, np.split(ids, np.cumsum(count)[:-1]), strict=True):
        assert own.tolist() == library._core_bpe.encode_single_piece(piece)
    assert all(merges.alone(p) == library._core_bpe.encode_single_piece(p) for p in pieces[-100:])


def _kept(rows):
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\f\r"))
    rank = lambda i: 1 << 63 if i is None else i
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(rank(i))
    gone = lambda i, x: len(key(x)) >= 10 and rank(i) > min(held[key(x)])
    return Counter((i, "\n".join(x for x in (t or "").split("\n") if not gone(i, x)), len((t or "").split("\n")),
                    sum(gone(i, x) for x in (t or "").split("\n"))) for i, t in rows)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (7, 3)])
def test_lines(spark, texts, batches, fanout):
    rows = [*texts, (None, "longer line here"), (None, "only nulls hold this\nonly nulls hold this"), (3, texts[1][1])]
    rows += [(500 + i, "A line that all hold\nown line number %d\nshort" % i) for i in range(40)]
    out = lines.drop_repeated_lines(frame(spark, rows), batches=batches, fanout=fanout)
    assert Counter((r.doc_id, r.text, r._fl_lines, r._fl_dropped) for r in out.collect()) == _kept(rows)
    assert out.columns[:8] == [c.split()[0] for c in SCHEMA.split(", ")]


def test_mix(spark):
    rows = [(i, f"t{i}", "en", "hot" if i % 3 else f"s{i % 7}", 1, 0.0, 0, "") for i in range(600)] + [(None, "n", "en", None, 1, 0.0, 0, "")] * 3
    shares = {"hot": 5, "s0": 3, "s3": 2}
    out = mix.mix_sources(spark.createDataFrame(rows, SCHEMA), shares, 2, block_docs=4, rank_rows=50).collect()
    assert Counter((r.doc_id, r.source) for r in out) == Counter((r[0], r[3]) for r in rows)
    assert len({(r._fl_slot, r._fl_pos) for r in out}) == len(rows)
    slots = {(r._fl_class, r._fl_block): r._fl_slot for r in out}
    assert len(set(slots.values())) == len(slots)
    for c, share in enumerate([5, 3, 2, 2]):
        at = [slots[k] for k in sorted(k for k in slots if k[0] == c)]
        assert at == sorted(at)
        for n, slot in enumerate(at):  # before and after the slot, less than a block from the target
            assert abs(n - slot * share / 12) < 1 and abs(n + 1 - (slot + 1) * share / 12) < 1


def test_warc(spark):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(i, "u", "x" * (i % 30) + (fake * (i % 4) if i % 3 == 0 else "") + "é" * (i % 7)) for i in range(120)]
    rows += [(1000, None, None), (1001, "a\r\nb", ""), (1002, "u", "WARC/1.0\r\n"), (1003, "u", "WARC/1.0\r\n" * 2), (1004, "u", "\r\n\r\n"),
             (1005, "u", "y" * 20000 + fake), (1006, "u", fake), (1007, "u", fake[:-4])]
    text = {i: (t or "").encode() for i, _, t in rows}
    keeper = defaultdict(int)
    for i, t in text.items():
        keeper[t] = max(keeper[t], i)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("2k", "10m"):  # parts that cut records, and whole files
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            path = new_path(spark, "warc")
            warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("x")).repartition(2), path)
            out = warc.read_warc(spark, path).collect()
            number = lambda s: s and int(s[len("<urn:x-page:"):-1])
            assert sorted(number(r.record_id) for r in out) == sorted(text)
            for r in out:
                t, i = text[number(r.record_id)], number(r.record_id)
                assert r.payload_bytes == len(t) and r.payload_digest == base64.b32encode(hashlib.sha1(t).digest()).decode()
                assert (r.record_type, number(r.refers_to)) == (("response", None) if keeper[t] == i else ("revisit", keeper[t]))
                assert r.record_type == "revisit" or bytes(r.payload) == t
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16))
    x[200:260] = x[7]  # a vector that many rows share
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [float("inf")] + [1.0] * 15), (None, [1.0] * 16),
           (2080, [1.0, 2.0]), (2100, [None] + [1.0] * 15)]
    df = spark.createDataFrame([*rows, *bad, rows[40]], "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = defaultdict(list)
    for r in ann.search(*(lambda v: (v.where("vec_id % 20 = 0"), ann.build_index(v, 21, shard_rows=400)))(
            df.where(F.col("vec_id").isNotNull() & ann.usable(F.col("embedding"))).select("vec_id", "embedding").distinct()), 20, query_rows=30).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hit = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        want = sorted((i for i in range(1500) if i != q), key=lambda i: (-s[i], i))[:20]
        found = sorted(got[q])
        assert len(found) == 20 and all(abs(sc - s[i]) < 1e-9 for _, i, sc in found)
        assert [(-round(sc, 12), i) for _, i, sc in found] == sorted((-round(sc, 12), i) for _, i, sc in found)
        hit += len({i for _, i, _ in found} & set(want))
    assert hit / (75 * 20) >= 0.9 and set(got) == set(range(0, 1500, 20))  # 2080 has no other vector of its length


def test_nearest_neighbours_as_a_stream(spark):
    """Blocks and small Arrow batches that end anywhere give the rows of one block; an id with two vectors is named once."""
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))]
    rows += [(i, rng.normal(size=8).tolist()) for i in (0, 20, 33)] + [(1000 + i, rng.normal(size=3).tolist()) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index, asked = ann.build_index(df, 21, shard_rows=100), df.where("vec_id % 20 = 0")
    whole = ann.search(asked, index, 20).collect()
    assert len({(r.query_id, r.vec_id) for r in whole}) == len(whole) == 15 * 20 + 3 * 20
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        cut = ann.search(asked, index, 20, query_rows=5).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert {(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in cut} == {(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in whole}


def test_chat(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo <|im_end|>"), (1, 3, "ann", None), (1, 3, "ann", None),
             (2, 0, None, "x"), (2, 1, " ", "y"), (3, 0, "system", "alone"), (None, None, "a b", "z"), (None, 1, "user", "z")]
    turns += [(9, i, ("u", "v")[i % 2], f"m{i}") for i in range(30)] + [(8, 4, "u", f"tie{i}") for i in range(25)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("x"))
    out = chat.rotate_perspectives(df, part_turns=8, tie_rows=10).collect()
    said = defaultdict(str)
    for r in sorted(out, key=lambda r: (r.part, r.slice)):
        said[(r.conv_id, r.speaker)] += r.text
        for m in r.mask:
            assert r.text[:m.start].endswith("<|im_start|>assistant\n") and r.text[m.start:m.end].endswith("<|im_end|>")
        assert len(r.mask) == r.text.count("<|im_start|>assistant\n")
    assert set(said) == {(1, "ann"), (1, "bob"), (2, "unknown"), (3, None), (None, "a_b"), (None, "user"), (9, "u"), (9, "v"), (8, "u")}
    assert said[(1, "bob")] == ("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=ann\nhi<|im_end|>\n<|im_start|>assistant\nyo < |im_end|><|im_end|>\n"
                                + "<|im_start|>user name=ann\n<|im_end|>\n" * 2)
    assert [x for x in said[(9, "v")].replace("<|im_end|>", "").split("\n") if x.startswith("m")] == [f"m{i}" for i in range(30)]
    assert sum(r.n_turns for r in out if r.conv_id == 8) == 25 and max(r.n_turns for r in out if r.conv_id == 9) == 8


def test_chat_many_rows_of_one_turn(spark):
    """Rows that share a turn number, or have none, stay in the order of turn, role and text, and slices of equal rows are bounded."""
    turns = [(1, t, "uv"[t % 2], f"m{t}") for t in range(6)] + [(1, 2, "u", f"tie{i:02d}") for i in range(30)] + [(1, 3, "v", "same")] * 50
    turns += [(1, None, "u", f"none{i}") for i in range(9)] + [(2, 4, "u", f"few{i}") for i in range(7)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    out = chat.rotate_perspectives(df, part_turns=4, tie_rows=3).collect()
    key = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])
    for conv, speaker in ((1, "u"), (1, "v"), (2, "u")):
        rows = sorted((r for r in out if (r.conv_id, r.speaker) == (conv, speaker)), key=lambda r: (r.part, r.slice))
        said = [x for x in "".join(r.text for r in rows).replace("<|im_end|>", "").split("\n") if x and not x.startswith("<|im_start|>")]
        assert said == [r[3] for r in sorted((t for t in turns if t[0] == conv), key=key)]
        assert max(r.n_turns for r in rows) <= 12 and all(r.slice == 0 for r in rows if conv == 2)
        for part in {r.part for r in rows}:
            own = [r for r in rows if r.part == part]
            assert [r.slice for r in own] == list(range(len(own))) and all(r.n_turns == 12 for r in own[:-1])


def test_chains_equal_the_quadratic_recurrence():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 40))
        pos, spos = sorted(rng.integers(0, 200, n).tolist()), rng.integers(0, 200, n).tolist()
        f = []
        for i in range(n):
            before = [f[j] - 0.05 * (pos[i] - pos[j] + spos[i] - spos[j]) for j in range(i) if pos[j] < pos[i] and spos[j] < spos[i]]
            f.append(6 + max([0.0, *before]))
        best = substring.chains(pos, spos, 6.0, 0.05, 1)[0]
        score = 6.0 * len(best) - 0.05 * (pos[best[-1]] - pos[best[0]] + spos[best[-1]] - spos[best[0]])
        assert abs(score - max(f)) < 1e-9


def test_edits_against_the_table_of_distances():
    rng = np.random.default_rng(31)
    for _ in range(400):
        a, b = (rng.integers(0, 4, int(rng.integers(0, 90))).astype(np.uint16) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a.tolist(), 1):
            new = [i]
            for j, y in enumerate(b.tolist(), 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert substring.edits(a, b) == row[-1]


def test_blocks_of_matches_end_with_their_documents():
    """Matches word by word are one block, of eight at most; the next pair of documents begins another one, wherever it goes on."""
    pos = np.r_[np.arange(20), np.arange(20, 23), [40, 42]]
    start, more = substring.blocks(pos, pos + 5, np.r_[True, np.zeros(19, bool), True, np.zeros(4, bool)])
    assert start.tolist() == [0, 8, 16, 20, 23, 24] and more.tolist() == [7, 7, 3, 2, 0, 0]
    chained = substring.chain_anchors(pos[start[:3]].tolist(), (pos[start[:3]] + 5).tolist(), more[:3].tolist(), 5, 0.05, 2)
    assert chained == [([0, 19], [5, 24])]
    assert substring.chain_anchors([3, 40], [1, 44], [0, 2], 5, 0.05, 1) == [([3, 40, 42], [1, 44, 46])]


def test_chains_without_hope_hold_no_passage():
    """Chains of few and many seeds, edited between them: one that isn't aligned would have had no passage; most chance ones aren't."""
    rng = np.random.default_rng(32)
    a_words, b_words, at, bt, anchors, chance = [], [], [], [], [], []
    for i in range(600):
        few = i % 2
        a, b, way = [rng.integers(0, 30, 64)], [rng.integers(0, 30, 64)], []
        for n in range(int(rng.integers(2, 4 if few else 12))):
            way += [sum(map(len, a)), sum(map(len, b))]
            seed = rng.integers(0, 30, 5)
            gap = rng.integers(0, 30, int(rng.integers(0, 9)))
            other = gap.copy()
            other[rng.random(len(gap)) < (0.9 if few else 0.2)] = 77
            a += [seed, gap]
            b += [seed, other[:len(gap) - int(rng.integers(0, 2))] if len(gap) else other]
        if i % 4 == 0:  # what lies around agrees in part
            same = rng.random(64) < 0.7
            b[0] = np.where(same, a[0], b[0])
        a.append(rng.integers(0, 30, 64))
        b.append(np.where(rng.random(64) < 0.8, a[-1], 78) if i % 8 < 2 else rng.integers(0, 30, 64))
        way = np.array(way)
        a_words.append(np.concatenate(a).astype("<u2"))
        b_words.append(np.concatenate(b).astype("<u2"))
        at.append(way[0]), bt.append(way[1]), chance.append(few and i % 4 == 3)
        anchors.append(way - np.tile(way[:2], len(way) // 2))
    args = ([w.tobytes() for w in a_words], [w.tobytes() for w in b_words], np.array(at), np.array(bt))
    hope = substring.hopeful(*args, np.concatenate(anchors), np.array([len(w) for w in anchors]), 5, 32 - 1e-6)
    found = np.array([bool(substring.align(*x, 5, 40, 0.8)) for x in zip(a_words, b_words, at, bt, anchors)])
    assert not (found & ~hope).any() and found.sum() > 50
    assert hope[np.array(chance, bool)].mean() < 0.3
    short = substring.hopeful(*([w[:20] for w in x] for x in args[:2]), *args[2:], np.concatenate(anchors), np.array([len(w) for w in anchors]), 5, 32)
    assert not short.any()  # seeds beyond the end


def test_passages(spark):
    rng = np.random.default_rng(6)
    words = lambda n: [f"q{x}" for x in rng.integers(0, 10**6, n)]
    passage, fuzzy = words(90), None
    fuzzy = [w if k % 15 else "other" for k, w in enumerate(passage)]
    doc = lambda *parts: " ".join(x for p in parts for x in p)
    whole = doc(words(200))
    rows = [(1, doc(words(50), passage, words(30))), (2, doc(words(300))), (3, doc(words(10), passage, words(80))), (4, doc(fuzzy, words(40))),
            (5, whole), (6, whole), (7, whole), (8, ""), (9, None), (None, whole), (10, doc(words(60), passage[:20], words(60))), (3, doc(words(5))),
            (11, doc(words(20), ["same"] * 120)), (12, doc(["same"] * 100, words(20))), (13, doc(words(20000)))]
    out = substring.repeated_passages(frame(spark, rows)).collect()
    got = {(r.doc_id, r.source_id): r for r in out}
    assert set(got) == {(3, 1), (4, 1), (6, 5), (7, 5), (12, 11)}
    r = got[(3, 1)]
    assert (r.start_word, r.end_word, r.source_start, r.source_end, r.similarity, r.whole_copy) == (10, 100, 50, 140, 1.0, False)
    assert got[(4, 1)].similarity >= 0.9 and got[(4, 1)].end_word - got[(4, 1)].start_word >= 80
    assert got[(7, 5)].whole_copy and got[(7, 5)].end_word == 200


def test_passages_around_unshared_text(spark):
    """Chains that bridge unshared text are cut: every shared passage is found by itself."""
    rng = np.random.default_rng(16)
    words = lambda n: [f"q{x}" for x in rng.integers(0, 10**6, n)]
    rows, want = [], {}
    for i, (size, gap) in enumerate([(60, 300), (100, 300), (100, 850), (200, 200), (45, 100)]):
        head, mid, tail = words(size), words(size), words(size)
        for doc, parts in ((2 * i, [head, words(gap), mid, words(gap), tail]), (2 * i + 1, [head, words(gap), mid, words(gap), tail])):
            rows.append((doc, " ".join(w for p in parts for w in p)))
        want[2 * i + 1] = [(k * (size + gap), k * (size + gap) + size) for k in range(3)]
    got = defaultdict(list)
    for r in substring.repeated_passages(frame(spark, rows)).collect():
        assert r.similarity == 1.0 and r.source_id == r.doc_id - 1 and (r.start_word, r.end_word) == (r.source_start, r.source_end)
        got[r.doc_id].append((r.start_word, r.end_word))
    assert {k: sorted(v) for k, v in got.items()} == want


def edited(rng, passage, edits, kinds):
    """The passage with that many words substituted, inserted or deleted at random places."""
    out, places = [], set((1 + rng.choice(len(passage) - 2, edits, replace=False)).tolist())
    for j, w in enumerate(passage):
        kind = rng.choice(kinds) if j in places else "keep"
        out += {"keep": [w], "sub": [f"x{rng.integers(10**6)}"], "ins": [f"x{rng.integers(10**6)}", w], "del": []}[kind]
    return out


@pytest.mark.parametrize("kinds", [["sub"], ["sub", "ins", "del"]])
def test_edited_passages(spark, kinds):
    """Recall of edited passages: at least 0.9 from 50 words at 0.9 and 100 words at 0.8 on, all of the exact ones."""
    rng = np.random.default_rng(17)
    words = lambda n: [f"q{x}" for x in rng.integers(0, 10**6, n)]
    rows, kind, size = [], {}, {}
    for n, edits in ((40, 0), (50, 5), (60, 6), (100, 10), (100, 20), (200, 40)):
        for _ in range(40):
            passage, i = words(n), len(rows)
            changed = edited(rng, passage, edits, kinds)
            rows.append((i, " ".join([*words(30), *passage, *words(30)])))
            rows.append((i + 1, " ".join([*words(20), *changed, *words(40)])))
            kind[i + 1], size[i + 1] = (n, edits), len(changed)
    covered = defaultdict(int)
    for r in substring.repeated_passages(frame(spark, rows)).collect():
        assert r.similarity >= 0.8 and r.source_id == r.doc_id - 1 and min(r.end_word - r.start_word, r.source_end - r.source_start) >= 40
        covered[r.doc_id] = max(covered[r.doc_id], min(r.end_word, 20 + size[r.doc_id]) - max(r.start_word, 20))
    found = defaultdict(list)
    for i, k in kind.items():
        found[k].append(covered[i] >= 0.7 * size[i])
    recall = {k: float(np.mean(v)) for k, v in found.items()}
    assert recall[(40, 0)] == 1.0 and min(recall.values()) >= 0.9, recall


@pytest.mark.parametrize("vocabulary", [10, 16, 60])
def test_passages_of_common_words(spark, vocabulary):
    """Nearly every seed has an earlier holder by chance; exact passages of late documents are found all the same."""
    rng = np.random.default_rng(vocabulary)
    words = lambda n: [f"v{x}" for x in rng.integers(0, vocabulary, n)]
    rows = [(i, " ".join(words(300))) for i in range(1000)]
    for k in range(60):
        passage = words(100)
        rows += [(1000 + 2 * k, " ".join([*words(100), *passage, *words(100)])), (1001 + 2 * k, " ".join([*words(50), *passage, *words(150)]))]
    got = {(r.doc_id, r.source_id) for r in substring.repeated_passages(frame(spark, rows)).collect() if r.end_word - r.start_word >= 95}
    assert sum((1001 + 2 * k, 1000 + 2 * k) in got for k in range(60)) == 60


def test_passages_of_a_document_in_between(spark):
    """The source is neither the first nor the nearest document that holds the seeds: those hold pieces, in another order."""
    rng = np.random.default_rng(31)
    words = lambda n: [f"q{x}" for x in rng.integers(0, 10**6, n)]
    rows = []
    for i in range(10):
        passage = words(60)
        pieces = lambda: " ".join(w for k in rng.permutation(12) for w in [*passage[5 * k:5 * k + 9], *words(40)])  # noqa: E731, B023
        rows += [(i, pieces()), (100 + i, " ".join([*words(100), *passage, *words(100)])), (200 + i, pieces()),
                 (300 + i, " ".join([*words(50), *passage, *words(50)]))]
    got = {(r.doc_id, r.source_id, r.start_word, r.end_word) for r in substring.repeated_passages(frame(spark, rows)).collect()}
    assert got == {(300 + i, 100 + i, 50, 110) for i in range(10)}


def test_links_against_all_pairs(spark):
    """Rows of few places are linked with all before them, in whatever batches they come; of many places the first and the
    nearest document, and all that share the words behind them."""
    rng = np.random.default_rng(32)
    rows = [(int(s) << 24 | int(f), int(d), i, int(x)) for i, (s, f, d, x) in enumerate(zip(
        rng.integers(-40, 40, 3000) ** 3 // 1000, rng.integers(0, 3, 3000), rng.integers(0, 400, 3000), rng.integers(0, 12, 3000)))]
    rows = sorted(set(rows))
    held, tail = defaultdict(list), defaultdict(list)
    for h, doc, pos, far in rows:
        held[h >> 24].append((doc, pos))
        held["h", h].append((doc, pos))
        tail[h, far].append((doc, pos))
    want, seen = set(), set()
    for h, doc, pos, far in rows:
        name = h >> 24 if len(held[h >> 24]) <= 8 else ("h", h)
        group = sorted(held[name])
        if len(group) <= 8:
            want |= {(doc, d, pos, p) for d, p in group if d < doc}
            continue
        for g in (group, sorted(tail[h, far])):
            before = [x for x in g if x[0] < doc]
            if len(g) <= 8:
                want |= {(doc, d, pos, p) for d, p in before}
            elif before:
                want |= {(doc, *x) for x in [(before[0][0], pos, before[0][1]), (before[-1][0], pos, min(p for d, p in g if d == before[-1][0]))]}
    frame_ = spark.createDataFrame(rows, "h long, doc_id long, pos int, far int")
    for batch in (7, 10000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            seen = {tuple(r) for r in substring.earlier_holders(frame_, 8).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert seen == want


def test_longest_holders_against_all_pairs():
    """The place in a smaller doc_id that shares the most of what follows, for each seed of a name that has one."""
    rng = np.random.default_rng(41)
    for _ in range(60):
        rows = sorted((rng.integers(0, 3, int(rng.integers(0, 6))).astype(">u2").tobytes(), int(d), i) for i, d in enumerate(rng.integers(0, 12, 40)))
        group = substring.Longest()
        for follows, doc, pos in rows:
            group.add(doc, pos, follows)
        group.close()
        at = {pos: (follows, doc) for follows, doc, pos in rows}
        best = {pos: max((substring._shared_blocks(f, g) for g, d, _ in rows if d < doc), default=None) for pos, (f, doc) in at.items()}
        links = [x for x in group.out if x[0] != x[1]]
        assert sorted(x[2] for x in group.out) == list(range(40))
        got = {pos: reach for _, _, pos, _, reach in links}
        assert got == {p: substring.FAR + substring.block_start(n) for p, n in best.items() if n is not None} and len(links) == len(got)
        for doc, src, pos, spos, reach in links:
            assert at[pos][1] == doc > src == at[spos][1]
            assert substring._shared_blocks(at[pos][0], at[spos][0]) >= (reach - substring.FAR) // substring.STEP
    assert [substring.block_start(n) for n in (0, 1, 255, 256, 257, 512, 513)] == [0, 8, 2040, 2048, 2064, 6144, 6176]


def test_common_texts_of_equal_ends(spark):
    """A passage that more documents hold than are linked, at the end of the texts, in a row for each; nothing is beyond a text."""
    rng = np.random.default_rng(47)
    words = lambda n: [f"q{x}" for x in rng.integers(0, 10**6, n)]
    passage = words(70)
    docs = [[*words(10 + i % 7), *passage] for i in range(80)]
    got = {r.doc_id: r for r in substring.repeated_passages(frame(spark, [(i, " ".join(d)) for i, d in enumerate(docs)])).collect()}
    assert sorted(got) == list(range(1, 80))
    for i, r in got.items():
        assert (r.start_word, r.end_word, r.similarity) == (10 + i % 7, len(docs[i]), 1.0) and r.source_end == len(docs[r.source_id])


def test_passages_of_common_parts(spark):
    """Documents put together from a few parts that all of them hold: every exact run of 60 words that an earlier document
    shares lies in a row, to 16 words, though all its seeds, and 30 words from each, have more places than are linked."""
    rng = np.random.default_rng(43)
    words = lambda n: [f"q{x}" for x in rng.integers(0, 10**6, n)]
    stock = [words(int(n)) for n in rng.integers(45, 90, 5)]
    docs = []
    for _ in range(500):
        runs = [[w for s in rng.integers(0, 5, int(rng.integers(2, 7))) for w in stock[s]] for _ in range(2)]
        docs.append([*words(20), *runs[0], *words(25), *runs[1], *words(15)])
    found = defaultdict(list)
    for r in substring.repeated_passages(frame(spark, [(i, " ".join(d)) for i, d in enumerate(docs)])).collect():
        found[r.doc_id].append((r.start_word, r.end_word))
        if r.similarity == 1.0:
            assert docs[r.doc_id][r.start_word:r.end_word] == docs[r.source_id][r.source_start:r.source_end]
    names, missed, runs = {}, 0, 0
    power = np.cumprod(np.r_[np.uint64(1), np.full(2000, 0x9E3779B97F4A7C15, np.uint64)])
    seen = {n: set() for n in range(60, 500, 10)}
    for i, d in enumerate(docs):  # by brute force: all runs of 60, 70, ... words that a document before holds
        x = np.array([names.setdefault(w, int(rng.integers(1, 1 << 63))) for w in d], np.uint64)
        total = np.cumsum(np.r_[np.uint64(0), x * power[:len(x)]])
        longest: dict[int, int] = {}
        for n in (n for n in seen if n <= len(d)):
            grams = ((total[n:] - total[:-n]) * power[len(d) - np.arange(len(d) - n + 1)]).tolist()
            longest |= {k: n for k, g in enumerate(grams) if g in seen[n]}
            seen[n].update(grams)
        runs += len(longest)
        missed += sum(not any(a <= k + 16 and b >= k + n - 16 for a, b in found[i]) for k, n in longest.items())
    assert runs > 10_000 and missed == 0, (missed, runs)


def test_passages_against_all_pairs(spark):
    """Exact shared runs of 50 words and more between any two documents of a small table: each is named, or lies in a
    passage that is, whose source in turn names where it is from; a common seed has many places."""
    rng = np.random.default_rng(23)
    words = lambda n: [f"q{x}" for x in rng.integers(0, 400, n)]
    stock = [words(60) for _ in range(6)]
    docs = []
    for i in range(140):
        parts = [words(int(rng.integers(20, 60)))]
        for s in rng.choice(6, int(rng.integers(0, 3)), replace=False).tolist() + ([0] if i % 3 == 0 else []):
            parts += [stock[s], words(int(rng.integers(20, 60)))]
        docs.append([w for p in parts for w in p])
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    spans = defaultdict(list)
    for r in substring.repeated_passages(frame(spark, rows)).collect():
        spans[r.doc_id].append((r.start_word, r.end_word, r.source_id))
        assert r.source_id < r.doc_id
    for i, d in enumerate(docs):  # by brute force: runs of 50 words that an earlier document holds
        earlier = {tuple(e[k:k + 50]) for e in docs[:i] for k in range(len(e) - 49)}
        for k in range(len(d) - 49):
            if tuple(d[k:k + 50]) in earlier:
                assert any(min(b, k + 50) - max(a, k) >= 48 for a, b, _ in spans[i]), (i, k)  # a word beside it may agree by chance
    assert sum(map(len, spans.values())) < 3 * len(docs)


def test_toxicity(spark):
    rng = np.random.default_rng(8)
    vocab = [f"".join(chr(97 + int(c)) for c in rng.integers(0, 26, 6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        toxic = int(i % 5 == 0)
        rows.append((i, " ".join([*rng.choice(vocab, 40), *(["Vile!", "scum"] if toxic else ["fine"])])))
        labels.append((i, 1, toxic))
    rows += [(2000, None), (2001, ""), (None, "vile scum"), (5, rows[5][1])]
    table = spark.createDataFrame([*labels, (None, 1, 1), (3000, 0, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity_scores(frame(spark, rows), table).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 900]
    assert np.mean([r.predicted == int(r.doc_id % 5 == 0) for r in held]) > 0.97
    assert all(r.predicted == 0 for r in out if r.doc_id in (2000, 2001))
    kept = toxicity.drop_toxic(frame(spark, rows), table)
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")] and kept.count() == sum(r.predicted == 0 for r in out)
    none = toxicity.toxicity_scores(frame(spark, rows), table.where("false")).collect()
    assert {r.predicted for r in none} == {0}


def test_toxicity_told_by_a_pair_only(spark):
    """One of two words but not both: neither word alone tells the label, the fitted machine does, on held-out rows."""
    rng = np.random.default_rng(5)
    vocab = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, 6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(3000):
        a, b = rng.random(2) < 0.5
        rows.append((i, " ".join([*rng.choice(vocab, 40), *["insult"] * int(a), *["folk"] * int(b)])))
        labels.append((i, 1, int(a != b)))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(frame(spark, rows), table)
    assert {toxicity.hashed("insult"), toxicity.hashed("folk")} <= set(model.terms) and len(model.terms) < 50
    held = [r for r in toxicity.toxicity_scores(frame(spark, rows), table).collect() if r.held_out]
    assert len(held) > 500 and np.mean([r.predicted == labels[r.doc_id][2] for r in held]) > 0.85


def test_factorization_machine_learns_pairs():
    """The score has the pair term of its definition."""
    m = toxicity.Model([toxicity.hashed(w) for w in ("insult", "group")], -2.0, np.zeros(2), np.array([[1.0, 1.0], [2.0, 2.0]]))
    s = toxicity.Scorer(m)
    assert s.score("an insult") < 0.5 and s.score("the group") < 0.5 and s.score("insult, GROUP") > 0.85


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert simhash.simhash_components(docs).count() == 0
    assert simhash.drop_near_copies(docs).count() == 0
    assert fingerprint.document_fingerprints(docs).count() == 0
    assert toxicity.toxicity_scores(docs, labels).count() == 0
    assert bpe.encode_documents(docs, path, public_tokenizers.PATTERN).count() == 0
    assert lines.drop_repeated_lines(docs).count() == 0
    assert mix.mix_sources(docs, {"a": 1}, 1).count() == 0
    assert substring.repeated_passages(docs).count() == 0
    out = new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), out)
    assert warc.read_warc(spark, out).count() == 0
    assert ann.nearest_neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert chat.rotate_perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_exact_dedup(spark, texts, tmp_path):
    """Against brute force, with hashes of three bits (collisions), tiny buckets (splits, overflow chains) and clashing columns."""
    rows = [*texts, *[(500 + i, "copy of a text " * 20) for i in range(300)], (None, "one"), (None, None), (None, "only null"), (0, texts[0][1])]
    by_text = defaultdict(list)
    for i, t in rows:
        by_text[t or ""].append(i)
    want = Counter()
    for t, ids in by_text.items():
        keep = max((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    df = frame(spark, rows).withColumnsRenamed({"key": "h", "score": "entry"}).repartition(40)
    for size, bits, held in ((exact.BUCKET_BYTES, 63, exact.HELD_BYTES), (500, 63, 300), (500, 3, 1), (1, 1, 1)):
        got = exact.exact_dedup(df, bucket_bytes=size, key_bits=bits, held_bytes=held).collect()
        assert Counter(map(tuple, got)) == want
    assert exact.exact_dedup(df.limit(0)).count() == 0


def test_exact_dedup_passes_small_batches(spark, monkeypatch):
    """Batches of whole texts are bounded by bytes, not by 10,000 rows alone; the session's setting comes back."""
    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(key)
    make = exact.index_entries

    def weighed(docs, *args):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"n_bytes": [b.nbytes]})

        seen.extend(r.n_bytes for r in docs.select("text").mapInArrow(run, "n_bytes long").collect())
        return make(docs, *args)

    monkeypatch.setattr(exact, "index_entries", weighed)
    rows = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.concat("id", F.expr("repeat(' text', 1000)")).alias("text"))
    assert exact.exact_dedup(rows).count() == 3000
    assert len(seen) > 1 and max(seen) < 6 << 20 and sum(seen) > 14 << 20
    assert spark.conf.get(key) == before


def test_owners_follow_shared_texts(spark):
    """Texts that no other text meets add no owners (so no files, each with processes that the executor starts for it)."""
    rows = [(i, f"text {i} " * 20) for i in range(2000)] + [(5000 + i, f"copy {i % 40}") for i in range(80)]
    entries = exact.index_entries(frame(spark, rows), held_bytes=1).cache()
    classes = exact.exact_classes(entries, 4000)
    assert len(classes.inputFiles()) == 1
    named = {r.entry: r["class"] for r in classes.collect()}
    held = defaultdict(set)
    for r in entries.collect():
        held[bytes(r.text)].add(named.get(r.entry, r.entry))
    assert len(held) == 2040 and all(len(c) == 1 for c in held.values()) and len(set.union(*held.values())) == 2040
    entries.unpersist()


def test_directory(spark):
    """Buckets cover every key once; overfull ones are split, but for those of a single key."""
    rng = np.random.default_rng(2)
    keys = [(int(h), 10) for h in rng.integers(0, 1 << 63, 2000)] + [(5, 400), (6, 10), (7, 10)]
    weights = spark.createDataFrame(keys, "h long, bytes long")
    found = [tuple(r) for r in exact.build_directory(weights, 100)[0].collect()]
    held = {b: [w for h, w in keys if h >> (63 - b[1]) == b[0] >> (63 - b[1])] for b in found}
    assert sum(map(len, held.values())) == len(keys)
    assert all(len(w) == b[2] and sum(w) == b[3] and (b[3] <= 100 or b[2] == 1) for b, w in held.items())
    assert exact.build_directory(weights.limit(0), 100)[0].count() == 0


def brute_merkle(rows):
    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def leaf(r, text):
        return h(*[field(x) for x in (r[0], r[3], r[2], r[4], text)])

    def climb(nodes):
        """Digest of the tree, and of each node the siblings by level, as (left, right)."""
        path, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, i in enumerate(at):
                run = nodes[i // 8 * 8:i // 8 * 8 + 8]
                path[k].append((run[:i % 8], run[i % 8 + 1:]))
            at = [i // 8 for i in at]
            nodes = [h(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
        return nodes[0], path

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        own = sorted(((r, leaf(r, r[1])) for r in rows if r[2] == lang), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees.append((own, *climb([x for _, x in own])))
    root, top = climb([t[1] for t in trees])
    for (own, sub, paths), up in zip(trees, top, strict=True):
        for (r, x), path in zip(own, paths, strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            f = leaf(r, r[1].translate(lower) if hit and r[1] is not None else r[1])
            for left, right in path + up:
                f = h(*left, f, *right)
            yield (r[0], x, sub, root, h(*[y for a, b in path + up for y in a + b]), f, f == root)


def test_merkle(spark, texts):
    """Ten and more languages (two top levels), null fields, repeated rows, one leaf, 600 leaves of one language."""
    rows = [(i, t, [None, "de", "é", "Z", *"abcdefgh"][n % 12], f"s{n % 3}" if n % 4 else None, n if n % 5 else None)
            for n, (i, t) in enumerate(texts * 3)]
    rows += [(2000 + i, f"Text {i}", "en", "src", i) for i in range(600)] + [(None, "X", "en", None, None), (None, "A", None, None, 3)]
    rows += [(7, "Alone", "one", "s", 5), *rows[:3]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, hash long, idx string, tree long"
    frame_of = lambda rs: spark.createDataFrame([(*r, 1, "x", 2) for r in rs], schema).repartition(5)
    for part in (rows, [r for r in rows if r[2] == "en"], rows[:1], [(3, "A b", "en", None, None)]):
        got = merkle.merkle_manifest(frame_of(part)).collect()
        assert Counter(map(tuple, got)) == Counter(brute_merkle(part))
    assert merkle.merkle_manifest(frame_of(rows).limit(0)).count() == 0


def brute_spelling(rows, delete=True):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[:h % len(w)] + w[h % len(w) + 1:] if delete and h % 97 == 0 else w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    form, count = {}, {}
    for w in n:
        met = [v for v in n if near(w, v)]
        count[w] = len(met)
        best = min(met, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return Counter((w, form[w], root(w), c, count[w], n.get(form[w])) for w, c in n.items())


def test_spelling(spark, texts):
    """Random words over a few letters (many near words, chains of forms), accents, long runs; blocks cut into tiles."""
    rng = np.random.default_rng(4)
    letters = np.array(list("abcgÀàéÉx"))
    words = ["".join(rng.choice(letters, rng.integers(4, 8), p=[.3, .2, .1, .1, .05, .05, .05, .05, .1])) for _ in range(900)]
    rows = [(i, " ".join(rng.choice(words, 300, p=np.arange(1, 901) / 405450)) + f" 1{words[i].upper()}-{'ab' * 3000}ü") for i in range(60)]
    rows += [(i, "ab" * 3000 + x) for i in range(70, 76) for x in ("Ü", "ü", "", "a")] + [*texts, (None, "Straße Straße straße Strasse"), (61, None)]
    rows += [(2, "w" * 30 + " grey gray greyer grayer " * 4)] * 3
    want = brute_spelling(rows)
    assert len(want) > 500 and any(r[2] not in (r[0], r[1]) for r in want) and max(r[4] for r in want) > 8
    for tile in (spelling.TILE_WORDS, 3):
        got = spelling.spelling_variants(frame(spark, rows), tile_words=tile).collect()
        assert Counter(map(tuple, got)) == want
    assert spelling.spelling_variants(frame(spark, [(1, None), (2, "")])).count() == 0
    assert spelling.spelling_variants(frame(spark, rows).limit(0)).count() == 0


def test_chat_slices_are_bounded_in_bytes(spark):
    """Long turns: slices hold no more than their bytes and one turn; their texts one after another are the whole."""
    rows = [(1, i, "ann" if i % 2 else "bob", f"{i}:" + "x" * (i % 7) * 100) for i in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    whole = {(r.speaker, r.part): r.text for r in chat.rotate_perspectives(df).collect()}
    cut = chat.rotate_perspectives(df, slice_bytes=2000).collect()
    assert len(whole) == 2 and len(cut) > 20 and all(len(r.text) < 2000 + 700 for r in cut)
    for key, text in whole.items():
        assert "".join(r.text for r in sorted(cut, key=lambda r: r.slice) if (r.speaker, r.part) == key) == text
