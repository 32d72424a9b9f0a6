"""The pipeline's stages on sf0.001, each against brute force on its own input."""

from collections import Counter

import pyarrow.parquet as pq

import corpus_pipeline
from flowlens.llm import queries, simhash, toxicity
from flowlens.llm.common import read_table, written
from test_operators import _kept

SF001 = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read_table(spark, SF001, "documents")
    columns, tables = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = written(stage(spark, docs, SF001), name)
        tables[name] = (before, docs.collect())
        assert docs.columns == columns or name == "byte_bpe"
    before, after = tables["toxicity"]
    model = toxicity.Scorer(toxicity.train(read_table(spark, SF001, "documents"), read_table(spark, SF001, "labels")))
    assert Counter(tuple(r) for r in after) == Counter(r for r in before if model.score(r[1] or "") < 0.5)
    before, after = tables["line_dedup"]
    want = Counter(k[:2] for k in _kept([r[:2] for r in before]).elements())
    assert Counter((r.doc_id, r.text) for r in after) == want and all(r.n_chars == len(r.text) for r in after)
    before, after = tables["simhash_near_dedup"]
    fp = {r[0]: simhash.fingerprint((r[1] or "").encode(), 4) for r in before}
    near = {i: {j for j in fp if (fp[i] ^ fp[j]).bit_count() <= 4} for i in fp}
    low = {i: i for i in fp}
    for _ in fp:
        low = {i: min(low[j] for j in near[i]) for i in fp}
    assert {r.doc_id for r in after} == {i for i in fp if low[i] == i}
    before, after = tables["mix_sources"]
    assert Counter(map(tuple, after)) == Counter(before)
    assert {r.doc_id for r in tables["byte_bpe"][1]} == {r.doc_id for r in after}
    assert pq.read_table(f"{SF001}/documents.parquet").num_rows > len(after) > 0


def test_mix_reaches_the_end(spark):
    """The rows of run() put in order by slot and position are the mix: sources within a block of their target shares."""
    out = corpus_pipeline.run(spark, SF001).select("doc_id", "slot", "pos").collect()
    source = {r.doc_id: r.source for r in read_table(spark, SF001, "documents").select("doc_id", "source").collect()}
    order = sorted(out, key=lambda r: (r.slot, r.pos))
    assert len({(r.slot, r.pos) for r in out}) == len(out) == len({r.doc_id for r in out}) > 0
    shares = {**queries.SHARES, None: queries.OTHER_SHARE}
    cls = lambda i: source[i] if source[i] in queries.SHARES else None
    held, last = {}, {}
    for r in order:
        held.setdefault(r.slot, []).append(r)
        last[cls(r.doc_id)] = r.slot
    assert all(len({cls(r.doc_id) for r in rows}) == 1 and [r.pos for r in rows] == list(range(len(rows))) for rows in held.values())
    blocks = Counter()
    for slot, rows in sorted(held.items()):
        blocks[cls(rows[0].doc_id)] += 1
        for c, n in shares.items():
            if slot <= last.get(c, -1):
                assert abs(blocks[c] - (slot + 1) * n / sum(shares.values())) < 1
    docs = read_table(spark, SF001, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF001), f"again_{name}")
    files = sorted(docs.select("doc_id", "_metadata.file_path", "_metadata.row_index").collect(), key=lambda r: (r.file_path, r.row_index))
    assert [r.doc_id for r in files] == [r.doc_id for r in order]
