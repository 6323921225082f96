import numpy as np
import pyarrow as pa

import corpus_pipeline
from keylattice.llm import bpe, packing, quality, simhash


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "packing"]


def test_pipeline_against_brute_force(spark, frame, prose, tmp_path):
    """Every stage with production parameters, on documents with awkward extra columns, a long text and null, empty and repeated rows."""
    secret = ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" '
    item = prose(900, 30)
    own = lambda i, n=120: prose(i, n)
    rows = [(i, own(i)) for i in range(100)]
    rows += [(100 + i, " ".join(w + "%%%" for w in own(i + 150, 100).split())) for i in range(10)]
    rows += [(200 + i, own(i)) for i in range(5)] + [(210, own(6, 118) + " zeta theta")]
    rows += [(300, own(170, 60) + " " + item + " " + own(171, 60)), (301, own(172, 90) + secret + own(173, 40)), (302, ""), (303, None), (None, own(174)), (5, own(5)), (7, own(175)), (304, own(176, 300_000))]
    docs = frame(rows)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(80)] + [(100 + i, 0, 0) for i in range(5)], "doc_id bigint, quality int, toxic int")
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")

    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, sf)
        assert out.columns == docs.columns, name
        seen = spark.createDataFrame(out.collect(), docs.schema)
    left = {(r["doc_id"], r["text"]) for r in seen.collect()}
    kept = {r["doc_id"] for r in quality.score(docs, labels).where("keep").collect()}
    assert not kept & set(range(100, 110)) and {300, 301, 302, 303, 304} <= kept and len(kept & set(range(100))) >= 95
    # brute force over what the quality rule kept: fingerprints of all pairs, windows of the item, the secret's own text
    texts = sorted({(d, t) for d, t in rows if d in kept and d is not None and t}, key=lambda x: (x[0], x[1]))
    a, b, _ = simhash.fingerprints(pa.array([t for _, t in texts]))
    prints = [(int(x), int(y)) for x, y in zip(a, b)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i][0] ^ prints[j][0]).bit_count() + (prints[i][1] ^ prints[j][1]).bit_count() <= simhash.DISTANCE:
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    want = {texts[i] for i in range(len(texts)) if root[i] == i}
    want = {(d, t.replace("24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "[STRONG]")) for d, t in want if item not in t}
    want |= {(d, t) for d, t in rows if (d is None or not t) and d in kept}
    assert left == want
    assert {(200, own(0)), (5, own(5))} & left == {(5, own(5))} and seen.where("doc_id = 5").count() == 1

    encode = bpe.encoding(bpe.DEFAULT_VOCABULARY)
    got = {}
    for r in sorted(corpus_pipeline.run(spark, sf).collect(), key=lambda r: r["piece"]):
        got.setdefault((r["doc_id"], r["piece"], r["start"]), []).append(r["tokens"])
    whole = {}
    for d, t in left:
        ids, start = encode.encode_ordinary(t or ""), 0
        _, piece, at, n = packing.decompose(np.array([len(ids)]))
        for p, start, size in zip(piece.tolist(), at.tolist(), n.tolist()):
            whole.setdefault((d, p, start), []).append(ids[start : start + size])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in whole.items()}


def test_stages_take_empty_documents(spark, frame, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
