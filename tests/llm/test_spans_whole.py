"""Edges under one anchor that agree in 31 bits are told apart."""

import numpy as np
import pyarrow as pa

from keylattice.llm import debruijn, textkit as tk


def test_edges_equal_in_31_bits_are_no_repeat(frame, prose, monkeypatch):
    """Documents that share only a banner of 20 words, with edges cut so that their first 31 bits agree."""
    banner = prose(1, 20)
    docs = frame([(i, f"{prose(10 + i, 60)} {banner} {prose(100 + i, 60)}") for i in range(6)])
    shingles = tk.shingles

    def run(docs):
        # workers import the module anew, so the collisions are made in this process
        rows = docs.select("doc_id", "text").collect()
        texts = pa.array([r["text"] for r in rows])
        monkeypatch.setattr(debruijn, "shingles", lambda w, n: (lambda h, s: ((h >> tk.U64(31)) | (tk.U64(5) << tk.U64(33)), s) if n == debruijn.K else (h, s))(*shingles(w, n)))
        text, start, anchor, content, off, edges = debruijn.runs_of_edges(texts, bits=debruijn.EDGE_BITS)
        return [(a, e) for a, i, z in zip(anchor, off, off[1:]) for e in edges[i + 1 : z - 1]], edges

    pairs, edges = run(docs)
    assert len(set(pairs)) == len(pairs) and edges.dtype == np.int64
    assert debruijn._RUNS.endswith("edges array<bigint>")
    monkeypatch.undo()
    assert debruijn.repeated_spans(docs).count() == 0
