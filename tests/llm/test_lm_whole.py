"""Every word of the corpus is a training target."""

import numpy as np
import pyarrow as pa

from keylattice.llm import lm_score, textkit as tk


def test_every_word_is_a_target_once(prose):
    w = tk.words(pa.array([*(prose(i, 300) for i in range(20)), prose(1, 300), "", None, "one"]))
    h, at, n = np.unique(tk.signed(w.hashes), return_index=True, return_counts=True)
    form = lm_score.forms(w)[at]
    vocab = lm_score.vocabulary(h, form, n, np.bincount(form, n, minlength=lm_score.FORMS))
    k, _, _, around = lm_score.contexts(w, vocab)
    seen = np.zeros(len(k), int)
    for turn in range(lm_score.ROUNDS):
        seen[lm_score.masked(w, around, turn)] += 1
    assert len(seen) and (seen == 1).all()
