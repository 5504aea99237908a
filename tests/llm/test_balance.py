"""Buckets of the suffix sort's first digit stay even."""

import numpy as np

from rarespark.llm.store import bounds
from rarespark.llm.substring import Runs


def test_anchors_spread_over_buckets():
    rng = np.random.RandomState(3)
    words = ["".join(chr(97 + c) for c in rng.randint(0, 26, rng.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words, 400)).encode() for _ in range(300)]
    offs = np.r_[0, np.cumsum([len(t) for t in texts])]
    anchors = Runs(np.frombuffer(b"".join(texts), np.uint8), offs, 200, 64).gram
    for buckets in (8, 64):
        n = np.bincount(np.searchsorted(bounds(buckets), anchors, "right"), minlength=buckets)
        assert n.max() < 2 * n.mean()
