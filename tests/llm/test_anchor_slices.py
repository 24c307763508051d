import numpy as np

from octarine.llm import suffix_dedup


def test_anchors_at_the_end_of_the_last_slice(monkeypatch):
    r = np.random.default_rng(3)
    for n in range(128 + 16, 128 + 60):
        raw, starts, ends = r.integers(97, 101, n).astype(np.uint8), np.array([0]), np.array([n])
        monkeypatch.setattr(suffix_dedup, "SLICE", 1 << 19)
        whole = suffix_dedup.anchors(raw, ends, starts)
        monkeypatch.setattr(suffix_dedup, "SLICE", 64)
        sliced = suffix_dedup.anchors(raw, ends, starts)
        assert all(np.array_equal(a, b) for a, b in zip(whole, sliced, strict=True))
