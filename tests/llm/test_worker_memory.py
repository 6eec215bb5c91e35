"""What a Python worker holds is bounded, whatever the texts."""

from __future__ import annotations

import tracemalloc

import numpy as np

from shoplens.llm import minhash, toxicity


def test_remembered_words_are_bounded():
    toxic, ordinary = ["awful", "nasty"], ["good", "fine"]
    windows = toxicity.Windows(toxic, ordinary)
    texts = [" ".join(f"w{i}x{j}" for j in range(1000)) for i in range(250)]
    most, cells = 0, []
    for t in texts:
        cells.append(windows.of(t))
        most = max(most, len(windows.cells), len(windows.bare))
    assert most <= 120_000
    for i in (0, 99, 100, 249):  # what was forgotten is found again
        assert (toxicity.Windows(toxic, ordinary).of(texts[i]) == cells[i]).all()


def test_a_block_holds_its_words_as_numbers():
    rng = np.random.default_rng(3)
    sequences = [rng.integers(0, 2**63, 10_000, dtype=np.uint64) for _ in range(150)]  # 12 MB
    sequences.append(sequences[0].copy())
    tracemalloc.start()
    links = minhash.links_within(sequences, list(range(151)), lambda i, others: np.ones(len(others), bool), 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(map(sorted, links)) == [[0, 150]]
    assert peak < 20_000_000
