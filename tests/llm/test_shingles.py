import random

import numpy as np

from medcorpus.llm.shingles import find_words, lowered, word_hashes


def test_word_hashes_tell_words_apart():
    rng = random.Random(6)
    parts = ["a", "b", "ab", "ba", "É", "A", " ", "\n", "\t", "  ", "\x0b", "\x85", " ", "aaaa", "x" * 300]
    seen = {}
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 14)))
        for lower in (False, True):
            words = find_words(lowered(text) if lower else text)
            hashes = word_hashes(text, lower).tolist()
            assert len(words) == len(hashes)
            for w, h in zip(words, hashes, strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen) > 500
    assert word_hashes("").dtype == np.uint64
