"""Windows and items that repeat a shingle lie outside the fingerprints' radius, and are found all the same."""

import numpy as np

from quadframe.llm import decontaminate as d
from quadframe.llm.hashing import run_hashes, word_hashes
from tests.llm.test_whole_job import prose


def test_repeated_shingles():
    for seed in range(12):
        common = prose(seed, 204)
        for item, text in ((["alpha"] * 24, ["beta"] * 24), (["alpha"] * 24, prose(99, 24).split()), (prose(98, 24).split(), ["beta"] * 24)):
            index = d.Index([(1, " ".join([common, *item]))], d.SHINGLE, d.THRESHOLD, d.RADIUS)
            shingles = run_hashes(word_hashes(d.split_words(" ".join([common, *text]))), d.SHINGLE)
            found = index.search(shingles, index.hits(shingles, d.SHINGLE), 228, d.SHINGLE)
            assert np.isclose(found[228, 0][0], 200 / 248)


def test_many_items_of_one_length():
    """The index of 100,000 items of one length takes bounded memory, and finds exact and edited ones."""
    import tracemalloc

    import numpy as np

    from quadframe.llm import decontaminate as D
    from quadframe.llm.hashing import run_hashes, word_hashes

    rng, n = np.random.default_rng(3), 100_000
    made = [" ".join(f"w{x}" for x in row) for row in rng.integers(0, 10**7, (n, 12)).tolist()]
    index = D.Index(list(enumerate(made)), D.SHINGLE, D.THRESHOLD, D.RADIUS)
    text = " ".join([*made[77].split(), "a b c", *made[99_999].split()])
    words = D.split_words(text)
    shingles = run_hashes(word_hashes(words), 5)
    tracemalloc.start()
    found = index.search(shingles, index.hits(shingles, 5), len(words), 5)
    assert {index.items[m][k][0] for m, k in found} == {77, 99_999} and {s for s, _, _ in found.values()} == {1.0}
    prints = D.to_blocks(np.stack([D.signs(s).sum(axis=0) for _, s in index.items[12][:40]]))
    got = set(index.within(prints, 12))
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    every = D.to_blocks(np.stack([D.signs(s).sum(axis=0) for _, s in index.items[12]]))
    apart = np.bitwise_count(prints.view("<u8").ravel()[:, None] ^ every.view("<u8").ravel()[None, :])
    assert got == {(int(w), int(i)) for w, i in zip(*np.nonzero(apart <= D.RADIUS))}
