"""The compressibility of a whole text."""

import random
import zlib

import pytest

from gleaner.llm import quality


def test_compressibility_reads_the_whole_text():
    rng = random.Random(5)
    prose = " ".join("".join(rng.choices("abcdefghijklmnopqrst", k=rng.randrange(2, 9))) for _ in range(220_000))
    assert len(prose) > quality.PART
    for text in ("a b", prose[:5000], prose + " junk" * 500_000, "junk " * 500_000 + prose):
        assert quality.features(text)[16] == pytest.approx(len(zlib.compress(text.encode(), 1)) / len(text), rel=1e-3)
