"""Parts of the training-data operators that need no session, against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from gleaner.llm import bpe, chunk_dedup, html_text, ngram_join, quality, sharding
from gleaner.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def hard_texts():
    rng = random.Random(1)
    pick = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    merges = bpe.load_merges(tokenizer_path())[0]
    words = [b.decode() for b in merges.bytes_of.values() if b.isascii() and b.isalpha()]
    yield from ["", "a", " ", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "<|endoft", "x" * 9000 + "<|endoftext|>" + "y" * 9000, "!" * 9000 + "'s ok", " " * 9000 + "x", "ab" * 20000, "՘" * 5000]
    yield from (pick(rng.randrange(1, 60), " \n\t'srevmabc1é²\x1c\u0085　՘<|>endoftx") for _ in range(300))
    yield from ("".join(rng.choices(words, k=3000)) for _ in range(6))


@pytest.mark.parametrize("block", [1 << 16, 97])
def test_stream_is_the_library(library, block, monkeypatch):
    import hashlib

    monkeypatch.setattr(bpe, "BLOCK", block)
    texts = list(hard_texts())
    for text, got in zip(texts, bpe.digests(tokenizer_path(), texts), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        assert got == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()), text[:80]


def test_a_long_piece_keeps_a_bounded_window():
    merges = bpe.load_merges(tokenizer_path())[0]
    stream, held = bpe.PieceStream(merges), 0
    for _ in range(300):
        stream.feed(b"abcdefgh" * 30)
        held = max(held, len(stream.held))
    assert held < 5 * merges.lookahead


def links_by_hand(sets, num, den):
    return {(i, j) for i in range(len(sets)) for j in range(i) if den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])}


def families(rng, n):
    out = []
    for _ in range(n):
        base = [rng.randrange(1 << 60) for _ in range(rng.randrange(1, 80))]
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            for _ in range(rng.randrange(0, 9)):
                copy[rng.randrange(len(copy))] = rng.randrange(1 << 60)
            out.append(frozenset(copy[: rng.randrange(max(1, len(copy) - 3), len(copy) + 1)]))
    return out


@pytest.mark.parametrize("num,den", [(9, 10), (8, 10)])
def test_every_link_shares_an_index_list_and_is_found(num, den):
    sets = families(random.Random(num), 60)
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    lists = [set(ngram_join.signatures(a, num, den).tolist()) for a in arrays]
    expected = links_by_hand(sets, num, den)
    assert expected and all(lists[i] & lists[j] for i, j in expected)
    degree = Counter(x for p in expected for x in p)
    root, count = ngram_join.links(arrays, np.ones(len(sets), np.int64), None, num, den)
    assert count.tolist() == [degree[i] for i in range(len(sets))]
    assert all(root[i] == root[j] for i, j in expected)
    side = np.arange(len(sets)) % 2
    across = Counter(x for i, j in expected if side[i] != side[j] for x in (i, j))
    assert ngram_join.links(arrays, np.ones(len(sets), np.int64), side, num, den)[1].tolist() == [across[i] for i in range(len(sets))]


def test_shingles():
    words = ngram_join.Words()
    assert len(ngram_join.shingles(None, 3, words)) == len(ngram_join.shingles(" \n", 3, words)) == 0
    assert len(ngram_join.shingles("a b", 3, words)) == 1 and len(ngram_join.shingles("a b c a b c", 3, words)) == 3
    assert (ngram_join.shingles("A B", 3, words) == ngram_join.shingles("a\tb", 3, words)).all()
    assert (ngram_join.shingles("a b", 3, words) != ngram_join.shingles("b a", 3, words)).all()


def test_chunks_resist_shifts_and_repeat_at_a_period():
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(2000)).encode()
    pieces = lambda raw: [raw[a:b] for a, b in zip([0, *chunk_dedup.cuts(np.frombuffer(raw, np.uint8))], chunk_dedup.cuts(np.frombuffer(raw, np.uint8)))]
    a, b = pieces(text), pieces(b"inserted words " + text)
    assert b"".join(a) == text and len(set(a) - set(b)) <= 5
    assert len(set(pieces(b"Of " * 4000))) < 6 and pieces(b"") == []
    assert chunk_dedup.without("aéb", [(1, 2)]) == "aéb" and chunk_dedup.without("abcdef", [(1, 3), (4, 5)]) == "adf" and chunk_dedup.without(None, [(0, 1)]) is None


def test_rolling_hash_by_definition():
    data = np.frombuffer(bytes(random.Random(3).randrange(256) for _ in range(100)), np.uint8)
    h = chunk_dedup.gear(data)
    for i in (0, 5, 31, 32, 99):
        assert int(h[i]) == sum(int(chunk_dedup.GEAR[data[i - k]]) << k for k in range(32) if i >= k) % (1 << 32)


def test_pages():
    texts = lambda html: "\n".join(html_text.parse(html).blocks)
    page = '<html><head><title>T</title></head><body><nav><a>x</a></nav><div class="ad">buy</div><article><h1>A&amp;B</h1><p><b>one  two<br><p>three &eacute;<script>var x="</p>"</script></p><div class="comments"><p>me</p></div></article><footer>f</footer></body></html>'
    assert texts(page) == "A&B\none two\nthree é"
    assert texts("") == "" and texts(None) == "" and texts("<p>cut <b>off &am") == "cut off &am"


def test_ring_loads():
    rng = random.Random(4)
    counts = Counter(rng.randrange(sharding.POSITIONS) for _ in range(5000))
    load = lambda rows: [sum(n for *_, n, s, _ in rows if s == k) for k in range(24)]
    even = list(sharding.bounded_loads(counts, 24, 0.0))
    assert max(load(even)) - min(load(even)) <= 1 and sum(load(even)) == 5000
    loose = list(sharding.bounded_loads(counts, 24, 0.25))
    assert max(load(loose)) <= 1.25 * 5000 / 24 + 1
    where = lambda rows: {(at, first + i): s for at, first, n, s, _ in rows for i in range(n)}
    a, b = where(loose), where(list(sharding.bounded_loads(counts, 25, 0.25)))
    assert sum(a[k] != b[k] for k in a) < 0.25 * 5000
    assert list(sharding.bounded_loads({}, 24, 0.0)) == []


def test_quality_features_and_fit():
    assert not quality.features(None).any() and not quality.features(" \n").any()
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] > 0.3).astype(int)
    w, t = quality.fit(x, y)
    assert ((x @ w >= t) == y).mean() > 0.97
    assert quality.fit(x, np.ones(400))[1] == 0
    assert re.fullmatch(r"\d+", str(len(w)))
