"""Byte-level BPE as a streaming transducer with bounded lookahead, and an incremental decoder.

A text is split into pieces (words with a leading space, numbers, marks, white space) between which no token
lies; inside a piece the merge list decides. Whether a token is final depends on the bytes behind it, and
``MergeList.lookahead`` bounds how many: a change at the right end travels left from token to token, each step
by a merge of later rank that meets the token on its right, so the longest such chain of ranks, in bytes, is
enough. The encoder holds a chunk of text and, for a piece of any length, a window of a few lookaheads.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import slices

#: The pieces of byte-level BPE, in their published form.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
RUNS = {"L": regex.compile(r"\p{L}+"), "N": regex.compile(r"\p{N}+"), "S": regex.compile(r"\s+"), "P": regex.compile(r"[^\s\p{L}\p{N}]+")}
#: A character of each class.
PROXY = {"L": "a", "N": "1", "S": "\t", "P": "!"}
#: Characters of text that are fed at a time; pieces that are remembered, and characters of such a piece; a piece that is longer than LONG is not held whole.
BLOCK, REMEMBERED, SHORT, LONG = 1 << 16, 100_000, 64, 4096
#: Documents, and bytes of their texts, whose ids a task holds at a time.
TOGETHER, BYTES = 500, 4 << 20
NONE = 1 << 62


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary: itself if it prints in Latin-1, else the next from U+0100."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    other = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class MergeList:
    def __init__(self, vocab: dict[str, int], merges: list, added: dict[str, int]) -> None:
        letters = byte_letters()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in added} | {i: t.encode() for t, i in added.items()}
        self.ranks = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        self.of_byte = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.packed = {a << 32 | b: r << 32 | made for (a, b), (r, made) in self.ranks.items()}
        self.added = added
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Bytes behind a token that decide it. See the module's text.

        A merge (t, y) can follow a merge (u, v) of earlier rank if y starts with u, that is u is y or one of the
        left parts from which y was made; reach[u] is the longest chain, in bytes, that ends in a merge of u.
        """
        size = {i: len(b) for i, b in self.bytes_of.items()}
        left, reach = {}, {}
        for (t, y), (_, made) in sorted(self.ranks.items(), key=lambda x: x[1][0]):
            best, u = size[y], y
            while u is not None:
                best = max(best, reach.get(u, 0))
                u = left.get(u)
            reach[t] = max(reach.get(t, 0), best + size[t])
            left.setdefault(made, t)
        return max(reach.values(), default=0) + max(size.values())

    def encode(self, data: bytes) -> list[int]:
        """The ids of data as one piece: always the merge of least rank, leftmost first."""
        ids = [self.of_byte[b] for b in data]
        if len(ids) > 100:
            return self._encode_long(ids)
        get, none = self.packed.get, NONE
        ranks = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]  # rank and made id of each pair
        while ranks and (least := min(ranks)) != none:
            at = ranks.index(least)
            ids[at] = made = least & 0xFFFFFFFF
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = get(ids[at - 1] << 32 | made, none)
            if at < len(ranks):
                ranks[at] = get(made << 32 | ids[at + 1], none)
        return ids

    def _encode_long(self, ids: list[int]) -> list[int]:
        ranks, n = self.ranks, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*ranks[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in ranks]
        heap = [(r, i, m) for r, m, i in heap]
        heapq.heapify(heap)
        while heap:
            rank, i, made = heapq.heappop(heap)
            if ids[i] < 0 or (j := after[i]) < 0 or ranks.get((ids[i], ids[j]), (-1,))[0] != rank:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (x := ranks.get((ids[a], ids[after[a]]))):
                    heapq.heappush(heap, (x[0], a, x[1]))
        return [x for x in ids if x >= 0]


class PieceStream:
    """One piece of any length: bytes in, ids out as soon as they are stable, a window of a few lookaheads held."""

    def __init__(self, merges: MergeList) -> None:
        self.merges, self.held = merges, b""

    def feed(self, data: bytes) -> list[int]:
        self.held += data
        if len(self.held) < 4 * self.merges.lookahead:
            return []
        out, end, sure = [], 0, len(self.held) - self.merges.lookahead
        for x in self.merges.encode(self.held):
            if end + len(self.merges.bytes_of[x]) > sure:
                break
            out.append(x)
            end += len(self.merges.bytes_of[x])
        self.held = self.held[end:]
        return out

    def finish(self) -> list[int]:
        out, self.held = self.merges.encode(self.held) if self.held else [], b""
        return out


@lru_cache(maxsize=4)
def load_merges(path: str) -> tuple[MergeList, object]:
    """The merge list of a tokenizer file, and a probe of its library's character classes."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    added = {x["content"]: x["id"] for x in said["added_tokens"]}
    return MergeList(said["model"]["vocab"], said["model"]["merges"], added), Tokenizer.from_file(path).pre_tokenizer


class Remembered(dict):
    """Ids of pieces, as decimal text joined by commas; starts anew when full. Long pieces aren't kept, so its bytes are bounded."""

    def __init__(self, merges: MergeList) -> None:
        self.merges = merges

    def __missing__(self, piece: str) -> str:
        out = ",".join(map(str, self.merges.encode(piece.encode())))
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = out
        return out


class Encoder:
    """Text in chunks of any size; ids, as decimal text joined by commas, once they are stable."""

    def __init__(self, path: str) -> None:
        self.merges, self.probe = load_merges(path)
        self.known = Remembered(self.merges)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.merges.added, key=len, reverse=True))) or r"(?!)")
        self.margin = max([8, *(len(x) + 3 for x in self.merges.added)])
        self.classed: dict[str, str] = {}
        self.odd: dict[int, str] = {}
        self.rest, self.run, self.stream = "", "", None

    def _alike(self, text: str) -> str:
        """text with a proxy for each character whose class in the library differs from the class here."""
        if text.isascii():
            return text
        for c in set(text) - self.classed.keys():
            if c < "\x80":
                self.classed[c] = ""
                continue
            joins = lambda x: len(self.probe.pre_tokenize_str(x + c)) == 1  # noqa: E731, B023
            self.classed[c] = theirs = "L" if joins("a") else "N" if joins("1") else "P" if joins("!") else "S"
            if not RUNS[theirs].fullmatch(c):
                self.odd[ord(c)] = PROXY[theirs]
        return text.translate(self.odd) if self.odd else text

    def _pieces(self, text: str) -> list[str]:
        """The pieces of a text without special tokens."""
        alike = self._alike(text)
        found = PIECES.findall(alike)
        if alike is text or alike == text:
            return found
        out, at = [], 0
        for x in found:
            out.append(text[at : at + len(x)])
            at += len(x)
        return out

    def _whole(self, text: str) -> list[str]:
        """Ids of a text that ends where a piece ends."""
        out, at, known = [], 0, self.known
        for m in self.special.finditer(text) if self.merges.added else ():
            out += map(known.__getitem__, self._pieces(text[at : m.start()]))
            out.append(str(self.merges.added[m[0]]))
            at = m.end()
        out += map(known.__getitem__, self._pieces(text[at:] if at else text))
        return out

    def _in_run(self, final: bool) -> list[str]:
        """Goes on with a piece that is longer than LONG."""
        mark = self.special.search(self.rest)
        stop = mark.start() if mark else len(self.rest)
        m = RUNS[self.run].match(self._alike(self.rest[:stop]))
        end = m.end() if m else 0
        if end == stop and not mark and not final:
            end, closed = max(0, stop - self.margin), False
        else:
            closed = True
            if self.run == "S" and end < stop:  # the last white space before something else goes with that, or alone
                end = max(0, end - 1)
        ids = self.stream.feed(self.rest[:end].encode())
        self.rest = self.rest[end:]
        if closed:
            ids += self.stream.finish()
            self.run = ""
        return [str(x) for x in ids]

    def feed(self, chunk: str, final: bool = False) -> str:
        self.rest += chunk
        out: list[str] = []
        while self.rest:
            if self.run:
                out += self._in_run(final)
                if self.run:
                    break
                continue
            cut = len(self.rest) if final and len(self.rest) <= 2 * BLOCK else 0
            at = len(self.rest)
            while not cut and (at := self.rest.rfind(" ", 1, at)) > 0:
                if not self.rest[at - 1].isspace():
                    cut = at  # white space behind something else always starts a piece
            if cut:
                text, self.rest = self.rest[:cut], self.rest[cut:]
                out += self._whole(text)
                if not final:
                    break
                continue
            if len(self.rest) < LONG and not final:
                break
            out += self._stable(final)
            if not self.run:
                break
        if final and self.run:
            out += self._in_run(True)
        return ",".join(x for x in out if x)

    def _stable(self, final: bool) -> list[str]:
        """Ids of the pieces that more text can't change, where no cut was found; opens a run if one is left that is too long."""
        mark = self.special.search(self.rest)
        text = self.rest[: mark.start()] if mark else self.rest
        end, found = 0, self._pieces(text)
        for k, x in enumerate(found):
            if not mark and not final and (k == len(found) - 1 or end + len(x) > len(text) - self.margin):
                break
            if len(x) > LONG:
                break
            end += len(x)
        else:
            k = len(found)
        out = list(map(self.known.__getitem__, found[:k]))
        if mark and end == len(text):
            out.append(str(self.merges.added[mark[0]]))
            end = mark.end()
        self.rest = self.rest[end:]
        if k < len(found) and len(found[k]) > LONG:
            alike = self._alike(found[k])
            self.run = next(c for c in "LNPS" if RUNS[c].match(alike, len(alike) - 1))
            self.stream = PieceStream(self.merges)
            if found[k][0] == " " and self.run != "S":
                self.stream.feed(b" ")
                self.rest = self.rest[1:]
        elif (final or mark) and self.rest:
            out += [x for x in (self._again(final),) if x]
        return out

    def _again(self, final: bool) -> str:
        return self.feed("", final)

    def encode(self, text: str) -> Iterator[str]:
        """Ids of a text, block by block."""
        for at in range(0, max(len(text), 1), BLOCK):
            if x := self.feed(text[at : at + BLOCK], final=at + BLOCK >= len(text)):
                yield x


class Decoder:
    """Ids to text: bytes of a character that is not whole are held; bytes that can't be UTF-8 become U+FFFD."""

    def __init__(self, path: str) -> None:
        merges = load_merges(path)[0]
        self.known = {str(i): b for i, b in merges.bytes_of.items()}
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: str, final: bool = False) -> str:
        return self.state.decode(b"".join(map(self.known.__getitem__, ids.split(","))) if ids else b"", final)


def digests(path: str, texts: Iterable[str | None]) -> Iterator[tuple[int, str, str]]:
    encoder, decoder = Encoder(path), Decoder(path)
    for text in texts:
        n, ids, plain = 0, hashlib.sha256(), hashlib.sha256()
        for block in encoder.encode(text or ""):
            ids.update((("," if n else "") + block).encode())
            n += block.count(",") + 1
            plain.update(decoder.feed(block).encode())
        plain.update(decoder.feed("", True).encode())
        decoder.state.reset()
        yield n, ids.hexdigest(), plain.hexdigest()


def encode_documents(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text, ...) with ids array<int>. Null text has no ids; other columns stay, but for one named ids."""
    kept = docs.drop("ids")
    at = kept.columns.index("text")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        encoder = Encoder(path)
        for batch in slices(batches, at, TOGETHER, BYTES):
            offsets, parts = [0], []
            for text in batch.column(at).to_pylist():
                blocks = [np.array(x.split(","), np.int32) for x in encoder.encode(text or "")]
                offsets.append(offsets[-1] + sum(map(len, blocks)))
                parts += blocks
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, "ids"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode_documents(spark: SparkSession, encoded: DataFrame, path: str) -> DataFrame:
    """encoded(doc_id, ids) to (doc_id, decoded). Null ids decode to an empty text."""

    def run(batches):
        import pyarrow as pa

        decoder = Decoder(path)
        for batch in batches:
            texts = [decoder.feed(",".join(map(str, x or ())), True) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, T.StructType([encoded.schema["doc_id"], T.StructField("decoded", T.StringType())]))


def encoding_digests(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of docs(doc_id, text); one pass, blocks of a text at a time.

    Null and empty texts have no tokens and the digests of empty strings; repeated rows each give a row.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = list(digests(path, batch.column(1).to_pylist()))
            n, ids, plain = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(plain, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return docs.select("doc_id", "text").mapInArrow(run, out)
