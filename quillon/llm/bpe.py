"""Encoding with a byte-level BPE vocabulary as a streaming transducer, and decoding as a byte-to-text machine.

The text is read in blocks and cut into words where no later text can move the cut; within a word the transducer keeps,
for each of the last bytes read, the last token of the encoding of everything up to there. That token is unique: it is the
one that may follow the last token before it. Whether two tokens may stand side by side is a question of merge times: a
merge over their border must not come up while both its parts stand at the border.

How far later bytes can reach back is a property of the merge list (``lookahead``): a merge is held up only by an earlier
merge that takes the right edge of its right part, which in turn can be held up by a still earlier one further right, so
the chain's bytes are bounded. Tokens that end further back than that are final and are emitted; what is kept is that many
bytes and no more.

The vocabulary is read from its file, whose path is a parameter; nothing is trained.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

# The word pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Between these two characters there is always a cut, whatever comes before and after.
_CUT = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}])")
#: Characters read at once, and words kept in memory with their ids.
BLOCK = 1 << 16
WORDS = 200_000
#: Words longer than this many characters are encoded through the window of ``Transducer`` instead of whole.
LONG = 256


def byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files write bytes: printable Latin-1 as itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A vocabulary with its merge list."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letter = byte_letters()
        vocab = {t: i for t, i in model["vocab"].items() if all(c in letter for c in t)}
        self.bytes = {i: bytes(letter[c] for c in t) for t, i in vocab.items()}
        self.ids = {b: i for i, b in self.bytes.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank[left, right] = r
            if whole not in self.parts:
                self.parts[whole], self.born[whole] = (left, right), r
        self.longest = max(map(len, self.bytes.values()))
        self._fits: dict[tuple[int, int], bool] = {}
        self._own: dict[int, bool] = {}
        self._edges: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts that stand at the token's left (0) or right (1) edge while it is built, each with the time of the
        merge that takes it up."""
        out = self._edges.get((token, side))
        if out is None:
            out, until, t = [], 1 << 60, token
            while True:
                out.append((t, until))
                if t not in self.parts:
                    break
                until, t = self.born[t], self.parts[t][side]
            self._edges[token, side] = out
        return out

    def fits(self, a: int, b: int) -> bool:
        """Whether ``a`` may be followed by ``b``. Of equal merges the left one comes first."""
        known = self._fits.get((a, b))
        if known is None:
            rank = self.rank
            known = True
            for x, until_x in self.edge(a, 1):
                for y, until_y in self.edge(b, 0):
                    r = rank.get((x, y))
                    if r is not None and r < until_x and r <= until_y:
                        known = False
                        break
                if not known:
                    break
            if len(self._fits) < 2_000_000:
                self._fits[a, b] = known
        return known

    def own(self, token: int) -> bool:
        """Whether the token's bytes are encoded as the token."""
        known = self._own.get(token)
        if known is None:
            parts = self.parts.get(token)
            known = self._own[token] = parts is None or (self.own(parts[0]) and self.own(parts[1]) and self._joins(*parts))
        return known

    def _joins(self, a: int, b: int) -> bool:
        """Whether the first merge over the border of ``a`` and ``b`` is that of the two whole."""
        whole = self.rank[a, b]
        for x, until_x in self.edge(a, 1):
            for y, until_y in self.edge(b, 0):
                r = self.rank.get((x, y))
                if r is not None and r < whole and r < until_x and r <= until_y:
                    return False
        return True

    def lookahead(self) -> int:
        """Bytes that must be known behind a token's end before it is final."""
        reach: dict[int, int] = {}  # by left part: the bytes to its right that its earlier merges depend on
        most = 0
        for (left, right), _ in self.rank.items():
            behind = max((reach.get(t, 0) for t, _ in self.edge(right, 1)), default=0)
            need = len(self.bytes[right]) + behind
            reach[left] = max(reach.get(left, 0), need)
            most = max(most, need)
        return most + self.longest


class Transducer:
    """Encodes one word fed piece by piece; ``feed`` gives the ids that have become final, ``close`` the rest."""

    def __init__(self, merges: Merges, wait: int | None = None):
        self.m = merges
        self.wait = merges.lookahead() if wait is None else wait
        self.held = b""  # bytes from the last emitted token's end
        self.last: list[int] = []  # by end position in held: the last token of the encoding up to there
        self.before = -1  # the last emitted token
        self.done = 0

    def _extend(self) -> None:
        held, last, ids, m = self.held, self.last, self.m.ids, self.m
        longest = m.longest
        for end in range(len(last) + 1, len(held) + 1):
            for start in range(max(0, end - longest), end):
                t = ids.get(held[start:end])
                if t is None:
                    continue
                prev = last[start - 1] if start else self.before
                if (prev < 0 or m.fits(prev, t)) and m.own(t):
                    last.append(t)
                    break
            else:
                raise ValueError("a byte is missing from the vocabulary")

    def _path(self, end: int) -> list[int]:
        out = []
        while end:
            t = self.last[end - 1]
            out.append(t)
            end -= len(self.m.bytes[t])
        return out[::-1]

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        step = max(1, self.wait)
        for at in range(0, len(data), step):
            self.held += data[at : at + step]
            self._extend()
            final = len(self.held) - self.wait
            end = 0
            for t in self._path(len(self.held)) if final > 0 else ():
                if end + len(self.m.bytes[t]) > final:
                    break
                end += len(self.m.bytes[t])
                self.before = t
                out.append(t)
            self.held, self.last = self.held[end:], self.last[end:]
        return out

    def close(self) -> list[int]:
        out = self._path(len(self.held))
        self.held, self.last, self.before = b"", [], -1
        return out


class Encoder(dict):
    """Words to their ids as int32 bytes; the first ``WORDS`` words met are remembered."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        super().__init__()
        self.m = Merges(path)
        self.wait = self.m.lookahead()
        self.words = regex.compile(pattern).findall

    def __missing__(self, word: str) -> bytes:
        one = Transducer(self.m, self.wait)
        if len(word) <= LONG:
            one.held = word.encode("utf-8", "surrogatepass")
            one._extend()
            ids = one.close()
        else:
            ids = one.feed(word.encode("utf-8", "surrogatepass")) + one.close()
        out = np.array(ids, np.int32).tobytes()
        if len(self) < WORDS and len(word) <= LONG:
            self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text, as int32 bytes."""
        get = self.__getitem__
        return b"".join([b"".join(map(get, self.words(block))) for block in blocks(text)])


def blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    """Pieces of about ``size`` characters whose words are the text's words."""
    if len(text) <= size:
        yield text
        return
    start = 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_stream(chunks: Iterable[str], path: str = VOCABULARY) -> Iterator[int]:
    """The ids of a text that comes in chunks of any size; a word is encoded as soon as a later cut is sure."""
    encoder = _encoder(path)
    held = ""
    for chunk in chunks:
        held += chunk
        # the last cut that no later text can move
        cut = None
        for cut in _CUT.finditer(held, max(0, len(held) - BLOCK)):
            pass
        if cut is not None and cut.start():
            yield from np.frombuffer(encoder.encode(held[: cut.start()]), np.int32).tolist()
            held = held[cut.start() :]
    yield from np.frombuffer(encoder.encode(held), np.int32).tolist()


class Decoder:
    """Ids to text, piece by piece: a character is given out when its last byte has come; what is no UTF-8 becomes the
    replacement character."""

    def __init__(self, path: str = VOCABULARY):
        self.bytes = _encoder(path).m.bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(self.bytes[i] for i in ids))

    def close(self) -> str:
        return self.state.decode(b"", final=True)


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            ids = [b"" if t is None else encoder.encode(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(i) // 4 for i in ids)])
            flat = pa.array(np.frombuffer(b"".join(ids), np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["doc_id", "ids"])

    return run


def encode_texts(df: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and ids (array<int>) of each row of (doc_id, text), without special tokens, whose strings are ordinary
    text. Empty and NULL texts both have the empty list; every other text has at least one id."""
    return df.select("doc_id", "text").mapInArrow(_encode(path), "doc_id bigint, ids array<int>")


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            counts = [0 if t is None else len(encoder.encode(t)) // 4 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return run


def count_tokens(df: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens of each row of (doc_id, text); 0 for empty and NULL texts."""
    return df.select("doc_id", "text").mapInArrow(_count(path), "doc_id bigint, n_tokens bigint")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                decoder = Decoder(path)
                texts.append(None if ids is None else decoder.feed(ids) + decoder.close())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode_ids(df: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and text of each row of (doc_id, ids); NULL ids give NULL."""
    return df.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id bigint, text string")
