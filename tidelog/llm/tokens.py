"""Token ids of texts by a byte-level pair-merge vocabulary, without special tokens.

A text is split by the vocabulary's pattern; each piece, mapped byte by byte to Latin-1, is matched against all tokens by
an Aho-Corasick automaton. From each position the longest token is tried first; it stands if it is compatible with the
token before it, i.e. if merging the two tokens' bytes in rank order keeps the boundary between them. Where no token fits,
the search steps back and marks the position as dead, so every position is left at most once per token that ends there.
The verdict on a pair of tokens is kept, as is the result for a piece and for a line.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the pattern of the vocabulary's pre-tokenizer; white space is Unicode's, which Python's \s is not quite.
SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
KEPT_PAIRS, KEPT_PIECES, KEPT_LINES, KEPT_CHARACTERS = 2_000_000, 200_000, 100_000, 10_000_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: visible Latin-1 characters for themselves, the other bytes, in order, for 256 and on."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or (0xA1 <= b and b != 0xAD)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PairMergeEncoder:
    """Exact merges in time linear in the text. vocabulary: the bytes of the tokenizer's JSON file. Picklable; built anew, with empty memory, in each worker."""

    def __init__(self, vocabulary: bytes) -> None:
        self.vocabulary = vocabulary
        self.ready = False

    def __getstate__(self) -> bytes:
        return self.vocabulary

    def __setstate__(self, vocabulary: bytes) -> None:
        self.__init__(vocabulary)

    def build(self) -> None:
        import ahocorasick
        import regex

        model = json.loads(self.vocabulary)["model"]
        letters = {k: chr(v) for k, v in byte_letters().items()}
        ids = {}
        for token, i in model["vocab"].items():
            if all(c in letters for c in token):
                ids["".join(letters[c] for c in token)] = i
        self.size = [0] * (max(ids.values()) + 1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        self.joined: dict[tuple[int, int], int] = {}
        automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            self.size[i] = len(token)
            automaton.add_word(token, i)
        automaton.make_automaton()
        self.automaton, self.ids = automaton, ids
        self.birth = [-1] * len(self.size)  # the rank of the merge that makes a token; -1: a single byte
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right = ("".join(letters[c] for c in x) for x in (a, b))
            pair, made = (ids[left], ids[right]), ids[left + right]
            self.rank[pair] = rank
            if self.birth[made] < 0:
                self.birth[made], self.parts[made] = rank, pair
        self.split = regex.compile(PATTERN).findall
        self.fits: dict[int, bool] = {}
        self.pieces: dict[str, list[int]] = {}
        self.lines: dict[str, np.ndarray] = {}
        self.held = 0
        self.ready = True

    def compatible(self, a: int, b: int) -> bool:
        """Whether the boundary between a and b survives when their bytes are merged in rank order.

        Undo the merges of both tokens from the last one down. While a and b stand whole, a merge of the two must not exist
        with a rank below that of the step that made the later of them into what it is next."""
        key = a << 20 | b
        known = self.fits.get(key)
        if known is not None:
            return known
        rank, birth, parts = self.rank, self.birth, self.parts
        left, right, until = a, b, 1 << 30
        good = True
        while True:
            made = rank.get((left, right))
            if made is not None and made < until:
                good = False
                break
            # Of equal births the right token is undone first: merges of one rank are applied from the left.
            if birth[left] < 0 and birth[right] < 0:
                break
            if birth[left] > birth[right]:
                until = birth[left]
                left = parts[left][1]
            else:
                until = birth[right] + 1
                right = parts[right][0]
        if len(self.fits) >= KEPT_PAIRS:
            self.fits.clear()
        self.fits[key] = good
        return good

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        whole = self.ids.get(data)
        if whole is not None:
            return [whole]
        n, size, compatible = len(data), self.size, self.compatible
        starting: list[list[int]] = [[] for _ in range(n)]
        for end, token in self.automaton.iter(data):  # by end, so the longest of a start comes last
            starting[end + 1 - size[token]].append(token)
        out: list[int] = []
        at, choice = 0, len(starting[0]) - 1
        tried: list[int] = []
        dead = bytearray(n + 1)
        while at < n:
            here, found = starting[at], False
            while choice >= 0:
                token = here[choice]
                if not dead[at + size[token]] and (not out or compatible(out[-1], token)):
                    found = True
                    break
                choice -= 1
            if found:
                out.append(token)
                tried.append(choice)
                at += size[token]
                choice = len(starting[at]) - 1 if at < n else 0
            else:
                dead[at] = 1
                at -= size[out.pop()]
                choice = tried.pop() - 1
        return out

    def encode_line(self, line: str) -> np.ndarray:
        known = self.lines.get(line)
        if known is not None:
            return known
        pieces, out = self.pieces, []
        for piece in self.split(line):
            ids = pieces.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(pieces) >= KEPT_PIECES:
                    pieces.clear()
                if len(piece) <= 100:
                    pieces[piece] = ids
            out += ids
        ids = np.array(out, np.int32)
        if len(line) <= 10_000:
            if len(self.lines) >= KEPT_LINES or self.held > KEPT_CHARACTERS:
                self.lines.clear()
                self.held = 0
            self.lines[line] = ids
            self.held += len(line)
        return ids

    def encode(self, text: str) -> list[np.ndarray]:
        """The ids in parts. A text is cut before a line feed that follows a visible character: no piece of the pattern spans that place."""
        if not self.ready:
            self.build()
        parts, start, n = [], 0, len(text)
        while start < n:
            end = text.find("\n", start + 1)
            while end > 0 and text[end - 1] in WHITE:
                end = text.find("\n", end + 1)
            if end < 0:
                end = n
            parts.append(self.encode_line(text[start:end]))
            start = end
        return parts


WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B))))


def encode_documents(df: DataFrame, vocabulary: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each row; an empty array for an empty or null text. Names of special tokens are ordinary text.

    The vocabulary, a file of fixed size, travels with the task. Repeated rows give repeated rows; other columns are not read."""
    with open(vocabulary, "rb") as f:
        encoder = PairMergeEncoder(f.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, offsets, n = [], np.zeros(b.num_rows + 1, np.int64), 0
            for i, t in enumerate(b.column(1).to_pylist()):
                if t:
                    for p in encoder.encode(t):
                        parts.append(p)
                        n += len(p)
                offsets[i + 1] = n
            values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[doc_id, "ids"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(doc_id, F.col(text).cast("string").alias(text)).mapInArrow(encode, f"{doc_id} {kind}, ids array<int>")
