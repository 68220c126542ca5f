"""SentencePiece encoding and decoding over an Aho-Corasick automaton.

One automaton holds all pieces. It runs over the text once; at each position its output links list the
pieces that end there, and each of them relaxes the best segmentation of the prefix:

- unigram models: the score of the prefix before the piece plus the piece's score, the greatest wins;
- BPE models: the piece is admissible if merging leaves it and the piece before it apart, that is, if merging
  their two texts gives just these two pieces. Exactly one piece per position is, so the
  result is the one that merging the whole text by rank would give.

Where no piece has a space mark after another character, words are independent and are remembered.
"""

from __future__ import annotations

import functools
import heapq
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from postlake.llm._shared import table, text_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Fixed values of the model format: kinds of pieces and of models, and how far an unknown character's score lies below the least.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
#: Words that a generation of the memory holds, of which there are two, and pairs of pieces that it holds.
WORDS, PAIRS = 300_000, 500_000


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """The fields of a protocol buffer message: number, and value as int or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """A SentencePiece model whose normaliser changes nothing but spaces."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.kind, self.prefix, self.squeeze, self.unknown_id = UNIGRAM, True, True, 0
        for number, value in _fields(data):
            if number == 1:
                x = dict(_fields(value))
                self.kinds.append(x.get(3, NORMAL))
                self.pieces.append(x.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", x[2])[0] if 2 in x else 0.0)
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                x = dict(_fields(value))
                self.prefix, self.squeeze = bool(x.get(3, 1)), bool(x.get(4, 1))
                if x.get(2):
                    raise ValueError("models with a character map aren't supported")
        if self.kind not in (UNIGRAM, BPE) or USER_DEFINED in self.kinds:
            raise ValueError("only unigram and BPE models without user-defined pieces are supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown_id = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        self.least = min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, p)
        if self.ids:
            self.automaton.make_automaton()
        plain = {i: chr(b) for i, b in self.byte_of.items() if b < 128}  # such a byte is a character by itself
        self.spelling = pa.array([plain.get(i, p.replace(SPACE, " ")) for i, p in enumerate(self.pieces)])
        self.cost = {p: -self.scores[i] for p, i in self.ids.items()}
        self.special = np.array([k in (CONTROL, UNKNOWN) or self.byte_of.get(i, 0) >= 128 for i, k in enumerate(self.kinds)], bool)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.lives: dict[str, tuple[list[float], list[str], list[str]] | None] = {}

    # Encoding

    def normalise(self, text: str) -> str:
        text = text.replace(SPACE, " ") if self.squeeze else text
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return ((" " if self.prefix else "") + text).replace(" ", SPACE) if text else ""

    def merged(self, text: str) -> list[str]:
        """BPE merging by rank: the best-scored pair of neighbours first, the leftmost among equals."""
        part, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            if left >= 0 and after[left] < len(part) and (i := self.ids.get(part[left] + part[after[left]])) is not None:
                heapq.heappush(queue, (-self.scores[i], left, self.pieces[i]))

        for i in range(len(part) - 1):
            offer(i)
        while queue:
            _, left, piece = heapq.heappop(queue)
            if not part[left] or after[left] >= len(part) or part[left] + part[after[left]] != piece:
                continue
            right = after[left]
            part[left], part[right], after[left] = piece, "", after[right]
            if after[left] < len(part):
                before[after[left]] = left
            offer(before[left])
            offer(left)
        return [x for x in part if x]

    def _life(self, text: str) -> tuple[list[float], list[str], list[str]] | None:
        """How a text merges into one piece: the costs of the steps, and its first and last symbol before each and after all. None if it doesn't."""
        found = self.lives.get(text, False)
        if found is False:
            part, costs, firsts, lasts = list(text), [], [text[0]], [text[-1]]
            while len(part) > 1:
                least, at = float("inf"), -1
                for i in range(len(part) - 1):
                    c = self.cost.get(part[i] + part[i + 1])
                    if c is not None and c < least:
                        least, at = c, i
                if at < 0:
                    break
                part[at : at + 2] = [part[at] + part[at + 1]]
                costs.append(least)
                firsts.append(part[0])
                lasts.append(part[-1])
            found = self.lives[text] = ([*costs, float("inf")], firsts, lasts) if len(part) == 1 else None
        return found

    def apart(self, a: str, b: str) -> bool:
        """Whether merging a + b gives just these two. Both merge on their own, the cheaper step first, until a merge across their border would come before."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[a, b] = self._apart(a, b)
        return found

    def _apart(self, a: str, b: str) -> bool:
        right = self._life(b)
        left = self._life(a) if a else None
        if right is None or not a:
            return right is not None
        if left is None:
            return False
        (left_costs, _, lasts), (right_costs, firsts, _), i, j = left, right, 0, 0
        while True:
            across = self.cost.get(lasts[i] + firsts[j])
            if across is not None and across < left_costs[i] and across <= right_costs[j]:
                return False
            if left_costs[i] == right_costs[j] == float("inf"):
                return True
            if left_costs[i] <= right_costs[j]:
                i += 1
            else:
                j += 1

    def segments(self, word: str) -> list[str]:
        """The pieces of a text, and the characters that no piece covers, in order."""
        if self.kind == BPE and word.startswith(SPACE + SPACE):
            return self.merged(word)  # runs of spaces have pieces of equal rank, which only merging itself orders
        last = self._admissible(word) if self.kind == BPE else self._best_scored(word)
        out, n = [], len(word)
        while n:
            piece = last[n] or word[n - 1]
            out.append(piece)
            n -= len(piece)
        return out[::-1]

    def _admissible(self, word: str) -> list[str]:
        """For each prefix the last piece of its merged form; empty for a character that no piece covers."""
        last, known = [""] * (len(word) + 1), self.pairs.get
        for end, piece in self.automaton.iter(word) if self.ids else ():
            if last[end + 1]:
                continue
            start = end + 1 - len(piece)
            before = last[start] or (word[start - 1] if start else "")
            fits = known((before, piece))
            if fits or (fits is None and self.apart(before, piece)):
                last[end + 1] = piece
        return last

    def _best_scored(self, word: str) -> list[str]:
        """For each prefix the last piece of its best-scored segmentation; empty for a character that no piece covers."""
        last, best, done = [""] * (len(word) + 1), [0.0] + [-float("inf")] * len(word), 0
        for end, piece in [*self.automaton.iter(word), (len(word), "")] if self.ids else [(len(word), "")]:
            while done < end:  # settles the prefixes before this end
                done += 1
                if best[done - 1] + self.least > best[done]:
                    best[done], last[done] = best[done - 1] + self.least, ""
            start = end + 1 - len(piece)
            if piece and best[start] + self.scores[self.ids[piece]] > best[end + 1]:
                best[end + 1], last[end + 1] = best[start] + self.scores[self.ids[piece]], piece
        return last

    def _ids(self, word: str) -> list[int]:
        out: list[int] = []
        for x in self.segments(word):
            i = self.ids.get(x)
            if i is not None:
                out.append(i)
            elif len(self.bytes) == 256:
                out += [self.bytes[b] for b in x.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown_id:
                out.append(self.unknown_id)
        return out

    def _packed(self, word: str) -> bytes:
        return np.array(self._ids(word), np.int32).tobytes()

    def _word(self, word: str) -> bytes:
        """The ids of a word after one space mark, as bytes. Words seen since the last turn of generations are remembered."""
        found = self.words.get(word)
        if found is None:
            found = self.older.get(word)
            if found is None:
                found = self._packed(SPACE + word)
            if len(word) < 64:
                if len(self.words) >= WORDS:
                    self.older, self.words = self.words, {}
                self.words[word] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, as 32-bit integers."""
        text = self.normalise(text)
        if not text:
            return np.empty(0, np.int32)
        if not self.by_word or len(self.bytes) != 256:
            return np.array(self._ids(text), np.int32)
        if text[0] == SPACE and text[-1] != SPACE and SPACE + SPACE not in text:
            words = text.split(SPACE)[1:]
            found = list(map(self.words.get, words))
            if None in found:
                found = [self._word(w) if x is None else x for w, x in zip(words, found)]
        else:
            words = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", text)
            found = [self._word(w[1:]) if w[0] == SPACE and w[1:2] not in ("", SPACE) else self._packed(w) for w in words]
        return np.frombuffer(b"".join(found), np.int32)

    # Decoding

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; control pieces are silent, broken byte runs give U+FFFD."""
        return self.decode_all([np.asarray(ids, np.int64)])[0]

    def decode_all(self, rows: list[np.ndarray]) -> list[str]:
        """The texts of several arrays of ids."""
        if not rows:
            return []
        ids, ends = np.concatenate(rows), np.cumsum([0, *map(len, rows)])
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.spelling.take(pa.array(ids))), "").to_pylist()
        odd = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(self.special[ids])])[ends]))
        for i in odd:
            joined[i] = "".join(self._spelt(rows[i].tolist())).replace(SPACE, " ")
        return [x.removeprefix(" ") for x in joined] if self.prefix else joined

    def _spelt(self, ids: list[int]) -> Iterator[str]:
        held = bytearray()
        for i in ids:
            if self.kinds[i] == BYTE:
                held.append(self.byte_of[i])
                continue
            if held:
                yield held.decode("utf-8", "replace")
                held.clear()
            if self.kinds[i] != CONTROL:
                yield " ⁇ " if self.kinds[i] == UNKNOWN else self.pieces[i]
        if held:
            yield held.decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def _model(data: bytes) -> Model:
    return Model(data)


def read_model(path: str = MODEL) -> bytes:
    """The bytes of a model file, which the driver reads and tasks are sent."""
    with open(path, "rb") as f:
        return f.read()


def encoder(model: bytes):
    """A column function from a text to its ids; a null text has null ids, an empty one none."""

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        m = _model(model)
        return pd.Series([None if x is None else m.encode(x) for x in texts], dtype=object)

    return encode


def decoder(model: bytes):
    """A column function from ids to their text; null ids have a null text."""

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        there = [x for x in ids if x is not None]
        texts = iter(_model(model).decode_all(there))
        return pd.Series([None if x is None else next(texts) for x in ids], dtype=object)

    return decode


def encode_documents(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``n_tokens`` (long).

    A null text has null ids and a null count, an empty one no ids and count 0. Whole texts are
    encoded; columns of these two names are replaced; repeated rows stay repeated.
    """
    text_batches(docs.sparkSession)
    return docs.withColumn("ids", encoder(model)(F.col(text))).withColumn("n_tokens", F.when(F.col("ids").isNotNull(), F.size("ids").cast("long")))


def op7_pieces(spark, sf_dir: str) -> DataFrame:
    model = read_model()
    coded = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return coded.select("doc_id", "n_tokens", "ids", F.col("text").eqNullSafe(decoder(model)("ids")).alias("round_trip"))
