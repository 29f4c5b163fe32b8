"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word the last token of its encoding is unique: of the vocabulary
tokens that end there (found by an automaton over the vocabulary) it is the one that the
last token of the shorter prefix may stand before.  Two tokens may stand side by side if
no merge across their boundary would have come before the merges that formed them.
Following the stored tokens back from the end of the word gives its ids.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import text_udf

NEVER = 1 << 60
#: Words of a generation whose ids a task remembers (two generations of about 45 MB each), and pairs whose test it remembers.
WORDS_KEPT = 200_000
PAIRS_KEPT = 200_000
#: Stands for the end of a word inside the automaton; no byte letter is mapped to it.
END = "\x00"


def byte_letters() -> list[str]:
    """Letter of each byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


@lru_cache(maxsize=2)
def token_strings(path: str) -> np.ndarray:
    """Token of each id, added tokens included."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    strings = np.full(max(ids.values()) + 1, None, object)
    for token, i in ids.items():
        strings[i] = token
    return strings


def decode_ids(ids: bytes | None, path: str) -> str:
    """Tokens joined by spaces, as a tokenizer without a decoder writes them."""
    return " ".join(token_strings(path)[np.frombuffer(ids or b"", "<u4")].tolist())


class WordCodec:
    """Ids of texts, from a tokenizer file with lower case, word ends and byte letters."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = token_strings(path)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self._learn(vocab, [m.split(" ") if isinstance(m, str) else m for m in model["merges"]])
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def _learn(self, vocab: dict[str, int], merges: list[list[str]]) -> None:
        self.rank_of: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank_of[left, right] = rank
            if whole not in parts:
                parts[whole] = (left, right, rank)
        self.parts = parts
        usable = set()
        for token in sorted(vocab.values(), key=lambda t: parts[t][2] if t in parts else -1):
            if token not in parts:
                usable.add(token)
                continue
            left, right, rank = parts[token]
            if max(parts.get(left, (0, 0, -1))[2], parts.get(right, (0, 0, -1))[2]) >= rank:
                raise ValueError("a merge uses a token that a later merge forms")
            if {left, right} <= usable and self._stand(left, right, rank):
                usable.add(token)
        self.automaton = ahocorasick.Automaton()
        for token in usable:
            text = self.strings[token]
            if text.endswith(self.suffix) and text != self.suffix:
                text = text.removesuffix(self.suffix) + END
            self.automaton.add_word(text, (token, len(text)))
        self.automaton.make_automaton()

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens at a token's left (0) or right (1) edge, smallest first, each with the rank that ends its time there."""
        edge, ends, parts = [], NEVER, self.parts
        while True:
            edge.append((token, ends))
            if token not in parts:
                return edge[::-1]
            ends = parts[token][2]
            token = parts[token][side]

    def _stand(self, left: int, right: int, before: int = NEVER) -> bool:
        """No merge of rank under ``before`` joins the two across their boundary.

        Edge tokens change at the ranks of their merges; of equal ranks the leftmost goes first.
        """
        a_edge, b_edge, i, j = self._edge(left, 1), self._edge(right, 0), 0, 0
        rank_of = self.rank_of
        while True:
            a, a_ends = a_edge[i]
            b, b_ends = b_edge[j]
            rank = rank_of.get((a, b), NEVER)
            if rank < before and rank < a_ends and rank <= b_ends:
                return False
            if a_ends == NEVER and b_ends == NEVER:
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1

    def _may_stand(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            known = self.pairs[key] = self._stand(left, right)
        return known

    def word(self, piece: str) -> bytes:
        """Ids of one piece, as little-endian unsigned 32-bit integers."""
        text = piece.encode().decode("latin-1").translate(self.letters) + END
        last = [-1] * (len(text) + 1)
        back = [0] * (len(text) + 1)
        for end, (token, size) in self.automaton.iter(text):
            start = end + 1 - size
            if start == 0 or (last[start] >= 0 and self._may_stand(last[start], token)):
                last[end + 1], back[end + 1] = token, start
        ids, at = [], len(text)
        while at > 0:
            ids.append(last[at])
            at = back[at]
        return np.array(ids[::-1], "<u4").tobytes()

    def forget(self) -> None:
        """Let go of the words that texts have left behind; the vocabulary and its pairs stay."""
        self.words, self.older = {}, {}

    def _remember(self, piece: str) -> bytes:
        """Ids of a piece that the young generation lacks.  A full young generation becomes the old one, whose place it takes."""
        ids = self.older.get(piece)
        if ids is None:
            ids = self.word(piece)
        if len(piece) < 64:
            if len(self.words) >= WORDS_KEPT:
                self.older, self.words = self.words, {}
            self.words[piece] = ids
        return ids

    def _plain(self, text: str) -> list[bytes]:
        # Lower case goes letter by letter, so no final form of sigma arises.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        words, out = self.words, []
        for piece in self.pieces(text):
            ids = words.get(piece)
            if ids is None:
                ids = self._remember(piece)
                words = self.words
            out.append(ids)
        return out

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" not in text:
            return b"".join(self._plain(text))
        out: list[bytes] = []
        for part in self.cut(text):
            out += [np.array([self.special[part]], "<u4").tobytes()] if part in self.special else self._plain(part)
        return b"".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> WordCodec:
    """One codec per Python worker."""
    return WordCodec(path)


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with a binary column of token ids, little-endian unsigned 32-bit integers.

    Whole texts; null and empty texts give empty ids.  Row by row: repeated rows, null
    keys and other columns pass through, a column named like the result is replaced.
    """

    def kernel(column: pa.Array) -> pa.Array:
        return pa.array(map(codec(path).encode, column.to_pylist()), pa.binary())

    return docs.withColumn(out, text_udf(kernel, "binary", lambda: codec(path).forget())(F.col(text)))


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of a column of ids; null ids give an empty text."""

    def kernel(column: pa.Array) -> pa.Array:
        return pa.array([decode_ids(ids, path) for ids in column.to_pylist()], pa.string())

    return docs.withColumn(out, text_udf(kernel, "string")(F.col(ids)))


def round_trip(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` of its ids in one pass, so that one Python worker a task serves both.

    Columns named like a result are replaced; other columns may have any name.
    """

    def kernel(column: pa.Array) -> pa.Array:
        coded = [codec(path).encode(t) for t in column.to_pylist()]
        decoded = pa.array([decode_ids(c, path) for c in coded], pa.string())
        return pa.StructArray.from_arrays([pa.array(coded, pa.binary()), decoded], ["ids", "decoded"])

    coded = text_udf(kernel, "struct<ids: binary, decoded: string>", lambda: codec(path).forget())(F.col(text))
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in (ids, out)]
    return docs.select(F.struct("*").alias("row"), coded.alias("coded")).select(*own, F.col("coded.ids").alias(ids), F.col("coded.decoded").alias(out))
