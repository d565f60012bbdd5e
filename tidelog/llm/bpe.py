"""Byte-level BPE: encoding by backtracking over longest matches, and decoding.

The bytes of a piece are mapped to Latin-1, so that one Aho-Corasick automaton over the reversed tokens
finds the longest token that starts at every position in a single pass.  Encoding walks from left to right,
takes the longest token that may follow its predecessor, shortens it or steps back where none may, and never
enters a dead position twice; so the work is linear in the piece.  Whether two tokens may stand side by side
is decided from their merge trees and memoised.

Null texts count as empty; an empty text has no ids and decodes to no bytes; texts of any length are handled
whole; repeated rows and rows without doc_id give a row each; an empty table gives no rows.  Further columns are ignored or, if
round_trip is to carry them, stay, but for those that its own columns replace.  Of several longest matches there is only one
token, so nothing is left to chance.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidelog.llm import common

#: Distinct strings in each generation of a worker's memory; a pass with one worker a core can afford more.
REMEMBERED, REMEMBERED_ALONE = 130_000, 300_000
#: Characters of the longest string whose ids are remembered.
LONG = 64
#: White space as Unicode defines it; Python's own class also has four control characters.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_codecs: dict[tuple, "BytePairCodec"] = common.cache()


def codec(path: str, pattern: str, remembered: int = REMEMBERED) -> "BytePairCodec":
    """The codec of this process; built once a worker, or once more after tasks of another operator."""
    common.begin("bpe")  # whoever encodes with it
    key = (path, pattern, remembered)
    if key not in _codecs:
        _codecs[key] = BytePairCodec.load(*key)
    return _codecs[key]


class BytePairCodec:
    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.decimal = [str(i).encode() for i in range(len(self.bytes_of))]
        self.size = [len(t) for t in self.bytes_of]
        self.find = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")).findall
        self._spines()
        self._automaton()
        self.allowed: dict[int, bool] = {}
        self.letters = r"| ?\p{L}+|" in pattern
        self.seen = _Memory(lambda piece: self.encode_piece(piece.encode()), remembered // 4)
        self.runs = _Memory(self.encode_run, remembered)
        self.uneven = regex.compile(f"[{WHITE}][{WHITE}]|^[{WHITE}]|[{WHITE}]$|\0").search

    @classmethod
    def load(cls, path: str, pattern: str, remembered: int = REMEMBERED) -> "BytePairCodec":
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern, remembered)

    def _spines(self) -> None:
        """For each token the tokens along its right and left edge, each with the rank at which it is merged away."""
        never = len(self.bytes_of) + 1
        self.joined: dict[tuple[int, int], int] = {}
        self.right: list[list[tuple[int, int]]] = [[] for _ in self.bytes_of]
        self.left: list[list[tuple[int, int]]] = [[] for _ in self.bytes_of]
        for token, i in sorted(self.ranks.items(), key=lambda x: x[1]):
            self.right[i], self.left[i] = [(i, never)], [(i, never)]
            if len(token) > 1 and len(parts := self.merged(token, i)) == 2:
                a, b = parts
                self.joined[a, b] = i
                self.right[i] += [(b, i), *self.right[b][1:]]
                self.left[i] += [(a, i), *self.left[a][1:]]

    def merged(self, piece: bytes, below: int) -> list[int]:
        """Merges by rank alone, with ranks under `below`; quadratic, for single tokens and tests."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(((self.ranks.get(a + b, below), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] >= below:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ranks[p] for p in parts]

    def _automaton(self) -> None:
        self.matches = ahocorasick.Automaton()
        self.shorter = [-1] * len(self.bytes_of)
        for token, i in self.ranks.items():
            self.matches.add_word(token[::-1].decode("latin-1"), i)
            self.shorter[i] = next((self.ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in self.ranks), -1)
        self.matches.make_automaton()

    def adjacent(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b by rank leaves exactly a and b.

        A token on the right edge of a and one on the left edge of b join if their pair comes up before either is
        merged away inside its own token; of equal ranks the pair further left comes first.
        """
        for r, gone in self.right[a]:
            for x, taken in self.left[b]:
                m = self.joined.get((r, x))
                if m is not None and m < gone and m <= taken:
                    return False
        return True

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one piece, as merging by rank gives them."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        found = list(self.matches.iter(piece[::-1].decode("latin-1")))
        found.reverse()  # the longest match at an end comes first, and so stays here
        longest = dict(found)
        size, shorter, allowed = self.size, self.shorter, self.allowed
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest.get(n - 1, -1)
        while True:
            while token >= 0:
                end = at + size[token]
                if not dead[end]:
                    if not out:
                        break
                    pair = out[-1] << 32 | token
                    fits = allowed.get(pair)
                    if fits is None:
                        if len(allowed) >= self.remembered:
                            allowed.clear()
                        fits = allowed[pair] = self.adjacent(out[-1], token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                if at == n:
                    return tuple(out)
                token = longest.get(n - 1 - at, -1)
            else:
                dead[at] = 1
                if not out:
                    raise ValueError("a byte of the text has no token")
                token = out.pop()
                at -= size[token]

    def encode_run(self, run: str) -> tuple[int, ...]:
        """The ids of what stands between two cuts; where the pattern has a piece of letters after a blank, letters alone are one."""
        if self.letters and run.isascii() and run.removeprefix(" ").isalpha():
            return self.encode_piece(run.encode())
        return tuple(chain.from_iterable(map(self.seen.__getitem__, self.find(run))))

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text.

        Where white space stands alone, a piece always begins at a space and a line break is a piece, so the text may
        be cut there and the ids of each run remembered.  Any other text is cut by the pattern itself.
        """
        if not _plain(text) and self.uneven(text):
            return list(chain.from_iterable(map(self.seen.__getitem__, self.find(text))))
        runs = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        return list(chain.from_iterable(map(self.runs.__getitem__, runs)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _plain(text: str) -> bool:
    """True only if all white space is lone blanks and line breaks inside the text; quick to tell."""
    return (
        "  " not in text
        and "\n\n" not in text
        and " \n" not in text
        and "\n " not in text
        and text[:1] not in (" ", "\n")
        and text[-1:] not in (" ", "\n")
        and text.replace("\n", "").isprintable()
    )


class _Memory(dict):
    """Ids by string, in two generations: when the younger is full the older goes, so it stays bounded and keeps what recurs."""

    def __init__(self, ids_of, most: int):
        self.ids_of, self.most, self.older = ids_of, most, {}

    def __missing__(self, text: str) -> tuple[int, ...]:
        ids = self.older.get(text)
        if ids is None:
            ids = self.ids_of(text)
            if len(text) > LONG:
                return ids
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[text] = ids
        return ids


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>): the ids of every whole text."""
    common.ship(docs.sparkSession)

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            for b in common.pieces(batch):
                lists = [own.encode(t or "") for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return common.texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded binary): the bytes of every list of ids."""
    common.ship(encoded.sparkSession)

    def run(batches):
        own = codec(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.decode(x or ()) for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Encodes and decodes in one pass: the columns of `carry`, n_tokens, and digests of the ids and of the decoded bytes.

    Ids live only within a block of about a megabyte of text, so no task holds more than its largest text.
    """
    common.ship(docs.sparkSession)
    own_names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    carry = tuple(c for c in carry if c.lower() not in own_names)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *(docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(carry)))
    kinds = "".join(f", `{c}` {dict(docs.dtypes)[c]}" for c in carry)

    def run(batches):
        own = codec(path, pattern, REMEMBERED_ALONE)
        for batch in batches:
            for b in common.pieces(batch):
                n, ids_hash, text_hash = [], [], []
                for t in b.column(1).to_pylist():
                    ids = own.encode(t or "")
                    n.append(len(ids))
                    ids_hash.append(hashlib.sha256(b" ".join(map(own.decimal.__getitem__, ids))).hexdigest())
                    text_hash.append(hashlib.sha256(own.decode(ids)).hexdigest())
                made = [pa.array(np.asarray(n, np.int64)), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
                yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], *made], names=["doc_id", *carry, "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(common.tidy("bpe", run), f"doc_id long{kinds}, n_tokens long, ids_sha256 string, decoded_sha256 string")
