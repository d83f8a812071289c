"""Operator 2: byte-level BPE by backtracking, and decoding by an offset table.

Encoding. Text is cut at the special tokens' strings and then into pieces by the tokenizer's pattern. A piece is encoded from left to right: an
Aho-Corasick automaton over the reversed vocabulary gives, for every start, all tokens that match there, the longest first. A token is taken when the
pair it makes with the one before is compatible: merging the two tokens' bytes by the ranks gives exactly these two back. If none that starts here is,
the last token is given up for the next shorter one. Each position is marked once it is known to lead nowhere, so the work is linear in the piece.
Pairs are looked up in a table that fills as pairs are met. Distinct pieces are kept in two bounded tables, for words repeat: when the newer one is full it
becomes the older one, so what is met again stays and what came once goes.

Decoding. All tokens' bytes lie in one array; an offset table says where each starts. The ids gather their slices at once.

Cases: null and empty text have no tokens; texts of any length are encoded whole; repeated rows get equal results; ids outside the vocabulary raise
IndexError in decode; an empty table gives an empty result; columns named like the new ones are replaced.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from attestor.llm.common import passing

#: Fixed value: the pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Entries of the tables of a coder, some 300 bytes each. Pieces have two such tables.
KEPT_PIECES = 200_000
KEPT_PAIRS = 200_000


def byte_letters() -> dict[str, int]:
    """The byte for each letter in which byte-level vocabularies write it: printable Latin-1 stands for itself, the rest in order from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Pieces(dict):
    """The ids of pieces that were met; those of others are made when they are asked for."""

    def __init__(self, encode: Callable[[str], tuple[int, ...]]) -> None:
        super().__init__()
        self.encode = encode
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece) or self.encode(piece)
        if len(piece) <= 64:
            if len(self) >= KEPT_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class BytePairCoder:
    """Encodes and decodes with the vocabulary of a tokenizer file (JSON, model BPE, byte level)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merges = {(vocab[raw(a)], vocab[raw(b)]): (rank, vocab[raw(a + b)]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.single = [vocab.get(bytes([b]), -1) for b in range(256)]
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for s, i in [*vocab.items(), *((k.encode(), v) for k, v in self.special.items())]:
            self.bytes_of[i] = s
        self.decimals = [str(i) for i in range(len(self.bytes_of))]
        # Of each token the rank of the merge that makes it (-1: none) and its parts. Usable if there is one such merge at most, and if it comes after those of its parts.
        self.rank, self.left, self.right = ([-1] * len(self.bytes_of) for _ in range(3))
        for (a, b), (rank, i) in self.merges.items():
            self.rank[i], self.left[i], self.right[i] = rank, a, b
        self.ordered = len({i for _, i in self.merges.values()} | set(self.single)) == len(self.merges) + len(set(self.single)) and all(max(self.rank[a], self.rank[b]) < rank for (a, b), (rank, _) in self.merges.items())
        # A token that no merge makes can't come out of merging.
        made = {i for _, i in self.merges.values()} | set(self.single)
        self.automaton = ahocorasick.Automaton()
        for s, i in vocab.items():
            if i in made:
                self.automaton.add_word(s[::-1].decode("latin-1"), (len(s), i))
        self.automaton.make_automaton()
        self.blob = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.sizes = np.array([len(s) for s in self.bytes_of], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces = Pieces(self.encode_piece)

    def release(self) -> None:
        """Gives the tables up: a worker lives on after its task, and other work follows in it and beside it."""
        self.fits, self.pieces = {}, Pieces(self.encode_piece)

    def merged(self, data: bytes) -> list[int]:
        """Plain merging by rank: the definition, used for pairs of tokens."""
        ids = [self.single[b] for b in data]
        while len(ids) > 1:
            _, at, new = self._best(ids)
            if at < 0:
                break
            ids[at : at + 2] = [new]
        return ids

    def _best(self, ids: list[int]) -> tuple[int, int, int]:
        best = (1 << 60, -1, -1)
        for i in range(len(ids) - 1):
            found = self.merges.get((ids[i], ids[i + 1]))
            if found and found[0] < best[0]:
                best = (found[0], i, found[1])
        return best

    def compatible(self, a: int, b: int) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= KEPT_PAIRS:
                self.fits.clear()
            known = self.fits[a, b] = self.stand_apart(a, b) if self.ordered else self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def stand_apart(self, a: int, b: int) -> bool:
        """Whether merging the two tokens' bytes gives them back. Merges come in the order of their ranks, so the two tokens that meet at the boundary are known for every rank: going back, the one made later falls into its parts. They
        merge there if that comes before either goes into the token that it is a part of; of equal merges the left one comes first."""
        merges, rank = self.merges, self.rank
        until_a = until_b = 1 << 60
        while True:
            found = merges.get((a, b))
            if found and found[0] < until_a and found[0] <= until_b:
                return False
            made_a, made_b = rank[a], rank[b]
            if made_a > made_b:
                until_a, a = made_a, self.right[a]
            elif made_b >= 0:
                until_b, b = made_b, self.left[b]
            else:
                return True

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8")
        n = len(data)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(data[::-1].decode("latin-1")):
            at[-1 - end].append(match)
        ids: list[int] = []
        starts: list[int] = []  # of each id
        choice: list[int] = []  # its index among the matches at its start
        dead = bytearray(n + 1)  # 1: no way from here on
        fits, compatible = self.fits.get, self.compatible
        pos, k, last = 0, 0, -1
        while pos < n:
            found = at[pos]
            for k in range(k, len(found)):
                size, token = found[k]
                if not dead[pos + size]:
                    if last < 0:
                        break
                    known = fits((last, token))
                    if known or known is None and compatible(last, token):
                        break
            else:
                if not ids:
                    raise ValueError("the vocabulary lacks a byte")
                dead[pos] = 1
                ids.pop()
                last = ids[-1] if ids else -1
                pos, k = starts.pop(), choice.pop() + 1
                continue
            ids.append(token)
            starts.append(pos)
            choice.append(k)
            pos, k, last = pos + size, 0, token
        return tuple(ids)

    def encode(self, text: str | None) -> np.ndarray:
        """The ids (int32) of the whole text."""
        if not text:
            return np.empty(0, dtype=np.int32)
        out: list[int] = []
        ids = self.pieces.__getitem__
        for k, part in enumerate(self.cut(text) if self.cut else [text]):
            if k % 2:
                out.append(self.special[part])
            else:
                out.extend(chain.from_iterable(map(ids, self.split(part))))
        return np.array(out, dtype=np.int32)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, dtype=np.int64)
        if not ids.size:
            return b""
        if ids.min() < 0:
            raise IndexError("negative id")
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        index = np.repeat(self.offsets[ids] - (ends - sizes), sizes) + np.arange(ends[-1])
        return self.blob[index].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_coders: dict[str, BytePairCoder] = {}


def coder(path: str) -> BytePairCoder:
    """One for each worker process and file."""
    if path not in _coders:
        _coders[path] = BytePairCoder(path)
    return _coders[path]


def tokenizer_path(spark: SparkSession) -> str:
    """spark.attestor.tokenizer, else byte_bpe_50k.json of the public tokenizers, which every machine has."""
    named = spark.conf.get("spark.attestor.tokenizer", None)
    if named:
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True, digests: bool = False) -> DataFrame:
    """The columns `keep` with n_tokens, and ids array<int> and digests of the ids and the decoded text as asked for. One pass, no shuffle; batches are bounded by rows and worked document by document."""
    fields = [T.StructField("n_tokens", T.LongType()), *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids]
    fields += [T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256") if digests]
    kept = passing(keep, (f.name for f in fields))
    schema = T.StructType([*(docs.schema[c] for c in kept), *fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        decimals = c.decimals.__getitem__
        try:
            for whole in batches:
                for start in range(0, whole.num_rows, 256):
                    batch = whole.slice(start, 256)
                    found = [c.encode(t.as_py()) for t in batch.column(len(kept))]
                    out = [batch.column(i) for i in range(len(kept))]
                    out.append(pa.array([len(x) for x in found], pa.int64()))
                    if ids:
                        ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                        out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *found]))))
                    if digests:
                        out.append(pa.array([hashlib.sha256(",".join(map(decimals, x.tolist())).encode()).hexdigest() for x in found], pa.string()))
                        out.append(pa.array([hashlib.sha256(c.decode(x).encode()).hexdigest() for x in found], pa.string()))
                    yield pa.RecordBatch.from_arrays(out, names=[f.name for f in schema])
        finally:
            c.release()

    return docs.select(*kept, text).mapInArrow(work, schema)


def decoded(encodings: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and text, decoded from the array of ids; null ids: null."""
    kept = passing(keep, ["text"])
    schema = T.StructType([*(encodings.schema[c] for c in kept), T.StructField("text", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            out = [None if x.as_py() is None else c.decode(np.array(x.as_py(), dtype=np.int64)) for x in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(out, pa.string())], names=[f.name for f in schema])

    return encodings.select(*kept, ids).mapInArrow(work, schema)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encoded(docs, tokenizer_path(spark), ids=False, digests=True)
