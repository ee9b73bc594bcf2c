"""Byte-level BPE by a sentencepiece model that is serialised from a table of ranks.

Each byte is mapped to one character, so every token of the vocabulary is a piece of the model; a piece's score is its
negative rank, which makes sentencepiece merge in the order of the ranks. The model normalises nothing and adds nothing.
Texts are split by a pattern and each match is encoded on its own; a match that is a token as it stands is that token.
Decoding maps ids back to the bytes of their tokens.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructType

from vigil.llm.arrow_text import lean, slices

FIRST_CHAR = 0x4E00  # byte b stands as chr(FIRST_CHAR + b): letters that no normaliser or splitter treats specially
SLICE = 500_000  # bytes of text whose ids are held at a time
CACHE = 100_000  # matches whose ids a task remembers before it starts anew


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


PIECE_CHARS = "".join([chr(FIRST_CHAR + b) for b in range(256)])


def as_piece(token: bytes) -> str:
    return token.decode("latin-1").translate(PIECE_CHARS)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model; id 0 is the unknown piece, the token of the i-th smallest rank has id i + 1."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        model.pieces.add(piece=as_piece(token), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    trainer, normal = model.trainer_spec, model.normalizer_spec
    trainer.model_type, trainer.vocab_size, trainer.unk_id = pb.TrainerSpec.BPE, len(model.pieces), 0
    trainer.bos_id = trainer.eos_id = trainer.pad_id = -1
    normal.name = "identity"
    normal.add_dummy_prefix = normal.remove_extra_whitespaces = normal.escape_whitespaces = False
    return model.SerializeToString()


class Strings:
    """Byte strings by number; ``join`` concatenates those of an array of numbers without a loop over them."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def join(self, numbers: np.ndarray) -> bytes:
        return gathered(self.data, self.starts[numbers], self.sizes[numbers]).tobytes()


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices data[start:start + size], one after the other."""
    ends = np.cumsum(sizes)
    at = np.repeat(starts - (ends - sizes), sizes)
    at += np.arange(len(at))
    return data[at]


class Codec:
    """Encodes and decodes whole texts in one process.

    Matches are remembered within a ``with`` block, a task's, and forgotten at its end: the process stays for later tasks of
    other kinds, beside which they would lie in an executor's memory.
    """

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        self.by_piece = [-1, *sorted(self.ranks.values())]
        by_rank = {rank: token for token, rank in self.ranks.items()}
        table = [by_rank.get(rank, b"") for rank in range(max(by_rank) + 1)]
        self.tokens = Strings(table)
        self.decimals = Strings([b",%d" % rank for rank in range(len(table))])
        self.split = regex.compile(pattern).findall
        self._forget()

    def __enter__(self) -> Codec:
        return self

    def __exit__(self, *_error) -> None:
        self._forget()

    def _forget(self) -> None:
        self.known: defaultdict[str, int] = defaultdict()  # matches by number, in order of appearance
        self.known.default_factory = self.known.__len__
        self.ids = np.empty(0, np.int32)
        self.sizes = np.empty(0, np.int64)

    def _learn(self) -> None:
        """Appends the ids of the matches that were numbered since the last call."""
        new = list(islice(reversed(self.known), len(self.known) - len(self.sizes)))[::-1]
        ids: list = [self.ranks.get(m.encode()) for m in new]
        hard = [i for i, rank in enumerate(ids) if rank is None]
        rank = self.by_piece.__getitem__
        pieces = self.model.encode([as_piece(new[i].encode()) for i in hard], out_type=int, num_threads=1) if hard else []
        for i, found in zip(hard, pieces, strict=True):
            ids[i] = tuple(map(rank, found))
        ids = [(x,) if isinstance(x, int) else x for x in ids]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))])
        self.sizes = np.concatenate([self.sizes, sizes])

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null has none."""
        if len(self.known) > CACHE:
            self._forget()
        number = self.known.__getitem__
        split = (self.split(t) if t else [] for t in texts)  # the matches of one text at a time
        at = [np.fromiter(map(number, matches), np.int64, len(matches)) for matches in split]
        self._learn()
        starts = np.cumsum(self.sizes) - self.sizes
        return [gathered(self.ids, starts[x], self.sizes[x]) for x in at]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.tokens.join(ids)

    def listed(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return self.decimals.join(ids)[1:]


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encoded(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids", digest_col: str | None = None) -> DataFrame:
    """``docs`` with the array of token ids of each text; a null text has no tokens.

    ``vocabulary`` is the path of a rank file that stands on every machine. Whole texts are encoded, whatever their
    length; columns of ``docs`` named like ``ids_col`` are replaced. With ``digest_col`` the ids are decoded again in the
    same pass, and the column has the SHA-256 of the decoded bytes.
    """
    rows = docs.drop(ids_col, *([digest_col] if digest_col else []))
    schema = StructType(list(rows.schema)).add(ids_col, ArrayType(IntegerType()))
    if digest_col:
        schema = schema.add(digest_col, "string")

    def run(batches):
        with codec(vocabulary, pattern) as c:
            for whole in batches:
                for batch in slices(whole, text_col, SLICE):
                    ids = c.encode_all(batch.column(text_col).to_pylist())
                    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids), pa.int32()))
                    batch = batch.append_column(ids_col, lists)
                    if digest_col:
                        batch = batch.append_column(digest_col, pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids], pa.string()))
                    yield batch

    return rows.mapInArrow(lean(run), schema)


def decoded(rows: DataFrame, vocabulary: str, pattern: str, ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that its ids stand for; null ids give null."""
    rows = rows.drop(bytes_col)

    def run(batches):
        c = codec(vocabulary, pattern)
        for batch in batches:
            out = [None if ids is None else c.decode(np.array(ids, np.int64)) for ids in batch.column(ids_col).to_pylist()]
            yield batch.append_column(bytes_col, pa.array(out, pa.binary()))

    return rows.mapInArrow(lean(run), StructType(list(rows.schema)).add(bytes_col, "binary"))


def token_digest(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256 and decoded_sha256, encoded and decoded again in one pass.

    A null or empty text has no tokens; its digests are those of the empty string.
    """
    rows = docs.select(id_col, text_col)
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        sha = hashlib.sha256
        with codec(vocabulary, pattern) as c:
            for whole in batches:
                for batch in slices(whole, text_col, SLICE):
                    n, ids_sha, text_sha = [], [], []
                    for ids in c.encode_all(batch.column(text_col).to_pylist()):
                        n.append(len(ids))
                        ids_sha.append(sha(c.listed(ids)).hexdigest())
                        text_sha.append(sha(c.decode(ids)).hexdigest())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(id_col), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                        names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                    )

    return rows.mapInArrow(lean(run), schema)
