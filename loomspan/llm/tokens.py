"""Byte-level BPE with numpy, and token counts by a public library.

Shapes of input with a defined result: a null text counts as empty; an empty text has no tokens (and
decodes to no bytes); texts of any length are read whole, in runs of about a MB; ids may be null or
repeated and are given back as they are, one row out for each row in; of equal ranks in a piece the
leftmost pair merges first; an empty table gives no rows; other columns are ignored, whatever their
names are.
"""

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import SLICE, U, mix, texts

#: Characters of distinct pieces, and of their ids, that a worker keeps; beyond it starts anew. A run of texts may add a MB or so.
CACHE = 16 << 20
#: Pieces of more bytes go through a heap instead of a matrix, whose rounds times width grow with the square of the piece.
WIDE = 256
_NONE = np.int32(2**31 - 1)

# White space of Unicode; letters and numbers below U+0100.
_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LATIN_LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_LATIN_NUMBERS = r"0-9\xb2\xb3\xb9\xbc-\xbe"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a rank file (a base64 token and its rank on each line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PairTable:
    """Open-addressing hash table from a pair of token ids to the id that they merge into."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        left, right, to = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    to.append(rank)
        keys = (np.array(left, U) << U(32)) | np.array(right, U)
        self.mask = U((1 << max(4, (4 * len(keys)).bit_length())) - 1)
        self.keys = np.full(int(self.mask) + 1, 2**64 - 1, U)
        self.values = np.full(int(self.mask) + 1, _NONE, np.int32)
        todo, slot, values = keys, mix(keys) & self.mask, np.array(to, np.int32)
        while len(todo):
            free = self.keys[slot] == U(2**64 - 1)
            at, first = np.unique(slot[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.keys[at], self.values[at] = todo[chosen], values[chosen]
            rest = np.ones(len(todo), bool)
            rest[chosen] = False
            todo, values, slot = todo[rest], values[rest], (slot[rest] + U(1)) & self.mask

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(U) << U(32)) | right.astype(U)
        slot = mix(keys) & self.mask
        found = self.keys[slot]
        out = self.values[slot]
        miss = np.flatnonzero((found != keys) & (found != U(2**64 - 1)))
        out[(found != keys)] = _NONE
        while len(miss):
            slot[miss] = (slot[miss] + U(1)) & self.mask
            found = self.keys[slot[miss]]
            hit = found == keys[miss]
            out[miss[hit]] = self.values[slot[miss[hit]]]
            miss = miss[~hit & (found != U(2**64 - 1))]
        return out


class Bpe:
    """Encodes and decodes by a rank file, many pieces at once.

    Pieces of similar length share a matrix with a row each. In every round each row merges its
    leftmost pair of least rank; the row moves up by one place, only the two pairs at the merge are
    looked up anew, and rows without a pair leave the matrix.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.pairs = PairTable(ranks)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.tokens = {str(rank): token for token, rank in ranks.items()}
        self.split = regex.compile(pattern.replace(r"[^\s", rf"[^{_SPACES}").replace(r"\s", f"[{_SPACES}]").replace(r"\S", f"[^{_SPACES}]"))
        latin = pattern.replace(r"[^\s", rf"[^{_SPACES}").replace(r"\s", f"[{_SPACES}]").replace(r"\S", f"[^{_SPACES}]")
        latin = re.sub(r"\[\^([^]]*)\]", lambda m: "[^" + m[1].replace(r"\p{L}", _LATIN_LETTERS).replace(r"\p{N}", _LATIN_NUMBERS) + "]", latin)
        self.split_latin = re.compile(latin.replace(r"\p{L}", f"[{_LATIN_LETTERS}]").replace(r"\p{N}", f"[{_LATIN_NUMBERS}]"))
        self.known: dict[str, str] = {}
        self.held = 0

    def pieces(self, text: str, latin: bool) -> list[str]:
        """The matches of the pattern; `latin`: every character is below U+0100."""
        return (self.split_latin if latin else self.split).findall(text)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each non-empty piece."""
        out: list = [None] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = [whole]
            elif len(p) > WIDE:
                out[i] = self._long(p)
            else:
                groups.setdefault(max(4, 1 << (len(p) - 1).bit_length()) if len(p) > 16 else -(-len(p) // 4) * 4, []).append(i)
        for width, members in groups.items():
            for k in range(0, len(members), max(64, (1 << 19) // width)):
                part = members[k : k + max(64, (1 << 19) // width)]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> list[list[int]]:
        size = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        inside = np.arange(width) < size[:, None]
        ids = np.where(inside, self.single[raw], -1).astype(np.int32)
        rank = np.full((len(pieces), width), _NONE, np.int32)
        two = np.nonzero(inside[:, 1:])
        rank[two] = self.pairs(ids[two], ids[two[0], two[1] + 1])
        row = np.arange(len(pieces))
        out: list = [None] * len(pieces)
        places = np.arange(width)
        while len(row):
            at = rank.argmin(1)
            least = rank[np.arange(len(row)), at]
            done = least == _NONE
            if done.any():
                for r, line, n in zip(row[done].tolist(), ids[done].tolist(), size[done].tolist()):
                    out[r] = line[:n]
                go = ~done
                row, ids, rank, size, at, least = row[go], ids[go], rank[go], size[go], at[go], least[go]
                if not len(row):
                    break
            every = np.arange(len(row))
            ids[every, at] = least
            take = np.minimum(places + (places > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, take, 1)
            rank = np.take_along_axis(rank, take, 1)
            size = size - 1
            ids[every, size] = -1
            rank[every, size - 1] = _NONE
            rank[every, size] = _NONE
            some = np.flatnonzero(at + 1 < size)
            rank[some, at[some]] = self.pairs(ids[some, at[some]], ids[some, at[some] + 1])
            some = np.flatnonzero(at > 0)
            rank[some, at[some] - 1] = self.pairs(ids[some, at[some] - 1], ids[some, at[some]])
        return out

    def _long(self, piece: bytes) -> list[int]:
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        parts = [piece[k : k + 1] for k in range(len(piece))]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        first = self.pairs(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, k) for k, r in enumerate(first) if r != _NONE]
        heapq.heapify(heap)
        now = dict(enumerate(first))
        while heap:
            r, k = heapq.heappop(heap)
            if now.get(k) != r or r == _NONE:
                continue
            j = after[k]
            ids[k], parts[k] = r, parts[k] + parts[j]
            after[k] = after[j]
            now.pop(j, None)
            if after[j] < len(ids):
                before[after[j]] = k
                now[k] = self.ranks.get(parts[k] + parts[after[k]], int(_NONE))
                heapq.heappush(heap, (now[k], k))
            else:
                now.pop(k, None)
            if before[k] >= 0:
                b = before[k]
                now[b] = self.ranks.get(parts[b] + parts[k], int(_NONE))
                heapq.heappush(heap, (now[b], b))
        out, k = [], 0
        while k < len(ids):
            out.append(ids[k])
            k = after[k]
        return out

    def encoded(self, found: list[list[str]]) -> list[str]:
        """Decimal ids joined by commas, for each list of pieces."""
        if self.held > CACHE:
            self.known.clear()
            self.held = 0
        fresh = list(set().union(*found) - self.known.keys())
        for p, ids in zip(fresh, self.merge([p.encode() for p in fresh])):
            self.known[p] = ids = ",".join(map(str, ids))
            self.held += len(p) + len(ids)
        return [",".join(map(self.known.__getitem__, pieces)) for pieces in found]

    def decoded(self, ids: str) -> bytes:
        """The bytes of decimal ids joined by commas."""
        return b"".join(map(self.tokens.__getitem__, ids.split(","))) if ids else b""


@lru_cache(2)
def loaded(path: str, pattern: str) -> Bpe:
    """One encoder a worker and rank file."""
    return Bpe(read_ranks(path), pattern)


def encode_texts(path: str, pattern: str, rows: pa.RecordBatch, text_col: str) -> Iterator[tuple[int, int, list[str], list[str]]]:
    """For runs of rows of about a MB: first row, row after the last, their texts and their ids."""
    bpe = loaded(path, pattern)
    data, offsets = texts(rows.column(text_col))
    i = 0
    while i < rows.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        found, whole = [], []
        for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist()):
            part = data[a:b]
            text = part.tobytes().decode()
            whole.append(text)
            found.append(bpe.pieces(text, not len(part) or part.max() <= 0xC3))
        yield i, j, whole, bpe.encoded(found)
        i = j


def shipped(df: DataFrame, path: str) -> Callable[[], str]:
    """Sends a vocabulary file along with the tasks; the call gives its place on the executor."""
    df.sparkSession.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[-1]
    return lambda: SparkFiles.get(name)


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's ids and the text that they decode to: `id_col`, `ids array<int>`, `decoded binary`."""
    place = shipped(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, coded in encode_texts(place(), pattern, batch, text_col):
                ids = [np.array(x.split(","), np.int32) if x else np.zeros(0, np.int32) for x in coded]
                yield pa.RecordBatch.from_arrays([batch.column(id_col).slice(i, j - i).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([loaded(place(), pattern).decoded(x) for x in coded], pa.binary())], [id_col, "ids", "decoded"])

    return _two(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` long, ids array<int>, decoded binary")


def bpe_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col, n_tokens, ids_sha256, decoded_sha256` of the round trip, without keeping ids or texts."""
    place = shipped(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, coded in encode_texts(place(), pattern, batch, text_col):
                bpe = loaded(place(), pattern)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(id_col).slice(i, j - i).cast(pa.int64()),
                        pa.array([x.count(",") + 1 if x else 0 for x in coded], pa.int64()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in coded], pa.string()),
                        pa.array([hashlib.sha256(bpe.decoded(x)).hexdigest() for x in coded], pa.string()),
                    ],
                    [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return _two(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _two(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))


#: Texts of more bytes are counted in parts, each of about so many bytes.
LONG = 1 << 16
_SAFE = re.compile(rb"[A-Za-z0-9] (?=[A-Za-z0-9])")


def safe_parts(text: bytes, size: int = LONG) -> list[bytes]:
    """The text cut at single spaces between two ASCII letters or digits; the space at a cut goes.

    A piece of the vocabulary has its word mark in front, and the encoder puts one before every
    text, so the parts' tokens are the text's. Without such a place a part stays long.
    """
    out, start = [], 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if not cut:
            break
        out.append(text[start : cut.end() - 1])
        start = cut.end()
    out.append(text[start:])
    return out


@lru_cache(2)
def _pieces_model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if any("▁" in model.id_to_piece(k).lstrip("▁") for k in range(model.get_piece_size())):
        raise ValueError("the vocabulary has pieces across words: texts can't be cut at spaces")
    return model


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col, n_bytes, n_tokens, over_limit` by a sentencepiece model.

    Texts go to the library in lists of about a MB, whatever their number; long texts go in parts,
    and only lengths come back.
    """
    place = shipped(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _pieces_model(place())
        for batch in batches:
            data, offsets = texts(batch.column(text_col))
            size = np.diff(offsets)
            count = np.zeros(batch.num_rows, np.int64)
            parts, owner, held = [], [], 0
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                for part in safe_parts(data[a:b].tobytes()):
                    parts.append(part.decode())
                    owner.append(k)
                    held += len(part)
                    if held >= SLICE:
                        np.add.at(count, owner, [len(x) for x in model.encode(parts, num_threads=1)])
                        parts, owner, held = [], [], 0
            if parts:
                np.add.at(count, owner, [len(x) for x in model.encode(parts, num_threads=1)])
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(size), pa.array(count), pa.array(count > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return _two(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` long, n_bytes long, n_tokens long, over_limit boolean")


def op3_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
