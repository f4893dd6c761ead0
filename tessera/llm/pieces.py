"""SentencePiece encoding by forward filtering and backward sampling, and decoding without loss."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.text import mixed, sliced

#: Place of the public model file; only the driver reads it.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a literal SPACE character of the text; no UTF-8 text holds a lone surrogate.
LITERAL = "\udfff"
#: A run of spaces and the word after it: no piece goes on behind a word into the next spaces.
UNIT = re.compile(" +[^ ]*")
#: Path weights below this are scaled up, so that words of any length keep their shares.
TINY = 1e-150
#: Weight of a character that no piece covers; its bytes are the pieces.
FALLBACK = np.exp(-10.0)
#: Code points whose lattices are built side by side.
BATCH_CHARS = 200_000
SEED = 42

SLOT_BITS = 21
STEP = np.uint64(0x9E3779B97F4A7C15)
TURN = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Vocabulary:
    """Pieces of a model as arrays: about two megabytes whatever the data."""

    surfaces: tuple[bytes, ...]
    weights: np.ndarray
    byte_ids: np.ndarray
    keys: np.ndarray
    values: np.ndarray
    longest: int

    @staticmethod
    def load(path: str = MODEL_PATH, theta: float = 1.0) -> Vocabulary:
        """Read a model file.  A byte-pair model has ranks, no probabilities: the weight of a piece is its rank's, by Zipf, to the power theta."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        surfaces, byte_ids, normal = [b""] * n, np.zeros(256, np.int32), {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                surfaces[i], byte_ids[value] = bytes([value]), i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                surfaces[i], normal[piece] = piece.replace(SPACE, " ").encode(), i
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in normal):
            raise ValueError("the model has pieces that go on behind a word; units would cut them")
        first = min(normal.values())
        weights = (np.maximum(np.arange(n) - first, 0) + 1.0) ** -theta
        prefixes = {p[:k]: -1 for p in normal for k in range(1, len(p) + 1)} | normal
        known = {"": 0}
        keys, values = np.zeros(1 << SLOT_BITS, np.uint64), np.full(1 << SLOT_BITS, -2, np.int32)
        for prefix, value in sorted(prefixes.items(), key=lambda x: len(x[0])):
            key = known[prefix] = _advance_one(known[prefix[:-1]], ord(prefix[-1]))
            slot = key >> (64 - SLOT_BITS)
            while values[slot] != -2:
                slot = (slot + 1) % (1 << SLOT_BITS)
            keys[slot], values[slot] = key, value
        return Vocabulary(tuple(surfaces), weights, byte_ids, keys, values, max(map(len, normal)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece id, -1 for a mere prefix of pieces, or -2, of each prefix key."""
        slot = (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        out = np.where(self.keys[slot] == keys, self.values[slot], -2)
        seek = np.flatnonzero((self.keys[slot] != keys) & (self.values[slot] != -2))
        while len(seek):
            slot[seek] = (slot[seek] + 1) % (1 << SLOT_BITS)
            out[seek] = np.where(self.keys[slot[seek]] == keys[seek], self.values[slot[seek]], -2)
            seek = seek[(self.keys[slot[seek]] != keys[seek]) & (self.values[slot[seek]] != -2)]
        return out


def _advance(keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
    x = (keys ^ codes) * STEP
    return (x ^ (x >> np.uint64(29))) * TURN


def _advance_one(key: int, code: int) -> int:
    full = (1 << 64) - 1
    x = ((key ^ code) * int(STEP)) & full
    return ((x ^ (x >> 29)) * int(TURN)) & full


class _Numbers(dict):
    """Words in order of appearance, numbered from 0."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def units(text: str) -> list[str]:
    """The words of a text, each without the space before it but with further ones; joined by spaces they are the text."""
    if "  " not in text and not text.endswith(" "):
        return text.split(" ")
    return [u[1:] for u in UNIT.findall(" " + text)]


class Sampler:
    """Encodes batches of texts; words that repeat in a batch share one lattice."""

    def __init__(self, vocabulary: Vocabulary, seed: int = SEED) -> None:
        self.v, self.seed = vocabulary, seed

    def _lattices(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(last slot of each word, its length, cumulated shares by slot and piece length, piece ids)."""
        v, most = self.v, self.v.longest
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        zero = most + np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))  # slot before a word's first character
        n = most + int((lengths + 1).sum())
        raw = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes, end = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        chars = np.repeat(zero + 1 - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(len(raw))
        codes[chars] = raw
        end[chars] = np.repeat(zero + lengths, lengths)
        weight, ids = np.zeros((n, most), np.float32), np.full((n, most), -1, np.int32)
        start, keys = chars, np.zeros(len(chars), np.uint64)
        for k in range(most):
            last = start + k
            keys = _advance(keys, codes[last])
            found = v.find(keys)
            has = found >= 0
            ids[last[has], k] = found[has]
            weight[last[has], k] = v.weights[found[has]]
            if k == 0:
                lone = last[~has]
                code = codes[lone].astype(np.int64)
                code[code == ord(LITERAL)] = ord(SPACE)
                ids[lone, 0] = np.where(code < 128, v.byte_ids[np.minimum(code, 127)], len(v.surfaces) + code)
                weight[lone, 0] = FALLBACK
            go = (found > -2) & (last < end[start])
            start, keys = start[go], keys[go]
            if not len(start):
                break
        alpha = np.zeros(n)
        alpha[zero] = 1.0
        order = np.argsort(-lengths, kind="stable")
        # Cumulated shares of the piece lengths of each slot; lengths that cannot end there stay above every draw.
        shares = np.full((n, most), 2.0, np.float32)
        sizes, back = lengths[order], np.arange(1, most + 1)
        fewer = -sizes
        for t in range(1, int(sizes[0]) + 1 if len(sizes) else 1):
            rows = zero[order[: np.searchsorted(fewer, -t, side="right")]] + t
            m = min(t, most)
            sums = np.cumsum(weight[rows, :m] * alpha[rows[:, None] - back[:m]], axis=1)
            total = sums[:, -1]
            alpha[rows] = total
            shares[rows, :m] = sums / total[:, None]
            tiny = total < TINY
            if tiny.any():  # only the sums that later slots look back at
                alpha[rows[tiny, None] - back[:m] + 1] /= total[tiny, None]
        return zero + lengths, lengths, shares, ids

    def encode(self, batch: list[str], keys: list[int]) -> list[np.ndarray]:
        """Piece ids of each text; the draws depend on the seed, the text's key and the place in the text only."""
        known = _Numbers()
        places, counts = [], []
        for text in batch:
            words = units(text.replace(SPACE, LITERAL))
            places.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
            counts.append(len(words))
        last, lengths, shares, ids = self._lattices([SPACE + w.replace(" ", SPACE) for w in known])
        word = np.concatenate(places)
        owner = np.repeat(np.arange(len(batch)), counts)
        ends = np.cumsum(lengths[word])
        text_start = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)[:-1]))]
        seeds = mixed(np.array([k & ((1 << 64) - 1) for k in keys], np.uint64) + np.array([self.seed], np.uint64) * STEP)[owner]
        slot, left, place = last[word], lengths[word].copy(), ends - text_start[owner]
        at, live, steps, taken = np.zeros(len(word), np.int64), np.arange(len(word)), [], []
        while len(live):
            s = slot[live]
            u = (mixed(seeds[live] + place[live].astype(np.uint64) * TURN) >> np.uint64(11)).astype(np.float64)* 2.0**-53
            size = np.count_nonzero(shares[s] <= np.minimum(u, 1 - 2.0**-24).astype(np.float32)[:, None], axis=1) + 1
            steps.append(live)
            taken.append(ids[s, size - 1])
            slot[live] -= size
            place[live] -= size
            left[live] -= size
            at[live] += 1
            live = live[left[live] > 0]
        total = np.cumsum(at)
        out = np.empty(int(total[-1]) if len(total) else 0, np.int32)
        for k, (who, piece) in enumerate(zip(steps, taken)):
            out[total[who] - 1 - k] = piece
        bounds = total[np.cumsum(counts) - 1][:-1]
        return [self._bytes(x) for x in np.split(out, bounds)]

    def _bytes(self, ids: np.ndarray) -> np.ndarray:
        """Replace marks of characters outside the vocabulary by the pieces of their bytes."""
        n = len(self.v.surfaces)
        if not (ids >= n).any():
            return ids
        return np.array([y for x in ids.tolist() for y in ([x] if x < n else self.v.byte_ids[list(chr(x - n).encode())].tolist())], np.int32)


def decode(surfaces: tuple[bytes, ...], ids: list[int]) -> bytes:
    """UTF-8 text of piece ids: surfaces side by side without the space put before the text."""
    return b"".join(map(surfaces.__getitem__, ids))[1:]


ENCODED = "doc_id long, text_key long, piece_ids array<int>, n_pieces long"


def _encoder(vocabulary: Vocabulary, seed: int):
    def run(batches):
        sampler = Sampler(vocabulary, seed)
        kind = pa.list_(pa.int32())
        for batch in sliced(batches):
            column = batch.column(2).to_pylist()
            keys = [k if d is None else d for d, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            at = 0
            while at < len(column):
                to, size = at, 0
                while to < len(column) and (to == at or size + len(column[to] or "") <= BATCH_CHARS):
                    size += len(column[to] or "")
                    to += 1
                have = [i for i in range(at, to) if column[i] is not None]
                done = dict(zip(have, sampler.encode([column[i] for i in have], [keys[i] for i in have]))) if have else {}
                rows = [done.get(i) for i in range(at, to)]
                flat = np.concatenate([r for r in rows if r is not None]) if done else np.empty(0, np.int32)
                sizes = np.array([0 if r is None else len(r) for r in rows])
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), mask=np.array([r is None for r in rows] + [False]))
                lists = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())).cast(kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), lists, pa.array(sizes, pa.int64())], ["doc_id", "text_key", "piece_ids", "n_pieces"])
                at = to

    return run


def _decoder(surfaces: tuple[bytes, ...]):
    def run(batches):
        for batch in sliced(batches):
            out = [None if x is None else decode(surfaces, x.tolist()) for x in (None if not y.is_valid else y.values.to_numpy(zero_copy_only=False) for y in batch.column("piece_ids"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary()).cast(pa.string())], [*batch.schema.names, "text"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def encode_pieces(docs: DataFrame, vocabulary: Vocabulary, seed: int = SEED) -> DataFrame:
    """(doc_id, text_key, piece_ids, n_pieces): one sampled segmentation of each whole text.

    Words with the spaces before them are lattices of all pieces that fit, whole however long; no piece of
    the model leaves such a unit, so their product is the lattice of the text.  Forward sums
    of path weights filter them, and pieces are drawn from the end backwards, by a
    counter generator on (seed, doc_id, place).  So a row's segmentation depends on its
    own text and id only, not on partitions or runs.  Characters outside the
    vocabulary fall back to bytes; nothing is normalised, so decoding gives the text back.

    A null text has null piece_ids and n_pieces 0; an empty one is the lone space piece.
    A null doc_id draws by the text's hash.  Repeated rows repeat their results; other
    columns are ignored; an empty table gives no rows.
    """
    return _keyed(docs).mapInArrow(_encoder(vocabulary, seed), ENCODED)


def decode_pieces(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """All columns of ``encoded`` and text, decoded from piece_ids; null ids give null."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(_decoder(vocabulary.surfaces), f"{schema}, text string")


def encode_and_check(docs: DataFrame, path: str = MODEL_PATH, seed: int = SEED) -> DataFrame:
    """doc_id, n_pieces, piece_ids, decoded_sha256 and lossless: whether the decoded text has the hash of the input."""
    vocabulary = Vocabulary.load(path)
    encode, decode = _encoder(vocabulary, seed), _decoder(vocabulary.surfaces)
    decoded = _keyed(docs).mapInArrow(lambda batches: decode(encode(batches)), f"{ENCODED}, text string")  # one Python worker a task does both
    return decoded.select("doc_id", "n_pieces", "piece_ids", F.sha2("text", 256).alias("decoded_sha256"), (F.xxhash64("text") == F.col("text_key")).alias("lossless"))


def op1_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_check(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_piece_sampling": op1_piece_sampling}
ORACLE_SQL: dict[str, str] = {}
