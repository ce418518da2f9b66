"""SentencePiece encoding and decoding: sampled segmentations by forward filtering and
backward sampling.

A text's lattice has an arc for every vocabulary piece that matches at a place, and byte pieces
for a character without a piece of its own. A segmentation has the product of its pieces'
weights; the forward pass sums weights up to each position, the backward pass draws pieces from
the end with the exact conditional probabilities. Draws come from a counter-based hash of the
row key, the place of the word in its text and the step, so a row's segmentation is the same in
any partition, batch or rerun.

Between two characters that stand side by side in no piece no arc can cross, as before a word,
around a line end and at most punctuation. There the lattice factorises into units: the
forward pass runs once for each distinct unit of a batch, all units in lock step, and the
backward pass runs over all occurrences in lock step. Spaces are U+2581 in pieces; a
U+2581 of the text itself goes through byte pieces, nothing is normalised, and decoding gives
back every text exactly.

Weights: a unigram model's scores, or -log(rank + 10) for a merge-ranked model, times SHARPNESS.

Defined results: null text gives null pieces and decodes to null; empty text gives no pieces; a
null key counts as a key of its own; repeated rows get equal segmentations; extra columns pass
through, one named piece_ids or decoded is replaced; very long texts are cut up whole; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, mix64, small_batches, table, tidy, unused

SHARPNESS = 1.0
SEED = 20_240_607
CHARS = 1 << 19  # characters of one lock-step batch
CACHE_SLOTS = 1 << 18
_CODE = 1 << 24  # arcs from here on are characters to be spelled in bytes
_FOREIGN = 0x110000  # stands for a U+2581 of the text itself


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_vocabulary(path: str) -> tuple[list[str], list[float], list[int]]:
    """Pieces by id ("" for those that match no text), scores, and the ids of bytes 0 to 255."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    size = m.get_piece_size()
    pieces, bytes_ = [""] * size, [-1] * 256
    for i in range(size):
        if m.is_byte(i):
            bytes_[int(m.id_to_piece(i)[1:-1], 16)] = i
        elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
            pieces[i] = m.id_to_piece(i)
    if min(bytes_) < 0:
        raise ValueError("the model has no byte pieces, so not every text could be encoded")
    return pieces, [m.get_score(i) for i in range(size)], bytes_


class Lattice:
    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], sharpness: float = SHARPNESS) -> None:
        used = [i for i, p in enumerate(pieces) if p]
        ranked = all(scores[i] == int(scores[i]) for i in used)
        weight = {i: sharpness * (-np.log(10 - scores[i]) if ranked else scores[i]) for i in used}
        self.width = max(len(pieces[i]) for i in used)
        self.byte_ids = np.array(byte_ids, np.int64)
        self.byte_weight = np.float32(sharpness * -np.log(10 + len(pieces)))
        trie: dict[tuple[int, int], int] = {}
        self.piece_at, count = {}, 1
        for i in used:
            node = 0
            for ch in pieces[i]:
                key = (node, ord(ch))
                if key not in trie:
                    trie[key] = count
                    count += 1
                node = trie[key]
            self.piece_at.setdefault(node, i)
        keys = sorted(trie)
        self.keys = np.array([(a << 21) | c for a, c in keys], np.int64)
        self.to = np.array([trie[k] for k in keys], np.int64)
        self.node_piece = np.full(count, -1, np.int32)
        self.node_weight = np.full(count, -np.inf, np.float32)
        for node, i in self.piece_at.items():
            self.node_piece[node], self.node_weight[node] = i, weight[i]
        empty = np.zeros((0, self.width))
        self.cache = (np.zeros(0, U), np.zeros(0, np.int64), empty.astype(np.float32), empty.astype(np.int32))
        self.first = np.zeros(_FOREIGN + 1, np.int32)  # node after one character, 0 for none
        for (a, c), node in trie.items():
            if a == 0:
                self.first[c] = node
        inner = sorted({ch for i in used if len(pieces[i]) > 1 for ch in pieces[i]})
        self.kind = np.zeros(_FOREIGN + 1, np.int32)  # 0: in no piece of two characters or more
        self.kind[[ord(ch) for ch in inner]] = np.arange(1, len(inner) + 1)
        self.touch = np.zeros((len(inner) + 1, len(inner) + 1), bool)
        for i in used:
            k = self.kind[[ord(ch) for ch in pieces[i]]]
            self.touch[k[:-1], k[1:]] = True
        self.touch[0] = self.touch[:, 0] = False
        self.touch = self.touch.ravel()
        self.kinds = len(inner) + 1
        self.bytes_of = [p.replace("▁", " ").encode() if p else b"" for p in pieces]
        for b, i in enumerate(byte_ids):
            self.bytes_of[i] = bytes([b])
        self.byte_size = np.array([len(x) for x in self.bytes_of], np.int64)
        self.byte_start = np.cumsum(self.byte_size) - self.byte_size
        self.byte_flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def _filter(self, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward pass over units laid end to end. Slots: size + 1 for each unit. Returns each
        unit's first slot, and by slot the cumulative probabilities and the arcs of piece
        lengths 1 to width that end there."""
        k, w = len(size), self.width
        off = np.cumsum(size + 1) - (size + 1)
        unit = np.repeat(np.arange(k), size)
        inner = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        slot = off[unit] + inner  # the slot before each character
        left = size[unit] - inner
        slots = int((size + 1).sum())
        weight = np.full((slots, w), -np.inf, np.float32)
        arc = np.zeros((slots, w), np.int32)
        at, node = np.arange(len(flat)), self.first[flat].astype(np.int64)
        alone = self.node_piece[node] < 0
        spelled = flat[alone]
        true = np.where(spelled == _FOREIGN, 0x2581, spelled)
        n_bytes = 1 + (true > 0x7F) + (true > 0x7FF) + (true > 0xFFFF)
        weight[slot[alone] + 1, 0] = self.byte_weight * n_bytes
        arc[slot[alone] + 1, 0] = np.where(true < 128, self.byte_ids[np.minimum(true, 127)], _CODE + true)
        for n in range(1, w + 1):
            live = node > 0
            at, node = at[live], node[live]
            hit = self.node_piece[node] >= 0
            end = slot[at[hit]] + n
            weight[end, n - 1] = self.node_weight[node[hit]]
            arc[end, n - 1] = self.node_piece[node[hit]]
            more = left[at] > n
            at, node = at[more], node[more]
            key = (node << 21) | flat[at + n]
            to = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            node = np.where(self.keys[to] == key, self.to[to], 0)
        alpha = np.zeros(slots + w, np.float32)  # padded in front by w
        long_first = np.argsort(-size, kind="stable")
        ordered = size[long_first]
        back = w - np.arange(1, w + 1)
        for j in range(1, int(size.max(initial=0)) + 1):
            lanes = long_first[: int(np.searchsorted(-ordered, -j, side="right"))]
            s = off[lanes] + j
            n = min(j, w)  # no piece is longer than what stands before
            a = alpha[s[:, None] + back[:n]] + weight[s, :n]
            top = a.max(axis=1)
            e = np.exp(a - top[:, None])
            sums = np.cumsum(e, axis=1)
            total = sums[:, -1]
            alpha[s + w] = top + np.log(total)
            weight[s, :n] = sums / total[:, None]  # ends at exactly 1, above every draw
            weight[s, n:] = 2
        return off, weight, arc

    def _filtered(self, h: np.ndarray, c: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The forward pass for units with hashes h. Units of the first batches, the most frequent
        ones among them, are remembered up to CACHE_SLOTS slots; what is found doesn't differ."""
        known, known_off, cum, arc = self.cache
        at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
        hit = known[at] == h if len(known) else np.zeros(len(h), bool)
        off = np.zeros(len(h), np.int64)
        off[hit] = known_off[at[hit]]
        if (new := ~hit).any():
            b, n = begin[new], size[new]
            pick = np.repeat(b - (np.cumsum(n) - n), n) + np.arange(n.sum())
            own, more_cum, more_arc = self._filter(c[pick], n)
            off[new] = len(cum) + own
            full = len(cum) + len(more_cum) > CACHE_SLOTS
            cum, arc = np.concatenate([cum, more_cum]), np.concatenate([arc, more_arc])
            if not full:
                both = np.concatenate([known, h[new]])
                order = np.argsort(both)
                self.cache = (both[order], np.concatenate([known_off, off[new]])[order], cum, arc)
        return off, cum, arc

    def _sample(self, keys: np.ndarray, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Piece ids of each text (arrays of code points), keyed by uint64."""
        lengths = np.array([len(t) for t in texts], np.int64)
        c = np.concatenate(texts).astype(np.int64)
        c = np.where(c == 0x2581, _FOREIGN, np.where(c == 32, 0x2581, c))
        start = np.zeros(len(c), bool)
        start[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        kind = self.kind[c]
        start[1:] |= ~self.touch[kind[:-1] * self.kinds + kind[1:]]
        begin = np.flatnonzero(start)
        size = np.diff(np.append(begin, len(c)))
        doc = np.repeat(np.arange(len(texts)), lengths)[begin]
        h = self._unit_hash(c, begin, size)
        distinct, at, unit = np.unique(h, return_index=True, return_inverse=True)
        off, cum, arc = self._filtered(distinct, c, begin[at], size[at])

        first_unit = np.searchsorted(doc, np.arange(len(texts)))
        nth = np.arange(len(begin)) - first_unit[doc]
        base = mix64(keys[doc] ^ mix64(nth.astype(U) + U(SEED)))
        origin = off[unit]
        s = origin + size
        lanes = np.arange(len(begin))
        count = np.zeros(len(begin), np.int64)
        steps = []
        t = 0
        while len(lanes):
            draw = (mix64(base[lanes] + U((t + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> U(40)).astype(np.float32) * np.float32(2**-24)
            own = s[lanes]
            k = (cum[own] <= draw[:, None]).sum(axis=1)
            steps.append((lanes, arc[own, k]))
            s[lanes] = own - k - 1
            count[lanes] += 1
            lanes = lanes[s[lanes] > origin[lanes]]
            t += 1
        place = np.cumsum(count)  # one past each unit's last piece
        out = np.zeros(int(count.sum()), np.int64)
        for t, (lanes, ids) in enumerate(steps):
            out[place[lanes] - 1 - t] = ids
        per_doc = np.bincount(doc, count, len(texts)).astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), per_doc)
        if (code := out >= _CODE).any():
            out, owner = self._spell(out, owner, code)
            per_doc = np.bincount(owner, minlength=len(texts))
        return np.split(out.astype(np.int32), np.cumsum(per_doc)[:-1])

    @staticmethod
    def _unit_hash(c: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        inner = np.arange(len(c)) - np.repeat(begin, size)
        mixed = mix64((c.astype(U) << U(32)) + inner.astype(U) + U(1))
        return mix64(np.add.reduceat(mixed, begin) + size.astype(U)) if len(begin) else np.zeros(0, U)

    def _spell(self, out: np.ndarray, owner: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece, as the byte pieces of their UTF-8 form."""
        ch = np.where(code, out - _CODE, 0)
        n = np.where(code, 1 + (ch > 0x7F) + (ch > 0x7FF) + (ch > 0xFFFF), 1)
        src = np.repeat(np.arange(len(out)), n)
        nth = np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n)
        total, x = n[src], ch[src]
        low = (x >> (6 * (total - 1 - nth))) & np.where(nth == 0, (1 << np.maximum(7 - total, 0)) - 1, 63)
        head = np.where(nth == 0, np.array([0, 0, 0xC0, 0xE0, 0xF0])[total], 0x80)
        return np.where(code[src], self.byte_ids[np.where(code[src], head | low, 0)], out[src]), owner[src]

    def encode(self, keys: np.ndarray, texts: list[str | None]) -> list[np.ndarray | None]:
        out: list[np.ndarray | None] = [None] * len(texts)
        held: list[int] = []
        chars: list[np.ndarray] = []
        total = 0

        def flush() -> None:
            for i, ids in zip(held, self._sample(keys[np.array(held)], chars), strict=True):
                out[i] = ids
            held.clear()
            chars.clear()

        for i, t in enumerate(texts):
            if t is None:
                continue
            if not t:
                out[i] = np.zeros(0, np.int32)
                continue
            held.append(i)
            chars.append(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32))
            total += len(t)
            if total >= CHARS:
                flush()
                total = 0
        if held:
            flush()
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def decode_lists(self, lists: pa.ListArray) -> pa.Array:
        """Decoded strings of a whole column."""
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        size = np.diff(lists.offsets.to_numpy())
        if lists.null_count:
            size = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, size)
        n = self.byte_size[flat]
        ends = np.cumsum(n)
        at = np.repeat(self.byte_start[flat] - (ends - n), n) + np.arange(int(n.sum()))
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(size)])]
        data = pa.py_buffer(self.byte_flat[at].tobytes())
        out = pa.Array.from_buffers(pa.large_string(), len(lists), [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), data])
        out.validate(full=True)
        out = out.cast(pa.string())
        return pc.if_else(lists.is_null(), pa.scalar(None, pa.string()), out) if lists.null_count else out


_lattices: dict[str, Lattice] = {}


def _lattice(shared, key: str) -> Lattice:
    if key not in _lattices:
        _lattices.clear()
        _lattices[key] = Lattice(*shared.value)
    return _lattices[key]


def _lists(rows: list[np.ndarray | None]) -> pa.ListArray:
    ends = np.cumsum([0, *(0 if r is None else len(r) for r in rows)])
    flat = np.concatenate([r for r in rows if r is not None] or [np.zeros(0, np.int32)])
    mask = pa.array([r is None for r in rows], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()), mask=mask)


class PieceCodec:
    """Encoding and decoding columns; the vocabulary is broadcast once and each Python worker
    builds the lattice once. both() does the two in one worker."""

    def __init__(self, spark: SparkSession, path: str | None = None, sharpness: float = SHARPNESS) -> None:
        small_batches(spark)
        vocabulary = load_vocabulary(path or default_model_path())
        shared = spark.sparkContext.broadcast((*vocabulary, sharpness))
        name = f"{path}|{sharpness}"

        @F.arrow_udf("array<int>")
        def encode(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            lattice = _lattice(shared, name)
            for key, text in parts:
                k = mix64(key.fill_null(-(2**62)).to_numpy(zero_copy_only=False).astype(np.int64).view(U))
                yield _lists(lattice.encode(k, text.to_pylist()))
            tidy()

        @F.arrow_udf("string")
        def decode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            lattice = _lattice(shared, name)
            for ids in parts:
                yield lattice.decode_lists(ids)

        @F.arrow_udf("piece_ids array<int>, decoded string")
        def both(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            lattice = _lattice(shared, name)
            for key, text in parts:
                k = mix64(key.fill_null(-(2**62)).to_numpy(zero_copy_only=False).astype(np.int64).view(U))
                ids = _lists(lattice.encode(k, text.to_pylist()))
                yield pa.StructArray.from_arrays([ids, lattice.decode_lists(ids)], ["piece_ids", "decoded"])
            tidy()

        self._encode, self._decode, self._both = encode, decode, both

    def pieces(self, key: Column, text: Column) -> Column:
        return self._encode(key.cast("long"), text.cast("string"))

    def text(self, piece_ids: Column) -> Column:
        return self._decode(piece_ids)

    def both(self, key: Column, text: Column) -> Column:
        """Struct of piece_ids and `decoded`, the text that these ids spell."""
        return self._both(key.cast("long"), text.cast("string"))


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with piece_ids (sampled, seeded by doc_id) and `decoded`, the text they spell."""
    codec = PieceCodec(docs.sparkSession, path)
    both = unused(docs, "encoded")
    got = docs.withColumn(both, codec.both(F.col("doc_id"), F.col("text")))
    return got.withColumns({c: F.col(f"{both}.{c}") for c in ("piece_ids", "decoded")}).drop(both)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        F.when(F.col("piece_ids").isNotNull(), F.xxhash64("piece_ids")).alias("pieces_hash"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )
