"""SentencePiece encoding and decoding with seeded merge-dropout.

Encoding follows merge-type (BPE) models: the characters of a text are joined pair by pair
from an agenda ordered by the merged piece's score, then by place. Under dropout each
candidate merge is skipped where a keyed hash of its place and piece falls below the rate,
so that a word gets varied segmentations; characters without a piece fall back to bytes.

A merge never crosses a space that follows another character, nor a line end, so that
words are encoded one by one. Each occurrence of a word has a hash key of its own, from
(seed, doc_id, copy, place in the text): results don't depend on partitioning. A word's
segmentation without a skip is worked out once and kept, in a cache of bounded size, with the
merges that were made for it. Skipping a merge that is never made changes nothing, so that
only an occurrence that skips one of those is segmented anew.

Pieces decode to their bytes, so any segmentation decodes to the text, also one that holds
the model's space mark itself: the mark as a character has no piece here and goes to bytes.
"""

from __future__ import annotations

import heapq
import re
from importlib.util import find_spec
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafstrata.llm.common import give_back, pick, table

MARK = "▁"
DROPOUT, SEED = 0.1, 7
#: Words whose segmentation a task keeps; beyond, the cache starts anew. Only words of up to SHORT characters are kept.
CACHE = 400_000
_WORD = re.compile(r" *[^ \n]+|\n| +")
_M64 = (1 << 64) - 1


def default_model() -> str:
    """The path of the public merge-type model, where its package is installed."""
    if not find_spec("public_tokenizers"):
        raise FileNotFoundError("no tokenizer package is installed; give the path of a SentencePiece BPE model")
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceTable:
    """A BPE model's pieces with spaces for the space mark: ids, scores and bytes of each."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path or default_model())
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.bytes: list[bytes] = []
        self.byte_ids = [sp.unk_id()] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.scores.append(sp.get_score(i))
            if sp.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i):
                self.bytes.append(b"")
            else:
                self.ids[piece.replace(MARK, " ")] = i
                self.bytes.append(piece.replace(MARK, " ").encode())
        if sp.unk_id() in self.byte_ids:
            raise ValueError("the model has no byte fallback: it can't decode all texts losslessly")
        crossing = [p for p in self.ids if re.search(r"[^ ] |\n", p)]
        if crossing:
            raise ValueError(f"pieces cross words, such as {crossing[0]!r}")
        # what the agenda of many words at once looks up: characters to ids, and pairs of pieces to the merged piece
        chars = sorted((ord(p), i) for p, i in self.ids.items() if len(p) == 1)
        self.char_codes, self.char_ids = (np.array(x, np.int64) for x in zip(*chars, strict=True))
        size = len(self.scores)
        pairs = sorted((self.ids[p[:k]] * size + self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)
        self.by_rank = np.lexsort((np.arange(size), -np.array(self.scores))).astype(np.int32)
        self.rank = np.argsort(self.by_rank).astype(np.int32)
        self._fill(*(np.array(x, np.int64) for x in zip(*pairs, strict=True)))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.table_bits)).astype(np.int64)

    def _fill(self, keys: np.ndarray, ids: np.ndarray) -> None:
        """A hash table of pairs: a pair lies in its slot or in one of the next ``table_reach``."""
        self.table_bits = int(np.ceil(np.log2(max(len(keys), 1) * 8)))
        self.table_keys, self.table_ids = np.full((1 << self.table_bits) + 64, -1, np.int64), np.full((1 << self.table_bits) + 64, -1, np.int32)
        at, self.table_reach = self._slots(keys), 0
        while len(keys):
            if self.table_reach == 64:
                raise ValueError("too many pairs of pieces share a slot")
            free = self.table_keys[at] < 0
            won = np.zeros(len(at), bool)
            won[np.unique(np.where(free, at, -1), return_index=True)[1]] = True
            won &= free
            self.table_keys[at[won]], self.table_ids[at[won]] = keys[won], ids[won]
            keys, ids, at = keys[~won], ids[~won], at[~won] + 1
            self.table_reach += bool(len(keys))

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each two neighbouring pieces make, -1 where there is none."""
        asked = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * len(self.scores) + right, -2)
        at = self._slots(asked)
        got = np.where(self.table_keys[at] == asked, self.table_ids[at], np.int32(-1))
        open_ = np.flatnonzero((got < 0) & (self.table_keys[at] >= 0))
        for _ in range(self.table_reach):
            if not len(open_):
                break
            at[open_] += 1
            held = self.table_keys[at[open_]]
            same = held == asked[open_]
            got[open_[same]] = self.table_ids[at[open_[same]]]
            open_ = open_[~same & (held >= 0)]
        return got

    def lookup(self, keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """values where keys (sorted) hold what is asked, else -1."""
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return np.where(keys[at] == asked, values[at], -1)


def skipped(key: int, place: int, piece: int, limit: int) -> bool:
    """Whether the keyed hash drops the merge into ``piece`` at ``place``; limit is the rate in 2^32."""
    h = (key ^ (place * 0x9E3779B97F4A7C15 + piece * 0xC2B2AE3D27D4EB4F)) & _M64
    h = (h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 & _M64
    h = (h ^ (h >> 32)) * 0x94D049BB133111EB & _M64
    return (h >> 32) < limit


def segment(word: str, pieces: PieceTable, key: int = 0, limit: int = 0) -> list[int]:
    """Ids of a word by agenda merging; merges that the keyed hash skips are left out."""
    ids, scores = pieces.ids, pieces.scores
    parts: list[str] = list(word)
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda: list[tuple[float, int, int, str]] = []

    def propose(a: int, b: int) -> None:
        merged = parts[a] + parts[b]
        i = ids.get(merged)
        if i is not None and not (limit and skipped(key, a, i, limit)):
            heapq.heappush(agenda, (-scores[i], a, b, merged))

    for a in range(n - 1):
        propose(a, a + 1)
    while agenda:
        _, a, b, merged = heapq.heappop(agenda)
        if not parts[a] or after[a] != b or not parts[b] or parts[a] + parts[b] != merged:
            continue
        parts[a], parts[b] = merged, ""
        c = after[a] = after[b]
        if c < n:
            before[c] = a
            propose(a, c)
        if before[a] >= 0:
            propose(before[a], a)
    out: list[int] = []
    for p in parts:
        if p:
            i = ids.get(p)
            out += [i] if i is not None else [pieces.byte_ids[x] for x in p.encode("utf-8", "surrogatepass")]
    return out


#: Words up to this many characters are merged many at once, so many at a time.
SHORT, AT_ONCE = 24, 1 << 15
#: No entry in an agenda; a cell without a piece, other than a character that has none (-1).
_NONE, _GONE = (1 << 31) - 1, -2


def _skipped_each(keys: np.ndarray, place: np.ndarray, piece: np.ndarray, limit: int) -> np.ndarray:
    """skipped() for arrays."""
    h = keys ^ (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + piece.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(32)) < np.uint64(limit)


def _stretches(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start .. start + length - 1 of each stretch, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Segments:
    """Ids of many words as one array, and each word's number of ids; with the merges (place and piece) that were made, if they were noted."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, places: np.ndarray | None = None, made: np.ndarray | None = None, merges: np.ndarray | None = None):
        self.ids, self.lengths, self.places, self.made, self.merges = ids, lengths, places, made, merges


def segment_many(words: list[str], keys: np.ndarray | None, pieces: PieceTable, limit: int, note: bool = False) -> Segments:
    """segment() for many short words: each step takes the first entry of every word's agenda.

    Each character has a cell, a word's cells lie in a row of equal width, and a piece lives
    in its first cell, with the cells of its neighbours in ``after`` and ``before``. The
    agenda holds the rank of the piece that a cell's piece makes with the next one, or _NONE
    where there is none or where the keyed hash skips it. ``note`` asks for the merges that
    were made, word by word.
    """
    length = np.fromiter(map(len, words), np.int64, len(words))
    width = int(length.max()) + 1  # the last cell stays empty
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    columns = np.arange(width)
    inside = columns < length[:, None]
    first = np.full(inside.shape, _GONE, np.int32)
    first[inside] = pieces.lookup(pieces.char_codes, pieces.char_ids, codes)
    ids = first.ravel()
    after, before = np.arange(1, len(ids) + 1, dtype=np.int32), np.arange(-1, len(ids) - 1, dtype=np.int32)
    if keys is None:
        keys, limit = np.zeros(len(words), np.uint64), 0

    def proposed(cell: np.ndarray, row: np.ndarray) -> np.ndarray:
        """What each cell's piece makes with the next one, by rank."""
        merged = pieces.pair(ids[cell], ids[after[cell]])
        rank = pieces.rank[merged]
        if limit:
            with np.errstate(over="ignore"):
                rank = np.where(_skipped_each(keys[row], cell - row * width, np.maximum(merged, 0), limit), _NONE, rank)
        return np.where(merged >= 0, rank, _NONE)

    agenda = np.full(len(ids), _NONE, np.int32)
    cell = np.flatnonzero(inside[:, :-1] & inside[:, 1:])
    cell += cell // (width - 1)  # from rows without their last cell to whole rows
    agenda[cell] = proposed(cell, cell // width)
    agenda = agenda.reshape(len(words), width)
    row = np.arange(len(words))
    noted: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(row):
        here = np.arange(len(row))
        j = agenda.argmin(1)
        rank = agenda[here, j]
        going = rank < _NONE
        if not going.all():
            agenda, row, j, rank = (m[going] for m in (agenda, row, j, rank))
            here = here[: len(row)]
        at = row * width + j
        right = after[at]
        ids[at], ids[right] = pieces.by_rank[rank], _GONE
        after[at] = after[right]
        before[after[right]] = at
        if note:
            noted.append((row, j, ids[at]))
        agenda[here, right - row * width] = _NONE
        agenda[here, j] = proposed(at, row)
        left = before[at]
        has = left >= row * width
        has[has] = ids[left[has]] != _GONE  # the row before ends in an empty cell
        r, left = row[has], left[has]
        agenda[here[has], left - r * width] = proposed(left, r)
    held = np.flatnonzero(ids != _GONE)
    flat, of = ids[held], held // width
    lengths = np.bincount(of, minlength=len(words))
    missing = np.flatnonzero(flat < 0)
    if len(missing):  # characters without a piece go to bytes
        of, at = of[missing], held[missing] % width
        raw = [words[n][k].encode("utf-8", "surrogatepass") for n, k in zip(of.tolist(), at.tolist(), strict=True)]
        more = np.fromiter(map(len, raw), np.int64, len(raw)) - 1
        lengths = lengths + np.bincount(of, more, len(words)).astype(np.int64)
        times = np.ones(len(flat), np.int64)
        times[missing] += more
        flat = np.repeat(flat, times)
        flat[flat < 0] = np.array(pieces.byte_ids, np.int32)[np.frombuffer(b"".join(raw), np.uint8)]
    if not note:
        return Segments(flat, lengths)
    rows, places, made = (np.concatenate([n[i] for n in noted] or [np.zeros(0, np.int64)]) for i in range(3))
    by_word = np.argsort(rows, kind="stable")
    return Segments(flat, lengths, places[by_word].astype(np.int8), made[by_word].astype(np.int32), np.bincount(rows, minlength=len(words)))


class Known:
    """Short words without a skip: their ids and the merges made for them, in arrays that grow."""

    def __init__(self, pieces: PieceTable):
        self.pieces = pieces
        self.number: dict[str, int] = {}
        self.parts: list[Segments] = []
        self.joined: Segments | None = None

    def learn(self, words: list[str]) -> None:
        """Add words that are not known yet."""
        words = sorted(words, key=len)  # words of like lengths share a block
        for n in range(0, len(words), AT_ONCE):
            some = words[n : n + AT_ONCE]
            self.parts.append(segment_many(some, None, self.pieces, 0, note=True))
            self.number.update(zip(some, range(len(self.number), len(self.number) + len(some)), strict=True))
            self.joined = None

    def all(self) -> Segments:
        if self.joined is None:
            fields = ("ids", "lengths", "places", "made", "merges")
            self.joined = Segments(*(np.concatenate([getattr(p, f) for p in self.parts]) for f in fields))
            self.parts = [self.joined]
            self.starts = np.cumsum(self.joined.lengths) - self.joined.lengths
            self.merge_starts = np.cumsum(self.joined.merges) - self.joined.merges
        return self.joined


class Encoder:
    """Encodes texts under a seed and a dropout rate."""

    def __init__(self, pieces: PieceTable, seed: int = SEED, dropout: float = DROPOUT):
        self.pieces, self.seed = pieces, seed
        self.limit = min(1 << 32, round(dropout * (1 << 32)))
        self.known = Known(pieces)

    def keys(self, doc_id, copy: int, count: int) -> np.ndarray:
        """The hash keys of a document's words, in order."""
        return self._keys([doc_id], [copy], [count])

    def _keys(self, doc_ids: list, copies: list[int], counts: list[int]) -> np.ndarray:
        """keys() of documents one after another."""
        starts = [xxhash.xxh64_intdigest(f"{self.seed}:{d}:{c}") for d, c in zip(doc_ids, copies, strict=True)]
        place = _stretches(np.ones(len(counts), np.int64), np.array(counts, np.int64)).astype(np.uint64)
        with np.errstate(over="ignore"):
            h = np.repeat(np.array(starts, np.uint64), counts) + place * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return h ^ (h >> np.uint64(31))

    def _skipping(self, which: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Whether each occurrence skips a merge that was made for its word: only then can its ids differ."""
        held = self.known.all()
        size = held.merges[which]
        at = _stretches(self.known.merge_starts[which], size)
        with np.errstate(over="ignore"):
            hit = _skipped_each(np.repeat(keys, size), held.places[at], held.made[at], self.limit)
        before = np.concatenate([[0], np.cumsum(hit)])
        ends = np.cumsum(size)
        return before[ends] > before[ends - size]

    def encode_many(self, texts: list[str | None], doc_ids: list, copies: list[int] | None = None) -> list[np.ndarray]:
        """Ids of each text; none for a null or empty one."""
        cut = [_WORD.findall(" " + text) if text else [] for text in texts]
        flat = [w for words in cut for w in words]
        if not flat:
            return [np.zeros(0, np.int32) for _ in texts]
        counts = list(map(len, cut))
        keys = self._keys(doc_ids, copies or [0] * len(cut), counts)
        if len(self.known.number) >= CACHE:
            self.known = Known(self.pieces)
        self.known.learn([w for w in set(flat).difference(self.known.number) if len(w) <= SHORT])
        which = np.fromiter(map(self.known.number.get, flat, repeat(-1)), np.int64, len(flat))
        again = which < 0
        short = np.flatnonzero(~again)
        start, length, pool = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64), []
        if len(short):
            held = self.known.all()
            start[short], length[short] = self.known.starts[which[short]], held.lengths[which[short]]
            pool.append(held.ids)
            if self.limit:
                anew = short[self._skipping(which[short], keys[short])]
                anew = anew[np.argsort(np.fromiter((len(flat[i]) for i in anew.tolist()), np.int64, len(anew)), kind="stable")]
                offset = len(held.ids)
                for n in range(0, len(anew), AT_ONCE):
                    some = anew[n : n + AT_ONCE]
                    got = segment_many([flat[i] for i in some.tolist()], keys[some], self.pieces, self.limit)
                    length[some], start[some] = got.lengths, offset + np.cumsum(got.lengths) - got.lengths
                    pool.append(got.ids)
                    offset += len(got.ids)
        offset = sum(map(len, pool))
        for i in np.flatnonzero(again).tolist():
            ids = np.array(segment(flat[i], self.pieces, int(keys[i]), self.limit), np.int32)
            start[i], length[i] = offset, len(ids)
            pool.append(ids)
            offset += len(ids)
        ids = np.concatenate(pool)[_stretches(start, length)]
        ends = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def encode(self, text: str | None, doc_id=None, copy: int = 0) -> np.ndarray:
        return self.encode_many([text], [doc_id], [copy])[0]


def decode(ids, pieces: PieceTable) -> str:
    """The text of any segmentation: the pieces' bytes, without the first space."""
    return b"".join(map(pieces.bytes.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


def _parts(batch, most: int = 1 << 20):
    """Slices of an Arrow batch with about ``most`` bytes of text in column 1 each."""
    size, start = 0, 0
    for i, n in enumerate(pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()):
        size += n
        if size >= most:
            yield batch.slice(start, i + 1 - start)
            size, start = 0, i + 1
    if start < batch.num_rows:
        yield batch.slice(start)


def encode_documents(docs: DataFrame, seed: int = SEED, dropout: float = DROPOUT, model: str | None = None, copy: str | None = None) -> DataFrame:
    """doc_id, ids, n_pieces, lossless for each row of ``docs``.

    ``lossless`` tells that the ids decode to the text's own bytes, which each row is
    tried on. Null and empty texts have no ids. Rows with the same doc_id and text get
    the same ids unless the column named by ``copy`` tells them apart; null doc_ids draw
    alike. Words over SHORT characters, of any length, are merged one by one and not kept.
    Extra columns are ignored; an empty table gives no rows. The model's table goes to the
    workers with the task; its size is the vocabulary's.
    """
    rows = pick(docs, "doc_id", "text", *([copy] if copy else []))
    pieces = PieceTable(model)

    def run(batches):
        encoder = Encoder(pieces, seed, dropout)
        for b in batches:
            for part in _parts(b):
                doc_ids, texts = part.column(0), part.column(1).to_pylist()
                ids = encoder.encode_many(texts, doc_ids.to_pylist(), part.column(2).to_pylist() if copy else None)
                same = [b"".join(map(pieces.bytes.__getitem__, x.tolist()))[1:] == (t or "").encode("utf-8", "surrogatepass") for x, t in zip(ids, texts, strict=True)]
                sizes = [len(x) for x in ids]
                offsets = pa.array(np.cumsum([0, *sizes]), pa.int32())
                values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
                yield pa.record_batch(
                    [doc_ids, pa.ListArray.from_arrays(offsets, values), pa.array(sizes, pa.int32()), pa.array(same, pa.bool_())],
                    names=["doc_id", "ids", "n_pieces", "lossless"],
                )
            give_back()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_pieces int, lossless boolean")


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids decode to the empty text."""
    rows = pick(encoded, "doc_id", "ids")
    pieces = PieceTable(model)

    def run(batches):
        for b in batches:
            texts = [decode(x or [], pieces) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_pieces", "lossless", F.col("ids"))
