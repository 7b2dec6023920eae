"""SentencePiece encoding and decoding on a relational lattice (operator 1).

Words (a run of the space mark and what follows up to the next one; no piece crosses into the next word) are encoded in blocks: every substring of
bounded length is exploded and equi-joined with the piece table, the matches are grouped by word as edges of a lattice, and the lattices of a block are
folded together, a turn of all words at a time. Characters that no piece covers become byte pieces.

The vocabulary is a BPE model. The path of greatest total score (Viterbi) is not what such a model encodes to, so the fold keeps the lattice and applies
the model's own rule to it: of the edges that span exactly two current pieces the one of best score, the leftmost of equals, is taken, until none is
left. Words over `LONG` characters, alone in their lattice, are folded by the same rule with their edges in a queue, so time grows as length x log length.

Explode, join, grouping and fold run on Arrow and numpy columns of a task, not as Spark rows and a higher-order aggregate (README: figures). Each task
encodes its own texts' words and keeps up to `KNOWN_WORDS` of them for its next texts; nothing is shuffled or stored, and a lost task is run again alone.

Decoding joins the ids of each row with the vocabulary's bytes on Arrow columns, in the row's own task: no row a token, no shuffle, no key.

Cases: null and empty texts have no ids. Repeated rows are encoded and decoded each. `encode` ignores extra columns, `decode` keeps them. A task holds
`small` texts and a block's edges.
"""

from __future__ import annotations

import codecs
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .common import small, vocabulary

MARK, LONG, BLOCK_WORDS, KNOWN_WORDS = "▁", 48, 20_000, 300_000
WORD = re.compile(f"{MARK}+[^{MARK}]*")


def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary(path))


class Lattice:
    """The piece table of a model and the encoding of words with it."""

    def __init__(self, path: str):
        p = processor(path)
        rows = [(p.id_to_piece(i), i, p.get_score(i)) for i in range(p.vocab_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        names, ids, scores = zip(*rows)
        self.pieces, self.ids, self.row = pa.array(names), np.array(ids, "<i4"), {x: i for i, x in enumerate(names)}
        self.rank = np.unique(-np.array(scores), return_inverse=True)[1]  # 0 is the best score; equal scores have one rank
        self.longest = max(map(len, names))
        self.first_byte = next(i for i in range(p.vocab_size()) if p.is_byte(i))

    def edges(self, words: pa.Array, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """word, start, length, row of the piece table, of each substring that is a piece. words: longest first."""
        cuts, spans = [], []
        for s in range(int(n[0])):
            for k in range(1, min(self.longest, int(n[0]) - s) + 1):
                m = int(np.searchsorted(-n, -(s + k), side="right"))  # words of s + k characters at least
                cuts.append(pc.utf8_slice_codeunits(words[:m], s, s + k))
                spans.append((m, s, k))
        hit = pc.index_in(pa.chunked_array(cuts), value_set=self.pieces)
        row = hit.fill_null(-1).to_numpy()
        m, s, k = np.array(spans, "i4").T
        word = np.concatenate([np.arange(x, dtype="i4") for x in m])
        found = row >= 0
        return word[found], np.repeat(s, m)[found], np.repeat(k, m)[found], row[found]

    def block(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit integers."""
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        n = np.array([len(words[i]) for i in order])
        word, s, k, row = self.edges(pa.array([words[i] for i in order]), n)
        base = np.concatenate([[0], np.cumsum(n + 1)])  # a word's boundaries lie side by side
        after = np.arange(1, base[-1] + 1)  # the next boundary
        after[base[1:] - 1] = -1
        bound, piece = np.ones(base[-1], bool), np.full(base[-1], -1, "<i4")  # piece: id of what starts here, -1 for bytes
        start = base[word] + s
        one = k == 1
        piece[start[one]] = self.ids[row[one]]
        word, start, end, row = word[~one], start[~one], (start + k)[~one], row[~one]
        best_first = np.argsort((word.astype("i8") << 40) | (self.rank[row] << 8) | (start - base[word]))
        word, start, end, row = word[best_first], start[best_first], end[best_first], row[best_first]
        while word.size:
            middle = after[start]
            fits = np.flatnonzero(after[middle] == end)
            first = fits[np.diff(word[fits], prepend=-1) != 0]  # best of each word
            bound[middle[first]] = False
            after[start[first]] = end[first]
            piece[start[first]] = self.ids[row[first]]
            going = np.zeros(len(words), bool)
            going[word[first]] = True
            left = going[word] & bound[start] & bound[end]
            left[first] = False
            word, start, end, row = word[left], start[left], end[left], row[left]
        bound[base[1:] - 1] = False
        counts = np.concatenate([[0], np.cumsum(bound)])[base]  # pieces before each word
        ids = piece[bound]
        flat, cuts = ids.tobytes(), (4 * counts).tolist()
        out: list[bytes] = [b""] * len(words)
        for at, i in enumerate(order):
            out[i] = flat[cuts[at] : cuts[at + 1]]
        places = np.flatnonzero(bound)
        for at in np.unique(np.searchsorted(counts, np.flatnonzero(ids < 0), side="right") - 1).tolist():
            w, part = words[order[at]], slice(counts[at], counts[at + 1])
            out[order[at]] = np.array([x for p, c in zip(places[part] - base[at], ids[part]) for x in ([c] if c >= 0 else [self.first_byte + b for b in w[p].encode()])], "<i4").tobytes()
        return out

    def long_word(self, w: str) -> bytes:
        """The ids of one word: its edges wait in a queue, best score first, leftmost of equals."""
        n, row, queue = len(w), self.row, []
        end, before = list(range(1, n + 1)), list(range(-1, n))  # of the piece that starts at a place; end 0: none starts there

        def add(start: int) -> None:
            if start >= 0 and end[start] < n:
                middle = end[start]
                at = row.get(w[start : end[middle]]) if end[middle] - start <= self.longest else None
                if at is not None:
                    heapq.heappush(queue, (int(self.rank[at]), start, middle, end[middle]))

        for i in range(n):
            add(i)
        while queue:
            _, start, middle, stop = heapq.heappop(queue)
            if end[start] == middle and end[middle] == stop:
                end[start], end[middle] = stop, 0
                if stop < n:
                    before[stop] = start
                add(before[start])
                add(start)
        ids, at = [], 0
        while at < n:
            piece = row.get(w[at : end[at]])
            ids += [int(self.ids[piece])] if piece is not None else [self.first_byte + b for b in w[at : end[at]].encode()]
            at = end[at]
        return np.array(ids, "<i4").tobytes()

    def encode(self, words: list[str]) -> dict[str, bytes]:
        """word -> ids, for distinct words."""
        out = {}
        lattice = [w for w in words if len(w) <= LONG]
        for i in range(0, len(lattice), BLOCK_WORDS):
            part = lattice[i : i + BLOCK_WORDS]
            out.update(zip(part, self.block(part)))
        out.update((w, self.long_word(w)) for w in words if len(w) > LONG)
        return out


def _texts(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """doc_id and ids of slices of rows."""
    lattice, known = Lattice(path), {}
    for b in small(batches):
        cut = [WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in b.column("text").to_pylist()]
        new = set().union(*cut).difference(known)
        if len(known) + len(new) > KNOWN_WORDS:
            known = {}
            new = set().union(*cut)
        known.update(lattice.encode(list(new)))
        yield b.column("doc_id"), [b"".join(map(known.__getitem__, words)) for words in cut]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, ids in _texts(batches, path):
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype("i4")
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield pa.RecordBatch.from_arrays([doc_id, lists], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def encoded_digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), text_crc32 (UTF-8 bytes of the text decoded from the ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)
        for doc_id, ids in _texts(batches, path):
            sizes, crcs = [len(x) // 4 for x in ids], pa.array([zlib.crc32(x) for x in ids], pa.int64())
            texts = vocabulary.texts(np.frombuffer(b"".join(ids), "<i4"), np.array(sizes, "i8"))
            back = pa.array([zlib.crc32(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(sizes, pa.int64()), crcs, back], ["doc_id", "n_ids", "ids_crc32", "text_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, text_crc32 long")


class Vocabulary:
    """The bytes of every id of a model and the decoding of rows of ids with them."""

    def __init__(self, path: str):
        p = processor(path)
        out = [bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else b"" if p.is_control(i) or p.is_unknown(i) else p.id_to_piece(i).replace(MARK, " ").encode() for i in range(p.vocab_size())]
        self.bytes = pa.array([*out, b""], pa.binary())  # the last stands for ids outside the vocabulary
        codecs.register_error("each", lambda e: ("\ufffd" * (e.end - e.start), e.end))  # as the library: one for each bad byte

    def texts(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The text of each row; ids: those of all rows, one row after the other."""
        none = len(self.bytes) - 1
        parts = self.bytes.take(pa.array(np.where((ids >= 0) & (ids < none), ids, none)))
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("i4"))
        whole = pc.binary_join(pa.ListArray.from_arrays(ends, parts), b"")
        return [x.removeprefix(b" ").decode("utf-8", "each") for x in whole.to_pylist()]


def decode(rows: DataFrame, path: str) -> DataFrame:
    """rows with `text` in place of `ids`: ids joined with the vocabulary, bytes put in order, the first space taken off. Null ids and ids outside the vocabulary add nothing."""
    keep = [c for c in rows.columns if c != "ids"]
    kind = StructType([rows.schema[c] for c in keep]).add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)
        for b in small(batches):
            ids = b.column("ids")
            flat, sizes = pc.list_flatten(ids).fill_null(-1).to_numpy(zero_copy_only=False), pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*map(b.column, keep), pa.array(vocabulary.texts(flat, sizes), pa.string())], [*keep, "text"])

    return rows.mapInArrow(run, kind)
