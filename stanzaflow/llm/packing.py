"""Best-fit packing of tokenized documents into fixed sequences (operator 4).

1. Tokenize every text (mapInArrow) into pieces of at most `capacity` tokens; only over-long documents are cut, their
   first piece taking the remainder. Each piece keeps its ids, its task number and its ordinal among the task's pieces of that length.
2. The histogram of piece lengths (at most `capacity` rows, whatever the input) goes to the driver, which plans all bins:
   pieces above one third of the capacity are matched greedily, longest first with the longest partner that still fits, at most two
   a bin; smaller ones go best-fit, longest first, into the tightest remaining gap. Bins alike are planned as ranges, so
   the plan has a few thousand rows at any input size.
3. Ordinals become global ranks (a window over counts per task and length, not over pieces), and one join with the
   plan, whose size the capacity bounds, gives each piece its sequence and offset.
4. `pack` gives the pieces with their ids (binary, little-endian unsigned 32-bit) and the CRC of these; `sequences` puts
   the pieces of each sequence together, a row of at most `capacity` tokens to train on.

Cases: null text is empty and makes a piece of the separator alone. Repeated rows and null ids are separate documents;
an empty table packs to no rows. Very long texts are tokenized whole. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small, stored, vocabulary

CAPACITY = 2048
SEPARATOR = 0
RUN = 64
CACHE = 300_000  # distinct word forms a worker remembers


def encoder(path: str):
    """Ids of a text by the same vocabulary as ranks, which encodes a single word form three times as fast as the library `tokenizers` (a test compares the ids)."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(vocabulary(path.removesuffix(".json") + ".tiktoken"), "rb") as f:
        ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}
    return tiktoken.Encoding("forms", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Forms(dict):
    """Word form -> ids of `lead` + form as little-endian uint32 bytes; the first `CACHE` forms stay, which holds nearly all frequent ones.

    bare: a form that is empty or has white space at an end raises KeyError.
    """

    def __init__(self, encode, lead: str = "", bare: bool = False):
        self.encode, self.lead, self.bare = encode, lead, bare
        self.stops = {c: array("I", encode(c)).tobytes() for c in ".,;:!?"}

    def __missing__(self, form: str) -> bytes:
        if self.bare and (not form or form != form.strip()):
            raise KeyError(form)
        if form[-1:] in self.stops and "A" <= form[-2:-1] < "\u0250" and form[-2].isalpha():  # pre-tokens end between a letter and a stop
            ids = self[form[:-1]] + self.stops[form[-1]]
        else:
            ids = array("I", self.encode(self.lead + form)).tobytes()
        if len(self) < CACHE:
            self[form] = ids
        return ids


def forms_of(text: str) -> list[str]:
    """Cuts a text before each blank that follows a character other than white space: byte-level pre-tokens never cross such a place."""
    parts = text.split(" ")
    out = parts[:1]
    for p in parts[1:]:
        if not out[-1] or out[-1][-1].isspace():
            out[-1] += " " + p
        else:
            out.append(" " + p)
    return out if out[0] else out[1:]


def plain_ids(encode):
    """Function text -> its ids as little-endian uint32 bytes.

    Where no two characters of white space meet, pre-tokens start anew at every blank and on both sides of every line break, so lines and
    their words are looked up by themselves. Other texts are cut by `forms_of`.
    """
    first, after, odd, line_break = Forms(encode, bare=True), Forms(encode, " ", bare=True), Forms(encode), array("I", encode("\n")).tobytes()

    def ids(text: str) -> bytes:
        try:
            lines = (line.split(" ") for line in text.split("\n"))
            return line_break.join([b"".join([first[x[0]], *map(after.__getitem__, x[1:])]) for x in lines])
        except KeyError:
            return b"".join(map(odd.__getitem__, forms_of(text)))

    return ids


def added_tokens(path: str) -> dict[str, bytes]:
    """Content -> id, as little-endian uint32 bytes, of the tokens the JSON file adds to the vocabulary."""
    with open(vocabulary(path), encoding="utf-8") as f:
        return {t["content"]: array("I", [t["id"]]).tobytes() for t in json.load(f)["added_tokens"]}


def tokenized(path: str, capacity: int, added: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        ids, seen = plain_ids(encoder(path)), defaultdict(int)
        extra = added_tokens(path) if added else {}
        cut = re.compile("(" + "|".join(map(re.escape, sorted(extra, key=len, reverse=True))) + ")") if extra else None

        def encoded(text: str) -> bytes:
            if not any(t in text for t in extra):
                return ids(text)
            return b"".join(extra[p] if i % 2 else ids(p) for i, p in enumerate(cut.split(text)) if p)

        for b in small(batches):
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                buf = (encoded(text) if text else b"") + SEPARATOR.to_bytes(4, "little")
                n = len(buf) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((doc_id, k, s, e - s, buf[4 * s : 4 * e], task, seen[e - s]))
                    seen[e - s] += 1
            cols = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids", "task", "ordinal"])

    return run


PIECES = "doc_id long, piece int, start long, length long, ids binary, task int, ordinal long"


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank end, first sequence, offset): pieces of a length in the rank range go to consecutive sequences at that offset."""
    out, gaps, bins = [], defaultdict(list), 0  # gap -> [first sequence, bins, offset]
    rank: dict[int, int] = defaultdict(int)
    left = {k: v for k, v in counts.items() if v > 0}

    def put(length: int, n: int, first: int, offset: int) -> None:
        out.append((length, rank[length], rank[length] + n, first, offset))
        rank[length] += n
        left[length] -= n

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        at = bisect_left(large, capacity - a + 1) - 1
        while at >= 0 and not left[large[at]]:
            large.pop(at)
            at -= 1
        b = large[at] if at >= 0 else None
        if b is None:
            n = left[a]
        elif b == a:
            n = left[a] // 2 or 1
            b = b if left[a] > 1 else None
            if b is None and at > 0:  # the last of its kind takes the next shorter partner
                b = next((x for x in reversed(large[:at]) if left[x]), None)
        else:
            n = min(left[a], left[b])
        put(a, n, bins, 0)
        if b is not None:
            put(b, n, bins, a)
        room = capacity - a - (b or 0)
        if room:
            gaps[room].append([bins, n, capacity - room])
        bins += n
    tight = sorted(gaps)
    for k in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[k]:
            at = bisect_left(tight, k)
            if at == len(tight):
                n = max(1, left[k] // (capacity // k))
                first, here, offset = bins, n, 0
                bins += n
                gap = capacity
            else:
                gap = tight[at]
                first, here, offset = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    tight.pop(at)
                most = -(-left[k] // (gap // k))  # bins that this length can use
                if here > most:
                    _open(gaps, tight, gap, [first + most, here - most, offset])
                    here = most
            while gap >= k and left[k]:
                n = min(here, left[k])
                if n < here:  # the rest of the range stays as it is
                    _open(gaps, tight, gap, [first + n, here - n, offset])
                    here = n
                put(k, n, first, offset)
                gap, offset = gap - k, offset + k
            if gap:
                _open(gaps, tight, gap, [first, here, offset])
    return out


def _open(gaps: dict, tight: list, gap: int, entry: list) -> None:
    if gap not in gaps or not gaps[gap]:
        insort(tight, gap)
    gaps[gap].append(entry)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, added: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids of every piece.

    added: the file's added tokens are found in texts, as the library finds them by itself; else they are text like any other (its `encode_special_tokens`).
    """
    spark = docs.sparkSession
    pieces = stored(docs.select("doc_id", "text").mapInArrow(tokenized(tokenizer_path, capacity, added), PIECES), "pieces")
    per_task = pieces.groupBy("length", "task").count()
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # A task's pieces of one length are dealt out in runs of `RUN`, so that its many full pieces don't meet in one task.
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(count - 1) div {RUN}")))
    base = per_task.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).select("length", "task", "before", runs.alias("run"))
    plan = spark.createDataFrame(plan_bins(counts, capacity), "p_length long, p_from long, p_to long, p_first long, offset long")
    ranked = pieces.withColumn("run", F.expr(f"ordinal div {RUN}")).join(base.hint("merge"), ["length", "task", "run"]).withColumn("rank", F.col("before") + F.col("ordinal"))
    on = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("p_from")) & (F.col("rank") < F.col("p_to"))
    return ranked.join(F.broadcast(plan), on).select(  # rows bounded by capacity, not by input
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), (F.col("p_first") + F.col("rank") - F.col("p_from")).alias("sequence_id"), "offset", "ids"
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids array<int>, starts (offset, doc_id, piece, start of each piece) of every packed sequence."""
    kind = "sequence_id long, n_tokens long, ids array<int>, starts array<struct<offset: long, doc_id: long, piece: int, start: long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            ids = [array("i", b"".join(x["ids"] for x in row)) for row in b.column("parts").to_pylist()]
            starts = [[{k: x[k] for k in ("offset", "doc_id", "piece", "start")} for x in row] for row in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("sequence_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                 pa.array(starts, pa.list_(pa.struct([("offset", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64())])))],
                ["sequence_id", "n_tokens", "ids", "starts"],
            )

    part = F.struct("offset", "doc_id", "piece", "start", "ids")
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts")).mapInArrow(run, kind)
