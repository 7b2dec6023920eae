"""Benchmark decontamination (operator 12): normalised windows of test items, looked for in every training text.

Texts are lower-cased (A-Z) and cut into words of digits, letters and all characters beyond ASCII. A window is `WINDOW` consecutive words of an item; an item of
fewer words is one window. Where the texts of all items together have at most `BROADCAST_BYTES` (their sum is asked for first), their windows go to
every task as a hash set: words become numbers of the items' vocabulary (0: a word of no item), rolling 64-bit hashes of the document's windows are
looked up in the set, and each hit is verified word by word. Beyond that size the windows of all distinct texts meet the items' windows in a sort-merge
join on the words themselves; the result is the same (tested). Then spans or whole documents are removed.

Cases: a null or empty text has no words and stays as it is; items without words have no window. Repeated items, and windows that many items hold, count for each
item once; an item without id marks words but is in no list of ids. Repeated rows, null and tied doc_ids are judged each on its own text. Very long texts
are scanned whole. An empty table of documents gives no rows, one of items no hits. Extra columns are ignored by `report` and kept by `decontaminated`, whatever
their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small

WINDOW = 10
BROADCAST_BYTES = 16_000_000
MATCH = "n_words long, spans array<struct<first:long,last:long>>, items array<string>"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NORMAL = bytes(b if b > 127 or chr(b).isdigit() or chr(b) in _LOWER else b + 32 if chr(b) in _UPPER else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text; bytes beyond ASCII are parts of words, so nothing has to be decoded."""
    return text.translate(_NORMAL).split()


def _hashes(ids: np.ndarray, length: int, factor: np.uint64) -> np.ndarray:
    """The hash of each stretch of `length` numbers."""
    h = np.zeros(len(ids) - length + 1, np.uint64)
    for k in range(length):
        h *= factor
        h += ids[k : k + len(h)]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h


class Index:
    """The items' windows: vocabulary, and per window length sorted hashes with one place of each window and the items that hold it."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        codes: defaultdict[bytes, int] = defaultdict()
        codes.default_factory = lambda: len(codes) + 1
        self.names = sorted({n for n, _ in items if n is not None})
        number = {n: k for k, n in enumerate(self.names)}
        texts = [([codes[w] for w in words_of(t)], number.get(n, -1)) for n, t in items]
        self.vocabulary = dict(codes)
        self.ids = np.array([x for t, _ in texts for x in [*t, 0]] or [0], np.uint64)
        by_length: dict[int, list[tuple[int, int]]] = defaultdict(list)  # window length -> (place, item)
        at = 0
        for t, item in texts:
            n = min(window, len(t))
            if n:
                by_length[n] += [(at + k, item) for k in range(len(t) - n + 1)]
            at += len(t) + 1
        self.tables = {n: self._table(n, np.array(found, np.int64)) for n, found in sorted(by_length.items())}

    def _table(self, length: int, found: np.ndarray) -> dict:
        for factor in range(0x5851F42D4C957F2D, 0x5851F42D4C957F2D + 2000, 2):
            h = _hashes(self.ids, length, np.uint64(factor))[found[:, 0]]
            order = np.lexsort((found[:, 1], h))
            h, places, items = h[order], found[order, 0], found[order, 1]
            head = np.append(True, h[1:] != h[:-1])
            first = np.flatnonzero(head)[np.cumsum(head) - 1]
            same = all((self.ids[places + k] == self.ids[places[first] + k]).all() for k in range(length))
            if same:  # no two different windows share a hash
                break
        else:
            raise ArithmeticError("no factor keeps the windows apart")
        fresh = (head | np.append(True, items[1:] != items[:-1])) & (items >= 0)  # each item of a window once
        bits = max(16, int(len(places) * 16).bit_length())
        seen = np.zeros(1 << bits, bool)
        seen[(h >> np.uint64(64 - bits)).astype(np.int64)] = True
        counts = np.add.reduceat(fresh.astype(np.int64), np.flatnonzero(head))
        return {"factor": np.uint64(factor), "hash": h[head], "place": places[head], "items": items[fresh], "end": np.cumsum(counts), "shift": np.uint64(64 - bits), "seen": seen}

    def search(self, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """Of each text: number of words, stretches of hit words (first, last), items."""
        get, flat, size = self.vocabulary.get, [], []
        for t in texts:
            found = [get(w, 0) for w in words_of(t)] if t else []
            size.append(len(found))
            flat += found
            flat.append(0)
        ids = np.array(flat, np.uint64)
        ends = np.cumsum(np.array(size, np.int64) + 1)
        known = np.append(0, np.cumsum(ids != 0))
        hit, held = np.zeros(len(ids) + 1, np.int64), defaultdict(set)
        for length, t in self.tables.items():
            if len(ids) < length:
                continue
            h = _hashes(ids, length, t["factor"])
            at = np.flatnonzero(t["seen"][(h >> t["shift"]).astype(np.int64)] & (known[length:] - known[:-length] == length))
            row = np.minimum(np.searchsorted(t["hash"], h[at]), len(t["hash"]) - 1)
            true = t["hash"][row] == h[at]
            for k in range(length):
                true &= self.ids[t["place"][row] + k] == ids[at + k]
            at, row = at[true], row[true]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + length, -1)
            for d, r in zip(np.searchsorted(ends, at, side="right").tolist(), row.tolist()):
                held[d].add((length, r))
        out: list = [(n, [], []) for n in size]
        marked = np.diff(np.append(0, (np.cumsum(hit) > 0).astype(np.int8)))
        begins, stops = np.flatnonzero(marked > 0), np.flatnonzero(marked < 0)
        owner = np.searchsorted(ends, begins, side="right")
        for d, s, e in zip(owner.tolist(), begins.tolist(), stops.tolist()):
            base = int(ends[d]) - size[d] - 1
            out[d][1].append((s - base, e - 1 - base))
        for d, windows in held.items():
            items = {x for length, r in windows for x in self._items(length, r)}
            out[d][2].extend(self.names[x] for x in sorted(items))
        return out

    def _items(self, length: int, row: int) -> list[int]:
        t = self.tables[length]
        return t["items"][t["end"][row - 1] if row else 0 : t["end"][row]].tolist()


def _in_tasks(rows: DataFrame, items: DataFrame, window: int) -> DataFrame:
    found = items.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).where("text is not null").collect()  # bounded by the caller
    index = rows.sparkSession.sparkContext.broadcast(Index([(n, bytes(t)) for n, t in found], window))
    spans = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            got = index.value.search(b.column("text").cast(pa.binary()).to_pylist())
            cols = [pa.array([g[0] for g in got], pa.int64()), pa.array([[{"first": s, "last": e} for s, e in g[1]] for g in got], spans), pa.array([g[2] for g in got], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("text"), *cols], ["doc", "text", "n_words", "spans", "items"])

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, text string, {MATCH}")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _SEPARATORS), lambda w: w != "")


def _windows(words: Column, lengths: list[int], short: bool) -> Column:
    """array<struct<at, length, window>> of the windows of these lengths, at from 0. short: words fewer than the greatest of them are one window."""
    cut = lambda n: F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda k: F.struct(k.cast("long").alias("at"), F.lit(n).alias("length"), F.array_join(F.slice(words, k + 1, n), " ").alias("window")))
    none = F.array().cast("array<struct<at:bigint,length:int,window:string>>")
    fits = lambda n: F.size(words) == n if short and n < max(lengths) else F.size(words) >= n
    return F.concat(none, *[F.when(fits(n), cut(n)).otherwise(none) for n in lengths])


def _by_join(rows: DataFrame, items: DataFrame, window: int) -> DataFrame:
    tests = items.select(F.col("item_id").cast("string").alias("item"), _words(F.col("text")).alias("w"))
    tests = tests.select("item", F.explode(_windows(F.col("w"), list(range(1, window + 1)), True)).alias("x")).select("item", "x.length", "x.window")
    lengths = sorted(r[0] for r in tests.select("length").distinct().collect())  # at most `window`
    rows = rows.withColumn("blob", F.sha2(F.coalesce("text", F.lit("")), 256))
    texts = rows.groupBy("blob").agg(F.first("text").alias("text")).select("blob", _words(F.col("text")).alias("w"))
    cut = texts.select("blob", F.explode(_windows(F.col("w"), lengths, False)).alias("x")).select("blob", "x.at", (F.col("x.at") + F.col("x.length")).alias("end"), "x.window")
    met = cut.join(tests.select("window").distinct().hint("merge"), "window")
    inside = Window.partitionBy("blob").orderBy("at", "end")
    reach = met.withColumn("before", F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    block = F.sum(F.when(F.col("at") <= F.col("before"), 0).otherwise(1)).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    spans = reach.withColumn("block", block).groupBy("blob", "block").agg(F.min("at").alias("first"), (F.max("end") - 1).alias("last"))
    spans = spans.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"))
    held = met.select("blob", "window").distinct().join(tests.where("item is not null").select("window", "item").distinct().hint("merge"), "window")
    held = held.groupBy("blob").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = rows.join(spans.join(held, "blob", "left").hint("merge"), "blob", "left")
    or_none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
    return out.select("doc", "text", F.size(_words(F.col("text"))).cast("long").alias("n_words"), or_none("spans", "array<struct<first:bigint,last:bigint>>"), or_none("items", "array<string>"))


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES, keep: list[str] | None = None) -> DataFrame:
    """Per row: doc (a struct of its columns, or those of `keep`), text, n_words, spans (disjoint stretches of hit words by number, from 0) and items (ids, sorted)."""
    names = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + F.count("*") * 16).first()[0]
    return (_in_tasks if size <= broadcast_bytes else _by_join)(rows, items, window)


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids) and contaminated of every document."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    found = matches(docs, items, window, broadcast_bytes, ["doc_id"])
    return found.select("doc.doc_id", "n_words", n_hit.alias("n_hit"), "items", (F.size("spans") > 0).alias("contaminated"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        doc = b.column("doc")
        at, texts = doc.type.get_field_index("text"), []
        for t, spans in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist()):
            if spans:
                places = [m.span() for m in _WORD.finditer(t.translate(_NORMAL))]
                parts, end = [], 0
                for s in spans:
                    parts.append(t[end : places[s["first"]][0]])
                    end = places[s["last"]][1]
                t = b"".join([*parts, t[end:]])
            texts.append(t)
        fields = doc.flatten()
        fields[at] = pa.array(texts, pa.binary()).cast(doc.type.field(at).type)
        yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, fields=list(doc.type))], ["doc"])


def decontaminated(docs: DataFrame, items: DataFrame, whole: bool = True, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs without the rows that hold a window (whole), or without the stretches of hit words, from the first word's begin to the last one's end."""
    found = matches(docs, items, window, broadcast_bytes)
    if whole:
        return found.where(F.size("spans") == 0).select("doc.*")
    return found.mapInArrow(_cut, f"doc {found.schema['doc'].dataType.simpleString()}").select("doc.*")
