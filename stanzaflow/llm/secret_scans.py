"""Secret scans over an incremental blob ledger (operator 9).

Every version of a file (here: every document text) is a blob, addressed by the SHA-256 of its UTF-8 bytes. The ledger
holds one row per (blob, rule version) already scanned, with its findings. A scan takes the pairs the ledger lacks,
reads each blob once however many paths hold it, appends the findings, and joins the ledger back to all paths.

A text's address is made where the row is read, and so is a test that is exact in one direction: a text without the bytes that every rule needs
holds nothing. Its blob enters the ledger as scanned, by its address alone; only the texts that may hold something move. Blobs are collapsed inside each task
before the shuffle, so copies of one text cost one row per task. The join back is a sort-merge join that AQE splits where one blob is held by
very many paths.

Cases: null text is the empty blob, which has no finding. Repeated rows, null doc_ids and tied ids each get their own
result row. Very long texts are scanned whole. Spans are in code points, end exclusive. An empty table gives no rows. Extra columns are ignored by `scan`
and kept by `redacted`, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stored

# --- fixed values of the rules: kind, pattern, flags, group measured, least length of it ---
BASE_RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 0, 18),
    ("hex", r"[0-9a-f]+", 0, 0, 16),
)
ADDED_RULES = (
    ("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z]+ )?PRIVATE KEY-----)?", 0, 0, 32),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 0, 30),
    ("forge", r"(?:ghp|gho|ghs|ghu|glpat|xox[abpr])[_-][A-Za-z0-9_-]+", 0, 0, 20),
)
RULES = BASE_RULES + ADDED_RULES
#: What a text must hold for a rule to find anything: cheap substring tests before the patterns.
NEEDLES = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("AKIA",), "pem": ("-----BEGIN ",), "jwt": ("eyJ",), "forge": ("ghp", "gho", "ghs", "ghu", "glpat", "xox")}
RULE_VERSION = "r1-" + hashlib.sha256(repr(RULES).encode()).hexdigest()[:12]
FINDINGS = "array<struct<kind:string,start:int,end:int>>"


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text, by start, then rule order."""
    if not text:
        return []
    low, spans = text.lower(), []
    for order, (kind, pattern, flags, group, least) in enumerate(RULES):
        if kind in NEEDLES and not any(n in (low if flags & re.I else text) for n in NEEDLES[kind]):
            continue
        # Maximal runs of hex digits: those under the least length can be skipped by the pattern itself.
        p = re.compile(r"[0-9a-f]{%d,}" % least if kind == "hex" else pattern, flags)
        spans += [(m.start(), order, kind, m.end()) for m in p.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(kind, start, end) for start, _, kind, end in sorted(spans)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for b in small(batches):
        out = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] for t in b.column("text").to_pylist()]  # null: nothing to find
        yield pa.RecordBatch.from_arrays([b.column("blob"), pa.array([RULE_VERSION] * b.num_rows), pa.array(out, kind)], ["blob", "rule_version", "findings"])


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def may_hold(text: Column) -> Column:
    """False only where `find` has nothing to find: a needle for each rule, for `assign` its whole pattern, for `hex` a run of the least length."""
    text = F.coalesce(text, F.lit(""))
    has = lambda *needles: reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])
    parts = [has(*NEEDLES[kind]) for kind, *_ in RULES if kind in NEEDLES and kind != "assign"]
    for kind, pattern, _, _, least in BASE_RULES:
        if kind == "assign":
            parts.append(has(":", "=") & text.rlike("(?i)" + pattern))
        if kind == "hex":
            parts.append(text.rlike("[0-9a-f]{%d}" % least))
    return reduce(lambda a, b: a | b, parts)


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """The ledger after scanning every (blob, rule version) pair of `versions` (column text) that it lacks."""
    seen = ledger.where(F.col("rule_version") == RULE_VERSION) if ledger is not None else None
    blobs = versions.select(blob_id(F.col("text")).alias("blob"), F.when(may_hold(F.col("text")), F.col("text")).alias("text"))
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    if seen is not None:
        blobs = blobs.join(seen.select("blob"), "blob", "left_anti")
    new = stored(blobs.mapInArrow(_scan, f"blob binary, rule_version string, findings {FINDINGS}"), "ledger")
    return new if ledger is None else ledger.unionByName(new)


def scan(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """doc_id and findings of every row of docs."""
    book = update_ledger(docs, ledger).where(F.col("rule_version") == RULE_VERSION).where(F.size("findings") > 0)
    # merged at every size: findings small enough to broadcast today are not so tomorrow
    paths = docs.select("doc_id", blob_id(F.col("text")).alias("blob"))
    return paths.join(book.hint("merge"), "blob", "left").select("doc_id", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def report(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("findings", lambda x: x["kind"].isin(*[r[0] for r in BASE_RULES]))
    return scan(docs, ledger).select("doc_id", *[count(r[0]) for r in BASE_RULES], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("findings")).alias("spans"))


MASK = "[SECRET]"


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        doc = b.column("doc")
        at, texts = doc.type.get_field_index("text"), []
        fields = doc.flatten()
        for t, f in zip(fields[at].to_pylist(), b.column("findings").to_pylist()):
            if t is not None and f:
                parts, end = [], 0
                for s, e in merged((x["start"], x["end"]) for x in f):
                    parts += [t[end:s], MASK]
                    end = e
                t = "".join([*parts, t[end:]])
            texts.append(t)
        fields[at] = pa.array(texts, doc.type.field(at).type)
        yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, fields=list(doc.type))], ["doc"])


def redacted(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """docs with every found span (overlaps joined) replaced by MASK; all columns and rows stay, null texts stay null.

    Rows whose text cannot hold anything stay where they are; the others meet the ledger's findings.
    """
    book = update_ledger(docs, ledger).where(F.col("rule_version") == RULE_VERSION).where(F.size("findings") > 0)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    held = may_hold(F.col("doc.text"))
    met = row.where(held).withColumn("blob", blob_id(F.col("doc.text"))).join(book.select("blob", "findings").hint("merge"), "blob", "left")
    done = met.select("doc", "findings").mapInArrow(_masked, row.schema)
    return row.where(~held).unionByName(done).select("doc.*")


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out
