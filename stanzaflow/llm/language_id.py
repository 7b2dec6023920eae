"""Language identification by a bidirectional gated recurrent network over bytes (operator 10).

Trained here in numpy by backpropagation through time on windows of UTF-8 bytes; it labels every byte position, and a document's
probabilities are the mean over all its positions. Texts are read whole, in windows of `WINDOW` bytes that run side
by side (the state starts anew at each window, from the left for one direction and from the right for the other).
The squashing function is x / (1 + |x|), seven times cheaper than tanh here; gates are its image in 0..1.

Training sample (documented bound): of the labelled documents outside the held-out fold, at most `PER_LANGUAGE` a language, those of the smallest
hash of doc_id. Their whole texts are cut into windows as for a prediction, where they lie; a training step draws languages evenly, in them documents
evenly, in these windows evenly. Training reads `STEPS` x `BATCH` windows, so of a document with more than its share of them that many are drawn, evenly over the whole text, and
only these go to the driver: some 5 MB, however long the texts are. Only text and lang are used; lang, source and doc_id are no input of a prediction.

Cases: null text, or text without a letter, is `und` with score 0. Null doc_id counts as held out (never learned from). Null
lang teaches nothing. With no labelled document at all every text is `und`. Equal probabilities: the language
that sorts first. Repeated rows are predicted each. Extra columns are
ignored by `predict_languages` and kept by `language_filter`. Of rows that share doc_id and lang the greatest text teaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small

WINDOW, HIDDEN, LANES = 48, 8, 2048
PER_LANGUAGE, SALTS = 400, 8
STEPS, BATCH, RATE = 400, 256, 0.02
NONE = "und"


def _soft(a):
    return a / (1 + np.abs(a))


def _slope(a):
    return 1 / (1 + np.abs(a)) ** 2


def _run(x: np.ndarray, p: dict) -> tuple[np.ndarray, list]:
    """x: (steps, lanes) bytes, in this direction's order. Logits of every position, and what the way back needs."""
    h = np.zeros((x.shape[1], p["uz"].shape[0]), np.float32)
    logits, past = np.empty((*x.shape, p["out"].shape[1]), np.float32), []
    for t in range(len(x)):
        az, ar, hc = h @ p["uz"] + p["tz"][x[t]], h @ p["ur"] + p["tr"][x[t]], h @ p["uc"]
        z, r = 0.5 + 0.5 * _soft(az), 0.5 + 0.5 * _soft(ar)
        ac = p["tc"][x[t]] + r * hc
        c = _soft(ac)
        after = h + z * (c - h)
        past.append((h, az, ar, hc, z, r, ac, c, after))
        h = after
        logits[t] = h @ p["out"]
    return logits, past


def _fast(x: np.ndarray, p: dict, logits: np.ndarray, reverse: bool) -> None:
    """Adds the logits of _run to logits, for use: gates side by side, buffers used again."""
    lanes, width = x.shape[1], p["uz"].shape[0]
    u, uc, tab, tc = np.hstack([p["uz"], p["ur"]]), p["uc"], np.hstack([p["tz"], p["tr"]]), p["tc"]
    h, a, g, e, d, f = (np.zeros((lanes, k * width), np.float32) for k in (1, 2, 2, 1, 1, 1))
    step = np.empty((lanes, logits.shape[2]), np.float32)
    for t in range(len(x) - 1, -1, -1) if reverse else range(len(x)):
        np.matmul(h, u, out=a)
        a += tab.take(x[t], 0)
        np.abs(a, out=g)
        g += 1
        a /= g
        a *= 0.5
        a += 0.5
        np.matmul(h, uc, out=e)
        e *= a[:, width:]
        e += tc.take(x[t], 0)
        np.abs(e, out=f)
        f += 1
        e /= f
        np.subtract(e, h, out=d)
        d *= a[:, :width]
        h += d
        np.matmul(h, p["out"], out=step)
        logits[t] += step


def _back(x: np.ndarray, p: dict, past: list, dlogits: np.ndarray) -> dict:
    g = {k: np.zeros_like(v) for k, v in p.items()}
    dh = np.zeros_like(past[0][0])
    for t in range(len(x) - 1, -1, -1):
        h, az, ar, hc, z, r, ac, c, after = past[t]
        g["out"] += after.T @ dlogits[t]
        dh = dh + dlogits[t] @ p["out"].T
        dac = dh * z * _slope(ac)
        daz = dh * (c - h) * 0.5 * _slope(az)
        dar = dac * hc * 0.5 * _slope(ar)
        dhc = dac * r
        for k, d in (("tz", daz), ("tr", dar), ("tc", dac)):
            np.add.at(g[k], x[t], d)
        g["uz"] += h.T @ daz
        g["ur"] += h.T @ dar
        g["uc"] += h.T @ dhc
        dh = dh * (1 - z) + daz @ p["uz"].T + dar @ p["ur"].T + dhc @ p["uc"].T
    return g


def _softmax(a):
    a = a - a.max(-1, keepdims=True)
    np.exp(a, out=a)
    a /= a.sum(-1, keepdims=True)
    return a


def _windows(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after the other in rows of WINDOW bytes, each text's last row padded with 0; rows of each text."""
    rows = -(-np.array([len(b) for b in raw], np.int64) // WINDOW)
    data = np.zeros((rows.sum(), WINDOW), np.uint8)
    flat = data.reshape(-1)
    for b, at in zip(raw, np.cumsum(rows) - rows):
        flat[at * WINDOW : at * WINDOW + len(b)] = np.frombuffer(b, np.uint8)
    return data, rows


def train(samples: list[tuple[bytes, str]], steps: int = STEPS, seed: int = 0) -> dict | None:
    """Texts as bytes with their languages -> {'langs', 'fore', 'aft'}; Adam, languages drawn evenly and each text as often as any other of its language."""
    samples = [s for s in samples if s[0]]
    langs = sorted({lang for _, lang in samples})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    data, rows = _windows([b for b, _ in samples])
    label = np.array([langs.index(lang) for _, lang in samples])
    weight = np.repeat((1 / np.bincount(label))[label] / rows, rows)
    label = np.repeat(label, rows)
    n = len(langs)
    init = lambda: {**{k: rng.normal(0, 0.5, (256, HIDDEN)) for k in ("tz", "tr", "tc")}, **{k: rng.normal(0, 0.3, (HIDDEN, HIDDEN)) for k in ("uz", "ur", "uc")}, "out": rng.normal(0, 0.3, (HIDDEN, n))}
    nets = [{k: v.astype(np.float32) for k, v in init().items()} for _ in range(2)]
    m = [[{k: np.zeros_like(v) for k, v in p.items()} for p in nets] for _ in range(2)]
    for step in range(1, steps + 1):
        pick = rng.choice(len(data), BATCH, p=weight / weight.sum())
        x, y = data[pick].T, label[pick]
        ahead, past_a = _run(x, nets[0])
        behind, past_b = _run(x[::-1], nets[1])
        d = _softmax(ahead + behind[::-1])
        d[:, np.arange(BATCH), y] -= 1
        d /= BATCH * WINDOW / 8
        d[x == 0] = 0  # padding
        rate = RATE * (1 - step / (steps + 1))
        for k, (net, g) in enumerate(((nets[0], _back(x, nets[0], past_a, d)), (nets[1], _back(x[::-1], nets[1], past_b, d[::-1])))):
            for name, v in g.items():
                m[0][k][name] = 0.9 * m[0][k][name] + 0.1 * v
                m[1][k][name] = 0.99 * m[1][k][name] + 0.01 * v * v
                net[name] -= rate * (m[0][k][name] / (1 - 0.9**step)) / (np.sqrt(m[1][k][name] / (1 - 0.99**step)) + 1e-7)
    return {"langs": langs, "fore": nets[0], "aft": nets[1]}


def probabilities(texts: list[str], model: dict) -> np.ndarray:
    """Mean probabilities over all byte positions of each text; texts are whole and not empty."""
    raw = [t.encode() for t in texts]
    sizes = np.array([len(b) for b in raw])
    data, rows = _windows(raw)
    owner, first = np.repeat(np.arange(len(raw)), rows), np.cumsum(rows) - rows
    used = np.minimum(WINDOW, np.repeat(sizes, rows) - (np.arange(len(data)) - first[owner]) * WINDOW)
    total, ones = np.zeros((len(raw), len(model["langs"]))), np.ones((len(model["langs"]), 1), np.float32)
    for s in range(0, len(data), LANES):
        x = np.ascontiguousarray(data[s : s + LANES].T)
        p = np.zeros((*x.shape, ones.shape[0]), np.float32)
        _fast(x, model["fore"], p, False)
        _fast(x, model["aft"], p, True)
        np.exp(np.minimum(p, 60, out=p), out=p)  # |state| < 1, so logits are small
        p /= p @ ones
        short = np.flatnonzero(used[s : s + LANES] < WINDOW)
        for k in short:
            p[used[s + k] :, k] = 0
        part = p.sum(0)
        for k in range(part.shape[1]):
            total[:, k] += np.bincount(owner[s : s + LANES], part[:, k], len(raw))
    return total / sizes[:, None]


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _drawn(share: dict[str, int]):
    """The texts as bytes, or of those with more windows than their language's share so many windows, drawn by the document's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            out = []
            for lang, h, text in zip(b.column("lang").to_pylist(), b.column("h").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                data, most = _windows([text])[0], share[lang]
                if len(data) > most:
                    text = data[np.sort(np.random.default_rng(h & (2**63 - 1)).integers(0, len(data), most))].tobytes()
                out.append(text)
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("h"), pa.array(out, pa.binary())], ["lang", "h", "windows"])

    return run


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE, draws: int = STEPS * BATCH) -> list[tuple[bytes, str]]:
    """Windows of at most per_language documents a language, the distinct (lang, doc_id) of smallest hash: a list bounded in bytes.

    Hashes alone are ranked, then the texts at or under each language's last hash are read, and their windows drawn on the executors.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}") & ~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id", F.lit("sample")))
    # first in each of SALTS parts of a language, so that no task ranks a whole language
    parts = Window.partitionBy("lang", F.pmod("h", F.lit(SALTS))).orderBy("h")
    top = known.select("lang", "h").distinct().withColumn("r", F.row_number().over(parts)).where(F.col("r") <= per_language)
    top = top.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= per_language)
    found = top.groupBy("lang").agg(F.max("h").alias("h"), F.count("*").alias("n")).collect()
    if not found:
        return []
    bound = F.create_map(*[F.lit(x) for r in found for x in (r["lang"], r["h"])])
    share = {r["lang"]: -(-draws // (len(found) * r["n"])) for r in found}
    # repeated doc_ids give one text each, reduced where they are read
    texts = known.where(F.col("h") <= F.try_element_at(bound, F.col("lang"))).groupBy("lang", "h").agg(F.max("text").alias("text"))
    drawn = texts.mapInArrow(_drawn(share), "lang string, h long, windows binary").collect()
    return [(bytes(r["windows"]), r["lang"]) for r in sorted(drawn, key=lambda r: (r["lang"], r["h"]))]


def _predict(model: dict, batch_chars: int = 4_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 2048):
            texts, best = b.column("_text").to_pylist(), [(NONE, 0.0)] * b.num_rows
            todo = [i for i, t in enumerate(texts) if t is not None]
            while todo:
                n, size = 0, 0
                while n < len(todo) and (n == 0 or size + len(texts[todo[n]]) < batch_chars):
                    size += len(texts[todo[n]])
                    n += 1
                p = probabilities([texts[i] for i in todo[:n]], model)
                for i, row in zip(todo[:n], p):
                    best[i] = (model["langs"][row.argmax()], min(1.0, float(row.max())))
                todo = todo[n:]
            cols = [pa.array([x[0] for x in best]), pa.array([x[1] for x in best])]
            rest = [k for k, f in enumerate(b.schema) if f.name != "_text"]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in rest), *cols], [*(b.schema.names[k] for k in rest), "_lang", "_score"])

    return run


def _with_prediction(docs: DataFrame, row: dict, model: dict | None) -> DataFrame:
    """row: output name -> column; adds _lang and _score."""
    text = F.when(F.col("text").rlike("\\p{L}"), F.col("text"))
    if model is None:
        return docs.select(*[c.alias(k) for k, c in row.items()], F.lit(NONE).alias("_lang"), F.lit(0.0).alias("_score"))
    base = docs.select(*[c.alias(k) for k, c in row.items()], text.alias("_text"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name != "_text")
    return base.mapInArrow(_predict(model), f"{kind}, _lang string, _score double")


def predict_languages(docs: DataFrame) -> DataFrame:
    model = train(training_sample(docs))
    out = _with_prediction(docs, {"doc_id": F.col("doc_id"), "held_out": held_out(F.col("doc_id"))}, model)
    return out.select("doc_id", "held_out", F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def language_filter(docs: DataFrame, least_score: float = 0.5, wanted: set[str] | None = None) -> DataFrame:
    """The rows whose text has a language, told with at least least_score (and one of `wanted`, if given)."""
    model = train(training_sample(docs))
    row = {"doc": F.struct(*[F.col(f"`{c}`") for c in docs.columns])}
    out = _with_prediction(docs, row, model).where((F.col("_lang") != NONE) & (F.col("_score") >= least_score))
    return (out.where(F.col("_lang").isin(*wanted)) if wanted else out).select("doc.*")
