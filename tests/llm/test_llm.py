"""Operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("stanzaflow.llm")
import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from oracle import connect, same  # noqa: E402

from stanzaflow.llm import common, html_text, language_id, near_dedup, nearest, packing, quality_rules, queries, resampling, secret_scans, sentence_pieces, sharding  # noqa: E402

SF = "/root/testdata/sf0.001"
BPE, SP = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = " ".join(f"w{i} common word{i % 7}" for i in range(60))
EDGES = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", None), (4, "one two", None, "a"), (5, BASE, "en", "a"), (6, BASE, "en", "a"), (6, BASE, "en", "a"), (None, BASE, "en", "a"),
    (7, BASE.replace("w59", "x"), "en", "a"), (8, "long text here " * 4000, "en", "a"), (9, "Password: abcdefghijkl 0123456789abcdef", "en", "a"), (10, "é ü 日本 ÇA " * 30, "fr", "b"), (None, None, None, None),
]


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, t, la, s, None, f"x{n}") for n, (i, t, la, s) in enumerate(EDGES)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `doc` string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def none(edges):
    return edges.where("false")


def test_quality_counts(edges, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality_rules.quality_verdicts(docs).collect():
        t = texts[r.doc_id]
        w = WORD.findall(t)
        n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.quality_verdicts(edges).count() == len(EDGES)


def test_quality_filter_keeps_columns(edges, none):
    assert quality_rules.quality_filter(edges).columns == edges.columns
    assert quality_rules.quality_filter(none).count() == 0 and quality_rules.quality_verdicts(none).count() == 0


def test_sketch_bucket(spark):
    got = spark.createDataFrame([(x,) for x in (0, 127, 128, 255, 256, 1000, 10**12 + 7)], "x long").select("x", quality_rules.sketch_bucket(F.col("x")).alias("b")).collect()
    for r in got:
        assert r.b <= r.x and r.x - r.b <= r.x / 64


def test_shards(edges, docs, none):
    rows = sharding.shuffle_into_shards(docs, 7).collect()
    n = Counter(r.shard for r in rows)
    assert len(rows) == 200 and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    assert Counter(r.doc_id for r in sharding.shuffle_into_shards(edges, 40).collect()) == Counter(e[0] for e in EDGES)
    assert sharding.shuffle_into_shards(none, 4).count() == 0


def test_communication_matrix_law():
    for seed in range(20):
        counts = [random.Random(seed).randint(0, 60) for _ in range(9)]
        m = sharding.communication_matrix(counts, 5, seed)
        assert [sum(r) for r in m] == counts and [sum(c) for c in zip(*m)] == sharding.shard_sizes(sum(counts), 5)
    rng = random.Random(1)
    draws = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(20_000)]
    assert abs(np.mean(draws) - 6) < 0.05 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.15


def brute_shingles(text, k):
    """The words themselves, none of the operator's hashes."""
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, num):
    sets = [brute_shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                up[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, len(sets[i]), least.get(top(i)) if d is not None else None) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("k,num", [(3, 85), (5, 80)])
def test_components(edges, docs, k, num):
    both = docs.select("doc_id", "text").union(edges.select(F.col("doc_id") + 10**6, "text"))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.components(both, k, num).collect()), key=str)
    assert got == brute_components([(r.doc_id, r.text) for r in both.collect()], k, num)


def test_shingles_and_sketch():
    assert len(near_dedup.shingle_set("A b", 3)) == 1 and not len(near_dedup.shingle_set(" \n", 3)) and not len(near_dedup.shingle_set(None, 3))
    assert (near_dedup.shingle_set("A B c d", 3) == near_dedup.shingle_set("a b C D", 3)).all()
    one = near_dedup.sketch(np.array([5], np.uint64))
    assert (one != np.iinfo(np.uint64).max).all()
    rng = np.random.default_rng(0)
    pool = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    a, b = pool[:1000], pool[100:1100]
    assert abs((near_dedup.sketch(a) == near_dedup.sketch(b)).mean() - 900 / 1100) < 0.15


def test_dedup_keeps_one(edges, none):
    kept = near_dedup.deduplicated(edges)
    assert kept.columns == edges.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 5, 8, 9, 10}
    assert near_dedup.components(none).count() == 0


def test_pack(edges, docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    both = docs.select("doc_id", "text").union(edges.select(F.coalesce("doc_id", F.lit(77)) + 10**6, "text").distinct()).union(both_spaces(docs.sparkSession))
    rows = packing.pack(both, BPE).collect()
    for r in both.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [0]
        mine = sorted((x for x in rows if x.doc_id == r.doc_id), key=lambda x: x.piece)
        if len({x.piece for x in mine}) == len(mine):
            assert sum(x.length for x in mine) == len(ids)
            assert all(zlib.crc32(np.array(ids[x.start : x.start + x.length], "<u4").tobytes()) == x.ids_crc32 for x in mine)
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert at.get(r.sequence_id, 0) == r.offset
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 2048 and len(at) <= -(-sum(r.length for r in rows) // 2048) + 2
    assert packing.pack(none, BPE).count() == 0


def both_spaces(spark):
    odd = ["  a  b", "\n x", " ", "a ", "a \n b", " \t b  c d  e", "it's  's", "<|endoftext|> x"]
    return spark.createDataFrame([(2 * 10**6 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")


def test_plan_bins():
    for seed in range(60):
        r = random.Random(seed)
        cap = r.choice([10, 30, 2048])
        n = Counter(min(cap, 1 + int(r.expovariate(6 / cap))) for _ in range(r.randint(0, 3000)))
        used, got = Counter(), Counter()
        for length, a, b, first, _ in packing.plan_bins(dict(n), cap):
            got[length] += b - a
            for k in range(b - a):
                used[first + k] += length
        assert got == n and all(v <= cap for v in used.values())


def base_spans(t):
    out = []
    for order, (kind, p, flags, group, least) in enumerate(secret_scans.BASE_RULES):
        out += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, t, flags) if len(m[group]) >= least]
    return ",".join(x[2] for x in sorted(out))


def test_secrets(spark, edges, docs, none):
    odd = spark.createDataFrame([(10**7, "token=secret=abcdefghijkl AKIAABCDEFGHIJKLMN toſen=abcdefghijklmn API-KEY:'x' api_key: \"Abc/def+ghi=jk.l\" 😀 deadbeefdeadbeef0"), (10**7 + 1, "token:secret:abcdefghijklmno")], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(edges.select("doc_id", "text")).union(odd)
    want = Counter((r.doc_id, hashlib.sha256(base_spans(r.text or "").encode()).hexdigest()) for r in both.collect())
    got = secret_scans.report(both).collect()
    assert Counter((r.doc_id, r.base_sha256) for r in got) == want
    assert secret_scans.report(none).count() == 0
    clean = secret_scans.redacted(edges)
    assert clean.columns == edges.columns and clean.count() == len(EDGES)
    assert [r.text for r in clean.where("doc_id = 9").collect()] == ["[SECRET] [SECRET]"]


def test_added_secrets(spark):
    """Spans of the rules beyond the base, the rows that the test before the patterns lets pass, and masks over overlaps."""
    pem = "-----BEGIN RSA PRIVATE KEY-----\nMIIabc/+=\nxyz\n-----END RSA PRIVATE KEY-----"
    jwt, forge = "eyJhbGciOiJI.eyJzdWIiOiIx.s_fl-KxwRJSM", "ghp_ABCDEFGHIJKLMNOPqrst"
    texts = [f"é {pem} x", f"a {jwt} b", f"{forge}, glpat-{'y' * 20} ghp_short", f"token={jwt}", "the secret: a token = of trust", "AKIA1234 eyJ.eyJ ghp", "-----BEGIN PRIVATE KEY-----", None, ""]
    want = [f"pem:2:{2 + len(pem)}", f"jwt:2:{2 + len(jwt)}", f"forge:0:{len(forge)},forge:{len(forge) + 2}:{len(forge) + 28}", f"assign:0:{6 + len(jwt)},jwt:6:{6 + len(jwt)}", "", "", "", "", ""]
    rows = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "doc_id long, text string, findings string")
    got = {r.doc_id: r.spans for r in secret_scans.report(rows).collect()}
    assert [got[i] for i in range(len(texts))] == want
    clean = {r.doc_id: r for r in secret_scans.redacted(rows).collect()}
    assert [clean[i].text for i in range(len(texts))] == ["é [SECRET] x", "a [SECRET] b", "[SECRET], [SECRET] ghp_short", "[SECRET]", *texts[4:]]
    assert all(clean[i].findings == t for i, t in enumerate(texts)) and secret_scans.redacted(rows.where("false")).count() == 0


def test_may_hold_is_complete(spark):
    """No text with a finding fails the test that keeps texts from moving."""
    rng = random.Random(5)
    bits = ["password", "PassWD", "secret", "tokEN", "api_key", "APIkey", "'", '"', " ", ":", "=", "AKIA", "ABCDEFGHIJKLMN", "abcdef0123", "456789ab", "-----BEGIN PRIVATE KEY-----", "abcdefg==", "eyJabcd", ".", "ghp_", "glpat-", "xoxb-", "ZZZZZZZZZZ", "\n", "ſ", "K"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", secret_scans.may_hold(F.col("text")).alias("may")).collect()
    found = [r for r in rows if secret_scans.find(r.text)]
    assert len(found) > 300 and all(r.may for r in found) and sum(r.may for r in rows) < 4000


def test_ledger_scans_only_unseen(edges, docs):
    first = secret_scans.update_ledger(docs.select("text"))
    again = secret_scans.update_ledger(docs.select("text").union(edges.select("text")), first)
    new = edges.select(secret_scans.blob_id(F.col("text")).alias("blob")).distinct().count()
    assert again.count() == first.count() + new == again.select("blob").distinct().count()
    both = docs.select("doc_id", "text").union(edges.select("doc_id", "text"))
    fresh, kept = (Counter(map(tuple, secret_scans.report(both, book).collect())) for book in (None, first))
    assert fresh == kept


def test_language(spark, edges, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.predict_languages(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97
    out = language_id.predict_languages(edges).collect()
    assert len(out) == len(EDGES) and all(r.lang_pred == "und" for r in out if r.doc_id in (1, 2, 3))
    assert language_id.predict_languages(none).count() == 0 and language_id.language_filter(edges).columns == edges.columns


def test_language_gradient():
    """Backpropagation through time against finite differences."""
    rng = np.random.default_rng(0)
    p = {k: rng.normal(0, 0.5, (256, 3)) for k in ("tz", "tr", "tc")} | {k: rng.normal(0, 0.5, (3, 3)) for k in ("uz", "ur", "uc")} | {"out": rng.normal(0, 0.5, (3, 2))}
    x, d = rng.integers(97, 100, (5, 4)), rng.normal(0, 1, (5, 4, 2)).astype(np.float32)
    g = language_id._back(x, p, language_id._run(x, p)[1], d)
    for name in p:
        i = tuple(97 if n == 256 else 1 for n in p[name].shape)
        near = []
        for s in (1e-2, -1e-2):
            q = {k: v.copy() for k, v in p.items()}
            q[name][i] += s
            near.append((language_id._run(x, q)[0] * d).sum())
        assert abs((near[0] - near[1]) / 2e-2 - g[name][i]) < 2e-2


def test_html(spark):
    tree = html_text.trained()
    page = (
        "<head><title>T</title><script>var t='</p>'</script></head><header><h1>Site</h1></header><nav><a href=x>a</a> b</nav><div class='sidebar'><p>one two three four five six</p></div><div class=\"cookie-notice\">we use</div>"
        "<main><article><h2>T &amp; x</h2><p>Hello <b>w</b>orld<br>line\n\t end<p>Of.<form>f<input></form><section id=comments><p>nice post very good post indeed</p></section></article></main><footer>f"
    )
    assert html_text.main_text(page, tree) == "T & x\n\nHello world line end\n\nOf."
    assert html_text.main_text(None, tree) == "" and html_text.main_text("<script>x", tree) == "" and html_text.main_text("<!-- x", tree) == ""
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (2, None, "")], "page_id long, url string, html string")
    assert [(r.page_id, r.n_chars) for r in html_text.extract(rows).orderBy("page_id").collect()] == [(1, len("T & x\n\nHello world line end\n\nOf.")), (2, 0), (2, 0)]
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert all(r.text and r.n_chars == len(r.text) for r in html_text.extract(pages).collect())


def test_nearest(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = nearest.search(table, table.where("vec_id % 50 = 0"), leaf=40).collect()
    rows = table.orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows], np.float64), np.array([r.vec_id for r in rows])
    norm = np.sqrt((x * x).sum(1))
    hits = n = 0
    for q in ids[ids % 50 == 0]:
        s = (x * x[ids == q]).sum(1) / (norm * norm[ids == q])
        s[ids == q] = -9
        best = ids[np.lexsort((ids, -s))[:5]]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5] and all(abs(r.score - s[ids == r.vec_id][0]) < 1e-12 for r in mine)
        hits, n = hits + len({r.vec_id for r in mine} & set(best.tolist())), n + 5
    assert hits / n >= 0.9


def test_nearest_edges(spark):
    kind = "vec_id long, embedding array<float>, label int"
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (None, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [1.0])]
    t = spark.createDataFrame([(*r, 0) for r in rows], kind)
    got = nearest.search(t, t.where("vec_id % 50 = 0")).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 1), (0, 2), (0, 7)]
    assert nearest.search(t.where("false"), t.where("false")).count() == 0


@pytest.mark.parametrize("block, hubs, shingles", [(8, 2, 8_000_000), (6, 1, 8_000_000), (256, 2, 900)])
def test_large_groups_in_blocks(spark, monkeypatch, block, hubs, shingles):
    """Chains whose ends are far apart, and a crowd of near copies, in groups of many blocks, by their rows or by their shingles."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", shingles)
    monkeypatch.setattr(near_dedup, "HUBS", hubs)
    rng = random.Random(3)
    word = lambda: f"v{rng.randrange(10**6)}"
    line = [word() for _ in range(100 + 4 * 45)]
    rows = [(i, " ".join(line[4 * i : 4 * i + 100])) for i in range(45)]
    base = [word() for _ in range(120)]
    rows += [(100 + i, " ".join(base[: 2 * i] + [word()] + base[2 * i + 1 :])) for i in range(50)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect())
    assert got == sorted(brute_components(rows, 3, 85))


def test_resampling(spark, edges, docs, none):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = resampling.resample(docs, labels, 0.5).collect()
    assert len(rows) == 200 and sum(r.selected for r in rows) == 100
    assert min(r.noisy for r in rows if r.selected) >= max(r.noisy for r in rows if not r.selected)
    assert resampling.resample(edges, labels).count() == len(EDGES) and resampling.resample(none, labels).count() == 0


def test_sentence_pieces(spark, edges, docs, none):
    p = sentence_pieces.processor(SP)
    odd = ["a  b", " a b ", "", "x\n\ny", "日本語 ẞ", "é ﬁ ½", "q" * 100 + " z", None, "▁x y"]
    both = docs.select("doc_id", "text").limit(40).union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in both.collect()}
    got = sentence_pieces.encode(both, SP)
    rows = {r.doc_id: list(r.ids) for r in got.collect()}
    assert rows == {k: p.encode(t) for k, t in texts.items()}
    back = sentence_pieces.decode(spark.createDataFrame(list(rows.items()), "key long, ids array<int>"), SP).collect()
    assert {r.key: r.text for r in back} == {k: p.decode(v) for k, v in rows.items()}
    assert sentence_pieces.encoded_digest(none, SP).count() == 0


def test_pipeline(spark, tmp_path):
    """The pipeline against its stages worked by hand on the texts."""
    import corpus_pipeline

    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.quality_verdicts(docs).where("kept").collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    ids = {r.doc_id for r in out}
    assert ids <= kept and len(ids) > 0.6 * len(kept)
    comp = brute_components([(d, rows[d]) for d in sorted(kept)], 5, 80)
    assert ids <= {c[0] for c in comp if c[0] == c[2]}
    ordered = {s: k for k, (s, _) in enumerate(corpus_pipeline.STAGES)}
    assert list(ordered) == ["quality_rules", "language_id", "near_dedup", "secret_scans", "best_fit_packing"]


def test_lattice_against_library():
    """Ids of odd, random and long words, byte pieces and ties included, and across a cleared word cache."""
    import pyarrow as pa

    rng = random.Random(3)
    texts = ["", None, "  a  b ", "▁x▁▁y", "日本語 テキスト", "a" * 40, "é" * 30, "x" * 200, " " * 70, "😀😀 ÿ\n\t"]
    texts += ["".join(rng.choice("abe ▁é日\n") for _ in range(400)) for _ in range(40)]
    texts += ["".join(rng.choice(x) for _ in range(n)) for x, n in (("etaoinshrdlu", 30_000), ("ab", 5000), ("=-_/.0123456789abcdef", 4000), ("é日😀ste", 2000), ("▁", 300), ("the", 49), ("aé", 48))]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    p = sentence_pieces.processor(SP)
    want = [p.encode(t) if t else [] for t in texts]
    kept = sentence_pieces.KNOWN_WORDS
    try:
        for sentence_pieces.KNOWN_WORDS in (kept, 1):
            got = [np.frombuffer(x, "<i4").tolist() for _, ids in sentence_pieces._texts(iter([batch, batch]), SP) for x in ids]
            assert got == want * 2
    finally:
        sentence_pieces.KNOWN_WORDS = kept


def brute_kept(rows, weight=30):
    """op8's verdicts from the texts alone. rows: (lang, source, text)."""
    def measures(t):
        w, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = len({j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)})
        chars, nw, nl = sum(map(len, w)), max(len(w), 1), max(len(lines), 1)
        tops = [(len(re.findall(r"[#*$%&|<>]", t or "")), 1000, nw, 1), ((t or "").count("!"), 1000, nw, 1), (len(lines) - len(set(lines)), 1000, nl, 1), (covered, 1000, nw, 6), (len(re.findall("[A-Z]", t or "")), 1000, max(chars, 1), 1), (chars, 100, nw, 1)]
        return len(w) < 50 or 100 * covered > 50 * len(w), [(a * u // of, -(-one * u // of)) for a, u, of, one in tops]

    def bucket(x):
        drop = max(x.bit_length() - 7, 0)
        return x >> drop << drop

    made = [(la, so, *measures(t)) for la, so, t in rows]
    pools = {}
    for la, so, failed, m in made:
        for k in ((la, so), la, "all"):
            if not failed:
                pools.setdefault(k, []).append([bucket(v) for v, _ in m])

    def tenths(j, *keys):
        """Those of the first key's pool, drawn towards those of the keys after it."""
        xs = sorted(p[j] for p in pools[keys[0]])
        own = [xs[-(-q * len(xs) // 10) - 1] for q in (1, 5, 9)]
        return [(len(xs) * a + weight * b) // (len(xs) + weight) for a, b in zip(own, tenths(j, *keys[1:]))] if len(keys) > 1 else own

    out = []
    for la, so, failed, m in made:
        ok = not failed
        for j, (v, step) in enumerate(m):
            if ok:
                a, b, c = tenths(j, (la, so), la, "all")
                ok = a - 3 * (b - a) - step <= v <= c + c // 64 + 3 * (c - b) + step
        out.append(ok)
    return out


def test_quality_kept(spark, docs):
    """Verdicts of groups of every size, null groups too; a text of twelve symbols in a thousand words goes where nobody uses them."""
    rows = [(r.doc_id, r.text, None if r.doc_id % 9 == 1 else r.lang, None if r.doc_id % 7 == 0 else r.source) for r in docs.collect()] + [(10**6, " ".join(f"w{i}{' & ' if i % 80 == 0 else ''}" for i in range(1000)), "en", "src0")]
    for weight in (0, 2, 30):
        want = brute_kept([(la, so, t) for _, t, la, so in rows], weight)
        got = {r.doc_id: r.kept for r in quality_rules.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), weight=weight).collect()}
        assert got == dict(zip((r[0] for r in rows), want))
        assert 0.5 * len(rows) < sum(want) < len(rows) and (weight < 30 or not got[10**6])


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert same(spark, connect(SF), SF, queries.queries()[name], queries.oracle_sql()[name]) == {"op13_clustering": 500}.get(name, 200)


def test_packed_sequences(docs):
    """The ids of every document can be read back out of the packed sequences."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    packed = packing.pack(docs, BPE, 512)
    found = {}
    for r in packing.sequences(packed).collect():
        ends = [x.offset for x in r.starts[1:]] + [r.n_tokens]
        assert r.n_tokens == len(r.ids) <= 512 and r.starts[0].offset == 0
        for x, end in zip(r.starts, ends):
            found.setdefault(x.doc_id, {})[x.start] = list(r.ids[x.offset : end])
    for r in docs.collect():
        got = [i for _, ids in sorted(found[r.doc_id].items()) for i in ids]
        assert got == tok.encode(r.text, add_special_tokens=False).ids + [0]


def test_shards_hold_the_documents(edges, docs):
    """Every column of every row arrives, repeated and null ids included, in other order than it left."""
    for given, n in ((docs.repartition(5), 7), (edges, 3)):
        rows = sharding.shuffle_into_shards(given, n).collect()
        assert Counter(tuple(r.doc) for r in rows) == Counter(map(tuple, given.collect())) and list(rows[0].doc.asDict()) == given.columns
        assert all(r.doc_id == r.doc.doc_id and r.text_crc32 == zlib.crc32((r.doc.text or "").encode()) for r in rows)
        assert sorted((r.shard, r.slot) for r in rows) == sorted((s, k) for s, m in enumerate(sharding.shard_sizes(len(rows), n)) for k in range(m))
    order = [r.doc_id for r in sorted(sharding.shuffle_into_shards(docs.coalesce(1), 1).collect(), key=lambda r: r.slot)]
    assert order != sorted(order)
    here, n = docs.coalesce(1), 2
    first = {r.doc_id for r in sharding.shuffle_into_shards(here, n).where("shard = 0").collect()}
    assert first != {r.doc_id for r in here.limit(len(first)).collect()}


def test_decode_every_row(spark, edges):
    """Rows that share or lack a key decode on their own; bytes that make no character give what the library gives."""
    p = sentence_pieces.processor(SP)
    texts = [t for _, t, *_ in EDGES]
    back = sentence_pieces.decode(sentence_pieces.encode(edges, SP), SP)
    assert back.columns == ["doc_id", "text"]
    want = [(d, p.decode(p.encode(t or ""))) for (d, *_), t in zip(EDGES, texts)]
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(want)
    digest = sentence_pieces.encoded_digest(edges, SP).collect()
    assert Counter((r.doc_id, r.text_crc32) for r in digest) == Counter((d, zlib.crc32(t.encode())) for d, t in want)
    byte, rng = [i for i in range(p.vocab_size()) if p.is_byte(i)], random.Random(1)
    rows = [([300, *(rng.choice(byte) for _ in range(rng.randint(0, 6))), 400],) for _ in range(200)]
    assert [r.text for r in sentence_pieces.decode(spark.createDataFrame(rows, "ids array<int>").coalesce(1), SP).collect()] == [p.decode(r[0]) for r in rows]
    odd = spark.createDataFrame([(1, None), (1, []), (1, [10**6, -5, None])], "key long, ids array<int>")
    assert [tuple(r) for r in sentence_pieces.decode(odd, SP).collect()] == [(1, "")] * 3


def test_dedup_by_rows(spark):
    """Clean rows without id stay, and one row of each component, whatever ids it repeats."""
    rng = random.Random(8)
    text = lambda: " ".join(f"v{rng.randrange(10**6)}" for _ in range(80))
    a, b, c, d = text(), text(), text(), text()
    rows = [(None, a, 0), (None, b, 1), (6, b, 2), (6, b, 3), (7, c, 4), (6, c + " end", 5), (6, d, 6), (None, d, 7), (None, a, 8), (9, "", 9), (None, "", 10)]
    kept = near_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, n int").coalesce(1)).collect()
    assert sorted(r.n for r in kept) == [0, 2, 5, 6, 9]


def test_html_text_survives():
    """Self-closed and unclosed elements take no text along; class names that only contain a part's name do not hide an article."""
    tree = html_text.trained()
    tags = ("<svg class=i />", "<math x='1'/>", "<button>", "<object data=x>", "<video src=x>", "<select>", "<svg viewBox='0'><path/><svg>in</svg>in</svg>", "<button>B</button>", "<svg/><svg><text>in</text></svg>")
    for tag in tags:
        assert html_text.main_text(f"<article><p>one two three four five</p>{tag}<p>six seven eight nine ten</p></article>", tree) == "one two three four five\n\nsix seven eight nine ten", tag
    assert html_text.main_text("<main><p>one two three</p><button><p>four five six</p><button>x</button></main>", tree) == "one two three\n\nfour five six"
    for top in ("article class='post tag-news'", "main class='content has-sidebar'", "main id=main-content class=no-comments"):
        assert html_text.main_text(f"<body><{top}><p>one two three four five</p></{top.split()[0]}>", tree) == "one two three four five"
    assert html_text.main_text("<body><article class='x sidebar'><p>one two three four five</p></article>", tree) == ""


def test_pack_added_tokens(spark, tmp_path):
    """The query's ids are the library's own, without any flag, where a text holds an added token."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    texts = ["@ <|endoftext|> x", "<|endoftext|>", "a<|endoftext|><|endoftext|> b  ", "it's <|endoftext|>\n\n y <|endoftext", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.length, r.ids_crc32) for r in queries.op4_packing(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_pipeline_stage_by_stage(spark):
    """What run() gives, ids and masked texts and pieces, equals the stages worked one by one outside Spark; only the trained language predictor is the library's own."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    tok = Tokenizer.from_file(BPE)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = docs.collect()
    good = brute_kept([(r.lang, r.source, r.text) for r in given])
    kept = {r.doc_id: r.text for r, ok in zip(given, good) if ok}
    assert {r.doc_id for r in quality_rules.quality_filter(docs).collect()} == set(kept)
    told = language_id.predict_languages(docs.where(F.col("doc_id").isin(list(kept)))).collect()
    kept = {r.doc_id: kept[r.doc_id] for r in told if r.lang_pred != "und" and r.score >= 0.5}
    kept = {d: kept[d] for d, _, c in brute_components(sorted(kept.items()), 5, 80) if d == c}
    want = {}
    for d, t in kept.items():
        hit = [False] * len(t)
        for _, s, e in secret_scans.find(t):
            hit[s:e] = [True] * (e - s)
        starts = {s for s, _ in secret_scans.merged((s, e) for _, s, e in secret_scans.find(t))}
        clean = "".join("[SECRET]" if i in starts else "" if h else c for i, (c, h) in enumerate(zip(t, hit)))
        want[d] = tok.encode(clean, add_special_tokens=False).ids + [0]
    got = {}
    for r in sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: r.start):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
        assert r.length * 4 == len(r.ids) <= 4 * 2048
    assert got == want


def test_stored_folders_go(spark, docs, tmp_path):
    """What a scope stores is gone after it, what it keeps goes with the scope around it."""
    import os

    before = set(os.listdir(common.shared_dir(spark)))
    with common.scratch(spark):
        with common.scratch(spark):
            common.stored(docs.limit(1), "inner")
            kept = common.stored(docs.limit(3), "outer", keep=True)
        assert kept.count() == 3 and len(set(os.listdir(common.shared_dir(spark))) - before) == 1
    assert set(os.listdir(common.shared_dir(spark))) == before
    near_dedup.components(docs).count()
    left = set(os.listdir(common.shared_dir(spark))) - before
    assert sorted(x.split("-")[0] for x in left) == ["linked", "sketches"]


def test_dedup_repeated_rows(spark):
    """An id and a row that repeat very often, also as the least of a group of near copies."""
    rng = random.Random(4)
    base = [f"v{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(1, " ".join(base))] * 40 + [(1, f"other {i} " + " ".join(f"u{i}x{j}" for j in range(60))) for i in range(30)] + [(2 + i, " ".join(base[:-1]) + f" z{i}") for i in range(12)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect())
    assert got == sorted(brute_components(rows, 3, 85))


HELD_OUT = [
    # a weblog of plain boxes: nothing names its boilerplate
    ("""<body><div><a href=/>My little kitchen</a></div><div><a href=/a>Home</a></div><div><a href=/b>All recipes</a></div><div><h2>*How I learned to bake bread in a cold house</h2>
    <div>*For many years I thought that dough needs a warm place, and so I waited for summer before I tried again, until a neighbour told me that cold is no enemy of yeast at all.</div>
    <div>*It only takes its time: a night and half a day on the stone floor of the cellar, under a cloth, and the loaf rises as it should. Here is <a href=/c>the list</a> of what I use.</div>
    <ul><li>*Five cups of flour and one of rye</li><li>*Water as it comes from the well</li></ul></div><div><a href=/d>How to keep a sourdough alive through winter</a></div>
    <div>Filed under: <a href=/e>bread</a>, <a href=/f>winter</a></div><div>Copyright 2019 by the cook. All rights reserved.</div></body>"""),
    # an article whose boxes are called what they aren't, with a formula, an object and readers' comments
    ("""<body><nav><a href=1>One</a> <a href=2>Two</a></nav><article class="post tag-law"><h1>*On the length of treaties</h1><div class="legal-note"><p>*The parties agreed in the spring that the text should be short, and that every clause be read aloud twice before it was signed by anyone at all.</p></div>
    <div class="social-history"><p>*Such readings were feasts in small towns, and people walked for days to hear them, whatever the weather was like in those mountains.</p></div><p>*It holds that <math><mi>a</mi><mo>+</mo><mi>b</mi></math> is even.</p>
    <object data=x.swf><p>*The chart shows how long each treaty was, in lines, over two centuries of peace and war between the towns.</p></object>
    <section class="post-comments"><h3>Comments</h3><p>I disagree with almost every word of this, as my grandfather signed one of these treaties and never heard it read aloud, not even once in his life.</p></section></article>
    <div class="site-footer"><p>Some words about us and where to find our house</p></div></body>"""),
    # a cookie line and a sign-up line that nothing names
    ("""<body><div>We use cookies to make this site better for you. <a href=p>More</a></div><div><a href=1>News</a></div><div><a href=2>Sport</a></div><main><h1>*Rain</h1><p>*It rained.</p><p>*Nobody in the valley had seen so much water since the year the mill burned down.</p></main>
    <div>Subscribe to our newsletter and hear of rain first</div><div>© 2020 The Valley Post</div></body>"""),
]


def test_html_held_out():
    """Blocks that stand for other pages than the table's: those marked * are content. The word list alone is wrong on a fifth of them."""
    tree, right, named, n = html_text.trained(), 0, 0, 0
    for page in HELD_OUT:
        blocks = html_text.blocks_of(page)
        want = [b[0].startswith("*") for b in blocks]
        got = html_text.verdicts([(b[0].removeprefix("*"), *b[1:]) for b in blocks], tree)
        right += sum(bool(g) == w for g, w in zip(got, want))
        named += sum((b[3] == 0) == w for b, w in zip(blocks, want))
        n += len(blocks)
    assert right == n and named < 0.8 * n, (right, named, n)
    text = html_text.main_text(HELD_OUT[1], tree)
    assert "It holds that a+b is even." in text and "The chart shows" in text


def test_html_table(spark):
    """The tables' pages against a plain reading of their own markup; extra columns with clashing names, an empty table, repeated rows."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.blocks = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside = self.inside or tag == "article"
            self.blocks[-1] += " " if tag == "br" else ""
            if tag in ("p", "h1", "article"):
                self.blocks.append("")

        def handle_endtag(self, tag):
            self.inside = self.inside and tag != "article"
            if tag in ("p", "h1", "article"):
                self.blocks.append("")

        def handle_data(self, data):
            self.blocks[-1] += data if self.inside else ""

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.select("page_id", "url", "html", F.lit("x").alias("text"), F.lit(5).alias("n_chars"))
    got = Counter(map(tuple, html_text.extract(rows.union(rows)).collect()))
    want = Counter()
    for r in pages.collect():
        a = Article()
        a.feed(r.html)
        t = "\n\n".join(x for x in (" ".join(b.split()) for b in a.blocks) if x)
        want[(r.page_id, r.url, t, len(t))] += 2
    assert got == want and html_text.extract(rows.where("false")).count() == 0


def test_resampling_by_hand(spark, docs):
    """Log ratios, noise and the chosen rows from the texts alone; repeated and conflicting labels, rows with and without text."""
    import math

    import xxhash

    def h(*parts):
        seed = 42
        for x in parts:
            seed = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else x, seed=seed)
        return seed - 2**64 if seed >= 2**63 else seed

    odd = [(None, "a b"), (10**6, None), (10**6, ""), (10**6 + 1, "x " * 5000), (5, "again and again")]
    given = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + odd
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    labels += [(labels[0][0], 1, 0), (labels[0][0], 0, 1), (10**6 + 1, 1, None), (None, 1, 0), (5, 1, 0), (5, 1, 0)]
    good = {d for d, q, x in labels if q == 1 and not x and d is not None}
    n = 10_000
    raw, target, made = [1.0] * n, [1.0] * n, []
    for d, t in given:
        w = WORD.findall(t or "")
        f = [h(x) % n for x in w] + [h(x, y) % n for x, y in zip(w, w[1:])]
        made.append((d, f))
        for b in f:
            raw[b] += 1
            target[b] += d in good
    a, b = sum(target), sum(raw)
    want = Counter()
    for d, f in made:
        ratio = round(sum(math.log(target[x] / a) - math.log(raw[x] / b) for x in f), 6)
        u = ((h(d.to_bytes(8, "little"), (7).to_bytes(4, "little")) if d is not None else h((7).to_bytes(4, "little"))) % 2**64 >> 11) + 0.5
        want[(d, len(f), round(ratio - math.log(-math.log(u / 2**53)), 4))] += 1
    frame = spark.createDataFrame(given, "doc_id long, text string")
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = resampling.resample(frame, labelled, 0.7).collect()
    near = lambda r: (r.doc_id, r.n_features, round(r.noisy, 4))
    lost = want - Counter(map(near, rows))
    assert sum(lost.values()) <= 2, lost  # a last digit may round the other way
    order = sorted((r.noisy for r in rows), reverse=True)
    cut = order[math.ceil(0.7 * len(rows)) - 1]
    assert all(r.selected == (r.noisy >= cut - 1e-6) for r in rows)
    none = resampling.resample(frame, labelled.where("false"), 0.7).collect()
    assert len(none) == len(given) and all(r.log_ratio == 0 for r in none)


def test_nearest_recall_and_dimensions(spark):
    """At default settings nine of ten true neighbours are found on a larger table; queries shorter than the table's vectors have no answer."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    x, ids = np.array([r.embedding for r in rows], np.float64), np.array([r.vec_id for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    asked = np.flatnonzero(ids % 50 == 0)
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -9
    truth = {(int(ids[q]), int(ids[j])) for q, row in zip(asked, near) for j in np.argsort(-row)[:5]}
    got = {(r.query_id, r.vec_id) for r in nearest.search(table, table.where("vec_id % 50 = 0"), 5).collect()}
    assert len(got) == len(truth) and len(got & truth) >= 0.9 * len(truth)
    t = spark.createDataFrame([(i, [float(i + 1), 1.0, 2.0]) for i in range(9)] + [(50, [1.0, 2.0]), (100, [3.0])], "vec_id long, embedding array<float>")
    assert {r.query_id for r in nearest.search(t, t.where("vec_id % 50 = 0")).collect()} == {0}
    assert nearest.search(t, t.where("vec_id >= 50")).count() == 0


CLASH = "sum node low keys n comp rep blocks task length ids piece ordinal run f w b key blob findings _lang _score h cuts _row _at _part _rank _cell _u shard slot kept l lines grams n_words base_failed _f target noisy".split()


def test_clashing_columns(spark, docs):
    """Columns called as the operators call their own change no result."""
    some = docs.where("doc_id % 3 = 0")
    more = some.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASH)])
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, f in {
        "op1": lambda d: sentence_pieces.encoded_digest(d, SP), "op2": near_dedup.components, "op3": lambda d: sharding.shuffle_into_shards(d, 5).select("doc_id", "size", "text_crc32"),
        "op4": lambda d: packing.pack(d, BPE).select("doc_id", "piece", "start", "length", "ids_crc32"), "op5": lambda d: resampling.resample(d, labels.withColumn("text", F.lit(1))), "op8": quality_rules.quality_verdicts,
        "op9": secret_scans.report, "op10": lambda d: language_id.predict_languages(d).select("doc_id", "held_out"),
    }.items():
        assert Counter(map(tuple, f(more).collect())) == Counter(map(tuple, f(some).collect())), name
    for f in (near_dedup.deduplicated, secret_scans.redacted, quality_rules.quality_filter, language_id.language_filter):
        out = f(more)
        assert out.columns == more.columns and all(r["keys"] == "x3" for r in out.select("keys").collect())
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    clash = table.select("*", *[F.lit("x").alias(c) for c in ("leaf", "at", "draw", "d", "query", "block", "blocks", "score", "rank")])
    assert Counter(map(tuple, nearest.search(clash, clash.where("vec_id % 50 = 0")).collect())) == Counter(map(tuple, nearest.search(table, table.where("vec_id % 50 = 0")).collect()))


def test_pipeline_edges(spark, docs, tmp_path):
    """Nulls, repeated rows, very long texts, extra columns and an empty table go through all stages."""
    import corpus_pipeline

    rng = random.Random(6)
    prose = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.choice(['elan', 'oro', 'ist'])}{rng.randrange(30)}" for _ in range(n))
    one, two, long = prose(80), prose(90), prose(30_000)
    rows = [(None, None, None, None), (1, "", "en", "a"), (2, "few words", "en", "a"), (None, one, "en", None), (4, one, None, "a"), (4, one, "en", "a"), (5, two + " password = abcdefghijkl", "en", "a"), (6, long, "en", "a"), (None, two + " other end", "en", "a")]
    plain = [(r.doc_id + 1000, r.text, r.lang, r.source) for r in docs.limit(60).collect()]
    given = spark.createDataFrame(rows + plain, "doc_id long, text string, lang string, source string").withColumns({"doc": F.lit("d"), "keys": F.lit(None).cast("int"), "findings": F.lit(1)})
    given.write.parquet(f"{tmp_path}/some/documents.parquet")
    given.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    by_id = Counter(r.doc_id for r in out if r.piece == 0)
    assert by_id[4] <= 1 and by_id[5] <= 1 and by_id[1] == by_id[2] == by_id[None] == 0 and all(n == 1 for d, n in by_id.items() if d is not None)
    assert by_id[4] + by_id[5] == 2 and sum(n for d, n in by_id.items() if d is not None and d > 999) > 20
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_training_sample_takes_whole_texts(spark):
    """Texts come whole however long, one for each doc_id however often it is repeated, none of the held-out fold, no more than the bound."""
    text = lambda i: f"word{i} " * (3 if i % 9 else 3000)
    rows = [(i, text(i), "ab"[i % 2], i) for i in range(200)] + [(1, text(1), "b", 0)] * 50 + [(None, "null id", "a", 0), (300, None, "a", 0), (301, "12", "a", 0), (302, "no language", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, h int")
    may = {(text(i).encode(), "ab"[i % 2]) for i in range(200) if zlib.crc32(str(i).encode()) % 5}
    got = language_id.training_sample(docs.drop("h"))
    assert len(got) == len(set(got)) and set(got) == may
    some = language_id.training_sample(docs.drop("h"), 20)
    assert Counter(lang for _, lang in some) == {"a": 20, "b": 20} and set(some) < may
    assert language_id.training_sample(docs.drop("h").where("lang is null")) == [] and language_id.train([]) is None


def test_windows_hold_every_byte():
    raw = [b"x", b"y" * 48, b"z" * 49, bytes(range(1, 101))]
    data, rows = language_id._windows(raw)
    assert rows.tolist() == [1, 1, 2, 3]
    assert [part.tobytes().rstrip(b"\0") for part in np.split(data, np.cumsum(rows)[:-1])] == raw


def test_word_forms_against_library():
    """Ids of texts cut at blanks, line breaks and stops are the library's, whatever white space meets there."""
    from tokenizers import Tokenizer

    tok, ids, r = Tokenizer.from_file(BPE), packing.plain_ids(packing.encoder(BPE)), random.Random(3)
    for chars in (" \nab1'.sé", " \n\t\r\x0b\x1c\x85\xa0 　ab1'.,!?ßé漢́​", "ab \n.,:;"):
        for _ in range(5000):
            text = "".join(r.choice(chars) for _ in range(r.randint(1, 14)))
            assert ids(text) == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)
