"""The text operators against brute force, exact round trips and held-out labels, with the awkward rows each must survive."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.llm import forest, minhash, mixing, mixing_lm, packing, substring, tokens, toxicity, transport, urls
from millrace.llm.common import connected_components

SF = "/root/testdata/sf0.001"
WORDS = [f"w{k}" for k in range(400)]


def some_words(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """Texts with exact and near copies, shared passages, empty, null and very long ones; doc_id may be null or repeat."""
    rng = random.Random(5)
    base = some_words(rng, 120)
    passage = some_words(rng, 70)
    texts = [" ".join(base)] * 3
    for _ in range(60):
        near = list(base)
        for _ in range(rng.randrange(1, 5)):
            near[rng.randrange(120)] = rng.choice(WORDS)
        texts.append(" ".join(near))
    for _ in range(50):
        texts.append(" ".join(some_words(rng, rng.randrange(0, 60)) + passage + some_words(rng, rng.randrange(0, 60))))
    texts += ["", None, " \n\t", "One two", "one TWO", "é à ü", "a\x0bb\x0cc", " ".join(some_words(rng, 20_000))]
    texts += [" ".join(some_words(rng, rng.randrange(1, 90))) for _ in range(40)]
    out = [(k, t, f"s{k % 3}" if k % 5 else "s0") for k, t in enumerate(texts)]
    return [*out, out[0], (None, texts[0], "s1"), (None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    x = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return x.withColumns({"id": F.lit("clash"), "n": F.lit(1), "key": F.lit(None).cast("string"), "v": F.lit(2), "rep": F.lit("x"), "h": F.lit(0.5), "copy": F.lit("c")}).repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < -1")


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(None, 3), (5, 5)] + [(k, k + 1) for k in range(1000, 1100)]
    lab = {}
    for a, b in edges:
        if a is not None and a != b:
            lab.setdefault(a, a), lab.setdefault(b, b)
    while True:
        before = dict(lab)
        for a, b in edges:
            if a is not None and a != b:
                lab[a] = lab[b] = min(lab[a], lab[b])
        if before == lab:
            break
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["component_id"] for r in got} == lab


def test_minhash(docs, rows, empty):
    got = minhash.near_duplicates(docs).toPandas()
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows if i is not None}
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(comp[a], comp[b])
            changed |= comp[a] != low or comp[b] != low
            comp[a] = comp[b] = low
    known = got[got.doc_id.notna()]
    assert all(comp[int(i)] == c and len(sets[int(i)]) == n and kept == (i == c) for i, n, c, kept in known.itertuples(index=False))
    assert got[got.doc_id.isna()].kept.all()
    assert minhash.near_duplicates(empty).count() == 0


def test_blocks_of_long_lists(docs, rows, monkeypatch):
    want = minhash.near_duplicates(docs).toPandas().sort_values("doc_id").component_id.tolist()
    monkeypatch.setattr(minhash, "SHORT_LIST", 1)
    monkeypatch.setattr(minhash, "BLOCK", 7)
    got = minhash.near_duplicates(docs).toPandas().sort_values("doc_id").component_id.tolist()
    assert str(got) == str(want)


def test_cover():
    assert all(any((a + d) % 31 in substring.COVER and (b + d) % 31 in substring.COVER for d in range(31)) for a in range(31) for b in range(31))


def test_substring(docs, rows, empty):
    got = {r["doc_id"]: r for r in substring.remove_repeats(docs).collect()}
    first = {}
    for i, t, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            g = tuple(w[k : k + 50])
            if first.setdefault(g, i) < i:
                gone[k : k + 50] = [True] * 50
        kept = b" ".join(a for a, x in zip(w, gone) if not x)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest()), i
        assert got[i]["kept_text"] == (kept.decode() if sum(gone) else t)
    out = substring.clean_documents(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert substring.remove_repeats(empty).count() == 0


def test_forest(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e = rng.standard_normal((900, 32))
    e -= (e * x).sum(1, keepdims=True) * x
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    c = rng.uniform(0.901, 0.95, (900, 1))
    v = np.vstack([x, c * x + np.sqrt(1 - c * c) * e, x[:5], 3 * x[:5]])
    m = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    odd = [(5000, None), (5001, []), (5002, [0.0] * 32), (5003, [float("nan")] * 32), (5004, [None] + [1.0] * 31), (5005, [1.0, 2.0]), (None, [1.0] * 32)]
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(v)] + [(0, v[0].tolist())] + odd, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash"))
    for cap in (4096, 64):
        got = forest.near_duplicate_vectors(df, leaf=64, leaf_cap=cap).toPandas().set_index("vec_id")
        links = got.n_links.reindex(range(len(v))).to_numpy()
        assert links.sum() >= 0.99 * near.sum() and (links <= near.sum(1)).all()
        assert (got.n_links.reindex([k for k, _ in odd if k is not None]) == 0).all() and len(got) == len(v) + len(odd)
        assert (got.component_id.reindex(range(5)) == range(5)).all() and (got.component_id.reindex(range(1800, 1805)) == range(5)).all()
    assert forest.near_duplicate_vectors(df.limit(0)).count() == 0


def test_toxicity(spark, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.fit(docs, labels.where(~held))
    got = toxicity.score_documents(docs, model).join(labels.where(held), "doc_id").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.9
    restorer = toxicity.Restorer(model["counts"])
    assert restorer.word("idiooot") == "idiot" and "idiot" in restorer.words("you i d i o t !")
    assert toxicity.score_documents(empty, model).count() == 0


def test_restores_signs():
    counts = np.zeros(toxicity.CLASSES**3, np.int64)
    for w in ("stupid", "loser", "clown", "trash", "moron") * 50:
        counts += toxicity.trigram_counts(w.encode())
    r = toxicity.Restorer(counts)
    assert [r.word(w) for w in ("$tup1d", "l0s3r", "cl.o.wn", "tr@sh", "m0r0n")] == ["stupid", "loser", "clown", "trash", "moron"]


def test_restores_any_length():
    counts = np.zeros(toxicity.CLASSES**3, np.int64)
    for w in ("you", "stupid", "loser", "clown", "are", "trash", "moron", "feed") * 50:
        counts += toxicity.trigram_counts(w.encode())
    r = toxicity.Restorer(counts)
    assert {"you", "stupid"} <= r.words(" ".join("youstupid"))
    assert {"clown", "moron", "trash"} <= r.words("x " + " ".join("youare" * 8 + "clown" + "youare" + "moron" + "you" + "trash"))
    assert "stupid" in r.words("stuupid") and "feed" in r.words("feed")
    assert "stupid" in r.words("st" + "u" * 60 + "pid") and "stupid" in r.words("$tu" + "." * 50 + "p1d")
    assert len(r.word("a1" * 100_000)) >= 100_000


def test_transport(docs, rows, empty):
    for n in (0, 1, 64, 169, 170, 171, 183, 184, 4096, 50_000):
        data = random.Random(n).randbytes(n)
        s = transport.parse(transport.mux(data))
        assert b"".join(u.data for u in s.units) == data and not (s.counter_errors or s.table_errors or s.sync_errors)
        assert [u.pts for u in s.units] == [3600 * k for k in range(len(s.units))] and s.units[0].random_access
    broken = transport.mux(bytes(60_000))
    assert transport.parse(broken[: 188 * 20] + broken[188 * 21 :]).counter_errors == 1
    for r in transport.store_texts(docs).collect():
        text = dict((i, t) for i, t, _ in rows)[r["doc_id"]] if r["doc_id"] is not None else None
        if r["doc_id"] is not None:
            p = transport.padded(text.encode() if text else None)
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert transport.demux(transport.to_media(docs)).where("counter_errors > 0").count() == 0
    assert transport.store_texts(empty).count() == 0


def test_token_tree(docs, rows, empty):
    enc = tokens.encoder(tokens.rank_file())
    rng = random.Random(3)
    for _ in range(150):
        text = " ".join(some_words(rng, 80))
        tree = tokens.TokenTree(text, lambda p: len(enc.encode_ordinary(p)), 64)
        for _ in range(8):
            at, n, new = rng.randrange(len(text) + 1), rng.choice((0, 1, 3, 90)), rng.choice(("", " ", "  x", "\n", "'s", "é b", " word "))
            text = text[:at] + new + text[at + n :]
            tree.edit(at, n, new)
            assert tree.text == text and tree.total == len(enc.encode_ordinary(text))
    got = tokens.count_edited(tokens.sample_edits(docs)).toPandas()
    assert len(got) == len(rows)
    assert tokens.count_edited(tokens.sample_edits(empty)).count() == 0


def test_language_model(spark, docs, rows, empty):
    got = mixing_lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    from collections import Counter

    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts.doc_id}
    split = {i: [*t.encode().lower().split(), b""] for i, t in zip(texts.doc_id, texts.text)}
    c = Counter(w for i, ws in split.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for r in got.itertuples():
        base = sum(np.log10((c[w] + 1) / (n + v + 1)) for w in split[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(split[r.doc_id]), sum(c[w] > 0 for w in split[r.doc_id]), n)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
    ours = got[got.held_out]
    assert (got.score < 0).all() and ours.score.sum() > ours.base_score.sum()
    assert len(mixing_lm.score(docs).toPandas()) == len(rows)
    assert mixing_lm.score(empty).count() == 0


def test_language_model_new_tokens(spark):
    rng = random.Random(11)
    rows, fresh = [], 0
    for k in range(300):
        w = some_words(rng, 40)
        for j in range(0, 40, 4):
            w[j], fresh = f"once{fresh}", fresh + 1
        rows.append((k, " ".join(w)))
    x = spark.createDataFrame(rows, "doc_id long, text string")
    got = mixing_lm.score(x).toPandas()
    new = got[got.held_out]
    # a quarter of all tokens is new: two bits each and the known ones' entropy, far from log2 of the token count
    assert -new.score.sum() / np.log10(2) / new.n_tokens.sum() < 0.76 * np.log2(400) + 1.5
    # a smaller head moves tokens to the tail; those held once cost alike
    low = mixing_lm.score(x, head=300).toPandas()
    train = got.merge(low, on="doc_id").query("not held_out_x")
    assert abs(train.score_x.sum() / train.score_y.sum() - 1) < 0.1


def test_short_texts_adapt():
    import types

    import pyarrow as pa

    rng = random.Random(12)
    texts = [" ".join(x for w in rng.choices(WORDS[:50], k=30) for x in (w, w.upper() + "x")).encode() for _ in range(200)]
    counts = pd.Series([w for t in texts for w in [*t.lower().split(), b""]]).value_counts()
    pairs = [(int(h), int(c)) for h, c in zip(mixing_lm.token_hashes(list(counts.index)), counts) if c > 1]
    voc = mixing_lm.Vocabulary(pairs, int(counts.sum()), int((counts == 1).sum()))
    table = np.zeros(mixing_lm.ALL_CELLS, np.int32)
    for b in mixing_lm._table_rows(types.SimpleNamespace(value=voc))(iter([pa.record_batch([pa.array(texts, pa.binary())], ["t"])])):
        part = np.frombuffer(pa.decompress(b.column(2)[0].as_buffer(), mixing_lm.BLOCK_CELLS * 4, "zstd"), np.int32)
        at = b.column(0)[0].as_py() * mixing_lm.BLOCK_CELLS
        table[at : at + len(part)] = part[: mixing_lm.ALL_CELLS - at]
    fixed, learned = mixing_lm.Mixer(table, voc), mixing_lm.Mixer(table, voc, texts[:100])
    new = [[*t.lower().split(), b""] for t in (b"w1 w1x w2 w2x w7 w7x " * 4, b"w3 w3x", b"")]

    def bits(mixer, texts, rate=0.3):
        ids, _ = mixing_lm.TokenIds(voc).of([w for t in texts for w in t])
        return mixer.bits(texts, ids, np.ones(len(texts), bool), rate)[0]

    assert voc.length[mixing_lm.TokenIds(voc).of(new[0])[0]].sum() < 4096
    assert bits(fixed, new)[0] < bits(fixed, new, 0.0)[0]
    assert bits(learned, new, 0.0)[0] < bits(fixed, new, 0.0)[0]
    assert np.allclose(bits(learned, new), [bits(learned, [t])[0] for t in new], rtol=1e-5)


def test_forest_beyond_its_sample(spark):
    """Links of 6,000 vectors, planted pairs of cosine 0.9 to 0.93 among them, by a forest fitted on 200."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(0, 1200, 2):
        d = rng.normal(size=24)
        d -= d @ x[k] * x[k]
        c = rng.uniform(0.9, 0.93)
        x[k + 1] = c * x[k] + np.sqrt(1 - c * c) * d / np.linalg.norm(d)
    rows = spark.createDataFrame([(i, [float(q) for q in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    got = forest.near_duplicate_vectors(rows, sample=200, leaf=64).toPandas().set_index("vec_id").n_links
    want = (x @ x.T >= 0.9).sum(1) - 1
    assert (got.loc[range(6000)].values <= want).all() and got.sum() >= 0.9 * want.sum() > 0
    big, small = (forest.Forest(x[:200], 3, d, 0.02) for d in (14, 6))
    size = lambda f: f.directions.nbytes + f.cuts.nbytes + f.middles.nbytes + f.below.nbytes
    assert size(big) < 2 * size(small) + 20_000


def test_kept_trees(spark):
    """Two rounds of edits on a stored table of trees against encoding the edited texts anew."""
    rng = random.Random(4)
    texts = {k: " ".join(some_words(rng, rng.choice([0, 3, 200]))) for k in range(30)}
    x = spark.createDataFrame(list(texts.items()) + [(30, None)], "doc_id long, text string")
    trees, enc = tokens.keep_trees(x).persist(), tokens.encoder(tokens.rank_file())
    texts[30] = ""
    for _ in range(2):
        edits = [(k, [(rng.randrange(len(t) + 1), rng.randrange(9), rng.choice(["", "new words", " \n"])) for _ in range(2)]) for k, t in texts.items() if k % 3]
        for k, own in edits:
            for at, n, new in own:
                texts[k] = texts[k][:at] + new + texts[k][at + n :]
        trees = tokens.edit_trees(trees, spark.createDataFrame(edits, "doc_id long, edits array<struct<begin:bigint,length:bigint,insert:string>>")).persist()
        got = {r["doc_id"]: r for r in trees.collect()}
        assert all(got[k]["n_tokens"] == len(enc.encode_ordinary(t)) and "".join(got[k]["parts"]) == t for k, t in texts.items())
        assert all(got[k]["n_chars_encoded"] == 0 for k in texts if not k % 3) and sum(r["n_chars_encoded"] for r in got.values()) < 0.8 * sum(map(len, texts.values()))


def test_bad_bytes(spark):
    """Texts that are no UTF-8 are read with marks in place of the bad bytes."""
    x = spark.sql("SELECT id AS doc_id, cast(unhex(concat('61FF62', hex(concat(' w', id)))) AS string) AS text FROM range(20)")
    assert packing.pack(x).count() >= 20 and tokens.count_edited(tokens.sample_edits(x)).count() == 20
    y = spark.sql("SELECT id AS doc_id, cast(id % 2 AS int) AS toxic FROM range(20)")
    assert toxicity.score_documents(x, toxicity.fit(x, y)).count() == 20


def test_urls(spark):
    rows = [(1, "http://a.com/en/1", None), (2, "https://B.Example.com/en/7x?q", "<p>cheap pills</p>"), (3, "ftp://x.net/de/8", ""), (4, "http://example.net/de/8", None), (5, "x.org/es/", None), (6, None, None), (None, "http://spamfarmcheappills.info/free", None), (8, "http://h?x://y/en/", None), (9, "http://notcom/en/", None)]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()}
    assert [(got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) for k in (1, 2, 3, 4)] == [("a.com", "/en/1", "com/en/", "block"), ("b.example.com", "/en/7x", "example.com/en/7", "allow"), ("x.net", "/de/8", "net/de/", "allow"), ("example.net", "/de/8", "example.net/de/8", "block")]
    assert [(got[k]["host"], got[k]["path"], got[k]["rule"]) for k in (5, 6, 8, 9)] == [("", "", None), ("", "", None), ("h", "", None), ("notcom", "/en/", None)]
    assert got[None]["verdict"] == "block" and "h:spam" in got[None]["tokens"]
    words = {"cheap": -2.0, "pills": -2.0, "pill": -3.0, "heap": -3.0, "s": -6.0, "c": -6.0}
    assert urls.segment("cheappills", words, -8.0) == ["cheap", "pills"]


def test_urls_of_rare_words(spark):
    def word(k):
        return "".join(chr(97 + k // 26**j % 26) for j in range(4)) + "qz"

    # 60,000 words that occur twice each, two rare ones, and a path piece with a word across its 63rd letter
    html = [" ".join(word(k) for k in range(lo, lo + 1000)) for lo in range(0, 60_000, 1000)]
    rows = [(k, "http://a.info/x", h) for k, h in enumerate(html * 2)]
    rows.append((900, "http://zzrarewordzzotherword.info/", "zzrareword zzotherword"))
    rows.append((901, "http://a.info/" + "zzrareword" * 10, None))
    got = {r["page_id"]: r["tokens"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert "h:zzrareword" in got[900] and "h:zzotherword" in got[900]
    assert got[901].count("p:zzrareword") == 10


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs, seed=4).toPandas()
    assert set(got.columns) == {*docs.columns, "shuffle_key"}
    again = mixing.mix(docs.repartition(2), seed=4).toPandas()
    key = lambda d: sorted(zip(d.doc_id.fillna(-1), d["copy"], d.shuffle_key))
    assert key(got) == key(again)
    one = mixing.mix(docs, {"s0": 1.0}, epochs=20.0).toPandas()
    assert set(one.source) == {"s0"}
    assert mixing.mix(empty).count() == 0
    assert "Python" not in mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()


def test_poisson_counts(spark):
    x = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("ab").alias("text"), F.lit("s").alias("source"))
    n = mixing.mix(x, epochs=2.5).groupBy("doc_id").count().toPandas()["count"]
    assert abs(n.sum() / 20_000 - 2.5) < 0.05
    assert abs((20_000 - len(n)) / 20_000 - np.exp(-2.5)) < 0.01


def test_mixing_of_tiny_sources(spark):
    rows = [(k, "x" * 10_000, "hot") for k in range(40)] + [(k, "abc", "tiny") for k in range(100, 110)] + [(200, "ab" * 20, None), (201, "", None)]
    x = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(x, seed=3).toPandas()
    total = 40 * 10_000 + 10 * 3 + 40
    assert not got.duplicated(["doc_id", "copy"]).any()
    for i, bytes_ in ((100, 30), (109, 30), (200, 40), (201, 40)):
        own, rate = got[got.doc_id == i], total / 3 / bytes_
        assert abs(len(own) - rate) < 6 * rate**0.5 and sorted(own["copy"]) == list(range(len(own)))
    assert 0 < (got.source == "hot").sum() < 40
    counts = got[got.source == "tiny"].groupby("doc_id").size()
    assert counts.nunique() > 5


def test_packing(docs, rows, empty):
    got = packing.pack(docs).toPandas()
    encode, _ = packing.tokenizer(str(__import__("public_tokenizers").path("byte_bpe_50k.json")), None)
    ids = {i: np.append(encode(t) if t else np.empty(0, np.uint32), np.uint32(1)) for i, t, _ in rows if i is not None}
    for i, g in got[got.doc_id.notna()].groupby("doc_id"):
        assert (g.doc_tokens == len(ids[i])).all() and g.length.sum() == len(ids[i]) * sum(r[0] == i for r in rows)
        for r in g.itertuples():
            assert zlib.crc32(ids[i][r.start : r.start + r.length].astype("<u4").tobytes()) == r.ids_crc32
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 2048
    assert packing.pack(empty).count() == 0


def test_cuts_are_cheapest():
    rng = random.Random(8)
    for _ in range(100):
        n, w = rng.randrange(1, 40), 8
        places = sorted(rng.sample(range(1, n + 1), rng.randrange(0, n + 1)))
        got = packing.choose_cuts(n, np.array(places, int), np.full(len(places), packing.SENTENCE_END), w)
        assert got[-1] == n and all(0 < b - a <= w for a, b in zip([0, *got], got))
        dense = packing.choose_cuts(n, np.arange(1, n + 1), np.zeros(n, int), w)
        assert len(dense) == -(-n // w)


def test_queries_over_small_tables(spark):
    from millrace.llm.queries import QUERIES

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert QUERIES["op1_toxicity"](spark, SF).count() == n


def test_pipeline_keeps_clean_empty_texts(spark):
    import corpus_pipeline

    passage = " ".join(WORDS[:60])
    rows = [(1, passage), (2, passage), (3, ""), (4, "  "), (5, "\t\n"), (6, None), (7, "a b")]
    got = corpus_pipeline.substrings(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 3, 4, 5, 6, 7]


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.toPandas(), docs.schema)
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert pd.DataFrame(docs.take(1)).shape[0] == 1
