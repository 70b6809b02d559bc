"""Operators against brute force, exact round trips and edge cases, on small tables."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from framespark.llm import ann, bpe, components, embdedup, langid, minhash, packing, quality, secrets, tokenfile, warc
from framespark.llm.storage import new_path
from framespark.llm.tokens import ChunkEncoder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD_TEXTS = [None, "", " ", "\n", "a", "a  b", " a", "a ", "x \n y", "don't", "é日本😀", "<|endoftext|>", "\x1c\x00", "tab\tx", "ab " * 3000, "x" * 5000, "3½²"]


def docs(spark, texts):
    rows = [(i, t, "keep", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, id long")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    for base in texts[:12]:
        w = base.split()
        for k in range(4):
            v = list(w)
            for _ in range(k):
                v[rng.randrange(len(v))] = rng.choice(words)
            texts.append(" ".join(v).upper() if k == 1 else " ".join(v))
    return texts + [None, "", " \t\n", "One", "one", "one two", "ONE\x0btwo"]


def near_groups(texts, words, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, min(1, len(w))))})
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, corpus, words, percent):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs(spark, corpus), words, percent).collect()}
    sizes, groups = near_groups(corpus, words, percent)
    assert [got[i]["n_shingles"] for i in range(len(corpus))] == sizes
    assert [got[i]["component_id"] for i in range(len(corpus))] == groups
    assert all(got[i]["kept"] == (groups[i] == i) for i in got)


def test_superminhash_estimates_likeness():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[500:2500]
    h = np.concatenate((np.sort(a), np.sort(b)))
    sign = minhash.superminhash(h, np.array([0, 2000, 4000]), 512)
    assert abs((sign[0] == sign[1]).mean() - 0.6) < 0.08
    few = minhash.superminhash(h[:3], np.array([0, 3, 3]), 16)
    assert np.isfinite(few[0]).all() and np.isinf(few[1]).all()


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7), (101, 100)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    path = new_path(spark, "t")
    tokenfile.write_token_files(docs(spark, ODD_TEXTS).repartition(3), path, TOKENIZER, end_id=2)
    at = 0
    for i, r in enumerate(tokenfile.read_token_files(spark, path).orderBy("id").collect()):
        want = [*whole.encode(ODD_TEXTS[i] or "", add_special_tokens=False).ids, 2]
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["start"] == at
        at += len(want)
    for n in (0, 1, 6):
        ranks = np.array([0, 255, 256, 65536, 2**24, 2**32 - 1][:n], np.uint32)
        assert (tokenfile.unpack(*tokenfile.pack(ranks), n) == ranks).all()


def test_chunked_encoding_equals_whole_encoding():
    import tiktoken
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(TOKENIZER), ChunkEncoder(TOKENIZER)
    ranks = bpe.load_ranks(RANKS)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = bpe.TextBpe(ranks, public_tokenizers.PATTERN)
    rng = random.Random(1)
    parts = [" ", "  ", "\n", " \n", "\n ", "a", "the.", " don't", "12", "½", "é", "日本", "...", "\t", "\xa0", "\x1c", "_", "😀"]
    for _ in range(400):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert np.frombuffer(own.encode(s), own.dtype).tolist() == whole.encode(s, add_special_tokens=False).ids
        assert text.encode(s) == other.encode_ordinary(s)


def test_columns_of_texts_are_cut_and_encoded_as_whole_texts():
    from tokenizers import Tokenizer

    whole, own, rng = Tokenizer.from_file(TOKENIZER), ChunkEncoder(TOKENIZER, remembered=20_000), random.Random(5)
    parts = [" ", "  ", "\n", " \n", "\n ", "\n\n\n", "a", "the.", " don't", "'s", "12", "½", "é", "×", "÷", "日本", "...", "\t", "\r\n", "\x1c", "😀", "<|"]
    texts = [*ODD_TEXTS, *("".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(3000)), None]
    for lo in range(0, len(texts), 500):
        column = pa.array(["not this one", *texts[lo : lo + 500]])[1:]
        for text, raw in zip(texts[lo : lo + 500], own.encode_all(column, 2).to_pylist(), strict=True):
            assert np.frombuffer(raw, own.dtype).tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, 2]
    assert own.encode_all(pa.array([None, ""], pa.string())).to_pylist() == [b"", b""]


def test_a_stretch_encodes_each_piece_once(monkeypatch):
    own, calls = ChunkEncoder(TOKENIZER, remembered=0), []
    monkeypatch.setattr(ChunkEncoder, "shared", lambda *_: own)
    encode = own._ids
    monkeypatch.setattr(own, "_ids", lambda piece: calls.append(piece) or encode(piece))
    texts = ["one two, two three\n", "two two two. three", "one 12 two"] * 50
    batch = pa.RecordBatch.from_arrays([pa.array(range(150)), pa.array(texts)], ["id", "text"])
    assert sum(len(ids) for _, ids in tokenfile.encode_batches(iter([batch]), TOKENIZER, 2)) == 150
    assert len(calls) == len(set(calls)) == len({"one", " two", ",", " three", "\n", "two", ".", " 12"})


def test_prefix_tables_append_and_edit():
    encoder = bpe.PrefixBpe(bpe.load_ranks(RANKS))
    rng = random.Random(2)
    for _ in range(40):
        s = bytes(rng.choice(b"the ationing") for _ in range(rng.randint(1, 40)))
        table = encoder.table(s)
        assert encoder.read(len(s), table) == encoder.merged(s)
        assert encoder.append(s, list(table), b"ing")[1] == encoder.table(s + b"ing")
        lo = rng.randrange(len(s))
        after, edited, _ = encoder.edit(s, table, lo, min(len(s), lo + 2), b"xy")
        assert edited == encoder.table(after)


def test_bpe_of_documents_decodes(spark):
    d = bpe.decode(bpe.encode(docs(spark, ODD_TEXTS), RANKS, public_tokenizers.PATTERN), RANKS)
    got = {r["doc_id"]: bytes(r["bytes"]) for r in d.collect()}
    assert got == {i: (t or "").encode() for i, t in enumerate(ODD_TEXTS)}


def test_packing(spark):
    got = packing.pack_documents(docs(spark, ODD_TEXTS * 3), TOKENIZER, 0, capacity=64, group=40).toPandas()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["length"].sum() <= 64 and (g["length"].cumsum() - g["length"] == g["offset"]).all()
    for _, g in got.sort_values("piece").groupby("doc_id"):
        assert (g["length"].iloc[1:] == 64).all() and (g["start"] == g["length"].cumsum() - g["length"]).all()
    lengths = np.random.default_rng(0).integers(1, 64, 500)
    at, _ = packing.best_fit(lengths, 64)
    assert np.bincount(at, weights=lengths).max() <= 64 and packing.lower_bound(lengths, 64) <= at.max() + 1
    assert packing.lower_bound(np.full(10, 40), 64) == 10


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 600 + "\r\n\r\nWARC/1.1\r\n</p>"
    pages = [(1, "http://a/\r\nx", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", big + " ")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = new_path(spark, "w")
    warc.write_warc(df, path)
    read = warc.read_warc(spark, path)
    payloads = {r["page_id"]: r["payload"] for r in read.collect()}
    assert payloads[2] == big.encode() and payloads[1] is None and payloads[5] == b""
    got = {r["page_id"]: r for r in warc.resolved_records(read).collect()}
    for i, _, html in pages:
        raw = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert [(got[i]["record_type"], got[i]["refers_to"]) for i in (1, 2, 3, 6)] == [("revisit", 2), ("response", None), ("response", None), ("response", None)]


def vectors(spark, x, labels=None):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], None if labels is None else labels[i]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_search_against_brute_force(spark):
    x = np.random.default_rng(1).standard_normal((2500, 16)).astype(np.float32)
    rows = [*x, None, np.zeros(16), [None] * 16, [float("nan")] * 16]
    got = ann.search(vectors(spark, rows), vectors(spark, rows).filter("vec_id % 50 = 0"), 10).toPandas()
    hit = 0
    for q, g in got.groupby("query_id"):
        score = x.astype(float) @ x[q].astype(float)
        score[q] = -np.inf
        hit += len(set(np.argsort(-score)[:10]) & set(g["vec_id"]))
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 11)) and np.allclose(g["score"], score[g["vec_id"]])
    assert hit / (10 * got["query_id"].nunique()) >= 0.9
    few = ann.search(vectors(spark, x[:4]), vectors(spark, x[:1]), 10).collect()
    assert len(few) == 3
    assert ann.search(vectors(spark, []), vectors(spark, []), 10).count() == 0


def test_similarity_join_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 24))
    x = np.concatenate([base, base + rng.normal(0, 0.2, base.shape), base[:20], base[:20] * 3]).astype(np.float32)
    labels = [i % 3 for i in range(60)] * 2 + [i % 3 for i in range(20)] * 2
    rows, marks = [*x, None, np.zeros(24), x[0]], [*labels, 0, 0, None]
    got = embdedup.near_duplicate_vectors(vectors(spark, rows, marks), 0.93).orderBy("vec_id").toPandas()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = (u @ u.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels))
    np.fill_diagonal(link, False)
    assert got["n_links"].tolist() == [*link.sum(axis=1), 0, 0, 0]
    comp = np.arange(len(x))
    for _ in range(len(x)):
        comp = np.minimum(comp, np.where(link, comp[None, :], len(x)).min(axis=1))
    assert got["component_id"].tolist() == [*comp, len(x), len(x) + 1, len(x) + 2]


def test_language(spark):
    rng = random.Random(4)
    kinds = {"aa": ["the", "and", "tion", "ing"], "bb": ["que", "lle", "eau", "ère"]}
    rows = [(i, " ".join("".join(rng.choices(kinds[k], k=2)) for _ in range(30)), k) for i in range(200) for k in [("aa", "bb")[i % 2]]]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(train.filter("doc_id < 150"))
    got = langid.predict(train.filter("doc_id >= 150"), model).join(train, "doc_id").collect()
    assert all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in got)
    odd = {r["doc_id"]: r for r in langid.predict(docs(spark, [None, "", "12 !", "日本"]), model).collect()}
    assert [odd[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and odd[3]["lang_pred"] in kinds
    assert langid.predict(docs(spark, ["x"]), langid.fit(train.limit(0))).first()["lang_pred"] == "und"


def test_language_rejects_what_it_has_not_learned(spark):
    rng = random.Random(7)
    kinds = {"aa": "the and tion ing er on that with is of".split(), "bb": "que lle eau ère ment de la oui ou les".split()}
    text = lambda k, n: " ".join("".join(rng.choices(kinds[k], k=rng.randint(1, 3))) for _ in range(n))
    rows = [(i, text(k, rng.choice([1, 3, 10, 40, 150])), k) for i in range(600) for k in [("aa", "bb")[i % 2]]]
    model = langid.fit(spark.createDataFrame(rows[:400], "doc_id long, text string, lang string"))
    clean = model.judge([r[1] for r in rows[400:]], [True] * 200)[2]
    assert sum(clean) <= 6
    odd = [
        "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita",
        "Litwo ojczyzno moja ty jesteś jak zdrowie ile cię trzeba cenić ten tylko się dowie kto cię stracił",
        "Watu wote wamezaliwa huru hadhi na haki zao ni sawa wote wamejaliwa akili na dhamiri hivyo yapasa",
        "zzzz " * 40,
        " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(40)),
        '<div class="nav"><ul><li><a href="/index.html">home</a></li></ul></div> ' * 5,
    ]
    assert all(model.judge(odd, [True] * len(odd))[2])
    lone = langid.fit(spark.createDataFrame([rows[0]], "doc_id long, text string, lang string"))
    assert lone.judge([rows[0][1]], [True])[2] == [False]


def test_resampling(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["good", "fine", "text", "here"] if i % 4 else ["buy!!", "now!!", "$$$"], k=40))) for i in range(200)]
    df = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(100)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.resample(df, labels).collect()}
    assert all(got[i]["kept"] == (i % 4 > 0) for i in range(200)) and len(got) == 202
    ratios = quality.log_ratios(quality.ngram_models(quality.labelled(df, labels), "good"))
    n, weight = quality.weights_of([rows[3][1].encode()], ratios)
    assert n[0] == 79 and abs(weight[0] - got[3]["log_weight"]) < 1e-9
    assert quality.resample(df, labels, k=7).filter("kept").count() == 7
    assert quality.keep_drawn(df, labels, k=7).count() == 7
    scores = spark.range(1000).selectExpr("CAST((id * 7919) % 1009 AS DOUBLE) s")
    want = sorted(((i * 7919) % 1009 for i in range(1000)), reverse=True)
    assert all(quality.kth_largest(scores, "s", k) == want[k - 1] for k in (1, 2, 500, 999))


def test_secrets(spark):
    rng = random.Random(6)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    keys = [hexa(40) for _ in range(40)]
    texts = [f'some words here token = "{k}" and more' for k in keys]
    texts += [f"card {rng.randrange(10**15, 10**16)} call +1 (555) 123-4567 mail a.b@c.example.com" for _ in range(40)]
    df = docs(spark, [*texts, None, "", "plain words only"])
    found = {(r["doc_id"], r["value"]) for r in secrets.scan(df).collect()}
    assert found == set(enumerate(keys))
    clean = secrets.redact(df, secrets.scan(df))
    assert clean.columns == df.columns and clean.count() == 83
    assert clean.filter("doc_id = 0").first()["text"] == 'some words here token = "[SECRET]" and more'
    assert secrets.candidate_spans("x" * 100 + "1" * 3 + " abc1") == [(0, 103)]


def test_secrets_set_without_quotes(spark):
    rng = random.Random(8)
    many = lambda kinds, n: "".join(rng.choice(kinds) for _ in range(n))
    mixed = "abcdefghjkmnpqrsABCDEFGHJKMNPQRS23456789"
    keys = ["AKIA" + many("ABCDEFGHJK23456789", 16), "ghp_" + many(mixed, 36), "S3cretValue99", many(mixed, 38) + "==", many(mixed, 22) + "47"]
    forms = ["AWS_ACCESS_KEY_ID={}", "https://a.example/x?id=7&token={}&user=me2", "password={}", "export API_SECRET={}", "[db]\ntoken={}\n"]
    texts = [f.format(k) for f, k in zip(forms, keys, strict=True)]
    for text, key in zip(texts, keys, strict=True):
        at = text.index(key)
        assert secrets.candidate_spans(text) == [(at, at + len(key))]
    assert secrets.candidate_spans("password=S3cretValue99&user=bob12345") == [(9, 22)]
    assert secrets.candidate_spans("token==" + "a1" * 10) == [(6, 27)]
    want = set(enumerate(keys))
    assert {(r["doc_id"], r["value"]) for r in secrets.scan(docs(spark, texts)).collect()} == want  # no forest: all are sure
    texts += [f"card {rng.randrange(10**15, 10**16)} and words" for _ in range(40)]
    assert {(r["doc_id"], r["value"]) for r in secrets.scan(docs(spark, texts)).collect()} == want


def test_empty_tables(spark):
    none = docs(spark, [])
    assert minhash.near_duplicates(none).count() == 0
    assert packing.pack_documents(none, TOKENIZER).count() == 0
    assert secrets.scan(none).count() == 0
    assert bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0
