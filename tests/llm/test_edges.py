"""Whole queries against brute force on small tables, and nulls, repeated rows, ties, clashing names, long and no rows."""

import gzip
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framespark.llm import ann, bpe, embdedup, langid, minhash, packing, quality, secrets, tokenfile, warc
from framespark.llm import queries as llm
from framespark.llm.storage import new_path, shared_dir

from .test_llm import ODD_TEXTS, RANKS, TOKENIZER, docs, vectors

LONG = " ".join(f"w{i % 9973}x" for i in range(400_000)) + " " + "z" * 300_000


@pytest.fixture(scope="module")
def sf(spark):
    """A folder with small tables as the queries read them."""
    path, rng = new_path(spark, "sf"), np.random.default_rng(0)
    words = ["the", "of", "and", "el", "la", "que", "der", "die", "und"]
    rows = [(int(i), " ".join(rng.choice(words[3 * (i % 3) : 3 * (i % 3) + 3], 40)) + f" {i % 7} Zeit", ["en", "es", "de"][i % 3], f"s{i % 4}", 9) for i in range(120)]
    rows += [(200 + i, t, None, "odd", 0) for i, t in enumerate(ODD_TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    x = rng.standard_normal((300, 16))
    x[200:230] = x[:30] + rng.normal(0, 0.05, (30, 16))
    x[230:240] = x[0]
    v = [(i, [float(c) for c in a], int(i % 3)) for i, a in enumerate(x)]
    v += [(300, None, 0), (301, [0.0] * 16, 0), (302, [None] * 16, 1), (303, [float("inf")] * 16, 1), (304, [1.0] * 16, None)]
    spark.createDataFrame(v, "vec_id long, embedding array<double>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path, rows, v


def test_search_query_by_brute_force(spark, sf):
    path, _, v = sf
    ok = {i: np.array(a) for i, a, _ in v if a and None not in a and np.isfinite(a).all() and any(a)}
    got = llm.op1_adaptive_scan(spark, path).toPandas()
    assert set(got["query_id"]) == {i for i in ok if i % 20 == 0}
    hit = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and np.allclose(g["score"], [ok[i] @ ok[q] for i in g["vec_id"]], rtol=1e-12)
        assert sorted(zip(-g["score"], g["vec_id"])) == list(zip(-g["score"], g["vec_id"]))
        want = sorted((i for i in ok if i != q), key=lambda i: (-(ok[i] @ ok[q]), i))[:20]
        hit += len(set(want) & set(g["vec_id"]))
    assert hit >= 0.9 * len(got)


@pytest.mark.parametrize("spread", [1.0, 0.15])
def test_search_by_lists_alone(spark, spread):
    """The fitting sample is a tenth of the rows, which are one cloud or clusters."""
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((40, 24)) * (1 if spread < 1 else 0))[rng.integers(0, 40, 6000)] + spread * rng.standard_normal((6000, 24))
    df = vectors(spark, x)
    index = ann.fit(df, 10, sample_rows=600)
    assert index.lists > 30 and index.probes < index.lists
    got = ann.search(df, df.filter("vec_id % 100 = 0"), 10, index=index).toPandas()
    x = x.astype(np.float32).astype(float)
    hit = 0
    for q, g in got.groupby("query_id"):
        score = x @ x[q]
        score[q] = -np.inf
        hit += len(set(np.argsort(-score)[:10]) & set(g["vec_id"]))
    assert len(got) == 600 and hit >= 0.93 * 600


def test_search_among_repeated_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((60, 8))
    rows = spark.createDataFrame([(i, [float(c) for c in x[i]], "a", 1.5) for i in range(60) for _ in range(3)], "vec_id long, embedding array<double>, score string, rank double")
    index = ann.fit(rows, 10)
    index.probes = index.lists  # all lists: the answer is exact
    got = ann.search(rows, rows.filter("vec_id < 2").dropDuplicates(["vec_id"]), 10, index=index).toPandas()
    for q, g in got.groupby("query_id"):
        order = np.argsort(-np.where(np.arange(60) == q, -np.inf, x @ x[q]))
        assert sorted(g["vec_id"]) == sorted([*np.repeat(order[:3], 3), order[3]])
    many = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5000)] + [(9000, [1.0, 1.0])], "vec_id long, embedding array<double>")
    few = ann.search(many, many.filter("vec_id = 9000 or vec_id = 7"), 5).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in few] == [0, 1, 2, 3, 4, 0, 1, 2, 3, 4]


def test_vector_links_of_null_and_repeated_ids(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(None, a, "x"), (5, a, "x"), (5, b, "x"), (9, a, "x"), (7, [0.99, 0.05, 0.0, 0.0], "x"), (8, b, "y"), (None, None, None)]
    got = embdedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=repr) == sorted(
        [(None, 0, None, True), (None, 0, None, True), (5, 2, 5, True), (5, 0, 5, True), (9, 2, 5, False), (7, 2, 5, False), (8, 0, 8, True)], key=repr
    )


def test_near_duplicates_of_null_and_repeated_ids(spark):
    rows = [(3, "a b c d"), (3, "A b c d"), (None, "a b c d"), (1, "a b c d"), (2, None), (2, ""), (4, "q r s t")]
    got = minhash.near_duplicates(spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, n long, component long"), 3, 85).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=repr) == sorted(
        [(3, 2, 1, False), (3, 2, 1, False), (None, 2, None, True), (1, 2, 1, True), (2, 0, 2, True), (2, 0, 2, True), (4, 2, 4, True)], key=repr
    )


def test_token_queries_by_the_libraries(spark, sf):
    import tiktoken
    from tokenizers import Tokenizer

    path, rows, _ = sf
    whole = Tokenizer.from_file(TOKENIZER)
    ids = {r[0]: whole.encode(r[1] or "", add_special_tokens=False).ids for r in rows}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    at = 0
    for r in llm.op4_token_files(spark, path).orderBy("doc_id").collect():
        want = [*ids[r["doc_id"]], 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(want), crc(want))
        at += len(want)
    packed = llm.op7_best_fit_packing(spark, path).collect()
    assert len(packed) == sum(max(1, -(-(len(x) + 1) // 2048)) for x in ids.values())
    for r in packed:
        assert r["ids_crc32"] == crc([*ids[r["doc_id"]], 0][r["start"] : r["start"] + r["length"]])
    used = {r["sequence_id"] for r in packed}
    assert len(used) == packing.lower_bound(np.array([r["length"] for r in packed]), 2048)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    for r in llm.op9_prefix_bpe(spark, path).collect():
        text = next(t for i, t, *_ in rows if i == r["doc_id"]) or ""
        want = other.encode_ordinary(text)
        assert r["n_tokens"] == len(want) and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()


def test_language_query(spark, sf):
    path, rows, _ = sf
    got = {r["doc_id"]: r for r in llm.op8_language_id(spark, path).collect()}
    assert len(got) == len(rows)
    for i, text, lang, *_ in rows:
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
        assert lang is None or r["lang_pred"] == lang


def test_packing_goes_on_while_it_helps(spark):
    lengths = np.random.default_rng(1).integers(200, 700, 900)
    pieces = spark.createDataFrame([(str(i), int(n)) for i, n in enumerate(lengths)] + [("full", 1024)], "key string, length long")
    got = packing.pack(pieces, 1024, group=60).join(pieces, "key")
    frame = got.toPandas()
    assert len(frame) == 901
    for _, g in frame.sort_values("offset").groupby("sequence_id"):
        assert g["length"].sum() <= 1024 and (g["length"].cumsum() - g["length"] == g["offset"]).all()
    used, bound = packing.certificate(got, 1024)
    assert used == frame["sequence_id"].nunique() and bound <= used
    assert used <= 1.06 * (packing.best_fit(np.append(lengths, 1024), 1024)[0].max() + 1)
    assert packing.pack(pieces.filter("false"), 1024).count() == 0


def test_gumbel_inclusion_follows_the_weights(spark):
    """Of four documents the one with the largest log weight plus noise is each as often as its share of the weights."""
    weights = spark.createDataFrame([(i, f"t{i}", w) for i, w in enumerate([1.0, 2.0, 3.0, 4.0])], "doc_id long, text string, w double")
    drawn = weights.crossJoin(spark.range(6000).withColumnRenamed("id", "seed"))
    noisy = drawn.withColumn("s", F.log("w") + quality.gumbel_noise("doc_id", "text", F.col("seed")))
    won = noisy.groupBy("seed").agg(F.max_by("doc_id", "s").alias("doc_id")).groupBy("doc_id").count().collect()
    assert all(abs(r["count"] / 6000 - (r["doc_id"] + 1) / 10) < 0.03 for r in won) and len(won) == 4


def test_resampling_with_nulls_and_clashing_names(spark):
    rows = [(1, "good text here", True, 1.0, 2), (None, "good text here", None, 1.0, 2), (1, "good text here", None, None, 3), (2, None, None, 0.0, 4), (3, "", None, 0.0, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, good boolean, noise double, label_of long")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    assert quality.resample(df, labels).count() == 5
    kept = quality.keep_drawn(df, labels)
    assert kept.columns == df.columns and kept.count() == 5


def test_forest_on_labelled_findings(spark):
    """Labels come from what was planted, not from any feature; the forest is judged on documents it has not seen."""
    rng = random.Random(9)
    many = lambda kinds, n: "".join(rng.choice(kinds) for _ in range(n))
    keys, texts = [], []
    for i in range(240):
        if i % 2:
            keys.append(many("abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", rng.choice([24, 32, 40])))
            texts.append(f"set the {rng.choice(['secret', 'token', 'key'])} = '{keys[-1]}' before the start")
        else:
            keys.append(rng.choice([many("0123456789abcdef", 40), many("0123456789", 16), "version" + many("0123456789", 9)]))
            texts.append(f"the {rng.choice(['commit', 'order', 'checksum'])} {keys[-1]} was seen")
    df = docs(spark, texts)
    marks = [(i, t.index(k), len(k), i % 2 == 1) for i, (t, k) in enumerate(zip(texts, keys)) if i < 160]
    findings = spark.createDataFrame(marks, "doc_id long, start long, length long, is_secret boolean")
    found = {(r["doc_id"], r["value"]) for r in secrets.scan(df, findings).filter("doc_id >= 160").collect()}
    want = {(i, keys[i]) for i in range(160, 240) if i % 2}
    assert len(found & want) >= 0.95 * len(want) and len(found & want) >= 0.95 * len(found)


def test_redaction_with_repeated_ids_and_any_names(spark):
    rows = [(1, 'a token = "Zx9qLm47TbVr20KdPw8sYh3N" b', "p", "q"), (1, "longer than the other one, without any", "r", "s"), (None, "x", "t", "u"), (2, None, "v", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, of string, spans string")
    clean = secrets.redact(df, secrets.scan(df))
    assert clean.columns == df.columns
    assert sorted(r["text"] or "" for r in clean.collect()) == sorted(['a token = "[SECRET]" b', rows[1][1], "x", ""])


def test_warc_of_null_and_repeated_ids(spark):
    big, other = "<p>" + "a" * 1200, "<p>" + "b" * 1200
    rows = [(1, "u", big), (1, "u", other), (2, "u", big), (None, "u", big), (3, "u", other), (3, "u", other)]
    path = new_path(spark, "w")
    warc.write_warc(spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, payload_bytes long, refers_to string"), path)
    read = warc.read_warc(spark, path)
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.resolved_records(read).collect()), key=repr)
    assert got == sorted([(1, "revisit", 2), (1, "revisit", 3), (2, "response", None), (None, "response", None), (3, "response", None), (3, "revisit", 3)], key=repr)
    assert read.filter("payload is null").count() == 3
    assert read.select("record_id").distinct().count() == 5  # page 1 has two payloads and one id


def test_warc_of_a_much_repeated_row(spark, monkeypatch):
    """One response for a payload whose page comes again and again; archives are cut by bytes and tell what they are."""
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    big = "<p>é" + "a" * 1500
    rows = [(9, u, big) for u in ["b", "a", "b", None, "a"]] + [(4, "c", big)] + [(i, "d", f"{i}" * 3000) for i in range(20, 60)]
    path = new_path(spark, "w")
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, record_type string, copy int").repartition(3)
    resolved = warc.resolve_revisits(df)
    assert sorted(r["refers_to"] for r in resolved.filter("record_type = 'revisit'").collect()) == [9, 9, 9, 9, 9]
    warc.write_warc(df, path)
    read = warc.read_warc(spark, path)
    got = warc.resolved_records(read).filter("page_id < 10").collect()
    found = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got), key=repr)
    assert found == [(4, "revisit", 9, 1505), (9, "response", None, 1505), *[(9, "revisit", 9, 1505)] * 4]
    assert read.count() == len(rows) and read.select("record_id").distinct().count() == len(rows)
    files = [gzip.decompress(r["content"]) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()]
    assert len(files) > 6 and all(next(warc.parse_records(f))[0]["WARC-Type"] == "warcinfo" for f in files) and max(map(len, files)) < 40_000
    assert all(r["url"] == "a" for r in read.filter("page_id = 9 and record_type = 'response'").collect())


def test_secret_query_on_planted_findings(spark):
    """The forest is fitted on what was planted; on documents held out it tells plants apart better than a rule."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["tree", "river", "the", "of", "stone", "house", "and"]) for _ in range(80)) for _ in range(600)]
    df = spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    corpus = secrets.corpus_statistics(df)
    found = secrets.planted_findings(df, corpus).cache()
    plants = sum(len(r["plants"]) for r in secrets.planted(df, 600).collect())
    assert plants == 2400 and found.count() >= 0.9 * plants and found.count() == secrets.planted_findings(df, corpus).count()
    held = F.pmod(F.xxhash64("row"), F.lit(4)) == 0
    model = secrets.train(found.filter(~held), "row")
    judged = secrets.judge(found.filter(held), model).collect()
    hit = sum(r["is_secret"] and r["score"] >= 0.5 for r in judged)
    told, true = sum(r["score"] >= 0.5 for r in judged), sum(r["is_secret"] for r in judged)
    assert hit >= 0.95 * told and hit >= 0.95 * true
    rules = secrets.rule_labels(found.filter(held).withColumnRenamed("is_secret", "planted")).collect()
    wrong = sum(bool(r["is_secret"]) != r["planted"] for r in rules)
    assert wrong > 5 * sum((r["score"] >= 0.5) != r["is_secret"] for r in judged)  # the rule cannot tell many of them
    # the whole query, on texts with secrets and look-alikes of other draws
    path, want, rows = new_path(spark, "sf"), set(), []
    for i, t in enumerate(texts):
        before, value, after, secret = secrets.plant(rng, ["stone", "house"])
        rows.append((i, f"{t} {before}{value}{after} {t}", "en", "s0", 1))
        want |= {(i, value)} if secret else set()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    got = {(r["doc_id"], r["value"]) for r in llm.op2_secret_forest(spark, path).collect()}
    assert len(got & want) >= 0.93 * len(want) and len(got & want) >= 0.93 * len(got)


def test_resampling_query_by_brute_force(spark):
    rng = random.Random(9)
    good, bad = ["tree", "river", "stone", "house", "garden", "light"], ["###", "&&&", "zx", "qq", "$$$"]
    rows, labels = [], []
    for i in range(200):
        words = [rng.choice(good if rng.random() < (0.9 if i % 3 else 0.2) else bad) for _ in range(rng.randrange(1, 90))]
        rows.append((i, " ".join(words) if i % 40 else None, "en", "s", 1))
        if i % 2:
            labels.append((i, int(bool(i % 3)), 0))
    path = new_path(spark, "sf")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    got = {r["doc_id"]: r for r in llm.op10_importance_resampling(spark, path).collect()}
    noise = {r["doc_id"]: r["noise"] for r in df.select("doc_id", quality.gumbel_noise("doc_id", "text", 0)).collect()}
    marks, counts, of = dict(l[:2] for l in labels), np.zeros((2, quality.BUCKETS)), {}
    for i, text, *_ in rows:
        of[i], _ = quality.bucketed([(text or "").encode()], quality.BUCKETS)
        np.add.at(counts[0], of[i], 1)
        if marks.get(i):
            np.add.at(counts[1], of[i], 1)
    p = (counts + quality.SMOOTHING) / (counts + quality.SMOOTHING).sum(axis=1, keepdims=True)
    ratio = np.log(p[1] / p[0])
    per = {i: ratio[b].sum() / (len(b) + quality.PRIOR) for i, b in of.items()}
    score = {i: quality.STRENGTH * per[i] + noise[i] for i in of}
    steps = {i: min(400, max(0, int(np.ceil(-100 * per[i])))) for i in marks if len(of[i])}
    gain = []
    for bar in range(401):
        share = [np.mean([steps[i] <= bar for i in steps if marks[i] == g]) for g in (0, 1)]
        gain.append(quality.KEEP_GOOD * share[1] - share[0])
    best = np.flatnonzero(np.array(gain) >= max(gain) - 1e-12)
    k = sum(v >= -best[len(best) // 2] / 100 for v in per.values())
    kept = set(sorted(score, key=lambda i: -score[i])[:k])
    assert {i for i, r in got.items() if r["kept"]} == kept and 0 < len(kept) < 200
    assert all(abs(r["gumbel_score"] - score[i]) < 1e-6 and r["n_grams"] == len(of[i]) for i, r in got.items())


def test_ids_of_null_and_repeated_rows(spark):
    rows = [(None, "a b", "x"), (4, "a b", "y"), (4, "a b", "z"), (None, None, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, bytes string")
    assert sorted(len(r["ids"]) for r in bpe.encode(df, RANKS, public_tokenizers.PATTERN).collect()) == [0, 2, 2, 2]
    decoded = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN).withColumn("bytes", F.lit("x")), RANKS)
    assert decoded.columns == ["doc_id", "ids", "bytes"] and sorted(bytes(r["bytes"]) for r in decoded.collect()) == [b"", b"a b", b"a b", b"a b"]
    path = new_path(spark, "t")
    tokenfile.write_token_files(df, path, TOKENIZER, end_id=2)
    back = tokenfile.read_token_files(spark, path).orderBy("start").collect()
    assert [r["id"] for r in back] == [None, None, 4, 4] and [r["start"] for r in back] == [0, 1, 4, 7]
    assert packing.pack_documents(df, TOKENIZER).count() == 4


def test_a_very_long_text(spark):
    df = spark.createDataFrame([(1, LONG), (2, "short text of five words"), (3, LONG + " more")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df).collect()}
    assert got[1]["n_shingles"] == 9973 + 1 and [got[i]["component_id"] for i in (1, 2, 3)] == [1, 2, 1]
    assert bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS).filter(F.col("bytes") == F.encode(F.lit("short text of five words"), "utf-8")).count() == 1
    assert packing.pack_documents(df, TOKENIZER).groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").isEmpty()
    assert quality.resample(df, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 3
    assert secrets.scan(df).filter("doc_id = 2").count() == 0
    assert langid.predict(df, langid.fit(df.withColumn("lang", F.lit("aa")))).count() == 3


def test_no_rows(spark):
    none, labels = docs(spark, []), spark.createDataFrame([], "doc_id long, quality int")
    assert quality.resample(none, labels).count() == 0 and quality.keep_drawn(none, labels).count() == 0
    model = langid.fit(none.withColumn("lang", F.lit(None).cast("string")))
    assert langid.predict(none, model).count() == 0 and langid.keep_identified(none, model).count() == 0
    assert secrets.redact(none, secrets.scan(none)).count() == 0
    assert embdedup.near_duplicate_vectors(vectors(spark, [], [])).count() == 0
    some = vectors(spark, [[1.0, 2.0], [2.0, 1.0]])
    assert ann.search(some, some.filter("false"), 3).count() == 0 and ann.search(some.filter("false"), some, 3).count() == 0
    path = new_path(spark, "none")
    tokenfile.write_token_files(none, path, TOKENIZER, end_id=2)
    assert tokenfile.read_token_files(spark, path).count() == 0
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), f"{path}/w")
    assert warc.resolved_records(warc.read_warc(spark, f"{path}/w")).count() == 0


def test_stages_with_odd_rows(spark, sf):
    path, rows, _ = sf
    spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(100)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    form = "doc_id long, text string, lang string, source string, n_chars long, row_id long, row_id_ string, good string"
    table = spark.createDataFrame([(*r, 7, "x", "y") for r in rows] + [(None, "the of and " * 9, "en", None, None, 1, "x", "y")] * 2, form)
    for stage in (corpus_pipeline.quality_stage, corpus_pipeline.language_stage, corpus_pipeline.near_duplicate_stage, corpus_pipeline.secrets_stage):
        for docs_ in (table, table.filter("false")):
            kept = stage(spark, docs_, path)
            assert kept.columns == table.columns and kept.count() <= docs_.count()
    assert corpus_pipeline.packing_stage(spark, table.filter("false"), path).count() == 0
    out = corpus_pipeline.run(spark, path).toPandas()
    assert len(out) and out.groupby("sequence_id")["length"].sum().max() <= 2048


def test_shared_folder_must_be_named_on_a_cluster():
    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared_dir(Session())
