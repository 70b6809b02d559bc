"""Exact duplicates, filter interaction and phrases against brute force, and nulls, ties, repeats, clashing names, no rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from framespark.llm import exact, filteraudit, phrases, quotient
from framespark.llm import queries as llm
from framespark.llm.storage import new_path

from .test_llm import ODD_TEXTS


@pytest.mark.parametrize("width", [3, 17, 58, 63])
def test_quotient_filters_keep_everything(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 5, 700):
        values = rng.integers(0, min(2**width, 2**63), n, dtype=np.uint64) & np.uint64(2**width - 1)
        values = np.concatenate((values, values[: n // 3]))
        found, counts = quotient.tally(values)
        again, same = quotient.unpack(quotient.pack(found, counts, width), width)
        assert again.tolist() == found.tolist() and same.tolist() == counts.tolist() and counts.sum() == len(values)
    parts = [rng.integers(0, min(2**width, 500), 200, dtype=np.uint64) for _ in range(4)]
    merged = quotient.merge([quotient.pack(*quotient.tally(p), width) for p in parts], width)
    assert dict(zip(*(x.tolist() for x in merged))) == Counter(np.concatenate(parts).tolist())


def _duplicates(rows, keep=max):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return sorted((i, keep(groups[t or ""]), len(groups[t or ""]), i == keep(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("bits", [64, 9])
def test_exact_duplicates(spark, bits):
    """With fingerprints of 9 bits most different texts share one: bytes decide."""
    rng = random.Random(3)
    texts = [*ODD_TEXTS, "z" * 400_000, *(f"text {rng.randrange(400)}" for _ in range(900)), *["hot"] * 500]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], "doc_id long, text string, sha string, row long, fp int").repartition(5)
    got = exact.exact_duplicates(df, bits=bits)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect())) == _duplicates(rows)
    if bits == 64:
        assert sorted(map(tuple, exact.exact_duplicates(df, keep="smallest").collect())) == _duplicates(rows, min)


def test_exact_duplicates_of_null_and_repeated_ids(spark):
    rows = [(7, "a"), (7, "a"), (3, "a"), (None, "a"), (None, "b"), (None, "b"), (None, "c"), (2, None), (1, "")]
    got = exact.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    at = lambda t: sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got if r["text_sha256"] == hashlib.sha256(t).hexdigest()), key=repr)
    assert at(b"a") == [(3, 7, 4, False), (7, 7, 4, False), (7, 7, 4, True), (None, 7, 4, False)]
    assert at(b"b") == [(None, None, 2, False), (None, None, 2, True)] and at(b"c") == [(None, None, 1, True)]
    assert at(b"") == [(1, 2, 2, False), (2, 2, 2, True)]
    assert exact.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _fails(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {
        "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
    }


def test_filter_audit_by_running_every_order(spark):
    rng = random.Random(5)
    texts = [*ODD_TEXTS]
    for _ in range(150):
        words = [rng.choice(["tree", "Big", "RED", "sea", "a#b", "x|"][: rng.choice([2, 4, 6])]) + str(rng.randrange(rng.choice([9, 900]))) for _ in range(rng.choice([5, 99, 100, 101, 140]))]
        texts.append(rng.choice([" ", "\n", "\t "]).join(words))
    texts += texts[20:50]
    rows = [(i, t, rng.choice(["en", "de", None])) for i, t in enumerate(texts)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, len(rows), 2)] + [(0, 1, 1), (None, 1, 1), (10**6, 1, 1)]
    df = spark.createDataFrame([(*r, True, 7) for r in rows], "doc_id long, text string, lang string, good boolean, part int").repartition(3)
    lf = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filteraudit.audit(*filteraudit.document_failures(df, lf))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()}
    good, toxic = ({i for i, *flags in labels if flags[k] == 1} for k in (0, 1))
    first, want = {}, {}
    for i, t, _ in rows:
        first.setdefault(t or "", i)
    failed = {i: {**_fails(t or ""), "E": first[t or ""] < i} for i, t, _ in rows}
    shapley = Counter()
    for part in ("en", "de", ""):
        mine = [i for i, _, lang in rows if (lang or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = set(mine)
            for step, f in enumerate(order, 1):
                fails = {i for i in mine if failed[i][f]}
                out = left & fails
                only = {i for i in fails if sum(failed[i].values()) == 1}
                want[part, order, step] = [len(left - fails), len(out), len(fails - left), len(only), len(out & good), len(out & toxic)]
                shapley[part, f] += len(out)
                left -= fails
    assert found == {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in want.items()} and len(found) == 3 * 600


def test_filter_audit_of_odd_tables(spark):
    rows = [(None, "x", None), (None, "x", ""), (4, "x", ""), (4, "x", ""), (5, None, "en")]
    labels = spark.createDataFrame([(None, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r["part"], r["step"]): r for r in filteraudit.audit(*filteraudit.document_failures(docs, labels)).filter("filter_order = 'EABCD'").collect()}
    assert (got["", 1]["removed"], got["", 1]["kept"], got["", 1]["good_lost"], got["en", 1]["removed"]) == (2, 2, 2, 0)
    assert got["", 2]["removed"] == 2 and got["", 2]["redundant"] == 2 and got["en", 2]["removed"] == 1
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filteraudit.audit(*filteraudit.document_failures(none, labels)).count() == 0
    tables = {k: spark.createDataFrame([(i,) for i in ids], "row long") for k, ids in {"x": [1, 2], "y": [2, 3]}.items()}
    base = spark.createDataFrame([(i, "p", False, False) for i in range(5)], "row long, part string, good boolean, toxic boolean")
    two = sorted((r["filter_order"], r["step"], r["kept"], r["removed"], r["shapley"]) for r in filteraudit.audit(base, tables).collect())
    assert two == [("xy", 1, 3, 2, 3), ("xy", 2, 2, 1, 3), ("yx", 1, 3, 2, 3), ("yx", 2, 2, 1, 3)]


def _phrases(rows, least, longest, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inner = defaultdict(int)
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inner[p[i : i + k]] = max(inner[p[i : i + k]], a)
        scored = []
        for p, a in cand.items():
            if 100 * inner[p] >= 100 * a:
                continue
            s, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("group", [phrases.GROUP, 300])
def test_phrases_by_brute_force(spark, group, monkeypatch):
    """With groups of 300 suffixes most prefixes are longer than a word, and texts come in several stretches."""
    if group == 300:
        monkeypatch.setattr(phrases, "GROUPS", 10**6)
    rng = random.Random(11)
    words = ["the", "of", "Ämter", "STATE", "art", "x\x00y", "é", "日本", "a|b", "zz"]
    rows = [(t, "en") for t in ODD_TEXTS]
    for i in range(260):
        text = "".join(rng.choice(words[: 3 + i % 8]) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x1c"]) for _ in range(rng.randrange(60)))
        rows.append((text, rng.choice(["en", "en", None, "de und"])))
    rows += [("over and over it goes", "en")] * 60 + [("the the the the the the the", "en")] * 40
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "text string, lang string, n int, part string").repartition(4)
    counts = phrases.count_phrases(df, least=12, longest=5, group=group)
    got = phrases.collocations(counts, top=150)
    assert got.columns == ["part", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == _phrases(rows, 12, 5, 150)


def test_phrase_scores_beyond_64_bits_and_no_rows(spark):
    big = 10**13
    rows = [("en", None, 0, big), ("en", "a", 1, big // 10), ("en", "b", 1, big // 10 - 1), ("en", "a b", 2, big // 20)]
    got = phrases.collocations(spark.createDataFrame(rows, "part string, phrase string, words int, n long")).collect()
    assert [tuple(r) for r in got] == [("en", 1, "a b", big // 20, big // 10, big // 10 - 1, big, 1000 * (big // 20) * big // (big // 10 * (big // 10 - 1)))]
    none = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(phrases.count_phrases(none)).count() == 0
    short = spark.createDataFrame([(None, None), ("", "en"), ("...", "en"), ("one", "en")], "text string, lang string")
    assert phrases.collocations(phrases.count_phrases(short, least=1)).count() == 0


def test_a_long_text_is_cut_between_words(monkeypatch):
    text = b"one two. three  fourfive six\tseven\neight" * 7
    whole = [t for some in phrases._tokens(text) for t in some]
    for stretch in (1, 2, 5, 11):
        monkeypatch.setattr(phrases, "STRETCH", stretch)
        assert [t for some in phrases._tokens(text) for t in some] == whole


def test_whole_queries(spark):
    path = new_path(spark, "sf")
    rows = [(i, t, "en", "s", 1) for i, t in enumerate([*ODD_TEXTS, *["Good morning, good night. " * 3] * 40])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert sorted(map(tuple, llm.op11_quotient_dedup(spark, path).collect())) == _duplicates([r[:2] for r in rows])
    assert llm.op12_filter_audit(spark, path).count() == 600
    found = llm.op13_collocations(spark, path)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == _phrases([(r[1], r[2]) for r in rows], 100, 5, 2000)
