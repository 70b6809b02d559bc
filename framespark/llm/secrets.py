"""Secret scans: candidate strings judged by a random forest that removes false positives.

Candidates are found by their form alone. Each is described by its length and characters, by how likely its
character transitions are in the corpus, by how much of it dictionary words of the corpus cover, by the path (source)
of its document and by its neighbouring words. A random forest is fitted on labelled findings; where none are given, they
are made: secrets and look-alikes of known kinds are planted into a bounded sample of the documents, so that labels come
from what was planted and not from the features.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize
from .wordhash import U, hash_words
from .worker import begin_task, stretches, texts

#: Words that go with credentials, and words that go with look-alikes.
CREDENTIAL_WORDS = (
    "access api apikey auth authorization aws bearer client credential credentials key passwd password private pwd "
    "secret session signing token"
).split()
LOOKALIKE_WORDS = (
    "card checksum commit digest doi etag hash id invoice isbn issn md5 mail order phone revision sha1 sha256 tel uuid"
).split()
#: How well-known credentials begin.
PREFIXES = re.compile(
    r"(?:AKIA|ASIA)[0-9A-Z]{16}$|gh[pousr]_[0-9A-Za-z]{36,}$|xox[abprs]-[0-9A-Za-z-]{10,}$|[sr]k_live_[0-9A-Za-z]{16,}$"
    r"|AIza[0-9A-Za-z_-]{35}$|eyJ[0-9A-Za-z_-]{10,}|glpat-[0-9A-Za-z_-]{20,}$"
)
#: A candidate: a long run of the characters of keys with a digit in it, after the names that are set to it within the
#: run, or what is assigned to a credential word.
DIGIT = re.compile(r"[0-9]")
RUN_BEFORE = re.compile(r"[0-9A-Za-z+/_=-]*\Z")
RUN = re.compile(r"[0-9A-Za-z+/_=-]{16,}(?:\.[0-9A-Za-z+/_=-]{8,}){0,2}|[0-9A-Za-z+/_=-]+")
SHORTEST = 16
GIVEN_WORDS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey")
GIVEN = re.compile(r"(?i:(?:password|passwd|pwd|secret|token|api_?key)[\"']?\s*[:=]\s*[\"']?)((?:(?!&[\w.-]+=)[^\s\"'|,;]){8,})")
ASSIGNED = re.compile(r"[:=]\s*[\"']?$")
#: A name and its "=" within a run (NAME=value, /path?name=value); the "=" that pad a value at its end are not such.
NAMED = re.compile(r"[A-Za-z0-9_/+.-]*[A-Za-z0-9_-]=(?=[^=])")
WORD = re.compile(r"[^\W\d_]+")
CONTEXT = 60
#: Bytes of text that are looked through at once.
SLICE = 1 << 18

BUCKETS = 1 << 16
LETTERS = 27
FEATURES = [
    "length", "digits", "upper", "lower", "symbols", "distinct", "entropy", "transitions", "coverage", "longest_word",
    "prefix", "assigned", "quoted", "credential_near", "credential_before", "lookalike_near", "hexadecimal",
    "all_digits", "path_bucket", "path_test", "next_letter",
]
#: Findings that the forest is fitted on, about.
MAX_TRAIN = 20_000
TREES, DEPTH = 20, 8


#: Documents that secrets and look-alikes are planted into, about, plants in each, and plants at least in small tables.
PLANT_DOCS, PLANTS, LEAST_PLANTS = 2_000, 4, 2_400
_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_HEX, _DIGITS = "0123456789abcdef", "0123456789"


def _drawn(rng: random.Random, alphabet: str, low: int, high: int | None = None) -> str:
    """A string with a digit in it."""
    n = rng.randint(low, high or low)
    text = "".join(rng.choice(alphabet) for _ in range(n))
    at = rng.randrange(n)
    return text if any(c in _DIGITS for c in text) else text[:at] + rng.choice(_DIGITS) + text[at + 1 :]


def plant(rng: random.Random, words: list[str]) -> tuple[str, str, str, bool]:
    """(what goes before, value, what goes after, whether it is a secret) of a random kind, half of them secrets.

    ``words`` are some of the document's own. Secrets: keys with known beginnings; random values set to a credential word or
    told in prose. Look-alikes: commit hashes, checksums, ids, numbers, file names, versions, dates and placeholders, some
    of them set to a name like a secret is.
    """
    a, b = rng.choice(words), rng.choice(words)
    quote = rng.choice(["", "", '"', "'"])
    equals = rng.choice(["=", " = ", ": ", ":"])
    name = rng.choice(["password", "api_key", "secret", "token", "client_secret", "auth_token", "DB_PASSWORD", "private_key", "access_key"])
    if rng.random() < 0.5:
        value = rng.choice([
            "AKIA" + _drawn(rng, _ALNUM[:26] + _DIGITS, 16), "ghp_" + _drawn(rng, _ALNUM, 36), "sk_live_" + _drawn(rng, _ALNUM, 24), "xoxb-" + _drawn(rng, _DIGITS, 12) + "-" + _drawn(rng, _ALNUM, 24),
            "eyJ" + _drawn(rng, _ALNUM, 20) + "." + _drawn(rng, _ALNUM, 30) + "." + _drawn(rng, _ALNUM, 40), *(_drawn(rng, alphabet, 10, 48) for alphabet in (_ALNUM, _ALNUM + "+/", _ALNUM + "!@%-_", _ALNUM[26:], _HEX, _HEX)),
            _drawn(rng, _ALNUM[:52], 18, 30) + _drawn(rng, _DIGITS, 1, 3), f"{a[:9].capitalize()}{b[:9].title()}{_drawn(rng, _DIGITS, 1, 4)}",
        ])
        known, told = PREFIXES.match(value), len(value) < 20 or value.startswith(a[:9].capitalize())
        style = 0 if told else rng.randrange(3 if known else 2)
        if style == 2:
            return f"{a} ", value, f" {b}", True
        before = f"{name}{equals}{quote}" if style == 0 else rng.choice([f"the {name.lower()} is ", f"use {name.lower()} ", "Authorization: Bearer "])
        line = rng.random() < 0.3  # alone on a line, as in a file of settings
        return ("\n" if line else "") + before, value, (quote if style == 0 else "") + ("\n" if line else ""), True
    number = _drawn(rng, _DIGITS, 16, 20)
    kinds = [
        ("commit ", _drawn(rng, _HEX, 40)), ("sha256: ", _drawn(rng, _HEX, 64)), ("checksum=", _drawn(rng, _HEX, 32)), ("md5 ", _drawn(rng, _HEX, 32)), ("etag: ", _drawn(rng, _HEX, 32)),
        ("id ", "-".join(_drawn(rng, _HEX, n) for n in (8, 4, 4, 4, 12))), ("order ", number), ("invoice no. ", number), ("phone ", _drawn(rng, _DIGITS, 16)), ("isbn ", "978-" + _drawn(rng, _DIGITS, 13)),
        (f"{a} ", f"{a}_{b}_20{_drawn(rng, _DIGITS, 2)}_v{rng.randint(1, 9)}_final"), (f"{a}/", f"{b}/{a}-{b}-{rng.randint(1, 999)}/index"), ("version ", f"{rng.randint(1, 9)}-{a}-{b}-build-{_drawn(rng, _DIGITS, 4)}"),
        ("on ", f"20{_drawn(rng, _DIGITS, 2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T12-{_drawn(rng, _DIGITS, 2)}-00"), (f"{name}{equals}", f"your-{name.lower().replace('_', '-')}-here-1"), (f"{name}{equals}", f"example-{a}-{b}-123"),
        (f"{name}_id{equals}", number), (f"token count{equals}", number), (f"{a} ", number), (f"{a} ", f"{a}{b}{rng.randint(10, 99)}{a}{b}"),
    ]
    before, value = rng.choice(kinds)
    return before, value, "", False


def planted(docs: DataFrame, rows: int, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``row, text, path, plants``: about ``PLANT_DOCS`` of the ``rows`` documents with secrets and look-alikes in them.

    A small table gets more plants in each document. ``plants`` are structs of start, length and is_secret, in characters of the new text. Documents are drawn by a hash of id
    and text, and so is what is planted: any run gives the same.
    """
    plants = max(PLANTS, -(-LEAST_PLANTS // max(rows, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, text, path in zip(*(c.to_pylist() for c in batch.columns)):
                rng, text = random.Random(row), text or ""
                words = [w for w in WORD.findall(text[:4000]) if len(w) > 2] or ["value", "text"]
                spaces = [m.start() for m in re.finditer(" ", text)] or [len(text)]
                at, new, size, last, found = sorted(rng.choice(spaces) for _ in range(plants)), [], 0, 0, []
                for place in at:
                    before, value, after, secret = plant(rng, words)
                    new += [text[last:place], " ", before, value, after]
                    size += place - last + 1 + len(before)
                    found.append({"start": size, "length": len(value), "is_secret": secret})
                    size, last = size + len(value) + len(after), place
                out.append((row, "".join([*new, text[last:]]), path, found))
            columns = list(zip(*out)) if out else [[]] * 4
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("is_secret", pa.bool_())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["row", "text", "path", "plants"])

    path = F.col(path_col).cast("string") if path_col in docs.columns else F.lit(None).cast("string")
    text = F.col(text_col).cast("string")
    draw = F.xxhash64(F.col(id_col).cast("string"), text, F.lit(17))
    share = min(1.0, PLANT_DOCS / max(rows, 1))
    source = docs.select(draw.alias("row"), text.alias("text"), path.alias("path")).filter(F.pmod("row", F.lit(1 << 30)) < share * (1 << 30))
    return source.mapInArrow(run, "row long, text string, path string, plants array<struct<start: long, length: long, is_secret: boolean>>")


def planted_findings(docs: DataFrame, corpus: "Corpus", id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Labelled candidates (see ``find_candidates``, by ``row``): those that are what was planted, with ``is_secret``."""
    sample = materialize(planted(docs, docs.count(), id_col, text_col, path_col), "planted")
    candidates = find_candidates(sample.select("row", "text", "path"), corpus, "row", "text", "path")
    plants = sample.select("row", F.explode("plants").alias("p")).select("row", F.col("p.start").alias("from"), (F.col("p.start") + F.col("p.length")).alias("to"), "p.is_secret")
    inside = (F.col("start") < F.col("to")) & (F.col("start") + F.col("length") > F.col("from"))
    return candidates.join(plants, "row").filter(inside).drop("from", "to")


@dataclass
class Corpus:
    """Counted over all texts: log probabilities of character transitions, and which word buckets are frequent."""

    transitions: np.ndarray
    frequent: np.ndarray


def corpus_statistics(docs: DataFrame, text_col: str = "text", frequent: float = 8.0) -> Corpus:
    """A word is of the dictionary if its hash bucket holds ``frequent`` times the mean number of occurrences."""
    cells = LETTERS * LETTERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells + BUCKETS, np.int64)
        kind = np.full(256, 26, np.int16)
        kind[97:123] = kind[65:91] = np.arange(26)
        begin_task()
        for batch in batches:
            for _, _, part in texts(batch.column(0), SLICE):
                data = kind[np.frombuffer(b"\n".join(part), np.uint8)]
                total[:cells] += np.bincount(data[:-1] * LETTERS + data[1:], minlength=cells)
                words, _ = hash_words(part)
                total[cells:] += np.bincount((words % U(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["counts"])

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "counts array<long>")
    flat = rows.select(F.posexplode("counts").alias("place", "n"))
    total = np.zeros(cells + BUCKETS, np.int64)
    # a row for each place that was met
    for r in flat.filter("n > 0").groupBy("place").agg(F.sum("n").alias("n")).collect():
        total[r["place"]] = r["n"]
    moves = total[:cells].reshape(LETTERS, LETTERS) + 1.0
    words = total[cells:]
    return Corpus(np.log(moves / moves.sum(axis=1, keepdims=True)), words > max(2.0, frequent * words.mean()))


def candidate_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of all candidates, in order and without overlap; text without digits or credential words is passed
    over by plain searches."""
    spans, at = [], 0
    while m := DIGIT.search(text, at):
        lo, window = m.start(), 64
        while True:
            edge = max(at, m.start() - window)
            lo = RUN_BEFORE.search(text, edge, m.start()).start()
            if lo > edge or edge == at:
                break
            window *= 4
        at = RUN.match(text, lo).end()
        while name := NAMED.match(text, lo, at):
            lo = name.end()
        if at - lo >= SHORTEST and DIGIT.search(text, lo, at):
            spans.append((lo, at))
    low = text.lower()
    if any(w in low for w in GIVEN_WORDS):
        starts, alone = [lo for lo, _ in spans], []
        for lo, hi in (m.span(1) for m in GIVEN.finditer(text)):
            k = bisect_right(starts, lo) - 1
            if k >= 0 and spans[k][1] > lo:
                if spans[k][1] >= hi:  # what is given stands for the run around it
                    spans[k] = (lo, hi)
            elif k + 1 == len(spans) or spans[k + 1][0] >= hi:
                alone.append((lo, hi))
        spans = sorted(spans + alone)
    return spans


def _letters(text: str) -> list[int]:
    return [ord(c) - 97 if "a" <= c <= "z" else 26 for c in text.lower()]


def describe(corpus: Corpus, path: str, before: str, value: str, after: str) -> list[float]:
    """The features of one candidate, in the order of FEATURES."""
    n = len(value)
    count = Counter(value)
    digits, upper, lower = (sum(map(f, value)) for f in (str.isdigit, str.isupper, str.islower))
    at = _letters(value)
    moves = [corpus.transitions[a, b] for a, b in zip(at, at[1:], strict=False)]
    words = [w for w in WORD.findall(value) if len(w) >= 3]
    known = []
    if words:
        hashes, _ = hash_words([" ".join(words).encode()])
        hit = corpus.frequent[(hashes % U(BUCKETS)).astype(np.int64)]
        known = [len(w) for w, h in zip(words, hit.tolist(), strict=True) if h]
    near = [w.lower() for w in WORD.findall(before)[-3:]]
    ahead = [w.lower() for w in WORD.findall(after)[:1]]
    path = path or ""
    return [
        float(n),
        digits / n,
        upper / n,
        lower / n,
        (n - digits - upper - lower) / n,
        len(count) / n,
        -sum(c / n * math.log2(c / n) for c in count.values()),
        sum(moves) / max(1, len(moves)),
        sum(known) / n,
        float(max(map(len, words), default=0)),
        float(bool(PREFIXES.match(value))),
        float(bool(ASSIGNED.search(before))),
        float(before[-1:] in "\"'" and before[-1:] == after[:1] and before != ""),
        float(any(w in CREDENTIAL_WORDS for w in near + ahead)),
        float(bool(near) and near[-1] in CREDENTIAL_WORDS),
        float(any(w in LOOKALIKE_WORDS for w in near)),
        float(all(c in "0123456789abcdefABCDEF" for c in value)),
        float(digits == n),
        float(sum(path.encode()) % 16),
        float(bool(re.search(r"test|example|sample|fixture|mock", path.lower()))),
        float(after[:1].isalpha()),
    ]


def find_candidates(
    docs: DataFrame, corpus: Corpus, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source"
) -> DataFrame:
    """``id_col, start, length, value, before, after, features`` of every candidate in whole texts.

    ``start`` and ``length`` count characters. ``path_col`` may be missing; then no document has a path. Null texts have no
    candidates; null and repeated ids are carried along, and other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.float64())]
        names = [id_col, "start", "length", "value", "before", "after", "features"]
        begin_task()
        for batch in batches:
            for first, end in stretches(batch.column(1), SLICE):
                rows = []
                for doc, text, path in zip(*(batch.column(k).slice(first, end - first) for k in range(3)), strict=True):
                    if not text.is_valid:
                        continue
                    whole = text.as_py()
                    for lo, hi in candidate_spans(whole):
                        before, after = whole[max(0, lo - CONTEXT) : lo], whole[hi : hi + CONTEXT]
                        features = describe(corpus, path.as_py(), before, whole[lo:hi], after)
                        rows.append((doc.as_py(), lo, hi - lo, whole[lo:hi], before, after, features))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    path = F.col(path_col).cast("string") if path_col in docs.columns else F.lit(None).cast("string")
    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), path)
    schema = (
        f"{id_col} long, start long, length long, value string, before string, after string, features array<double>"
    )
    return source.mapInArrow(run, schema)


def rule_labels(candidates: DataFrame) -> DataFrame:
    """Adds ``is_secret`` where a rule of high precision can tell, null elsewhere.

    True: a known beginning, or a value of mixed characters assigned to a credential word. False: digits only, or
    neither assigned nor after a credential word nor high in entropy.
    """
    f = {name: F.col("features")[i] for i, name in enumerate(FEATURES)}
    random_like = (f["entropy"] >= 3) & (f["digits"] > 0.05) & (f["coverage"] < 0.3)
    sure = (f["prefix"] == 1) | ((f["assigned"] == 1) & (f["credential_before"] == 1) & random_like)
    never = (f["all_digits"] == 1) | ((f["assigned"] == 0) & (f["credential_near"] == 0) & (f["entropy"] < 3.5))
    return candidates.withColumn("is_secret", F.when(sure, True).when(never, False))


def train(labelled: DataFrame, id_col: str = "doc_id", max_rows: int = MAX_TRAIN, seed: int = 5):
    """A forest on about ``max_rows`` labelled findings, drawn by a hash; None unless both kinds are there.

    The rarer kind is weighted up to the other.
    """
    from pyspark.ml.classification import RandomForestClassifier  # the driver's alone: workers import this module too
    from pyspark.ml.functions import array_to_vector

    rows = labelled.filter("is_secret is not null").select(id_col, "start", "features", F.col("is_secret").cast("double").alias("y"))
    found = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(found) < 2:
        return None
    most = max(found.values())
    draw = F.pmod(F.xxhash64(id_col, "start", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    weight, share = F.lit(1.0), F.lit(1.0)
    for y, n in found.items():
        kept = min(n, max_rows // 2)
        weight = F.when(F.col("y") == y, most / n).otherwise(weight)
        share = F.when(F.col("y") == y, kept / n).otherwise(share)
    sample = materialize(rows.filter(draw < share).withColumn("weight", weight), "findings")
    ready = sample.select("y", "weight", array_to_vector("features").alias("x"))
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="y", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=seed, maxBins=32
    )
    return forest.fit(ready)


def judge(candidates: DataFrame, model) -> DataFrame:
    """Adds ``score``, the forest's probability that a candidate is a secret (without a forest: 1 where ``rule_labels`` is
    sure that it is one, else 0)."""
    if model is None:
        sure = F.coalesce(F.col("is_secret"), F.lit(False))
        return rule_labels(candidates).withColumn("score", sure.cast("double")).drop("is_secret")
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scored = model.transform(candidates.withColumn("x", array_to_vector("features")))
    return scored.withColumn("score", vector_to_array("probability")[1]).drop(
        "x", "rawPrediction", "probability", "prediction"
    )


def scan(
    docs: DataFrame,
    findings: DataFrame | None = None,
    threshold: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str = "source",
) -> DataFrame:
    """One row per secret found: ``id_col, start, length, value, score``.

    ``findings`` are labelled candidates (``id_col, start, length, is_secret``); by default they are planted (see
    ``planted_findings``) into about ``PLANT_DOCS`` documents. Candidates have a digit and ``SHORTEST`` characters, or are
    set to one of ``GIVEN_WORDS``: keys of letters alone elsewhere are none. Null and empty texts hold nothing. Null and repeated ids are carried along; equal rows give equal
    findings. Other columns are ignored; no rows give no findings.
    """
    corpus = corpus_statistics(docs, text_col)
    candidates = materialize(find_candidates(docs, corpus, id_col, text_col, path_col), "candidates")
    if findings is None:
        model = train(planted_findings(docs, corpus, id_col, text_col, path_col), "row")
    else:
        marks = findings.groupBy(id_col, "start", "length").agg(F.max("is_secret").alias("is_secret"))
        model = train(candidates.join(marks, [id_col, "start", "length"]), id_col)
    found = judge(candidates, model).filter(F.col("score") >= threshold)
    return found.select(id_col, "start", "length", "value", "score")


def redact(docs: DataFrame, secrets: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every found value replaced by ``mark``; all columns, of any names, and all rows stay.

    ``secrets`` are rows of ``scan``. Spans are collected by id and joined; a span is cut out of a text only if its value
    is what the text has there, so rows that share an id lose their own secrets alone. Null texts stay null, and rows
    with a null id, which nothing can be joined to, stay as they are. Of spans that overlap the first is cut.
    """
    spans_col = "spans"
    while spans_col in docs.columns:
        spans_col += "_"
    span = F.struct(F.col("start").cast("int").alias("start"), F.col("length").cast("int").alias("length"), "value")
    spans = secrets.groupBy(F.col(id_col).alias(id_col)).agg(F.array_sort(F.collect_set(span)).alias(spans_col))
    where = docs.join(spans, id_col, "left")
    text = F.col(f"`{text_col}`")

    def cut(state, span):
        kept = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        there = (span["start"] >= state["at"]) & (F.substring(text, span["start"] + 1, span["length"]) == span["value"])
        done = F.struct(F.concat(state["out"], kept, F.lit(mark)).alias("out"), (span["start"] + span["length"]).alias("at"))
        return F.when(there, done).otherwise(state)

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate(spans_col, start, cut, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return where.withColumn(text_col, F.when(F.col(spans_col).isNull(), text).otherwise(done)).select(*(f"`{c}`" for c in docs.columns))
