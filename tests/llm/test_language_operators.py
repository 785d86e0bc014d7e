"""Operators on languages and sources: divergence audit, collocations, language identification."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from corpusloom.llm import language_id, phrase_mining, source_divergence
from corpusloom.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, item string, score string, size string, shard string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def documents(spark, rows):
    """Rows (text, lang, source) with an id (the second has none, the fourth that of the third) and columns whose names the operators use inside."""
    ids = [None if k == 1 else 2 if k == 3 else k for k in range(len(rows))]
    return spark.createDataFrame([(i, *r, "x", "y", "z", "s") for i, r in zip(ids, rows, strict=True)], DOCS)


def some_rows(seed, n, vocabulary=30):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdéß漢") for _ in range(r.randint(1, 4))) for _ in range(vocabulary)]
    rows = []
    for k in range(n):
        lang, source = r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "s3", "s4", "s5", None])
        rows.append((" ".join(r.choice(words).upper() if r.random() < 0.2 else r.choice(words) for _ in range(r.randint(0, 40))) + r.choice([".", "", "!\n x9y"]), lang, source))
    return rows + [(None, "en", "s1"), ("", "xx", "alone"), ("12 ;", "xx", None), ("Long " * 30_000, "en", "s2")]


# ---------------------------------------------------------------- divergence
def brute_audit(rows, least, most):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        groups[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in docs.keys() | {x for x, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: c for (x, s), c in groups.items() if x == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: B023,E731
        p, q = {s: share(c) for s, c in own.items()}, share(sum(own.values(), Counter()))
        for s in own:
            pairs = [(x, sum(abs(p[s][t] - p[x][t]) for t in kept)) for x in own if x != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found, last in (("pair", pairs, None), ("term", terms, most)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found[:last], 1)]
    return sorted(out)


@pytest.mark.parametrize(("terms", "groups", "wave"), [(32_768, 16, 16), (4, 1, 2)])
def test_audit_equals_brute_force(spark, monkeypatch, terms, groups, wave):
    """In one shard and block, and in several of each over more than one wave of rounds."""
    for name, value in (("TERMS", terms), ("GROUPS", groups), ("WAVE", wave)):
        monkeypatch.setattr(source_divergence, name, value)
    rows = some_rows(1, 120)
    found = source_divergence.audit(documents(spark, rows), min_docs=5, most=3)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == brute_audit(rows, 5, 3)


def test_audit_of_little(spark):
    df = documents(spark, some_rows(2, 0))
    assert source_divergence.audit(df.limit(0)).count() == 0
    assert {(r["source"], r["item"], r["value"]) for r in source_divergence.audit(df).filter("part = 'pair'").collect()} == {("s1", "s2", 0), ("s2", "s1", 0), ("alone", "", 0), ("", "alone", 0)}


def test_shares_of_counts_beyond_64_bits():
    count, total, terms = np.array([0, 3, 10**12, 7 * 10**14]), 9 * 10**14, 10**6
    assert source_divergence.shares(count, total, terms).tolist() == [1 + 10**9 * (int(c) + 5) // (total + 5 * terms) for c in count]


def test_blocks_meet_once():
    """The rounds of a language of n blocks hold every pair, in one place."""
    for n in range(1, 9):
        met = Counter()
        for turn in range(n):
            for block in range(n):
                place = (turn - block) % n
                if place == block or (place < block) == ((place + block) % 2 == 0):
                    met[frozenset((place, block))] += 1
        assert set(met.values()) == {1} and len(met) == n * (n + 1) // 2


# ---------------------------------------------------------------- collocations
def brute_phrases(rows, enough, covered, best):
    counts, total = defaultdict(Counter), Counter()
    for text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, 6):
                counts[lang].update(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
    out = []
    for lang, own in counts.items():
        often = {p: a for p, a in own.items() if len(p) > 1 and a >= enough}
        inside = Counter()
        for p, a in often.items():
            for n in range(2, len(p)):
                for k in range(len(p) - n + 1):
                    inside[p[k : k + n]] = max(inside[p[k : k + n]], a)
        found = []
        for p, a in often.items():
            if 100 * inside[p] >= covered * a:
                continue
            cuts = [(1000 * a * total[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        found.sort()
        out += [(lang, rank, p.decode(), -a, left, right, total[lang], -score) for rank, (score, a, p, left, right) in enumerate(found[:best], 1)]
    return sorted(out)


PHRASES = [("New York is big. new york, new york", "en", "s"), ("a\tb a\tb a b", None, "s"), ("a b\na b\vx y z w v u", "und", "s"), ("x y z w v u; x y z w v u", "und", "s"), (None, "en", "s"), ("", "", "s"), ("É é É é", "fr", "s"), ("x y x y x y x y", "fr", "s")] * 2


@pytest.mark.parametrize("bits", [20, 4])
def test_phrases_equal_brute_force(spark, monkeypatch, bits):
    """With a sketch that has room and with one that lets nearly all pass."""
    monkeypatch.setattr(phrase_mining, "LEAST_BITS", bits)
    monkeypatch.setattr(phrase_mining, "MOST_BITS", bits)
    rows = PHRASES + some_rows(3, 60, 8)
    for enough, covered, best in ((3, 100, 2000), (4, 60, 5)):
        found = phrase_mining.collocations(documents(spark, rows).repartition(5), enough=enough, covered=covered, best=best)
        assert sorted(map(tuple, found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == brute_phrases(rows, enough, covered, best)


def test_phrases_of_little(spark):
    df = documents(spark, PHRASES)
    assert phrase_mining.collocations(df).count() == 0 and phrase_mining.collocations(df.limit(0)).count() == 0


def test_sketch_never_counts_too_little(spark):
    """Cells of many tasks' sketches reach the threshold where their sum does, and few others do."""
    df = spark.createDataFrame([("a b c " * 3, "en") for _ in range(40)] + [(f"w{k} v{k}", "en") for k in range(3000)], "text string, lang string").repartition(20)
    bits = phrase_mining.sketch(df, 5, 100)
    words = phrase_mining._Words(pa.record_batch([pa.array(["a b c " * 3]), pa.array(["en"])], ["text", "lang"]), 5)
    size = bits.shape[1].bit_length() + 2
    for at, h in zip(words.begin[:3], words.hash[:3], strict=True):
        for row in range(phrase_mining.ROWS):
            cell = phrase_mining._cells(h[at[:1]], row, size)
            assert ((bits[row, cell >> 3] >> (cell & 7).astype(np.uint8)) & 1).all()
    assert np.unpackbits(bits).sum() < 100


# ---------------------------------------------------------------- languages
def plain_features(text):
    """Counts of buckets, one n-gram after the other."""
    own, m = "", 2**64 - 1
    for c in (text or "").lower():
        if c.isalpha():
            own += c
        elif own and own[-1] != " ":
            own += " "

    def mixed(h):
        h ^= h >> 30
        h = h * 0xBF58476D1CE4E5B9 & m
        h ^= h >> 27
        h = h * 0x94D049BB133111EB & m
        return h ^ h >> 31

    out = Counter()
    for n in range(1, 4):
        for k in range(len(own) - n + 1):
            h = 0
            for j, c in enumerate(own[k : k + n], 1):
                h = mixed(h * 0x9E3779B97F4A7C15 + ord(c) + j & m)
            out[h >> 48] += 1
    return out


TEXTS = [("The cat, the DOG", "en"), ("ein Hund — und Öl", "de"), (None, "de"), ("12 !!", "en"), ("the end", None), ("x" * 3000 + " yy", "en"), ("der Hund", "de"), ("le chat", "fr"), ("", "fr"), ("der Hund", "de")]


def test_features_equal_a_plain_loop():
    text, bucket, times = language_id.features(pa.array([t for t, _ in TEXTS]))
    for k, (t, _) in enumerate(TEXTS):
        assert dict(zip(bucket[text == k].tolist(), times[text == k].tolist(), strict=True)) == plain_features(t)


@pytest.mark.parametrize("block", [64, 1])
def test_languages_equal_plain_bayes(spark, block):
    rows = documents(spark, [(t, lang, "s") for t, lang in TEXTS])
    model = language_id.train(rows, F.coalesce("doc_id", F.lit(0)) != 7, block=block)
    assert model.languages == ["de", "en", "fr"]
    learned = [(t, lang) for k, (t, lang) in enumerate(TEXTS) if lang and k not in (1, 7)]
    counts, seen = defaultdict(Counter), Counter(lang for _, lang in learned)
    for k, (t, lang) in enumerate(TEXTS):
        if lang and k not in (1, 7):  # the second row has no id
            counts[lang] += plain_features(t)
    found = {(r["text"]): r for r in language_id.identify(rows, model).collect()}
    assert found["ein Hund — und Öl"]["item"] == "x"
    for t, _ in TEXTS:
        own = plain_features(t)
        if not own:
            assert (found[t]["lang_pred"], found[t]["score"]) == ("und", 0.0)
            continue
        scale = min(1, 100 / sum(own.values()))
        sums = {x: math.log(seen[x] / len(learned)) + scale * sum(n * math.log((counts[x][b] + 0.5) / (sum(counts[x].values()) + 0.5 * 65536)) for b, n in own.items()) for x in seen}
        best = max(sorted(sums), key=sums.get)
        assert found[t]["lang_pred"] == best
        assert found[t]["score"] == pytest.approx(1 / sum(math.exp(v - sums[best]) for v in sums.values()), rel=1e-3)


def test_languages_of_little(spark):
    rows = documents(spark, [(t, None, "s") for t, _ in TEXTS])
    none = language_id.train(rows, F.lit(True))
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(rows, none).collect()} == {("und", 0.0)}
    assert language_id.identify(rows.limit(0), none).count() == 0
    assert language_id.identify(rows.limit(0), language_id.train(rows.withColumn("lang", F.lit("en")), F.lit(True))).count() == 0


def test_a_language_learns_from_a_bounded_sample(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.when(F.col("id") < 5, "rare").otherwise("often").alias("lang"))
    model = language_id.train(rows, F.lit(True), max_labelled=1000)
    assert model.languages == ["often", "rare"]
    found = language_id.identify(rows.limit(1), model).first()
    assert found["lang_pred"] == "often" and 0.99 < found["score"] <= 1


def test_held_out_languages(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op13_language_id"](spark, SF).join(truth, "doc_id").filter("held_out")
    assert found.count() > 30 and found.filter("lang = lang_pred").count() >= 0.98 * found.count()
