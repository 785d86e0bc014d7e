"""Operators over the whole corpus: line dedup, near-duplicates, decontamination, classifiers, pipeline."""

import random
import tracemalloc
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from corpusloom.llm import common, decontaminate, near_dups, quality_model, quality_rules, toxicity
from corpusloom.llm.line_dedup import CuckooFilter, LineIndex, drop_lines
from corpusloom.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, set string, __score string"


def documents(spark, texts, first=0):
    return spark.createDataFrame([(first + k, t, "en", "src1", len(t or ""), "s", "x") for k, t in enumerate(texts)], DOCS)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


# ---------------------------------------------------------------- lines
def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute_lines(texts, least_docs, once=False):
    """With ``once`` equal texts count once."""
    lines = [(t or "").split("\n") for t in texts]
    seen = Counter(k for own in ([t.split("\n") for t in {t or "" for t in texts}] if once else lines) for k in {key(x) for x in own} if k)
    return ["\n".join(x for x in own if not (key(x) and seen[key(x)] >= least_docs)) for own in lines]


LINES = ["Cookie notice\n" + prose(k, 5) + "\n  COOKIE notice\t\nÄ line\n\n" + ("Ä LINE" if k % 2 else "x") for k in range(12)] + [None, "", "\n\n", "cookie notice", "same\nsame\nsame"]


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_lines_equal_a_plain_count(spark, broadcast_bytes):
    df = documents(spark, LINES)
    for least in (1, 2, 10):
        rows = {r["doc_id"]: r for r in drop_lines(df, LineIndex.build(df, min_docs=least, shards=4), broadcast_bytes=broadcast_bytes).collect()}
        assert [rows[k]["text"] for k in range(len(LINES))] == brute_lines(LINES, least)
        assert [rows[k]["__n_lines"] for k in range(len(LINES))] == [len((t or "").split("\n")) for t in LINES]
        assert rows[0]["source"] == "src1"


def test_deleting_documents_brings_their_lines_back(spark):
    first, more = documents(spark, LINES[:8]), documents(spark, LINES[8:], 8)
    both = LineIndex.build(first, min_docs=9).add(more)
    whole = LineIndex.build(first.unionByName(more), min_docs=9)
    assert sorted(both.counts.collect()) == sorted(whole.counts.collect()) and both.frequent().count() == 2
    back = both.remove(more)
    assert sorted(back.counts.collect()) == sorted(LineIndex.build(first, min_docs=9).counts.collect())
    assert [r["text"] for r in drop_lines(first, back).orderBy("doc_id").collect()] == LINES[:8]
    with pytest.raises(ValueError):
        back.remove(more)


def test_only_flagged_keys_are_shuffled(spark):
    """Whether filters fit one broadcast or not, of 4,000 lines those of the frequent key (and what a filter knows wrongly) meet the exact table."""
    df = documents(spark, [f"notice\n{prose(k, 8)}\n{prose(9000 + k, 8)}" for k in range(2000)])
    index = LineIndex.build(df, min_docs=10, shards=8)
    assert index.frequent().count() == 1
    for size in (1 << 20, 0):
        out = drop_lines(df, index, broadcast_bytes=size)
        assert {r["text"].count("\n") for r in out.collect()} == {1}
    from corpusloom.llm import line_dedup

    keys = df.select("text").mapInArrow(lambda b: (x for x in b), "text string")
    probing = line_dedup._probing(line_dedup._sent(index, list(range(8))))
    passed = line_dedup.line_keys(keys).mapInArrow(probing, "h1 long, h2 long").count()
    assert 2000 <= passed <= 2010


def test_no_documents(spark):
    none = documents(spark, [])
    assert drop_lines(none, LineIndex.build(none)).count() == 0


def test_cuckoo_filter_finds_what_it_holds_and_forgets():
    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, (3000, 2))
    made = CuckooFilter.sized(3000)
    made.insert(keys[:, 0], keys[:, 1])
    assert made.contains(keys[:, 0], keys[:, 1]).all()
    others = np.random.default_rng(2).integers(-(1 << 62), 1 << 62, (20000, 2))
    assert made.contains(others[:, 0], others[:, 1]).mean() < 0.002
    assert np.count_nonzero(made.table) == 3000
    made.delete(keys[:1500, 0], keys[:1500, 1])
    assert made.contains(keys[1500:, 0], keys[1500:, 1]).all() and made.contains(keys[:1500, 0], keys[:1500, 1]).mean() < 0.01


# ---------------------------------------------------------------- near-duplicates
def brute_groups(texts, percent=85):
    sets = []
    for t in texts:
        words = key_words(t)
        sets.append({tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set())
    parent = list(range(len(texts)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [find(k) for k in range(len(texts))], [len(s) for s in sets]


def key_words(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if (text or "").strip() else []


def near_copies():
    r, out = random.Random(5), []
    for seed in range(12):
        words = prose(seed, r.choice([6, 40, 120, 300])).split()
        out.append(" ".join(words))
        for _ in range(r.randint(0, 6)):
            words = list(words)
            for _ in range(r.randint(0, 3)):
                words[r.randrange(len(words))] = "changed"
            out.append(" ".join(words))
    return [*out, None, "", "  ", "one two", "ONE two", "one two three", prose(99, 40000)]


def test_groups_equal_brute_force(spark):
    texts = near_copies()
    want, sizes = brute_groups(texts)
    rows = {r["doc_id"]: r for r in near_dups.near_duplicates(documents(spark, texts), percent=85).collect()}
    assert [rows[k]["component_id"] for k in range(len(texts))] == want
    assert [rows[k]["n_shingles"] for k in range(len(texts))] == sizes
    kept = near_dups.keep_one_of_each(documents(spark, texts), percent=85)
    assert {r["doc_id"] for r in kept.collect()} == set(want) and kept.columns == documents(spark, []).columns


def test_pairs_are_found_in_a_bucket_of_many_unlike_classes(spark):
    """One bucket of 60 classes below the threshold, of which one pair is linked."""
    words, texts = prose(1, 120).split(), []
    for k in range(60):
        own = list(words)
        for j in range(6):
            own[k % 7 + 18 * j] = f"own{k}x{j}"
        texts.append(" ".join(own))
    texts.append(texts[37] + " more")
    df = documents(spark, texts)
    classes = near_dups.sketch_documents(df).select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), F.array(F.lit(1).cast("long")).alias("bands"))
    found = near_dups.link(classes, df.select("doc_id", "text"), "text", 85, 5).collect()
    assert {(r["v"], r["c"]) for r in found} == {(37, 37), (60, 37)}


def variants(count, words, least, most, seed):
    """Texts around one template: each has ``least`` to ``most`` words of its own, half of them shared with others."""
    r, out = random.Random(seed), []
    for k in range(count):
        own = [f"w{j}" for j in range(words)]
        for j in r.sample(range(words), r.randint(least, most)):
            own[j] = f"x{r.randrange(4)}y{j}" if r.random() < 0.5 else f"n{k}z{j}"
        out.append(" ".join(own))
    return out


def all_pairs(texts, percent):
    """The component of each text by comparing all sets with each other, and how many links there are."""
    sets, sizes = near_dups.shingle_sets(pa.array(texts))
    _, at, times = np.unique(sets, return_inverse=True, return_counts=True)
    held = np.zeros((len(texts), len(times)), np.float32)
    held[np.repeat(np.arange(len(texts)), sizes), at] = 1
    both = held[:, times > 1] @ held[:, times > 1].T
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    np.fill_diagonal(linked, False)
    label = np.arange(len(texts))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(texts)).min(1))
        if (new == label).all():
            return label.tolist(), int(linked.sum()) // 2
        label = new


@pytest.mark.parametrize(("shape", "block"), [((324, 500, 5, 14, 1), near_dups.BLOCK_WEIGHT), ((2000, 200, 2, 6, 2), near_dups.BLOCK_WEIGHT), ((700, 200, 2, 6, 4), 1 << 13)])
def test_no_link_is_lost_in_a_group_around_the_threshold(spark, monkeypatch, shape, block):
    """Most pairs are just below 85 %, few above; small blocks make every bucket meet in many tasks."""
    monkeypatch.setattr(near_dups.link, "__defaults__", (block,))
    texts = variants(*shape)
    want, links = all_pairs(texts, 85)
    assert links and len(set(want)) > len(texts) // 2
    rows = {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(documents(spark, texts), percent=85).collect()}
    assert [rows[k] for k in range(len(texts))] == want


def test_a_block_keeps_what_its_links_connect():
    texts = variants(150, 60, 0, 3, 9)
    sets, sizes = near_dups.shingle_sets(pa.array(texts))
    want, _ = all_pairs(texts, 80)
    a, b = near_dups.linked_in_block(np.arange(150), np.arange(150), sets.view(np.int64), sizes, 80)
    root = list(range(150))
    for _ in root:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            root[x] = root[y] = min(root[x], root[y])
    assert root == want and len(a) < 150


def test_rows_without_ids_and_repeated_rows(spark):
    text = prose(1, 60)
    df = spark.createDataFrame([(None, text), (4, text), (4, text), (7, text), (8, prose(2, 50)), (8, prose(3, 50))], "doc_id long, text string")
    rows = [(r["doc_id"], r["component_id"], r["kept"]) for r in near_dups.near_duplicates(df).collect()]
    assert rows.count((4, 4, True)) == 2 and (7, 4, False) in rows and rows.count((8, 8, True)) == 2
    kept = Counter(r["doc_id"] for r in near_dups.keep_one_of_each(df).collect())
    assert kept == {None: 1, 4: 1, 8: 2}
    assert near_dups.near_duplicates(df.limit(0)).count() == 0


def test_densified_sketches_agree_as_often_as_sets_do():
    words = [f"w{k}" for k in range(400)]
    other = [w if k % 40 else "changed" for k, w in enumerate(words)]
    sets, sizes = near_dups.shingle_sets(pa.array([" ".join(words), " ".join(other)]))
    a, b = set(sets[: sizes[0]].tolist()), set(sets[sizes[0] :].tolist())
    one, two = near_dups.sketches(sets, sizes, 2048)
    assert abs((one == two).mean() - len(a & b) / len(a | b)) < 0.06
    few, n = near_dups.shingle_sets(pa.array(["a b c"]))
    assert n.tolist() == [1] and (near_dups.sketches(few, n) == near_dups.sketches(few, n)[0, 0]).all()


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    assert {r["v"]: r["c"] for r in near_dups.components(edges).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


# ---------------------------------------------------------------- decontamination
def brute_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b, 1):
            before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def test_common_subsequence():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randrange(5) for _ in range(r.randrange(1, 30))] for _ in range(2))
        assert decontaminate.common_subsequence(a, b) == brute_subsequence(a, b)


def test_planted_items_are_found_and_prose_is_left(spark):
    r = random.Random(7)
    items = [prose(1000 + k, r.randint(12, 60)) + ". " + prose(2000 + k, 5) + "." for k in range(30)]
    docs, want = [], set()
    for k in range(60):
        words = prose(k, r.choice([0, 30, 400])).split()
        if k % 3 == 0:
            own = items[k // 2].split()
            if k % 2:
                own = [w for j, w in enumerate(own) if j % 9 != 4]  # a word in nine is missing
            at = r.randint(0, len(words))
            words[at:at] = own
            want.add((k, k // 2))
        docs.append(" ".join(words).upper() if k % 4 == 0 else " ".join(words))
    df = documents(spark, [*docs, None, ""])
    bench = spark.createDataFrame([*enumerate(items), (98, None), (None, items[0]), (99, "too short")], "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(df, bench).collect()} == want
    assert {x["doc_id"] for x in decontaminate.without_leaks(df, bench).collect()} == set(range(62)) - {k for k, _ in want}
    assert decontaminate.find_leaks(df.limit(0), bench).count() == 0 and decontaminate.find_leaks(df, bench.limit(0)).count() == 0


@pytest.mark.parametrize("every", [9, 6, 4])
def test_recall_of_the_search_on_paraphrases(spark, every):
    """Of the items that a plain subsequence over the whole text confirms, at least nine in ten are found: a word in ``every`` is another one, and others are swapped."""
    r = random.Random(every)
    vocabulary = [prose(5000 + k, 1) for k in range(3000)]
    speak = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items, docs, want = [], [], set()
    for k in range(80):
        own = [*speak(r.randint(14, 50)), *speak(6)]
        items.append(" ".join(own[:-6]) + ". " + " ".join(own[-6:]) + ".")
        said = [r.choice(vocabulary) if j % every == 1 else w for j, w in enumerate(own)]
        at = r.randrange(len(said) - 1)
        said[at : at + 2] = said[at + 1], said[at]
        share, answer = brute_subsequence(own, said) / len(own), 0.0
        tail = own[-decontaminate.answer_words(items[-1], len(own)) :]
        answer = brute_subsequence(tail, said) / len(tail)
        if share >= decontaminate.WHOLE or share >= decontaminate.PART and answer >= decontaminate.ANSWER:
            want.add((k, k))
        docs.append(" ".join([*speak(r.randint(0, 300)), *said, *speak(r.randint(0, 300))]))
    docs += [" ".join(speak(400)) for _ in range(40)]
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    found = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(documents(spark, docs), bench).collect()}
    assert len(want) > 20 and len(found & want) >= 0.9 * len(want) and len(found - want) <= 0.05 * len(want)


def test_alike_documents_still_leak(spark):
    item = prose(3, 30)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for copies in (1, 1000):
        assert decontaminate.find_leaks(documents(spark, [item] * copies), bench).count() == copies


def test_cosines_in_small_blocks_give_the_same(spark, monkeypatch):
    items = [prose(10 + k, 20) for k in range(20)]
    df = documents(spark, [prose(900 + k, 50) + " " + items[k] + " " + prose(950 + k, 90) for k in range(20)])
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    found = lambda: sorted(tuple(x)[:2] + tuple(x)[3:] for x in decontaminate.find_leaks(df, bench).collect())  # noqa: E731  cosines are rounded
    whole = found()
    monkeypatch.setattr(decontaminate, "COSINES", 7)
    assert len(whole) == 20 and found() == whole


def test_leaks_of_the_tables_equal_brute_force(spark):
    import re

    plain = lambda t: " " + " ".join(re.sub(r"[!-/:-@\[-`{-~]+", " ", (t or "").lower()).split()) + " "
    docs = {r["doc_id"]: plain(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r["item_id"]: plain(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    whole = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    found = {(r["doc_id"], r["item_id"]) for r in QUERIES["op4_decontaminate"](spark, SF).collect()}
    assert whole <= found and len(found - whole) <= max(1, len(whole) // 10)


# ---------------------------------------------------------------- classifiers
def held_out_scores(spark, name, label, mod, rest):
    sf = str(Path(SF).parent / "sf0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = QUERIES[name](spark, sf).join(labels, "doc_id").filter("held_out").select("score", "predicted", label, (F.crc32(F.col("doc_id").cast("string")) % mod).alias("r")).collect()
    assert rows and all(0 <= r["score"] <= 1 and r["r"] == rest and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    pos = [r["score"] for r in rows if r[label] == 1]
    neg = [r["score"] for r in rows if r[label] == 0]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]), rows


def test_quality_ranks_held_out_rows(spark):
    auc, rows = held_out_scores(spark, "op5_quality_model", "quality", 4, 2)
    assert auc > 0.97 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


def test_toxicity_ranks_held_out_rows(spark):
    auc, rows = held_out_scores(spark, "op6_toxicity", "toxic", 3, 1)
    assert auc > 0.85 and np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.94


@pytest.mark.parametrize("module", [quality_model, toxicity])
def test_classifiers_without_labels_or_texts(spark, module):
    df = documents(spark, ["some words", None, "", prose(3, 30000)])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scores = [r["score"] for r in module.score(df, module.train(df, labels, F.lit(True))).collect()]
    assert scores == ([0.5] * 4 if module is quality_model else [0.0] * 4)
    odd = spark.createDataFrame([(0, 1, 1), (0, 0, 0), (1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert len(module.score(df, module.train(df, odd, F.lit(True))).collect()) == 4
    assert module.score(df.limit(0), module.train(df, odd, F.lit(True))).count() == 0


def test_block_max_search_is_exact():
    r = np.random.default_rng(3)
    terms = toxicity.Terms(np.arange(1, 41))
    idf = r.uniform(1, 6, 40)
    out = toxicity.Index.build(terms, idf, [], [], [], 0.3)
    vectors = []
    for _ in range(1500):
        own = np.sort(r.choice(40, r.integers(1, 6), replace=False))
        vectors.append(out.vector(own, r.integers(1, 9, len(own)).astype(float), int(r.integers(20, 900))))
    index = toxicity.Index.build(terms, idf, vectors, r.integers(0, 2, 1500).tolist(), list(range(1500)), 0.3)
    dense = np.zeros((1500, 41))
    for k, (t, w) in enumerate(vectors):
        dense[k, t] = w
    for t, w in vectors[::25]:
        q = np.zeros(41)
        q[t] = w
        truth = dense @ q
        best, cosines = index.nearest(t, w, 16)
        assert np.allclose(np.sort(truth)[::-1][:16], cosines) and np.allclose(truth[best], cosines)


def test_texts_are_searched_together_and_exactly(monkeypatch):
    """Many texts at once get what plain sums give, in order, by a product for each ``TOGETHER`` of them and not for each text."""
    r = np.random.default_rng(4)
    terms = toxicity.Terms(np.arange(1, 301), np.arange(1, 21))
    empty = toxicity.Index.build(terms, r.uniform(1, 6, 300), [], [], [], 0.3)
    # terms of one half of the texts are dense, some of the others are in few examples
    held = [np.sort(r.choice(20 if k % 2 else 300, r.integers(1, 15), replace=False)) for k in range(2000)]
    times, words, unknown = [r.integers(1, 9, len(x)).astype(float) for x in held], r.integers(20, 900, 2000), r.integers(0, 3, 2000).astype(float)
    sizes = np.array([len(x) for x in held])
    term, weight, starts = empty.vectors(np.concatenate(held), np.concatenate(times), sizes, words, unknown)
    vectors = [(term[a:b], weight[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    for k in range(0, 2000, 97):
        alone = empty.vector(held[k], times[k], int(words[k]), unknown[k])
        assert np.array_equal(alone[0], vectors[k][0]) and np.allclose(alone[1], vectors[k][1])
    index = toxicity.Index.build(terms, empty.idf, vectors, r.integers(0, 2, 2000).tolist(), list(range(2000)), 0.3)
    every = np.zeros((2000, 301))
    for k, (t, w) in enumerate(vectors):
        every[k, t] = w
    made, plain = [], toxicity.Index.common_scores
    monkeypatch.setattr(toxicity.Index, "common_scores", lambda *a: made.append(1) or plain(*a))
    monkeypatch.setattr(toxicity, "ADDED", 500)
    found = index.all_nearest(term[: starts[300]], weight[: starts[300]], starts[:301], 16)
    assert len(found) == 300 and len(made) == -(-300 // toxicity.TOGETHER)
    for k, (best, cosines) in enumerate(found):
        truth = every @ every[k]
        assert np.allclose(np.sort(truth)[::-1][:16], cosines, atol=1e-5) and np.allclose(truth[best], cosines, atol=1e-5)
    assert index.all_nearest(term[:0], weight[:0], starts[:1], 16) == []


def test_copies_of_labelled_examples_are_found(spark):
    texts = [prose(500 + k, 20 + 30 * (k % 9)) for k in range(60)]
    df = documents(spark, [*texts, *texts, "x" + prose(1, 30), None])
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(60)], "doc_id long, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.score(df, toxicity.train(df, labels, F.lit(True))).collect()}
    for k in range(60):
        for own in (k, 60 + k):
            found = rows[own]["evidence"][0]
            assert (found["id"], found["label"]) == (k, int(k % 5 == 0)) and abs(found["cosine"] - 1) < 1e-5
            assert (rows[own]["score"] >= 0.7) == (k % 5 == 0)
    assert not rows[121]["evidence"]


def test_toxic_examples_of_the_tables_find_themselves(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    toxic = toxicity.score(docs, toxicity.train(docs, labels, F.lit(True))).join(labels.filter("toxic = 1"), "doc_id").filter("text <> ''").collect()
    assert toxic and all(abs(r["evidence"][0]["cosine"] - 1) < 1e-5 for r in toxic)


_MASK = (1 << 64) - 1


def mixed(h):
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    h = (h ^ h >> 27) * 0x94D049BB133111EB & _MASK
    return h ^ h >> 31


def word_hash(word):
    h = mixed(len(word) + 0x9E3779B97F4A7C15 & _MASK)
    for at in range(0, len(word), 8):
        h = mixed((h ^ int.from_bytes(word[at : at + 8], "little")) * 0x9E3779B97F4A7C15 + at + 1 & _MASK)
    return h


def quality_features(text):
    """Place to value, family by family, word by word."""
    import math
    import re

    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode()) if w]
    h, shapes = [word_hash(w.lower()) for w in words], []
    for k, w in enumerate(words):
        lower, upper = sum(97 <= c < 123 for c in w), sum(65 <= c < 91 for c in w)
        symbols, digits = sum(33 <= c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 127 for c in w), sum(48 <= c < 58 for c in w)
        case = (1 if upper else 0) if lower else (2 if upper > 1 else 3)
        shapes.append(case + 4 * min(symbols, 4) + 32 * min(len(w) // 4, 5) + 256 * (k > 0 and h[k] == h[k - 1]) + 512 * (digits > 0))
    families = [
        [mixed(x + 1 & _MASK) for x in h], [mixed(mixed(a) + b + 2 & _MASK) for a, b in zip(h, h[1:], strict=False)],
        [mixed(x + (3 << 32)) for x in shapes], [mixed(mixed(a + (4 << 32)) + b & _MASK) for a, b in zip(shapes, shapes[1:], strict=False)],
        [mixed(int(math.log2(1 + len(words))) + (5 << 32))], [mixed(6)],
    ]
    out = Counter()
    for own in families:
        for place, times in Counter(x >> 64 - quality_model.BITS for x in own).items():
            out[place] += math.sqrt(times / len(own))
    return out


def test_quality_scores_equal_a_dictionary_version(spark):
    import math

    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    weights = quality_model.train(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    scores = {r["doc_id"]: r["score"] for r in QUERIES["op5_quality_model"](spark, SF).collect()}
    for r in docs.collect():
        margin = sum(weights[k] * v for k, v in quality_features(r["text"]).items())
        assert abs(scores[r["doc_id"]] - 1 / (1 + math.exp(-margin))) < 1e-4


def test_ftrl_equals_a_dictionary_version():
    import math

    r, state, z, n = random.Random(2), quality_model.Ftrl.empty(), Counter(), Counter()

    def weight(k):
        if abs(z[k]) <= state.l1:
            return 0.0
        return -(z[k] - math.copysign(state.l1, z[k])) / ((state.beta + math.sqrt(n[k])) / state.alpha + state.l2)

    for _ in range(200):
        own, y = {k: r.random() for k in r.sample(range(30), 5)}, r.randint(0, 1)
        state.learn(np.array(list(own)), np.array(list(own.values())), y)
        w = {k: weight(k) for k in own}
        p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in own.items())))
        for k, v in own.items():
            g = (p - y) * v
            z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / state.alpha * w[k]
            n[k] += g * g
    assert np.allclose(state.weights(np.arange(30)), [weight(k) for k in range(30)])


def test_ftrl_learns_a_separable_problem():
    state = quality_model.Ftrl.empty()
    for _ in range(30):
        state.learn(np.array([1, 2]), np.array([1.0, 0.5]), 1)
        state.learn(np.array([1, 3]), np.array([1.0, 0.5]), 0)
    w = state.weights()
    assert w[2] > 0.3 > -0.3 > w[3] and np.count_nonzero(w) <= 3


def test_scores_are_calibrated_by_bins(spark):
    """Of held-out rows in a bin of scores the share of toxic ones lies near the mean score."""
    _, rows = held_out_scores(spark, "op6_toxicity", "toxic", 3, 1)
    for lo, hi in ((0, 0.3), (0.3, 0.7), (0.7, 1.01)):
        own = [r for r in rows if lo <= r["score"] < hi]
        error = abs(np.mean([r["score"] for r in own]) - np.mean([r["toxic"] for r in own])) if own else 0
        assert error < 0.1 + 1 / (1 + len(own))


def test_neighbours_of_the_tables_equal_brute_force(spark):
    """The query's neighbours on the smallest tables, ties included, against every cosine of the same vectors."""
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    index = toxicity.train(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    dense = np.zeros((len(index.labels), len(index.terms) + 1))
    for t in range(len(index.terms)):
        a, b = index.starts[t], index.starts[t + 1]
        dense[index.examples[a:b], t] = index.weights[a:b]
    rows = {r["doc_id"]: r["neighbours"] for r in QUERIES["op6_toxicity"](spark, SF).collect()}
    few = 0
    for row in docs.collect():
        owner, term, times, words, unknown = index.terms.in_texts(pa.array([row["text"]], pa.string()))
        few += not rows[row["doc_id"]] and words[0] > 0
        if len(term):
            t, w = index.vector(term, times.astype(float), int(words[0]), unknown[0])
            cosines = dense[:, t] @ w
            got = [index.ids.index(x) for x in rows[row["doc_id"]]]
            assert np.allclose(np.sort(cosines)[::-1][: len(got)], cosines[got], atol=1e-5) and len(got) == min(16, (cosines > 0).sum())
    assert few <= 0.01 * len(rows)


def test_cost_and_not_rejections_decides_the_order(spark):
    """A rule that rejects a little more at many times the cost comes later."""
    df = documents(spark, [prose(k, 300) for k in range(60)])
    metrics = quality_rules.base_metrics(df, keep=("doc_id",))
    w = F.col("__words")
    dear = F.size(F.array_distinct(F.transform(F.sort_array(F.transform(w, lambda x: F.sha2(x, 512))), lambda x: F.md5(x)))) >= 0
    rules = [quality_rules.Rule("dear", dear), quality_rules.Rule("cheap", F.col("doc_id") % 10 != 0)]
    estimates = {e.name: e for e in quality_rules.estimate(metrics, rules)}
    assert estimates["dear"].rejected == 60 and estimates["cheap"].rejected == 54 and estimates["dear"].cost_s > 5 * estimates["cheap"].cost_s
    assert [r.name for r in quality_rules.order(rules, list(estimates.values()))] == ["cheap", "dear"]


CLASHING = ("__n_lines", "__n_dropped", "__row", "__keys", "__id", "__kept", "kept_id", "leak", "row", "keys", "gone", "key", "place", "__score", "__evidence", "score_", "c", "v", "set")


def test_stages_keep_columns_of_any_name(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    texts = [prose(k % 9, 60) + "\nnotice" for k in range(12)] + [None, ""]
    rows = [(k, t, "en", "s", len(t or ""), *(f"{c}{k}" for c in CLASHING)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns, name
        for r in out.collect():
            assert all(r[c] == f"{c}{r['doc_id']}" for c in CLASHING), name


# ---------------------------------------------------------------- pipeline
def test_a_group_of_copies_keeps_its_text(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    copy = prose(1, 30) + "\n" + prose(2, 30)
    df = documents(spark, [copy] * 12 + ["notice\n" + prose(20 + k, 30) for k in range(10)])
    lines = corpus_pipeline.line_dedup(spark, df, SF)
    assert not lines.filter("text LIKE '%notice%'").count()
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.near_dedup(spark, lines, SF).collect()}
    assert kept[0] == copy and set(kept) == {0, *range(12, 22)}


def test_a_long_passage_stays_in_one_document(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    passage, short = prose(5, 51), prose(6, 50)
    texts = [f"{prose(30 + k, 300)}\n{passage if k else '  ' + passage.upper()}\n{short}" for k in range(3)] + [f"{prose(40, 90)}\n{prose(40, 90)}", None, ""]
    rows = {r["doc_id"]: r for r in corpus_pipeline.near_dedup(spark, documents(spark, texts), SF).collect()}
    assert [rows[k]["text"] for k in range(6)] == [texts[0], *(f"{prose(30 + k, 300)}\n{short}" for k in (1, 2)), *texts[3:]]
    assert all(rows[k]["n_chars"] == len(rows[k]["text"] or "") for k in range(6))


def test_near_dedup_stage_equals_brute_force_at_80(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    texts, sets = [], []
    for k in range(8):
        words = prose(700 + k, 200).split()
        for n in (0, 3, 4, 5, 7):  # words changed far apart: each changes 5 shingles
            texts.append(" ".join("changed" if n and j % (200 // n) == 20 else w for j, w in enumerate(words)))
    for t in texts:
        w = t.split()
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)})
    root = list(range(len(texts)))
    pairs = [(a, b) for b in range(len(texts)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert any(100 * len(sets[a] & sets[b]) < 85 * len(sets[a] | sets[b]) for a, b in pairs)
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, documents(spark, texts), SF).collect()} == set(root)


def test_pipeline_stages_keep_their_contract(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    seen, texts = {}, {r["doc_id"]: r["text"] for r in docs.collect()}
    before = set(texts)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "sentencepiece":
            assert out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"] for r in docs.collect()}
        assert seen[name] <= before and docs.count() == len(seen[name])
        before = seen[name]
    lines = spark.read.parquet(str(tmp_path / "line_dedup"))
    own = sorted(seen["toxicity"])
    assert [r["text"] for r in lines.orderBy("doc_id").collect()] == brute_lines([texts[k] for k in own], 10, once=True)
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    kept = [r["text"] for r in lines.orderBy("doc_id").collect()]
    groups, _ = brute_groups(kept, 80)
    assert seen["near_dedup"] == {own[k] for k in groups}
    assert seen["sentencepiece"] == seen["decontamination"] and docs.filter("NOT round_trip").count() == 0
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == seen["sentencepiece"]


# ---------------------------------------------------------------- work and memory of decontamination and toxicity
def test_sums_over_runs_of_known_words_equal_plain_ones():
    rng = np.random.default_rng(5)
    lines = rng.standard_normal((30, 6))
    for sizes in ([], [1], [3, 1, 1, 7, 2], rng.integers(1, 9, 10_000).tolist()):
        term = rng.integers(0, 30, sum(sizes))
        heads = np.cumsum([0, *sizes])[:-1]
        wanted = [lines[term[a : a + n]].sum(axis=0) for a, n in zip(heads, sizes, strict=True)]
        assert np.allclose(decontaminate._sums_of(lines, term, heads), np.array(wanted).reshape(-1, 6))


def test_words_without_symbols_need_no_expression(monkeypatch):
    monkeypatch.setattr(decontaminate.pc, "replace_substring_regex", None)
    found, bounds = decontaminate._words(pa.array(["It's [a] TEST_case... été", None, "it s a test case été"]))
    assert bounds.tolist() == [0, 6, 6, 12] and found[:6].tolist() == found[6:].tolist()


def test_no_stage_of_toxicity_has_two_python_steps(spark, monkeypatch):
    kind = type(spark.range(1))
    plain, steps = kind.mapInArrow, []

    def watched(self, *args, **options):
        steps.append("MapInArrow" in self._jdf.queryExecution().optimizedPlan().toString())
        return plain(self, *args, **options)

    monkeypatch.setattr(kind, "mapInArrow", watched)
    rows = [(k, f"word{k % 7} other{k % 5} text{k % 3}", k % 2) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    score = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), F.lit(True)))
    assert score.count() == 60 and len(steps) >= 6 and not any(steps)


def test_batches_are_bounded_unless_the_session_bounds_them(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.getAll.get(name)
    spark.conf.unset(name)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    try:
        common.small_batches(spark)
        sizes = [r.n for r in spark.range(0, 5_000, 1, 1).select(F.repeat(F.lit("text "), 1_000).alias("t")).mapInArrow(run, "n long").collect()]
        assert sum(sizes) > 5 * common.BATCH_BYTES and max(sizes) < 2 * common.BATCH_BYTES
        spark.conf.set(name, 1 << 20)
        common.small_batches(spark)
        assert spark.conf.get(name) == str(1 << 20)
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def _peak(made) -> int:
    """Bytes that arrays took at most while ``made`` ran, beyond those before."""
    tracemalloc.start()
    try:
        made()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def _dense_index(terms: int, examples: int) -> toxicity.Index:
    r = np.random.default_rng(8)
    own = [np.flatnonzero(r.random(terms) < 0.2) for _ in range(examples)]
    vectors = [(t, np.full(len(t), len(t) ** -0.5 if len(t) else 1.0)) for t in own]
    return toxicity.Index.build(toxicity.Terms(np.arange(1, terms + 1), np.arange(1, 5)), np.ones(terms), vectors, r.integers(0, 2, examples).tolist(), list(range(examples)), 0.3)


def test_products_of_some_dense_terms_copy_few_of_their_rows():
    """Rows of half of all dense terms take 4.5 MB; a product gives the same without a copy of all of them."""
    index = _dense_index(250, 9000)
    assert index.dense[1].shape == (250, 9000)
    term, weight, starts = np.tile(np.arange(120), 4), np.random.default_rng(2).random(480), np.arange(5) * 120
    assert np.allclose(index.common_scores(term, weight, starts), weight.reshape(4, 120) @ index.dense[1][:120], atol=1e-4)
    assert _peak(lambda: index.common_scores(term, weight, starts)) < 2 << 20


def test_calibration_takes_few_rows_of_a_batch_at_once(monkeypatch):
    """One batch of 2,000 rows gives two votes for every row, and no more than 256 rows are searched together."""
    index = _dense_index(40, 2000)
    rows = [[int(t) + 1 for t in np.flatnonzero(np.random.default_rng(k).random(40) < 0.3)] for k in range(2000)]
    batch = pa.RecordBatch.from_pylist(
        [{"id": k, "y": k % 2, "words": 50, "terms": x, "times": [1] * len(x)} for k, x in enumerate(rows)],
        pa.schema([("id", pa.int64()), ("y", pa.int32()), ("words", pa.int64()), ("terms", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]))
    got, sizes, plain = [], [], toxicity.Index.all_nearest

    class Held:
        class sparkSession:
            class sparkContext:
                broadcast = staticmethod(lambda x: SimpleNamespace(value=x, destroy=lambda: None))

        def mapInArrow(self, run, _):
            got.extend(run(iter([batch])))
            return self

        def toArrow(self):
            return pa.Table.from_batches(got)

    monkeypatch.setattr(toxicity.Index, "all_nearest", lambda self, t, w, starts, k: sizes.append(len(starts) - 1) or plain(self, t, w, starts, k))
    line = toxicity._calibrated(index, Held())
    assert sum(sizes) == 2000 and max(sizes) <= 256
    assert sum(x.num_rows for x in got) == 4000 and all(map(np.isfinite, line))
    whole = plain(index, *index.vectors(np.concatenate(rows) - 1, np.ones(sum(map(len, rows))), np.array(list(map(len, rows))), np.full(2000, 50), np.zeros(2000)), 17)
    votes = np.concatenate([x.column("vote").to_numpy() for x in got])
    for k, (best, cosines) in enumerate(whole):
        for at, keep in ((2 * k, best != k), (2 * k + 1, best >= 0)):
            assert abs(votes[at] - index.vote(cosines[keep][:16], best[keep][:16], np.array([len(best[keep][:16])]))[0]) < 1e-4
