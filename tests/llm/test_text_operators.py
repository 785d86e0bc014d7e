"""Operators over single texts: chat, pieces, token counts, rules, WARC."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm.chat_format import CONTROL, MARK, conversation_digests, escape, format_turns, read_turns, unescape
from corpusloom.llm.piece_codec import Codec, StreamEncoder, decode_ids, encode_checked, encode_texts
from corpusloom.llm.quality_rules import apply_rules, default_rules, estimate, base_metrics, hashes_of, order, windows_of
from corpusloom.llm.token_counts import Counter, count_tokens
from corpusloom.llm import piece_codec, warc_bundles
from corpusloom.llm.warc_bundles import fetch_records, parse_record, read_record, read_bundles, read_frame, read_seek_table, record_index, write_bundles

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
HARD = [
    "", " ", "   ", "\n\n", "a", " a  b ", "aaaaaaaaaaaaaaaaaaaaaaaa", "x" * 9000, "Ünïcödé ▁ text", "日本語のテキスト", "🙂🙃 emoji", "\x00\x01\x7f", "tab\tand\r\nline",
    "don't we'll I'm", "1234567890 12 3", "!!!??? ...", "<|endoftext|> in a text <|endoftext|>", "<s></s><unk>", "word " * 3000, "  lead and trail  ", " nbsp　wide", "á",
]


def texts(spark, rows):
    return spark.createDataFrame([(k, t, "other") for k, t in enumerate(rows)], "doc_id long, text string, token_ids string")


# ---------------------------------------------------------------- pieces
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_equal_the_library():
    codec, reference = Codec(MODEL), library()
    ids, counts = codec.encode(HARD)
    at = 0
    for text, n in zip(HARD, counts, strict=True):
        assert ids[at : at + n].tolist() == reference.encode(text), text[:40]
        at += n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters="▁"), max_size=60), max_size=8))
def test_pieces_round_trip(rows):
    codec, reference = Codec(MODEL), library()
    ids, counts = codec.encode(rows)
    assert codec.decode(ids, counts) == rows
    assert ids.tolist() == [i for t in rows for i in reference.encode(t)]


def test_pieces_of_cuts_in_any_order():
    cuts = ["", "a", "a\0", "a\0b", "abc" * 9, "abc" * 9 + "d", "abcabcx", "x" * 9000, "x" * 30, "x" * 31, "日本", "日本語", "▁▁a", "a"]
    codec, reference = Codec(MODEL), library()
    for some in (cuts, cuts[::-1]):
        ids, starts, sizes = codec.encode_cuts(some)
        assert [ids[a : a + n].tolist() for a, n in zip(starts, sizes, strict=True)] == [reference.encode(c.replace("▁", " ")) or codec.pieces.spell(codec.pieces.numbers["▁"]) for c in some]


def test_runs_of_texts_give_the_ids_of_all(monkeypatch):
    runs = piece_codec._runs
    whole = Codec(MODEL).encode(HARD)
    monkeypatch.setattr(piece_codec, "_runs", lambda sizes: runs(sizes, 7))
    codec = Codec(MODEL)
    ids, counts = codec.encode(HARD)
    assert ids.tolist() == whole[0].tolist() and counts.tolist() == whole[1].tolist()
    assert codec.decode(ids, counts) == [t.replace("▁", " ") for t in HARD]


def test_a_single_character_asks_for_no_join(monkeypatch):
    asked = []
    codec = Codec(MODEL)
    monkeypatch.setattr(type(codec.pieces), "joins", lambda *x: asked.append(x) or True)
    codec.encode(["鿰鿱鿲 𐂀𐂁"])
    assert not asked


def test_a_stream_in_parts_gives_the_same_ids():
    codec = Codec(MODEL)
    text = "▁" + "".join(random.Random(3).choice("abcdeing") for _ in range(5000))
    parts = StreamEncoder(codec.pieces)
    out = [i for at in range(0, len(text), 37) for i in parts.feed(text[at : at + 37])] + parts.end()
    whole = StreamEncoder(codec.pieces)
    assert out == whole.feed(text) + whole.end()
    assert max(len(parts.text), len(parts.ends)) <= 5 * codec.pieces.longest + 37 + 1


def test_pieces_over_rows(spark):
    df = texts(spark, [*HARD, None])
    rows = decode_ids(encode_texts(df, MODEL), MODEL).collect()
    assert all(r["decoded"] == (r["text"] or "").replace("▁", " ") for r in rows)
    checked = {r["doc_id"]: r for r in encode_checked(df, MODEL).collect()}
    assert all(checked[r["doc_id"]]["token_ids"] == r["token_ids"] for r in rows)
    assert [r["text"] for r in checked.values() if not r["round_trip"]] == ["Ünïcödé ▁ text"]
    assert encode_checked(df.limit(0), MODEL).count() == 0


# ---------------------------------------------------------------- token counts
def bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def test_token_counts_equal_the_library():
    reference, counter = bpe(), Counter(BPE)
    assert counter.count(HARD).tolist() == [len(reference.encode(t, add_special_tokens=False).ids) for t in HARD]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",)), max_size=60), max_size=8))
def test_token_counts_of_any_text(rows):
    reference = bpe()
    assert Counter(BPE).count(rows).tolist() == [len(reference.encode(t, add_special_tokens=False).ids) for t in rows]


def test_token_counts_over_rows(spark):
    found = {r["doc_id"]: r for r in count_tokens(texts(spark, [*HARD, None]), BPE).collect()}
    assert found[len(HARD)]["n_tokens"] == 0 and found[len(HARD)]["n_bytes"] == 0
    assert found[18]["over_limit"] and not found[4]["over_limit"]
    assert found[8]["n_bytes"] == len(HARD[8].encode())
    assert count_tokens(texts(spark, []), BPE).count() == 0


# ---------------------------------------------------------------- chat
@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from([*"".join(CONTROL), MARK, "0", "1", "x"]), max_size=60))
def test_escaping_is_undone_and_leaves_no_control_string(text):
    hidden = escape(text)
    assert unescape(hidden) == text and not any(c in hidden for c in CONTROL)


def test_chat_reads_back_every_turn(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", f"{MARK}1 <s>[ROLE]"), (1, 2, None, None), (2, 5, "assistant", ""), (2, 5, "assistant", "b"), (2, 5, "assistant", "b"),
            (None, 0, "user", "lone"), (3, 0, "assistant", "é🙂" * 2000)]
    rows += [(9, k, "user" if k % 2 else "assistant", f"turn {k}") for k in range(300)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, token_ids string")
    blocks = format_turns(df, RANKS, public_tokenizers.PATTERN)
    got = sorted((r["conv_id"] or -9, r["role"], r["text"], r["learned"]) for r in read_turns(blocks, RANKS, public_tokenizers.PATTERN).collect())
    assert got == sorted((c if c is not None else -9, r or "", t or "", r == "assistant" and bool(t)) for c, _, r, t in rows)
    digests = {r["conv_id"]: r for r in conversation_digests(blocks, RANKS, public_tokenizers.PATTERN).collect()}
    assert digests[9]["n_turns"] == 300 and digests[9]["loss_chars"] == sum(len(t) for c, _, r, t in rows if c == 9 and r == "assistant")
    assert format_turns(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


# ---------------------------------------------------------------- rules
def brute_rules(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    twice = {g for g in grams if grams.count(g) > 1}
    covered = {k + i for k, g in enumerate(grams) if g in twice for i in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rules_equal_a_plain_count(spark):
    rows = [None, "", " \n\t ", "a b c a b c", "x x x x x", "one\none\n two\n two", "#*$ %&| <>", "é ü ñ 日本", "a b c", "the cat sat " * 40, " ".join(f"w{k}" for k in range(80)), "go!! now!! " * 60]
    df = texts(spark, rows)
    found = {r["doc_id"]: r for r in apply_rules(df).collect()}
    for k, text in enumerate(rows):
        r = found[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_rules(text), text
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert found[10]["kept"] and found[11]["rejected_by"] is not None
    assert apply_rules(texts(spark, [])).count() == 0


def test_the_verdict_is_that_of_any_order(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rules = default_rules()
    one = {r["doc_id"]: r["kept"] for r in apply_rules(df, rules).collect()}
    two = {r["doc_id"]: r["kept"] for r in apply_rules(df, rules[::-1], sample_rows=5).collect()}
    assert one == two
    ranked = order(rules, estimate(base_metrics(df), rules))
    assert sorted(r.name for r in ranked) == sorted(r.name for r in rules)


def test_texts_without_a_repeated_window_sort_nothing(spark):
    own = ["a b c d e f", "a b c x a b c", "a b", "a a a a", ""]
    words = spark.createDataFrame([(t.split(),) for t in own], "w array<string>").withColumn("h", hashes_of(F.col("w")))
    rows = words.select(F.size("h").alias("all"), F.size(windows_of(F.col("h"))).alias("sorted")).collect()
    assert [tuple(r) for r in rows] == [(4, 0), (5, 5), (0, 0), (2, 2), (0, 0)]


def test_rules_run_no_python(spark):
    plan = apply_rules(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# ---------------------------------------------------------------- WARC
def test_bundles_are_seekable_and_whole(spark):
    rows = [(k, f"http://x/{k}", "page " * (k % 5) + "é" * (k % 3)) for k in range(200)] + [(200, None, None), (201, "u", "z" * 3_000_000), (None, "u", "lost"), (7, "again", "other")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, frame int")
    bundles = write_bundles(df, frame_bytes=2000, bundle_bytes=4000)
    held = bundles.collect()
    assert len(held) > 1 and all(len(read_seek_table(b["bundle"])) >= 1 for b in held)
    place = record_index(bundles).filter("record_id = 201").first()
    data = next(b["bundle"] for b in held if b["bundle_id"] == place["bundle_id"])
    frame = read_frame(data, read_seek_table(data)[place["frame"]])
    assert parse_record(frame[place["frame_offset"] : place["frame_offset"] + place["length"]])["payload"] == b"z" * 3_000_000
    found = read_bundles(bundles).collect()
    assert len(found) == len(rows) - 1
    by_payload = {}
    for i, _, h in rows:
        if i is not None:
            by_payload.setdefault(h or "", []).append(i)
    for r in found:
        own = [h or "" for i, _, h in rows if i == r["record_id"] and len((h or "").encode()) == r["payload_bytes"]][0]
        holder = max(by_payload[own])
        assert r["record_type"] == ("response" if holder == r["record_id"] else "revisit")
        assert r["refers_to"] == (None if holder == r["record_id"] else holder)
        assert r["payload"] is None if r["refers_to"] is not None else bytes(r["payload"]).decode() == own
    assert write_bundles(df.limit(0)).count() == 0


def test_any_zstandard_reader_can_read_a_bundle(spark):
    import io

    import zstandard

    df = spark.createDataFrame([(k, "u", f"page {k}") for k in range(50)], "page_id long, url string, html string")
    data = bytes(write_bundles(df.coalesce(1), frame_bytes=500).first()["bundle"])
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\n") == 50
    assert isinstance(pa.py_buffer(data), pa.Buffer)


@pytest.mark.parametrize("bad", [b"", b"HTTP/1.1 200\r\n\r\n"])
def test_what_is_no_record_is_refused(bad):
    with pytest.raises((ValueError, KeyError)):
        parse_record(bad)


def test_one_record_costs_one_frame(spark, monkeypatch):
    pages = spark.createDataFrame([(k, f"u{k}", f"page {k} " * 50) for k in range(40)] + [(99, "u", "page 3 " * 50)], "page_id long, url string, html string")
    bundles = write_bundles(pages, frame_bytes=1000, bundle_bytes=4000)
    rows = {r["record_id"]: r for r in fetch_records(bundles, [7, 3, 1234]).collect()}
    assert set(rows) == {7, 3} and bytes(rows[7]["payload"]) == b"page 7 " * 50 and rows[3]["record_type"] == "revisit"
    monkeypatch.setattr(warc_bundles, "BROADCAST_HOLDERS", 0)
    assert {r["record_id"]: r["refers_to"] for r in read_bundles(write_bundles(pages)).collect()} == {**dict.fromkeys(range(40)), 3: 99, 99: None}
    row = next(r for r in bundles.collect() if len(read_seek_table(r["bundle"])) > 1)
    opened = []
    monkeypatch.setattr(warc_bundles, "read_frame", lambda data, frame: opened.append(frame) or read_frame(data, frame))
    assert read_record(bytes(row["bundle"]), row["entries"][-1].asDict())["record_id"] == row["entries"][-1]["record_id"] and len(opened) == 1


def test_small_blocks_of_chats_read_back(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", f"turn {k} <s> " * (k % 5)) for k in range(50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = conversation_digests(format_turns(df, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    for turns, chars in ((3, 1 << 20), (64, 20)):
        blocks = format_turns(df, RANKS, public_tokenizers.PATTERN, block_turns=turns, block_chars=chars)
        assert blocks.count() > 10 and conversation_digests(blocks, RANKS, public_tokenizers.PATTERN).collect() == whole


def test_a_slice_ends_between_blocks(spark):
    # more characters and ids than a task works on at once, in long and short conversations
    rows = [(c, k, ("user", "assistant")[k % 2], f"{c} {k} " * (6000 if c % 3 else 2)) for c in range(40) for k in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    blocks = format_turns(df, RANKS, public_tokenizers.PATTERN)
    found = {r["conv_id"]: r for r in conversation_digests(blocks.coalesce(1), RANKS, public_tokenizers.PATTERN).collect()}
    assert len({r["block"] for r in blocks.select("block").collect()}) == blocks.count() == 40
    for c in range(40):
        own = [(role, text) for n, _, role, text in rows if n == c]
        learned = "".join(text for role, text in own if role == "assistant")
        assert found[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert (found[c]["n_turns"], found[c]["loss_chars"], found[c]["loss_sha256"]) == (3, len(learned), hashlib.sha256(learned.encode()).hexdigest())
    back = read_turns(blocks, RANKS, public_tokenizers.PATTERN)
    assert sorted((r["conv_id"], r["place"], r["role"], r["text"]) for r in back.collect()) == sorted(rows)


def test_long_pre_tokens_merge_like_the_library():
    import tokenizers

    r = random.Random(4)
    rows = ["".join(r.choice("abcdefghijé日") for _ in range(n)) for n in (1023, 1025, 30000)] + ["a" * 5001, "ab" * 4000, "=" * 3000 + "the" * 3000]
    library_ = tokenizers.Tokenizer.from_file(BPE)
    assert Counter(BPE).count(rows).tolist() == [len(library_.encode(t, add_special_tokens=False).ids) for t in rows]
