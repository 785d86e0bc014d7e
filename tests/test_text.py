import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import languages, packing, paths, text
from corpusloom.operators import chunking


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(column(F.col("x"))).collect()]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",), blacklist_characters="\x00İς"), max_size=30), min_size=1, max_size=40))
def test_words_and_strip_are_those_of_python(spark, texts):
    plain = [t for t in texts if all(c.isascii() or c.isalpha() and unicodedata.ucd_3_2_0.category(c) != "Cn" for c in t)] or ["a_b 1"]
    assert one(spark, text.strip, *texts) == [t.strip() for t in texts]
    assert one(spark, text.words, *plain) == [re.findall(r"\w+", t.lower()) for t in plain]


def test_white_space_set():
    assert set(text.WHITE) == {chr(c) for c in range(0x3001) if chr(c).isspace()}


def brute_pack(parts, room, overlap, joint):
    out, now = [], ""
    for p in parts:
        if now and len(now) + len(p) + joint > room:
            out.append(now)
            now = now[-overlap:] + "\n\n" + p if overlap else p
        elif overlap:
            now = (now + "\n\n" + p).lstrip() if now else p
        else:
            now = (now + "\n\n" + p).lstrip()
    return out + ([now] if now.strip() else [])


@pytest.mark.parametrize(("overlap", "counts"), [(0, False), (7, True)])
def test_packing(spark, overlap, counts):
    texts = ["", "a", "aa\n\nbb\n\n\ncc", "x" * 50 + "\n\ny", "\n\n" + "ab cd\n\n" * 9, "  a\n\n\n\nb" * 5]
    found = one(spark, lambda c: F.transform(packing.packs(F.array(c), 20, overlap=overlap, joint_counts=counts)[0], lambda p: p["text"]), *texts)
    assert found == [brute_pack(re.split(r"\n{2,}", t), 20, overlap, 2 if counts else 0) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab \n\t\u3000"), max_size=120), st.integers(1, 25), st.integers(0, 9), st.booleans())
def test_packs_jump_like_steps(content, room, overlap, counts):
    extra = 2 if counts else 0
    found = packing.packed(content, room, overlap, extra)
    assert [x for x, _ in found] == brute_pack(re.split(r"\n{2,}", content), room, overlap, extra)
    lines = 0
    for x, before in found:
        assert before == lines
        lines += x.count("\n") + 2


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("#a \n\r\t"), max_size=60), min_size=1, max_size=40))
def test_sections_begin_at_headings(spark, contents):
    found = one(spark, chunking.sections, *contents)
    for content, own in zip(contents, found, strict=True):
        want, heads = [[]], [""]
        for line in content.split("\n"):
            # the line's end counts as Java's dot sees it
            m = re.match(r"(#{1,4})[ \t\n\x0b\f\r]+([^\n\r\u0085\u2028\u2029]+)", line)
            if m and (want != [[]] or heads != [""]):
                want.append([line])
                heads.append(m[2].strip())
            elif m:
                want, heads = [[line]], [m[2].strip()]
            else:
                want[-1].append(line)
        assert [(s["heading"], s["text"]) for s in own] == [(h, "\n".join(w)) for h, w in zip(heads, want, strict=True)]


def test_time_of_sections_and_packs_grows_with_size(spark):
    """40,000 lines, then twice as many: a fold that copies what it has would take four times as long."""
    import time

    files = lambda n: spark.createDataFrame([("a.md", "".join(f"# head {k}\ntext of {k}\n\n" if k % 3 == 0 else f"line {k}\n\n" for k in range(n)), "u", "md"), ("b.md", "\n\n".join(["a paragraph"] * n), "u", "md")], "path string, content string, raw_url string, file_type string")
    run = lambda n: chunking.markdown_chunks(files(n)).write.format("noop").mode("overwrite").save()
    run(100)
    began = time.perf_counter()
    run(80_000)
    assert time.perf_counter() - began < 10


@pytest.mark.parametrize(("path", "want"), [("a/./b/../c", "a/c"), ("../a", "../a"), ("a/../../b", "../b"), ("/x/y", "x/y"), ("a//b", "a/b")])
def test_normalised(spark, path, want):
    assert one(spark, paths.normalised, path) == [want]


def test_languages_and_types(spark):
    assert one(spark, languages.language, "a/b.TSX", "Jenkinsfile", "Rakefile", ".json", "x.adoc", "x.h", "x") == ["typescript", "groovy", "ruby", "generic", "generic", "c", "generic"]
    assert one(spark, paths.file_type, "README.MD", "Makefile", "tools/Makefile", ".github/Makefile") == ["md", "makefile", "tools/makefile", "github/makefile"]
    first = ["graph TD", "stateDiagram-v2", "classDiagram", "C4Context", "gitGraph:", "%% note", "journey"]
    assert one(spark, languages.diagram_type, *first) == ["Flowchart", "State Diagram", "Class Diagram", "C4 Diagram", "Git Graph", "Diagram", "Diagram"]


def test_sections(spark):
    content = "intro\n# A\ntext\n##### B\nmore\n## C"
    found = one(spark, chunking.sections, content)[0]
    assert [(r["heading"], r["text"]) for r in found] == [("", "intro"), ("A", "# A\ntext\n##### B\nmore"), ("C", "## C")]


def test_short_prose_is_one_chunk(spark):
    files = spark.createDataFrame([("a.md", "intro\n# A\ntext", "u", "md")], "path string, content string, raw_url string, file_type string")
    rows = chunking.markdown_chunks(files).collect()
    assert len(rows) == 1 and rows[0]["heading"] is None


def test_imports_summary(spark):
    rows = spark.createDataFrame([([f"m{k}" for k in range(13)],), ([],)], "i array<string>").select(chunking.imports_summary(F.col("i"))).collect()
    assert rows[0][0] == ", ".join(f"m{k}" for k in range(12)) + " (+1 more)" and rows[1][0] == ""
