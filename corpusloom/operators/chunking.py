"""Files to chunks: diagrams, prose by headings and paragraphs, and code by units.

``chunks`` is (chunk_id, text, path, raw_url, file_type, language, chunk_index, total_chunks, heading,
unit_name, unit_type, diagram_type, imports, signature). A row is one file until the last explode, so no step shuffles by content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.languages import diagram_type, language
from ..functions.packing import packs
from ..functions.text import blank_as_null, paragraphs, strip

SECTION_CHARS, OVERLAP, LEAST_SECTION, LEAST_DIAGRAM = 2400, 300, 50, 10
SHOWN_IMPORTS, STORED_IMPORTS, DOC_CHARS, FILE_DOC_CHARS = 12, 20, 300, 200
PROSE = ("md", "mdx", "txt", "rst")
# a heading's line, and the line feed before one; \s without the line feed, as a text of many lines is matched
HEADING = r"^(#{1,4})[\s&&[^\n]]+(.+)"
BEFORE_HEADING = r"\n(?=#{1,4}[\s&&[^\n]]+.)"
_NONE = {"heading": "string", "unit_name": "string", "unit_type": "string", "diagram_type": "string", "imports": "array<string>", "signature": "string"}


def routed(files: DataFrame) -> DataFrame:
    """``files`` with ``route``: mermaid, markdown or code."""
    kind = F.col("file_type")
    return files.withColumn("route", F.when(kind == "mmd", "mermaid").when(kind.isin(*PROSE), "markdown").otherwise("code"))


def _as_chunks(df: DataFrame, **known: Column) -> DataFrame:
    """The chunk table of rows (path, raw_url, file_type, chunk_index, total_chunks, text) and further columns."""
    own = {k: known.get(k, F.lit(None)).cast(t).alias(k) for k, t in _NONE.items()}
    return df.select(
        F.concat_ws("::", "path", F.col("chunk_index").cast("string")).alias("chunk_id"), "text", "path", "raw_url", "file_type",
        known["language"].alias("language"), F.col("chunk_index").cast("int").alias("chunk_index"), F.col("total_chunks").cast("int").alias("total_chunks"), *own.values())


# ---------------------------------------------------------------- diagrams
def mermaid_chunks(files: DataFrame) -> DataFrame:
    """A chunk for each block of more than ``LEAST_DIAGRAM`` characters; the whole file where there is none."""
    content = F.coalesce("content", F.lit(""))
    blocks = F.filter(F.transform(paragraphs(content), strip), lambda b: F.length(b) > LEAST_DIAGRAM)
    kept = files.select("path", "raw_url", "file_type", F.when(F.size(blocks) > 0, blocks).otherwise(F.array(strip(content))).alias("b"))
    each = kept.select("path", "raw_url", "file_type", F.size("b").alias("total_chunks"), F.posexplode("b").alias("chunk_index", "block")).withColumn("d", diagram_type(F.col("block")))
    each = each.withColumn("text", F.concat(F.lit("[Mermaid "), "d", F.lit("] File: "), "path", F.lit("\n\n"), "block"))
    return _as_chunks(each, language=F.lit("mermaid"), heading=F.col("d"), diagram_type=F.col("d"))


# ---------------------------------------------------------------- prose
def sections(content: Column) -> Column:
    """array<struct<heading, text>>: a heading's line begins its section; lines before the first have an empty heading. A text is cut in one go before such lines."""
    heading = lambda text: F.when(text.rlike(HEADING), strip(F.regexp_extract(text, HEADING, 2))).otherwise(F.lit(""))
    return F.transform(F.split(content, BEFORE_HEADING), lambda text: F.struct(heading(text).alias("heading"), text.alias("text")))


def markdown_chunks(files: DataFrame) -> DataFrame:
    """A chunk for each section, long ones in packs that begin with the end of the one before; those of ``LEAST_SECTION`` characters or fewer go, unless all do."""
    cut = files.select("path", "raw_url", "file_type", F.coalesce("content", F.lit("")).alias("content"), sections(F.coalesce("content", F.lit(""))).alias("s"))
    long = F.transform("s", lambda s: F.when(F.length(s["text"]) > SECTION_CHARS, s["text"]))
    cut = cut.withColumn("p", packs(long, SECTION_CHARS, overlap=OVERLAP, joint_counts=True))
    texts = lambda s, p: F.when(F.size(p) > 0, F.transform(p, lambda x: strip(x["text"]))).otherwise(F.array(s["text"]))
    every = F.flatten(F.zip_with("s", "p", lambda s, p: F.transform(texts(s, p), lambda t: F.struct(s["heading"].alias("heading"), t.alias("text")))))
    kept = F.filter(every, lambda s: F.length(strip(s["text"])) > LEAST_SECTION)
    whole = F.array(F.struct(F.lit("").alias("heading"), F.col("content").alias("text")))
    rows = cut.select("path", "raw_url", "file_type", kept.alias("k"), whole.alias("w"))
    rows = rows.select("path", "raw_url", "file_type", F.when(F.size("k") > 0, F.col("k")).otherwise(F.col("w")).alias("s"))
    each = rows.select("path", "raw_url", "file_type", F.size("s").alias("total_chunks"), F.posexplode("s").alias("chunk_index", "s"))
    named = F.when(F.col("s.heading") != "", F.concat(F.lit(" | Section: "), F.col("s.heading"))).otherwise(F.lit(""))
    each = each.withColumn("text", F.concat(F.lit("File: "), "path", named, F.lit("\n\n"), strip(F.col("s.text"))))
    return _as_chunks(each, language=F.lit("markdown"), heading=blank_as_null(F.col("s.heading")))


# ---------------------------------------------------------------- code
def imports_summary(imports: Column) -> Column:
    """The first imports, and how many more there are."""
    more = F.when(F.size(imports) > SHOWN_IMPORTS, F.concat(F.lit(" (+"), (F.size(imports) - SHOWN_IMPORTS).cast("string"), F.lit(" more)"))).otherwise(F.lit(""))
    return F.concat(F.array_join(F.slice(imports, 1, SHOWN_IMPORTS), ", "), more)


def code_text(path: Column, lang: Column, name: Column, unit_type: Column, signature: Column, docstring: Column, body: Column, imports: Column, module_doc: Column) -> Column:
    """The text of a code chunk: a label, what is known of the unit, a rule, the body."""
    line = lambda label, value: F.concat(F.lit(f"{label}: "), blank_as_null(value))  # noqa: E731  null, and so left out, where it is empty
    return F.concat_ws(
        "\n",
        F.concat(F.lit("["), F.initcap(lang), F.lit(" "), F.initcap(unit_type), F.lit("] "), path, F.lit(" :: "), name),
        line("Signature", signature),
        line("Docstring", F.substring(docstring, 1, DOC_CHARS)),
        line("File imports", imports_summary(imports)),
        F.when(unit_type == "module", line("File description", F.substring(module_doc, 1, FILE_DOC_CHARS))),
        F.lit("─" * 40),
        body,
    )


def code_chunks(files: DataFrame, units: DataFrame, parsed: DataFrame) -> DataFrame:
    """A chunk for each unit; a file without any has one that says so."""
    none = F.array().cast("array<string>")
    counted = units.groupBy("path").agg(F.count("*").alias("total"))
    rows = (
        files.select("path", "raw_url", "file_type").join(parsed.select("path", "raw_imports", "module_doc"), "path", "left")
        .join(counted, "path", "left").join(units, "path", "left")
    )
    imports = F.coalesce("raw_imports", none)
    lang = language(F.col("path"))
    text = F.coalesce(
        F.when(F.col("ord").isNotNull(), code_text(F.col("path"), lang, F.col("name"), F.col("unit_type"), F.col("signature"), F.col("docstring"), F.col("body"), imports, F.coalesce("module_doc", F.lit("")))),
        F.concat(F.lit("File: "), "path", F.lit("\n\n(empty or binary)")))
    each = rows.withColumns({"text": text, "chunk_index": F.coalesce("ord", F.lit(0)), "total_chunks": F.coalesce("total", F.lit(1))})
    known = F.col("ord").isNotNull()
    return _as_chunks(each, language=lang, unit_name=F.col("name"), unit_type=F.col("unit_type"), signature=F.col("signature"), imports=F.when(known, F.slice(imports, 1, STORED_IMPORTS)))


def chunk_files(files: DataFrame, units: DataFrame, parsed: DataFrame) -> DataFrame:
    """All chunks of ``files``; each file takes one route. ``units`` and ``parsed`` are of the code files."""
    by = routed(files)
    of = lambda route: by.filter(F.col("route") == route)
    return mermaid_chunks(of("mermaid")).unionByName(markdown_chunks(of("markdown"))).unionByName(code_chunks(of("code"), units, parsed))
