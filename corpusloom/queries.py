"""The registered queries over the reference tables; ``oracles.py`` has SQL for each.

Derived tables, made alike on both sides: CH (documents as chunks, their source as path), HY (chunks with their
embedding, or that of their words where the table has none), Q (every benchmark item as a query, three to a question), FI (documents as files), IM (two imports of each file),
CF (a code file of each document, in five languages).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.languages import language
from .functions.paths import file_type
from .goldens import GOLDEN_FILES, GOLDEN_IMPORTS, GOLDEN_PATHS, GOLDEN_RESPONSES, GOLDEN_UNITS, GOLDEN_URLS, GRAPH_PATHS
from .functions.scratch import folder, written
from .operators import chunking, diagram, fusion, graph, links, parsing, ranking, retrieval
from .operators.embedding import embed
from .sources import repository
from .streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
EXTENSIONS = ("md", "txt", "py", "go", "js", "mmd", "adoc", "lua")
JS_MODULES = (".ts", ".js", "/index.js", ".jsx")

#: endings of CF's files by doc_id % 5, the line that is repeated in a body, and the file; 1 is the id, 2 words of the document, 3 a small number, 4 the repeated lines
CODE = (
    ("py", "\n    v = 1", '"""%2$s"""\nimport os, src%3$s.doc_%1$s\nfrom . import x\n\ndef load_%1$s(a: int, *, k=1) -> str:\n    "%2$s"%4$s\n\nclass Run%1$s(Base):\n    def g(self): pass\n'),
    ("js", "\n  const s = '}' + x", "// %2$s\nimport a from './a_%1$s'\nconst b = require('b%3$s')\n\n// adds\n// %2$s\nexport function add_%1$s(x) {%4$s\n}\nclass Box%1$s extends Base {\n  put(v) { this.v = v }\n}\n"),
    ("go", '\n\tif a > 0 { fmt.Println("{") }', 'package m\n\nimport (\n\t"fmt"\n\tf "x/y%3$s"\n)\n\n/* Run runs %2$s. */\nfunc (s *Server) Run%1$s(a int) {%4$s\n}\n\ntype Server%1$s struct {\n\tn int\n}\n'),
    ("java", "\n        return k;", "/* %2$s */\nimport a.b%3$s.C;\npublic class Box%1$s {\n    public int get(int k) {%4$s\n    }\n}\n"),
    ("rs", "\n    go();", "use std::io%3$s;\npub use x::y;\n\n/// Reads %2$s\npub fn read_%1$s(n: u8) {%4$s\n}\nimpl Reader%1$s {\n    fn inner(&self) {}\n}\n"),
)
UNPARSED = "import os\ndef f(:\n%s"  # every fifth Python file
PLAIN = 'x = 1\ny = "%s"\n'  # every fifth, too


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- derived tables
def ch(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("path"), "text")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("given"))


def hy(spark: SparkSession, sf: str) -> DataFrame:
    """All chunks; those without a row in ``embeddings`` get the vector of their hashed words."""
    own = embed(ch(spark, sf).repartition("chunk_id")).join(_vectors(spark, sf), "chunk_id", "left")  # dealt for the join, before the words are hashed
    return own.select("chunk_id", "path", "text", F.coalesce("given", "embedding").alias("embedding"))


def cards(df: DataFrame) -> DataFrame:
    """Chunks with the columns that cards and labels show."""
    return df.select(
        "*", F.concat(F.lit("https://example.org/"), "path").alias("raw_url"), F.lit("txt").alias("file_type"), F.lit("text").alias("language"),
        F.when(F.col("chunk_id") % 2 == 0, F.concat(F.lit("Part "), (F.col("chunk_id") % 7).cast("string"))).alias("heading"),
        F.when(F.col("chunk_id") % 5 == 0, F.concat(F.lit("unit_"), (F.col("chunk_id") % 11).cast("string"))).alias("unit_name"),
        F.when(F.col("chunk_id") % 5 == 0, F.lit("function")).alias("unit_type"), F.lit(None).cast("string").alias("diagram_type"), F.col("chunk_id").alias("chunk_index"))


def q(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
    return _table(spark, sf, "benchmark").join(vectors, "item_id").select(F.floor(F.col("item_id") / 3).alias("question_id"), F.col("item_id").alias("query_id"), "text", "vec")


def fi(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "documents")
    extension = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 8 + 1).cast("int"))
    root = F.when(F.col("doc_id") % 11 == 0, "a/dist/").when(F.col("doc_id") % 11 == 1, "dist/").otherwise("")
    content = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return d.select(
        F.col("doc_id").alias("pos"), F.concat(root, "source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), extension).alias("path"), F.lit("blob").alias("type"),
        F.length("text").cast("long").alias("size"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# "), content)).otherwise(content).alias("content"),
    ).withColumn("raw_url", F.concat(F.lit("https://example.org/"), "path")).withColumn("file_type", file_type(F.col("path")))


def im(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(imports, paths): each document is a module that imports two others."""
    d = _table(spark, sf, "documents").select("doc_id")
    n = d.agg(F.count("*").alias("n"))
    root = F.when(F.col("doc_id") % 3 == 0, "src/").when(F.col("doc_id") % 3 == 1, "lib/").otherwise("")
    path = F.concat(root, F.lit("src"), (F.col("doc_id") % 20).cast("string"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".py"))
    aimed = d.crossJoin(F.broadcast(n)).select(path.alias("src"), F.explode(F.array((7 * F.col("doc_id") + 3) % F.col("n"), (13 * F.col("doc_id") + 1) % F.col("n"))).alias("b"))
    raw = F.concat(F.lit("src"), (F.col("b") % 20).cast("string"), F.lit(".doc_"), F.col("b").cast("string"))
    return aimed.select("src", F.lit("python").alias("language"), raw.alias("raw")), d.select(path.alias("path"))


def cf(spark: SparkSession, sf: str) -> DataFrame:
    """A code file of each document."""
    d, n = _table(spark, sf, "documents"), F.col("doc_id")
    words = F.coalesce(F.nullif(F.trim(F.regexp_replace(F.substring("text", 1, 80), "[^A-Za-z]+", " ")), F.lit("")), F.lit("none"))
    by_kind = lambda values: F.element_at(F.array(*values), (n % len(CODE) + 1).cast("int"))
    files = by_kind([F.format_string(text, n, words, n % 7, F.repeat(F.lit(line), (n % 4 + 1).cast("int"))) for _, line, text in CODE])
    content = F.when(n % 25 == 0, F.format_string(UNPARSED, words)).when(n % 25 == 5, F.format_string(PLAIN, words)).otherwise(files)
    path = F.concat(F.lit("code/s"), (n % 20).cast("string"), F.lit("/f_"), n.cast("string"), F.lit("."), by_kind([F.lit(ending) for ending, _, _ in CODE]))
    return d.select(path.alias("path"), content.alias("content")).withColumn("raw_url", F.concat(F.lit("https://example.org/"), "path")).withColumn("file_type", file_type(F.col("path")))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.import_edges(*im(spark, sf))


def im_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of the modules of IM: three units each."""
    paths = _table(spark, sf, "documents").select("doc_id", F.posexplode(F.array(F.lit("load"), F.lit("Run"), F.lit("load"))).alias("chunk_index", "unit_name"))
    root = F.when(F.col("doc_id") % 3 == 0, "src/").when(F.col("doc_id") % 3 == 1, "lib/").otherwise("")
    path = F.concat(root, F.lit("src"), (F.col("doc_id") % 20).cast("string"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".py"))
    return paths.select(path.alias("path"), "chunk_index", "unit_name", F.when(F.col("unit_name") == "Run", "class").otherwise("function").alias("unit_type"))


def path_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between sources: each leads to two others."""
    n = _table(spark, sf, "documents").select(F.col("source").alias("src")).distinct()
    k = F.regexp_extract("src", r"(\d+)$", 1).cast("long")
    out = n.select("src", F.explode(F.array((7 * k + 3) % 20, (k + 1) % 20)).alias("to")).select("src", F.concat(F.lit("src"), F.col("to").cast("string")).alias("dst"))
    return out.filter("src <> dst").distinct()


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# ---------------------------------------------------------------- ranking
def tokenize_counts(spark, sf):
    return ranking.token_counts(ch(spark, sf))


def _bm25(spark: SparkSession, sf: str) -> ranking.Bm25:
    """The stored index of CH, whose texts are dealt by chunk before their words are counted."""
    return ranking.bm25_index(ch(spark, sf).repartition("chunk_id"), keep=True)


def bm25_term_stats(spark, sf):
    return _rounded(_bm25(spark, sf).terms.select("term", "df", "idf"), "idf")


def bm25_doc_len(spark, sf):
    return ranking.bm25_index(ch(spark, sf)).lengths


def bm25_scores(spark, sf):
    return _rounded(ranking.bm25_matches(_bm25(spark, sf), q(spark, sf)), "bm25")


def cosine_scores(spark, sf):
    return _rounded(ranking.cosine_scores(hy(spark, sf), q(spark, sf)), "cosine")


def vector_topk_capped(spark, sf):
    return _rounded(ranking.vector_search(hy(spark, sf), q(spark, sf)), "score").select("query_id", "chunk_id", "path", "score", "rank")


def _index(spark: SparkSession, sf: str) -> tuple[DataFrame, ranking.Bm25]:
    """HY and its BM25 index, both stored."""
    own = written(hy(spark, sf), "chunks")
    return own, ranking.bm25_index(own, keep=True)


def _ranks(spark, sf):
    """All ranks of HY; its texts are neither stored nor dealt, but where they come in too few parts to share the work."""
    own = ch(spark, sf)
    own = own.repartition("chunk_id") if own.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism else own
    vectors = embed(own).drop("text").join(_vectors(spark, sf), "chunk_id", "left").select("chunk_id", "path", F.coalesce("given", "embedding").alias("embedding"))
    return ranking.rank_lists(vectors, ranking.bm25_index(own, keep=True), q(spark, sf))


def rank_lists(spark, sf):
    return _ranks(spark, sf).select("query_id", "chunk_id", "vector_rank", "bm25_rank")


def rrf_fusion(spark, sf):
    return _rounded(ranking.fused(_ranks(spark, sf)), "score").select("query_id", "chunk_id", "score")


def _hits(spark, sf, k=6):
    return fusion.hybrid_search(*_index(spark, sf), q(spark, sf), k)


def hybrid_search(spark, sf):
    return _rounded(_hits(spark, sf), "score")


def multi_query_merge(spark, sf):
    found = ranking.merged(_hits(spark, sf, retrieval.PER_QUERY), q(spark, sf), retrieval.FINAL)
    return _rounded(found, "score").select("question_id", "chunk_id", "path", "hits", "score", "rank")


def _retrieved(spark, sf):
    own, index = _index(spark, sf)
    return retrieval.retrieve(own, index, path_edges(spark, sf), q(spark, sf))


def graph_augmented_retrieve(spark, sf):
    return _rounded(_retrieved(spark, sf)[1], "score")


def build_sources(spark, sf):
    semantic, near = _retrieved(spark, sf)
    out = retrieval.sources(semantic, near, cards(hy(spark, sf)))
    return _rounded(out, "score").select("question_id", "place", "via_graph", "chunk_id", "score", "preview", "label", "badge", "percent")


def context_block(spark, sf):
    semantic, near = _retrieved(spark, sf)
    return retrieval.context_blocks(semantic, near, cards(hy(spark, sf)))


# ---------------------------------------------------------------- lookups
def chunks_for_file(spark, sf):
    return retrieval.chunks_of(cards(ch(spark, sf)), "src3").select("chunk_id", "path", "text")


def indexed_files(spark, sf):
    return retrieval.indexed_files(cards(ch(spark, sf)))


def index_size(spark, sf):
    return ch(spark, sf).agg(F.count("*").alias("n_chunks"))


def file_counts(spark, sf):
    return retrieval.file_counts(fi(spark, sf).withColumn("chunk_index", F.lit(0)))


def search_tool(spark, sf):
    return retrieval.search_tool(_hits(spark, sf), cards(hy(spark, sf)))


def tool_fetch(spark, sf):
    refs = values(spark, [("src3",), ("PART 4",), ("rc1",), ("nowhere",)], "ref string")
    return retrieval.fetch_tool(cards(ch(spark, sf)), refs).select("ref", "chunk_id")


def tool_list_sections(spark, sf):
    return retrieval.sections(cards(ch(spark, sf))).select("section", F.col("at.path").alias("path"), F.col("at.chunk_index").alias("chunk_id"))


def tool_list_files(spark, sf):
    return retrieval.file_list(ch(spark, sf))


def expand_queries_post(spark, sf):
    """Each turn of a user as a question, the turn after it as the model's response; and fixed ones."""
    turns = _table(spark, sf, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    asked = turns.filter("role = 'user'").join(after, ["conv_id", "turn"], "left").select(((F.col("conv_id") + 1) * 1000000 + F.col("turn")).cast("long").alias("question_id"), F.col("text").alias("question"), "response")
    return ranking.expanded(values(spark, GOLDEN_RESPONSES, "question_id long, question string, response string").unionByName(asked))


def chat_history(spark, sf):
    semantic, near = _retrieved(spark, sf)
    turns = _table(spark, sf, "conversations").select(F.col("conv_id").alias("question_id"), "turn", "role")
    shown = retrieval.history(turns, retrieval.sources(semantic, near, cards(hy(spark, sf))))
    return shown.select("question_id", "turn", "role", F.array_join("sources", " ; ").alias("sources"))


# ---------------------------------------------------------------- files
def parse_repo_url(spark, sf):
    """Addresses of pages, of a repository of each document (plain, as a clone's, with a branch), and fixed ones."""
    pages, n = _table(spark, sf, "pages").select("url"), F.col("doc_id")
    more = F.when(n % 3 == 0, "").when(n % 3 == 1, ".git").otherwise(F.concat(F.lit("/tree/dev/"), (n % 5).cast("string")))
    own = _table(spark, sf, "documents").select(F.concat(F.lit("https://github.com/"), "source", F.lit("/doc_"), n.cast("string"), more).alias("url"))
    every = pages.unionByName(own).unionByName(values(spark, [(u,) for u in GOLDEN_URLS], "url string"))
    return every.select("url", repository.parse_address(F.col("url")).alias("a")).select("url", "a.owner", "a.repo", "a.branch")


def repo_id(spark, sf):
    return parse_repo_url(spark, sf).filter("owner IS NOT NULL").select("url", repository.repo_id(F.col("owner"), F.col("repo")).alias("repo_id"))


def file_filter(spark, sf):
    return repository.wanted(fi(spark, sf), None).select("path", "size")


def file_limit(spark, sf):
    return repository.wanted(fi(spark, sf)).select("path", "pos")


def file_types(spark, sf):
    golden = values(spark, [(p,) for p in GOLDEN_PATHS], "path string")
    return fi(spark, sf).select("path").unionByName(golden).select("path", file_type(F.col("path")).alias("file_type"))


def detect_language(spark, sf):
    golden = values(spark, [(p,) for p in GOLDEN_PATHS], "path string")
    return fi(spark, sf).select("path").unionByName(golden).select("path", language(F.col("path")).alias("language"))


def generic_blocks(spark, sf):
    return parsing.generic_blocks(fi(spark, sf)).select("path", F.col("ord").cast("long").alias("ord"), "name", "body", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"))


def file_comment(spark, sf):
    return fi(spark, sf).select("path", parsing.file_comment(F.col("content")).alias("comment"))


def truncate_units(spark, sf):
    return ch(spark, sf).select("chunk_id", parsing.truncated(F.col("text")).alias("body"))


def dedup_units(spark, sf):
    units = _table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("path"), F.col("l_partkey").alias("ord"), F.col("l_linenumber").cast("long").alias("line_start"),
        (F.col("l_linenumber") + F.col("l_quantity") % 9).cast("long").alias("line_end"))
    return parsing.uncontained(units.distinct())


# ---------------------------------------------------------------- chunks
def chunk_router(spark, sf):
    return chunking.routed(fi(spark, sf)).select("path", "route")


def mermaid_chunks(spark, sf):
    made = chunking.mermaid_chunks(fi(spark, sf).filter("file_type = 'mmd'"))
    return made.select("chunk_id", "text", "heading", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("total_chunks").cast("long").alias("total_chunks"))


def markdown_sections(spark, sf):
    cut = fi(spark, sf).select("path", F.posexplode(chunking.sections(F.col("content"))).alias("ord", "s"))
    return cut.select("path", F.col("ord").cast("long").alias("ord"), "s.heading", "s.text")


def markdown_chunks(spark, sf):
    made = chunking.markdown_chunks(fi(spark, sf).filter(F.col("file_type").isin(*chunking.PROSE)))
    return made.select("chunk_id", "text", "heading", F.col("total_chunks").cast("long").alias("total_chunks"))


def imports_summary(spark, sf):
    rows = im(spark, sf)[0].groupBy("raw").agg(F.sort_array(F.collect_list("src")).alias("own"))
    by_root = im(spark, sf)[0].groupBy(F.substring_index("src", "/", 1).alias("raw")).agg(F.sort_array(F.collect_list("raw")).alias("own"))
    return rows.unionByName(by_root).select("raw", chunking.imports_summary(F.col("own")).alias("summary"))


def code_chunk_text(spark, sf):
    names = ["path", "language", "name", "unit_type", "signature", "docstring", "body", "imports", "module_doc"]
    fixed = values(spark, GOLDEN_UNITS, "path string, language string, name string, unit_type string, signature string, docstring string, body string, imports array<string>, module_doc string")
    units, parsed = parsing.parse_files(cf(spark, sf).select("path", "content"))
    both = fixed.unionByName(units.join(parsed, "path").withColumnRenamed("raw_imports", "imports").select(*names))
    return both.select("path", "name", chunking.code_text(*map(F.col, names)).alias("text"))


def code_chunks(spark, sf):
    """All three routes' entry over code files."""
    files = cf(spark, sf)
    made = chunking.chunk_files(files, *parsing.parse_files(files.select("path", "content")))
    return made.select("chunk_id", "text", "language", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("total_chunks").cast("long").alias("total_chunks"), "unit_name", "unit_type", "signature", F.array_join("imports", " ").alias("imports"))


def _code_parse(spark, sf):
    """Units and imports of a code file of each document, and of fixed ones."""
    return parsing.parse_files(values(spark, GOLDEN_FILES, "path string, content string").unionByName(cf(spark, sf).select("path", "content")))


def code_units(spark, sf):
    units, _ = _code_parse(spark, sf)
    return units.select("path", F.col("ord").cast("long").alias("ord"), "name", "unit_type", "signature", "docstring", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"))


def code_imports(spark, sf):
    _, parsed = _code_parse(spark, sf)
    return parsed.select("path", "language", F.array_join("raw_imports", " ").alias("imports"), "module_doc")


def parse_corpus(spark, sf):
    units, _ = parsing.parse_files(fi(spark, sf).filter(~F.col("file_type").isin("mmd", *chunking.PROSE)).select("path", "content"))
    return units.groupBy("path").agg(F.count("*").alias("n_units"))


def embed_documents(spark, sf):
    made = embed(ch(spark, sf).select("chunk_id", "text"))
    return _rounded(made.select("chunk_id", F.posexplode("embedding").alias("place", "value")).withColumn("value", F.col("value").cast("double")), "value")


# ---------------------------------------------------------------- graph
def js_modules(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(imports, paths): each document is a script or a folder's index, every fifth one both; it imports one of another folder, one of its own and a package."""
    d = _table(spark, sf, "documents").select("doc_id")
    stem = F.concat(F.lit("web/s"), (F.col("doc_id") % 20).cast("string"), F.lit("/m_"), F.col("doc_id").cast("string"))
    ending = F.element_at(F.array(*map(F.lit, JS_MODULES)), (F.col("doc_id") % len(JS_MODULES) + 1).cast("int"))
    paths = d.select(F.concat(stem, ending).alias("path"), "doc_id")
    n = d.agg(F.count("*").alias("n"))
    up = F.when(F.col("path").endswith("/index.js"), "../").otherwise("")
    far = (7 * F.col("doc_id") + 3) % F.col("n")
    raw = F.array(
        F.concat(up, F.lit("../s"), (far % 20).cast("string"), F.lit("/m_"), far.cast("string")),
        F.concat(F.lit("./"), up, F.lit("m_"), (F.col("doc_id") + 20).cast("string")), F.lit("react"))
    imports = paths.crossJoin(F.broadcast(n)).select(F.col("path").alias("src"), F.explode(raw).alias("raw"))
    return imports, paths.select("path").unionByName(d.filter("doc_id % 5 = 0").select(F.concat(stem, F.lit(".tsx")).alias("path")))


def go_modules(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(imports, paths): documents share 97 names of files, some at the top; each imports one of 120 names."""
    d = _table(spark, sf, "documents").select("doc_id")
    below = F.when(F.col("doc_id") % 13 == 0, "").otherwise(F.concat(F.lit("cmd/s"), (F.col("doc_id") % 20).cast("string"), F.lit("/d"), F.col("doc_id").cast("string"), F.lit("/")))
    path = F.concat(below, F.lit("m_"), (F.col("doc_id") % 97).cast("string"), F.lit(".go"))
    return d.select(path.alias("src"), F.concat(F.lit("example.com/x/m_"), ((7 * F.col("doc_id") + 3) % 120).cast("string")).alias("raw")), d.select(path.alias("path"))


def _resolved(spark, lang, resolve, imports, paths):
    """Every distinct import and where it leads (or null): those of the tables, and fixed ones among their own paths."""
    fixed = values(spark, [x[:2] for x in GOLDEN_IMPORTS if x[2] == lang], "src string, raw string")
    fixed_paths = values(spark, [(p,) for p in GRAPH_PATHS], "path string")
    of = lambda i, p: i.join(resolve(i, p), ["src", "raw"], "left").select("src", "raw", "dst")
    return of(fixed, fixed_paths).unionByName(of(imports.select("src", "raw").distinct(), paths.distinct()))


def resolve_python(spark, sf):
    return _resolved(spark, "python", graph.resolve_python, *im(spark, sf))


def resolve_js(spark, sf):
    return _resolved(spark, "javascript", graph.resolve_js, *js_modules(spark, sf))


def resolve_go(spark, sf):
    return _resolved(spark, "go", graph.resolve_go, *go_modules(spark, sf))


def import_edges(spark, sf):
    return edges(spark, sf)


def links_after_changes(spark, sf):
    """Links of IM's imports after a change of files, from links before it: every tenth module comes, every seventh has other imports, a twin of every fourth
    appears at the top, and one of every ninth, which was there, goes. All modules are there in the end."""
    imports, paths = (written(x, "modules") for x in im(spark, sf))
    number = F.regexp_extract("path", r"doc_(\d+)\.py$", 1).cast("long")
    top = lambda every, beside: paths.filter((number % every == 0) & (number % beside != 0)).select(F.regexp_replace("path", "^(src|lib)/(?=src)", "").alias("path"))
    of = lambda df, condition: df.join(paths.filter(condition).select(F.col("path").alias("src")), "src", "left_semi")
    came, changed = number % 10 == 0, (number % 7 == 0) & (number % 10 != 0)
    old = of(imports, changed).select("src", "language", F.concat("raw", F.lit("0")).alias("raw"))
    before = paths.filter(~came).unionByName(top(9, 4)).distinct()
    after = written(paths.unionByName(top(4, 20)).distinct(), "paths")
    stay = of(imports, ~came & ~changed)
    links_before = written(links.all_links(stay.unionByName(old), before), "links")
    index = written(links.tries(stay.unionByName(old)).join(old.select("src").distinct(), "src", "left_anti").select("key", "src", "language", "raw"), "tries")
    differ = after.join(before, "path", "left_anti").unionByName(before.join(after, "path", "left_anti"))
    keys = written(differ.select(F.explode(links.keys_of(F.col("path"))).alias("key")).distinct(), "keys")
    again = links.touched(index, keys).unionByName(of(imports, came | changed))
    return links.newest([links_before, links.relinked(again, old, after, written)])


def newest_versions(spark, sf):
    """The last turn of each conversation by a stream of turns as versions: those of even number come first, the others in a later run, so half of them come late."""
    turns = _table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("text").alias("content"), F.lit("").alias("raw_url"), F.col("role").alias("file_type"), F.col("turn").alias("seq"))
    root = folder(spark, "versions")
    for odd in (0, 1):
        turns.filter(F.col("seq") % 2 == odd).write.mode("append").parquet(f"{root}/in")
        changes = ingest.newest_changes(spark.readStream.schema(ingest.CHANGES).parquet(f"{root}/in")).writeStream.outputMode("update")
        changes = changes.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{root}/out/batch={n}"))
        changes.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    made = spark.read.schema(f"{ingest.CHANGES}, batch long").parquet(f"{root}/out")
    return ingest.latest(made).filter("content IS NOT NULL").select(F.col("path").cast("long").alias("conv_id"), F.col("file_type").alias("role"), F.sha2("content", 256).alias("digest"))


def edge_count(spark, sf):
    return edges(spark, sf).agg(F.count("*").alias("n_edges"))


def degree(spark, sf):
    return graph.degrees(edges(spark, sf))


def neighbours_depth1(spark, sf):
    own = edges(spark, sf)
    return graph.neighbours(own, im(spark, sf)[1].select(F.col("path").alias("start"))).select("start", "path", F.col("hops").cast("long").alias("hops"))


def neighbours_depth2(spark, sf):
    own = edges(spark, sf)
    return graph.neighbours(own, im(spark, sf)[1].select(F.col("path").alias("start")), 2).select("start", "path", F.col("hops").cast("long").alias("hops"))


def connection_summary(spark, sf):
    return graph.connection_summary(edges(spark, sf), im(spark, sf)[1])


def diagram_nodes(spark, sf):
    return diagram.nodes(im_chunks(spark, sf), edges(spark, sf))


def diagram_edges(spark, sf):
    own = edges(spark, sf)
    return diagram.node_edges(own, diagram.nodes(im_chunks(spark, sf), own))


def diagram_groups(spark, sf):
    shown = diagram.groups(diagram.nodes(im_chunks(spark, sf), edges(spark, sf)))
    return shown.select("directory", F.array_join("files", ",").alias("files"))


def mermaid_lines(spark, sf):
    """The lines of the diagram of the best connected files, in order."""
    lines = diagram.diagram_lines(im_chunks(spark, sf), edges(spark, sf))
    return lines.select(F.row_number().over(Window.orderBy("part", "key")).cast("long").alias("place"), "line")


def graph_summary_lines(spark, sf):
    return diagram.summary_lines(im_chunks(spark, sf), edges(spark, sf)).select("line")


def ui_caption(spark, sf):
    return im_chunks(spark, sf).agg(F.count_distinct("path").alias("n_files")).crossJoin(edges(spark, sf).agg(F.count("*").alias("n_edges")))


_ALL = (
    tokenize_counts, bm25_term_stats, bm25_doc_len, bm25_scores, cosine_scores, vector_topk_capped, rank_lists, rrf_fusion, hybrid_search, multi_query_merge,
    graph_augmented_retrieve, build_sources, context_block, chunks_for_file, indexed_files, index_size, file_counts, search_tool, tool_fetch, tool_list_sections, tool_list_files,
    expand_queries_post, chat_history, parse_repo_url, repo_id, file_filter, file_limit, file_types, detect_language, generic_blocks, file_comment, truncate_units, dedup_units, chunk_router,
    mermaid_chunks, markdown_sections, markdown_chunks, imports_summary, code_chunk_text, code_chunks, code_units, code_imports, parse_corpus, embed_documents, resolve_python, resolve_js, resolve_go,
    import_edges, links_after_changes, newest_versions, edge_count, degree, neighbours_depth1, neighbours_depth2, connection_summary, diagram_nodes, diagram_edges, diagram_groups, mermaid_lines, graph_summary_lines, ui_caption,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}
