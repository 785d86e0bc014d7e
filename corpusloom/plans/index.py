"""An index over the files of a repository, and what can be asked of it."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.languages import language
from ..functions.scratch import written
from ..operators import diagram, retrieval
from ..operators.chunking import chunk_files, routed
from ..operators.embedding import embed
from ..operators.graph import import_edges
from ..operators.parsing import parse_files
from ..operators.fusion import hybrid_search
from ..operators.ranking import ROW_GROUP, Bm25, bm25_index, expanded
from ..sources.index_store import IndexStore
from .providers import CODE_PROMPT, DIAGRAM_PROMPT, DOCUMENT_PROMPT, Models

log = logging.getLogger(__name__)
MOST_STEPS = 4
#: Chunks and names that a tool's text holds; it says how many more there are.
MOST_FETCHED, MOST_LISTED = 40, 1_000


def _written_bm25(chunks: DataFrame) -> Bm25:
    found = bm25_index(chunks, keep=True, cluster=True)
    return replace(found, lengths=written(found.lengths, "lengths"))


class Index:
    """Tables of one repository: chunks with embeddings, raw imports, the edges they lead to, and BM25 statistics."""

    def __init__(self, chunks: DataFrame, imports: DataFrame, edges: DataFrame, bm25: Bm25, model: Callable[[], object] | None = None):
        self.chunks, self.imports, self.edges, self.bm25, self.model = chunks, imports, edges, bm25, model

    # ---------------------------------------------------------------- making and keeping
    @classmethod
    def build(cls, files: DataFrame, model: Callable[[], object] | None = None, progress: Callable[[int, str], None] = lambda percent, what: None) -> Index:
        """Parse, chunk, link and embed ``files`` (path, content, raw_url, file_type). Each table is written once."""
        progress(5, "reading")
        files = written(files, "files")
        progress(25, "parsing")
        code = routed(files).filter("route = 'code'").select("path", "content")
        units, parsed = parse_files(code)
        progress(35, "linking")
        imports = written(parsed.select(F.col("path").alias("src"), "language", F.explode("raw_imports").alias("raw")), "imports")
        edges = written(import_edges(imports, files.select("path")), "edges")
        progress(40, "embedding")
        chunks = written(embed(chunk_files(files, units, parsed), model=model), "chunks")
        progress(90, "indexing")
        bm25 = _written_bm25(chunks)
        progress(100, "done")
        return cls(chunks, imports, edges, bm25, model)

    def save(self, store: IndexStore, repo_id: str, replaces: str | None = None) -> str:
        """Keep the index and return its version; with ``replaces`` only if that version is still the newest."""
        tables = {"chunks": self.chunks, "imports": self.imports, "edges": self.edges, "postings": self.bm25.postings, "lengths": self.bm25.lengths, "terms": self.bm25.terms, "totals": self.bm25.totals}
        return store.save(repo_id, tables, {"postings": {"parquet.block.size": ROW_GROUP}}, replaces)

    @classmethod
    def load(cls, store: IndexStore, repo_id: str, model: Callable[[], object] | None = None, version: str | None = None) -> Index:
        tables = store.load(repo_id, version)
        if tables is None:
            raise ValueError(f"{repo_id} isn't indexed")
        return cls(tables["chunks"], tables["imports"], tables["edges"], Bm25(tables["postings"], tables["lengths"], tables["terms"], tables["totals"]), model)

    def appended(self, files: DataFrame) -> Index:
        """An index that holds ``files`` as well; files of a path that is there already take its place.

        Only the new files are parsed and embedded. Links of all imports are resolved anew, since old ones can lead
        to new files, and BM25 statistics cover all chunks; both are written.
        """
        more = Index.build(files, self.model)
        fresh = more.chunks.select("path").distinct()
        chunks = written(self.chunks.join(fresh, "path", "left_anti").select(*self.chunks.columns).unionByName(more.chunks), "chunks")
        imports = written(self.imports.join(fresh.withColumnRenamed("path", "src"), "src", "left_anti").select(*self.imports.columns).unionByName(more.imports), "imports")
        return Index(chunks, imports, written(import_edges(imports, chunks.select("path").distinct()), "edges"), _written_bm25(chunks), self.model)

    # ---------------------------------------------------------------- asking
    def queries(self, questions: DataFrame) -> DataFrame:
        """question_id, query_id, text, vec of ``questions`` (question_id, question, response)."""
        own = expanded(questions).withColumn("query_id", F.col("question_id") * 16 + F.col("query_id"))
        return embed(own, name="vec", model=self.model)

    def retrieve(self, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
        return retrieval.retrieve(self.chunks, self.bm25, self.edges, self.queries(questions))

    def tools(self, documents: bool = False) -> dict[str, Callable[[str], str]]:
        """The lookups of a planner, by name; each gives a text."""
        spark = self.chunks.sparkSession

        def search(query: str) -> str:
            asked = self.queries(spark.createDataFrame([(0, query, None)], "question_id long, question string, response string"))
            hits = hybrid_search(self.chunks, self.bm25, asked, retrieval.TOOL_HITS)
            row = retrieval.search_tool(hits, self.chunks).first()
            return row["answer"] if row else "Nothing was found."

        def fetch(ref: str) -> str:
            rows = retrieval.fetch_tool(self.chunks, spark.createDataFrame([(ref,)], "ref string"))
            placed = rows.join(self.chunks.select("chunk_id", "chunk_index"), "chunk_id")
            texts = [r["text"] for r in placed.orderBy("path", "chunk_index").limit(MOST_FETCHED).collect()]
            if len(texts) == MOST_FETCHED and (more := rows.count() - MOST_FETCHED):
                texts.append(f"({more} more passages match '{ref}'.)")
            return "\n\n---\n\n".join(texts) if texts else f"'{ref}' isn't in the index."

        def listed(label: str, df: DataFrame) -> Callable[[str], str]:
            def names(_: str) -> str:
                lines = [f"- {r[0]}" for r in df.limit(MOST_LISTED).collect()]
                if len(lines) == MOST_LISTED and (more := df.count() - MOST_LISTED):
                    lines.append(f"({more} more.)")
                return "\n".join([f"{label}:", *lines])

            return names

        if documents:
            return {"search_document": search, "get_section": fetch, "list_sections": listed("Sections", retrieval.sections(self.chunks))}
        return {"search_codebase": search, "get_file": fetch, "list_files": listed("Files", retrieval.file_list(self.chunks))}

    def gather(self, question: str, context: str, models: Models, documents: bool = False) -> list[tuple[str, str, str]]:
        """(tool, input, observation) of at most ``MOST_STEPS`` steps; a planner that fails ends them."""
        if models.planner is None:
            return []
        tools, steps = self.tools(documents), []
        for _ in range(MOST_STEPS):
            try:
                step = models.planner.step(question, context, [x[2] for x in steps])
            except Exception as error:  # a model's failure leaves what is known
                log.warning("the planner failed: %s", error)
                break
            if step is None:
                break
            name, given = step
            if name in tools and (seen := tools[name](given)).strip():
                steps.append((name, given, seen))
        return steps

    def answer(self, question: str, models: Models | None = None, documents: bool = False) -> Iterator[dict]:
        """Events of one answer: its sources, the tools that were used, and the text's pieces."""
        models = models or Models()
        spark = self.chunks.sparkSession
        try:
            response = models.expander.expand(question)
        except Exception as error:  # the question alone still works
            log.warning("the expander failed: %s", error)
            response = None
        semantic, near = (written(x, "hits") for x in self.retrieve(spark.createDataFrame([(0, question, response)], "question_id long, question string, response string")))
        yield {"type": "sources", "sources": [r.asDict() for r in retrieval.sources(semantic, near, self.chunks).orderBy("place").collect()]}
        row = retrieval.context_blocks(semantic, near, self.chunks).first()
        context = row["context"] if row else ""
        steps = self.gather(question, context, models, documents)
        for name, given, _ in steps:
            yield {"type": "tool", "tool": name, "input": given}
        passages = "\n\n---\n\n".join(x for x in (context, *(s[2] for s in steps)) if x)
        for piece in models.generator.stream(f"{DOCUMENT_PROMPT if documents else CODE_PROMPT}\n\n{passages}\n\n{question}\n"):
            yield {"type": "token", "text": piece}

    # ---------------------------------------------------------------- diagrams
    def mermaid(self) -> str:
        return diagram.render(diagram.diagram_lines(self.chunks, self.edges))

    def summary(self) -> str:
        rows = diagram.summary_lines(self.chunks, self.edges).orderBy("part", "key").collect()
        return "\n".join(r["line"] for r in rows) if len(rows) > 1 else ""

    def explain(self, models: Models | None = None) -> Iterator[str]:
        yield from (models or Models()).generator.stream(f"{DIAGRAM_PROMPT}\n\n{self.summary()}")


def ingest(files: DataFrame, store: IndexStore, repo_id: str, model: Callable[[], object] | None = None, progress: Callable[[int, str], None] = lambda percent, what: None) -> Index:
    """Build an index, keep it under ``repo_id`` and read it back."""
    Index.build(files, model, progress).save(store, repo_id)
    return Index.load(store, repo_id, model)


def languages(files: DataFrame) -> DataFrame:
    """(language, n_files), the most frequent first."""
    return files.select(language(F.col("path")).alias("language")).groupBy("language").agg(F.count("*").alias("n_files")).orderBy(F.desc("n_files"), "language")


def open_index(spark: SparkSession, root: str, repo_id: str) -> Index:
    return Index.load(IndexStore(spark, root), repo_id)
