"""The whole analysis of many repositories as lazy tables behind one object."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Limits
from ..functions import scalar as S
from ..operators import chunks as K
from ..operators import context as X
from ..operators import graph as G
from ..operators import manifest as M
from ..operators import reports as R
from ..operators import resolve as V
from ..operators import retrieve as T
from ..operators import score as C
from ..operators import sections as N
from ..operators import symbols as Y
from ..parsing import driver as P


#: Files of a repository that are analysed in sampled mode.
SAMPLE = 300


class Analysis:
    """files(file_id, repo, path, size_bytes, sha) and contents(file_id, repo, path, content); symbols are parsed unless given.

    Nodes of the import graph are file ids.  Tables are plans until they are read; those that many others are made of (symbols,
    edges, degrees, scores) are written to the checkpoint folder when they are first needed, so files are parsed once.
    """

    def __init__(self, spark: SparkSession, files: DataFrame, contents: DataFrame, symbols: DataFrame | None = None, limits: Limits | None = None):
        self.spark, self.files, self.contents, self.given, self.limits = spark, files, contents, symbols, limits or Limits()

    @cached_property
    def manifest(self) -> DataFrame:
        return M.with_lines(self.files, self.contents)

    @cached_property
    def tiers(self) -> DataFrame:
        return M.analysis_tiers(self.files, self.limits)

    @cached_property
    def parsed(self) -> DataFrame:
        return G.cut(P.parse_files(self.contents))

    @cached_property
    def symbols(self) -> DataFrame:
        return self.given if self.given is not None else G.cut(V.flagged(self.parsed, M.manifest(self.files)))

    @cached_property
    def imports(self) -> DataFrame:
        return Y.imports(self.symbols).withColumn("language", S.language(F.col("path")))

    @cached_property
    def edges(self) -> DataFrame:
        """repo, src, dst by path."""
        return V.edges(self.imports, M.manifest(self.files))

    @cached_property
    def nodes(self) -> DataFrame:
        return self.manifest.select(F.col("file_id").alias("node"))

    @cached_property
    def id_edges(self) -> DataFrame:
        ids = M.manifest(self.files).select("repo", "path", "file_id")
        a = ids.select("repo", F.col("path").alias("src"), F.col("file_id").alias("s"))
        b = ids.select("repo", F.col("path").alias("dst"), F.col("file_id").alias("d"))
        return G.cut(self.edges.join(a, ["repo", "src"]).join(b, ["repo", "dst"]).select(F.col("s").alias("src"), F.col("d").alias("dst")))

    @cached_property
    def degrees(self) -> DataFrame:
        return G.cut(G.degrees(self.nodes, self.id_edges).withColumnRenamed("node", "file_id"))

    @cached_property
    def components(self) -> DataFrame:
        return G.cut(G.components(self.nodes, self.id_edges))

    @cached_property
    def circular(self) -> DataFrame:
        return G.cut(G.circular_nodes(self.nodes, self.id_edges, self.components).withColumnRenamed("node", "file_id"))

    @cached_property
    def analyzed(self) -> DataFrame | None:
        """file_id of the files that are analysed: of repositories in sampled mode the first SAMPLE of each by rank, users, symbols
        and depth, of others all; None if no repository is in that mode."""
        sampled = self.tiers.where("tier = 'Sampled'").select("repo")
        if sampled.isEmpty():
            return None
        rows = self.manifest.select("file_id", "repo", "path", S.path_depth(F.col("path")).alias("depth"))
        rows = rows.join(self.degrees, "file_id").join(G.pagerank(self.nodes, self.id_edges).withColumnRenamed("node", "file_id"), "file_id", "left").join(Y.file_counts(self.symbols).select("file_id", "n_symbols"), "file_id", "left")
        rows = rows.join(sampled.withColumn("few", F.lit(True)), "repo", "left")
        w = Window.partitionBy("repo").orderBy(F.desc(F.coalesce("pagerank", F.lit(0.0))), F.desc("in_degree"), F.desc(F.coalesce("n_symbols", F.lit(0))), "depth", "path")
        return G.cut(rows.withColumn("k", F.row_number().over(w)).where(F.col("few").isNull() | (F.col("k") <= SAMPLE)).select("file_id"))

    @cached_property
    def function_scores(self) -> DataFrame:
        return C.function_scores(P.function_complexity(self.parsed))

    @cached_property
    def scores(self) -> DataFrame:
        errors = self.symbols.groupBy("file_id").agg(F.max(F.coalesce("parse_error", F.lit(False))).alias("parse_error"))
        return G.cut(C.scores(self.manifest, Y.file_counts(self.symbols), C.file_complexity(self.function_scores), self.degrees.select("file_id", F.col("out_degree").alias("coupling")), self.circular, errors, self.analyzed))

    @cached_property
    def chunks(self) -> DataFrame:
        return K.with_complexity(K.make_chunks(self.contents, self.symbols, analyzed=self.analyzed), self.function_scores, self.scores.select("file_id", "risk_level"))

    def search(self, text: str, k: int = 5, **filters: str) -> DataFrame:
        """Nearest chunks of a question; a blank one finds none."""
        q = T.hashing_embedding(text if text.strip() else None).tolist()
        return T.nearest(T.embed(self.chunks, "content"), q, k, T.where(**filters))

    def selected(self, k: int = 20) -> DataFrame:
        return X.selected(self.scores, self.degrees, k)

    def facts(self, repos: DataFrame | None = None, explanations: DataFrame | None = None) -> N.Facts:
        """What reports need; repos(repo, repo_url, default_branch) and explanations(file_id, explanation) may be given."""
        kind = dict(self.files.dtypes)["file_id"]
        none = lambda schema: self.spark.createDataFrame([], schema)

        def order() -> DataFrame:
            ring = self.circular.join(self.manifest.select("file_id", "repo"), "file_id").select("repo").distinct()
            kept = self.manifest.join(ring, "repo", "left_anti").select(F.col("file_id").alias("node"))
            e = self.id_edges.join(kept.withColumnRenamed("node", "src"), "src", "left_semi").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi")
            return G.levels(kept, e).withColumnRenamed("node", "file_id")

        return N.Facts(
            repos=lambda: repos if repos is not None else self.manifest.select("repo", F.lit(None).cast("string").alias("repo_url"), F.lit(None).cast("string").alias("default_branch")).distinct(),
            tiers=lambda: self.tiers,
            languages=lambda: M.language_breakdown(self.files, True),
            totals=lambda: Y.totals(self.symbols),
            scored=lambda: self.scores,
            nodes=lambda: self.manifest.select("file_id", "repo", "path"),
            degrees=lambda: self.degrees,
            edges=lambda: self.id_edges,
            cycles=lambda: G.cut(G.cycles(self.nodes, self.id_edges, known=self.components).select("nodes", "length")),
            order=order,
            classes=lambda: Y.classes(self.symbols),
            functions=lambda: self.function_scores,
            explanations=lambda: explanations if explanations is not None else none(f"file_id {kind}, explanation string"),
        )

    def documents(self, f: N.Facts | None = None) -> DataFrame:
        """repo, onboarding, agent_context, file_explanations of every repository."""
        f = f or self.facts()
        text = lambda sections, name: N.document(f.repos, sections).withColumnRenamed("document", name)
        return text(N.onboarding(f), "onboarding").join(text(N.agent_context(f), "agent_context"), "repo").join(text(N.file_explanations(f), "file_explanations"), "repo")

    def results(self, job_id: str, f: N.Facts | None = None) -> DataFrame:
        """job_id, repo, json and the documents: what a client of the service gets of each repository."""
        f = f or self.facts()
        return N.api_json(f, job_id).join(self.documents(f), "repo").withColumn("job_id", F.lit(job_id))

    def smoke(self, questions: tuple[str, ...] = ("where is the program started", "how are errors handled", "what is configured"), k: int = 2) -> dict[str, list[str]]:
        """The nearest chunks of a few fixed questions, to see that search answers."""
        return {q: [r["chunk_id"] for r in self.search(q, k).collect()] for q in questions}

    def report(self) -> str:
        """A Markdown overview of all repositories."""
        return R.document(
            "Overview",
            {
                "Tiers": lambda: R.markdown(self.tiers.orderBy("repo"), "Tiers"),
                "Languages": lambda: R.markdown(M.language_breakdown(self.files).orderBy("repo", "language"), "Languages"),
                "Risk": lambda: R.markdown(C.risk_distribution(self.scores).orderBy("repo", "risk_level"), "Risk"),
                "Architecture": lambda: R.markdown(R.architecture(self.scores, self.degrees), "Architecture"),
                "Risky files": lambda: R.markdown(C.top_risky(self.scores), "Risky files"),
                "Complex functions": lambda: R.markdown(C.top_functions(C.complex_functions(self.function_scores), 20), "Complex functions"),
                "Safe files": lambda: R.markdown(C.safe_files(self.scores, self.degrees), "Safe files"),
                "Domain classes": lambda: R.markdown(R.domain_classes(Y.classes(self.symbols), self.degrees), "Domain classes"),
            },
        )
