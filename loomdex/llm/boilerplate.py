"""Problem 4: lines repeated across one source's documents.

Lines are folded (case, digits, white space, outer marks) and become the nodes of one graph for each source. A node's weight is the
number of the source's files that have the line, an edge's weight the number of files where the second line follows the first. Nodes
with high support stay, and edges between them; connected components are the boilerplate blocks, and every occurrence of
their lines is deleted from the texts.

Weights are counted over distinct (source, line, file) hashes with partial aggregation, so a line that a third of all rows hold
costs one row for each map task and file. The kept lines are at most five times the mean number of lines a file for each
source; they are sent to all tasks only while they are few (``small``), otherwise joined by shuffle.

Defined cases: null content has no lines, but its file counts as one of the source; files without a source form none; lines without a
letter never count; a line that occurs twice in a text is deleted twice; repeated rows of a chunk_id count once; an empty table
gives an empty result; a text whose lines are all boilerplate becomes empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomdex.functions.text import source_of
from loomdex.operators.graph import connected_components
from loomdex.session import cut


def folded_lines(text: Column) -> Column:
    """array<string>: the lines of a text, folded; all passes run over the whole text, before it is split."""
    t = F.regexp_replace(F.lower(text), "\\p{Nd}+", "0")
    t = F.regexp_replace(t, "(?U)[\\s&&[^\\n]]+", " ")
    return F.split(F.regexp_replace(t, "(?dm)^[^\\p{L}\\p{N}\\n]+|[^\\p{L}\\p{N}\\n]+$", ""), "\n")


class Boilerplate:
    """``chunks`` has chunk_id, content and file_path; all else is ignored."""

    def __init__(self, chunks: DataFrame, least_files: int = 5, least_share: float = 0.2, small: int = 200_000):
        self.chunks, self.least_files, self.least_share, self.small = chunks, least_files, least_share, small
        source = source_of(F.col("file_path"))
        self.placed = chunks.select("chunk_id", "content", F.xxhash64(source).alias("source"), F.xxhash64("file_path").alias("file"), source.isNotNull().alias("__has")).where("__has").drop("__has")
        at = self.placed.where("content is not null").select("chunk_id", "source", "file", F.posexplode(folded_lines(F.col("content"))).alias("line_no", "line"))
        self.lines = at.where(F.col("line").rlike("\\p{L}")).select("chunk_id", "source", "file", "line_no", F.xxhash64("line").alias("line"))
        self._nodes: DataFrame | None = None
        self._marked: DataFrame | None = None

    def nodes(self) -> DataFrame:
        """(source, line, n_files, least): lines with enough support; least is what was asked for in this source."""
        if self._nodes is None:
            support = self.lines.select("source", "line", "file").distinct().groupBy("source", "line").agg(F.count(F.lit(1)).alias("n_files"))
            files = self.placed.select("source", "file").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("of"))
            least = F.greatest(F.lit(self.least_files), F.ceil(F.col("of") * F.lit(self.least_share) - F.lit(1e-9)))
            self._nodes = cut(support.where(F.col("n_files") >= self.least_files).join(files, "source").select("source", "line", "n_files", least.alias("least")).where("n_files >= least"))
        return self._nodes

    def marked(self) -> DataFrame:
        """(chunk_id, source, file, line_no, line, least): every occurrence of a node."""
        if self._marked is None:
            kept = self.nodes().select("source", "line", "least")
            kept = F.broadcast(kept) if kept.count() <= self.small else kept
            self._marked = cut(self.lines.join(kept, ["source", "line"]))
        return self._marked

    def edges(self) -> DataFrame:
        """(source, line, next, n_files): a node that follows another in enough files."""
        w = Window.partitionBy("chunk_id", "file", "source").orderBy("line_no")
        follows = self.marked().withColumns({"next": F.lead("line").over(w), "next_no": F.lead("line_no").over(w)}).where("next_no = line_no + 1")
        return follows.select("source", "line", "next", "least", "file").distinct().groupBy("source", "line", "next", "least").agg(F.count(F.lit(1)).alias("n_files")).where("n_files >= least").drop("least")

    def blocks(self) -> DataFrame:
        """(source, line, block): each node's component; a node without edges is a block of one line."""
        node = lambda line: F.struct("source", line)
        links = self.edges().select(node(F.col("line")).alias("a"), node(F.col("next").alias("line")).alias("b"))
        alone = self.nodes().select(node(F.col("line")).alias("a"), node(F.col("line")).alias("b"))
        found = connected_components(links.unionByName(alone))
        return found.select("node.source", "node.line", F.xxhash64("component").alias("block"))

    def occurrences(self) -> DataFrame:
        """(chunk_id, line_no, block), one row for each line of each chunk_id that belongs to a block."""
        return self.marked().join(self.blocks(), ["source", "line"]).groupBy("chunk_id", "line_no").agg(F.min("block").alias("block"))

    def cleaned(self) -> DataFrame:
        """(chunk_id, content, n_removed): chunks that lost lines, one row for each chunk_id."""
        gone = self.occurrences().groupBy("chunk_id").agg(F.collect_list("line_no").alias("gone"))
        texts = self.placed.where("content is not null").select("chunk_id", "content").join(gone, "chunk_id").dropDuplicates(["chunk_id"])
        left = F.filter(F.transform(F.split("content", "\n"), lambda x, i: F.when(~F.array_contains("gone", i), x)), lambda x: x.isNotNull())
        return texts.select("chunk_id", F.array_join(left, "\n").alias("content"), F.size("gone").alias("n_removed"))
