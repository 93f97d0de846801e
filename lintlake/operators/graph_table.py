"""The code graph by a table function: a file's entities are one partition of it, nodes and edges its rows.

    select * from code_graph(table(entities))        after spark.udtf.register("code_graph", CodeGraph)

The function holds one file's names at a time: what the file defines, imports and calls.  Two files of one path are one.
A null path is a file of its own; entities without a name are passed over.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import IntegerType, StringType, StructType

from lintlake.operators.graph import import_name

NODE = [("id", "string"), ("name", "string"), ("kind", "string"), ("file_path", "string"), ("line_start", "int"), ("line_end", "int"), ("language", "string")]
EDGE = [("source_id", "string"), ("target_id", "string"), ("relationship", "string")]
NEEDED = ("path", "language", "kind", "name", "line_start", "line_end")


def entities(files: DataFrame) -> DataFrame:
    """path, language, kind (module, function, class, import, call), name, line_start, line_end of files (path, language, structure)."""
    s, none = F.col("structure"), F.lit(None).cast("int")
    entity = lambda kind, name, first=none, last=none: F.struct(F.lit(kind).alias("kind"), name.alias("name"), first.alias("line_start"), last.alias("line_end"))
    calls = F.when(F.col("language").isin("python", "javascript"), s["calls"]).otherwise(F.expr("cast(array() as array<string>)"))
    every = F.concat(
        F.array(entity("module", F.col("path"))),
        F.transform(s["functions"], lambda f: entity("function", f["name"], f["line_start"], f["line_end"])),
        F.transform(s["classes"], lambda c: entity("class", c["name"], c["line_start"], c["line_end"])),
        F.transform(s["imports"], lambda i: entity("import", import_name(i, F.col("language")))),
        F.transform(F.array_distinct(F.transform(calls, lambda c: F.element_at(F.split(c, r"\."), -1))), lambda c: entity("call", c)),
    )
    return files.select("path", "language", F.explode(every).alias("e")).select("path", "language", "e.*").where(F.coalesce("name", F.lit("")) != "")


@udtf
class CodeGraph:
    """part (node or edge) and the fields of either, from a table of entities, partitioned by path."""

    def __init__(self):
        self.path, self.functions, self.inside, self.called = None, {}, [], set()

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or set(NEEDED) - set(table.dataType.fieldNames()):
            raise ValueError(f"code_graph takes a table with the columns {', '.join(NEEDED)}")
        rows = StructType().add("part", StringType())
        for name, kind in NODE + EDGE:
            rows.add(name, IntegerType() if kind == "int" else StringType())
        return AnalyzeResult(rows, partitionBy=[PartitioningColumn("path")], orderBy=[OrderingColumn("kind"), OrderingColumn("name")])

    def eval(self, row):
        self.path = row["path"]
        if row["kind"] == "call":
            self.called.add(row["name"])
            return
        kind, path = (("module", row["name"]) if row["kind"] == "import" else (row["kind"], self.path))
        node = _node_id(kind, row["name"], path)
        if kind == "function":
            self.functions[row["name"]] = node
        if row["kind"] != "module":
            self.inside.append((node, "IMPORTS" if row["kind"] == "import" else "CONTAINS"))
        yield ("node", node, row["name"], kind, path, row["line_start"], row["line_end"], row["language"], None, None, None)

    def terminate(self):
        here = _node_id("module", self.path, self.path)
        made = {(node, how) for node, how in self.inside} | {(node, "CALLS") for name, node in self.functions.items() if name in self.called}
        for node, how in sorted(made):
            yield ("edge", None, None, None, None, None, None, None, here, node, how)


def _node_id(*parts: str | None) -> str:
    return hashlib.sha256(":".join(p for p in parts if p is not None).encode()).hexdigest()[:16]


def rows(files: DataFrame) -> DataFrame:
    """What the table function makes of files (path, language, structure)."""
    return CodeGraph(entities(files).asTable())


def parts(made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the table function's rows."""
    nodes = made.where("part = 'node'").select(*(c for c, _ in NODE))
    return nodes, made.where("part = 'edge'").select(*(c for c, _ in EDGE)).distinct()


def extract_by_table(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as graph.extract gives them."""
    return parts(rows(files))
