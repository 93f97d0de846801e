"""The code graph: nodes and edges from structures, upserts, and one-hop queries as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def node_id(kind: Column, name: Column, path: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", kind, name, path), 256), 1, 16)


def import_name(statement: Column, language: Column) -> Column:
    """The module an import statement of Python or JavaScript names; null for other languages and statements."""
    text = F.trim(statement)
    word = F.get(F.split(F.regexp_replace(text, r"\s+", " "), " "), F.lit(1))
    python = F.when(text.startswith("from "), word).when(text.startswith("import "), F.split_part(word, F.lit("."), F.lit(1)))
    # What stands after the last "from", without blanks, then quotes, then semicolons at its ends.
    script = F.trim(F.element_at(F.split(text, "from"), -1))
    script = F.regexp_replace(F.regexp_replace(script, "^['\"]+|['\"]+$", ""), "^;+|;+$", "")
    return F.when(language == "python", python).when((language == "javascript") & text.contains("from") & (script != ""), script)


def _node(kind: str, name: Column, path: Column, first: Column | None = None, last: Column | None = None) -> Column:
    none = F.lit(None).cast("int")
    return F.struct(node_id(F.lit(kind), name, path).alias("id"), name.alias("name"), F.lit(kind).alias("kind"), path.alias("file_path"), (none if first is None else first).alias("line_start"), (none if last is None else last).alias("line_end"))


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of files (path, language, structure): modules, functions, classes, imported modules; CONTAINS, IMPORTS, CALLS."""
    path, language, s = F.col("path"), F.col("language"), F.col("structure")
    module = _node("module", path, path)
    functions = F.transform(s["functions"], lambda f: _node("function", f["name"], path, f["line_start"], f["line_end"]))
    classes = F.transform(s["classes"], lambda c: _node("class", c["name"], path, c["line_start"], c["line_end"]))
    names = F.filter(F.transform(s["imports"], lambda i: import_name(i, language)), lambda n: n.isNotNull() & (n != ""))
    imported = F.transform(names, lambda n: _node("module", n, n))
    rows = files.select("path", "language", module.alias("module"), functions.alias("functions"), classes.alias("classes"), imported.alias("imported"), s["calls"].alias("calls"))
    nodes = rows.select("language", F.explode(F.concat(F.array("module"), "functions", "classes", "imported")).alias("n")).select("n.*", "language")
    edge = lambda to, kind: F.struct(F.col("module.id").alias("source_id"), to.alias("target_id"), F.lit(kind).alias("relationship"))
    # A call is to the function of that name in the same file, if there is one.
    called = F.transform(F.when(language.isin("python", "javascript"), F.col("calls")).otherwise(F.expr("cast(array() as array<string>)")), lambda c: F.element_at(F.split(c, r"\."), -1))
    own = F.filter(F.col("functions"), lambda f: F.array_contains(called, f["name"]))
    made = F.concat(
        F.transform(F.concat("functions", "classes"), lambda n: edge(n["id"], "CONTAINS")),
        F.transform("imported", lambda n: edge(n["id"], "IMPORTS")),
        F.transform(own, lambda n: edge(n["id"], "CALLS")),
    )
    edges = rows.select(F.explode(made).alias("e")).select("e.*").distinct()
    return nodes, edges


def upsert_nodes(nodes: DataFrame, order: str = "ord") -> DataFrame:
    """The last version of each node."""
    rest = [c for c in nodes.columns if c not in ("id", order)]
    return nodes.groupBy("id").agg(F.max_by(F.struct(*rest), F.col(order)).alias("n")).select("id", "n.*")


def upsert_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges both of whose ends exist."""
    ids = nodes.select("id")
    kept = edges.distinct().join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    return kept.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def _hop(nodes: DataFrame, edges: DataFrame, relationship: str, names: list[str], at: str) -> DataFrame:
    """queried, id, name, kind, file_path: the other ends of edges at nodes with the given names; `at` is the queried end."""
    other = {"source_id": "target_id", "target_id": "source_id"}[at]
    here = nodes.where(F.col("name").isin(names)).select(F.col("id").alias(at), F.col("name").alias("queried"))
    there = nodes.select(F.col("id").alias(other), "name", "kind", "file_path")
    found = edges.where(F.col("relationship") == relationship).join(here, at).join(there, other)
    return found.select("queried", F.col(other).alias("id"), "name", "kind", "file_path").distinct()


def callers(nodes: DataFrame, edges: DataFrame, names: list[str]) -> DataFrame:
    return _hop(nodes, edges, "CALLS", names, "target_id")


def callees(nodes: DataFrame, edges: DataFrame, names: list[str]) -> DataFrame:
    return _hop(nodes, edges, "CALLS", names, "source_id")


def imports_of(nodes: DataFrame, edges: DataFrame, names: list[str]) -> DataFrame:
    return _hop(nodes, edges, "IMPORTS", names, "source_id")


def parents(nodes: DataFrame, edges: DataFrame, names: list[str], path: str | None = None) -> DataFrame:
    """The classes that contain the named nodes, of one file if its path is given."""
    found = _hop(nodes, edges, "CONTAINS", names, "target_id").where(F.col("kind") == "class")
    return found if path is None else found.where(F.col("file_path") == path)


def beside(nodes: DataFrame, edges: DataFrame, names: list[str]) -> DataFrame:
    """queried, id, name, kind, file_path: all other nodes, of whatever kind, that a container of a named node contains."""
    inside = edges.where(F.col("relationship") == "CONTAINS").select("source_id", "target_id")
    named = nodes.where(F.col("name").isin(names)).select(F.col("id").alias("target_id"), F.col("name").alias("queried"))
    held = inside.join(named, "target_id").select("source_id", "queried", F.col("target_id").alias("self"))
    found = inside.join(held, "source_id").where(F.col("target_id") != F.col("self"))
    return found.join(nodes.select(F.col("id").alias("target_id"), "name", "kind", "file_path"), "target_id").select("queried", F.col("target_id").alias("id"), "name", "kind", "file_path").distinct()


def siblings(nodes: DataFrame, edges: DataFrame, names: list[str], path: str | None = None) -> DataFrame:
    """file_path, id, name: functions other than the named ones, in the file `path`, or else in each file that contains a named one."""
    inside = edges.where(F.col("relationship") == "CONTAINS").select("source_id", "target_id")
    modules = nodes.where(F.col("kind") == "module").select(F.col("id").alias("source_id"), F.col("file_path").alias("in_path"))
    if path is not None:
        modules = modules.where(F.col("in_path") == path)
    else:
        named = nodes.where(F.col("name").isin(names)).select(F.col("id").alias("target_id"))
        modules = modules.join(inside.join(named, "target_id", "left_semi"), "source_id", "left_semi")
    functions = nodes.where((F.col("kind") == "function") & ~F.col("name").isin(names)).select(F.col("id").alias("target_id"), "name")
    found = inside.join(modules, "source_id").join(functions, "target_id")
    return found.select(F.col("in_path").alias("file_path"), F.col("target_id").alias("id"), "name").distinct()


def file_context(nodes: DataFrame, edges: DataFrame, names: list[str], path: str, most: int = 10) -> DataFrame:
    """One row, `context`: what calls the named functions of a file, what they call, the file's other functions, its imports
    and the class around them, at most `most` of each, as text for a model; empty if nothing is known."""
    here = nodes.where((F.col("kind") == "module") & (F.col("file_path") == path)).select(F.col("id").alias("source_id"))
    imported = edges.where(F.col("relationship") == "IMPORTS").join(here, "source_id", "left_semi").select(F.col("target_id").alias("id"))
    parts = [
        ("Called by:", callers(nodes, edges, names).select("name", "kind", "file_path"), F.concat(F.lit("  - "), "name", F.lit(" ("), "kind", F.lit(") in "), "file_path"), most),
        ("Calls:", callees(nodes, edges, names).select("name", "file_path"), F.concat(F.lit("  - "), "name"), most),
        ("Sibling functions in file: ", siblings(nodes, edges, names, path).select("name"), F.col("name"), most),
        ("Module imports: ", nodes.join(imported, "id", "left_semi").select("name"), F.col("name"), most),
        ("Defined in class: ", parents(nodes, edges, names, path).select("name"), F.col("name"), 1),
    ]
    texts = []
    for at, (title, rows, shown, limit) in enumerate(parts):
        first = rows.distinct().orderBy(*rows.columns).limit(limit).agg(F.array_sort(F.collect_list(F.struct(*rows.columns, shown.alias("shown")))).alias("r"))
        lines = F.transform("r", lambda x: x["shown"])
        body = F.concat(F.lit(title + "\n"), F.array_join(lines, "\n")) if title.endswith(":") else F.concat(F.lit(title), F.array_join(lines, ", "))
        texts.append(first.where(F.size("r") > 0).select(F.lit(at).alias("at"), body.alias("text")))
    all_ = texts[0]
    for more in texts[1:]:
        all_ = all_.unionAll(more)
    whole = all_.agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("t"))
    return whole.select(F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("context"))
