"""Parsed functions as columns: Arrow functions over `cparse`, one text at a time, and relations that follow from them."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from . import cparse, tokens

for _m in (sys.modules[__name__], cparse, tokens):
    cloudpickle.register_pickle_by_value(_m)  # executors need not have the package installed


def _rows(*fields: tuple[str, str]) -> T.ArrayType:
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "b": T.BooleanType()}
    return T.ArrayType(T.StructType([T.StructField(n, kinds[k]) for n, k in fields]))


NODES = _rows(("idx", "i"), ("kind", "s"), ("text", "s"), ("start_line", "i"), ("start_col", "i"), ("end_line", "i"), ("start", "i"), ("end", "i"), ("parent", "i"), ("depth", "i"), ("leaf", "b"))
BLOCKS = _rows(("block", "i"), ("start_line", "i"), ("end_line", "i"), ("kind", "s"), ("label", "s"), ("ipdom", "i"))
EDGES = _rows(("src", "i"), ("dst", "i"), ("kind", "s"))
ACCESSES = _rows(("idx", "i"), ("var", "s"), ("line", "i"), ("pos", "i"), ("kind", "s"), ("context", "s"))
GRAPH = T.StructType([T.StructField("blocks", BLOCKS), T.StructField("edges", EDGES), T.StructField("accesses", ACCESSES)])


def _graph(code: str, root: cparse.Node | None = None) -> dict:
    root = cparse.parse(code) if root is None else root
    flow, found = cparse.control_flow(code, root), cparse.accesses(code, root)
    ipdom = cparse.post_dominators(flow)
    return {"blocks": [(k, *b, ipdom[k]) for k, b in enumerate(flow.blocks)], "edges": list(flow.edges), "accesses": [(k, *x) for k, x in enumerate(found)]}


@F.pandas_udf(NODES)
def c_parse(code: pd.Series) -> pd.Series:
    """The nodes of the tree of each text, in preorder."""
    return code.map(lambda x: cparse.nodes(x or ""))


@F.pandas_udf(GRAPH)
def c_graph(code: pd.Series) -> pd.DataFrame:
    """blocks and edges of the control flow, accesses of variables."""
    return pd.DataFrame([_graph(x or "") for x in code], columns=["blocks", "edges", "accesses"])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def c_slice(code: pd.Series, criteria: pd.Series, kind: pd.Series) -> pd.Series:
    """The lines of a backward, forward or both-way slice."""
    return pd.Series([cparse.graph_slice(c or "", [int(x) for x in l], k) for c, l, k in zip(code, criteria, kind, strict=True)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _calls(code: pd.Series) -> pd.Series:
    return code.map(lambda x: cparse.calls(x or ""))


@F.pandas_udf(_rows(("line", "i"), ("n_nodes", "i"), ("smallest", "s")))
def _nodes_over(code: pd.Series, lines: pd.Series) -> pd.Series:
    return pd.Series([cparse.nodes_over(c or "", [int(x) for x in l] if l is not None else []) for c, l in zip(code, lines, strict=True)])


@F.pandas_udf(_rows(("src", "i"), ("dst", "i"), ("kind", "s")))
def _data_edges(code: pd.Series) -> pd.Series:
    return code.map(lambda x: cparse.data_edges(cparse.accesses(x or "", cparse.parse(x or ""))))


def _counted(code: str) -> dict:
    root = cparse.parse(code)
    kinds = [n.kind for n, _, _ in cparse.walk(root) if n.kind == "subscript_expression" or (n.kind == "pointer_expression" and code[n.start] == "*")] if root is not None else []
    return _graph(code, root) | {"derefs": kinds.count("pointer_expression"), "subscripts": kinds.count("subscript_expression")}


@F.pandas_udf(T.StructType([*GRAPH.fields, T.StructField("derefs", T.LongType()), T.StructField("subscripts", T.LongType())]))
def _counted_graph(code: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_counted(x or "") for x in code], columns=["blocks", "edges", "accesses", "derefs", "subscripts"])


def dependency_slices(sinks: list[str], memory: list[str], most: int = 6) -> Column:
    """An Arrow function from texts to their (slice, kind, seed, lines)."""
    first, second = frozenset(sinks), frozenset(memory)

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("slice", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("seed", T.IntegerType()), T.StructField("lines", T.ArrayType(T.IntegerType()))])))
    def slices(code: pd.Series) -> pd.Series:
        return code.map(lambda x: cparse.dependency_slices(x or "", first, second, most))

    return slices.asNondeterministic()


# These parse a text once for a whole query; not deterministic, so that no filter on their result runs them a second time.
c_calls, c_nodes_over, c_data_edges, c_counted_graph = (f.asNondeterministic() for f in (_calls, _nodes_over, _data_edges, _counted_graph))


@F.pandas_udf(T.StringType())
def c_blanked(code: pd.Series) -> pd.Series:
    """Texts with their comments as spaces."""
    return code.map(lambda x: cparse.blanked(x or ""))


def register(spark: SparkSession) -> None:
    """The SQL names c_tokens, c_parse, c_graph, c_slice and c_blanked."""
    from . import places

    for name, f in {"c_tokens": places.c_tokens, "c_parse": c_parse, "c_graph": c_graph, "c_slice": c_slice, "c_blanked": c_blanked}.items():
        spark.udf.register(name, f)


def definitions_of_uses(accesses: DataFrame) -> DataFrame:
    """id, src, dst, kind: def-use by a running maximum (no self-join), ptr-flow by a join within a function."""
    is_def = F.col("kind").isin("def", "param")
    before = Window.partitionBy("id", "var").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)  # idx is in order of places
    held = accesses.withColumn("d", F.max(F.when(is_def, F.col("idx"))).over(before))
    uses = held.where(~is_def & F.col("d").isNotNull()).select("id", F.col("d").alias("src"), F.col("idx").alias("dst"), F.lit("def-use").alias("kind"))
    a = accesses.where("kind = 'address'").select("id", F.col("idx").alias("src"), F.col("line").alias("la"))
    b = accesses.where("kind = 'deref'").select("id", F.col("idx").alias("dst"), F.col("line").alias("lb"))
    return uses.unionByName(a.join(b, "id").where("lb > la").select("id", "src", "dst", F.lit("ptr-flow").alias("kind")))


def flattened(df: DataFrame, column: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.inline(column))


def criteria(pattern: str, code: str = "code") -> Column:
    """The lines (from 1) that a pattern matches."""
    return F.expr(f"filter(transform(split({code}, '\\n'), (t, i) -> IF(t RLIKE '{pattern}', i + 1, 0)), x -> x > 0)")
