"""Entry points and data sinks, by ordered rules over nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .links import first_rule

#: Annotations, names and calls that make a node an entry point or a data sink.
ENTRY_ANNOTATIONS = ("Path", "GET", "POST", "PUT", "DELETE", "PATCH", "RequestMapping", "GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping", "RestController", "Controller", "WebServlet")
ENTRY_PARENTS = ("HttpServlet", "AbstractHttpServlet", "IdentityServlet", "FrameworkServlet")
ENTRY_NAMES = ("Servlet", "Controller", "Endpoint", "Resource")
ENTRY_METHOD_MARKS = ("Mapping", "GET", "POST", "PUT", "DELETE", "Path")
SINK_ANNOTATIONS = ("Repository",)
SINK_NAMES = ("DAO", "DataAccessor", "Repository", "JDBCPersistenceManager", "AbstractDAO", "JdbcTemplate")
SINK_CALLS = ("executeQuery", "executeUpdate", "prepareStatement", "createStatement", "prepareCall")


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return F.coalesce(out, F.lit(False))


def _ids(edges: DataFrame, kind: str, names: tuple[str, ...], flag: str) -> DataFrame:
    return edges.where((F.col("edge_type") == kind) & F.col("dst").isin(*names)).select(F.col("src").alias("id")).distinct().withColumn(flag, F.lit(True))


def _methods(edges: DataFrame, tagged: DataFrame) -> DataFrame:
    return edges.where("edge_type = 'HAS_METHOD'").join(tagged.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().withColumn("owned", F.lit(True))


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, rule): nodes by the first rule that holds: annotation, parent, name; then marked methods of tagged types."""
    above = edges.where("edge_type = 'EXTENDS'").join(nodes.select(F.col("id").alias("dst"), F.col("fqn").alias("above")), "dst").where(_holds(F.col("above"), ENTRY_PARENTS)).select(F.col("src").alias("id")).distinct().withColumn("parent", F.lit(True))
    own = nodes.join(_ids(edges, "ANNOTATED_WITH", ENTRY_ANNOTATIONS, "annotated"), "id", "left").join(above, "id", "left")
    component = F.col("label") == "Component"
    direct = own.select("id", "label", first_rule([("annotation", F.col("annotated")), ("parent", component & F.col("parent")), ("name", component & _holds(F.col("fqn"), ENTRY_NAMES))]).alias("rule")).where("rule is not null")
    marked = F.exists("annotations", lambda a: _holds(a, ENTRY_METHOD_MARKS))
    methods = nodes.where("label = 'LogicUnit'").where(marked).join(_methods(edges, direct.where("label = 'Component'")), "id", "left_semi").join(direct, "id", "left_anti")
    return direct.select("id", "rule").unionByName(methods.select("id", F.lit("method").alias("rule")))


def data_sinks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, rule): types by annotation, name or table use, in that order; their methods; methods that call a database."""
    asks = edges.where("edge_type = 'QUERIES_TABLE'").select(F.col("src").alias("id")).distinct().withColumn("asks", F.lit(True))
    own = nodes.where("label = 'Component'").join(_ids(edges, "ANNOTATED_WITH", SINK_ANNOTATIONS, "annotated"), "id", "left").join(asks, "id", "left")
    direct = own.select("id", first_rule([("annotation", F.col("annotated")), ("name", _holds(F.col("fqn"), SINK_NAMES)), ("table", F.col("asks"))]).alias("rule")).where("rule is not null")
    unit = nodes.where("label = 'LogicUnit'").join(_methods(edges, direct), "id", "left")
    rest = unit.select("id", first_rule([("method", F.col("owned")), ("call", _holds(F.col("body_text"), SINK_CALLS))]).alias("rule")).where("rule is not null")
    return direct.unionByName(rest)


def counts(tagged: DataFrame) -> DataFrame:
    """(rule, n): nodes that each rule was the first to tag."""
    return tagged.groupBy("rule").agg(F.count("*").alias("n"))
