"""Cross-document references: module::key chains over all documents, with cycle detection.

Definitions form a functional graph, for each has one target at most. Pointer doubling squares the step each round, so
that a chain of n definitions takes log2(n) joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def definitions(nodes: DataFrame, caps: DataFrame, names: DataFrame) -> DataFrame:
    """Well-formed definitions, the last of each key: module, key, number or (ref_module, ref_key). ``names`` maps doc_id
    to the module's name (name)."""
    tok = caps.where((F.col("kind") == "token")).groupBy("doc_id", "node_id").pivot("key", ["key", "module", "value"]).agg(F.first("string"))
    d = nodes.where(F.col("name") == "Def").select("doc_id", F.col("node_id").alias("def_id"), "start")
    own = tok.select("doc_id", F.col("node_id").alias("def_id"), F.col("key"))
    val = nodes.where(F.col("name").isin("Number", "Reference")).select("doc_id", "node_id", F.col("parent_id").alias("def_id")).join(tok, ["doc_id", "node_id"])
    val = val.select("doc_id", "def_id", F.col("value").alias("number"), F.col("module").alias("ref_module"), F.col("key").alias("ref_key"))
    out = d.join(own, ["doc_id", "def_id"]).join(val, ["doc_id", "def_id"])
    out = out.where(F.col("key").isNotNull() & (F.col("number").isNotNull() | (F.col("ref_module").isNotNull() & F.col("ref_key").isNotNull())))
    out = out.join(names.select("doc_id", F.col("name").alias("module")), "doc_id")
    last = Window.partitionBy("module", "key").orderBy(F.col("doc_id").desc(), F.col("def_id").desc())
    return out.withColumn("r", F.row_number().over(last)).where("r = 1").select("module", "key", "number", "ref_module", "ref_key")


def resolve(defs: DataFrame) -> DataFrame:
    """module, key, status (number, unresolved, recursive) and value."""
    node = lambda m, k: F.concat_ws("::", m, k)
    start = defs.select("module", "key", node(F.col("module"), F.col("key")).alias("id"), "number", F.when(F.col("number").isNull(), node(F.col("ref_module"), F.col("ref_key"))).alias("to"))
    # A definition is done with a number, unresolved (dead) or recursive, or on the way to another one (to). Coming back
    # to itself is recursive at once; what leads into a cycle without being on it is found when more steps are taken than
    # there are definitions.
    loops = F.coalesce(F.col("to") == F.col("id"), F.lit(False))
    state = cut(start.select("id", "number", F.when(~loops, F.col("to")).alias("to"), F.lit(False).alias("dead"), loops.alias("loop")))
    steps, most = 1, start.count()
    while steps <= most:
        on_way = state.where(F.col("to").isNotNull())
        if not on_way.limit(1).count():
            break
        t = state.select(F.col("id").alias("t_id"), F.col("number").alias("t_number"), F.col("to").alias("t_to"), F.col("dead").alias("t_dead"), F.col("loop").alias("t_loop"))
        met = on_way.join(t, F.col("to") == F.col("t_id"), "left")
        back = F.coalesce(F.col("t_loop"), F.lit(False)) | F.coalesce(F.col("t_to") == F.col("id"), F.lit(False))
        moved = met.select("id", F.col("t_number").alias("number"), F.when(~back, F.col("t_to")).alias("to"), (F.col("t_id").isNull() | F.col("t_dead")).alias("dead"), back.alias("loop"))
        state = cut(state.where(F.col("to").isNull()).unionByName(moved))
        steps *= 2
    status = F.when(F.col("s.number").isNotNull(), "number").when(F.col("s.dead"), "unresolved").otherwise("recursive")
    return start.alias("a").join(state.alias("s"), "id").select("module", "key", status.alias("status"), F.col("s.number").alias("value"))
