"""Chain analysis: assignments in nested blocks, references resolved outwards, by one pass over a document.

A reference takes what an earlier assignment of the same block gave its name; else it looks outwards in the snapshot of
the enclosing block's names at the point where the block starts. The result is a number or broken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import grammars
from ..operators import navigate, parse


def assignments(nodes: DataFrame, caps: DataFrame) -> DataFrame:
    """doc_id, key_id (node of the key), block_id, ord (order of the statement), key, number or ref."""
    tokens = caps.where(F.col("kind") == "token").select("doc_id", "node_id", "string")
    stmt = nodes.where(F.col("name") == "Assignment").select("doc_id", F.col("node_id").alias("stmt"), F.col("parent_id").alias("block_id"), F.col("pre").alias("ord"))
    part = nodes.where(F.col("name").isin("Key", "Number", "Reference")).select("doc_id", "node_id", "name", F.col("parent_id").alias("stmt"))
    part = part.join(tokens, ["doc_id", "node_id"], "left")
    one = lambda rule, c: F.max(F.when(F.col("name") == rule, F.col(c)))
    parts = part.groupBy("doc_id", "stmt").agg(one("Key", "node_id").alias("key_id"), one("Key", "string").alias("key"), one("Number", "string").alias("number"), one("Reference", "string").alias("ref"))
    return stmt.join(parts, ["doc_id", "stmt"]).where(F.col("key").isNotNull())


class Names:
    """The names of the blocks that are open, while a document's blocks and assignments come in order. A name has its
    values from the outermost block inwards, so that a look-up is one step, whatever the depth."""

    def __init__(self) -> None:
        self.blocks: list[tuple[int, list[str]]] = []
        self.values: dict[str, list[tuple[int, str | None]]] = {}

    def _inside(self, block_id: int | None) -> None:
        """Close the blocks that don't hold what comes."""
        while self.blocks and self.blocks[-1][0] != block_id:
            for name in self.blocks.pop()[1]:
                self.values[name].pop()

    def enter(self, block_id: int, outer: int | None) -> None:
        self._inside(outer)
        self.blocks.append((block_id, []))

    def assign(self, block_id: int, key: str, number: str | None, ref: str | None) -> str | None:
        """The value of the assignment: a number's text, or null."""
        self._inside(block_id)
        seen = self.values.get(ref) if number is None else None
        value = seen[-1][1] if seen else number
        at = len(self.blocks)
        own = self.values.setdefault(key, [])
        if own and own[-1][0] == at:
            own[-1] = (at, value)
        elif at:
            own.append((at, value))
            self.blocks[-1][1].append(key)
        return value


RESULT = "key_id int, key string, value string"


def _status(df: DataFrame) -> DataFrame:
    return df.withColumn("status", F.when(F.col("value").isNotNull(), "number").otherwise("broken"))


def resolve(nodes: DataFrame, caps: DataFrame) -> DataFrame:
    """Per key: doc_id, key_id, key, value (a number's text or null), status (number or broken).

    Blocks and assignments of a document go by once, in order of entry: what an earlier assignment gave a name is known
    when a reference to it comes. Work grows with the statements, memory with the names of the blocks that are open."""
    a = assignments(nodes, caps).select("doc_id", F.col("ord").alias("pre"), F.col("block_id").alias("up"), "key_id", "key", "number", "ref")
    b = nodes.where(F.col("name") == "Block").select("doc_id", "pre", F.col("parent_id").alias("up"), F.col("node_id").alias("block_id"))
    rows = a.unionByName(b, allowMissingColumns=True).select("doc_id", "up", "block_id", "key_id", "key", "number", "ref", "pre")

    def start():
        names = Names()

        def step(up, block_id, key_id, key, number, ref, _):
            if key_id is None:
                names.enter(block_id, up)
                return []
            return [(key_id, key, names.assign(up, key, number, ref))]

        return step

    return _status(navigate.sweep(rows, ["pre"], StructType.fromDDL(f"doc_id long, {RESULT}"), start))


def resolve_documents(docs: DataFrame) -> DataFrame:
    """The same from texts (doc_id, text), parsed and resolved in one kernel."""
    return _status(parse.fold(docs, grammars.chain_syntax(), _plan, RESULT))


def _plan(rows: list[dict]):
    """Blocks and assignments of a tree in order: (block, outer), or (block, key's node, tokens of key, number, ref)."""
    nodes = sorted((r for r in rows if r["kind"] == "node" and r["pre"] is not None), key=lambda r: r["pre"])
    token = {r["id"]: r["ref_id"] for r in rows if r["kind"] == "cap" and r["ref_kind"] == "token"}
    parts: dict[tuple, int] = {(r["parent_id"], r["name"]): r["id"] for r in nodes}
    steps: list[tuple] = []
    for r in nodes:
        if r["name"] == "Block":
            steps.append((r["id"], r["parent_id"]))
        elif r["name"] == "Assignment":
            key, number, ref = (parts.get((r["id"], x)) for x in ("Key", "Number", "Reference"))
            if token.get(key) is not None:
                steps.append((r["parent_id"], key, token[key], token.get(number), token.get(ref)))

    def run(string):
        names, out = Names(), []
        for s in steps:
            if len(s) == 2:
                names.enter(*s)
            else:
                block, key_id, key, number, ref = s
                key = string(key)
                out.append((key_id, key, names.assign(block, key, None if number is None else string(number), None if ref is None else string(ref))))
        return out

    return run


def latest_by_ordinal(a: DataFrame) -> DataFrame:
    """Last assignment per block and key (the block's final namespace)."""
    by = Window.partitionBy("doc_id", "block_id", "key").orderBy(F.col("ord").desc())
    return a.withColumn("r", F.row_number().over(by)).where("r = 1").drop("r")
