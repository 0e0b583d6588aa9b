"""Merkle manifest of a dataset, and folding of changed rows through it.

Every row is a leaf, the rows of one part (a language, say) are a tree in the
order of their ids, and the roots of the parts are the leaves of a last tree.
A parent is the digest of up to ``FAN`` children's digests as text, fed one by
one to a running hash.  It retains a copy of that hash's state before each
child slot, so that a changed child costs neither its left siblings nor a
second pass: the fold resumes the copy of its slot with the replacement and
the right siblings alone (``Parent``).

Trees are built in rounds.  A round deals the nodes of a tree in runs of
``FAN ** STEPS`` consecutive ones, one group each, and climbs ``STEPS`` levels
there; what it leaves, one node for a run, is the table of the next round.
Folding goes down the same rounds: each run gets the path above it (its
siblings and slot at each level) and hands every node of its own the path
above that.  Rows are shuffled twice, digests only, and no group holds more
than a run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from scorewright.llm.rows import named
from scorewright.sources.staging import staged

FAN = 8
#: Levels that one round climbs: runs of 4096 nodes.
STEPS = 4

_PATH = "array<struct<slot:int,run:array<string>>>"
_PATH_ARROW = pa.list_(pa.struct([("slot", pa.int32()), ("run", pa.list_(pa.string()))]))


class Parent:
    """A node of the tree: its children's digests, its own, and the state of
    its hash before each child slot."""

    def __init__(self, children: list[str]) -> None:
        state = hashlib.sha256()
        self.before = []
        for child in children:
            self.before.append(state.copy())
            state.update(child.encode())
        self.children = children
        self.digest = state.hexdigest()
        self.right = ["".join(children[k + 1 :]).encode() for k in range(len(children))]

    def fold(self, slot: int, digest: str) -> str:
        """The parent's digest if ``digest`` stood in the slot."""
        state = self.before[slot].copy()
        state.update(digest.encode())
        state.update(self.right[slot])
        return state.hexdigest()

    def siblings(self, slot: int) -> str:
        return "".join(self.children[:slot] + self.children[slot + 1 :])


def climb(digests: list[str], n: int, steps: int) -> list[list[Parent]]:
    """Levels of parents above a run of the ``n`` nodes of a tree, ``steps``
    at most, while the tree has more than one node; its last parent of a level
    may have fewer children, even one."""
    levels: list[list[Parent]] = []
    while n > 1 and len(levels) < steps:
        levels.append([Parent(digests[k : k + FAN]) for k in range(0, len(digests), FAN)])
        digests, n = [p.digest for p in levels[-1]], -(-n // FAN)
    return levels


def leaf_digest(columns: dict[str, Column] | list[str]) -> Column:
    """SHA-256 (hex) of the columns' values in order: ``-`` for null, else
    the UTF-8 byte count, ``:`` and the value."""
    columns = columns if isinstance(columns, dict) else {c: named(c) for c in columns}
    texts = [c.cast("string") for c in columns.values()]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def ordered(rows: DataFrame, by: list[str], tree: str | None, name: str) -> DataFrame:
    """``rows``, staged, with ``pos``: their place from 0 in the order of
    ``by`` (ascending, nulls first), apart for each value of ``tree``, the
    first of ``by``; ``n`` is how many there are.

    The rows are sorted by range, so no task sees all of a tree; rows equal in
    ``by`` may stand in either order, and many of them in several ranges.
    """
    tie = rows.withColumn("_tie", F.monotonically_increasing_id())
    sorted_ = tie.repartitionByRange(*by, "_tie").sortWithinPartitions(*by, "_tie").drop("_tie")
    found = staged(sorted_.withColumn("_seq", F.monotonically_increasing_id()), name)
    found = found.withColumns({"_part": F.shiftright("_seq", 33), "_tree": F.col(tree) if tree else F.lit(0)})
    parts = found.groupBy("_tree", "_part").agg(F.min("_seq").alias("_low"), F.count("*").alias("_n"))
    whole = Window.partitionBy("_tree")  # a row for each range at most
    upto = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumns({"_before": F.coalesce(upto, F.lit(0)), "n": F.sum("_n").over(whole)})
    parts = parts.select(F.col("_tree").alias("_t"), F.col("_part").alias("_p"), F.col("_low"), "_before", "n")
    both = found.join(parts, F.col("_tree").eqNullSafe(F.col("_t")) & (F.col("_part") == F.col("_p")))
    return both.withColumn("pos", F.col("_before") + F.col("_seq") - F.col("_low")).drop("_seq", "_part", "_tree", "_t", "_p", "_low", "_before")


def _runs(nodes: DataFrame, steps: int) -> GroupedData:
    """Nodes in runs that climb ``steps`` levels to one node."""
    return nodes.withColumn("up", F.expr(f"pos div {FAN**steps}")).groupBy("tree", "up")


def rounds_of(nodes: DataFrame, most: int, steps: int, name: str) -> list[DataFrame]:
    """Tables ``tree, pos, n, digest`` of every round, the last with one node
    (``pos`` 0) for each tree; ``n`` is the nodes of the tree in that round,
    ``most`` the size of the largest tree."""
    fields = pa.schema([("tree", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])

    def climbed(key: tuple, run: pa.Table) -> pa.Table:
        digests, n = run.sort_by("pos")["digest"].to_pylist(), run["n"][0].as_py()
        levels = climb(digests, n, steps)
        root = levels[-1][0].digest if levels else digests[0]
        return pa.table({"tree": [key[0].as_py()], "pos": [key[1].as_py()], "n": [-(-n // FAN**steps)], "digest": [root]}, schema=fields)

    found = [nodes]
    while len(found) == 1 or most > 1:
        runs = _runs(found[-1].select("tree", "pos", "n", "digest"), steps)
        found.append(staged(runs.applyInArrow(climbed, "tree long, pos long, n long, digest string"), name))
        most = -(-most // FAN**steps)
    return found


def _folder(finish: Callable, fields: list[tuple[str, pa.DataType]], steps: int) -> Callable:
    """A function for cogrouped runs: nodes of one run, and the path above it."""

    def fold(key: tuple, nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("pos")
        levels = climb(nodes["digest"].to_pylist(), nodes["n"][0].as_py(), steps)
        path = above["path"][0].as_py() if above.num_rows else []
        return pa.table(finish(key[0].as_py(), nodes, levels, path), schema=pa.schema(fields))

    return fold


def _steps(levels: list[list[Parent]], at: int) -> list[tuple[Parent, int]]:
    """Parents and slots from the node at a place of the run upwards."""
    found = []
    for level in levels:
        found.append((level[at // FAN], at % FAN))
        at //= FAN
    return found


def _paths(tree: int, nodes: pa.Table, levels: list[list[Parent]], path: list[dict]) -> dict:
    own = [[{"slot": slot, "run": p.children} for p, slot in _steps(levels, k)] for k in range(nodes.num_rows)]
    return {"tree": [tree] * nodes.num_rows, "pos": nodes["pos"], "path": pa.array([x + path for x in own], _PATH_ARROW)}


def _folds(tree: int, nodes: pa.Table, levels: list[list[Parent]], path: list[dict]) -> dict:
    above = [(Parent(x["run"]), x["slot"]) for x in path]  # retained once for the run
    tail = "".join(p.siblings(slot) for p, slot in above).encode()
    proofs, folded, made = [], [], nodes["replaced"].to_pylist()
    for k, leaf in enumerate(nodes["digest"].to_pylist()):
        own, now = _steps(levels, k), made[k] or leaf
        proof = hashlib.sha256("".join(p.siblings(slot) for p, slot in own).encode())
        proof.update(tail)
        for p, slot in own + above:
            now = p.fold(slot, now)
        proofs.append(proof.hexdigest())
        folded.append(now)
    return {"id": nodes["id"], "tree": [tree] * nodes.num_rows, "leaf": nodes["digest"], "proof_sha256": proofs, "folded_root": folded}


def _over(rounds: list[DataFrame], path: DataFrame, steps: int, finish: Callable, fields: str, arrow: list) -> DataFrame:
    """From the path above each tree (``tree, pos, path``) down to the first round."""
    for k in reversed(range(len(rounds) - 1)):
        last = k == 0
        above = path.select("tree", F.col("pos").alias("up"), "path").groupBy("tree", "up")
        fold = _folder(finish if last else _paths, arrow if last else _PATH_FIELDS, steps)
        path = _runs(rounds[k], steps).cogroup(above).applyInArrow(fold, fields if last else f"tree long, pos long, path {_PATH}")
    return path


_PATH_FIELDS = [("tree", pa.int64()), ("pos", pa.int64()), ("path", _PATH_ARROW)]
_FOLD_FIELDS = [("id", pa.int64()), ("tree", pa.int64()), ("leaf", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())]


class Manifest:
    """The Merkle tree over all rows of ``docs``.

    ``columns`` are the leaf's inputs in order, ``id_col`` (a long) orders the
    leaves of a part and ``part_col`` names the part.  ``replaced`` says what
    some columns would hold after a change, and ``where`` in which rows.

    ``parts`` is the manifest: ``part, size, tree, subroot``, ``root`` the
    digest over all parts (None if there are no rows).  ``folds()`` returns a
    row for every row of ``docs``.  Nulls stand for ``-`` in a leaf; rows with a null
    id come first, rows of a null part are a part of their own, before the
    others.  Rows of one id stand in the order of their digests, equal rows in
    any.  Other columns take no part, whatever their names.  An empty table
    has no parts and no root.
    """

    def __init__(
        self, docs: DataFrame, columns: list[str], id_col: str = "doc_id", part_col: str = "lang", replaced: dict[str, Column] | None = None, where: Column | None = None, steps: int = STEPS
    ) -> None:
        changed = leaf_digest({c: (replaced or {}).get(c, named(c)) for c in columns}) if replaced else F.lit(None).cast("string")
        rows = docs.select(
            named(part_col).cast("string").alias("part"), named(id_col).cast("long").alias("id"), leaf_digest(columns).alias("digest"),
            (F.when(where, changed) if where is not None else changed).alias("replaced"),
        )
        leaves = ordered(rows, ["part", "id", "digest"], "part", "leaves")
        sizes = ordered(leaves.groupBy("part").agg(F.any_value("n").alias("size")), ["part"], None, "parts")
        sizes = sizes.select("part", "size", F.col("pos").alias("tree"), "n")
        most = sizes.agg(F.coalesce(F.max("size"), F.lit(0)).alias("size"), F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()
        trees = sizes.select(F.col("part").alias("_part"), "tree")
        self._steps = steps
        self.leaves = leaves.join(trees, F.col("part").eqNullSafe(F.col("_part"))).select("tree", "pos", "n", "id", "digest", "replaced")
        self._rounds = rounds_of(self.leaves, most["size"], steps, "nodes")
        subroots = self._rounds[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(most["n"]).cast("long").alias("n"), "digest")
        self._tops = rounds_of(subroots, most["n"], steps, "tops")
        top = self._tops[-1].first()
        self.root = top["digest"] if top else None
        self.parts = sizes.join(self._rounds[-1].select("tree", F.col("digest").alias("subroot")), "tree").select("part", "size", "tree", "subroot")

    def folds(self) -> DataFrame:
        """``id, leaf, subroot, root, proof_sha256, folded_root, verified``
        of every row: the proof is over the siblings' digests up to the root,
        the folded root comes from the replaced leaf where there is one."""
        start = self._tops[-1].select("tree", "pos", F.array().cast(_PATH).alias("path"))
        paths = _over(self._tops, start, self._steps, _paths, f"tree long, pos long, path {_PATH}", _PATH_FIELDS)
        top = paths.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "path")
        fields = "id long, tree long, leaf string, proof_sha256 string, folded_root string"
        found = _over(self._rounds, top, self._steps, _folds, fields, _FOLD_FIELDS)
        out = found.join(self.parts.select("tree", "subroot"), "tree").withColumn("root", F.lit(self.root))
        return out.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def tampered_folds(docs: DataFrame, columns: list[str], id_col: str = "doc_id", part_col: str = "lang", text_col: str = "text", steps: int = STEPS) -> DataFrame:
    """Folds after lower-casing A-Z of the text in the rows where 3 divides
    the CRC-32 of the decimal id; rows without an id are left alone."""
    hit = F.crc32(named(id_col).cast("string").cast("binary")) % 3 == 0
    lower = F.translate(named(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return Manifest(docs, columns, id_col, part_col, {text_col: lower}, hit, steps).folds()
