"""Exact duplicates by Patricia tries: equal texts end at one node, which knows the smallest identifier.

Each map task inserts its texts into a trie of its own, so a text leaves the task once however many rows have it.
These entries meet in partitions by length and content hash, one trie each, which compares whole byte strings. A
trie that grows beyond its bound spills a subtree: in a map task as entries, in a partition as entries of a next
round over finer partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipflow.llm import text as T
from shipflow.session import stored

TRIE_BYTES = 64 * 1024 * 1024  # of edges and nodes that a task holds
PARTITION_BYTES = 32 * 1024 * 1024  # of texts that are meant to meet in one partition
NODE_BYTES = 300
OUT_BYTES = 4 * 1024 * 1024  # of texts in one batch of results
SPACES = bytes(np.flatnonzero(T.IS_SPACE).tolist())


class Node:
    """The end of an edge; `spilled` if texts below it have left the trie before."""

    __slots__ = ("edge", "children", "value", "spilled")

    def __init__(self, edge: bytes):
        self.edge, self.children, self.value, self.spilled = edge, None, None, False

    def put(self, child: Node) -> None:
        if self.children is None:
            self.children = {}
        self.children[child.edge[0]] = child


def _shared(edge: bytes, key: bytes, at: int) -> int:
    """How many first bytes of the edge the key has from `at` on."""
    limit = min(len(edge), len(key) - at)
    for i in range(min(limit, 16)):
        if edge[i] != key[at + i]:
            return i
    different = np.frombuffer(edge, np.uint8, limit) != np.frombuffer(key, np.uint8, limit, at)
    first = int(different.argmax()) if limit else 0
    return first if limit and different[first] else limit


class Trie:
    """A compressed radix trie over byte strings."""

    def __init__(self):
        self.root = Node(b"")
        self.held = 0

    def node(self, key: bytes) -> Node:
        """The node where the key ends; made if it is not there."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at]) if node.children else None
            if child is None:
                child = Node(key[at:])
                node.put(child)
                self.held += len(child.edge) + NODE_BYTES
                return child
            if not key.startswith(child.edge, at):
                same = _shared(child.edge, key, at)
                middle = Node(child.edge[:same])
                child.edge = child.edge[same:]
                middle.put(child)
                node.put(middle)
                self.held += NODE_BYTES
                child = middle
            node, at = child, at + len(child.edge)
        return node

    def _sizes(self) -> tuple[dict[int, int], set[int]]:
        """Bytes of each subtree, by the identity of its first node, and which of them hold texts."""
        order, sizes, held = [self.root], {}, set()
        for node in order:
            order.extend(node.children.values() if node.children else ())
        for node in reversed(order):
            below = node.children.values() if node.children else ()
            sizes[id(node)] = len(node.edge) + NODE_BYTES + sum(sizes[id(child)] for child in below)
            if node.value is not None or any(id(child) in held for child in below):
                held.add(id(node))
        return sizes, held

    def spill(self, bound: int) -> Iterator[tuple[bytes, object]]:
        """Take subtrees out until at most `bound` bytes are left: (key, value) of their texts.

        The heaviest path is followed down to a subtree that is no more than needed, so that most stays. A stub with
        the first byte of its edge remains, and tells that the trie no longer knows all that goes on so.
        """
        while self.held > bound:
            sizes, with_texts = self._sizes()
            path = [self.root]
            while len(path) == 1 or sizes[id(path[-1])] > self.held - bound:
                below = [child for child in (path[-1].children or {}).values() if id(child) in with_texts]
                if not below:
                    break
                path.append(max(below, key=lambda child: sizes[id(child)]))
            if len(path) == 1:
                return
            heavy = path.pop()
            yield from self._texts(heavy, b"".join(node.edge for node in path))
            self._stub(path, heavy, sizes[id(heavy)])

    def _stub(self, path: list[Node], gone: Node, size: int) -> None:
        """Replace the subtree that has left by a stub, and nodes above that hold nothing but stubs by one stub."""
        while True:
            stub = Node(gone.edge[:1])
            stub.spilled = True
            path[-1].put(stub)
            self.held -= size - 1 - NODE_BYTES
            gone = path.pop()
            held = [child for child in gone.children.values() if child.children or child.value is not None or not child.spilled]
            if not path or held or gone.value is not None:
                return
            size = len(gone.edge) + NODE_BYTES + len(gone.children) * (1 + NODE_BYTES)

    @staticmethod
    def _texts(node: Node, prefix: bytes) -> Iterator[tuple[bytes, object]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            key = prefix + node.edge
            if node.value is not None:
                yield key, node.value
            stack.extend((child, key) for child in node.children.values()) if node.children else None

    def texts(self) -> Iterator[tuple[bytes, object, bool]]:
        """(key, value, whether the like may have been spilled) of all texts that are in the trie."""
        stack = [(self.root, b"", False)]
        while stack:
            node, prefix, spilled = stack.pop()
            key, spilled = prefix + node.edge, spilled or node.spilled
            if node.value is not None:
                yield key, node.value, spilled
            stack.extend((child, key, spilled) for child in node.children.values()) if node.children else None


def normalised(text: bytes) -> bytes:
    """The text with one blank for each run of white space, at its ends too."""
    middle = b" ".join(text.split())
    if not middle:
        return b" " if text else b""
    return (b" " if text[0] in SPACES else b"") + middle + (b" " if text[-1] in SPACES else b"")


class Owner:
    """What a terminal node holds: least (id, row), rows, and the entries that stand for them. Null ids come last."""

    __slots__ = ("least", "rows", "entries")

    def __init__(self, entries: list[int]):
        self.least, self.rows, self.entries = None, 0, entries

    def add(self, doc_id, row: int, rows: int = 1) -> None:
        key = (doc_id is None, doc_id if doc_id is not None else 0, row)
        if self.least is None or key < self.least:
            self.least = key
        self.rows += rows

    @property
    def doc_id(self):
        return None if self.least[0] else self.least[1]


class _Out:
    """Rows of results, handed out in batches of bounded bytes."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, size: int, **values) -> None:
        self.rows.append(values)
        self.size += size + 100

    def batches(self, least: int = OUT_BYTES) -> Iterator[pa.RecordBatch]:
        if self.rows and self.size >= least:
            yield pa.RecordBatch.from_pylist(self.rows, self.schema)
            self.rows, self.size = [], 0


def _local(bound: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row its entry and the digest of its text; for each entry its text, its least id and its rows.

    Rows of entries have `n`. Numbers of rows and entries begin with the number of the task.
    """
    first = TaskContext.get().partitionId() << 36
    trie, n_rows, n_entries, out = Trie(), 0, 0, None

    def entry(key: bytes, owner: Owner) -> None:
        out.add(len(key), doc_id=owner.doc_id, row=owner.least[2], entry=owner.entries[0], n=owner.rows, text=key,
                length=len(key), content=xxhash.xxh64_intdigest(key) - 2**63)

    for batch in batches:
        out = out or _Out(pa.schema([
            ("doc_id", batch.schema.field("doc_id").type), ("row", pa.int64()), ("entry", pa.int64()), ("text_sha256", pa.string()),
            ("n", pa.int64()), ("length", pa.int64()), ("content", pa.int64()), ("text", pa.binary()),
        ]))
        bounds, data = T.text_bytes(batch["text"])
        for doc_id, begin, end in zip(batch["doc_id"].to_pylist(), bounds, bounds[1:]):
            key = normalised(data[begin:end].tobytes())
            node, row = trie.node(key), first + n_rows
            n_rows += 1
            if node.value is None:
                node.value = Owner([first + n_entries])
                n_entries += 1
            node.value.add(doc_id, row)
            bound = max(bound, 3 * (len(key) + NODE_BYTES))  # one text is always held
            out.add(100, doc_id=doc_id, row=row, entry=node.value.entries[0], text_sha256=hashlib.sha256(key).hexdigest())
            if trie.held > bound:
                for spilled, owner in trie.spill(bound // 2):
                    entry(spilled, owner)
                    yield from out.batches()
            yield from out.batches()
    for key, owner, _ in trie.texts():
        entry(key, owner)
        yield from out.batches()
    if out:
        yield from out.batches(0)


def _meet(bound: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of one partition by their texts: (entry, keep_id, keep_row, group_size) of those that are complete.

    Texts that left the trie, and those that came after their like had left, are rows with a text again.
    """
    trie, out = Trie(), None

    def again(key: bytes, owner: Owner) -> None:
        out.add(len(key) + 8 * len(owner.entries), keep_id=owner.doc_id, keep_row=owner.least[2], group_size=owner.rows,
                entries=owner.entries, text=key)

    for batch in batches:
        out = out or _Out(pa.schema([
            ("entry", pa.int64()), ("keep_id", batch.schema.field("keep_id").type), ("keep_row", pa.int64()),
            ("group_size", pa.int64()), ("entries", pa.list_(pa.int64())), ("text", pa.binary()),
        ]))
        for i in range(batch.num_rows):
            key = batch["text"][i].as_py()
            node = trie.node(key)
            if node.value is None:
                node.value = Owner([])
            node.value.entries.extend(batch["entries"][i].as_py())
            node.value.add(batch["keep_id"][i].as_py(), batch["keep_row"][i].as_py(), batch["group_size"][i].as_py())
            bound = max(bound, 3 * (len(key) + NODE_BYTES))
            if trie.held > bound:
                for spilled, owner in trie.spill(bound // 2):
                    again(spilled, owner)
                    yield from out.batches()
    for key, owner, spilled in trie.texts():
        if spilled:
            again(key, owner)
        else:
            for entry in owner.entries:
                out.add(0, entry=entry, keep_id=owner.doc_id, keep_row=owner.least[2], group_size=owner.rows)
                yield from out.batches()
        yield from out.batches()
    if out:
        yield from out.batches(0)


def owners(entries: DataFrame, id_type: str, trie_bytes: int, partition_bytes: int) -> DataFrame:
    """entry, keep_id, keep_row, group_size for entries (keep_id, keep_row, group_size, entries, text, length, content)."""
    spark = entries.sparkSession
    schema = f"entry long, keep_id {id_type}, keep_row long, group_size long, entries array<long>, text binary"
    columns = ["keep_id", "keep_row", "group_size", "entries", "text"]
    done, left, keys, turn = None, entries, ["length", "content"], 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        size = left.agg(F.sum(F.octet_length("text") + F.lit(NODE_BYTES))).first()[0] or 0
        parts = max(least, -(-size * (turn + 1) // partition_bytes))
        met = left.repartition(parts, *keys).select(*columns).mapInArrow(partial(_meet, trie_bytes), schema)
        met = stored(met, "owners", compression="zstd")
        found = met.filter(F.col("entry").isNotNull()).select("entry", "keep_id", "keep_row", "group_size")
        done = found if done is None else done.unionByName(found)
        left, turn = met.filter(F.col("entry").isNull()), turn + 1
        if left.select("keep_row").isEmpty():
            return done
        keys = [F.xxhash64(F.lit(turn), "text")]


def exact_dedup(docs: DataFrame, trie_bytes: int = TRIE_BYTES, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row per row of docs.

    Texts are equal if they are after each run of the six ASCII white-space characters became one blank; a null
    text is empty, and a text of white space only is one blank, which the empty text is not. Of equal texts one row
    stays, that with the smallest doc_id; null ids come last, and of repeated rows with that id one stays. A text of
    any length is compared as a whole. Other columns are ignored.
    """
    frame = T.columns_of(docs, "doc_id", "text")
    id_type = frame.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, row long, entry long, text_sha256 string, n long, length long, content long, text binary"
    with T.text_batches(docs.sparkSession):
        local = stored(frame.mapInArrow(partial(_local, trie_bytes), schema), "texts", compression="zstd")
        entries = local.filter(F.col("n").isNotNull()).select(
            F.col("doc_id").alias("keep_id"),
            F.col("row").alias("keep_row"),
            F.col("n").alias("group_size"),
            F.array("entry").alias("entries"),
            "text",
            "length",
            "content",
        )
        kept = owners(entries, id_type, trie_bytes, partition_bytes)
    rows = local.filter(F.col("n").isNull()).select("doc_id", "row", "entry", "text_sha256")
    return rows.join(kept, "entry").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )
