"""Exact duplicates: owners of equal texts, found in Patricia tries.

Texts are dealt out by length and content hash, so equal ones meet in one partition. A task inserts the full byte
strings of its partition into one compressed radix trie: strings branch where they differ, and terminal nodes hold the
identifier that stays and the number of copies. Tasks first do this to the rows they read, so a text with any number of
copies is sent once a task. When the held strings exceed a bound, whole subtrees are written out, the largest first,
until half of it is free. Rows arrive ordered by length and hash, so a string is finished when the next one comes.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes of labels, with NODE_BYTES for each node, that the trie of a task holds at a time.
HELD_BYTES, NODE_BYTES = 48 << 20, 300


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common start of `a` and `b[at:]`, by halving."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[at + low:at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Node:
    __slots__ = ("label", "children", "owner", "copies")

    def __init__(self, label: bytes, owner=None, copies: int = 0):
        self.label, self.children, self.owner, self.copies = label, {}, owner, copies


class PatriciaTrie:
    """Byte strings with the identifier that stays (smallest, or largest) and the number of insertions."""

    def __init__(self, largest: bool = False):
        self.root, self.better, self.held = Node(b""), max if largest else min, 0

    def insert(self, key: bytes, owner, copies: int = 1) -> bool:
        """Whether the string is new."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = Node(key[at:], owner, copies)
                self.held += len(key) - at + NODE_BYTES
                return True
            same = len(child.label) if key.startswith(child.label, at) else _common(child.label, key, at)
            if same < len(child.label):
                upper = Node(child.label[:same])
                upper.children[child.label[same]] = child
                child.label = child.label[same:]
                node.children[key[at]] = upper
                self.held += NODE_BYTES
                child = upper
            node, at = child, at + same
        new = node.copies == 0
        if new or node.owner is None:
            node.owner = owner
        elif owner is not None:
            node.owner = self.better(node.owner, owner)
        node.copies += copies
        return new

    def items(self, root: Node | None = None, before: bytes = b""):
        """(string, owner, copies) of every terminal node of a subtree, where `before` leads to its root."""
        stack = [(root or self.root, before)]
        while stack:
            node, start = stack.pop()
            key = start + node.label
            if node.copies:
                yield key, node.owner, node.copies
            stack.extend((child, key) for child in node.children.values())

    def _sizes(self) -> dict:
        """Held bytes of the subtree of every node."""
        order, sizes = [self.root], {}
        for node in order:
            order.extend(node.children.values())
        for node in reversed(order):
            sizes[id(node)] = len(node.label) + NODE_BYTES + sum(sizes[id(c)] for c in node.children.values())
        return sizes

    def spill(self, most: int):
        """Take out the largest subtrees until `most` bytes are held, each as (its prefix, its items).

        From the root, the way leads into the largest child as long as that alone holds more than has to go.
        """
        sizes = self._sizes()
        while self.held > most and self.root.children:
            path, before = [self.root], b""
            while True:
                child = max(path[-1].children.values(), key=lambda c: sizes[id(c)])
                if sizes[id(child)] <= self.held - most or not child.children:
                    break
                path.append(child)
                before += child.label
            while len(path) > 1 and not path[-1].copies and len(path[-1].children) == 1:
                # A node that leads to nothing else goes too.
                child = path.pop()
                before = before[:len(before) - len(child.label)]
            node, gone = path[-1], sizes[id(child)]
            del node.children[child.label[0]]
            if node is not self.root and not node.copies and len(node.children) == 1:
                # One child is left without a string between: both are one edge again.
                (only,) = node.children.values()
                node.label, node.children, node.owner, node.copies = node.label + only.label, only.children, only.owner, only.copies
                gone += NODE_BYTES
            for up in path:
                sizes[id(up)] -= gone
            self.held -= gone
            yield before, self.items(child, before)


CONTENTS = "content binary, owner long, copies long"
OWNERS = "sha binary, owner long, copies long"


def _tries(largest: bool, final: bool, held_bytes: int):
    """Merge rows (size, hash, content, owner, copies) of equal content; `final` gives digests for contents."""
    names = [c.split()[0] for c in (OWNERS if final else CONTENTS).split(", ")]
    kinds = [pa.binary(), pa.int64(), pa.int64()]

    def written(items):
        rows = []
        for content, owner, copies in items:
            rows.append((hashlib.sha256(content).digest() if final else content, owner, copies))
            if len(rows) == 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def task(batches):
        trie, last = PatriciaTrie(largest), None
        for batch in batches:
            contents = batch.column("content")
            for i, (size, digest, owner, copies) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("size", "hash", "owner", "copies")))):
                if trie.held > held_bytes and (size, digest) != last:
                    for _, items in trie.spill(held_bytes // 2):
                        yield from written(items)
                last = size, digest
                trie.insert(contents[i].as_py(), owner, copies)
        yield from written(trie.items())

    return task


def owners(docs: DataFrame, keep: str = "max", id_col: str = "doc_id", text_col: str = "text", held_bytes: int = HELD_BYTES) -> DataFrame:
    """(sha, owner, copies) of every distinct text: its SHA-256, the id that stays (`keep` min or max), its rows."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.octet_length(text).cast("long").alias("size"), F.xxhash64(text).alias("hash"), text.cast("binary").alias("content"),
        F.col(id_col).cast("long").alias("owner"), F.lit(1).cast("long").alias("copies"),
    )
    largest = keep == "max"
    partial = rows.mapInArrow(_tries(largest, False, held_bytes), CONTENTS)
    named = partial.select(F.octet_length("content").cast("long").alias("size"), F.xxhash64("content").alias("hash"), "content", "owner", "copies")
    return (
        named.repartition("size", "hash").sortWithinPartitions("size", "hash")
        .mapInArrow(_tries(largest, True, held_bytes), OWNERS)
    )


def with_sha(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumn("text_sha256", F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))


def exact_groups(docs: DataFrame, keep: str = "max", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the largest id stays
    (`keep="min"`: the smallest). A null id stays only if no row of its group has one. Rows that repeat both id
    and text are alike, so all or none of them are marked kept; each counts in group_size. An empty table gives
    an empty result; other columns are ignored.
    """
    found = owners(docs, keep, id_col, text_col).select(
        F.lower(F.hex("sha")).alias("text_sha256"), F.col("owner").alias("keep_id"), F.col("copies").alias("group_size")
    )
    named = with_sha(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).drop("text")
    return named.join(found, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def without_copies(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The rows of `docs` that stay, with all their columns, whatever their names.

    Null texts count as empty, and a null id stays only if no row of its text has one. Rows that repeat both id and text
    stay or go together. An empty table gives an empty result.
    """
    stay = owners(docs, keep).select(F.lower(F.hex("sha")).alias("kin_sha"), F.col("owner").alias("kin_owner"))
    sha = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    return docs.join(stay, (sha == F.col("kin_sha")) & F.col("doc_id").eqNullSafe(F.col("kin_owner")), "left_semi")
