"""Fingerprints of documents: Merkle trees over sections and paragraphs.

A text is its sections, cut at empty lines; a section is its paragraphs, cut at newlines; a
paragraph is its pieces: sentences, longer ones in parts of ``PIECE`` code points. A piece is
hashed by its text, every other node by the digests of its children, so equal roots mean equal
texts. A fingerprint is the whole tree as text: the root, then for each section its digest and
in brackets its paragraphs, each with digest and pieces (digest and code points):

    <root>|<section>(<paragraph>:<piece>.<length>,<piece>.<length>;<paragraph>:...)|<section>(...)

Two fingerprints are compared from the root down; equal branches are never opened. Likeness is
the share of code points of both texts that lie in pieces common to both (as often as both have
them); equal roots have 1, a text and an empty one 0. ``changes`` names the code points of both
texts under differing branches.

For documents in ascending order each text meets the next one: rows are laid out by range and
sorted, each task compares neighbours as they pass by, and the first and last row of a task go
to a second step that joins the ends of neighbouring tasks. Order is doc_id (null first), then
a hash of the text and the text, so a doc_id that repeats is spread over tasks and rows in a
tie are equal. Null texts are empty. A document alone is its own next one. An empty table gives
no rows. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlink.session import shuffle_partitions, staged

PIECE = 200  # code points
PIECE_HEX, NODE_HEX = 8, 16

_MARKS = ".!?"
PATTERN = rf"[^{_MARKS}]{{0,{PIECE}}}[{_MARKS}]+|[^{_MARKS}]{{1,{PIECE}}}"
_PIECES = re.compile(PATTERN)
# both trees in one string, where what they share packs well
_FIELDS = "doc_id long, n_chars long, edited_sha256 string, trees string, near_edited double, near_next double"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fingerprint(text: str | None) -> str:
    """The tree of a text. Nodes hash their children's whole digests; the tree shows the digests' beginnings."""
    sections, above = [], []
    for section in (text or "").split("\n\n"):
        paragraphs, digests = [], []
        for paragraph in section.split("\n"):
            pieces = _PIECES.findall(paragraph)
            leaves = [_sha(p) for p in pieces]
            digests.append(_sha("".join(leaves)))
            shown = ",".join([f"{d[:PIECE_HEX]}.{len(p)}" for d, p in zip(leaves, pieces, strict=True)])
            paragraphs.append(f"{digests[-1][:NODE_HEX]}:{shown}")
        above.append(_sha("".join(digests)))
        sections.append(f"{above[-1][:NODE_HEX]}({';'.join(paragraphs)})")
    return f"{_sha(''.join(above))}|{'|'.join(sections)}"


def _sections(tree: str) -> list[str]:
    return tree.split("|")[1:]


def _paragraphs(section: str) -> list[str]:
    return section[NODE_HEX + 1 : -1].split(";")


def _pieces(paragraph: str) -> list[str]:
    shown = paragraph[NODE_HEX + 1 :]
    return shown.split(",") if shown else []


def _length(piece: str) -> int:
    return int(piece[PIECE_HEX + 1 :])


def _chars(tree: str) -> int:
    """Code points in the pieces of a tree or branch."""
    return sum(map(int, re.findall(r"\.([0-9]+)", tree)))


def likeness(one: str, other: str) -> float:
    """Share of the code points of both trees in common pieces; only differing branches are opened."""
    if one[: one.index("|")] == other[: other.index("|")]:
        return 1.0
    total, common = _chars(one) + _chars(other), 0
    a, b = Counter(_sections(one)), Counter(_sections(other))
    for opened in (_paragraphs, _pieces, None):
        both = a & b
        common += sum(_chars(node) * times for node, times in both.items())
        if opened:
            a = Counter(x for node in (a - both).elements() for x in opened(node))
            b = Counter(x for node in (b - both).elements() for x in opened(node))
    return 2 * common / total if total else 0.0


def changes(one: str, other: str) -> list[tuple[int, int, int, int]]:
    """``start, end`` in the one text and in the other of each differing run of branches, in code points.

    Children of two nodes are aligned by digest; where one child stands against one, the
    comparison goes on below it.
    """
    found: list[tuple[int, int, int, int]] = []

    def size(node: str, level: int) -> int:
        if level == 2:
            return _length(node)
        children = _paragraphs(node) if level == 0 else _pieces(node)
        gaps = len(children) - 1 if level == 0 else 0
        return sum(size(c, level + 1) for c in children) + gaps

    def compare(a: list[str], b: list[str], a_at: int, b_at: int, level: int) -> None:
        gap = (2, 1, 0)[level]  # separators between siblings
        starts = []
        for nodes, at in ((a, a_at), (b, b_at)):
            places = [at]
            for node in nodes:
                places.append(places[-1] + size(node, level) + gap)
            starts.append(places)
        for tag, i, k, j, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            if tag == "equal":
                continue
            if level < 2 and k - i == m - j == 1:
                opened = _paragraphs if level == 0 else _pieces
                compare(opened(a[i]), opened(b[j]), starts[0][i], starts[1][j], level + 1)
                continue
            ends = [max(places[x], places[y] - gap) for places, x, y in ((starts[0], i, k), (starts[1], j, m))]
            found.append((starts[0][i], ends[0], starts[1][j], ends[1]))

    if one[: one.index("|")] != other[: other.index("|")]:
        compare(_sections(one), _sections(other), 0, 0, 0)
    return found


def edited(text: str | None, following: str | None) -> str:
    """The text with its last half (rounded down) replaced by the first as many code points of the following one."""
    text, following = text or "", following or ""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


class _Row:
    """One document and its tree."""

    def __init__(self, doc_id: int | None, text: str | None):
        self.doc_id, self.text = doc_id, text or ""
        self.tree = fingerprint(self.text)

    def facts(self, following: "_Row") -> tuple:
        changed = edited(self.text, following.text)
        tree = fingerprint(changed)
        return self.doc_id, len(self.text), _sha(changed), f"{self.tree} {tree}", likeness(self.tree, tree), likeness(self.tree, following.tree)


_NAMES = [f.split()[0] for f in _FIELDS.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.split()[1]] for f in _FIELDS.split(", ")]
_RESULT, _FIRST, _LAST = 0, 1, 2


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Facts of all rows of a sorted task but the last one; its first and last rows as they are."""
    task, last = TaskContext.get().partitionId(), None
    names, types = ["kind", "task", "text", *_NAMES], [pa.int32(), pa.int32(), pa.string(), *_TYPES]
    nothing = (None,) * (len(_NAMES) - 1)
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            row = _Row(doc_id, text)
            if last is None:
                rows.append((_FIRST, task, row.text, doc_id, *nothing))
            else:
                rows.append((_RESULT, task, None, *last.facts(row)))
            last = row
        yield _batch(rows, names, types)
    if last is not None:
        yield _batch([(_LAST, task, last.text, last.doc_id, *nothing)], names, types)


def across_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Facts of the last rows of tasks, each beside the first row of the next task."""
    for batch in batches:
        rows = batch.to_pylist()
        if rows:
            yield _batch([_Row(r["doc_id"], r["text"]).facts(_Row(None, r["following"])) for r in rows], _NAMES, _TYPES)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of each document."""
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).select("doc_id", "text", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    sort = ["doc_id", "_hash", "text", "_row"]
    laid_out = keyed.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id", "_hash", "_row").sortWithinPartitions(*sort)
    found = staged(
        laid_out.select("doc_id", "text").mapInArrow(neighbours, f"kind int, task int, text string, {_FIELDS}"), compression="zstd"
    )
    first = found.where(F.col("kind") == _FIRST).select(F.col("task").alias("next_task"), F.col("text").alias("following"))
    last = found.where(F.col("kind") == _LAST).select("task", "doc_id", "text")
    # one row per task here, without its text
    order = Window.orderBy("task")
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = last.select("task").select("task", F.coalesce(F.lead("task").over(order), F.min("task").over(whole)).alias("next_task"))
    ends = last.join(following, "task").join(first, "next_task").select("doc_id", "text", "following")
    rows = found.where(F.col("kind") == _RESULT).select(*_NAMES).unionByName(ends.mapInArrow(across_tasks, _FIELDS))
    trees = [F.substring_index("trees", " ", at).alias(c) for at, c in ((1, "fingerprint"), (-1, "edited_fingerprint"))]
    return rows.select("doc_id", "n_chars", "edited_sha256", *trees, "near_edited", "near_next")
