"""Token counts that follow edits: a segment tree of pre-tokens per document.

No pre-token holds white space behind something else, so a text can be cut where white space begins: both sides are then
encoded independently. The leaves of a document's tree are stretches between such cuts with their sizes in code points
and in tokens; inner nodes hold sums. An edit re-encodes the leaves that it touches and the neighbours that share its
ends, and updates the sums above them; the rest of the text is never encoded again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidepanel.llm import bpe
from tidepanel.llm.common import chunks, map_arrow, text_buffers

LEAF_BYTES = 256


def leaves_of(texts: list[str], vocab: bpe.Vocabulary) -> list[tuple[list[int], list[int]]]:
    """Code points and tokens of every leaf of every text; all texts are encoded at once."""
    data, offsets = text_buffers(pa.array(texts, pa.large_string()))
    if not len(data):
        return [([], []) for _ in texts]
    starts = bpe.word_starts(data, offsets)
    codes, words = bpe.distinct_words(data, starts)
    _, places = vocab.merge(words)
    tokens = np.concatenate(([0], np.cumsum(np.diff(places)[codes])))
    space = bpe.byte_classes(data) == bpe.SPACE
    fence = np.zeros(len(data) + 1, bool)
    fence[offsets] = True
    cut = starts[(starts > 0) & space[starts] & ~space[starts - 1] & ~fence[starts]]
    owner = np.searchsorted(offsets, cut, "right") - 1
    # the first cut in each stretch of so many bytes opens a leaf
    stretch = owner << 40 | (cut - offsets[owner]) // LEAF_BYTES
    later = (np.diff(stretch, prepend=-1) != 0) & ((stretch & ((1 << 40) - 1)) > 0)
    first = np.unique(np.concatenate((offsets[:-1][np.diff(offsets) > 0], cut[later])))
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    ends = np.append(first[1:], len(data))
    size = points[ends] - points[first]
    held = np.diff(tokens[np.searchsorted(starts, np.append(first, len(data)))])
    at = np.searchsorted(first, offsets)
    size, held = size.tolist(), held.tolist()
    return [(size[a:b], held[a:b]) for a, b in zip(at.tolist(), at[1:].tolist())]


class SegmentTree:
    """Sums of code points and tokens over the leaves of one text."""

    def __init__(self, points: list[int], tokens: list[int]) -> None:
        self.build(points, tokens)

    def build(self, points: list[int], tokens: list[int]) -> None:
        self.size = 1 << max(0, (len(points) - 1).bit_length())
        pad = [0] * (self.size - len(points))
        self.points = [0] * self.size + points + pad
        self.tokens = [0] * self.size + tokens + pad
        for node in range(self.size - 1, 0, -1):
            self.pull(node)

    def pull(self, node: int) -> None:
        self.points[node] = self.points[2 * node] + self.points[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def find(self, point: int) -> tuple[int, int]:
        """Leaf that holds a code point, and the leaf's first code point."""
        node, first = 1, 0
        while node < self.size:
            node *= 2
            if point - first >= self.points[node] and self.points[node + 1]:
                first += self.points[node]
                node += 1
        return node - self.size, first

    def replace(self, low: int, high: int, points: list[int], tokens: list[int]) -> None:
        """Put new leaves in the place of leaves low .. high; a tree without room is built anew from its leaves."""
        room = high - low + 1
        if len(points) > room:
            old_points, old_tokens = self.points[self.size:], self.tokens[self.size:]
            kept = [(p, t) for p, t in zip(old_points[:low], old_tokens[:low]) if p] + [*zip(points, tokens)] + [(p, t) for p, t in zip(old_points[high + 1:], old_tokens[high + 1:]) if p]
            self.build([p for p, _ in kept], [t for _, t in kept])
            return
        nodes = range(self.size + low, self.size + high + 1)
        for node, p, t in zip(nodes, points + [0] * (room - len(points)), tokens + [0] * (room - len(points))):
            self.points[node], self.tokens[node] = p, t
        a, b = nodes[0] // 2, nodes[-1] // 2
        while a:
            for node in range(a, b + 1):
                self.pull(node)
            a, b = a // 2, b // 2


class Document:
    """A text with its tree while edits are applied."""

    def __init__(self, text: str, leaves: tuple[list[int], list[int]]) -> None:
        self.text, self.tree, self.encoded = text, SegmentTree(*leaves), 0

    def region(self, start: int, removed: int, inserted: str) -> str:
        """Change the text; returns what has to be encoded anew. Places beyond the text's end mean its end."""
        size = len(self.text)
        start = min(max(start, 0), size)
        end = min(start + max(removed, 0), size)
        self.low, first = self.tree.find(max(start - 1, 0))
        self.high, last = self.tree.find(min(end, max(size - 1, 0)))
        past = last + self.tree.points[self.tree.size + self.high]
        fresh = self.text[first:start] + inserted + self.text[end:past]
        self.text = self.text[:start] + inserted + self.text[end:]
        self.encoded += len(fresh)
        return fresh

    def settle(self, leaves: tuple[list[int], list[int]]) -> None:
        self.tree.replace(self.low, self.high, *leaves)

    @property
    def tokens(self) -> int:
        return self.tree.tokens[1]


def open_documents(texts: list[str], vocab: bpe.Vocabulary) -> list[Document]:
    """Trees of all texts, encoded together."""
    return [Document(t, leaves) for t, leaves in zip(texts, leaves_of(texts, vocab))]


def apply_edits(documents: list[Document], edits: list[list[tuple[int, int, str]]], vocab: bpe.Vocabulary) -> None:
    """Apply every document's edits in turn. The k-th edits of all documents are encoded together."""
    for k in range(max(map(len, edits), default=0)):
        touched = [(d, e[k]) for d, e in zip(documents, edits) if len(e) > k]
        fresh = [d.region(*edit) for d, edit in touched]
        for (document, _), leaves in zip(touched, leaves_of(fresh, vocab)):
            document.settle(leaves)


def count_edited(docs: DataFrame, vocab_path: str | None = None, doc_id: str = "doc_id", text: str = "text", edits: str = "edits") -> DataFrame:
    """Token counts before and after the edits of every document: (doc_id, n_tokens_before, n_tokens, n_chars, n_edits,
    n_reencoded), the last the code points that edits made the encoder read again.

    ``edits`` is an array of (start, removed, inserted), applied in turn: from code point ``start`` of the text as it then
    is, ``removed`` code points go and ``inserted`` comes. Places beyond the end mean the end, negative ones the start;
    null fields are 0 or empty; a null array has no edits; a null edit does nothing. A null text is empty. Each row is a
    document of its own; repeated rows and null ids stay. Other columns are not read. An empty table gives an empty one.
    """
    path = vocab_path or bpe.default_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = bpe.vocabulary(path)
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for i, j in chunks(offsets):
                part = batch.slice(i, j - i)
                texts = [t or "" for t in part.column(1).to_pylist()]
                changes = [[(e["start"] or 0, e["removed"] or 0, e["inserted"] or "") for e in row or () if e] for row in part.column(2).to_pylist()]
                documents = open_documents(texts, vocab)
                before = [d.tokens for d in documents]
                apply_edits(documents, changes, vocab)
                values = [before, [d.tokens for d in documents], [len(d.text) for d in documents], list(map(len, changes)), [d.encoded for d in documents]]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, pa.int64()) for v in values)],
                                                 names=[doc_id, "n_tokens_before", "n_tokens", "n_chars", "n_edits", "n_reencoded"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_arrow(docs.select(doc_id, text, edits), work, f"{doc_id} {kind}, n_tokens_before long, n_tokens long, n_chars long, n_edits long, n_reencoded long")
