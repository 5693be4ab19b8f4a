"""Token counts that follow edits.

A text is cut into leaves at places where no token crosses, whatever else the text holds: before white space that
follows another character, and between a mark of punctuation and a letter or digit. The pre-tokens of a leaf, and so
its token count, depend on the leaf alone. A segment tree over the leaves keeps sums of characters and tokens. An edit
finds its leaves by descending the tree, takes their text and the leaves next to them as context (an edit can make
or unmake the bounds there), cuts and counts only that, puts the new leaves in the place of the old ones and updates
the sums above. A subtree whose halves have become too unequal is built anew, which is paid for by the edits that
made it so; no other text is read.
The leaves of a result can be kept and given with the edited text to the next call, which then encodes nothing
but what its own edits touch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import byte_bpe
from .common import fresh, named, prepare

#: A leaf is closed at the first bound after so many characters.
LEAF = 128
#: Pieces of up to KNOWN_CHARS characters whose counts a worker keeps; then it starts anew.
WORDS, KNOWN_CHARS = 300_000, 48
#: Marks that are no letter, digit, space or apostrophe; letters and digits.
_SPACES = byte_bpe.SPACES
_MARKS = "!-&(-/:-@\\[-`{-~\u3001\u3002\u3008-\u3011\uff01\uff08\uff09\uff0c\uff0e\uff1a\uff1b\uff1f"
_LETTERS = "0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_BOUND = re.compile(f"(?<=[^{_SPACES}])(?=[{_SPACES}])|(?<=[{_MARKS}])(?=[{_LETTERS}])")
_PIECE = re.compile(f"[{_SPACES}]*[^{_SPACES}]+|[{_SPACES}]+")


class Counter:
    """Counts tokens; the counts of pieces between bounds are kept."""

    def __init__(self, vocabulary: byte_bpe.Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, int] = {}

    @classmethod
    def read(cls, data: bytes) -> Counter:
        return cls(byte_bpe.vocabulary(data))

    def count(self, text: str) -> int:
        """The tokens of a text whose ends are bounds."""
        known, total = self.known, 0
        if len(known) > WORDS:
            known.clear()
        for piece in _PIECE.findall(text):
            n = known.get(piece)
            if n is None:
                n = len(self.vocabulary.encode(piece))
                if len(piece) <= KNOWN_CHARS:
                    known[piece] = n
            total += n
        return total


def leaves_of(text: str) -> list[str]:
    """The text cut at bounds into leaves of about LEAF characters."""
    out, at = [], 0
    while len(text) - at > LEAF:
        m = _BOUND.search(text, at + LEAF)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    if at < len(text):
        out.append(text[at:])
    return out


def is_bound(before: str, after: str) -> bool:
    """Whether a text may be cut between two characters."""
    return _BOUND.search(before + after, 1) is not None


class _Node:
    """A stretch of leaves: how many, their characters and tokens, and two halves or the text of the one leaf."""

    __slots__ = ("count", "chars", "tokens", "left", "right", "text")

    def __init__(self, count: int, chars: int, tokens: int, left: _Node | None, right: _Node | None, text: str | None):
        self.count, self.chars, self.tokens, self.left, self.right, self.text = count, chars, tokens, left, right, text


def _over(left: _Node | None, right: _Node | None) -> _Node | None:
    if left is None or right is None:
        return left or right
    node = _Node(left.count + right.count, left.chars + right.chars, left.tokens + right.tokens, left, right, None)
    return _built(list(_leaves(node))) if node.count > 8 and 4 * max(left.count, right.count) > 3 * node.count else node


def _built(leaves: list[tuple[str, int]]) -> _Node | None:
    level = [_Node(1, len(x), n, None, None, x) for x, n in leaves]
    while len(level) > 1:
        pairs = [_Node(a.count + b.count, a.chars + b.chars, a.tokens + b.tokens, a, b, None) for a, b in zip(level[::2], level[1::2], strict=False)]
        level = pairs + level[len(level) - len(level) % 2 :]
    return level[0] if level else None


def _leaves(node: _Node | None, first: int = 0, last: int | None = None) -> Iterator[tuple[str, int]]:
    """(text, tokens) of the leaves from number first up to last."""
    stack = [(node, 0)] if node else []
    while stack:
        node, at = stack.pop()
        if at + node.count <= first or last is not None and at >= last:
            continue
        if node.left is None:
            yield node.text, node.tokens
        else:
            stack += [(node.right, at + node.left.count), (node.left, at)]


def _replaced(node: _Node, first: int, last: int, new: _Node | None) -> _Node | None:
    """The tree with new in the place of the leaves from first up to last, at least one."""
    if first <= 0 and last >= node.count:
        return new
    k = node.left.count
    left = _replaced(node.left, first, last, new) if first < k else node.left
    right = _replaced(node.right, first - k, last - k, None if first < k else new) if last > k else node.right
    return _over(left, right)


class TokenTree:
    """A text as leaves under a segment tree of (characters, tokens)."""

    def __init__(self, text: str, counter: Counter, kept: tuple[list[tuple[str, int]], int] | None = None):
        self.counter = counter
        self.recounted = 0
        leaves, self.encoded = kept or (self._counted(text), len(text))
        self.root = _built(leaves)

    def _counted(self, text: str) -> list[tuple[str, int]]:
        return [(x, self.counter.count(x)) for x in leaves_of(text)]

    @property
    def leaves(self) -> list[tuple[str, int]]:
        return list(_leaves(self.root))

    @property
    def text(self) -> str:
        return "".join(x for x, _ in _leaves(self.root))

    @property
    def n_chars(self) -> int:
        return self.root.chars if self.root else 0

    @property
    def n_tokens(self) -> int:
        return self.root.tokens if self.root else 0

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The number of the leaf that holds a place, and where it starts; the end is in the last leaf."""
        node, number, start = self.root, 0, 0
        while node.left is not None:
            if place - start >= node.left.chars:
                number, start, node = number + node.left.count, start + node.left.chars, node.right
            else:
                node = node.left
        return number, start

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace the characters from start up to stop by new; places beyond the text are its end."""
        start = max(0, min(start, self.n_chars))
        stop = max(start, min(stop, self.n_chars))
        if not self.root:
            self.root = _built(self._counted(new))
            self.recounted += self.n_chars
            return
        first, at = self._leaf_at(start)
        last = min(self._leaf_at(stop)[0] + 2, self.root.count)
        if first:  # the leaf before as context
            first -= 1
            at -= len(next(_leaves(self.root, first, first + 1))[0])
        old = "".join(x for x, _ in _leaves(self.root, first, last))
        text = old[: start - at] + new + old[stop - at :]
        # leaves whose bound the edit has unmade come with it
        while last < self.root.count:
            beside = next(_leaves(self.root, last, last + 1))[0]
            if text and is_bound(text[-1], beside[0]):
                break
            text, last = text + beside, last + 1
        while first:
            beside = next(_leaves(self.root, first - 1, first))[0]
            if text and is_bound(beside[-1], text[0]):
                break
            text, first = beside + text, first - 1
        self.recounted += len(text)
        self.root = _replaced(self.root, first, last, _built(self._counted(text)))


def _mark(leaf: str) -> int:
    """64 bits of a leaf's text, by which a kept count is known to be of it."""
    return int.from_bytes(xxhash.xxh64_digest(leaf.encode("utf-8", "surrogatepass")), "big", signed=True)


def kept_leaves(text: str, counter: Counter, chars: list[int] | None, tokens: list[int] | None, marks: list[int] | None) -> tuple[list[tuple[str, int]], int] | None:
    """The leaves of a text by their kept lengths and counts, and the characters of those whose text is another than it was, which are counted
    anew; None if the lengths are not of a text cut so."""
    if chars is None or tokens is None or marks is None or not len(chars) == len(tokens) == len(marks) or None in chars or None in tokens or sum(chars) != len(text) or any(n <= 0 for n in chars):
        return None
    out, at, anew = [], 0, 0
    for n, count, mark in zip(chars, tokens, marks, strict=True):
        if at and not is_bound(text[at - 1], text[at]):
            return None
        leaf = text[at : at + n]
        if _mark(leaf) != mark:
            count, anew = counter.count(leaf), anew + n
        out.append((leaf, count))
        at += n
    return out, anew


_COUNTERS: dict[int, Counter] = {}


def _counter(data: bytes) -> Counter:
    """This worker's counter for a broadcast vocabulary file: built once."""
    key = hash(data)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter.read(data)
    return _COUNTERS[key]


_RESULT = "struct<n_tokens:long,n_tokens_edited:long,n_chars_edited:long,n_chars_recounted:long,n_chars_encoded:long,leaf_chars:array<int>,leaf_tokens:array<int>,leaf_marks:array<long>,text:string>"


def edit_counts(docs: DataFrame, vocabulary_path: str, edits_col: str, text_col: str = "text", column: str = "counts", kept_col: str | None = None, with_text: bool = False) -> DataFrame:
    """docs with a last column of token counts before and after the edits of edits_col.

    An edit is struct(start, stop, text): code points start up to stop become text; edits follow each other,
    each on the text that those before left, and places beyond the text are its end. The column has n_tokens,
    n_tokens_edited, n_chars_edited, n_chars_recounted (read again for the edits), n_chars_encoded (read before
    them, to build the tree) and the leaves of the edited text: leaf_chars, leaf_tokens and leaf_marks (64 bits of their text), and, with_text,
    the edited text. Null texts are empty; null edits and null fields are no edit, 0 and "". Long texts are taken whole, in time by
    their length, runs of white space of any length too; a run of millions without any bound is one leaf, which an edit inside reads
    again. Repeated rows come out as often as they go in; other columns stay, and the new one gets leading underscores if docs
    has its name; an empty table stays empty.
    kept_col is a column of an earlier result whose edited text is now the text, by the same vocabulary. Its tree is
    taken up without encoding; leaves whose text is another than it was are counted anew. Where it is null, or its leaves
    do not fit the text in length and bounds, the text is encoded.
    """
    spark = prepare(docs.sparkSession)
    with open(vocabulary_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    @F.arrow_udf(_RESULT)
    def of(texts: pa.Array, edits: pa.Array, chars: pa.Array, tokens: pa.Array, marks: pa.Array) -> pa.Array:
        counter, out = _counter(shared.value), []
        for text, own, *kept in zip(*(x.to_pylist() for x in (texts, edits, chars, tokens, marks)), strict=True):
            tree = TokenTree(text or "", counter, kept_leaves(text or "", counter, *kept))
            before = tree.n_tokens
            for e in own or ():
                if e:
                    tree.edit(e["start"] or 0, e["stop"] or 0, e["text"] or "")
            leaves = tree.leaves
            out.append((before, tree.n_tokens, tree.n_chars, tree.recounted, tree.encoded, [len(x) for x, _ in leaves], [n for _, n in leaves], [_mark(x) for x, _ in leaves], tree.text if with_text else None))
        columns = list(zip(*out, strict=True)) or [()] * 9
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.int64()), pa.string()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["n_tokens", "n_tokens_edited", "n_chars_edited", "n_chars_recounted", "n_chars_encoded", "leaf_chars", "leaf_tokens", "leaf_marks", "text"])

    kept = [(named(kept_col)[x] if kept_col else F.lit(None)).cast(kind) for x, kind in (("leaf_chars", "array<int>"), ("leaf_tokens", "array<int>"), ("leaf_marks", "array<long>"))]
    return docs.withColumn(fresh(docs, column), of.asNondeterministic()(named(text_col), named(edits_col), *kept))
