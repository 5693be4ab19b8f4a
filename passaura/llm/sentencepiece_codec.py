"""SentencePiece encoding and decoding by an Aho-Corasick automaton and a single-pass Viterbi search.

The automaton over all pieces reads a text once. At each place its output links name the pieces that end
there, longest first, and each relaxes the best way to that place from the best way to the piece's start.
For a unigram model a way's score is the sum of its pieces' scores. For a BPE model the scores are merge
ranks, whose sum means nothing; there a way is open if each two neighbouring pieces are what BPE makes
of their joint string, and exactly one piece at each place continues the open way to its start (a merge
that would break two pieces up depends on these two alone). So the result is that of the library for both.
Places no piece covers take a character as byte pieces, or as the unknown piece in models without them.

No piece of a model like this joins a word to what follows it, so a text is searched word by word and the
short words of a worker's memory are not searched again. Pieces of blanks alone have one score in BPE models, under
all others: blanks are joined when all else is, from the left, so a run of them follows from its length.
"""

from __future__ import annotations

import re
import struct
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, named, prepare

SPACE = "\u2581"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words of up to KNOWN_CHARS characters (twice), pairs of pieces and steps of the automaton that a worker keeps.
WORDS, KNOWN_CHARS, PAIRS, STEPS = 100_000, 48, 300_000, 300_000


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message: an int, four bytes or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + n]
            at += n


class Model:
    """A SentencePiece model file: pieces, scores, kinds, and how texts are made ready."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        self.bpe, self.prefix, self.fold, self.charsmap = False, True, True, b""
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif number == 2:
                self.bpe = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                own = dict(_fields(value))
                self.prefix, self.fold, self.charsmap = bool(own.get(3, 1)), bool(own.get(4, 1)), own.get(2, b"")
        if self.charsmap:
            raise ValueError("models with a character map in their normaliser are not supported")
        if any(SPACE in p.lstrip(SPACE) for p, k in zip(self.pieces, self.kinds, strict=True) if k in (NORMAL, USER)):
            raise ValueError("models whose pieces span words are not supported")

    @classmethod
    def read(cls, path: str) -> Model:
        with open(path, "rb") as f:
            return cls(f.read())


class Codec:
    """Encodes texts to piece ids and decodes ids to texts."""

    def __init__(self, model: Model):
        self.model = model
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        usable = [k in (NORMAL, USER) for k in model.kinds]
        self.ids = {p: i for i, (p, ok) in enumerate(zip(model.pieces, usable, strict=True)) if ok and p}
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == BYTE}
        # no piece joins what is before a line's end to what is after it, so lines are searched one by one
        self.lines = 10 in self.byte and not any("\n" in p for p in self.ids)
        self.unknown = next((i for i, k in enumerate(model.kinds) if k == UNKNOWN), 0)
        self.worst = min((model.scores[i] for i in self.ids.values()), default=0.0) - 10
        self._build()
        self.plain = [p.replace(SPACE, " ").encode() if ok else b"" for p, ok in zip(model.pieces, usable, strict=True)]
        for b, i in self.byte.items():
            self.plain[i] = bytes([b])
        self.plain[self.unknown] = " \u2047 ".encode()

    def _build(self) -> None:
        """The automaton: for each state its steps, its output (piece id or -1) and the next state with an output."""
        steps: list[dict[str, int]] = [{}]
        out = [-1]
        for piece, i in self.ids.items():
            s = 0
            for c in piece:
                n = steps[s].get(c)
                if n is None:
                    n = steps[s][c] = len(steps)
                    steps.append({})
                    out.append(-1)
                s = n
            out[s] = i
        fail, link, order = [0] * len(steps), [0] * len(steps), list(steps[0].values())
        for s in order:
            link[s] = fail[s] if out[fail[s]] >= 0 else link[fail[s]]
            for c, n in steps[s].items():
                f = fail[s]
                while f and c not in steps[f]:
                    f = fail[f]
                fail[n] = steps[f].get(c, 0)
                order.append(n)
        self.steps, self.fail, self.out, self.link = steps, fail, out, link
        self.goto, self.known_steps = [dict() for _ in steps], 0
        self.length = [len(p) for p in self.model.pieces]
        self.blanks = self._of_blanks() if self.model.bpe else []
        # for each state, the pieces that end there, longest first: the output links written out
        ends: list[tuple] = [()] * len(steps)
        for s in order:
            ends[s] = (((out[s], self.length[out[s]]),) if out[s] >= 0 else ()) + ends[link[s]]
        self.ends = ends
        self.whole = {i for p, i in self.ids.items() if self.merged(p) == [i]} if self.model.bpe else set(self.ids.values())
        if self.model.bpe:
            self.ends = [tuple(x for x in e if x[0] in self.whole) for e in ends]

    def _follow(self, state: int, c: str) -> int:
        """The state after a character by steps and failure links, kept in goto."""
        s = state
        while s and c not in self.steps[s]:
            s = self.fail[s]
        s = self.steps[s].get(c, 0)
        if self.known_steps >= STEPS:
            self.goto, self.known_steps = [{} for _ in self.steps], 0
        self.goto[state][c] = s
        self.known_steps += 1
        return s

    def _of_blanks(self) -> list[list[int]]:
        """The ids of 0, 1, ... blanks up to the longest piece of them; none if they are not joined last, from the left."""
        lengths = {self.length[i]: i for p, i in self.ids.items() if not p.strip(SPACE)}
        scores = {self.model.scores[i] for n, i in lengths.items() if n > 1}
        others = min((self.model.scores[i] for p, i in self.ids.items() if p.strip(SPACE) and len(p) > 1), default=0.0)
        if 1 not in lengths or len(scores) > 1 or any(x >= others for x in scores):
            return []
        runs: list[list[int]] = [[]]
        for _ in range(max(lengths)):  # one more blank joins what is before it as long as that is a piece
            own = [*runs[-1], 1]
            while len(own) > 1 and own[-2] + own[-1] in lengths:
                own[-2:] = [own[-2] + own[-1]]
            runs.append(own)
        return [[lengths[n] for n in own] for own in runs] if len(runs[-1]) == 1 else []

    def merged(self, text: str) -> list[int]:
        """BPE itself: join the neighbours of best score, the leftmost of equals, until none join; -1: no piece.

        A heap holds the joins that are open, so n characters take n log n steps.
        """
        parts, n = list(text), len(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(k: int) -> None:
            both = parts[k] + parts[after[k]]
            i = self.ids.get(both)
            if i is not None:
                heappush(heap, (-self.model.scores[i], k, both))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, k, both = heappop(heap)
            j = after[k] if parts[k] else n
            if j >= n or len(parts[k]) + len(parts[j]) != len(both) or parts[k] + parts[j] != both:
                continue  # one of the two is joined already
            parts[k], parts[j], after[k] = both, "", after[j]
            if after[k] < n:
                before[after[k]] = k
                offer(k)
            if before[k] >= 0:
                offer(before[k])
        return [self.ids.get(p, -1) for p in parts if p]

    def _fits(self, a: int, b: int) -> bool:
        key = a << 24 | b
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            pieces = self.model.pieces
            ok = self.pairs[key] = self.merged(pieces[a] + pieces[b]) == [a, b]
        return ok

    def search(self, word: str) -> tuple[int, ...]:
        """The ids of a word by one pass of the automaton."""
        if self.model.bpe and word[:2] == SPACE + SPACE:
            return self._after_blanks(word)
        goto, follow, ends, n = self.goto, self._follow, self.ends, len(word)
        last = [-1] * (n + 1)  # the last piece of the best way to each place; -1: an uncovered character
        size = [1] * (n + 1)
        state = 0
        if self.model.bpe:
            fits, pairs = self._fits, self.pairs
            for j, c in enumerate(word, 1):
                after = goto[state].get(c)
                state = follow(state, c) if after is None else after
                for piece, length in ends[state]:
                    before = last[j - length] if j > length else -1
                    if before >= 0:
                        ok = pairs.get(before << 24 | piece)
                        if not (fits(before, piece) if ok is None else ok):
                            continue
                    last[j], size[j] = piece, length
                    break
        else:
            score = [0.0] + [float("-inf")] * n
            for j, c in enumerate(word, 1):
                after = goto[state].get(c)
                state = follow(state, c) if after is None else after
                best, covered = float("-inf"), False
                for piece, length in ends[state]:
                    covered |= length == 1
                    s = score[j - length] + self.model.scores[piece]
                    if s > best:
                        best, last[j], size[j] = s, piece, length
                if not covered and score[j - 1] + self.worst > best:
                    best, last[j], size[j] = score[j - 1] + self.worst, -1, 1
                score[j] = best
        found, j = [], n
        while j:
            found.append(last[j])
            j -= size[j]
        return self._spelled(word, found[::-1])

    def _after_blanks(self, word: str) -> tuple[int, ...]:
        """The ids of a word with several blanks before it: those blanks that the word does not take are joined from the left."""
        if not self.blanks:
            return self._spelled(word, self.merged(word))
        rest = word.lstrip(SPACE)
        n, own = len(word) - len(rest), ()
        if rest:
            own = self.search(SPACE + rest)
            n -= 1
            if own[0] == self.ids[SPACE]:  # the word left its blank alone
                n, own = n + 1, own[1:]
        longest = len(self.blanks) - 1
        return (*self.blanks[-1] * (n // longest), *self.blanks[n % longest], *own)

    def _spelled(self, word: str, found: list[int]) -> tuple[int, ...]:
        """found with the bytes of uncovered characters in their place."""
        if -1 not in found:
            return tuple(found)
        out, at = [], 0
        for i in found:
            if i >= 0:
                out.append(i)
                at += self.length[i]
            else:
                if self.byte:
                    out += [self.byte[b] for b in word[at].encode()]
                elif not out or out[-1] != self.unknown:  # the library joins unknown neighbours
                    out.append(self.unknown)
                at += 1
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """Null and empty texts have no ids."""
        if text and self.model.fold:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return []
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if self.model.prefix:
            text = " " + text
        if not self.lines or "\n" not in text:
            out: list[int] = []
            self._words(text, out)
            return out
        out = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(self.byte[10])
            if line:
                self._words(line, out)
        return out

    def _words(self, text: str, out: list[int]) -> None:
        """Add the ids of a text, word by word."""
        if "  " in text or text[-1] == " ":
            parts = [x.replace(" ", SPACE) for x in _WORD.findall(text)]
        elif text[0] == " ":
            parts = [SPACE + x for x in text[1:].split(" ")]
        else:
            first, *parts = text.split(" ")
            parts = [first, *[SPACE + x for x in parts]]
        recent, older = self.words, self.older
        for x in parts:
            ids = recent.get(x)
            if ids is None:
                ids = older.get(x)
                if ids is None:
                    ids = self.search(x)
                if len(x) <= KNOWN_CHARS:
                    recent[x] = ids
            out += ids
        if len(recent) >= WORDS:  # words in use move to the new table; the others go with the next
            self.words, self.older = {}, recent

    def decode(self, ids: list[int] | None) -> str:
        """The text of ids; bytes that are not UTF-8 become the replacement character."""
        data = b"".join(map(self.plain.__getitem__, ids or ()))
        if self.model.prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


_WORD = re.compile(r" +[^ ]*|[^ ]+")
_CODECS: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """This worker's codec for a model's broadcast bytes: built once."""
    if shared.id not in _CODECS:
        _CODECS.clear()
        _CODECS[shared.id] = Codec(Model(shared.bytes))
    return _CODECS[shared.id]


class _Shared:
    """A model's bytes with a name that stays the same in every worker."""

    def __init__(self, data: bytes):
        import hashlib

        self.bytes, self.id = data, hashlib.sha256(data).hexdigest()


def _read(path: str) -> _Shared:
    with open(path, "rb") as f:
        return _Shared(f.read())


def encoded(docs: DataFrame, model_path: str, text_col: str = "text", column: str = "ids") -> DataFrame:
    """docs with a last column of piece ids (with leading underscores if docs has its name).

    The model file is read by the driver and sent to the workers. Null and empty texts have no ids; a
    U+2581 in a text counts as a space, as the library has it. Other columns and repeated rows stay. Long texts are
    read whole, in time that grows with their length. An empty table gives an empty table with the column.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(_read(model_path))

    @F.arrow_udf("array<int>")
    def of(texts: pa.Array) -> pa.Array:
        codec = _codec(shared.value)
        return pa.array([codec.encode(x) for x in texts.to_pylist()], pa.list_(pa.int32()))

    return docs.withColumn(fresh(docs, column), of.asNondeterministic()(named(text_col)))


def decoded(docs: DataFrame, model_path: str, ids_col: str = "ids", column: str = "decoded") -> DataFrame:
    """docs with a last column of the texts of piece ids (with leading underscores if docs has its name).

    Null and empty ids give the empty text. Other columns and repeated rows stay; an empty table stays empty.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(_read(model_path))

    @F.arrow_udf("string")
    def of(ids: pa.Array) -> pa.Array:
        codec = _codec(shared.value)
        return pa.array([codec.decode(x) for x in ids.to_pylist()], pa.string())

    return docs.withColumn(fresh(docs, column), of.asNondeterministic()(named(ids_col)))


def coded(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """docs with a last column `coded` (or `_coded`): struct(ids, decoded), both ways in one pass.

    Nulls, empty and long texts, repeated rows, empty tables and names as for `encoded` and `decoded`.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(_read(model_path))

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def of(texts: pa.Array) -> pa.Array:
        codec = _codec(shared.value)
        ids = [codec.encode(x) for x in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(x) for x in ids], pa.string())], ["ids", "decoded"])

    return docs.withColumn(fresh(docs, "coded"), of.asNondeterministic()(named(text_col)))


def is_lossless(text: Column, decoded_text: Column) -> Column:
    """Whether a text came back: as itself, U+2581 as a space; null as the empty text."""
    return F.coalesce(F.translate(text, SPACE, " "), F.lit("")) == decoded_text
