"""Token counts that follow edits.

A document's text is cut into pre-tokens by the tokenizer's pattern; the merges never cross them, so that a text's count
is the sum over its pre-tokens. LEAF pre-tokens make a leaf, and a segment tree holds the counts, the lengths and the texts
of the leaves: the whole text is nowhere else, and no edit copies it. An edit re-encodes the touched leaves and, for
context, the one before them (the pattern looks one character ahead) and as much after them as it takes until the pattern
is back at an old leaf's start; from there on a left-to-right match repeats itself. Then only the sums above the replaced
leaves change. Edits that lie close together are made at once.
"""

from __future__ import annotations

import base64
import os
import re

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from karstflow.llm.common import lean

#: Pre-tokens of a leaf.
LEAF = 64
#: Old leaves behind an edit at whose starts re-encoding may end; if it meets none, it goes on to the text's end.
NEXT = 8
#: Edits with fewer characters than this between them are one.
CLOSE = 256
#: The pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED, LONGEST = 400_000, 64


class Counter:
    """The number of tokens of a pre-token, by a rank file of byte-level merges."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def of(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(piece) <= LONGEST:
                if len(self.known) > REMEMBERED:
                    self.known.clear()
                self.known[piece] = n
        return n

    def all_leaves(self, text: str) -> list[tuple[str, int]]:
        """(text, tokens) of the leaves of a whole text."""
        pieces = self.pattern.findall(text)
        for piece in {*pieces}.difference(self.known):
            self.of(piece)
        known = self.known
        counts = [known[x] if x in known else self.of(x) for x in pieces]
        return [("".join(pieces[k : k + LEAF]), sum(counts[k : k + LEAF])) for k in range(0, len(pieces), LEAF)]

    def leaves_until(self, text: str, stops, whole: bool) -> tuple[list[tuple[str, int]], int] | None:
        """The leaves of `text` and where they end: at the first pre-token that starts at one of `stops`, or at the text's
        end. None if `text` isn't all there is (`whole`) and ends before that is settled."""
        out, begin, tokens, n, at = [], 0, 0, 0, 0
        for match in self.pattern.finditer(text):
            if match.start() in stops:
                break
            if not whole and match.end() == len(text):
                return None  # what follows might belong to the match
            tokens, n, at = tokens + self.of(match.group()), n + 1, match.end()
            if n == LEAF:
                out.append((text[begin:at], tokens))
                begin, tokens, n = at, 0, 0
        if n:
            out.append((text[begin:at], tokens))
        return out, at


class Tree:
    """A segment tree of (characters, tokens) sums over leaves, as nested tuples (characters, tokens, leaves, left, right);
    a leaf has its text for `right`. Replacing leaves makes new nodes on the paths to them only; two trees are joined along
    the edge of the larger one, so that depths stay logarithmic."""

    EMPTY = (0, 0, 0, None, None)

    @staticmethod
    def build(leaves):
        if not leaves:
            return Tree.EMPTY
        if len(leaves) == 1:
            text, tokens = leaves[0]
            return (len(text), tokens, 1, None, text)
        half = len(leaves) // 2
        return Tree.joined(Tree.build(leaves[:half]), Tree.build(leaves[half:]))

    @staticmethod
    def joined(a, b):
        if not a[2] or not b[2]:
            return a if a[2] else b
        if a[2] > 4 * b[2]:
            return Tree.over(a[3], Tree.joined(a[4], b))
        if b[2] > 4 * a[2]:
            return Tree.over(Tree.joined(a, b[3]), b[4])
        return Tree.over(a, b)

    @staticmethod
    def over(a, b):
        return (a[0] + b[0], a[1] + b[1], a[2] + b[2], a, b)

    @staticmethod
    def find(node, at: int) -> tuple[int, int]:
        """(number, first character) of the leaf that holds character `at`; of the last leaf if there is none."""
        number = first = 0
        while node[3] is not None:
            if at < first + node[3][0]:
                node = node[3]
            else:
                number, first, node = number + node[3][2], first + node[3][0], node[4]
        return number, first

    @staticmethod
    def split(node, n: int):
        """The first n leaves and the others."""
        if n <= 0:
            return Tree.EMPTY, node
        if n >= node[2]:
            return node, Tree.EMPTY
        if n < node[3][2]:
            a, b = Tree.split(node[3], n)
            return a, Tree.joined(b, node[4])
        a, b = Tree.split(node[4], n - node[3][2])
        return Tree.joined(node[3], a), b

    @staticmethod
    def leaves(node, first: int = 0):
        """(text, tokens) of the leaves from number `first` on."""
        todo = [(node, first)] if node[2] else []
        while todo:
            node, skip = todo.pop()
            if skip >= node[2]:
                continue
            if node[3] is None:
                yield node[4], node[1]
            else:
                todo += [(node[4], max(0, skip - node[3][2])), (node[3], skip)]


class Document:
    """A text with the segment tree of its token counts."""

    def __init__(self, counter: Counter, text: str, leaves=None):
        """leaves: (characters, tokens) of its leaves, if known."""
        self.counter = counter
        if leaves is None:
            own = counter.all_leaves(text)
        else:
            own, at = [], 0
            for chars, tokens in leaves:
                own.append((text[at : at + chars], tokens))
                at += chars
        self.tree = Tree.build(own)
        self.encoded = 0  # characters that edits re-encoded

    @property
    def text(self) -> str:
        return "".join(x for x, _ in Tree.leaves(self.tree))

    @property
    def tokens(self) -> int:
        return self.tree[1]

    def part(self, start: int, end: int) -> str:
        """Characters start to end-1."""
        number, first = Tree.find(self.tree, start)
        out, at = [], first
        for text, _ in Tree.leaves(self.tree, number):
            if at >= end:
                break
            out.append(text)
            at += len(text)
        return "".join(out)[start - first : end - first]

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces characters start to end-1 by `new`."""
        old = self.tree
        if not 0 <= start <= end <= old[0]:
            raise ValueError(f"no characters {start} to {end} in a text of {old[0]}")
        number, first = Tree.find(old, max(0, start - 1))
        # back by a leaf, and on until the leaf's start is settled: the pattern looks at up to two characters, and at the
        # white space and the character after it, to end the match before
        steps = 0
        while number > 0 and (steps < 1 or start - first < 8 or self.part(first, start).isspace()):
            number, first = Tree.find(old, first - 1)
            steps += 1
        through = min(old[2], Tree.find(old, end)[0] + 1)
        before, after = Tree.split(old, through)
        text = self.part(first, start) + new + self.part(end, before[0])
        # places where the old leaves behind the edit start now; the first one that the pattern meets ends the work
        stops, more = {}, Tree.leaves(after)
        found = None
        while found is None:
            seen = len(stops)
            for leaf, _ in more:
                stops[len(text)] = len(stops)
                text += leaf
                if len(stops) >= max(NEXT, 2 * seen):
                    break
            found = self.counter.leaves_until(text, stops, len(stops) == after[2])
        leaves, stop = found
        after = Tree.split(after, stops[stop])[1] if stop in stops else Tree.EMPTY
        self.encoded += stop
        self.tree = Tree.joined(Tree.joined(Tree.split(old, number)[0], Tree.build(leaves)), after)

    def edits(self, todo) -> None:
        """All of (start, end, new), in order, places as they are when the edit's turn comes. Neighbours that go to one
        side, and lie close together, are made at once."""
        group = None  # start, end (before the group's edits) and the text that stands there after them
        for start, end, new in todo:
            if group:
                a, b, text = group
                c = a + len(text)  # where the group ends now
                if 0 <= start <= end <= a and a - end < CLOSE:
                    group = (start, b, new + self.part(end, a) + text)
                    continue
                if c <= start <= end <= self.tree[0] - (b - a) + len(text) and start - c < CLOSE:
                    group = (a, end - c + b, text + self.part(b, start - c + b) + new)
                    continue
                self.edit(*group)
            group = (start, end, new)
            if not 0 <= start <= end <= self.tree[0]:
                raise ValueError(f"no characters {start} to {end} in a text of {self.tree[0]}")
        if group:
            self.edit(*group)


_INTS = T.ArrayType(T.IntegerType())


def _with(rows: DataFrame, **more: T.DataType) -> T.StructType:
    return T.StructType([*rows.schema.fields, *(T.StructField(name, kind) for name, kind in more.items())])


def _state(path: str):
    @lean
    def run(batches):
        counter = Counter(path)
        for batch in batches:
            leaves = [counter.all_leaves(x or "") for x in batch.column(0).to_pylist()]
            kind = pa.list_(pa.int32())
            chars, tokens = pa.array([[len(c) for c, _ in x] for x in leaves], kind), pa.array([[t for _, t in x] for x in leaves], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, chars, tokens, pa.array([sum(t for _, t in x) for x in leaves], pa.int64())], names=[*batch.schema.names, "leaf_chars", "leaf_tokens", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, ranks: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """text, doc_id, leaf_chars, leaf_tokens, n_tokens: the state that apply_edits() works on, a row for each row of docs.

    ranks: the path of a rank file, the same on every machine. A null or empty text has no leaves and no tokens; a text of
    any length is counted whole, in time linear in it; an empty table gives an empty result; repeated rows are counted each
    for itself; other columns are ignored.
    """
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("doc_id"))
    return rows.mapInArrow(_state(ranks), _with(rows, leaf_chars=_INTS, leaf_tokens=_INTS, n_tokens=T.LongType()))


def apply_edits(state: DataFrame, edits: Column, ranks: str) -> DataFrame:
    """The state after edits, with n_tokens_before and n_encoded (characters that were encoded again).

    edits: for each row an array of (start, end, new): characters start to end-1 become `new`, applied in order, places
    as they are when the edit's turn comes; an edit outside of the text is an error. A null array is no edit; a null `new` is
    empty; a null text counts as empty. An edit costs the leaves it touches and the depth of the tree, however long the text
    is and however many edits it has.
    """
    rows = state.select("text", "doc_id", "leaf_chars", "leaf_tokens", "n_tokens", edits.alias("edits"))

    @lean
    def run(batches):
        counter = Counter(ranks)
        for batch in batches:
            texts, chars, tokens, totals, encoded = [], [], [], [], []
            for text, c, t, todo in zip(batch.column(0).to_pylist(), *(batch.column(k).to_pylist() for k in (2, 3, 5)), strict=True):
                if todo:
                    doc = Document(counter, text or "", list(zip(c, t, strict=True)))
                    doc.edits((e["start"], e["end"], e["new"] or "") for e in todo)
                    leaves = list(Tree.leaves(doc.tree))
                    text, c, t = doc.text, [len(x) for x, _ in leaves], [x for _, x in leaves]
                    encoded.append(doc.encoded)
                else:
                    encoded.append(0)
                texts.append(text)
                chars.append(c)
                tokens.append(t)
                totals.append(sum(t))
            kind = pa.list_(pa.int32())
            columns = [pa.array(texts, pa.string()), batch.column(1), pa.array(chars, kind), pa.array(tokens, kind), pa.array(totals, pa.int64()), batch.column(4), pa.array(encoded, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["text", "doc_id", "leaf_chars", "leaf_tokens", "n_tokens", "n_tokens_before", "n_encoded"])

    return rows.mapInArrow(run, _with(rows.drop("edits"), n_tokens_before=T.LongType(), n_encoded=T.LongType()))


def redactions(text: Column, pattern: str, new: str) -> Column:
    """Edits that replace every match of a pattern (of Python's re), as apply_edits() takes them: from the last match to the
    first, so that places stay valid. A null text has none."""

    @F.pandas_udf("array<struct<start:int,end:int,new:string>>")
    def found(texts: pd.Series) -> pd.Series:
        own = re.compile(pattern)
        return pd.Series([None if t is None else [{"start": m.start(), "end": m.end(), "new": new} for m in own.finditer(t) if m.end() > m.start()][::-1] for t in texts])

    return found(text)
