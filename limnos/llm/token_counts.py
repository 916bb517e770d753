"""Edit-aware token counts on segment trees of pre-tokens."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens of the byte-level vocabularies: the public pattern of that tokenizer family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF = 128
CACHE = 1 << 18
#: A pre-token depends on so many characters after its end at most (the longest contraction).
CONTEXT = 3
#: Mail addresses, long numbers and keys, which the query masks.
MASKED = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+|\+?[0-9][0-9 -]{7,}[0-9]|AKIA[A-Z0-9]{16,}|[0-9a-f]{16,}"


class Counter(dict):
    """Tokens of each pre-token; forgets all when it has grown large."""

    def __init__(self, ranks: str) -> None:
        super().__init__()
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.pattern = regex.compile(PATTERN)

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self[piece] = len(self.encode(piece))
        return n


@lru_cache(maxsize=2)
def counter(ranks: str) -> Counter:
    return Counter(ranks)


class TokenTree:
    """A text's pre-tokens in leaves of bounded size, with token and character sums above them.

    Leaves keep their places and their part of the text, so an edit costs what
    the leaves that it touches hold and the path above them, whatever the
    text's length. The leaves are dealt out anew once one has grown large or
    half of them are empty.
    """

    def __init__(self, text: str, ranks: str = RANKS) -> None:
        self.count = counter(ranks)
        pieces = self.count.pattern.findall(text)
        self.encoded = len(pieces)
        self._deal(text, list(map(len, pieces)), [self.count[p] for p in pieces])

    def _deal(self, text: str, sizes: list[int], tokens: list[int]) -> None:
        """Leaves of LEAF pre-tokens and the sums of all subtrees, root at 1."""
        self.leaves = [(sizes[i : i + LEAF], tokens[i : i + LEAF]) for i in range(0, len(sizes), LEAF)] or [([], [])]
        self.width = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.texts, at = [], 0
        for i, (own, counts) in enumerate(self.leaves):
            n = sum(own)
            self.texts.append(text[at : at + n])
            self.sums[self.width + i] = n, sum(counts)
            at += n
        level = self.width
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2
        self._emptied = 0

    def _put(self, i: int, text: str, sizes: list[int], tokens: list[int]) -> None:
        """What a leaf holds, with its sums and those of the subtrees above it."""
        self._emptied += bool(self.leaves[i][0]) - bool(sizes)
        self.leaves[i], self.texts[i] = (sizes, tokens), text
        at = self.width + i
        self.sums[at] = len(text), sum(tokens)
        while at > 1:
            at //= 2
            self.sums[at] = self.sums[2 * at] + self.sums[2 * at + 1]

    @property
    def text(self) -> str:
        return "".join(self.texts)

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def pieces(self) -> int:
        return sum(len(sizes) for sizes, _ in self.leaves)

    def _find(self, char: int) -> tuple[int, int, int, int]:
        """(leaf, place in it, first character in the leaf, first in the text) of the first pre-token that ends at ``char`` or later."""
        at, start = 1, 0
        while at < self.width:
            at *= 2
            if start + self.sums[at, 0] < char:
                start += int(self.sums[at, 0])
                at += 1
        leaf, inside = at - self.width, 0
        for k, size in enumerate(self.leaves[leaf][0]):
            if start + inside + size >= char:
                return leaf, k, inside, start + inside
            inside += size
        return leaf, len(self.leaves[leaf][0]), inside, start + inside

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters start to end; only pre-tokens that this can change are encoded anew."""
        leaf, place, inside, base = self._find(max(0, start - CONTEXT))
        start, end = start - base, end - base  # from here on, characters count from that pre-token
        changed, shift = start + len(new), len(new) - (end - start)
        head, loaded = self.texts[leaf][:inside], leaf + 1
        old = self.texts[leaf][inside:]
        while len(old) < end:
            old, loaded = old + "".join(self.texts[loaded : 2 * loaded - leaf]), min(2 * loaded - leaf, len(self.leaves))
        text = old[:start] + new + old[end:]
        sizes: list[int] = []
        tokens: list[int] = []
        at = old_at = 0
        old_leaf, old_place = leaf, place
        while True:
            # old pre-tokens up to where the new ones have come
            while old_leaf < len(self.leaves) and (old_at < end or old_at + shift < at):
                if old_place == len(self.leaves[old_leaf][0]):
                    old_leaf, old_place = old_leaf + 1, 0
                    continue
                old_at += self.leaves[old_leaf][0][old_place]
                old_place += 1
            if at >= changed and old_at >= end and old_at + shift == at:
                break
            found = self.count.pattern.match(text, at)
            while loaded < len(self.leaves) and (found is None or found.end() + CONTEXT > len(text)):
                text, loaded = text + "".join(self.texts[loaded : 2 * loaded - leaf]), min(2 * loaded - leaf, len(self.leaves))
                found = self.count.pattern.match(text, at)
            if found is None:
                break
            sizes.append(len(found[0]))
            tokens.append(self.count[found[0]])
            at = found.end()
        self.encoded += len(sizes)
        if old_leaf == len(self.leaves):
            old_leaf, old_place = old_leaf - 1, len(self.leaves[-1][0])
        (head_sizes, head_tokens), (tail_sizes, tail_tokens) = self.leaves[leaf], self.leaves[old_leaf]
        rest = sum(tail_sizes[old_place:])
        tail = self.texts[old_leaf][len(self.texts[old_leaf]) - rest :]
        made = head_sizes[:place] + sizes, head_tokens[:place] + tokens
        if leaf == old_leaf:
            self._put(leaf, head + text[:at] + tail, made[0] + tail_sizes[old_place:], made[1] + tail_tokens[old_place:])
        else:
            self._put(leaf, head + text[:at], *made)
            for i in range(leaf + 1, old_leaf):
                self._put(i, "", [], [])
            self._put(old_leaf, tail, tail_sizes[old_place:], tail_tokens[old_place:])
        if len(self.leaves[leaf][0]) > 8 * LEAF or 2 * self._emptied > len(self.leaves) > 1:
            self._deal(self.text, [s for own, _ in self.leaves for s in own], [t for _, counts in self.leaves for t in counts])


def count_tokens(docs: DataFrame, edits: str = MASKED, mask: str = "[MASKED]", id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """Tokens of every whole text before and after the edits that a pattern makes.

    Every match of ``edits`` is replaced by ``mask``. The text's segment tree is
    built once; each edit then encodes only the pre-tokens around it and
    updates the sums above them, and the result equals encoding the edited text
    from the start.

    Returns doc_id, n_pretokens and n_tokens (before), n_edits,
    n_tokens_edited and n_reencoded (pre-tokens encoded for the edits), one row
    per input row. Null and empty texts have no tokens. Repeated rows stay;
    other columns are ignored.
    """
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    find = regex.compile(edits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                tree = TokenTree(value.as_py() or "", ranks)
                pieces, tokens, built = tree.pieces, tree.tokens, tree.encoded
                spans = [m.span() for m in find.finditer(tree.text)]
                for start, end in reversed(spans):
                    tree.edit(start, end, mask)
                rows.append((pieces, tokens, len(spans), tree.tokens, tree.encoded - built))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", "n_pretokens", "n_tokens", "n_edits", "n_tokens_edited", "n_reencoded"])

    return picked.mapInArrow(count, f"doc_id {picked.dtypes[0][1]}, n_pretokens long, n_tokens long, n_edits long, n_tokens_edited long, n_reencoded long")
