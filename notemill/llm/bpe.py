"""Operator 2: BPE encoding and decoding by speculate and verify.

Each different piece of text is first covered by the longest vocabulary entries
from left to right. A cover is the tokenizer's own result exactly when no merge
crosses any of its inner boundaries, and whether a merge crosses a boundary
depends on the two tokens beside it alone. So all adjacent pairs of a batch are
tested at once with numpy; only pieces with a failing pair are merged one merge
at a time. Pieces repeat a lot, hence every batch works on its different pieces
and a bounded table keeps those of earlier batches. Texts with characters outside the
vectorised cutter's table are normalised and cut by the library, their pieces encoded like all others.

Nothing is shuffled: each document is encoded where it is read, in slices of
about ``STEP_BYTES``. Defined results: null or empty text has no ids and decodes
to the empty text; other columns are ignored; repeated rows give repeated results;
an empty table gives an empty one.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from notemill.llm.common import Texts, distinct, spread, steps
from notemill.llm.pretoken import COVERED, SPACES, classes, unusual, word_pieces

#: Stands for the mark of a word's end; no UTF-8 text has this byte.
END = b"\xff"
#: Merge ranks of single symbols, and "never".
BASE, NEVER = -1, np.iinfo(np.int64).max
#: Different pieces whose ids a task remembers between batches.
REMEMBERED = 500_000


def byte_of() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, others for 256 and up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def library_of(path: str):
    """The library's tokenizer, whole texts, on the one core that Spark gives a task."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class WordBpe:
    """A vocabulary with word ends, read from a tokenizers file."""

    def __init__(self, path: str):
        self.library = library_of(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.stand = stand = byte_of()
        suffix = spec["model"]["end_of_word_suffix"]
        self.special = [x["content"].encode() for x in spec["added_tokens"]]
        names: dict[int, str] = {i: s for s, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        added = {x["id"] for x in spec["added_tokens"]}
        size = max(names) + 1
        #: What decoding writes for each id; the file has no decoder, so names stand as they are, with blanks between.
        self.names = pa.array([names.get(i, "").encode() for i in range(size)], pa.large_binary())

        def raw(name: str) -> bytes:
            end = name.endswith(suffix)
            return bytes(stand[c] for c in (name[: -len(suffix)] if end else name)) + END * end

        self.id_of = {raw(s): i for s, i in spec["model"]["vocab"].items() if i not in added}
        self.longest = max(map(len, self.id_of))
        self.rank = np.full(size, BASE, np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            x, y = self.id_of[raw(a)], self.id_of[raw(b)]
            made = self.id_of[raw(a) + raw(b)]
            if (x, y) not in self.merge:
                self.merge[x, y] = (rank, made)
            if self.left[made] < 0:
                self.left[made], self.right[made], self.rank[made] = x, y, rank
        keys = np.array([x << 32 | y for x, y in self.merge], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.merge.values()], np.int64)[order]
        made = np.flatnonzero(self.left >= 0)
        sound = np.ones(size, bool)
        sound[made] = self.joined(self.left[made], self.right[made], own=self.rank[made])
        for t in made[np.argsort(self.rank[made], kind="stable")]:  # a token is reached only if its parts are
            sound[t] &= sound[self.left[t]] and sound[self.right[t]]
        self.sound = sound
        self.unsafe = ~classes()[1].copy()
        for cp in np.flatnonzero(~self.unsafe):
            c = chr(cp)
            if cp not in SPACES and (self.library.normalizer.normalize_str(c) != pc.utf8_lower(c).as_py()):
                self.unsafe[cp] = True
        self.known: dict[bytes, bytes] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, NEVER without one."""
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)

    def joined(self, a: np.ndarray, b: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Whether each boundary between tokens a and b holds while merges run in order of rank.

        Goes back in time from the finished tokens: ``a`` and ``b`` stand at the boundary
        until ``until_a`` and ``until_b``, when a larger token takes them in. A merge across
        comes first if its rank is lower than both; on a tie the left of two equal merges
        runs first. The token made last is then undone. ``own``: rank of the merge that
        makes the pair itself, by which vocabulary entries are tested.
        """
        a, b = a.copy(), b.copy()
        until_a = np.full(len(a), NEVER) if own is None else own.copy()
        until_b = until_a.copy()
        holds, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            r = self.ranks(x, y)
            crossed = (r < until_a[live]) & (r <= until_b[live]) if own is None else (r < until_a[live]) & (r <= until_b[live]) & (r != own[live])
            holds[live[crossed]] = False
            left_last = self.rank[x] > self.rank[y]
            done = crossed | ((self.rank[x] == BASE) & (self.rank[y] == BASE))
            back_a, back_b = live[left_last & ~done], live[~left_last & ~done]
            until_a[back_a] = self.rank[a[back_a]]
            a[back_a] = self.right[a[back_a]]
            until_b[back_b] = self.rank[b[back_b]]
            b[back_b] = self.left[b[back_b]]
            live = live[~done]
        return holds

    def longest_match(self, piece: bytes) -> list[int]:
        """The greedy cover; a word's last byte and its end mark stay together."""
        out, at, n, id_of = [], 0, len(piece), self.id_of
        while at < n:
            for upto in range(min(n, at + self.longest), at, -1):
                if upto != n - 1 and (found := id_of.get(piece[at:upto])) is not None:
                    out.append(found)
                    at = upto
                    break
        return out

    def merged(self, piece: bytes) -> list[int]:
        """Exact merging: the lowest rank first, the leftmost on ties, from a queue over a linked list."""
        body = piece[:-1]
        ids = [self.id_of[body[i : i + 1]] for i in range(len(body) - 1)] + [self.id_of[body[-1:] + END]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, x, y, made = heapq.heappop(queue)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := self.merge.get((made, ids[k])):
                    heapq.heappush(queue, (m[0], i, made, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := self.merge.get((ids[h], made))):
                heapq.heappush(queue, (m[0], h, ids[h], made, m[1]))
        return [x for x in ids if x >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each different piece, as 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = [p for p in pieces if p not in known]
        if new:
            covers = [self.longest_match(p + END) for p in new]
            sizes = np.fromiter(map(len, covers), np.int64, len(covers))
            flat = np.fromiter((t for c in covers for t in c), np.int64, int(sizes.sum()))
            of = np.repeat(np.arange(len(new)), sizes)
            inner = np.flatnonzero(of[1:] == of[:-1])
            pairs, back = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
            holds = self.joined(pairs >> 32, pairs & 0xFFFFFFFF)[back] if len(pairs) else np.zeros(0, bool)
            bad = np.zeros(len(new), bool)
            bad[of[inner[~holds]]] = True
            bad[of[~self.sound[flat]]] = True
            raw, ends = flat.astype("<u4").tobytes(), np.cumsum(sizes) * 4
            for i, p in enumerate(new):
                known[p] = np.array(self.merged(p + END), "<u4").tobytes() if bad[i] else raw[ends[i] - 4 * sizes[i] : ends[i]]
        return [known[p] for p in pieces]

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids start (one more entry at the end)."""
        whole = unusual(texts, self.unsafe, self.special)
        usual, odd = np.flatnonzero(~whole), np.flatnonzero(whole)
        plain = texts.pick(usual) if len(odd) else texts
        lower = Texts(np.frombuffer(pc.utf8_lower(pa.array([plain.data.tobytes()], pa.large_binary()).cast(pa.large_string()))[0].as_buffer(), np.uint8), plain.at) if len(plain.data) else plain
        if len(lower.data) != len(plain.data):  # a lower-case form of another size: lower text by text
            each = [pc.utf8_lower(plain.row(i).decode()).as_py().encode() for i in range(len(plain))]
            lower = Texts(np.frombuffer(b"".join(each), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64))
        pieces, bounds = word_pieces(lower)
        kinds, index = distinct(pieces)
        found = self.encode_pieces(kinds)
        ids, at = lay_out(found, index, bounds)
        return weave(ids, at, usual, {int(i): self.encode_odd(texts.row(i)) for i in odd}, len(texts)) if len(odd) else (ids, at)

    def encode_odd(self, raw: bytes) -> np.ndarray:
        """Ids of a text with characters outside the table: the library normalises and cuts it, its pieces are encoded as all others.

        Only a text that holds a special token's own string is left to the library.
        """
        text = raw.decode()
        if any(s in raw for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        pieces = [bytes(map(self.stand.__getitem__, p)) for p, _ in cut if p]
        return np.frombuffer(b"".join(self.encode_pieces(pieces)), "<u4").astype(np.int64)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The decoded texts, special tokens included."""
        names = self.names.take(pa.array(ids))
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), names), pa.scalar(b" ", pa.large_binary()))


def lay_out(found: list[bytes], index: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces in text order, from the ids of each kind of piece."""
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    flat = np.frombuffer(b"".join(found), "<u4").astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    return flat[spread(starts[index], sizes[index])], np.concatenate([[0], np.cumsum(sizes[index])])[bounds]


def weave(ids: np.ndarray, at: np.ndarray, rows: np.ndarray, others: dict[int, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Puts ids of ``rows`` and of the other rows in the rows' order."""
    sizes = np.zeros(n, np.int64)
    sizes[rows] = np.diff(at)
    for i, x in others.items():
        sizes[i] = len(x)
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if n else 0, np.int64)
    out[spread((ends - sizes)[rows], sizes[rows])] = ids
    for i, x in others.items():
        out[ends[i] - sizes[i] : ends[i]] = x
    return out, np.concatenate([[0], ends])


@cache
def vocabulary(path: str) -> WordBpe:
    """One per Python worker."""
    return WordBpe(path)


def bpe_encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", decoded: bool = False) -> DataFrame:
    """Ids of each text, as little-endian unsigned 32-bit integers in one binary column.

    Returns ``key, ids binary`` and with ``decoded`` also the text that the ids decode to.
    ``path`` is the vocabulary file on the workers.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for rows, texts in steps(batches, "t"):
            ids, at = bpe.encode(texts)
            out = [rows.column(0), Texts(np.ascontiguousarray(ids.astype("<u4")).view(np.uint8), at * 4).arrow().cast(pa.binary())]
            if decoded:
                out.append(bpe.decode(ids, at).cast(pa.large_string()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=["k", "ids", "decoded"][: len(out)])

    out = docs.selectExpr(f"`{key}` AS k", f"`{text}` AS t").mapInArrow(run, f"k {kind}, ids binary" + ", decoded string" * decoded)
    return out.withColumnRenamed("k", key)


def bpe_decode(tokens: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """Texts of ids as ``bpe_encode`` returns them: ``key, decoded string``; null ids give the empty text."""
    kind = tokens.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for rows, raw in steps(batches, "i"):
            texts = bpe.decode(np.ascontiguousarray(raw.data).view("<u4").astype(np.int64), raw.at // 4)
            yield pa.RecordBatch.from_arrays([rows.column(0), texts.cast(pa.large_string()).cast(pa.string())], names=["k", "decoded"])

    return tokens.selectExpr(f"`{key}` AS k", f"`{ids}` AS i").mapInArrow(run, f"k {kind}, decoded string").withColumnRenamed("k", key)
