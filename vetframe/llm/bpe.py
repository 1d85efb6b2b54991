"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

Leaf i of the tree holds the rank of the pair that starts at symbol i together
with i itself, so the root is the leftmost pair of the lowest rank.  A merge
changes three leaves; each change climbs to the root in log2(n) steps.  The
merge loop ends when the root holds no mergeable pair.

``PairTree`` is that loop for one word.  ``encode_words`` runs the same trees
for many short words side by side in numpy.  Texts are cut into pre-tokens as
the byte-level pre-tokenizer of the ``tokenizers`` library cuts them; equal
pre-tokens of a chunk are encoded once; they are found by hash and compared in full.

Defined results: null counts as the empty text, which has no ids; the special
tokens of the file are matched first and become their own ids; ids of documents
pass through unread, null and repeated ones too; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: No mergeable pair; above every rank with a place beside it.
NONE = 1 << 30
LETTER, NUMBER, SPACES, OTHER = 0, 1, 2, 3
#: Pre-tokens of at most so many bytes are encoded side by side.
SIDE_BY_SIDE = 64
#: Size of the table of pair ranks.
SLOTS = 1 << 18
#: Distinct pre-tokens that a task remembers; more than one step can hold.
CACHED = 400_000
#: Bytes of text in one step.
STEP = 1_000_000
#: White space as the library's patterns see it.
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def character_classes() -> bytes:
    """Class of every code point (letter, number, white space, other), compressed."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, every):
            first, last = ord(m[0][0]), ord(m[0][-1])
            table[first : last + 1] = kind
    table[WHITE] = SPACES
    return zlib.compress(table.tobytes(), 6)


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 18)).astype(np.int64)


class Vocabulary:
    """Merge ranks and token bytes of a byte-level BPE file, as arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in printable}
        shown |= {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in shown)}
        back = {c: b for b, c in shown.items()}
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if token not in self.special else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        self.key, self.made = key, np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.slot_key, self.slot_rank = np.full(SLOTS, -1, np.int64), np.full(SLOTS, NONE, np.int32)
        left, at = np.arange(len(key)), _slot(key)
        while len(left):  # open addressing: who comes first takes the slot, the rest try the next
            free = self.slot_key[at] < 0
            _, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[free[first]]
            self.slot_key[at[first]], self.slot_rank[at[first]] = key[left[first]], left[first]
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, at = left[rest], (at[rest] + 1) & (SLOTS - 1)
        self.classes = character_classes()

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair, or NONE; a negative id is no symbol."""
        key = np.where((a >= 0) & (b >= 0), a.astype(np.int64) << 20 | b, -2)
        at = _slot(key)
        found = self.slot_key[at]
        out = np.where(found == key, self.slot_rank[at], np.int32(NONE))
        more = np.flatnonzero((found != key) & (found >= 0) & (key >= 0))
        while len(more):
            at.flat[more] = (at.flat[more] + 1) & (SLOTS - 1)
            found = self.slot_key[at.flat[more]]
            hit = found == key.flat[more]
            out.flat[more[hit]] = self.slot_rank[at.flat[more[hit]]]
            more = more[~hit & (found >= 0)]
        return out


class PairTree:
    """The merge loop of one word over a segment tree."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.ranks = {k: i for i, k in enumerate(vocabulary.key.tolist())}
        self.made = vocabulary.made.tolist()

    def encode(self, word: bytes) -> list[int]:
        ids = self.v.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n, none, ranks = len(ids), (1 << 60, -1), self.ranks
        width = 1 << max(0, (n - 1).bit_length())
        after, before = [*range(1, n), -1] if n else [], [*range(-1, n - 1)]

        def leaf(i: int) -> tuple[int, int]:
            j = after[i]
            return (r, i) if j >= 0 and (r := ranks.get(ids[i] << 20 | ids[j])) is not None else none

        tree = [none] * width + [leaf(i) for i in range(n)] + [none] * (width - n)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        while tree[1] != none if width > 1 else False:
            rank, i = tree[1]
            j = after[i]
            ids[i], ids[j] = self.made[rank], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            for k in (j, i, before[i]):
                if k < 0:
                    continue
                value, k = none if k == j else leaf(k), k + width
                tree[k] = value
                while k > 1:
                    k >>= 1
                    low = min(tree[2 * k], tree[2 * k + 1])
                    if low == tree[k]:
                        break
                    tree[k] = low
        return [x for x in ids if x >= 0]


def _trees(v: Vocabulary, symbols: np.ndarray) -> None:
    """Merge every row of ``symbols`` (ids, then -1) in place, one tree a row; arrays are addressed flat."""
    n, width = symbols.shape
    bits, depth = width.bit_length(), width.bit_length() - 1
    low = (1 << bits) - 1
    place = np.arange(width, dtype=np.int32)
    after = np.broadcast_to(np.r_[place[1:], -1].astype(np.int32), (n, width)).copy()
    after[:, :-1][symbols[:, 1:] < 0] = -1
    before = np.broadcast_to(place - 1, (n, width)).copy()
    tree = np.full((n, 2 * width), NONE, np.int32)
    rank = v.rank_of(symbols[:, :-1], symbols[:, 1:])
    tree[:, width : 2 * width - 1] = np.where(rank < NONE, rank << bits | place[:-1], NONE)
    for size in (1 << k for k in range(depth - 1, -1, -1)):
        tree[:, size : 2 * size] = np.minimum(tree[:, 2 * size : 4 * size : 2], tree[:, 2 * size + 1 : 4 * size : 2])
    ids, after, before, tree = symbols.reshape(-1), after.reshape(-1), before.reshape(-1), tree.reshape(-1)
    rows = np.flatnonzero(tree[1 :: 2 * width] < NONE)
    root = tree[rows * (2 * width) + 1]
    while len(rows):
        base, top = rows * width, rows * (2 * width)
        i = (root & low).astype(np.int64)
        at = base + i
        j = after[at].astype(np.int64)
        made = v.made[root >> bits]
        ids[at] = made
        k = after[base + j]
        ids[base + j] = -1
        after[at] = k
        has = k >= 0
        to = base + np.where(has, k, i)
        before[to[has]] = i[has]
        h = before[at]
        had = h >= 0
        back = base + np.where(had, h, i)
        rank = v.rank_of(np.concatenate([made, np.where(had, ids[back], -1)]), np.concatenate([np.where(has, ids[to], -1), made]))
        right, left = rank[: len(rows)], rank[len(rows) :]
        tree[top + width + j] = NONE
        tree[top + width + i] = np.where(right < NONE, right << bits | i, NONE)
        g = np.where(had, h, i)
        some = np.flatnonzero(had)
        tree[(top + width + g)[some]] = np.where(left[some] < NONE, left[some] << bits | g[some], NONE)
        up = np.concatenate([j, i, g]) + width
        tops = np.concatenate([top, top, top])
        for _ in range(depth):
            below = tops + (up & ~1)
            up >>= 1
            tree[tops + up] = np.minimum(tree[below], tree[below + 1])
        root = tree[top + 1]
        keep = root < NONE
        rows, root = rows[keep], root[keep]


def encode_words(v: Vocabulary, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words ``data[start:end]`` one after another, and how many each has."""
    size = end - start
    counts, parts, places = np.zeros(len(start), np.int64), [], []
    width = 2
    lower = 0
    while width <= SIDE_BY_SIDE:
        for some in np.array_split(w := np.flatnonzero((size > lower) & (size <= width)), max(1, len(w) * width // 64_000)):
            if not len(some):
                continue
            at = start[some][:, None] + np.arange(width)
            inside = np.arange(width) < size[some][:, None]
            symbols = np.where(inside, v.byte_id[data[np.minimum(at, len(data) - 1)]], np.int32(-1))
            _trees(v, symbols)
            kept = symbols >= 0
            counts[some] = kept.sum(1)
            parts.append(symbols[kept])
            places.append(some)
        lower, width = width, 2 * width
    long = np.flatnonzero(size > SIDE_BY_SIDE)
    if len(long):
        one = PairTree(v)
        for w in long.tolist():
            ids = np.array(one.encode(data[start[w] : end[w]].tobytes()), np.int32)
            counts[w] = len(ids)
            parts.append(ids)
            places.append(np.array([w]))
    out = np.zeros(int(counts.sum()), np.int32)
    if parts:
        order = np.concatenate(places)
        first = np.cumsum(counts) - counts
        out[common.concat_ranges(first[order], counts[order])] = np.concatenate(parts)
    return out, counts


def pretokens(points: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each pre-token of texts given as code points; every text is cut by itself.

    The library's pattern is: a contraction, else an optional space and a run of
    letters, of numbers or of other characters, else white space, of which the
    last character is left to what follows.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes[points]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    cut = first.copy()
    cut[1:n] |= kind[1:] != kind[:-1]
    white = kind == SPACES
    # a run of white space before something else: its last character stands apart ...
    last = np.flatnonzero(white & cut[1:] & ~first[1:])
    cut[last] = True
    # ... and a plain space there belongs to what follows
    joined = last[points[last] == 32] + 1
    cut[joined] = False
    # contractions: an apostrophe that begins a token and stands before its letters
    quote = np.flatnonzero((points == 39) & cut[:n])
    quote = quote[(quote + 1 < n) & cut[np.minimum(quote + 1, n)] & ~first[np.minimum(quote + 1, n)]]
    if len(quote):
        a = points[quote + 1]
        b = np.where((quote + 2 < n) & ~first[np.minimum(quote + 2, n)], points[np.minimum(quote + 2, n - 1)], 0)
        one = np.isin(a, [115, 116, 109, 100])
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        some = quote[one | two]
        size = np.where(one, 2, 3)[one | two]
        cut[some + 1] = False
        cut[some + size] = True
        # the apostrophe after a contraction begins a token as well; it was cut by its class already
    start = np.flatnonzero(cut[:n])
    return start, np.r_[start[1:], n]


def _agree(a: np.ndarray, a_start: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_size: np.ndarray) -> bool:
    """Whether each span of ``a`` equals that of ``b``."""
    return np.array_equal(a_size, b_size) and np.array_equal(a[common.concat_ranges(a_start, a_size)], b[common.concat_ranges(b_start, b_size)])


class Encoder:
    """Encodes batches of texts; holds the tables of one task and the pre-tokens it met, up to ``CACHED``."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.classes = np.frombuffer(zlib.decompress(vocabulary.classes), np.uint8)
        self.hash = common.SpanHasher()
        self._forget()

    def _forget(self) -> None:
        """Hashes of the known pre-tokens in order; where their ids and their code points begin, and how many there are."""
        self.known = np.zeros(0, np.uint64)
        self.begin, self.count, self.spelt, self.size = (np.zeros(0, np.int64) for _ in range(4))
        self.store, self.spelling = np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _learn(self, h: np.ndarray, ids: np.ndarray, counts: np.ndarray, points: np.ndarray, size: np.ndarray) -> None:
        if len(self.known) + len(h) > CACHED:
            self._forget()
        at = np.searchsorted(self.known, h)
        self.known = np.insert(self.known, at, h)
        self.begin = np.insert(self.begin, at, np.cumsum(counts) - counts + len(self.store))
        self.count = np.insert(self.count, at, counts)
        self.spelt = np.insert(self.spelt, at, np.cumsum(size) - size + len(self.spelling))
        self.size = np.insert(self.size, at, size)
        self.store, self.spelling = np.concatenate([self.store, ids]), np.concatenate([self.spelling, points])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text begins (one more entry at the end)."""
        if not any(s in t for s in self.v.special for t in texts):
            return self._plain(texts)
        ids, counts = [], []
        for t in texts:  # a text with a special token is rare
            mine = []
            for part, special in self._parts(t):
                mine.append(np.array([special], np.int32) if special is not None else self._plain([part])[0])
            ids += mine
            counts.append(sum(map(len, mine)))
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.r_[0, np.cumsum(counts)].astype(np.int64)

    def _parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        while text:
            found = min(((at, s) for s in self.v.special if (at := text.find(s)) >= 0), default=None)
            if found is None:
                yield text, None
                return
            if found[0]:
                yield text[: found[0]], None
            yield found[1], self.v.special[found[1]]
            text = text[found[0] + len(found[1]) :]

    def _encoded(self, points: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of some pre-tokens, how many each has, and the code points of all."""
        chosen = points[common.concat_ranges(start, size)]
        data = np.frombuffer(chosen.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace"), np.uint8)
        wide = 1 + (chosen >= 0x80).astype(np.int64) + (chosen >= 0x800) + (chosen >= 0x10000)
        ends = np.r_[0, np.cumsum(wide)][np.cumsum(size)]
        return *encode_words(self.v, data, np.r_[0, ends[:-1]], ends), chosen

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
        start, end = pretokens(points, offsets, self.classes)
        size = end - start
        text_at = np.searchsorted(start, offsets, side="left")
        if not len(start):
            return self.store[:0], np.zeros(len(offsets), np.int64)
        h, some, which = np.unique(self.hash(points, start, end), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, h), max(len(self.known) - 1, 0))
        hit = self.known[at] == h if len(self.known) else np.zeros(len(h), bool)
        # equal hashes are taken for equal words only where all their characters agree
        old = np.flatnonzero(hit)
        same = _agree(points, start, size, points, start[some][which], size[some][which]) and _agree(points, start[some[old]], size[some[old]], self.spelling, self.spelt[at[old]], self.size[at[old]])
        if not same:
            ids, per, _ = self._encoded(points, start, size)
            return ids, np.r_[0, np.cumsum(per)][text_at]
        new = np.flatnonzero(~hit)
        if len(new):
            known = some[new]
            ids, counts, chosen = self._encoded(points, start[known], size[known])
            self._learn(h[new], ids, counts, chosen, size[known])
            if len(self.known) == len(new) < len(h):  # the others have been forgotten
                self._forget()
                return self._plain(texts)
            at = np.searchsorted(self.known, h)
        per = self.count[at][which]
        return self.store[common.concat_ranges(self.begin[at][which], per)], np.r_[0, np.cumsum(per)][text_at]

    def decode(self, ids: list[int]) -> bytes:
        """Text of the ids in UTF-8; what is no UTF-8 becomes U+FFFD."""
        raw = b"".join(map(self.v.bytes_of.__getitem__, ids))
        return raw.decode("utf-8", "replace").encode()


def encode_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id column as ``doc_id``, ``ids`` (array of int) and ``decoded`` (the round trip)."""
    v = Vocabulary(vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(v)
        for batch in batches:
            for part in common.slices(batch, limit=STEP):
                ids, at = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                decoded = [encoder.decode(ids[a:b].tolist()).decode() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, without shipping the ids themselves."""
    v = Vocabulary(vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(v)
        shown = [str(i) for i in range(len(v.bytes_of))]
        for batch in batches:
            for part in common.slices(batch, limit=STEP):
                ids, at = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                digest, decoded = [], []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    mine = ids[a:b].tolist()
                    digest.append(hashlib.sha256(",".join(map(shown.__getitem__, mine)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(encoder.decode(mine)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at), pa.int64()), pa.array(digest), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
