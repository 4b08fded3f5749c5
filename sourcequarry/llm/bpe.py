"""BPE encoding and decoding for byte-level vocabularies with a word-end suffix.

A word becomes its byte symbols, the last one with the suffix. A segment tree holds, for each
adjacent pair of symbols, its merge rank and place; the root is the lowest rank, leftmost among
equals. Merging there changes three pairs, each with one walk from leaf to root, until the root
is empty: a word of n symbols takes O(n log n), however long it is.

Texts are normalised to NFC, lower-cased character by character and cut by the vocabulary's own
pattern; strings of special tokens inside a text are those tokens. White space never reaches a
word, so it needs no replacement first. The vocabulary file is read by the driver and broadcast
(two to three megabytes; more than ``FILE_BYTES`` is refused). Encoded words are kept in a
bounded cache for each worker.

Defined results: null and empty texts have no tokens and decode to the empty text; equal rows
give equal rows; an empty table stays empty; columns of the input that carry a result's name are
replaced, all others stay. Ids are packed as little-endian unsigned 32-bit integers.
"""

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sourcequarry.llm.common import with_computed

FILE_BYTES = 64 << 20
#: Words whose ids a worker keeps; then it starts anew.
CACHED_WORDS = 400_000
#: Task shape: characters of text split at a time, words merged in step, and the bytes of the longest of these.
RUN_CHARS, WORDS_TOGETHER, LONGEST_TOGETHER = 2_000_000, 20_000, 33
NONE = 1 << 62


def _byte_symbols() -> list[str]:
    """A printable character for each byte: itself if it is printable Latin-1, else the next
    one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


# --- fixed values: what the vocabulary's library knows of Unicode beyond Python's tables ---------
#: Letters and numbers that Unicode 16 added.
LETTERS_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C),
    (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA)]
#: Capitals that Unicode 16 and 17 added, first and last, and the small letter of the first.
CAPITALS = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3),
    (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB)]
# --- end of fixed values -------------------------------------------------------------------------

_SMALL = {c: small + c - first for first, last, small in CAPITALS for c in range(first, last + 1)}


@functools.cache
def _younger() -> frozenset[str]:
    """Letters and numbers of the pattern engine that neither Python's Unicode nor Unicode 16 has, and
    the library does not either."""
    classed = regex.compile(r"[\p{L}\p{N}]+")
    known = {c for first, last in LETTERS_16 for c in range(first, last + 1)}
    out = []
    for run in classed.finditer("".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))):
        out += [c for c in run[0] if unicodedata.category(c) == "Cn" and ord(c) not in known]
    return frozenset(out)


class Tokenizer:
    """The tables of a vocabulary file, and encoding of whole texts."""

    def __init__(self, file: str):
        spec = json.loads(file)
        model = spec["model"]
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or len(splits) != 1 or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("a BPE vocabulary with one split pattern, NFC and lower case is expected")
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.suffix = model["end_of_word_suffix"] or ""
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[self.vocab[a] << 32 | self.vocab[b]] = rank, self.vocab[a + b]
        symbols = _byte_symbols()
        self.inner = [self.vocab[s] for s in symbols]
        self.last = [self.vocab[s + self.suffix] for s in symbols]
        self.words = regex.compile(splits[0])
        self.rare = _younger().union(map(chr, _SMALL))
        self.least_rare = min(self.rare)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pairs = PairTable(self.merges)
        self.cache: dict[str, bytes] = {}

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of every text. Texts are taken in runs of about ``RUN_CHARS``."""
        out, at = [], 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars < RUN_CHARS):
                chars += len(texts[end] or "")
                end += 1
            pieces = [self._pieces(t) for t in texts[at:end]]
            if len(self.cache) > CACHED_WORDS:
                self.cache.clear()
            self._learn({w for text in pieces for words in text if isinstance(words, list) for w in words})
            get = self.cache.__getitem__
            out += [b"".join(p if isinstance(p, bytes) else b"".join(map(get, p)) for p in text) for text in pieces]
            at = end
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def _pieces(self, text: str | None) -> list:
        """Words between special tokens, and the packed ids of these."""
        out = []
        for i, piece in enumerate(self.specials.split(text) if text and self.specials else [text or ""]):
            if i % 2:
                out.append(np.uint32(self.special[piece]).tobytes())
            else:
                out.append(self._words_of(unicodedata.normalize("NFC", piece).replace("Σ", "σ")))
        return out

    def _words_of(self, text: str) -> list[str]:
        """The pattern's words in lower case; what is younger than the library is no letter to it."""
        if text.isascii() or max(text) < self.least_rare or self.rare.isdisjoint(text):
            return self.words.findall(text.lower())
        text, younger = text.translate(_SMALL).lower(), _younger()
        plain = "".join("\ufffd" if c in younger else c for c in text)  # a symbol, one for one
        return [text[m.start():m.end()] for m in self.words.finditer(plain)]

    def _learn(self, words: set[str]) -> None:
        """Encode the words that the cache lacks: short ones many at a time, long ones singly."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for word in words - self.cache.keys():
            data = word.encode()
            if len(data) > LONGEST_TOGETHER:
                self.cache[word] = np.array(merge_pairs(self._symbols(data), self.merges), "<u4").tobytes()
            else:
                by_size.setdefault(max(1, (len(data) - 2).bit_length()), []).append((word, data))
        for bits, some in by_size.items():
            for i in range(0, len(some), WORDS_TOGETHER):
                part = some[i:i + WORDS_TOGETHER]
                for (word, _), packed in zip(part, self._merge_many([d for _, d in part], 1 << bits), strict=True):
                    self.cache[word] = packed

    def _symbols(self, data: bytes) -> list[int]:
        return [*(self.inner[b] for b in data[:-1]), self.last[data[-1]]]

    def _merge_many(self, words: list[bytes], size: int) -> list[bytes]:
        lengths = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(size + 1, b"\0") for w in words), np.uint8).reshape(len(words), size + 1)
        ids = np.array(self.inner)[raw]
        rows = np.arange(len(words))
        ids[rows, lengths - 1] = np.array(self.last)[raw[rows, lengths - 1]]
        ids[np.arange(size + 1) >= lengths[:, None]] = -1
        merge_together(ids, self.pairs)
        left = ids >= 0
        flat, ends = ids[left].astype("<u4").tobytes(), np.cumsum(left.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def decode(self, packed: bytes | None) -> str:
        """Tokens joined by spaces, as for a vocabulary file without a decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(packed or b"", "<u4").tolist()))

    def decode_text(self, packed: bytes | None) -> str:
        """Text with one space after each word: symbols become bytes again."""
        byte_of = {s: b for b, s in enumerate(_byte_symbols())}
        out = []
        for token in map(self.tokens.__getitem__, np.frombuffer(packed or b"", "<u4").tolist()):
            ended = bool(self.suffix) and token.endswith(self.suffix)
            if token in self.special:
                out.append(token)
                continue
            stem = token[:-len(self.suffix)] if ended else token
            out.append(bytes(byte_of[s] for s in stem) + (b" " if ended else b""))
        return b"".join(x.encode() if isinstance(x, str) else x for x in out).decode("utf-8", "replace")


class PairTable:
    """Ranks and merged ids of pairs, looked up many at a time in a sorted array."""

    def __init__(self, merges: dict[int, tuple[int, int]]):
        self.keys = np.array(sorted(merges) or [-1], np.int64)
        ordered = [merges.get(k, (0, 0)) for k in self.keys.tolist()]
        self.rank = np.array([r for r, _ in ordered], np.int64)
        self.merged = np.zeros(int(self.rank.max()) + 1, np.int64)  # by rank
        self.merged[self.rank] = [i for _, i in ordered]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """-1 where the pair does not merge; ids below 0 stand for no symbol."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (left >= 0) & (right >= 0), self.rank[at], -1)


def merge_together(ids: np.ndarray, pairs: PairTable) -> None:
    """``merge_pairs`` for many words in step: row by row the ids of a word, -1 where it has no
    symbol; merged rows keep the ids where the merged symbols began. A row has one place more
    than its segment tree has leaves, a power of two."""
    n_words, size = ids.shape[0], ids.shape[1] - 1
    rank = pairs.ranks(ids[:, :-1], ids[:, 1:])
    tree = np.full((n_words, 2 * size), NONE, np.int64)
    tree[:, size:] = np.where(rank >= 0, rank * size + np.arange(size), NONE)
    level = size
    while level > 1:  # parents of the leaves, then of those, up to the root at 1
        tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
        level //= 2
    after = np.tile(np.arange(1, size + 3), (n_words, 1))
    before = np.tile(np.arange(-1, size + 1), (n_words, 1))
    ids = ids if ids.flags.writeable else ids.copy()
    word = np.arange(n_words)

    def put(word: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        flat, base = tree.reshape(-1), word * (2 * size)
        node = leaf + size
        flat[base + node] = value
        while node.size and (node := node >> 1)[0] >= 1:
            child = base + 2 * node
            flat[base + node] = np.minimum(flat[child], flat[child + 1])

    def key(rank: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        return np.where(rank >= 0, rank * size + leaf, NONE)

    while True:
        root = tree[word, 1]
        word, root = word[root < NONE], root[root < NONE]
        if not len(word):
            return
        i = root % size
        j = after[word, i]
        k = after[word, j]
        ids[word, i] = pairs.merged[root // size]
        ids[word, j] = -1
        after[word, i] = k
        before[word, k] = i
        inner = k <= size
        right = np.where(inner, ids[word, np.minimum(k, size)], -1)
        put(word, i, key(pairs.ranks(ids[word, i], right), i))
        has_leaf = j < size
        put(word[has_leaf], j[has_leaf], np.full(int(has_leaf.sum()), NONE))
        h = before[word, i]
        on_left = h >= 0
        w, h, i = word[on_left], h[on_left], i[on_left]
        put(w, h, key(pairs.ranks(ids[w, h], ids[w, i]), h))


def merge_pairs(ids: list[int], merges: dict[int, tuple[int, int]]) -> list[int]:
    """Apply the leftmost lowest-ranked merge until none is left. ``merges``: (rank, merged id)
    by left id << 32 | right id."""
    n = len(ids)
    if n < 2:
        return ids
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    none = NONE
    tree = [none] * (2 * size)
    for i in range(n - 1):
        found = merges.get(ids[i] << 32 | ids[i + 1])
        if found:
            tree[size + i] = found[0] * n + i
    for node in range(size - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (root := tree[1]) < none:
        i = root % n
        j = after[i]
        ids[i] = merges[ids[i] << 32 | ids[j]][1]
        k = after[i] = after[j]
        ids[j] = -1
        changed = [(i, none), (j, none)] if j < n - 1 else [(i, none)]
        if k < n:
            before[k] = i
            found = merges.get(ids[i] << 32 | ids[k])
            if found:
                changed[0] = (i, found[0] * n + i)
        h = before[i]
        if h >= 0:
            found = merges.get(ids[h] << 32 | ids[i])
            changed.append((h, found[0] * n + h if found else none))
        for leaf, value in changed:
            node = size + leaf
            if tree[node] == value:
                continue
            tree[node] = value
            while node > 1:
                node >>= 1
                left, right = tree[2 * node], tree[2 * node + 1]
                low = left if left < right else right
                if tree[node] == low:
                    break
                tree[node] = low
    return [x for x in ids if x >= 0]


_loaded: dict[str, Tokenizer] = {}


def _tokenizer(name: str, file) -> Tokenizer:
    """One for each worker process and vocabulary."""
    if name not in _loaded:
        _loaded[name] = Tokenizer(file.value)
    return _loaded[name]


def _shipped(spark: SparkSession, path: str):
    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    size = fs.get_file_info(at).size
    if size > FILE_BYTES:
        raise ValueError(f"{path} has {size} bytes; a vocabulary file has {FILE_BYTES} at most")
    with fs.open_input_stream(at) as f:
        return spark.sparkContext.broadcast(f.read().decode())


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", drop_text: bool = False) -> DataFrame:
    """``docs`` with the packed ids of their whole texts."""
    file = _shipped(docs.sparkSession, vocabulary)
    return with_computed(docs, text, ids, T.BinaryType(), pa.binary(),
                         lambda texts: _tokenizer(vocabulary, file).encode_all(texts), drop_source=drop_text)


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded", as_text: bool = False) -> DataFrame:
    """``encoded`` with its tokens joined by spaces, or as readable text."""
    file, method = _shipped(encoded.sparkSession, vocabulary), "decode_text" if as_text else "decode"
    return with_computed(encoded, ids, decoded, T.StringType(), pa.string(),
                         lambda packed: list(map(getattr(_tokenizer(vocabulary, file), method), packed)))


def token_count(ids: str | Column = "ids") -> Column:
    return (F.octet_length(ids) / 4).cast("long")
