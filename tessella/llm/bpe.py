"""Byte-level BPE encoding and decoding.

Each match of the split pattern is a word. Merging runs in Spark higher-order
functions: a word is an array of byte values, and a fold over it merges, step by
step, the neighbours of lowest rank (the leftmost on a tie), which is the merge
order of the byte-level BPE libraries. The ranks are a literal map from the
ids of two neighbours, kept as a sparse table in two literal arrays, so that a look-up
costs the same at any vocabulary size. Decoding concatenates the tokens' bytes.

Words that occur more than once are folded once: counts over all texts are taken, and
the ``cache_words`` most frequent words (a fixed bound) are folded into a table that is
broadcast as a few packed arrays. Other words are folded where they stand, so that
nothing depends on the table but speed, and texts are never shuffled. A word that is
itself a token needs no fold, and a word of more than ``FOLD_BYTES`` bytes is merged
with a heap, in n log n steps where the fold takes n of O(n). Texts are cut into words,
and words are counted and looked up, in numpy arrays, without an object for each word;
texts that need the whole of the pattern are cut by it.

Defined results: null and empty texts have no tokens; repeated documents each get
their row; special tokens are ordinary text. Columns other than the named ones are
ignored.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tessella.llm._words import as_bytes, chunks, mix
from tessella.session import lean, materialise, ship, tidy

#: Most frequent words whose token ids are broadcast, at about 40 bytes each.
CACHE_WORDS = 1 << 20
#: Bytes of the longest word that is folded.
FOLD_BYTES = 512
_SHIFT = 1 << 20
_NONE = 2**31 - 1
#: Bytes of text that one numpy pass looks at; a longer text is a pass of its own.
_CHUNK_BYTES = 1 << 20
#: Words, distinct in their pass, that a counting task holds before it passes them on.
_HELD_WORDS = 1_000_000
#: Words that a task folds.
_TASK_WORDS = 20_000
#: Characters of a printed plan: the literal map is long, and Spark keeps every plan that it prints.
_PLAN_CHARS = 1 << 14


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ranks, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merges(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(id of left, id of right) to the rank of both joined.

    A token is only ever made from the two parts that the lower ranks leave of its
    bytes, so one pair per token is the whole rank map.
    """
    out = {}
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1], rank)) < rank]
            if not found:
                break
            at = min(found)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out[ranks[parts[0]], ranks[parts[1]]] = rank
    return out


def _packed_rows(pairs: dict[tuple[int, int], int], size: int) -> tuple[list[int], list[int]]:
    """The sparse table of ranks (row: left id, column: right id) as one array, rows displaced into each other's gaps.

    Returns the displacement of each row (and of the row of no token, id ``size``), and
    cells of rank * 2^20 + row (-1: free).
    """
    rows: dict[int, dict[int, int]] = {}
    for (left, right), rank in pairs.items():
        rows.setdefault(left, {})[right] = rank
    room = 5 * len(pairs) // 2 + 1
    moves, cells = [0] * (size + 1), [-1] * (room + size + 1)
    for left in sorted(rows, key=lambda x: (-len(rows[x]), x)):
        row = rows[left]
        # Tried in a fixed scattered order; the array has room to spare, so few tries do.
        at = left * 7919 % room
        while any(cells[at + right] >= 0 for right in row):
            at = (at + 104_729) % room
        moves[left] = at
        for right, rank in row.items():
            cells[at + right] = rank * _SHIFT + left
    return moves, cells


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_words(words: Column, ranks: dict[bytes, int]) -> Column:
    """array<array<int>> of byte values to array<array<bigint>> of token ids.

    The fold's state has a number for each token: the rank of merging it with the next
    one, times 2^20, plus its id; before all there is one of no token. The least number
    is the next merge; equal numbers are equal pairs, of which the leftmost comes first.
    The rank map stands in the plan once.
    """
    size = max(ranks.values()) + 1
    moves, cells = _packed_rows(merges(ranks), size)
    literal = lambda values: F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), "array<bigint>")
    tables = F.struct(literal(moves).alias("moves"), literal(cells).alias("cells"), literal([ranks[bytes([b])] for b in range(256)]).alias("single"))
    last = _NONE * _SHIFT

    def id_of(number: Column) -> Column:
        return number.bitwiseAND(_SHIFT - 1)

    def fold(word: Column, moves: Column, cells: Column, single: Column) -> Column:
        def number(token: Column, following: Column) -> Column:
            """Looked up in constant time."""
            held = F.get(cells, (F.get(moves, token.cast("int")) + following).cast("int"))
            return _let(held, lambda h: F.when(id_of(h) == token, h).otherwise(token + last))

        def merge(state: Column, least: Column, at: Column) -> Column:
            token = F.shiftright(least, 20)
            new = F.struct(number(id_of(F.get(state, at - 2)), token).alias("before"), number(token, id_of(F.get(state, at + 1))).alias("merged"))
            # Filtering and mapping cost less here than slices that are put together.
            return _let(new, lambda n: F.transform(F.filter(state, lambda x, i: i != at), lambda x, i: F.when(i == at - 1, n["merged"]).when(i == at - 2, n["before"]).otherwise(x)))

        def step(state: Column, _: Column) -> Column:
            return _let(F.array_min(state), lambda least: F.when(least >= last, state).otherwise(
                _let(F.array_position(state, least).cast("int"), lambda at: merge(state, least, at))))

        start = F.concat(F.array(F.lit(last + size)), F.transform(word, lambda b, i: number(F.get(single, b), F.get(single, F.get(word, i + 1)))))
        return F.aggregate(word, start, step, lambda state: F.transform(F.filter(state, lambda x, i: i > 0), id_of))

    return _let(tables, lambda t: F.transform(words, lambda word: fold(word, t["moves"], t["cells"], t["single"])))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one word of any length, by a heap over the pairs of neighbours."""
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = [*range(1, len(word)), -1], [-1, *range(len(word) - 1)]
    waiting = [(r, i, 2) for i in range(len(word) - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(waiting)

    def offer(i: int) -> None:
        if i >= 0 and after[i] >= 0:
            joined = parts[i] + parts[after[i]]
            if (rank := ranks.get(joined)) is not None:
                heapq.heappush(waiting, (rank, i, len(joined)))

    while waiting:
        _, i, size = heapq.heappop(waiting)
        j = after[i] if parts[i] is not None else -1
        if j < 0 or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i], parts[j], after[i] = parts[i] + parts[j], None, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [ranks[p] for p in parts if p is not None]


#: Fixed value: the split pattern of the common byte-level vocabularies, as the contract's library has it.
COMMON_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same on UTF-8 for texts whose characters beyond ASCII are letters, and any other character.
_PLAIN_PATTERN = rb" ?[A-Za-z\x80-\xff]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\sA-Za-z0-9\x80-\xff]+|\s+(?!\S)|\s+"
_OTHER = rb"\xc2[^\xaa\xb5\xba]|\xc3[\x97\xb7]|[\xca-\xff]"


def word_finder(pattern: str):
    """A function from a text in UTF-8 to its matches, by the faster of two equal ways."""
    import regex

    full = regex.compile(pattern).findall
    slow = lambda text: [w.encode() for w in full(text.decode())]
    if pattern != COMMON_PATTERN:
        return slow
    plain, other = re.compile(_PLAIN_PATTERN).findall, re.compile(_OTHER).search
    return lambda text: slow(text) if other(text) else plain(text)


#: Classes of bytes for plain texts: letters, digits, white space, others.
_LETTER, _DIGIT, _SPACE, _SIGN = range(4)
_CLASS = np.full(256, _SIGN, np.uint8)
for _i in range(256):
    if _i >= 0x80 or bytes([_i]).isalpha():
        _CLASS[_i] = _LETTER
    elif bytes([_i]).isdigit():
        _CLASS[_i] = _DIGIT
    elif bytes([_i]).isspace():
        _CLASS[_i] = _SPACE


def _plain_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the words of ``_PLAIN_PATTERN`` begin in texts of one byte array (text i: offsets[i] to offsets[i + 1]), as flags."""
    kind, n = _CLASS[data], len(data)
    opens = np.zeros(n + 1, bool)
    opens[offsets] = True
    begins = opens[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    # The last white space before something else is a word of its own, or a space that belongs to it.
    last = (kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~opens[1:n]
    begins[:-1] |= last
    begins[1:] &= ~(last & (data[:-1] == 0x20))
    # Short forms: an apostrophe that begins a word, with letters of the same text.
    for i in np.flatnonzero((data == 0x27) & begins).tolist():
        if i + 1 >= n or opens[i + 1]:
            continue
        size = 2 if data[i + 1] in b"stmd" else 3 if i + 2 < n and not opens[i + 2] and data[i + 1 : i + 3].tobytes() in (b"re", b"ve", b"ll") else 0
        if size:
            begins[i + 1] = False
            begins[i + 2 : i + size] = False
            if i + size < n:
                begins[i + size] = True
    return begins


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; the data must end with eight bytes to spare."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


@dataclass
class Words:
    """Words of a run of texts: those of text i are first[i]:first[i + 1]."""

    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i] + self.sizes[i]].tobytes()


def _hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64 bits for each word, of eight bytes at a time."""
    eights = _eights(data)
    out = mix(eights[starts] & _MASKS[np.minimum(sizes, 8)]) + sizes.astype(np.uint64)
    more = np.flatnonzero((sizes > 8) & (sizes <= FOLD_BYTES))
    k = 8
    while len(more):
        left = sizes[more] - k
        out[more] = mix(out[more] + (eights[starts[more] + k] & _MASKS[np.minimum(left, 8)]))
        k += 8
        more = more[left > 8]
    for i in np.flatnonzero(sizes > FOLD_BYTES).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + sizes[i]])
    return out


def word_scanner(pattern: str):
    """A function from texts in UTF-8 to their ``Words``: what ``word_finder`` finds, in one array."""
    find, other = word_finder(pattern), re.compile(_OTHER).search

    def scan(texts: list[bytes]) -> Words:
        # Of texts that need the pattern itself: their words in a row, and the words' sizes.
        slow = {i: find(t) for i, t in enumerate(texts) if t and (pattern != COMMON_PATTERN or other(t))}
        parts = [b"".join(slow[i]) if i in slow else t for i, t in enumerate(texts)]
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
        data = np.frombuffer(b"".join([*parts, bytes(8)]), np.uint8)
        n = int(offsets[-1])
        begins = _plain_starts(data[:n], offsets) if n else np.zeros(0, bool)
        for i, words in slow.items():
            ends = np.cumsum([len(w) for w in words if w], dtype=np.int64)
            begins[offsets[i] : offsets[i + 1]] = False
            begins[offsets[i] + np.concatenate([np.zeros(min(1, len(ends)), np.int64), ends[:-1]])] = True
        starts = np.flatnonzero(begins)
        sizes = np.diff(starts, append=n)
        return Words(data, starts, sizes, np.searchsorted(starts, offsets), _hashes(data, starts, sizes))

    return scan


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of each run of that size, in a row."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _distinct(hashes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One place for each hash, and the sum of its counts. Low bits of the hash give way to the place, so one sort does."""
    n = len(hashes)
    bits = np.uint64(max(1, (n - 1).bit_length()))
    keys = np.sort(hashes >> bits << bits | np.arange(n, dtype=np.uint64))
    at = (keys & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    heads = np.flatnonzero(np.diff(keys >> bits, prepend=~keys[:1] >> bits))
    return at[heads], np.diff(heads, append=n) if counts is None else np.add.reduceat(counts[at], heads)


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Parts of these sizes of one array, as binaries."""
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    if offsets[-1] >= 1 << 31:
        raise ValueError("more than 2 GB in one batch")
    offsets = offsets.astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _count_words(pattern: str):
    """Distinct words and their numbers. Two words of one hash count as one of them: nothing but speed depends on that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, held, total = word_scanner(pattern), [], 0

        def flush():
            hashes, counts, sizes, data = map(np.concatenate, zip(*held))
            held.clear()
            at, n = _distinct(hashes, counts)
            starts = np.cumsum(sizes) - sizes
            return pa.RecordBatch.from_arrays([_binary(data[_places(starts[at], sizes[at])], sizes[at]), pa.array(n, pa.int64())], names=["word", "n"])

        for batch in batches:
            texts = as_bytes(batch.column(0))
            for a, b in chunks(texts, _CHUNK_BYTES):
                words = scan(texts[a:b])
                if not len(words.starts):
                    continue
                at, n = _distinct(words.hashes)
                held.append((words.hashes[at], n, words.sizes[at], words.data[_places(words.starts[at], words.sizes[at])]))
                total += len(at)
                if total > _HELD_WORDS:
                    yield flush()
                    total = 0
        if held:
            yield flush()

    return run


def _kind(tokens: int) -> str:
    """How ids are held on the way: in two bytes where they fit."""
    return "<u2" if tokens <= 1 << 16 else "<u4"


class Vocabulary:
    """Words with their token ids, found without an object for each: arrays in order of the words' hashes, and where hashes of the same first bits begin."""

    def __init__(self, hashes: np.ndarray, word_ends: np.ndarray, words: bytes, id_ends: np.ndarray, ids: bytes, tokens: list[bytes]):
        self.kind = _kind(len(tokens))
        self.ranks = {t: i for i, t in enumerate(tokens) if t}
        # Behind the last entry stands one that no word is.
        self.hashes = np.append(hashes, np.uint64(0))
        self.starts, self.sizes = word_ends[:-1].astype(np.int64), np.append(np.diff(word_ends.astype(np.int64)), -1)
        self.eights = _eights(np.frombuffer(words + bytes(8), np.uint8))
        ends = id_ends.astype(np.int64) // np.dtype(self.kind).itemsize
        self.id_starts, self.id_sizes = ends, np.append(np.diff(ends), 0)
        self.ids = np.frombuffer(ids + bytes(4), self.kind)
        bits = max(1, len(hashes)).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        self.begin = np.concatenate([[0], np.cumsum(np.bincount((hashes >> self.shift).astype(np.int64), minlength=1 << bits))]).astype(np.int32)

    def find(self, words: Words) -> np.ndarray:
        """The entry of each word; the last one: none. Of two entries of one hash only the first is found."""
        first = (words.hashes >> self.shift).astype(np.int64)
        at, end = self.begin[first], self.begin[first + 1]
        going = np.flatnonzero((at < end) & (self.hashes[at] < words.hashes))
        while len(going):
            at[going] += 1
            here = at[going]
            going = going[(here < end[going]) & (self.hashes[here] < words.hashes[going])]
        found = (at < end) & (self.hashes[at] == words.hashes) & (self.sizes[at] == words.sizes)
        # Equal hashes are not yet equal words.
        same, eights, k = np.flatnonzero(found), _eights(words.data), 0
        while len(same):
            left = words.sizes[same] - k
            differ = (self.eights[self.starts[at[same]] + k] ^ eights[words.starts[same] + k]) & _MASKS[np.minimum(left, 8)] != 0
            found[same[differ]] = False
            same = same[(left > 8) & ~differ]
            k += 8
        return np.where(found, at, len(self.hashes) - 1)

    def token_or_long(self, word: bytes) -> list[int] | None:
        """Ids of a word that is a token, or too long to be folded; None: to be folded."""
        if word in self.ranks:
            return [self.ranks[word]]
        return merge_long(word, self.ranks) if len(word) > FOLD_BYTES else None


def _pack_words(kind: str):
    """A row of packed arrays for each batch of folded words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ids = batch.column("word").to_pylist(), batch.column("ids")
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            text = b"".join(words)
            hashes = _hashes(np.frombuffer(text + bytes(8), np.uint8), np.cumsum(sizes) - sizes, sizes)
            row = [hashes, sizes.astype(np.int32), text, ids.value_lengths().to_numpy().astype(np.int32), ids.flatten().to_numpy().astype(kind)]
            yield pa.RecordBatch.from_arrays([pa.array([bytes(x)], pa.binary()) for x in row], names=_PACKED)

    return run


_PACKED = ["hashes", "word_sizes", "words", "id_sizes", "ids"]


def _byte_values(word: str) -> Column:
    return F.transform(F.split(F.decode(word, "ISO-8859-1"), ""), F.ascii)


def _in_order(sizes: np.ndarray, blob: bytes, order: np.ndarray, step: int = 1 << 16) -> tuple[np.ndarray, bytes]:
    """Ends and bytes of the blob's parts in another order; a step of parts at a time, as places take eight times the bytes."""
    starts, whole = np.cumsum(sizes) - sizes, np.frombuffer(blob, np.uint8)
    out = []
    for a in range(0, len(order), step):
        part = order[a : a + step]
        ends = np.cumsum(sizes[part])
        at = np.repeat(starts[part] - ends + sizes[part], sizes[part]) + np.arange(ends[-1])
        out.append(whole[at].tobytes())
    return np.concatenate([[0], np.cumsum(sizes[order])]).astype(np.uint32), b"".join(out)


def vocabulary(words: DataFrame, ranks: dict[bytes, int]):
    """A broadcast of the folded words' packed arrays, and of the tokens; the words (word, n) are bounded in number."""
    folded = words.where(F.octet_length("word") <= FOLD_BYTES).select("word", F.get(fold_words(F.array(_byte_values("word")), ranks), F.lit(0)).alias("ids"))
    kind = _kind(max(ranks.values()) + 1)
    rows = folded.mapInArrow(lean(_pack_words(kind)), ", ".join(f"{name} binary" for name in _PACKED)).toArrow()
    parts = []
    for name in _PACKED:
        parts.append(b"".join(rows.column(name).to_pylist()))
        rows = rows.drop_columns(name)
    hashes, word_sizes, text, id_sizes, ids = parts
    del parts
    hashes = np.frombuffer(hashes, np.uint64)
    order = np.argsort(hashes, kind="stable")
    word_ends, text = _in_order(np.frombuffer(word_sizes, np.int32), text, order)
    id_ends, ids = _in_order(np.frombuffer(id_sizes, np.int32) * np.dtype(kind).itemsize, ids, order)
    return words.sparkSession.sparkContext.broadcast((hashes[order], word_ends, text, id_ends, ids, _tokens(ranks)))


def _tokens(ranks: dict[bytes, int]) -> list[bytes]:
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _split_texts(pattern: str, shared):
    """Per text: packed ids of all words that need no fold, and the bytes of the others with their places (in ids) among those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, vocabulary = word_scanner(pattern), Vocabulary(*shared.value)
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            for a, b in chunks(texts, _CHUNK_BYTES):
                words = scan(texts[a:b])
                entry = vocabulary.find(words)
                sizes = vocabulary.id_sizes[entry]
                rare, ready = [], []
                for i in np.flatnonzero(entry == len(vocabulary.sizes) - 1).tolist():
                    ids = vocabulary.token_or_long(words.word(i))
                    if ids is None:
                        rare.append(i)
                    else:
                        sizes[i] = len(ids)
                        ready.append((i, ids))
                ends = np.concatenate([[0], np.cumsum(sizes)])
                known = vocabulary.ids.take(_places(vocabulary.id_starts[entry], sizes), mode="clip")
                for i, ids in ready:
                    known[ends[i] : ends[i + 1]] = ids
                text_ends = ends[words.first]
                rare = np.array(rare, np.int64)
                per_text = np.diff(np.searchsorted(rare, words.first))
                letters = words.data[_places(words.starts[rare], words.sizes[rare])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(a, b - a), _binary(known, np.diff(text_ends) * known.itemsize),
                    _lists(pa.array(ends[rare] - np.repeat(text_ends[:-1], per_text), pa.int32()), per_text), _lists(_lists(pa.array(letters), words.sizes[rare]), per_text),
                ], names=["id", "known", "places", "rare"])

    return run


def _decoder(tokens: list[bytes], step: int = 1 << 18):
    """A function from ids to the bytes of their tokens in a row, and the ends of the tokens in it; a step of ids at a time, as places take eight times the bytes."""
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts, whole = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(tokens), np.uint8)

    def decoded(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [whole[_places(starts[part], sizes[part])] for part in (ids[a : a + step] for a in range(0, len(ids), step))]
        return np.concatenate([*parts, np.zeros(0, np.uint8)]), np.concatenate([[0], np.cumsum(sizes[ids])])

    return decoded


def _values(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The binaries of a column as numbers in a row, and where each begins and ends among them."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    return values.view(kind) if values.ctypes.data % np.dtype(kind).itemsize == 0 else values.copy().view(kind), (ends - ends[0]) // np.dtype(kind).itemsize


def _joined(kind: str, tokens):
    """Puts the folded words' ids among the others; with a broadcast of tokens it decodes the whole again, in the same worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded = _decoder(tokens.value) if tokens else None
        for batch in batches:
            known, ends = _values(batch.column("known"), kind)
            places, folded = batch.column("places"), batch.column("folded")
            words = folded.flatten()
            per_text = places.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            at = places.flatten().to_numpy() + np.repeat(ends[:-1], per_text)
            ids = np.insert(known.astype("<u4"), np.repeat(at, sizes), words.flatten().to_numpy().astype("<u4"))
            first = np.concatenate([[0], np.cumsum(per_text)])
            ends = ends + np.concatenate([[0], np.cumsum(sizes)])[first]
            columns, names = [batch.column("id"), _binary(ids, np.diff(ends) * 4)], ["id", "ids"]
            if decoded:
                text, token_ends = decoded(ids)
                columns, names = [*columns, _binary(text, np.diff(token_ends[ends]))], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def frequent_words(docs: DataFrame, text_col: str, pattern: str, limit: int) -> DataFrame:
    """At most ``limit`` words: those of at least some number of occurrences in all texts, two at least."""
    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(lean(_count_words(pattern)), "word binary, n bigint")
    counts = materialise(counts.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"), "bpe-words")
    by_count = counts.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count("*").alias("words")).collect()
    least, total = None, 0
    for n, words in sorted(((r.n, r.words) for r in by_count), reverse=True):
        if total + words > limit:
            break
        least, total = n, total + words
    # Folding is slow for so few bytes, so a task gets a number of words.
    return counts.where(F.lit(False) if least is None else F.col("n") >= least).repartition(total // _TASK_WORDS + 1)


def _bound_plans(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.maxPlanStringLength").rstrip("b")) > _PLAN_CHARS:
        spark.conf.set("spark.sql.maxPlanStringLength", str(_PLAN_CHARS))


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS, decoded: bool = False,
) -> DataFrame:
    """Per document: id, ids (token ids as little-endian unsigned 32-bit integers, one binary), n_tokens; decoded: with what the ids decode to."""
    spark = docs.sparkSession
    ship(spark)
    _bound_plans(spark)
    shared = vocabulary(frequent_words(docs, text_col, pattern, cache_words), ranks)
    tidy(spark)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    split = source.mapInArrow(lean(_split_texts(pattern, shared)), T.StructType([
        source.schema["id"], T.StructField("known", T.BinaryType()), T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("rare", T.ArrayType(T.ArrayType(T.IntegerType()))),
    ]))
    # Written, so that no task needs two Python workers, and a lost executor splits no text again.
    split = materialise(split, "bpe-split", "zstd")
    tidy(spark)
    folded = split.select("id", "known", "places", fold_words(F.col("rare"), ranks).alias("folded"))
    binary = [T.StructField(name, T.BinaryType()) for name in (("ids", "decoded") if decoded else ("ids",))]
    tokens = spark.sparkContext.broadcast(_tokens(ranks)) if decoded else None
    joined = folded.mapInArrow(lean(_joined(_kind(max(ranks.values()) + 1), tokens)), T.StructType([source.schema["id"], *binary]))
    return joined.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def decode(coded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Rows with packed ids, and ``decoded``: the bytes of their tokens in a row. An id outside the vocabulary is an error."""
    shared = coded.sparkSession.sparkContext.broadcast(_tokens(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded = _decoder(shared.value)
        for batch in batches:
            column = batch.column("ids")
            ids, ends = _values(column.fill_null(b""), "<u4")
            text, token_ends = decoded(ids)
            out = pc.if_else(column.is_null(), pa.scalar(None, pa.binary()), _binary(text, np.diff(token_ends[ends])))
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, "decoded"])

    return coded.mapInArrow(lean(run), T.StructType([*coded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def unpack(ids: Column) -> Column:
    """Packed ids as array<bigint>."""
    digits = F.hex(ids)
    at = F.sequence(F.lit(0), (F.octet_length(ids) / 4).cast("int") - 1)
    swapped = lambda i: F.concat(*[digits.substr(i * 8 + 7 - 2 * k, F.lit(2)) for k in range(4)])
    return F.when(F.octet_length(ids) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(at, lambda i: F.conv(swapped(i), 16, 10).cast("bigint")))


def digest(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, with_ids: bool = False) -> DataFrame:
    """The contract's columns: encode, then decode the ids; with_ids puts the packed ids beside them."""
    coded = encode(docs, ranks, pattern, decoded=True)
    kept = ["ids"] if with_ids else []
    return coded.select(F.col("id").alias("doc_id"), *kept, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
