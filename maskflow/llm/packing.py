"""Vector best-fit packing of tokenized documents into training sequences.

A sequence has three capacities: tokens, documents and attention cost (the sum
of squared piece lengths, as attention stays within a document). Pieces are
placed largest first, each into the open sequence that can take it under
every capacity and scores best: the largest weighted dot product of the
piece's demand and the residual, or the smallest weighted norm of the residual
that would be left. A piece that no open sequence can take opens one.

Documents are tokenized once into narrow rows (the ids are not kept), written
down, and dealt at random into groups of bounded size; a group is packed in
one task, so no task sees more than its group whatever the table. Pieces that
fill a sequence by themselves skip the packing.

Defined results: a null text is empty, and an empty text is one piece, the
end id alone; rows with equal ids are separate documents; equal pieces are
placed in the order of their rows; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
import sys
import types
import zlib
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskflow.llm.common import write_table

#: Pieces that one task packs, on average.
GROUP = 16384
#: Bytes of words, and of pieces of words, in one of the generations that a worker remembers (some 100,000 words).
REMEMBER = 1_000_000
#: Bytes of texts whose words are looked up together.
TOGETHER = 1_000_000
#: Bytes of a string that is kept as two numbers; its length takes one more.
SHORT = 15

PIECES = "piece int, start long, length long, ids_crc32 long"


def in_ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places first, first + 1, ... of each range, ranges in a row."""
    ends = np.cumsum(size)
    out = np.repeat(first - (ends - size), size)
    out += np.arange(len(out))
    return out


class _Generation:
    """Strings of up to ``SHORT`` bytes and their ids, in flat arrays; longer strings in a dictionary.

    A short string is two numbers (its bytes, zeros, its length), and a table
    by hash tells its number; the next free place takes what does not fit.
    """

    def __init__(self):
        self.low, self.high = (np.empty(0, np.uint64) for _ in range(2))
        self.first, self.size = (np.empty(0, np.int64) for _ in range(2))
        self.flat = np.empty(0, "<u4")
        self.table = np.empty(0, np.int32)
        self.long: dict[bytes, np.ndarray] = {}
        self.bytes = 0

    def place(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = low * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed += high
        mixed *= np.uint64(0xC2B2AE3D27D4EB4F)
        return (mixed >> np.uint64(65 - len(self.table).bit_length())).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Number of each string; -1 for those not here."""
        if not len(self.low):
            return np.full(len(low), -1, np.int32)
        at = self.place(low, high)
        found = self.table[at]
        open_ = np.flatnonzero((found >= 0) & ((self.low[found] != low) | (self.high[found] != high)))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.table)
            found[open_] = seen = self.table[at[open_]]
            open_ = open_[(seen >= 0) & ((self.low[seen] != low[open_]) | (self.high[seen] != high[open_]))]
        return found

    def add(self, low: np.ndarray, high: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        """Take in strings that are not here, with their ids in a row."""
        had = len(self.low)
        self.low, self.high = np.append(self.low, low), np.append(self.high, high)
        self.first = np.append(self.first, len(self.flat) + np.cumsum(size) - size)
        self.size, self.flat = np.append(self.size, size), np.append(self.flat, flat)
        room = 1 << max(12, (2 * len(self.low)).bit_length())
        if room > len(self.table):
            self.table, had = np.full(room, -1, np.int32), 0
        todo = np.arange(had, len(self.low), dtype=np.int32)
        at = self.place(self.low[had:], self.high[had:])
        while len(todo):
            free = self.table[at] < 0
            self.table[at[free]] = todo[free]
            more = self.table[at] != todo
            todo, at = todo[more], (at[more] + 1) % room


class _Memory:
    """Ids of strings, kept for two generations; one not met in a generation is forgotten with the next."""

    def __init__(self, learn: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]):
        """``learn``: ids in a row and their number, of strings that are not known."""
        self.learn, self.now, self.older = learn, _Generation(), _Generation()

    def __call__(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, size): where the ids of each of the different ``strings`` stand."""
        if self.now.bytes > REMEMBER:
            self.older, self.now = self.now, _Generation()
        now, older = self.now, self.older
        if not len(strings):
            return now.flat, np.empty(0, np.int64), np.empty(0, np.int64)
        _, places, data = strings.buffers()
        data = np.frombuffer(data or b"", np.uint8)
        places = np.frombuffer(places, np.int32)[: len(strings) + 1].astype(np.int64)
        width = np.diff(places)
        short, long = np.flatnonzero(width <= SHORT), np.flatnonzero(width > SHORT)
        low, high = self.numbers(data, places[short], width[short])
        found = now.find(low, high).astype(np.int64)

        new = np.flatnonzero(found < 0)
        kept = older.find(low[new], high[new])
        back, kept = new[kept >= 0], kept[kept >= 0]
        found[back] = len(now.low) + np.arange(len(back))
        now.add(low[back], high[back], older.flat[in_ranges(older.first[kept], older.size[kept])], older.size[kept])
        new = new[found[new] < 0]
        found[new] = len(now.low) + np.arange(len(new))

        names = [data[a:b].tobytes() for a, b in zip(places[long].tolist(), places[long + 1].tolist(), strict=True)]
        now.long.update((w, older.long[w]) for w in names if w not in now.long and w in older.long)
        unknown = [i for i, w in zip(long.tolist(), names, strict=True) if w not in now.long]
        now.bytes += int(width[short[back]].sum() + width[short[new]].sum() + width[long].sum())
        if len(new) or unknown:
            flat, size = self.learn(strings.take(pa.array(np.append(short[new], np.array(unknown, np.int64)))))
            cut = int(size[: len(new)].sum())
            now.add(low[new], high[new], flat[:cut], size[: len(new)])
            for i, end, n in zip(unknown, np.cumsum(size)[len(new) :].tolist(), size[len(new) :].tolist(), strict=True):
                now.long[data[places[i] : places[i + 1]].tobytes()] = flat[end - n : end].copy()

        first, size = np.empty(len(strings), np.int64), np.empty(len(strings), np.int64)
        first[short], size[short] = now.first[found], now.size[found]
        ids = [now.long[w] for w in names]
        size[long] = [len(x) for x in ids]
        first[long] = len(now.flat) + np.cumsum(size[long]) - size[long]
        return np.concatenate([now.flat, *ids]) if ids else now.flat, first, size

    @staticmethod
    def numbers(data: np.ndarray, first: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers for each short string: no two strings have both equal."""
        rows = np.zeros((len(first), SHORT + 1), np.uint8)
        rows.reshape(-1)[in_ranges((SHORT + 1) * np.arange(len(first)), width)] = data[in_ranges(first, width)]
        rows[:, SHORT] = width
        both = rows.view(np.uint64)
        return both[:, 0].copy(), both[:, 1].copy()


class _Merges:
    """The merges of a byte-pair model, for many pieces at once.

    In each round every piece joins all occurrences of its pair of lowest rank,
    from the left, until it has no pair with a rank.
    """

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        self.size = max(vocab.values()) + 1
        self.single, self.last = (np.full(512, -1, np.int64) for _ in range(2))
        for code in range(512):
            self.single[code], self.last[code] = vocab.get(chr(code), -1), vocab.get(chr(code) + end, -1)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        # A table of places by hash; the next free one takes what does not fit.
        self.bits = max(10, len(keys).bit_length() + 2)
        self.keys = np.full((1 << self.bits) + 64, -1, np.int64)
        self.rank, self.made = np.full(len(self.keys), len(keys), np.int64), np.zeros(len(self.keys), np.int64)
        for rank, (key, at) in enumerate(zip(keys.tolist(), self.place(keys).tolist(), strict=True)):
            while self.keys[at] >= 0:
                at += 1
            self.keys[at], self.rank[at], self.made[at] = key, rank, made[rank]
        self.none = len(keys)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands in the table, or a free place."""
        at = self.place(keys)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while len(open_):
            at[open_] += 1
            seen = self.keys[at[open_]]
            open_ = open_[(seen != keys[open_]) & (seen >= 0)]
        return at

    def ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of the pieces, of byte letters, in a row, and their number; None if a letter has no id."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        codes = np.frombuffer("".join(pieces).encode("utf-16-le"), dtype="<u2")
        word = np.repeat(np.arange(len(pieces)), sizes)
        if not len(codes) or codes.max() >= 512:
            return None
        ids = self.single[codes]
        ends = np.cumsum(sizes)[sizes > 0] - 1
        ids[ends] = self.last[codes[ends]]
        if ids.min() < 0:
            return None
        done_word, done_ids = [], []
        while len(ids):
            at = self.find(ids[:-1] * self.size + ids[1:])
            rank = np.append(np.where(word[:-1] == word[1:], self.rank[at], self.none), self.none)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(ids))))
            over = least == self.none
            done_word.append(word[over])
            done_ids.append(ids[over])
            join = (rank == least) & ~over
            # Of pairs that overlap, every second one from the left.
            begins = join & ~np.append(False, join[:-1])
            place = np.arange(len(ids))
            since = place - np.maximum.accumulate(np.where(begins, place, 0))
            join &= since % 2 == 0
            ids = np.where(join, self.made[np.append(at, 0)], ids)
            keep = ~over & ~np.append(False, join[:-1])
            ids, word = ids[keep], word[keep]
        word, ids = np.concatenate(done_word), np.concatenate(done_ids)
        return ids[np.argsort(word, kind="stable")].astype("<u4"), np.bincount(word, minlength=len(pieces))


def strings_of(array: pa.Array) -> list:
    return array.to_numpy(zero_copy_only=False).tolist()


def one_by_one(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids in a row, and their sizes."""
    return np.array([i for some in ids for i in some], dtype="<u4"), np.array([len(some) for some in ids], dtype=np.int64)


def in_turn(mine: np.ndarray, some: tuple[np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids in a row, and sizes, taken from ``some`` where ``mine`` is true and from ``others`` elsewhere."""
    size = np.empty(len(mine), np.int64)
    size[mine], size[~mine] = some[1], others[1]
    order = np.argsort(~mine, kind="stable")
    first = np.empty(len(mine), np.int64)
    first[order] = np.cumsum(size[order]) - size[order]
    return np.append(some[0], others[0])[in_ranges(first, size)], size


class _Encoder:
    """Ids, as little-endian 32-bit numbers, by the tokenizer in the file ``path``; remembers words it has met.

    The tokenizer drops white space before anything else, so a text's ids are
    those of its words in a row, and each word is encoded once. Where the
    file's rules are lower-casing and one pattern that splits into pieces, this
    is done here for words of plain Latin letters and signs (which NFC leaves
    as they are), and the ids of each piece, which many words share, come from the
    tokenizer's model. Words that are not plain, or may hold a special token,
    go through the whole tokenizer. Where the model merges pairs by rank and no more, new
    pieces are merged together (``_Merges``).

    Words and pieces are kept in flat arrays (``_Memory``); objects of their own took most of
    a worker's memory.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words, self.pieces = _Memory(self.learn), _Memory(self.model_ids)
        rules = json.loads(Path(path).read_text(encoding="utf-8"))
        cleaning = [r["type"] for r in (rules["normalizer"] or {}).get("normalizers", [])]
        first, *rest = (rules["pre_tokenizer"] or {}).get("pretokenizers", []) or [{}]
        by_pattern = first.get("type") == "Split" and (first["behavior"], first["invert"]) == ("Removed", True)
        byte_level = [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        # Where the rules are others, no word is plain.
        self.plain = regex.compile(r"(?!)").fullmatch
        if cleaning == ["NFC", "Replace", "Lowercase"] and by_pattern and "Regex" in first["pattern"] and rest == byte_level:
            self.plain = regex.compile(r"[\n\x21-\x7E\xC0-\xFF]*").fullmatch
            self.split = regex.compile(f"{first['pattern']['Regex']}|\n").findall
        model = rules["model"]
        self.merges = None
        if model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges", "byte_fallback")):
            self.merges = _Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.special = [t["content"] for t in rules["added_tokens"]]
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {c: as_bytes(chr(c))[0][0] for c in range(0xC0, 0x100)}

    def whole(self, word: bytes) -> list[int]:
        return self.tokenizer.encode(word.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids

    def by_pieces(self, lines: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids in a row and their number, of plain words, one on a line."""
        coded = pa.array(self.split(lines.lower()), pa.string()).dictionary_encode()
        ids, first, size = self.pieces(coded.dictionary)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        sizes = size[codes]
        # A line's end is a piece without ids.
        end = coded.dictionary.index("\n").as_py()
        word = np.cumsum(codes == end)
        return ids[in_ranges(first[codes], sizes)], np.bincount(word, sizes, lines.count("\n") + 1).astype(np.int64)

    def model_ids(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids in a row and their number, of pieces; a line's end has none. Long ones go one by one, so that none keeps the others' rounds up."""
        pieces = ["" if p == "\n" else p if p.isascii() else p.translate(self.letters) for p in strings_of(new)]
        short = np.fromiter((len(p) <= 64 for p in pieces), bool, len(pieces))
        known = self.merges.ids([p for p in pieces if len(p) <= 64]) if self.merges and short.any() else None
        if known is None:
            return one_by_one([[t.id for t in self.model.tokenize(p)] for p in pieces])
        return in_turn(short, known, one_by_one([[t.id for t in self.model.tokenize(p)] for p in pieces if len(p) > 64]))

    def learn(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids in a row and their number, of the words ``new``."""
        words = strings_of(new.cast(pa.binary()))
        lines = b"\n".join(words).decode("utf-8", "surrogatepass")
        if self.is_plain(lines):
            return self.by_pieces(lines)
        plain = np.fromiter((self.is_plain(w.decode("utf-8", "surrogatepass")) for w in words), bool, len(words))
        odd = one_by_one([self.whole(w) for w, p in zip(words, plain.tolist(), strict=True) if not p])
        if not plain.any():
            return odd
        lines = b"\n".join(w for w, p in zip(words, plain.tolist(), strict=True) if p).decode("utf-8")
        return in_turn(plain, self.by_pieces(lines), odd)

    def is_plain(self, text: str) -> bool:
        return self.plain(text) is not None and not any(s in text for s in self.special)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's end; a null text has none.

        Each different word of the batch is looked up once.
        """
        # What the batch before has freed goes back to the system, not only to Arrow.
        pa.default_memory_pool().release_unused()
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        flat, first, size = self.words(coded.dictionary)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        sizes = size[codes]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return flat[in_ranges(first[codes], sizes)], ends[split.offsets.to_numpy()[1:] - split.offsets[0].as_py()]

    def __call__(self, text: str) -> bytes:
        return self.batch(pa.array([text], pa.string()))[0].tobytes()


def encoder(path: str) -> _Encoder:
    """The encoder of the tokenizer file ``path`` that a worker keeps between its tasks."""
    name = f"_packing_{zlib.crc32(path.encode())}"
    if name not in sys.modules:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        memory = types.ModuleType(name)
        memory.encode = _Encoder(path)
        sys.modules[name] = memory
    return sys.modules[name].encode


def in_slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``TOGETHER`` bytes of the column number ``text``; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    piece = np.concatenate([[0], np.cumsum(sizes)[:-1]]) // TOGETHER if len(sizes) else sizes
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(sizes)]
    for low, high in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(low, high - low)


def tokenize(docs: DataFrame, id_col: str, text_col: str, path: str, tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents, ended by ``end_id``, cut at ``tokens``."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for some in in_slices(batch, 1):
                ids, ends = encode.batch(some.column(1))
                which, rows, at = [], [], 0
                for k, stop in enumerate(ends.tolist()):
                    whole = ids[at:stop].tobytes() + end
                    for piece, low in enumerate(range(0, len(whole), 4 * tokens)):
                        part = whole[low : low + 4 * tokens]
                        which.append(k)
                        rows.append((piece, low // 4, len(part) // 4, zlib.crc32(part)))
                    at = stop
                made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.int64()] * 3), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(which)), *made], ["doc_id", "piece", "start", "length", "ids_crc32"])

    wanted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return wanted.mapInArrow(cut, f"doc_id {kind}, {PIECES}")


def best_fit(
    lengths: np.ndarray,
    tokens: int,
    documents: int,
    attention: float,
    score: str = "norm",
    weights: Sequence[float] = (1.0, 0.01, 0.01),
) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; pieces longest first, under all three capacities.

    All numbers are parts of a capacity. ``score``: "dot" takes the open
    sequence with the largest weighted dot product of demand and residual,
    "norm" the one whose residual after placing is smallest.
    """
    caps = np.array([tokens, documents, attention], dtype=float)
    demand = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], axis=1) / caps
    if len(lengths) and demand.max() > 1 + 1e-9:
        raise ValueError("a piece is beyond a capacity")
    weights = np.asarray(weights, dtype=float)
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room = np.empty((1024, 3))
    names, filled = np.empty(1024, np.int64), np.empty(1024, np.int64)
    open_, made = 0, 0
    least = demand.min(axis=0) if len(lengths) else None
    for step, i in enumerate(order):
        if step % 256 == 255:
            # Sequences that not even the smallest piece fits in are closed.
            live = np.flatnonzero((room[:open_] + 1e-9 >= least).all(axis=1))
            open_ = len(live)
            room[:open_], names[:open_], filled[:open_] = room[live], names[live], filled[live]
        d = demand[i]
        left = room[:open_] - d
        fits = np.flatnonzero(left.min(axis=1) >= -1e-9) if open_ else ()
        if len(fits):
            value = room[fits] @ (weights * d) if score == "dot" else -(left[fits] ** 2 @ weights)
            at = fits[int(np.argmax(value))]
        else:
            if open_ == len(room):
                room, names, filled = np.resize(room, (2 * open_, 3)), np.resize(names, 2 * open_), np.resize(filled, 2 * open_)
            at = open_
            room[at], names[at], filled[at] = 1.0, made, 0
            open_ += 1
            made += 1
        sequence[i], offset[i] = names[at], filled[at]
        filled[at] += lengths[i]
        room[at] -= d
    return sequence, offset


def pack(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens: int = 2048,
    documents: int | None = None,
    attention: float | None = None,
    score: str = "norm",
    end_id: int = 0,
) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``: all documents packed into sequences.

    ``path``: a tokenizer file. ``documents`` and ``attention`` are the other
    capacities of a sequence; unset, they never bind before the tokens do.
    """
    documents, attention = documents or tokens, attention or float(tokens) ** 2
    pieces, _ = write_table(tokenize(docs, id_col, text_col, path, tokens, end_id), "pieces")
    pieces = pieces.withColumn("_row", F.monotonically_increasing_id())  # of a written table: the same in each read
    full = F.col("length") == tokens
    loose = pieces.filter(~full)
    n = max(1, -(-loose.count() // GROUP))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_row")
        sequence, offset = best_fit(group["length"].to_numpy(), tokens, documents, attention, score)
        number = int(group["_group"].iat[0]) << 32
        return group.drop(columns=["_row", "_group"]).assign(sequence_id=number + sequence, offset=offset)

    kind = pieces.schema["doc_id"].dataType.simpleString()
    dealt = loose.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(n)).cast("long"))
    placed = dealt.groupBy("_group").applyInPandas(place, f"doc_id {kind}, {PIECES}, sequence_id long, offset long")
    alone = pieces.filter(full).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return placed.unionByName(alone)
