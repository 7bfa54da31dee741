"""Byte-level BPE in numpy: batched merge rounds over flat symbol arrays.

The vocabulary file is a parameter and is read on the driver; only its bounded tables
(pairs, ids, token bytes) travel to the executors.  Each Python worker keeps a bounded
cache of the words it has encoded.  The operator is a map: no shuffle, a lost executor
only repeats its own input splits.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import blob, free_name, pieces, require

#: The published pre-tokenisation pattern of byte-level BPE, over classes of letters and
#: numbers; contractions stand behind letters, which changes nothing as no letter is "'".
PATTERN = r" ?[{L}]+| ?[{N}]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"
#: Letters and numbers below U+0250, for the faster engine of the standard library.
LATIN = re.compile(PATTERN.format(L="A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", N="0-9\xb2\xb3\xb9\xbc-\xbe"))
BEYOND_LATIN = re.compile("[^\x00-\x1b\x20-\x84\x86-\u024f]")
NO_RANK = np.int64(1) << 40
#: Bytes of words and ids a worker keeps, with what a cached word costs beside them; the cache
#: starts anew beyond it, which changes no result.
CACHE_BYTES = 32_000_000
WORD_COST = 160
PIECE_BYTES = 1_000_000
#: A word of more symbols is merged by ranks in turn, not by rounds over all words.
LONG_WORD = 512


def unknown_letters() -> str:
    """Letters and numbers that ``regex`` knows and the ``tokenizers`` library does not yet.

    The two carry different Unicode versions; only code points that are unassigned in this
    Python's tables can differ, and those are tried one by one.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    cut = ByteLevel(add_prefix_space=False).pre_tokenize_str
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    new = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    return "".join(c for c in new if len(cut(f"a{c}a")) > 1 and len(cut(f"1{c}1")) > 1)


def byte_alphabet() -> dict[int, str]:
    """Byte -> printable character of the byte-level alphabet."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """Tables of one byte-level BPE tokenizer."""

    keys: np.ndarray  # sorted left * size + right
    ranks: np.ndarray  # rank of each key
    merged: np.ndarray  # id that each key merges into
    byte_ids: np.ndarray  # id of each single byte
    token_bytes: list[bytes]
    special: dict[str, int] = field(default_factory=dict)
    unknown: str = ""  # letters and numbers that count as neither

    @property
    def size(self) -> int:
        return len(self.token_bytes)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a ``tokenizers`` JSON file (driver side)."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *special.values()]) + 1
        alphabet = byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        token_bytes = [b""] * size
        for token, i in vocab.items():
            token_bytes[i] = bytes(back[c] for c in token)
        for token, i in special.items():
            token_bytes[i] = token.encode()
        rows = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            rows.append((vocab[a] * size + vocab[b], rank, vocab[a + b]))
        table = np.array(rows, dtype=np.int64)
        table = table[np.argsort(table[:, 0], kind="stable")]
        byte_ids = np.array([vocab[alphabet[b]] for b in range(256)], dtype=np.int64)
        return cls(table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy(), byte_ids, token_bytes, special, unknown_letters())

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Encode distinct words: flat ids and the number of ids of each word."""
        long = [i for i, w in enumerate(words) if len(w) > LONG_WORD]
        if not long:
            return self._merge_rounds(words)
        ids, counts = self._merge_rounds([w for w in words if len(w) <= LONG_WORD])
        short = iter(np.split(ids, np.cumsum(counts)[:-1])) if len(counts) else iter(())
        parts = [self._merge_long(w) if len(w) > LONG_WORD else next(short) for w in words]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, place in the key table) of pairs of symbols."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[at] == key, at

    def _merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one long word: ranks in rising order, all places of a rank in one round.

        Each round touches only the pairs of its rank and the new pairs beside them, so the
        work grows with the merges made, not with rounds times length.
        """
        n = len(word)
        symbol = self.byte_ids[np.frombuffer(word, np.uint8)]
        if not len(self.keys):
            return symbol
        after = np.arange(1, n + 2)  # place of the next symbol; n: none
        before = np.arange(-1, n)
        alive = np.ones(n + 1, bool)
        alive[n] = False
        symbol = np.append(symbol, 0)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def offer(places: np.ndarray) -> None:
            known, at = self._lookup(symbol[places], symbol[after[places]])
            known &= after[places] < n
            places, rank = places[known], self.ranks[at[known]]
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            starts = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]])) if len(rank) else []
            for r, some in zip(rank[starts].tolist() if len(rank) else (), np.split(places, starts[1:]), strict=False):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(some)

        offer(np.arange(n - 1))
        while ranks:
            r = heapq.heappop(ranks)
            parts = waiting.pop(r)
            pos = np.unique(np.concatenate(parts)) if len(parts) > 1 else np.sort(parts[0])
            pos = pos[alive[pos]]
            pos = pos[after[pos] < n]
            known, at = self._lookup(symbol[pos], symbol[after[pos]])
            known &= self.ranks[at] == r
            pos, at = pos[known], at[known]
            if not len(pos):
                continue
            # In a run of overlapping occurrences (a a a) every second one merges.
            run = np.concatenate([[True], after[pos[:-1]] != pos[1:]])
            first = np.maximum.accumulate(np.where(run, np.arange(len(pos)), 0))
            odd = (np.arange(len(pos)) - first) % 2 == 0
            pos, at = pos[odd], at[odd]
            gone = after[pos]
            symbol[pos] = self.merged[at]
            alive[gone] = False
            after[pos] = after[gone]
            before[after[pos]] = pos
            left = before[pos]
            offer(np.unique(np.concatenate([pos, left[left >= 0]])))
        return symbol[alive]

    def _merge_rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Batched rounds over many short words.

        Every round takes, in each unfinished word, the adjacent pair of lowest rank and
        merges all its occurrences from left to right.  Pairs are found by binary search
        over the sorted keys, once for each pair that a merge brings about; finished words
        leave the flat array.
        """
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        done_ids: list[np.ndarray] = []
        done_word: list[np.ndarray] = []
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(n), lengths)
        rank, into = np.full(len(symbols), NO_RANK), np.zeros(len(symbols), np.int64)

        def look(places: np.ndarray) -> None:
            """Rank and merged id of the pairs that begin at ``places``, in words of their own."""
            places = places[places < len(symbols) - 1]
            places = places[word[places] == word[places + 1]]
            if len(places) and len(self.keys):
                known, at = self._lookup(symbols[places], symbols[places + 1])
                rank[places] = np.where(known, self.ranks[at], NO_RANK)
                into[places] = self.merged[at]

        look(np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(starts, len(symbols)))
            best = np.minimum.reduceat(rank, starts)
            open_word = best < NO_RANK
            keep = np.repeat(open_word, sizes)
            if not open_word.all():
                done_ids.append(symbols[~keep])
                done_word.append(word[~keep])
            if not open_word.any():
                break
            # In a run of overlapping occurrences (a a a) every second one merges.
            pos = np.flatnonzero(keep & (rank == np.repeat(best, sizes)))
            run_start = np.concatenate([[True], np.diff(pos) != 1])
            first = np.maximum.accumulate(np.where(run_start, np.arange(len(pos)), 0))
            pos = pos[(np.arange(len(pos)) - first) % 2 == 0]
            symbols[pos] = into[pos]
            keep[pos + 1] = False
            # Only pairs at and before a merged symbol are new; the others keep their rank.
            rank[pos] = NO_RANK
            place = np.cumsum(keep) - 1
            new = place[pos]
            symbols, word, rank, into = symbols[keep], word[keep], rank[keep], into[keep]
            beside = np.zeros(len(symbols), bool)
            beside[new] = True
            beside[np.maximum(new - 1, 0)] = True
            look(np.flatnonzero(beside))
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=n)


class Encoder:
    """Encodes and decodes texts with one vocabulary, keeping a bounded word cache."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        but = f"--[{self.v.unknown}]" if self.v.unknown else ""
        full = r" ?[\p{L}BUT]+| ?[\p{N}BUT]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s[[\p{L}\p{N}]BUT]]+|\s+(?!\S)|\s+".replace("BUT", but)
        self.full = regex.compile(full, regex.V1).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")").split if vocabulary.special else None
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.held = 0  # bytes of the cached words, their ids and their cost
        self.n_ids = self.n_words = 0
        self.ids = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.counts = np.zeros(1 << 14, np.int64)

    def _store(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """Append words; the arrays double when they are full."""
        for name, used, more in (("ids", self.n_ids, len(ids)), ("starts", self.n_words, len(counts)), ("counts", self.n_words, len(counts))):
            have = getattr(self, name)
            if used + more > len(have):
                grown = np.zeros(max(2 * len(have), used + more), have.dtype)
                grown[:used] = have[:used]
                setattr(self, name, grown)
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        ends = self.n_ids + np.cumsum(counts)
        self.starts[self.n_words : self.n_words + len(counts)] = ends - counts
        self.counts[self.n_words : self.n_words + len(counts)] = counts
        self.n_ids += len(ids)
        self.n_words += len(counts)

    def find(self, text: str) -> list[str]:
        return self.full(text) if BEYOND_LATIN.search(text) else LATIN.findall(text)

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text; special tokens stand alone, as a one-element tuple."""
        if self.split is None or not any(s in text for s in self.v.special):
            return self.find(text)
        out: list = []
        for i, part in enumerate(self.split(text)):
            out.extend([(part,)] if i % 2 else self.find(part))
        return out

    def _places(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Places of each text's words in the store, new words encoded together first."""
        if self.held > CACHE_BYTES:
            self._reset()
        split = [self.words(t) for t in texts]
        index = self.index
        fresh = [w for w in set().union(*split) if w not in index]
        special = [w for w in fresh if type(w) is tuple]
        plain = [w for w in fresh if type(w) is not tuple]
        if plain:
            self._store(*self.v.merge_words([w.encode() for w in plain]))
        if special:
            self._store(np.array([self.v.special[w[0]] for w in special]), np.ones(len(special), np.int64))
        for w in [*plain, *special]:
            index[w] = len(index)
        self.held += sum(map(len, plain)) * 5 + WORD_COST * len(fresh)
        for words in split:
            yield np.fromiter(map(index.__getitem__, words), np.int64, len(words))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out = []
        for at in self._places(texts):
            counts = self.counts[at]
            ends = np.cumsum(counts)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.ids[np.repeat(self.starts[at] - ends + counts, counts) + np.arange(total)])
        return out

    def count(self, texts: list[str]) -> list[int]:
        """Number of ids of each text."""
        return [int(self.counts[at].sum()) for at in self._places(texts)]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.v.token_bytes.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


def tokenize(df: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", ids: bool = True, decode: bool = True, decoded_text: bool = True) -> DataFrame:
    """Encode every text and decode its ids again.

    Returns one row per input row: ``key``, ``ids`` (array<int>, if asked for),
    ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned 32-bit integers) and, with
    ``decode``, ``decoded`` (if asked for) and ``decoded_sha256``.  Null and empty texts have no ids; an
    empty table gives an empty one; further columns of ``df`` are ignored.
    """
    require(df, key, text)
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string"
    schema += ", ids array<int>" * ids + ", decoded_sha256 string" * decode + ", decoded string" * (decode and decoded_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for part in pieces(batches, "t", PIECE_BYTES):
            encoded = encoder.encode([t.decode() for t in part.column("t").to_pylist()])
            raw = [e.astype("<u4") for e in encoded]
            out = {
                key: part.column("k"),
                "n_tokens": pa.array([len(e) for e in encoded], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(r.tobytes()).hexdigest() for r in raw], pa.string()),
            }
            if ids:
                out["ids"] = pa.array([e.astype(np.int32) for e in encoded], pa.list_(pa.int32()))
            if decode:
                texts = [encoder.decode(e) for e in encoded]
                out["decoded_sha256"] = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())
                if decoded_text:
                    out["decoded"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return df.select(F.col(f"`{key}`").alias("k"), blob(text).alias("t")).mapInArrow(run, schema)


def count_tokens(df: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``df`` without ``text``, with the number of BPE tokens of each text; see ``tokenize``.

    Null and empty texts have none; repeated rows each have theirs; a column ``out`` is replaced.
    """
    rest = [c for c in df.columns if c not in (text, out)]
    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in rest) + f"`{out}` long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for part in pieces(batches, len(rest), PIECE_BYTES):
            counts = encoder.count([t.decode() for t in part.column(len(rest)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], pa.array(counts, pa.int64())], names=[*rest, out])

    return df.select(*[F.col(f"`{c}`") for c in rest], blob(text).alias(free_name(df, "_text"))).mapInArrow(run, schema)
