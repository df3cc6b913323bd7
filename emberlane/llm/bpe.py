"""Operator 3: byte-level BPE encoding and decoding with the tokenizers library.

Spark hands Arrow batches of texts to a cached tokenizer. A text is cut before each
space and line feed: no match of the splitting pattern holds white space after another
character, so the pieces can be encoded one by one. Arrow takes the punctuation off
the end of each distinct piece; words are kept with their ids by a worker, the half that
is used least is dropped when they are too many, and new ones go to the library's model
many in a string. Texts in which white space stands in longer runs are matched whole.
Bytes become printable characters by a fixed byte table before the merges; decoding
reverses that table, so a character that is split over tokens comes back whole when its
tokens are joined.

Defined cases: a null text counts as empty and gives no ids; an empty table gives an
empty table; repeated rows give repeated rows; columns other than the key and the text
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import string
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from emberlane.llm.common import slices, table

#: Code points that the splitting pattern takes for white space (fixed values).
SPACE_POINTS = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE_SET = frozenset(map(chr, SPACE_POINTS))
_GAPS = re.compile("\n\n(?:[" + "".join(map(chr, SPACE_POINTS)) + "]|\\Z)")
#: Distinct words that a worker keeps at most; then the half that fewer groups of texts held is dropped. It bounds memory, not results.
CACHE_PIECES = 750_000
#: Other pieces, and matches inside them, that are kept.
CACHE_OTHERS = 100_000
#: So many signs behind a word are taken off it; pieces with more are split by the pattern.
LONGEST_TAIL = 16
#: Longer pieces and matches are not kept.
LONGEST_PIECE = 1000
#: So many words at least go to the library in one string, and so many at most.
FEW, MANY = 16, 64
#: Characters of texts that are cut and looked up together.
GROUP_CHARACTERS = 1 << 22


def byte_characters() -> list[str]:
    """The printable character that stands for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for byte in range(256):
        out.append(chr(byte if byte in shown else spare))
        spare += byte not in shown
    return out


_CHARACTERS = byte_characters()
_TO_CHARACTERS = dict(enumerate(_CHARACTERS))
_TO_BYTE = {ord(c): b for b, c in enumerate(_CHARACTERS)}
#: The byte 255 is in no text; it stands for the cut between strings.
_JOINED = np.array([ord(c) for c in _CHARACTERS[:255]] + [0x0A], "<u4")
_SIGNS = np.zeros(256, bool)
_SIGNS[list(string.punctuation.encode())] = True
_SPACE, _LINE = _TO_CHARACTERS[0x20], _TO_CHARACTERS[0x0A]


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[str, str]]:
    """Every way to join two tokens into a third, by the third's rank, as rank files mean it."""
    show = lambda token: token.decode("latin-1").translate(_TO_CHARACTERS)
    out = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        for cut in range(1, len(token)):
            if token[:cut] in ranks and token[cut:] in ranks:
                out.append((show(token[:cut]), show(token[cut:])))
    return out


def _plain(text: str) -> bool:
    """Whether no match of the splitting pattern can hold white space on both sides of a cut before a space or line feed."""
    return not (text[:1] in SPACE_SET or "  " in text or " \n" in text or "\n\n" in text and _GAPS.search(text))


def _shown(texts: list[str]) -> list[str]:
    """The printable characters of the bytes of each text."""
    data = np.frombuffer(b"\xff".join(map(str.encode, texts)), np.uint8)
    return _JOINED[data].tobytes().decode("utf-32-le").split("\n") if texts else []


def _strings(pieces: pa.LargeStringArray) -> list[str]:
    """The pieces, none of which holds a space, by one split, which takes less than a Python string for each."""
    joined = pc.binary_join(pa.LargeListArray.from_arrays([0, len(pieces)], pieces), pa.scalar(" ", pa.large_string()))[0].as_py()
    return joined.split(" ") if len(pieces) else []


def _large(kind: pa.DataType, lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    """Strings or binaries of so many bytes each that stand one after another."""
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)))
    return pa.Array.from_buffers(kind, len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _before_signs(pieces: pa.LargeStringArray) -> tuple[pa.DictionaryArray, pa.DictionaryArray]:
    """Each piece without the ASCII punctuation at its end, and that punctuation."""
    ends = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset:pieces.offset + len(pieces) + 1]
    data = np.frombuffer(pieces.buffers()[2], np.uint8)[ends[0]:ends[-1]]
    begins, ends = ends[:-1] - ends[0], ends[1:] - ends[0]
    middle = ends.copy()
    some = np.flatnonzero(ends > begins)
    for _ in range(LONGEST_TAIL):
        some = some[_SIGNS[data[middle[some] - 1]]]
        middle[some] -= 1
        some = some[middle[some] > begins[some]]
    lengths = ends - middle
    skip = np.cumsum(lengths) - lengths
    tail = np.arange(lengths.sum()) + np.repeat(middle - skip, lengths)
    inside = np.ones(len(data), bool)
    inside[tail] = False
    stems, tails = _large(pa.large_string(), middle - begins, data[inside]), _large(pa.large_string(), lengths, data[tail])
    return stems.dictionary_encode(), tails.dictionary_encode()


class Codec:
    """A vocabulary: ids of a text, characters of the text that each id covers, and bytes of ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer, models

        self.ignores_merges = not path.endswith(".json")
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.special: dict[str, int] = {}
        if path.endswith(".json"):
            full = Tokenizer.from_file(path)
            self.vocab = full.get_vocab(with_added_tokens=False)
            self.special = {t.content: number for number, t in full.get_added_tokens_decoder().items()}
            self.model = full.model
            self.model._resize_cache(0)  # what is known is kept here
            self.vocab |= self.special
        else:
            ranks = load_ranks(path)
            self.vocab = {t.decode("latin-1").translate(_TO_CHARACTERS): r for t, r in ranks.items()}
            self.model = models.BPE(vocab=self.vocab, merges=merges_of(ranks), ignore_merges=True, cache_capacity=0)
        if max(self.vocab.values()) > 0xFFFF:
            raise ValueError("ids beyond 16 bits")
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.table = [b""] * (max(self.vocab.values()) + 1)
        for shown, number in self.vocab.items():
            self.table[number] = shown.encode() if shown in self.special else bytes(_TO_BYTE.get(ord(c), 63) for c in shown)
        self.lengths = np.array([len(x) for x in self.table], np.int64)
        # a merge over a space or line feed could only stand beside a letter if a token held both
        shown = [(shown, self.table[i].decode("utf-8", "replace").isspace()) for shown, i in self.vocab.items() if shown not in self.special]
        self.joins = not any(_SPACE in x[1:] and not blank for x, blank in shown)
        self.lines = self.joins and not self.ignores_merges and not any(_LINE in x and not blank for x, blank in shown)
        self.begins = np.array([x[:1] in (b" ", b"\n") for x in self.table])
        self.known: dict[str, int] = {}  # places of words in ``laid``
        self.laid = pa.array([], pa.large_binary())  # packed ids of words
        self.uses = np.zeros(0, np.int64)  # groups of texts that held the word at a place
        self.others: dict[str, bytes] = {}  # packed ids of pieces that are no words
        self.matches: dict[str, bytes] = {}  # packed ids of matches of the pattern inside these, and of signs behind words

    def _ids_of_matches(self, matches: list[str]) -> list[bytes]:
        """Packed ids of matches of the pattern, each by one call of the library's model, which needs no offsets, alignments or encodings."""
        out: list[bytes] = []
        tokenize = self.model.tokenize
        for at in range(0, len(matches), 2048):
            ids: list[int] = []
            cuts = [0]
            for m in _shown(matches[at:at + 2048]):
                ids += [t.id for t in tokenize(m)]
                cuts.append(2 * len(ids))
            packed = np.array(ids, "<u2").tobytes()
            out += [packed[i:j] for i, j in zip(cuts, cuts[1:])]
        return out

    def _ids_of_words(self, words: list[str]) -> pa.LargeBinaryArray:
        """Packed ids of words. Many go to the library in one string, as no merge crosses the end of such a word; one begins at each id that begins with white space."""
        if not self.joins:
            return pa.array(self._ids_of_matches([" " + w for w in words]), pa.large_binary())
        share = MANY if len(words) >= FEW else 1
        whole = np.full(len(words), -1, np.int64)
        if self.ignores_merges:
            whole = np.fromiter(map(self.vocab.get, _shown([" " + w for w in words]), repeat(-1)), np.int64, len(words))
            words = [w for w, v in zip(words, whole.tolist()) if v < 0]
        lines = [(" " + " ".join(words[at:at + share])).replace(" \n", "\n") for at in range(0, len(words), share)]
        tokenize = self.model.tokenize
        found = np.array([t.id for line in _shown(lines) for t in tokenize(line)], np.int64)
        counts = np.ones(len(whole), np.int64)
        counts[whole < 0] = np.diff(np.flatnonzero(self.begins[found]), append=len(found))
        ids = np.repeat(whole, counts)
        ids[ids < 0] = found
        return _large(pa.large_binary(), 2 * counts, ids.astype("<u2"))

    def _are_words(self, pieces: list[str]) -> np.ndarray:
        """Whether each piece is letters, with a space or a line feed before them, and not too long to keep."""
        out = np.fromiter(map(str.isalpha, pieces), bool, len(pieces))
        if self.lines:
            for i in np.flatnonzero(~out).tolist():
                out[i] = pieces[i][:1] == "\n" and pieces[i][1:].isalpha()
        return out & (np.fromiter(map(len, pieces), np.int64, len(pieces)) <= LONGEST_PIECE)

    def _places(self, pieces: list[str]) -> np.ndarray:
        """Places of distinct pieces in ``laid``, of new words too; -1 for what is no word."""
        places = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(places < 0)
        names = [pieces[i] for i in missing.tolist()]
        are = self._are_words(names)
        if are.any():
            words, first = list(compress(names, are.tolist())), len(self.laid)
            self.laid = pa.concat_arrays([self.laid, self._ids_of_words(words)])
            self.uses = np.concatenate((self.uses, np.zeros(len(words), np.int64)))
            self.known.update(zip(words, range(first, first + len(words))))
            places[missing[are]] = np.arange(first, first + len(words))
        self.uses[places[places >= 0]] += 1
        return places

    def _forget(self) -> None:
        """Keeps the half of the words that most groups of texts held."""
        keep = np.sort(np.argpartition(-self.uses, len(self.uses) // 2)[:len(self.uses) // 2])
        kept = np.zeros(len(self.uses), bool)
        kept[keep] = True
        self.known = dict(zip(compress(self.known, kept.tolist()), range(len(keep))))  # words stand in the order of their places
        self.laid, self.uses = self.laid.take(pa.array(keep)), self.uses[keep] // 2

    def _ids_of_parts(self, parts: list[list[str]]) -> list[bytes]:
        """Packed ids of lists of matches; those that are not too long are kept, as a very long one would outweigh many others."""
        fresh = list(dict.fromkeys(m for own in parts for m in own if m not in self.matches))
        self.matches.update(zip(fresh, self._ids_of_matches(fresh)))
        out = [b"".join([self.matches[m] for m in own]) for own in parts]
        for m in fresh:
            if len(m) > LONGEST_PIECE:
                del self.matches[m]
        return out

    def _ids_of_others(self, pieces: list[str]) -> list[bytes | None]:
        """Packed ids of distinct pieces that are no words; None where a piece cannot be encoded by itself."""
        # white space at the end might go on after a cut
        fresh = [p for p in pieces if p not in self.others and (p == "\n" or p[-1:] not in SPACE_SET)]
        found = dict(zip(fresh, self._ids_of_parts([self.split(p if p[:1] == "\n" else " " + p) for p in fresh])))
        self.others.update(found)
        out = list(map(self.others.get, pieces))
        for p in fresh:
            if len(p) > LONGEST_PIECE:
                del self.others[p]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 16-bit integers; the vocabulary's added tokens are read as such wherever they stand."""
        parts = []  # (stretches of a text between added tokens and those tokens)
        for t in texts:
            parts.append(self.at_special(t) if t and any(s in t for s in self.special) else [t or ""])
        done = iter(self._encode([p for own in parts for p in own[::2]]))
        return [b"".join(self.special[p].to_bytes(2, "little") if k % 2 else next(done) for k, p in enumerate(own)) for own in parts]

    def _encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        places, held, size = [], [], 0
        for i, t in enumerate(texts):
            if _plain(t):
                places.append(i)
                held.append(" \n" + t.replace("\n", " \n"))
                size += len(t)
                if size > GROUP_CHARACTERS:
                    self._encode_pieces(places, held, out)
                    places, held, size = [], [], 0
        if held:
            self._encode_pieces(places, held, out)
        for i, done in enumerate(out):
            if done is None:
                matches = self.split(texts[i])
                fresh = dict.fromkeys(matches)
                fresh = dict(zip(fresh, self._ids_of_matches(list(fresh))))
                out[i] = b"".join([fresh[m] for m in matches])
        return out

    def _encode_pieces(self, texts: list[int], held: list[str], out: list[bytes | None]) -> None:
        """Sets the ids of texts that are cut before spaces (a line feed with a space before it stands before each); leaves None where a piece cannot be encoded by itself.

        Arrow cuts the texts and numbers their distinct pieces, so that only these become Python strings and are looked up.
        """
        if len(self.known) > CACHE_PIECES:
            self._forget()
        if max(len(self.others), len(self.matches)) > CACHE_OTHERS:
            self.others, self.matches = {}, {}
        pieces = pc.split_pattern(pa.array(["".join(held)], pa.large_string()), " ").values[1:].dictionary_encode()
        distinct, indices = pieces.dictionary, pieces.indices.to_numpy()
        stems, tails = _before_signs(distinct)
        places = self._places(_strings(stems.dictionary))[stems.indices.to_numpy()]
        odd = np.flatnonzero(places < 0)
        others = self._ids_of_others(_strings(distinct.take(pa.array(odd))))
        words = self.laid.take(pa.array(places, mask=places < 0))
        signs = pa.array(self._ids_of_parts([[t] if t else [] for t in tails.dictionary.to_pylist()]), pa.large_binary())  # such signs behind a word are one match
        ids = pa.concat_arrays([pc.binary_join_element_wise(words, signs.take(tails.indices), pa.scalar(b"", pa.large_binary())), pa.array(others, pa.large_binary())])
        where = np.arange(len(distinct))
        where[odd] = np.arange(len(distinct), len(ids))
        cuts = np.cumsum([0, *(h.count(" ") for h in held)])
        whole = np.zeros(len(held), bool)
        alone = odd[[o is None for o in others]]
        if len(alone):
            unknown = np.flatnonzero(np.isin(indices, alone))
            whole[np.searchsorted(cuts, unknown, side="right") - 1] = True
        laid = ids.take(pa.array(where[indices]))
        ends = np.frombuffer(laid.buffers()[1], np.int64)[cuts].tolist()
        data = memoryview(laid.buffers()[2])
        for i, first, last, odd_text in zip(texts, ends, ends[1:], whole.tolist()):
            if not odd_text:
                out[i] = bytes(data[first + 2:last])  # the line feed put before a text is one id

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one character of ``text`` that each id touches; ids may share a split character."""
        raw = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.lengths[ids])
        begins = ends - self.lengths[ids]
        return character[begins], character[ends - 1] + 1

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, ids.tolist()))


_CODECS: dict[str, Codec] = {}


def codec(name: str) -> Codec:
    """The codec of a vocabulary file: a path, or the name of a public one. One per worker."""
    if name not in _CODECS:
        import public_tokenizers

        _CODECS[name] = Codec(name if os.path.isabs(name) else public_tokenizers.path(name))
    return _CODECS[name]


def ids_of(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u2")


def encode(df: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text", offsets: bool = False) -> DataFrame:
    """(key, ids): the ids of each row's text, packed as little-endian unsigned 16-bit integers.

    With offsets also ``begins`` and ``ends``, the characters that each id touches.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in (part for batch in batches for part in slices(batch, 1, rows=2048, size=1 << 22)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            packed = own.encode(texts)
            columns = [batch.column(0), pa.array(packed, pa.binary())]
            if offsets:
                spans = [own.offsets(t, ids_of(p)) for t, p in zip(texts, packed)]
                columns += [pa.array([s[i].tolist() for s in spans], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "ids", "begins", "ends"][:len(columns)])

    schema = f"`{key}` {kind}, ids binary" + ", begins array<bigint>, ends array<bigint>" * offsets
    return df.select(key, text).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, *, ids: str = "ids") -> DataFrame:
    """Adds ``bytes``, what the packed ids stand for, and ``decoded``, those bytes as text.

    Tokens are joined before they are read as UTF-8; bytes that end inside a character
    become the replacement character.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.types import BinaryType

    @F.pandas_udf(BinaryType())
    def raw(packed):
        own = codec(vocabulary)
        return packed.map(lambda p: own.decode(ids_of(p or b"")))

    @F.pandas_udf("string")
    def shown(raw_bytes):
        return raw_bytes.map(lambda b: b.decode("utf-8", "replace"))

    return df.withColumn("bytes", raw(ids)).withColumn("decoded", shown("bytes"))


def round_trip(df: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes, decodes, and digests both ways, inside one pass over the Arrow batches."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        decimal = [b"%d" % i for i in range(len(own.table))]
        for batch in batches:
            counts, digests, decoded = [], [], []
            for part in slices(batch, 1, rows=2048, size=1 << 22):
                for packed in own.encode(part.column(1).to_pylist()):
                    ids = ids_of(packed).tolist()
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(b",".join(map(decimal.__getitem__, ids))).hexdigest())
                    decoded.append(hashlib.sha256(b"".join(map(own.table.__getitem__, ids))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=["k", "n", "i", "d"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), "byte_bpe_multi_50k.tiktoken")


QUERIES = {"op3_byte_bpe": op3_byte_bpe}
ORACLE: dict[str, str] = {}
