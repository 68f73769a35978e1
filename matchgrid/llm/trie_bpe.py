"""BPE encoding by a prefix-sharing trie, and decoding.

The encoding of a word's prefix is known from its last token alone: the encoding of a prefix p that ends in token t is
the encoding of p without t, followed by t, and t is the only vocabulary token that ends p and is compatible with the
last token before it. Two tokens are compatible if plain BPE leaves their concatenation as these two. So a depth-first walk
of the trie of all distinct words gives every node its last token from those of its ancestors: the encoding of a prefix
that many words share is worked out once. The trie's nodes are not stored: in sorted order words follow as the walk meets
them, and a stack holds the path from the root, of which the next word keeps what it shares. A word's ids are read off by stepping back, token by token.

A word's last character carries the end-of-word suffix, so it is a symbol of its own; the trie keeps it as an edge
beside the plain character's.

Normalisation and splitting into words are the tokenizers library's own, applied to distinct pieces of text between
spaces; special tokens are found in them first, as the library does. Pieces of printable Latin letters, signs and
digits below U+0250, whose properties no version of Unicode changes, take a shorter way to the same words. Pieces are
cached per worker; a cache that is full is emptied, which costs time but drops nothing.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchgrid.llm.tokens import _byte_chars

#: Pieces, and compatible pairs, that a worker keeps before it starts afresh; documents whose words share a trie.
MAX_PIECES = 700_000
MAX_PAIRS = 400_000
TOGETHER = 1024

VOCABULARY = "word_bpe_49k.json"


class TrieBPE:
    """Encodes words (strings of base symbols) with a merge list."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.vocab, self.suffix = vocab, suffix
        self.rank = {tuple(m): k for k, m in enumerate(merges)}
        self.symbols = {t: self._symbols(t) for t in vocab}
        self.pairs: dict[tuple[str, str], bool] = {}
        reachable = [t for t in vocab if self._plain(self.symbols[t]) == [t]]
        self.back: dict = {}  # vocabulary tokens by their symbols from the last to the first
        for t in reachable:
            node = self.back
            for s in reversed(self.symbols[t]):
                node = node.setdefault(s, {})
            node[None] = t

    def _symbols(self, token: str) -> tuple[str, ...]:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return (*body[:-1], body[-1] + self.suffix)
        return tuple(token)

    def _plain(self, symbols: Iterable[str]) -> list[str]:
        """BPE as defined: the lowest-ranked pair first, the leftmost of equals."""
        parts = list(symbols)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.rank.get((parts[k], parts[k + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            found = self.pairs[a, b] = self._plain(self.symbols[a] + self.symbols[b]) == [a, b]
        return found

    def encode(self, words: Iterable[str]) -> dict[str, list[str]]:
        """The tokens of each distinct word.

        Sorted words are a trie in depth-first order: a word's path to the root is its predecessor's as far as both
        agree, and only the rest are new nodes.
        """
        out: dict[str, list[str]] = {}
        path: list[str] = []  # symbols of the inner nodes from the root
        last: list[str] = [""]  # the last token of each prefix of the path
        size: list[int] = [0]  # and its number of symbols
        known, compatible, back, suffix, previous = self.pairs, self.compatible, self.back, self.suffix, ""
        for word in sorted(words):
            end = len(word) - 1
            most, n = min(end, len(path)), 0
            while n < most and word[n] == previous[n]:
                n += 1
            del path[n:], last[n + 1 :], size[n + 1 :]
            for k in range(n, end + 1):
                symbol = word[k]
                level, at, ends = back[symbol if k < end else symbol + suffix], k, []
                while level is not None:  # tokens that end here, with the length of the prefix before them
                    if None in level:
                        ends.append((level[None], at))
                    if not at:
                        break
                    at -= 1
                    level = level.get(path[at])
                while ends:  # the longest first; one always fits
                    token, at = ends.pop()
                    if not at:
                        break
                    fits = known.get((last[at], token))
                    if fits or fits is None and compatible(last[at], token):
                        break
                if k < end:
                    path.append(symbol)
                    last.append(token)
                    size.append(k + 1 - at)
            tokens = [token]
            while at:
                tokens.append(last[at])
                at -= size[at]
            tokens.reverse()
            out[word] = tokens
            previous = word
        return out


class Codec:
    """Texts to ids and back, as the tokenizers library does with this file and add_special_tokens=False."""

    #: White space that surely ends a word, whatever the normaliser does with the rest.
    BLANK = re.compile(r"[ \t\n\r\x0b\x0c]+")
    #: Characters that normalisation only puts in lower case, one for one.
    SIMPLE = re.compile(r"[!-~\xa1-\u012f\u0131-\u024f]+")

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        library = Tokenizer.from_file(path)
        stages = {t["type"] for t in spec["normalizer"]["normalizers"]}
        split, bytes_ = spec["pre_tokenizer"]["pretokenizers"]
        if stages != {"NFC", "Replace", "Lowercase"} or split["behavior"] != "Removed" or bytes_["type"] != "ByteLevel" or bytes_["use_regex"]:
            raise ValueError(f"{path} normalises or splits in a way that is not supported")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.bytes = {b: chr(c) for b, c in _byte_chars().items() if b != c}
        self.normalise = library.normalizer.normalize_str
        self.split = library.pre_tokenizer.pre_tokenize_str
        self.trie = TrieBPE(model["vocab"], merges, model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")")
        names = {i: t for t, i in (model["vocab"] | self.special).items()}
        self.names = [names.get(k, "") for k in range(max(names) + 1)]
        self.codes = {t: i.to_bytes(4, "little") for t, i in (model["vocab"] | self.special).items()}
        self.pieces: dict[str, tuple[bytes, str]] = {}

    def _words(self, piece: str) -> list[str | int]:
        """Words in base symbols, and the ids of special tokens."""
        if self.SIMPLE.fullmatch(piece) and "<|" not in piece:
            low = piece.lower()
            found = [low] if low.isalpha() else self.words.findall(low)
            return found if low.isascii() else [w.encode().decode("latin-1").translate(self.bytes) for w in found]
        out: list[str | int] = []
        for part in self.marks.split(piece):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += [w for w, _ in self.split(self.normalise(part))]
        return out

    def _learn(self, pieces: Iterable[str]) -> None:
        split = {p: self._words(p) for p in pieces}
        known = self.trie.encode({w for ws in split.values() for w in ws if isinstance(w, str)})
        codes, names = self.codes, self.names
        for p, ws in split.items():
            tokens = [t for w in ws for t in (known[w] if isinstance(w, str) else (names[w],))]
            self.pieces[p] = b"".join([codes[t] for t in tokens])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids (little-endian uint32)."""
        split = [self.BLANK.split(t) for t in texts]
        have = self.pieces
        wanted = set().union(*split)
        if missing := wanted.difference(have):
            if len(have) + len(missing) > MAX_PIECES:
                have.clear()
                missing = wanted
            self._learn(missing)
        return [b"".join([have[p] for p in ps]) for ps in split]

    def decode(self, ids: bytes) -> str:
        """As the library decodes this file, which names no decoder: tokens joined by one space."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, uint32 little-endian), decoded, one row per row of df.

    Null text counts as empty: no ids, empty decoded text. Repeated rows and null ids are kept as they are; an empty
    table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary_path)
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(k, TOGETHER)
                done = c.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(done, pa.binary()), pa.array([c.decode(x) for x in done], pa.string())], ["doc_id", "ids", "decoded"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(df: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens and the hashes of ids and decoded text, without moving either out of the task.

    Null text counts as empty: no ids, empty decoded text. Repeated rows and null ids are kept as they are; an empty
    table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary_path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(k, TOGETHER)
                done = c.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column(0),
                        "n_tokens": pa.array([len(x) // 4 for x in done], pa.int64()),
                        "ids_sha256": [sha(x) for x in done],
                        "decoded_sha256": [sha(c.decode(x).encode()) for x in done],
                    }
                )

    return df.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, public_tokenizers.path(VOCABULARY))
