"""BPE encoding and decoding over a contiguous array of ranks.

The tokenizer file gives vocabulary, merge ranks and added tokens.  A word is
held as two short arrays side by side: the symbols of its parts and the rank of
every adjacent pair.  The smallest rank is looked up by scanning, the boundary
behind it is deleted and the two neighbouring ranks are refreshed, until no
pair has a rank.  Words of more than ``SHORT`` bytes use a heap of ranks with
linked parts instead (the same merges in the same order, not quadratic).

Text is prepared as the file prescribes: added tokens are cut out of the raw
text; the rest is normalised and pre-split.  Texts within U+0000-U+017F take
a direct path (there the rules come to white space, lower case and a pattern);
any other text goes through the library's normaliser and pre-tokeniser.

Defined cases: a null text is empty; an empty text has no ids and decodes to the
empty string; repeated rows are encoded alike; columns besides doc_id and text
stay out of the result.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
from pyspark.sql import DataFrame

from kinrank.llm.shared import text_batches, worker_memo

SHORT = 128
MEMO = 500_000               # words a worker remembers at once (about 120 MB)
NONE = 1 << 62               # the rank of a pair that doesn't merge

# Fixed values of the file format, for characters below U+0180: white space of its
# normaliser, letters (L), numbers (N), and its word pattern.
SPACE = "\\t-\\r \\x85\\xa0"
LETTER = "a-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u017f"
NUMBER = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
PATTERN = f"[{LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+"

ENCODED = "doc_id {id}, ids array<int>, decoded string"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable Latin-1, else U+0100 and on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Bpe:
    """One tokenizer file with byte letters, an end-of-word suffix and no decoder."""

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.tokens = {i: t for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.added.items()}
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + end] for c in letters]
        self.letter_byte = {c: b for b, c in enumerate(letters)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.find = re.compile(PATTERN).findall
        self.plain = re.compile("[\\x00-\\u017f]*").fullmatch
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.known: dict[bytes, tuple[bytes, str]] = {}

    def parts(self, word: bytes) -> list[int]:
        """The ids of one word."""
        ids = [self.inner[b] for b in word[:-1]] + [self.final[word[-1]]]
        return self._scan(ids) if len(ids) <= SHORT else self._heap(ids)

    def _scan(self, ids: list[int]) -> list[int]:
        merges, none = self.merges, (NONE, 0)
        ranks = [merges.get(p, none)[0] for p in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            i = ranks.index(low)
            ids[i] = merges[ids[i], ids[i + 1]][1]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = merges.get((ids[i - 1], ids[i]), none)[0]
            if i < len(ranks):
                ranks[i] = merges.get((ids[i], ids[i + 1]), none)[0]
        return ids

    def _heap(self, ids: list[int]) -> list[int]:
        merges = self.merges
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(merges[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue                       # the pair is gone
            ids[i], ids[j] = merges[a, b][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) >= 0 and (p := (ids[left], ids[right])) in merges:
                    heapq.heappush(heap, (merges[p][0], left, *p))
        return [x for x in ids if x >= 0]

    def word(self, word: bytes) -> tuple[bytes, str]:
        """A word's ids as little-endian 32-bit integers, and its tokens joined by spaces; remembered."""
        if len(self.known) > MEMO:
            self.known.clear()
        ids = self.parts(word)
        out = np.array(ids, "<u4").tobytes(), " ".join(map(self.tokens.__getitem__, ids))
        if len(word) <= SHORT:
            self.known[word] = out
        return out

    def words(self, text: str) -> list[bytes]:
        """The words of a text without added tokens, as UTF-8."""
        if self.plain(text):
            return [w.encode() for w in self.find(text.lower())]
        pieces = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
        return [bytes(map(self.letter_byte.__getitem__, p)) for p, _ in pieces]

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """All ids of a text as bytes, and the text decoded from them (tokens joined by spaces)."""
        ids, decoded = [], []
        for piece in self.cut.split(text or ""):
            if piece in self.added:
                ids.append(self.added[piece].to_bytes(4, "little"))
                decoded.append(piece)
                continue
            known, word = self.known, self.word
            for w in self.words(piece):
                out = known.get(w) or word(w)
                ids.append(out[0])
                decoded.append(out[1])
        return b"".join(ids), " ".join(decoded)

    def decode(self, ids) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


def tokenizer(path: str) -> Bpe:
    """The tokenizer of a file, built once in each worker."""
    return worker_memo(("bpe", path), lambda: Bpe(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of every document."""
    def run(batches):
        import pyarrow as pa
        t = tokenizer(path)
        for b in batches:
            ids_of = b.column(b.schema.get_field_index("doc_id"))
            at = 0
            for texts in text_batches(b, "text"):
                out = [t.encode(x) for x in texts]
                ids = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *(len(x) // 4 for x, _ in out)]), pa.int32()),
                    pa.array(np.frombuffer(b"".join(x for x, _ in out), "<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [ids_of.slice(at, len(out)), ids, pa.array([x for _, x in out], pa.string())],
                    names=["doc_id", "ids", "decoded"])
                at += len(out)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, ENCODED.format(id=kind))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the digests, taken where the ids are made,
    so that neither ids nor decoded texts leave the worker."""
    def run(batches):
        from hashlib import sha256

        import pyarrow as pa
        t = tokenizer(path)
        for b in batches:
            out = [(len(ids) // 4, sha256(ids).hexdigest(), sha256(text.encode()).hexdigest())
                   for texts in text_batches(b, "text") for ids, text in map(t.encode, texts)]
            n, ids, texts = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(ids, pa.string()),
                 pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
