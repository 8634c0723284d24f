"""Token counts of whole texts, long ones by overlapping chunks.

A text is cut into pre-tokens and every pre-token's tokens are counted once per
worker: a bounded memory holds the counts, the library's model encodes only what
is not in it.  Texts within U+0000-U+017F are cut by the file's own word pattern,
all others by the library's pre-tokeniser; added tokens are cut out first.

Texts of up to ``CHUNK`` characters are counted whole.  A longer one is counted
chunk by chunk with offsets; neighbouring chunks overlap, and the two are
spliced at a place where both start a new pre-token.  That place is proven
stable: the pre-tokeniser reads from left to right and looks only ahead, so
equal starts give equal tokens from there on, provided that the left chunk saw
``MARGIN`` more characters (enough for any look-ahead and for the longest added
token).  If the overlap holds no such place it is doubled, up to the whole rest
of the left chunk.

Memory: one chunk (or the widened overlap) at a time besides the text, and the
remembered pre-tokens.

Defined cases: a null text is empty and has no tokens and no bytes; repeated
rows are counted alike; special strings inside a text are handled as the
library does by default; very long texts are counted whole; an empty table
gives an empty result.  Extra columns stay out of the result.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame

from kinrank.llm.bpe import byte_letters
from kinrank.llm.shared import text_batches, worker_memo

CHUNK = 4096                 # characters
OVERLAP = 128
MARGIN = 32
LIMIT = 512
MEMO = 500_000               # pre-tokens a worker remembers at once (about 80 MB)
LONG = 64                    # longer ones are not remembered

# Fixed values of the file format, for characters below U+0180: white space, letters
# and numbers of its word pattern, and that pattern.
SPACE = "\t-\r \x85\xa0"
LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
PATTERN = (f"'(?:s|t|re|ve|m|ll|d)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+"
           f"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
KIND = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


class Counter:
    """The tokens of one tokenizer file: byte-level pre-tokens without a normaliser, merged by BPE."""

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if spec["normalizer"] or any(pre.get(k) != v for k, v in KIND.items()) or model["type"] != "BPE" or any(
                model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix")):
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take in their surroundings")
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        self.encode, self.model, self.library = tokenizer.encode, tokenizer.model, tokenizer.pre_tokenizer.pre_tokenize_str
        self.find, self.plain = re.compile(PATTERN).findall, re.compile("[\x00-\u017f]*").fullmatch
        self.letters = byte_letters()
        self.memo: dict[str, int] = {}

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text without added tokens; joined they are the text."""
        return self.find(text) if self.plain(text) else [text[a:b] for _, (a, b) in self.library(text)]

    def counts(self, words: list[str]) -> list[int]:
        """The number of tokens of each pre-token."""
        found = list(map(self.memo.get, words))
        if None in found:
            if len(self.memo) > MEMO:
                self.memo.clear()
            for i, n in enumerate(found):
                if n is None:
                    n = self.memo.get(words[i])
                    if n is None:
                        n = len(self.model.tokenize("".join(map(self.letters.__getitem__, words[i].encode()))))
                        if len(words[i]) <= LONG:
                            self.memo[words[i]] = n
                    found[i] = n
        return found

    def _parts(self, text: str):
        """(text, is it an added token) in order."""
        at = 0
        for m in self.added.finditer(text) if self.added else ():
            if m.start() > at:
                yield text[at:m.start()], False
            yield m.group(), True
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def total(self, text: str) -> int:
        return sum(1 if special else sum(self.counts(self.words(part))) for part, special in self._parts(text))

    def measure(self, text: str, begin: int, end: int):
        """Of text[begin:end]: places of its pre-tokens, tokens before each, and all tokens."""
        words, tokens = [], []
        for part, special in self._parts(text[begin:end]):
            own = [part] if special else self.words(part)
            words += own
            tokens += [1] if special else self.counts(own)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        sums = np.cumsum(np.array(tokens, np.int64))
        starts = begin + np.concatenate([[0], ends[:-1]]) if words else np.zeros(0, np.int64)
        return starts, np.concatenate([[0], sums[:-1]]) if words else starts, int(sums[-1]) if words else 0


def load(path: str) -> Counter:
    return Counter(path)


def count_tokens(counter: Counter, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of tokens of one text, spliced from chunks."""
    total, at, end = 0, 0, min(chunk, len(text))       # tokens before `at` are in `total`
    starts, before, tokens = counter.measure(text, at, end)
    while end < len(text):
        width, stop = overlap, min(end + max(chunk, end - at), len(text))
        while True:
            begin = max(at, end - width)
            ours, own, n = counter.measure(text, begin, stop)
            if begin == at:                # no stable place in the whole left chunk: one longer chunk
                starts, before, tokens, end = ours, own, n, stop
                break
            common = np.intersect1d(ours, starts, assume_unique=True)
            common = common[(common > at) & (common <= end - MARGIN)]
            if len(common):
                place = common[-1]
                i = np.searchsorted(ours, place)
                total += int(before[np.searchsorted(starts, place)])
                starts, before, tokens, at, end = ours[i:], own[i:] - own[i], n - int(own[i]), int(place), stop
                break
            width *= 2
    return total + tokens


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK,
                 overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document."""
    def run(batches):
        import pyarrow as pa
        counter = worker_memo(("token-count", path), lambda: load(path))
        for b in batches:
            size, count = [], []
            for texts in text_batches(b, "text", 64):
                texts = [x or "" for x in texts]
                size += [len(x.encode()) for x in texts]
                count += [counter.total(x) if len(x) <= chunk else count_tokens(counter, x, chunk, overlap) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index("doc_id")), pa.array(size, pa.int64()), pa.array(count, pa.int64()),
                 pa.array([n > limit for n in count], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
