"""Token counts by byte-pair merging over a heap and a linked list.

For every pre-token the adjacent pair of lowest rank is popped again and again (leftmost on ties) and joined; the count is
the number of initial symbols less the number of merges, and no identifiers are emitted. Special strings listed in the
tokenizer file count as one token each and cut the text, as the library does by default.

Cases: a null text counts as empty (0 bytes, 0 tokens, not over the limit); the cost of a pre-token of n bytes is
O(n log n), so that one endless word is no trap; counts of short pre-tokens are cached per Python worker up to
twice ``CACHE_ENTRIES`` (results do not depend on it). Repeated rows are counted row by row, extra columns
are never read, and an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cairn.llm.bpe_encode import byte_alphabet
from cairn.llm.frames import as_text
from cairn.llm.pretokens import Generations, splitter

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
CACHE_ENTRIES = 500_000
CACHED_LENGTH = 48
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class Counter(Generations):
    """Pre-token to its number of tokens; computed on a miss."""

    def __init__(self, tokenizer: str = TOKENIZER):
        super().__init__(CACHE_ENTRIES)
        with open(public_tokenizers.path(tokenizer), encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        if not plain or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{tokenizer}: only plain byte-level BPE files are supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{tokenizer}: added tokens that strip or need word ends are not supported")
        alphabet, ids = byte_alphabet(), model["vocab"]
        self.symbols = [ids[c] for c in alphabet]
        self.pairs: list[dict[int, int]] = [{} for _ in range(max(ids.values()) + 1)]  # left id: right id to rank
        self.joined: list[int] = []
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[ids[left]][ids[right]] = len(self.joined)
            self.joined.append(ids[left + right])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.first = special
        self.find = splitter()

    def __missing__(self, piece: str) -> int:
        if (n := self.old.get(piece)) is None:
            n = self.merged(piece.encode())
        if len(piece) <= CACHED_LENGTH:
            self.add(piece, n)
        return n

    def merged(self, data: bytes) -> int:
        n = len(data)
        if n < 2:
            return n
        shift = n.bit_length()  # heap entries are rank and position in one integer
        low = (1 << shift) - 1
        pairs, joined, symbols = self.pairs, self.joined, self.symbols
        ids = [symbols[b] for b in data]
        ids.append(-1)  # stands behind the last symbol; pairs with nothing
        ranks = [pairs[a].get(b, -1) for a, b in zip(ids, ids[1:], strict=False)]  # of the pair that starts at each place
        heap = [r << shift | i for i, r in enumerate(ranks) if r >= 0]
        if not heap:
            return n
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        count = n
        while heap:
            entry = heappop(heap)
            i, r = entry & low, entry >> shift
            if ranks[i] != r:  # its left symbol was absorbed, or either side has changed since
                continue
            j = after[i]
            k = after[j]
            new = ids[i] = joined[r]
            ranks[j] = -1
            count -= 1
            after[i] = k
            following = pairs[new]
            if k < n:
                before[k] = i
                ranks[i] = s = following.get(ids[k], -1)
                if s >= 0:
                    heappush(heap, s << shift | i)
            else:
                ranks[i] = -1
            if (h := before[i]) >= 0:
                ranks[h] = s = pairs[ids[h]].get(new, -1)
                if s >= 0:
                    heappush(heap, s << shift | h)
        return count

    def count(self, text: str) -> int:
        if self.special is None or not any(s in text for s in self.first):
            return sum(map(self.__getitem__, self.find(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.find(p))) for p in parts)


@lru_cache(maxsize=2)
def counter(tokenizer: str = TOKENIZER) -> Counter:
    return Counter(tokenizer)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in batches:
            size, tokens = [], []
            for t in batch.column(1).to_pylist():
                text = t or ""
                size.append(len(text.encode()))
                tokens.append(own.count(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return as_text(df, id_col, text_col).mapInArrow(run, SCHEMA)
