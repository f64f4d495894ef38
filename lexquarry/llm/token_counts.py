"""Operator 7: token counts of a byte-level BPE by the whole-token shortcut.

Offline, `prove_whole_tokens` establishes which vocabulary strings the library encodes alone as one token and splits
alone as one pre-token. Counting then works on units: a run of white space with the characters after it, up to the
next white space. No pre-token crosses from a unit into the next, so a unit's count does not depend on its place. The
distinct units of a batch are split into pre-tokens once; a proven pre-token counts 1, the distinct others are merged in
one call by ranks (a proof in the tests and the library on demand hold this to the library's counts). A text with white space outside ASCII (whose runs could cross units) or with a special string goes to the library
as a whole.

Nulls count as empty texts (0 tokens), a null doc_id stays null, repeated rows each give a row, other columns are not
read. Long texts are cut into units like any other; memory follows the distinct units of about 4 MB of text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame

from lexquarry.llm.common import by_bytes, strings, symbol_bytes, text_array

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Unicode white space outside 0x20 and 0x09-0x0D, or what some libraries take for it.
OTHER_SPACE = "[\\x1c-\\x1f\\x85\\xa0\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"
SPACES = frozenset(" \t\n\v\f\r")
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def prove_whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings that, alone, are one pre-token and one token."""
    tok = load(path)
    back = symbol_bytes()
    strings = []
    for symbols in tok.get_vocab():
        try:
            strings.append(bytes(back[c] for c in symbols).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    strings = [s for s in strings if s and s not in special]
    alone = tok.encode_batch(strings, add_special_tokens=False)
    split = tok.pre_tokenizer.pre_tokenize_str
    return frozenset(s for s, e in zip(strings, alone, strict=True) if len(e.ids) == 1 and len(split(s)) == 1)


MARK = "\x01"  # between pieces that are merged in one call


class Counter:
    """Counts of the distinct units of a batch."""

    def __init__(self, path: str, whole: frozenset[str]):
        import regex
        import tiktoken

        self.tok = load(path)
        self.whole = pa.array(sorted(whole), pa.large_string())
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        back = symbol_bytes()
        ranks = {bytes(back[c] for c in s): i for s, i in self.tok.get_vocab(with_added_tokens=False).items()}
        #: The same merges (an id is its merge's rank), over pieces that are split already.
        self.merge = tiktoken.Encoding("pieces", pat_str=f"[^{MARK}]+|{MARK}", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        (self.mark_id,) = self.merge(MARK)
        self.agreed: set[str] = set(map(chr, range(128)))
        self.odd: set[str] = set()

    def learn_characters(self, units: list[str]) -> None:
        """A character whose class this pattern engine sees otherwise than the library does is odd; units with one are left to the library."""
        for c in set("".join(units)) - self.agreed - self.odd:
            probes = (f"a{c}", f"1{c}", f"!{c}", f" {c}b", f"'{c}")
            same = all([s[p[1][0] : p[1][1]] for p in self.tok.pre_tokenizer.pre_tokenize_str(s)] == self.find(s) for s in probes)
            (self.agreed if same else self.odd).add(c)

    def counts(self, units: list[str]) -> np.ndarray:
        self.learn_characters(units)
        find, odd = self.find, self.odd | {MARK}
        # Units that begin with white space and end in something else keep their pre-tokens when they stand in one text (white
        # space at an end, ASCII or not, would run into the next unit's); the others come last, apart.
        loose = [i for i, u in enumerate(units) if u[:1] not in SPACES or u[-1:].isspace()]
        apart = set(loose)
        order = [i for i in range(len(units)) if i not in apart] if loose else range(len(units))
        pieces = find("".join([units[i] for i in order]))
        length = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        ends = np.cumsum(length[np.asarray(order, dtype=np.int64)])
        per_unit = np.diff(np.searchsorted(np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))), ends, "right"), prepend=0)
        more = [find(units[i]) for i in loose]
        coded = pa.array(pieces + list(chain.from_iterable(more)), pa.large_string()).dictionary_encode()
        total = np.concatenate([[0], np.cumsum([*per_unit, *map(len, more)]).astype(np.int64)])
        each = np.ones(len(coded.dictionary), dtype=np.int64)
        rest = np.flatnonzero(~pc.is_in(coded.dictionary, self.whole).to_numpy(zero_copy_only=False))
        if len(rest):
            ids = np.array(self.merge(MARK.join(strings(coded.dictionary.take(pa.array(rest))))))
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids))
            if len(ends) == len(rest):  # else a piece has the mark in it; its unit is done below, but so must the others be
                each[rest] = np.diff(ends, prepend=-1) - 1
            else:
                each[rest] = [self.library(p) for p in strings(coded.dictionary.take(pa.array(rest)))]
        sums = np.concatenate([[0], np.cumsum(each[coded.indices.to_numpy()])]) if len(coded) else np.zeros(1, dtype=np.int64)
        out = np.empty(len(units), dtype=np.int64)
        out[[*order, *loose]] = sums[total[1:]] - sums[total[:-1]]
        if len(odd) > 1:
            for i, u in enumerate(units):
                if not odd.isdisjoint(u):
                    out[i] = self.library(u)
        return out

    def library(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False).ids)


def unit_array(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets of each text's units, units): the same bytes, cut where white space begins and where texts begin."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    lo, hi = int(offsets[0]), int(offsets[-1])
    if hi == lo:
        return np.zeros(len(texts) + 1, dtype=np.int64), pa.array([], pa.large_string())
    white = WHITE[np.frombuffer(data, dtype=np.uint8, count=hi)[lo:]]
    begins = np.empty(hi - lo, dtype=bool)
    begins[0] = True
    begins[1:] = white[1:] & ~white[:-1]
    starts = offsets[:-1][np.diff(offsets) > 0] - lo
    begins[starts] = True
    cuts = np.append(np.flatnonzero(begins), hi - lo) + lo
    units = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), data])
    return np.searchsorted(cuts, offsets), units


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of `docs` (doc_id, text)."""
    whole = _proven(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = Counter(path, whole)
        counter = _counters[path]
        for batch in by_bytes(batches):
            texts = text_array(batch.column("text"))
            n_bytes = pc.binary_length(texts).to_numpy().astype(np.int64)
            apart = pc.match_substring_regex(texts, OTHER_SPACE).to_numpy(zero_copy_only=False).copy()
            for s in counter.special:
                apart |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
            bounds, units = unit_array(texts)
            coded = units.dictionary_encode()
            each = counter.counts(strings(coded.dictionary))
            total = np.concatenate([[0], np.cumsum(each[coded.indices.to_numpy()] if len(units) else each)])
            n_tokens = total[bounds[1:]] - total[bounds[:-1]]
            for i in np.flatnonzero(apart):
                n_tokens[i] = counter.library(texts[int(i)].as_py())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


@lru_cache(maxsize=4)
def _proven(path: str) -> frozenset[str]:
    return prove_whole_tokens(path)


def query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(TOKENIZER))
