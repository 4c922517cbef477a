"""BPE encoding and decoding, with tree concatenation for long unsplit text.

Text is cut at single spaces, where the public tokenizers never merge across, and
each distinct piece of a run is encoded once. A piece of more than
``tokens.LONG_PIECE`` characters, and text that cannot be cut at spaces, is
normalised and split into words by the file's own rules; a word of more than
``LEAF_BYTES`` bytes, of any script, is halved down to leaves. Leaves are encoded
in parallel and neighbours joined upwards: a window of tokens on both sides of a
join is encoded again and grows until its first token equals the left side's own
token there and its last token the right side's. Every neighbouring pair of the
result then stands in some exact encoding, which makes the whole exact; a side
whose tokens are used up is simply encoded whole.

Left to the library are texts that hold a NUL, which stands for the end of a word
here, and files of another layout.

Defined results: null reads as empty; an empty text has no ids and decodes to
the empty string; repeated rows stay; an empty table gives an empty table; further
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm import tokens
from docframe.llm.common import text_of

#: Bytes of a leaf of the tree; longer words go through it.
LEAF_BYTES = 32
#: Leaves from which on threads share them.
MANY_LEAVES = 512
#: Tokens on each side of a join that are encoded again at first.
WINDOW = 8


class TreeEncoder:
    """Ranks of a long byte string by merging halves; ``encode`` gives ranks of a short one. ``joins`` counts the joins made."""

    def __init__(self, encode, sizes: np.ndarray, leaf: int = LEAF_BYTES):
        self.encode, self.sizes, self.leaf = encode, sizes.tolist(), leaf
        self.joins = 0

    def join(self, data: bytes, middle: int, left: list[int], right: list[int]) -> list[int]:
        """Ranks of ``data`` from the ranks of its parts before and behind ``middle``."""
        self.joins += 1
        n, size = WINDOW, self.sizes.__getitem__
        while True:
            a, b = left[-n:], right[:n]
            window = self.encode(data[middle - sum(map(size, a)) : middle + sum(map(size, b))])
            left_done, right_done = n >= len(left), n >= len(right)
            if (left_done or window[0] == a[0]) and (right_done or window[-1] == b[-1]):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            n *= 2

    def __call__(self, data: bytes) -> list[int]:
        parts = [data[i : i + self.leaf] for i in range(0, len(data), self.leaf)]
        if len(parts) < MANY_LEAVES:
            found = map(self.encode, parts)
        else:
            with ThreadPoolExecutor(4) as pool:
                found = list(pool.map(self.encode, parts, chunksize=128))
        level = [(i * self.leaf, i * self.leaf + len(p), r) for i, (p, r) in enumerate(zip(parts, found, strict=True))]
        while len(level) > 1:
            pairs = zip(level[::2], level[1::2], strict=False)
            joined = [(a[0], b[1], self.join(data[a[0] : b[1]], a[1] - a[0], a[2], b[2])) for a, b in pairs]
            level = joined + level[len(joined) * 2 :]
        return level[0][2] if level else []


class LongPieces:
    """Encoder of long unsplit pieces, and of texts that cannot be cut at spaces, for one file of the known layouts."""

    def __init__(self, path: str):
        self.path = path
        core, self.ids, sizes = tokens.ranks(path)
        self.short, self.tree = core._encode_single_piece, TreeEncoder(core._encode_single_piece, sizes)
        self.bytes = tokens.byte_chars()
        self.end = tokens.WORD_END if tokens.spec(path)["model"].get("end_of_word_suffix") else b""
        added = {t["content"]: t for t in tokens.spec(path)["added_tokens"]}
        self.added = {c: t["id"] for c, t in added.items()}
        # an added token cuts the text wherever it stands, if the file asks for nothing else
        self.plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added.values())
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def words(self, text: str) -> list[bytes]:
        t = tokens.tokenizer(self.path)
        text = t.normalizer.normalize_str(text) if t.normalizer else text
        return [bytes(map(self.bytes.__getitem__, w)) + self.end for w, _ in t.pre_tokenizer.pre_tokenize_str(text)]

    def __call__(self, piece: str) -> np.ndarray:
        if "\0" in piece or not self.plain:
            return tokens.encode_whole(self.path, piece)
        out: list[int] = []
        for part in self.cut.split(piece) if self.cut else [piece]:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                ranks = [r for w in self.words(part) for r in (self.tree(w) if len(w) > self.tree.leaf else self.short(w))]
                out += self.ids[ranks].tolist()
        return np.array(out, "<u4")


@lru_cache(maxsize=2)
def token_texts(path: str) -> list[str]:
    """What each id decodes to, special tokens included, for files without a decoder."""
    t = tokens.tokenizer(path)
    return [t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))]


def decode_ids(path: str, ids: np.ndarray) -> str:
    """The library's ``decode`` with special tokens kept; files without a decoder join tokens by spaces."""
    if tokens.spec(path)["decoder"] is not None:
        return tokens.tokenizer(path).decode(ids.tolist(), skip_special_tokens=False)
    return " ".join(map(token_texts(path).__getitem__, ids.tolist()))


def bpe_round_trip(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids (array) and decoded (string) of every whole text."""
    picked = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long_piece = LongPieces(path) if tokens.family(path) else None
        for b in found:
            texts = b.column("text").to_pylist()
            for i, j in tokens.runs(texts):
                ids, cut = tokens.encode_run(path, texts[i:j], long_piece)
                decoded = [decode_ids(path, ids[cut[k] : cut[k + 1]]) for k in range(j - i)]
                held = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), held, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(batches, f"doc_id {kind}, ids array<int>, decoded string")
