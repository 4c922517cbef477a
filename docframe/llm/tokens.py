"""Tokenizers inside tasks: ids of whole texts, each distinct piece encoded once a run.

A text is cut at single spaces between non-blank characters. The public
byte-level and word tokenizers never merge across such a place, so the distinct
pieces of a run of texts are encoded together and the ids of the texts are
gathered from them. A text with other spacing at a cut (double spaces, other
blanks beside a space) goes to the library whole.

Pieces of Latin-1 characters are merged by ranks (``tiktoken``) where the file's
merges are in the order of its ids, which makes both libraries give the same
ids; other files and other pieces go through ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of text encoded together; memory in a task follows this, not the batch.
RUN_CHARS = 3_000_000
#: Pieces of more characters than this are encoded apart.
LONG_PIECE = 32
#: Stands for the mark at the end of a word; pieces that hold it go to the library.
WORD_END = b"\x00"


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The library's tokenizer of a .json file, without truncation and padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache(maxsize=4)
def spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


#: The split patterns of the two public layouts.
BYTE_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""


def byte_chars() -> dict[str, int]:
    """The printable character of each byte in byte-level vocabularies, reversed.

    Printable Latin-1 bytes stand for themselves, the others follow from 256 on.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def ranks(path: str):
    """Encoding, id and byte size of each rank, for a file whose merges follow its ids; None for other files."""
    import tiktoken

    model = spec(path)["model"]
    if model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("byte_fallback"):
        return None
    suffix = model.get("end_of_word_suffix") or ""
    back = byte_chars()
    vocab = model["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]

    def raw(token: str) -> bytes:
        end = bool(suffix) and token.endswith(suffix)
        body = token[: -len(suffix)] if end else token
        return bytes(back[c] for c in body) + (WORD_END if end else b"")

    order = ([c + suffix for c in back] if suffix else []) + list(back)
    joined = [a + b for a, b in merges]
    if any(t not in vocab for t in order + joined) or any(vocab[x] >= vocab[y] for x, y in zip(joined, joined[1:], strict=False)):
        return None
    # word ends come first: the mark joins its last byte before anything else merges
    table: dict[bytes, int] = {}
    ids: list[int] = []
    for t in order + joined:
        if table.setdefault(raw(t), len(ids)) != len(ids):
            if suffix and raw(t) in (WORD_END, WORD_END * 2):
                continue  # the mark itself never stands in a piece encoded here
            return None
        ids.append(vocab[t])
    core = tiktoken.Encoding("ranks", pat_str=r"[^ ]+" if suffix else BYTE_SPLIT, mergeable_ranks=table, special_tokens={})
    sizes = np.zeros(len(ids), np.int64)
    for token, rank in table.items():
        sizes[rank] = len(token)
    return core, np.array(ids, "<u4"), sizes


def merge_bytes(path: str, word: bytes) -> np.ndarray:
    """Ids of the bytes of one unsplit word."""
    core, ids, _ = ranks(path)
    return ids[core._encode_single_piece(word)]


# The word split on Latin-1 characters, where every library agrees on what a letter or number is.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\t-\r \x1c-\x1f\x85\xa0"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+|\n")


@lru_cache(maxsize=4)
def family(path: str) -> str:
    """'byte' and 'word' name the two public layouts with a quick way; '' is any other."""
    s = spec(path)
    pre, norm = s["pre_tokenizer"] or {}, json.dumps(s["normalizer"])
    suffix = s["model"].get("end_of_word_suffix")
    if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and norm == "null" and not suffix:
        return "byte" if ranks(path) else ""
    split = (pre.get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
    if split == WORD_SPLIT and '"NFC"' in norm and '"Lowercase"' in norm and suffix:
        return "word" if ranks(path) else ""
    return ""


@lru_cache(maxsize=4)
def _odd(path: str) -> str:
    """RE2 pattern of pieces that need the library or more care."""
    marks = {re.escape(t["content"][:2]) for t in spec(path)["added_tokens"]}
    return "|".join([r"^$", r"^[\s]", r"[\s]$", r"[\x00\x1c-\x1f\x{85}\x{a0}]", r"[^\x{0}-\x{ff}]", *marks])


def encode_whole(path: str, text: str) -> np.ndarray:
    return np.array(tokenizer(path).encode(text, add_special_tokens=False).ids, dtype="<u4")


def _bytes_of(path: str, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of byte-level pieces, each after a space, and the end of each piece's ids."""
    core, ids, sizes = ranks(path)
    if not len(pieces):
        return np.empty(0, "<u4"), np.empty(0, np.int64)
    found = np.array(core.encode_ordinary(" " + " ".join(pieces.to_pylist())), dtype=np.int64)
    ends = np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    return ids[found], np.searchsorted(np.cumsum(sizes[found]), ends) + 1


def _words_of(path: str, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of word-level pieces and the end of each piece's ids; a line feed stands between pieces."""
    core, ids, _ = ranks(path)
    if not len(pieces):
        return np.empty(0, "<u4"), np.empty(0, np.int64)
    end = WORD_END.decode()
    words = _WORDS.findall("\n".join(pieces.to_pylist()).lower() + "\n")
    found = np.array(core.encode_ordinary(f"{end} ".join(words) + end), dtype=np.int64)
    mark = core._encode_single_piece(b"\n" + WORD_END)[0]
    stops = np.flatnonzero(found == mark)
    return ids[found[found != mark]], stops - np.arange(len(stops))


def encode_run(path: str, texts: list[str], long_piece=None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and the bounds (one more than texts) of each.

    ``long_piece`` encodes a long unsplit piece and whatever cannot be cut at spaces; by default the library does.
    """
    kind = family(path)
    other = long_piece or (lambda t: encode_whole(path, t))
    if not kind or not texts:
        each = [encode_whole(path, t) for t in texts]
        return np.concatenate(each or [np.empty(0, "<u4")]), np.cumsum([0] + [len(x) for x in each])
    flat = pa.array(texts, pa.large_string())
    if kind == "word":  # blanks are dropped, so a line feed cuts as a space does
        flat = pc.replace_substring(flat, "\n", " ")
    parts = pc.split_pattern(flat, " ")
    bounds = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.values.dictionary_encode()
    codes, pieces = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    odd = pc.or_(pc.match_substring_regex(pieces, _odd(path)), pc.greater(pc.utf8_length(pieces), LONG_PIECE))
    plain = np.flatnonzero(~odd.to_numpy(zero_copy_only=False))
    ids, ends = (_bytes_of if kind == "byte" else _words_of)(path, pieces.take(pa.array(plain)))
    sizes = np.zeros(len(pieces), np.int64)
    starts = np.zeros(len(pieces), np.int64)
    starts[plain], sizes[plain] = np.r_[0, ends[:-1]] if len(ends) else ends, np.diff(np.r_[0, ends])
    uncut = np.zeros(len(pieces), bool)
    more, at = [ids], len(ids)

    def put(code: int, found: np.ndarray) -> None:
        nonlocal at
        starts[code], sizes[code] = at, len(found)
        more.append(found)
        at += len(found)

    for code in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
        p = pieces[int(code)].as_py()
        if kind == "word" and not p:
            continue
        if not p or p[0].isspace() or p[-1].isspace():
            uncut[code] = True
        else:
            put(code, other(p if kind == "word" else " " + p))
    if kind == "byte":  # the first piece of a text has no space before it
        first = codes[bounds[:-1]]
        codes[bounds[:-1]] = len(pieces) + np.arange(len(texts))
        starts, sizes = np.r_[starts, np.zeros(len(texts), np.int64)], np.r_[sizes, np.zeros(len(texts), np.int64)]
        uncut = np.r_[uncut, uncut[first]]
        core, own, _ = ranks(path)
        rough = odd.to_numpy(zero_copy_only=False)
        for i, code in enumerate(first):
            p = pieces[int(code)].as_py()
            put(len(pieces) + i, other(p) if rough[code] else own[core.encode_ordinary(p)])
    ids = np.concatenate(more)
    whole = np.logical_or.reduceat(uncut[codes], bounds[:-1])
    n = sizes[codes]
    stop = np.cumsum(n)
    index = np.repeat(starts[codes] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)
    out, cut = ids[index], np.r_[0, stop][bounds]
    if not whole.any():
        return out, cut
    each = [other(t) if w else out[cut[i] : cut[i + 1]] for i, (t, w) in enumerate(zip(texts, whole, strict=True))]
    return np.concatenate(each), np.cumsum([0] + [len(x) for x in each])


def runs(texts: list[str], chars: int = RUN_CHARS):
    """Bounds of runs of texts of a bounded total size."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


@lru_cache(maxsize=2)
def piece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def count_run(path: str, texts: list[str]) -> np.ndarray:
    """Numbers of tokens by the library that the file name names."""
    if path.endswith(".model"):
        return np.array([len(x) for x in piece_model(path).encode(texts, num_threads=1)], np.int64)
    return np.diff(encode_run(path, texts)[1])
