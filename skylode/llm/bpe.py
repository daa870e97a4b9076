"""Byte-level BPE by backtracking over longest matches.

The vocabulary's tokens, each byte mapped to the Latin-1 character of the same number, form an Aho-Corasick automaton,
which gives the longest token at a position. Two tokens may stand side by side exactly if merging their joint bytes by
rank would end in these two; that is found by undoing their merges from the seam outwards, and is kept in a memo. A
text is then encoded from left to right: take the longest token that is compatible with the one before; where there is
none, fall back to the next shorter one, else take back the token before. A position that has failed is never entered
again, so the time is linear in the text. The ids are those of repeated lowest-rank merging.

Each match of the split pattern is encoded by itself and kept in a bounded memo, since most words come again.

Cases: a null or empty text has no ids and decodes to no bytes; a text of any length is one row, encoded piece by
piece; an unpaired surrogate cannot occur in Spark's strings. Rows stay as they are, repeated or not; an empty table
gives an empty result; a column in ``keep`` that has the name of an added one is an error, others may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused

#: Code points of White_Space, as the pattern's \s means it; Python's own \s holds \x1c to \x1f as well.
SPACES = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The pattern of the byte-level vocabularies; for it, runs are looked up whole.
KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO_PIECES, MEMO_CHARS, MEMO_PAIRS = 400_000, 40, 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    """A file of lines 'base64 rank', as tiktoken reads it."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def split_pattern(pattern: str):
    r"""The pattern for Python's re, which is several times faster than regex: \p{L}, \p{N} and \s are written out."""
    import re

    import regex

    def ranges(prop: str) -> str:
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        return "".join(f"\\U{ord(m[0][0]):08x}-\\U{ord(m[0][-1]):08x}" for m in regex.finditer(rf"\p{{{prop}}}+", every) for m in _runs(m[0]))

    def _runs(s: str):
        start = 0
        for i in range(1, len(s) + 1):
            if i == len(s) or ord(s[i]) != ord(s[i - 1]) + 1:
                yield (s[start:i],)
                start = i

    letters, numbers = ranges("L"), ranges("N")
    known = {r" ?\p{L}+": f" ?[{letters}]+", r" ?\p{N}+": f" ?[{numbers}]+", r" ?[^\s\p{L}\p{N}]+": f" ?[^{SPACES}{letters}{numbers}]+", r"\s+(?!\S)": f"[{SPACES}]+(?![^{SPACES}])", r"\s+": f"[{SPACES}]+"}
    parts = [known.get(p, p) for p in pattern.split("|")]
    if any("\\p" in p or "\\s" in p.replace(SPACES, "") for p in parts):
        return regex.compile(pattern)
    return re.compile("|".join(parts))


def _runs_pattern():
    import re

    return re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick

        self.ranks, self.tokens = ranks, {i: t for t, i in ranks.items()}
        self.split = split_pattern(pattern)
        # Where the pattern lets no match go from other characters on to white space, a run of them with the space
        # before it is split alike wherever it stands, so whole runs can be looked up.
        self.runs = _runs_pattern() if pattern == KNOWN else self.split
        self.halves: dict[int, tuple[int, int]] = {}
        self.merges: dict[tuple[int, int], int] = {}
        self.shorter: dict[int, int] = {}  # the longest token that begins a token
        self.trie = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.trie.add_word(token.decode("latin-1"), rank)
        for rank in sorted(self.tokens):  # a token's halves have lower ranks
            self._take_apart(rank)
        self.trie.make_automaton()
        for rank, token in self.tokens.items():
            short = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), -1)
            self.shorter[rank] = short
        self.word = [struct.pack("<I", i) for i in range(max(self.tokens) + 1)]
        self.sizes = [len(self.tokens.get(i, b"")) for i in range(len(self.word))]
        self.pairs: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        self.run_memo: dict[str, bytes] = {}

    def _take_apart(self, rank: int) -> None:
        """Finds the last merge that makes the token: what the merges of lower rank leave of it."""
        token = self.tokens[rank]
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if self.ranks.get(parts[best] + parts[best + 1], 1 << 60) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2 and all(p in self.ranks for p in parts):
            self.halves[rank] = (self.ranks[parts[0]], self.ranks[parts[1]])
            self.merges[self.halves[rank]] = rank

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._seam_holds(left, right)
        return known

    def _seam_holds(self, left: int, right: int) -> bool:
        """Whether no merge across the seam would have come before a merge that made left or right.

        The merges on both sides are undone latest first. A merge over the seam of what is left and right now wins if
        its rank is below that of the merge undone last: on the left side also at the same rank, as leftmost goes first.
        """
        undone = 1 << 60
        while True:
            over = self.merges.get((left, right))
            if over is not None and over < undone:
                return False
            a, b = self.halves.get(left), self.halves.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:
                undone, left = left, a[1]
            else:
                undone, right = right + 1, b[0]

    def piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        text, n, sizes, pairs, shorter = data.decode("latin-1"), len(data), self.sizes, self.pairs, self.shorter
        longest = self.trie.iter_long  # begun at a position, its first match is the longest token there
        chain = [rank for _, rank in longest(text)]
        before, fits = -1, True
        for token in chain:  # most often the longest tokens fit as they are
            if before >= 0 and not (pairs.get(before << 32 | token) or self.compatible(before, token)):
                fits = False
                break
            before = token
        if fits:
            return chain
        known, at = {}, 0
        for token in chain:
            known[at] = token
            at += sizes[token]
        ids: list[int] = []
        dead: set[int] = set()
        at, before = 0, -1
        token = chain[0]
        while at < n:
            while token >= 0:
                end = at + sizes[token]
                if end not in dead and (before < 0 or pairs.get(before << 32 | token) or self.compatible(before, token)):
                    break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                before, at = token, end
                if at < n:
                    token = known.get(at, -1)
                    if token < 0:
                        token = known[at] = next(longest(text, at))[1]
            else:
                if not ids:
                    raise ValueError(f"the vocabulary cannot spell {data[:40]!r}")
                dead.add(at)
                token = ids.pop()
                before = ids[-1] if ids else -1
                at -= sizes[token]
                token = shorter[token]
        return ids

    def packed(self, piece: str) -> bytes:
        ids = self.piece(piece.encode())
        out = b"".join([self.word[i] for i in ids])
        if len(piece) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_PIECES:
                self.memo.clear()
            self.memo[piece] = out
        return out

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        get, packed = self.run_memo.get, self.packed_run
        return b"".join([get(r) or packed(r) for r in self.runs.findall(text)])

    def packed_run(self, run: str) -> bytes:
        get, packed = self.memo.get, self.packed
        out = b"".join([get(p) or packed(p) for p in self.split.findall(run)])
        if len(run) <= MEMO_CHARS:
            if len(self.run_memo) >= MEMO_PIECES:
                self.run_memo.clear()
            self.run_memo[run] = out
        return out

    def encode(self, text: str) -> list[int]:
        raw = self.encode_packed(text)
        return list(struct.unpack(f"<{len(raw) // 4}I", raw))

    def decode_packed(self, raw: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(raw).cast("I") if _LITTLE else struct.unpack(f"<{len(raw) // 4}I", raw)))


_LITTLE = struct.pack("=I", 1) == struct.pack("<I", 1)
_encoders: dict[str, Encoder] = {}


def encoder(key: str, ranks_file: bytes, pattern: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if key not in _encoders:
        _encoders.clear()
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line.strip())}
        _encoders[key] = Encoder(ranks, pattern)
    return _encoders[key]


def encode(documents: DataFrame, path: str, pattern: str, keep: Iterable[str] = ("doc_id",), form: str = "ids") -> DataFrame:
    """Adds to the columns in keep the tokens of documents.text.

    form 'ids': n_tokens and ids (array<int>). form 'digest': n_tokens, ids_sha256 (of the packed ids) and
    decoded_sha256 (of the bytes that the ids decode to). The vocabulary file, a megabyte, is read by the driver and
    broadcast, so executors need no copy of it.
    """
    keep = list(keep)
    if clash := set(keep) & {"n_tokens", "ids", "ids_sha256", "decoded_sha256"}:
        raise ValueError(f"columns that encode() adds: {sorted(clash)}")
    with open(path, "rb") as f:
        data = f.read()
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    shared = documents.sparkSession.sparkContext.broadcast(data)
    told = [("ids", pa.list_(pa.int32()))] if form == "ids" else [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    kinds = "ids array<int>" if form == "ids" else "ids_sha256 string, decoded_sha256 string"
    fields = [documents.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(key, shared.value, pattern)
        for batch in batches:
            n, raws, out = [], [], {name: [] for name, _ in told}
            for text in batch.column(len(keep)):
                raw = own.encode_packed(text.as_py() or "")
                n.append(len(raw) // 4)
                if form == "ids":
                    raws.append(raw)
                else:
                    out["ids_sha256"].append(hashlib.sha256(raw).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(own.decode_packed(raw)).hexdigest())
            columns = [*batch.columns[: len(keep)], pa.array(n, pa.int64())]
            if form == "ids":
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                columns.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(raws), "<u4").astype(np.int32))))
            else:
                columns += [pa.array(out[name], kind) for name, kind in told]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_tokens", *out])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_tokens long", kinds])
    return documents.select(*[f"`{c}`" for c in keep], F.col("text").alias(unused(keep, "text_"))).mapInArrow(run, schema)
