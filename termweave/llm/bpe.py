"""Byte-level BPE with forced-boundary splitting.

Two bytes that never stand side by side inside any vocabulary token can't end up in one token, so between them every
text may be cut for certain: merges on one side never touch the other. Each pre-token is cut at all such places, the
fragments are merged independently, and their ids are concatenated.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

#: White_Space of Unicode, stated because `\s` of Python has four control characters more.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The pre-tokenizer's pattern (a fixed value of the tokenizer file's kind).
_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: Pre-tokens kept by a worker, in each of two generations; longer ones than CACHE_CHARS are never kept. Bounds its memory.
CACHE_ITEMS, CACHE_CHARS = 120_000, 48
#: Ids up to which a fragment is merged by looking at all neighbours.
SHORT = 48
#: In short fragments a pair of ids and a merge (rank and the id made) are one number each: faster to look up and compare.
_NONE = 1 << 62


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ForcedBoundaryBpe:
    """Encodes and decodes as the tokenizer file says; `path`: a byte-level BPE JSON file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: t for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.single = [vocab.get(bytes([b])) for b in range(256)]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.inside = {pair for t in vocab for pair in zip(t, t[1:])}  # noqa: B905  byte pairs found inside tokens
        self.pattern = regex.compile(_SPLIT)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}  # the generation of the cache before
        self.merged: dict[bytes, list[int]] = {}  # by fragment
        self.packed = {a << 32 | b: rank << 32 | made for (a, b), (rank, made) in self.merges.items()}

    def fragments(self, piece: bytes) -> Iterator[bytes]:
        """The piece, cut at every certain boundary."""
        start, inside = 0, self.inside
        if inside.issuperset(zip(piece, piece[1:])):  # noqa: B905
            yield piece
            return
        for i in [i for i, pair in enumerate(zip(piece, piece[1:]), 1) if pair not in inside]:  # noqa: B905
            yield piece[start:i]
            start = i
        yield piece[start:]

    def merge(self, fragment: bytes) -> list[int]:
        """Ids of one fragment: lowest-ranked pair first, leftmost among equals; O(n log n) for long ones."""
        ids = [self.single[b] for b in fragment]
        n = len(ids)
        if n <= SHORT:
            return self._merge_short(ids)
        left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], right[i] = made, False, right[j]
            if right[j] < n:
                left[right[j]] = i
                if m := self.merges.get((made, ids[right[j]])):
                    heapq.heappush(heap, (m[0], i, made, ids[right[j]], m[1]))
            if (k := left[i]) >= 0 and (m := self.merges.get((ids[k], made))):
                heapq.heappush(heap, (m[0], k, ids[k], made, m[1]))
        return [t for t, ok in zip(ids, alive, strict=True) if ok]

    def _merge_short(self, ids: list[int]) -> list[int]:
        """The same for few ids, without a heap: the merges of all neighbours are kept in a list."""
        get, none = self.packed.get, _NONE
        found = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while found:
            best = min(found)
            if best == none:
                break
            i = found.index(best)
            ids[i] = made = best & 0xFFFFFFFF
            del found[i], ids[i + 1]
            if i < len(found):
                found[i] = get(made << 32 | ids[i + 1], none)
            if i:
                found[i - 1] = get(ids[i - 1] << 32 | made, none)
        return ids

    def piece(self, word: str) -> tuple[int, ...]:
        """Ids of a pre-token."""
        got = self.older.get(word)
        if got is None:
            ids: list[int] = []
            for f in self.fragments(word.encode()):
                part = self.merged.get(f)
                if part is None:
                    part = self.merge(f)
                    if len(f) <= CACHE_CHARS:
                        if len(self.merged) >= CACHE_ITEMS:
                            self.merged.clear()
                        self.merged[f] = part
                ids += part
            got = tuple(ids)
        if len(word) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_ITEMS:
                self.cache, self.older = {}, self.cache
            self.cache[word] = got
        return got

    def encode(self, text: str) -> list[int]:
        """Ids of a text; [] for an empty one. Special tokens' strings become their ids."""
        if self.specials and any(s in text for s in self.special):
            out, end = [], 0
            for m in self.specials.finditer(text):
                out += self._plain(text[end : m.start()])
                out.append(self.special[m.group()])
                end = m.end()
            return out + self._plain(text[end:])
        return self._plain(text)

    def _plain(self, text: str) -> list[int]:
        make, out = self.piece, []
        for w in self.pattern.findall(text):
            out += self.cache.get(w) or make(w)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; special tokens stay, invalid UTF-8 becomes U+FFFD, unknown ids are left out."""
        return self.raw(ids).decode("utf-8", "replace")

    def raw(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of.get(i, b"") for i in ids])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ForcedBoundaryBpe:
    return ForcedBoundaryBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """doc_id, ids array<int>, and decoded string if that is asked for: a row for each row of docs.

    Null text counts as empty: no ids, decoded "". Repeated rows and null ids come out as they went in; an empty table
    gives an empty result; other columns aren't read. path: the vocabulary file's place on the executors.
    """

    def run(batches):
        import pyarrow as pa

        bpe = tokenizer(path or default_path())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                arrays = [part.column(0), pa.array(ids, pa.list_(pa.int32())), *([pa.array([bpe.decode(i) for i in ids], pa.string())] if decode else [])]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "decoded"][: len(arrays)])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", decoded string" * decode)


def token_digests(docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row's encoding and of its decoding (cases as encode_documents)."""

    def run(batches):
        import pyarrow as pa

        bpe = tokenizer(path or default_path())
        of = lambda x: hashlib.sha256(x.encode("utf-8")).hexdigest()
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                n.append(len(ids))
                a.append(of(",".join([bpe.text_of[i] for i in ids])))
                b.append(of(bpe.decode(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe_roundtrip(spark, sf_dir: str) -> DataFrame:
    """Number of ids and digests of ids and decoded text of every document; null and empty texts have no ids and decode to "".

    Byte-pair merges are no SQL; tests/llm compares ids and decoded texts with the tokenizers library.
    """
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
