"""Alignment of two tokenizers' tokens over the bytes of a text, and corpus-wide counts of linked token ids.

Tokenizer A (byte-level BPE, ids in merge order) encodes a space and the text; B (sentencepiece with byte fallback) encodes
the text and adds that space itself. Each side's token indices are repeated over their bytes, so every byte has an owner on
both sides. Runs of equal owner pairs are the overlaps of tokens; where both owners change at once is a cut. Cuts bound
the groups, and the tokens that end at a cut are linked.

No token of either side holds a space behind something else (A's pattern; B's vocabulary is checked when it is loaded), so
both sides end a token before such a space whatever surrounds it. Texts are cut there into stretches of about a million
characters, which are encoded and aligned by themselves; memory follows the longest stretch without such a space.

Counts of linked id pairs are summed in tasks and then shuffled. The pairs that hold at least one link in HEAVY_PAIRS are
at most that many; they, or all pairs if they are so few, travel to the tasks as arrays. The rest have no hot pair, and
join by a shuffle. The highest count of each B id is one row an id of the vocabulary.

Defined results: a text that is null or empty, or whose tokens don't join to the very bytes of space and text on both
sides, has no tokens and no groups; rows never depend on each other but for the corpus-wide counts, in which repeated rows
count each; null and repeated ids stay as they are; an empty table gives an empty one. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.scratch import keep
from strandline.llm.tokens import Planes

STRETCH = 1 << 20
#: Characters of stretches that are aligned together.
SLICE = 1 << 19
HEAVY_PAIRS = 1_000_000
#: Distinct pairs that one task sums before it hands them on.
SUM_PAIRS = 2_000_000
_LONG_SPACE = re.compile(r"\s{1000}")
_CUT = re.compile(r"(?<=\S) ")


class Tokenizers:
    """Both tokenizers, with each id's bytes, byte length and decimal spelling."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        of_char = {c: b for b, c in byte_chars().items()}
        a_bytes = {i: bytes(of_char[c] for c in piece) for piece, i in model["vocab"].items() if all(c in of_char for c in piece)}
        if any(model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] != 256 + i for i, m in enumerate(model["merges"])):
            raise ValueError("the ids of tokenizer A are not in the order of its merges")
        ranks = {piece: i for i, piece in a_bytes.items() if i < 256 + len(model["merges"])}
        self._fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._slow = Tokenizer.from_file(a_path)
        self._slow.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self._b.id_to_piece(i) for i in range(self._b.vocab_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("tokenizer B has pieces that hold a space behind something else")
        self.a_bytes = [a_bytes.get(i, b"") for i in range(max(a_bytes) + 1)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        # entry 2 * id inside a group, 2 * id + 1 at its end
        self.a_names, self.b_names = (np.array([f"{i}{c}" for i in range(len(side)) for c in ("," + end)], object) for side, end in ((self.a_bytes, "|"), (self.b_bytes, ";")))

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        # the fast library's pattern overflows its stack on very long runs of white space
        return [self._slow.encode(t, add_special_tokens=False).ids if _LONG_SPACE.search(t) else self._fast.encode_ordinary(t) for t in texts]

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        return self._b.encode(texts, num_threads=1)


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in A's vocabulary: itself, or one after U+0100 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def stretches(text: str, size: int) -> list[str]:
    """``text`` in parts of ``size`` characters or a little more; all but the first begin with a space that follows something else."""
    out, at = [], 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if not cut or cut.end() == len(text):  # B gives a lone space no token
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def align(a_ids: np.ndarray, b_ids: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(byte ends of cuts, their A tokens, their B tokens, overlaps) of two tokenisations of the same bytes; sizes are per token."""
    a_owner, b_owner = np.repeat(np.arange(len(a_ids), dtype=np.int32), a_sizes), np.repeat(np.arange(len(b_ids), dtype=np.int32), b_sizes)
    a_changes, b_changes = (np.append(o[1:] != o[:-1], True) if len(o) else np.zeros(0, bool) for o in (a_owner, b_owner))
    overlaps = np.flatnonzero(a_changes | b_changes)
    cuts = overlaps[a_changes[overlaps] & b_changes[overlaps]]
    return cuts + 1, a_owner[cuts], b_owner[cuts], len(overlaps)


class _Document:
    """What the stretches of one text add up to."""

    def __init__(self, detail: bool) -> None:
        self.sums, self.sha, self.pairs, self.whole = np.zeros(4, np.int64), hashlib.sha256(), [], True
        self.groups = [] if detail else None

    def add(self, sums: tuple[int, ...], text: str, pairs: np.ndarray) -> None:
        if self.sums[0]:
            self.sha.update(b";")
        self.sums += sums
        self.sha.update(text.encode())
        self.pairs.append(pairs)

    def row(self) -> tuple:
        """(n_a, n_b, n_groups, n_overlaps, groups_sha256, pairs, times, groups)"""
        if not self.whole or not self.sums[0]:
            return (0, 0, 0, 0, "", b"", b"", [])
        pairs, times = np.unique(np.concatenate(self.pairs), return_counts=True)
        return (*map(int, self.sums), self.sha.hexdigest(), Planes.pack(pairs, delta=True) + len(pairs).to_bytes(4, "little"), Planes.pack(times, 4), self.groups or [])


def _slice(tok: Tokenizers, parts: list[tuple[_Document, bool, str]]) -> None:
    """Align (document, begins the text, stretch) and add the results to their documents."""
    wanted = [(" " + t if first else t) for _, first, t in parts]
    a_all, b_all = tok.encode_a(wanted), tok.encode_b([w[1:] for w in wanted])
    good = []
    for (doc, _, _), text, a, b in zip(parts, wanted, a_all, b_all):
        raw = text.encode()
        doc.whole = doc.whole and b"".join(map(tok.a_bytes.__getitem__, a)) == raw == b"".join(map(tok.b_bytes.__getitem__, b))
        if doc.whole:
            good.append((doc, np.array(a, np.int64), np.array(b, np.int64)))
    if not good:
        return
    a_ids, b_ids = np.concatenate([a for _, a, _ in good]), np.concatenate([b for _, _, b in good])
    a_size, b_size = tok.a_sizes[a_ids], tok.b_sizes[b_ids]
    ends, a_last, b_last, _ = align(a_ids, b_ids, a_size, b_size)
    pairs = a_ids[a_last] << 32 | b_ids[b_last]
    # spellings in order of groups: a group's A tokens follow all B tokens of earlier groups
    a_ends, b_ends = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
    a_ends[a_last], b_ends[b_last] = 1, 1
    a_group, b_group = np.cumsum(a_ends) - a_ends, np.cumsum(b_ends) - b_ends
    a_upto, b_upto = a_last.astype(np.int64) + 1, np.append(0, b_last.astype(np.int64) + 1)
    names = np.empty(len(a_ids) + len(b_ids), object)
    names[np.arange(len(a_ids)) + b_upto[a_group]] = tok.a_names[2 * a_ids + a_ends]
    names[np.arange(len(b_ids)) + a_upto[b_group]] = tok.b_names[2 * b_ids + b_ends]
    spelled = names.tolist()
    n_a, n_b = np.cumsum([0, *[len(a) for _, a, _ in good]]), np.cumsum([0, *[len(b) for _, _, b in good]])
    for i, (doc, a, b) in enumerate(good):
        lo, hi = np.searchsorted(a_last, (n_a[i], n_a[i + 1]))
        text = "".join(spelled[n_a[i] + n_b[i] : n_a[i + 1] + n_b[i + 1]])[:-1]
        doc.add((len(a), len(b), hi - lo, len(a) + len(b) - (hi - lo)), text, pairs[lo:hi])
        if doc.groups is not None:
            before = doc.groups[-1]["end"] if doc.groups else 0
            start = ends[lo - 1] if lo else 0
            doc.groups += [{"end": int(before + e - start), "a": x, "b": y} for e, x, y in _groups(ends[lo:hi], a, b, a_last[lo:hi] - n_a[i], b_last[lo:hi] - n_b[i])]


def _groups(ends: np.ndarray, a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> Iterator[tuple[int, list[int], list[int]]]:
    i = j = 0
    for end, x, y in zip(ends, a_last, b_last):
        yield end, a[i : x + 1].tolist(), b[j : y + 1].tolist()
        i, j = x + 1, y + 1


_GROUPS = pa.list_(pa.struct([("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
_FIELDS = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_overlaps", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary()), ("groups", _GROUPS)]


def _encode(a_path: str, b_path: str, detail: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizers(a_path, b_path)
        for batch in batches:
            docs, parts, held = [], [], 0
            for text in batch.column(1):
                doc = _Document(detail)
                docs.append(doc)
                for i, part in enumerate(stretches(text.as_py() or "", STRETCH)):
                    if part and doc.whole:
                        parts.append((doc, i == 0, part))
                        held += len(part)
                    if held >= SLICE:
                        _slice(tok, parts)
                        parts, held = [], 0
            if parts:
                _slice(tok, parts)
            columns = list(zip(*(d.row() for d in docs))) or [()] * len(_FIELDS)
            fields = _FIELDS if detail else _FIELDS[:-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, (_, t) in zip(columns, fields)]], names=["doc_id", *[n for n, _ in fields]])

    return run


def encoded(docs: DataFrame, a_path: str, b_path: str, detail: bool = False) -> DataFrame:
    """One row a document: counts, the hash of its groups, and its distinct linked pairs (packed) with their times.

    With ``detail``, ``groups`` has each group's byte end in space+text and the ids of both sides.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_overlaps long, groups_sha256 string, pairs binary, times binary" + (", groups array<struct<end: long, a: array<int>, b: array<int>>>" if detail else "")
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_encode(a_path, b_path, detail), schema)


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    at = [batch.schema.get_field_index(c) for c in ("n_groups", "pairs", "times")]
    for n, pairs, times in zip(*(batch.column(i) for i in at)):
        count = n.as_py()
        yield _unpack(pairs.as_py(), times.as_py()) if count else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _unpack(pairs: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    count = int.from_bytes(pairs[-4:], "little")
    return Planes.unpack(pairs[:-4], count, delta=True).view(np.int64), Planes.unpack(times, count, 4).view(np.int64)


def _pair_sums(limit: int):
    """(pair, n) summed over a task's documents; handed on whenever ``limit`` distinct ones are held."""

    def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        pairs, place = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
        return pairs, np.bincount(place, np.concatenate([t for _, t in held]), len(pairs)).astype(np.int64)

    def rows(pairs: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(pairs), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[i : i + 100_000]), pa.array(n[i : i + 100_000])], names=["pair", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for found in _unpacked(batch):
                held.append(found)
                size += len(found[0])
                if size >= 2 * limit:
                    held = [summed(held)]
                    size = len(held[0][0])
                    if size >= limit:
                        yield from rows(*held[0])
                        held, size = [], 0
        if held:
            yield from rows(*summed(held))

    return run


def _look_up(known):
    """Adds the documents' links that are a B id's best, and their counts, as far as the known pairs tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = known.value
        for batch in batches:
            n_best, count_sum = [], []
            for mine, times in _unpacked(batch):
                if len(pairs) and len(mine):
                    at = np.minimum(np.searchsorted(pairs, mine), len(pairs) - 1)
                    times = times * (pairs[at] == mine)
                    n_best.append(int(times[best[at]].sum()))
                    count_sum.append(int((times * counts[at]).sum()))
                else:
                    n_best.append(0)
                    count_sum.append(0)
            names = [c for c in batch.schema.names if c not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], names=[*names, "n_best", "count_sum"])

    return run


def _unknown(known):
    """(rid, pair, times) of the documents' pairs that are not known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = known.value[0]
        for batch in batches:
            for rid, (mine, times) in zip(batch.column(batch.schema.get_field_index("rid")).to_pylist(), _unpacked(batch)):
                if len(pairs) and len(mine):
                    rest = pairs[np.minimum(np.searchsorted(pairs, mine), len(pairs) - 1)] != mine
                    mine, times = mine[rest], times[rest]
                if len(mine):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), rid)), pa.array(mine), pa.array(times)], names=["rid", "pair", "times"])

    return run


def pair_counts(done: DataFrame) -> DataFrame:
    """(pair, n, best): links of each pair (A id * 2**32 + B id) over all documents, and whether its B id has no higher count."""
    counts = keep(done.mapInArrow(_pair_sums(SUM_PAIRS), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "alignment-counts")
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b_id")
    highest = counts.groupBy(b_id).agg(F.max("n").alias("highest"))  # one row an id of B's vocabulary
    return counts.withColumn("b_id", b_id).join(F.broadcast(highest), "b_id").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def digest(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    spark = docs.sparkSession
    done = keep(encoded(docs, a_path, b_path).withColumn("rid", F.monotonically_increasing_id()), "alignment-documents")
    counts = keep(pair_counts(done), "alignment-pairs")
    total = counts.agg(F.count("*").alias("pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("links")).first()
    few = total["pairs"] <= HEAVY_PAIRS
    heavy = F.lit(True) if few else F.col("n") * HEAVY_PAIRS >= total["links"]
    table = counts.filter(heavy).toArrow().sort_by("pair")
    known = spark.sparkContext.broadcast(tuple(np.asarray(table.column(c)) for c in ("pair", "n", "best")))
    plain = done.drop("pairs", "times")
    out = done.mapInArrow(_look_up(known), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema) + ", n_best long, count_sum long")
    if not few:
        rest = done.mapInArrow(_unknown(known), "rid long, pair long, times long").join(counts.filter(~heavy), "pair")
        rest = rest.groupBy("rid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
        added = [(F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("n_best", "more_best"), ("count_sum", "more_sum"))]
        out = out.join(rest, "rid", "left").select(*plain.columns, *added)
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256", "n_overlaps")
