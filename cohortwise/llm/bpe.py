"""Operator 9: byte-level BPE encoding and decoding with forced-boundary splitting.

Merging can never join two neighbouring bytes that stand side by side inside
no token of the vocabulary. Such a pair is a *forced boundary*: a text may be
cut there and the fragments encoded apart, and the ids of the fragments, one
after the other, are the ids of the text. This holds inside one pre-token; at
a cut before a space that follows a non-space it holds for the whole text,
because the pre-tokeniser ends a pre-token there too (its only look-ahead is
at the end of white space, and it looks at nothing on the left).

So a text is cut twice: at every forced boundary before a single space
(*outer* cuts, a plain split, which gives the fragments that repeat all over a
corpus), and inside a fragment at every forced boundary between characters of
one pre-token (*inner* cuts, which keep a word of a million letters cheap).
Each distinct fragment of a batch is encoded once; a bounded table keeps the
ids of fragments met before. Nothing is shuffled.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.llm.common import holds_tables, slices_by_bytes, table, task_of, utf8_parts

#: Fragments after which a Python worker begins a new table of known ids (it keeps the last two).
KEPT_FRAGMENTS = 250_000
#: Longer fragments are not kept: they seldom repeat, and the tables stay small.
LONG = 64
#: Bytes of text encoded at a time (a longer text stands alone).
AT_ONCE = 1 << 22


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = [""] * 256
    for b in shown:
        out[b] = chr(b)
    for k, b in enumerate(x for x in range(256) if not out[x]):
        out[b] = chr(256 + k)
    return out


class ForcedBoundaryBpe:
    """A byte-level BPE vocabulary file with its forced boundaries.

    ``encode`` equals the tokenizers library's encoding without added tokens
    at the ends, ``decode`` its decoding with special tokens kept.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] is not None or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("the file is not a plain byte-level BPE vocabulary")
        import public_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.words = regex.compile(public_tokenizers.PATTERN).findall
        self.chars = byte_characters()
        number = {c: b for b, c in enumerate(self.chars)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_added = regex.compile("|".join(sorted(map(regex.escape, self.added), key=len, reverse=True))) if self.added else None
        size = max([*spec["model"]["vocab"].values(), *self.added.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in spec["model"]["vocab"].items():
            self.bytes_of[i] = bytes(number[c] for c in token)
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.inside = np.zeros((256, 256), bool)
        for token in spec["model"]["vocab"]:
            for a, b in zip(token, token[1:]):
                self.inside[number[a], number[b]] = True
        # a cut before a space is certain if no byte can stand before a space inside a token, save white space
        self.solid = np.array([chr(b) for b in range(0x21, 0x7F) if not self.inside[b, 0x20]])
        self.solid_set = frozenset(self.solid.tolist())
        # the last byte of any character beyond ASCII is 0x80 to 0xBF
        self.wide_solid = not self.inside[0x80:0xC0, 0x20].any()
        # a space and letters, and the marks behind them: two pre-tokens, whatever follows
        self.plain = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]+)?\Z").match
        self.parts: dict[str, bytes] = {}
        self.older_parts: dict[str, bytes] = {}
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _is_cut(self, last: str) -> bool:
        """Whether a space after the character ``last`` begins a new fragment."""
        return last in self.solid_set or (last > "\x7f" and self.wide_solid and not last.isspace())

    def fragments(self, text: str) -> list[str]:
        """``text`` cut at the outer forced boundaries."""
        out: list[str] = []
        add, solid = out.append, self._is_cut
        last = ""  # the last character before the next space
        for k, part in enumerate(text.split(" ")):
            if not k:
                if part:
                    add(part)
            elif last and solid(last):
                add(" " + part)
            elif out:
                out[-1] += " " + part
            else:
                add(" " + part)
            last = part[-1:] or " "
        return out

    def _inner(self, word: str) -> Iterator[str]:
        """The bytes of one pre-token, as vocabulary characters, cut at the inner forced boundaries."""
        raw = word.encode("utf-8")
        shown = "".join(map(self.chars.__getitem__, raw))
        if len(raw) < 3:
            yield shown
            return
        b = np.frombuffer(raw, np.uint8)
        cuts = np.flatnonzero(~self.inside[b[:-1], b[1:]]) + 1
        start = 0
        for cut in cuts.tolist():
            yield shown[start:cut]
            start = cut
        yield shown[start:]

    def _encode_short(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, each at most one fragment or pre-token of ``LONG`` characters."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]

    def _encode_long(self, fragment: str) -> bytes:
        """Ids of a fragment without a cut for long: pre-token by pre-token, long ones cut at forced boundaries."""
        words = self.words(fragment)
        short = [w for w in dict.fromkeys(words) if len(w) <= LONG]
        known = dict(zip(short, self._encode_short(short)))
        out = []
        for word in words:
            if word in known:
                out.append(known[word])
            else:
                out += (np.array([t.id for t in self.model.tokenize(piece)], "<u4").tobytes() for piece in self._inner(word))
        return b"".join(out)

    def _part(self, part: str) -> bytes:
        """Ids of one pre-token without a cut inside."""
        ids = self.parts.get(part)
        if ids is None:
            ids = self.older_parts.get(part)
            if ids is None:
                shown = "".join(map(self.chars.__getitem__, part.encode()))
                ids = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
            self.parts[part] = ids
        return ids

    def _learn(self, fragments: set[str]) -> dict[str, bytes]:
        """The ids of every fragment of the set."""
        kept, older, found, new = self.kept, self.older, {}, []
        for f in fragments:
            ids = kept.get(f)
            if ids is None:
                ids = older.get(f)
                if ids is None:
                    m = self.plain(f) if len(f) <= LONG else None
                    if m is None:
                        new.append(f)
                        continue
                    ids = self._part(m[1]) + (self._part(m[2]) if m[2] else b"")
                kept[f] = ids
            found[f] = ids
        short = [f for f in new if len(f) <= LONG]
        learnt = dict(zip(short, self._encode_short(short)))
        found.update(learnt)
        kept.update(learnt)
        found.update((f, self._encode_long(f)) for f in new if len(f) > LONG)
        if len(kept) > KEPT_FRAGMENTS:  # the fragments met of late stay, older ones go
            self.older, self.kept = kept, {}
        if len(self.parts) > KEPT_FRAGMENTS:
            self.older_parts, self.parts = self.parts, {}
        return found

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of whole texts (null: empty), as little-endian unsigned 32-bit integers."""
        cut: list[list] = []  # fragments, and added tokens as tuples
        for text in texts:
            if not text:
                cut.append([])
            elif self.at_added is None or not self.at_added.search(text):
                cut.append(self.fragments(text))
            else:  # added tokens are found before anything else, and stand alone
                parts, start = [], 0
                for m in self.at_added.finditer(text):
                    parts += [*self.fragments(text[start:m.start()]), (m[0],)]
                    start = m.end()
                cut.append([*parts, *self.fragments(text[start:])])
        alone = {(token,): np.array([i], "<u4").tobytes() for token, i in self.added.items()}
        ids = self._learn(set().union(*cut).difference(alone))
        ids.update(alone)
        return [np.frombuffer(b"".join(map(ids.__getitem__, parts)), "<u4") for parts in cut]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@holds_tables("bpe")
@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> ForcedBoundaryBpe:
    """One table for each Python worker."""
    return ForcedBoundaryBpe(path)


def encode(df: DataFrame, text_col: str, path: str, out_col: str = "ids") -> DataFrame:
    """``df`` with the token ids of ``text_col`` in ``out_col`` (array of bigint).

    A null or empty text has an empty array. Any other column is left as it is;
    a column named ``out_col`` is replaced. An empty table gives an empty table.
    """

    @F.pandas_udf("array<bigint>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        task_of("bpe")
        bpe = tokenizer(path)
        for texts in batches:
            yield pd.Series([bpe.encode(x).astype(np.int64) for x in texts], dtype=object)

    return df.withColumn(out_col, ids(F.col(text_col)))


def decode(df: DataFrame, ids_col: str, path: str, out_col: str = "text") -> DataFrame:
    """``df`` with the text of the ids in ``ids_col`` (null: empty); bytes that are no UTF-8 become U+FFFD."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        task_of("bpe")
        bpe = tokenizer(path)
        for rows in batches:
            yield pd.Series([bpe.decode(np.asarray(x if x is not None else [], np.int64)) for x in rows], dtype=object)

    return df.withColumn(out_col, text(F.col(ids_col)))


def round_trip(df: DataFrame, key_col: str, text_col: str, path: str) -> DataFrame:
    """Encode and decode every text in one pass: key, n_tokens, ids_sha256, decoded_sha256.

    The digests stand for ids and texts that would otherwise travel through the
    plan. Repeated and null keys are kept as they are, one row for each row.
    """
    rows = df.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task_of("bpe")
        bpe = tokenizer(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            column = batch.column(1)
            for i, j in slices_by_bytes(utf8_parts(column)[1], AT_ONCE):
                for ids in bpe.encode_many(column.slice(i, j - i).to_pylist()):
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(digest, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key_col)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, encoded and decoded with the 50k byte-level vocabulary."""
    docs = table(spark, sf_dir, "documents")
    return round_trip(docs, "doc_id", "text", public_path("byte_bpe_50k.json"))


QUERIES = {"op9_bpe": (op9_bpe, None)}
