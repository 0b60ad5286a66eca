"""Packing by best-fit decreasing.

A document's ids are cut into full windows; what is left of it, shorter than a window, is put into the
open window with the least room that still holds it. A segment tree over the remaining capacities finds
that window in log(window) steps. Whole remainders are never cut.

Tokens: white space separates the tokenizer's pieces, so the ids of a text are those of its words in a
row; a bounded memo of words per worker process makes each frequent word be encoded once. Each document
ends with the id ``end_id``.

Scale: only piece rows (ids, lengths, no tokens) shuffle. They are dealt by hash into bins of about
``bin_pieces`` pieces, the number of bins following from the count, and each bin is packed by itself;
at that size the last open windows of a bin are below a thousandth of its tokens. Sequence ids are
gapless: a running sum over the bins gives each its first number.

Edge cases: a null text counts as empty, and an empty text is its one end id. Repeated rows are packed
each. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewright.llm.common import table, written

PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words of ASCII letters and those from U+00C0 to U+00FF, in UTF-8.
_LETTERS = re.compile(rb"[A-Za-z]*(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf][A-Za-z]*)*").fullmatch
#: ASCII punctuation without the characters of special tokens.
_MARKS = b"!\"#$%&'()*+,-./:;=?@[\\]^_`{}~"


def _runs_of_letters(spec: dict) -> bool:
    """Whether a tokenizer is byte-level BPE over lower-cased runs of letters, with a mark at the end of each."""
    normal, pre, model = (spec[k] or {} for k in ("normalizer", "pre_tokenizer", "model"))
    steps = [{k: v for k, v in x.items() if k != "trim_offsets"} for x in pre.get("pretokenizers", [])]
    return (
        normal.get("normalizers") == [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
        and steps
        == [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False},
        ]
        and not spec["post_processor"]
        and (model.get("type"), model.get("end_of_word_suffix"), model.get("dropout")) == ("BPE", "</w>", None)
        and not any(_LETTERS(x["content"].encode()) for x in spec["added_tokens"])
    )


class Encoder:
    """Texts to little-endian 32-bit ids, by way of a memo of white-space separated words; beyond ``memo`` of them the later half goes.

    New words are encoded many at once, with a bar between them: a bar among white space is one token
    of its own, and no word without a bar has it. ASCII letters are lower-cased first, as the tokenizer
    itself does, unless the text may hold one of its special tokens. Full stops, commas and the like
    after a letter or digit are a token run of their own, so a word is encoded without them.

    Most new words are Latin letters only. The normalizer does no more than lower-case these and the
    pre-tokenizer leaves each in one run, so they go to the tokenizer's model alone, with blanks between
    them: the last token of each is one of those that end a word.
    """

    def __init__(self, path: str, memo: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.memo, self.known = Tokenizer.from_file(path), memo, {}
        with open(path, encoding="utf-8") as f:
            self.plain = _runs_of_letters(json.load(f))
        if self.plain:
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.last = np.zeros(1 + max(self.model.get_vocab().values()), bool)
            self.last[[i for x, i in self.model.get_vocab().items() if x.endswith("</w>")]] = True
        bar = self._ids("|")
        if len(bar) != 1 or self._ids("A").tolist() != self._ids("a").tolist():
            raise ValueError("this tokenizer has no single token for a bar, or doesn't lower-case")
        self.bar = bar[0]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, words: list[bytes]) -> None:
        marks = _MARKS if self.plain else b".,!?;:"
        split = {w: head for w in words if not w.isalpha() and len(head := w.rstrip(marks)) < len(w) and (head[-1:].isalnum() or (self.plain and head and _LETTERS(head)))}
        parts = {*split.values(), *(w[len(head) :] for w, head in split.items()), *(w for w in words if w not in split)}
        self._learn([w for w in parts if w not in self.known])
        for w, head in split.items():
            self.known[w] = self.known[head] + self.known[w[len(head) :]]

    def _learn_plain(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 256):
            part = words[at : at + 256]
            text = b" ".join(part).decode().lower().encode().decode("latin-1").replace("\x9f", "\u0141").replace("\xa0", "\u0142").replace("\xad", "\u0143")  # the byte-level alphabet
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            data, begin = ids.tobytes(), 0
            for w, end in zip(part, (4 * np.flatnonzero(self.last[ids]) + 4).tolist(), strict=True):
                self.known[w] = data[begin:end]
                begin = end

    def _learn(self, words: list[bytes]) -> None:
        if self.plain:
            letters = [w for w in words if w.isalpha() or _LETTERS(w)]
            self._learn_plain(letters)
            words = set(words).difference(letters)
        odd = [w for w in words if b"|" in w]
        words = [w for w in words if b"|" not in w]
        for w in odd:
            self.known[w] = self._ids(w.decode(errors="replace")).tobytes()
        for at in range(0, len(words), 256):
            part = words[at : at + 256]
            ids = self._ids(b" | ".join(part).decode(errors="replace"))
            data, ends = ids.tobytes(), np.flatnonzero(ids == self.bar).tolist()
            begin = 0
            for w, end in zip(part, [*ends, len(ids)], strict=True):
                self.known[w] = data[4 * begin : 4 * end]
                begin = end + 1

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        words = [(t if b"<|" in t else t.lower()).split() for t in texts]
        if len(self.known) > self.memo:  # the words met first are the frequent ones
            self.known = dict(itertools.islice(self.known.items(), self.memo // 2))
        self.learn(list(set().union(*words).difference(self.known)))
        return [b"".join(map(self.known.__getitem__, w)) for w in words]


_ENCODERS: dict = {}


def _pieces(path: str, window: int, end_id: int):
    tail = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        encode = _ENCODERS[path]
        for batch in batches:
            out = []
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                for doc, data in zip(part.column("id").to_pylist(), encode([t or b"" for t in part.column("text").to_pylist()]), strict=True):
                    data += tail
                    n = len(data) // 4
                    out += [(doc, s, min(window, n - s), zlib.crc32(data[4 * s : 4 * (s + window)]), n) for s in range(0, n, window)]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    return cut


class OpenWindows:
    """Windows by remaining capacity; a segment tree says which capacities any window has."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, n: int) -> None:
        node = room + self.size
        while node:
            self.tree[node] += n
            node >>= 1

    def put(self, room: int, window: int) -> None:
        self.at[room].append(window)
        self._add(room, 1)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Takes out the window with the least room of at least length: (room, window)."""
        node = length + self.size
        if not self.tree[node]:
            while node & 1 or not self.tree[node + 1]:
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.size:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        room = node - self.size
        window = self.at[room].pop()
        self._add(room, -1)
        return room, window


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(window, offset) for each length, in the order given."""
    rooms, n, placed = OpenWindows(capacity), 0, [(0, 0)] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        room, window = rooms.tightest(lengths[k]) or (capacity, n)
        n = max(n, window + 1)
        placed[k] = (window, capacity - room)
        if room > lengths[k]:
            rooms.put(room - lengths[k], window)
    return placed


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, tokenizer: str | None = None, end_id: int = 2, bin_pieces: int = 8192) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    pieces = written(rows.mapInArrow(_pieces(tokenizer or default_tokenizer(), window, end_id), PIECES), "pieces")
    n_bins = max(1, -(-pieces.count() // bin_pieces))
    pieces = pieces.withColumn("bin", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(n_bins)))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "start", "ids_crc32"], kind="stable")
        placed = best_fit_decreasing(pdf["length"].tolist(), window)
        return pdf.assign(number=[w for w, _ in placed], offset=[o for _, o in placed])

    put = written(pieces.groupBy("bin").applyInPandas(packed, PIECES + ", bin long, number long, offset long"), "packed")
    firsts = put.groupBy("bin").agg((F.max("number") + 1).alias("n"))
    firsts = firsts.select("bin", (F.sum("n").over(Window.orderBy("bin")) - F.col("n")).alias("first"))  # a row per bin
    return put.join(firsts, "bin").select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("number")).alias("sequence_id"), "offset")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def last_stage(spark, docs: DataFrame) -> DataFrame:
    return pack(docs)
