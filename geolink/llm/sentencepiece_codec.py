"""Operator 6: SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps a score-ordered agenda of adjacent symbol pairs: the pair whose
piece scores highest (leftmost among equals) merges, and the pairs it forms with
its new neighbours join the agenda.  What stays outside the vocabulary falls back
to bytes.

A text first falls apart into segments at places that no piece spans: before a
space mark that follows another character, and around characters that occur in
no longer piece.  The vocabulary is tested for both when it is loaded.  Segments
repeat a lot, so a worker remembers the ids of the first ``MEMO`` it meets.
Every segment that is new to a worker is checked against the sentencepiece
library, one library call per Arrow batch; where they differ the library's ids
count, and ``n_corrected`` says how many segments of a text that met.  Decoding
is the library's ``decode``.

Defined results
    null or empty text  begin and end ids only, decoded to the empty text
    very long texts     whole; one text at a time is in memory besides its batch
    repeated rows       encoded alike
    empty table         no rows
    extra columns       those named in ``keep`` are carried along
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolink.llm.common import give_back, keeping, lean, table

MARK = "▁"
#: Segments that a worker remembers at once.
MEMO = 300_000
#: Texts encoded together.
TEXTS = 256
#: Segments of up to so many characters merge many at a time, longer ones singly.
WIDE = 32
NONE = np.int64(1 << 40)
VOCABULARY = "piece_bpe_32k.model"


class Codec:
    """A loaded vocabulary with its agenda encoder and the library's processor."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        every = range(lib.get_piece_size())
        plain = [i for i in every if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        self.score = {lib.id_to_piece(i): lib.get_score(i) for i in plain}
        self.byte = {int(lib.id_to_piece(i)[1:-1], 16): i for i in every if lib.is_byte(i)}
        self.begin, self.end = lib.bos_id(), lib.eos_id()
        if len(self.byte) != 256:
            raise ValueError("the vocabulary has no byte fallback")
        if any(MARK in piece.lstrip(MARK) for piece in self.ids):
            raise ValueError("a piece spans a word boundary")
        spanned = {c for piece in self.ids if len(piece) > 1 for c in piece}
        alone = "".join(c for c in "\n\t\r" if c not in spanned)
        self.segments = re.compile(f"[{alone}]|{MARK}*[^{MARK}{alone}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+").findall
        if "\n" not in alone or lib.normalize("a  b\nａ ") != f"{MARK}a{MARK}{MARK}b\nａ{MARK}":
            raise ValueError("the vocabulary's normaliser isn't the identity with a leading space mark")
        self.memo: dict[str, bytes] = {}
        #: Segments on which the library was followed.
        self.corrected: set[str] = set()
        self._tables()

    def _tables(self) -> None:
        """Arrays for merging many segments at once: symbols by code point, pairs by rank."""
        singles = sorted({c for piece in self.ids for c in piece})
        symbol = {piece: i for i, piece in enumerate(dict.fromkeys([*self.ids, *singles]))}
        self.width = len(symbol)
        self.id_of = np.array([self.ids.get(piece, 0) for piece in symbol], dtype="<u4")
        self.symbol_of = np.full(max(map(ord, singles)) + 2, -1, dtype=np.int32)
        for c in singles:
            if c in self.ids:
                self.symbol_of[ord(c)] = symbol[c]
        order = {piece: r for r, piece in enumerate(sorted(self.ids, key=lambda q: -self.score[q]))}
        pairs = sorted(
            (symbol[piece[:k]] * self.width + symbol[piece[k:]], order[piece], symbol[piece])
            for piece in self.ids for k in range(1, len(piece)) if piece[:k] in symbol and piece[k:] in symbol
        )
        self.pair_key, self.pair_rank, self.pair_symbol = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))

    def agenda(self, segment: str) -> list[int]:
        """Ids of one segment by score-ordered merging."""
        symbols = list(segment)
        n = len(symbols)
        if n > 1 and segment in self.ids and n == 2:
            return [self.ids[segment]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        score, agenda = self.score, []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in score:
                agenda.append((-score[pair], i, i + 1, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, pair = heapq.heappop(agenda)
            # stale unless both symbols still stand next to each other and spell the pair
            if symbols[i] is None or symbols[j] is None or after[i] != j or len(symbols[i]) + len(symbols[j]) != len(pair):
                continue
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                wider = pair + symbols[k]
                if wider in score:
                    heapq.heappush(agenda, (-score[wider], i, k, wider))
            h = before[i]
            if h >= 0:
                wider = symbols[h] + pair
                if wider in score:
                    heapq.heappush(agenda, (-score[wider], h, i, wider))
        out = []
        for s in symbols:
            if s is not None:
                out += [self.ids[s]] if s in self.ids else [self.byte[b] for b in s.encode()]
        return out

    def check(self, segments: list[str]) -> None:
        """Compare segments' remembered ids with the library's, all in one call."""
        text = "\n" + "".join(s.replace(MARK, " ") if s[0] == MARK else "\n" + s for s in segments)
        line = np.uint32(self.byte[10]).tobytes()
        own = np.uint32(self.ids[MARK]).tobytes() + line + b"".join(self.memo[s] if s[0] == MARK else line + self.memo[s] for s in segments)
        if np.asarray(self.library.encode(text), dtype=np.uint32).tobytes() == own:
            return
        if len(segments) > 1:  # find the ones that differ by halves
            self.check(segments[: len(segments) // 2])
            self.check(segments[len(segments) // 2 :])
            return
        segment = segments[0]
        ids = self.library.encode(text)[2 if segment[0] == MARK else 3 :]  # after the mark and the line feeds
        self.memo[segment] = np.asarray(ids, dtype="<u4").tobytes()
        self.corrected.add(segment)

    def agendas(self, segments: list[str]) -> None:
        """Remember the ids of many segments: the same agenda, one merge of each segment a round."""
        by_length: dict[int, list[str]] = {}
        for s in segments:
            by_length.setdefault(len(s) if len(s) <= WIDE else 0, []).append(s)
        for length, group in by_length.items():
            if length:
                codes = np.frombuffer("".join(group).encode("utf-32-le"), dtype="<u4").reshape(len(group), length)
                symbols = self.symbol_of[np.minimum(codes, len(self.symbol_of) - 1)]
                known = (symbols >= 0).all(axis=1)
                self._merge_rows([s for s, k in zip(group, known, strict=True) if k], symbols[known])
                group = [s for s, k in zip(group, known, strict=True) if not k]
            for s in group:  # with characters outside the vocabulary, or very long
                self.memo[s] = np.asarray(self.agenda(s), dtype="<u4").tobytes()

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of symbol pairs; the rank is NONE where they form no piece."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        hit = self.pair_key[at] == key
        return np.where(hit, self.pair_rank[at], NONE), self.pair_symbol[at]

    def _merge_rows(self, group: list[str], symbols: np.ndarray) -> None:
        rows = np.arange(len(group))
        rank = self._rank(symbols[:, :-1], symbols[:, 1:])[0] if symbols.shape[1] > 1 else np.zeros((len(group), 0), np.int64)
        while len(rows):
            width = symbols.shape[1]
            best = rank.argmin(axis=1) if width > 1 else np.zeros(len(rows), np.int64)
            going = rank[np.arange(len(rows)), best] < NONE if width > 1 else np.zeros(len(rows), bool)
            ended = self.id_of[symbols[~going]]
            for row, one in zip(rows[~going], ended, strict=True):
                self.memo[group[row]] = one.tobytes()
            rows, symbols, rank, best = rows[going], symbols[going], rank[going], best[going]
            if not len(rows):
                break
            every = np.arange(len(rows))
            merged = self._rank(symbols[every, best], symbols[every, best + 1])[1]
            column = np.arange(width - 1)
            symbols = np.take_along_axis(symbols, column + (column > best[:, None]), axis=1)
            symbols[every, best] = merged
            if width > 2:
                column = column[:-1]
                rank = np.take_along_axis(rank, column + (column >= best[:, None]), axis=1)
                for side, inside in ((best - 1, best > 0), (best, best < width - 2)):
                    r, c = every[inside], side[inside]
                    rank[r, c] = self._rank(symbols[r, c], symbols[r, c + 1])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers, begin and end included."""
        memo, find = self.memo, self.segments
        parts = [find(MARK + text.replace(" ", MARK)) if text else [] for text in texts]
        new = list(set().union(*parts).difference(memo))
        self.agendas(new)
        # a run of marks alone would join the next segment's marks in the checked text
        tails = [s for s in new if not s.strip(MARK)]
        if rest := [s for s in new if s.strip(MARK)]:
            self.check(rest)
        for s in tails:
            if len(s) > 1 and (ids := self.library.encode(" " * (len(s) - 1))) != np.frombuffer(memo[s], "<u4").tolist():
                memo[s] = np.asarray(ids, dtype="<u4").tobytes()
                self.corrected.add(s)
        begin, end = np.uint32(self.begin).tobytes(), np.uint32(self.end).tobytes()
        out = [b"".join([begin, *map(memo.__getitem__, p), end]) for p in parts]
        self.met = [sum(s in self.corrected for s in p) if self.corrected else 0 for p in parts]
        if len(memo) > MEMO:
            for s in new:
                del memo[s]
        return out

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, dtype="<u4").tolist())


@lru_cache(maxsize=2)
def _codec(model_file: str) -> Codec:
    return Codec(model_file)


def tokenizer_path(name: str = VOCABULARY) -> str:
    """A public vocabulary's place on the machine that asks (driver or executor)."""
    import public_tokenizers

    return public_tokenizers.path(name)


@keeping
def encode(docs: DataFrame, *, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode and decode every text: ``doc_id, n_tokens, ids_sha256, decoded_sha256, n_corrected`` and ``keep``.

    With ``ids`` also ``ids array<int>`` and ``decoded``.  ``vocabulary`` is a name
    for ``public_tokenizers.path`` or a path that every executor can open.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"), *keep)
    fields = [f for f in rows.schema.fields if f.name != "_text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_corrected bigint", *(["ids array<int>, decoded string"] if ids else [])])

    def run(batches):
        codec = _codec(vocabulary if "/" in vocabulary else tokenizer_path(vocabulary))
        for batch in batches:
            texts = batch.column("_text").fill_null("")
            # a slice's results leave before the next slice's are made
            for at in range(0, len(texts), TEXTS):
                part = batch.slice(at, TEXTS)
                out: dict[str, list] = {"n": [], "i": [], "d": [], "ids": [], "text": []}
                for one in codec.encode(texts[at : at + TEXTS].to_pylist()):
                    text = codec.decode(one)
                    out["n"].append(len(one) // 4)
                    out["i"].append(hashlib.sha256(one).hexdigest())
                    out["d"].append(hashlib.sha256(text.encode()).hexdigest())
                    if ids:
                        out["ids"].append(np.frombuffer(one, dtype="<i4"))
                        out["text"].append(text)
                made = [pa.array(out["n"], pa.int64()), pa.array(out["i"], pa.string()), pa.array(out["d"], pa.string()), pa.array(codec.met, pa.int64())]
                names = ["n_tokens", "ids_sha256", "decoded_sha256", "n_corrected"]
                if ids:
                    made += [pa.array(out["ids"], pa.list_(pa.int32())), pa.array(out["text"], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), *made], names=[*(f.name for f in fields), *names])
                del part, out, made
                give_back()

    return rows.mapInArrow(lean(run), schema)


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), ids=False)
