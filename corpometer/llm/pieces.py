"""SentencePiece models run by the tokenizers library: the model file is parsed here and rebuilt there."""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from corpometer.llm.common import with_columns_from

# Fixed values of the model file format: piece types, model types and the white space marker.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARK = "▁"
CACHED_WORDS = 150_000
WORDS_AT_ONCE = 5_000
# Ways to cut a text that starts with a marker into units, the finest first: markers and then a run of
# Latin letters and digits or of other characters; markers and all up to the next marker.
LATIN = "0-9A-Za-zÀ-ÖØ-öø-ɏ"
CUTS = (f"{MARK}*[{LATIN}]+|{MARK}*[^{LATIN}{MARK}]+|{MARK}+", f"{MARK}+[^{MARK}]*")


@dataclass
class PieceModel:
    """What a model file says: pieces with score and type, kind of model, and normaliser settings."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    mark_spaces: bool = True


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of one protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = _varint(data, at)
        else:
            if wire == 2:
                size, at = _varint(data, at)
            elif wire in (1, 5):
                size = 8 if wire == 1 else 4
            else:
                raise ValueError(f"wire type {wire} does not occur in model files")
            value, at = data[at : at + size], at + size
        yield number, value


def parse_model(data: bytes) -> PieceModel:
    """Read a serialised model: pieces (1), trainer settings (2) and normaliser settings (3)."""
    model = PieceModel()
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
            model.pieces.append((own[1].decode(), score, own.get(3, NORMAL)))
        elif number == 2:
            own = dict(_fields(value))
            model.kind, model.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
        elif number == 3:
            own = dict(_fields(value))
            model.charsmap = own.get(2, b"")
            model.dummy_prefix, model.trim_spaces, model.mark_spaces = (bool(own.get(n, 1)) for n in (3, 4, 5))
    if model.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are read")
    return model


def build_tokenizer(model: PieceModel, cache: int = 10_000) -> Tokenizer:
    """The tokenizer that gives the model's ids.

    A unigram model keeps its scores. A BPE model's merges are all splits of a piece into two pieces,
    best score first; of equal scores, as runs of spaces have, the longer piece first, which extends a
    run from the left as the model does.
    """
    unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), None)
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=unknown, byte_fallback=model.byte_fallback)
    else:
        ids = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        scores = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER_DEFINED)}
        splits = [
            (-s, -len(p), p, ids[p[:k]], (p[:k], p[k:]))
            for p, s in scores.items()
            for k in range(1, len(p))
            if p[:k] in scores and p[k:] in scores
        ]
        token = None if unknown is None else model.pieces[unknown][0]
        core = models.BPE(
            vocab=ids, merges=[x[-1] for x in sorted(splits)], unk_token=token, fuse_unk=True,
            byte_fallback=model.byte_fallback, cache_capacity=cache,
        )
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.trim_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.mark_spaces else " "))
    if model.mark_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if _cut_at_marks(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(CUTS[-1]), "isolated")
    back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence(back + [decoders.Strip(" ", 1, 0)] * model.dummy_prefix)
    return tokenizer


def _cut_at_marks(model: PieceModel) -> bool:
    return model.mark_spaces and not any(MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED))


def unit_pattern(model: PieceModel) -> str | None:
    """The finest way of cutting that no piece crosses, so that units can be encoded apart; None if none is."""
    if not model.mark_spaces:
        return None
    long = [p for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED) and len(p) > 1]
    for cut in CUTS[:-1]:
        if all(map(re.compile(cut).fullmatch, long)):
            return cut
    return CUTS[-1] if _cut_at_marks(model) else None


class Encoder:
    """Encodes and decodes batches of texts with the ids of one model.

    Where words can be encoded apart (see :func:`unit_pattern`) and the normaliser is the identity, each
    word is encoded once and its ids are kept, up to ``cached`` words. New words go to the tokenizer in
    batches, which it works on with ``threads`` threads. Any other model encodes whole texts.
    """

    def __init__(self, model: PieceModel, threads: int = 2, cached: int = CACHED_WORDS):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        self.model, self.cached = model, cached
        pattern = unit_pattern(model)
        self.by_word = pattern is not None and not model.charsmap and not model.trim_spaces and model.dummy_prefix
        self.known: dict[str, bytes] = {}
        self.units = re.compile(pattern or "")
        if self.by_word:
            # Words are handed over with their marker, so the copy for words does not normalise.
            self.words = build_tokenizer(model, cache=0)
            self.words.normalizer = normalizers.Sequence([])
            self.words.pre_tokenizer = pre_tokenizers.Sequence([])
        self.bytes_of = [
            bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in model.pieces
        ]

    @cached_property
    def tokenizer(self) -> Tokenizer:
        return build_tokenizer(self.model)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text as int32; a null or empty text has none."""
        texts = [t or "" for t in texts]
        if not self.by_word:
            return [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        split = [self.units.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        seen = set().union(*split)
        if len(self.known) + len(seen) > self.cached:
            self.known.clear()
        new = [w for w in seen if w not in self.known]
        for low in range(0, len(new), WORDS_AT_ONCE):
            some = new[low : low + WORDS_AT_ONCE]
            for word, e in zip(some, self.words.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[word] = array("i", e.ids).tobytes()
        ids = self.known.__getitem__
        return [np.frombuffer(b"".join(map(ids, ws)), dtype=np.int32) for ws in split]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts by the library's decoder."""
        return self.tokenizer.decode_batch([list(map(int, x)) for x in ids], skip_special_tokens=False)

    def spelled(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for, less the marker put before a text: the fast check of a round trip."""
        data = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return data[1:] if self.model.dummy_prefix and data[:1] == b" " else data


def load_model(path: str) -> PieceModel:
    """The model of a file on the driver; a few MB by its nature, it travels to the tasks with the function."""
    return parse_model(Path(path).read_bytes())


def encoded(docs: DataFrame, model: PieceModel, text: str = "text", threads: int = 2) -> DataFrame:
    """``docs`` with ``ids`` (array of int), ``n_tokens`` and ``round_trip``.

    Whole texts are encoded as the model's own library encodes them, without start or end ids. Null and
    empty texts have no ids. ``round_trip`` says whether the ids spell the text again; a text that holds
    the white space marker itself does not, as the marker stands for a space, and a text that its
    model's normaliser changes does not. Rows are judged one by one; columns of these names are replaced.
    """

    def score(texts: list[str | None]) -> list[pa.Array]:
        if not encoders:
            encoders.append(Encoder(model, threads))
        found = encoders[0].encode(texts)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        flat = pa.array(np.concatenate([*found, np.zeros(0, np.int32)]), pa.int32())
        same = [encoders[0].spelled(x) == (t or "").encode("utf-8", "surrogatepass") for x, t in zip(found, texts, strict=True)]
        return [pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(sizes), pa.array(same)]

    encoders: list[Encoder] = []
    return with_columns_from(docs, text, "ids array<int>, n_tokens bigint, round_trip boolean", score, chars=1_000_000)
