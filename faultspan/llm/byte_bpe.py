"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file gives each token's bytes and its rank. The library wants characters and merges, so every byte stands
as one printable character (the byte table of byte-level BPE), and a token's merge is the pair of lower-ranked
parts that the ranks themselves lead to. Decoding turns ids back into bytes with the reversed table; a character
whose bytes lie in several tokens comes out whole from the joined bytes, and in `pieces` the tokens that share it
all have the offsets of that character.

Null texts count as empty; an empty text has no ids and the digests of no bytes. Repeated rows, ties and other
columns pass through as they are; an output name that the input already has is taken by the output.
"""

from __future__ import annotations

import base64
import codecs
import functools
import hashlib
import os
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Texts of one call to the tokenizer hold so many bytes at most, unless one text is longer.
CALL_BYTES = 1 << 20
#: Distinct matches that a worker remembers at most.
MEMO = 1 << 18
#: Letters and numbers assigned after Unicode 16, which tiktoken's tables don't count as such.
LATER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959),
    (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F),
    (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96),
    (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F),
    (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]


def byte_table() -> list[str]:
    """The character that stands for each byte: itself where it is printable in Latin-1, else one from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def parts(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What the merges below a token's own rank make of its bytes; two parts for every token that merges can reach."""
    own, seq = ranks[token], [token[i : i + 1] for i in range(len(token))]
    while len(seq) > 2:
        best, at = own, -1
        for i in range(len(seq) - 1):
            rank = ranks.get(seq[i] + seq[i + 1], own)
            if rank < best:
                best, at = rank, i
        if at < 0:
            break
        seq[at : at + 2] = [seq[at] + seq[at + 1]]
    return seq


class Memo(dict):
    """Of each match, its ids in decimal; and the bytes that these ids decode to."""

    def __init__(self, codec: Codec) -> None:
        self.codec, self.decoded = codec, {}

    def __missing__(self, piece: str) -> str:
        ids = [t.id for t in self.codec.tokens(piece)]
        self.decoded[piece] = self.codec.decode_bytes(ids)
        self[piece] = decimal = ",".join(map(str, ids))
        return decimal


class Codec:
    """One vocabulary: encode texts, decode ids to bytes, text or pieces.

    The pattern's matches are merged separately, so each distinct match goes through the tokenizer's model once and is
    then remembered, up to MEMO matches at a time. The regex module finds the matches; where the given pattern says
    \\s it says White_Space, as its own \\s has four control characters more, and texts with characters of LATER
    are split with these left out of the letters and numbers.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        from tokenizers import Tokenizer, decoders, models, pre_tokenizers

        ranks = read_ranks(path)
        table = byte_table()
        shown = lambda b: "".join(table[x] for x in b)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        merges = [tuple(map(shown, p)) for t in sorted(ranks, key=ranks.get) if len(t) > 1 and len(p := parts(t, ranks)) == 2]
        self.tokenizer = Tokenizer(models.BPE({shown(t): r for t, r in ranks.items()}, merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.tokenizer.decoder = decoders.ByteLevel()
        self.model, self.shown = self.tokenizer.model, dict(enumerate(table))
        pattern = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        later = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in LATER)
        self.plain, self.later = regex.compile(pattern).findall, regex.compile(f"[{later}]").search
        self.older = regex.compile("|".join(x.replace(r"\p{L}", rf"[\p{{L}}--[{later}]]").replace(r"\p{N}", rf"[\p{{N}}--[{later}]]") for x in pattern.split("|")), regex.V1).findall
        self.beyond = re.compile(f"[{chr(LATER[0][0])}-{chr(sys.maxunicode)}]").search
        self.memo = Memo(self)

    def split(self, text: str) -> list[str]:
        return self.older(text) if not text.isascii() and self.beyond(text) and self.later(text) else self.plain(text)

    def tokens(self, piece: str) -> list:
        """One match through the model, its bytes shown as characters."""
        return self.model.tokenize(piece.encode().decode("latin-1").translate(self.shown))

    def decimal(self, text: str) -> tuple[str, bytes]:
        """The text's ids in decimal, joined by commas, and the bytes that they decode to."""
        pieces, memo = self.split(text), self.memo
        if len(memo) > MEMO:
            self.memo = memo = Memo(self)
        return ",".join(map(memo.__getitem__, pieces)), b"".join(map(memo.decoded.__getitem__, pieces))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[int(i) for i in d.split(",")] if (d := self.decimal(t)[0]) else [] for t in texts]

    def encode_offsets(self, texts: list[str]) -> list[tuple[list[int], list[tuple[int, int]]]]:
        """Ids with the characters (start, end) that each covers; tokens that split a character share its offsets."""
        out = []
        for text in texts:
            at, ids, spans = 0, [], []
            for piece in self.split(text):
                # of each byte, the number of characters that begin up to it
                seen = [n for n, c in enumerate(piece, at + 1) for _ in c.encode()]
                first = 0
                for t in self.tokens(piece):
                    last = first + len(self.bytes_of[t.id])
                    ids.append(t.id)
                    spans.append((seen[first] - 1, seen[last - 1]))
                    first = last
                at += len(piece)
            out.append((ids, spans))
        return out

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded bytes."""
        sha, out = hashlib.sha256, []
        for text in texts:
            decimal, decoded = self.decimal(text)
            out.append((decimal.count(",") + bool(decimal), sha(decimal.encode()).hexdigest(), sha(decoded).hexdigest()))
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """The text; where the ids begin or end inside a character, or make no UTF-8, U+FFFD stands for what is cut."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def pieces(self, ids: list[int]) -> list[str]:
        """The text that each token completes: a split character belongs to the token with its last byte."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        return [reader.decode(self.bytes_of[i]) for i in ids]


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Codec(path, pattern)


def _calls(texts: pa.Array) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        t = t.as_py() or ""
        if held and size + len(t) > CALL_BYTES:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def _keep(df: DataFrame, new: str) -> list[str]:
    taken = {x.split()[0].lower() for x in new.split(", ")}
    return [c for c in df.columns if c.lower() not in taken]


def _schema(spark: SparkSession, df: DataFrame, keep: list[str], new: str):
    from pyspark.sql.types import StructType

    return StructType([df.schema[c] for c in keep] + StructType.fromDDL(new).fields)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """Add `ids array<int>`, and with offsets `starts` and `ends array<int>` (characters of the text)."""
    new = "ids array<int>, starts array<int>, ends array<int>" if offsets else "ids array<int>"
    keep = _keep(df, new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path, pattern)
        for batch in batches:
            at = 0
            for call in _calls(batch.column("__text")):
                cols = [batch.column(c).slice(at, len(call)) for c in keep]
                if offsets:
                    got = use.encode_offsets(call)
                    cols += [pa.array([g[0] for g in got], pa.list_(pa.int32())), *(pa.array([[o[k] for o in g[1]] for g in got], pa.list_(pa.int32())) for k in (0, 1))]
                else:
                    cols.append(pa.array(use.encode(call), pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, [*keep, *(x.split()[0] for x in new.split(", "))])
                at += len(call)

    return df.select(*(df[c] for c in keep), df[text].alias("__text")).mapInArrow(run, _schema(df.sparkSession, df, keep, new))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Add `decoded binary` (the exact bytes) and `decoded_text string` (U+FFFD for cut characters); null ids are empty."""
    new = "decoded binary, decoded_text string"
    keep = _keep(df, new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                got = [use.decode_bytes(i.as_py() or []) for i in part.column("__ids")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(got, pa.binary()), pa.array([g.decode("utf-8", "replace") for g in got], pa.string())], [*keep, "decoded", "decoded_text"])

    return df.select(*(df[c] for c in keep), df[ids].alias("__ids")).mapInArrow(run, _schema(df.sparkSession, df, keep, new))


def digests(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Encode and decode in one pass and add `n_tokens long, ids_sha256 string, decoded_sha256 string`.

    ids_sha256 is over the decimal ids joined by commas, decoded_sha256 over the decoded bytes, both lower-case hex.
    """
    new = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    keep = _keep(df, new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path, pattern)
        for batch in batches:
            at = 0
            for call in _calls(batch.column("__text")):
                got = use.digests(call)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(call)) for c in keep), *(pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string())))], [*keep, "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(call)

    return df.select(*(df[c] for c in keep), df[text].alias("__text")).mapInArrow(run, _schema(df.sparkSession, df, keep, new))
