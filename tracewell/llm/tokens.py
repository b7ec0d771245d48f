"""Token ids of whole texts with a public tokenizer file, and operator 1, the separator scan over flat token files.

:class:`Chunks` encodes the pieces between ASCII white space once each and keeps them. That gives the tokenizer's own ids
because its pre-tokenizer drops white space and never joins across it. The cache holds at most ``CACHE`` pieces a worker.

Operator 1 writes the documents of a table as flat token files: ids as little-endian unsigned 16-bit numbers, each
document followed by the separator, no index. Stored values are the id plus 1, so 0 is free for the separator. The scan
reads such files in blocks of ``block`` tokens, finds the separators of a block in one vectorised comparison, and stitches
documents that cross blocks with a prefix scan over the blocks of a file: the running maximum of separator places and the
running sum of separator counts.

Defined results: null and empty texts are documents of 0 tokens; very long texts are encoded whole and may fill a file of
their own; repeated rows and repeated or null doc_id each keep their own row; tokens after a file's last separator are a
document too (``closed`` false); an empty table has no rows; other columns of the table, whatever their names, take no part.
"""

from __future__ import annotations

import gzip
import io
import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from .common import cut, shared_dir

TOKENIZER = "word_bpe_49k.json"
CACHE = 600_000
BLOCK = 1 << 18
FILE_ROWS, FILE_TOKENS, FILES_PER_TASK = 20_000, 1 << 22, 1_000_000
LINE, SEPARATOR = "\0\0", b"\0\0"
_BIG = sys.byteorder == "big"
# Bytes: control characters and anything beyond ASCII and U+00C0 to U+00FF; an apostrophe before a mark; marks before white space; letters.
_OTHER = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f\xc2\xc4-\xf4]")
_QUOTED = re.compile(rb"'[!-&(-/:-@\[-`{-~]")
_MARKS = re.compile(rb"([!-&(-/:-@\[-`{-~]+)(?=[\x20\n])")
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: How a tokenizer file must normalise and part texts for its pieces between white space to be encoded alone.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def parts_at_white_space(spec: dict) -> bool:
    """Whether a tokenizer file (parsed) drops white space, lower-cases, and never joins across white space."""
    split = {"type": "Split", "pattern": {"Regex": _WORDS}, "behavior": "Removed", "invert": True}
    normal, parts = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    own = normal.get("normalizers") == _NORMAL and parts.get("pretokenizers") == [split, _BYTES]
    return own and not spec.get("post_processor") and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")


class Chunks:
    """White-space separated pieces to their ids, as bytes of little-endian unsigned 16-bit numbers plus ``shift``.

    Texts are encoded whole where the file parts them in another way (:func:`parts_at_white_space`); a vocabulary whose ids
    leave 16 bits is refused.
    """

    def __init__(self, path: str, shift: int = 0, plain: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.shift, self.known = Tokenizer.from_file(path), shift, {}
        self.plain = self.tokenizer.encode_special_tokens = plain
        with open(path, encoding="utf-8") as f:
            self.by_word = parts_at_white_space(json.load(f))
        if max(self.tokenizer.get_vocab().values(), default=0) + shift > 0xFFFF:
            raise ValueError(f"ids of {path} leave 16 bits")
        name = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.names = {c: name(chr(c))[0][0] for c in range(0xC0, 0x100)}

    def _ids(self, ids) -> bytes:
        return np.array(ids, "<u2").tobytes() if _BIG else array("H", ids).tobytes()

    def _split(self, raw: bytes) -> list[bytes]:
        """Pieces of a text, none of which cuts a pre-token. In Latin-1 letters and ASCII the marks at a piece's end part from it."""
        if _OTHER.search(raw) or b"\xc3\x97" in raw or b"\xc3\xb7" in raw or b"'" in raw and _QUOTED.search(raw) or not self.plain and b"<|" in raw:
            return raw.split()
        return _MARKS.sub(rb" \1", raw.lower()).split()

    def _whole(self, texts: list[str], shift: int) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [self._ids([i + shift for i in e.ids]) for e in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._whole(texts, self.shift)
        split = [self._split(t.encode("utf-8", "surrogatepass")) if t else [] for t in texts]
        known, shift, merge = self.known, self.shift, self.tokenizer.model.tokenize
        new = set().union(*split).difference(known)
        fresh, other = {}, []
        for w in new:  # a piece of letters is one pre-token: lower case and byte names, then the tokenizer's model alone
            if w.isalpha():
                fresh[w] = self._ids([t.id + shift for t in merge(w.decode().lower())])
            elif _LETTERS.fullmatch(w):
                fresh[w] = self._ids([t.id + shift for t in merge(w.decode().lower().translate(self.names))])
            else:
                other.append(w)
        fresh |= zip(other, self._whole([w.decode("utf-8", "replace") for w in other], shift), strict=True)
        known.update(fresh)
        get = known.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        if len(known) > CACHE:  # what this call added goes again
            for w in fresh:
                del known[w]
        return out


_chunks: dict[tuple, Chunks] = {}


def chunks(path: str, shift: int = 0, plain: bool = False) -> Chunks:
    """The worker's own encoder, kept between tasks."""
    if (key := (path, shift, plain)) not in _chunks:
        _chunks[key] = Chunks(path, shift, plain)
    return _chunks[key]


def batches(frames: Iterator[pd.DataFrame], rows: int = 512) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for i in range(0, len(frame), rows):
            yield frame.iloc[i : i + rows]


def write_flat(docs: DataFrame, path: str, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """Write ``docs`` as flat token files below ``path``/kind=tokens; returns file, ordinal and doc_id of each row.

    One pass writes both the flat files, which hold tokens and separators only, and beside each of them, below kind=ids,
    the list of its documents: the same task attempt makes both, so no second reading of ``docs`` has to agree with the
    first. A file ends after ``FILE_TOKENS`` tokens or ``FILE_ROWS`` documents.
    """
    at = tokenizer or tokenizer_path()

    def encode(frames):
        own, task, number = chunks(at, shift=1, plain=True), TaskContext.get().partitionId(), 0
        ids, held, size = [], [], 0

        def filled():
            name = task * FILES_PER_TASK + number
            return pd.DataFrame({"kind": ["ids", "tokens"], "file": [name, name], "value": [json.dumps(ids).encode(), SEPARATOR.join(held)]})

        for frame in batches(frames):
            for doc, raw in zip(frame["doc_id"], own.encode(list(frame["text"])), strict=True):
                ids.append(None if doc is None else str(doc))
                held.append(raw)
                size += len(raw)
                if len(held) >= FILE_ROWS or size >= 2 * FILE_TOKENS:
                    yield filled()
                    ids, held, size, number = [], [], 0, number + 1
        if held:
            yield filled()

    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    made = texts.mapInPandas(encode, "kind string, file long, value binary")
    flat = made.select("kind", "file", F.col("value").cast("string").alias("value"))
    flat.write.partitionBy("kind", "file").option("lineSep", LINE).option("compression", "gzip").text(path)
    if docs.isEmpty():  # no file, no folder
        return spark.createDataFrame([], T.StructType([T.StructField("file", T.LongType()), T.StructField("ordinal", T.IntegerType()), T.StructField("doc_id", kind)]))
    listed = spark.read.schema("value string, file long").option("lineSep", LINE).text(f"{path}/kind=ids")
    rows = listed.select("file", F.posexplode(F.from_json("value", "array<string>")).alias("ordinal", "doc_id"))
    return rows.select("file", "ordinal", F.col("doc_id").cast(kind).alias("doc_id"))


def scan_flat(spark: SparkSession, path: str, separator: int = 0, block: int = BLOCK) -> DataFrame:
    """path, ordinal, start, n_tokens, closed: the documents of flat token files, found from their separators alone.

    ``start`` counts tokens from the file's beginning, separators included.
    """

    def blocks(frames):
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with gzip.open(io.BytesIO(content)) as f:
                    number, base = 0, 0
                    while data := f.read(2 * block):
                        tokens = np.frombuffer(data, "<u2")
                        places = np.flatnonzero(tokens == separator) + base
                        yield pd.DataFrame({"path": [name], "block": [number], "base": [base], "n": [len(tokens)], "places": [places.tolist()]})
                        number, base = number + 1, base + len(tokens)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = cut(files.mapInPandas(blocks, "path string, block int, base long, n long, places array<long>"))
    of_file = W.partitionBy("path").orderBy("block")
    before = of_file.rowsBetween(W.unboundedPreceding, -1)
    end = F.element_at(F.expr("nullif(places, array())"), -1)
    stitched = found.select(
        "path",
        "places",
        F.coalesce(F.sum(F.size("places")).over(before), F.lit(0)).alias("_docs"),
        F.coalesce(F.max(end).over(before), F.lit(-1)).alias("_last"),
        F.lead("block").over(of_file).isNull().alias("_end"),
        (F.col("base") + F.col("n")).alias("_to"),
    )
    last = F.coalesce(end, F.col("_last"))
    open_ = F.when(F.col("_end") & (last + 1 < F.col("_to")), F.array(F.col("_to")))
    rest = open_.otherwise(F.array().cast("array<bigint>"))
    each = stitched.select(
        "path",
        "_docs",
        F.size("places").alias("_n"),
        F.posexplode(F.concat("places", rest)).alias("_i", "_at"),
        F.concat(F.array("_last"), "places").alias("_from"),
    )
    start = F.element_at("_from", F.col("_i") + 1) + 1
    return each.select(
        "path",
        (F.col("_docs") + F.col("_i")).alias("ordinal"),
        start.alias("start"),
        (F.col("_at") - start).alias("n_tokens"),
        (F.col("_i") < F.col("_n")).alias("closed"),
    )


def token_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, file, start: flat token files written, scanned, and matched to the rows by file and order.

    A document listed but not found, found but not listed, or without its separator is an error and never a missing row.
    """
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession, "flat-tokens")
    rows = write_flat(docs, path, tokenizer)
    if docs.isEmpty():
        return rows.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), "file", F.lit(0).cast("long").alias("start"))
    found = scan_flat(spark, f"{path}/kind=tokens")
    found = found.select(F.regexp_extract("path", r"/file=(\d+)/", 1).cast("long").alias("file"), "ordinal", "start", "n_tokens", "closed")
    both = rows.withColumn("_row", F.lit(True)).join(found, ["file", "ordinal"], "full_outer")
    sound = F.coalesce(F.col("_row") & F.col("closed"), F.lit(False))
    n = F.when(sound, F.col("n_tokens")).otherwise(F.raise_error(F.lit("token files and documents do not match")).cast("long"))
    return both.select("doc_id", n.alias("n_tokens"), "file", "start")
