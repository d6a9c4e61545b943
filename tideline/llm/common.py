"""What the training-data operators share: tables, shared scratch storage and cached tokenization."""

from __future__ import annotations

import os
import re
import struct
import sys
import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unicode White_Space, as the tokenizers' `\s` has it (fixed values).
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: Distinct words whose ids a worker keeps; words beyond it are encoded at each occurrence.
CACHED_WORDS = 1_900_000


#: Spark's setting to remove a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: `spark.checkpoint.dir`.

    Only where it is unset and the master is local (tests) a temporary folder is used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/tideline-scratch"


class Scratch:
    """Tables written under the shared folder to cut lineage; they outlive any executor.

    What the returned result still reads must stay; intermediate rounds are dropped as they are superseded. Once the
    result is written, `close` removes the rest.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, tag: str, group: int | None = None) -> DataFrame:
        """The table, written and read back; what its plan shuffled is dropped as soon as it is written. group: bytes of a row group, for rows of megabytes,
        whose size is then looked at after every row instead of every hundred, so that neither writer nor reader holds more at a time."""
        path, conf = f"{self.root}/{tag}", self.spark.conf
        before = conf.get(CLEANUP)
        conf.set(CLEANUP, "true")
        try:
            writer = df.write.option("compression", "zstd")
            if group:
                writer = writer.option("parquet.block.size", str(group)).option("parquet.page.size.row.check.min", "1").option("parquet.page.size.row.check.max", "1")
            writer.parquet(path)
        finally:
            conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, tag: str) -> None:
        self._delete(f"{self.root}/{tag}")

    def close(self) -> None:
        """Removes all of it. Results that still read from it must have been written elsewhere."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def free(df: DataFrame, *names: str) -> list[str]:
    """These names, lengthened until the table has no column of that name: for columns that are only passed on."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def named(*columns: str) -> list[Column]:
    """Columns by their whole names, dots and backticks included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def iterated(schema: str):
    """A pandas function over an iterator of batches."""
    return lambda f: F.pandas_udf(f, schema, F.PandasUDFType.SCALAR_ITER)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def tokenizer_file(name: str) -> str:
    """A tokenizer's path: an existing file, or the name of a file of the public_tokenizers package."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(os.path.basename(name))


def byte_signs() -> dict[int, str]:
    """Byte-level tokenizers' signs for bytes: printable Latin-1 bytes stand for themselves, the others for 256, 257, ... in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(hidden)) for b in range(256)}


LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if LITTLE else struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder(dict):
    """Encodes whole texts with the tokenizers library, remembering the ids of words it has met.

    A text is cut only where the tokenizer's own pre-tokenizer always cuts: for the byte-level kind before a word
    together with its leading blank, for the word kind at white space. Joining the words' ids therefore gives the ids
    of the whole text. A new word of Latin letters, or such letters and then signs, goes straight to the library's model; any other
    goes through the whole tokenizer. The tokenizer's added tokens are cut out of a text first, as the library does.
    """

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file(name))
        self.model = self.tokenizer.model
        added = self.tokenizer.get_added_tokens_decoder()
        # Only tokens that are looked for literally, as in the public files, can be cut out; else whole texts go to the library.
        self.literal = not any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values())
        self.added = {t.content: _packed([i]) for i, t in added.items()}
        longest = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(longest)})") if longest else None
        self.signs = byte_signs()
        self.byte_level = self.tokenizer.normalizer is None
        blank = f" ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+"
        self.words = re.compile(blank if self.byte_level else f"[^{WHITE_SPACE}]+").findall
        # Letters up to U+024F in composed form, which lower-casing takes one by one; signs without those that contractions or numbers need.
        letters, ends = "[A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u012f\\u0132-\\u024f]+", "[!-&(-/:-@\\[-^`{-~]*"
        self.plain = re.compile(f"({' ?' if self.byte_level else ''}{letters})({ends})").fullmatch

    def __missing__(self, word: str) -> bytes:
        found = self.plain(word)
        if found:
            letters, ends = found.groups()
            small = letters if self.byte_level else letters.lower()
            if ends:
                raw = self[letters] + self[ends]
            elif small != letters:
                raw = self[small]
            else:
                raw = _packed([t.id for t in self.model.tokenize(self._signs(letters))])
        else:
            raw = _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(self) < CACHED_WORDS:
            self[word] = raw
        return raw

    def _signs(self, part: str) -> str:
        if part.isascii():  # only a leading blank has a sign of its own
            return self.signs[32] + part[1:] if part[0] == " " else part
        return part.encode().decode("latin-1").translate(self.signs)

    def encode(self, texts: Iterable[str | None], end: int) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit values, the end id last; a null text is empty."""
        last, get, words = end.to_bytes(4, "little"), self.__getitem__, self.words
        if self.cut is None:
            return [b"".join(map(get, words(t))) + last if t else last for t in texts]
        if not self.literal:
            return [_packed(self.tokenizer.encode(t or "", add_special_tokens=False).ids) + last for t in texts]
        met = self.cut.search
        return [(self._around(t) if met(t) else b"".join(map(get, words(t)))) + last if t else last for t in texts]

    def _around(self, text: str) -> bytes:
        """The ids of a text that holds added tokens: of them and of the parts between them."""
        parts = self.cut.split(text)
        return b"".join(self.added[p] if i % 2 else b"".join(map(self.__getitem__, self.words(p))) for i, p in enumerate(parts))


@lru_cache(maxsize=4)
def encoder(name: str) -> WordEncoder:
    """One encoder a worker process and tokenizer, kept between tasks."""
    return WordEncoder(name)


def slices(frame, rows: int = 256):
    """A pandas batch in parts of at most so many rows, so that long texts don't add up."""
    for i in range(0, len(frame), rows):
        yield frame.iloc[i : i + rows]
