"""External entropy: a data source of 16-bit words, and integers made of them.

``register(spark)`` adds the format "entropy" for batch and streaming reads and writes (see ``sink``).
By default it reads recorded values (option ``words``, separated by commas);
with option ``url`` it asks a service that answers with JSON, over TLS as it
comes.  Nothing is asked unless a url is given.  Option ``log`` keeps what a
service gave, so that a block read again is the same; live streams need it.  Option ``type`` is "uint16"
(rows pos, word), "hex16" (pos, block) or "integers" (pos, value: a sequence
between options ``low`` and ``high``, with the caller's ``key``).
"""

from __future__ import annotations

import json
import math
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition
from pyspark.sql.types import StructType

from pointloom.sources.blocklog import BlockLog
from pointloom.sources.sink import EntropyStreamWriter, EntropyWriter

WORD_BITS = 16
#: Bounds of the service (fixed values): kinds of data, values of a block.
KINDS, MOST = ("uint16", "hex16"), 1024


def parse_response(body: str, kind: str, length: int) -> list:
    """Data of a block response, or of a response with a list of sequences; anything unsuccessful raises."""
    answer = json.loads(body)
    if "result" in answer:
        return answer["result"]["random"]["data"][0]
    if not answer.get("success") or answer.get("length") != length:
        raise ValueError("the service gave no full block")
    data = answer["data"]
    return [int(x) for x in data] if kind == "uint16" else [str(x) for x in data]


def fetch(url: str, kind: str = "uint16", length: int = 1, size: int = 1, timeout: float = 10.0) -> list:
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    if not (1 <= length <= MOST and 1 <= size <= MOST):
        raise ValueError(f"length and size must be 1 to {MOST}")
    query = urllib.parse.urlencode({"type": kind, "length": length, "size": size})
    with urllib.request.urlopen(f"{url}?{query}", timeout=timeout) as answer:
        return parse_response(answer.read().decode(), kind, length)


def fetch_integers(url: str, key: str, n: int, low: int, high: int, timeout: float = 10.0) -> list[int]:
    """One sequence of n integers, both ends included, by JSON-RPC."""
    call = {"jsonrpc": "2.0", "method": "generateIntegerSequences", "id": 1, "params": {"apiKey": key, "n": 1, "length": n, "min": low, "max": high, "replacement": True}}
    request = urllib.request.Request(url, json.dumps(call).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return parse_response(answer.read().decode(), "uint16", n)


SCHEMAS = {"uint16": "pos long, word int", "hex16": "pos long, block string", "integers": "pos long, value long"}


class _Words:
    """Blocks of values of a service or of a record."""

    def __init__(self, options: dict) -> None:
        self.url = options.get("url")
        self.kind = options.get("type", "uint16")
        if self.kind not in SCHEMAS:
            raise ValueError(f"type must be one of {tuple(SCHEMAS)}")
        self.block = int(options.get("block", MOST))
        self.size = int(options.get("size", 1))
        self.low, self.high, self.key = int(options.get("low", 0)), int(options.get("high", 1)), options.get("key", "")
        self.recorded = [w.strip() for w in options.get("words", "").split(",") if w.strip()]
        self.log = BlockLog(options["log"]) if options.get("log") else None
        self.blocks = int(options.get("blocks", 1 if self.url else -(-len(self.recorded) // self.block)))

    def ask(self) -> list:
        if self.kind == "integers":
            return fetch_integers(self.url, self.key, self.block, self.low, self.high)
        return fetch(self.url, self.kind, self.block, self.size)

    def read(self, block: int) -> Iterator[tuple]:
        if self.url and self.log:
            values = self.log.values(block, self.ask)
        elif self.url:
            values = self.ask()
        else:
            values = self.recorded[block * self.block : (block + 1) * self.block]
        for i, value in enumerate(values):
            yield block * self.block + i, str(value) if self.kind == "hex16" else int(value)


class _Block(InputPartition):
    pass


class EntropyReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.words = _Words(options)

    def partitions(self) -> list[InputPartition]:
        return [_Block(k) for k in range(max(1, self.words.blocks))]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, int]]:
        return self.words.read(partition.value)


class EntropyStream(DataSourceStreamReader):
    """Blocks by partition; the offset counts blocks.

    A recorded stream ends with its last block. A live one goes on, option ``trigger`` blocks at a time (1), to
    option ``blocks`` where that is given; it needs option ``log``, a folder of its own (see ``blocklog``), by
    which a batch that is read again after a failure or a restart has the same values.
    """

    def __init__(self, options: dict) -> None:
        self.words = _Words(options)
        self.trigger, self.ends = int(options.get("trigger", 1)), "blocks" in options
        if self.trigger < 1:
            raise ValueError("trigger must be positive")
        if self.words.url and not self.words.log:
            raise ValueError("a live stream needs the option log")

    def initialOffset(self) -> dict:
        return {"block": 0}

    def latestOffset(self) -> dict:
        if not self.words.url:
            return {"block": self.words.blocks}
        reached = self.words.log.count() + self.trigger
        return {"block": min(reached, self.words.blocks) if self.ends else reached}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Block(k) for k in range(start["block"], end["block"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.words.read(partition.value)

    def commit(self, end: dict) -> None:
        if self.words.log:
            self.words.log.forget(end["block"])


class EntropySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "entropy"

    def schema(self) -> str:
        return SCHEMAS[_Words(self.options).kind]

    def reader(self, schema: StructType) -> DataSourceReader:
        return EntropyReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return EntropyStream(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return EntropyWriter(self.options, schema, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return EntropyStreamWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EntropySource)


def randint(words: DataFrame, low: int = 0, high: int = 10) -> DataFrame:
    """(pos, value) from words (pos, word): words are packed, numbers of the top step dropped, the rest scaled to [low, high).

    Values are doubles, as a division gives them; a range of 0 gives ``low`` for each number.
    """
    span = high - low
    size = max(1, math.ceil(math.ceil(math.log2(abs(span) + 1)) / WORD_BITS)) if span else 1
    number: Column = F.lit(0).cast("long")
    # consecutive words make a number, the first one the highest
    groups = words.groupBy(F.floor(F.col("pos") / size).alias("pos")).agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("rows")).where(F.size("rows") == size)
    for k in range(size):
        number = F.shiftleft(number, WORD_BITS) + F.get("rows", k)["word"]
    if not span:
        return groups.select("pos", F.lit(float(low)).alias("value"))
    step = (2 ** (size * WORD_BITS) - 1) / span
    return groups.select("pos", number.alias("n")).where(F.col("n") < step * span).select("pos", (F.col("n") / F.lit(step) + low).alias("value"))


def hex_text(blocks: DataFrame) -> DataFrame:
    """One row: hex blocks (pos, block) joined in order, and the bytes they stand for."""
    joined = F.array_join(F.sort_array(F.collect_list(F.struct("pos", "block")))["block"], "")
    return blocks.agg(joined.alias("hex")).withColumn("bytes", F.unhex("hex"))
