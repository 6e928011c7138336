"""Dense tapes in columnar shard files, as a Spark data source and a sink.

A shard is a magic of six bytes, the length of a JSON header (u32, little-endian), the header, and one zstd frame for each
column that it lists, in order. Prices are integers: close as differences, the others as offsets from it. The magic is an
option, so that shards of other writers of this layout can be read and written.

Reading, filters on ``t`` and ``symbol`` reach the source: shards that they rule out aren't opened, and a schema of fewer columns
reads those columns' frames alone. Where shards lie is told by index files that a commit leaves beside them; the headers of
shards in no index are read, in parallel.

Writing, tasks stage whole shards in a folder of the job, and the driver gives them their names and writes the index once
all tasks have ended. A task that fails leaves nothing but staged files, which go at commit or abort.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from tapeworks.sources.files import opened

MAGIC = "TWTAPE"
# fixed values: the scales of the layout's integers; columns' names and types are in LAYOUT
PRICE_SCALE, VOLUME_SCALE, TAKER_SCALE = 100, 100_000, 65_535
SCHEMA = "symbol string, t long, open double, high double, low double, close double, vol double, qvol double, ntrades long, takerfrac double, valid boolean"
MANIFEST = "file string, symbol string, t0 long, n long, n_valid long, bytes long, gap_pct double, status string"
NAMES = tuple(part.split()[0] for part in SCHEMA.split(", "))
#: How index files end, of which each commit leaves one; these, and names that begin with a dot or a dash below, are no shards.
INDEX = ".index.json"


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """Multiples of 1 / scale, halves to even."""
    return np.rint(np.asarray(values, float) * scale).astype(np.int64)


@dataclass(frozen=True)
class Codec:
    """A column of the layout as numbers: ``put`` makes them from bars, ``get`` finds the bars' column again."""

    name: str
    kind: str
    column: str

    def numbers(self, bars: dict) -> np.ndarray:
        raise NotImplementedError

    def get(self, numbers: np.ndarray, header: dict, bars: dict) -> np.ndarray:
        raise NotImplementedError

    def put(self, bars: dict) -> bytes:
        numbers, room = self.numbers(bars), np.iinfo(self.kind)
        if len(numbers) and not room.min <= numbers.min() <= numbers.max() <= room.max:
            raise ValueError(f"{self.column} is beyond {self.kind}: its {self.name} would need more bits")
        return numbers.astype(self.kind).tobytes()


class Bits(Codec):
    def numbers(self, bars):
        return np.packbits(np.asarray(bars[self.column], bool))

    def get(self, numbers, header, bars):
        return np.unpackbits(numbers, count=header["n"]).astype(bool)


class Steps(Codec):
    """A price by its differences in hundredths."""

    def numbers(self, bars):
        price = whole(bars[self.column], PRICE_SCALE)
        return np.concatenate([price[:1], price[1:] - price[:-1]])

    def get(self, numbers, header, bars):
        return np.add.accumulate(numbers, dtype=np.int64) / header["price_scale"]


class Offsets(Codec):
    """A price by how far it is from the close."""

    def numbers(self, bars):
        return whole(bars[self.column], PRICE_SCALE) - whole(bars["close"], PRICE_SCALE)

    def get(self, numbers, header, bars):
        return (whole(bars["close"], header["price_scale"]) + numbers) / header["price_scale"]


@dataclass(frozen=True)
class Scaled(Codec):
    scale: int = 1
    field: str = ""

    def numbers(self, bars):
        return whole(bars[self.column], self.scale)

    def get(self, numbers, header, bars):
        return numbers / header[self.field] if self.field else numbers.astype(np.int64) if self.column == "ntrades" else numbers.astype(float)


LAYOUT = (
    Bits("valid", "uint8", "valid"), Steps("dclose", "int32", "close"), *(Offsets(f"{c}_off", "int32", c) for c in ("open", "high", "low")),
    Scaled("vol", "int32", "vol", VOLUME_SCALE, "vol_scale"), Scaled("qvol", "int32", "qvol"), Scaled("ntrades", "int32", "ntrades"), Scaled("takerfrac", "uint16", "takerfrac", TAKER_SCALE, "taker_scale"),
)
CODECS = {c.name: c for c in LAYOUT}


def packed(tape: pd.DataFrame) -> tuple[dict, list[tuple[Codec, bytes]]]:
    """The header of a shard of one symbol's consecutive bars but for what compression adds, and its columns' bytes."""
    bars = tape.sort_values("t")
    t = bars["t"].to_numpy()
    if len(t) and t[-1] - t[0] != len(t) - 1 or len(np.unique(t)) != len(t):
        raise ValueError("a shard's bars must be consecutive")
    columns = bars.to_dict("series")
    raw = [(codec, codec.put(columns)) for codec in LAYOUT]
    digest = hashlib.sha256()
    for _, data in raw:
        digest.update(data)
    head = {"symbol": str(bars["symbol"].iloc[0]), "t0": int(t[0])} if len(t) else {"symbol": "", "t0": 0}
    return head | {"n": len(t), "n_valid": int(bars["valid"].sum()), "price_scale": PRICE_SCALE, "vol_scale": VOLUME_SCALE, "taker_scale": TAKER_SCALE, "digest": digest.hexdigest()}, raw


def encode(tape: pd.DataFrame, magic: str = MAGIC, level: int = 17) -> bytes:
    """The bytes of a shard of one symbol's consecutive bars."""
    return sealed(*packed(tape), magic, level)


def sealed(head: dict, raw: list[tuple[Codec, bytes]], magic: str, level: int) -> bytes:
    frames = [zstandard.compress(data, level) for _, data in raw]
    about = [{"name": codec.name, "dtype": codec.kind, "raw_bytes": len(data), "comp_bytes": len(frame)} for (codec, data), frame in zip(raw, frames)]
    text = json.dumps(head | {"zstd_level": level, "columns": about}).encode()
    return magic.encode() + len(text).to_bytes(4, "little") + text + b"".join(frames)


def read_header(file, magic: str) -> tuple[dict, int]:
    """The header of an open shard, and where its first frame begins."""
    if file.read(len(magic)) != magic.encode():
        raise ValueError("not a shard with this magic")
    size = int.from_bytes(file.read(4), "little")
    return json.loads(file.read(size)), len(magic) + 4 + size


def decode(file, magic: str = MAGIC, wanted: set[str] | None = None) -> pd.DataFrame:
    """The bars of an open shard; frames of columns that aren't wanted are passed over, not read."""
    header, at = read_header(file, magic)
    names = {c.column for c in LAYOUT} if wanted is None else wanted
    reads = names | ({"close"} if names & {"open", "high", "low"} else set())
    bars = {}
    for about in header["columns"]:
        codec = CODECS.get(about["name"])
        if codec and codec.column in reads:
            file.seek(at)
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(file.read(about["comp_bytes"]))
            bars[codec.column] = codec.get(np.frombuffer(raw, about["dtype"]), header, bars)
        at += about["comp_bytes"]
    place = {"symbol": [header.get("symbol", "")] * header["n"], "t": np.arange(header["t0"], header["t0"] + header["n"])}
    return pd.DataFrame(place | {c: v for c, v in bars.items() if c in names})


def listed(fs: pyarrow.fs.FileSystem, root: str) -> tuple[list, list]:
    """The shard files of a folder, and its index files."""
    files = [x for x in fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True)) if x.is_file]
    return [x for x in files if not x.base_name.startswith((".", "_")) and not x.base_name.endswith(INDEX)], [x for x in files if x.base_name.endswith(INDEX)]


def located(fs: pyarrow.fs.FileSystem, root: str, magic: str) -> list[dict]:
    """file, symbol, t0 and n of every shard, from the index where it knows the file by name and size, else from headers."""
    files, indexes = listed(fs, root)
    known: dict = {}
    for x in indexes:
        with fs.open_input_stream(x.path) as file:
            known |= {(row["file"], row["bytes"]): row for row in map(json.loads, file.read().splitlines())}

    def place(x) -> dict:
        if found := known.get((x.base_name, x.size)):
            return found
        with fs.open_input_file(x.path) as file:
            header, _ = read_header(file, magic)
        return {"file": x.base_name, "symbol": header.get("symbol", ""), "t0": header["t0"], "n": header["n"]}

    with ThreadPoolExecutor(16) as pool:
        return sorted(pool.map(place, files), key=lambda row: (row["t0"], row["symbol"], row["file"]))


class ShardPartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ShardSource(DataSource):
    """spark.read.format("tape_shards").schema(columns wanted).load(folder); option magic.

    Written with options magic and level, from rows with a column ``stretch`` too, which names the shard. Rows must come with each
    stretch of a symbol whole in one partition and together, as ``write`` deals them.
    """

    @classmethod
    def name(cls) -> str:
        return "tape_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return ShardReader(self.options, [field.name for field in schema])

    def writer(self, schema, overwrite):
        return ShardWriter(self.options, overwrite)


class ShardReader(DataSourceReader):
    def __init__(self, options, columns: list[str] | None = None):
        self.folder, self.magic = options["path"], options.get("magic", MAGIC)
        self.columns = columns or list(NAMES)
        self.start, self.stop, self.symbols = None, None, None  # of t, half open; None is no bound

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes the bounds that filters set; Spark applies them all once more, which costs little on what is left."""
        for f in filters:
            if getattr(f, "attribute", None) == ("t",):
                values = list(f.value) if isinstance(f, In) else [getattr(f, "value", None)]
                if any(not isinstance(v, int) for v in values):
                    continue
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo, EqualNullSafe, In)):
                    low = min(values) + isinstance(f, GreaterThan)
                    self.start = low if self.start is None else max(self.start, low)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo, EqualNullSafe, In)):
                    high = max(values) + (not isinstance(f, LessThan))
                    self.stop = high if self.stop is None else min(self.stop, high)
            elif getattr(f, "attribute", None) == ("symbol",) and isinstance(f, (EqualTo, EqualNullSafe, In)):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.symbols = values if self.symbols is None else self.symbols & values
        return list(filters)

    def partitions(self):
        """A partition for each shard that the filters leave."""
        fs, root = opened(self.folder)
        meets = lambda x: (self.stop is None or x["t0"] < self.stop) and (self.start is None or x["t0"] + x["n"] > self.start) and (self.symbols is None or x["symbol"] in self.symbols)
        return [ShardPartition(f"{root}/{x['file']}") for x in located(fs, root, self.magic) if meets(x)]

    def read(self, partition):
        if partition is None:  # no shard is left
            return
        fs, _ = opened(self.folder)
        with fs.open_input_file(partition.path) as file:
            rows = decode(file, self.magic, set(self.columns))
        if self.start is not None:
            rows = rows[rows["t"] >= self.start]
        if self.stop is not None:
            rows = rows[rows["t"] < self.stop]
        for i in range(0, len(rows), 100_000):
            yield pa.RecordBatch.from_pandas(rows.iloc[i : i + 100_000][self.columns], preserve_index=False)


class Staged(WriterCommitMessage):
    """The manifest rows of a task's shards; ``staged`` is where a shard waits for its name, if it has to be moved there."""

    def __init__(self, rows: list[dict]):
        self.rows = rows


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.folder, self.magic, self.overwrite = options["path"], options.get("magic", MAGIC), overwrite
        self.level = int(options.get("level", 17))
        self.job = options.get("job") or uuid.uuid4().hex

    def stage(self) -> tuple[pyarrow.fs.FileSystem, str, str]:
        fs, root = opened(self.folder)
        return fs, root, f"{root}/_staged-{self.job}"

    def shard(self, rows: pd.DataFrame, stretch: str) -> dict:
        """Stages a stretch, unless a shard with the same bars is there already."""
        fs, root, stage = self.stage()
        head, raw = packed(rows)
        name = f"{head['symbol']}-{stretch}.shard"
        row = {"file": name, "symbol": head["symbol"], "t0": head["t0"], "n": head["n"], "n_valid": head["n_valid"], "gap_pct": round(100 * (head["n"] - head["n_valid"]) / head["n"], 4), "staged": None}
        there = fs.get_file_info(f"{root}/{name}")
        if there.is_file:
            with fs.open_input_file(there.path) as file:
                was = read_header(file, self.magic)[0] if file.read(len(self.magic)) == self.magic.encode() and file.seek(0) == 0 else {}
            if [was.get(k) for k in ("t0", "n", "digest")] == [head[k] for k in ("t0", "n", "digest")]:
                return row | {"bytes": there.size, "status": "cached"}
        data = sealed(head, raw, self.magic, self.level)
        fs.create_dir(stage, recursive=True)
        row |= {"bytes": len(data), "status": "ok", "staged": f"{stage}/{uuid.uuid4().hex}"}
        with fs.open_output_stream(row["staged"]) as out:
            out.write(data)
        return row

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        """One stretch is held at a time."""
        done: list[dict] = []
        held: list[pd.DataFrame] = []
        at = None
        for batch in iterator:
            rows = batch.to_pandas()
            for key, part in rows.groupby(["symbol", "stretch"], sort=False):
                if key != at and held:
                    done.append(self.shard(pd.concat(held), at[1]))
                    held = []
                at = key
                held.append(part)
        if held:
            done.append(self.shard(pd.concat(held), at[1]))
        return Staged(done)

    def commit(self, messages: list[Staged | None]) -> None:
        fs, root, stage = self.stage()
        rows = [row for message in messages if message for row in message.rows]
        if len({row["file"] for row in rows}) < len(rows):
            self.abort(messages)
            raise ValueError("a stretch of a symbol came from two partitions")
        fs.create_dir(root, recursive=True)
        before, indexes = listed(fs, root)

        def settle(row: dict) -> None:
            if row["staged"]:
                fs.move(row["staged"], f"{root}/{row['file']}")

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(settle, rows))
        with fs.open_output_stream(f"{root}/{self.job}{INDEX}") as out:
            out.write("".join(json.dumps({k: v for k, v in row.items() if k != "staged"}) + "\n" for row in rows).encode())
        if self.overwrite:
            kept = {row["file"] for row in rows}
            for x in [x for x in before if x.base_name not in kept] + indexes:
                fs.delete_file(x.path)
        self.clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self.clear()

    def clear(self) -> None:
        fs, _, stage = self.stage()
        if fs.get_file_info(stage).type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(stage)


def registered(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ShardSource)


def read(spark: SparkSession, folder: str, columns: Iterable[str] = NAMES, **options) -> DataFrame:
    """The bars of a folder of shards; ``where`` on t and symbol decides which are opened, ``columns`` which frames are read."""
    registered(spark)
    wanted = {"symbol", "t", *columns}
    schema = ", ".join(part for part in SCHEMA.split(", ") if part.split()[0] in wanted)
    return spark.read.format("tape_shards").schema(schema).options(**{k: str(v) for k, v in options.items()}).load(folder)


def write(tape: DataFrame, folder: str, width: int = 0, magic: str = MAGIC, level: int = 17, mode: str = "append", by: Column | None = None) -> DataFrame:
    """Writes a shard for each symbol and stretch of ``width`` bars, or of bars with one text ``by``; gives the job's manifest.

    A task holds one stretch.

    A shard that is there with the same bars stays as it is, with status cached; one with others is replaced at commit. Mode
    overwrite takes away what this job didn't write.
    """
    spark, job = tape.sparkSession, uuid.uuid4().hex
    registered(spark)
    stretch = F.lpad(F.floor(F.col("t") / width).cast("string"), 12, "0") if by is None else by
    dealt = tape.select(*NAMES, stretch.alias("stretch")).repartition("symbol", "stretch").sortWithinPartitions("symbol", "stretch", "t")
    dealt.write.format("tape_shards").options(magic=magic, level=level, job=job).mode(mode).save(folder)
    return spark.read.schema(MANIFEST).json(f"{folder.rstrip('/')}/{job}{INDEX}")


def totals(manifest: DataFrame) -> DataFrame:
    """Bytes, shards and shards at hand of a manifest."""
    return manifest.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("shards"), F.count_if(F.col("status").isin("ok", "cached")).alias("at_hand"))
