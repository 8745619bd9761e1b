"""SRC-03 / SRC-04: reading dataset archives.

Two layouts:
* our export (``sinks.archive``): a directory with ``manifest`` (one JSON
  line: version + dataset settings) and ``fuels/ stations/ snapshots/
  prices/`` as gzip JSON-lines parts — every section is read in parallel;
* a single JSON document ``{"version":1, "analysis":{…}, "fuels":[…],
  "stations":[…], "snapshots":[…], "prices":[…]}`` (optionally gzip), in one
  file or in parts that give the document when put together in the order of
  their names (``operators.archive.write_document``). A part ends with a line
  end, which JSON has between tokens only.
  The document is scanned as text split on ``}``: every price object is flat,
  so each fragment ends one object, and the other sections are told apart by
  what the scan has passed (strings, depth, key). No array is materialised
  (flat memory; parts, and the splits of a plain file, are read by many tasks).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pumpwatch.session import ensure_checkpoint_dir
from pumpwatch.sources.tables import spread

# fixed values: the only archive version understood
ARCHIVE_VERSION = 1

ANALYSIS = T.StructType([
    T.StructField("update_frequency", T.IntegerType()),
    T.StructField("data_source_url", T.StringType()),
    T.StructField("active", T.BooleanType()),
    T.StructField("run_automatically", T.BooleanType()),
    T.StructField("max_snapshots", T.IntegerType()),
])
FUEL = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
STATION = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
    T.StructField("city", T.StringType()), T.StructField("region", T.StringType()),
    T.StructField("adress", T.StringType()), T.StructField("longitude", T.DoubleType()),
    T.StructField("latitude", T.DoubleType())])
SNAPSHOT = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("timestamp", T.StringType()),
    T.StructField("status", T.StringType())])
PRICE = T.StructType([
    T.StructField("station_id", T.LongType()), T.StructField("fuel_id", T.LongType()),
    T.StructField("price", T.DoubleType()), T.StructField("snapshot_id", T.LongType())])
MANIFEST = T.StructType([T.StructField("version", T.LongType()),
                         T.StructField("analysis", ANALYSIS)])
#: Sections of a document other than its facts, by key: the type of their entries.
DIMENSIONS = {"fuels": FUEL, "stations": STATION, "snapshots": SNAPSHOT}


class ArchiveVersionError(ValueError):
    pass


def check_version(version) -> None:
    """Missing version means 1; a number other than 1 is refused."""
    if version is not None and int(version) != ARCHIVE_VERSION:
        raise ArchiveVersionError(f"unsupported archive version {version}")


def check_versions(manifest: DataFrame) -> None:
    """Refuse an archive any of whose manifest rows has another version."""
    bad = manifest.where(F.col("version") != ARCHIVE_VERSION).select(F.max("version")).first()[0]
    check_version(bad)


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{root}/manifest")


def read_section(spark: SparkSession, root: str, name: str) -> DataFrame:
    schema = {"fuels": FUEL, "stations": STATION, "snapshots": SNAPSHOT, "prices": PRICE}[name]
    return spark.read.schema(schema).json(f"{root}/{name}")


# ------------------------------------------- sections of one document
# A fragment is the text up to a '}'. In JSON no escape stands before that '}', so what a fragment
# needs to know of the text before it is: in a string or not, depth, last key of the document.
_STRING_END = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*("?)', re.S)
_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*("?)|[\[\]{]', re.S)
_KEY_END = re.compile(r'\s*:\s*([\[{]?)')
_SCALAR = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|[^\s,"\[\]{]+', re.S)
#: A fragment that is one flat object, if it begins outside a string.
_FLAT = r'^[\s,]*\{([^"\[\]{\\]|"([^"\\]|\\.)*")*$'
_SPACE = ", \t\r\n"
_ESCAPE = re.compile(r"\\.", re.S)
_FOUND = "section string, text string, item long, part long"
_FOUND_ARROW = pa.schema([("section", pa.string()), ("text", pa.string()), ("item", pa.int64()), ("part", pa.int64())])


@dataclass
class _Place:
    """What is known of the text before a split (or, while it is read, before a fragment)."""
    in_string: bool = False
    depth: int = 0
    key: tuple[str, str] = ("", "")     # last key of the document's own, and the '[' or '{' of its value
    item: int | None = None             # split in which the entry began that is still open
    number: int = 0                     # of the split, in the order of the document
    tail: bool = False                  # its last fragment is the end of a part, with no '}' behind


def _entry_depth(key: tuple[str, str]) -> int:
    """Depth of the objects under a key that are kept; none is as deep as 0."""
    return 3 if key[1] == "[" and key[0] in DIMENSIONS else 2 if key == ("analysis", "{") else 0


def _name(token: str) -> str:
    try:
        return json.loads(token, strict=False) if "\\" in token else token[1:-1]
    except ValueError:                  # no JSON: a split read as if it began outside a string
        return ""


@dataclass
class _Scan:
    """The fragments of one split, in their order.

    ``keep``: entries are found; else depth is relative to the split's begin and the last key of
    each depth is noted, from which ``_places`` derives where the splits after it begin.
    """
    at: _Place
    keep: bool
    keys: dict[int, tuple[str, str]] = field(default_factory=dict)
    low: int = 0
    quotes: bool = False                # an odd number of them
    pieces: list[str] | None = None     # text of the open entry, as far as this split has it
    found: list[pa.RecordBatch] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)

    def __post_init__(self):
        if self.keep and self.at.item is not None:
            self.pieces = []

    def read(self, texts: pa.Array) -> None:
        """Fragments that end with '}'; runs of flat objects are passed or taken as they are."""
        flat = pc.match_substring_regex(texts, _FLAT).to_numpy(zero_copy_only=False)
        other = np.append(np.flatnonzero(~flat), len(flat))
        i = 0
        while i < len(flat):
            end = int(other[np.searchsorted(other, i)])
            at = self.at
            if end == i or at.in_string or (self.keep and (at.depth != 2 or at.key[1] != "[")):
                self.read_one(texts[i].as_py())
                i += 1
                continue
            if self.keep and at.key[0] in DIMENSIONS:
                run = pc.binary_join_element_wise(pc.utf8_ltrim(texts.slice(i, end - i), _SPACE), "}", "")
                self.take_rows()
                none = pa.nulls(len(run), pa.int64())
                self.found.append(pa.RecordBatch.from_arrays(
                    [pa.array([at.key[0]] * len(run), pa.string()), run, none, none], schema=_FOUND_ARROW))
            i = end

    def read_one(self, text: str, closed: bool = True) -> None:
        at, pos = self.at, 0
        begin = 0 if self.pieces is not None else None      # of the entry's text in this fragment
        self.quotes ^= _ESCAPE.sub("", text).count('"') % 2 == 1
        if at.in_string:
            m = _STRING_END.match(text)
            pos = m.end()
            if m[1]:
                at.in_string = False
                if k := _KEY_END.match(text, pos):          # a name with '}' in it: none that is known
                    self.key("", k, text)
        if not at.in_string:
            for m in _TOKEN.finditer(text, pos):
                c = text[m.start()]
                if c == '"':
                    if not m[1]:
                        at.in_string = True
                    elif k := _KEY_END.match(text, m.end()):
                        self.key(_name(m[0]), k, text)
                elif c == "]":
                    at.depth -= 1
                    self.low = min(self.low, at.depth)
                else:
                    at.depth += 1
                    if self.keep and c == "{" and self.pieces is None and at.depth == _entry_depth(at.key):
                        self.pieces, begin = [], m.start()
        if closed and not at.in_string:
            at.depth -= 1
            self.low = min(self.low, at.depth)
        if begin is not None:
            self.pieces.append(text[begin:] + ("}" if closed else ""))
            if at.depth < _entry_depth(at.key):
                self.take()

    def key(self, name: str, end: re.Match, text: str) -> None:
        at = self.at
        if not self.keep:
            self.keys[at.depth] = (name, end[1])
        elif at.depth == 1:
            at.key = (name, end[1])
            if name == "version" and not end[1] and (v := _SCALAR.match(text, end.end())):
                self.rows.append(("version", f'{{"version": {v[0]}}}', None, None))

    def take(self) -> None:
        """The open entry as one row, or its part of this split if it began or ends in another."""
        cut = self.at.item is not None
        self.rows.append((self.at.key[0], "".join(self.pieces), self.at.item, self.at.number if cut else None))
        self.pieces, self.at.item = None, None

    def take_rows(self) -> None:
        if self.rows:
            self.found.append(pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), _FOUND_ARROW, strict=True)],
                schema=_FOUND_ARROW))
            self.rows = []

    def end(self) -> None:
        if self.keep and self.pieces is not None:
            if self.at.item is None:
                self.at.item = self.at.number
            self.take()


def _scans(batches: Iterator[pa.RecordBatch], place, keep: bool) -> Iterator[tuple[tuple, _Scan, bool]]:
    """One scan for each split of a task's fragments, given out after every batch; the flag: it is through.

    The last fragment of a split is held back, as it may be the end of a part.
    """
    split, scan, held = None, None, None

    def last():
        scan.read_one(held, closed=keep and not scan.at.tail)
        scan.end()
        scan.take_rows()
        return split, scan, True
    for b in batches:
        files, starts = b.column("file").to_numpy(), b.column("start").to_numpy()
        edges = np.flatnonzero((files[1:] != files[:-1]) | (starts[1:] != starts[:-1])) + 1
        for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(files)], strict=True):
            if i == j:
                continue
            here = (int(files[i]), int(starts[i]))
            if here != split:
                if scan is not None:
                    yield last()
                split, scan = here, _Scan(place(here), keep)
            else:
                scan.read_one(held)
            texts = b.column("value").slice(i, j - i)
            held = texts[-1].as_py()
            scan.read(texts.slice(0, len(texts) - 1))
            scan.take_rows()
            yield split, scan, False
    if scan is not None:
        yield last()


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """Fragments in the order of each split, with the file and the start of their split."""
    return spark.read.option("lineSep", "}").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _in_order(path: str) -> list:
    """Sort key of a part: numbers in its name count as numbers."""
    return [(int(x), "") if x.isdigit() else (-1, x) for x in re.split(r"([0-9]+)", path)]


def _summaries(fragments: DataFrame, in_string: frozenset) -> dict[tuple, dict]:
    """What each split does to the place it begins at; a few numbers and keys for each.

    ``in_string``: the splits that begin in a string.
    """
    def each(batches):
        for split, scan, through in _scans(batches, lambda s: _Place(in_string=s in in_string), False):
            if through:
                yield pa.RecordBatch.from_pydict({
                    "file": [split[0]], "start": [split[1]], "quotes": [scan.quotes], "depth": [scan.at.depth],
                    "low": [scan.low], "closes": [not scan.at.in_string], "keys": [json.dumps([*scan.keys.items()])]})
    rows = fragments.mapInArrow(each, "file long, start long, quotes boolean, depth long, low long, closes boolean, "
                                "keys string").collect()
    return {(r.file, r.start): r.asDict() | {"keys": {d: tuple(k) for d, k in json.loads(r["keys"])}} for r in rows}


def _places(fragments: DataFrame, files: dict[int, str]) -> dict[tuple, _Place]:
    """Where each split begins, from the summaries of those before it."""
    strings: frozenset = frozenset()
    while True:
        did = _summaries(fragments, strings)
        order = sorted(did, key=lambda s: (_in_order(files[s[0]]), s[1]))
        odd, found = False, set()
        for s in order:             # quotes are told alike wherever a split begins
            if odd:
                found.add(s)
            odd ^= did[s]["quotes"]
        if found == strings:
            break
        strings = frozenset(found)
    places, at = {}, _Place()
    for n, s in enumerate(order):
        d = did[s]
        tail = n + 1 == len(order) or order[n + 1][0] != s[0]
        places[s] = at = replace(at, number=n, tail=tail)
        closes = d["closes"] and not tail
        low = at.depth + min(d["low"], d["depth"] - closes)
        key = d["keys"].get(1 - at.depth, at.key)
        depth, inside = at.depth + d["depth"] - closes, _entry_depth(key)
        still = at.item if at.item is not None and low >= _entry_depth(at.key) else n
        at = _Place(at.in_string ^ d["quotes"], depth, key, still if inside and depth >= inside else None)
    if at.in_string or at.depth not in (0, 1):      # 1: no line end behind the document's own '}'
        raise ValueError("the document is cut short or isn't JSON")
    return places


def read_document_sections(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Single-document archive: version, analysis and dimension sections.

    One pass tells where each split begins (in a string or not, depth, section), a second one takes
    the entries; an entry that splits cut is put together from its pieces. Null entries of a section
    are skipped. What is kept (no prices) is written to the shared folder once.
    """
    ensure_checkpoint_dir(spark)
    names = spark.read.format("binaryFile").load(path).select("_metadata.file_path").distinct()
    files = {r.file: r.file_path for r in names.withColumn("file", F.xxhash64("file_path")).collect()}
    # both passes see the same splits, also where executors come and go between them
    setting = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, before or str(spark.sparkContext.defaultParallelism))
    try:
        fragments = _fragments(spark, path)
        places = _places(fragments, files)

        def each(batches):
            for _, scan, _ in _scans(batches, lambda s: replace(places[s]), True):
                yield from scan.found
                scan.found = []
        rows = spread(fragments.mapInArrow(each, _FOUND)).checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)
    whole = rows.where(F.col("item").isNull()).select("section", "text")
    pieces = F.array_sort(F.collect_list(F.struct("part", "text")))
    joined = (rows.where(F.col("item").isNotNull()).groupBy("section", "item")
              .agg(F.concat_ws("", F.transform(pieces, lambda p: p["text"])).alias("text")).select("section", "text"))
    every = whole.unionAll(joined)
    head = [F.from_json(F.max(F.when(F.col("section") == name, F.col("text"))), kind).alias(name)
            for name, kind in (("version", MANIFEST), ("analysis", ANALYSIS))]
    manifest = every.where(F.col("section").isin("version", "analysis")).agg(*head)
    entries = lambda name: (every.where(F.col("section") == name)
                            .select(F.from_json("text", DIMENSIONS[name]).alias("x")).select("x.*"))
    return {"manifest": manifest.select("version.version", "analysis")} | {name: entries(name) for name in DIMENSIONS}


def read_price_fragments(spark: SparkSession, path: str) -> DataFrame:
    """Prices of an archive as a text scan split on '}' (bounded memory).

    Keeps the fragments holding a price object, cuts everything before the
    object's '{' and parses it with the price schema. Works on a single
    document and on JSON-lines parts alike. A gzip document is one task; it
    only decompresses and splits — the kept fragments are spread over the
    shuffle partitions before the JSON parse.
    """
    frags = spark.read.option("lineSep", "}").text(path)
    obj = F.concat(F.regexp_extract(F.col("value"), r"(\{[^{]*)$", 1), F.lit("}"))
    kept = spread(frags.where(F.col("value").contains('"snapshot_id"')))
    return kept.select(F.from_json(obj, PRICE).alias("p")).select("p.*")
