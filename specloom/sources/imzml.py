"""imzML: an XML index and a binary file of arrays, read by byte ranges and written one pair of files a task.

The reader is a data source. Its partitions are stretches of index files, cut so that each stands for about the same bytes of index and
arrays; only names and sizes of files are looked at to make them. A task finds the first spectrum that begins in its stretch, parses on
from there as the bytes come, and reads the arrays' ranges, neighbours at once. So a file of any size is spread over tasks without a
shuffle, and no value holds more than a spectrum. Files are opened by Arrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import fnmatch
import hashlib
import re
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPECTRA = "dataset_id string, spectrum_id long, x int, y int, z int, wz double, mzs array<double>, ints array<double>, norm_infile double"
FACTS = "dataset_id string, mode string, kind string, size_x double, size_y double"

#: Names of the terms of the file format.
TERMS = {
    "mz": "MS:1000514", "intensity": "MS:1000515", "x": "IMS:1000050", "y": "IMS:1000051", "z": "IMS:1000052", "offset": "IMS:1000102", "length": "IMS:1000103",
    "norm": "MS:1000285", "continuous": "IMS:1000030", "processed": "IMS:1000031", "profile": "MS:1000128", "centroid": "MS:1000127",
    "size_x": "IMS:1000046", "size_y": "IMS:1000047", "encoded": "IMS:1000104", "uuid": "IMS:1000080", "max_x": "IMS:1000042", "max_y": "IMS:1000043", "sha1": "IMS:1000091",
}
NUMBERS = {"MS:1000521": "<f4", "MS:1000523": "<f8"}

#: Bytes of index and arrays of a partition; of index that are parsed at once; of arrays that are read at once, and between two of them; values of a batch.
SPLIT_BYTES, XML_BYTES, READ_BYTES, GAP_BYTES, BATCH_VALUES = 1 << 26, 1 << 20, 1 << 25, 1 << 16, 1 << 20
#: Where a spectrum begins, and bytes that a match may need.
TAG, TAG_BYTES = re.compile(rb"<spectrum(?=[\s/>])"), 10
#: Spectra that a task writes to one pair of files.
FILE_SPECTRA = 1 << 16


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def matching(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """Index files at a path, in a folder, or that a pattern names; `*` stays within a part of the path."""
    parts = path.rstrip("/").split("/")
    wild = next((i for i, p in enumerate(parts) if re.search(r"[*?\[]", p)), len(parts))
    system, root = store("/".join(parts[:wild]) or "/")
    found = system.get_file_info(root)
    if wild == len(parts) and found.type == fs.FileType.File:
        return system, [found]
    names = parts[wild:] or ["*.[iI][mM][zZ][mM][lL]"]
    inside = system.get_file_info(fs.FileSelector(root, recursive=len(names) > 1))
    fits = lambda f: len(rest := f.path[len(root.rstrip("/")) + 1 :].split("/")) == len(names) and all(fnmatch.fnmatchcase(r, n) for r, n in zip(rest, names, strict=True))
    return system, sorted((f for f in inside if f.type == fs.FileType.File and fits(f)), key=lambda f: f.path)


def arrays_file(system: fs.FileSystem, path: str) -> fs.FileInfo:
    """The file of arrays beside an index."""
    stem = re.sub(r"\.[^./]*$", "", path)
    for info in system.get_file_info([f"{stem}.ibd", f"{stem}.IBD"]):
        if info.type == fs.FileType.File:
            return info
    raise FileNotFoundError(f"{path} has no .ibd file beside it")


def params(node, groups: dict) -> dict[str, str]:
    """Terms of a node and of the groups that it refers to."""
    out = {}
    for ref in node.findall("{*}referenceableParamGroupRef"):
        out |= groups.get(ref.get("ref"), {})
    for p in node.findall("{*}cvParam"):
        out[p.get("accession")] = p.get("value", "")
    return out


class Index:
    """An index file whose head has been read: groups of terms, facts of the file, and a parser that stands at the list of spectra."""

    def __init__(self, system: fs.FileSystem, path: str):
        self.name, self.file = path, system.open_input_file(path)
        self.groups: dict[str, dict[str, str]] = {}
        self.meta: dict[str, str] = {}
        self.parser, self.listing, at = ET.XMLPullParser(("start", "end")), None, 0
        while self.listing is None:
            data = self.file.read_at(XML_BYTES, at)
            if not data:
                raise ValueError(f"{path} has no list of spectra")
            cut = TAG.search(data)
            # what is fed ends before the first spectrum, so that any stretch can follow it; a tag's beginning may be the last bytes
            end = cut.start() if cut else len(data) - TAG_BYTES if len(data) > TAG_BYTES else len(data)
            if not end:
                raise ValueError(f"{path} has a spectrum before its list of spectra")
            self.parser.feed(data[:end])
            at += end
            for event, node in self.parser.read_events():
                kind = node.tag.rpartition("}")[2]
                if event == "start" and kind == "spectrumList":
                    self.listing = node
                elif event == "end" and kind == "referenceableParamGroup":
                    self.groups[node.get("id")] = {p.get("accession"): p.get("value", "") for p in node.findall("{*}cvParam")}
                elif event == "end" and kind in ("fileContent", "scanSettings"):
                    self.meta |= params(node, self.groups)
        self.begin = at

    def spectra(self, start: int, end: int) -> Iterator[tuple[int, ET.Element]]:
        """Number and node of each spectrum whose tag begins at a byte in [start, end)."""
        at, held, number, begun = max(start, self.begin), b"", None, False
        while True:
            data = self.file.read_at(XML_BYTES, at)
            text, base = held + data, at - len(held)
            safe = max(0, len(text) - TAG_BYTES) if data else len(text)  # a tag may go on in the next block
            low = 0
            if not begun:
                found = TAG.search(text)
                if found and found.start() < safe:
                    if base + found.start() >= end:
                        return
                    begun, low, first = True, found.start(), base + found.start()
                elif not data or base > end:
                    return
            stop = next((m.start() for m in TAG.finditer(text, max(low, end - base)) if m.start() < safe), None) if begun else None
            if begun:
                self.parser.feed(text[low : safe if stop is None else stop])
                for event, node in self.parser.read_events():
                    if event == "end" and node.tag.rpartition("}")[2] == "spectrum":
                        if number is None:
                            number = int(node.get("index")) if node.get("index") else self.count(first)
                        yield number, node
                        number += 1
                        self.listing.remove(node)
            if stop is not None or not data:
                return
            held, at = text[safe:], at + len(data)

    def count(self, end: int) -> int:
        """Spectra that begin before a byte, for files that don't number theirs."""
        n, at = 0, self.begin
        while at < end:
            data = self.file.read_at(min(XML_BYTES, end - at) + TAG_BYTES, at)
            n += sum(m.start() < min(XML_BYTES, end - at) for m in TAG.finditer(data))
            at += XML_BYTES
        return n

    def row(self, number: int, node: ET.Element) -> dict:
        """Place, norm and ranges of a spectrum."""
        at, cut = {}, {}
        for scan in node.iterfind(".//{*}scan"):
            at |= params(scan, self.groups)
        for a in node.iterfind(".//{*}binaryDataArray"):
            p = params(a, self.groups)
            kind = next((NUMBERS[t] for t in NUMBERS if t in p), None)
            if kind is None:
                raise ValueError(f"{self.name}: only 32 and 64 bit floating point arrays can be read")
            cut["mz" if TERMS["mz"] in p else "int"] = (int(p[TERMS["offset"]]), int(p[TERMS["length"]]), kind)
        own = params(node, self.groups)
        place = {c: int(at.get(TERMS[c]) or 1) - 1 for c in "xyz"}
        return {"spectrum_id": number, **place, "norm_infile": float(own.get(TERMS["norm"]) or 1.0)} | cut

    def facts(self) -> dict:
        first = next(self.spectra(0, self.file.size()), None)
        kinds = set(self.meta) | {a for g in self.groups.values() for a in g} | set(params(first[1], self.groups) if first else ())
        number = lambda k: float(self.meta[TERMS[k]]) if self.meta.get(TERMS[k]) else None
        either = lambda *names: next((k for k in names if TERMS[k] in kinds), None)
        return {"mode": either("continuous", "processed"), "kind": either("profile", "centroid"), "size_x": number("size_x"), "size_y": number("size_y")}


def ranges(file: pa.NativeFile, wanted: set[tuple[int, int, str]]) -> dict[tuple[int, int, str], np.ndarray]:
    """Arrays of (offset, length, type), those that lie close together read at once."""
    out, order = {}, sorted(wanted)
    size = lambda w: w[1] * int(w[2][-1])
    i = 0
    while i < len(order):
        start, end, j = order[i][0], order[i][0] + size(order[i]), i + 1
        while j < len(order) and order[j][0] <= end + GAP_BYTES and order[j][0] + size(order[j]) - start <= READ_BYTES:
            end = max(end, order[j][0] + size(order[j]))
            j += 1
        data = file.read_at(end - start, start)
        if len(data) < end - start:
            raise ValueError(f"the arrays end at byte {start + len(data)}, before byte {end}")
        for w in order[i:j]:
            out[w] = np.frombuffer(data, w[2], w[1], w[0] - start).astype(float)
        i = j
    return out


def schema_of(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in ddl.split(", "))])


def batch_of(name: str, rows: list[dict], file: pa.NativeFile) -> pa.RecordBatch:
    empty = (0, 0, "<f8")
    got = ranges(file, {r.get(k, empty) for r in rows for k in ("mz", "int")} - {empty})

    def lists(k: str) -> pa.ListArray:
        parts = [got.get(r.get(k, empty), np.zeros(0)) for r in rows]
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts)))

    cols = {"dataset_id": [name] * len(rows), "wz": [float(r["z"]) for r in rows]} | {c: [r[c] for r in rows] for c in ("spectrum_id", "x", "y", "z", "norm_infile")}
    schema = schema_of(SPECTRA)
    return pa.RecordBatch.from_arrays([lists("mz" if f.name == "mzs" else "int") if f.name in ("mzs", "ints") else pa.array(cols[f.name], f.type) for f in schema], schema=schema)


@dataclass
class Stretch(InputPartition):
    """Pieces (path, first byte, byte after the last) of index files."""

    pieces: list[tuple[str, int, int]]


class ImzmlReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.only_facts = options["path"], options.get("facts") == "true"
        self.split = int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[Stretch]:
        system, found = matching(self.path)
        out, room = [], 0
        for info in found:
            both = info.size + (0 if self.only_facts else arrays_file(system, info.path).size)
            n = 1 if self.only_facts else max(1, -(-both // self.split))
            cuts = [info.size * i // n for i in range(n + 1)]
            for a, b in zip(cuts, cuts[1:]):
                if room < both // n or not out:
                    out.append(Stretch([]))
                    room = self.split
                out[-1].pieces.append((info.path, a, b))
                room -= both // n
        return out or [Stretch([])]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        system = store(re.split(r"[*?\[]", self.path)[0].rpartition("/")[0] or "/")[0]
        for path, start, end in partition.pieces:
            index, name = Index(system, path), re.sub(r"\.[^./]*$", "", path)
            if self.only_facts:
                yield pa.RecordBatch.from_pylist([{"dataset_id": name} | index.facts()], schema_of(FACTS))
                continue
            with system.open_input_file(arrays_file(system, path).path) as file:
                rows, values = [], 0
                for number, node in index.spectra(start, end):
                    rows.append(index.row(number, node))
                    values += sum(rows[-1][k][1] for k in ("mz", "int") if k in rows[-1])
                    if values >= BATCH_VALUES:
                        yield batch_of(name, rows, file)
                        rows, values = [], 0
                if rows:
                    yield batch_of(name, rows, file)


class ImzmlSource(DataSource):
    """`spark.read.format("imzml").load(path)`: spectra, or with option facts=true a row of metadata a file. Option splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "imzml"

    def schema(self) -> str:
        return FACTS if self.options.get("facts") == "true" else SPECTRA

    def reader(self, schema) -> ImzmlReader:
        return ImzmlReader(self.options)


def read_imzml(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Spectra and one row of metadata for each .imzML file that `path` (a file, a folder or a pattern) matches.

    A place that is not given is 0, a norm 1. dataset_id is the path without its ending. A spectrum without arrays has empty ones.
    """
    spark.dataSource.register(ImzmlSource)
    load = spark.read.format("imzml").option("splitBytes", split_bytes)
    return load.load(path), load.option("facts", "true").load(path)


def write_imzml(spectra: DataFrame, folder: str, processed: bool, kind: str = "profile", numbers: str = "<f8") -> int:
    """Writes (x, y, z, mzs, ints, norm_infile) as pairs of files in a new folder, and tells how many pairs there are.

    A task writes a pair for every 65536 of its spectra, under hidden names; the driver renames those of the tasks that count. In continuous files
    all spectra have the axis of the first, else it is an error; the files of different tasks may have different axes.
    """
    if processed not in (True, False) or numbers not in NUMBERS.values():
        raise ValueError("numbers are <f4 or <f8")
    base = re.sub(r"^file:/(?!/)", "file:///", folder)
    number_term = next(t for t, n in NUMBERS.items() if n == numbers)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = store(base)
        system.create_dir(root, recursive=True)
        pair = None
        for batch in batches:
            for row in batch.to_pylist():
                if pair is None or len(pair.nodes) >= FILE_SPECTRA:
                    if pair:
                        yield pair.close()
                    pair = Pair(system, root, processed, kind, numbers, number_term)
                pair.add(row)
        if pair:
            yield pair.close()

    names = [r["name"] for r in spectra.select("x", "y", "z", "mzs", "ints", "norm_infile").mapInArrow(write, "name string").collect()]  # a row a pair
    system, root = store(base)
    for name in names:
        for end in ("ibd", "imzML"):  # the index last: without it nobody reads the arrays
            system.move(f"{root}/_{name}.{end}", f"{root}/{name}.{end}")
    return len(names)


class Pair:
    """Two files that are being written."""

    def __init__(self, system, root, processed, kind, numbers, number_term):
        self.system, self.root, self.processed, self.kind, self.numbers, self.number_term = system, root, processed, kind, numbers, number_term
        self.id, self.nodes, self.at, self.axis, self.most = uuid.uuid4(), [], 16, None, [1, 1]
        self.out, self.sha = system.open_output_stream(f"{root}/_{self.id.hex}.ibd"), hashlib.sha1()
        self.put(self.id.bytes)
        self.at = 16

    def put(self, data: bytes) -> int:
        at = self.at
        self.out.write(data)
        self.sha.update(data)
        self.at += len(data)
        return at

    def add(self, row: dict) -> None:
        mzs, ints = (np.asarray(row[c] or [], self.numbers) for c in ("mzs", "ints"))
        if self.processed:
            axis_at = self.put(mzs.tobytes())
        elif self.axis is None:
            self.axis = (mzs, axis_at := self.put(mzs.tobytes()))
        elif not np.array_equal(self.axis[0], mzs):
            raise ValueError("the spectra of a continuous file share one axis")
        else:
            axis_at = self.axis[1]
        at = self.put(ints.tobytes())
        term = lambda k, v: f'<cvParam cvRef="{TERMS[k].split(":")[0]}" accession="{TERMS[k]}" name={quoteattr(k)} value="{v}"/>'
        array = lambda k, o, n: f'<binaryDataArray encodedLength="0"><referenceableParamGroupRef ref="{k}"/>{term("offset", o)}{term("length", n)}{term("encoded", n * int(self.numbers[-1]))}<binary/></binaryDataArray>'
        place = "".join(term(c, (row[c] or 0) + 1) for c in "xyz")
        norm = "" if row["norm_infile"] is None else term("norm", repr(float(row["norm_infile"])))
        i = len(self.nodes)
        self.nodes.append(
            f'<spectrum id="spectrum={i}" index="{i}" defaultArrayLength="0">{norm}<scanList count="1"><scan>{place}</scan></scanList>'
            f'<binaryDataArrayList count="2">{array("mz", axis_at, len(mzs))}{array("intensity", at, len(ints))}</binaryDataArrayList></spectrum>\n'
        )
        self.most = [max(m, (row[c] or 0) + 1) for m, c in zip(self.most, "xy", strict=True)]

    def close(self) -> pa.RecordBatch:
        self.out.close()
        term = lambda k, v="": f'<cvParam cvRef="{TERMS[k].split(":")[0]}" accession="{TERMS[k]}" name={quoteattr(k)} value="{v}"/>'
        group = lambda k: f'<referenceableParamGroup id="{k}">{term(k)}<cvParam cvRef="MS" accession="{self.number_term}" name="float" value=""/></referenceableParamGroup>'
        with self.system.open_output_stream(f"{self.root}/_{self.id.hex}.imzML", compression=None) as out:
            out.write(
                f'<?xml version="1.0" encoding="UTF-8"?>\n<mzML xmlns="http://psi.hupo.org/ms/mzml" version="1.1"><fileDescription><fileContent>{term("processed" if self.processed else "continuous")}{term(self.kind)}'
                f'{term("uuid", self.id)}{term("sha1", self.sha.hexdigest())}</fileContent></fileDescription><referenceableParamGroupList count="2">{group("mz")}{group("intensity")}</referenceableParamGroupList>'
                f'<scanSettingsList count="1"><scanSettings id="s">{term("max_x", self.most[0])}{term("max_y", self.most[1])}</scanSettings></scanSettingsList><run id="r"><spectrumList count="{len(self.nodes)}">\n'.encode()
            )
            for node in self.nodes:
                out.write(node.encode())
            out.write(b"</spectrumList></run></mzML>\n")
        return pa.RecordBatch.from_pylist([{"name": self.id.hex}])
