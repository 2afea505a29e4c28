"""A data source of indexed mzML: planned from the files' own offsets, so that one large file is read by many tasks and a spectrum by its id alone.

    spark.dataSource.register(IndexedMzml)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.read.format("indexed_mzml").load("s3://runs/*.mzML").where("spectrum_id = 'scan=17'")

Options: `task_bytes`, how much of a file a task reads (32 MB); `arrays`, false to leave the arrays null and undecoded.
The setting must be on, as Spark refuses a reader that takes filters without it. Filters on spectrum_id, spectrum_index, ms_level and rt reach the reader: ids and places choose bytes to read, levels and times are
told before arrays are decoded. Columns are those of `spectra.read_mzml`.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from spectraloom.sources import spectra as S
from spectraloom.sources.shared import located

SCHEMA = """file string, spectrum_id string, spectrum_index long, scan_number string, ms_level int, kind string, rt double, precursor_ref string, precursor_mz double, precursor_charge int,
 isolation_low double, isolation_high double, collision_energy double, mz array<double>, intensity array<double>"""
_ARROW = pa.schema(
    [("file", pa.string()), ("spectrum_id", pa.string()), ("spectrum_index", pa.int64()), ("scan_number", pa.string()), ("ms_level", pa.int32()), ("kind", pa.string()), ("rt", pa.float64()), ("precursor_ref", pa.string()),
     ("precursor_mz", pa.float64()), ("precursor_charge", pa.int32()), ("isolation_low", pa.float64()), ("isolation_high", pa.float64()), ("collision_energy", pa.float64()), ("mz", pa.list_(pa.float64())), ("intensity", pa.list_(pa.float64()))]
)
_TAIL, _BATCH = 4096, 200


@dataclass
class Span(InputPartition):
    """Byte ranges of a file, each of whole spectra."""

    path: str
    ranges: tuple[tuple[int, int], ...]

    def __init__(self, path: str, ranges: tuple[tuple[int, int], ...]):
        super().__init__(None)
        self.path, self.ranges = path, ranges


def matching(pattern: str) -> list[str]:
    """The files of a path: itself, those of a folder, or those whose names match its last part."""
    store, path = located(pattern)
    head = pattern[: len(pattern) - len(path)] if pattern.endswith(path) else ""
    folder, _, name = path.rpartition("/")
    if any(c in name for c in "*?["):
        found = [f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.is_file and fnmatch(f.base_name, name)]
    elif store.get_file_info(path).type == fs.FileType.Directory:
        found = [f.path for f in store.get_file_info(fs.FileSelector(path)) if f.is_file and f.base_name.lower().endswith(".mzml")]
    else:
        found = [path]
    return [head + f for f in sorted(found)]


def offsets(path: str) -> tuple[list[str], np.ndarray]:
    """(ids, places) of a file's spectra; the last place is that of the index. Raises for a file without one."""
    store, name = located(path)
    with store.open_input_file(name) as f:
        size = f.size()
        f.seek(max(0, size - _TAIL))
        found = re.search(rb"<indexListOffset>\s*(\d+)", f.read(_TAIL))
        if not found:
            raise ValueError(f"{path} has no index of its spectra")
        at = int(found[1])
        f.seek(at)
        index = f.read(size - at)
    listed = ElementTree.fromstring(index[: index.index(b"</indexList>") + len(b"</indexList>")])
    rows = [(o.get("idRef"), int(o.text)) for o in listed.findall("index[@name='spectrum']/offset")]
    return [i for i, _ in rows], np.array([*(p for _, p in rows), at], np.int64)


def _terms(node: ElementTree.Element | None) -> dict[str, ElementTree.Element]:
    return {p.get("accession"): p for p in node.findall("cvParam")} if node is not None else {}


def _number(terms: dict, accession: str) -> float | None:
    try:
        return float(terms[accession].get("value"))
    except (KeyError, TypeError, ValueError):
        return None


def _decoded(arrays: list[tuple[dict, str]], kind: str) -> list[float] | None:
    for terms, text in arrays:
        if kind in terms:
            raw = base64.b64decode(text or "")
            return np.frombuffer(zlib.decompress(raw) if S.ZLIB in terms and raw else raw, "<f8" if S.FLOAT64 in terms else "<f4").astype(float).tolist()
    return None


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.task_bytes = options["path"], int(options.get("task_bytes", 32 << 20))
        self.arrays = str(options.get("arrays", "true")).lower() != "false"
        self.ids: set | None = None
        self.places: set | None = None
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if column == "spectrum_id" and values is not None:
                self.ids = values if self.ids is None else self.ids & values
            elif column == "spectrum_index" and values is not None:
                self.places = values if self.places is None else self.places & values
            elif column in ("ms_level", "rt") and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in matching(self.path):
            names, at = offsets(path)
            if self.ids is not None or self.places is not None:
                wanted = [i for i, n in enumerate(names) if (self.ids is None or n in self.ids) and (self.places is None or i in self.places)]
                ranges = tuple((int(at[i]), int(at[i + 1])) for i in wanted)
                out += [Span(path, ranges)] if ranges else []
                continue
            first = 0
            while first < len(names):
                upto = max(first + 1, int(np.searchsorted(at, at[first] + self.task_bytes, "right")) - 1)
                out.append(Span(path, ((int(at[first]), int(at[upto])),)))
                first = upto
        return out

    def read(self, partition: Span | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing was planned
            return
        store, name = located(partition.path)
        rows: list[dict] = []
        with store.open_input_file(name) as f:
            for start, end in partition.ranges:
                f.seek(start)
                for element in re.finditer(rb"<spectrum\s.*?</spectrum>", f.read(end - start), re.S):
                    row = self._row(partition.path, element[0])
                    if row is not None:
                        rows.append(row)
                    if len(rows) >= _BATCH:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    def _passes(self, row: dict) -> bool:
        for f in self.tests:
            x = row[f.attribute[0]]
            if x is None or not {EqualTo: x == f.value, GreaterThan: x > f.value, GreaterThanOrEqual: x >= f.value, LessThan: x < f.value, LessThanOrEqual: x <= f.value}[type(f)]:
                return False
        return True

    def _row(self, path: str, text: bytes) -> dict | None:
        """A spectrum, or None for one that a filter turns down; its arrays are decoded last."""
        node = ElementTree.fromstring(text)
        own, scan = _terms(node), node.find("scanList/scan")
        at = _terms(scan)
        rt = _number(at, S.RT)
        row: dict = {"file": path, "spectrum_id": node.get("id"), "spectrum_index": int(node.get("index")) if node.get("index") else None}
        row["ms_level"] = None if _number(own, S.LEVEL) is None else int(_number(own, S.LEVEL))
        row["kind"] = "centroid" if S.CENTROID in own else "profile" if S.PROFILE in own else "unknown"
        row["rt"] = rt / 60.0 if rt is not None and at[S.RT].get("unitName") == "second" else rt
        if not self._passes(row):
            return None
        number = re.search(r"scan=(\d+)", row["spectrum_id"] or "")
        row["scan_number"] = number[1] if number else row["spectrum_id"]
        first = node.find("precursorList/precursor")
        if first is not None:
            window, ion, act = _terms(first.find("isolationWindow")), _terms(first.find("selectedIonList/selectedIon")), _terms(first.find("activation"))
            row["precursor_ref"], row["precursor_mz"], charge = first.get("spectrumRef"), _number(ion, S.SELECTED), _number(ion, S.CHARGE)
            row["precursor_charge"] = None if charge is None else int(charge)
            target = _number(window, S.TARGET) if _number(window, S.TARGET) is not None else row["precursor_mz"]
            if target is not None:
                row["isolation_low"], row["isolation_high"] = target - (_number(window, S.LOWER) or 0.0), target + (_number(window, S.UPPER) or 0.0)
            row["collision_energy"] = _number(act, S.ENERGY)
        if self.arrays:
            arrays = [(_terms(a), (a.findtext("binary") or "").strip()) for a in node.findall("binaryDataArrayList/binaryDataArray")]
            row["mz"], row["intensity"] = _decoded(arrays, S.MZ_ARRAY), _decoded(arrays, S.INTENSITY_ARRAY)
        return row


class IndexedMzml(DataSource):
    @classmethod
    def name(cls) -> str:
        return "indexed_mzml"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))
