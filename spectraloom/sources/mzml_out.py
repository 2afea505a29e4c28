"""A writer of mzML: spectra as `spectra.read_mzml` gives them, one file a run."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from itertools import groupby
from xml.sax.saxutils import quoteattr

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spectraloom.sources import spectra as S
from spectraloom.sources.shared import replaced

#: Names of the terms written.
NAMES = {
    S.LEVEL: "ms level", S.CENTROID: "centroid spectrum", S.PROFILE: "profile spectrum", S.RT: "scan start time", S.TARGET: "isolation window target m/z", S.LOWER: "isolation window lower offset",
    S.UPPER: "isolation window upper offset", S.SELECTED: "selected ion m/z", S.CHARGE: "charge state", S.ENERGY: "collision energy", S.MZ_ARRAY: "m/z array", S.INTENSITY_ARRAY: "intensity array",
    S.FLOAT64: "64-bit float", S.ZLIB: "zlib compression", "MS:1000579": "MS1 spectrum", "MS:1000580": "MSn spectrum", "MS:1000285": "total ion current",
    "MS:1000130": "positive scan", "MS:1000129": "negative scan",
}
UNITS = {S.RT: "minute", S.TARGET: "m/z", S.LOWER: "m/z", S.UPPER: "m/z", S.SELECTED: "m/z"}
HEAD = """<?xml version="1.0" encoding="utf-8"?>
<indexedmzML xmlns="http://psi.hupo.org/ms/mzml">
<mzML xmlns="http://psi.hupo.org/ms/mzml" version="1.1.0">
<cvList count="1"><cv id="MS" fullName="Proteomics Standards Initiative Mass Spectrometry Ontology" URI="https://raw.githubusercontent.com/HUPO-PSI/psi-ms-CV/master/psi-ms.obo"/></cvList>
<fileDescription><fileContent><cvParam cvRef="MS" accession="MS:1000579" name="MS1 spectrum" value=""/></fileContent></fileDescription>
<softwareList count="1"><software id="spectraloom" version="1"><cvParam cvRef="MS" accession="MS:1000799" name="custom unreleased software tool" value=""/></software></softwareList>
<instrumentConfigurationList count="1"><instrumentConfiguration id="IC1"/></instrumentConfigurationList>
<dataProcessingList count="1"><dataProcessing id="DP1"><processingMethod order="0" softwareRef="spectraloom"><cvParam cvRef="MS" accession="MS:1000544" name="Conversion to mzML" value=""/></processingMethod></dataProcessing></dataProcessingList>
"""


def _term(accession: str, value="") -> str:
    unit = f' unitName="{UNITS[accession]}"' if accession in UNITS else ""
    return f'<cvParam cvRef="MS" accession="{accession}" name="{NAMES[accession]}" value="{value if isinstance(value, str) else repr(value)}"{unit}/>'


def _array(values: np.ndarray, kind: str) -> str:
    text = base64.b64encode(zlib.compress(values.astype("<f8").tobytes())).decode()
    return f'<binaryDataArray encodedLength="{len(text)}">{_term(S.FLOAT64)}{_term(S.ZLIB)}{_term(kind)}<binary>{text}</binary></binaryDataArray>'


def _known(v) -> bool:
    return v is not None and v == v


def _spectrum(r, place: int) -> str:
    mz, y = (np.zeros(0) if v is None else np.asarray(v, float) for v in (r.mz, r.intensity))
    if mz.size != y.size:
        raise ValueError(f"arrays differ in length: {r.spectrum_id}")
    terms = [] if not _known(r.ms_level) else [_term("MS:1000579" if r.ms_level == 1 else "MS:1000580"), _term(S.LEVEL, int(r.ms_level))]
    terms += [_term({"centroid": S.CENTROID, "profile": S.PROFILE}[r.kind])] if r.kind in ("centroid", "profile") else []
    terms += [_term({"positive": "MS:1000130", "negative": "MS:1000129"}[r.polarity])] if getattr(r, "polarity", None) in ("positive", "negative") else []
    terms += [_term("MS:1000285", float(y.sum()))]
    scan = f'<scanList count="1"><scan>{_term(S.RT, float(r.rt)) if _known(r.rt) else ""}</scan></scanList>'
    before = ""
    if any(_known(v) for v in (r.precursor_mz, r.isolation_low, r.isolation_high)):
        low, high = r.isolation_low, r.isolation_high
        window = ""
        if _known(low) and _known(high):
            target = float(r.precursor_mz) if _known(r.precursor_mz) and low <= r.precursor_mz <= high else (low + high) / 2
            window = f"<isolationWindow>{_term(S.TARGET, target)}{_term(S.LOWER, float(target - low))}{_term(S.UPPER, float(high - target))}</isolationWindow>"
        ion = [_term(S.SELECTED, float(r.precursor_mz))] if _known(r.precursor_mz) else []
        ion += [_term(S.CHARGE, int(r.precursor_charge))] if _known(r.precursor_charge) else []
        chosen = f'<selectedIonList count="1"><selectedIon>{"".join(ion)}</selectedIon></selectedIonList>' if ion else ""
        energy = _term(S.ENERGY, float(r.collision_energy)) if _known(r.collision_energy) else ""
        ref = f" spectrumRef={quoteattr(r.precursor_ref)}" if r.precursor_ref else ""
        before = f'<precursorList count="1"><precursor{ref}>{window}{chosen}<activation>{energy}</activation></precursor></precursorList>'
    arrays = f'<binaryDataArrayList count="2">{_array(mz, S.MZ_ARRAY)}{_array(y, S.INTENSITY_ARRAY)}</binaryDataArrayList>'
    return f'<spectrum index="{place}" id={quoteattr(r.spectrum_id)} defaultArrayLength="{mz.size}">{"".join(terms)}{scan}{before}{arrays}</spectrum>\n'


def write_mzml(spectra: DataFrame, path: str, run: str = "run") -> DataFrame:
    """One file a value of `run`, `path/<value>.mzML`, spectra by ascending index, numbered anew; (run, path, spectra) of each.

    Ids, levels, kinds, times, precursors and, where the column is there, polarity are kept; arrays are written as doubles, deflated.
    A spectrum whose arrays differ in length fails the job and leaves no file. The places of the spectra are listed at the end. A run streams through one task;
    files are written when the result is read, and put in place whole.
    """
    kept = [c for c in ("spectrum_id", "spectrum_index", "ms_level", "kind", "rt", "precursor_ref", "precursor_mz", "precursor_charge", "isolation_low", "isolation_high", "collision_energy", "mz", "intensity", "polarity") if c in spectra.columns]
    counts = spectra.groupBy(F.col(run).alias("_run")).agg(F.count("*").alias("_n"))
    rows = spectra.select(F.col(run).alias("_run"), *kept).join(counts, "_run").withColumnsRenamed({"_run": "run_name", "_n": "run_size"})

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = (r for b in batches for r in b.itertuples(index=False))
        for name, own in groupby(each, key=lambda r: r.run_name):
            target, places, at = f"{path.rstrip('/')}/{name}.mzML", [], 0
            with replaced(target, str(TaskContext.get().taskAttemptId())) as out:

                def put(text: str, out=out) -> int:
                    raw = text.encode()
                    out.write(raw)
                    return len(raw)

                at += put(HEAD)
                for r in own:
                    if not places:
                        at += put(f'<run id={quoteattr(str(name))} defaultInstrumentConfigurationRef="IC1"><spectrumList count="{r.run_size}" defaultDataProcessingRef="DP1">\n')
                    places.append(f"<offset idRef={quoteattr(r.spectrum_id)}>{at}</offset>")
                    at += put(_spectrum(r, len(places) - 1))
                at += put("</spectrumList></run></mzML>\n")
                put(f'<indexList count="1"><index name="spectrum">\n{chr(10).join(places)}\n</index></indexList>\n<indexListOffset>{at}</indexListOffset>\n</indexedmzML>\n')
            yield pd.DataFrame({"run": [str(name)], "path": [target], "spectra": [len(places)]})

    dealt = rows.repartition("run_name").sortWithinPartitions("run_name", "spectrum_index", "spectrum_id")
    return dealt.mapInPandas(write, T.StructType([T.StructField("run", T.StringType()), T.StructField("path", T.StringType()), T.StructField("spectra", T.LongType())]))
